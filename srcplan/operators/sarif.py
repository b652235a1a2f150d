"""Findings as SARIF 2.1.0: rules in order of first occurrence, results that point at them, counts, and the whole document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def level(severity: Column) -> Column:
    return F.when(severity == "high", "error").when(severity == "medium", "warning").otherwise("note")


def first_sentence(text: Column) -> Column:
    at = F.coalesce(F.nullif(F.instr(text, ". "), F.lit(0)), F.nullif(F.instr(text, ".\n"), F.lit(0)))
    return F.when(at.isNotNull(), F.substring(text, F.lit(1), at)).when(text.endswith("."), text).otherwise(F.concat(text, F.lit(".")))


def _some(df: DataFrame, name: str) -> Column:
    return F.nullif(F.col(name), F.lit("")) if name in df.columns else F.lit(None).cast("string")


def rules(findings: DataFrame) -> DataFrame:
    """(rule_index, id, name, short, full, level, severity) of each code; the finding of least diag_idx describes it."""
    f = findings
    name = F.coalesce(_some(f, "symbol"), _some(f, "component"), F.col("code"))
    full = F.when(_some(f, "suggestion").isNotNull(), F.concat("message", F.lit("\n\nSuggestion: "), _some(f, "suggestion"))).otherwise(F.col("message"))
    first = f.groupBy("code").agg(F.min(F.struct("diag_idx", name.alias("name"), first_sentence(F.col("message")).alias("short"), full.alias("full"), level(F.col("severity")).alias("level"), "severity")).alias("x"))
    # one row a code from here on: the number of rules, not of findings, is sorted
    place = F.transform(F.array_sort(F.collect_list(F.struct("x.diag_idx", F.struct(F.col("code").alias("id"), "x.name", "x.short", "x.full", "x.level", "x.severity").alias("r")))), lambda y: y["r"])
    return first.agg(place.alias("r")).select(F.posexplode("r").alias("rule_index", "r")).select("rule_index", "r.*")


def results(findings: DataFrame) -> DataFrame:
    """(diag_idx, rule_id, rule_index, message, level, uri, start_line, end_line) of each finding."""
    index = rules(findings).select(F.col("id").alias("code"), "rule_index")
    end = F.when(F.coalesce("end_line", F.lit(0)) > 0, F.col("end_line")).otherwise(F.col("line")) if "end_line" in findings.columns else F.col("line")
    return findings.join(index, "code").select(
        "diag_idx", F.col("code").alias("rule_id"), "rule_index", "message", level(F.col("severity")).alias("level"), F.col("file").alias("uri"), F.col("line").alias("start_line"), end.alias("end_line")
    )


def counts(findings: DataFrame) -> DataFrame:
    n = lambda s: F.count_if(level(F.col("severity")) == s)
    return findings.agg(F.count("*").alias("diagnosticCount"), n("error").alias("errorCount"), n("warning").alias("warningCount"), n("note").alias("noteCount"))


#: Results in a piece of a document at most.
PIECE = 4096


def _result() -> Column:
    """A row of results() as a document has it."""
    c = F.col
    place = F.struct(F.struct(F.struct(c("uri"), F.lit("%SRCROOT%").alias("uriBaseId")).alias("artifactLocation"), F.struct(c("start_line").alias("startLine"), c("end_line").alias("endLine")).alias("region")).alias("physicalLocation"))
    return F.struct(c("rule_id").alias("ruleId"), c("rule_index").alias("ruleIndex"), F.struct(c("message").alias("text")).alias("message"), "level", F.array(place).alias("locations"))


def frame(findings: DataFrame, tool: str = "srcplan", version: str = "0.1", uri: str = "") -> DataFrame:
    """One row, head and tail: what stands before and after the results of a document."""
    r = rules(findings).agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("rule_index", "id", "name", "short", "full", "level", "severity"))),
            lambda x: F.struct(x["id"].alias("id"), x["name"].alias("name"), F.struct(x["short"].alias("text")).alias("shortDescription"), F.struct(x["full"].alias("text")).alias("fullDescription"), F.struct(x["level"].alias("level")).alias("defaultConfiguration"), F.struct(x["severity"].alias("severity")).alias("properties")),
        ).alias("rules")
    )
    c = counts(findings).select(F.struct("*").alias("properties"))
    driver = F.struct(F.lit(tool).alias("name"), F.lit(version).alias("version"), F.lit(uri).alias("informationUri"), "rules")
    schema = "https://raw.githubusercontent.com/oasis-tcs/sarif-spec/master/Schemata/sarif-schema-2.1.0.json"
    before, after = F.to_json(F.struct(F.struct(driver.alias("driver")).alias("tool"))), F.to_json(F.struct(F.lit("utf16CodeUnits").alias("columnKind"), "properties"))
    cut = lambda j, first, less: F.substring(j, F.lit(first), F.length(j) - less)
    return r.crossJoin(c).select(
        F.concat(F.lit('{"$schema":"' + schema + '","version":"2.1.0","runs":['), cut(before, 1, 1), F.lit(',"results":[')).alias("head"),
        F.concat(F.lit("],"), cut(after, 2, 1), F.lit("]}")).alias("tail"),
    )


def pieces(findings: DataFrame) -> DataFrame:
    """(part, n, json): the results of a document in order of part, n to a piece, each piece a JSON array. No row holds more than PIECE results, however many findings there are."""
    by = ["diag_idx", "rule_id", "rule_index", "message", "level", "uri", "start_line", "end_line"]
    r = results(findings).repartitionByRange("diag_idx").sortWithinPartitions(*by)
    # ids rise from partition to partition and by one within each, from multiples of the size on
    r = r.select(F.monotonically_increasing_id().alias("place"), _result().alias("x")).withColumn("part", F.shiftright("place", PIECE.bit_length() - 1))
    return r.groupBy("part").agg(F.count("*").alias("n"), F.concat(F.lit("["), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", F.to_json("x").alias("x")))), lambda e: e["x"]), ","), F.lit("]")).alias("json"))


def parts(findings: DataFrame, tool: str = "srcplan", version: str = "0.1", uri: str = "") -> DataFrame:
    """(part, json): a document of any size as texts that give it when they are written one after the other in order of part."""
    f, p = frame(findings, tool, version, uri), pieces(findings)
    # the first piece is always 0, as the range of the least rows is never empty
    some = p.select("part", F.concat(F.when(F.col("part") == 0, "").otherwise(","), F.substring("json", F.lit(2), F.length("json") - 2)).alias("json"))
    return f.select(F.lit(-1).cast("long").alias("part"), F.col("head").alias("json")).union(some).union(f.select(F.lit(2**63 - 1).alias("part"), F.col("tail").alias("json")))


def document(findings: DataFrame, tool: str = "srcplan", version: str = "0.1", uri: str = "") -> DataFrame:
    """One row, json: the whole document. A sink: its size is that of all findings, so it is meant for reports; parts() has documents of any size."""
    p = parts(findings, tool, version, uri)
    return p.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "json"))), lambda x: x["json"]), "").alias("json"))
