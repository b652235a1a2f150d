"""Whether a change fits a review budget, and the findings that say why not."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from srcplan.operators import structural

MAX_LINES, MAX_FILES, SLACK = 1500, 12, 500


def _decimal(c: Column, places: int) -> Column:
    """A ratio with so many places, halves to even."""
    return F.when(F.abs(c) == float("inf"), F.lit("+Inf")).otherwise(F.replace(F.format_number(F.when(F.abs(c) != float("inf"), c), places), F.lit(",")))


def verdict(totals: DataFrame, max_lines: int = MAX_LINES, max_files: int = MAX_FILES) -> DataFrame:
    """Adds status and recommendation to rows of diff.totals()."""
    lines, files = F.col("changed") > max_lines, F.col("files") > max_files
    mixed = F.size("categories") > 2
    reasons = F.array_compact(
        F.array(
            F.when(lines, F.format_string("Diff is %d lines (budget: %d)", "changed", F.lit(max_lines))),
            F.when(files, F.format_string("Diff touches %d files (budget: %d)", "files", F.lit(max_files))),
            F.when(F.col("has_generated") | F.col("has_lockfile"), F.lit("Diff includes generated or lockfile changes")),
        )
    )
    found = lines.cast("int") + files.cast("int") + mixed.cast("int")
    out = totals.withColumns({"reasons": reasons, "findings": found})
    status = F.when((F.size("reasons") == 0) & (F.col("findings") == 0), "pass").when((F.col("findings") <= 1) & (F.col("changed") <= max_lines + SLACK), "warn").otherwise("fail")
    out = out.withColumn("status", status).withColumn("recommendation", F.when(F.col("status") == "fail", "decompose").otherwise("review"))
    lead = F.when(F.col("status") == "warn", "Diff approaches budget limits: ").otherwise("Diff exceeds reviewability budget: ")
    return out.withColumn("reason", F.when(F.col("status") == "pass", "Diff is within reviewability budget").otherwise(F.concat(lead, F.array_join("reasons", "; "))))


def profiled(files: DataFrame, max_lines: int = MAX_LINES, max_files: int = MAX_FILES) -> tuple[DataFrame, DataFrame]:
    """(verdicts, diagnostics) of all diffs of files with diff.facts(), from one row a diff; the names of its clusters are made from rows of low cohesion only."""
    rows = structural.profile(files)
    judged = verdict(rows, max_lines, max_files)
    ratios = structural.ratios(judged, *[c for c in judged.columns if c != "diff_id"])
    named = structural.suggested(structural._united(rows))
    return judged, diagnostics(ratios.join(named, "diff_id", "left"), None, max_lines, max_files)


def diagnostics(judged: DataFrame, kinds: DataFrame | None, max_lines: int = MAX_LINES, max_files: int = MAX_FILES) -> DataFrame:
    """(diff_id, ord, code, severity, confidence, message) of rows of verdict() joined with kinds: diff_id, overhead, test_to_logic, productive, variance, ephemeral, reusable and, if groups of files are to be named, suggested as structural.suggested() has it; None if judged has these."""
    j = judged if kinds is None else judged.join(kinds, "diff_id")
    c = F.col
    suggested = F.coalesce(F.concat(F.lit(" (suggested clusters: "), c("suggested"), F.lit(")")), F.lit("")) if "suggested" in j.columns else F.lit("")
    heavy, loose = c("overhead") > 0.5, c("variance") > structural.LOW_COHESION
    rules = [
        ("agent.diff-too-large", "high", "high", c("changed") > max_lines, F.format_string("Diff is %d lines, exceeds reviewability budget of %d", "changed", F.lit(max_lines))),
        ("agent.too-many-files-touched", "high", "high", c("files") > max_files, F.format_string("Diff touches %d files, exceeds reviewability budget of %d", "files", F.lit(max_files))),
        ("agent.mixed-boundaries", "medium", "medium", F.size("categories") > 2, F.format_string("Diff spans %d categories ([%s]), suggests mixed concerns", F.size("categories"), F.array_join("categories", " "))),
        ("agent.unreviewable-plan", "high", "high", c("status") == "fail", c("reason")),
        ("agent.parallelization-opportunity", "low", "medium", (c("status") == "fail") & (c("files") > 1), F.format_string("Diff touches %d files which could be parallelized across tasks", "files")),
        ("agent.high-overhead", "medium", "high", heavy, F.format_string("Structural overhead ratio is %s (threshold: 0.50)", _decimal(c("overhead"), 2))),
        ("agent.low-cohesion", "medium", "high", loose, F.format_string("Cohesion variance is %s (threshold: 0.60)%s", _decimal(c("variance"), 2), suggested)),
        ("agent.test-to-code-imbalance", "medium", "medium", (c("test_to_logic") > 3) & (c("ephemeral") > c("reusable")), F.format_string("Test-to-logic ratio is %s (threshold: 3.0) with no reusable scaffold", _decimal(c("test_to_logic"), 1))),
        ("agent.ceremonial-noise", "high", "high", heavy & loose, F.lit("Diff has high structural overhead and low cohesion — high ceremonial noise")),
        ("agent.productive-scaffold", "low", "high", (c("productive") > 0.5) & (c("reusable") >= 20), F.format_string("Productive scaffold ratio is %s with %d reusable lines", _decimal(c("productive"), 2), "reusable")),
    ]
    each = F.array_compact(F.array(*[F.when(test, F.struct(F.lit(k).alias("ord"), F.lit(code).alias("code"), F.lit(severity).alias("severity"), F.lit(sure).alias("confidence"), message.alias("message"))) for k, (code, severity, sure, test, message) in enumerate(rules)]))
    return j.select("diff_id", F.explode(each).alias("d")).select("diff_id", "d.*")


def envelopes(judged: DataFrame, kinds: DataFrame, found: DataFrame, spec: str = "agent-safety", version_key: str = "version") -> DataFrame:
    """(diff_id, status, json): the review of each diff as one JSON document with verdict, structure and findings, which is the only form that has all three.

    judged: of verdict(); kinds: diff_id and what is known of its structure; found: of diagnostics(). A diff without findings has no list of them. Infinite ratios become null.
    """
    d = found.groupBy("diff_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", F.struct("code", "severity", "confidence", "message").alias("d")))), lambda x: x["d"]).alias("diagnostics"))
    finite = [(F.when(F.abs(F.col(f.name)) != float("inf"), F.col(f.name)) if f.dataType.typeName() == "double" else F.col(f.name)).alias(f.name) for f in kinds.schema.fields if f.name != "diff_id"]
    k = kinds.select("diff_id", F.struct(*finite).alias("structural"))
    observed = F.struct("added", "deleted", "changed", "files", F.col("largest_delta").alias("largestDelta"))
    r = judged.select("diff_id", "status", F.struct("status", "recommendation", "reason", observed.alias("observed")).alias("review"))
    body = F.to_json(F.struct(F.lit("0.1").alias(version_key), F.lit(spec).alias("spec"), "review", "structural", "diagnostics"))
    return r.join(k, "diff_id", "left").join(d, "diff_id", "left").select("diff_id", "status", body.alias("json"))
