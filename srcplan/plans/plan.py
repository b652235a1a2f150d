"""From findings to plans, for many plans at once.

Findings: plan, diag_idx, code, severity, file, line, symbol, message (component optional). A plan is partitioned by its key
throughout, so plans are made in parallel and one plan is one window partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from srcplan.functions import text
from srcplan.plans.registry import registry

VERSION = "0.1"
#: What identifies a plan before its findings, in the order of its hash.
HEAD = ("source", "subject", "language", "goal")


def target(df: DataFrame) -> Column:
    """The symbol, else the component, else the file."""
    empty = lambda c: F.nullif(F.col(c), F.lit("")) if c in df.columns else F.lit(None).cast("string")
    return F.coalesce(empty("symbol"), empty("component"), F.col("file"))


def order_findings(findings: DataFrame) -> DataFrame:
    """Adds diag_no and diag_id in normal order: severity, file, line (0 last), code, symbol, message."""
    line = F.coalesce(F.nullif(F.col("line"), F.lit(0)), F.lit(2**31 - 1))
    w = Window.partitionBy("plan").orderBy(text.severity_rank(F.col("severity")), "file", line, "code", F.coalesce("symbol", F.lit("")), "message", "diag_idx")
    return findings.withColumn("diag_no", F.row_number().over(w)).withColumn("diag_id", F.format_string("diag_%03d", "diag_no"))


def steps(ordered: DataFrame, tool: str = "srcplan") -> DataFrame:
    """(plan, step_no, step_id, recipe, action, file, risk, verify, requires): a step for each finding that has a recipe. The registry is fixed and small, hence broadcast."""
    f = ordered.join(F.broadcast(registry(ordered.sparkSession, tool=tool)), "code")
    action = F.regexp_replace(F.replace(F.regexp_replace("template", "%s", "\0"), F.lit("\0 (\0)"), F.lit("\0 (\1)")), "\0", "\0")
    action = F.replace(F.replace(action, F.lit("\0"), target(ordered)), F.lit("\1"), F.col("file"))
    f = f.withColumn("action", action).withColumn("risk", F.when(F.col("recipe_risk") == "=", F.col("severity")).otherwise(F.col("recipe_risk")))
    w = Window.partitionBy("plan").orderBy(text.severity_rank(F.col("risk")), "file", "recipe", "action", "diag_no")
    name = F.when(F.coalesce("symbol", F.lit("")) != "", F.col("symbol")).otherwise(text.stem(F.col("file")))
    f = f.withColumn("step_no", F.row_number().over(w)).withColumn("step_id", F.format_string("step_%03d_%s_%s", "step_no", "code", text.slug(name)))
    return f.select("plan", "step_no", "step_id", "recipe", "action", "file", "risk", "verify", F.array("diag_id").alias("requires"))


def fallback_step(recipe: str, on: str) -> dict[str, object]:
    """The one step of a plan that is asked for by recipe."""
    return {"recipe": recipe, "action": f"Apply recipe {recipe} to {on}", "verify": ["typecheck", "tests"], "file": on, "risk": "medium"}


def risk(planned: DataFrame) -> DataFrame:
    """(plan, risk, tokens): the highest risk of a plan's steps, and the estimate of tokens of its actions."""
    least = F.min(text.severity_rank(F.col("risk")))
    return planned.groupBy("plan").agg(F.when(least == 0, "high").when(least == 1, "medium").otherwise("low").alias("risk"), F.sum(text.estimate_tokens(F.col("action"))).alias("tokens"))


def goal(findings: DataFrame, on: Column) -> DataFrame:
    """(plan, goal) from which codes occur."""
    has = lambda *codes: F.bool_or(F.col("code").isin(*codes))
    part = lambda word: F.bool_or(F.col("code").contains(word))
    seen = findings.groupBy("plan").agg(
        F.array_compact(F.array(F.when(has("go.large-file"), "split large files"), F.when(has("go.long-function", "go.high-complexity", "go.deep-nesting"), "simplify complex functions"), F.when(has("go.ignored-error"), "handle ignored errors"))).alias("go"),
        F.array_compact(F.array(F.when(part("component"), "reduce component size"), F.when(part("hook"), "extract custom hooks"))).alias("react"),
    )
    parts = F.when(F.size("go") > 0, F.col("go")).when(F.size("react") > 0, F.col("react")).otherwise(F.array(F.lit("improve code structure")))
    return seen.select("plan", F.concat(F.lit("Refactor "), on, F.lit(": "), F.array_join(parts, " and ")).alias("goal"))


def plan_ids(plans: DataFrame, ordered: DataFrame, planned: DataFrame) -> DataFrame:
    """(plan, plan_id): a hash of header, findings and steps in normal order. plans: plan, source, subject, language, goal."""
    d = ordered.groupBy("plan").agg(F.array_sort(F.collect_list(F.struct("diag_no", F.concat("code", "file", F.col("line").cast("string"), F.coalesce("symbol", F.lit(""))).alias("s")))).alias("d"))
    s = planned.groupBy("plan").agg(F.array_sort(F.collect_list(F.struct("step_no", F.concat("recipe", "action", "file").alias("s")))).alias("s"))
    joined = lambda c: F.coalesce(F.array_join(F.transform(c, lambda x: x["s"]), ""), F.lit(""))
    all_parts = plans.join(d, "plan", "left").join(s, "plan", "left")
    body = F.concat(F.lit(VERSION), *HEAD, joined("d"), joined("s"))
    return all_parts.select("plan", F.concat(F.lit("grp_"), F.substring(F.sha2(body, 256), 1, 8)).alias("plan_id"))
