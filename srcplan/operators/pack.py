"""Choosing what fits a token budget, and hiding what should not leave."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from srcplan.functions import paths, text


def select(snippets: DataFrame, budget: int, keys: tuple[str, ...], order: tuple[str, ...]) -> DataFrame:
    """Takes snippets in order while budget is left; the one that crosses it is cut to the rest.

    snippets: with tokens and, for text that may be cut, content. Adds before, taken and truncated. What a sequential loop does in closed form.
    """
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    s = snippets.withColumn("before", F.coalesce(F.sum("tokens").over(w), F.lit(0))).filter(F.col("before") < budget)
    s = s.withColumn("taken", F.least(F.col("tokens"), F.lit(budget) - F.col("before")))
    return s.withColumn("truncated", F.col("taken") < F.col("tokens"))


def phase(kind: str, budget: int):
    """Order of kinds of snippets: small budgets take findings before components."""
    first = "diagnostic" if budget <= 4000 else "component"
    return F.when(F.col(kind) == first, 0).otherwise(1)


def summaries(files: DataFrame, findings: DataFrame) -> DataFrame:
    """(path, lines, findings, summary) of each file. files: path, lines, hooks, imports and names of components."""
    n = findings.groupBy(F.col("file").alias("path")).agg(F.count("*").alias("findings"))
    f = files.join(n, "path", "left").withColumn("findings", F.coalesce("findings", F.lit(0)))
    base = F.when(F.col("findings") > 0, F.format_string("%d lines, %d diagnostics", "lines", "findings")).otherwise(F.format_string("%d lines", "lines"))
    module = F.format_string("Module with %s, %d hooks, %d imports", base, "hooks", "imports")
    exports = F.format_string("Exports %s (%s, %d components, %d hooks)", F.array_join("components", ", "), base, F.size("components"), "hooks")
    return f.select("path", "lines", "findings", F.when(F.size("components") == 0, module).otherwise(exports).alias("summary"))


def for_task(files: DataFrame, plans: DataFrame, tasks: DataFrame, keys: tuple[str, ...] = ("diff_id",)) -> tuple[DataFrame, DataFrame]:
    """(files, plans) for each of the tasks (keys..., task_id, goal, allowed_files): the files whose path the task names exactly, and the plans with the task's goal, if it has one. Findings and steps stay whole."""
    allowed = tasks.select(*keys, "task_id", F.explode("allowed_files").alias("path")).distinct()
    scoped = files.join(tasks.select(*keys, "task_id"), list(keys)).join(allowed, [*keys, "task_id", "path"], "left_semi")
    goals = tasks.select(*keys, "task_id", F.nullif("goal", F.lit("")).alias("_goal"))
    return scoped, plans.join(goals, list(keys)).withColumn("goal", F.coalesce("_goal", "goal")).drop("_goal")


def private(df: DataFrame, mode: str, path: str, content: str) -> DataFrame:
    """mode: private (as is), redacted (paths and contents), public (paths only)."""
    if mode == "redacted":
        return df.withColumn(path, paths.redact_path(F.col(path))).withColumn(content, text.redact(F.col(content)))
    if mode == "public":
        return df.withColumn(path, paths.public_path(F.col(path)))
    if mode != "private":
        raise ValueError(f"unknown mode {mode}")
    return df
