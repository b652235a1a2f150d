"""What leaves the engine for other hands: work orders of a decomposition, and receipts of a change."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def work_orders(tasks: DataFrame, plans: DataFrame, steps: DataFrame) -> DataFrame:
    """A work order for each task (diff_id, task_no, task_id, goal, allowed_files, ...) with its plan's id and risk and the steps on its files.

    plans: diff_id, plan_id, risk (at most one a diff; without one the risk is MEDIUM); steps: diff_id, step_no, file and more. A task without allowed files gets all steps.
    """
    kept = [c for c in steps.columns if c != "diff_id"]
    asked = tasks.select("diff_id", "task_id", F.explode_outer(F.array_distinct("allowed_files")).alias("file"))
    some = asked.filter("file is not null").join(steps, ["diff_id", "file"]).select("diff_id", "task_id", F.struct(*kept).alias("step"))
    every = asked.filter("file is null").join(steps, "diff_id").select("diff_id", "task_id", F.struct(*[steps[c] for c in kept]).alias("step"))
    found = some.union(every).groupBy("diff_id", "task_id").agg(F.array_sort(F.collect_list(F.struct(F.col("step.step_no").alias("n"), "step"))).alias("s"))
    risk = F.upper(F.coalesce(F.nullif("risk", F.lit("")), F.lit("medium")))
    out = tasks.join(plans.select("diff_id", "plan_id", "risk"), "diff_id", "left").join(found, ["diff_id", "task_id"], "left")
    return out.select(*[tasks[c] for c in tasks.columns], F.col("plan_id").alias("source_plan_id"), risk.alias("work_risk"), F.coalesce(F.transform("s", lambda x: x["step"]), F.array()).alias("steps"))


def content_hash(text):
    """SHA-256 of the whole, '' for nothing."""
    return F.when(F.coalesce(F.length(text), F.lit(0)) == 0, "").otherwise(F.sha2(text, 256))


def snippet_hash(text):
    """The first 8 bytes of SHA-256."""
    return F.substring(F.sha2(text, 256), 1, 16)


def receipts(files: DataFrame, texts: DataFrame, plans: DataFrame | None = None, verified: DataFrame | None = None) -> DataFrame:
    """(diff_id, changed, added, deleted, files, manifest, content_hash, plan_ref, verification) of each diff.

    files: with diff.facts(); texts: diff_id, text; plans: diff_id, plan_id; verified: diff_id, verification.
    """
    row = F.struct("file_idx", F.struct("path", "added", "deleted", "changed").alias("f"))
    m = files.groupBy("diff_id").agg(F.sum("changed").alias("changed"), F.sum("added").alias("added"), F.sum("deleted").alias("deleted"), F.count("*").alias("files"), F.transform(F.array_sort(F.collect_list(row)), lambda x: x["f"]).alias("manifest"))
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("changed", "added", "deleted", "files")]
    out = texts.select("diff_id", content_hash(F.col("text")).alias("content_hash")).join(m, "diff_id", "left")
    out = out.select("diff_id", *zero, F.coalesce("manifest", F.array()).alias("manifest"), "content_hash")
    for df, name in ((plans and plans.select("diff_id", F.col("plan_id").alias("plan_ref")), "plan_ref"), (verified, "verification")):
        out = out.join(df, "diff_id", "left") if df is not None else out.withColumn(name, F.lit(None).cast("string"))
    return out
