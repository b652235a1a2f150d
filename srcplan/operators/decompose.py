"""Splitting a change into ordered tasks, by category or by clusters of related files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from srcplan.functions import paths

#: category -> (place in the order, goal, checks by letter)
CATEGORIES = {
    "schema": (0, "Update database schema", "B"),
    "proto": (1, "Update protobuf definitions", "BT"),
    "config": (2, "Update configuration", "BT"),
    "go": (3, "Implement Go logic", "BVT"),
    "typescript": (4, "Implement TypeScript logic", "C"),
    "javascript": (5, "Implement JavaScript logic", "L"),
    "python": (6, "Implement Python logic", "BT"),
    "rust": (7, "Implement Rust logic", "BT"),
    "library": (8, "Implement remaining changes", "BT"),
    "style": (9, "Apply style changes", "S"),
    "other": (10, "Implement remaining changes", "BT"),
    "documentation": (11, "Update documentation", "BT"),
    "test": (12, "Add/modify tests", "T"),
}
CHECKS = {"B": "go build ./...", "V": "go vet ./...", "T": "go test ./...", "C": "tsc --noEmit", "L": "npm run lint", "S": "npm run lint:css"}


def _lookup(key: Column, values: dict[str, object]) -> Column:
    return F.create_map(*[x for k, v in values.items() for x in (F.lit(k), v if isinstance(v, Column) else F.lit(v))])[key]


def checks(letters: str) -> Column:
    return F.array(*[F.lit(CHECKS[x]) for x in letters])


def by_category(files: DataFrame) -> DataFrame:
    """(diff_id, task_no, task_id, category, goal, allowed_files, max_lines, parallelizable, depends_on, verification): a chain of one task a category."""
    cat = files.withColumn("category", paths.task_category(F.col("path")))
    groups = cat.groupBy("diff_id", "category").agg(F.array_sort(F.collect_list("path")).alias("allowed_files"), F.sum("changed").alias("total"))
    groups = groups.withColumn("place", _lookup(F.col("category"), {k: v[0] for k, v in CATEGORIES.items()}))
    w = Window.partitionBy("diff_id").orderBy("place", "category")
    t = groups.withColumn("task_no", F.row_number().over(w)).withColumn("task_id", F.format_string("task_%03d_%s", "task_no", "category"))
    t = t.withColumn("depends_on", F.collect_list("task_id").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    return t.select(
        "diff_id",
        "task_no",
        "task_id",
        "category",
        _lookup(F.col("category"), {k: v[1] for k, v in CATEGORIES.items()}).alias("goal"),
        "allowed_files",
        F.greatest(F.lit(200), F.col("total") + F.floor(F.col("total") / 2)).alias("max_lines"),
        (F.col("task_no") == 1).alias("parallelizable"),
        "depends_on",
        _lookup(F.col("category"), {k: checks(v[2]) for k, v in CATEGORIES.items()}).alias("verification"),
    )


def label(files: Column) -> Column:
    """The last directory that all paths of an array share, else the first part of the first path."""
    parts = F.transform(files, lambda p: F.split(p, "/"))
    first = F.element_at(parts, 1)
    shared = F.filter(F.sequence(F.lit(1), F.size(first)), lambda n: F.forall(parts, lambda p: F.slice(p, F.lit(1), n) == F.slice(first, F.lit(1), n)))
    return F.element_at(first, F.greatest(F.lit(1), F.size(shared)))


def by_cluster(clusters: DataFrame, files: DataFrame) -> DataFrame:
    """(diff_id, task_no, task_id, goal, allowed_files, max_lines, parallelizable, depends_on, verification): a star on the first cluster, then the files of no cluster."""
    has = lambda *ends: F.exists("allowed_files", lambda p: paths.ends(p, *ends))
    none = F.array().cast("array<string>")
    groups = clusters.groupBy("diff_id", "cluster").agg(F.array_sort(F.collect_list(F.struct("file_idx", "path"))).alias("f"))
    groups = groups.select("diff_id", F.col("cluster").alias("task_no"), F.transform("f", lambda x: x["path"]).alias("allowed_files")).withColumn("label", label(F.col("allowed_files")))
    some = F.concat(F.when(has(".go"), checks("BVT")).otherwise(none), F.when(has(".ts", ".tsx"), checks("C")).otherwise(none), F.when(has(".sql"), checks("B")).otherwise(none))
    t = groups.select(
        "diff_id",
        "task_no",
        F.format_string("task_%03d_cluster_%s", "task_no", "label").alias("task_id"),
        F.format_string("Implement %s layer changes", "label").alias("goal"),
        "allowed_files",
        F.greatest(F.lit(200), F.size("allowed_files") * 15).cast("long").alias("max_lines"),
        F.when(F.size(some) == 0, checks("BT")).otherwise(some).alias("verification"),
    )
    last = t.groupBy("diff_id").agg(F.max("task_no").alias("n"))
    rest = files.join(last, "diff_id").join(clusters.select("diff_id", "path"), ["diff_id", "path"], "left_anti")
    rest = rest.groupBy("diff_id", "n").agg(F.transform(F.array_sort(F.collect_list(F.struct("file_idx", "path"))), lambda x: x["path"]).alias("allowed_files"))
    rest = rest.select("diff_id", (F.col("n") + 1).alias("task_no"), F.format_string("task_%03d_remainder", F.col("n") + 1).alias("task_id"), F.lit("Implement remaining changes").alias("goal"), "allowed_files", F.lit(400).cast("long").alias("max_lines"), checks("BT").alias("verification"))
    both = t.unionByName(rest)
    first = F.first("task_id").over(Window.partitionBy("diff_id").orderBy("task_no"))
    return both.withColumn("lead", first).select(
        "diff_id", "task_no", "task_id", "goal", "allowed_files", "max_lines", (F.col("task_no") == 1).alias("parallelizable"), F.when(F.col("task_no") == 1, none).otherwise(F.array("lead")).alias("depends_on"), "verification"
    )
