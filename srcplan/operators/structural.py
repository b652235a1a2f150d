"""What kind of work a change adds, and how well its files belong together."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from srcplan.functions import paths
from srcplan.operators.diff import sums

LOW_COHESION, SIMILAR = 0.6, 0.3
#: Written files of a diff up to which all pairs are formed within its row; the pairs of larger diffs meet by word in a join.
IN_ROW = 400


def rounded(c: Column, places: int = 9) -> Column:
    """A double with so many places, halves by its product with their power of ten, as SQL has it; Spark's own rounding goes by the shortest decimal form, which for 169 / 5120 and other ratios of large changes gives another last place."""
    return F.round(c * 10.0**places) / 10.0**places


def _bucketed(files: DataFrame) -> DataFrame:
    """Adds bucket, null for files that count nowhere, and passing, the ephemeral part of the added lines."""
    bucket = paths.bucket(F.col("path"), F.col("is_generated"), F.col("is_lockfile"))
    share = F.when(F.col("path").endswith(".go"), F.lit(0.10)).otherwise(F.lit(0.05))
    f = files.withColumn("bucket", F.when(~F.col("is_binary") & (F.col("added") > 0), bucket))
    return f.withColumn("passing", F.when(F.col("bucket").isin("logic", "test"), F.least(F.round(F.col("added") * share).cast("int"), F.col("added"))).otherwise(0))


def _sums() -> list[Column]:
    total = lambda name: F.coalesce(F.sum(F.when(F.col("bucket") == name, F.col("added") - F.col("passing"))), F.lit(0))
    return [
        total("logic").alias("logic"),
        total("test").alias("test"),
        F.sum("passing").alias("ephemeral"),
        F.lit(0).cast("long").alias("reusable"),
        total("config_data").alias("config_data"),
        total("config_structural").alias("config_structural"),
        total("generated").alias("generated"),
    ]


def buckets(files: DataFrame) -> DataFrame:
    """Added lines by bucket for each diff. files: with diff.facts(); binary files and those without added lines count nowhere."""
    return _bucketed(files).groupBy("diff_id").agg(*_sums())


def ratios(summed: DataFrame, *keep: str) -> DataFrame:
    """overhead, test_to_logic (infinite for tests without logic) and productive for rows of buckets(), with the columns to keep."""
    c = F.col
    work, support = c("logic") + c("reusable"), c("ephemeral") + c("config_structural")
    part = lambda a, b: F.when(b != 0, a / b).otherwise(0.0)
    return summed.select(
        "diff_id",
        part(support, work + support).alias("overhead"),
        F.when(work != 0, c("test") / work).when(c("test") > 0, F.lit(float("inf"))).otherwise(0.0).alias("test_to_logic"),
        part(c("reusable"), c("reusable") + c("ephemeral")).alias("productive"),
        *keep,
    )


def _written(files: DataFrame) -> DataFrame:
    return files.filter("not is_generated and not is_lockfile and not is_binary").select("diff_id", "file_idx", "path", paths.tokens(F.col("path")).alias("words"))


def similarities(files: DataFrame) -> DataFrame:
    """(diff_id, a, b, jaccard) for all pairs of written files of a diff, by file_idx, that share a word of their paths.

    Pairs meet by word, so files that share none are never compared.
    """
    return _similar(_written(files))


def _similar(written: DataFrame) -> DataFrame:
    words = written.select("diff_id", "file_idx", F.size("words").alias("n"), F.explode("words").alias("word"))
    other = words.select("diff_id", "word", F.col("file_idx").alias("b"), F.col("n").alias("nb"))
    met = words.join(other, ["diff_id", "word"]).filter("file_idx < b").groupBy("diff_id", F.col("file_idx").alias("a"), "b").agg(F.count("*").alias("both"), F.first("n").alias("na"), F.first("nb").alias("nb"))
    return met.select("diff_id", "a", "b", (F.col("both") / (F.col("na") + F.col("nb") - F.col("both"))).alias("jaccard"))


def _items() -> Column:
    """The written files of a diff with the words of their paths, as an aggregate."""
    written = ~F.col("is_generated") & ~F.col("is_lockfile") & ~F.col("is_binary")
    return F.array_sort(F.collect_list(F.when(written, F.struct("file_idx", "path", paths.tokens(F.col("path")).alias("words")))))


def _link(rows: DataFrame, files: DataFrame, in_row: int) -> DataFrame:
    """Replaces f of rows, as _items() has it, by (f, variance, edges), see linked()."""

    def jaccard(x: Column, y: Column) -> Column:
        both = F.size(F.array_intersect(x["words"], y["words"]))
        return both / (F.size(x["words"]) + F.size(y["words"]) - both)

    # files that share no word are at 0; a path without any word is like no other
    some = lambda x, y: F.size(x["words"]) + F.size(y["words"]) > 0
    after = lambda i: F.slice("f", i + 2, F.size("f"))
    pairs = F.flatten(F.transform("f", lambda x, i: F.transform(after(i), lambda y: F.struct(x["file_idx"].alias("a"), y["file_idx"].alias("b"), F.when(some(x, y), jaccard(x, y)).otherwise(0.0).alias("j")))))
    # diffs with more files than that have their pairs made by a join; which they are follows from the number of all their files
    large = files.groupBy("diff_id").agg(F.count("*").alias("n")).filter(F.col("n") > in_row).select("diff_id")
    near = _similar(_written(files.join(large, "diff_id", "left_semi")))
    near = near.groupBy("diff_id").agg(F.sum("jaccard").alias("_s"), F.collect_list(F.when(F.col("jaccard") >= SIMILAR, F.struct("a", "b"))).alias("_e"))
    out = rows.withColumn("_pairs", F.when(F.size("f") <= in_row, pairs)).join(near, "diff_id", "left")
    n, small = F.size("f").cast("long"), F.col("_pairs").isNotNull()
    total = F.when(small, F.aggregate("_pairs", F.lit(0.0), lambda s, p: s + p["j"])).otherwise(F.coalesce("_s", F.lit(0.0)))
    edges = F.when(small, F.transform(F.filter("_pairs", lambda p: p["j"] >= SIMILAR), lambda p: F.struct(p["a"].alias("a"), p["b"].alias("b")))).otherwise(F.coalesce("_e", F.array()))
    # rounded, as sums of doubles depend on their order and the value is compared with a threshold
    variance = F.when(n < 2, 0.0).otherwise(F.round(1 - total / F.greatest(F.lit(1), n * (n - 1) / 2), 12))
    kept = [c for c in rows.columns if c != "f"]
    return out.select(*kept, F.transform("f", lambda x: F.struct(x["file_idx"].alias("file_idx"), x["path"].alias("path"))).alias("f"), variance.alias("variance"), edges.alias("edges"))


def linked(files: DataFrame, in_row: int = IN_ROW) -> DataFrame:
    """(diff_id, f, variance, edges): the written files of each diff (file_idx, path), one less the mean similarity of all pairs (0 for fewer than two files), and the similar pairs.

    One shuffle for diffs of up to in_row files; of larger ones, which would have too many pairs for a row, pairs meet by word.
    """
    return _link(files.groupBy("diff_id").agg(_items().alias("f")), files, in_row)


def profile(files: DataFrame, in_row: int = IN_ROW) -> DataFrame:
    """What totals(), buckets() and linked() say of each diff, in one row and one pass."""
    return _link(_bucketed(files).groupBy("diff_id").agg(*sums(), *_sums(), _items().alias("f")), files, in_row)


def cohesion(files: DataFrame, in_row: int = IN_ROW) -> DataFrame:
    """(diff_id, variance): one less the mean similarity of all pairs of written files, 0 for fewer than two."""
    return linked(files, in_row).select("diff_id", "variance")


def suggested(grouped: DataFrame) -> DataFrame:
    """(diff_id, suggested): the clusters of a diff by their first and last file, as findings name them."""
    ends = grouped.groupBy("diff_id", "cluster").agg(F.format_string("[%s...%s]", F.min_by("path", "file_idx"), F.max_by("path", "file_idx")).alias("s"))
    return ends.groupBy("diff_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("cluster", "s"))), lambda x: x["s"]), ", ").alias("suggested"))


def clusters(files: DataFrame, in_row: int = IN_ROW) -> DataFrame:
    """(diff_id, cluster, file_idx, path) for diffs of low cohesion: connected files by similarity, groups of two and more, numbered by their first file."""
    return _united(linked(files, in_row))


def _united(linked_rows: DataFrame) -> DataFrame:
    """clusters() of rows of linked()."""
    schema = T.StructType([T.StructField("diff_id", linked_rows.schema["diff_id"].dataType), T.StructField("cluster", T.IntegerType()), T.StructField("file_idx", T.LongType()), T.StructField("path", T.StringType())])
    kinds = [f.type for f in to_arrow_schema(schema)]

    def unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Union-find within each row."""
        for batch in batches:
            rows = []
            for diff, files, edges in zip(*(c.to_pylist() for c in batch.columns)):
                root: dict[int, int] = {}

                def find(x: int) -> int:
                    while root.setdefault(x, x) != x:
                        root[x] = root[root[x]]
                        x = root[x]
                    return x

                for e in edges:
                    a, b = sorted((find(e["a"]), find(e["b"])))
                    root[b] = a
                number = {r: k + 1 for k, r in enumerate(sorted({find(x) for x in list(root)}))}
                rows.extend((diff, number[find(x["file_idx"])], x["file_idx"], x["path"]) for x in files if x["file_idx"] in root)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=schema.names)

    low = linked_rows.filter((F.col("variance") > LOW_COHESION) & (F.size("edges") > 0))
    return low.select("diff_id", "f", "edges").mapInArrow(unite, schema).withColumn("file_idx", F.col("file_idx").cast(linked_rows.schema["f"].dataType.elementType["file_idx"].dataType))
