"""Benchmark decontamination by winnowing.

Both sides are cut into words (runs of ASCII letters, digits, underscores and non-ASCII characters of the lower-cased
text). Of every `window` consecutive hashes of k-grams the smallest is kept as a fingerprint (rightmost on ties). Equal fingerprints of a
document and an item are extended to both sides as far as the words agree. As any shared run of k + window - 1 words
holds a whole window on either side, and the kept k-gram of a window depends on nothing else, every shared run of
`k + window - 1` words or more is found; runs shorter than that are not reported.

Defined results: a null or empty text, or one with fewer than `k + window - 1` words, has no hit. A null id keeps its
hits under a null id. Repeated rows count once in the result, since hits are distinct, but decontaminate judges each row by its own text, whatever its id; an item that occurs twice
in a document gives two hits. Empty tables give an empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from srcplan.llm import common as C

K, WINDOW = 6, 5
#: Test sets of up to so many characters are sent to all workers; larger ones are joined.
SMALL_CHARS = 64_000_000

HITS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("item_id", T.LongType()),
        T.StructField("doc_start", T.IntegerType()),
        T.StructField("item_start", T.IntegerType()),
        T.StructField("n_words", T.IntegerType()),
    ]
)


def fingerprints(h: np.ndarray, first: np.ndarray, k: int, window: int) -> np.ndarray:
    """Ascending word positions whose k-gram is the smallest of some window that lies within one text."""
    g = C.kgrams(h, k)
    n = len(g) - window + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    best, at = g[:n].copy(), np.zeros(n, np.int64)
    for j in range(1, window):
        less = g[j : j + n] <= best
        best[less] = g[j : j + n][less]
        at[less] = j
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    whole = text[:n] == text[k + window - 2 : k + window - 2 + n]
    return np.unique((np.arange(n) + at)[whole])


def extend(a: np.ndarray, ia: int, alo: int, ahi: int, b: np.ndarray, ib: int, blo: int, bhi: int) -> tuple[int, int]:
    """First word in a and length of the longest equal run around a[ia] and b[ib] within the bounds."""
    back = min(ia - alo, ib - blo)
    left = 0
    step = 16
    while left < back:
        m = min(step, back - left)
        eq = a[ia - left - m : ia - left][::-1] == b[ib - left - m : ib - left][::-1]
        if not eq.all():
            left += int(np.argmin(eq))
            break
        left += m
        step *= 2
    fore = min(ahi - ia, bhi - ib)
    right, step = 0, 16
    while right < fore:
        m = min(step, fore - right)
        eq = a[ia + right : ia + right + m] == b[ib + right : ib + right + m]
        if not eq.all():
            right += int(np.argmin(eq))
            break
        right += m
        step *= 2
    return ia - left, left + right


class Index:
    """All fingerprints of a test set, sorted, with its words."""

    def __init__(self, ids: list, texts: pa.Array, k: int, window: int) -> None:
        self.ids, self.k, self.window = ids, k, window
        self.h, self.first, *_ = C.words(texts)
        at = fingerprints(self.h, self.first, k, window)
        g = C.kgrams(self.h, k)[at]
        order = np.argsort(g, kind="stable")
        self.g, self.at = g[order], at[order]
        self.item = np.searchsorted(self.first, self.at, "right") - 1

    def hits(self, h: np.ndarray, first: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """(text, item, first word in the text, first word in the item, words), distinct."""
        at = fingerprints(h, first, self.k, self.window)
        if not len(at) or not len(self.g):
            return []
        g = C.kgrams(h, self.k)[at]
        lo, hi = np.searchsorted(self.g, g, "left"), np.searchsorted(self.g, g, "right")
        some = np.flatnonzero(hi > lo)
        text = np.searchsorted(first, at, "right") - 1
        out, least = {}, self.k + self.window - 1
        seen: dict[tuple[int, int, int], int] = {}
        for i in some:
            p, t = int(at[i]), int(text[i])
            for j in range(lo[i], hi[i]):
                q, e = int(self.at[j]), int(self.item[j])
                if seen.get((t, e, p - q), -1) > p:  # inside a run that is known
                    continue
                s, n = extend(h, p, int(first[t]), int(first[t + 1]), self.h, q, int(self.first[e]), int(self.first[e + 1]))
                seen[t, e, p - q] = s + n
                if n >= least:
                    out[t, e, s - int(first[t]), s - p + q - int(self.first[e]), n] = None
        return list(out)


def _rows(ids: list, items: list, found: list[tuple[int, int, int, int, int]]) -> pa.RecordBatch:
    t, e, s, q, n = zip(*found) if found else ([],) * 5
    return pa.RecordBatch.from_arrays(
        [pa.array([ids[i] for i in t], pa.int64()), pa.array([items[i] for i in e], pa.int64()), pa.array(s, pa.int32()), pa.array(q, pa.int32()), pa.array(n, pa.int32())],
        names=HITS.names,
    )


Hits = list[tuple[int, int, int, int, int]]


def _found(b: pa.RecordBatch, ids: list, found: Hits) -> pa.RecordBatch:
    return _rows(b.column("doc_id").to_pylist(), ids, found)


def _judged(b: pa.RecordBatch, ids: list, found: Hits) -> pa.RecordBatch:
    clean = np.ones(b.num_rows, bool)
    clean[[x[0] for x in found]] = False
    return pa.RecordBatch.from_arrays([b.column("row"), pa.array(clean)], names=["row", "clean"])


def _broadcast(docs: DataFrame, bench: DataFrame, k: int, window: int, schema: T.StructType, emit: Callable[[pa.RecordBatch, list, Hits], pa.RecordBatch]) -> DataFrame:
    rows = bench.collect()  # bounded: the caller checked its size
    sent = docs.sparkSession.sparkContext.broadcast(([r[0] for r in rows], [r[1] for r in rows]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts = sent.value
        index = Index(ids, pa.array(texts, pa.large_string()), k, window)
        for batch in batches:
            for b in C.blocks(batch if "text" in batch.schema.names else C.with_text(batch), "text"):
                h, first, *_ = C.words(b.column("text"))
                yield emit(b, ids, index.hits(h, first))

    return docs.transform(C.mapped, run, schema)


def _prints(df: DataFrame, key: str, k: int, window: int) -> DataFrame:
    schema = T.StructType([T.StructField(key, T.LongType()), T.StructField("fp", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in C.blocks(batch, "text"):
                h, first, *_ = C.words(b.column("text"))
                at = fingerprints(h, first, k, window)
                text = np.searchsorted(first, at, "right") - 1
                yield pa.RecordBatch.from_arrays([b.column(key).take(pa.array(text)), pa.array(C.kgrams(h, k)[at].view(np.int64))], names=[key, "fp"])

    return df.transform(C.mapped, run, schema)


def _joined(docs: DataFrame, bench: DataFrame, k: int, window: int) -> DataFrame:
    """Fingerprints meet in a shuffled join; only documents and items that share one are then brought together."""
    left = docs.withColumn("rid", F.monotonically_increasing_id())
    right = bench.withColumn("qid", F.monotonically_increasing_id())
    left, right = C.saved(left, "docs"), C.saved(right, "items")
    pairs = _prints(left.select("rid", "text"), "rid", k, window).join(_prints(right.select("qid", "text"), "qid", k, window), "fp").select("rid", "qid").distinct()
    met = pairs.join(left, "rid").join(right.select("qid", "item_id", F.col("text").alias("item")), "qid").select("doc_id", "text", "item_id", "item")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = [c.to_pylist() for c in batch.columns]
            for doc, text, item_id, item in zip(*cols):
                h, first, *_ = C.words(pa.array([text], pa.large_string()))
                if found := Index([item_id], pa.array([item], pa.large_string()), k, window).hits(h, first):
                    yield _rows([doc], [item_id], found)

    return met.transform(C.mapped, run, HITS)


def _bench(benchmark: DataFrame) -> tuple[DataFrame, int]:
    """(items that have a text, their characters)."""
    bench = benchmark.select(F.col("item_id").cast("long"), "text").filter(F.col("text").isNotNull())
    return bench, bench.agg(F.sum(F.length("text"))).first()[0] or 0


def contamination(docs: DataFrame, benchmark: DataFrame, k: int = K, window: int = WINDOW, small_chars: int = SMALL_CHARS) -> DataFrame:
    """All maximal shared runs of at least k + window - 1 words: doc_id, item_id, doc_start, item_start, n_words (in words)."""
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    bench, size = _bench(benchmark)
    return (_broadcast(docs, bench, k, window, HITS, _found) if size <= small_chars else _joined(docs, bench, k, window)).distinct()


def decontaminate(docs: DataFrame, benchmark: DataFrame, k: int = K, window: int = WINDOW, small_chars: int = SMALL_CHARS) -> DataFrame:
    """The rows of docs without any hit in their own text, with all their columns."""
    bench, size = _bench(benchmark)
    if size <= small_chars:
        carried = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"))
        schema = T.StructType([T.StructField("row", docs.schema), T.StructField("clean", T.BooleanType())])
        return _broadcast(carried, bench, k, window, schema, _judged).filter("clean").select("row.*")
    name = "_id"
    while name in docs.columns:
        name += "_"
    rows = C.saved(docs.withColumn(name, F.monotonically_increasing_id()), "rows")
    hits = _joined(rows.select(F.col(name).alias("doc_id"), "text"), bench, k, window)
    return C.without(rows, hits.select("doc_id"), name).select(*docs.columns)


ORACLE = f"""
WITH least AS (SELECT {K + WINDOW - 1} AS t),
d AS (SELECT doc_id, row_number() OVER () AS rid, regexp_extract_all(lower(text), '[0-9a-z_\\x{{80}}-\\x{{10FFFF}}]+') AS w FROM documents WHERE text IS NOT NULL),
b AS (SELECT item_id, row_number() OVER () AS qid, regexp_extract_all(lower(text), '[0-9a-z_\\x{{80}}-\\x{{10FFFF}}]+') AS w FROM benchmark WHERE text IS NOT NULL),
dg AS (SELECT rid, doc_id, i, hash(list_slice(w, i + 1, i + t)) AS g FROM (SELECT *, unnest(range(greatest(len(w) - t + 1, 0))) AS i FROM d, least)),
bg AS (SELECT qid, item_id, j, hash(list_slice(w, j + 1, j + t)) AS g FROM (SELECT *, unnest(range(greatest(len(w) - t + 1, 0))) AS j FROM b, least)),
m AS (SELECT rid, doc_id, qid, item_id, i, j, i - row_number() OVER (PARTITION BY rid, qid, i - j ORDER BY i) AS island FROM dg JOIN bg USING (g))
SELECT DISTINCT doc_id, item_id, CAST(min(i) AS INTEGER) AS doc_start, CAST(min(j) AS INTEGER) AS item_start, CAST(count(*) + (SELECT t - 1 FROM least) AS INTEGER) AS n_words
FROM m GROUP BY rid, doc_id, qid, item_id, i - j, island
"""
