"""Line dedup with a sharded minimal perfect hash.

A line counts if it has `min_chars` characters after trimming blanks. Workers count the distinct documents (rows) of
each 64-bit line hash and note the least 32-bit digest of a text that has it. The hashes go to shards by their value, and each shard lays a minimal perfect hash over its distinct
hashes: levels of bit arrays, in which a hash sits at the first level where it met no other. The rank of its
bit indexes a 16-bit fingerprint, a 16-bit saturating count and the digest. Documents probe these arrays; no line is joined. While the arrays of all shards are small
together they are sent to every worker. Beyond `small_bytes` the hashes of lines go to the shards instead, and only those that hit come back.

A line that is in `min_docs` rows or more, or in `long_docs` if it has `long_words` words or more, is removed wherever it is but in the text of the least digest (the first 8 hexadecimal
digits of its MD5; copies of that text keep it alike), so that nothing is lost. How much of a document goes makes no difference.

`passages_once` does the same for long lines only, from 2 texts on, by joins. It is meant for documents that near-dedup has left, whose copies would else be cut to pieces.

Defined results: null and empty texts come back as they are; a repeated line within a document counts once, and goes or stays everywhere; repeated
rows count as documents of their own. Every input row gives one row, with all columns; only `text` changes. Empty tables give
empty results. Lines of any length are hashed whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from srcplan.llm import common as C

MIN_DOCS, MIN_CHARS = 5, 20
LONG_DOCS, LONG_WORDS = 2, 50
#: Lines of a shard at most, if all were of MIN_CHARS characters and different.
SHARD_LINES = 4_000_000
#: Lines that ask one shard at once, where the arrays are not sent.
ASK_LINES = 2_000_000
#: Arrays of up to so many bytes are sent to all workers (about 9 bytes a distinct line).
SMALL_BYTES = 96 << 20
GAMMA = 2.0
U64, U32 = np.uint64, np.uint32

INDEX = T.StructType([T.StructField(n, T.BinaryType() if n != "shard" else T.IntegerType()) for n in ("shard", "sizes", "bits", "ranks", "prints", "counts", "first")])


class PerfectHash:
    """Minimal perfect hash over distinct 64-bit hashes, with a fingerprint, a count and the least digest of a text for each."""

    def __init__(self, sizes: np.ndarray, bits: np.ndarray, ranks: np.ndarray, prints: np.ndarray, counts: np.ndarray, first: np.ndarray) -> None:
        self.sizes, self.bits, self.ranks, self.prints, self.counts, self.first = sizes, bits, ranks, prints, counts, first

    @staticmethod
    def _slot(h: np.ndarray, level: int, size: int) -> np.ndarray:
        x = C.mix(h ^ U64((0x9E3779B97F4A7C15 * (level + 1)) & (2**64 - 1)))
        return ((x >> U64(32)) * U64(size)) >> U64(32)

    @classmethod
    def build(cls, h: np.ndarray, counts: np.ndarray, first: np.ndarray) -> PerfectHash:
        rest, sizes, parts = h, [], []
        while len(rest):
            size = max(64, int(len(rest) * GAMMA + 63) // 64 * 64)
            at = cls._slot(rest, len(sizes), size).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            sizes.append(size)
            parts.append(alone)
            rest = rest[~alone[at]]
        flags = np.concatenate(parts) if parts else np.zeros(0, bool)
        bits = np.packbits(flags, bitorder="little").view(U64)
        ranks = np.zeros(len(bits), U32)
        np.cumsum(np.bitwise_count(bits)[:-1], out=ranks[1:]) if len(bits) else None
        out = cls(np.array(sizes, np.int64), bits, ranks, np.zeros(len(h), np.uint16), np.zeros(len(h), np.uint16), np.zeros(len(h), U32))
        where = out.index(h)
        out.prints[where] = (h & U64(0xFFFF)).astype(np.uint16)
        out.counts[where] = np.minimum(counts, 65535)
        out.first[where] = first
        return out

    def index(self, h: np.ndarray) -> np.ndarray:
        """Slot of each hash; -1 where no level holds it."""
        out = np.full(len(h), -1, np.int64)
        pending, base = np.arange(len(h)), 0
        for level, size in enumerate(self.sizes):
            at = self._slot(h[pending], level, int(size)) + U64(base)
            word, bit = (at >> U64(6)).astype(np.int64), at & U64(63)
            w = self.bits[word]
            hit = (w >> bit) & U64(1) == 1
            below = w & ((U64(1) << bit) - U64(1))
            out[pending[hit]] = self.ranks[word[hit]].astype(np.int64) + np.bitwise_count(below[hit])
            pending = pending[~hit]
            base += int(size)
            if not len(pending):
                break
        return out

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(documents of each hash, least digest of a text that has it); 0 documents for a hash that the fingerprint tells is not a member."""
        at = self.index(h)
        ok = at >= 0
        ok[ok] = self.prints[at[ok]] == (h[ok] & U64(0xFFFF)).astype(np.uint16)
        if not len(self.counts):
            return np.zeros(len(h), np.uint16), np.zeros(len(h), U32)
        at = np.maximum(at, 0)
        return np.where(ok, self.counts[at], np.uint16(0)), self.first[at]

    def row(self) -> list[bytes]:
        return [x.tobytes() for x in (self.sizes, self.bits, self.ranks, self.prints, self.counts, self.first)]

    @classmethod
    def of(cls, sizes: bytes, bits: bytes, ranks: bytes, prints: bytes, counts: bytes, first: bytes) -> PerfectHash:
        return cls(*(np.frombuffer(b, k) for b, k in ((sizes, np.int64), (bits, U64), (ranks, U32), (prints, np.uint16), (counts, np.uint16), (first, U32))))


def _long(line: Column, words: int) -> Column:
    # runs of blanks need an expression, single ones are counted
    t = F.trim(line)
    n = F.when(t.contains("  "), F.size(F.split(t, " +"))).otherwise(F.length(t) - F.length(F.replace(t, F.lit(" "), F.lit(""))) + 1)
    return (F.length(line) >= 2 * words - 1) & (n >= words)


def line_hashes(text: Column, min_chars: int, long_words: int) -> Column:
    """Hash of each line of the text in order, null for one that is too short to count; the last bit tells whether a line is long."""
    h = lambda x: F.xxhash64(F.trim(x)).bitwiseAND(F.lit(-2)).bitwiseOR(_long(x, long_words).cast("long"))
    return F.transform(F.split(text, "\n", -1), lambda x: F.when(F.length(F.trim(x)) >= min_chars, h(x)))


def digest(text: Column) -> Column:
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def shard_of(h: np.ndarray, shards: int) -> np.ndarray:
    return ((C.mix(h) >> U64(32)) * U64(shards) >> U64(32)).astype(np.int32)


def shards_for(docs: DataFrame, min_chars: int) -> int:
    """So many shards that none has more than about SHARD_LINES lines."""
    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    return max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-chars // (max(1, min_chars) * SHARD_LINES)))


def _merged(h: np.ndarray, n: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct hashes with the sum of n and the least of first."""
    order = np.argsort(h)
    h, n, first = h[order], n[order], first[order]
    begin = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
    return h[begin], np.add.reduceat(n.astype(np.int64), begin), np.minimum.reduceat(first, begin)


def build_index(docs: DataFrame, min_chars: int = MIN_CHARS, long_words: int = LONG_WORDS, shards: int | None = None) -> DataFrame:
    """One row of arrays for each shard that has a line, written to the shared folder."""
    shards = shards or shards_for(docs, min_chars)

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            every = np.concatenate([h for h, _ in held])
            h, n, first = _merged(every, np.ones(len(every), np.int64), np.concatenate([k for _, k in held]))
            s = shard_of(h, shards)
            order = np.argsort(s, kind="stable")
            some, begin = np.unique(s[order], return_index=True)
            parts = np.split(order, begin[1:])
            return pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), *(pa.array([x[p].tobytes() for p in parts], pa.binary()) for x in (h, n.astype(U32), first))], names=["shard", "h", "n", "first"])

        for batch in batches:
            h = batch.column("h").flatten().to_numpy(zero_copy_only=False).view(U64)
            held.append((h, np.repeat(batch.column("digest").to_numpy().astype(U32), batch.column("h").value_lengths().to_numpy())))
            size += len(h)
            if size > SHARD_LINES:
                yield flush()
                held, size = [], 0
        if size:
            yield flush()

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        h, n, first = _merged(*(np.concatenate([np.frombuffer(b, k) for b in pdf[c]]) for c, k in (("h", U64), ("n", U32), ("first", U32))))
        return pd.DataFrame([[pdf["shard"].iloc[0], *PerfectHash.build(h, n, first).row()]], columns=INDEX.names)

    hashes = docs.select(F.array_compact(F.array_distinct(line_hashes(F.col("text"), min_chars, long_words))).alias("h"), digest(F.col("text")).alias("digest")).filter(F.size("h") > 0)
    return C.saved(hashes.transform(C.mapped, combine, "shard int, h binary, n binary, first binary").groupBy("shard").applyInPandas(build, INDEX), "lines")


def _cut(text: str, drop: np.ndarray) -> tuple[str, int]:
    """The text without the lines that drop marks, and how many went."""
    return "\n".join(x for x, d in zip(text.split("\n"), drop) if not d), int(drop.sum())


def dedup_lines(docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, long_docs: int = LONG_DOCS, long_words: int = LONG_WORDS, small_bytes: int = SMALL_BYTES, shards: int | None = None, removed: str | None = None, ask_lines: int = ASK_LINES) -> DataFrame:
    """docs with repeated lines cut from text but for one; removed names a further column for the number of lines cut."""
    spark = docs.sparkSession
    names = [c for c in docs.columns if c != removed]
    docs = docs.select(*[docs[c] for c in names])
    shards = shards or shards_for(docs, min_chars)
    index = build_index(docs, min_chars, long_words, shards)
    size = index.select(F.sum(sum((F.length(c) for c in INDEX.names[1:]), F.lit(0)))).first()[0] or 0
    others = [c for c in docs.columns if c != "text"]
    row = docs.select(F.struct(*(others or [F.lit(0).alias("none")])).alias("row"))
    carried = docs.select(F.struct(*(others or [F.lit(0).alias("none")])).alias("row"), "text", line_hashes(F.col("text"), min_chars, long_words).alias("h"), digest(F.col("text")).alias("digest"))
    schema = T.StructType([*row.schema.fields, T.StructField("text", T.StringType()), T.StructField("cut", T.IntegerType())])

    def goes(table: PerfectHash, h: np.ndarray, digests: np.ndarray) -> np.ndarray:
        n, first = table.find(h)
        return (n >= np.where(h & U64(1), long_docs, min_docs)) & (first != digests)

    def batch_of(b: pa.RecordBatch, marks: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        """marks: of each line of all texts; counts: lines of each text."""
        ends = np.cumsum(counts)
        texts, cut = b.column("text"), np.zeros(len(counts), np.int32)
        if marks.any():
            texts = texts.to_pylist()
            for i in np.unique(np.searchsorted(ends, np.flatnonzero(marks), "right")):
                texts[i], cut[i] = _cut(texts[i], marks[ends[i] - counts[i] : ends[i]])
        return pa.RecordBatch.from_arrays([b.column("row"), pa.array(texts, pa.string()), pa.array(cut)], names=schema.names)

    if size <= small_bytes:
        sent = spark.sparkContext.broadcast([tuple(r) for r in index.collect()])

        def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tables = {s: PerfectHash.of(*arrays) for s, *arrays in sent.value}
            for batch in batches:
                for b in C.blocks(batch, "text"):
                    col = b.column("h")
                    flat, counts = col.flatten(), col.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
                    valid = flat.is_valid().to_numpy(zero_copy_only=False)
                    h = flat.fill_null(0).to_numpy(zero_copy_only=False).view(U64)
                    digests = np.repeat(b.column("digest").fill_null(0).to_numpy(zero_copy_only=False).astype(U32), counts)
                    at, marks = np.flatnonzero(valid), np.zeros(len(h), bool)
                    s = shard_of(h[at], shards)
                    order = np.argsort(s, kind="stable")
                    for own in np.split(order, np.flatnonzero(np.diff(s[order])) + 1):
                        if len(own) and int(s[own[0]]) in tables:
                            marks[at[own]] = goes(tables[int(s[own[0]])], h[at[own]], digests[at[own]])
                    yield batch_of(b, marks, counts)

        out = carried.transform(C.mapped, probe, schema)
    else:
        rows = C.saved(carried.withColumn("rid", F.monotonically_increasing_id()), "rows")

        def ask(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            if not len(left) or not len(right):
                return pd.DataFrame({"rid": pd.Series(dtype="int64"), "at": pd.Series(dtype="int32")})
            return left.loc[goes(PerfectHash.of(*right.iloc[0, 2:]), left["h"].to_numpy().view(U64), left["digest"].to_numpy().astype(U32)), ["rid", "at"]]

        def to_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                h = b.column("h").to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(shard_of(h.view(U64), shards))], names=["rid", "digest", "at", "h", "shard"])

        # questions to a shard come in parts of bounded size, so that neither many lines nor a line that all have fill a task
        lines = rows.agg(F.sum(F.size("h"))).first()[0] or 0
        parts = max(1, -(-lines // (shards * ask_lines)))
        asked = rows.select("rid", "digest", F.posexplode("h").alias("at", "h")).filter("h is not null").transform(C.mapped, to_shard, "rid long, digest long, at int, h long, shard int")
        asked = asked.withColumn("part", F.pmod(F.xxhash64("rid", "at"), F.lit(parts)).cast("int"))
        told = index.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).select("shard", "part", *INDEX.names[1:])
        found = asked.groupBy("shard", "part").cogroup(told.groupBy("shard", "part")).applyInPandas(ask, "rid long, at int").groupBy("rid").agg(F.collect_list("at").alias("hits"))

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                counts = b.column("h").value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
                marks = np.zeros(int(counts.sum()), bool)
                for start, at in zip(np.cumsum(counts) - counts, b.column("hits").to_pylist()):
                    marks[[start + i for i in at or ()]] = True
                yield batch_of(b, marks, counts)

        out = rows.join(found, "rid", "left").select("row", "text", "h", "hits").transform(C.mapped, cut, schema)
    kept = [F.col("text").alias("text") if c == "text" else F.col("row").getField(c).alias(c) for c in names]
    return out.select(*kept, *([F.col("cut").alias(removed)] if removed else []))


def passages_once(docs: DataFrame, long_words: int = LONG_WORDS) -> DataFrame:
    """docs with each line of long_words words or more in one text only."""
    hashes = F.array_distinct(F.transform(F.filter(F.split("text", "\n", -1), lambda x: _long(x, long_words)), lambda x: F.xxhash64(F.trim(x))))
    held = C.saved(docs.select(F.xxhash64("text").alias("key"), F.explode(hashes).alias("line")).distinct(), "passages")
    first = held.groupBy("line").agg(F.min("key").alias("first"))
    drop = C.saved(held.join(first, "line").filter("key <> first").groupBy("key").agg(F.collect_list("line").alias("drop")), "drop")
    sent = F.broadcast(drop) if (drop.agg(F.sum(F.size("drop") + 2)).first()[0] or 0) <= C.SMALL_IDS else drop
    rows = docs.select(F.struct(*docs.columns).alias("row"), "text", F.xxhash64("text").alias("key")).join(sent, "key", "left")
    left = F.filter(F.split("text", "\n", -1), lambda x: ~F.array_contains("drop", F.xxhash64(F.trim(x))))
    text = F.when(F.col("drop").isNotNull(), F.array_join(left, "\n")).otherwise(F.col("text"))
    return rows.select(*(text.alias("text") if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns))


ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, text, substr(md5(text), 1, 8) AS k FROM documents),
p AS (SELECT rid, k, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM d),
c AS (SELECT trim(line) AS line, count(DISTINCT rid) AS n, min(k) AS keeper FROM p WHERE length(trim(line)) >= {MIN_CHARS} GROUP BY 1),
common AS (SELECT line, keeper FROM c WHERE n >= CASE WHEN len(string_split_regex(line, ' +')) >= {LONG_WORDS} THEN {LONG_DOCS} ELSE {MIN_DOCS} END),
m AS (SELECT p.*, common.line IS NOT NULL AND p.k <> common.keeper AS hit FROM p LEFT JOIN common ON trim(p.line) = common.line),
g AS (SELECT rid, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT hit), '') AS rest, count(*) FILTER (hit) AS n FROM m GROUP BY rid)
SELECT doc_id, CASE WHEN n > 0 THEN rest ELSE text END AS text, CAST(coalesce(n, 0) AS INTEGER) AS lines_removed
FROM d LEFT JOIN g USING (rid)
"""
