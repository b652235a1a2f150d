"""Quality rule by n-gram perplexity: a modified Kneser-Ney model of words for each language.

Words lie between white space, as they are written; a Chinese or Japanese character is a word of its own. Every word of a language is a symbol, however rare, and every bigram counts;
a word that the model has not seen gets the base probability, one by the number of different words plus one. Workers keep the words of a block of texts as numbers in the list of its
different words. Its distinct bigrams go to shards by their hash or that of a rare word in them, which count them over all documents, and its different words to shards of words, which add up how many bigrams
end in them (the lower order) and what follows them (the back-off weights). Both send the counts of the other half back to the block, whose texts are then scored,
so no model is held whole anywhere and no worker holds more than a shard or a block. Shards and blocks take turns in passes, so that a part of all shuffles is on disk at once. Words that are frequent in a sample go as small numbers, all others as hashes of 63 bits, which saves disk only.

With `vocabulary` given, only so many of the most frequent words of a language (ties by hash) are told apart and all others are one class, the probability of which is divided by the
number of different words in it. Such a model has at most (vocabulary + 1) x (vocabulary + 2) bigrams or 34 MB: fitted probabilities and back-off weights lie in arrays sorted by
a 32-bit hash (one to one) of order and n-gram, which workers search through an index of the leading bits.

Documents are split in two halves by the least hash of their bigrams (with a vocabulary: by a hash of their text), and each is scored by the model counted on the other half of its
language, so that a rare text does not vouch for itself, copies stay together, and so do two edited copies with the probability (1 + share of bigrams they have in common) / 2. A document is rejected if its log
perplexity is off its language's median by more than `below` or `above` standard deviations, which gives the language's lower and upper band. The variance is that between
documents (1.4826 times the median absolute deviation, at least `floor`, squared) and that of a mean of so many words (the variance of a word's log probability in the language, by
the number of words), so that bands follow from the corpus and short texts have wider ones.

Defined results: a null or empty text, or one without a word, is rejected, with null perplexity. Texts of a language of which fewer than `min_docs` documents have a score have no band
and are accepted, with null perplexity if no model scored them. A null language is a language of its own. Every row
gives one row; repeated rows repeat; other columns are ignored. Empty tables give empty results.
"""

from __future__ import annotations

import gc
import time
from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from srcplan.llm import common as C

BITS = 12
START, RARE, FIRST = 0, 1, 2
#: Standard deviations below and above the median: text that says one thing again is often meant, text of strange words is not.
BELOW, ABOVE = 4.0, 2.5
FLOOR, MIN_DOCS = 0.02, 20
#: Models are sent to workers together up to so many bytes, else language by language.
SMALL_BYTES = 128 << 20
#: Characters of text for each shard of counts.
SHARD_CHARS = 400_000_000
#: Characters of text for each shard of bigrams of all words, shards of these for one of words, and words of texts in a block.
PAIR_CHARS, WORD_SHARDS, BLOCK_WORDS = 25_000_000, 4, 4_000_000
#: Passes over shards and over blocks, one after the other: so much less is in shuffles at once.
PASSES = 6
#: Words that get a small number, and characters of the sample that they are frequent in; results do not depend on them.
CODES, SAMPLE_CHARS = (1 << 16) - 1, 20_000_000
#: Distinct n-grams that a worker holds before it gives them out.
HELD = 4_000_000
U64, U32 = np.uint64, np.uint32
LOW = (1 << BITS) - 1
MODEL = "part string, hashes binary, probs binary, context_hashes binary, weights binary, base double, types long"

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = True
_WIDE = np.zeros(256, bool)
_WIDE[0xE3:0xEA] = True
_BYTE = C.mix(np.arange(256, dtype=U64) + U64(0x3C6EF372)) | U64(1)


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, first word of each text plus the total)."""
    data, off = C.buffer_of(texts)
    inside = ~_SPACE[data]
    cut = np.zeros(len(data) + 4, bool)
    wide = np.flatnonzero(_WIDE[data])
    cut[wide] = cut[wide + 3] = True
    before = np.concatenate([[False], inside[:-1]]) if len(data) else inside
    start = np.flatnonzero(inside & (~before | cut[: len(data)]))
    after = np.concatenate([inside[1:], [False]]) if len(data) else inside
    end = np.flatnonzero(inside & (~after | cut[1 : len(data) + 1])) + 1
    return C.hash_spans(data, start, end, _BYTE), np.searchsorted(start, off)


class Vocabulary:
    """The symbols of frequent words, and how many different words there are besides."""

    def __init__(self, words: np.ndarray, types: int) -> None:
        self.words, self.types = np.sort(words), types

    def symbols(self, h: np.ndarray) -> np.ndarray:
        if not len(self.words):
            return np.full(len(h), RARE, U32)
        at = np.minimum(np.searchsorted(self.words, h), len(self.words) - 1)
        return np.where(self.words[at] == h, at + FIRST, RARE).astype(U32)


def bigrams(symbols: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The bigram that ends at each word; that of a text's first word begins at its start."""
    before = np.concatenate([[START], symbols[:-1]]).astype(U32) if len(symbols) else symbols
    before[first[:-1][np.diff(first) > 0]] = START
    return before << U32(BITS) | symbols


def summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, with the sum of n."""
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    begin = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[begin], np.add.reduceat(n, begin) if len(begin) else n


def discounts(counts: np.ndarray) -> np.ndarray:
    """The modified Kneser-Ney discounts for counts of 1, 2 and more; 0.5 x count where the data define none."""
    return discounts_of(np.bincount(np.minimum(counts, 5), minlength=6)[1:5])


def discounts_of(n: np.ndarray) -> np.ndarray:
    """The same, from how many counts are 1, 2, 3 and 4."""
    n = n.astype(float)
    y = n[0] / (n[0] + 2 * n[1]) if n[0] else 0.0
    d = [k - (k + 1) * y * n[k] / n[k - 1] if n[k - 1] and n[k] else 0.5 * k for k in (1, 2, 3)]
    return np.array([0.0, *(min(max(v, 0.05), k - 0.05) for k, v in zip((1, 2, 3), d))])


def key(order: int, g: np.ndarray) -> np.ndarray:
    """A one-to-one 32-bit hash."""
    x = g.astype(U32) ^ U32(order << 28)
    for m in (0x7FEB352D, 0x846CA68B):
        x = (x ^ (x >> U32(16))) * U32(m)
    return x ^ (x >> U32(16))


def fit(code: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, float]:
    """(hashes of n-grams of all orders, log probabilities, hashes of contexts, log weights, log of the base probability), of distinct bigrams with counts."""
    grams = {2: (code, count), 1: summed(code & U32(LOW), np.ones(len(code), np.int64))}
    base = 1.0 / (len(grams[1][0]) + 1)
    hashes, probs, contexts, weights = [], [], [], []
    lower: tuple[np.ndarray, np.ndarray] | None = None
    for n in (1, 2):
        g, counts = grams[n]
        off = discounts(counts)[np.minimum(counts, 3)]
        before = g >> U32(BITS)
        order = np.argsort(before, kind="stable")
        g, counts, off, before = g[order], counts[order], off[order], before[order]
        begin = np.flatnonzero(np.concatenate([[True], before[1:] != before[:-1]]))
        total, gone = np.add.reduceat(counts, begin), np.add.reduceat(off, begin)
        which = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, len(g))))
        weight = gone / total
        below = np.full(len(g), base) if lower is None else lower[1][np.searchsorted(lower[0], g & U32(LOW))]
        p = (counts - off) / total[which] + weight[which] * below
        lower = (g, p) if lower is None else lower
        hashes.append(key(n, g))
        probs.append(np.log(p))
        contexts.append(key(n - 1, before[begin]))
        weights.append(np.log(weight))
    h, c = np.concatenate(hashes), np.concatenate(contexts)
    a, b = np.argsort(h), np.argsort(c)
    return h[a], np.concatenate(probs)[a].astype(np.float32), c[b], np.concatenate(weights)[b].astype(np.float32), float(np.log(base))


class HashArray:
    """Values by sorted 32-bit hash, found through an index of the leading bits."""

    def __init__(self, hashes: np.ndarray, values: np.ndarray) -> None:
        self.h, self.v = hashes, values
        bits = min(31, max(1, int(len(hashes)).bit_length()))
        self.shift = U32(32 - bits)
        self.first = np.searchsorted(hashes >> self.shift, np.arange((1 << bits) + 1, dtype=U64)).astype(np.int64)

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(whether each is there, its value or 0)."""
        lead = (h >> self.shift).astype(np.int64)
        at, end = self.first[lead], self.first[lead + 1]
        out, there = np.zeros(len(h), np.float32), np.zeros(len(h), bool)
        todo = np.flatnonzero(at < end)
        at, end, h = at[todo], end[todo], h[todo]
        while len(todo):
            hit = self.h[at] == h
            there[todo[hit]] = True
            out[todo[hit]] = self.v[at[hit]]
            on = ~hit & (at + 1 < end)
            todo, at, end, h = todo[on], at[on] + 1, end[on], h[on]
        return there, out


class Model:
    def __init__(self, hashes: bytes, probs: bytes, contexts: bytes, weights: bytes, base: float, types: int) -> None:
        self.probs = HashArray(np.frombuffer(hashes, U32), np.frombuffer(probs, np.float32))
        self.weights = HashArray(np.frombuffer(contexts, U32), np.frombuffer(weights, np.float32))
        self.base, self.rare = base, float(np.log(max(1, types)))

    def score(self, g: np.ndarray) -> np.ndarray:
        """Log probability of the last word of each bigram given the first."""
        out, todo, rare = np.zeros(len(g)), np.arange(len(g)), (g & U32(LOW)) == RARE
        for n in (2, 1):
            there, p = self.probs.find(key(n, g))
            out[todo[there]] += p[there]
            todo, g = todo[~there], g[~there]
            known, w = self.weights.find(key(n - 1, g >> U32(BITS)))
            out[todo[known]] += w[known]
            g = g & U32(LOW)
        out[todo] += self.base
        out[rare] -= self.rare
        return out


def _prepared(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), "lang", F.pmod(F.xxhash64("text"), F.lit(2)).cast("int").alias("fold"), F.coalesce("text", F.lit("")).alias("text"))


def _parts(batch: pa.RecordBatch, flip: bool) -> dict[str, list[int]]:
    rows: dict[str, list[int]] = defaultdict(list)
    for i, (lang, fold) in enumerate(zip(batch.column("lang").to_pylist(), batch.column("fold").to_pylist())):
        rows[f"{1 - fold if flip else fold}{'?' if lang is None else '=' + lang}"].append(i)
    return rows


PACKED = "part string, shard int, keys binary, n binary"


def _counted(docs: DataFrame, shards: int, keys_of: Callable[[str, pa.Array], np.ndarray]) -> DataFrame:
    """PACKED: what keys_of (part, texts) gives, with counts, over all documents: sorted arrays for each shard of the hash of the key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = defaultdict(list)
        size = 0

        def merged(own: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
            return summed(np.concatenate([k for k, _ in own]), np.concatenate([n for _, n in own]))

        def flush() -> Iterator[pa.RecordBatch]:
            for part, own in held.items():
                keys, n = merged(own)
                s = (C.mix(keys.astype(U64)) % U64(shards)).astype(np.int64)
                some = np.unique(s)
                which = [s == k for k in some]
                yield pa.RecordBatch.from_arrays([pa.array([part] * len(some), pa.string()), pa.array(some, pa.int32()), pa.array([keys[w].tobytes() for w in which], pa.binary()), pa.array([n[w].tobytes() for w in which], pa.binary())], names=["part", "shard", "keys", "n"])
            held.clear()

        for batch in batches:
            for b in C.blocks(batch, "text", 2 << 20):
                for part, rows in _parts(b, False).items():
                    k = keys_of(part, b.column("text").take(pa.array(rows)))
                    held[part].append(summed(k, np.ones(len(k), np.int64)))
                    size += len(held[part][-1][0])
                if size > HELD:
                    for part, own in list(held.items()):
                        held[part] = [merged(own)]
                    size = sum(len(own[0][0]) for own in held.values())
                    if size > HELD * 3 // 4:
                        yield from flush()
                        size = 0
        yield from flush()

    return _prepared(docs).transform(C.mapped, run, PACKED)


def _unpacked(t: pa.Table, kind: type) -> tuple[np.ndarray, np.ndarray]:
    return summed(np.concatenate([np.frombuffer(x, kind) for x in t.column("keys").to_pylist()]), np.concatenate([np.frombuffer(x, np.int64) for x in t.column("n").to_pylist()]))


def vocabularies(docs: DataFrame, shards: int, size: int) -> dict[str, Vocabulary]:
    """For each half of each language; size words for each is all that the driver gets."""

    def top(key_: tuple, t: pa.Table) -> pa.Table:
        w, n = _unpacked(t, U64)
        best = np.lexsort((w.view(np.int64), -n))[:size]
        return pa.table({"part": pa.array([key_[0].as_py()] * len(best), pa.string()), "w": pa.array(w[best].view(np.int64)), "n": pa.array(n[best]), "types": pa.array([len(w), *[0] * (len(best) - 1)], pa.int64())})

    best = _counted(docs, shards, lambda _, texts: tokens(texts)[0]).groupBy("part", "shard").applyInArrow(top, "part string, w long, n long, types long")
    best = C.saved(best, "words")
    rank = F.row_number().over(Window.partitionBy("part").orderBy(F.desc("n"), "w"))
    types = {r[0]: r[1] for r in best.groupBy("part").agg(F.sum("types")).collect()}
    words = defaultdict(list)
    for part, w in best.withColumn("k", rank).filter(F.col("k") <= size).select("part", "w").collect():
        words[part].append(w)
    return {part: Vocabulary(np.array(words[part], np.int64).view(U64), n - len(words[part])) for part, n in types.items()}


def train(docs: DataFrame, shards: int, known: dict[str, Vocabulary]) -> DataFrame:
    """MODEL: a row of sorted arrays for each half of each language, written to the shared folder."""
    sent = docs.sparkSession.sparkContext.broadcast(known)  # as many words for each language

    def grams(part: str, texts: pa.Array) -> np.ndarray:
        h, first = tokens(texts)
        return bigrams(sent.value[part].symbols(h), first)

    def add(key_: tuple, t: pa.Table) -> pa.Table:
        g, n = _unpacked(t, U32)
        return pa.table({"part": [key_[0].as_py()], "keys": pa.array([g.tobytes()], pa.binary()), "n": pa.array([n.tobytes()], pa.binary())})

    def build(key_: tuple, t: pa.Table) -> pa.Table:
        part = key_[0].as_py()
        *arrays, base = fit(*_unpacked(t, U32))
        return pa.table({"part": [part], **{c: pa.array([a.tobytes()], pa.binary()) for c, a in zip(("hashes", "probs", "context_hashes", "weights"), arrays)}, "base": [base], "types": [sent.value[part].types]})

    added = _counted(docs, shards, grams).groupBy("part", "shard").applyInArrow(add, "part string, keys binary, n binary")
    return C.saved(added.groupBy("part").applyInArrow(build, MODEL), "model")


SCORE = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("lang", T.StringType()), T.StructField("n", T.LongType()), T.StructField("bits", T.DoubleType()), T.StructField("squares", T.DoubleType())])


def scores(docs: DataFrame, model: DataFrame, known: dict[str, Vocabulary], small_bytes: int = SMALL_BYTES) -> DataFrame:
    """(doc_id, lang, n, bits, squares) for every row: its words, the sum of their negative log probabilities, null without a model, and the sum of the squares of these."""
    context = docs.sparkSession.sparkContext
    sizes = model.select("part", sum((F.length(c) for c in ("hashes", "probs", "context_hashes", "weights")), F.lit(0)).alias("b")).collect()
    groups: list[list[str]] = [[]]
    held = 0
    for part, b in sorted(sizes):
        if groups[-1] and held + b > small_bytes:
            groups.append([])
            held = 0
        groups[-1].append(part)
        held += b
    every, own = _prepared(docs), F.concat((1 - F.col("fold")).cast("string"), F.coalesce(F.concat(F.lit("="), "lang"), F.lit("?")))

    def scorer(parts: list[str]):
        sent = context.broadcast([(tuple(r)[1:], r["part"], known[r["part"]]) for r in model.filter(F.col("part").isin(parts)).collect()]) if parts else None

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            models = {part: (Model(*arrays), words) for arrays, part, words in sent.value} if sent else {}
            for batch in batches:
                for b in C.blocks(batch, "text", 2 << 20):
                    h, first = tokens(b.column("text"))
                    size = np.diff(first)
                    sums, squares, scored = np.zeros(b.num_rows), np.zeros(b.num_rows), np.zeros(b.num_rows, bool)
                    for part, rows in _parts(b, True).items():
                        if part not in models:
                            continue
                        m, words = models[part]
                        keep = np.zeros(b.num_rows, bool)
                        keep[rows] = True
                        some = h[np.repeat(keep, size)]
                        at = np.concatenate([[0], np.cumsum(size[keep])])
                        bits = -m.score(bigrams(words.symbols(some), at))
                        for out, x in ((sums, bits), (squares, bits * bits)):
                            total = np.concatenate([[0.0], np.cumsum(x)])
                            out[keep] = total[at[1:]] - total[at[:-1]]
                        scored |= keep & (size > 0)
                    yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("lang"), pa.array(size), *(pa.array(x, pa.float64(), mask=~scored) for x in (sums, squares))], names=SCORE.names)

        return run

    if len(groups) == 1:
        return every.transform(C.mapped, scorer(groups[0]), SCORE)
    out = every.filter(~own.isin([p for g in groups for p in g])).transform(C.mapped, scorer([]), SCORE)
    for g in groups:
        out = out.unionByName(every.filter(own.isin(g)).transform(C.mapped, scorer(g), SCORE))
    return out


# ---- all words, by blocks and shards

STREAM, PAIRS, WORDS, PAIR_TOTALS, WORD_TOTALS = range(5)
PIECE = "block long, lang string, fold int, kind int, shard int, a binary, b binary, c binary, d binary, e binary, f binary"
_PIECE = pa.schema([("block", pa.int64()), ("lang", pa.string()), ("fold", pa.int32()), ("kind", pa.int32()), ("shard", pa.int32()), *((c, pa.binary()) for c in "abcdef")])


def pack(x: np.ndarray) -> bytes:
    """The array by planes of its bytes, compressed, after its length."""
    planes = np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.itemsize).T)
    return len(x).to_bytes(8, "little") + (pa.compress(planes.tobytes(), "zstd", asbytes=True) if len(x) else b"")


def unpack(b: bytes, kind: type) -> np.ndarray:
    n, k = int.from_bytes(b[:8], "little"), np.dtype(kind).itemsize
    if not n:
        return np.zeros(0, kind)
    planes = np.frombuffer(pa.decompress(b[8:], n * k, "zstd", asbytes=True), np.uint8).reshape(k, n)
    return np.ascontiguousarray(planes.T).view(kind).reshape(-1)


def pack_sorted(x: np.ndarray) -> bytes:
    """pack() of ascending hashes, by their differences."""
    return pack(np.diff(x, prepend=U64(0)))


def unpack_sorted(b: bytes) -> np.ndarray:
    return np.cumsum(unpack(b, U64), dtype=U64)


def _let_go(df: DataFrame) -> None:
    """Spark removes the shuffle files of what is written when the driver collects its garbage, some of which its event queue holds a moment longer."""
    for _ in range(2):
        gc.collect()
        df.sparkSession.sparkContext._jvm.System.gc()
        time.sleep(0.4)


def _piece(block: int | None, lang: str, fold: int, kind: int, shard: int, *arrays: np.ndarray | bytes) -> dict:
    return {"block": block, "lang": lang, "fold": fold, "kind": kind, "shard": shard, **{c: x if isinstance(x, bytes) else pack(x) for c, x in zip("abcdef", arrays)}}


def codes(docs: DataFrame, chars: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, ascending, their codes from 1 on) of frequent words of a sample."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [summed(h, np.ones(len(h), np.int64)) for batch in batches for b in C.blocks(batch, "text") for h in (tokens(b.column("text"))[0],)]
        if held:
            w, n = summed(np.concatenate([w for w, _ in held]), np.concatenate([n for _, n in held]))
            yield pa.RecordBatch.from_arrays([pa.array(w[n > 1].view(np.int64)), pa.array(n[n > 1])], names=["w", "n"])

    some = docs.filter(F.pmod(F.xxhash64("text", F.lit(1)), F.lit(max(1, chars // SAMPLE_CHARS))) == 0).select("text")
    top = some.transform(C.mapped, run, "w long, n long").groupBy("w").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "w").limit(CODES).collect()
    h = np.array([r["w"] for r in top], np.int64).view(U64)
    order = np.argsort(h)
    return h[order], (order + 1).astype(U64)


def streams(docs: DataFrame, known: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """PIECE, a STREAM for each block of texts of one language and half: ids, which are null, words of each, the different words, and the number of each word among these."""
    sent = docs.sparkSession.sparkContext.broadcast(known)  # at most CODES words

    def keys_of(h: np.ndarray) -> np.ndarray:
        hashes, numbers = sent.value
        if not len(hashes):
            return h | U64(1 << 63)
        at = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
        return np.where(hashes[at] == h, numbers[at], h | U64(1 << 63))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple[np.ndarray, ...]]] = defaultdict(list)
        size, made = 0, TaskContext.get().partitionId() << 32

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal made
            for part in list(held):
                ids, missing, n, keys = (np.concatenate(x) for x in zip(*held.pop(part)))
                words, at = np.unique(keys, return_inverse=True)
                yield pa.RecordBatch.from_pylist([_piece(made, part[1:], int(part[0]), STREAM, 0, ids, missing, n, pack_sorted(words), at.astype(U32))], _PIECE)
                made += 1

        for batch in batches:
            for b in C.blocks(batch, "text", 2 << 20):
                h, first = tokens(b.column("text"))
                keys, n, fold = keys_of(h), np.diff(first), halves(h, first)
                b = b.set_column(b.schema.get_field_index("fold"), "fold", pa.array(fold))
                ids, missing = b.column("doc_id").fill_null(0).to_numpy(), b.column("doc_id").is_null().to_numpy(zero_copy_only=False).astype(np.uint8)
                for part, rows in _parts(b, False).items():
                    keep = np.zeros(b.num_rows, bool)
                    keep[rows] = True
                    held[part].append((ids[keep], missing[keep], n[keep].astype(U32), keys[np.repeat(keep, n)]))
                size += len(h) + b.num_rows
                if size > BLOCK_WORDS:
                    yield from flush()
                    size = 0
        yield from flush()

    return C.saved(_prepared(docs).transform(C.mapped, run, PIECE), "streams")


def halves(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """0 or 1 for each text, by the least hash of its bigrams: edited copies, which would vouch for each other, mostly share it. 0 without a word."""
    n = np.diff(first)
    before = np.concatenate([np.zeros(1, U64), h[:-1]])[: len(h)]
    before[first[:-1][n > 0]] = 0
    out = np.zeros(len(n), np.int64)
    if len(h):
        out[n > 0] = (C.mix(np.minimum.reduceat(pair_hash(before, h), first[:-1][n > 0])) & U64(1)).astype(np.int64)
    return out


def pair_hash(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    return C.mix(C.mix(v) + w * U64(0xC2B2AE3D27D4EB4F))


def pair_shard(v: np.ndarray, w: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each bigram: that of its word without a number, so that what a rare word is in lies together, or its own."""
    named_v, named_w = v < U64(1 << 63), w < U64(1 << 63)
    return np.where(~named_v, C.mix(v), np.where(named_w, pair_hash(v, w), C.mix(w))) % U64(shards)


def pairs_of(words: np.ndarray, at: np.ndarray, n: np.ndarray, shards: int, of: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(key of every symbol, START at first; symbols of each distinct bigram; its shard; which of them ends at each word; counts) of a block, or of a pass over its shards."""
    keys = np.concatenate([np.zeros(1, U64), words])
    before = np.zeros(len(at), U64)
    before[1:] = at[:-1].astype(U64) + U64(1)
    before[(np.cumsum(n.astype(np.int64)) - n)[n > 0]] = 0
    g = before << U64(32) | (at.astype(U64) + U64(1))
    if of is not None:
        g = g[pair_shard(keys[before], keys[1:][at], shards) % U64(PASSES) == of]
    g, which, count = np.unique(g, return_inverse=True, return_counts=True)
    v, w = (g >> U64(32)).astype(np.int64), (g & U64(0xFFFFFFFF)).astype(np.int64)
    return keys, v, w, pair_shard(keys[v], keys[w], shards), which, count


def by_shard(h: np.ndarray, shards: int) -> Iterator[tuple[int, np.ndarray]]:
    """(shard, where its hashes are, in order) for each that has any."""
    s = (h % U64(shards)).astype(np.int64)
    order = np.argsort(s, kind="stable")
    s = s[order]
    cut = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]])) if len(s) else np.zeros(0, np.int64)
    for i, j in zip(cut, [*cut[1:], len(s)]):
        yield int(s[i]), order[i:j]


def _rows(t: pa.Table) -> Iterator[dict]:
    return (r for b in t.to_batches(max_chunksize=1) for r in b.to_pylist())


def counted_pairs(blocks: DataFrame, shards: int, word_shards: int, of: int) -> DataFrame:
    """PIECE, for a pass: PAIRS for each block and shard (the counts of its bigrams in the other half), WORDS for each shard of words (their bigrams as a last word; words, and bigrams of counts 1, 2 and more, that follow) and PAIR_TOTALS."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in _rows(pa.Table.from_batches([batch])):
                keys, v, w, shard, _, n = pairs_of(unpack_sorted(r["d"]), unpack(r["e"], U32), unpack(r["c"], U32), shards, of)
                rows = []
                for s, i in by_shard(shard, shards):
                    used, at = np.unique(np.concatenate([v[i], w[i]]), return_inverse=True)
                    at = at.astype(U32)
                    rows.append(_piece(r["block"], r["lang"], r["fold"], PAIRS, s, pack_sorted(keys[used]), at[: len(i)], at[len(i) :], n[i].astype(U32)))
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, _PIECE)

    def count(key_: tuple, t: pa.Table) -> pa.Table:
        lang, shard = (k.as_py() for k in key_)
        of, parts = [], []
        for r in _rows(t):
            keys = unpack_sorted(r["a"])
            parts.append((keys[unpack(r["b"], U32)], keys[unpack(r["c"], U32)], unpack(r["d"], U32)))
            of.append((r["block"], r["fold"], len(parts[-1][0])))
        v, w, n = (np.concatenate(x) for x in zip(*parts))
        parts.clear()
        fold = np.repeat([f for _, f, _ in of], [m for _, _, m in of])
        _, first, which = np.unique(pair_hash(v, w), return_index=True, return_inverse=True)
        v, w = v[first], w[first]
        counts = [np.bincount(which, n * (fold == f), len(v)).astype(np.int64) for f in (0, 1)]
        out, at = [], 0
        for block, f, m in of:
            out.append(_piece(block, lang, f, PAIRS, shard, counts[1 - f][which[at : at + m]].astype(U32)))
            at += m
        for f in (0, 1):
            there = counts[f] > 0
            if not there.any():
                continue
            c, keys = counts[f][there], np.unique(np.concatenate([v[there], w[there]]))
            a, b = np.searchsorted(keys, v[there]), np.searchsorted(keys, w[there])
            sums = [np.bincount(b, minlength=len(keys)), np.bincount(a, c, len(keys)), *(np.bincount(a[x], minlength=len(keys)) for x in (c == 1, c == 2, c > 2))]
            sums = [x.astype(U64) for x in sums]
            out += [_piece(None, lang, f, WORDS, s, pack_sorted(keys[i]), *(x[i] for x in sums)) for s, i in by_shard(C.mix(keys), word_shards)]
            out.append(_piece(None, lang, f, PAIR_TOTALS, shard, np.bincount(np.minimum(c, 5), minlength=6)[1:5]))
        return pa.Table.from_pylist(out, _PIECE)

    return C.saved(blocks.transform(C.mapped, ask, PIECE).groupBy("lang", "shard").applyInArrow(count, PIECE), "pairs")


def counted_words(blocks: DataFrame, pairs: DataFrame, word_shards: int, of: int) -> DataFrame:
    """PIECE, for a pass: WORDS for each block and shard, the five figures of its words in the other half, and WORD_TOTALS."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in _rows(pa.Table.from_batches([batch])):
                keys = np.concatenate([np.zeros(1, U64), unpack_sorted(r["d"])])
                rows = [_piece(r["block"], r["lang"], r["fold"], WORDS, s, pack_sorted(keys[i])) for s, i in by_shard(C.mix(keys), word_shards) if s % PASSES == of]
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, _PIECE)

    def add(key_: tuple, t: pa.Table) -> pa.Table:
        lang, shard = (k.as_py() for k in key_)
        asked, parts = [], ([], [])
        for r in _rows(t):
            if r["block"] is None:
                parts[r["fold"]].append((unpack_sorted(r["a"]), [unpack(r[c], U64).astype(np.int64) for c in "bcdef"]))
            else:
                asked.append((r["block"], r["fold"], r["a"]))
        out, known = [], []
        for f in (0, 1):
            keys, which = np.unique(np.concatenate([np.zeros(0, U64), *(k for k, _ in parts[f])]), return_inverse=True)
            sums = [np.bincount(which, np.concatenate([np.zeros(0), *(x[j] for _, x in parts[f])]), len(keys)).astype(np.int64) for j in range(5)]
            parts[f].clear()
            known.append((keys, sums))
            ends = sums[0][sums[0] > 0]
            if len(keys):
                out.append(_piece(None, lang, f, WORD_TOTALS, shard, np.array([*np.bincount(np.minimum(ends, 5), minlength=6)[1:5], ends.sum(), len(ends)], np.int64)))
        for block, f, a in asked:
            own, (keys, sums) = unpack_sorted(a), known[1 - f]
            at = np.minimum(np.searchsorted(keys, own), max(0, len(keys) - 1))
            there = keys[at] == own if len(keys) else np.zeros(len(own), bool)
            out.append(_piece(block, lang, f, WORDS, shard, *(np.where(there, x[at], 0).astype(U64) if len(keys) else np.zeros(len(own), U64) for x in sums)))
        return pa.Table.from_pylist(out, _PIECE)

    every = blocks.transform(C.mapped, ask, PIECE).unionByName(pairs.filter((F.col("kind") == WORDS) & (F.col("shard") % PASSES == of)))
    return C.saved(every.groupBy("lang", "shard").applyInArrow(add, PIECE), "words")


def whole_scores(docs: DataFrame, chars: int, pair_chars: int = PAIR_CHARS) -> DataFrame:
    """As scores(), by models in which every word is a symbol."""
    shards = max(1, -(-chars // pair_chars))
    word_shards = -(-shards // WORD_SHARDS)
    blocks = streams(docs, codes(docs, chars))

    def passes(one: Callable[[int], DataFrame], n: int) -> DataFrame:
        out = []
        for of in range(min(n, PASSES)):
            if out:
                _let_go(docs)
            out.append(one(of))
        if len(out) > 1:
            _let_go(docs)
        return reduce(DataFrame.unionByName, out)

    pairs = passes(lambda of: counted_pairs(blocks, shards, word_shards, of), shards)
    words = passes(lambda of: counted_words(blocks, pairs, word_shards, of), word_shards)
    totals: dict[tuple, np.ndarray] = defaultdict(lambda: np.zeros(6, np.int64))  # as many as languages
    for df, kind in ((pairs, PAIR_TOTALS), (words, WORD_TOTALS)):
        for r in df.filter(F.col("kind") == kind).select("lang", "fold", "a").toLocalIterator():
            x = unpack(bytes(r["a"]), np.int64)
            totals[r["lang"], r["fold"], kind][: len(x)] += x
    sent = docs.sparkSession.sparkContext.broadcast(dict(totals))

    def score(key_: tuple, t: pa.Table) -> pa.Table:
        got: dict[int, dict[int, dict]] = defaultdict(dict)
        for r in _rows(t):
            got[r["kind"]][r["shard"]] = r
        r = got[STREAM][0]
        ids, missing, n = unpack(r["a"], np.int64), unpack(r["b"], np.uint8), unpack(r["c"], U32).astype(np.int64)
        two, one = (sent.value.get((r["lang"], 1 - r["fold"], kind)) for kind in (PAIR_TOTALS, WORD_TOTALS))
        sums, squares = np.zeros(len(n)), np.zeros(len(n))
        if two is not None:
            keys, v, w, shard, which, _ = pairs_of(unpack_sorted(r["d"]), unpack(r["e"], U32), n, shards)
            figures, c = np.zeros((5, len(keys)), np.int64), np.zeros(len(v), np.int64)
            for s, i in by_shard(C.mix(keys), word_shards):
                for x, name in zip(figures, "abcde"):
                    x[i] = unpack(got[WORDS][s][name], U64)
            for s, i in by_shard(shard, shards):
                c[i] = unpack(got[PAIRS][s]["a"], U32)
            ends, follow, *some = figures
            d = discounts_of(one[:4])
            left = (d[1] * one[0] + d[2] * one[1] + d[3] * (one[5] - one[0] - one[1])) / one[4]
            below = (ends - d[np.minimum(ends, 3)]) / one[4] + left / (one[5] + 1)
            d = discounts_of(two[:4])
            weight = np.where(follow > 0, sum(x * k for x, k in zip(d[1:], some)) / np.maximum(1, follow), 1.0)
            p = (c - d[np.minimum(c, 3)]) / np.maximum(1, follow[v]) + weight[v] * below[w]
            bits = -np.log(p)[which]
            at = np.concatenate([[0], np.cumsum(n)])
            for out, x in ((sums, bits), (squares, bits * bits)):
                total = np.concatenate([[0.0], np.cumsum(x)])
                out[:] = total[at[1:]] - total[at[:-1]]
        none = (n == 0) | (two is None)
        lang = None if r["lang"] == "?" else r["lang"][1:]
        return pa.Table.from_arrays([pa.array(ids, mask=missing > 0), pa.array([lang] * len(n), pa.string()), pa.array(n), *(pa.array(x, mask=none) for x in (sums, squares))], names=SCORE.names)

    every = blocks.unionByName(pairs.filter(F.col("kind") == PAIRS)).unionByName(words.filter(F.col("kind") == WORDS))
    of_task = F.shiftright("block", 32) % min(shards, PASSES)
    return passes(lambda of: C.saved(every.filter(of_task == of).groupBy("block").applyInArrow(score, SCORE), "scores"), shards)


def judge(scored: DataFrame, below: float = BELOW, above: float = ABOVE, floor: float = FLOOR, min_docs: int = MIN_DOCS) -> DataFrame:
    """doc_id, lang, perplexity, lower, upper, accepted."""
    scored = scored.withColumn("x", F.col("bits") / F.when(F.col("n") > 0, F.col("n")))
    known = scored.filter("x is not null")
    mean = F.sum("bits") / F.sum("n")
    # as many rows as languages
    mid = known.groupBy("lang").agg(F.percentile_approx("x", 0.5, 100000).alias("mid"), F.count("*").alias("m"), F.greatest(F.lit(0.0), F.sum("squares") / F.sum("n") - mean * mean).alias("v"))
    mid = C.saved(mid.filter(F.col("m") >= min_docs).select(F.col("lang").alias("of"), "mid", "v"), "medians")
    off = known.join(mid, known["lang"].eqNullSafe(mid["of"])).groupBy("of", "mid", "v").agg(F.percentile_approx(F.abs(F.col("x") - F.col("mid")), 0.5, 100000).alias("mad"))
    band = off.select("of", "mid", "v", F.greatest(F.lit(floor), 1.4826 * F.col("mad")).alias("sd"))
    out = scored.join(band, scored["lang"].eqNullSafe(band["of"]), "left")
    reach = F.sqrt(F.col("sd") * F.col("sd") + F.col("v") / F.when(F.col("n") > 0, F.col("n")))
    out = out.withColumn("low", F.col("mid") - below * reach).withColumn("high", F.col("mid") + above * reach)
    ok = (F.col("n") > 0) & F.coalesce(F.col("x").between(F.col("low"), F.col("high")), F.lit(True))
    return out.select("doc_id", "lang", F.exp("x").alias("perplexity"), F.exp("low").alias("lower"), F.exp("high").alias("upper"), ok.alias("accepted"))


def quality(docs: DataFrame, vocabulary: int | None = None, below: float = BELOW, above: float = ABOVE, floor: float = FLOOR, min_docs: int = MIN_DOCS, small_bytes: int = SMALL_BYTES, shard_chars: int = SHARD_CHARS, pair_chars: int = PAIR_CHARS) -> DataFrame:
    """doc_id, lang, perplexity, lower, upper, accepted for every row. small_bytes and shard_chars are for a vocabulary, pair_chars for all words."""
    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    if vocabulary is None:
        return judge(whole_scores(docs, chars, pair_chars), below, above, floor, min_docs)
    if vocabulary + FIRST > 1 << BITS:
        raise ValueError(f"a vocabulary has at most {(1 << BITS) - FIRST} words")
    shards = max(1, -(-chars // shard_chars))
    known = vocabularies(docs, shards, vocabulary)
    return judge(C.saved(scores(docs, train(docs, shards, known), known, small_bytes), "scores"), below, above, floor, min_docs)
