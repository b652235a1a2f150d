"""Near-duplicate documents by Order MinHash, verified by banded alignment.

A document is its sequence of word hashes. Each k-mer of words is labelled with which occurrence of that k-mer it is, and each of
`sketches` hash functions picks the `picks` labelled k-mers of least hash; their hash in text order is one sketch. Two
documents meet if they agree in a sketch, which is likelier the closer they are in edit distance, not only in content. Texts under SHORT words have sketches of
four single words instead, as few of their 3-mers survive an edit; texts near that length have both. Pairs that meet
are verified: the edit distance of their words, computed within the band that the threshold allows, must leave a similarity
1 - distance / longer length of at least `threshold`. Groups are the connected components of verified pairs.

A bucket is the documents that agree in a sketch. Buckets of up to `bucket` members give all their pairs. A larger one is searched around a leader: every
member is aligned with the leader, and sketched again by what it has besides the leader's words (by labelled words, or by labelled pairs of
words where hardly a word is left). Members whose rests agree form the buckets of the next level, unless all of them are in one group by what was aligned so far, and no pair is aligned twice. So
a group of thousands of copies costs one comparison a copy, thousands of different pages with one boilerplate are told apart by what is their own, and no
bucket is gathered in a task. What `levels` leaders do not separate is compared in full. Rests are sketches too: a pair of a
large bucket that nothing else brings together is found with high probability, as any pair is.
Documents with the same words are grouped by a 128-bit hash of the sequence beforehand and only one of them is compared.

Defined results: rows with a null doc_id and texts without a word (null, empty, only signs) are in no group. Rows that repeat a doc_id are
documents of their own; the result has them under that doc_id, and keep_one leaves one row of a group. Ties between representatives go to the smallest doc_id.
Documents with fewer than k words have one k-mer, all their words. Empty tables give empty results. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from srcplan.llm import common as C

K, PICKS, SKETCHES, THRESHOLD = 3, 3, 64, 0.8
#: Texts under SHORT words have sketches of SHORT_PICKS single words; those from LONG words on have sketches of k-mers. A pair within the threshold has one kind in common.
SHORT, LONG, SHORT_PICKS, SHORT_SKETCHES = 64, 48, 4, 32
#: Members of a bucket of which all pairs are aligned, and leaders that a larger one has at most, one after the other.
BUCKET, LEVELS = 8, 8
REST_SKETCHES = 24
#: Words of rests that are sketched at once; results do not depend on it.
REST_WORDS = 1 << 17
U64 = np.uint64
TOP = U64(0xFFFFFFFF00000000)


def _odd(n: int, seed: int) -> np.ndarray:
    return C.mix(np.arange(1, n + 1, dtype=U64) * U64(0x9E3779B97F4A7C15) + U64(seed)) | U64(1)


def whole_hashes(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """128-bit hash of the words of each text that has any."""
    n = np.diff(first)
    begin = first[:-1][n > 0]
    if not len(begin):
        return np.zeros((0, 2), U64)
    place = (np.arange(len(h)) - np.repeat(first[:-1], n)).astype(U64)
    return np.stack([np.add.reduceat(C.mix(h * U64(m) + C.mix(place + U64(s))), begin) for m, s in ((0xA24BAED4963EE407, 1), (0x9FB21C651E98DF25, 2))], 1)


def sketch(h: np.ndarray, first: np.ndarray, k: int, picks: int, sketches: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows of those texts that have words, their sketches)."""
    n = np.diff(first)
    some = np.flatnonzero(n > 0)
    if not len(some):
        return some, np.zeros((0, sketches), U64)
    size, begin = n[some], first[:-1][some]
    count = np.maximum(size - k + 1, 1)
    start = np.cumsum(count) - count
    at = np.arange(int(count.sum())) - np.repeat(start - begin, count)
    g = np.empty(len(at), U64)
    long = np.repeat(size >= k, count)
    if long.any():
        g[long] = C.kgrams(h, k)[at[long]]
    if not long.all():
        g[start[size < k]] = whole_hashes(h, first)[size < k, 0]
    # label each k-mer with its occurrence
    doc = np.repeat(np.arange(len(some)), count)
    key = C.mix(g ^ C.mix(doc.astype(U64) + U64(77)))
    order = np.argsort(key, kind="stable")
    new = np.concatenate([[True], key[order][1:] != key[order][:-1]])
    run = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    if not new.all():
        occ = np.empty(len(order), U64)
        occ[order] = (np.arange(len(order)) - run).astype(U64)
        u = C.mix(g + occ * U64(0xD1342543DE82EF95))
    else:
        u = C.mix(g)
    local = (np.arange(len(u)) - np.repeat(start, count)).astype(U64)
    out = np.empty((len(some), sketches), U64)
    seeds, odds = _odd(sketches, 11 + 100 * k), _odd(sketches, 12 + 100 * k)
    for s in range(sketches):
        w = (((u ^ seeds[s]) * odds[s]) & TOP) | local
        got = []
        for p in range(picks):
            low = np.minimum.reduceat(w, start)
            got.append(np.where(low == U64(2**64 - 1), U64(2**32 - 1), low & U64(0xFFFFFFFF)))
            if p + 1 < picks:
                w[start + (low & U64(0xFFFFFFFF)).astype(np.int64) * (got[-1] != U64(2**32 - 1))] = U64(2**64 - 1)
        pos = np.sort(np.stack(got, 1), 1)
        value = np.full(len(some), seeds[s], U64)
        for p in range(picks):
            there = pos[:, p] != U64(2**32 - 1)
            x = np.where(there, u[start + np.where(there, pos[:, p], U64(0)).astype(np.int64)], U64(0))
            value = C.mix(value * U64(0xC2B2AE3D27D4EB4F) + x)
        out[:, s] = value
    return some, out


def banded_distance(a: np.ndarray, b: np.ndarray, most: int) -> int:
    """Edit distance of two sequences, or most + 1 if it is larger.

    Bit-parallel over the diagonals within `most` of the main one: bit i of the vertical deltas stands for a diagonal, and
    a step along b moves the band one element down a.
    """
    m = min(len(a), len(b))
    eq = a[:m] == b[:m]
    pre = m if eq.all() else int(np.argmin(eq))
    a, b = a[pre:], b[pre:]
    m = min(len(a), len(b))
    if m:
        eq = a[len(a) - m :][::-1] == b[len(b) - m :][::-1]
        suf = m if eq.all() else int(np.argmin(eq))
        a, b = a[: len(a) - suf], b[: len(b) - suf]
    if len(a) < len(b):
        a, b = b, a
    n, m = len(a), len(b)
    if n - m > most:
        return most + 1
    if not m:
        return n
    most = min(most, n)
    where: dict[int, int] = {}
    for i, x in enumerate(a.tolist()):  # positions of a, moved up by the half band
        where[x] = where.get(x, 0) | (1 << (i + most))
    width = 2 * most + 1
    full, top = (1 << width) - 1, 1 << (width - 1)
    # bit d is row j + d - most of column j; rows above a have delta +1 from a virtual border
    vp, vn, dist = full ^ ((1 << most) - 1), 0, most
    get = where.get
    edge = top >> 1
    for j, y in enumerate(b.tolist()):
        x = (get(y, 0) >> j) & full
        d0 = ((((x & vp) + vp) ^ vp) | x | vn) & full
        hp = vn | (full & ~(d0 | vp))
        hn = d0 & vp
        if j + most < n:  # the lowest diagonal still runs inside a
            dist += not d0 & top
        else:
            dist += (hp & edge != 0) - (hn & edge != 0)
            edge >>= 1
        d1 = d0 >> 1
        vp = hn | (full & ~(d1 | hp))
        vn = d1 & hp
    return dist if dist <= most else most + 1


def similar(a: np.ndarray, b: np.ndarray, threshold: float) -> bool:
    """Whether 1 - distance / longer length is at least the threshold; cheap bounds go first."""
    n = max(len(a), len(b))
    most = int((1 - threshold) * n + 1e-9)
    if abs(len(a) - len(b)) > most:
        return False
    both = np.concatenate([a, b])
    _, inv = np.unique(both, return_inverse=True)
    size = int(inv.max()) + 1 if len(inv) else 0
    diff = np.bincount(inv[: len(a)], minlength=size) - np.bincount(inv[len(a) :], minlength=size)
    if max(int(diff[diff > 0].sum()), int(-diff[diff < 0].sum())) > most:
        return False
    return banded_distance(a, b, most) <= most


def chosen(h: np.ndarray, first: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first) of the texts to keep."""
    n = np.diff(first)
    return h[np.repeat(keep, n)], np.concatenate([[0], np.cumsum(n[keep])])


def keys_of(h: np.ndarray, first: np.ndarray, k: int, picks: int, sketches: int) -> tuple[np.ndarray, list[bytes]]:
    """(rows of those texts that have words, the keys of their buckets)."""
    n = np.diff(first)
    parts: list[list[bytes]] = [[] for _ in n]
    for keep, args in ((n < SHORT, (1, SHORT_PICKS, min(sketches, SHORT_SKETCHES))), (n >= LONG, (k, picks, sketches))):
        at = np.flatnonzero(keep)
        some, s = sketch(*chosen(h, first, keep), *args)
        for i, row in zip(at[some], s):
            parts[i].append(row.tobytes())
    some = np.flatnonzero(n > 0)
    return some, [b"".join(parts[i]) for i in some]


def _sketches(docs: DataFrame, k: int, picks: int, sketches: int) -> DataFrame:
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("n", T.IntegerType()), T.StructField("w1", T.LongType()), T.StructField("w2", T.LongType()), T.StructField("s", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in C.blocks(batch, "text", 1 << 20):
                h, first, *_ = C.words(b.column("text"))
                some, s = keys_of(h, first, k, picks, sketches)
                whole = whole_hashes(h, first)
                yield pa.RecordBatch.from_arrays([b.column("id").take(pa.array(some)), pa.array(np.diff(first)[some].astype(np.int32)), pa.array(whole[:, 0].view(np.int64)), pa.array(whole[:, 1].view(np.int64)), pa.array(s, pa.binary())], names=schema.names)

    return docs.transform(C.mapped, run, schema)


def _buckets(rows: DataFrame) -> DataFrame:
    """(key, id, n) and, if rows have it, label, for each key in s."""
    names = [c for c in ("id", "n", "label") if c in rows.columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m = pc.divide(pc.binary_length(b.column("s")), 8).to_numpy(zero_copy_only=False)
            keys = np.frombuffer(b"".join(b.column("s").to_pylist()), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(keys), *(pa.array(np.repeat(b.column(c).to_numpy(), m)) for c in names)], names=["key", *names])

    return rows.select(*names, "s").transform(C.mapped, run, "key long, id long, n int" + ", label long" * ("label" in names))


def components(edges: DataFrame) -> DataFrame:
    """(id, root) for each end of the edges (a, b): the smallest id that can be reached.

    In every round each id takes its smallest neighbour, two steps of that are followed, and the edges are contracted; what a round leaves is written to the shared folder.
    """
    live = C.saved(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    total = None
    while True:
        up = live.select(F.col("b").alias("id"), F.col("a").alias("to")).union(live.select(F.col("a").alias("id"), F.col("b").alias("to"))).groupBy("id").agg(F.least("id", F.min("to")).alias("p"))
        up = C.saved(up, "parents")
        top = up.select(F.col("id").alias("p"), F.col("p").alias("root"))
        up = C.saved(up.join(top, "p").select("id", "root"), "parents")
        total = up if total is None else C.saved(total.join(up.select(F.col("id").alias("root"), F.col("root").alias("r")), "root", "left").select("id", F.coalesce("r", "root").alias("root")), "roots")
        live = live.join(up.select(F.col("id").alias("a"), F.col("root").alias("ra")), "a").join(up.select(F.col("id").alias("b"), F.col("root").alias("rb")), "b")
        live = C.saved(live.filter("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), "edges")
        if live.isEmpty():
            return total


def _words(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, words) of those documents that met another, written to the shared folder. words: 32 bits of each word's hash."""
    some = docs.join(ids, "id", "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in C.blocks(batch, "text"):
                h, first, *_ = C.words(b.column("text"))
                low = (h >> U64(32)).astype(np.uint32)
                yield pa.RecordBatch.from_arrays([b.column("id"), pa.array([low[first[i] : first[i + 1]].tobytes() for i in range(b.num_rows)], pa.binary())], names=["id", "words"])

    return C.saved(some.transform(C.mapped, run, "id long, words binary"), "words")


def occurrences(words: np.ndarray) -> np.ndarray:
    """64-bit labels: each word with which occurrence of it this is."""
    order = np.argsort(words, kind="stable")
    w = words[order]
    new = np.concatenate([[True], w[1:] != w[:-1]]) if len(w) else np.zeros(0, bool)
    out = np.empty(len(w), U64)
    out[order] = (np.arange(len(w)) - np.maximum.accumulate(np.where(new, np.arange(len(w)), 0))).astype(U64)
    return C.mix(words.astype(U64) | out << U64(32))


def pairs_of(words: np.ndarray) -> np.ndarray:
    """32-bit hashes of neighbouring words."""
    return (C.mix(words[:-1].astype(U64) << U64(32) | words[1:].astype(U64)) >> U64(32)).astype(np.uint32)


class Leader:
    """What a leader's words leave of a member."""

    def __init__(self, words: np.ndarray) -> None:
        self.one, self.two = np.sort(occurrences(words)), np.sort(occurrences(pairs_of(words)))

    @staticmethod
    def _rest(known: np.ndarray, own: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(known, own), max(0, len(known) - 1))
        return own[known[at] != own] if len(known) else own

    def rests(self, words: np.ndarray, threshold: float) -> list[np.ndarray]:
        """[rest by words, rest by pairs of words]; empty where the other kind is enough. Of two texts within the threshold, one kind is there for both."""
        one, slack = self._rest(self.one, occurrences(words)), (1 - threshold) * len(words)
        return [one if len(one) > 0.7 * slack else one[:0], self._rest(self.two, occurrences(pairs_of(words))) if len(one) <= 2.2 * slack else one[:0]]


def _verify(pairs: DataFrame, words: DataFrame, threshold: float) -> DataFrame:
    """pairs (a, b, n, label, hot) with ok, whether they align, and for hot pairs s, the keys of b by what a leaves of it. A pair that is labelled as of one group is not aligned, and not ok."""
    schema = T.StructType([*(T.StructField(c, T.LongType()) for c in ("a", "b")), T.StructField("n", T.IntegerType()), T.StructField("label", T.LongType()), T.StructField("hot", T.BooleanType()), T.StructField("ok", T.BooleanType()), T.StructField("s", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lead, leader = None, None
        for b in batches:
            a, hot, label = (b.column(c).to_pylist() for c in ("a", "hot", "label"))
            own, ok = [], np.zeros(b.num_rows, bool)
            keys: list[list[bytes]] = [[] for _ in a]
            rests: tuple[list, list] = ([], [])
            for i, (x, y) in enumerate(zip(b.column("wa").to_pylist(), b.column("wb").to_pylist())):
                p, q = np.frombuffer(x, np.uint32), np.frombuffer(y, np.uint32)
                ok[i] = label[i] != a[i] and similar(p, q, threshold)
                if hot[i]:
                    if lead != a[i]:
                        lead, leader = a[i], Leader(p)
                    own.append(i)
                    for kind, r in zip(rests, leader.rests(q, threshold)):
                        kind.append(r)
            seed = C.mix(np.array([a[i] for i in own], np.int64).view(U64))
            for kind, rest in enumerate(rests):
                first = np.concatenate([[0], np.cumsum([len(r) for r in rest])]).astype(np.int64)
                at = 0
                while at < len(own):  # a few at a time, so that the sketches stay small
                    to = max(at + 1, int(np.searchsorted(first, first[at] + REST_WORDS, "right")) - 1)
                    some, s = sketch(np.concatenate(rest[at:to]), first[at : to + 1] - first[at], 1, PICKS, REST_SKETCHES)
                    s = C.mix(s ^ (seed[at + some] + U64(kind))[:, None])
                    for j, row in zip(some, s):
                        keys[own[at + j]].append(row.tobytes())
                    at = to
            for j, i in enumerate(own):
                if not keys[i] and not ok[i] and label[i] != a[i]:  # nothing is left of it, and yet it does not align
                    keys[i].append(C.mix(seed[j : j + 1] + U64(9)).tobytes())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in schema.names[:5]), pa.array(ok), pa.array([b"".join(k) for k in keys], pa.binary())], names=schema.names)

    met = pairs.join(words.select(F.col("id").alias("b"), F.col("words").alias("wb")), "b").join(words.select(F.col("id").alias("a"), F.col("words").alias("wa")), "a")
    return met.select("a", "b", "n", "label", "hot", "wa", "wb").transform(C.mapped, run, schema)


def _pairs(rows: DataFrame, threshold: float, bucket: int, seen: DataFrame | None) -> DataFrame:
    """Of the buckets (key, id, n, label): distinct pairs (a, b, n, label, hot), n and label of b, without those of seen (lo, hi).

    All pairs of small buckets, and hot ones of a leader with each member of larger buckets. Members of one label are known to be in one group; without labels, each is by itself.
    """
    # a leader is a member that is in no group yet, if there is one
    if "label" in rows.columns:
        found = rows.groupBy("key").agg(F.count("*").alias("m"), F.coalesce(F.min(F.when(F.col("label") == F.col("id"), F.col("id"))), F.min("id")).alias("lead"), F.bit_xor(F.xxhash64("id", "label")).alias("same"), F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo <> hi")
    else:
        found = rows.groupBy("key").agg(F.count("*").alias("m"), F.min("id").alias("lead"), F.bit_xor(F.xxhash64("id")).alias("same")).filter("m > 1")
    # of buckets with the same members one is enough; many members of one bucket are split by the join
    found = C.saved(found.groupBy("m", "lead", "same").agg(F.min("key").alias("key")).select("key", "m", "lead"), "buckets")
    members = rows.join(found.hint("merge"), "key")
    members = members if "label" in rows.columns else members.withColumn("label", F.col("id"))
    hot = members.filter((F.col("m") > bucket) & (F.col("id") != F.col("lead"))).select(F.col("lead").alias("a"), F.col("id").alias("b"), "n", "label", F.lit(True).alias("hot"))
    if not bucket:  # no leader is left: all pairs, by a join that splits large buckets
        x, y = (members.select("key", F.struct("id", "n", "label").alias(c)) for c in "xy")
        few, hot = x.join(y, "key").filter("x.id < y.id"), hot.limit(0)
    else:
        few = _few(members.filter(F.col("m") <= bucket), bucket)
    near = F.abs(F.col("x.n") - F.col("y.n")) <= F.floor((1 - threshold) * F.greatest("x.n", "y.n") + 1e-9)
    few = few.filter(near & (F.col("x.label") != F.col("y.label"))).select(F.col("x.id").alias("a"), F.col("y.id").alias("b"), F.col("y.n").alias("n"), F.col("y.label").alias("label"), F.lit(False).alias("hot"))
    every = few.union(hot).groupBy("a", "b").agg(F.max("n").alias("n"), F.min("label").alias("label"), F.max("hot").alias("hot"))
    if seen is not None:
        every = every.join(seen, (F.least("a", "b") == seen["lo"]) & (F.greatest("a", "b") == seen["hi"]), "left_anti")
    return C.saved(every, "pairs")


def _few(members: DataFrame, bucket: int) -> DataFrame:
    """All pairs (x, y) of members of small buckets."""
    few = members.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("id", "n", "label"))).alias("m"))
    return few.select(F.posexplode("m").alias("i", "x"), "m").select("x", F.explode(F.slice("m", F.col("i") + 2, bucket)).alias("y"))


def _keyed(docs: DataFrame) -> tuple[DataFrame, str, bool]:
    """(docs with an id for each row, the name of that column, whether it is doc_id): rows of repeated doc_ids are numbered in a table of the shared folder; a null doc_id has no id."""
    name = "_id"
    while name in docs.columns:
        name += "_"
    ids = docs.select(F.col("doc_id").cast("long").alias("id")).filter("id is not null")
    if ids.groupBy("id").count().filter("count > 1").isEmpty():
        return docs.withColumn(name, F.col("doc_id").cast("long")), name, True
    return C.saved(docs.withColumn(name, F.when(F.col("doc_id").isNotNull(), F.monotonically_increasing_id())), "rows"), name, False


def groups(docs: DataFrame, k: int = K, picks: int = PICKS, sketches: int = SKETCHES, threshold: float = THRESHOLD, bucket: int = BUCKET, levels: int = LEVELS, seen: list | None = None) -> DataFrame:
    """(id, root, links) of docs (id, text) with unique ids: the smallest id of the group, and how many links were verified between its text and others or are to its copies. seen: gets the number of pairs that were aligned at each level."""
    drawn = C.saved(_sketches(docs, k, picks, sketches), "sketches")
    one = C.saved(drawn.groupBy("w1", "w2").agg(F.min("id").alias("rep"), F.min_by(F.struct("n", "s"), "id").alias("x"), F.count("*").alias("m")), "texts")
    reps = one.select(F.col("rep").alias("id"), "x.n", "x.s")
    rows, good, words, past, roots = _buckets(reps), None, None, None, None
    for level in range(levels + 1):
        pairs = _pairs(rows, threshold, bucket if level < levels else 0, past)
        met = C.saved(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "met")
        met = F.broadcast(met) if met.count() <= C.SMALL_IDS else met
        if words is None:
            words = _words(docs, met)
        # later levels move the words of few documents
        done = C.saved(_verify(pairs, words.join(met, "id", "left_semi") if level else words, threshold), "aligned")
        if seen is not None:
            seen.append(done.filter("label <> a").count())
        new = done.filter("ok").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        if good is None or not new.isEmpty():
            good = C.saved((new if good is None else good.union(new)).distinct(), "good")
            roots = components(good)
        # what a leader leaves of its members is of use where some of them are of other groups
        of = lambda c, name: roots.select(F.col("id").alias(c), F.col("root").alias(name))
        hot = done.filter("hot").select("a", "b").join(of("b", "label"), "b", "left").join(of("a", "own"), "a", "left")
        hot = C.saved(hot.select("a", "b", F.coalesce("label", "b").alias("label"), F.coalesce("own", "a").alias("own")), "hot")
        torn = C.saved(hot.filter("label <> own").select("a").distinct(), "leaders")
        if torn.isEmpty():
            break
        sent = F.broadcast(torn) if torn.count() <= C.SMALL_IDS else torn
        rest = done.filter("hot").select("a", "b", "n", "s").join(sent, "a", "left_semi").join(hot.select("a", "b", "label").join(sent, "a", "left_semi"), ["a", "b"])
        rows = _buckets(C.saved(rest.select(F.col("b").alias("id"), "n", "label", "s"), "rests"))
        tried = done.select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi"))
        past = tried if past is None else past.union(tried)
    degree = good.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count("*").alias("links"))
    roots = roots.withColumnRenamed("id", "rep").join(degree, "rep")
    texts = one.select("rep", "w1", "w2", "m").join(roots, "rep", "left").filter("m > 1 or root is not null")
    texts = texts.select("w1", "w2", F.coalesce("root", "rep").alias("root"), (F.coalesce("links", F.lit(0)) + F.col("m") - 1).alias("links"))
    return drawn.select("id", "w1", "w2").join(texts, ["w1", "w2"]).select("id", "root", "links")


def near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """doc_id, group_id (the smallest doc_id of the group) and n_links for each document that has a near duplicate.

    n_links: copies of its text besides itself, and different texts that were verified to be near. Texts that are known to be in one group need not be compared, so this counts the links
    that hold the group together, not all pairs.
    """
    rows, key, own = _keyed(docs.select(F.col("doc_id").cast("long"), "text"))
    out = groups(rows.filter(F.col(key).isNotNull()).select(F.col(key).alias("id"), "text"), **options)
    if own:
        return out.select(F.col("id").alias("doc_id"), F.col("root").alias("group_id"), F.col("links").alias("n_links"))
    out = C.saved(out.join(rows.select(F.col(key).alias("id"), "doc_id"), "id"), "groups")
    least = out.groupBy("root").agg(F.min("doc_id").alias("group_id"))
    return out.join(least, "root").select("doc_id", "group_id", F.col("links").alias("n_links"))


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """The documents without those that have a near duplicate of smaller doc_id; documents without an id stay."""
    rows, key, _ = _keyed(docs)
    out = groups(rows.filter(F.col(key).isNotNull()).select(F.col(key).alias("id"), "text"), **options)
    return C.without(rows, out.filter("id != root").select("id"), key).select(*docs.columns)
