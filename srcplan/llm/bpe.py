"""Byte-level BPE with a pair occurrence index.

A block of texts is cut into pieces by the tokenizer's pattern. The distinct pieces that no earlier block of the worker had are laid
out as one array of symbols with links to both neighbours, and an index maps each mergeable pair to all its positions.
The active rank that is lowest is applied at all its positions, which changes the lists of the pairs at either side; a heap
gives the next rank. Where a merge opens a lower rank, that one goes first, so the result is that of merging piece by piece.

Defined results: a null text gives null ids and null count; an empty text no ids and 0. Texts of any length are encoded
whole. Every row gives one row; repeated rows repeat. Other columns are ignored. Ids that the vocabulary lacks decode as nothing.
"""

from __future__ import annotations

import base64
import heapq
import re
import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from srcplan.llm import common as C

VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
ENCODED = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType(), False)), T.StructField("n_tokens", T.IntegerType())])
#: Pieces remembered by a worker before those not used since are dropped, and pairs whose rank is; bound memory only.
REMEMBERED, PAIRS = 180_000, 300_000
#: Text encoded at once; its new pieces share one index.
BLOCK_BYTES = 1 << 20


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f) if a}


def _charset(kind: str) -> str:
    out, start = [], None
    for c in range(sys.maxunicode + 2):
        yes = c <= sys.maxunicode and not 0xD800 <= c < 0xE000 and unicodedata.category(chr(c))[0] == kind
        if yes and start is None:
            start = c
        elif not yes and start is not None:
            out.append(f"\\U{start:08x}" + (f"-\\U{c - 1:08x}" if c - 1 > start else ""))
            start = None
    return "".join(out)


_SPACE = r"\t\n\x0b\x0c\r \x85\xa0  -     　"
_LATIN_LETTER, _LATIN_NUMBER = r"a-zA-Z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff", r"0-9\xb2\xb3\xb9\xbc-\xbe"
_beyond = re.compile(r"[^\x00-\x1b\x20-\xff]").search


def _pattern(letter: str, number: str, space: str) -> re.Pattern:
    return re.compile(f" ?[{letter}]+|'(?:[stmd]|re|ve|ll)| ?[{number}]+| ?[^{space}{letter}{number}]+|[{space}]+(?![^{space}])|[{space}]+")


#: Latin-1 texts give the same pieces by this smaller pattern, four times as fast.
_latin = _pattern(_LATIN_LETTER, _LATIN_NUMBER, r"\s").findall
_full: list = []


def pieces_of(text: str) -> list[str]:
    """How the tokenizer cuts text, in the character classes that the standard library knows."""
    if _beyond(text) is None:
        return _latin(text)
    if not _full:
        _full.append(_pattern(_charset("L"), _charset("N"), _SPACE).findall)
    return _full[0](text)


class Encoder:
    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.bytes = {r: t for t, r in ranks.items()}
        self.single = np.array([ranks[bytes([i])] for i in range(256)], np.int64)
        self.pairs: dict[int, int] = {}
        self.known: dict[str, list[int]] = {}
        self.older: dict[str, list[int]] = {}
        self.shared = list(range(max(ranks.values()) + 1))

    def rank(self, a: int, b: int) -> int:
        """Rank of the pair, which is the id that it merges to, or -1."""
        key = a << 20 | b
        r = self.pairs.get(key)
        if r is None:
            r = self.pairs[key] = self.ranks.get(self.bytes[a] + self.bytes[b], -1)
        return r

    def pieces(self, new: list[str]) -> None:
        """Encodes these distinct pieces together."""
        raw = [p.encode() for p in new]
        direct = self.ranks
        rest = [i for i, p in enumerate(raw) if p not in direct]
        for p, r in zip(new, raw):
            if r in direct:
                self.known[p] = [self.shared[direct[r]]]
        if not rest:
            return
        size = np.fromiter((len(raw[i]) for i in rest), np.int64, len(rest))
        start = np.cumsum(size) - size
        flat = self.single[np.frombuffer(b"".join([raw[i] for i in rest]), np.uint8)]
        total = len(flat)
        last = start + size - 1
        # the index at the start: pairs that lie within a piece, grouped by rank
        key = flat[:-1] << 20 | flat[1:]
        inner = np.ones(total, bool)
        inner[last] = False
        uniq, inv = np.unique(key, return_inverse=True)
        ranks = np.array([self.rank(int(u) >> 20, int(u) & 0xFFFFF) for u in uniq], np.int64)
        pr = ranks[inv]
        where = np.flatnonzero((pr >= 0) & inner[:-1])
        order = where[np.argsort(pr[where], kind="stable")]
        edges = np.flatnonzero(np.diff(pr[order], prepend=-2))
        index: dict[int, list[int]] = {int(pr[order[s]]): part.tolist() for s, part in zip(edges, np.split(order, edges[1:]))} if len(order) else {}
        heap = list(index)
        heapq.heapify(heap)
        sym, right = flat.tolist(), np.arange(1, total + 1)
        right[last] = -1
        right = right.tolist()
        left = np.arange(-1, total - 1)
        left[start] = -1
        left = left.tolist()
        rank_of, known_pairs = self.rank, self.pairs
        push, pop = heapq.heappush, heapq.heappop
        while heap:
            r = pop(heap)
            at = index.pop(r, None)
            if at is None:
                continue
            at.sort()
            lower = False
            for i, p in enumerate(at):
                a = sym[p]
                if a < 0 or (q := right[p]) < 0:
                    continue
                k = a << 20 | sym[q]
                if known_pairs.get(k, -1) != r:
                    continue
                sym[p], sym[q] = r, -1
                n = right[p] = right[q]
                if n >= 0:
                    left[n] = p
                    k = r << 20 | sym[n]
                    x = known_pairs.get(k)
                    if x is None:
                        x = rank_of(r, sym[n])
                    if x >= 0:
                        if (lst := index.get(x)) is None:
                            index[x] = [p]
                            push(heap, x)
                        else:
                            lst.append(p)
                        lower = x < r
                m = left[p]
                if m >= 0:
                    k = sym[m] << 20 | r
                    x = known_pairs.get(k)
                    if x is None:
                        x = rank_of(sym[m], r)
                    if x >= 0:
                        if (lst := index.get(x)) is None:
                            index[x] = [m]
                            push(heap, x)
                        else:
                            lst.append(m)
                        lower = lower or x < r
                if lower:
                    if i + 1 < len(at):
                        if (lst := index.get(r)) is None:
                            index[r] = at[i + 1 :]
                            push(heap, r)
                        else:
                            lst.extend(at[i + 1 :])
                    break
        out = np.array(sym, np.int64)
        kept = out >= 0
        shared = self.shared
        ids = [shared[i] for i in out[kept].tolist()]
        ends = np.cumsum(np.add.reduceat(kept, start)).tolist()
        known, s = self.known, 0
        for i, e in zip(rest, ends):
            known[new[i]] = ids[s:e]
            s = e

    def encode(self, texts: list[str | None]) -> list[list[int] | None]:
        cut = [pieces_of(t) if t else [] for t in texts]
        if len(self.known) > REMEMBERED:
            self.older, self.known = self.known, {}
        if len(self.pairs) > PAIRS:
            self.pairs.clear()
        known = self.known
        new = set().union(*cut).difference(known) if cut else set()
        if again := new & self.older.keys():
            known.update((p, self.older[p]) for p in again)
            new -= again
        if new:
            self.pieces(list(new))
        out: list[list[int] | None] = []
        for t, ps in zip(texts, cut):
            ids: list[int] = []
            more = ids.extend
            for p in ps:
                more(known[p])
            out.append(None if t is None else ids)
        return out

    def decode(self, ids: list[int] | None) -> str | None:
        get = self.bytes.get
        return None if ids is None else b"".join([get(i, b"") for i in ids]).decode("utf-8", "replace")


def _ranks(df: DataFrame, vocabulary: str):
    """The vocabulary, sent to all workers once: a file of fixed size, under 2 MB."""
    with open(vocabulary, "rb") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


_encoders: dict[int, Encoder] = {}


def _encoder(raw: bytes) -> Encoder:
    """One encoder for all tasks of a worker, with the pieces that it remembers."""
    key = hash(raw)
    C.CACHES["bpe"] = _encoders.clear
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder({base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines()) if a})
    return _encoders[key]


def encode(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, ids, n_tokens for every row."""
    sent = _ranks(docs, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(sent.value)
        for batch in batches:
            for b in C.blocks(batch, "text", BLOCK_BYTES):
                ids = enc.encode(b.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(ids, pa.list_(pa.int32())), pa.array([None if x is None else len(x) for x in ids], pa.int32())], names=ENCODED.names)

    return docs.select(F.col("doc_id").cast("long"), "text").transform(C.mapped, run, ENCODED, "bpe")


def decode(encoded: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, text of the ids in column ids."""
    sent = _ranks(encoded, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(sent.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([enc.decode(x) for x in batch.column("ids").to_pylist()], pa.string())], names=["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long"), "ids").transform(C.mapped, run, "doc_id long, text string", "bpe")


def round_trip(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, ids, n_tokens and the text that the ids decode to, in one pass over the documents."""
    sent = _ranks(docs, vocabulary)
    schema = T.StructType([*ENCODED.fields, T.StructField("decoded", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(sent.value)
        for batch in batches:
            for b in C.blocks(batch, "text", BLOCK_BYTES):
                ids = enc.encode(b.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id"), pa.array(ids, pa.list_(pa.int32())), pa.array([None if x is None else len(x) for x in ids], pa.int32()), pa.array([enc.decode(x) for x in ids], pa.string())], names=schema.names
                )

    return docs.select(F.col("doc_id").cast("long"), "text").transform(C.mapped, run, schema, "bpe")
