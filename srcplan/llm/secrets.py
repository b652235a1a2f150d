"""Secret scan through a trigram inverted index.

For each rule a Boolean query over trigrams is derived from its regular expression: every match must satisfy it. Each block of documents of a
worker gets an inverted index, from the trigrams of the queries to the documents that hold them; the postings are intersected and
united as the query says, and the expression itself runs over the candidates only. A rule for which no trigram is mandatory runs over every
document. Index and queries are in lower case (ASCII), so that case-insensitive rules need no expansion. An index
covers one block and lives as long as it; nothing is shuffled.

Defined results: null and empty texts have no match. Matches of a rule do not overlap and are numbered from 0 in text order. Every row is
scanned whole, repeated rows repeat their matches, a null doc_id keeps them; other columns are ignored. Secrets leave only as a
preview of four characters and a SHA-256 digest.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from re import _constants as S
from re import _parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from srcplan.llm import common as C

#: (name, expression). The dialect is what Python's and RE2's syntax share, with ASCII classes.
RULES: list[tuple[str, str]] = [
    ("aws-access-key", r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b"),
    ("github-token", r"\bgh[pousr]_[A-Za-z0-9]{36,}\b"),
    ("slack-token", r"\bxox[abprs]-[A-Za-z0-9-]{10,}"),
    ("google-api-key", r"\bAIza[0-9A-Za-z_-]{35}"),
    ("stripe-key", r"\b[rs]k_live_[0-9A-Za-z]{16,}\b"),
    ("openai-style-key", r"\bsk-[A-Za-z0-9_-]{20,}"),
    ("gitlab-token", r"\bglpat-[A-Za-z0-9_-]{20,}"),
    ("npm-token", r"\bnpm_[A-Za-z0-9]{36}\b"),
    ("pypi-token", r"\bpypi-AgEIcHlwaS5vcmc[A-Za-z0-9_-]{50,}"),
    ("sendgrid-key", r"\bSG\.[A-Za-z0-9_-]{22}\.[A-Za-z0-9_-]{43}"),
    ("huggingface-token", r"\bhf_[A-Za-z0-9]{34,}\b"),
    ("shopify-token", r"\bshp(?:at|ca|pa|ss)_[a-fA-F0-9]{32}\b"),
    ("slack-webhook", r"https://hooks\.slack\.com/services/T[A-Z0-9]{8,}/B[A-Z0-9]{8,}/[A-Za-z0-9]{20,}"),
    ("azure-storage-key", r"\bAccountKey=[A-Za-z0-9+/]{86}=="),
    ("bearer-header", r"(?i)\bauthorization[\"']?[ \t]*:[ \t]*[\"']?bearer[ \t]+[A-Za-z0-9._~+/=-]{16,}"),
    ("private-key", r"-----BEGIN (?:[A-Z]+ )?PRIVATE KEY-----"),
    ("json-web-token", r"\beyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
    ("url-password", r"[a-z][a-z0-9+.-]{1,20}://[^\s/:@]{1,64}:[^\s/:@]{1,64}@[A-Za-z0-9.-]+"),
    ("assigned-secret", r"(?i)\b(?:api[_-]?key|secret|password|passwd|token)[\"']?[ \t]*[:=][ \t]*[\"']?[A-Za-z0-9_/+=.-]{8,}"),
    ("hex-key", r"\b[0-9a-f]{40}\b"),
]
RESULT = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("rule", T.StringType()), T.StructField("match_no", T.IntegerType()), T.StructField("n_chars", T.IntegerType()), T.StructField("preview", T.StringType()), T.StructField("digest", T.StringType())]
)

# ---- from expressions to Boolean queries: ("all",), ("tri", t), ("and", q...), ("or", q...)

ALL = ("all",)
#: Sets of strings larger than this are cut down to trigrams; longer strings likewise. Neither loses matches.
MOST_STRINGS = 24


def _and(*qs: tuple) -> tuple:
    flat = dict.fromkeys(x for q in qs for x in (q[1:] if q[0] == "and" else [q]) if x != ALL)
    return ALL if not flat else next(iter(flat)) if len(flat) == 1 else ("and", *flat)


def _or(*qs: tuple) -> tuple:
    if not qs or ALL in qs:
        return ALL
    flat = dict.fromkeys(x for q in qs for x in (q[1:] if q[0] == "or" else [q]))
    return next(iter(flat)) if len(flat) == 1 else ("or", *flat)


def _of_string(s: bytes) -> tuple:
    return _and(*(("tri", s[i : i + 3]) for i in range(len(s) - 2)))


def _of_strings(strings: set[bytes]) -> tuple:
    return _or(*(_of_string(s) for s in sorted(strings)))


@dataclass
class Part:
    """What is known of an expression: the exact strings it matches, or how its matches begin and end, and a query that all satisfy."""

    exact: set[bytes] | None
    prefix: set[bytes]
    suffix: set[bytes]
    query: tuple

    def loose(self) -> Part:
        if self.exact is None:
            return self
        return Part(None, self.exact, self.exact, _and(self.query, _of_strings(self.exact)))


def _any() -> Part:
    return Part(None, {b""}, {b""}, ALL)


def _cut(p: Part) -> Part:
    """Bounds the sets: what is cut off has been turned into the query."""
    if p.exact is not None and (len(p.exact) > MOST_STRINGS or any(len(s) > 24 for s in p.exact)):
        p = p.loose()
    if p.exact is None:
        query = _and(p.query, _of_strings(p.prefix), _of_strings(p.suffix))
        prefix, suffix = {s[:2] for s in p.prefix}, {s[-2:] for s in p.suffix}
        return Part(None, prefix if len(prefix) <= MOST_STRINGS else {b""}, suffix if len(suffix) <= MOST_STRINGS else {b""}, query)
    return p


def _concat(a: Part, b: Part) -> Part:
    if a.exact is not None and b.exact is not None:
        if len(a.exact) * len(b.exact) <= 4 * MOST_STRINGS:
            return _cut(Part({x + y for x in a.exact for y in b.exact}, set(), set(), _and(a.query, b.query)))
        a = a.loose()
    left, right = a.exact if a.exact is not None else a.suffix, b.exact if b.exact is not None else b.prefix
    across = _of_strings({x + y for x in left for y in right}) if len(left) * len(right) <= MOST_STRINGS**2 else ALL
    prefix = {x + y for x in a.exact for y in right} if a.exact is not None else a.prefix
    suffix = {x + y for x in left for y in b.exact} if b.exact is not None else b.suffix
    if a.exact is not None and b.exact is None:
        b = Part(None, set(), b.suffix, b.query)
    return _cut(Part(None, prefix, suffix, _and(a.query, b.query, across)))


def _union(parts: list[Part]) -> Part:
    if all(p.exact is not None for p in parts):
        return _cut(Part(set().union(*(p.exact for p in parts)), set(), set(), _or(*(p.query for p in parts))))
    parts = [p.loose() for p in parts]
    return _cut(Part(None, set().union(*(p.prefix for p in parts)), set().union(*(p.suffix for p in parts)), _or(*(p.query for p in parts))))


def _char(c: int, fold: bool) -> Part:
    if fold and c > 127 or fold and chr(c).lower() in "ks":  # the Kelvin sign and the long s fold to these
        return _any()
    return Part({chr(c).encode().lower()}, set(), set(), ALL)


def _walk(tree, fold: bool) -> Part:
    out = Part({b""}, set(), set(), ALL)
    for op, arg in tree:
        if op is S.LITERAL:
            p = _char(arg, fold)
        elif op is S.IN:
            chars: set[int] | None = set()
            for o, a in arg:
                if o is S.LITERAL and chars is not None:
                    chars.add(a)
                elif o is S.RANGE and chars is not None and a[1] - a[0] < 64:
                    chars |= set(range(a[0], a[1] + 1))
                else:
                    chars = None
            p = _any() if chars is None or len(chars) > MOST_STRINGS else _union([_char(c, fold) for c in chars])
        elif op is S.SUBPATTERN:
            p = _walk(arg[3], (fold or bool(arg[1] & re.I)) and not arg[2] & re.I)
        elif op is S.BRANCH:
            p = _union([_walk(x, fold) for x in arg[1]])
        elif op in (S.MAX_REPEAT, S.MIN_REPEAT, S.POSSESSIVE_REPEAT):
            low, high, sub = arg
            inner = _walk(sub, fold)
            if low == 0:
                p = _union([inner, Part({b""}, set(), set(), ALL)]) if high == 1 else _any()
            else:
                p = inner
                for _ in range(min(low, 8) - 1):
                    p = _concat(p, inner)
                if high != low or low > 8:
                    p = p.loose()
                    p = Part(None, p.prefix, p.suffix if low <= 8 else inner.loose().suffix, p.query)
        elif op is S.ATOMIC_GROUP:
            p = _walk(arg, fold)
        elif op in (S.AT, S.ASSERT, S.ASSERT_NOT):  # no text of its own
            p = Part({b""}, set(), set(), ALL)
        else:
            p = _any()
        out = _concat(out, p)
    return out


def trigram_query(expression: str) -> tuple:
    """A query over lower-case byte trigrams that holds for every text in which the expression matches."""
    tree = _parser.parse(expression, re.A)
    p = _walk(tree, bool(tree.state.flags & re.I)).loose()
    return _and(p.query, _of_strings(p.prefix), _of_strings(p.suffix))


def trigrams(query: tuple) -> set[bytes]:
    return {query[1]} if query[0] == "tri" else set().union(*(trigrams(q) for q in query[1:]), set())


# ---- the index of a block

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


class Postings:
    """Ascending documents of each wanted trigram, in one block of texts."""

    def __init__(self, texts: pa.Array, wanted: list[bytes], number: np.ndarray) -> None:
        data, off = C.buffer_of(texts)
        self.n = len(off) - 1
        c = _FOLD[data]
        code = c[:-2].astype(np.uint32)
        code <<= np.uint32(8)
        code |= c[1:-1]
        code <<= np.uint32(8)
        code |= c[2:]
        which = number[code]
        at = np.flatnonzero(which >= 0)
        which = which[at]
        doc = np.searchsorted(off, at, "right") - 1
        inside = at + 2 < off[doc + 1] - 1  # not across two texts
        pairs = np.unique(which[inside].astype(np.int64) * self.n + doc[inside])
        edges = np.searchsorted(pairs, np.arange(len(wanted) + 1) * self.n)
        self.docs = {t: pairs[edges[k] : edges[k + 1]] % max(self.n, 1) for k, t in enumerate(wanted)}

    def find(self, query: tuple) -> np.ndarray:
        """The documents for which the query holds."""
        if query == ALL:
            return np.arange(self.n)
        if query[0] == "tri":
            return self.docs[query[1]]
        parts = [self.find(q) for q in query[1:]]
        out = parts[0]
        for p in parts[1:]:
            out = np.intersect1d(out, p, True) if query[0] == "and" else np.union1d(out, p)
        return out


def scan(docs: DataFrame, rules: list[tuple[str, str]] | None = None) -> DataFrame:
    """doc_id, rule, match_no, n_chars, preview, digest of every match."""
    rules = RULES if rules is None else rules
    queries = [(name, expression, trigram_query(expression)) for name, expression in rules]
    wanted = sorted(set().union(*(trigrams(q) for *_, q in queries), set()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = np.full(1 << 24, -1, np.int16)
        for k, t in enumerate(wanted):
            number[t[0] << 16 | t[1] << 8 | t[2]] = k
        compiled = [(name, re.compile(expression, re.A), query) for name, expression, query in queries]
        for batch in batches:
            for b in C.blocks(batch, "text"):
                index = Postings(b.column("text"), wanted, number)
                texts, ids = b.column("text"), b.column("doc_id")
                rows = []
                for name, expression, query in compiled:
                    for i in index.find(query).tolist():
                        text = texts[i].as_py()
                        for k, m in enumerate(expression.finditer(text or "")):
                            s = m.group()
                            rows.append((ids[i].as_py(), name, k, len(s), s[:4], hashlib.sha256(s.encode()).hexdigest()))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string()))], names=RESULT.names)

    return docs.select(F.col("doc_id").cast("long"), "text").transform(C.mapped, run, RESULT)


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


ORACLE = " UNION ALL ".join(
    f"SELECT doc_id, {_quoted(name)} AS rule, CAST(k AS INTEGER) AS match_no, CAST(length(m) AS INTEGER) AS n_chars, left(m, 4) AS preview, sha256(m) AS digest "
    f"FROM (SELECT doc_id, unnest(x) AS m, unnest(range(len(x))) AS k FROM (SELECT doc_id, regexp_extract_all(text, {_quoted(expression)}) AS x FROM documents))"
    for name, expression in RULES
)
