"""HTML extraction with a suffix array for each host.

Pages become their visible words. The word streams of a host's pages are concatenated and a suffix array sorts all suffixes by
their first `min_words` words (prefix doubling; deeper order changes nothing here). Neighbours with a common prefix of that
length that lies within its page form the repeats; a repeat that occurs on `min_pages` distinct pages or more is boilerplate, and
all words that it covers are removed. What is left of a page are its unique runs, one a line.

A host of more than `part_words` words is divided in parts by hash of page_id. Workers build the suffix array of the pages of a part that they meet, and give out its distinct
prefixes by hash, each with at most `min_pages` of its pages. These sorted runs are merged by range of the hash, which tells the prefixes on enough pages of the host, and each
part's pages are cut by those that the part has. So no task holds more than a part, and a boilerplate that all pages have is one entry of a run.

Defined results: a null url or one without a host belongs to the host ''. Null and empty html, and pages without visible words, give an empty text and 0 words.
Rows are pages of their own only by page_id: repeated rows of a page_id are one page for the count of distinct pages, and each gives a row. A null page_id is one page. Empty tables give empty
results. Other columns are ignored. Unclosed comments, scripts, tags and quotes run to the end of the page; reading takes time in proportion to the page, whatever it holds.
Titles are not shown; a head ends where its elements do, so that a page may leave out any of its optional tags.
"""

from __future__ import annotations

import html as entities
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from srcplan.llm import common as C

MIN_WORDS, MIN_PAGES = 8, 2
#: Words of a part of a host, which one task holds (about 40 bytes each), on average.
PART_WORDS = 1_000_000
#: Words of large hosts that a worker gathers before it sorts them.
RUN_WORDS = 2_000_000
U64 = np.uint64
RESULT = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("host", T.StringType()), T.StructField("n_words", T.IntegerType()), T.StructField("n_removed", T.IntegerType()), T.StructField("text", T.StringType())])

# what stands between a tag's name and its end; quotes count after an equals sign, and nothing is tried twice
_REST = r"""(?:[^>=]++|=\s*+(?:"[^"]*+(?:"|\Z)|'[^']*+(?:'|\Z)|))*+(?:>|\Z)"""
_MARKUP = re.compile(
    rf"<!--(?:>|->|.*?(?:--!?>|\Z))|<(?P<raw>script|style|title|noscript|template|textarea|svg|iframe)(?=[\s/>]|\Z){_REST}(?:(?<=/>)|.*?(?:</(?P=raw)(?=[\s/>]|\Z){_REST}|\Z))"
    rf"|</?(?P<inline>a|abbr|b|bdi|bdo|cite|code|em|font|i|kbd|mark|q|s|samp|small|span|strong|sub|sup|tt|u|var|wbr)(?=[\s/>]|\Z){_REST}|</?[a-zA-Z]{_REST}|<[!?/][^>]*+(?:>|\Z)",
    re.S | re.I,
)


def _space(m: re.Match) -> str:
    return "" if m["inline"] else " "


def visible(page: str | None) -> str:
    """The words of a page that a reader sees, with one blank between any two."""
    if not page:
        return ""
    return " ".join(entities.unescape(_MARKUP.sub(_space, page)).split())


_BYTE = C.mix(np.arange(256, dtype=U64) + U64(0x51ED270B)) | U64(1)


def token_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, first word of each text plus the total). Words lie between single blanks."""
    data, off = C.buffer_of(texts)
    inside = data != 32
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1 if len(data) else np.zeros(0, np.int64)
    if len(data) and inside[0]:
        edge = np.concatenate([[0], edge])
    start, end = edge[0::2], edge[1::2]
    return C.hash_spans(data, start, end, _BYTE), np.searchsorted(start, off)


def host_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """token_hashes of many texts, some at a time."""
    n = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
    parts, sizes, at = [], [np.zeros(1, np.int64)], 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(n, (n[at - 1] if at else 0) + C.BLOCK_BYTES, "right")))
        h, first = token_hashes(texts.slice(at, to - at))
        parts.append(h)
        sizes.append(np.diff(first))
        at = to
    return np.concatenate(parts) if parts else np.zeros(0, U64), np.cumsum(np.concatenate(sizes))


def _ranked(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order of the keys, rank of each), 32 bits each; in pieces, so that the keys are never copied whole."""
    n, step = len(key), 1 << 20
    order = np.argsort(key).astype(np.int32)
    rank, last, top = np.empty(n, np.int32), None, -1
    for at in range(0, n, step):
        o = order[at : at + step]
        k = key[o]
        new = np.empty(len(k), bool)
        new[0] = last is None or k[0] != last
        np.not_equal(k[1:], k[:-1], out=new[1:])
        rank[o] = np.cumsum(new, dtype=np.int32) + np.int32(top)
        top, last = int(rank[o[-1]]), k[-1]
    return order, rank


def suffix_array(h: list[np.ndarray], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(suffixes sorted by their first `depth` words, rank of each suffix: equal for an equal prefix). h: the word hashes, taken out of their list.

    A prefix that the end cuts short ranks before its continuations. Arrays of 32 bits, as a task sorts under 2**31 words.
    """
    key = h.pop()
    n = len(key)
    order, rank = _ranked(key)
    done = 1
    while done < depth:
        step = min(done, depth - done)  # overlapping halves give the exact depth
        del order, key
        key = rank.astype(np.int64)
        key *= n + 2
        if step < n:
            key[: n - step] += rank[step:]
            key[: n - step] += 1
        del rank
        order, rank = _ranked(key)
        done += step
    return order, rank


def repeated(page: np.ndarray, order: np.ndarray, rank: np.ndarray, valid: np.ndarray, min_pages: int) -> np.ndarray:
    """Which valid suffixes share their prefix with valid suffixes of at least min_pages distinct pages in all."""
    out = np.zeros(len(page), bool)
    order = order[valid[order]]
    r = rank[order]
    same = r[1:] == r[:-1]
    several = np.zeros(len(order), bool)
    several[1:] |= same
    several[:-1] |= same
    order = order if min_pages < 2 else order[several]  # those that occur once are done with
    r, p = rank[order], page[order]
    again = np.lexsort((p, r))
    r, p, order = r[again], p[again], order[again]
    if len(r):
        new = np.concatenate([[True], r[1:] != r[:-1]])
        group = np.cumsum(new) - 1
        pages = np.bincount(group, new | np.concatenate([[True], p[1:] != p[:-1]]))
        out[order] = pages[group] >= min_pages
    return out


def covered(starts: np.ndarray, width: int) -> np.ndarray:
    """Positions that lie in a window of this width from a marked start."""
    out, done = starts.copy(), 1
    while done < width:
        step = min(done, width - done)
        out[step:] |= out[:-step].copy()
        done += step
    return out


def runs(words: list[str], gone: np.ndarray) -> str:
    """The words that stay, a line for each run."""
    if not gone.any():
        return " ".join(words)
    edges = np.flatnonzero(np.diff(np.concatenate([[True], gone, [True]]).astype(np.int8)))
    return "\n".join(" ".join(words[a:b]) for a, b in zip(edges[::2], edges[1::2]))


def _pages(page_id: pa.Array) -> np.ndarray:
    """32-bit hashes of page ids; a null is a page of its own."""
    ids = page_id.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).view(U64)
    ids = C.mix(ids + U64(0x9E3779B97F4A7C15))
    ids[page_id.is_null().to_numpy(zero_copy_only=False)] = U64(0x5DEECE66D5DEECE6)
    return (ids >> U64(32)).astype(np.uint32)


def _sorted_suffixes(page_id: pa.Array, texts: pa.Array, min_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(order and rank of the suffixes, which prefixes lie within their page, page of each word, hash of each prefix, first word of each page plus the total)."""
    h, first = host_hashes(texts)
    n, size = len(h), np.diff(first)
    prefix = np.zeros(n, U64)
    prefix[: max(0, n - min_words + 1)] = C.kgrams(h, min_words)
    taken = [h]
    del h
    order, rank = suffix_array(taken, min_words)
    valid = np.repeat(first[1:].astype(np.int32), size) - np.arange(n, dtype=np.int32) >= min_words
    return order, rank, valid, np.repeat(_pages(page_id), size), prefix, first


def run_of(page_id: pa.Array, texts: pa.Array, min_words: int, min_pages: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct prefixes of some pages by their hash, ascending, each with up to min_pages of its pages."""
    order, rank, valid, page, prefix, _ = _sorted_suffixes(page_id, texts, min_words)
    order = order[valid[order]]
    r, p = rank[order], page[order]
    again = np.lexsort((p, r))
    r, p, order = r[again], p[again], order[again]
    if not len(r):
        return np.zeros(0, U64), np.zeros(0, np.uint32)
    new = np.concatenate([[True], r[1:] != r[:-1]])
    other = new | np.concatenate([[True], p[1:] != p[:-1]])
    nth = np.cumsum(other)
    keep = other & (nth - np.maximum.accumulate(np.where(new, nth, 0)) < min_pages)
    h, p = prefix[order[keep]], p[keep]
    by = np.argsort(h, kind="stable")
    return h[by], p[by]


def cut_host(page_id: pa.Array, texts: pa.Array, min_words: int, min_pages: int, common: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """(which words of the pages are boilerplate, first word of each page plus the total). common: the repeated prefixes of a host of several parts, ascending."""
    if common is None:
        order, rank, valid, page, _, first = _sorted_suffixes(page_id, texts, min_words)
        return covered(repeated(page, order, rank, valid, min_pages), min_words), first
    h, first = host_hashes(texts)
    hit = np.zeros(len(h), bool)
    g = C.kgrams(h, min_words)
    hit[: len(g)] = common[np.minimum(np.searchsorted(common, g), len(common) - 1)] == g
    hit &= np.repeat(first[1:], np.diff(first)) - np.arange(len(h)) >= min_words
    return covered(hit, min_words), first


def _host_task(batches: Iterator[pa.RecordBatch], min_words: int, min_pages: int) -> Iterator[pa.RecordBatch]:
    """Pages sorted by host and part, after the part's common prefixes: each part is gathered, cut and given out in small batches."""
    held: list[pa.RecordBatch] = []

    def flush() -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(held).combine_chunks()
        held.clear()
        marks = pc.drop_null(t.column("common")).to_pylist()
        t = t.filter(pc.is_null(t.column("common")))
        ids, host, texts = (t.column(c).combine_chunks() for c in ("page_id", "host", "text"))
        texts = texts.cast(pa.large_string())
        del t
        gone, first = cut_host(ids, texts, min_words, min_pages, np.sort(np.frombuffer(b"".join(marks), U64)) if marks else None)
        for lo in range(0, len(ids), 500):
            hi = min(lo + 500, len(ids))
            rows = [(gone[first[i] : first[i + 1]], texts[i].as_py()) for i in range(lo, hi)]
            yield pa.RecordBatch.from_arrays(
                [ids.slice(lo, hi - lo), host.slice(lo, hi - lo), pa.array([len(g) for g, _ in rows], pa.int32()), pa.array([int(g.sum()) for g, _ in rows], pa.int32()), pa.array([runs(t.split(" ") if t else [], g) for g, t in rows], pa.string())], names=RESULT.names
            )

    for batch in batches:
        host, part = batch.column("host").to_numpy(zero_copy_only=False), batch.column("part").to_numpy()
        edges = [0, *(np.flatnonzero((host[1:] != host[:-1]) | (part[1:] != part[:-1])) + 1).tolist(), len(host)]
        for lo, hi in zip(edges[:-1], edges[1:]):
            if lo == hi:
                continue
            if held and (held[-1].column("host")[0].as_py(), held[-1].column("part")[0].as_py()) != (host[lo], part[lo]):
                yield from flush()
            held.append(batch.slice(lo, hi - lo))
    if held:
        yield from flush()


def _common(pages: DataFrame, min_words: int, min_pages: int, run_words: int) -> DataFrame:
    """(host, part, common): of pages (page_id, host, text, part, parts), the prefixes of each part that are on min_pages pages of the host."""

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, int, int], list[pa.RecordBatch]] = {}
        words = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for (host, part, parts), own in held.items():
                t = pa.Table.from_batches(own).combine_chunks()
                h, p = run_of(t.column("page_id").combine_chunks(), t.column("text").cast(pa.large_string()).combine_chunks(), min_words, min_pages)
                edges = np.searchsorted((h >> U64(32)) * U64(parts) >> U64(32), np.arange(parts + 1, dtype=U64))
                some = np.flatnonzero(np.diff(edges))
                cut = [slice(edges[k], edges[k + 1]) for k in some]
                yield pa.RecordBatch.from_arrays([pa.array([host] * len(some), pa.string()), pa.array([part] * len(some), pa.int32()), pa.array(some.astype(np.int32)), pa.array([h[c].tobytes() for c in cut], pa.binary()), pa.array([p[c].tobytes() for c in cut], pa.binary())], names=["host", "part", "range", "h", "p"])
            held.clear()

        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in ("host", "part", "parts"))))
            own = defaultdict(list)
            for i, k in enumerate(keys):
                own[k].append(i)
            for k, rows in own.items():
                held.setdefault(k, []).append(batch.select(["page_id", "text"]).take(pa.array(rows)))
            words += pc.sum(pc.count_substring(batch.column("text"), " ")).as_py() or 0
            if words > run_words:
                yield from flush()
                words = 0
        yield from flush()

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        h = [np.frombuffer(x, U64) for x in pdf["h"]]
        every, p = np.concatenate(h), np.concatenate([np.frombuffer(x, np.uint32) for x in pdf["p"]])
        order = np.lexsort((p, every))
        every, p = every[order], p[order]
        new = np.concatenate([[True], every[1:] != every[:-1]])
        several = np.bincount(np.cumsum(new) - 1, new | np.concatenate([[True], p[1:] != p[:-1]])) >= min_pages
        common = every[new][several]
        out = []
        for part, own in pdf.groupby("part").indices.items():
            x = np.unique(np.concatenate([h[i] for i in own]))
            x = x[np.isin(x, common, assume_unique=True)]
            if len(x):
                out.append((pdf["host"].iloc[0], part, x.tobytes()))
        return pd.DataFrame(out, columns=["host", "part", "common"])

    runs_ = pages.transform(C.mapped, sort, "host string, part int, range int, h binary, p binary")
    return C.saved(runs_.groupBy("host", "range").applyInPandas(merge, "host string, part int, common binary"), "common")


def extract(pages: DataFrame, min_words: int = MIN_WORDS, min_pages: int = MIN_PAGES, part_words: int = PART_WORDS, run_words: int = RUN_WORDS) -> DataFrame:
    """page_id, host, n_words, n_removed and the unique runs as text, for every row."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in C.blocks(batch, "html"):
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array([visible(x) for x in b.column("html").to_pylist()], pa.string())], names=[*names, "text"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in C.blocks(batch, "html"):
                n = [t.count(" ") + 1 if (t := visible(x)) else 0 for x in b.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column("host"), pa.array(n, pa.int64())], names=["host", "n"])

    names = ["page_id", "host", "part", "parts"]
    host = F.coalesce(F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))
    known = pages.select(F.col("page_id").cast("long"), host.alias("host"), "html")
    # pages are parsed again, as that takes less than to keep their texts on disk in between
    sizes = known.select("host", "html").transform(C.mapped, count, "host string, n long").groupBy("host").agg(F.sum("n").alias("n"))
    large = C.saved(sizes.filter(F.col("n") > part_words).select("host", F.ceil(F.col("n") / max(1, part_words)).cast("int").alias("parts")), "hosts")
    n = large.count()
    sent = F.broadcast(large) if n <= C.SMALL_IDS else large
    divided = known.join(sent, "host", "left") if n else known.withColumn("parts", F.lit(None).cast("int"))
    divided = divided.withColumn("part", F.when(F.col("parts").isNotNull(), F.pmod(F.xxhash64("page_id"), F.col("parts"))).otherwise(0).cast("int"))

    def parsed(own: DataFrame) -> DataFrame:
        return own.select(*names, "html").transform(C.mapped, parse, "page_id long, host string, part int, parts int, text string")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _host_task(batches, min_words, min_pages)

    every = parsed(divided).select("host", "part", "page_id", "text", F.lit(None).cast("binary").alias("common"))
    if n:
        common = _common(parsed(divided.filter("parts is not null")), min_words, min_pages, run_words)
        every = every.union(common.select("host", "part", F.lit(None).cast("long"), F.lit(None).cast("string"), "common"))
    return every.repartition("host", "part").sortWithinPartitions("host", "part").transform(C.mapped, task, RESULT)


#: The tables' pages are plain enough for SQL: no nested raw elements, no marks within quotes, and four kinds of entities.
_RAW_SQL = "(?is)<!--.*?(?:--!?>|\\z)|" + "|".join(rf"<{x}(?:[\s/][^>]*)?>.*?(?:</{x}(?:[\s/][^>]*)?>|\z)" for x in "script style title noscript template textarea svg iframe".split())
_INLINE_SQL = r"(?is)</?(?:a|abbr|b|bdi|bdo|cite|code|em|font|i|kbd|mark|q|s|samp|small|span|strong|sub|sup|tt|u|var|wbr)(?:[\s/][^>]*)?(?:>|\z)"
ORACLE = f"""
WITH p AS (SELECT row_number() OVER () AS rid, page_id, coalesce(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)), '') AS host,
  regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''), '{_RAW_SQL}', ' ', 'g'), '{_INLINE_SQL}', '', 'g'), '(?s)<[a-zA-Z/!?][^>]*(?:>|\\z)', ' ', 'g') AS t FROM pages),
e AS (SELECT rid, page_id, host, regexp_replace(replace(replace(replace(t, '&copy;', '\u00a9'), '&middot;', '\u00b7'), '&quot;', '"'), '&amp;?', '&', 'g') AS t FROM p),
u AS (SELECT rid, page_id, host, list_filter(string_split_regex(t, '[\\s\u00a0]+'), lambda x: x <> '') AS w FROM e),
g AS (SELECT rid, page_id, host, i, array_to_string(w[i : i + {MIN_WORDS - 1}], ' ') AS k FROM (SELECT *, unnest(range(1, len(w) - {MIN_WORDS - 2})) AS i FROM u)),
c AS (SELECT host, k FROM g GROUP BY ALL HAVING count(DISTINCT page_id) >= {MIN_PAGES}),
gone AS (SELECT DISTINCT rid, i + j AS i FROM (SELECT rid, i FROM g JOIN c USING (host, k)), (SELECT unnest(range({MIN_WORDS})) AS j)),
x AS (SELECT rid, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM u),
s AS (SELECT x.rid, x.i, word, x.i - row_number() OVER (PARTITION BY x.rid ORDER BY x.i) AS island FROM x ANTI JOIN gone ON gone.rid = x.rid AND gone.i = x.i),
r AS (SELECT rid, island, min(i) AS i, string_agg(word, ' ' ORDER BY i) AS run, count(*) AS n FROM s GROUP BY ALL),
t AS (SELECT rid, string_agg(run, chr(10) ORDER BY i) AS text, sum(n) AS n FROM r GROUP BY rid)
SELECT page_id, host, CAST(len(w) AS INTEGER) AS n_words, CAST(len(w) - coalesce(n, 0) AS INTEGER) AS n_removed, coalesce(text, '') AS text FROM u LEFT JOIN t USING (rid)
"""
