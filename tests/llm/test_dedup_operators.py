"""Near-dedup, decontamination, line dedup, BPE and the pipeline against brute force."""

from __future__ import annotations

import hashlib
import os
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from srcplan.llm import bpe, common, decontaminate, language, line_dedup, near_dedup

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[0-9a-z_\u0080-\U0010ffff]+")
needs_vocabulary = pytest.mark.skipif(not os.path.exists(bpe.VOCABULARY), reason="no vocabulary here")


def _words(t):
    return WORD.findall((t or "").lower())


def test_words_are_hashed_alike():
    texts = ["The cat, the CAT; the_cat", "", None, "é É ünï-x 12", "  "]
    h, first, start, end, off = common.words(pa.array(texts, pa.large_string()))
    cut = [_words(t) for t in texts]
    assert np.diff(first).tolist() == [len(c) for c in cut]
    seen = {}
    for x, w in zip(h.tolist(), sum(cut, [])):
        assert seen.setdefault(w, x) == x
    assert len(set(seen.values())) == len(seen)


# ---- 5 near duplicates


def _distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=14), st.lists(st.integers(0, 3), max_size=14), st.integers(0, 9))
def test_banded_distance(a, b, most):
    want = _distance(a, b)
    assert near_dedup.banded_distance(np.array(a, np.uint32), np.array(b, np.uint32), most) == (want if want <= most else most + 1)


def _variants(rng):
    """Texts with copies at several edit distances, and texts of their own."""
    vocab = [f"w{i}" for i in range(3000)]
    out = []
    for g in range(25):
        base = rng.choices(vocab, k=rng.randrange(30, 120))
        out.append(base)
        for _ in range(rng.randrange(0, 4)):
            t = list(base)
            for _ in range(int(len(t) * rng.choice([0, 0.02, 0.05, 0.1, 0.3]))):
                k = rng.randrange(len(t))
                t[k : k + 1] = rng.choice([[], [rng.choice(vocab)], [t[k], rng.choice(vocab)]])
            out.append(t)
        out.append(rng.sample(base, len(base)))  # the same words in another order
    return [" ".join(t) for t in out]


def _groups(texts, threshold):
    """Groups by all pairs: texts maps ids to texts."""
    ids = [i for i, t in texts.items() if _words(t)]
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    pairs = set()
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            x, y = _words(texts[a]), _words(texts[b])
            n = max(len(x), len(y))
            if abs(len(x) - len(y)) <= (1 - threshold) * n and sum((Counter(x) - Counter(y)).values()) <= (1 - threshold) * n and _distance(x, y) <= (1 - threshold) * n + 1e-9:
                pairs.add((a, b))
                p, q = sorted((find(a), find(b)))
                root[q] = p
    return pairs, {i: find(i) for i in ids}


def _near(df, **options):
    return {r["doc_id"]: r["group_id"] for r in near_dedup.near_duplicates(df, **options).collect()}


@pytest.mark.parametrize("bucket", [near_dedup.BUCKET, 2])
def test_near_duplicates_equal_all_pairs(spark, bucket):
    texts = dict(enumerate(_variants(random.Random(6))))
    df = spark.createDataFrame([(i, t, "g") for i, t in texts.items()], "doc_id long, text string, group_id string")
    got = _near(df, bucket=bucket)
    pairs, root = _groups(texts, near_dedup.THRESHOLD)
    assert len(pairs) > 20
    found = sum(got.get(a, a) == got.get(b, b) for a, b in pairs)
    assert found >= 0.95 * len(pairs)
    assert all(root[a] == root[g] for a, g in got.items())  # nothing that all pairs would keep apart


def test_short_texts_meet(spark):
    rng = random.Random(9)
    texts, pairs = {}, []
    for i in range(0, 600, 2):
        t = [f"s{rng.randrange(5000)}" for _ in range(rng.randrange(5, 70))]
        u = list(t)
        for k in rng.sample(range(len(t)), len(t) // 5):
            u[k] = f"n{rng.randrange(5000)}"
        texts |= {i: " ".join(t), i + 1: " ".join(u)}
        pairs.append((i, i + 1))
    got = _near(spark.createDataFrame(list(texts.items()), "doc_id long, text string"))
    assert sum(got.get(a, a) == got.get(b, b) for a, b in pairs) >= 0.95 * len(pairs)  # all at the threshold


def _boilerplate(n, rng):
    """Pages of 120 words, of which 80 are the same, and some near copies among them."""
    notice = [f"b{i}" for i in range(80)]
    texts = [[*notice[:40], *(f"w{rng.randrange(20000)}" for _ in range(40)), *notice[40:]] for _ in range(n)]
    for k in range(0, n, 10):
        t = list(texts[k])
        for _ in range(6):
            t[rng.randrange(120)] = f"e{rng.randrange(20000)}"
        texts.append(t)
    return [" ".join(t) for t in texts]


def test_boilerplate_does_not_meet_in_all_pairs(spark):
    aligned = []
    for n in (100, 200, 400):
        texts = dict(enumerate(_boilerplate(n, random.Random(n))))
        seen = []
        df = spark.createDataFrame(list(texts.items()), "id long, text string")
        got = {r["id"]: r["root"] for r in near_dedup.groups(df, seen=seen).collect()}
        want = {n + k: 10 * k for k in range(n // 10)}
        assert all(got.get(x, x) == x or want.get(x) == got[x] for x in texts)
        assert sum(got.get(a) == b for a, b in want.items()) >= 0.95 * len(want)
        aligned.append(sum(seen))
    assert aligned[2] < 2.6 * aligned[1] < 6.8 * aligned[0] and aligned[2] < 15 * 440


def test_what_no_leader_separates_is_compared(spark):
    rng = random.Random(1)
    base = [f"p{i}" for i in range(60)]
    texts = [" ".join(rng.sample(base, 60)) for _ in range(40)] + [" ".join([*base, "x"]), " ".join(base)]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    got = {r["id"]: (r["root"], r["links"]) for r in near_dedup.groups(df, bucket=2, levels=0).collect()}
    assert got == {40: (40, 1), 41: (40, 1)}


def test_large_cluster_of_edited_copies(spark):
    rng = random.Random(4)
    base = [f"c{rng.randrange(3000)}" for _ in range(90)]
    texts = {}
    for i in range(150):
        t = list(base)
        for _ in range(4):
            t[rng.randrange(90)] = f"e{rng.randrange(9999)}"
        texts[i] = " ".join(t)
    far = list(base)
    for k in range(0, 90, 6):
        far[k] = f"f{k}"
    texts[150] = " ".join(far)
    df = spark.createDataFrame(list(texts.items()), "id long, text string")
    seen = []
    got = {r["id"]: r["root"] for r in near_dedup.groups(df, seen=seen).collect()}
    _, root = _groups(texts, near_dedup.THRESHOLD)
    assert got == {i: r for i, r in root.items() if sum(x == r for x in root.values()) > 1} and sum(seen) < 20 * 150


def test_near_duplicate_edges(spark):
    long = " ".join(f"t{i}" for i in range(50_000))
    rows = [(5, "same text here twice"), (3, "Same text, here twice!"), (9, None), (8, ""), (7, "?!"), (None, "same text here twice"), (4, "alone"), (20, long), (21, long + " end"), (1, "a b"), (2, "a b")]
    rows += [(1000 + i, "copy of a page that many have") for i in range(300)]
    schema = "doc_id long, text string, _id long, id int, key string, a int"
    df = spark.createDataFrame([(*r, 1, 1, "k", 1) for r in rows], schema)
    got = near_dedup.near_duplicates(df).collect()
    assert {r["doc_id"]: r["group_id"] for r in got} == {3: 3, 5: 3, 20: 20, 21: 20, 1: 1, 2: 1} | {1000 + i: 1000 for i in range(300)}
    assert {r["doc_id"]: r["n_links"] for r in got} == {3: 1, 5: 1, 20: 1, 21: 1, 1: 1, 2: 1} | {1000 + i: 299 for i in range(300)}
    kept = near_dedup.keep_one(df)
    assert kept.columns == df.columns and sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 3, 4, 7, 8, 9, 20, 1000]
    assert near_dedup.near_duplicates(df.limit(0)).count() == 0 and near_dedup.keep_one(df.limit(0)).count() == 0
    # rows of one doc_id are documents of their own
    twice = spark.createDataFrame([(6, "other words"), (6, "other words"), (6, "quite another text"), (2, "quite another text"), (7, "alone"), (None, "alone")], "doc_id long, text string")
    assert sorted(map(tuple, near_dedup.near_duplicates(twice).collect())) == [(2, 2, 1), (6, 2, 1), (6, 6, 1), (6, 6, 1)]
    assert Counter(r["text"] for r in near_dedup.keep_one(twice).collect()) == {"other words": 1, "quite another text": 1, "alone": 2}


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 99), (7, 7)]
    got = dict(map(tuple, near_dedup.components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {i: 0 for i in range(41)} | {99: 99, 100: 99, 101: 99}


# ---- 8 decontamination


def _shared(docs, items, least):
    """All maximal equal runs of at least `least` words."""
    out = set()
    for d, t in docs:
        for q, s in items:
            a, b = _words(t), _words(s)
            for i in range(len(a)):
                for j in range(len(b)):
                    if a[i] == b[j] and not (i and j and a[i - 1] == b[j - 1]):
                        n = 0
                        while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n]:
                            n += 1
                        if n >= least:
                            out.add((d, q, i, j, n))
    return out


def _contaminated():
    rng = random.Random(8)
    vocab = [f"v{i}" for i in range(40)]
    items = [(q, " ".join(rng.choices(vocab, k=rng.randrange(5, 40)))) for q in range(12)] + [(50, None), (51, ""), (None, " ".join(vocab[:15])), (3, " ".join(vocab[:12]))]
    docs = []
    for d in range(60):
        t = rng.choices(vocab, k=rng.randrange(0, 60))
        for _ in range(rng.randrange(3)):
            w = (rng.choice(items)[1] or "").split()
            lo = rng.randrange(len(w) + 1)
            at = rng.randrange(len(t) + 1)
            t[at:at] = w[lo : lo + rng.randrange(30)]
        docs.append((d, ", ".join(t).upper()))
    docs += [(None, " ".join(vocab[:12])), (100, None), (101, ""), (5, docs[5][1]), (102, "ab " * 30), (103, " ".join(["x"] * 100_000) + " " + " ".join(vocab[:15]))]
    return docs, [*items, (60, "ab " * 12)]


@pytest.mark.parametrize("small", [10**9, 0])
def test_contamination_equals_brute_force(spark, small):
    docs, items = _contaminated()
    d = spark.createDataFrame([(*x, 1) for x in docs], "doc_id long, text string, item_id int")
    b = spark.createDataFrame([(*x, 1) for x in items], "item_id long, text string, doc_id int")
    got = {tuple(r) for r in decontaminate.contamination(d, b, small_chars=small).collect()}
    want = _shared(docs[:-1], items, decontaminate.K + decontaminate.WINDOW - 1) | {(103, q, 100_000, j, n) for _, q, i, j, n in _shared([(0, docs[-1][1].split("x ")[-1])], items, 10)}
    assert got == want and len(got) > 20
    if small:
        kept = {r["doc_id"] for r in decontaminate.decontaminate(d, b).collect()}
        assert kept == {i for i, _ in docs} - {r[0] for r in want}
        assert decontaminate.contamination(d.limit(0), b).count() == 0 and decontaminate.contamination(d, b.limit(0)).count() == 0


@pytest.mark.parametrize("small", [10**9, 0])
def test_each_row_is_judged_by_its_own_text(spark, small):
    item = "a question of the test set that was copied word for word"
    rows = [(1, f"before {item} after"), (1, "clean row of one id"), (None, item), (None, "clean row without an id"), (2, None), (3, "")]
    d = spark.createDataFrame([(*r, 0, "x") for r in rows], "doc_id long, text string, _id int, row string")
    b = spark.createDataFrame([(1, item)], "item_id long, text string")
    kept = decontaminate.decontaminate(d, b, small_chars=small)
    assert kept.columns == d.columns and Counter(r["text"] for r in kept.collect()) == Counter([rows[1][1], rows[3][1], None, ""])
    assert decontaminate.decontaminate(d, b.limit(0), small_chars=small).count() == len(rows) and decontaminate.decontaminate(d.limit(0), b, small_chars=small).count() == 0


# ---- 9 lines


@settings(max_examples=50, deadline=None)
@given(st.sets(st.integers(0, 2**64 - 1), max_size=300), st.sets(st.integers(0, 2**64 - 1), max_size=50))
def test_perfect_hash(members, others):
    h = np.array(sorted(members), np.uint64)
    counts = np.arange(1, len(h) + 1) * 700
    p = line_dedup.PerfectHash.of(*line_dedup.PerfectHash.build(h, counts, counts + 5).row())
    assert sorted(p.index(h).tolist()) == list(range(len(h)))
    assert p.find(h)[0].tolist() == np.minimum(counts, 65535).tolist() and p.find(h)[1].tolist() == (counts + 5).tolist()
    foreign = np.array(sorted(others - members), np.uint64)
    at = p.index(foreign)
    assert all(n == 0 or p.prints[i] == x & np.uint64(0xFFFF) for n, i, x in zip(p.find(foreign)[0], at, foreign))


def _brute_lines(texts, min_docs, min_chars, long_docs, long_words):
    digest = [hashlib.md5((t or "").encode()).hexdigest()[:8] for t in texts]
    on = defaultdict(list)
    for t, d in zip(texts, digest):
        for x in {x.strip(" ") for x in (t or "").split("\n") if len(x.strip(" ")) >= min_chars}:
            on[x].append(d)
    gone = {x: min(d) for x, d in on.items() if len(d) >= (long_docs if len(re.split(" +", x)) >= long_words else min_docs)}
    out = []
    for t, d in zip(texts, digest):
        lines = (t or "").split("\n")
        bad = [gone.get(x.strip(" "), d) != d for x in lines]
        out.append((t, 0) if t is None or not any(bad) else ("\n".join(x for x, b in zip(lines, bad) if not b), sum(bad)))
    return out


@pytest.mark.parametrize("small", [10**9, 0])
def test_line_dedup_equals_brute_force(spark, small):
    rng = random.Random(3)
    common_lines = [f"shared line number {i} of all" for i in range(6)]
    long_lines = [" ".join(f"l{k}w{i}" for i in range(49 + k)) for k in range(4)]
    texts = ["\n".join(rng.choices(common_lines, k=rng.randrange(4)) + [f"own line {d} {k} with more words in it" for k in range(rng.randrange(6))] + ["short"] + [x for k, x in enumerate(long_lines) if d in (k, 2 * k + 1)]) for d in range(60)]
    texts += [None, "", "\n\n", common_lines[0], common_lines[0] + "\n" + common_lines[0], "  " + common_lines[1] + "  \n" + "x" * 200_000]
    texts += [f"{common_lines[2]}\n{common_lines[3]}"] * 6  # copies: all of them stay whole, or all lose a line
    df = spark.createDataFrame([(i, t, "h") for i, t in enumerate(texts)] + [(0, texts[0], "h")], "doc_id long, text string, h string")
    got = line_dedup.dedup_lines(df, small_bytes=small, shards=3, removed="n", ask_lines=20)
    want = _brute_lines([*texts, texts[0]], line_dedup.MIN_DOCS, line_dedup.MIN_CHARS, line_dedup.LONG_DOCS, line_dedup.LONG_WORDS)
    assert got.columns == ["doc_id", "text", "h", "n"]
    rows = got.collect()
    assert Counter((r["doc_id"], r["text"], r["n"]) for r in rows) == Counter((i, *w) for i, w in zip([*range(len(texts)), 0], want))
    left = Counter(x.strip() for t in {r["text"] for r in rows if r["text"]} for x in set(t.split("\n")))
    assert all(left[x] == 1 for x in [*common_lines, *long_lines[1:]]) and left[long_lines[0]] == 2  # one text keeps a line, 49 words are few
    assert line_dedup.dedup_lines(df.limit(0), small_bytes=small).count() == 0


def test_documents_of_boilerplate_lose_it(spark):
    notice = "this notice is on every page of the site"
    df = spark.createDataFrame([(i, f"{notice}\nown {i}") for i in range(50)] + [(100 + i, notice) for i in range(3)], "doc_id long, text string")
    text = [r["text"] for r in line_dedup.dedup_lines(df).collect()]
    assert sum(notice in t for t in text) in (1, 3) and sum(t.startswith("own") for t in text) >= 49  # the notice alone is one text
    out = corpus_pipeline.lines(spark, spark.createDataFrame([(i, f"{notice}\nown {i}", "en", "s", 1) for i in range(9)], DOCS), "")
    assert sorted(r["n_chars"] for r in out.collect()) == [5] * 8 + [46]


def test_shards_follow_the_lines(spark):
    df = spark.createDataFrame([(1, "x" * 1000), (2, None)], "doc_id long, text string")
    assert line_dedup.shards_for(df, 20) == int(spark.conf.get("spark.sql.shuffle.partitions"))
    line_dedup.SHARD_LINES, was = 5, line_dedup.SHARD_LINES
    try:
        assert line_dedup.shards_for(df, 20) == 10
    finally:
        line_dedup.SHARD_LINES = was


def _passages():
    rng = random.Random(7)
    long = [" ".join(f"p{k}w{rng.randrange(10**6)}" for _ in range(50 + k)) for k in range(4)]
    under = " ".join(f"u{i}" for i in range(49))
    own = [" ".join(f"d{d}x{k}" for k in range(80)) for d in range(8)]
    texts = [f"{own[0]}\n{long[0]}", f"{own[1]}\n  {long[0]} \nend", f"{long[1]}\n{own[2]}\n{under}", f"{own[3]}\n{long[1]}\n{long[2]}", f"{own[4]}\n{long[2]}\n{long[1]}\n{under}", f"{own[5]}\n{long[3]}\n{long[3]}", own[6]]
    return long, under, own, texts


def test_long_lines_stay_once(spark):
    long, under, own, texts = _passages()
    df = spark.createDataFrame([(i, t, "k") for i, t in enumerate([*texts, None, "", texts[6]])], "doc_id long, text string, key string")
    got = line_dedup.passages_once(df)
    assert got.columns == df.columns
    text = {r["doc_id"]: r["text"] for r in got.collect()}
    lines = {i: [x.strip() for x in (t or "").split("\n")] for i, t in text.items()}
    for x in long:  # once, and in the same document as before
        assert [i for i in lines if x in lines[i]] and sum(x in v for v in lines.values()) == 1
    assert all(own[i] in lines[i] for i in range(7)) and sum(under in v for v in lines.values()) == 2
    assert text[5] == texts[5] and text[6] == text[9] == own[6] and text[7] is None and text[8] == ""
    assert line_dedup.passages_once(df.limit(0)).count() == 0


@needs_vocabulary
def test_passages_are_encoded_once(spark):
    long, _, _, texts = _passages()
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], DOCS)
    enc = bpe.Encoder(bpe.read_ranks(bpe.VOCABULARY))
    out = [enc.decode(list(r["ids"])) for r in corpus_pipeline.encoding(spark, df, "").collect()]
    assert len(out) == len(texts) and all(sum(x in t for t in out) == 1 for x in long)


# ---- 10 BPE

TEXTS = ["", "Hello, world! It's 2024; they'll go.", "  two  spaces\n\n\ttabs \r\n end ", "Ünïcödé naïve — “quotes” 你好 мир 🙂🙂", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa" * 40, " wide　space nb", "x" * 3000 + " " + "ab" * 2000, "'S 'Ve don't I'M", "١٢٣ ½ Ⅷ", "\x1c\x1d\x1e\x1f\x85 ​ "]


def _reference():
    import sys

    import tiktoken

    sys.path.insert(0, os.path.dirname(os.path.dirname(bpe.VOCABULARY)))
    spec = os.path.join(os.path.dirname(bpe.VOCABULARY), "__init__.py")
    pattern = re.search(r'PATTERN\s*=\s*(r?"""(.*?)"""|r?"(.*?)"\n|r?\'(.*?)\'\n)', open(spec).read(), re.S)
    text = next(g for g in pattern.groups()[1:] if g is not None)
    return tiktoken.Encoding("own", pat_str=text, mergeable_ranks=bpe.read_ranks(bpe.VOCABULARY), special_tokens={})


@needs_vocabulary
def test_bpe_equals_a_public_encoder():
    enc, own = _reference(), bpe.Encoder(bpe.read_ranks(bpe.VOCABULARY))
    rng = random.Random(5)
    alphabet = "abcdefghij ETAOIN'sdt1234é你🙂\n\t .,-_# 　"
    texts = TEXTS + ["".join(rng.choices(alphabet, k=rng.randrange(200))) for _ in range(300)]
    for t, ids in zip(texts, own.encode(texts)):
        assert ids == enc.encode_ordinary(t), t
        assert own.decode(ids) == t


@needs_vocabulary
@settings(max_examples=100, deadline=None)
@given(st.text(max_size=60))
def test_bpe_round_trip_of_any_text(t):
    global _own
    _own = globals().get("_own") or bpe.Encoder(bpe.read_ranks(bpe.VOCABULARY))
    assert _own.decode(_own.encode([t])[0]) == t


@needs_vocabulary
def test_bpe_edges(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(None, "null id"), (90, None), (1, TEXTS[1]), (91, "long text " * 100_000)]
    df = spark.createDataFrame([(*r, [1]) for r in rows], "doc_id long, text string, ids array<int>")
    e = bpe.encode(df)
    assert Counter(map(tuple, bpe.decode(e).collect())) == Counter(rows)
    assert all(r["n_tokens"] == (None if r["ids"] is None else len(r["ids"])) for r in e.collect())
    assert Counter((r["doc_id"], r["decoded"]) for r in bpe.round_trip(df).collect()) == Counter(rows)
    assert bpe.encode(df.limit(0)).count() == 0


# ---- pipeline


@needs_vocabulary
def test_pipeline_equals_brute_force(spark, tmp_path):
    rng = random.Random(12)
    vocab = {"en": "the of and to in that was his with they from have this which would there".split(), "de": "der die und das nicht von mit sich auf eine ist auch werden haben".split(), "fr": "le la les des une dans pour qui que est sont avec nous leur".split(), "es": "el los las una por con para que esta como pero sus fue hay".split()}
    item = "the exact question of this test that was in the set and would have leaked"
    shared = "this line of notice is on every page of the site"
    docs = []
    for i in range(120):
        lang = list(vocab)[i % 4]
        lines = [" ".join([*rng.choices(vocab[lang], k=9), f"q{rng.randrange(10**6)}x", *rng.choices(vocab[lang], k=4)]) for _ in range(8)]
        docs.append([i, "\n".join([shared, *lines] if i % 3 == 0 else lines), lang])
    docs[10][1] = docs[6][1] + " der"
    docs[17][1] = docs[2][1]
    docs[40][1] += "\n" + item
    docs += [[200, None, "en"], [201, "", None], [202, "12 34", "de"], [None, docs[50][1], "fr"]]
    rows = [(i, t, lang, "s", None if t is None else len(t)) for i, t, lang in docs]
    spark.createDataFrame(rows, DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = {r["doc_id"]: list(r["ids"]) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    # the same by plain loops
    df = spark.read.parquet(str(tmp_path / "documents.parquet"))
    model = language.fit(language.sample(df))
    ok = model.predict([t for _, t, *_ in rows])[3]
    now = [(r[0], r[1]) for r, k in zip(rows, ok) if k]
    cut = [t for t, _ in _brute_lines([t for _, t in now], line_dedup.MIN_DOCS, line_dedup.MIN_CHARS, line_dedup.MIN_DOCS, line_dedup.LONG_WORDS)]
    now = [(i, t) for (i, _), t in zip(now, cut)]
    _, root = _groups({i: t for i, t in now if i is not None}, near_dedup.THRESHOLD)
    now = [(i, t) for i, t in now if i is None or root.get(i, i) == i]
    leaked = {d for d, *_ in _shared(now, [(1, item)], 10)}
    now = [(i, t) for i, t in now if i not in leaked]
    enc = _reference()
    assert got == {i: enc.encode_ordinary(t) for i, t in now}
    decoder = bpe.Encoder(bpe.read_ranks(bpe.VOCABULARY))
    assert not {10, 17, 40, 200, 201, 202} & set(got) and len(got) > 100 and sum(shared in decoder.decode(x) for x in got.values()) == 1


def test_stages_keep_the_columns(spark, tmp_path):
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    df = spark.createDataFrame([(1, "the cat and the dog of the house", "en", "s", 32), (2, None, None, None, None)], DOCS)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, df, str(tmp_path)).columns == df.columns
        assert stage(spark, df.limit(0), str(tmp_path)).count() == 0
    assert len(corpus_pipeline.STAGES) == 5 and defaultdict(int)[0] == 0 and df.filter(F.col("doc_id") == 1).count() == 1
