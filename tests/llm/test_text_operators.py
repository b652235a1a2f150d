"""HTML extraction, language ID, perplexity, secrets, chat and WARC against brute force, held-out accuracy and round trips."""

from __future__ import annotations

import gzip
import math
import os
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from srcplan.llm import chat, html, language, perplexity, secrets, warc

TABLES = "/root/testdata/sf0.01"
LONG = "word " * 200_000


def _rows(df, *cols):
    return [tuple(r) for r in (df.select(*cols) if cols else df).collect()]


# ---- 1 HTML


def _brute_html(pages, min_words, min_pages):
    cut = [(p, (re.search(r"^[a-zA-Z][\w+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", u or "") or [None, ""])[1].lower(), html.visible(h).split()) for p, u, h in pages]
    on = defaultdict(set)
    for p, host, w in cut:
        for i in range(len(w) - min_words + 1):
            on[host, tuple(w[i : i + min_words])].add(p)
    out = []
    for p, host, w in cut:
        gone = [False] * len(w)
        for i in range(len(w) - min_words + 1):
            if len(on[host, tuple(w[i : i + min_words])]) >= min_pages:
                gone[i : i + min_words] = [True] * min_words
        runs, now = [], []
        for x, g in zip(w + [""], gone + [True]):
            if g:
                if now:
                    runs.append(" ".join(now))
                now = []
            else:
                now.append(x)
        out.append((p, host, len(w), sum(gone), "\n".join(runs)))
    return sorted(out, key=str)


def _pages():
    rng = random.Random(2)
    words = ["alpha", "beta", "gamma", "delta"]
    nav = " ".join(f"nav{i}" for i in range(9))
    pages = [(i, f"https://h{i % 3}.org/p{i}", f"<html><head><title>x</title></head><body><nav>{nav}</nav><p>{' '.join(rng.choices(words, k=rng.randrange(40)))}</p><script>var x='{nav}'</script></body>") for i in range(24)]
    pages += [(100, None, "<p>lone page</p>"), (101, "no url", None), (102, "https://h0.org/e", ""), (103, "HTTPS://u@H0.org:8/", "<!-- open"), (None, "https://h0.org/n", f"<b>{nav}</b>"), (1, "https://h1.org/p1", pages[1][2]), (104, "https://h2.org/long", LONG)]
    return pages


@pytest.mark.parametrize("part_words", [10**9, 50, 1])
def test_html_equals_brute_force(spark, part_words):
    pages = _pages()
    df = spark.createDataFrame([(*p, "x") for p in pages], "page_id long, url string, html string, host string")
    for words, least in ((3, 2), (5, 3)):
        got = html.extract(df, words, least, part_words, 60)
        assert sorted(_rows(got, "page_id", "host", "n_words", "n_removed", "text"), key=str) == _brute_html(pages, words, least)
    assert html.extract(df.limit(0)).count() == 0


def test_visible_text():
    for page, text in (
        ("<p>a<b>b</b> &amp; c</p><style>x</style><div>d<br>e</div><script>f", "ab & c d e"),
        ("<html><head><title>t</title><p>hello world body text</p>", "hello world body text"),
        ("<html><head><meta charset=x><title>t > u</title></head><body class=a>x</body>", "x"),
        ('<p title="a>b" data-x=\'c>"d\'>x</p>', "x"),
        ("<p don't>it's</p> 1 < 2 <3 a<b", "it's 1 < 2 <3 a"),
        ("a<!-->b<!-- c > d --!>e<!-- open", "a b e"),
        ("<script>if (a </b) '</scripty>'</SCRIPT x='>'>y<svg/>z<svg><title>n</title></svg>w", "y z w"),
        ("x<p title=\"open>y", "x"),
        ("<abc>x</abc><article>y", "x y"),
        ("<!doctype html><?xml x?>a</>b</ p>c", "a b c"),
    ):
        assert html.visible(page) == text, page
    assert html.visible(None) == html.visible("") == ""


@pytest.mark.parametrize("piece", ["<a ", "<script ", "<p x=", "<p x='", '<p x="', "<!-", "<!--", "</script", "<script></script", "<", "</a", "<svg><", "&", "<a x= ", "=", "<b =\t"])
def test_pages_are_read_in_time_in_proportion(piece):
    import time

    began = time.perf_counter()
    html.visible(piece * (10_000_000 // len(piece)))
    assert time.perf_counter() - began < 15


# ---- 2 language


def test_language_held_out(spark):
    if not os.path.isdir(TABLES):
        pytest.skip("no tables here")
    d = spark.read.parquet(f"{TABLES}/documents.parquet")
    train, held = d.filter("pmod(xxhash64(doc_id, 1), 2) = 0"), d.filter("pmod(xxhash64(doc_id, 1), 2) = 1")
    got = held.select("doc_id", "lang").join(language.identify(held, language.fit(language.sample(train))), "doc_id").filter("accepted")
    n, right = got.count(), got.filter("lang = language").count()
    assert n > 0.9 * held.count() and right > 0.98 * n


def test_language_edges(spark):
    texts = [("the cat sat on the mat and looked at the dog near the house", "en"), ("die Katze sass auf der Matte und sah den Hund neben dem Haus", "de"), ("le chat est sur le tapis et regarde le chien dans la maison", "fr"), ("el gato esta en la alfombra y mira al perro de la casa", "es")]
    rows = [(i, t, lang) for i, (t, lang) in enumerate(texts * 5)] + [(100, None, "en"), (101, "", None), (102, "12 34 !!", "en"), (None, texts[0][0], None), (103, LONG, None), (1, texts[1][0], "de")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, lang string, accepted string")
    got = language.identify(df)
    assert got.count() == len(rows)
    by = {r["doc_id"]: r for r in got.collect()}
    assert [(by[i]["family"], by[i]["language"], by[i]["accepted"]) for i in range(4)] == [("germanic", "en", True), ("germanic", "de", True), ("romance", "fr", True), ("romance", "es", True)]
    assert all(tuple(by[i])[1:] == ("und", "und", 0.0, False) for i in (100, 101, 102)) and by[None]["language"] == "en"
    kept = language.keep_identified(df)
    assert kept.columns == df.columns and kept.filter("doc_id between 100 and 102").count() == 0 and kept.filter("doc_id = 1").count() == 2
    one = language.identify(df.filter("lang = 'en' or lang is null"))
    assert {r["language"] for r in one.collect()} == {"en", "und"}
    assert language.identify(df.withColumn("lang", F.lit(None).cast("string"))).filter("accepted").count() == 0
    assert language.identify(df.limit(0)).count() == 0 and language.keep_identified(df.limit(0)).count() == 0


def test_sample_of_repeated_rows(spark):
    same = spark.range(20_000).select(F.col("id") * 0 + 3, F.lit("one text that all the rows of this table have").alias("text"), F.lit("en").alias("lang"))
    got = language.sample(same)
    assert len(got) == 1 and language.fit(got).predict(["any other english text"])[1] == ["en"]
    many = same.union(spark.range(3000).select("id", F.concat(F.lit("text number "), "id"), F.lit("en"))).union(spark.range(50).select("id", F.concat(F.lit("texte numero "), "id"), F.lit("fr")))
    got = language.sample(many, 100).groupby("lang")["text"].agg(["count", "nunique"])
    assert got.loc["en"].tolist() == [100, 100] and got.loc["fr"].tolist() == [50, 50]
    assert len(language.sample(many, 100, 200)) < 40 and len(language.sample(many, 100, 1)) == 2
    assert language.sample(many.limit(0)).empty and language.sample(many.withColumn("lang", F.lit(None).cast("string"))).empty


def test_decision_equals_plain_votes():
    rng = np.random.default_rng(1)
    words = {lang: ["".join(rng.choice(list(letters), 4)) for _ in range(30)] for lang, letters in {"en": "abcde", "de": "bcdef", "fr": "mnopq", "es": "nopqr", "pt": "opqrs"}.items()}
    text = lambda lang: " ".join(rng.choice(words[lang], 12))
    model = language.fit(pd.DataFrame([(text(lang), lang) for lang in words for _ in range(20)], columns=["text", "lang"]))
    texts = [text(lang) for lang in words for _ in range(8)] + ["", "ab", None, text("en") + " " + text("fr")]
    x, letters = language.features([t or "" for t in texts])

    def vote(m, row):
        if len(m.labels) == 1:
            return m.labels[0], 1.0
        s = {p: float(row @ w[:-1] + w[-1]) for p, w in zip(m.pairs, m.weights)}
        s |= {(b, a): -v for (a, b), v in s.items()}
        rank = {a: sum(v > 0 for (p, _), v in s.items() if p == a) + sum(min(1, max(-1, v)) for (p, _), v in s.items() if p == a) / (4 * len(m.labels)) for a in range(len(m.labels))}
        best = max(rank, key=rank.get)
        return m.labels[best], min(v for (p, _), v in s.items() if p == best)

    for got, row, n in zip(zip(*model.predict(texts)), x, letters):
        if n < language.MIN_LETTERS:
            assert got == ("und", "und", 0.0, False)
            continue
        family, first = vote(model.families, row)
        lang, second = vote(model.within[family], row)
        assert got[:2] == (family, lang) and abs(got[2] - min(first, second)) < 1e-4 and got[3] == (min(first, second) >= language.MIN_MARGIN)


def test_votes_of_pairs():
    rng = np.random.default_rng(0)
    centre = rng.normal(size=(4, 20)).astype(np.float32)
    y = [f"l{i % 4}" for i in range(200)]
    x = np.array([centre[i % 4] for i in range(200)], np.float32) + rng.normal(scale=0.1, size=(200, 20)).astype(np.float32)
    m = language.Machines.fit(x, y)
    assert len(m.pairs) == 6 and [m.labels[k] for k in m.predict(x)[0]] == y


# ---- 3 perplexity


def _kneser_ney(texts, vocabulary):
    """A plain modified Kneser-Ney model of word bigrams; returns the probability of a word after a word (None for the start)."""
    count = Counter(w for t in texts for w in t.split())
    known = {w for w, _ in count.most_common(vocabulary)}
    types = len(count) - len(known)
    sym = lambda w: w if w is None or w in known else "?"
    two = Counter((sym(a), sym(b)) for t in texts for a, b in zip([None, *t.split()], t.split()))
    one = Counter(b for _, b in two)
    disc = {n: perplexity.discounts(np.array(list(c.values()))) for n, c in ((1, one), (2, two))}

    def mixed(n, k, ks, below):
        off = sum(disc[n][min(x, 3)] for x in ks)
        return (k - (disc[n][min(k, 3)] if k else 0)) / sum(ks) + off / sum(ks) * below

    def p(a, b):
        a, b = sym(a), sym(b)
        low = mixed(1, one.get(b, 0), one.values(), 1 / (len(one) + 1))
        ks = [k for (x, _), k in two.items() if x == a]
        return (mixed(2, two.get((a, b), 0), ks, low) if ks else low) / (max(1, types) if b == "?" else 1)

    return p, [*known, "?"]


def _texts(rng, n):
    words = [f"w{i}" for i in range(30)]
    return [" ".join(rng.choices(words, [1 / (i + 1) for i in range(30)], k=rng.randrange(1, 30))) for _ in range(n)]


def test_model_equals_plain_kneser_ney():
    import pyarrow as pa

    texts = _texts(random.Random(1), 60)
    counts = Counter(w for t in texts for w in t.split())
    size = next(k for k in range(8, 20) if counts.most_common(k)[-1][1] > counts.most_common(k + 1)[-1][1])  # no tie at the edge
    h, first = perplexity.tokens(pa.array(texts))
    u, n = np.unique(h, return_counts=True)
    v = perplexity.Vocabulary(u[np.argsort(-n, kind="stable")[:size]], len(u) - size)
    g, n = np.unique(perplexity.bigrams(v.symbols(h), first), return_counts=True)
    *arrays, base = perplexity.fit(g, n)
    m = perplexity.Model(*(a.tobytes() for a in arrays), base, v.types)
    p, _ = _kneser_ney(texts, size)
    for t in (*texts[:9], "w0 w1 w0", "unknown words w0 and w29 w1", "w5 w5 w5"):
        x, at = perplexity.tokens(pa.array([t]))
        assert m.score(perplexity.bigrams(v.symbols(x), at)) == pytest.approx([math.log(p(a, b)) for a, b in zip([None, *t.split()], t.split())], abs=1e-4)


def test_words_of_scripts():
    import pyarrow as pa

    texts = ["a bb\tccc\n\nd", "", None, "  x  ", "你好 ok你", "한국어 단어", "Ab ab Ab", "\u00a0né🙂 né🙂"]
    h, first = perplexity.tokens(pa.array(texts, pa.large_string()))
    assert np.diff(first).tolist() == [4, 0, 0, 1, 4, 2, 3, 2]
    assert h[first[4]] == h[first[4] + 3] and h[first[6]] == h[first[6] + 2] != h[first[6] + 1] and h[first[7]] != h[first[7] + 1]


def test_keys_are_one_to_one():
    every = np.concatenate([perplexity.key(2, np.arange(1 << 20, dtype=np.uint32)), perplexity.key(1, np.arange(4096, dtype=np.uint32))])
    assert len(np.unique(every)) == len(every)


def _brute_quality(rows, below, above, floor, least):
    """judge() by plain loops over (id, lang, n, bits, squares)."""
    out = {}
    for lang in {r[1] for r in rows}:
        own = [r for r in rows if r[1] == lang]
        scored = [r for r in own if r[3] is not None and r[2]]
        band = None
        if len(scored) >= least:
            x = sorted(r[3] / r[2] for r in scored)
            mid = x[(len(x) + 1) // 2 - 1]
            off = sorted(abs(v - mid) for v in x)
            total = sum(r[2] for r in scored)
            v = max(0.0, sum(r[4] for r in scored) / total - (sum(r[3] for r in scored) / total) ** 2)
            band = mid, max(floor, 1.4826 * off[(len(off) + 1) // 2 - 1]), v
        for i, _, n, bits, _ in own:
            if not n:
                out[i] = False
            elif bits is None or band is None:
                out[i] = True
            else:
                off = (bits / n - band[0]) / math.sqrt(band[1] ** 2 + band[2] / n)
                out[i] = -below <= off <= above
    return out


def test_bands_equal_brute_force(spark):
    rng = random.Random(3)
    rows = []
    for i in range(400):
        lang, n = rng.choice(["en", "fr", None, "xx" if i < 60 else "en"]), rng.choice([0, 1, 3, 30, 400])
        x = [rng.gauss(7 + 2 * (i % 17 == 0) - 3 * (i % 29 == 0), 3) for _ in range(n)]
        rows.append((i, lang, n, None if not n or i % 41 == 0 else float(sum(x)), None if not n or i % 41 == 0 else float(sum(v * v for v in x))))
    df = spark.createDataFrame(rows, perplexity.SCORE)
    got = {r["doc_id"]: r["accepted"] for r in perplexity.judge(df, 2.5, 2.0, 0.02, 20).collect()}
    want = _brute_quality(rows, 2.5, 2.0, 0.02, 20)
    assert got == want and 10 < sum(not v for i, v in want.items() if rows[i][2]) < 200


def test_perplexity_edges(spark):
    rng = random.Random(4)
    words = {"en": "the of and to in that was his with they from have this".split(), "fr": "le la les des une dans pour qui que est sont avec".split()}
    line = lambda lang: " ".join(w for _ in range(12) for k in [rng.randrange(10)] for w in words[lang][k : k + 3])
    rows = [(i, line(lang) + f" own{i}", lang) for i, lang in enumerate(["en", "fr"] * 60)]
    rows += [(900, " ".join("".join(rng.choices("qxzjkvw#@", k=6)) for _ in range(60)), "en"), (904, "the " * 60, "en"), (905, " ".join(f"{w}%%%" for w in line("fr").split()), "fr"), (906, line("fr").upper(), "fr")]
    rows += [(901, None, "en"), (902, "", "fr"), (907, " \n ", "fr"), (903, "alone", "xx"), (908, "some text", None), (None, rows[0][1], "en"), (1, rows[1][1], "fr")]
    df = spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id long, text string, lang string, perplexity double")
    got = perplexity.quality(df, vocabulary=20)
    assert got.count() == len(rows)
    by = {r["doc_id"]: r for r in got.collect()}
    assert all(not by[i]["accepted"] and by[i]["perplexity"] > by[i]["upper"] for i in (900, 905, 906)) and not by[904]["accepted"]
    assert not any(by[i]["accepted"] or by[i]["perplexity"] for i in (901, 902, 907))
    assert all(by[i]["accepted"] and by[i]["lower"] is None for i in (903, 908)) and sum(r["accepted"] for k, r in by.items() if (k or 0) < 900) >= len(by) - 12
    for other in (perplexity.quality(df, vocabulary=20, small_bytes=1), perplexity.quality(df, vocabulary=20, shard_chars=50)):  # language by language, in many shards
        apart = {r["doc_id"]: r for r in other.collect()}
        assert all(apart[k]["perplexity"] == pytest.approx(by[k]["perplexity"]) if by[k]["perplexity"] else apart[k]["perplexity"] is None for k in by)
    assert perplexity.quality(df.limit(0)).count() == 0


def test_every_word_is_a_symbol(spark):
    import pyarrow as pa

    rng = random.Random(8)
    common, rare = [f"c{i}" for i in range(20)], [f"r{i}" for i in range(4000)]
    rows = [(i, " ".join(rng.choice(rare if rng.random() < 0.8 else common) for _ in range(60)), "en") for i in range(160)] + [(200, "c1 c2 never seen c1", "en"), (201, "", "en"), (202, None, "en"), (203, "alone here", "xx"), (None, "r1 c1 r2", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    fold = dict(zip([r[0] for r in rows], perplexity.halves(*perplexity.tokens(pa.array([r[1] for r in rows], pa.string()))).tolist()))
    halves = [[t for i, t, lang in rows if lang == "en" and t and fold[i] == f] for f in (0, 1)]
    assert min(len({w for t in half for w in t.split()}) for half in halves) > 2048
    models = [_kneser_ney(half, None)[0] for half in halves]
    for got in (perplexity.quality(df), perplexity.quality(df, pair_chars=3000)):  # in one shard and in many
        by = {r["doc_id"]: r for r in got.collect()}
        assert by.keys() == {r[0] for r in rows} and [by[i]["accepted"] for i in (201, 202, 203, None)] == [False, False, True, True]
        assert all(by[i]["perplexity"] is None for i in (201, 202, 203, None)) and by[None]["lang"] is None
        for i, t, _ in [*rows[:30], rows[160]]:
            p = models[1 - fold[i]]
            bits = [-math.log(p(a, b)) for a, b in zip([None, *t.split()], t.split())]
            assert math.log(by[i]["perplexity"]) == pytest.approx(sum(bits) / len(bits), abs=1e-6)
    assert perplexity.quality(df.limit(0)).count() == 0


def test_blocks_do_not_matter(spark, monkeypatch):
    rng = random.Random(9)
    rows = [(i, t, rng.choice(["en", "fr", None])) for i, t in enumerate([*_texts(rng, 150), "", None, "你好 w1 你好"])]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    want = {r["doc_id"]: r for r in perplexity.quality(df).collect()}
    monkeypatch.setattr(perplexity, "BLOCK_WORDS", 1)
    monkeypatch.setattr(perplexity, "CODES", 3)
    got = {r["doc_id"]: r for r in perplexity.quality(df, pair_chars=500).collect()}
    assert got.keys() == want.keys() and all(got[i]["accepted"] == r["accepted"] for i, r in want.items())
    assert all(got[i][c] == pytest.approx(r[c]) for i, r in want.items() for c in ("perplexity", "lower", "upper") if r[c] is not None)


def test_edited_copies_stay_together():
    import pyarrow as pa

    rng = random.Random(10)
    texts = [[f"w{rng.randrange(500)}" for _ in range(200)] for _ in range(400)]
    edited = [[*t[:k], "edit", *t[k + 1 :]] for t in texts for k in (rng.randrange(200),)]
    a, b = (perplexity.halves(*perplexity.tokens(pa.array([" ".join(t) for t in x]))) for x in (texts, edited))
    assert (a == b).mean() > 0.95 and 0.4 < a.mean() < 0.6
    assert perplexity.halves(*perplexity.tokens(pa.array(["", None, "a", "", "a", " "]))).tolist()[:2] == [0, 0]


def test_counts_cover_all_documents(spark):
    texts = ["abc abc", "abc", None, "", "x y\nz " * 500]
    df = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    packed = perplexity._counted(df, 3, lambda _, t: perplexity.tokens(t)[0]).collect()
    assert sum(np.frombuffer(r["n"], np.int64).sum() for r in packed) == 1503 and {r["shard"] for r in packed} <= {0, 1, 2}


# ---- 4 secrets


def _holds(query, text: bytes) -> bool:
    if query == secrets.ALL:
        return True
    if query[0] == "tri":
        return query[1] in text
    return (all if query[0] == "and" else any)(_holds(q, text) for q in query[1:])


PIECES = ["glpat-" + "a1" * 10, "npm_" + "Z" * 36, "pypi-AgEIcHlwaS5vcmc" + "x" * 50, "SG." + "a" * 22 + "." + "b" * 43, "hf_" + "Q" * 34, "shpca_" + "0f" * 16, "https://hooks.slack.com/services/T" + "A" * 8 + "/B" + "B" * 8 + "/" + "c" * 24, "AccountKey=" + "k" * 86 + "==", "authorization: BEARER " + "t" * 20, "AKIA" + "A1" * 8, "ghp_" + "a" * 36, "xoxb-" + "1" * 12, "sk_live_" + "z" * 16, "-----BEGIN RSA PRIVATE KEY-----", "-----BEGIN PRIVATE KEY-----", "eyJ" + "a" * 10 + ".eyJ" + "b" * 10 + "." + "c" * 10, "ftp://me:pw@host.org", "API_KEY = 'abcdefgh'", "toKen:abcdefghi", "0123456789abcdef" * 2 + "01234567"]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from([*PIECES, "word", " ", "\n", "é", "Key", ":", "-----BEGIN "]), max_size=8))
def test_queries_hold_for_every_match(parts):
    text = " ".join(parts)
    for _, expression in secrets.RULES:
        if re.search(expression, text, re.A):
            assert _holds(secrets.trigram_query(expression), text.lower().encode())


def test_trigram_queries():
    q = secrets.trigram_query
    assert q("abcd") == ("and", ("tri", b"abc"), ("tri", b"bcd")) and q("a.c") == q("a*") == q("[a-z]+") == secrets.ALL
    assert q("(?:abc|xyz)") == ("or", ("tri", b"abc"), ("tri", b"xyz")) and q("x(?=abc)") == secrets.ALL
    assert _holds(q("(?:abc|xyz)q?"), b"xyz") and not _holds(q("(?:abc|xyz)q?"), b"xy ab")
    assert sum(q(e) == secrets.ALL for _, e in secrets.RULES) >= 1  # such rules scan fully
    assert q("(?i)token") == secrets.ALL or _holds(q("(?i)token"), "toKen token".lower().encode())


def test_scan_equals_full_scan(spark):
    rng = random.Random(9)
    texts = [" ".join(rng.choices([*PIECES, "plain", "text", "é\n"], k=rng.randrange(12))) for _ in range(60)] + [None, "", LONG + PIECES[0], "key" + "AKIA"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, PIECES[0]), (3, texts[3])]
    df = spark.createDataFrame([(*r, "r") for r in rows], "doc_id long, text string, rule string")
    want = Counter((i, name, k, len(m.group()), m.group()[:4]) for i, t in rows for name, e in secrets.RULES for k, m in enumerate(re.finditer(e, t or "", re.A)))
    assert Counter(_rows(secrets.scan(df), "doc_id", "rule", "match_no", "n_chars", "preview")) == want and len(want) > 50
    assert secrets.scan(df.limit(0)).count() == 0


# ---- 6 chat


def test_chat(spark):
    rows = [("a", 1, "system", "s"), ("a", 2, "user", "u<|end|>"), ("a", 3, " Assistant ", "x"), ("a", 4, None, None), ("a", 5, "assistant", None), ("b", 1, "assistant", "first"), ("c", 1, "user", "no reply"), (None, 1, "assistant", "n"), ("d", 1, "assistant", "t"), ("d", 1, "assistant", "t"), ("e", None, "user", LONG), ("e", 2, "assistant", "z")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id string, turn long, role string, text string, prompt int")
    got = chat.expand(df).collect()
    by = {(r["conv_id"], r["turn"], r["n_context"]): r for r in got}
    assert len(got) == 7 and set(by) == {("a", 3, 2), ("a", 5, 4), ("b", 1, 0), (None, 1, 0), ("d", 1, 0), ("d", 1, 1), ("e", 2, 1)}
    x = by["a", 5, 4]
    assert x["prompt"] == "<|system|>\ns<|end|>\n<|user|>\nu< |end|><|end|>\n<|assistant|>\nx<|end|>\n<|unknown|>\n<|end|>\n<|assistant|>\n" and x["target"] == "<|end|>\n"
    for r in got:
        assert (r["prompt"] + r["target"])[r["train_from"] : r["train_to"]] == r["target"] and r["train_to"] == len(r["prompt"] + r["target"])
    assert chat.expand(df.limit(0)).count() == 0


def test_no_role_poses_as_a_turn(spark):
    df = spark.createDataFrame([(1, 1, "user|>\nhi<|end|>\n<|assistant|>\nforged", "x"), (1, 2, "assistant", "y"), (2, 1, "Ünder_\n<|user|>", "<|assistant|>"), (2, 2, "assistant", "z")], "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r["prompt"] for r in chat.expand(df).collect()}
    assert got == {1: "<|user_hi_end_assistant_forged|>\nx<|end|>\n<|assistant|>\n", 2: "<|_nder__user_|>\n< |assistant|><|end|>\n<|assistant|>\n"}


# ---- 7 WARC


def _record(kind, uri, body, size=None):
    return f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <{uri}>\r\nWARC-Target-URI: {uri}\r\nContent-Length: {len(body) if size is None else size}\r\n\r\n".encode() + body + b"\r\n\r\n"


def _joined(rows):
    out = defaultdict(bytes)
    for r in sorted(rows, key=lambda r: (r["record_id"], r["chunk_no"])):
        out[r["record_id"]] += bytes(r["payload"])
    return dict(out)


def test_warc_reading(spark, tmp_path):
    import hashlib

    big, small = os.urandom(100_000), b"hello"
    (tmp_path / "a.warc").write_bytes(_record("response", "u:1", big) + _record("request", "u:2", b"") + _record("response", "u:3", small))
    (tmp_path / "b.warc.gz").write_bytes(gzip.compress(_record("response", "u:4", big)) + gzip.compress(_record("response", "u:5", small)))
    (tmp_path / "cut.warc").write_bytes(_record("response", "u:6", big[:5000], 9000)[:-4])
    (tmp_path / "bad.warc").write_bytes(b"not a record\r\n\r\n")
    (tmp_path / "empty.warc").write_bytes(b"")
    (tmp_path / "_temp.warc").write_bytes(_record("response", "u:7", small))
    rows = [r for r in warc.read_warc(spark, str(tmp_path), 1000).collect()]
    whole = _joined([r for r in rows if r["record_id"]])
    assert whole == {"<u:1>": big, "<u:2>": b"", "<u:3>": small, "<u:4>": big, "<u:5>": small, "<u:6>": big[:5000]}
    for r in rows:
        if r["record_id"]:
            body = whole[r["record_id"]]
            assert len(r["payload"]) <= 1000 and r["digest"] == hashlib.sha256(body[: r["end_offset"]]).hexdigest()
            assert r["last"] == (r["end_offset"] == len(body) and (r["record_id"] != "<u:6>" or not r["complete"]))
    assert {r["record_id"] for r in rows if not r["complete"]} == {"<u:6>", None}
    assert warc.read_warc(spark, str(tmp_path / "none")).count() == 0


def test_warc_round_trip(spark):
    pages = [(1, "http://a", "x" * 50_000), (2, "http://b", ""), (3, None, None), (None, "http://c\n d", "é"), (2, "http://b", "again"), (4, "http://l", LONG)]
    df = spark.createDataFrame([(*p, 1) for p in pages], "page_id long, url string, html string, chunk_no int")
    got = warc.page_chunks(df, 1024)
    n = got.groupBy("record_id", "target_uri").agg(F.sum(F.length("payload")).alias("n"), F.count_if("last").alias("r")).collect()
    assert {(r["record_id"], r["target_uri"]): (r["n"], r["r"]) for r in n} == {("<urn:page:1>", "http://a"): (50_000, 1), ("<urn:page:2>", "http://b"): (5, 2), ("<urn:page:3>", ""): (0, 1), ("<urn:page:>", "http://c d"): (2, 1), ("<urn:page:4>", "http://l"): (len(LONG), 1)}
    assert warc.page_chunks(df.limit(0)).count() == 0


def test_warc_long_urls(spark):
    long = "http://a/" + "x" * 4_000_000
    pages = [(1, "http://b", "first"), (2, long, "y" * 40_000), (3, "http://c", "after"), (4, long + "z", ""), (5, None, "last")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1)
    rows = warc.page_chunks(df).collect()
    assert all(r["complete"] for r in rows)
    assert {r["record_id"]: r["target_uri"] for r in rows} == {f"<urn:page:{i}>": u or "" for i, u, _ in pages}
    assert _joined(rows) == {f"<urn:page:{i}>": h.encode() for i, _, h in pages}


def test_warc_goes_on_after_unreadable_headers(spark, tmp_path):
    one, two, three = (_record("response", f"u:{k}", b"body") for k in (1, 2, 3))
    data = b"junk" * 500_000 + b"\r\n" + one + _record("response", "u:9", b"lost").replace(b"Content-Length: 4", b"Content-Length: x") + two + b"no record\n\n\nWARC" + b"\r\n" + three
    (tmp_path / "a.warc").write_bytes(data)
    (tmp_path / "b.warc.gz").write_bytes(gzip.compress(data + b"WARC/1.0"))
    rows = warc.read_warc(spark, str(tmp_path)).collect()
    assert Counter((r["record_id"], bytes(r["payload"])) for r in rows if r["complete"]) == {(f"<u:{k}>", b"body"): 2 for k in (1, 2, 3)}
    assert Counter(r["record_id"] for r in rows if not r["complete"]) == {None: 5, "<u:9>": 2}


def test_warc_goes_on_after_damage(spark, tmp_path):
    body = [os.urandom(3000) for _ in range(4)]
    members = [gzip.compress(_record("response", f"u:{k}", b)) for k, b in enumerate(body)]

    def flipped(data, at):
        return data[:at] + bytes([data[at] ^ 255]) + data[at + 1 :]

    files = {
        "first": [flipped(members[0], 0), *members[1:]],
        "mark": [members[0], flipped(members[1], 0), *members[2:]],
        "middle": [members[0], flipped(members[1], 1500), *members[2:]],
        "crc": [members[0], flipped(members[1], len(members[1]) - 6), *members[2:]],
        "cut": [*members[:3], members[3][:1000]],
        "length": [gzip.compress(_record("response", "u:x", b"body").replace(b"Content-Length: 4", b"Content-Length: -4")), *members],
        "long": [gzip.compress(b"WARC/1.0\r\n" + b"x" * (2 << 20) + b"\r\nContent-Length: 1\r\n\r\n1"), *members],
    }
    for name, parts in files.items():
        (tmp_path / name).mkdir()
        (tmp_path / name / "a.warc.gz").write_bytes(b"".join(parts))
        rows = warc.read_warc(spark, str(tmp_path / name)).collect()
        bad = {r["record_id"] for r in rows if not r["complete"]}
        whole = _joined([r for r in rows if r["record_id"] and r["record_id"] not in bad])
        lost = {"first": {0}, "mark": {1}, "middle": {1}, "crc": {1}, "cut": {3}}.get(name, set())
        assert {f"<u:{k}>": b for k, b in enumerate(body) if k not in lost}.items() <= whole.items(), name
        assert not any(f"<u:{k}>" in whole for k in lost) and (bad or name == "long"), name
