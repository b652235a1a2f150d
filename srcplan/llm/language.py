"""Hierarchical language identification with linear support vector machines.

A text becomes the frequencies of its hashed character 1- to 3-grams (lower case, everything but letters as one
blank). A first set of one-versus-one machines picks the language family, a second one the language within it; each machine
casts a vote and the sum of margins breaks ties. Machines are fitted on the driver to a bounded sample of labelled
rows: of each language the `per_language` different texts with the smallest hash, as far as they have `sample_chars` characters together, or the first of them; texts are classified whole by workers.

A document is rejected if it has fewer than `min_letters` letters, or if the margin of its language against the closest rival
(other families and languages of its own) is below `min_margin`.

Defined results: a null or empty text, or one without enough letters, gets language and family `und`, margin 0 and is rejected.
Rows with a null label are no part of the sample. With one label only, all texts with enough letters get it, with
margin 1; with none, all are `und`. Every row gives one row; repeated rows repeat; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from srcplan.llm import common as C

FAMILIES = {
    "germanic": "en de nl af sv da no nb nn is fy lb yi",
    "romance": "fr es it pt ro ca gl oc la",
    "slavic": "ru uk be pl cs sk sl hr sr bs bg mk",
    "baltic": "lt lv",
    "celtic": "ga gd cy br",
    "indic": "hi ur bn mr gu pa ne si",
    "iranian": "fa ps ku tg",
    "semitic": "ar he mt am",
    "turkic": "tr az kk ky uz tk tt",
    "uralic": "fi et hu",
    "austronesian": "id ms tl jv mg",
    "dravidian": "ta te kn ml",
    "sinitic": "zh yue",
}
FAMILY = {lang: family for family, langs in FAMILIES.items() for lang in langs.split()}
#: Size of the labelled sample for each language, in texts and in characters; the only bounds on what is fitted.
PER_LANGUAGE, SAMPLE_CHARS = 600, 4_000_000
DIMENSIONS = 1 << 13
MIN_LETTERS, MIN_MARGIN = 8, 0.1
RESULT = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("family", T.StringType()), T.StructField("language", T.StringType()), T.StructField("margin", T.DoubleType()), T.StructField("accepted", T.BooleanType())])
U32 = np.uint32


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(a row of frequencies for each text, scaled to unit length; letters of each text)."""
    low = [" " + t.lower() + " " for t in texts]
    size = np.array([len(t) for t in low])
    out = np.zeros((len(texts), DIMENSIONS), np.float32)
    letters = np.zeros(len(texts), np.int64)
    at = 0
    while at < len(low):  # a few texts at a time, so that the counts stay small
        to, total = at, 0
        while to < len(low) and to - at < 256 and (to == at or total + size[to] < 1 << 19):
            total += size[to]
            to += 1
        c = np.frombuffer("".join(low[at:to]).encode("utf-32-le", "surrogatepass"), U32)
        alpha = _letter(c)
        doc = np.repeat(np.arange(to - at, dtype=np.int64), size[at:to])
        letters[at:to] = np.bincount(doc[alpha], minlength=to - at)
        c = np.where(alpha, c, U32(32)).astype(U32)
        keep = alpha.copy()
        keep[1:] |= alpha[:-1]
        keep[0] = True  # runs of blanks count once
        c, doc = c[keep], doc[keep]
        base = doc * DIMENSIONS
        counts = np.zeros((to - at) * DIMENSIONS, np.float32)
        h = c * U32(0x9E3779B1)
        for k in range(3):
            if k:
                h = (h[:-1] ^ (h[:-1] >> U32(15))) * U32(0x85EBCA77) + c[k:] * U32(0xC2B2AE3D)
            x = h ^ (h >> U32(13))
            x *= U32(0x27D4EB2F)
            counts += np.bincount(base[: len(x)] + (x >> U32(19)).astype(np.int64), minlength=len(counts)).astype(np.float32) * (1.0, 1.0, 1.5)[k]
        m = np.sqrt(counts.reshape(to - at, DIMENSIONS))
        m /= np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-9)
        out[at:to] = m
        at = to
    return out, letters


_alpha: list[np.ndarray] = []


def _letter(c: np.ndarray) -> np.ndarray:
    if not _alpha:
        _alpha.append(np.array([chr(i).isalpha() for i in range(0x30000)]))
    return _alpha[0][np.minimum(c, 0x2FFFF)]


def fit_pair(x: np.ndarray, y: np.ndarray, c: float = 20.0, rounds: int = 300) -> np.ndarray:
    """Weights (bias last) of a linear machine with squared hinge loss, by accelerated gradient steps. y: +1 or -1."""
    share = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32)
    w = np.zeros(x.shape[1] + 1, np.float32)
    v, step = w.copy(), np.float32(1.0 / (1.0 + 2 * c * 2))
    for i in range(rounds):
        pull = share * y * np.maximum(0, 1 - y * (x @ v[:-1] + v[-1]))
        new = v - step * (v - np.float32(2 * c) * np.append(pull @ x, pull.sum()))
        v = new + np.float32(i / (i + 3)) * (new - w)
        w = new
    return w


@dataclass
class Machines:
    """One-versus-one machines among labels: a positive score is for the first of the pair."""

    labels: list[str]
    pairs: list[tuple[int, int]]
    weights: np.ndarray

    @classmethod
    def fit(cls, x: np.ndarray, y: list[str]) -> Machines:
        labels = sorted(set(y))
        at = np.array([labels.index(v) for v in y])
        pairs = list(combinations(range(len(labels)), 2))
        w = [fit_pair(x[(at == a) | (at == b)], np.where(at[(at == a) | (at == b)] == a, 1, -1).astype(np.float32)) for a, b in pairs]
        return cls(labels, pairs, np.array(w, np.float32).reshape(len(pairs), x.shape[1] + 1))

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(label of each row by votes, smallest score of it against any rival)."""
        n, m = len(x), len(self.labels)
        if m == 1:
            return np.zeros(n, np.int64), np.ones(n)
        s = x @ self.weights[:, :-1].T + self.weights[:, -1]
        votes, sums, least = np.zeros((n, m)), np.zeros((n, m)), np.full((n, m), np.inf)
        for k, (a, b) in enumerate(self.pairs):
            for label, score in ((a, s[:, k]), (b, -s[:, k])):
                votes[:, label] += score > 0
                sums[:, label] += np.clip(score, -1, 1)
                least[:, label] = np.minimum(least[:, label], score)
        best = np.argmax(votes + sums / (4 * m), axis=1)
        return best, least[np.arange(n), best]


@dataclass
class Model:
    families: Machines | None
    within: dict[str, Machines]
    min_letters: int = MIN_LETTERS
    min_margin: float = MIN_MARGIN

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[str], np.ndarray, np.ndarray]:
        x, letters = features([t or "" for t in texts])
        n = len(texts)
        family, language, margin = np.full(n, "und", object), np.full(n, "und", object), np.zeros(n)
        ok = np.flatnonzero(letters >= self.min_letters)
        if self.families is not None and len(ok):
            f, first = self.families.predict(x[ok])
            for k, name in enumerate(self.families.labels):
                rows = ok[f == k]
                if len(rows):
                    m = self.within[name]
                    lang, second = m.predict(x[rows])
                    family[rows], language[rows] = name, np.array(m.labels, object)[lang]
                    margin[rows] = np.minimum(first[f == k], second)
        return family.tolist(), language.tolist(), margin, (letters >= self.min_letters) & (margin >= self.min_margin)


def sample(docs: DataFrame, per_language: int = PER_LANGUAGE, sample_chars: int = SAMPLE_CHARS) -> pd.DataFrame:
    """At most per_language different labelled texts (text, lang) of each language: those that hash lowest, up to sample_chars characters."""
    known = docs.select("text", "lang").filter("lang is not null and text is not null").withColumn("h", F.xxhash64("text"))
    share = {r[0]: min(1.0, (per_language * 1.5 + 60) / r[1]) for r in known.groupBy("lang").count().collect()}
    taken: list[pd.DataFrame] = []
    while share:
        # a hash below this bound leaves a little more than is needed of each language, so that few texts are moved; where texts repeat, a larger share is looked through
        bound = F.create_map(*[x for lang, v in share.items() for x in (F.lit(lang), F.lit(v))])
        drawn = known.filter(F.col("lang").isin(list(share)) & ((F.col("h") / F.lit(float(2**64)) + 0.5) <= bound[F.col("lang")])).groupBy("lang", "h").agg(F.min("text").alias("text"))
        order = Window.partitionBy("lang").orderBy("h")
        drawn = drawn.withColumn("k", F.row_number().over(order)).withColumn("chars", F.sum(F.length("text")).over(order)).filter((F.col("k") <= per_language) & ((F.col("k") == 1) | (F.col("chars") <= sample_chars)))
        # the last row of a language tells whether its bounds were reached
        rows = drawn.select("lang", "k", "chars", "text").toPandas()
        for lang, v in list(share.items()):
            own = rows[rows["lang"] == lang].sort_values("k")
            if v >= 1 or len(own) >= per_language or len(own) and own["chars"].iloc[-1] > sample_chars / 2:
                taken.append(own[["text", "lang"]])
                del share[lang]
            else:
                share[lang] = min(1.0, 8 * v)
    return pd.concat(taken).sort_values("lang", kind="stable", ignore_index=True) if taken else pd.DataFrame({"text": [], "lang": []})


def fit(labelled: pd.DataFrame, min_letters: int = MIN_LETTERS, min_margin: float = MIN_MARGIN) -> Model:
    x, letters = features(labelled["text"].tolist())
    ok = letters >= min_letters
    x, lang = x[ok], labelled["lang"][ok.tolist()].tolist() if len(labelled) else []
    if not lang:
        return Model(None, {}, min_letters, min_margin)
    family = [FAMILY.get(v, v) for v in lang]
    within = {}
    for name in sorted(set(family)):
        own = [i for i, f in enumerate(family) if f == name]
        within[name] = Machines.fit(x[own], [lang[i] for i in own])
    return Model(Machines.fit(x, family), within, min_letters, min_margin)


def identify(docs: DataFrame, model: Model | None = None, per_language: int = PER_LANGUAGE) -> DataFrame:
    """doc_id, family, language, margin, accepted for every row; without a model, one is fitted to docs and their lang."""
    return _applied(docs.select(F.col("doc_id").cast("long"), "text"), model or fit(sample(docs, per_language)), RESULT)


def keep_identified(docs: DataFrame, model: Model | None = None, per_language: int = PER_LANGUAGE) -> DataFrame:
    """The rows of docs that are accepted, with all their columns."""
    model = model or fit(sample(docs, per_language))
    schema = T.StructType([T.StructField("row", docs.schema), T.StructField("accepted", T.BooleanType())])
    out = _applied(docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row")), model, schema)
    return out.filter("accepted").select("row.*")


def _applied(df: DataFrame, model: Model, schema: T.StructType) -> DataFrame:
    sent = df.sparkSession.sparkContext.broadcast(model)  # a fixed number of weights for each pair of labels
    key = schema.names[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            batch = batch if "text" in batch.schema.names else C.with_text(batch)
            n = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False))
            at = 0
            while at < batch.num_rows:
                to = min(at + 256, max(at + 1, int(np.searchsorted(n, (n[at - 1] if at else 0) + (1 << 20), "right"))))
                b = batch.slice(at, to - at)
                at = to
                family, language, margin, ok = model.predict(b.column("text").to_pylist())
                made = {"family": pa.array(family, pa.string()), "language": pa.array(language, pa.string()), "margin": pa.array(margin), "accepted": pa.array(ok)}
                yield pa.RecordBatch.from_arrays([b.column(key), *[made[c] for c in schema.names[1:]]], names=schema.names)

    return df.transform(C.mapped, run, schema)
