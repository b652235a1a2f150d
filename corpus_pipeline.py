"""From raw documents to token ids: each stage takes what the one before it kept, as a table, and its decisions take effect.

Defined results: a null or empty text has no language and goes with the first stage. Rows with a null doc_id are judged like others, but near-dedup leaves them; rows that repeat a doc_id are
documents of their own. A text of which line dedup leaves nothing stays as an empty text, with no tokens. Further columns are carried until the last stage. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from srcplan.llm import bpe, decontaminate, language, line_dedup, near_dedup
from srcplan.llm.common import saved, table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents whose language can be told."""
    return language.keep_identified(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts lines that many documents have from all but one text; all documents stay, n_chars follows the text. Long lines of few documents are left to near-dedup, which needs copies whole, and to the last stage."""
    out = line_dedup.dedup_lines(docs, long_docs=line_dedup.MIN_DOCS)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates."""
    return near_dedup.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes the documents that share a run of words with the benchmark."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_tokens; a line of 50 words or more that several of the documents left have is encoded with one of them only."""
    return bpe.encode(line_dedup.passages_once(docs))


STAGES = [("language ID", language_id), ("line dedup", lines), ("MinHash near-dedup", near_duplicates), ("benchmark decontamination", decontamination), ("BPE encoding", encoding)]

#: Support vector machines, sketches and BPE are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
