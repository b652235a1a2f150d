"""The operators over their whole tables, with production parameters, and the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from srcplan.llm import bpe, chat, decontaminate, html, language, line_dedup, near_dedup, perplexity, secrets, warc
from srcplan.llm.common import table


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return perplexity.quality(table(spark, sf_dir, "documents"))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op6_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.expand(table(spark, sf_dir, "conversations"))


def op7_warc_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.page_chunks(table(spark, sf_dir, "pages"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), removed="lines_removed")


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ops = (op1_html_extraction, op2_language_id, op3_quality_rules, op4_secret_scan, op5_near_dedup, op6_chat_formatting, op7_warc_chunks, op8_decontamination, op9_line_dedup, op10_bpe)
    return {f.__name__: f for f in ops}


def oracle_sql() -> dict[str, str]:
    return {"op1_html_extraction": html.ORACLE, "op4_secret_scan": secrets.ORACLE, "op6_chat_formatting": chat.ORACLE, "op7_warc_chunks": warc.ORACLE, "op8_decontamination": decontaminate.ORACLE, "op9_line_dedup": line_dedup.ORACLE}
