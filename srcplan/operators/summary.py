"""Counts, health score and worst files of findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def severities(findings: DataFrame, *keys: str) -> DataFrame:
    """(keys..., files, findings, high, medium, low)."""
    n = lambda s: F.count_if(F.col("severity") == s).alias(s)
    return findings.groupBy(*keys).agg(F.count_distinct("file").alias("files"), F.count("*").alias("findings"), n("high"), n("medium"), n("low"))


def score(high: Column, medium: Column, low: Column) -> Column:
    """100 less 8, 3 and 1 for each finding, 0 at least."""
    return (100 - F.least(F.lit(100), 8 * high + 3 * medium + low)).cast("int")


def label(score: Column) -> Column:
    return F.when(score >= 90, "Excellent").when(score >= 75, "Good").when(score >= 50, "Needs attention").otherwise("High risk")


def codes(findings: DataFrame) -> DataFrame:
    return findings.groupBy("code").agg(F.count("*").alias("n"))


def worst_files(findings: DataFrame, limit: int = 10) -> DataFrame:
    """(file, n), most first, ties by name; a limit of 0 or less means all."""
    out = findings.groupBy("file").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "file")
    return out.limit(limit) if limit > 0 else out


def top_codes(findings: DataFrame, limit: int = 5) -> DataFrame:
    return codes(findings).orderBy(F.desc("n"), "code").limit(limit)


def all_counts(findings: DataFrame) -> DataFrame:
    """(code, file, n): counts by code, by file and in all, in one pass; null is `any`."""
    return findings.groupingSets([["code"], ["file"], []], "code", "file").agg(F.count("*").alias("n"))
