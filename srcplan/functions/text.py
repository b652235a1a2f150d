"""Text functions: token estimates, slugs, redaction."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: (expression, replacement), applied in this order. $1 is the first group.
REDACTIONS = [
    (r"sk-[A-Za-z\d]{20,}", "sk-<redacted>"),
    (r"sk-ant-[A-Za-z\d]{20,}", "sk-ant-<redacted>"),
    (r"Bearer [\w~+/=.-]{20,}", "Bearer <redacted>"),
    (r"(?i)api[-_]?key[:=]\s*[\"']?[a-z\d]{16,}[\"']?", "API_KEY=<redacted>"),
    (r"(?i)(api_key|token|password|secret)[:=]\s*[\"']?[a-z\d]{8,}[\"']?", "$1=<redacted>"),
    (r"[\w.%+-]+@[A-Za-z\d.-]+\.[A-Za-z]{2,}", "<email-redacted>"),
]


def estimate_tokens(text: Column) -> Column:
    """A third of the bytes."""
    return F.floor(F.octet_length(text) / 3).cast("int")


def redact(text: Column) -> Column:
    for expression, replacement in REDACTIONS:
        text = F.regexp_replace(text, expression, replacement)
    return text


def slug(text: Column) -> Column:
    """Lower-case ASCII letters and digits, runs of blanks and dashes as one dash, 40 bytes at most, `target` if nothing is left."""
    s = F.regexp_replace(F.regexp_replace(F.lower(text), r"[^a-z0-9 _-]", ""), r"[ _-]+", "-")
    s = F.substring(F.regexp_replace(s, "-+$", ""), 1, 40)
    return F.when(s == "", "target").otherwise(s)


def stem(path: Column) -> Column:
    """The name of a file up to its last dot."""
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")


def line_count(text: Column) -> Column:
    return F.size(F.split(text, "\n", -1))


def severity_rank(severity: Column) -> Column:
    return F.when(severity == "high", 0).when(severity == "medium", 1).otherwise(2)
