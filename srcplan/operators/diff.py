"""Unified diffs: lexing, parsing and totals, for many diffs at once.

`parse` follows a line-based grammar by expressions over each text, without Python: each `diff --git` line opens a file, each
`@@` a hunk, and a line that fits neither state closes it. No diff is taken apart into rows of lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from srcplan.functions import paths

#: First match wins. A line that matches none has no token.
LEXER = [
    ("HUNK", r"^@@"),
    ("DIFF", r"^diff --git "),
    ("BINARY", r"^Binary files "),
    ("NEW_FILE", r"^new file mode "),
    ("DELETED_FILE", r"^deleted file mode "),
    ("OLD_MODE", r"^old mode "),
    ("NEW_MODE", r"^new mode "),
    ("RENAME_FROM", r"^rename from "),
    ("RENAME_TO", r"^rename to "),
    ("SIMILARITY", r"^similarity index "),
    ("INDEX", r"^index "),
    ("OLD", r"^--- "),
    ("NEWHDR", r"^\+\+\+ "),
    ("NOEOL", r"^\\ No newline"),
    ("ADD", r"^\+"),
    ("DEL", r"^-"),
    ("CTX", r"^ "),
]


def token(text: Column) -> Column:
    out = None
    for name, expression in LEXER:
        out = F.when(text.rlike(expression), name) if out is None else out.when(text.rlike(expression), name)
    return out


def tokens(diffs: DataFrame) -> DataFrame:
    """(diff_id, line_no, token, text) of the lines that have a token. diffs: diff_id, text."""
    lines = diffs.select("diff_id", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "text"))
    lines = lines.withColumn("text", F.regexp_replace("text", "\r$", ""))
    return lines.select("diff_id", "line_no", token(F.col("text")).alias("token"), "text").filter("token is not null")


def _any(*names: str) -> str:
    """An expression of the lines with one of these tokens, at their beginning; a line that an earlier one of OLD and NEWHDR takes is not ADD or DEL."""
    begin = {n: e[1:] for n, e in LEXER} | {"ADD": r"\+(?!\+\+ )", "DEL": "-(?!-- )"}
    words = [begin[n] for n in names if begin[n][0].isalpha()]
    # most lines begin with a sign, so one look at the first letter passes over all words
    led = [f"(?=[{''.join(sorted({w[0] for w in words}))}])(?:{'|'.join(words)})"] if words else []
    return f"(?:{'|'.join([begin[n] for n in names if not begin[n][0].isalpha()] + led)})"


_CONTENT = ("ADD", "DEL", "CTX", "NOEOL")
#: What ends a hunk.
_NO_HUNK = tuple(n for n, _ in LEXER if n not in ("HUNK", "DIFF", *_CONTENT))


def parse(diffs: DataFrame) -> DataFrame:
    """(diff_id, file_idx, path, old_path, added, deleted, is_binary, is_rename) of each file of each diff.

    A text is cut at its `diff --git` lines and each part at its first `@@`, where it lies: there is no shuffle and no row for a line. Rows that share a diff_id are diffs of their own.
    """
    parts = diffs.select("diff_id", "text", F.posexplode(F.split("text", r"\n(?=diff --git )", -1)).alias("pos", "s"))
    t = parts.filter(F.col("s").startswith("diff --git ")).select("diff_id", (F.col("pos") + F.when(F.startswith("text", F.lit("diff --git ")), 1).otherwise(0)).cast("long").alias("file_idx"), "s")
    lead = F.substring_index("s", "\n@@", 1)
    t = t.select("diff_id", "file_idx", "s", lead.alias("lead"), F.substring("s", F.length(lead) + 1, F.length("s")).alias("hunks"))
    # lines on the file itself end where a body begins or a line closes it
    body = F.regexp_extract("lead", rf"(?s)\n({_any('OLD', 'NEWHDR', 'BINARY', *_CONTENT)}.*)", 1)
    t = t.select("diff_id", "file_idx", "s", "lead", "hunks", body.alias("body"))
    t = t.select("diff_id", "file_idx", "s", "hunks", "body", F.substring("lead", F.lit(1), F.length("lead") - F.length("body")).alias("meta"))
    closed = F.col("body").rlike(rf"^{_any('BINARY', *_CONTENT)}|\n{_any(*_CONTENT, *[n for n in _NO_HUNK if n not in ('OLD', 'NEWHDR')])}")
    # what follows the line that ends a hunk counts nowhere, up to the next hunk
    counted = F.when(~closed, F.regexp_replace("hunks", rf"(?s)\n{_any(*_NO_HUNK)}.*?(?=\n@@|\z)", ""))
    t = t.select("diff_id", "file_idx", "s", "meta", "body", counted.alias("counted"))
    lines = lambda sign: F.coalesce(F.octet_length("counted") - F.octet_length(F.replace("counted", F.lit("\n" + sign), F.lit("\n"))), F.lit(0)).cast("long")
    # the last line of each kind speaks
    said = lambda word: F.when(F.contains("meta", F.lit("\n" + word)), F.regexp_replace(F.regexp_extract("meta", rf"(?s)^.*\n{word}([^\n]*)", 1), "\r$", ""))
    old, new = said("rename from "), said("rename to ")
    return t.select(
        "diff_id",
        "file_idx",
        F.coalesce(new, F.regexp_extract("s", r"^diff --git a/(.*?) b/", 1)).alias("path"),
        F.coalesce(old, F.lit("")).alias("old_path"),
        lines("+").alias("added"),
        lines("-").alias("deleted"),
        F.startswith("body", F.lit("Binary files ")).alias("is_binary"),
        (old.isNotNull() | new.isNotNull()).alias("is_rename"),
    )


def facts(files: DataFrame) -> DataFrame:
    """Adds what follows from path and counts to file statistics (diff_id, file_idx, path, added, deleted)."""
    p = F.col("path")
    return files.withColumns(
        {
            "changed": F.col("added") + F.col("deleted"),
            "is_generated": paths.is_generated(p),
            "is_lockfile": paths.is_lockfile(p),
            "category": paths.diff_category(p),
            "is_binary": F.col("is_binary") if "is_binary" in files.columns else F.lit(False),
            "is_rename": F.col("is_rename") if "is_rename" in files.columns else F.lit(False),
        }
    )


def sums() -> list[Column]:
    """What totals() has of each diff, as aggregates over its files."""
    return [
        F.count("*").alias("files"),
        F.sum("added").alias("added"),
        F.sum("deleted").alias("deleted"),
        F.sum("changed").alias("changed"),
        F.max("changed").alias("largest_delta"),
        F.bool_or("is_generated").alias("has_generated"),
        F.bool_or("is_lockfile").alias("has_lockfile"),
        F.bool_or("is_binary").alias("has_binary"),
        F.bool_or("is_rename").alias("has_rename"),
        F.array_sort(F.collect_set("category")).alias("categories"),
    ]


def totals(files: DataFrame) -> DataFrame:
    """One row for each diff, of files with facts()."""
    return files.groupBy("diff_id").agg(*sums())


def render(files: DataFrame) -> DataFrame:
    """(diff_id, text): a diff for each description (diff_id, file_idx, path, added, deleted), whose counts parse() gives back. Lines are made after grouping, so only descriptions are shuffled."""
    number = lambda c: c.cast("string")

    def one(x: Column) -> Column:
        p = x["path"]
        head = F.concat(F.lit("diff --git a/"), p, F.lit(" b/"), p, F.lit("\n--- a/"), p, F.lit("\n+++ b/"), p, F.lit("\n@@ -1,"), number(x["deleted"]), F.lit(" +1,"), number(x["added"]), F.lit(" @@"))
        return F.concat(head, F.repeat(F.lit("\n-old"), x["deleted"]), F.repeat(F.lit("\n+new"), x["added"]))

    every = files.groupBy("diff_id").agg(F.array_sort(F.collect_list(F.struct("file_idx", "path", "added", "deleted"))).alias("f"))
    return every.select("diff_id", F.array_join(F.transform("f", one), "\n").alias("text"))
