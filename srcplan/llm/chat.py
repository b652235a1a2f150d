"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all turns before it, rendered one after the other, are the prompt, its
reply is the target, and only the target is trainable. The turns of a conversation are ordered by turn, then role, then
text (nulls first). A turn is rendered as <|role|>, a line end, its text, <|end|> and a line end; the prompt ends with the header of the reply.

Defined results: a null role is `unknown`, a null text is empty, a null conv_id is a conversation of its own. Roles compare in lower case without blanks around
them, and every run of characters in them besides a-z, 0-9, - and _ is rendered as one _, so that no role can pose as a turn either. Repeated rows are turns of their own. A conversation that begins with an assistant turn gives an example whose prompt is
the header only; one without assistant turns gives none. Marks of the template within a text are broken up by a space,
so that no text can pose as another turn. Empty tables give an empty result. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _role(c: Column) -> Column:
    return F.regexp_replace(F.coalesce(F.lower(F.trim(c)), F.lit("unknown")), "[^a-z0-9_-]+", "_")


def _text(c: Column) -> Column:
    return F.replace(F.coalesce(c, F.lit("")), F.lit("<|"), F.lit("< |"))


def expand(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, n_context, prompt, target, train_from, train_to: characters train_from to train_to of prompt and target together are trainable."""
    turns = conversations.select("conv_id", "turn", "role", "text").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    turns = turns.select(
        "conv_id",
        F.transform("turns", lambda t: F.struct(t["turn"].alias("turn"), _role(t["role"]).alias("role"), _text(t["text"]).alias("text"))).alias("turns"),
    )
    rendered = F.transform("turns", lambda t: F.concat(F.lit("<|"), t["role"], F.lit("|>\n"), t["text"], F.lit("<|end|>\n")))
    one = turns.withColumn("parts", rendered).select("conv_id", "parts", F.posexplode("turns").alias("at", "x")).filter("x.role = 'assistant'")
    out = one.select(
        "conv_id",
        F.col("x.turn").alias("turn"),
        F.col("at").alias("n_context"),
        F.concat(F.array_join(F.slice("parts", F.lit(1), F.col("at")), ""), F.lit("<|assistant|>\n")).alias("prompt"),
        F.concat(F.col("x.text"), F.lit("<|end|>\n")).alias("target"),
    )
    return out.select("conv_id", "turn", "n_context", "prompt", "target", F.length("prompt").alias("train_from"), (F.length("prompt") + F.length("target")).alias("train_to"))


ORACLE = r"""
WITH t AS (
  SELECT conv_id, turn, regexp_replace(coalesce(lower(trim(role)), 'unknown'), '[^a-z0-9_-]+', '_', 'g') AS role, replace(coalesce(text, ''), '<|', '< |') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) - 1 AS pos FROM conversations),
r AS (
  SELECT *, coalesce(string_agg('<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10), '') OVER (PARTITION BY conv_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS before FROM t)
SELECT conv_id, turn, CAST(pos AS INTEGER) AS n_context, before || '<|assistant|>' || chr(10) AS prompt, text || '<|end|>' || chr(10) AS target,
       CAST(length(before) + 14 AS INTEGER) AS train_from, CAST(length(before) + 14 + length(text) + 8 AS INTEGER) AS train_to
FROM r WHERE role = 'assistant'
"""
