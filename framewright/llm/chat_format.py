"""Preference pairs for training: one shared prompt, two masked completions.

The longest common prefix of a chosen and a rejected conversation, counted in whole turns, is
rendered once as the prompt. What follows it is rendered for either side with a mask of runs
``flag:length`` in characters; flag 1 marks what an assistant said and is trained on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewright.llm.common import table

TRAINED = "assistant"


def _row() -> Column:
    """A turn as it sorts: by number, those without one last, then by role and text."""
    return F.struct(F.col("turn").isNull().alias("unplaced"), "turn", F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))


def _turns(side: str) -> Column:
    """A side's turns in order; rows that repeat are one turn, different rows of one turn number keep an order of their own."""
    return F.array_sort(F.collect_set(F.when(F.col("side") == side, _row())))


def _head(t: Column) -> Column:
    return F.concat(F.lit("<|"), t["role"], F.lit("|>\n"))


def _body(t: Column) -> Column:
    return F.concat(t["text"], F.lit("<|end|>\n"))


def _render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(_head(t), _body(t))), "")


def _mask(turns: Column) -> Column:
    return F.array_join(
        F.transform(turns, lambda t: F.concat(F.lit("0:"), F.length(_head(t)).cast("string"), F.lit(" "), F.when(t["role"] == TRAINED, "1").otherwise("0"), F.lit(":"), F.length(_body(t)).cast("string"))), " "
    )


def format_preferences(turns: DataFrame) -> DataFrame:
    """(pair_id, n_prefix, prompt, chosen, chosen_mask, rejected, rejected_mask), a row for each pair.

    ``turns`` has (pair_id, side, turn, role, text, any others), side being chosen or rejected. Turns
    are equal if role and text are; a null role is ``unknown``, a null text empty, and a null turn
    number comes last. A side without turns has an empty completion, and so have equal sides. Rows
    of a null pair_id or another side are in no pair. A pair's turns meet in one row, as its text must.
    """
    pairs = turns.where("pair_id is not null and side in ('chosen', 'rejected')").groupBy("pair_id").agg(_turns("chosen").alias("c"), _turns("rejected").alias("r"))
    both = F.least(F.size("c"), F.size("r"))
    differ = F.filter(F.sequence(F.lit(1), both), lambda i: (F.element_at("c", i)["role"] != F.element_at("r", i)["role"]) | (F.element_at("c", i)["text"] != F.element_at("r", i)["text"]))
    pairs = pairs.withColumn("n", F.when(both > 0, F.coalesce(F.array_min(differ) - 1, both)).otherwise(0))
    tail = lambda side: F.slice(side, F.col("n") + 1, F.size(side))
    return pairs.select(
        "pair_id",
        F.col("n").cast("long").alias("n_prefix"),
        _render(F.slice("c", F.lit(1), F.col("n"))).alias("prompt"),
        _render(tail("c")).alias("chosen"),
        _mask(tail("c")).alias("chosen_mask"),
        _render(tail("r")).alias("rejected"),
        _mask(tail("r")).alias("rejected_mask"),
    )


def stale_reply_pairs(conversations: DataFrame) -> DataFrame:
    """Pairs made from plain conversations: chosen is a conversation up to its last assistant turn, rejected the same with the reply before that repeated in its place.

    An only reply gives way to an empty one. Without an assistant turn both sides are the whole
    conversation. (conv_id, turn, role, text) in; rows of a null conv_id make no pair.
    """
    conv = conversations.where("conv_id is not null").groupBy("conv_id").agg(F.array_sort(F.collect_set(_row())).alias("t"))
    said = F.filter(F.sequence(F.lit(1), F.size("t")), lambda i: F.element_at("t", i)["role"] == TRAINED)
    conv = conv.withColumn("said", said).withColumn("last", F.coalesce(F.array_max("said"), F.size("t")))
    before = F.when(F.size("said") > 1, F.element_at("t", F.element_at("said", F.when(F.size("said") > 1, F.lit(-2)).otherwise(F.lit(-1))))["text"]).otherwise(F.lit(""))
    stale = F.when(F.size("said") > 0, before).otherwise(F.element_at("t", F.col("last"))["text"])
    conv = conv.withColumn("stale", stale)
    # the position stands for the turn number, which need not be unique
    sides = F.explode(
        F.flatten(
            F.transform(
                F.slice("t", F.lit(1), F.col("last")),
                lambda x, i: F.array(
                    F.struct(F.lit("chosen").alias("side"), i.alias("turn"), x["role"].alias("role"), x["text"].alias("text")),
                    F.struct(F.lit("rejected").alias("side"), i.alias("turn"), x["role"].alias("role"), F.when(i + 1 == F.col("last"), F.col("stale")).otherwise(x["text"]).alias("text")),
                ),
            )
        )
    )
    return conv.select(F.col("conv_id").alias("pair_id"), sides.alias("s")).select("pair_id", "s.*")


def query(spark, sf_dir: str) -> DataFrame:
    return format_preferences(stale_reply_pairs(table(spark, sf_dir, "conversations")))


ORACLE = """
WITH t AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS i FROM (SELECT DISTINCT conv_id, turn, role, text FROM conversations)),
said AS (SELECT conv_id, max(i) AS last, count(*) AS n FROM t WHERE role = 'assistant' GROUP BY 1),
prev AS (SELECT t.conv_id, arg_max(t.text, t.i) AS text FROM t JOIN said s ON s.conv_id = t.conv_id AND t.i < s.last AND t.role = 'assistant' GROUP BY 1),
ends AS (SELECT c.conv_id, coalesce(s.last, c.n) AS last, CASE WHEN s.n IS NULL THEN NULL ELSE coalesce(p.text, '') END AS stale
         FROM (SELECT conv_id, max(i) AS n FROM t GROUP BY 1) c LEFT JOIN said s USING (conv_id) LEFT JOIN prev p USING (conv_id)),
rows AS (SELECT t.conv_id, t.i, t.role, t.text AS c, CASE WHEN t.i = e.last AND e.stale IS NOT NULL THEN e.stale ELSE t.text END AS r FROM t JOIN ends e ON e.conv_id = t.conv_id AND t.i <= e.last),
cut AS (SELECT conv_id, coalesce(min(i) FILTER (WHERE c <> r) - 1, max(i)) AS n FROM rows GROUP BY 1),
shown AS (SELECT rows.*, cut.n, '<|' || role || '|>' || chr(10) AS head, c || '<|end|>' || chr(10) AS cb, r || '<|end|>' || chr(10) AS rb, CASE WHEN role = 'assistant' THEN '1' ELSE '0' END AS f FROM rows JOIN cut USING (conv_id))
SELECT conv_id AS pair_id, any_value(n)::BIGINT AS n_prefix,
  coalesce(string_agg(head || cb, '' ORDER BY i) FILTER (WHERE i <= n), '') AS prompt,
  coalesce(string_agg(head || cb, '' ORDER BY i) FILTER (WHERE i > n), '') AS chosen,
  coalesce(string_agg('0:' || length(head) || ' ' || f || ':' || length(cb), ' ' ORDER BY i) FILTER (WHERE i > n), '') AS chosen_mask,
  coalesce(string_agg(head || rb, '' ORDER BY i) FILTER (WHERE i > n), '') AS rejected,
  coalesce(string_agg('0:' || length(head) || ' ' || f || ':' || length(rb), ' ' ORDER BY i) FILTER (WHERE i > n), '') AS rejected_mask
FROM shown GROUP BY 1
"""
