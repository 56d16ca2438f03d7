"""Chat formatting of preferences: one prompt for the common turns of both conversations, two masked completions.

Built-in functions only. The turns of a pair meet in one row by one grouping; texts are shuffled once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TRAINED_ROLE = "assistant"


def _header(turn: Column) -> Column:
    return F.concat(F.lit("<|"), F.coalesce(turn["role"], F.lit("unknown")), F.lit("|>\n"))


def _body(turn: Column) -> Column:
    """The text, in which no marker can begin, and the end of the turn."""
    return F.concat(F.replace(F.coalesce(turn["text"], F.lit("")), F.lit("<|"), F.lit("< |")), F.lit("\n"))


def _rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(_header(t), _body(t))), "")


def _mask(turns: Column) -> Column:
    """Runs of characters of the completion, in order: how many, and if the loss counts them."""
    return F.flatten(F.transform(turns, lambda t: F.array(
        F.struct(F.char_length(_header(t)).alias("chars"), F.lit(False).alias("train")),
        F.struct(F.char_length(_body(t)).alias("chars"), t["role"].eqNullSafe(TRAINED_ROLE).alias("train")))))


def format_preferences(turns: DataFrame) -> DataFrame:
    """One row for each pair_id, from rows (pair_id, chosen boolean, turn, role, text).

    n_common is the number of leading turns that agree in role and text; they are rendered once, as ``prompt``. What follows
    is ``chosen`` and ``rejected``, with ``chosen_mask`` and ``rejected_mask``: runs (chars, train) that add up to the
    completion's length; only the assistant's turns are trained on. Turns are ordered by number, then role, then text, NULLs
    first, so repeated numbers have a fixed order, and repeated rows are repeated turns. A NULL role is rendered as
    ``unknown``, a NULL text as an empty one. A pair that has turns on one side only gives an empty prompt and one empty
    completion, ``complete`` is false. Rows without pair_id or side belong to no pair and give nothing. An empty table gives
    an empty one. Other columns are not read. A pair's turns are one training example and so one row.
    """
    turn = F.struct("turn", "role", F.col("text").cast("string").alias("text"))
    sides = (
        turns.filter("pair_id IS NOT NULL AND chosen IS NOT NULL")
        .groupBy("pair_id")
        .agg(F.array_sort(F.collect_list(F.when(F.col("chosen"), turn))).alias("__a"),
             F.array_sort(F.collect_list(F.when(~F.col("chosen"), turn))).alias("__b"))
    )
    shorter = F.least(F.size("__a"), F.size("__b"))

    def differs(i: Column) -> Column:
        a, b = F.get("__a", i), F.get("__b", i)
        return ~(a["role"].eqNullSafe(b["role"]) & a["text"].eqNullSafe(b["text"]))

    first = F.get(F.filter(F.sequence(F.lit(0), shorter - 1), differs), F.lit(0))
    sides = sides.withColumn("n_common", F.when(shorter > 0, F.coalesce(first, shorter)).otherwise(0))
    tails = sides.select(
        "pair_id", "n_common",
        ((F.size("__a") > 0) & (F.size("__b") > 0)).alias("complete"),
        F.slice("__a", F.lit(1), F.col("n_common")).alias("__p"),
        F.slice("__a", F.col("n_common") + 1, F.size("__a")).alias("__a"),
        F.slice("__b", F.col("n_common") + 1, F.size("__b")).alias("__b"),
    )
    return tails.select(
        "pair_id", "complete", "n_common", _rendered(F.col("__p")).alias("prompt"),
        _rendered(F.col("__a")).alias("chosen"), _mask(F.col("__a")).alias("chosen_mask"),
        _rendered(F.col("__b")).alias("rejected"), _mask(F.col("__b")).alias("rejected_mask"),
    )


def with_other_ending(turns: DataFrame) -> DataFrame:
    """Pairs whose sides begin alike, from a table of conversations (conv_id, turn, role, text): the pair of a conversation has
    itself as chosen, and as rejected the same turns with the last of the assistant's replaced by the one of conversation
    conv_id + 1. If that has none, the rejected side ends without it. Conversations without a turn of the assistant give no pair.

    The last turn is the one with the greatest number, then the greatest text (NULLs least); rows equal to it are replaced with it.
    """
    rows = turns.filter("conv_id IS NOT NULL").select("conv_id", "turn", "role", F.col("text").cast("string").alias("text"))
    last = rows.filter(F.col("role") == TRAINED_ROLE).groupBy("conv_id").agg(F.max(F.struct("turn", "text")).alias("last"))
    other = last.select((F.col("conv_id") - 1).alias("conv_id"), F.col("last.text").alias("other"), F.lit(True).alias("found"))
    placed = rows.join(last, "conv_id").join(other, "conv_id", "left")
    ends = F.col("role").eqNullSafe(TRAINED_ROLE) & F.struct("turn", "text").eqNullSafe(F.col("last"))
    chosen = placed.select(F.col("conv_id").alias("pair_id"), F.lit(True).alias("chosen"), "turn", "role", "text")
    rejected = placed.filter(~ends | F.coalesce("found", F.lit(False))).select(
        F.col("conv_id").alias("pair_id"), F.lit(False).alias("chosen"), "turn", "role",
        F.when(ends, F.col("other")).otherwise(F.col("text")).alias("text"))
    return chosen.unionByName(rejected)


def mask_text(mask: Column) -> Column:
    return F.array_join(F.transform(mask, lambda r: F.concat(
        r["chars"].cast("string"), F.when(r["train"], "+").otherwise("-"))), " ")


ORACLE = """
WITH last AS (
  SELECT conv_id, turn, text FROM conversations WHERE conv_id IS NOT NULL AND role = 'assistant'
  QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC NULLS LAST, text DESC NULLS LAST) = 1
), placed AS (
  SELECT c.conv_id, c.turn, c.role, c.text, o.conv_id IS NOT NULL AS found, o.text AS other,
    c.role IS NOT DISTINCT FROM 'assistant' AND c.turn IS NOT DISTINCT FROM l.turn AND c.text IS NOT DISTINCT FROM l.text AS ends
  FROM conversations c JOIN last l USING (conv_id) LEFT JOIN last o ON o.conv_id = c.conv_id + 1
), sides AS (
  SELECT conv_id AS pair_id,
    coalesce(list({'turn': turn, 'role': role, 'text': text} ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST), []) AS a,
    coalesce(list({'turn': turn, 'role': role, 'text': new} ORDER BY turn NULLS FIRST, role NULLS FIRST, new NULLS FIRST)
      FILTER (NOT ends OR found), []) AS b
  FROM (SELECT *, CASE WHEN ends THEN other ELSE text END AS new FROM placed) GROUP BY 1
), met AS (
  SELECT *, coalesce(list_min(list_filter(range(1, least(len(a), len(b)) + 1), lambda i:
    a[i].role IS DISTINCT FROM b[i].role OR a[i].text IS DISTINCT FROM b[i].text)) - 1, least(len(a), len(b))) AS k
  FROM sides
), cut AS (
  SELECT pair_id, len(a) > 0 AND len(b) > 0 AS complete, k, a[1:k] AS p, a[k + 1:] AS c, b[k + 1:] AS r FROM met
)
SELECT pair_id, complete, k::INTEGER AS n_common,
  coalesce(array_to_string(list_transform(p, lambda t: '<|' || coalesce(t.role, 'unknown') || '|>' || chr(10)
    || replace(coalesce(t.text, ''), '<|', '< |') || chr(10)), ''), '') AS prompt,
  coalesce(array_to_string(list_transform(c, lambda t: '<|' || coalesce(t.role, 'unknown') || '|>' || chr(10)
    || replace(coalesce(t.text, ''), '<|', '< |') || chr(10)), ''), '') AS chosen,
  coalesce(array_to_string(list_transform(r, lambda t: '<|' || coalesce(t.role, 'unknown') || '|>' || chr(10)
    || replace(coalesce(t.text, ''), '<|', '< |') || chr(10)), ''), '') AS rejected,
  coalesce(array_to_string(list_transform(c, lambda t: (length(coalesce(t.role, 'unknown')) + 5) || '- '
    || (length(replace(coalesce(t.text, ''), '<|', '< |')) + 1)
    || CASE WHEN t.role IS NOT DISTINCT FROM 'assistant' THEN '+' ELSE '-' END), ' '), '') AS chosen_mask,
  coalesce(array_to_string(list_transform(r, lambda t: (length(coalesce(t.role, 'unknown')) + 5) || '- '
    || (length(replace(coalesce(t.text, ''), '<|', '< |')) + 1)
    || CASE WHEN t.role IS NOT DISTINCT FROM 'assistant' THEN '+' ELSE '-' END), ' '), '') AS rejected_mask
FROM cut"""
