"""Chat formatting by multi-party perspective rotation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from annalist.llm import shared

#: Speakers that set the scene and get no perspective of their own.
SCENE = ("system",)
END = "<|end|>\n"


def unmarked(text: Column) -> Column:
    """Text that forges no turn: `<|` and `|>` in it are written apart, so both occur in marks only."""
    return F.replace(F.replace(text, F.lit("<|"), F.lit("< |")), F.lit("|>"), F.lit("| >"))


def rotate(turns: DataFrame) -> DataFrame:
    """Every conversation once from each participant's view, as one row per turn and view.

    Columns: conv_id, perspective, turn, role, piece (what the turn renders to), start and end
    (code points in the whole rendering) and mask_start, mask_end (the assistant's words and
    end mark, on which a model is trained; null in other turns). The pieces of a view in order
    of `start` are the rendering; see `rendered`.

    The view's speaker becomes `assistant`, scene roles keep their name, and everyone else is
    `user:<name>`. Turns stand in order of (turn, role, text), nulls first; equal rows follow one
    another. Null role: the name is empty. Null text: empty. Null conv_id: a conversation of
    its own. A conversation in which only scene roles speak has no views. Empty table: no rows. Other columns are
    ignored. `<|` and `|>` in texts and names are written apart, as `< |` and `| >`, so that nobody forges a turn. Very long
    texts: a row holds one turn's text. Every turn occurs once for each speaker of its conversation, and a conversation's names are one row.

    Rows are numbered by ranges of that order and offsets are summed first inside a range, then
    over ranges, so a conversation with any share of all turns is spread over tasks.
    """
    rows = turns.select("conv_id", F.col("turn"), unmarked(F.coalesce("role", F.lit(""))).alias("role"), unmarked(shared.text_or_empty()).alias("text"))
    order = [F.col(c) for c in ("conv_id", "turn", "role", "text")]
    rows, _ = shared.numbered(rows, order, "chat-turns")
    rows = rows.withColumn("block", F.shiftright("row_number", 10))  # of one conversation: at most 1024 turns

    speakers = rows.where(~F.col("role").isin(*SCENE)).groupBy("conv_id").agg(F.array_sort(F.collect_set("role")).alias("views"))
    r, s = rows.alias("r"), speakers.alias("s")
    views = r.join(s, F.col("r.conv_id").eqNullSafe(F.col("s.conv_id"))).select("r.*", F.explode("views").alias("perspective"))

    own = F.col("role") == F.col("perspective")
    name = F.when(own, F.lit("assistant")).when(F.col("role").isin(*SCENE), F.col("role")).otherwise(F.concat(F.lit("user:"), F.col("role")))
    head = F.concat(F.lit("<|"), name, F.lit("|>\n"))
    views = views.withColumn("head", F.length(head)).withColumn("piece", F.concat(head, F.col("text"), F.lit(END))).withColumn("n", F.length("piece").cast("long"))

    blocks = views.groupBy("conv_id", "perspective", "block").agg(F.sum("n").alias("n"))
    upto = Window.partitionBy("conv_id", "perspective").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("conv_id", "perspective", "block", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("before"))
    upto = Window.partitionBy("conv_id", "perspective", "block").orderBy("row_number").rowsBetween(Window.unboundedPreceding, -1)
    views = views.withColumn("inside", F.coalesce(F.sum("n").over(upto), F.lit(0)))
    v, b = views.alias("v"), blocks.alias("b")
    same = F.col("v.conv_id").eqNullSafe(F.col("b.conv_id")) & (F.col("v.perspective") == F.col("b.perspective")) & (F.col("v.block") == F.col("b.block"))
    start = F.col("before") + F.col("inside")
    placed = v.join(b, same).select("v.*", start.alias("start"), (start + F.col("n")).alias("end"))
    return placed.select(
        "conv_id", "perspective", "turn", "role", "piece", "start", "end",
        F.when(own, F.col("start") + F.col("head")).alias("mask_start"),
        F.when(own, F.col("end")).alias("mask_end"),
    )


def rendered(pieces: DataFrame) -> DataFrame:
    """One row per view with the whole rendering and its masks, for conversations that fit a row."""
    in_order = F.array_sort(F.collect_list(F.struct("start", "piece", "mask_start", "mask_end")))
    whole = pieces.groupBy("conv_id", "perspective").agg(in_order.alias("parts"))
    masks = F.transform(F.filter("parts", lambda p: p["mask_start"].isNotNull()), lambda p: F.struct(p["mask_start"].alias("start"), p["mask_end"].alias("end")))
    return whole.select("conv_id", "perspective", F.array_join("parts.piece", "").alias("text"), masks.alias("masks"))


def op5_perspective_rotation(spark, sf_dir):
    """Every conversation from the view of each of its speakers; see `rotate`."""
    return rotate(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


SQL = """
WITH c AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM (
    SELECT conv_id, turn, replace(replace(coalesce(role, ''), '<|', '< |'), '|>', '| >') AS role, replace(replace(coalesce(text, ''), '<|', '< |'), '|>', '| >') AS text FROM conversations)),
v AS (
  SELECT DISTINCT conv_id, role AS perspective FROM c WHERE role <> 'system'),
p AS (
  SELECT c.*, perspective,
         '<|' || CASE WHEN role = perspective THEN 'assistant' WHEN role = 'system' THEN role ELSE 'user:' || role END || '|>' || chr(10) AS head
  FROM c JOIN v ON c.conv_id IS NOT DISTINCT FROM v.conv_id),
n AS (
  SELECT *, head || text || '<|end|>' || chr(10) AS piece, length(head) AS h, length(head) + length(text) + 8 AS n FROM p),
s AS (
  SELECT *, sum(n) OVER (PARTITION BY conv_id, perspective ORDER BY i) AS e FROM n)
SELECT conv_id, perspective, turn, role, piece, (e - n)::BIGINT AS "start", e::BIGINT AS "end",
       CASE WHEN role = perspective THEN (e - n + h)::BIGINT END AS mask_start,
       CASE WHEN role = perspective THEN e::BIGINT END AS mask_end
FROM s"""
