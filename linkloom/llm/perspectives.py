"""Operator 5: chat formatting, a dialogue from every participant's side.

For every participant of a conversation the whole dialogue is rendered with
that speaker as ``assistant`` and the others as named users; only the
assistant's words (and the mark that ends them) are to be learned. The
rendering is a table of segments, one per turn, with the place of each in
its rendering: joined in order they are the text, so that no task or row
holds a whole conversation however long. Places are running sums, taken in
blocks of a global sort and then over the blocks' totals.

Everything is DataFrame code.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkloom.llm.common import written

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
SYSTEM = "system"


def _plain(text: Column) -> Column:
    """Text in which the turn marks don't occur."""
    return F.replace(F.coalesce(text, F.lit("")), F.lit("<|"), F.lit("< |"))


def _name(role: Column) -> Column:
    return F.regexp_replace(_plain(F.coalesce(role, F.lit("unknown"))), r"[ \t\n\x0B\f\r]+", "_")


def rotate_perspectives(conversations: DataFrame, *, system: str = SYSTEM) -> DataFrame:
    """One row per (conversation, participant, turn).

    Columns: conv_id, perspective, pos (0, 1, ... in the rendering), turn,
    speaker, segment, start and stop (characters; the next starts where this
    stops), mask_start and mask_stop (what is to be learned; null for turns
    of others).

    Participants are the distinct roles but ``system``, whose turns are
    shown as such to everyone; a conversation of system turns alone gives no
    rows. Null roles speak as ``unknown``, null text is empty, white space
    in names becomes ``_`` and ``<|`` in texts ``< |``. Turns are ordered by
    turn (null first), speaker and md5 of the text; repeated rows are all
    kept. Rows without conv_id form one conversation. Further columns are
    not looked at.
    """
    turns = conversations.select("conv_id", "turn", _name(F.col("role")).alias("speaker"), _plain(F.col("text")).alias("body"))
    turns = turns.withColumn("tie", F.md5("body")).withColumn("rid", F.monotonically_increasing_id())
    order = ["conv_id", "turn", "speaker", "tie", "rid"]
    # A long conversation lies in several blocks; none is larger than a partition of the sort.
    turns = written(turns.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("block", F.spark_partition_id()), "turns")

    speakers = turns.filter(F.col("speaker") != system).select("conv_id", F.col("speaker").alias("perspective")).distinct()
    blocks = turns.select("conv_id", "block").distinct()
    same = blocks["conv_id"].eqNullSafe(speakers["conv_id"])
    seats = blocks.join(speakers, same).select(blocks["conv_id"].alias("seat"), blocks["block"].alias("seat_block"), "perspective")
    own = F.col("speaker") == F.col("perspective")
    head = F.concat(F.lit(OPEN), F.when(own, "assistant").when(F.col("speaker") == system, system).otherwise(F.concat(F.lit("user name="), F.col("speaker"))), F.lit("\n"))
    seen = (turns.join(seats, turns["conv_id"].eqNullSafe(seats["seat"]) & (turns["block"] == seats["seat_block"])).drop("seat", "seat_block")
            .withColumn("head", F.length(head)).withColumn("segment", F.concat(head, "body", F.lit(CLOSE + "\n")))
            .withColumn("size", F.length("segment").cast("long")))
    part = ["conv_id", "perspective", "block"]
    here = Window.partitionBy(*part).orderBy("turn", "speaker", "tie", "rid")
    seen = (seen.withColumn("upto", F.sum("size").over(here)).withColumn("nth", F.row_number().over(here)))
    totals = (turns.join(seats, turns["conv_id"].eqNullSafe(seats["seat"]) & (turns["block"] == seats["seat_block"])).drop("seat", "seat_block")
              .groupBy(*part).agg(F.sum(F.length(head) + F.length("body") + len(CLOSE) + 1).alias("size"), F.count(F.lit(1)).alias("n")))
    before = Window.partitionBy("conv_id", "perspective").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select(F.col("conv_id").alias("c"), F.col("perspective").alias("p"), F.col("block").alias("b"),
                          F.coalesce(F.sum("size").over(before), F.lit(0)).alias("base"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("nbase"))
    out = seen.join(bases, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("perspective") == F.col("p")) & (F.col("block") == F.col("b")))
    start = F.col("base") + F.col("upto") - F.col("size")
    return out.select("conv_id", "perspective", (F.col("nbase") + F.col("nth") - 1).alias("pos"), "turn", "speaker", "segment",
                      start.alias("start"), (start + F.col("size")).alias("stop"),
                      F.when(own, start + F.col("head")).alias("mask_start"),
                      F.when(own, start + F.col("size") - 1).alias("mask_stop"))
