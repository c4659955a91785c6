"""Chat formatting by perspective rotation: each dialogue once per participant.

For every participant, that speaker's turns become the assistant's, everybody else's become a named user's, and the
mask covers what the assistant says. Renderings come in parts of a bounded number of turns, so a conversation of any
length is rendered whole without being gathered in one row; the parts of a perspective, in order, are its text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

#: Turns in one part, and turn numbers in one block of the running count.
PART_TURNS, BLOCK = 256, 1024
#: The role that is nobody's: its turns stay as they are in every perspective.
SYSTEM = "system"


def _head(role: Column, perspective: Column) -> Column:
    who = F.when(role == SYSTEM, F.lit(SYSTEM)).when(role == perspective, F.lit("assistant")).otherwise(F.concat(F.lit("user name="), role))
    return F.concat(F.lit("<|im_start|>"), who, F.lit("\n"))


def _numbered(turns: DataFrame) -> DataFrame:
    """Adds the place of each turn in its conversation: by turn, role and text, repeated rows side by side.

    Equal rows travel as one with their number. Places are counted within blocks of turn numbers and over the sums of
    blocks, so that a long conversation is not counted in one task.
    """
    rows = turns.groupBy("conv", "turn", "role", "text").agg(F.count("*").alias("copies")).withColumn("block", F.floor(F.col("turn") / BLOCK))
    blocks = rows.groupBy("conv", "block").agg(F.sum("copies").alias("n"))
    earlier = Window.partitionBy("conv").orderBy(F.asc_nulls_first("block")).rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("conv", "block", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("ahead"))
    inside = Window.partitionBy("conv", "block").orderBy(F.asc_nulls_first("turn"), "role", "text").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("inside", F.coalesce(F.sum("copies").over(inside), F.lit(0)))
    met = rows.alias("r").join(blocks.alias("b"), F.col("r.conv").eqNullSafe(F.col("b.conv")) & F.col("r.block").eqNullSafe(F.col("b.block")))
    first = F.col("ahead") + F.col("inside")
    return met.select("r.conv", "role", "text", F.explode(F.sequence(first, first + F.col("copies") - 1)).alias("place"))


def rotate(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, perspective, part, n_turns, part_start, text, mask: one row per part of each rendering.

    `mask` lists the (start, end) code points, in the whole rendering, of what the assistant says with the mark that
    ends its turn. Conversations of system turns only have no participants and no rows. A null text is empty, a null
    role is the participant "unknown", null turn numbers come first, null conversation ids are one conversation,
    repeated rows are repeated turns. Other columns are ignored.
    """
    turns = conversations.select(
        F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"), F.coalesce(F.col(role_col).cast("string"), F.lit("unknown")).alias("role"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")
    )
    speakers = turns.filter(F.col("role") != SYSTEM).select(F.col("conv").alias("c"), F.col("role").alias("perspective")).distinct()
    rows = _numbered(turns).join(speakers, F.col("conv").eqNullSafe(F.col("c"))).drop("c")
    head, end = _head(F.col("role"), F.col("perspective")), F.lit("<|im_end|>\n")
    spoken = F.concat("text", F.lit("<|im_end|>"))
    segment = F.struct("place", F.concat(head, "text", end).alias("body"), F.length(head).alias("skip"), F.length(spoken).alias("size"), (F.col("role") == F.col("perspective")).alias("own"))
    parts = rows.groupBy("conv", "perspective", F.expr(f"place div {PART_TURNS}").cast("int").alias("part")).agg(F.sort_array(F.collect_list(segment)).alias("segments"))
    # Each segment's start within its part, by one fold over at most PART_TURNS segments.
    empty = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("spans"))

    def step(state: Column, s: Column) -> Column:
        start = state["at"] + s["skip"]
        span = F.array(F.struct(start.alias("start"), (start + s["size"]).alias("end")))
        return F.struct((state["at"] + F.length(s["body"])).alias("at"), F.when(s["own"], F.concat(state["spans"], span)).otherwise(state["spans"]).alias("spans"))

    parts = parts.withColumn("folded", F.aggregate("segments", empty, step))
    before = Window.partitionBy("conv", "perspective").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("part_start", F.coalesce(F.sum("folded.at").over(before), F.lit(0)))
    moved = F.transform("folded.spans", lambda s: F.struct((s["start"] + F.col("part_start")).alias("start"), (s["end"] + F.col("part_start")).alias("end")))
    body = F.array_join(F.transform("segments", lambda s: s["body"]), "")
    return parts.select(F.col("conv").alias("conv_id"), "perspective", "part", F.size("segments").cast("long").alias("n_turns"), "part_start", body.alias("text"), moved.alias("mask"))
