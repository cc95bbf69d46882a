"""Chat formatting by perspective: for every participant, the dialogue with that speaker as assistant.

A rendering is a sequence of segments, one a turn.  A segment's place in the rendering comes from a
distributed running sum, so a conversation of any length is never gathered as a whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from ..functions.staging import stage

# Fixed marks of the rendered format.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
SYSTEM = "system"
NAMELESS = "unknown"
#: Characters of a training block in ``blocks``.
BLOCK_CHARS = 32_768


def plain(text: Column) -> Column:
    """Text in which nothing reads as a mark of the format."""
    return F.replace(F.coalesce(text, F.lit("")), F.lit("<|"), F.lit("<​|"))


def speaker_name(role: Column) -> Column:
    """One line, without marks; null and blank names are ``unknown``."""
    name = F.trim(F.regexp_replace(plain(role), r"\s+", " "))
    return F.when(name == "", NAMELESS).otherwise(name)


def _header(speaker: Column, perspective: Column) -> Column:
    who = (
        F.when(speaker == SYSTEM, F.lit("system"))
        .when(speaker == perspective, F.lit("assistant"))
        .otherwise(F.concat(F.lit("user name="), speaker))
    )
    return F.concat(F.lit(OPEN), who, F.lit("\n"))


def rendered_turns(turns: DataFrame) -> DataFrame:
    """conv_id, perspective, turn, speaker, trainable, header_chars, segment: a row a turn and perspective.

    ``turns`` holds conv_id, turn, role and text.  Perspectives are the distinct speakers but the system;
    a conversation where only the system speaks has none.  A turn is trainable where its speaker is
    the perspective.  Rows with a null conv_id form one conversation; other columns are ignored.
    """
    said = turns.select("conv_id", "turn", speaker_name(F.col("role")).alias("speaker"), plain(F.col("text")).alias("text"))
    voices = said.where(F.col("speaker") != SYSTEM).select(F.col("conv_id").alias("conv"), F.col("speaker").alias("perspective"))
    both = said.join(voices.distinct(), said["conv_id"].eqNullSafe(voices["conv"])).drop("conv")
    header = _header(F.col("speaker"), F.col("perspective"))
    return both.select(
        "conv_id",
        "perspective",
        "turn",
        "speaker",
        (F.col("speaker") == F.col("perspective")).alias("trainable"),
        F.length(header).cast("long").alias("header_chars"),
        F.concat(header, F.col("text"), F.lit(CLOSE + "\n")).alias("segment"),
    )


def perspectives(turns: DataFrame) -> DataFrame:
    """The rendering of every conversation from every participant's side, a row a turn.

    Adds position (from 0), start and end of the segment and of its trained span (mask_start, mask_end:
    the content with its closing mark, null where nothing is trained), in characters of the
    whole rendering.  Turns are in order of turn (nulls first), then speaker and text; equal rows
    follow each other.  Rows are dealt to tasks by ranges of that order; each range's sums and the sums
    of the ranges before it give the places.
    """
    order = ["conv_id", "perspective", "turn", "speaker", "segment"]
    dealt = rendered_turns(turns).repartitionByRange(*order).sortWithinPartitions(*order)
    dealt = stage(dealt.withColumn("part", F.spark_partition_id()), "turns")
    group = ["part", "conv_id", "perspective"]
    own = Window.partitionBy(*group).orderBy("turn", "speaker", "segment").rowsBetween(Window.unboundedPreceding, 0)
    placed = dealt.withColumn("chars", F.length("segment").cast("long"))
    placed = placed.withColumns({"run": F.sum("chars").over(own), "count": F.count(F.lit(1)).over(own)})
    totals = dealt.groupBy(*group).agg(F.sum(F.length("segment")).alias("chars"), F.count(F.lit(1)).alias("turns"))
    before = Window.partitionBy("conv_id", "perspective").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        F.col("part").alias("p"),
        F.col("conv_id").alias("c"),
        F.col("perspective").alias("v"),
        F.coalesce(F.sum("chars").over(before), F.lit(0)).alias("chars_before"),
        F.coalesce(F.sum("turns").over(before), F.lit(0)).alias("turns_before"),
    )
    same = (F.col("part") == F.col("p")) & F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("perspective") == F.col("v"))
    end = F.col("chars_before") + F.col("run")
    start = end - F.col("chars")
    return placed.join(offsets, same).select(
        "conv_id",
        "perspective",
        (F.col("turns_before") + F.col("count") - 1).alias("position"),
        "turn",
        "speaker",
        "segment",
        start.alias("start"),
        end.alias("end"),
        "trainable",
        F.when(F.col("trainable"), start + F.col("header_chars")).alias("mask_start"),
        F.when(F.col("trainable"), end - 1).alias("mask_end"),
    )


def blocks(segments: DataFrame, chars: int = BLOCK_CHARS) -> DataFrame:
    """conv_id, perspective, block, text, masks: training rows of segments that start in one block.

    A block holds as many segments as start within its ``chars`` characters, so its size is bounded
    but for the last segment's own length; masks are (start, end) within the block's text.
    """
    placed = segments.withColumn("block", F.floor(F.col("start") / F.lit(chars)))
    row = F.struct("position", "segment", "start", "mask_start", "mask_end")
    made = placed.groupBy("conv_id", "perspective", "block").agg(F.sort_array(F.collect_list(row)).alias("rows"))
    first = F.get(F.col("rows"), F.lit(0))["start"]
    trained = F.filter("rows", lambda r: r["mask_start"].isNotNull())
    return made.select(
        "conv_id",
        "perspective",
        "block",
        F.array_join(F.transform("rows", lambda r: r["segment"]), "").alias("text"),
        F.transform(
            trained, lambda r: F.struct((r["mask_start"] - first).alias("start"), (r["mask_end"] - first).alias("end"))
        ).alias("masks"),
    )
