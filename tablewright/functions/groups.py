"""Grouping patterns that stay safe when one group holds a large share of all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from .columns import quoted
from .staging import stage


def first_per_group(df: DataFrame, group: Sequence[str], order: Sequence[Column], n: int = 1) -> DataFrame:
    """The first ``n`` rows of every group.

    Spark limits each group on the map side before the shuffle (WindowGroupLimit, for n up to
    1000), so a hot group sends at most n rows per task.
    """
    rank = F.row_number().over(Window.partitionBy(*[quoted(g) for g in group]).orderBy(*order))
    return df.withColumn("__rank", rank).where(F.col("__rank") <= n).drop("__rank")


def shared_slots(df: DataFrame, slots: Sequence[Column]) -> DataFrame:
    """The staged set (slot) of hashes that several rows hold.

    Only hashes and counts are shuffled, with map-side combining, so copies of one row collapse
    early.
    """
    hashes = df.select(F.explode(F.array_distinct(F.array(*slots))).alias("slot"))
    repeated = hashes.groupBy("slot").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("slot")
    return stage(repeated, "slots")


def _mark(df: DataFrame, slots: Sequence[Column], repeated: DataFrame, flag: str) -> DataFrame:
    out = df
    hits = []
    for i, s in enumerate(slots):
        key, hit = f"__slot{i}", f"__hit{i}"
        side = repeated.select(F.col("slot").alias(key), F.lit(True).alias(hit))
        # staged, so of known size: Spark broadcasts a small set and shuffles for a large one
        out = out.withColumn(key, s).join(side, key, "left").drop(key)
        hits.append(hit)
    shared = F.coalesce(*[F.col(h) for h in hits], F.lit(False))
    return out.withColumn(flag, shared).drop(*hits)


def mark_shared(df: DataFrame, slots: Sequence[Column], flag: str) -> DataFrame:
    """Add a boolean telling whether a row shares one of its hash slots with another row.

    Rows that share no slot need no further comparison.  While the repeated hashes are small enough
    to broadcast, the wide rows are matched against them without a shuffle.
    """
    return _mark(df, slots, shared_slots(df, slots), flag)


def only_shared(df: DataFrame, slots: Sequence[Column]) -> DataFrame:
    """Rows that share a slot; see ``mark_shared``."""
    return mark_shared(df, slots, "__shared").where("__shared").drop("__shared")


def stage_shared(df: DataFrame, slots: Sequence[Column]) -> DataFrame:
    """Rows that share a slot, written once for several readers."""
    found = only_shared(df, slots)
    # few rows out of many scan tasks: evened out, so that not every task writes a small file
    return stage(found.hint("rebalance"), "shared")
