"""Detectors of attributes that should be constant per entity but are not.

All of them count (entity, value) pairs first.  That aggregate combines on the map side, so a hot
entity shrinks to its distinct values before anything is shuffled, and no set is gathered per entity.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..functions.columns import column, groupable, is_absent


def _pairs(df: DataFrame, entity: str, category: str, *aggs) -> DataFrame:
    """(entity, category, rows, present): ``present`` is 0 for the rows without a category.

    Filtering on that count, not on the category, leaves the aggregate as it is: the pairs and
    their totals then come from one exchange, hence one scan.
    """
    rows = df.where(~is_absent(df, entity))
    category_key = groupable(df, category)
    keys = [column(entity).alias("entity"), category_key.alias("category")]
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"), *aggs, F.count(category_key).alias("present"))


def _totals(pairs: DataFrame, *aggs) -> DataFrame:
    totals = pairs.groupBy("entity").agg(
        F.count_if(F.col("present") > 0).alias("categories"), F.sum("rows").alias("affected_rows"), *aggs
    )
    return totals.where("categories > 1")


def drifting_entities(df: DataFrame, entity: str, category: str) -> DataFrame:
    """(entity, categories, affected_rows) for entities with several distinct non-null categories.

    ``affected_rows`` counts all rows of the entity, those without a category included.
    """
    return _totals(_pairs(df, entity, category))


def category_drift(df: DataFrame, entity: str, category: str) -> DataFrame:
    """(entity, category, rows, categories, affected_rows): every category of a drifting entity."""
    pairs = _pairs(df, entity, category)
    return pairs.where("present > 0").drop("present").join(_totals(pairs), "entity")


def category_drift_cutoff(df: DataFrame, entity: str, value: str, category: str, date: str, cutoff: str) -> DataFrame:
    """For one entity: rows per category, and how many lie before and from the cutoff date."""
    moment, edge = column(date), F.lit(cutoff).cast("timestamp")
    return (
        df.where((column(entity) == value) & column(category).isNotNull())
        .groupBy(column(category).alias("category"))
        .agg(
            F.count(F.lit(1)).alias("rows"),
            F.count_if(moment < edge).alias("before_cutoff"),
            F.count_if(moment >= edge).alias("from_cutoff"),
        )
    )


def category_drift_timing(df: DataFrame, entity: str, category: str, date: str) -> DataFrame:
    """Category drift with the first and last date of each category and of the entity."""
    moment = column(date)
    pairs = _pairs(df, entity, category, F.min(moment).alias("first"), F.max(moment).alias("last"))
    totals = _totals(pairs, F.min("first").alias("entity_first"), F.max("last").alias("entity_last"))
    return pairs.where("present > 0").drop("present").join(totals, "entity")


def id_consistency(df: DataFrame, key: str, attributes: Sequence[str]) -> DataFrame:
    """(id, attribute, value, rows, values): values of an attribute that differ within one id."""
    entries = [
        F.struct(F.lit(a).alias("attribute"), groupable(df, a).cast("string").alias("value")) for a in attributes
    ]
    long = df.where(~is_absent(df, key)).select(column(key).alias("id"), F.inline(F.array(*entries)))
    counts = long.where("value IS NOT NULL").groupBy("id", "attribute", "value").agg(F.count(F.lit(1)).alias("rows"))
    totals = counts.groupBy("id", "attribute").agg(F.count("value").alias("values"))
    return counts.join(totals.where("values > 1"), ["id", "attribute"])
