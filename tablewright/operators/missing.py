"""Detectors of missing values and of their pattern over time."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.columns import column, is_absent
from ..functions.issues import ratio_of
from ..functions.missing import MISSING_TOKENS, is_missing


def missing_values(df: DataFrame, name: str, tokens: Sequence[str] = MISSING_TOKENS) -> DataFrame:
    """Rows whose value is null, blank or a token that stands for null."""
    return df.where(is_missing(df, name, tokens))


def any_absent(df: DataFrame, names: Sequence[str]) -> Column:
    return reduce(lambda a, b: a | b, [is_absent(df, n) for n in names])


def missing_values_any(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Rows in which at least one of the columns is null."""
    return df.where(any_absent(df, names))


def missing_by_period(df: DataFrame, name: str, date: str, unit: str = "day") -> DataFrame:
    """Per period: rows, missing values, their share in the period and in the whole table.

    The table's total is one number, counted in its own narrow pass.
    """
    per = df.groupBy(F.date_trunc(unit, column(date)).alias("period")).agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(is_absent(df, name)).alias("missing_count")
    )
    total = df.agg(F.count(F.lit(1))).scalar()
    return per.withColumn("missing_percent", F.col("missing_count") * 100.0 / F.col("rows")).withColumn(
        "missing_percent_of_table", F.col("missing_count") * 100.0 / total
    )


def missing_span(df: DataFrame, name: str, date: str) -> DataFrame:
    """First date, last date and number of the rows that miss a value."""
    moment = column(date)
    return df.where(is_absent(df, name)).agg(
        F.min(moment).alias("first"), F.max(moment).alias("last"), F.count(moment).alias("rows")
    )


def missing_weekday_weekend(df: DataFrame, name: str, date: str) -> DataFrame:
    """Missing rate at weekends against working days; rows without a date belong to neither."""
    weekend = F.dayofweek(column(date)).isin(1, 7)
    out = (
        df.where(column(date).isNotNull())
        .groupBy(F.when(weekend, "weekend").otherwise("weekday").alias("day_kind"))
        .agg(F.count(F.lit(1)).alias("rows"), F.count_if(is_absent(df, name)).alias("missing_count"))
    )
    return out.withColumn("missing_percent", ratio_of(F.col("missing_count"), F.col("rows")) * 100.0)
