"""Detectors of values in the wrong type, format or order, and profiles over time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.columns import column, is_text, value_or_null

# Formats tried for a text date, the first that fits wins.
DATE_FORMATS = (
    "yyyy-MM-dd",
    "yyyy-MM-dd HH:mm:ss",
    "yyyy-MM-dd'T'HH:mm:ss",
    "dd/MM/yyyy",
    "MM/dd/yyyy",
    "dd.MM.yyyy",
)


def parsed_date(text: Column, formats: Sequence[str] = DATE_FORMATS) -> Column:
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in formats])


def is_invalid_date(df: DataFrame, name: str, formats: Sequence[str] = DATE_FORMATS) -> Column:
    if not is_text(df, name):
        return F.lit(False)
    return column(name).isNotNull() & parsed_date(F.trim(column(name)), formats).isNull()


def invalid_dates(df: DataFrame, name: str, formats: Sequence[str] = DATE_FORMATS) -> DataFrame:
    """Rows with a non-null text that fits none of the formats."""
    return df.where(is_invalid_date(df, name, formats))


def type_inconsistency(df: DataFrame, name: str, type_name: str = "double", min_share: float = 0.5) -> DataFrame:
    """(value, rows): values that fail the cast in a text column most of whose values pass it.

    The share is one aggregate without a shuffle of values; only failing values are grouped.
    """
    text = column(name)
    passes = F.trim(text).try_cast(type_name).isNotNull()
    share = df.agg(F.count_if(passes) / F.greatest(F.count(text), F.lit(1)))
    failing = df.where(text.isNotNull() & ~passes & (share.scalar() >= min_share))
    return failing.groupBy(text.alias("value")).agg(F.count(F.lit(1)).alias("rows"))


def date_consistency(df: DataFrame, start: str, end: str) -> DataFrame:
    """Rows whose end lies before their start."""
    return df.where(column(end) < column(start))


def date_consistency_across(
    left: DataFrame, right: DataFrame, left_key: str, right_key: str, start: str, end: str
) -> DataFrame:
    """Joined rows whose end (left table) lies before their start (right table)."""
    return left.join(right, column(left_key) == column(right_key)).where(column(end) < column(start))


def pattern_check(df: DataFrame, name: str, pattern: str) -> DataFrame:
    """Rows with a non-null value that the whole pattern does not match."""
    return df.where(~column(name).rlike(rf"\A(?:{pattern})\z"))


def temporal_profile(df: DataFrame, date: str, value: str, unit: str = "day") -> DataFrame:
    """Rows and value statistics per period."""
    v = value_or_null(df, value)
    return df.groupBy(F.date_trunc(unit, column(date)).alias("period")).agg(
        F.count(F.lit(1)).alias("rows"),
        F.count(v).alias("values"),
        F.sum(v).alias("total"),
        F.avg(v).alias("mean"),
        F.min(v).alias("min"),
        F.max(v).alias("max"),
    )
