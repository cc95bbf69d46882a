"""Rows of a vector table that can take part in a search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.blocks import numbered


def whole(vector: str) -> Column:
    """A vector that is not null and has only finite components."""
    x = F.col(vector)
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf"))))
    return x.isNotNull() & ~F.coalesce(bad, F.lit(True))


def usable(df: DataFrame, key: str, vector: str, label: str, *others: Column, rows: Column) -> DataFrame:
    """(vec_id, vector, others..., __row) of the rows that take part, written once and numbered."""
    columns = [F.col(key).cast("bigint").alias("vec_id"), F.col(vector).cast("array<double>").alias("vector"), *others]
    return numbered(df.where(rows & F.col(key).isNotNull()).select(*columns), label)
