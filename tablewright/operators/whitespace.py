"""Detectors of stray blanks.  The three rules differ on purpose and stay apart."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.columns import column, is_text
from ..functions.text import has_edge_blanks, has_stray_blanks, strip


def has_edge_or_double_blanks(text: Column) -> Column:
    """Blank ends or two spaces in a row; a single inner tab is allowed here."""
    return has_edge_blanks(text) | F.coalesce(F.contains(text, F.lit("  ")), F.lit(False))


def whitespace_normalize(df: DataFrame, name: str) -> DataFrame:
    """Rows with blank ends, runs of blanks, tabs, line ends or Unicode blanks."""
    return df.where(has_stray_blanks(column(name)))


def whitespace_edges_or_double(df: DataFrame, name: str) -> DataFrame:
    return df.where(has_edge_or_double_blanks(column(name)))


def any_edge_blanks(df: DataFrame, names: Sequence[str]) -> Column:
    tests = [has_edge_blanks(column(n)) for n in names if is_text(df, n)]
    return reduce(lambda a, b: a | b, tests, F.lit(False))


def whitespace_edges(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Rows in which any of the text columns has blank ends."""
    return df.where(any_edge_blanks(df, names))


def whitespace_kinds(df: DataFrame, name: str) -> DataFrame:
    """Rows with leading, trailing or repeated inner spaces, and which of the three."""
    c = column(name)
    blank = r"(?U)[\s\x1C-\x1F]"
    return (
        df.withColumn("leading", F.coalesce(c.rlike(rf"\A{blank}"), F.lit(False)))
        .withColumn("trailing", F.coalesce(c.rlike(rf"{blank}\z"), F.lit(False)))
        .withColumn("multiple_internal", F.coalesce(F.contains(strip(c), F.lit("  ")), F.lit(False)))
        .where("leading OR trailing OR multiple_internal")
    )
