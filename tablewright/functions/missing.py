"""What counts as a missing value."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame

from .columns import column, is_absent
from .text import is_one_of

# Trimmed spellings that stand for "no value" (exact case).
MISSING_TOKENS = ("", "NULL", "null")


def is_missing(df: DataFrame, name: str, tokens: Sequence[str] = MISSING_TOKENS) -> Column:
    """Null or NaN, or a text whose stripped form is one of ``tokens``."""
    return is_absent(df, name) | is_one_of(column(name).cast("string"), tokens)
