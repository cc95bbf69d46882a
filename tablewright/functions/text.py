"""Text expressions shared by detectors and repairs.  All are built-in Spark functions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

# Characters that Python's str.split() and str.strip() treat as blank: the Unicode White_Space
# property plus the four ASCII separators U+001C to U+001F.
BLANK_CLASS = r"[\s\x1C-\x1F]"


def collapse_blanks(text: Column) -> Column:
    """Strip both ends and turn every run of blanks into one space."""
    return F.trim(F.regexp_replace(text, f"(?U){BLANK_CLASS}+", " "))


def strip(text: Column) -> Column:
    """Remove blanks at both ends only.

    The look-behind lets the engine try a run of blanks once, so a long inner run costs linear time.
    """
    pattern = rf"(?U)\A{BLANK_CLASS}+|(?<!{BLANK_CLASS}){BLANK_CLASS}+\z"
    return F.regexp_replace(text, pattern, "")


def has_stray_blanks(text: Column) -> Column:
    """Differs from its words joined by one space; decided by a search, without building that text."""
    b = BLANK_CLASS
    other = r"[\s\x1C-\x1F&&[^ ]]"
    return F.coalesce(text.rlike(rf"(?U)\A{b}|{b}\z|{b}{{2}}|{other}"), F.lit(False))


def has_edge_blanks(text: Column) -> Column:
    return F.coalesce(text.rlike(rf"(?U)\A{BLANK_CLASS}|{BLANK_CLASS}\z"), F.lit(False))


def is_one_of(text: Column, tokens: Sequence[str]) -> Column:
    """Whether the stripped text equals one of the tokens."""
    return strip(text).isin(*tokens) if tokens else F.lit(False)


def spelling_key(text: Column) -> Column:
    """Key under which values that differ only by case and spacing are equal."""
    return F.lower(collapse_blanks(text))


def title_case(text: Column) -> Column:
    return F.initcap(F.lower(text))


def slug(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), " ", "_")


def hash_order(seed: int, *keys: Column) -> Column:
    """A reproducible pseudo-random order of rows: hex digest of the key and a seed."""
    parts = [F.coalesce(k.cast("string"), F.lit("")) for k in keys]
    return F.md5(F.concat_ws("|", *parts, F.lit(str(seed))))
