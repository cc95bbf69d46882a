"""Detectors of exact, partial and near duplicates."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.columns import (
    column,
    floor_to,
    groupable,
    is_absent,
    is_groupable,
    micros,
    null_safe_equal,
    quoted,
    row_digest,
)
from ..functions.groups import only_shared
from ..functions.scan import carry_forward
from ..functions.staging import stage

# Time buckets whose neighbours are looked up together.
SPAN = 1_024


def _keyed(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Grouping columns in groupable form, under their own names."""
    return df.select(*[groupable(df, n).alias(n) for n in names])


def duplicate_rows(df: DataFrame, columns: Sequence[str] | None = None, prune: bool = True) -> DataFrame:
    """Every pattern that occurs more than once, with its number of copies; nulls are equal.

    ``prune`` first drops rows whose hash occurs once, so that only candidates are shuffled as
    whole rows; equality is decided on the real columns.  Copies of one hot row collapse on the
    map side in both passes.
    """
    names = list(columns or df.columns)
    rows = _keyed(df, names)
    if prune:
        rows = only_shared(rows, [F.xxhash64(*[quoted(n) for n in names])])
    copies = rows.groupBy(*[quoted(n) for n in names]).agg(F.count(F.lit(1)).alias("copies"))
    return copies.where("copies > 1")


exact_duplicates = duplicate_rows


def duplicate_groups(df: DataFrame, columns: Sequence[str] | None = None, prune: bool = True) -> DataFrame:
    """One row: rows that belong to a group of identical rows, and number of such groups."""
    return duplicate_rows(df, columns, prune).agg(
        F.coalesce(F.sum("copies"), F.lit(0)).alias("rows_involved"),
        F.count(F.lit(1)).alias("duplicate_groups"),
    )


def duplicates_on_subset(df: DataFrame, subset: Sequence[str]) -> DataFrame:
    """All rows that share the key columns with another row.

    A small set of repeated keys is broadcast and the wide table not shuffled; a large set is
    joined by shuffle, where AQE splits a hot key.
    """
    repeated = duplicate_rows(df, subset, prune=False).drop("copies")
    if all(not f.nullable and is_groupable(df, f.name) for f in df.schema if f.name in subset):
        return df.join(stage(repeated, "duplicate-keys"), list(subset), "left_semi")
    keys = stage(repeated.select(*[column(n).alias(f"__key{i}") for i, n in enumerate(subset)]), "duplicate-keys")
    same = [groupable(df, n).eqNullSafe(F.col(f"__key{i}")) for i, n in enumerate(subset)]
    return df.join(keys, reduce(lambda a, b: a & b, same), "left_semi")


def distinct_rows(df: DataFrame) -> DataFrame:
    """One row of each set of identical rows, maps included; copies collapse before the shuffle."""
    if all(is_groupable(df, c) for c in df.columns):
        return df.dropDuplicates()
    keys = [groupable(df, c).alias(f"__key{i}") for i, c in enumerate(df.columns)]
    kept = F.first(F.struct(*[column(c).alias(f"c{i}") for i, c in enumerate(df.columns)])).alias("row")
    rows = df.groupBy(*keys).agg(kept)
    return rows.select(*[F.col(f"row.c{i}").alias(c) for i, c in enumerate(df.columns)])


def near_duplicate_buckets(df: DataFrame, ts: str, seconds: float = 1.0, key: str | None = None) -> DataFrame:
    """Rows equal in all columns but ``ts``, counted per time bucket as wide as the tolerance.

    Two rows in one bucket are always within the tolerance, and a bucket can only be linked to the
    one next to it: when its first moment is within the tolerance of the previous bucket's last.
    So no group has to be sorted as a whole, and one that holds a third of the table is spread over
    its times.  Rows without a timestamp never pair.  The other columns are told apart by a digest of
    128 bits, so each row is shuffled as a few numbers, from one scan.

    Output: the digest ``g0`` and ``g1``, ``bucket``, ``rows``, ``first_us``, ``last_us``, the booleans
    ``linked_before`` and ``linked_after``, ``previous_us`` (the last moment before, of a linked bucket), and ``example`` (smallest key) when ``key`` is given.
    """
    width = int(round(seconds * 1_000_000))
    moment = micros(column(ts))
    moments = df.where(column(ts).isNotNull()).select(
        *row_digest(df, [c for c in df.columns if c != ts]),
        moment.alias("__us"),
        floor_to(moment, width).alias("bucket"),
        *([column(key).alias("__id")] if key else []),
    )
    return link_buckets(moments, ["g0", "g1"], width, "__id" if key else None)


def involved() -> Column:
    """Whether a bucket's rows take part in a pair."""
    return (F.col("rows") > 1) | F.col("linked_before") | F.col("linked_after")


def link_buckets(moments: DataFrame, names: Sequence[str], width: int, key: str | None = None) -> DataFrame:
    """Buckets of each group with their links, from rows with ``names``, ``bucket`` and ``__us``.

    Buckets next to one another meet in spans of SPAN buckets; those at the edge of a span also
    stand in the one beyond.
    """
    example = [F.min(column(key)).alias("example")] if key else []
    counted = moments.groupBy(*names, "bucket").agg(
        F.count(F.lit(1)).alias("rows"),
        F.min("__us").alias("first_us"),
        F.max("__us").alias("last_us"),
        *example,
    )
    bucket, span = F.col("bucket"), floor_to(F.col("bucket"), SPAN)
    at = F.pmod(bucket, F.lit(SPAN))
    beyond = F.when(at == 0, span - 1).when(at == SPAN - 1, span + 1)
    spans = F.filter(F.array(span, beyond), lambda s: s.isNotNull())
    spread = counted.withColumn("__own", span).withColumn("__span", F.explode(spans))
    # at most SPAN + 2 buckets stand in one window
    window = Window.partitionBy(*names, "__span").orderBy("bucket")
    before, after = (f(F.struct("bucket", "first_us", "last_us")).over(window) for f in (F.lag, F.lead))
    linked_before = (before["bucket"] == bucket - 1) & (F.col("first_us") - before["last_us"] <= width)
    linked_after = (after["bucket"] == bucket + 1) & (after["first_us"] - F.col("last_us") <= width)
    met = spread.select(
        "*",
        F.when(linked_before, before["last_us"]).alias("previous_us"),
        F.coalesce(linked_before, F.lit(False)).alias("linked_before"),
        F.coalesce(linked_after, F.lit(False)).alias("linked_after"),
    )
    return met.where(F.col("__own") == F.col("__span")).drop("__own", "__span")


def near_duplicates(df: DataFrame, ts: str, seconds: float = 1.0) -> DataFrame:
    """One row: pairs of consecutive rows within the tolerance, and distinct rows in such pairs."""
    return summarise_near(near_duplicate_buckets(df, ts, seconds))


def summarise_near(buckets: DataFrame) -> DataFrame:
    return buckets.agg(
        F.coalesce(F.sum(F.col("rows") - 1 + F.col("linked_before").cast("int")), F.lit(0)).alias("pairs"),
        F.coalesce(F.sum(F.when(involved(), F.col("rows"))), F.lit(0)).alias("rows_involved"),
    )


def near_duplicate_rows(df: DataFrame, ts: str, seconds: float = 1.0) -> DataFrame:
    """The rows of ``df`` that take part in a pair, distinct patterns with their number of copies.

    Digests find the buckets; only the rows in those are joined back whole, and the links are then found
    again on their real columns.
    """
    width = int(round(seconds * 1_000_000))
    others = [c for c in df.columns if c != ts]
    hits = stage(near_duplicate_buckets(df, ts, seconds).where(involved()).select("g0", "g1", "bucket"), "near")
    moment = micros(column(ts))
    timed = df.where(column(ts).isNotNull()).select(
        F.struct(*[column(c).alias(f"c{i}") for i, c in enumerate(df.columns)]).alias("row"),
        *[groupable(df, c).alias(f"k{i}") for i, c in enumerate(others)],
        *row_digest(df, others),
        moment.alias("__us"),
        floor_to(moment, width).alias("bucket"),
    )
    found = stage(timed.join(hits, ["g0", "g1", "bucket"], "left_semi").drop("g0", "g1"), "near-rows")
    names = [f"k{i}" for i in range(len(others))]
    linked = link_buckets(found, names, width).where(involved()).select(*names, "bucket")
    copies = found.groupBy(*names, "bucket", "__us").agg(F.count(F.lit(1)).alias("copies"), F.first("row").alias("row"))
    met = copies.join(linked, null_safe_equal(copies, linked, [*names, "bucket"]), "left_semi")
    return met.select(*[F.col(f"row.c{i}").alias(c) for i, c in enumerate(df.columns)], "copies")


def collapse_near(df: DataFrame, ts: str, seconds: float, merged: Mapping[str, Callable[[Column], Column]]) -> DataFrame:
    """One row per chain of linked rows, at its first moment; ``merged`` has what becomes of some columns.

    Each function gets the number of rows of the chain.  Three scans: digests and times, the rows outside
    chains, and the rows at the beginning of a chain.  Where a chain begins is carried forward over its
    buckets by a parallel scan, so a chain may be of any length.
    """
    width = int(round(seconds * 1_000_000))
    digest = row_digest(df, [c for c in df.columns if c != ts])
    linked = stage(near_duplicate_buckets(df, ts, seconds).where(involved()), "near")
    start = F.when(~F.col("linked_before"), F.col("bucket"))
    chained = stage(carry_forward(linked, start, ["g0", "g1"], [F.col("bucket")], "start"), "chained")
    chains = chained.groupBy("g0", "g1", F.col("start").alias("bucket")).agg(
        F.min("first_us").alias("__first"), F.sum("rows").alias("__rows")
    )
    own = ["g0", "g1", "bucket"]
    chains = stage(chained.select(*own).join(chains, own, "left"), "chains")
    moment = micros(column(ts))
    placed = df.select(*[column(c) for c in df.columns], *digest, floor_to(moment, width).alias("bucket"))
    alone = placed.join(chains, own, "left_anti")

    def out(c: str, rows: Column) -> Column:
        return (merged[c](rows) if c in merged else column(c)).alias(c)

    # rows of a chain at its first moment are copies of one another; one of them stays
    opening = placed.join(chains.where("__first IS NOT NULL"), own).where(micros(column(ts)) == F.col("__first"))
    row = F.struct(*[out(c, F.col("__rows")).alias(f"c{i}") for i, c in enumerate(df.columns)])
    opened = opening.groupBy(*own).agg(F.first(row).alias("row"))
    return alone.select(*[out(c, F.lit(1)) for c in df.columns]).unionByName(
        opened.select(*[F.col(f"row.c{i}").alias(c) for i, c in enumerate(df.columns)])
    )


def duplicate_key_conflicts(df: DataFrame, key: str, attributes: Sequence[str]) -> DataFrame:
    """Per repeated key: rows, distinct values of each attribute, and whether all rows are copies.

    Distinct values are counted by grouping on (key, attribute, value) first, so neither a set nor
    an expanded row per attribute is ever held for one key.  A null counts as a value.
    """
    repeated = df.where(~is_absent(df, key)).groupBy(quoted(key)).agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")
    repeated = stage(repeated, "repeated-keys")
    rows = df.join(repeated.select(quoted(key)), key, "left_semi")
    values = rows.select(
        column(key).alias("key"),
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(i).alias("slot"), groupable(df, a).cast("string").alias("value"))
                    for i, a in enumerate(attributes)
                ]
            )
        ),
    )
    distinct = values.groupBy("key", "slot", "value").agg(F.count(F.lit(1)).alias("n"))
    per_key = distinct.groupBy("key").agg(
        *[F.count_if(F.col("slot") == i).alias(f"{a}_values") for i, a in enumerate(attributes)]
    )
    patterns = duplicate_rows(rows, prune=False).groupBy(quoted(key)).agg(F.sum("copies").alias("copied"))
    out = repeated.join(patterns, key, "left").join(per_key.withColumnRenamed("key", key), key, "left")
    return out.select(
        quoted(key),
        "rows",
        *[quoted(f"{a}_values") for a in attributes],
        (F.coalesce("copied", F.lit(0)) == F.col("rows")).alias("exact_copies"),
    )
