"""Numeric detectors: outliers, ranges, correlation."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from math import ceil, floor

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.columns import FLOATING, column, is_numeric, type_of, value_or_null

# A rank sketch of this size is off by 0.13 % of the values at most, with a probability of 99 %.
SKETCH_SIZE, RANK_ERROR = 4_096, 0.0025
# Values of one interval that are read to the driver.
READ_LIMIT = 100_000


@dataclass
class _Search:
    """A wanted rank, and the open interval that holds it: ``below`` values lie under it and ``inside`` in it."""

    rank: int
    inside: int
    below: int = 0
    low: float | None = None
    high: float | None = None
    value: float | None = None

    def holds(self) -> Column:
        x = F.col("x")
        over = F.lit(True) if self.low is None else x > self.low
        return over if self.high is None else over & (x < self.high)

    def narrow(self, a: float, b: float, less: int, at_a: int, between: int, at_b: int) -> None:
        """Keep the part of the interval that holds the rank, by the exact counts around two of its values."""
        k = self.rank - self.below
        if k < less:
            self.high, self.inside = a, less
        elif k < less + at_a:
            self.value = a
        elif k < less + at_a + between:
            self.below, self.inside = self.below + less + at_a, between
            self.low, self.high = a, b
        elif k < less + at_a + between + at_b:
            self.value = b
        else:
            self.below += less + at_a + between + at_b
            self.low, self.inside = b, self.inside - less - at_a - between - at_b


def _sketched(inside: Column, shares: Sequence[float]) -> Column:
    """Values around each share of the values of ``x`` for which ``inside`` holds, two for each, from one rank sketch."""
    x = F.when(inside, F.col("x"))
    probes = [min(1.0, max(0.0, s + d)) for s in shares for d in (-RANK_ERROR, RANK_ERROR)]
    found = F.kll_sketch_get_quantile_double(F.kll_sketch_agg_double(x, F.lit(SKETCH_SIZE)), F.array(*map(F.lit, probes)))
    return F.when(F.count(x) > 0, found)


def _narrow(values: DataFrame, searches: Sequence[_Search], bounds: Sequence[tuple[float, float]]) -> None:
    """Count once, exactly, around the bounds of every search."""
    x = F.col("x")
    aggs = []
    for s, (a, b) in zip(searches, bounds):
        tests = [x < a, x == a, (x > a) & (x < b), (x == b) & (b > a)]
        aggs += [F.count_if(s.holds() & t) for t in tests]
    counts = values.agg(*aggs).first()
    for i, (s, (a, b)) in enumerate(zip(searches, bounds)):
        s.narrow(a, b, *counts[4 * i : 4 * i + 4])


def _read(values: DataFrame, searches: Sequence[_Search]) -> None:
    """Read the values of all narrow intervals at once: at most READ_LIMIT for each search."""
    hit = reduce(lambda a, b: a | b, [s.holds() for s in searches])
    counted = sorted(values.where(hit).groupBy("x").agg(F.count(F.lit(1)).alias("n")).collect())
    for s in searches:
        left = s.rank - s.below
        for x, n in counted:
            if (s.low is None or x > s.low) and (s.high is None or x < s.high):
                if left < n:
                    s.value = x
                    break
                left -= n


def order_statistics(
    values: DataFrame, total: int, ranks: Sequence[int], around: Mapping[int, tuple[float, float]] | None = None
) -> dict[int, _Search]:
    """The value of column ``x`` (without nulls) at every rank, from 0.

    ``around`` may have two values near each rank, from a sketch taken before.  One pass counts exactly what lies below, at
    and between them, and one pass reads what is left between.  An interval that still holds more than
    READ_LIMIT values gets a sketch of its own first, which leaves a few thousandths of it.
    """
    searches = {rank: _Search(rank, total) for rank in ranks}
    if around:
        _narrow(values, list(searches.values()), [around[rank] for rank in searches])
    while wide := [s for s in searches.values() if s.value is None and s.inside > READ_LIMIT]:
        shares = [(s.rank - s.below + 0.5) / s.inside for s in wide]
        bounds = values.agg(*[_sketched(s.holds(), [share]).alias(f"q{i}") for i, (s, share) in enumerate(zip(wide, shares))])
        _narrow(values, wide, [tuple(q) for q in bounds.first()])
    if narrow := [s for s in searches.values() if s.value is None]:
        _read(values, narrow)
    return searches


def exact_quantiles(df: DataFrame, name: str, probabilities: Sequence[float]) -> list[float | None]:
    """Quantiles with linear interpolation, exact; only scalars and narrow intervals reach the driver.

    One mergeable sketch gives values around all wanted ranks, in the scan that counts the values; see
    ``order_statistics`` for the rest.
    """
    values = df.select(value_or_null(df, name).cast("double").alias("x")).where("x IS NOT NULL")
    total, found = values.agg(F.count("x"), _sketched(F.lit(True), probabilities)).first()
    if total == 0:
        return [None] * len(probabilities)
    ends = [(floor((total - 1) * p), ceil((total - 1) * p)) for p in probabilities]
    around = {rank: (found[2 * i], found[2 * i + 1]) for i, pair in enumerate(ends) for rank in pair}
    searches = order_statistics(values, total, list(around), around)
    out = []
    for p, (low, high) in zip(probabilities, ends):
        first, second, position = searches[low].value, searches[high].value, (total - 1) * p
        out.append(first if first == second else (high - position) * first + (position - low) * second)
    return out


def iqr_fences(df: DataFrame, name: str, factor: float = 1.5) -> tuple[float, float] | None:
    """Lower and upper fence, or None when the column holds no value."""
    q1, q3 = exact_quantiles(df, name, [0.25, 0.75])
    if q1 is None:
        return None
    return q1 - factor * (q3 - q1), q3 + factor * (q3 - q1)


def outside(df: DataFrame, name: str, fences: tuple[float, float] | None) -> Column:
    """Value beyond the fences; null for a missing value.

    The bounds are literals and stand in a conjunct of their own, so the scan can skip on them.
    """
    return F.lit(False) if fences is None else _beyond(df, name, *fences)


def _beyond(df: DataFrame, name: str, low: float | None, high: float | None) -> Column:
    c = column(name)
    tests = ([c < low] if low is not None else []) + ([c > high] if high is not None else [])
    if not tests:
        return F.lit(False)
    beyond = reduce(lambda a, b: a | b, tests)
    return beyond & ~F.isnan(c) if isinstance(type_of(df, name), FLOATING) else beyond


def outliers_iqr(df: DataFrame, name: str, factor: float = 1.5, fences: tuple[float, float] | None = None) -> DataFrame:
    return df.where(outside(df, name, fences or iqr_fences(df, name, factor)))


def _moments(df: DataFrame, name: str) -> DataFrame:
    c = value_or_null(df, name).cast("double")
    return df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.avg(c).alias("mean"),
        F.stddev_samp(c).alias("std"),
        F.min(c).alias("min"),
        F.max(c).alias("max"),
    )


def outliers_zscore(df: DataFrame, name: str, threshold: float = 3.0) -> DataFrame:
    """Rows whose distance from the mean exceeds ``threshold`` sample standard deviations."""
    stats = _moments(df, name).select("mean", "std").first()
    if not stats["std"]:
        return df.limit(0)
    c = value_or_null(df, name)
    return df.where(F.abs(c - stats["mean"]) / stats["std"] > threshold)


def zscore_summary(df: DataFrame, name: str, threshold: float = 3.0) -> DataFrame:
    """One row: outliers, their share of all rows, and mean, deviation and extremes of the column."""
    hits = outliers_zscore(df, name, threshold).agg(F.count(F.lit(1)).alias("n"))
    return _moments(df, name).select(
        hits.scalar().alias("outlier_count"),
        (hits.scalar() * 100.0 / F.greatest("rows", F.lit(1))).alias("outlier_percent"),
        "mean",
        "std",
        "min",
        "max",
    )


def value_range(df: DataFrame, name: str, low: float | None = None, high: float | None = None) -> DataFrame:
    """Rows with a value outside [low, high]; an open end is not tested."""
    return df.where(_beyond(df, name, low, high))


def negative_quantity(df: DataFrame, name: str) -> DataFrame:
    return df.where(column(name) < 0)


class _Gram:
    """Sums over a task's rows for every pair of columns, from products of column blocks with their masks.

    A pair counts rows that have both values: with missing values as zeros in X and ones for present values in V, V'V is
    the number of such rows, X'V the sums, X^2'V the squares and X'X the products.
    """

    def __init__(self, shifts: Sequence[float]):
        self.shifts = np.array(shifts)

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = len(self.shifts)
        n, bad, s, ss, xy = (np.zeros((size, size)) for _ in range(5))
        for batch in batches:
            columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]  # null as NaN
            raw = np.stack(columns, axis=1).astype(float) if columns else np.zeros((0, 0))
            present, endless = ~np.isnan(raw), np.isinf(raw)
            x = np.where(present & ~endless, raw - self.shifts, 0.0)
            v = present.astype(float)
            n += v.T @ v
            bad += endless.T.astype(float) @ v
            s += x.T @ v
            ss += (x * x).T @ v
            xy += x.T @ x
        i, j = np.triu_indices(size, 1)
        sums = [n[i, j], bad[i, j] + bad[j, i], s[i, j], s[j, i], ss[i, j], ss[j, i], xy[i, j]]
        columns = [pa.array(i, pa.int32()), pa.array(j, pa.int32()), *[pa.array(v) for v in sums]]
        yield pa.RecordBatch.from_arrays(columns, names=["i", "j", *GRAM])


GRAM = ("n", "endless", "sx", "sy", "sxx", "syy", "sxy")
# Rows from which a value near the middle of each column is taken; sums of distances from it lose no digits.
SHIFT_ROWS = 1_000


def column_correlation(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Pearson correlation of each pair of numeric columns over rows that have both; null where one is constant.

    One scan for any number of columns: every task sums the products of all pairs, and the sums are added up.  A task
    holds five numbers for each pair.
    """
    names = list(columns or [c for c in df.columns if is_numeric(df, c)])
    spark = df.sparkSession
    if len(names) < 2:
        return spark.createDataFrame([], "column_a string, column_b string, correlation double")
    values = df.select(*[value_or_null(df, c).cast("double").alias(f"c{i}") for i, c in enumerate(names)])
    head = values.limit(SHIFT_ROWS).toPandas().replace([np.inf, -np.inf], np.nan).median()
    parts = values.mapInArrow(_Gram(head.fillna(0.0).tolist()), "i int, j int, " + ", ".join(f"{g} double" for g in GRAM))
    total = parts.groupBy("i", "j").agg(*[F.sum(g).alias(g) for g in GRAM])
    n, sx, sy, sxx, syy, sxy = (F.col(g) for g in ("n", "sx", "sy", "sxx", "syy", "sxy"))

    def spread(square: Column, single: Column) -> Column:
        """Sum of squares around the mean, 0 where it is nothing but rounding."""
        around = square - single * single / n
        return F.when(around > square * 1e-13, around).otherwise(F.lit(0.0))

    r = F.try_divide(sxy - sx * sy / n, F.sqrt(spread(sxx, sx)) * F.sqrt(spread(syy, sy)))
    clipped = F.when(r > 1, 1.0).when(r < -1, -1.0).otherwise(r)
    known = F.when(F.col("endless") > 0, F.lit(float("nan"))).when(n > 0, clipped)
    labels = F.array(*[F.lit(c) for c in names])
    one = lambda k: F.get(labels, F.col(k))
    pairs = spark.range(len(names)).select(F.col("id").cast("int").alias("i"))
    pairs = pairs.select("i", F.explode(F.sequence(F.col("i") + 1, F.lit(len(names)))).alias("j")).where(F.col("j") < len(names))
    found = pairs.join(total, ["i", "j"], "left")
    return found.select(one("i").alias("column_a"), one("j").alias("column_b"), known.alias("correlation"))
