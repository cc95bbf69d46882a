"""Repairs.  Each returns the repaired table; ``change_preview`` and ``correction_report`` show what changed."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.columns import (
    column,
    is_absent,
    is_numeric,
    is_text,
    quoted,
    to_long_form,
    value_or_null,
)
from ..functions.groups import first_per_group
from ..functions.missing import is_missing
from ..functions.scan import carry_forward
from ..functions.staging import stage
from ..functions.text import collapse_blanks, spelling_key, title_case
from .duplicates import collapse_near, distinct_rows
from .formats import DATE_FORMATS, parsed_date
from .outliers import exact_quantiles, iqr_fences, outside


def replace_column(df: DataFrame, name: str, value: Column, keep_before: str | None = None) -> DataFrame:
    """Put a repaired value in place of a column; ``keep_before`` names a column for the old value."""
    out = df.withColumn(keep_before, column(name)) if keep_before else df
    return out.withColumn(name, value)


def fill_default(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Null becomes 0 in numeric and '' in text columns; other types stay."""
    out = df
    for c in columns or df.columns:
        if is_numeric(df, c):
            out = out.withColumn(c, F.coalesce(value_or_null(df, c), F.lit(0).cast(df.schema[c].dataType)))
        elif is_text(df, c):
            out = out.withColumn(c, F.coalesce(column(c), F.lit("")))
    return out


def most_frequent_value(df: DataFrame, name: str):
    """Most frequent non-null value, the smallest on a tie; counted by Spark, one value returned."""
    counts = df.where(~is_absent(df, name)).groupBy(column(name).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    top = counts.orderBy(F.desc("n"), "v").first()
    return None if top is None else top["v"]


def statistic_of(df: DataFrame, name: str, strategy: str):
    if strategy == "median":
        return exact_quantiles(df, name, [0.5])[0]
    if strategy == "mean":
        return df.agg(F.avg(value_or_null(df, name))).first()[0]
    if strategy == "mode":
        return most_frequent_value(df, name)
    raise ValueError(f"unknown fill strategy: {strategy}")


def fill_statistic(df: DataFrame, strategies: Mapping[str, str]) -> DataFrame:
    """Null becomes the median, mean or mode of its column."""
    out = df
    for name, strategy in strategies.items():
        fill = statistic_of(df, name, strategy)
        if fill is None:
            continue
        if strategy == "mode":
            out = out.withColumn(name, F.coalesce(value_or_null(df, name), F.lit(fill).cast(df.schema[name].dataType)))
        else:
            out = out.withColumn(name, F.coalesce(value_or_null(df, name).cast("double"), F.lit(fill).cast("double")))
    return out


def fill_report(before: DataFrame, names: Sequence[str], tokens: Sequence[str] | None = None) -> DataFrame:
    """(column, filled): how many values a fill of these columns replaces."""
    test = (lambda c: is_missing(before, c, tokens)) if tokens is not None else (lambda c: is_absent(before, c))
    counted = before.agg(*[F.count_if(test(c)).alias(f"n{i}") for i, c in enumerate(names)])
    return to_long_form(counted, [{"column": F.lit(c), "filled": F.col(f"n{i}")} for i, c in enumerate(names)])


def fill_forward(df: DataFrame, name: str, group: Sequence[str], ts: str, tie: Sequence[str] = ()) -> DataFrame:
    """Null becomes the last non-null value of the group in time order; rows without a time come first.

    A parallel prefix scan: rows are dealt by ranges of (group, time, tie), so no group is a task's alone.
    """
    order = [column(ts), *[column(t) for t in tie]]
    out = carry_forward(df, value_or_null(df, name), group, order, "__filled")
    return out.select(*[F.col("__filled").alias(c) if c == name else column(c) for c in df.columns])


def most_frequent_per_key(df: DataFrame, key: Column, value: Column) -> DataFrame:
    """(key, value): the most frequent value of each key, the smallest on a tie."""
    counts = df.groupBy(key.alias("key"), value.alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return first_per_group(counts, ["key"], [F.desc("n"), F.col("value")]).drop("n")


def fill_lookup(
    df: DataFrame, name: str, key: str, lookup: DataFrame | None = None, tokens: Sequence[str] | None = None
) -> DataFrame:
    """Missing value becomes the value known for another column of the row.

    ``lookup`` has columns (key, value) with one row per key; by default it holds the most frequent
    present value of each key.  ``tokens`` extends what counts as missing.
    """
    absent = is_absent(df, name) if tokens is None else is_missing(df, name, tokens)
    if lookup is None:
        present = df.where(~absent & column(key).isNotNull())
        lookup = most_frequent_per_key(present, column(key), column(name))
    side = stage(lookup, "lookup").select(F.col("key").alias("__key"), F.col("value").alias("__value"))
    out = df.join(side, column(key) == F.col("__key"), "left")
    filled = F.when(absent, F.coalesce("__value", column(name))).otherwise(column(name))
    return out.withColumn(name, filled).drop("__key", "__value")


def drop_duplicates(df: DataFrame) -> DataFrame:
    """One row of each set of identical rows."""
    return distinct_rows(df)


def dedupe_by_key(df: DataFrame, key: Sequence[str], order: Sequence[str], keep: str = "first") -> DataFrame:
    """First or last row per key in the order of the given columns."""
    columns = [column(c).asc_nulls_last() if keep == "first" else column(c).desc_nulls_last() for c in order]
    return first_per_group(df, list(key), columns)


def collapse_near_duplicates(
    df: DataFrame, ts: str, seconds: float = 1.0, sum_columns: Sequence[str] = ()
) -> DataFrame:
    """One row per chain of rows that differ only in time and follow each other within the tolerance.

    The earliest moment stays; ``sum_columns`` are added up over the chain.  Rows that are linked to no other pass
    unchanged, and so do rows without a time.
    """

    def total(c: str):
        return lambda rows: _total(column(c), rows, df.schema[c].dataType)

    return collapse_near(df, ts, seconds, {c: total(c) for c in sum_columns})


def _total(value: Column, times: Column, kind: T.DataType) -> Column:
    """A sum of equal values in the type of a sum: long for whole numbers, double for floating ones."""
    if isinstance(kind, T.IntegralType):
        return value.cast("long") * times
    return value.cast("double") * times if isinstance(kind, T.FloatType) else (value * times).cast(kind)


def cast_types(df: DataFrame, types: Mapping[str, str]) -> DataFrame:
    """Cast columns to declared types; what does not fit becomes null."""
    return df.withColumns({c: F.trim(column(c)).try_cast(t) if is_text(df, c) else column(c).try_cast(t) for c, t in types.items()})


def cast_report(df: DataFrame, types: Mapping[str, str]) -> DataFrame:
    """(column, type, lost): values a cast turns into null."""
    after = cast_types(df.select(*[quoted(c) for c in df.columns], *[column(c).alias(f"__old{i}") for i, c in enumerate(types)]), types)
    lost = [
        F.count_if(F.col(f"__old{i}").isNotNull() & column(c).isNull()).alias(f"n{i}") for i, c in enumerate(types)
    ]
    return to_long_form(
        after.agg(*lost),
        [{"column": F.lit(c), "type": F.lit(t), "lost": F.col(f"n{i}")} for i, (c, t) in enumerate(types.items())],
    )


def parse_dates(df: DataFrame, name: str, formats: Sequence[str] = DATE_FORMATS) -> DataFrame:
    """Text becomes a timestamp under the first format that fits; otherwise null."""
    return df.withColumn(name, parsed_date(F.trim(column(name)), formats))


def trim_collapse(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({c: collapse_blanks(column(c)) for c in columns})


def standardize_canonical(df: DataFrame, name: str, canonical: str, variants: Sequence[str]) -> DataFrame:
    """Every listed variant becomes the canonical value."""
    c = column(name)
    return df.withColumn(name, F.when(c.isin(*variants), F.lit(canonical)).otherwise(c))


def _apply_deviants(df: DataFrame, name: str, deviants: DataFrame) -> DataFrame:
    """Replace values through a table (from, to) of those that change.

    Only deviating values are in it, so it is mostly small.  Staged tables have a known size: Spark
    broadcasts a small one without shuffling the wide table first; otherwise the join shuffles and
    AQE splits hot values.
    """
    side = stage(deviants, "deviants").select(F.col("from").alias("__from"), F.col("to").alias("__to"))
    out = df.join(side, column(name) == F.col("__from"), "left")
    return out.withColumn(name, F.coalesce("__to", column(name))).drop("__from", "__to")


def most_frequent_spellings(df: DataFrame, name: str) -> DataFrame:
    """(from, to) for spellings that are not the most frequent of their case and space group."""
    text = column(name)
    counts = df.where(text.isNotNull()).groupBy(text.alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return _deviants(counts, [F.desc("n"), F.col("value")])


def _deviants(spellings: DataFrame, order: Sequence[Column]) -> DataFrame:
    keyed = spellings.withColumn("group", spelling_key(F.col("value")))
    best = first_per_group(keyed, ["group"], order).select("group", F.col("value").alias("to"))
    # the count is never 0; asking for it keeps both sides on the same aggregate and exchange
    return keyed.where("n > 0").join(best, "group").where("value <> to").select(F.col("value").alias("from"), "to")


def standardize_most_frequent(df: DataFrame, name: str, within: Column | None = None) -> DataFrame:
    """Within values equal up to case and spacing, the most frequent spelling (smallest on a tie).

    ``within`` is a test on the value: other values take no part and stay.
    """
    rows = df if within is None else df.where(within)
    return _apply_deviants(df, name, most_frequent_spellings(rows, name))


def standardize_most_recent(df: DataFrame, name: str, ts: str) -> DataFrame:
    """Same groups, the spelling seen last (largest on a tie)."""
    text = column(name)
    latest = df.where(text.isNotNull()).groupBy(text.alias("value"))
    latest = latest.agg(F.max(column(ts)).alias("last"), F.count(F.lit(1)).alias("n"))
    return _apply_deviants(df, name, _deviants(latest, [F.desc_nulls_last("last"), F.desc("value")]))


def standardize_title_case(df: DataFrame, name: str) -> DataFrame:
    return df.withColumn(name, title_case(column(name)))


def replace_mapping(df: DataFrame, name: str, mapping: Mapping[str, str]) -> DataFrame:
    """Replace values by a dictionary; others stay, and so do nulls, whatever the dictionary says of them."""
    side = df.sparkSession.createDataFrame(list(mapping.items()), "from string, to string")
    return _apply_deviants(df, name, side)


def canonical_categories(df: DataFrame, entity: str, category: str) -> DataFrame:
    """(key, value): the most frequent category of every entity that has several.

    An entity has several when its best count is below its total, so both sides of the join need
    the same counts and Spark reuses one exchange.
    """
    present = df.where(column(category).isNotNull() & column(entity).isNotNull())
    counts = present.groupBy(column(entity).alias("key"), column(category).alias("value")).agg(
        F.count(F.lit(1)).alias("n")
    )
    totals = counts.groupBy("key").agg(F.sum("n").alias("total"))
    best = first_per_group(counts, ["key"], [F.desc("n"), F.col("value")])
    return best.join(totals, "key").where("n < total").select("key", "value")


def canonical_category(df: DataFrame, entity: str, category: str, fill_nulls: bool = False) -> DataFrame:
    """One category per entity, the most frequent; rows that differ are reclassified."""
    return reclassify(df, entity, category, canonical_categories(df, entity, category), fill_nulls)


def reclassify(
    df: DataFrame, entity: str, category: str, canonical: DataFrame, fill_nulls: bool = False
) -> DataFrame:
    """Set the category of the entities in ``canonical`` (key, value); rows without one keep null by default."""
    side = stage(canonical, "canonical").select(
        F.col("key").alias("__key"), F.col("value").alias("__value")
    )
    out = df.join(side, column(entity) == F.col("__key"), "left")
    value = F.coalesce("__value", column(category))
    if not fill_nulls:
        value = F.when(column(category).isNotNull(), value)
    return out.withColumn(category, value).drop("__key", "__value")


def cap_outliers(
    df: DataFrame, name: str, factor: float = 1.5, fences: tuple[float, float] | None = None
) -> DataFrame:
    """Clip to the quartile fences; nulls stay."""
    fences = fences or iqr_fences(df, name, factor)
    if fences is None:
        return df
    c = column(name)
    capped = F.when(c < fences[0], F.lit(fences[0])).when(value_or_null(df, name) > fences[1], F.lit(fences[1]))
    return df.withColumn(name, capped.otherwise(c))


def remove_outliers(
    df: DataFrame, name: str, factor: float = 1.5, fences: tuple[float, float] | None = None
) -> DataFrame:
    """Drop rows beyond the quartile fences; nulls stay."""
    beyond = outside(df, name, fences or iqr_fences(df, name, factor))
    return df.where(F.coalesce(~beyond, F.lit(True)))


def change_preview(df: DataFrame, before: str, after: str) -> DataFrame:
    """(before, after, rows): the distinct changes between two columns."""
    old, new = column(before), column(after)
    changed = df.where(~old.eqNullSafe(new))
    return changed.groupBy(old.alias("before"), new.alias("after")).agg(F.count(F.lit(1)).alias("rows"))


def correction_report(df: DataFrame, pairs: Sequence[tuple[str, str]], kept: Column | None = None) -> DataFrame:
    """(column, rows_before, rows_after, changes) from columns before and after repair, in one scan.

    ``kept`` tells which rows survive the repair; changes are counted over those.
    """
    alive = F.lit(True) if kept is None else F.coalesce(kept, F.lit(False))
    counted = df.agg(
        F.count(F.lit(1)).alias("rows_before"),
        F.count_if(alive).alias("rows_after"),
        *[F.count_if(alive & ~column(b).eqNullSafe(column(a))).alias(f"n{i}") for i, (b, a) in enumerate(pairs)],
    )
    return to_long_form(
        counted,
        [
            {
                "column": F.lit(a),
                "rows_before": F.col("rows_before"),
                "rows_after": F.col("rows_after"),
                "changes": F.col(f"n{i}"),
            }
            for i, (_, a) in enumerate(pairs)
        ],
    )
