"""Profiles: one row per column, or one row per table."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.columns import (
    FLOATING,
    TEMPORAL,
    column,
    groupable,
    is_absent,
    is_groupable,
    is_numeric,
    is_text,
    numeric_columns,
    text_columns,
    to_long_form,
    type_of,
    value_or_null,
)

CATEGORICAL_RATIO = 0.2
STATS = ("rows", "missing_count", "unique_count")
# Sentence formats of the column and dataset summaries.
COLUMN_SENTENCE = "Detected as %s. %d unique values with %d missing entries out of %d."
MISSING_SENTENCE = "%s contient %d valeurs manquantes"
NO_SIGNAL_SENTENCE = "Aucun signal de qualité majeur détecté"


def row_column_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("rows")).withColumn("columns", F.lit(len(df.columns)).cast("bigint"))


def _counting_form(df: DataFrame, name: str) -> Column:
    """A column as text or a number, so that its digest keeps distinct values distinct and equal ones equal."""
    dtype = type_of(df, name)
    c = column(name)
    if isinstance(dtype, FLOATING):
        return value_or_null(df, name).cast("double") + F.lit(0.0)  # -0.0 and 0.0 are one value
    if isinstance(dtype, (T.ArrayType, T.StructType, T.MapType, T.VariantType)):
        return groupable(df, name) if isinstance(dtype, T.MapType) else F.to_json(c)
    return c


def _digests(df: DataFrame, name: str) -> list[Column]:
    """128 bits for a value, null for a missing one."""
    value = _counting_form(df, name)
    return [F.when(~is_absent(df, name), F.xxhash64(F.lit(seed), value)) for seed in (0, 1)]


def _summed(counted: DataFrame, names: Sequence[str], *more: Column) -> DataFrame:
    """One row per column from a count per (column, digest); an empty table has rows of zeros."""
    missing = F.sum(F.when(F.col("g0").isNull(), F.col("n")))
    summed = counted.groupBy("i").agg(
        F.sum("n").alias("rows"), F.coalesce(missing, F.lit(0)).alias("missing_count"), F.count("g0").alias("unique_count"), *more
    )
    labels = F.array(*[F.lit(c) for c in names])
    every = counted.sparkSession.range(len(names)).select(F.col("id").cast("int").alias("i"))
    extra = [c for c in summed.columns if c not in ("i", *STATS)]
    stats = [F.coalesce(F.col(n), F.lit(0).cast("bigint")).alias(n) for n in STATS]
    return every.join(summed, "i", "left").select(F.get(labels, F.col("i")).alias("column"), *stats, *extra)


def _exact_stats(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Rows, missing and distinct values per column: one scan, and one shuffle of digests counted on the map side."""
    entries = [F.struct(F.lit(i).alias("i"), *[g.alias(f"g{k}") for k, g in enumerate(_digests(df, c))]) for i, c in enumerate(names)]
    long = df.select(F.inline(F.array(*entries)))
    return _summed(long.groupBy("i", "g0", "g1").agg(F.count(F.lit(1)).alias("n")), names)


class _Pass:
    """What a task finds in its rows: counts of digests, batch by batch, and each column's first rows in key order."""

    def __init__(self, columns: int, keys: int, samples: int, counts: bool):
        self.columns, self.keys, self.samples, self.counts = columns, keys, samples, counts

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first: list[pa.Table | None] = [None] * self.columns
        for batch in batches:
            if not batch.num_rows:
                continue
            row, digests = batch.column(0), batch.columns[1 + self.keys :]
            if self.counts:
                yield self._counted(row.type, digests)
            table = pa.table([row, *batch.columns[1 : 1 + self.keys]], names=self._names())
            order = pc.sort_indices(table, self._order(), null_placement="at_start").to_numpy()
            for i in range(self.columns):
                valid = digests[i * (2 if self.counts else 1)].is_valid().to_numpy(zero_copy_only=False)
                places = order[valid[order]][: self.samples]
                if len(places):
                    found = table.take(pa.array(places))
                    first[i] = found if first[i] is None else self._merged(first[i], found)
        for i, found in enumerate(first):
            if found is not None:
                yield self._entries(found.column(0).combine_chunks(), i)

    def _names(self) -> list[str]:
        return ["row", *[f"k{i}" for i in range(self.keys)]]

    def _order(self) -> list[tuple[str, str]]:
        return [(n, "ascending") for n in self._names()[1:]]

    def _merged(self, a: pa.Table, b: pa.Table) -> pa.Table:
        both = pa.concat_tables([a, b]).combine_chunks()
        return both.take(pc.sort_indices(both, self._order(), null_placement="at_start")[: self.samples])

    def _counted(self, kind: pa.DataType, digests: list[pa.Array]) -> pa.RecordBatch:
        parts = []
        for i in range(self.columns):
            g0, g1 = digests[2 * i], digests[2 * i + 1]
            valid = g0.is_valid().to_numpy(zero_copy_only=False)
            a, b = (pc.fill_null(g, 0).to_numpy()[valid] for g in (g0, g1))
            order = np.argsort(a, kind="stable")
            a, b = a[order], b[order]
            # one entry for each run of a digest; Spark adds up what several runs and batches have
            first = np.ones(len(a), bool)
            first[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
            starts = np.flatnonzero(first)
            counts = np.diff(np.append(starts, len(a)))
            parts.append((np.full(len(starts), i), a[starts], b[starts], counts, np.zeros(len(starts), bool)))
            if missing := len(valid) - len(a):
                parts.append(tuple(np.array([v]) for v in (i, 0, 0, missing, True)))
        i, a, b, n, absent = (np.concatenate(p) for p in zip(*parts))
        digest = [pa.array(g, pa.int64(), mask=absent) for g in (a, b)]
        columns = [pa.array(i, pa.int32()), *digest, pa.array(n, pa.int64()), pa.nulls(len(i), kind)]
        return pa.RecordBatch.from_arrays(columns, names=["i", "g0", "g1", "n", "row"])

    def _entries(self, rows: pa.Array, i: int) -> pa.RecordBatch:
        size = len(rows)
        none = pa.nulls(size, pa.int64())
        columns = [pa.array(np.full(size, i, np.int32)), none, none, pa.array(np.zeros(size, np.int64)), rows]
        return pa.RecordBatch.from_arrays(columns, names=["i", "g0", "g1", "n", "row"])


def _one_pass(df: DataFrame, key: Sequence[str], samples: int, counts: bool) -> DataFrame:
    """(column, rows, missing_count, unique_count, sample_values) from one scan; counts are 0 without ``counts``.

    Tasks send digests with counts, added up on the map side, and at most ``samples`` rows per column.
    """
    names = df.columns
    row = F.struct(*[column(c).alias(f"c{i}") for i, c in enumerate(names)]).alias("row")
    own = [_digests(df, c) if counts else [F.when(~is_absent(df, c), F.lit(True))] for c in names]
    flat = [g.alias(f"d{i}_{k}") for i, pair in enumerate(own) for k, g in enumerate(pair)]
    wide = df.select(row, *[column(k).alias(f"k{i}") for i, k in enumerate(key)], *flat)
    whole = T.StructType([T.StructField(f"c{i}", f.dataType) for i, f in enumerate(df.schema.fields)])
    fields = [("i", T.IntegerType()), ("g0", T.LongType()), ("g1", T.LongType()), ("n", T.LongType()), ("row", whole)]
    found = wide.mapInArrow(_Pass(len(names), len(key), samples, counts), T.StructType([T.StructField(*f) for f in fields]))
    position = {c: f"row.c{i}" for i, c in enumerate(names)}
    texts = [F.col(position[c]).cast("string") if is_groupable(df, c) else F.to_json(position[c]) for c in names]
    text = reduce(lambda t, i: t.when(F.col("i") == i, texts[i]), range(1, len(names)), F.when(F.col("i") == 0, texts[0]))
    listed = found.select("i", "g0", "g1", "n", F.struct(*[F.col(position[k]) for k in key]).alias("k"), text.alias("v"))
    counted = listed.groupBy("i", "g0", "g1", F.when(F.col("v").isNotNull(), F.col("k")).alias("k"), "v").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("copies"))
    # rows with one key and one value have met in one entry
    entry = F.when(F.col("v").isNotNull(), F.struct("k", "v", "copies"))
    each = F.flatten(F.transform(F.array_sort(F.collect_list(entry)), lambda e: F.array_repeat(e["v"], e["copies"].cast("int"))))
    return _summed(counted, names, F.slice(each, 1, samples).alias("sample_values"))


def column_stats(df: DataFrame, columns: Sequence[str] | None = None, approximate: bool = False) -> DataFrame:
    """(column, rows, missing_count, unique_count); ``approximate`` needs one pass and no shuffle of values."""
    names = list(columns or df.columns)
    if not approximate:
        return _exact_stats(df, names)
    aggs = [F.count(F.lit(1)).alias("rows")]
    for i, c in enumerate(names):
        aggs.append(F.count_if(is_absent(df, c)).alias(f"m{i}"))
        value = value_or_null(df, c) if is_numeric(df, c) else groupable(df, c)
        aggs.append(F.approx_count_distinct(value).alias(f"u{i}"))
    return to_long_form(
        df.agg(*aggs),
        [
            {"column": F.lit(c), "rows": F.col("rows"), "missing_count": F.col(f"m{i}"), "unique_count": F.col(f"u{i}")}
            for i, c in enumerate(names)
        ],
    )


def _schema_type(df: DataFrame, name: str) -> str | None:
    """The logical type when the schema alone decides it; None for text."""
    dtype = type_of(df, name)
    if isinstance(dtype, T.BooleanType):
        return "boolean"
    if isinstance(dtype, T.NumericType):
        return "numeric"
    if isinstance(dtype, TEMPORAL):
        return "date"
    return None if is_text(df, name) else "string"


def _logical_type(df: DataFrame, unique: Column, rows: Column, ratio: float) -> Column:
    """Logical type per row of a frame that has one row per column of ``df``."""
    text_type = F.when(unique / F.greatest(rows, F.lit(1)) <= ratio, "categorical").otherwise("string")
    known = {c: _schema_type(df, c) for c in df.columns}
    out = None
    for type_name in ("boolean", "numeric", "date", "string"):
        members = [c for c, t in known.items() if t == type_name]
        if members:
            test = F.col("column").isin(*members)
            out = F.when(test, type_name) if out is None else out.when(test, type_name)
    return text_type if out is None else out.otherwise(text_type)


def _physical_type(df: DataFrame) -> Column:
    out = None
    for type_name in sorted({t for _, t in df.dtypes}):
        test = F.col("column").isin(*[c for c, t in df.dtypes if t == type_name])
        out = F.when(test, type_name) if out is None else out.when(test, type_name)
    return out


def column_types(df: DataFrame, categorical_ratio: float = CATEGORICAL_RATIO, approximate: bool = False) -> DataFrame:
    """Logical and physical type per column.  Only text columns are read; the schema decides the rest."""
    spark = df.sparkSession
    decided = [(c, _schema_type(df, c), dict(df.dtypes)[c]) for c in df.columns if _schema_type(df, c)]
    parts = []
    if decided:
        parts.append(spark.createDataFrame(decided, "column string, data_type string, physical_type string"))
    texts = text_columns(df)
    if texts:
        stats = column_stats(df, texts, approximate)
        kind = _logical_type(df, F.col("unique_count"), F.col("rows"), categorical_ratio)
        parts.append(stats.select("column", kind.alias("data_type"), _physical_type(df).alias("physical_type")))
    return reduce(DataFrame.unionByName, parts)


def null_counts(df: DataFrame, order: bool = True) -> DataFrame:
    """Missing values per column: one aggregate over the table, then one row per column."""
    counted = df.agg(*[F.count_if(is_absent(df, c)).alias(f"m{i}") for i, c in enumerate(df.columns)])
    out = to_long_form(
        counted,
        [{"column": F.lit(c), "missing_count": F.col(f"m{i}")} for i, c in enumerate(df.columns)],
    )
    return out.orderBy(F.desc("missing_count"), "column") if order else out


def null_rates(df: DataFrame) -> DataFrame:
    """Missing count and percentage of rows, for columns that miss anything."""
    aggs = [F.count_if(is_absent(df, c)).alias(f"m{i}") for i, c in enumerate(df.columns)]
    counted = df.agg(F.count(F.lit(1)).alias("rows"), *aggs)
    return to_long_form(
        counted,
        [
            {
                "column": F.lit(c),
                "missing_count": F.col(f"m{i}"),
                "missing_percent": F.col(f"m{i}") * 100.0 / F.greatest(F.col("rows"), F.lit(1)),
            }
            for i, c in enumerate(df.columns)
        ],
    ).where("missing_count > 0")


def distinct_counts(df: DataFrame, approximate: bool = False) -> DataFrame:
    return column_stats(df, approximate=approximate).select("column", "unique_count")


def sample_values(df: DataFrame, key: Sequence[str], n: int = 3) -> DataFrame:
    """First ``n`` non-missing values of every column as text, in key order; columns without values are left out.

    One scan: each task keeps the first ``n`` rows of every column.
    """
    found = _one_pass(df, key, n, counts=False).select("column", "sample_values")
    return found.where(F.size("sample_values") > 0)


def column_profile(
    df: DataFrame,
    key: Sequence[str],
    categorical_ratio: float = CATEGORICAL_RATIO,
    samples: int = 3,
    approximate: bool = False,
) -> DataFrame:
    """One row per column: types, missing, distinct, sample values and a describing sentence.

    One scan for all of it; ``approximate`` takes a second one instead of a shuffle of digests.
    """
    if approximate:
        stats = column_stats(df, approximate=True).join(sample_values(df, key, samples), "column", "left")
    else:
        found = F.when(F.size("sample_values") > 0, F.col("sample_values"))
        stats = _one_pass(df, key, samples, counts=True).withColumn("sample_values", found)
    kind = _logical_type(df, F.col("unique_count"), F.col("rows"), categorical_ratio)
    typed = stats.withColumn("data_type", kind).withColumn("physical_type", _physical_type(df))
    sentence = F.format_string(
        COLUMN_SENTENCE,
        "data_type",
        "unique_count",
        "missing_count",
        "rows",
    )
    return typed.select(
        "column",
        "data_type",
        "physical_type",
        "rows",
        "missing_count",
        "unique_count",
        "sample_values",
        sentence.alias("description"),
    )


def top_missing_observations(df: DataFrame, n: int = 3) -> DataFrame:
    """Sentences about the columns that miss most; a default sentence when none misses anything."""
    top = null_counts(df, order=False).where("missing_count > 0").orderBy(F.desc("missing_count"), "column").limit(n)
    sentence = F.format_string(MISSING_SENTENCE, "column", "missing_count")
    item = F.struct((-F.col("missing_count")).alias("rank"), "column", sentence.alias("observation"))
    listed = top.agg(F.array_sort(F.collect_list(item)).alias("items"))  # at most n items
    texts = F.transform("items", lambda x: x["observation"])
    filled = F.when(F.size("items") > 0, texts).otherwise(F.array(F.lit(NO_SIGNAL_SENTENCE)))
    return listed.select(F.posexplode(filled).alias("position", "observation"))


def numeric_summary(df: DataFrame) -> DataFrame:
    names = numeric_columns(df)
    aggs = []
    for i, c in enumerate(names):
        value = value_or_null(df, c)
        aggs += [F.min(value).alias(f"lo{i}"), F.max(value).alias(f"hi{i}"), F.avg(value).alias(f"mean{i}")]
    return to_long_form(
        df.agg(*aggs),
        [
            {
                "column": F.lit(c),
                "min": F.col(f"lo{i}").cast("double"),
                "max": F.col(f"hi{i}").cast("double"),
                "mean": F.col(f"mean{i}").cast("double"),
            }
            for i, c in enumerate(names)
        ],
    )


def categorical_summary(df: DataFrame, approximate: bool = False) -> DataFrame:
    """Number of distinct values per text column."""
    return column_stats(df, text_columns(df), approximate).select("column", F.col("unique_count").alias("categories"))


def value_counts(df: DataFrame, name: str, order: bool = True) -> DataFrame:
    counts = df.where(~is_absent(df, name)).groupBy(column(name).alias("value")).agg(F.count(F.lit(1)).alias("rows"))
    return counts.orderBy(F.desc("rows"), "value") if order else counts


def dataset_summary(df: DataFrame, name: str, description: str, n: int = 3) -> DataFrame:
    """One row: name, description, rows, columns and the observations."""
    listed = top_missing_observations(df, n).select(F.struct("position", "observation").alias("item"))
    texts = listed.agg(F.transform(F.array_sort(F.collect_list("item")), lambda x: x["observation"]))
    return row_column_count(df).select(
        F.lit(name).alias("name"),
        F.lit(description).alias("description"),
        F.col("rows").alias("row_count"),
        F.col("columns").alias("column_count"),
        texts.scalar().alias("observations"),
    )
