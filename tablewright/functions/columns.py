"""Column helpers that depend on the schema."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

TEXT = (T.StringType, T.CharType, T.VarcharType)
FLOATING = (T.DoubleType, T.FloatType)
TEMPORAL = (T.DateType, T.TimestampType, T.TimestampNTZType)


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def column(name: str) -> Column:
    """A column by its exact name, also when the name holds dots or spaces."""
    return F.col(quoted(name))


def type_of(df: DataFrame, name: str) -> T.DataType:
    return df.schema[name].dataType


def is_text(df: DataFrame, name: str) -> bool:
    return isinstance(type_of(df, name), TEXT)


def is_numeric(df: DataFrame, name: str) -> bool:
    return isinstance(type_of(df, name), T.NumericType)


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, TEXT)]


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]


def value_or_null(df: DataFrame, name: str) -> Column:
    """The column with NaN read as null, since both count as a missing number."""
    c = column(name)
    if isinstance(type_of(df, name), FLOATING):
        return F.when(~F.isnan(c), c)
    return c


def is_absent(df: DataFrame, name: str) -> Column:
    """Null, or NaN in a floating column."""
    c = column(name)
    if isinstance(type_of(df, name), FLOATING):
        return c.isNull() | F.isnan(c)
    return c.isNull()


def _has_map(kind: T.DataType) -> bool:
    if isinstance(kind, (T.MapType, T.VariantType)):
        return True
    if isinstance(kind, T.ArrayType):
        return _has_map(kind.elementType)
    return isinstance(kind, T.StructType) and any(_has_map(f.dataType) for f in kind.fields)


def is_groupable(df: DataFrame, name: str) -> bool:
    """Whether Spark can group by the column as it is."""
    return not _has_map(type_of(df, name))


def groupable(df: DataFrame, name: str) -> Column:
    """The column in a form that can be a grouping key; what holds maps or variants becomes JSON text."""
    c, kind = column(name), type_of(df, name)
    if isinstance(kind, T.MapType) and not _has_map(kind.valueType):
        return F.to_json(F.array_sort(F.map_entries(c)))  # whatever the order of the entries
    return c if is_groupable(df, name) else F.to_json(c)


def row_digest(df: DataFrame, names: Sequence[str]) -> list[Column]:
    """Two columns g0 and g1, 128 bits that tell rows apart by these columns as grouping does."""
    keys = []
    for n in names:
        key = groupable(df, n)
        # -0.0 and 0.0 are one group
        keys.append(key + F.lit(0).cast(type_of(df, n)) if isinstance(type_of(df, n), FLOATING) else key)
    # a null leaves a hash as it is, so the places of the nulls are hashed as well
    nulls = [k.isNull() for k in keys]
    return [F.xxhash64(F.lit(seed), *keys, *nulls).alias(f"g{seed}") for seed in (0, 1)]


def micros(moment: Column) -> Column:
    """Microseconds since the epoch; works for both timestamp types in a UTC session."""
    return F.unix_micros(moment.cast("timestamp"))


def floor_to(value: Column, width: int) -> Column:
    """Index of the bucket of ``width`` units that holds an integer value (also below zero)."""
    w = F.lit(width)
    return F.floor((value - F.pmod(value, w)) / w).cast("bigint")


def to_long_form(one_row: DataFrame, entries: Sequence[dict[str, Column]]) -> DataFrame:
    """Turn a one-row aggregate into one row per entry."""
    structs = [F.struct(*[c.alias(k) for k, c in e.items()]) for e in entries]
    return one_row.select(F.inline(F.array(*structs)))


def null_safe_equal(left: DataFrame, right: DataFrame, names: Sequence[str]) -> Column:
    """Join condition under which null keys are equal, as grouping sees them."""
    cond = None
    for n in names:
        one = left[quoted(n)].eqNullSafe(right[quoted(n)])
        cond = one if cond is None else cond & one
    return cond
