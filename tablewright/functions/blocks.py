"""Blocks of queries against blocks of rows, for searches that must look at every row.

Both sides are written once with a row number and dealt into blocks of a fixed expected size by its
hash, so no key, vector or id can make a block hot.  Every pair of blocks is one group: a task holds one
block of each side, whatever the sizes of the tables, and the driver sees two counts.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from .columns import column
from .staging import stage

ROW = "__row"
#: More pairs of blocks than this share tasks.
MAX_TASKS = 20_000


def numbered(df: DataFrame, label: str) -> DataFrame:
    """``df`` written once, with a number of its own for each row (unique, not gapless)."""
    return stage(df.withColumn(ROW, F.monotonically_increasing_id()), label)


def block_join(
    rows: DataFrame,
    queries: DataFrame,
    work: Callable[[pa.Table, pa.Table], pa.Table],
    schema: str,
    rows_each: int,
    queries_each: int,
) -> DataFrame:
    """What ``work`` makes of every pair of a block of rows and a block of queries, both ``numbered``.

    Shuffled are rows x blocks of queries and queries x blocks of rows, so larger blocks move less.
    """
    high, wide = (max(1, -(-df.count() // each)) for df, each in ((rows, rows_each), (queries, queries_each)))

    def dealt(df: DataFrame, own: str, blocks: int, other: str, others: int, prefix: str = "") -> DataFrame:
        block = F.pmod(F.xxhash64(ROW), F.lit(blocks)).cast("int").alias(own)
        placed = df.select(*[column(c).alias(prefix + c) for c in df.columns], block).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(others - 1))))
        # a stated number of partitions: a pair of blocks is small in bytes and long in work
        return placed.repartition(min(high * wide, MAX_TASKS), "__high", "__wide").groupBy("__high", "__wide")

    left = dealt(rows, "__high", high, "__wide", wide)
    # under names of their own: two sides with the same columns are taken for one when unused columns are dropped
    right = dealt(queries, "__wide", wide, "__high", high, "asked_")
    names = queries.columns
    empty = pa.Table.from_pylist([], schema=to_arrow(rows.sparkSession.createDataFrame([], schema)))

    def pair(some: pa.Table, asked: pa.Table) -> pa.Table:
        if not some.num_rows or not asked.num_rows:
            return empty
        asked = asked.select(["asked_" + c for c in names]).rename_columns(names)
        return work(some, asked).cast(empty.schema)

    return left.cogroup(right).applyInArrow(pair, schema)


def to_arrow(df: DataFrame) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(df.schema)


def matrix(vectors: pa.ChunkedArray) -> np.ndarray:
    """A column of arrays as float64 rows; shorter arrays end in zeros."""
    lists = vectors.combine_chunks()
    lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = pc.list_flatten(lists).to_numpy(zero_copy_only=False).astype(np.float64)
    size = int(lengths.max()) if len(lengths) else 0
    if (lengths == size).all():
        return flat.reshape(len(lengths), size)
    out = np.zeros((len(lengths), size))
    out[np.arange(size) < lengths[:, None]] = flat
    return out


def same_width(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both with as many columns as the wider one has."""
    size = max(a.shape[1], b.shape[1])
    return tuple(np.pad(m, ((0, 0), (0, size - m.shape[1]))) if m.shape[1] < size else m for m in (a, b))
