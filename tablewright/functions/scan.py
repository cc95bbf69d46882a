"""Running values over groups of any size, as parallel prefix scans.

Rows are dealt by ranges of (group, order, row hash, place), so a group is cut wherever a partition ends, whatever its
times: a group that holds all rows, or all rows at one moment, is spread over all tasks.  Every task fills
its sorted rows and says which group it begins and ends with, and with which value.  Two rows for each task
are enough to find what enters a task from the ones before it.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from .columns import column, groupable, quoted, row_digest
from .staging import stage

DATA, BEGINS, ENDS = 0, 1, 2


def carry_forward(df: DataFrame, value: Column, group: Sequence[str], order: Sequence[Column], out: str) -> DataFrame:
    """Add a column with the last non-null ``value`` of the group, up to and with the row in the given order.

    Rows that are equal in group and order go by the hash of all their columns.
    """
    spark = df.sparkSession
    fields = [T.StructField(f"c{i}", f.dataType) for i, f in enumerate(df.schema.fields)]
    row = F.struct(*[column(c).alias(f.name) for c, f in zip(df.columns, fields)]).alias("row")
    places = [c.alias(f"o{i}") for i, c in enumerate(order)]
    tie = F.xxhash64(*[groupable(df, c) for c in df.columns]).alias("tie")
    wide = df.select(row, value.alias("filled"), *row_digest(df, group), *places, tie, F.monotonically_increasing_id().alias("place"))
    keys = ["g0", "g1", *[f"o{i}" for i in range(len(places))], "tie", "place"]
    # a stated number, so that the partitions stay as dealt
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = wide.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).select("row", "filled", "g0", "g1")
    schema = T.StructType(
        [
            T.StructField("row", T.StructType(fields)),
            T.StructField("filled", wide.schema["filled"].dataType),
            *[T.StructField(c, T.LongType()) for c in ("g0", "g1")],
            *[T.StructField(c, T.IntegerType()) for c in ("part", "kind")],
        ]
    )
    filled = stage(ordered.mapInArrow(_fill, schema), "filled")
    ends = filled.where(F.col("kind") != DATA).drop("row")  # two rows a partition
    before = Window.partitionBy("g0", "g1").orderBy("part", "kind").rowsBetween(Window.unboundedPreceding, -1)
    entering = ends.withColumn("entering", F.last("filled", ignorenulls=True).over(before))
    entering = entering.where((F.col("kind") == BEGINS) & F.col("entering").isNotNull()).drop("filled", "kind")
    rows = filled.where(F.col("kind") == DATA).join(stage(entering, "entering"), ["g0", "g1", "part"], "left")
    own = [F.col("row").getField(f.name).alias(c) for c, f in zip(df.columns, fields)]
    return rows.select(*own, F.coalesce("filled", "entering").alias(out))


def positions(df: DataFrame, group: Sequence[str], order: Sequence[str], out: str) -> DataFrame:
    """Add the place of each row in its group, from 0, in the order of the given columns.

    Sorted by ranges as above: a task counts in its own rows, and the counts of (task, group) say where it begins.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = ["g0", "g1", *[quoted(c) for c in order]]
    keyed = df.select("*", *row_digest(df, group)).repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    # the number holds the task in its upper bits and the place in the task in the lower ones
    placed = stage(keyed.withColumn("__at", F.monotonically_increasing_id()), "placed")
    task = F.shiftright("__at", 33).alias("__task")
    counts = placed.groupBy("g0", "g1", task).agg(F.min("__at").alias("__first"), F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy("g0", "g1").orderBy("__task").rowsBetween(Window.unboundedPreceding, -1)
    begun = counts.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    rows = placed.withColumn("__task", task).join(stage(begun, "begun"), ["g0", "g1", "__task"])
    return rows.select(*[column(c) for c in df.columns], (F.col("__at") - F.col("__first") + F.col("__before")).alias(out))


def _fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Fill the sorted rows of a task inside their groups; two more rows tell how it begins and ends."""
    part = TaskContext.get().partitionId()
    first = last = carried = names = None
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        names = [*batch.schema.names, "part", "kind"]
        rows, values = batch.column(0), batch.column(1)
        group = np.stack([batch.column(i).to_numpy() for i in (2, 3)])
        if first is None:
            first, carried = group[:, 0], pa.nulls(1, values.type)
        begins = np.ones(n, bool)
        begins[1:] = (group[:, 1:] != group[:, :-1]).any(axis=0)
        begins[0] = last is None or (group[:, 0] != last).any()
        place = np.arange(1, n + 1)
        since = np.maximum.accumulate(np.where(begins, place, 0))
        seen = np.maximum.accumulate(np.where(values.is_valid().to_numpy(False), place, 0))
        # place 0 is what the group had before this batch
        filled = pa.concat_arrays([carried, values]).take(pa.array(seen, mask=seen < since))
        carried, last = filled.slice(n - 1), group[:, -1]
        marks = [pa.array(np.full(n, mark, np.int32)) for mark in (part, DATA)]
        yield pa.RecordBatch.from_arrays([rows, filled, batch.column(2), batch.column(3), *marks], names=names)
    if first is not None:
        for group, value, kind in ((first, pa.nulls(1, carried.type), BEGINS), (last, carried, ENDS)):
            marks = [pa.array([int(x)]) for x in group] + [pa.array([mark], pa.int32()) for mark in (part, kind)]
            yield pa.RecordBatch.from_arrays([pa.nulls(1, rows.type), value, *marks], names=names)
