"""Reproducible shuffle into shards: a Feistel permutation with cycle walking over global row numbers.

DataFrame functions only.  A row's shard and slot follow from its row number, the number of rows, the number
of shards and the seed alone, so they can be computed for any row without data, and backwards.
"""

from __future__ import annotations

from math import isqrt

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from ..functions.staging import stage
from .texts import without

ROUNDS = 6
SEED = 20_240
#: Most steps of a walk.  Places outside the rows are fewer than the square root of their number, so up to
#: 4,096 rows every walk ends within 64 steps, and beyond that a longer one has odds under rows ** -31.
WALK = 64


def domain(rows: int) -> tuple[int, int]:
    """Sides of the smallest rectangle near a square that holds all rows."""
    a = max(1, isqrt(rows - 1) + 1) if rows > 1 else 1
    return a, max(1, -(-rows // a))


def _permute(place: Column, sides: tuple[int, int], seed: int) -> Column:
    """One pass: rounds add to the left and right coordinate in turn a hash of the other."""
    a, b = sides

    def turn(pair: Column, step: Column) -> Column:
        salt = F.lit(seed * 1_000) + step
        left = F.pmod(pair["x"] + F.pmod(F.xxhash64(pair["y"], salt), F.lit(a)), F.lit(a))
        right = F.pmod(pair["y"] + F.pmod(F.xxhash64(left, salt + 500), F.lit(b)), F.lit(b))
        return F.struct(left.alias("x"), right.alias("y"))

    start = F.struct(F.floor(place / F.lit(b)).cast("long").alias("x"), F.pmod(place, F.lit(b)).cast("long").alias("y"))
    steps = F.array(*[F.lit(i) for i in range(ROUNDS)])
    return F.aggregate(steps, start, turn, lambda p: p["x"] * F.lit(b) + p["y"])


def permuted(row: Column, rows: int, seed: int = SEED) -> Column:
    """The place in 0..rows-1 of a row number: permute within the rectangle until inside the rows."""
    sides = domain(rows)
    walk = F.array_repeat(F.lit(0), min(WALK, max(0, sides[0] * sides[1] - rows)))
    first = _permute(row, sides, seed)
    place = F.aggregate(walk, first, lambda p, _: F.when(p < rows, p).otherwise(_permute(p, sides, seed)))
    return F.when(place < rows, place).otherwise(F.raise_error(F.lit("the walk did not end")).cast("long"))


def _placed(table: DataFrame) -> DataFrame:
    return table.withColumns(
        {"file_of_row": F.expr("_metadata.file_path"), "index_of_row": F.expr("_metadata.row_index")}
    )


def _plain_scan(table: DataFrame) -> bool:
    """Whether the plan is a scan of Parquet files with chosen columns and nothing else: places are then all there."""
    try:
        _placed(table)
    except AnalysisException:
        return False
    plan = table._jdf.queryExecution().analyzed()
    while plan.nodeName() in ("Project", "SubqueryAlias"):
        plan = plan.children().apply(0)
    return plan.nodeName() == "LogicalRelation" or plan.nodeName().startswith("Relation")


def row_numbers(table: DataFrame, name: str = "row_number") -> tuple[DataFrame, int]:
    """``table`` with global row numbers from 0, and the number of rows.

    A row's number is the number of rows in the files before its own, by path, plus its index in its
    file: no shuffle of the rows and no sort, the same on every run however files are split into
    tasks.  A frame that isn't a plain scan of Parquet files is written to the shared folder first.
    """
    table = without(table, name, "file_of_row", "index_of_row")
    placed = _placed(table if _plain_scan(table) else stage(table, "rows"))
    files = stage(placed.groupBy("file_of_row").agg(F.count(F.lit(1)).alias("n")), "files")
    earlier = Window.orderBy("file_of_row").rowsBetween(Window.unboundedPreceding, -1)
    start = files.select("file_of_row", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("offset"))
    rows = files.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    numbered = placed.join(start, "file_of_row")
    numbered = numbered.withColumn(name, F.col("offset") + F.col("index_of_row"))
    return numbered.drop("file_of_row", "index_of_row", "offset"), rows


def shard_of(row: Column, rows: int, shards: int, seed: int = SEED) -> tuple[Column, Column]:
    """(shard, slot) of a row number: places are dealt in turn, so counts differ by one at most."""
    place = permuted(row, rows, seed)
    return F.pmod(place, F.lit(shards)).cast("int"), F.floor(place / F.lit(shards)).cast("long")


def assign(table: DataFrame, shards: int, seed: int = SEED) -> DataFrame:
    """Every row of ``table`` with shard (0..shards-1) and slot (gapless from 0 within its shard).

    Nulls, empty texts and repeated rows are rows like any other; an empty table gives an empty one.
    Columns of ``table`` named row_number, shard or slot are replaced.
    """
    numbered, rows = row_numbers(without(table, "shard", "slot", "place"))
    numbered = numbered.withColumn("place", permuted(F.col("row_number"), max(rows, 1), seed))
    return numbered.withColumns(
        {
            "shard": F.pmod("place", F.lit(shards)).cast("int"),
            "slot": F.floor(F.col("place") / F.lit(shards)).cast("long"),
        }
    ).drop("place")


def write_shards(table: DataFrame, path: str, shards: int, seed: int = SEED) -> None:
    """Write ``table`` as Parquet, one folder a shard, rows in the order of their slots.

    Ranges of (shard, slot) are dealt to tasks, so a shard larger than a task is several files.
    """
    assigned = assign(table, shards, seed)
    ordered = assigned.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot")
    ordered.write.mode("errorifexists").partitionBy("shard").parquet(path)
