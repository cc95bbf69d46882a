"""Records of delimited files whose quoted fields may hold line ends, read by many tasks.

Whether a line begins inside quotes depends on all lines before it, which seems to need one task for a file.  But
a line only turns "outside" and "inside" into one of both, so the lines of a split together do so as well:
a first pass reduces every split to that small table, a running product over the splits of a file says how each
split begins, and the second pass cuts the lines into records.  A record over the edge of a split is put
together from its parts, of which a split has two at most.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions.staging import stage

#: Kinds of pieces: a record, the end of one begun before, one that goes on in the next split, a part between.
WHOLE, ENDS, BEGINS, THROUGH = 0, 1, 2, 3
#: Up to so many splits the table of how they begin is broadcast (some 50 MB); lines are joined and sorted beyond.
FEW_SPLITS = 500_000


def _patterns(delimiter: str) -> tuple[str, str]:
    """Lines that end outside quotes, when they begin outside and when they begin inside.

    A field is quoted when it begins with a quote; a quote elsewhere is a character like others.
    """
    sep = re.escape(delimiter)
    rest = f"[^{sep}]*+" if len(delimiter) == 1 else f"(?:(?!{sep}).)*+"
    closed = f'[^"]*+(?:""[^"]*+)*+"{rest}'
    field = f'(?:"{closed}|(?!"){rest})'
    more = f"(?:{sep}{field})*+"
    return rf"\A{field}{more}\z", rf"\A{closed}{more}\z"


def _lines(spark: SparkSession, path: str, delimiter: str) -> DataFrame:
    """Lines in file order, with their split and whether they end inside quotes, by how they begin."""
    lines = spark.read.option("lineSep", "\n").text(path)
    text = F.regexp_replace("value", r"\r\z", "")
    outside, inside = _patterns(delimiter)
    # a line without a quote ends as it begins
    plain = ~F.contains("value", F.lit('"'))
    return lines.select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("start"),
        F.col("_metadata.file_block_length").alias("length"),
        F.col("value").alias("text"),  # with its carriage return, which may stand inside quotes
        (~(plain | text.rlike(outside))).alias("from_out"),
        (plain | ~text.rlike(inside)).alias("from_in"),
    )


def _inside_after(from_out: np.ndarray, from_in: np.ndarray, begins: bool) -> np.ndarray:
    """Whether each line ends inside quotes, when the first one begins as told."""
    fixed = from_out == from_in  # ends alike however it begins
    swaps = np.cumsum(from_out & ~from_in)
    last = np.maximum.accumulate(np.where(fixed, np.arange(len(fixed)), -1))
    base = np.where(last >= 0, from_out[last], begins)
    since = swaps - np.where(last >= 0, swaps[last], 0)
    return base ^ (since % 2 == 1)


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[tuple[str, int], pa.RecordBatch]]:
    """Parts of a batch that come from one split."""
    starts, files = batch.column("start").to_numpy(), batch.column("file")
    change = np.flatnonzero(starts[1:] != starts[:-1]) + 1
    if len(files) > 1:
        other = pc.not_equal(files.slice(1), files.slice(0, len(files) - 1)).to_numpy(zero_copy_only=False)
        change = np.union1d(change, np.flatnonzero(other) + 1)
    edges = [0, *change.tolist(), batch.num_rows]
    for a, b in zip(edges, edges[1:]):
        if b > a:
            yield (files[a].as_py(), int(starts[a])), batch.slice(a, b - a)


def _flags(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    return tuple(part.column(c).to_numpy(zero_copy_only=False) for c in ("from_out", "from_in"))


def _reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(file, start, length, from_out, from_in): one row for every split of the task."""
    found: dict[tuple[str, int], list] = {}
    for batch in batches:
        for key, part in _runs(batch):
            own = found.setdefault(key, [part.column("length")[0].as_py(), False, True])
            flags = _flags(part)
            own[1:] = [bool(_inside_after(*flags, begins)[-1]) for begins in own[1:]]
    rows = [(*key, *own) for key, own in found.items()]
    if rows:
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_())
        columns = [pa.array(c, k) for c, k in zip(zip(*rows), kinds)]
        yield pa.RecordBatch.from_arrays(columns, names=["file", "start", "length", "from_out", "from_in"])


def splits(lines: DataFrame) -> DataFrame:
    """(file, start, length, inside): how each split begins, staged.  Files have few splits, so one window does."""
    reduced = lines.drop("text").mapInArrow(_reduce, "file string, start bigint, length bigint, from_out boolean, from_in boolean")
    reduced = stage(reduced, "splits")
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    step = F.struct("from_out", "from_in", F.col("from_out") == F.col("from_in"))
    # the last split that ends alike however it begins, and the number of turns since
    turns = F.sum((F.col("from_out") & ~F.col("from_in")).cast("int")).over(before)
    fixed = F.col("from_out") == F.col("from_in")
    counted = reduced.withColumn("turns", F.coalesce(turns, F.lit(0))).withColumn("step", step)
    last = F.last(F.when(fixed, F.struct("from_out", "turns")), ignorenulls=True).over(before)
    known = F.coalesce(last["from_out"], F.lit(False))
    odd = (F.col("turns") - F.coalesce(last["turns"], F.lit(0))) % 2 == 1
    return stage(counted.select("file", "start", "length", (known != odd).alias("inside")), "splits")


class _Cut:
    """Cuts the lines of a task into records; ``inside`` tells how the split of a row begins."""

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, open_, kind, first = None, False, [], WHOLE, True
        for batch in batches:
            for own, part in _runs(batch):
                if own != key:
                    if key:
                        yield from self._rest(key, open_, kind, first)
                    key, state = own, bool(part.column("inside")[0].as_py())
                    open_, kind, first = [], ENDS if state else WHOLE, own[1] == 0
                after = _inside_after(*_flags(part), state)
                text = part.column("text")
                ends = np.flatnonzero(~after) + 1
                if not len(ends):
                    open_.append(text)
                    state = True
                    continue
                head = pa.concat_arrays([*open_, text.slice(0, ends[0])])
                records = [self._joined(head, [0, len(head)]), self._joined(text, ends)]
                kinds = np.array([kind] + [WHOLE] * (len(ends) - 1), np.int32)
                yield self._batch(key, pa.concat_arrays(records), kinds, first)
                first = False
                rest = text.slice(int(ends[-1]))
                open_, kind, state = [rest] if len(rest) else [], WHOLE, bool(after[-1])
        if key:
            yield from self._rest(key, open_, kind, first)

    def _joined(self, text: pa.Array, edges) -> pa.Array:
        """The lines between each two edges as one text."""
        edges = np.asarray(edges, np.int32)
        if len(edges) == len(text) + 1 or (edges[1:] - edges[:-1] == 1).all():
            return text.slice(int(edges[0]), len(edges) - 1)  # a line is a record
        return pc.binary_join(pa.ListArray.from_arrays(pa.array(edges), text), "\n")

    def _rest(self, key: tuple[str, int], open_: list, kind: int, first: bool) -> Iterator[pa.RecordBatch]:
        if open_:
            lines = pa.concat_arrays(open_)
            goes_on = np.array([THROUGH if kind == ENDS else BEGINS], np.int32)
            yield self._batch(key, self._joined(lines, [0, len(lines)]), goes_on, first)

    def _batch(self, key: tuple[str, int], text: pa.Array, kinds: np.ndarray, first: bool) -> pa.RecordBatch:
        n = len(text)
        header = np.zeros(n, bool)
        header[0] = first
        columns = [pa.array([key[0]] * n), pa.array(np.full(n, key[1])), pa.array(kinds), text, pa.array(header)]
        return pa.RecordBatch.from_arrays(columns, names=["file", "start", "kind", "record", "header"])


def csv_records(spark: SparkSession, path: str, delimiter: str) -> DataFrame:
    """(record): every record of the files but the first of each, which is its header, and but blank ones.

    Two reads, both split as Spark splits files.  The splits must be the same in both: when cores were added or
    the split size changed in between, the read fails with that message instead of cutting wrongly.
    """
    lines = _lines(spark, path, delimiter)
    begins = splits(lines)
    own = ["file", "start", "length"]
    if begins.count() <= FEW_SPLITS:
        known = lines.join(F.broadcast(begins), own, "left")  # the lines stay in order
    else:
        at = lines.withColumn("at", F.monotonically_increasing_id())
        known = at.join(begins, own, "left").sortWithinPartitions("file", "start", "at").drop("at")
    lost = F.raise_error(F.lit("the splits of the files changed between two reads; read again"))
    placed = known.withColumn("inside", F.coalesce("inside", lost.cast("boolean")))
    pieces = placed.mapInArrow(_Cut(), "file string, start bigint, kind int, record string, header boolean")
    whole = pieces.where((F.col("kind") == WHOLE) & ~F.col("header")).select("record")
    if begins.where("inside").head(1):
        whole = whole.unionByName(_over_edges(pieces.where(F.col("kind") != WHOLE)))
    ended = F.regexp_replace("record", r"\r\z", "")
    return whole.select(ended.alias("record")).where(F.trim("record") != "")


def _over_edges(pieces: DataFrame) -> DataFrame:
    """Records put together from their parts, at most two parts a split."""
    parts = stage(pieces, "parts")
    order = Window.partitionBy("file").orderBy("start", F.col("kind") == BEGINS)
    number = F.sum((F.col("kind") == BEGINS).cast("int")).over(order)
    joined = parts.withColumn("number", number).groupBy("file", "number").agg(
        F.array_sort(F.collect_list(F.struct("start", "kind", "record"))).alias("parts"), F.max("header").alias("header")
    )
    return joined.where("NOT header").select(F.array_join(F.transform("parts", lambda p: p["record"]), "\n").alias("record"))
