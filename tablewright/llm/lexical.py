"""Reversed lexical search: the items' terms are indexed, and the documents stream through the index.

The inverted index over the items (term -> items that hold it) is what every task holds.  Each document's term
counts are looked up in it, and a heap of bounded size keeps every item's best documents of the task; the
heaps of all tasks are then merged.  Items are dealt into blocks until the index of each block has at most
``POSTINGS`` entries, and every block is searched by itself, so what is broadcast is bounded whatever the
number of items.

Null texts have no terms, repeated rows count as rows of their own, and a null document id comes
after all others of its score.  Columns beyond id and text play no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heappush, heappushpop
from itertools import chain
from math import floor, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..functions.blocks import ROW, numbered
from ..functions.staging import stage
from .texts import slices

#: Entries (item, term) of a block's index; one item with more has a block of its own.
POSTINGS = 500_000
#: Scores and additions held at once.
CELLS = 1 << 20
BEST = 10

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The same for UTF-8 bytes: a byte of no term becomes a blank.  All bytes of characters beyond ASCII are 0x80 or more.
_BYTES = bytes(c if c >= 0x80 else ord(chr(c).lower()) if chr(c).isalnum() else 32 for c in range(256))


def terms(text: bytes | None) -> list[bytes]:
    """The terms of a text in UTF-8."""
    return text.translate(_BYTES).split() if text else []


def item_terms(items: DataFrame, item: str, text: str) -> DataFrame:
    """(__row, item, term, n) of every item, staged; repeated ids are items of their own."""
    rows = numbered(items.select(F.col(item).alias("item"), F.col(text).alias("text")), "items")
    found = F.regexp_extract_all(F.translate("text", _UPPER, _LOWER), F.lit(TERM), F.lit(0))
    each = rows.select(ROW, "item", F.explode(found).alias("term"))
    return stage(each.groupBy(ROW, "item", "term").agg(F.count(F.lit(1)).alias("n")), "item-terms")


def blocks_of(entries: DataFrame) -> int:
    """Number of blocks, by hash, at which none holds more than POSTINGS entries of several items."""
    sizes = stage(entries.groupBy(ROW).agg(F.count(F.lit(1)).alias("n")), "item-sizes")
    count = -(-(sizes.agg(F.sum("n")).first()[0] or 0) // POSTINGS)
    while count:
        load = sizes.groupBy(_block(count)).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("items"))
        if not load.where((F.col("n") > POSTINGS) & (F.col("items") > 1)).head(1):
            break
        count *= 2
    return count


def _block(count: int):
    return F.pmod(F.xxhash64(ROW), F.lit(count)).alias("block")


class Index:
    """Inverted index of a block of items; bounded, built on the driver and broadcast."""

    def __init__(self, entries: list):
        items = sorted({r[0] for r in entries})
        place = {row: i for i, row in enumerate(items)}
        held: dict[str, list[tuple[int, int]]] = {}
        for row, _, term, n in entries:
            held.setdefault(term, []).append((place[row], n))
        self.items = np.array(items, np.int64)
        self.slot = {term.encode(): i for i, term in enumerate(held)}
        self.size = np.array([len(p) for p in held.values()], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.item, self.repeats = np.array([e for p in held.values() for e in p], np.int64).reshape(-1, 2).T.copy()

    def counts(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(terms of each text) and (text, slot, times) of the terms that some item holds."""
        lengths, hits = [], []
        for text in texts:
            found = terms(text)
            lengths.append(len(found))
            hits.append([s for s in map(self.slot.get, found) if s is not None])
        owner = np.repeat(np.arange(len(texts)), [len(h) for h in hits])
        slots = np.fromiter(chain.from_iterable(hits), np.int64, len(owner))
        both, times = np.unique(owner * len(self.slot) + slots, return_counts=True)
        return np.array(lengths, np.int64), *np.divmod(both, max(1, len(self.slot))), times


def _statistics(docs: DataFrame, index) -> dict[int, int]:
    """Documents that hold each term (by slot), documents with a term (-1), terms with repeats (-2)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(len(index.value.slot) + 2, np.int64)
        for batch in slices(batches, 1):
            lengths, _, slots, _ = index.value.counts(batch.column(1).cast(pa.binary()).to_pylist())
            held[:-2] += np.bincount(slots, minlength=len(held) - 2)
            held[-2:] += (lengths.sum(), np.count_nonzero(lengths))
        slots = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(np.where(slots < len(held) - 2, slots, slots - len(held))), pa.array(held[slots])], names=["slot", "n"])

    parts = docs.mapInArrow(run, "slot bigint, n bigint")
    return dict(parts.groupBy("slot").agg(F.sum("n")).collect())  # at most a row for each term of the block


class Heaps:
    """The best documents of every item so far."""

    def __init__(self, items: int, best: int):
        self.best, self.heaps = best, [[] for _ in range(items)]
        self.least = np.ones(items, np.int64)

    def update(self, scores: np.ndarray, ids: list[int | None]) -> None:
        """``scores``: documents x items.  Only those that reach an item's least kept score are looked at."""
        cut = self.least
        if len(scores) > self.best:
            cut = np.maximum(cut, np.partition(scores, -self.best, axis=0)[-self.best])
        for d, i in zip(*np.nonzero(scores >= cut)):
            doc, heap = ids[d], self.heaps[i]
            entry = (int(scores[d, i]), doc is not None, -(doc or 0))
            if len(heap) < self.best:
                heappush(heap, entry)
            else:
                heappushpop(heap, entry)
            if len(heap) == self.best:
                self.least[i] = heap[0][0]


def _best_documents(docs: DataFrame, index, weights: np.ndarray, number: int, total: int, best: int) -> DataFrame:
    """(__row, doc_id, score): every task's best documents of every item."""

    def score(heaps: Heaps, batch: pa.RecordBatch) -> None:
        own = index.value
        ids = batch.column(0).to_pylist()
        lengths, owner, slots, times = own.counts(batch.column(1).cast(pa.binary()).to_pylist())
        norms = np.array([25 + 75 * n * number // total for n in lengths.tolist()], np.int64)
        impact = weights[slots] * (1_000_000_000 * times // (1000 * times + 8 * norms[owner]))
        # documents in groups whose scores and additions are bounded
        cost = np.cumsum(np.bincount(owner, own.size[slots], len(ids)) + len(own.items))
        at = 0
        while at < len(ids):
            stop = max(at + 1, int(np.searchsorted(cost, (cost[at - 1] if at else 0) + CELLS, side="right")))
            first, last = np.searchsorted(owner, (at, stop))
            scores = np.zeros((stop - at, len(own.items)), np.int64)
            size = own.size[slots[first:last]]
            within = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            entry = np.repeat(own.start[slots[first:last]], size) + within
            cell = np.repeat((owner[first:last] - at) * len(own.items), size) + own.item[entry]
            np.add.at(scores.reshape(-1), cell, np.repeat(impact[first:last], size) * own.repeats[entry])
            heaps.update(scores, ids[at:stop])
            at = stop

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heaps = Heaps(len(index.value.items), best)
        for batch in slices(batches, 1):
            score(heaps, batch)
        found = [(row, -doc if has else None, s) for row, heap in zip(index.value.items.tolist(), heaps.heaps) for s, has, doc in heap]
        columns = [pa.array(c, pa.int64()) for c in (zip(*found) if found else ([], [], []))]
        yield pa.RecordBatch.from_arrays(columns, names=[ROW, "doc_id", "score"])

    return docs.mapInArrow(run, f"{ROW} bigint, doc_id bigint, score bigint")


def search(docs: DataFrame, items: DataFrame, best: int = BEST, doc: str = "doc_id", item: str = "item_id", text: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): the ``best`` documents of every item with a score above 0.

    Scores are the integers of the contract of ``op11``; equal scores go by ascending document id.  An item
    without terms, or whose terms no document holds, has no rows.  Document ids are integers.
    """
    spark = docs.sparkSession
    entries = item_terms(items, item, text)
    count = blocks_of(entries)
    rows = docs.select(F.col(doc).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    order = Window.partitionBy(ROW).orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    out = spark.createDataFrame([], f"{ROW} bigint, doc_id bigint, score bigint, rank int")
    for b in range(count):
        held = entries.where(_block(count) == b).collect()  # at most POSTINGS entries, or one item's
        if not held:
            continue
        index = spark.sparkContext.broadcast(Index(held))
        stats = _statistics(rows, index)
        number, total = stats.pop(-1, 0), stats.pop(-2, 0)
        if not number:  # no document has a term
            break
        weights = np.zeros(len(index.value.slot), np.int64)
        for slot, df in stats.items():
            weights[slot] = floor(1000 * log((2 * number + 2) / (2 * df + 1)))
        found = _best_documents(rows, index, weights, number, total, best)
        merged = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= best)
        out = out.unionByName(stage(merged, "best-documents"))
        index.unpersist()
    names = entries.select(ROW, "item").distinct()
    return out.join(names, ROW).select(F.col("item").alias(item), "rank", "doc_id", "score")
