"""Hard negatives from STR-packed R-trees.

Each block of rows is packed into an R-tree by sort-tile-recursive: rows are sorted by one coordinate, cut into
slices, each slice sorted by the next coordinate, and so on, down to leaves.  A node's box (smallest and largest
value of each coordinate) bounds the inner product with an anchor from both sides: the sum over the
coordinates of the lesser and of the greater of anchor x lower edge and anchor x upper edge.  A best-first
queue takes nodes by their upper bound and leaves out those that lie outside every open score window or
strictly below the lowest score kept; what is left is scored exactly, in integers.

Two searches: an anchor's positives, over all blocks, and then the negatives in the windows that the
positives' scores set.  Anchors are searched in blocks against every block of rows, so no task holds more than
two blocks.  Repeated rows count as rows of their own; a null id takes no part; shorter vectors end in zeros.
"""

from __future__ import annotations

from collections.abc import Callable
from heapq import heappop, heappush, heappushpop

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..functions.blocks import ROW, block_join, matrix, same_width
from ..functions.staging import stage
from .vectors import usable, whole

POSITIVES, NEGATIVES = 5, 10
#: A negative's score lies between these hundredths of the positive's.
LOW, HIGH = 30, 90
ROWS_EACH, ANCHORS_EACH = 16_384, 2_048
LEAF, FANOUT = 64, 8


def packed_order(points: np.ndarray) -> np.ndarray:
    """Order of the rows in which every LEAF neighbours make a leaf (sort-tile-recursive)."""
    parts = [np.arange(len(points))]
    for c in np.argsort(-points.var(axis=0), kind="stable") if len(points) else ():
        if max(map(len, parts)) <= LEAF:
            break
        # two slices a coordinate, of whole leaves, in the order of spread
        cut = []
        for part in parts:
            part = part[np.argsort(points[part, c], kind="stable")]
            half = -(-len(part) // (2 * LEAF)) * LEAF
            cut += [part[:half], part[half:]] if len(part) > LEAF else [part]
        parts = cut
    return np.concatenate(parts)


class Tree:
    """R-tree over the rows of a block; nodes are numbered from the root, leaves hold consecutive rows."""

    def __init__(self, points: np.ndarray):
        self.order = packed_order(points)
        self.points = points[self.order]
        starts = np.arange(0, len(points), LEAF)
        low, high = np.minimum.reduceat(self.points, starts), np.maximum.reduceat(self.points, starts)
        levels = [(low, high)]
        while len(low) > 1:
            starts = np.arange(0, len(low), FANOUT)
            low, high = np.minimum.reduceat(low, starts), np.maximum.reduceat(high, starts)
            levels.append((low, high))
        self.levels = levels[::-1]
        first = np.cumsum([0, *(len(low) for low, _ in self.levels)])
        self.first = first.tolist()
        self.low, self.high = (np.concatenate([edges[i] for edges in self.levels]) for i in (0, 1))

    def bounds(self, anchors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(least, greatest) inner product of every anchor with a row of every node."""
        up, down = np.maximum(anchors, 0), np.minimum(anchors, 0)
        return up @ self.low.T + down @ self.high.T, up @ self.high.T + down @ self.low.T

    def children(self, node: int, level: int) -> range:
        at = (node - self.first[level]) * FANOUT + self.first[level + 1]
        return range(at, min(at + FANOUT, self.first[level + 2]))

    def search(self, anchor: np.ndarray, least: np.ndarray, greatest: np.ndarray, windows: list[Window_], fits: Callable) -> int:
        """Fill the windows with the best rows; ``fits`` tells which rows of a leaf may count.  Returns leaves read."""
        queue = [(-greatest[0], 0, 0)]
        leaves = 0
        while queue:
            top, level, node = heappop(queue)
            if not any(w.open(least[node], -top) for w in windows):
                continue
            if level < len(self.levels) - 1:
                for child in self.children(node, level):
                    heappush(queue, (-greatest[child], level + 1, child))
                continue
            leaves += 1
            at = (node - self.first[level]) * LEAF
            places = self.order[at : at + LEAF]
            scores = self.points[at : at + LEAF] @ anchor
            may = fits(places)
            for w in windows:
                w.add(scores, places, may)
        return leaves


class Window_:
    """The best ``size`` rows whose score lies in a window; ties by id."""

    def __init__(self, size: int, ids: np.ndarray, low: float = -np.inf, high: float = np.inf):
        self.size, self.ids, self.low, self.high = size, ids, low, high
        self.heap: list[tuple] = []
        self.least = low

    def open(self, least: float, greatest: float) -> bool:
        return greatest >= self.least and least <= self.high

    def add(self, scores: np.ndarray, places: np.ndarray, may: np.ndarray) -> None:
        for k in np.flatnonzero(may & (scores >= self.least) & (scores <= self.high)).tolist():
            place = int(places[k])
            entry = (int(scores[k]), -int(self.ids[place]), -place)
            if len(self.heap) < self.size:
                heappush(self.heap, entry)
            else:
                heappushpop(self.heap, entry)
        if len(self.heap) == self.size:
            self.least = self.heap[0][0]


def _exact(points: np.ndarray, anchors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both in a type in which all their inner products and bounds are exact."""
    points, anchors = same_width(points, anchors)
    most = 2 * points.shape[1] * float(np.abs(points).max(initial=0)) * float(np.abs(anchors).max(initial=0))
    if most < 2**53:
        return points, anchors
    if most < 2**63:
        return points.astype(np.int64), anchors.astype(np.int64)
    return tuple(np.array([[int(x) for x in row] for row in m], object).reshape(m.shape) for m in (points, anchors))


def _searcher(size: int, windows: bool) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Work on a block of rows and a block of anchors (or of anchors with the positives that set their windows)."""

    def work(rows: pa.Table, asked: pa.Table) -> pa.Table:
        points, anchors = _exact(matrix(rows["vector"]), matrix(asked["vector"]))
        ids, numbers, labels = (rows[c].to_numpy() for c in ("vec_id", ROW, "label"))
        tree = Tree(points)
        own, row, label = (asked[c].to_pylist() for c in ("vec_id", "anchor_row", "label"))
        least, greatest = tree.bounds(anchors)
        out = []
        for i, anchor in enumerate(anchors):
            if windows:
                positives = asked["positives"][i].as_py()
                # 30 p <= 100 s <= 90 p in whole numbers
                edges = [(-(-LOW * p["score"] // 100), HIGH * p["score"] // 100) for p in positives]
                held = [Window_(size, ids, *e) for e in edges]
                fits = lambda places, mine=label[i]: labels[places] != mine
            else:
                held = [Window_(size, ids)]
                fits = lambda places, mine=label[i], me=row[i]: (labels[places] == mine) & (numbers[places] != me)
            tree.search(anchor, least[i], greatest[i], held, fits)
            for slot, w in enumerate(held):
                about = positives[slot] if windows else {"row": None, "vec_id": None, "score": None}
                out += [(own[i], row[i], *about.values(), int(numbers[-place]), -key, score) for score, key, place in w.heap]
        names = ["anchor_id", "anchor_row", "positive_row", "positive_id", "positive_score", "found_row", "found_id", "found_score"]
        return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(names, zip(*out) if out else [()] * len(names))})

    return work


FOUND = ", ".join(
    f"{n} bigint" for n in ("anchor_id", "anchor_row", "positive_row", "positive_id", "positive_score", "found_row", "found_id", "found_score")
)


def _best(found: DataFrame, groups: list[str], size: int) -> DataFrame:
    order = Window.partitionBy(*groups).orderBy(F.desc("found_score"), "found_id", "found_row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= size)


def mine(rows: DataFrame, anchors: DataFrame) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``rows`` as ``prepared`` makes them, ``anchors`` some of them.  An anchor's positives are the POSITIVES other rows
    of its label with the highest inner product; a positive's negatives are the NEGATIVES best rows of
    other labels whose score lies between LOW and HIGH hundredths of the positive's.
    """
    asked = stage(anchors.withColumn("anchor_row", F.col(ROW)), "anchors")
    found = block_join(rows, asked, _searcher(POSITIVES, False), FOUND, ROWS_EACH, ANCHORS_EACH)
    best = stage(_best(found, ["anchor_row"], POSITIVES), "positives")
    entry = F.struct(F.col("found_row").alias("row"), F.col("found_id").alias("vec_id"), F.col("found_score").alias("score"))
    windows = best.groupBy("anchor_row").agg(F.collect_list(entry).alias("positives"))  # POSITIVES entries at most
    asked = stage(asked.join(windows, "anchor_row"), "windows")
    found = block_join(rows, asked, _searcher(NEGATIVES, True), FOUND, ROWS_EACH, ANCHORS_EACH)
    ranked = _best(found, ["anchor_row", "positive_row"], NEGATIVES)
    return ranked.select(
        "anchor_id",
        "positive_id",
        "rank",
        F.col("found_id").alias("negative_id"),
        "positive_score",
        F.col("found_score").alias("negative_score"),
    )


def prepared(df: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """Rows with a label and a whole vector, in the integers of the contract, written once."""
    own = F.col(label).cast("bigint")
    # every seventh id carries another label
    noisy = F.when(F.col(key).cast("bigint") % 7 == 0, (own + 1) % 10).otherwise(own)
    rows = usable(df, key, vector, "vectors", noisy.alias("label"), rows=whole(vector) & F.col(label).isNotNull())
    return rows.withColumn("vector", F.transform("vector", lambda x: F.floor(256 * x).cast("double")))


def contract(df: DataFrame) -> DataFrame:
    """Hard negatives of every row whose id is divisible by 100."""
    rows = prepared(df)
    return mine(rows, rows.where(F.col("vec_id") % 100 == 0))
