"""Nearest vectors by collision counting over single projections.

Every block of rows keeps one sorted array for each of a set of random directions.  A query opens a window centred on
its own projection in every array; a row collides once for each window that holds it.  Virtual rehashing widens
all windows by a factor, and only what the wider windows add is counted.  Windows are HALF times as wide, on either
side, as the distance that they are to find, so near rows miss few of them: collisions are
counted from the other end, as rows left outside the windows, which are the two ends of a sorted array.  Rows that miss at
most as many windows as a row at that distance is expected to, and ``SURE`` standard deviations more, are verified
with their exact score.  The search of a block ends when the kth best verified row is within the distance of
the windows; a block that never gets there ends with windows over all its rows, all verified.  There is no cap on
candidates.

Largest inner product becomes smallest distance by one more coordinate, sqrt(M^2 - |x|^2) with M the
largest norm of the block, and 0 for the query, scaled to length M; scores are those of the original vectors.
The directions are random rotations, orthonormal within each, which makes counts less scattered than
independent ones.  The first windows are set from the distances to SAMPLE rows of the block, which saves rounds and
decides nothing.
"""

from __future__ import annotations

from math import ceil, erf, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..functions.blocks import ROW, block_join, matrix, same_width
from .vectors import usable, whole

BEST = 20
#: Rows and queries of a block, and queries that are counted together (counters: ROWS_EACH x TOGETHER x 2 bytes).
ROWS_EACH, QUERIES_EACH, TOGETHER = 32_768, 1_024, 64
#: At least so many directions, in whole rotations; half a window in distances; widening.
DIRECTIONS, HALF, WIDER = 64, 1.7, 1.1
#: Standard deviations of misses that a true neighbour has to spare.
SURE = 0.5
SAMPLE = 256
SEED = 42


def directions(size: int) -> np.ndarray:
    """size x m matrix: random rotations side by side, the same in every task.

    Lengths are sqrt(size), so that two points at distance d lie about d apart in each direction.
    """
    draw = np.random.default_rng(SEED)
    turns = [np.linalg.qr(draw.normal(size=(size, size)))[0] for _ in range(ceil(DIRECTIONS / size))]
    return np.hstack(turns) * sqrt(size)


def misses_allowed(m: int) -> int:
    """Windows out of m that a row at the distance of the windows may miss."""
    p = 1 - erf(HALF / sqrt(2))
    return ceil(m * p + SURE * sqrt(m * p * (1 - p)))


class Index:
    """Sorted projections of a block of rows."""

    def __init__(self, points: np.ndarray, ids: np.ndarray, numbers: np.ndarray):
        self.points, self.ids, self.numbers = np.ascontiguousarray(points), ids, numbers
        self.scale = float(np.abs(points).max(initial=0)) or 1.0
        scaled = points / self.scale
        squares = (scaled * scaled).sum(axis=1)
        self.norm = sqrt(squares.max(initial=0))
        extra = np.sqrt(np.maximum(self.norm**2 - squares, 0))
        self.turn = directions(points.shape[1] + 1)
        places = np.hstack([scaled, extra[:, None]]) @ self.turn
        self.order = np.argsort(places, axis=0, kind="stable").T.copy()
        self.sorted = np.sort(places, axis=0).T.copy()
        self.allowed = misses_allowed(len(self.sorted))
        chosen = np.random.default_rng(SEED).permutation(len(points))[:SAMPLE]
        self.sample = scaled[chosen]

    def scores(self, rows: np.ndarray, query: np.ndarray) -> np.ndarray:
        """Inner products of the original vectors, each summed in the same order wherever its row stands."""
        return (self.points[rows] * query).sum(axis=1)

    def distance(self, cosines: np.ndarray) -> np.ndarray:
        """Distances from inner products with a query of length 1, all scaled: |x - q|^2 = 2 M^2 - 2 M x.q"""
        return np.sqrt(np.maximum(2 * self.norm * (self.norm - cosines), 0))

    def search(self, queries: np.ndarray, own: np.ndarray, best: int) -> list[tuple[np.ndarray, np.ndarray, int]]:
        """For every query (rows, scores, rows verified): the best rows found, best first, ties by id."""
        out = []
        for at in range(0, len(queries), TOGETHER):
            out += self._together(queries[at : at + TOGETHER], own[at : at + TOGETHER], best)
        return out

    def _together(self, queries: np.ndarray, own: np.ndarray, best: int) -> list[tuple[np.ndarray, np.ndarray, int]]:
        n, m, size = len(self.points), len(self.sorted), len(queries)
        length = np.abs(queries).max(axis=1, keepdims=True)
        unit = queries / length
        unit /= np.sqrt((unit * unit).sum(axis=1, keepdims=True))
        centre = np.hstack([unit * self.norm, np.zeros((size, 1))]) @ self.turn
        apart = self.distance(unit @ self.sample.T)
        reach = np.maximum(0.85 * apart.min(axis=1), 0.5 * np.median(apart, axis=1))
        reach = np.where(reach > 0, reach, self.norm)
        misses = np.full((size, n), m, np.int16)
        verified = np.zeros((size, n), bool)
        verified[:] = self.numbers == own[:, None]
        seen = verified.sum(axis=1)
        found = [(np.zeros(0, np.int64), np.zeros(0))] * size
        # at first every row is outside; then windows from the left end to each query's upper edge, and so on
        low, high = np.zeros((m, size), np.int64), np.zeros((m, size), np.int64)
        fresh = np.ones(size, bool)
        active = np.flatnonzero(seen < n)
        while len(active):
            half = HALF * reach[active]
            first, last = np.empty((m, len(active)), np.int64), np.empty((m, len(active)), np.int64)
            for j, values in enumerate(self.sorted):
                first[j] = values.searchsorted(centre[active, j] - half)
                last[j] = values.searchsorted(centre[active, j] + half, side="right")
            for k, q in enumerate(active):
                if fresh[q]:
                    # both ends of every array lie outside
                    ends = [part for o, i, j in zip(self.order, first[:, k], last[:, k]) for part in (o[:i], o[j:])]
                    misses[q] = np.bincount(np.concatenate(ends), minlength=n)
                    fresh[q] = False
                else:
                    sides = [*zip(self.order, first[:, k], low[:, q]), *zip(self.order, high[:, q], last[:, k])]
                    misses[q] -= np.bincount(np.concatenate([o[i:j] for o, i, j in sides]), minlength=n).astype(np.int16)
            low[:, active], high[:, active] = first, last
            going = []
            for q in active:
                new = np.flatnonzero((misses[q] <= self.allowed) & ~verified[q])
                rows, scores = found[q]
                if len(new):
                    verified[q, new] = True
                    seen[q] += len(new)
                    rows, scores = np.append(rows, new), np.append(scores, self.scores(new, queries[q]))
                    top = np.lexsort((self.ids[rows], -scores))[:best]
                    found[q] = rows, scores = rows[top], scores[top]
                if seen[q] < n:
                    near = len(rows) == best
                    if near:
                        cosine = scores[-1] / self.scale / length[q, 0] / np.sqrt(((queries[q] / length[q, 0]) ** 2).sum())
                        near = self.distance(cosine) <= reach[q]
                    if not near:
                        going.append(q)
            active = np.array(going, np.int64)
            reach[active] *= WIDER
        return [(rows, scores, int(k)) for (rows, scores), k in zip(found, seen)]


def _work(best: int):
    def work(rows: pa.Table, asked: pa.Table) -> pa.Table:
        points, queries = same_width(matrix(rows["vector"]), matrix(asked["vector"]))
        index = Index(points, rows["vec_id"].to_numpy(), rows[ROW].to_numpy())
        own, ids = asked[ROW].to_numpy(), asked["vec_id"].to_numpy()
        found = index.search(queries, own, best)
        size = [len(f[0]) for f in found]
        places = np.concatenate([f[0] for f in found]).astype(np.int64)
        columns = {"query_id": np.repeat(ids, size), "query_row": np.repeat(own, size), "vec_id": index.ids[places]}
        columns |= {"found_row": index.numbers[places], "score": np.concatenate([f[1] for f in found])}
        return pa.table(columns)

    return work


def prepared(df: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Rows with an id and a whole vector that is not zero, written once."""
    some = F.exists(F.col(vector), lambda x: x != 0)
    return usable(df, key, vector, "vectors", rows=whole(vector) & some)


def nearest(rows: DataFrame, queries: DataFrame, best: int = BEST) -> DataFrame:
    """(query_id, rank, vec_id, score): every query's ``best`` other rows by inner product, ties by id.

    ``rows`` as ``prepared`` makes them, ``queries`` some of them; a row is never its own neighbour.  Blocks of queries
    meet all blocks of rows, every row is indexed, and the blocks' best are merged.
    """
    names = "query_id bigint, query_row bigint, vec_id bigint, found_row bigint, score double"
    found = block_join(rows, queries, _work(best), names, ROWS_EACH, QUERIES_EACH)
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id", "found_row")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= best)
    return ranked.select("query_id", "rank", "vec_id", "score")


def contract(df: DataFrame) -> DataFrame:
    """The nearest rows of every row whose id is divisible by 20."""
    rows = prepared(df)
    return nearest(rows, rows.where(F.col("vec_id") % 20 == 0))
