from __future__ import annotations

from math import floor

import numpy as np
import pytest
from checks import compare
from pyspark.sql import functions as F

from tablewright.functions.blocks import ROW
from tablewright.llm import hard_negatives, nearest, queries

from .conftest import MEDIUM

SCHEMA = "vec_id bigint, embedding array<float>, label int"
ODD = [
    (None, [1.0, 2.0], 1),
    (1000, None, 1),
    (1001, [1.0, None], 1),
    (1002, [float("nan"), 1.0], 1),
    (1003, [float("inf"), 1.0], 1),
    (1004, [], 1),
    (1005, [0.0, 0.0], 2),
    (1006, [0.5], 2),
    (1007, [0.25, 0.5], None),
    (1100, [0.5, 0.5, 0.5, 0.5, 0.5, 0.5, 0.5, 0.5, 0.5, 0.5], 1),
    (20, [0.5, 0.25], 3),
]


def vectors(n=260, size=8, copies=60):
    """Vectors around a few centres, a large group of copies, and the odd cases."""
    draw = np.random.default_rng(5)
    points = draw.normal(size=(6, size))[draw.integers(0, 6, n)] + 0.4 * draw.normal(size=(n, size))
    points[100 : 100 + copies] = points[100]
    points = points.astype(np.float32)
    return [(i, [float(x) for x in p], int(draw.integers(0, 10))) for i, p in enumerate(points)] + ODD


def frame(spark, rows):
    extra = {c: F.lit("mine") for c in ("rank", "score", "anchor_id", "found_row", "query_id", "vector")}
    return spark.createDataFrame(rows, SCHEMA).repartition(3).withColumns(extra)


def finite(v):
    return v is not None and all(x is not None and np.isfinite(x) for x in v)


def dot(a, b):
    return sum(x * y for x, y in zip(a, b))


def brute_negatives(rows):
    held = [(r, i, (lab + 1) % 10 if i % 7 == 0 else lab, [floor(256 * x) for x in v]) for r, (i, v, lab) in enumerate(rows) if i is not None and lab is not None and finite(v)]
    out = []
    for r, i, lab, v in held:
        if i % 100:
            continue
        scored = sorted((-dot(v, w), j, s, other) for s, j, other, w in held if s != r)
        for p, pid, *_ in [x for x in scored if x[3] == lab][:5]:
            fits = [x for x in scored if x[3] != lab and 30 * -p <= 100 * -x[0] <= 90 * -p][:10]
            out += [(i, pid, k + 1, x[1], -p, -x[0]) for k, x in enumerate(fits)]
    return sorted(out)


@pytest.mark.parametrize(("rows_each", "anchors_each", "leaf"), [(16_384, 2_048, 64), (90, 2, 4)])
def test_negatives_equal_brute_force(spark, monkeypatch, rows_each, anchors_each, leaf):
    for name, value in (("ROWS_EACH", rows_each), ("ANCHORS_EACH", anchors_each), ("LEAF", leaf)):
        monkeypatch.setattr(hard_negatives, name, value)
    rows = vectors()
    names = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    got = hard_negatives.contract(frame(spark, rows)).select(*names)
    want = brute_negatives(rows)
    assert want and sorted(map(tuple, got.collect())) == want


def test_boxes_bound_scores_and_prune():
    draw = np.random.default_rng(1)
    centres = 300 * draw.normal(size=(40, 3))
    points = np.floor(centres[draw.integers(0, 40, 5_000)] + 5 * draw.normal(size=(5_000, 3)))
    tree = hard_negatives.Tree(points)
    anchors = points[:50]
    least, greatest = tree.bounds(anchors)
    scores = anchors @ tree.points.T
    leaf = tree.first[-2] + np.arange(5_000) // hard_negatives.LEAF
    assert (least[:, leaf] <= scores).all() and (scores <= greatest[:, leaf]).all()
    ids, read = np.arange(5_000), 0
    for i, a in enumerate(anchors):
        window = hard_negatives.Window_(5, ids)
        read += tree.search(a, least[i], greatest[i], [window], lambda places: places >= 0)
        best = np.lexsort((ids, -(points @ a)))[:5]
        assert sorted(-key for _, key, _ in window.heap) == sorted(best)
    assert read < 50 * len(points) / hard_negatives.LEAF / 4


def test_large_components_stay_exact(spark):
    big = float(2**40)
    rows = [(100, [big, 1.0], 1), (1, [1.0, 0.0], 1), (2, [0.5, 0.0], 2), (3, [0.5, 2.0**-8], 2)]
    got = hard_negatives.contract(spark.createDataFrame(rows, SCHEMA.replace("float", "double")))
    assert sorted(map(tuple, got.collect())) == brute_negatives(rows)


def brute_nearest(rows, best):
    held = [(r, i, np.array(v, float)) for r, (i, v, _) in enumerate(rows) if i is not None and finite(v) and any(v)]
    size = max(len(v) for *_, v in held)
    points = np.array([np.pad(v, (0, size - len(v))) for *_, v in held])
    ids = np.array([i for _, i, _ in held])
    out = {}
    for k, (r, i, _) in enumerate(held):
        if i % 20 == 0:
            scores = (points * points[k]).sum(axis=1)
            order = [j for j in np.lexsort((ids, -scores)) if j != k][:best]
            out[r] = (i, [(int(ids[j]), scores[j]) for j in order])
    return list(out.values())


def recall(got, want):
    lists = {}
    for q, rank, vec, score in got:
        lists.setdefault(q, []).append((rank, vec, score))
    hit = total = 0
    for q, expected in want:
        have = {v: s for _, v, s in lists.get(q, [])}
        hit += sum(v in have for v, _ in expected)
        total += len(expected)
        exact = dict(expected)
        assert all(abs(have[v] - exact[v]) < 1e-9 for v in have if v in exact)
    return hit / total


@pytest.mark.parametrize(("rows_each", "queries_each"), [(16_384, 1_024), (70, 4)])
def test_nearest_against_brute_force(spark, monkeypatch, rows_each, queries_each):
    monkeypatch.setattr(nearest, "ROWS_EACH", rows_each)
    monkeypatch.setattr(nearest, "QUERIES_EACH", queries_each)
    rows = [r for r in vectors() if r[0] != 20 or len(r[1]) > 2]
    names = ["query_id", "rank", "vec_id", "score"]
    got = sorted(map(tuple, nearest.contract(frame(spark, rows)).select(*names).collect()))
    want = brute_nearest(rows, 20)
    assert len(got) == 20 * len(want) and recall(got, want) >= 0.95
    for q, _ in want:
        mine = [(-s, v) for a, _, v, s in got if a == q]
        assert mine == sorted(mine) and q not in [v for _, v in mine]


def test_fewer_rows_than_asked_and_repeated_rows(spark):
    rows = [(0, [1.0, 0.0], 1), (1, [0.5, 0.5], 1), (1, [0.5, 0.5], 1), (2, [-1.0, 0.0], 1)]
    got = sorted(map(tuple, nearest.contract(spark.createDataFrame(rows, SCHEMA)).collect()))
    assert got == [(0, 1, 1, 0.5), (0, 2, 1, 0.5), (0, 3, 2, -1.0)]
    again = [(20, [3e200, 0.0], 1), (20, [3e200, 0.0], 1), (21, [1e-200, 0.0], 1)]
    got = nearest.contract(spark.createDataFrame(again, SCHEMA.replace("float", "double")))
    assert sorted(r.vec_id for r in got.collect()) == [20, 20, 21, 21]


def test_empty_vector_tables(spark):
    none, lone = spark.createDataFrame([], SCHEMA), spark.createDataFrame([(100, [1.0], 1)], SCHEMA)
    for df in (none, lone):
        assert nearest.contract(df).count() == 0 and hard_negatives.contract(df).count() == 0


def test_recall_of_the_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{MEDIUM}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    got = list(map(tuple, queries.op13_nearest_neighbours(spark, MEDIUM).collect()))
    assert recall(got, brute_nearest(rows, 20)) >= 0.95


def test_negatives_query_equals_sql(spark):
    con = compare.connect(MEDIUM)
    assert compare.differences("op12", spark, con, MEDIUM, queries.op12_hard_negatives, queries.NEGATIVES_SQL) is None
