from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from conftest import rows_of

from tablewright.operators import duplicates, repair

START = datetime(2024, 1, 1)


def sales(spark, rows):
    data = [(k, None if t is None else START + timedelta(milliseconds=t)) for k, t in rows]
    return spark.createDataFrame(data, "item string, at timestamp")


def brute_pairs(rows):
    """Pairs and rows by sorting each group, as the definition says."""
    by_item = {}
    for i, (k, t) in enumerate(rows):
        if t is not None:
            by_item.setdefault(k, []).append((t, i))
    pairs, involved = 0, set()
    for members in by_item.values():
        members.sort()
        for (t0, a), (t1, b) in zip(members, members[1:]):
            if t1 - t0 <= 1000:
                pairs += 1
                involved |= {a, b}
    return pairs, len(involved)


def brute_chains(rows):
    by_item = {}
    for k, t in rows:
        by_item.setdefault(k, []).append(t)
    out = []
    for k, times in by_item.items():
        out += [(k, None)] * times.count(None)
        times = sorted(t for t in times if t is not None)
        for i, t in enumerate(times):
            if i == 0 or t - times[i - 1] > 1000:
                out.append((k, START + timedelta(milliseconds=t)))
    return sorted(out, key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.fixture(params=["10m", "-1"], ids=["broadcast", "shuffled"])
def pruning(request, spark):
    """Repeated hashes are matched by broadcast, or as when they are too large for it."""
    name = "spark.sql.autoBroadcastJoinThreshold"
    spark.conf.set(name, request.param)
    yield
    spark.conf.unset(name)


CASES = {
    "empty": [],
    "one": [("a", 0)],
    "null times": [("a", None), ("a", None), ("a", 5)],
    "null item": [(None, 0), (None, 700), ("a", 700)],
    "exact": [("a", 0)] * 5,
    "chain": [("a", 0), ("a", 1000), ("a", 2000), ("a", 3001)],
    "edge of bucket": [("a", 999), ("a", 1999), ("a", 3000)],
    "before epoch": [("a", -86_400_000 * 20_000), ("a", -86_400_000 * 20_000 + 900)],
}


@pytest.mark.parametrize("name", CASES)
def test_near_duplicates(spark, pruning, name):
    rows = CASES[name]
    df = sales(spark, rows)
    assert tuple(duplicates.near_duplicates(df, "at").first()) == brute_pairs(rows)
    found = duplicates.near_duplicate_rows(df, "at")
    assert (found.groupBy().sum("copies").first()[0] or 0) == brute_pairs(rows)[1]
    assert rows_of(repair.collapse_near_duplicates(df, "at")) == brute_chains(rows)


def test_near_duplicates_random(spark, pruning, monkeypatch):
    rng = random.Random(5)
    # one item holds most rows, dense enough for long chains over many buckets and chunks
    rows = [("hot", rng.randrange(0, 400_000)) for _ in range(900)]
    rows += [(rng.choice("bcd"), rng.choice([None, *range(0, 60_000, 400)])) for _ in range(300)]
    df = sales(spark, rows)
    assert tuple(duplicates.near_duplicates(df, "at").first()) == brute_pairs(rows)
    monkeypatch.setattr(duplicates, "SPAN", 4)  # links over many edges of spans
    assert tuple(duplicates.near_duplicates(df, "at").first()) == brute_pairs(rows)
    assert rows_of(repair.collapse_near_duplicates(df, "at")) == brute_chains(rows)


def test_repair_then_detect_finds_nothing(spark):
    rows = CASES["chain"] + CASES["exact"] + [("b", 0), ("b", 400), ("b", 5000)]
    fixed = repair.collapse_near_duplicates(sales(spark, rows), "at")
    assert duplicates.near_duplicates(fixed, "at").first()["pairs"] == 0


def test_collapse_adds_measures(spark):
    data = [("a", 2, START), ("a", 2, START + timedelta(seconds=1)), ("b", 3, START)]
    df = spark.createDataFrame(data, "item string, units int, at timestamp")
    out = repair.collapse_near_duplicates(df, "at", sum_columns=["units"])
    assert rows_of(out, "item", "units") == [("a", 4), ("b", 3)]
    assert out.dtypes == [("item", "string"), ("units", "bigint"), ("at", "timestamp")]  # the type of a sum


def test_exact_duplicates(spark, pruning):
    nan = float("nan")
    data = [(1, None, nan), (1, None, nan), (2, "x", 0.0), (2, "x", -0.0), (3, "y", 1.0), (None, None, None)]
    df = spark.createDataFrame(data, "a int, b string, c double")
    assert duplicates.duplicate_groups(df).first()[:] == (4, 2)
    assert repair.drop_duplicates(df).count() == 4


def test_exact_duplicates_with_map_column(spark, pruning):
    df = spark.sql("SELECT map('k', 1) AS m, 1 AS a UNION ALL SELECT map('k', 1), 1 UNION ALL SELECT map('k', 2), 1")
    assert duplicates.duplicate_groups(df).first()[:] == (2, 1)


def mapped(spark):
    """Rows with a map, a map within a struct and an array; the first two are copies with entries in another order."""
    return spark.sql("""SELECT * FROM VALUES
      (1, map('k', 1, 'l', 2), named_struct('m', map('x', 1)), array(1), TIMESTAMP '2024-01-01 00:00:00'),
      (1, map('l', 2, 'k', 1), named_struct('m', map('x', 1)), array(1), TIMESTAMP '2024-01-01 00:00:00'),
      (1, map('k', 1, 'l', 2), named_struct('m', map('x', 1)), array(1), TIMESTAMP '2024-01-01 00:00:01'),
      (1, map('k', 2), named_struct('m', map('x', 1)), array(1), TIMESTAMP '2024-01-01 00:00:00'),
      (2, NULL, NULL, NULL, NULL) AS t(a, m, s, l, at)""")


def test_maps_in_all_operators_on_duplicates(spark, pruning):
    df = mapped(spark)
    assert duplicates.duplicate_groups(df).first()[:] == (2, 1)
    assert duplicates.duplicates_on_subset(df, ["m"]).count() == 3
    assert duplicates.duplicates_on_subset(df, ["a", "s"]).count() == 4
    assert duplicates.duplicates_on_subset(df.fillna(0, ["a"]), ["a"]).count() == 4
    for out in (repair.drop_duplicates(df), repair.collapse_near_duplicates(df, "at")):
        assert out.schema.simpleString() == df.schema.simpleString()
    assert repair.drop_duplicates(df).count() == 4 and repair.collapse_near_duplicates(df, "at").count() == 3
    near = duplicates.near_duplicate_rows(df, "at")
    assert near.drop("copies").schema.simpleString() == df.schema.simpleString()
    assert sorted((r.copies, r.m["k"], r.at.second) for r in near.collect()) == [(1, 1, 1), (2, 1, 0)]


def test_wide_columns_stay_out_of_the_search(spark):
    """Before candidates are known, only digests and moments are shuffled."""
    df = sales(spark, CASES["chain"])
    plan = duplicates.near_duplicates(df, "at")._jdf.queryExecution().executedPlan().toString()
    after = plan[: plan.rindex("Exchange")]
    assert "Exchange" in after and "item#" not in after.split("xxhash64")[0]


def test_collapse_reads_its_input_three_times(spark, tmp_path):
    """Also where chains and copies abound; the rest works on staged digests."""
    rows = [(f"i{k % 3}", 400 * (k // 3)) for k in range(600)] + [("alone", 0)] * 2
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(len(batch))
            yield batch

    df = sales(spark, rows).mapInPandas(count, "item string, at timestamp")
    assert repair.collapse_near_duplicates(df, "at").count() == 4
    assert seen.value <= 3 * len(rows)


def test_hash_collisions_do_not_matter(spark, monkeypatch):
    """Rows that share a hash but differ are not duplicates."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(duplicates.F, "xxhash64", lambda *c: F.lit(7).cast("bigint"))
    df = spark.createDataFrame([(1, "x"), (1, "x"), (2, "x")], "a int, b string")
    assert rows_of(duplicates.duplicate_rows(df)) == [(1, "x", 2)]


def test_duplicates_on_subset_null_keys(spark):
    data = [(None, 1, "p"), (None, 1, "q"), (1, None, "r"), (2, 2, "s")]
    df = spark.createDataFrame(data, "a int, b int, c string")
    assert rows_of(duplicates.duplicates_on_subset(df, ["a", "b"]), "c") == [("p",), ("q",)]
    assert duplicates.duplicates_on_subset(df.where("c = 's'"), ["a"]).count() == 0


def test_duplicate_key_conflicts(spark):
    data = [("T1", 100.0, "C1"), ("T1", 100.0, "C1"), ("T2", 50.0, "C2"), ("T2", 75.0, None), ("T3", 1.0, "C3")]
    df = spark.createDataFrame(data, "transaction_id string, amount double, customer_id string")
    out = duplicates.duplicate_key_conflicts(df, "transaction_id", ["amount", "customer_id"])
    assert rows_of(out) == [("T1", 2, 1, 1, True), ("T2", 2, 2, 2, False)]
