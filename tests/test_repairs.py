from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from conftest import rows_of
from pyspark.sql import functions as F

from tablewright.functions import scan
from tablewright.functions.text import collapse_blanks
from tablewright.operators import drift, formats, outliers, repair, variants, whitespace

START = datetime(2024, 1, 1)


def test_fill_default(spark):
    df = spark.createDataFrame([(None, None, None, None)], "i int, x double, t string, d date")
    assert rows_of(repair.fill_default(df)) == [(0, 0.0, "", None)]
    assert rows_of(repair.fill_default(df, ["t"])) == [(None, None, "", None)]


def test_fill_statistic(spark):
    data = [(1.0, "b", 1), (2.0, "a", 2), (9.0, "b", 6), (None, None, None), (float("nan"), "a", None)]
    df = spark.createDataFrame(data, "x double, t string, n int")
    out = repair.fill_statistic(df, {"x": "median", "t": "mode", "n": "mean"})
    assert rows_of(out.where("x = 2")) == [(2.0, "a", 2.0), (2.0, "a", 3.0), (2.0, "a", 3.0)]
    assert rows_of(repair.fill_report(df, ["x", "t"])) == [("t", 1), ("x", 2)]
    empty = df.where("n > 99")
    assert repair.fill_statistic(empty, {"x": "median", "t": "mode"}).count() == 0
    with pytest.raises(ValueError):
        repair.fill_statistic(df, {"x": "guess"})


def brute_forward(rows):
    out, last = [], {}
    for g, t, v in sorted(rows, key=lambda r: (r[1] is not None, r[1] or START)):
        if v is not None:
            last[g] = v
        out.append((g, t, last.get(g)))
    return sorted(out, key=lambda r: tuple((x is None, str(x)) for x in r))


def test_fill_forward(spark, partitions):
    rng = random.Random(4)
    moments = rng.sample(range(0, 86_400 * 40), 400)
    groups = ["hot"] * 300 + [rng.choice(["b", "c", None]) for _ in range(100)]
    data = [(g, START + timedelta(seconds=m), rng.choice([None, None, None, f"v{m}"])) for g, m in zip(groups, moments)]
    df = spark.createDataFrame(data, "g string, at timestamp, v string")
    for parts in (1, 4, 37):
        partitions(parts)
        out = repair.fill_forward(df, "v", ["g"], "at")
        assert out.columns == df.columns
        assert rows_of(out) == brute_forward(data)


def parts_of(monkeypatch):
    """Rows of each partition that the scan has filled."""
    seen = []
    stage = scan.stage
    monkeypatch.setattr(scan, "stage", lambda df, label: seen.append(stage(df, label)) or seen[-1])
    return lambda: [r["count"] for r in seen[0].where("kind = 0").groupBy("part").count().collect()]


def test_one_group_inside_one_day_is_spread(spark, monkeypatch, partitions):
    """Every 50th row has a value; what enters a task comes from the tasks before it, also over empty ones."""
    partitions(8)
    sizes = parts_of(monkeypatch)
    ids = F.col("id")
    df = spark.range(8_000).select(
        F.lit("hot").alias("g"),
        (F.lit(START) + F.make_dt_interval(secs=ids)).cast("timestamp").alias("at"),
        F.when((ids % 50 == 0) & ~ids.between(1_000, 5_000), ids.cast("string")).alias("v"),
        ids,
    )
    out = repair.fill_forward(df, "v", ["g"], "at")
    want = F.when(ids.between(1_000, 5_049), F.lit("950")).otherwise((ids - ids % 50).cast("string"))
    assert out.where(~F.col("v").eqNullSafe(want)).count() == 0 and out.count() == 8_000
    assert len(sizes()) == 8 and max(sizes()) < 2_000


def test_a_group_without_times_is_spread(spark, monkeypatch, partitions):
    partitions(8)
    sizes = parts_of(monkeypatch)
    df = spark.range(8_000).selectExpr("'hot' AS g", "CAST(NULL AS TIMESTAMP) AS at", "id", "IF(id % 4 = 0, id, NULL) AS v")
    out = repair.fill_forward(df, "v", ["g"], "at", ["id"])
    assert out.where("v <> id - id % 4 OR v IS NULL").count() == 0
    assert len(sizes()) == 8 and max(sizes()) < 2_000
    # copies of one row, at one moment, are spread as well
    same = spark.range(8_000).selectExpr("'hot' AS g", "TIMESTAMP '2024-01-01' AS at", "CAST(NULL AS STRING) AS v")
    known = same.limit(1).selectExpr("g", "at - INTERVAL 1 DAY AS at", "'known' AS v")
    sizes = parts_of(monkeypatch)
    out = repair.fill_forward(same.unionAll(known), "v", ["g"], "at")
    assert out.where("v = 'known'").count() == 8_001 and max(sizes()) < 2_000


def test_fill_forward_keeps_all_types_and_names(spark):
    df = spark.sql(
        "SELECT * FROM VALUES (1, map('a', 1), array(1.5D), named_struct('x', 1), CAST(2 AS DECIMAL(9, 2)), TIMESTAMP '1900-01-01', X'00', 'v'),"
        " (1, NULL, NULL, NULL, NULL, TIMESTAMP '1901-01-01', NULL, NULL) AS t(`a.b`, m, l, s, d, `Sale Date`, b, `v``x`)"
    )
    for name in ("m", "l", "s", "d", "b", "v`x"):
        out = repair.fill_forward(df, name, ["a.b"], "Sale Date")
        assert out.schema.simpleString() == df.schema.simpleString()
        first, second = out.orderBy("Sale Date").collect()
        assert first[name] == second[name] and first[name] is not None


def test_fill_forward_groups_as_spark_groups(spark):
    nan = float("nan")
    data = [(0.0, None, 1, "a"), (-0.0, None, 2, None), (nan, "x", 1, "n"), (nan, "x", 2, None), (None, "y", 1, "m"), (None, "y", 2, None), (None, None, 3, None)]
    df = spark.createDataFrame(data, "g double, h string, at int, v string").withColumn("at", F.timestamp_seconds("at"))
    out = repair.fill_forward(df, "v", ["g", "h"], "at")
    assert rows_of(out, "v") == [("a",), ("a",), ("m",), ("m",), ("n",), ("n",), (None,)]
    assert repair.fill_forward(df.where("at IS NULL"), "v", ["g"], "at").count() == 0


def test_fill_forward_several_groups_and_types(spark):
    data = [(1, None, START, 5.0), (1, None, START + timedelta(days=3), float("nan")), (1, "x", START, None)]
    df = spark.createDataFrame(data, "a int, b string, at timestamp, v double")
    out = repair.fill_forward(df, "v", ["a", "b"], "at")
    assert rows_of(out, "b", "v") == [("x", None), (None, 5.0), (None, 5.0)]


def test_fill_lookup(spark):
    data = [(1, "Aspirin"), (1, "Aspirin"), (1, "aspirin"), (1, None), (1, " NULL "), (2, None), (None, None)]
    df = spark.createDataFrame(data, "barcode int, product string")
    out = repair.fill_lookup(df, "product", "barcode", tokens=("", "NULL", "null"))
    assert rows_of(out.where("barcode = 1").groupBy("product").count()) == [("Aspirin", 4), ("aspirin", 1)]
    assert out.where("product IS NULL").count() == 2 and out.count() == 7
    given = spark.createDataFrame([(2, "Plaster")], "key int, value string")
    assert repair.fill_lookup(df, "product", "barcode", given).where("product = 'Plaster'").count() == 1


def test_dedupe_by_key(spark):
    data = [(1, 2, "b"), (1, 1, "a"), (1, None, "n"), (None, 1, "x"), (None, 2, "y")]
    df = spark.createDataFrame(data, "k int, at int, v string")
    assert rows_of(repair.dedupe_by_key(df, ["k"], ["at"]), "v") == [("a",), ("x",)]
    assert rows_of(repair.dedupe_by_key(df, ["k"], ["at"], "last"), "v") == [("b",), ("y",)]


def test_a_hot_key_is_cut_before_the_shuffle(spark):
    df = spark.range(1000).selectExpr("id % 2 AS k", "id AS at")
    plan = repair.dedupe_by_key(df, ["k"], ["at"])._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Final") < plan.index("Exchange") < plan.index("Partial")


def test_cast_and_report(spark):
    df = spark.createDataFrame([(" 1 ", "x"), ("2.5", "2024-01-01"), (None, None)], "n string, d string")
    types = {"n": "double", "d": "date"}
    assert rows_of(repair.cast_types(df, types), "n") == [(1.0,), (2.5,), (None,)]
    assert rows_of(repair.cast_report(df, types)) == [("d", "date", 1), ("n", "double", 0)]


def test_parse_dates_then_nothing_is_invalid(spark):
    df = spark.createDataFrame([("2024-01-31",), ("31/12/2024",), ("soon",)], "d string")
    out = repair.parse_dates(df, "d")
    assert rows_of(out.where("d IS NOT NULL")) == [(datetime(2024, 1, 31),), (datetime(2024, 12, 31),)]
    assert formats.invalid_dates(out, "d").count() == 0


def test_trim_then_no_blanks(spark):
    df = spark.createDataFrame([(" a  b ",), ("c\td",), (None,)], "t string")
    out = repair.trim_collapse(df, ["t"])
    assert rows_of(out) == [("a b",), ("c d",), (None,)]
    assert whitespace.whitespace_normalize(out, "t").count() == 0


def test_spellings(spark):
    at = [START + timedelta(days=i) for i in range(5)]
    data = [("Acme Corp", at[0]), ("Acme Corp", at[1]), ("ACME  CORP", at[3]), ("acme corp", at[2]), ("Zenith", at[4]), (None, at[0])]
    df = spark.createDataFrame(data, "s string, at timestamp")
    frequent = repair.standardize_most_frequent(df, "s")
    assert rows_of(frequent.groupBy("s").count()) == [("Acme Corp", 4), ("Zenith", 1), (None, 1)]
    assert variants.case_space_variants(frequent, "s").count() == 0
    recent = repair.standardize_most_recent(df, "s", "at")
    assert rows_of(recent.groupBy("s").count()) == [("ACME  CORP", 4), ("Zenith", 1), (None, 1)]
    assert rows_of(repair.standardize_title_case(df.limit(1), "s"), "s") == [("Acme Corp",)]


def test_mappings(spark):
    df = spark.createDataFrame([("a",), ("b",), (None,)], "s string")
    assert rows_of(repair.replace_mapping(df, "s", {"a": "x", "b": "a"})) == [("a",), ("x",), (None,)]
    assert rows_of(repair.standardize_canonical(df, "s", "z", ["a", "b"])) == [("z",), ("z",), (None,)]


def test_canonical_category(spark):
    data = [("p", "A"), ("p", "B"), ("p", "B"), ("p", None), ("q", "C"), (None, "A")]
    df = spark.createDataFrame(data, "p string, c string")
    out = repair.canonical_category(df, "p", "c")
    assert rows_of(out) == [("p", "B")] * 3 + [("p", None), ("q", "C"), (None, "A")]
    assert drift.category_drift(out, "p", "c").count() == 0
    assert repair.canonical_category(df, "p", "c", fill_nulls=True).where("c IS NULL").count() == 0


def test_cap_and_remove(spark):
    df = spark.createDataFrame([(float(v),) for v in [*range(1, 12), 900, -900]] + [(None,)], "x double")
    fences = outliers.iqr_fences(df, "x")
    capped = repair.cap_outliers(df, "x")
    assert outliers.outliers_iqr(capped, "x", fences=fences).count() == 0 and capped.count() == 14
    assert repair.remove_outliers(df, "x").count() == 12


def test_preview_and_report(spark):
    df = spark.createDataFrame([("a ", 1), ("a ", 2), ("b", 3), (None, 4)], "t string, n int")
    out = repair.replace_column(df, "t", collapse_blanks(F.col("t")), keep_before="old")
    assert rows_of(repair.change_preview(out, "old", "t")) == [("a ", "a", 2)]
    report = repair.correction_report(out, [("old", "t")], kept=F.col("n") > 1)
    assert rows_of(report) == [("t", 4, 3, 1)]
