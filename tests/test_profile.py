from __future__ import annotations

from conftest import rows_of
from pyspark.sql import functions as F

from tablewright.operators import profile, rows

NAN = float("nan")


def mixed(spark):
    data = [
        (1, True, NAN, "a", None),
        (2, None, 1.5, "a", None),
        (3, False, -0.0, "b", None),
        (4, False, 0.0, None, None),
        (5, True, None, "a", None),
    ]
    return spark.createDataFrame(data, "id int, ok boolean, x double, kind string, none string")


def test_stats_count_nan_as_missing(spark):
    out = profile.column_stats(mixed(spark))
    expected = [("id", 5, 0, 5), ("kind", 5, 1, 2), ("none", 5, 5, 0), ("ok", 5, 1, 2), ("x", 5, 2, 2)]
    assert rows_of(out) == expected
    assert rows_of(profile.column_stats(mixed(spark), approximate=True)) == expected


def test_types(spark):
    kinds = {r["column"]: r["data_type"] for r in profile.column_types(mixed(spark), categorical_ratio=0.4).collect()}
    assert kinds == {"id": "numeric", "ok": "boolean", "x": "numeric", "kind": "categorical", "none": "categorical"}


def test_empty_table(spark):
    empty = mixed(spark).where("id > 9")
    out = profile.column_profile(empty, ["id"])
    assert {r["column"]: (r["rows"], r["missing_count"], r["unique_count"]) for r in out.collect()} == {
        c: (0, 0, 0) for c in empty.columns
    }
    assert profile.null_rates(empty).count() == 0
    assert profile.top_missing_observations(empty).first()["observation"] == profile.NO_SIGNAL_SENTENCE


def test_profile_sentence(spark, people):
    out = {r["column"]: r for r in profile.column_profile(people, ["id"]).collect()}
    name = out["name"]
    assert name["description"] == "Detected as string. 4 unique values with 1 missing entries out of 5."
    assert name["sample_values"] == ["Alice", "Bob", "David"]
    assert out["department"]["physical_type"] == "string"


def test_samples_from_far_rows(spark):
    """Values that start after the rows looked at first are still found, in key order."""
    df = spark.range(1000).select("id", F.when(F.col("id") >= 700, F.col("id") * 2).alias("late"))
    out = {r["column"]: r["sample_values"] for r in profile.sample_values(df, ["id"]).collect()}
    assert out == {"id": ["0", "1", "2"], "late": ["1400", "1402", "1404"]}


def test_a_profile_is_one_scan(spark, tmp_path):
    text = "id,kind,price,note\n" + "".join(f"{i},{'abc'[i % 3]},{i / 4 if i % 5 else ''},{'x' * (i % 9) if i > 50 else ''}\n" for i in range(200))
    (tmp_path / "a.csv").write_text(text)
    reader = spark.read.options(header=True, nullValue="").schema("id int, kind string, price double, note string")
    df = reader.csv("file:" + str(tmp_path / "a.csv"))
    for out in (profile.column_profile(df, ["id"]), profile.sample_values(df, ["id"]), profile.distinct_counts(df), profile.column_types(df)):
        assert out._jdf.queryExecution().executedPlan().toString().count("FileScan csv") == 1
    out = {r["column"]: r for r in profile.column_profile(df.repartition(7), ["id"]).collect()}
    assert (out["kind"].unique_count, out["price"].missing_count, out["price"].unique_count, out["note"].unique_count) == (3, 40, 160, 8)
    assert out["note"].sample_values == ["x" * (i % 9) for i in (51, 52, 53)] and out["price"].sample_values == ["0.25", "0.5", "0.75"]


def test_samples_in_key_order_whatever_the_key(spark):
    rows_ = [("b", None, "v1"), ("a", 2.0, "v2"), (None, 1.0, "v3"), ("a", float("nan"), "v4"), ("a", 2.0, "v2")]
    df = spark.createDataFrame(rows_, "k string, x double, v string").repartition(3)
    out = {r["column"]: r["sample_values"] for r in profile.sample_values(df, ["k", "x"], 4).collect()}
    assert out["v"] == ["v3", "v2", "v2", "v4"] and out["k"] == ["a", "a", "a", "b"] and out["x"] == ["1.0", "2.0", "2.0"]


def test_nested_and_binary_columns(spark):
    df = spark.sql(
        "SELECT 1 AS id, array(1, 2) AS a, map('k', 1) AS m, struct(1 AS x) AS s, X'FF' AS b, DATE'2024-01-01' AS d "
        "UNION ALL SELECT 2, array(1, 2), map('k', 2), NULL, X'FE', NULL"
    )
    out = rows_of(profile.distinct_counts(df))
    assert out == [("a", 1), ("b", 2), ("d", 1), ("id", 2), ("m", 2), ("s", 1)]


def test_observations(spark, people):
    out = profile.dataset_summary(people, "people", "five rows").first()
    assert (out["row_count"], out["column_count"]) == (5, 5)
    assert out["observations"] == ["name contient 1 valeurs manquantes"]


def test_numeric_summary(spark):
    out = rows_of(profile.numeric_summary(mixed(spark)))
    assert out[0] == ("id", 1.0, 5.0, 3.0)
    assert out[1][:3] == ("x", 0.0, 1.5)


def test_column_names_with_dots_and_spaces(spark):
    df = spark.createDataFrame([("a", None), ("a", 1.0)], "`Dept Fullname` string, `x.y` double")
    assert rows_of(profile.null_counts(df)) == [("Dept Fullname", 0), ("x.y", 1)]
    assert rows_of(profile.distinct_counts(df)) == [("Dept Fullname", 1), ("x.y", 1)]
    assert rows_of(rows.project_columns(df, ["x.y"])) == [(1.0,), (None,)]
    assert rows_of(rows.truncate_text(df, 1))[0] == ("a", 1.0)


def test_stratified_sample(spark):
    df = spark.range(1000)
    got = [r["id"] for r in rows.stratified_position_sample(df, "id").collect()]
    assert len(got) == len(set(got)) == 300 and got == sorted(got)
    assert got[:100] == list(range(100)) and got[-100:] == list(range(900, 1000))
    again = [r["id"] for r in rows.stratified_position_sample(df.repartition(7), "id").collect()]
    assert again == got
    assert rows.stratified_position_sample(spark.range(300), "id").count() == 300
    assert rows.stratified_position_sample(spark.range(0), "id").count() == 0


def test_stratified_sample_of_slightly_more_rows(spark):
    assert rows.stratified_position_sample(spark.range(301), "id").count() == 300


def test_random_sample_is_exact_and_stable(spark):
    df = spark.range(20_000)
    one = rows_of(rows.random_sample(df, ["id"], 500))
    two = rows_of(rows.random_sample(df.repartition(3), ["id"], 500))
    assert len(one) == 500 and one == two
    assert rows.random_sample(df, ["id"], 30_000).count() == 20_000
    other = rows_of(rows.random_sample(df, ["id"], 500, seed=1))
    assert other != one


def test_random_sample_of_a_million(spark):
    """No stage of one task, and exact where a hot key stands at the cut."""
    df = spark.range(3_000_000)
    sample = rows.random_sample(df, ["id"], 1_000_000)
    plan = sample._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan and "Limit" not in plan and "TakeOrdered" not in plan
    assert sample.count() == 1_000_000 and sample.distinct().count() == 1_000_000
    hot = spark.range(30_000).select(F.when(F.col("id") < 20_000, 7).otherwise(F.col("id")).alias("k"), "id")
    for n in (3_000, 15_000, 29_000):
        assert rows.random_sample(hot, ["k"], n).distinct().count() == n


def reference_csv_length(data, columns):
    """Characters of a CSV text with minimal quoting."""
    import csv
    import io

    buffer = io.StringIO()
    writer = csv.writer(buffer, lineterminator="\n")
    writer.writerow(columns)
    writer.writerows(data)
    return len(buffer.getvalue())


def test_csv_length(spark):
    data = [(1, 'say "hi"', "a,b"), (2, None, "line\nend"), (3, "", "plain")]
    df = spark.createDataFrame(data, "id int, t string, u string")
    total = df.agg(F.sum(rows.csv_row_length(df.columns))).first()[0] + rows.csv_header_length(df.columns)
    assert total == reference_csv_length(data, df.columns)


def test_token_budget(spark):
    df = spark.range(2000).select("id", F.lit("x" * 95).alias("t"))
    assert rows.token_budget_sample(df, ["id"], 100, 120_000)[1] == 100
    sample, n = rows.token_budget_sample(df, ["id"], 1000, 10_000)
    assert 10 <= n < 200 and sample.count() == n
    assert rows.token_budget_rows(df, ["id"], 1000, 1) == 10
    assert rows.token_budget_rows(df.limit(0), ["id"], 100, 10) == 10


def test_fit_to_budget_drops_columns_last(spark):
    df = spark.range(100).select("id", *[F.lit("v" * 50).alias(f"c{i}") for i in range(12)])
    fits = rows.fit_to_budget(df, ["id"], 100, 10**6)
    assert (fits.rows, fits.dropped_columns) == (100, [])
    fewer = rows.fit_to_budget(df, ["id"], 100, 20_000)
    assert 25 < fewer.rows < 100 and fewer.dropped_columns == [] and fewer.tokens <= 20_000
    narrow = rows.fit_to_budget(df, ["id"], 100, 5_000)
    assert narrow.rows == 25 and narrow.tokens <= 5_000
    assert narrow.dropped_columns == [f"c{i}" for i in range(11, 11 - len(narrow.dropped_columns), -1)]
    assert narrow.sample.count() == 25
    tiny = rows.fit_to_budget(df, ["id"], 100, 1)
    assert len(tiny.sample.columns) == 5
    assert rows.fit_to_budget(df.limit(0), ["id"]).rows == 0
