"""Cases that were wrong once: null keys, rules of one name, odd tokens, long lists, overflow, answers."""

from __future__ import annotations

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tablewright.functions import staging
from tablewright.functions.text import is_one_of
from tablewright.operators import repair, rows, rules
from tablewright.plans import analysis, cleaning
from tablewright.sources import catalog

from conftest import rows_of

ROLES = analysis.Roles(key="id", product="product", supplier="supplier", category="category", date="at")


def test_stratified_sample_with_a_null_key(spark):
    df = spark.range(1000).select(F.when(F.col("id") > 0, F.col("id")).alias("k"))
    got = [r.k for r in rows.stratified_position_sample(df, "k").collect()]
    assert len(got) == 300 and got.count(None) == 1


def test_rules_of_one_name_are_apart(spark):
    df = spark.range(5).toDF("x")
    found = rules.custom_rule(df, [rules.Rule("r", "x < 1"), rules.Rule("r", "x < 4"), rules.Rule("r", "nope < 1")])
    assert [(r.rule, r.success, r.affected_rows) for r in found.collect()] == [("r", True, 1), ("r", True, 4), ("r", False, None)]


def test_any_token(spark):
    df = spark.createDataFrame([(r" a\E ",), ("",), ("(x)",), (None,)], "t string")
    assert [r[0] for r in df.select(is_one_of(F.col("t"), [r"a\E"])).collect()] == [True, False, False, None]
    assert [r[0] for r in df.select(is_one_of(F.col("t"), ["(x)", ""])).collect()] == [False, True, True, None]


def test_all_categories_and_spellings_are_named(spark):
    data = [(i, "pen", f"ACME {i:02}", f"c{i:02}") for i in range(30)]
    df = spark.createDataFrame(data, "id bigint, product string, supplier string, category string")
    (issue,) = analysis.drift_issues(df, "d", ROLES).collect()
    assert issue.investigation.output["departments"] == ", ".join(f"c{i:02}" for i in range(30))
    roles = analysis.Roles(key="id", product="product", supplier="supplier", category="category", supplier_stem="Acme")
    found = {r.type: r for r in analysis.run_all_detectors(df, "d", roles).collect()}["supplier_variations"]
    assert found.investigation.output["examples"].count(",") == 29 and "ACME 05" not in found.description


def test_collapse_sums_in_a_wide_type(spark):
    at = datetime(2024, 1, 1)
    df = spark.createDataFrame([(at, 2_000_000_000), (at, 2_000_000_000), (at.replace(day=2), 7)], "at timestamp_ntz, units int")
    assert rows_of(repair.collapse_near_duplicates(df, "at", sum_columns=["units"]), "units") == [(4_000_000_000,), (7,)]


def test_mapping_leaves_nulls(spark):
    df = spark.createDataFrame([("a",), (None,), ("z",)], "t string")
    assert rows_of(repair.replace_mapping(df, "t", {"a": "b", None: "x"})) == [("b",), ("z",), (None,)]


def test_catalog_defaults_and_upsert(spark, tmp_path, folder):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "t.csv").write_text("a\n1\n")
    entries = catalog.describe_files(spark, f"{folder}/in")
    for _ in range(2):
        catalog.register(entries, f"{folder}/catalog")
    (row,) = catalog.load_catalog(spark, f"{folder}/catalog").collect()
    assert row.delimiter == "," and row.raw_filename == "raw.csv"


def test_answer_standardize_takes_the_most_frequent_spelling(spark):
    data = [(1, "ACME"), (2, "ACME"), (3, "Acme"), (4, "bob"), (5, "bob"), (6, "Bob")]
    df = spark.createDataFrame(data, "id bigint, supplier string")
    roles = analysis.Roles(key="id", supplier="supplier", supplier_stem="Acme")
    choices = "dataset_id string, issue_id string, type string, action string, value string"
    asked = spark.createDataFrame([("d", "i", "supplier_variations", "standardize_most_frequent", None)], choices)
    got = dict(rows_of(cleaning.apply_repairs(df, asked, "d", roles)))
    assert got == {1: "ACME", 2: "ACME", 3: "ACME", 4: "bob", 5: "bob", 6: "Bob"}
    plain = spark.createDataFrame([("d", "i", "supplier_variations", None, None)], choices)
    assert dict(rows_of(cleaning.apply_repairs(df, plain, "d", roles)))[1] == "Acme"


def test_a_cluster_without_a_shared_folder_is_refused(monkeypatch):
    class Context:
        master = "spark://host:7077"
        getCheckpointDir = staticmethod(lambda: None)

    class Conf:
        get = staticmethod(lambda *_: None)

    class Session:
        conf, sparkContext = Conf, Context

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        staging.shared_folder(Session)


def test_fit_to_budget_without_rows_or_columns_to_spare(spark):
    df = spark.range(60).selectExpr("id", *[f"repeat('x', 40) AS c{i}" for i in range(9)])
    fitted = rows.fit_to_budget(df, ["id"], 60, 2_500)
    assert fitted.rows == 25 and fitted.dropped_columns == [f"c{8 - i}" for i in range(len(fitted.dropped_columns))]
    assert fitted.sample.columns == ["id", *[f"c{i}" for i in range(9 - len(fitted.dropped_columns))]]
    assert fitted.tokens <= 2_500
