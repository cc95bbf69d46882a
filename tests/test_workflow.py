from __future__ import annotations

from datetime import datetime

import numpy as np
import pytest
from conftest import rows_of
from pyspark.sql import functions as F

from tablewright.functions.issues import ISSUE_SCHEMA, issue_id, severity_from_ratio
from tablewright.operators import context, workflow
from tablewright.plans import analysis, cleaning

NOW = datetime(2024, 1, 1)
LATER = datetime(2024, 1, 2)


def issues(spark, *rows):
    data = [
        {"dataset_id": "d", "id": i, "type": t, "severity": "medium", "category": c, "affectedRows": n, "affectedColumns": ["x"]}
        for i, t, c, n in rows
    ]
    filled = [tuple(r.get(f.name) for f in ISSUE_SCHEMA) for r in data]
    return spark.createDataFrame(filled, ISSUE_SCHEMA)


@pytest.fixture
def found(spark):
    return issues(
        spark,
        ("d_a", "missing_values", "quick_fixes", 3),
        ("d_b", "category_drift", "smart_fixes", None),
        ("d_c", "supplier_variations", "smart_fixes", 5),
    )


def decided(spark, *rows):
    return spark.createDataFrame([("d", *r) for r in rows], "dataset_id string, issue_id string, accepted boolean, reason string, updated_at timestamp")


def test_severity_edges(spark):
    df = spark.createDataFrame([(0.25,), (0.2499,), (0.10,), (0.0999,), (0.0,)], "r double")
    assert [r[0] for r in df.select(severity_from_ratio(F.col("r"))).collect()] == ["high", "medium", "medium", "low", "low"]


def test_issue_id(spark):
    row = spark.range(1).select(issue_id(F.lit("dataset_1"), F.lit("category_drift_Cough Syrup"))).first()
    assert row[0] == "dataset_1_category_drift_cough_syrup"


def test_normalize(spark):
    raw = spark.createDataFrame([("d", None, "x", None)], "dataset_id string, id string, description string, severity string")
    got = workflow.normalize_issues(raw).first()
    assert (got["id"], got["category"], got["severity"], got["type"]) == ("d_unknown", "quick_fixes", "medium", None)
    analyses = spark.createDataFrame(
        [("d", None, None), ("e", [("1",)], None)], "dataset_id string, issues array<struct<id:string>>, completedAt timestamp"
    )
    good, bad = workflow.normalize_analyses(analyses, F.lit(NOW))
    assert rows_of(good, "dataset_id", "completedAt") == [("e", NOW)] and rows_of(bad, "dataset_id") == [("d",)]


@pytest.mark.parametrize(
    "text,expected",
    [
        ('Sure! {"k": 1} bye', 1),
        ('```json\n{"k": 2}\n```', 2),
        ('{"k": 3}', 3),
        ('note } then {"k": 4}', 4),
        ("```\nnothing\n```", None),
        ("} {", None),
        ("", None),
        (None, None),
    ],
)
def test_json_payload(spark, text, expected):
    df = spark.createDataFrame([(text,)], "t string")
    got = workflow.extract_json_payload(df, "t", "struct<k:int>").first()["payload"]
    assert (got["k"] if got else None) == expected


def test_code_fences_are_stripped(spark):
    df = spark.createDataFrame([("```json\n[1, 2]\n```",)], "t string")
    assert df.select(workflow.extract_json_text(F.col("t"))).first()[0].strip() == "[1, 2]"


def test_report_lines(spark):
    lines = [
        "[MISSING_VALUES] ERROR: Column 'age' has 12 missing values. Example rows: [0, 15, 42].",
        "- [DUPLICATE_ROWS] ERROR: There are 5 duplicate rows. Example rows: [10, 11].",
        "[RARE_CATEGORY] WARNING: Column 'status' has rare category 'XYZ' (1 occurrence). Example row: [7].",
        "[SUMMARY] INFO: Column 'age' (numeric) - min=18, max=87, mean=45.2.",
        "Shape: 3 rows x 2 columns",
    ]
    df = spark.createDataFrame([(x,) for x in lines], "value string")
    got = rows_of(workflow.parse_report_lines(df), "report_category", "type", "severity", "column", "affected_rows", "row_ids")
    assert got == [
        ("DUPLICATE_ROWS", "duplicates", "high", None, 5, [10, 11]),
        ("MISSING_VALUES", "missing_values", "high", "age", 12, [0, 15, 42]),
        ("RARE_CATEGORY", "inconsistent_categories", "medium", "status", 1, [7]),
        ("SUMMARY", "other", "low", "age", None, []),
    ]


def test_rendered_report_parses_back(spark, found):
    report = workflow.render_report(found, 10, 2)
    assert [r["line"] for r in report.limit(3).collect()] == [workflow.REPORT_TITLE, workflow.REPORT_RULE, "Shape: 10 rows x 2 columns"]
    back = workflow.parse_report_lines(report, "line")
    assert rows_of(back, "type", "affected_rows") == [("category_drift", 0), ("missing_values", 3), ("supplier_variations", 5)]


def test_later_decision_wins(spark):
    old = decided(spark, ("a", True, None, NOW), ("b", True, "old", LATER))
    new = decided(spark, ("a", False, "no", NOW), ("b", False, "stale", NOW), ("c", True, None, NOW))
    got = rows_of(workflow.decision_upsert(old, new), "issue_id", "accepted", "reason")
    assert got == [("a", False, "no"), ("b", True, "old"), ("c", True, None)]


def test_plan(spark, found):
    choices = decided(spark, ("d_a", True, "fine", NOW), ("d_b", False, None, NOW))
    assert rows_of(workflow.apply_decisions(found, choices), "id", "accepted") == [("d_a", True), ("d_b", False), ("d_c", None)]
    plan = workflow.cleaning_plan(found, choices)
    assert rows_of(plan, "issue_id", "status", "decision_reason") == [
        ("d_a", "accepted", "fine"),
        ("d_b", "rejected", None),
        ("d_c", "pending", None),
    ]
    assert workflow.plan_summary(plan).first()[:] == ("d", 1, 1, 1)
    assert workflow.plan_summary(plan.where("status = 'pending'")).first()[:] == ("d", 0, 0, 1)


def test_apply(spark, found):
    done = spark.createDataFrame([("d", "d_c", NOW)], "dataset_id string, issue_id string, updated_at timestamp")
    asked = spark.createDataFrame(
        [("d", x, i) for i, x in enumerate(["d_a", "nope", "d_a", "d_c", "d_b"])], "dataset_id string, issue_id string, position bigint"
    )
    out = workflow.apply_issues(found, done, asked)
    assert [r["outcome"] for r in out.orderBy("position").collect()] == [
        "applied", "skipped_unknown", "skipped_repeated", "skipped_applied", "applied",
    ]
    assert workflow.apply_message(out).first()["message"] == "Applied 2 issues; 3 skipped"
    assert workflow.decisions_from_applied(out, F.lit(NOW)).count() == 2


def test_unknown_issue_is_not_recorded(spark, found):
    updates = decided(spark, ("d_a", True, None, NOW), ("nope", True, None, NOW))
    got = workflow.record_decision(found, decided(spark), updates)
    assert rows_of(got, "issue_id") == [("d_a",)]


def test_smart_fixes(spark, found):
    data = [("d_a", "keep", LATER), ("d_b", " standardize ", NOW), ("d_b", "  ", LATER), ("d_c", "keep", NOW), ("d_c", "Acme", LATER)]
    answers = spark.createDataFrame([("d", *r) for r in data], "dataset_id string, issue_id string, response string, updated_at timestamp")
    assert rows_of(workflow.smart_fix_responses(found, answers), "issue_id", "response") == [("d_b", "standardize"), ("d_c", "Acme")]
    got = rows_of(workflow.resolve_smart_fix(found, answers), "issue_id", "action", "value")
    assert got == [("d_b", "canonical_category", None), ("d_c", "standardize_canonical", "Acme")]


def test_totals_and_history(spark, found):
    assert rows_of(workflow.category_totals(found)) == [("quick_fixes", 1, 3), ("smart_fixes", 2, 5)]
    assert workflow.analysis_summary(found).first()["summary"] == "Found 3 issues across 3 categories."
    runs = spark.range(30).selectExpr("cast(id % 2 as string) AS dataset_id", "cast(id as string) AS analysis_id", "id AS completed_at")
    kept = workflow.analysis_history(runs, 10)
    assert kept.count() == 20 and kept.agg(F.min("completed_at")).first()[0] == 10


SALES = "`Sale ID` int, Product string, OrderList string, `Dept Fullname` string, `Sale Date` timestamp"
ROLES = analysis.Roles(key="Sale ID")


def sales(spark):
    rows = [
        (1, "Aspirin", "Pharmax", "OTC", datetime(2024, 1, 1, 8)),
        (1, "Aspirin", "Pharmax", "OTC", datetime(2024, 1, 1, 8)),
        (2, " Aspirin", "PHARMAX", "OTC", datetime(2024, 1, 2, 8)),
        (3, "Aspirin", "Medico", "OTC:Cold&Flu", datetime(2024, 5, 1, 8)),
        (4, None, "Medico", "OTC", datetime(2024, 5, 2, 8)),
        (5, "Plaster", "Medico", "Care", datetime(2024, 5, 3, 8, 0, 0)),
        (5, "Plaster", "Medico", "Care", datetime(2024, 5, 3, 8, 0, 1)),
    ]
    return spark.createDataFrame(rows, SALES)


@pytest.mark.parametrize("isolate", [False, True])
def test_all_detectors(spark, isolate):
    out = analysis.run_all_detectors(sales(spark), "d1", ROLES, isolate=isolate)
    got = [(r["id"], r["severity"], r["affectedRows"]) for r in out.orderBy("position").collect()]
    assert got == [
        ("d1_missing_product", "medium", 1),
        ("d1_exact_duplicates", "high", 2),
        ("d1_product_whitespace", "medium", 1),
        ("d1_supplier_variations", "medium", 1),
        ("d1_category_drift_aspirin", "medium", 3),
        ("d1_near_duplicates", "medium", 4),
    ]
    assert out.where("type = 'near_duplicates'").first()["investigation"]["output"]["pair_count"] == "2"


def test_evidence_shows_what_a_repair_changes(spark):
    found = {r["type"]: r["investigation"] for r in analysis.run_all_detectors(sales(spark), "d1", ROLES).collect()}
    shown = {t: [(e["current"], e["fixed"]) for e in i["evidence"]] for t, i in found.items()}
    assert shown == {
        "missing_values": [(None, "")],
        "duplicates": [("2 copies of 1", "1 row of 1")],
        "whitespace": [(" Aspirin", "Aspirin")],
        "supplier_variations": [("PHARMAX", "Pharmax")],
        "category_drift": [("OTC:Cold&Flu", "OTC")],
        "near_duplicates": [
            ("2024-01-01 08:00:00, 2024-01-01 08:00:00", "2024-01-01 08:00:00"),
            ("2024-05-03 08:00:00, 2024-05-03 08:00:01", "2024-05-03 08:00:00"),
        ],
    }
    assert found["whitespace"]["output"]["examples"] == "2: ' Aspirin'"
    assert found["near_duplicates"]["output"]["example_pairs"].startswith("1: 2024-01-01 08:00:00, 2024-01-01 08:00:00; 5: ")


def test_many_values_are_named_in_part_and_listed_whole(spark):
    """A drifting product with more categories, and more spellings, than an issue names."""
    n = 3 * analysis.NAMED
    rows = spark.range(2 * n).selectExpr("id", "'pen' AS product", f"concat('ACME ', id % {n}) AS supplier", f"concat('c', lpad(id % {n}, 4, '0')) AS category")
    roles = analysis.Roles(key="id", product="product", supplier="supplier", category="category", supplier_stem="Acme")
    found = {r.type: r for r in analysis.run_all_detectors(rows, "d", roles).collect()}
    named = found["category_drift"].investigation["output"]["departments"]
    assert named.startswith("c0000, c0001, ") and named.endswith(f"c{analysis.NAMED - 1:04}, … ({n} in all)")
    assert found["supplier_variations"].investigation["output"]["examples"].endswith(f" … ({n} in all)")
    details = analysis.issue_details(rows, "d", roles)
    drift = details.where("issue_id = 'd_category_drift_pen'").orderBy("position").collect()
    assert [(r.position, r.value, r.rows) for r in drift] == [(i, f"c{i:04}", 2) for i in range(n)]
    assert details.where("issue_id = 'd_supplier_variations'").count() == n


def test_a_row_check_that_fails_while_it_runs_leaves_the_others(spark, monkeypatch):
    needed, _, entry = analysis.ROW_CHECKS["whitespace"]
    broken = lambda df, r: F.raise_error(F.lit("broken")).cast("boolean")
    monkeypatch.setitem(analysis.ROW_CHECKS, "whitespace", (needed, broken, entry))
    types = [r["type"] for r in analysis.run_all_detectors(sales(spark), "d1", ROLES).collect()]
    assert sorted(types) == ["category_drift", "duplicates", "missing_values", "near_duplicates", "supplier_variations"]


def test_detectors_without_their_columns(spark, people):
    out = analysis.run_all_detectors(people, "d2", analysis.Roles(key="id"))
    assert out.count() == 0
    assert analysis.run_all_detectors(people.union(people), "d2", analysis.Roles(key="id")).first()["affectedRows"] == 10


def test_text_dates(spark):
    good = sales(spark).withColumn("Sale Date", F.date_format("Sale Date", "yyyy-MM-dd HH:mm:ss"))
    types = {r["type"] for r in analysis.run_all_detectors(good, "d", ROLES).collect()}
    assert "near_duplicates" in types
    bad = good.withColumn("Sale Date", F.when(F.col("Sale ID") == 3, "soon").otherwise(F.col("Sale Date")))
    types = {r["type"] for r in analysis.run_all_detectors(bad, "d", ROLES).collect()}
    assert "near_duplicates" not in types and "duplicates" in types


def test_one_failing_detector_does_not_stop_the_others(spark, monkeypatch):
    def fail(*args, **kwargs):
        raise RuntimeError("broken")

    monkeypatch.setattr(analysis, "drift_issues", fail)
    out = analysis.run_all_detectors(sales(spark), "d1", ROLES)
    assert out.count() == 5


def test_accepted_issues_are_repaired(spark):
    df = sales(spark)
    found = analysis.without_position(analysis.run_all_detectors(df, "d1", ROLES))
    choices = found.select("dataset_id", F.col("id").alias("issue_id"), F.lit(True).alias("accepted"), F.lit(None).cast("string").alias("reason"))
    plan = workflow.cleaning_plan(found, choices)
    none = spark.createDataFrame([], "dataset_id string, issue_id string, action string, value string")
    fixed = cleaning.apply_repairs(df, cleaning.accepted_repairs(plan, none), "d1", ROLES)
    after = {r["type"] for r in analysis.run_all_detectors(fixed, "d1", ROLES).collect()}
    assert after <= {"missing_values"}  # an unknown product stays blank without a lookup
    assert fixed.count() == 5


def test_only_accepted_products_are_reclassified(spark):
    data = [("p", "A"), ("p", "A"), ("p", "B"), ("q", "A"), ("q", "B"), ("q", "B"), ("r", "A"), ("r", "B"), ("r", "B")]
    df = spark.createDataFrame(data, "Product string, `Dept Fullname` string")
    choices = spark.createDataFrame(
        [("d", "d_category_drift_p", "category_drift", None), ("d", "d_category_drift_q", "category_drift", "C")],
        "dataset_id string, issue_id string, type string, value string",
    )
    out = cleaning.apply_repairs(df, choices, "d", analysis.Roles(key="Product"))
    assert rows_of(out.groupBy("Product", "Dept Fullname").count()) == [
        ("p", "A", 3), ("q", "C", 3), ("r", "A", 1), ("r", "B", 2),
    ]


def test_an_answer_decides_what_is_done(spark):
    plan = spark.createDataFrame(
        [("d", "a", "category_drift", "accepted"), ("d", "b", "supplier_variations", "accepted"), ("d", "c", "duplicates", "rejected")],
        "dataset_id string, issue_id string, type string, status string",
    )
    resolved = spark.createDataFrame(
        [("d", "a", "no_change", None), ("d", "b", "standardize_canonical", "Acme")],
        "dataset_id string, issue_id string, action string, value string",
    )
    assert rows_of(cleaning.accepted_repairs(plan, resolved), "issue_id", "value") == [("b", "Acme")]


def test_rows_to_text(spark, people):
    lines = [r["line"] for r in context.rows_to_text(people.select("id", "name"), ["id"], "p.xlsx", 3).collect()]
    assert lines[0].endswith("p.xlsx.") and lines[1] == "Colonnes : id, name."
    assert lines[3:] == ["Ligne 1 : id = 1; name = Alice", "Ligne 2 : id = 2; name = Bob", "Ligne 3 : id = 3"]


def test_session_history(spark):
    turns = spark.createDataFrame([(1, t, "user", f"m{t}") for t in range(60)] + [(2, 0, "user", "hi")], "conv_id int, turn int, role string, text string")
    new = spark.createDataFrame([(1, "user", "new", 1), (3, "user", "first", 1)], "conv_id int, role string, text string, seq int")
    out = {r["conv_id"]: r["messages"] for r in context.session_history(context.append_turns(turns, new)).collect()}
    assert [m["turn"] for m in out[1]] == list(range(11, 61)) and out[1][-1]["text"] == "new"
    assert [m["text"] for m in out[3]] == ["first"] and out[3][0]["turn"] == 0


@pytest.mark.parametrize(("rows_each", "queries_each"), [(32_768, 16_384), (30, 2)])
def test_similar_context(spark, monkeypatch, rows_each, queries_each):
    monkeypatch.setattr(context, "ROWS_EACH", rows_each)
    monkeypatch.setattr(context, "QUERIES_EACH", queries_each)
    monkeypatch.setattr(context, "QUERIES_AT_ONCE", 3)
    rng = np.random.default_rng(0)
    vectors = rng.normal(size=(200, 8))
    vectors[50:120] = vectors[0]  # a large group of copies
    vectors[7] = 0
    asked = np.vstack([vectors[0], rng.normal(size=(6, 8))])
    schema = "vec_id bigint, embedding array<double>"
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)] + [(999, None)], schema)
    queries = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(asked)], "query int, embedding array<double>")
    norms = np.linalg.norm(vectors, axis=1)
    norms[norms == 0] = 1
    scores = np.round((vectors / norms[:, None]) @ (asked / np.linalg.norm(asked, axis=1, keepdims=True)).T, 9)
    expected = []
    for q in range(len(asked)):
        order = sorted(range(200), key=lambda i: (-scores[i, q], i))[:4]
        expected += [(q, i, r + 1) for r, i in enumerate(order)]
    got = context.similar_context(df.repartition(3), queries, 4)
    assert sorted(tuple(r) for r in got.select("query", "vec_id", "rank").collect()) == sorted(expected)


def test_similar_context_keeps_queries_off_the_driver(spark, monkeypatch):
    """Nothing is collected, and each side is read from its input once."""
    rows = [(i, [float(i), 1.0]) for i in range(40)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(len(batch))
            yield batch

    queries = df.select(F.col("vec_id").alias("query"), "embedding").mapInPandas(count, "query bigint, embedding array<double>")
    for name in ("collect", "toLocalIterator", "toPandas"):
        monkeypatch.setattr(type(df), name, lambda *a, **k: pytest.fail("rows went to the driver"))
    found = context.similar_context(df, queries, 2)
    assert found.count() == 80 and seen.value == 40


def test_similar_context_without_queries(spark):
    df = spark.createDataFrame([(1, [1.0])], "vec_id bigint, embedding array<double>")
    none = spark.createDataFrame([], "query int, embedding array<double>")
    assert context.similar_context(df, none).count() == 0
