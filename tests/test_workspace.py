from __future__ import annotations

import pytest
from conftest import rows_of
from test_workflow import ROLES, sales

from tablewright.operators import workflow
from tablewright.plans.workspace import Workspace


def test_a_dataset_from_profile_to_clean_table(spark, folder):
    space, df = Workspace(spark, folder), sales(spark)
    summary, columns = space.understand(df, "d1", "sales.csv", "test", ["Sale ID", "Sale Date"])
    assert summary.first()["row_count"] == 7 and columns.count() == 5
    again, _ = space.understand(df.limit(1), "d1", "sales.csv", "test", ["Sale ID"])
    assert again.first()["row_count"] == 7  # kept
    fresh, _ = space.understand(df.limit(1), "d1", "sales.csv", "test", ["Sale ID"], refresh=True)
    assert fresh.first()["row_count"] == 1

    issues = space.analyse(df, "d1", ROLES)
    assert issues.count() == 6 and issues.where("accepted IS NOT NULL").count() == 0
    assert rows_of(space.load("details", "d1"), "issue_id", "value") == [
        ("d1_category_drift_aspirin", "OTC"),
        ("d1_category_drift_aspirin", "OTC:Cold&Flu"),
        ("d1_product_whitespace", " Aspirin"),
        ("d1_supplier_variations", "PHARMAX"),
    ]
    space.decide("d1", "d1_supplier_variations", False, "as delivered")
    space.decide("d1", "d1_exact_duplicates", True)
    space.decide("d1", "d1_exact_duplicates", False)
    with pytest.raises(ValueError):
        space.decide("d1", "d1_nothing", True)
    assert workflow.plan_summary(space.load("plan", "d1")).first()[:] == ("d1", 0, 2, 4)

    outcomes = space.apply("d1", ["d1_near_duplicates", "d1_product_whitespace", "d1_near_duplicates", "x"])
    assert [r["outcome"] for r in outcomes.orderBy("position").collect()] == [
        "applied", "applied", "skipped_repeated", "skipped_unknown",
    ]
    again = space.apply("d1", ["d1_near_duplicates"])
    assert again.first()["outcome"] == "skipped_applied"
    assert space.load("applied", "d1").count() == 2
    assert workflow.plan_summary(space.load("plan", "d1")).first()[:] == ("d1", 2, 2, 2)

    resolved = space.answer("d1", "d1_category_drift_aspirin", "standardize")
    assert rows_of(resolved, "action") == [("canonical_category",)]
    for issue, text in (("d1_category_drift_aspirin", "  "), ("d1_near_duplicates", "keep")):
        with pytest.raises(ValueError):
            space.answer("d1", issue, text)

    # decisions outlive a new analysis, and a dataset without issues replaces its old ones
    assert space.analyse(df, "d1", ROLES).where("accepted").count() == 2
    cleaned = space.clean(df, "d1", ROLES)
    assert cleaned.count() == 5 and cleaned.where("Product LIKE ' %'").count() == 0
    assert space.report(df, "d1").where("part = 3").count() == 6
    assert space.history("d1").count() == 2
    assert space.analyse(cleaned.limit(0), "d1", ROLES).count() == 0
    assert space.load("issues", "d1").count() == 0

    space.save_context("d1", "look at prices")
    assert space.load("context", "d1").first()["instructions"] == "look at prices"
    with pytest.raises(ValueError):
        space.save_context("../d1", "no")
