"""Every registered query against its SQL, on the smallest tables, and the known counts at sf0.01."""

from __future__ import annotations

import os

import pytest
from checks import compare
from checks.tables import dirty

import __spark_entry__ as entry
from tablewright.functions.missing import is_missing
from tablewright.operators import duplicates, formats, outliers, variants, whitespace

SMALL = "/root/testdata/sf0.001"
MEDIUM = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="test tables are absent")

QUERIES = {name: query for section in entry.SECTIONS for name, query in section.QUERIES.items()}
ORACLE = {name: sql for section in entry.SECTIONS for name, sql in section.ORACLE.items()}


@pytest.fixture(scope="module")
def con():
    return compare.connect(SMALL)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, con, name):
    assert compare.differences(name, spark, con, SMALL, QUERIES[name], ORACLE[name]) is None


def test_entry(spark):
    df = entry.entry(spark)
    assert "id" in df.columns and df.count() > 5


def test_known_counts(spark):
    df = dirty(spark, MEDIUM)
    assert df.count() == 10_167
    assert df.where(is_missing(df, "product")).count() == 1_600
    assert whitespace.whitespace_normalize(df, "product").count() == 1_000
    assert duplicates.duplicate_groups(df).first()[:] == (200, 100)
    assert duplicates.near_duplicates(df, "sale_date").first()["pairs"] == 167
    assert variants.supplier_variations(df, "order_list", "Pharmax").groupBy().sum("rows").first()[0] == 2_100
    assert variants.supplier_family_stats(df, "order_list", "Pharmax").first()[:] == (8_167, 5_067, 3_100)
    assert outliers.outliers_iqr(df, "amount").count() == 470
    assert outliers.outliers_zscore(df, "amount").count() == 185
    assert formats.invalid_dates(df, "date_text").count() == 300
    assert formats.type_inconsistency(df, "amount_text").first()[:] == ("N/A", 300)
    assert outliers.negative_quantity(df, "quantity").count() == 107
    rare = variants.rare_values(df, "product")
    assert (rare.count(), rare.groupBy().sum("rows").first()[0]) == (7, 678)
