from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from tablewright.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return local_session(4, "tests")


@pytest.fixture
def partitions(spark):
    """Sets the number of shuffle partitions for a test."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    yield lambda n: spark.conf.set("spark.sql.shuffle.partitions", str(n))
    spark.conf.set("spark.sql.shuffle.partitions", before)


@pytest.fixture
def people(spark):
    """Five rows with one null name."""
    rows = [
        (1, "Alice", 25, "Sales", 50000),
        (2, "Bob", 30, "Engineering", 75000),
        (3, None, 35, "Sales", 60000),
        (4, "David", 30, "Engineering", 75000),
        (5, "Eve", 28, "HR", 55000),
    ]
    return spark.createDataFrame(rows, "id bigint, name string, age bigint, department string, salary bigint")


@pytest.fixture
def folder(tmp_path):
    return "file:" + str(tmp_path)


def rows_of(df, *columns):
    """Rows as a sorted list of tuples."""
    out = df.select(*columns) if columns else df
    return sorted((tuple(r) for r in out.collect()), key=lambda t: tuple((x is None, str(x)) for x in t))
