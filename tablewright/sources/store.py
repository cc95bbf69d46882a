"""Saved results of an analysis: versions of each kind, one partition per dataset, and a pointer to what is current.

A write makes a new version beside the old ones and becomes visible by one atomic step at its end.  A write
that fails, at any time, leaves everything as it was.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from ..functions.issues import (
    ANSWER_SCHEMA,
    APPLIED_SCHEMA,
    CONTEXT_SCHEMA,
    DECISION_SCHEMA,
    DETAIL_SCHEMA,
    ISSUE_SCHEMA,
)

PLAN_SCHEMA = (
    "dataset_id string, issue_id string, type string, category string, severity string, affectedColumns array<string>, "
    "suggestedAction string, detector string, decision_reason string, status string"
)

SUMMARY_SCHEMA = (
    "dataset_id string, name string, description string, row_count bigint, column_count bigint, observations array<string>"
)
COLUMN_SCHEMA = (
    "dataset_id string, column string, data_type string, physical_type string, rows bigint, missing_count bigint, "
    "unique_count bigint, sample_values array<string>, description string"
)
ANALYSIS_SCHEMA = "dataset_id string, analysis_id string, completed_at timestamp, issue_count bigint, summary string"

ARTEFACTS: dict[str, str | T.StructType] = {
    "issues": ISSUE_SCHEMA,
    "details": DETAIL_SCHEMA,
    "decisions": DECISION_SCHEMA,
    "applied": APPLIED_SCHEMA,
    "plan": PLAN_SCHEMA,
    "answers": ANSWER_SCHEMA,
    "context": CONTEXT_SCHEMA,
    "summary": SUMMARY_SCHEMA,
    "columns": COLUMN_SCHEMA,
    "analyses": ANALYSIS_SCHEMA,
}


def _schema(kind: str) -> T.StructType:
    s = ARTEFACTS[kind]
    return T.StructType.fromDDL(s) if isinstance(s, str) else s


def _shaped(df: DataFrame, kind: str) -> DataFrame:
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in _schema(kind)])


def _file_system(spark: SparkSession, folder: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def _commits(spark: SparkSession, folder: str) -> list[tuple[int, str]]:
    """(number, version) of every version that was written to its end, in order."""
    fs, path = _file_system(spark, f"{folder}/commits")
    if not fs.exists(path):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(path)]
    return sorted((int(n.split("-")[0]), n.split("-")[1]) for n in names if not n.startswith("_"))


def _commit(spark: SparkSession, folder: str, version: str) -> None:
    """Make a version current: one rename of a small file, which happens or does not."""
    known = _commits(spark, folder)
    number = known[-1][0] + 1 if known else 0
    fs, begun = _file_system(spark, f"{folder}/commits/_{version}")
    fs.create(begun).close()
    if not fs.rename(begun, _file_system(spark, f"{folder}/commits/{number:012d}-{version}")[1]):
        raise OSError(f"could not commit {version} in {folder}")


def _write(df: DataFrame, root: str, kind: str, replaces: bool, dataset_id: str | None = None) -> None:
    """Write rows as a new version, then which datasets it is about, then commit it.

    Until the commit nobody sees the version, and nothing older is touched.
    """
    spark, folder, version = df.sparkSession, f"{root}/{kind}", uuid.uuid4().hex
    path = f"{folder}/data/version={version}"
    _shaped(df, kind).write.mode("errorifexists").partitionBy("dataset_id").parquet(path)
    if dataset_id is None:
        about = spark.read.schema(_schema(kind)).parquet(path).select("dataset_id").distinct()
    else:
        about = spark.createDataFrame([(dataset_id,)], "dataset_id string")
    marks = about.select("dataset_id", F.lit(replaces).alias("replaces"))
    marks.coalesce(1).write.mode("errorifexists").parquet(f"{folder}/marks/version={version}")
    _commit(spark, folder, version)


def save(df: DataFrame, root: str, kind: str) -> None:
    """Write an artefact of several datasets; those in ``df`` are replaced and all others stay."""
    _write(df, root, kind, replaces=True)


def save_one(df: DataFrame, root: str, kind: str, dataset_id: str) -> None:
    """Write the artefact of one dataset, also when there is nothing in it any more."""
    if not re.fullmatch(r"[\w.-]+", dataset_id):
        raise ValueError(f"unsuitable dataset id: {dataset_id!r}")
    _write(_shaped(df, kind).where(F.col("dataset_id") == dataset_id), root, kind, True, dataset_id)


def append(df: DataFrame, root: str, kind: str) -> None:
    """Add rows to what the datasets have."""
    _write(df, root, kind, replaces=False)


def _live(spark: SparkSession, folder: str) -> DataFrame | None:
    """(dataset_id, version): the versions that make up every dataset: the last full one and what was added since."""
    commits = _commits(spark, folder)
    if not commits:
        return None
    numbers = spark.createDataFrame(commits, "number int, version string")
    marks = spark.read.schema("dataset_id string, replaces boolean, version string").parquet(f"{folder}/marks")
    known = marks.join(numbers, "version")
    latest = Window.partitionBy("dataset_id")
    last = F.coalesce(F.max(F.when(F.col("replaces"), F.col("number"))).over(latest), F.lit(-1))
    return known.withColumn("last", last).where("number >= last").select("dataset_id", "version")


def load(spark: SparkSession, root: str, kind: str, dataset_id: str | None = None) -> DataFrame:
    """Read an artefact back as it was last committed.  Nothing saved yet is an empty table."""
    schema, folder = _schema(kind), f"{root}/{kind}"
    live = _live(spark, folder)
    if live is None:
        return spark.createDataFrame([], schema)
    stored = spark.read.schema(T.StructType([*schema.fields, T.StructField("version", T.StringType())])).parquet(f"{folder}/data")
    if dataset_id is not None:
        live, stored = (d.where(F.col("dataset_id") == dataset_id) for d in (live, stored))
    same = stored["dataset_id"].eqNullSafe(live["dataset_id"]) & (stored["version"] == live["version"])
    return stored.join(live, same, "left_semi").select(*schema.names)


def vacuum(spark: SparkSession, root: str, kind: str) -> int:
    """Remove the versions that no dataset uses any more, and return their number; tables read before are then gone."""
    folder = f"{root}/{kind}"
    live = _live(spark, folder)
    if live is None:
        return 0
    used = {r["version"] for r in live.select("version").distinct().collect()}  # one for each commit at most
    old = [(n, v) for n, v in _commits(spark, folder) if v not in used]
    for number, version in old:
        # the commit first: what has no commit is never read
        for name in (f"commits/{number:012d}-{version}", f"marks/version={version}", f"data/version={version}"):
            fs, path = _file_system(spark, f"{folder}/{name}")
            fs.delete(path, True)
    return len(old)
