"""Intermediate tables written to the folder all executors share.

A staged table cuts lineage, survives the loss of executors, and has a known size: the planner
reads the file sizes, so it broadcasts the table only when it is under
``spark.sql.autoBroadcastJoinThreshold`` and shuffles it otherwise.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Without one, a session inside one machine (master ``local``) uses a folder of its own; on a
    cluster there is nothing all executors could see, so that is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = spark.sparkContext.getCheckpointDir()
    if not folder:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file:" + tempfile.mkdtemp(prefix="tablewright-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def new_folder(spark: SparkSession, label: str) -> str:
    app = spark.sparkContext.applicationId
    path = f"{shared_folder(spark)}/tablewright-{app}/{label}-{uuid.uuid4().hex}"
    for made in _MADE:
        made.append(path)
    return path


#: Folders made inside each open ``scratch``.
_MADE: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[list[str]]:
    """What is staged inside is removed at the end; a path taken out of the list that is given stays.

    Results that read a removed table can no longer be computed, so stage what is to outlive it and keep its path.
    """
    made: list[str] = []
    _MADE.append(made)
    try:
        yield made
    finally:
        _MADE[:] = [m for m in _MADE if m is not made]
        for path in made:
            remove(spark, path)


def remove(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def stage(df: DataFrame, label: str = "stage") -> DataFrame:
    """Write ``df`` once and return it as a scan of the written files."""
    spark = df.sparkSession
    path = new_folder(spark, label)
    df.write.mode("errorifexists").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clear_staged(spark: SparkSession) -> None:
    """Remove what this application staged; tables built on it can no longer be read."""
    remove(spark, f"{shared_folder(spark)}/tablewright-{spark.sparkContext.applicationId}")
