"""Session settings."""

from __future__ import annotations

from pyspark.sql import SparkSession

# Settings every operator is written for.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}
TASK_BYTES = 128 * 1024 * 1024


def cluster_settings(input_bytes: int, cores: int) -> dict[str, str]:
    """Settings for a job that reads ``input_bytes``: shuffle partitions of about one task's size.

    AQE merges small partitions, so the number may be generous; it never falls under three tasks
    per core.
    """
    partitions = max(3 * cores, -(-input_bytes // TASK_BYTES))
    return {
        **SETTINGS,
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.files.maxPartitionBytes": str(TASK_BYTES),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(TASK_BYTES),
    }


def local_session(cpus: int | str = "*", name: str = "tablewright") -> SparkSession:
    """A session on this machine, for tests and benchmarks."""
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(name)
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    partitions = cpus if isinstance(cpus, int) else 8
    builder = builder.config("spark.sql.shuffle.partitions", str(partitions)).config("spark.ui.enabled", "false")
    builder = builder.config("spark.ui.showConsoleProgress", "false")
    spark = builder.config("spark.driver.memory", "8g").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
