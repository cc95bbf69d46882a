"""The catalog of datasets."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.groups import first_per_group
from .files import DEFAULT_DELIMITER, list_files

# Accepted file extensions and the type each stands for.
FILE_TYPES = {".csv": "csv", ".xls": "excel", ".xlsx": "excel"}

CATALOG_SCHEMA = (
    "dataset_id string, original_filename string, stored_file string, raw_filename string, extension string, "
    "file_size_bytes bigint, file_type string, delimiter string, content_type string, uploaded_at timestamp"
)


def generate_dataset_id() -> str:
    return f"dataset_{uuid.uuid4().hex}"


def describe_files(spark: SparkSession, path: str, delimiters: DataFrame | None = None) -> DataFrame:
    """A catalog row per file of a folder; an unsupported extension is left out.

    ``delimiters`` (file, delimiter), as ``infer_delimiter`` returns it, fills that column for
    CSV files.  The id is derived from the path and time, so that registering twice is stable.
    """
    files = list_files(spark, path)
    name = F.element_at(F.split("path", "/"), -1)
    extension = F.lower(F.regexp_extract(name, r"(\.[^.]+)$", 1))
    kinds = F.create_map(*[F.lit(x) for item in FILE_TYPES.items() for x in item])
    rows = files.select(
        F.concat(F.lit("dataset_"), F.md5(F.concat_ws("|", "path", F.col("modified").cast("string")))).alias("dataset_id"),
        name.alias("original_filename"),
        F.col("path").alias("stored_file"),
        F.concat(F.lit("raw"), extension).alias("raw_filename"),
        extension.alias("extension"),
        F.col("length").alias("file_size_bytes"),
        F.try_element_at(kinds, extension).alias("file_type"),
        F.lit(None).cast("string").alias("content_type"),
        F.col("modified").alias("uploaded_at"),
    ).where("file_type IS NOT NULL")
    if delimiters is None:
        return rows.withColumn("delimiter", F.lit(None).cast("string")).select(*_names())
    side = delimiters.select(F.col("file").alias("stored_file"), "delimiter")
    joined = rows.join(side, "stored_file", "left")
    csv_only = F.when(F.col("extension") == ".csv", F.col("delimiter"))
    return joined.withColumn("delimiter", csv_only).select(*_names())


def _names() -> list[str]:
    return [part.split()[0] for part in CATALOG_SCHEMA.split(", ")]


def register(entries: DataFrame, catalog_path: str) -> None:
    entries.write.mode("append").parquet(catalog_path)


def load_catalog(spark: SparkSession, catalog_path: str) -> DataFrame:
    """The catalog with defaults: raw file name from the extension, comma for CSV.

    A dataset registered more than once is one row, the one uploaded last.
    """
    rows = spark.read.schema(CATALOG_SCHEMA).parquet(catalog_path)
    rows = first_per_group(rows, ["dataset_id"], [F.desc_nulls_last("uploaded_at"), F.col("stored_file")])
    raw = F.concat(F.lit("raw"), F.coalesce("extension", F.lit("")))
    comma = F.when(F.col("file_type") == "csv", F.lit(DEFAULT_DELIMITER))
    return rows.withColumns(
        {"raw_filename": F.coalesce("raw_filename", raw), "delimiter": F.coalesce("delimiter", comma)}
    )


def catalog_health(catalog: DataFrame) -> DataFrame:
    return catalog.agg(
        F.lit("up").alias("status"),
        F.countDistinct("dataset_id").alias("datasets"),
        F.max("uploaded_at").alias("latest_dataset"),
    )
