"""Inputs of the registered queries: the given tables, and one dirtied view of ``events``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tablewright.plans.analysis import Roles

DIRTY_ROLES = Roles(
    key="event_id", product="product", supplier="order_list", category="dept_fullname", date="sale_date"
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` dirtied by fixed rules on ``event_id``, plus exact and one-second copies; one scan."""
    i, kind, ts = F.col("event_id"), F.col("event_type"), F.col("ts")
    d10, d20 = i % 10, i % 20
    rows = table(spark, sf_dir, "events").select(
        "event_id",
        "user_id",
        "event_type",
        F.when(d20 == 0, None)
        .when(d20 == 1, "")
        .when(d20 == 2, "NULL")
        .when(d20 == 3, F.concat(F.lit("  "), kind))
        .when(d20 == 4, F.concat(kind, F.lit("  x")))
        .otherwise(kind)
        .alias("product"),
        F.when(d10 == 0, "Pharmax Ltd")
        .when(d10 == 1, "PHARMAX")
        .when(d10 == 2, " Pharmax ")
        .when(d10 == 3, None)
        .when(d10 == 4, "pharmax")
        .when(d10 == 5, "Medico")
        .otherwise("Pharmax")
        .alias("order_list"),
        F.when((kind == "click") & (ts >= F.expr("timestamp_ntz'2024-01-15'")), "OTC:Cold&Flu")
        .when(i % 33 == 0, None)
        .otherwise("OTC")
        .alias("dept_fullname"),
        ts.alias("ts0"),
        F.when(i % 97 == 0, -1).otherwise(i % 9).cast("int").alias("quantity"),
        F.col("value").alias("amount"),
        F.when(i % 50 == 0, "N/A").otherwise(F.col("value").cast("decimal(12,2)").cast("string")).alias("amount_text"),
        F.when(i % 40 == 0, "not-a-date").otherwise(F.date_format(ts, "yyyy-MM-dd")).alias("date_text"),
        F.explode(
            F.concat(
                F.array(F.lit(0)),
                F.when(i % 100 == 0, F.array(F.lit(0))).otherwise(F.array().cast("array<int>")),
                F.when(i % 150 == 7, F.array(F.lit(1))).otherwise(F.array().cast("array<int>")),
            )
        ).alias("later"),
    )
    moved = F.expr("ts0 + make_dt_interval(0, 0, 0, later)")
    return rows.select(
        "event_id",
        "user_id",
        "event_type",
        "product",
        "order_list",
        "dept_fullname",
        moved.alias("sale_date"),
        "quantity",
        "amount",
        "amount_text",
        "date_text",
    )


DIRTY_COLUMNS = [
    "event_id", "user_id", "event_type", "product", "order_list", "dept_fullname",
    "sale_date", "quantity", "amount", "amount_text", "date_text",
]
ALL_COLUMNS = ", ".join(DIRTY_COLUMNS)

DIRTY_SQL = """dirty0 AS (
  SELECT event_id, user_id, event_type,
    CASE event_id % 20 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN 'NULL' WHEN 3 THEN '  ' || event_type
      WHEN 4 THEN event_type || '  x' ELSE event_type END AS product,
    CASE event_id % 10 WHEN 0 THEN 'Pharmax Ltd' WHEN 1 THEN 'PHARMAX' WHEN 2 THEN ' Pharmax ' WHEN 3 THEN NULL
      WHEN 4 THEN 'pharmax' WHEN 5 THEN 'Medico' ELSE 'Pharmax' END AS order_list,
    CASE WHEN event_type = 'click' AND ts >= TIMESTAMP '2024-01-15' THEN 'OTC:Cold&Flu'
      WHEN event_id % 33 = 0 THEN NULL ELSE 'OTC' END AS dept_fullname,
    ts AS sale_date,
    CAST(CASE WHEN event_id % 97 = 0 THEN -1 ELSE event_id % 9 END AS INTEGER) AS quantity,
    value AS amount,
    CASE WHEN event_id % 50 = 0 THEN 'N/A' ELSE CAST(CAST(value AS DECIMAL(12,2)) AS VARCHAR) END AS amount_text,
    CASE WHEN event_id % 40 = 0 THEN 'not-a-date' ELSE strftime(ts, '%Y-%m-%d') END AS date_text
  FROM events),
dirty AS (
  SELECT * FROM dirty0
  UNION ALL SELECT * FROM dirty0 WHERE event_id % 100 = 0
  UNION ALL SELECT * REPLACE (sale_date + INTERVAL 1 SECOND AS sale_date) FROM dirty0 WHERE event_id % 150 = 7)"""


def with_dirty(sql: str, *ctes: str) -> str:
    """A statement over the dirty view, with more named steps if given."""
    return "WITH RECURSIVE " + ",\n".join([DIRTY_SQL, *ctes]) + "\n" + sql
