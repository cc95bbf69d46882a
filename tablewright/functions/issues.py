"""The issue record and the rules that fill it."""

from __future__ import annotations

from pyspark.sql import Column, functions as F, types as T

from .text import slug

# The names an issue may carry.
ISSUE_TYPES = (
    "missing_values",
    "outliers",
    "inconsistent_categories",
    "invalid_dates",
    "duplicates",
    "whitespace",
    "near_duplicates",
    "supplier_variations",
    "discount_context",
    "category_drift",
    "other",
)
SEVERITIES = ("low", "medium", "high")
CATEGORIES = ("quick_fixes", "smart_fixes")

# What a repair would change: values as they are and as they would be.
EVIDENCE_TYPE = T.ArrayType(
    T.StructType([T.StructField("current", T.StringType()), T.StructField("fixed", T.StringType())])
)

INVESTIGATION_TYPE = T.StructType(
    [
        T.StructField("rule", T.StringType()),
        T.StructField("success", T.BooleanType()),
        T.StructField("output", T.MapType(T.StringType(), T.StringType())),
        T.StructField("error", T.StringType()),
        T.StructField("evidence", EVIDENCE_TYPE),
    ]
)

ISSUE_SCHEMA = T.StructType(
    [
        T.StructField("dataset_id", T.StringType()),
        T.StructField("id", T.StringType()),
        T.StructField("type", T.StringType()),
        T.StructField("severity", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("affectedColumns", T.ArrayType(T.StringType())),
        T.StructField("suggestedAction", T.StringType()),
        T.StructField("category", T.StringType()),
        T.StructField("accepted", T.BooleanType()),
        T.StructField("affectedRows", T.LongType()),
        T.StructField("temporalPattern", T.StringType()),
        T.StructField("investigation", INVESTIGATION_TYPE),
    ]
)

DECISION_SCHEMA = "dataset_id string, issue_id string, accepted boolean, reason string, updated_at timestamp"
APPLIED_SCHEMA = "dataset_id string, issue_id string, updated_at timestamp"
ANSWER_SCHEMA = "dataset_id string, issue_id string, response string, updated_at timestamp"
# All values an issue is about, one row each; the issue itself names the first ones.
DETAIL_SCHEMA = "dataset_id string, issue_id string, position bigint, value string, rows bigint"
CONTEXT_SCHEMA = "dataset_id string, instructions string, column_edits string, updated_at timestamp"


def severity_from_ratio(ratio: Column, high: float = 0.25, medium: float = 0.10) -> Column:
    return F.when(ratio >= high, "high").when(ratio >= medium, "medium").otherwise("low")


def duplicate_severity(ratio: Column, high: float = 0.15) -> Column:
    return F.when(ratio < high, "medium").otherwise("high")


def issue_id(dataset_id: Column, name: Column) -> Column:
    return F.concat_ws("_", dataset_id, slug(name))


def ratio_of(part: Column, whole: Column) -> Column:
    """Share of rows; an empty table counts as one row so that the share is 0."""
    return part / F.greatest(whole, F.lit(1))


def investigation(rule: str | Column, output: dict[str, Column], evidence: Column | None = None) -> Column:
    """The record of how an issue was found: rule text, named results, and what a repair would change."""
    entries = [x for k, v in output.items() for x in (F.lit(k), v.cast("string"))]
    results = F.create_map(*entries) if entries else F.lit(None)
    return F.struct(
        F.lit(rule).cast("string").alias("rule"),
        F.lit(True).alias("success"),
        results.cast("map<string,string>").alias("output"),
        F.lit(None).cast("string").alias("error"),
        (F.lit(None) if evidence is None else evidence).cast(EVIDENCE_TYPE).alias("evidence"),
    )


def issue_row(
    dataset_id: Column,
    name: Column,
    type_: str,
    severity: Column,
    description: Column,
    affected_columns: list[str],
    suggested_action: str,
    category: str,
    affected_rows: Column,
    investigation_: Column,
    temporal_pattern: str | None = None,
) -> list[Column]:
    """The columns of one issue, in the order of ``ISSUE_SCHEMA``."""
    values = [
        dataset_id,
        issue_id(dataset_id, name),
        F.lit(type_),
        severity,
        description,
        F.array(*[F.lit(c) for c in affected_columns]),
        F.lit(suggested_action),
        F.lit(category),
        F.lit(None),
        affected_rows,
        F.lit(temporal_pattern),
        investigation_,
    ]
    return [v.cast(f.dataType).alias(f.name) for v, f in zip(values, ISSUE_SCHEMA.fields)]
