"""Turning accepted issues into a repaired table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.columns import column
from ..functions.issues import issue_id
from ..functions.missing import MISSING_TOKENS, is_missing
from ..operators import repair
from ..operators.variants import is_supplier_variation
from .analysis import SLUGS, Roles


def accepted_repairs(plan: DataFrame, resolved: DataFrame) -> DataFrame:
    """(dataset_id, issue_id, type, action, value): accepted issues that call for a change.

    ``resolved`` holds what the answers to smart fixes ask for: an issue answered by leaving things
    as they are drops out, and a custom answer is the value to use.
    """
    answers = resolved.select("dataset_id", "issue_id", "action", "value")
    chosen = plan.where("status = 'accepted'").join(answers, ["dataset_id", "issue_id"], "left")
    wanted = F.col("action").isNull() | (F.col("action") != "no_change")
    return chosen.where(wanted).select("dataset_id", "issue_id", "type", "action", "value")


def _fill_products(df: DataFrame, roles: Roles) -> DataFrame:
    """From the lookup column where one is named; else every kind of missing becomes the empty text."""
    if roles.lookup:
        return repair.fill_lookup(df, roles.product, roles.lookup, tokens=MISSING_TOKENS)
    missing = is_missing(df, roles.product)
    return df.withColumn(roles.product, F.when(missing, F.lit("")).otherwise(column(roles.product)))


def _standardize_supplier(df: DataFrame, roles: Roles, action: str | None, value: str | None) -> DataFrame:
    """The answered action on the spellings of the stem; without an answer they become the stem."""
    c = column(roles.supplier)
    hit = is_supplier_variation(c, roles.supplier_stem)
    if action == "standardize_most_frequent":
        return repair.standardize_most_frequent(df, roles.supplier, hit | (c == roles.supplier_stem))
    return df.withColumn(roles.supplier, F.when(hit, F.lit(value or roles.supplier_stem)).otherwise(c))


def _reclassify(df: DataFrame, roles: Roles, dataset_id: str, choices: DataFrame) -> DataFrame:
    """Only the entities whose own issue is accepted, to the custom value or the most frequent category."""
    canonical = repair.canonical_categories(df, roles.product, roles.category)
    name = F.concat(F.lit(SLUGS["category_drift"]), F.col("key").cast("string"))
    keyed = canonical.withColumn("issue_id", issue_id(F.lit(dataset_id), name))
    mine = choices.where("type = 'category_drift'").select("issue_id", F.col("value").alias("custom"))
    chosen = keyed.join(mine, "issue_id").select("key", F.coalesce("custom", "value").alias("value"))
    return repair.reclassify(df, roles.product, roles.category, chosen)


def apply_repairs(df: DataFrame, choices: DataFrame, dataset_id: str, roles: Roles) -> DataFrame:
    """Run the repairs of the accepted issues (from ``accepted_repairs``) on the analysed table.

    Drift comes first, because its issues name products as they were found; blanks come before
    duplicates, since collapsing them can make rows equal.
    """
    single = choices.where(F.col("dataset_id") == dataset_id)
    # at most one entry per issue type reaches the driver
    action = F.col("action") if "action" in choices.columns else F.lit(None).cast("string").alias("action")
    latest = F.max(F.struct("value", action)).alias("answer")
    values = {r["type"]: r["answer"] for r in single.groupBy("type").agg(latest).collect()}
    out = df
    if "category_drift" in values:
        out = _reclassify(out, roles, dataset_id, single)
    if "whitespace" in values:
        out = repair.trim_collapse(out, [roles.product])
    if "missing_values" in values:
        out = _fill_products(out, roles)
    if "supplier_variations" in values:
        answer = values["supplier_variations"]
        out = _standardize_supplier(out, roles, answer["action"], answer["value"])
    if "near_duplicates" in values:
        out = repair.collapse_near_duplicates(out, roles.date)
    if "duplicates" in values:
        out = repair.drop_duplicates(out)
    return out
