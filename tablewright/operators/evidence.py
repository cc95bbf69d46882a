"""Evidence: which rows, what they look like, and what the repair would make of them."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.columns import column, is_numeric, is_text, quoted
from ..functions.groups import first_per_group
from ..functions.issues import investigation
from ..functions.staging import stage
from . import duplicates, formats, missing, outliers, variants, whitespace


def hit_summary(df: DataFrame, hit: Column, key: str, examples: int = 5) -> DataFrame:
    """One row: rows, affected rows, their share, and the first row ids in key order."""
    ids = df.where(hit).select(column(key).alias("id")).orderBy("id").limit(examples)
    listed = ids.agg(F.array_sort(F.collect_list("id")))  # at most ``examples`` ids
    counted = df.agg(F.count(F.lit(1)).alias("rows"), F.count_if(hit).alias("affected_rows"))
    share = F.col("affected_rows") / F.greatest("rows", F.lit(1))
    return counted.select("rows", "affected_rows", share.alias("ratio"), listed.scalar().alias("example_ids"))


def example_row_ids(hits: DataFrame, issue: str, key: str, n: int = 5) -> DataFrame:
    """(issue, position, id): first ``n`` row ids per issue, limited before the shuffle."""
    pairs = hits.select(quoted(issue), quoted(key))
    top = first_per_group(pairs, [issue], [column(key)], n)
    ids = F.array_sort(F.collect_list(column(key)))  # at most n ids per issue
    listed = top.groupBy(quoted(issue)).agg(ids.alias("ids"))
    return listed.select(quoted(issue), F.posexplode("ids").alias("position", key))


def problem_rows(df: DataFrame, issue_type: str, columns: Sequence[str]) -> DataFrame:
    """Offending rows for an issue type; an unknown type yields all rows."""
    if issue_type == "missing_values":
        return missing.missing_values_any(df, columns)
    if issue_type in ("duplicates", "near_duplicates"):
        return duplicates.duplicates_on_subset(df, columns)
    if issue_type == "whitespace":
        return whitespace.whitespace_edges(df, columns)
    if issue_type == "outliers":
        tests = [outliers.outside(df, c, outliers.iqr_fences(df, c)) for c in columns if is_numeric(df, c)]
        return df.where(reduce(lambda a, b: a | b, tests, F.lit(False)))
    if issue_type in ("inconsistent_categories", "category_drift", "supplier_variations"):
        texts = [c for c in columns if is_text(df, c)]
        hits = [_rare_flag(df, c) for c in texts]
        return _any_flag(df, hits)
    if issue_type == "invalid_dates":
        tests = [formats.is_invalid_date(df, c) for c in columns]
        return df.where(reduce(lambda a, b: a | b, tests, F.lit(False)))
    return df


def _rare_flag(df: DataFrame, name: str) -> tuple[str, DataFrame]:
    return name, stage(variants.rare_values(df, name).select("value"), "rare")


def _any_flag(df: DataFrame, hits: list[tuple[str, DataFrame]]) -> DataFrame:
    """Rows matching any of the value sets, each row once: one left join per column."""
    out, flags = df, []
    for i, (name, values) in enumerate(hits):
        side = values.select(F.col("value").alias(f"__v{i}"), F.lit(True).alias(f"__f{i}"))
        out = out.join(side, column(name) == F.col(f"__v{i}"), "left").drop(f"__v{i}")
        flags.append(f"__f{i}")
    if not flags:
        return df.limit(0)
    return out.where(F.coalesce(*[F.col(f) for f in flags], F.lit(False))).drop(*flags)


def problem_sample(
    df: DataFrame, issue_type: str, columns: Sequence[str], key: Sequence[str], n: int = 10
) -> DataFrame:
    """Up to ``n`` offending rows in key order, only the affected columns.

    A row that offends in several columns appears once.
    """
    rows = problem_rows(df, issue_type, columns)
    order = [quoted(k) for k in key] + [quoted(c) for c in columns]
    return rows.orderBy(*order).limit(n).select(*[quoted(c) for c in columns])


def before_after_examples(df: DataFrame, name: str, repaired: Column, n: int = 3) -> DataFrame:
    """(current, fixed): the first distinct pairs a repair would change."""
    pairs = df.select(column(name).alias("current"), repaired.alias("fixed"))
    changed = pairs.where(~F.col("current").eqNullSafe(F.col("fixed"))).distinct()
    return changed.orderBy("current", "fixed").limit(n)


def as_evidence(examples: DataFrame, n: int = 3) -> DataFrame:
    """One row with (current, fixed) pairs as an array; at most ``n`` of them."""
    pair = F.struct(F.col("current").cast("string").alias("current"), F.col("fixed").cast("string").alias("fixed"))
    return examples.limit(n).agg(F.array_sort(F.collect_list(pair)).alias("evidence"))


def issue_investigation(
    issues: DataFrame, rule: Column, output: dict[str, Column], evidence: Column | None = None
) -> DataFrame:
    """Attach the rule text, its named results and before/after examples to every issue."""
    return issues.withColumn("investigation", investigation(rule, output, evidence))
