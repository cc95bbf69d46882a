"""User-written rules."""

from __future__ import annotations

import logging
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, functions as F

log = logging.getLogger(__name__)

RESULT_SCHEMA = "rule string, success boolean, affected_rows bigint, error string"


@dataclass(frozen=True)
class Rule:
    """A name with either a SQL predicate or a function from the table to the offending rows."""

    name: str
    check: str | Callable[[DataFrame], DataFrame]


def rule_hits(df: DataFrame, rule: Rule) -> DataFrame:
    """The rows that break a rule."""
    return rule.check(df) if callable(rule.check) else df.where(F.expr(rule.check))


def custom_rule(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """(rule, success, affected_rows, error): every rule counted over the whole table.

    All predicates are counted in one scan.  If that fails, or a rule cannot be analysed, the rules
    run one by one, so a failing rule is recorded and the others go on.
    """
    spark = df.sparkSession
    results: dict[int, tuple] = {}  # by position: two rules may share a name

    def failed(i: int, rule: Rule, e: Exception) -> None:
        reason = e.getCondition() if isinstance(e, PySparkException) else None
        reason = reason or f"{type(e).__name__}: {e}"
        log.warning("rule %s failed: %s", rule.name, reason)
        results[i] = (rule.name, False, None, reason)

    predicates = []
    for i, rule in enumerate(rules):
        if callable(rule.check):
            continue
        try:
            df.where(F.expr(rule.check)).schema
            predicates.append((i, rule))
        except PySparkException as e:
            failed(i, rule, e)
    try:
        counts = df.agg(*[F.count_if(F.expr(r.check)).alias(f"r{i}") for i, r in predicates])
        row = counts.first() if predicates else ()
        for (i, rule), n in zip(predicates, row):
            results[i] = (rule.name, True, n, None)
    except PySparkException:
        log.info("the rules are counted one by one")
    for i, rule in enumerate(rules):
        if i in results:
            continue
        try:
            results[i] = (rule.name, True, rule_hits(df, rule).count(), None)
        except Exception as e:  # a rule is user code: whatever it raises is its result
            failed(i, rule, e)
    return spark.createDataFrame([results[i] for i in range(len(rules))], RESULT_SCHEMA)
