"""The saved life of datasets: understand, analyse, decide, apply, clean, report."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.issues import ANSWER_SCHEMA, CONTEXT_SCHEMA, DECISION_SCHEMA
from ..functions.staging import stage
from ..operators import profile, workflow
from ..sources import store
from .analysis import Roles, issue_details, run_all_detectors, without_position
from .cleaning import accepted_repairs, apply_repairs


class Workspace:
    """Results of any number of datasets under one folder.  Tables of results are small or partitioned;
    the data itself is only ever read lazily."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def load(self, kind: str, dataset_id: str | None = None) -> DataFrame:
        return store.load(self.spark, self.root, kind, dataset_id)

    def _save(self, df: DataFrame, kind: str, dataset_id: str) -> None:
        store.save_one(df, self.root, kind, dataset_id)

    def _rows(self, rows: Sequence[tuple], schema: str) -> DataFrame:
        """Request rows without a time, stamped with the current one."""
        untimed = schema.rsplit(",", 1)[0]
        return self.spark.createDataFrame(list(rows), untimed).withColumn("updated_at", F.current_timestamp())

    # understanding

    def understand(
        self, df: DataFrame, dataset_id: str, name: str, description: str, key: Sequence[str], refresh: bool = False
    ) -> tuple[DataFrame, DataFrame]:
        """Summary and column profiles; kept from the first time unless ``refresh``."""
        if refresh or not self.load("summary", dataset_id).count():
            ds = F.lit(dataset_id)
            self._save(profile.column_profile(df, key).withColumn("dataset_id", ds), "columns", dataset_id)
            self._save(profile.dataset_summary(df, name, description).withColumn("dataset_id", ds), "summary", dataset_id)
        return self.load("summary", dataset_id), self.load("columns", dataset_id)

    def save_context(self, dataset_id: str, instructions: str, column_edits: str | None = None) -> None:
        self._save(self._rows([(dataset_id, instructions, column_edits)], CONTEXT_SCHEMA), "context", dataset_id)

    # issues

    def analyse(self, df: DataFrame, dataset_id: str, roles: Roles, isolate: bool = True) -> DataFrame:
        """Run all detectors, save the issues, all their values, the plan and an entry of the history."""
        found = without_position(run_all_detectors(df, dataset_id, roles, isolate))
        found = stage(workflow.normalize_issues(found), "issues")
        found = workflow.apply_decisions(found, self.load("decisions", dataset_id))
        self._save(found, "issues", dataset_id)
        self._save(issue_details(df, dataset_id, roles), "details", dataset_id)
        issues = self._replan(dataset_id)
        counts = issues.agg(F.count(F.lit(1)).alias("issue_count"), F.countDistinct("type").alias("types"))
        entry = counts.select(
            F.lit(dataset_id).alias("dataset_id"),
            F.concat(F.lit("analysis_"), F.replace(F.uuid(), F.lit("-"), F.lit(""))).alias("analysis_id"),
            F.current_timestamp().alias("completed_at"),
            "issue_count",
            F.format_string(workflow.SUMMARY_SENTENCE, "issue_count", "types").alias("summary"),
        )
        store.append(entry, self.root, "analyses")
        return issues

    def history(self, dataset_id: str, n: int = 10) -> DataFrame:
        return workflow.analysis_history(self.load("analyses", dataset_id), n)

    def _replan(self, dataset_id: str) -> DataFrame:
        decisions = self.load("decisions", dataset_id)
        issues = workflow.apply_decisions(self.load("issues", dataset_id), decisions)
        self._save(issues, "issues", dataset_id)
        issues = self.load("issues", dataset_id)
        self._save(workflow.cleaning_plan(issues, decisions), "plan", dataset_id)
        return issues

    # decisions

    def decide(self, dataset_id: str, issue_id: str, accepted: bool, reason: str | None = None) -> DataFrame:
        """Record one decision; an unknown issue is refused."""
        issues = self.load("issues", dataset_id)
        update = workflow.valid_updates(issues, self._rows([(dataset_id, issue_id, accepted, reason)], DECISION_SCHEMA))
        if not update.count():
            raise ValueError(f"unknown issue: {issue_id}")
        self._save(workflow.decision_upsert(self.load("decisions", dataset_id), update), "decisions", dataset_id)
        self._replan(dataset_id)
        return self.load("decisions", dataset_id)

    def apply(self, dataset_id: str, issue_ids: Sequence[str]) -> DataFrame:
        """Mark issues as applied and accepted; the outcome of every requested id."""
        if not issue_ids:
            raise ValueError("no issue id given")
        asked = self.spark.createDataFrame(
            [(dataset_id, x, i) for i, x in enumerate(issue_ids)], "dataset_id string, issue_id string, position bigint"
        )
        before = self.load("applied", dataset_id)
        outcomes = stage(workflow.apply_issues(self.load("issues", dataset_id), before, asked), "outcomes")
        accepted = workflow.decisions_from_applied(outcomes, F.current_timestamp())
        self._save(before.unionByName(accepted.select(*before.columns)), "applied", dataset_id)
        self._save(workflow.decision_upsert(self.load("decisions", dataset_id), accepted), "decisions", dataset_id)
        self._replan(dataset_id)
        return outcomes

    def answer(self, dataset_id: str, issue_id: str, response: str) -> DataFrame:
        """Save the answer to a smart fix; blank answers and other issues are refused."""
        new = self._rows([(dataset_id, issue_id, response)], ANSWER_SCHEMA)
        issues = self.load("issues", dataset_id)
        if not workflow.smart_fix_responses(issues, new).count():
            raise ValueError(f"not a smart fix, or a blank answer: {issue_id}")
        answers = self.load("answers", dataset_id).unionByName(new)
        self._save(workflow.smart_fix_responses(issues, answers), "answers", dataset_id)
        return workflow.resolve_smart_fix(issues, self.load("answers", dataset_id))

    # results

    def clean(self, df: DataFrame, dataset_id: str, roles: Roles) -> DataFrame:
        """The table with the repairs of all accepted issues, as their answers ask."""
        resolved = workflow.resolve_smart_fix(self.load("issues", dataset_id), self.load("answers", dataset_id))
        return apply_repairs(df, accepted_repairs(self.load("plan", dataset_id), resolved), dataset_id, roles)

    def report(self, df: DataFrame, dataset_id: str) -> DataFrame:
        return workflow.render_report(self.load("issues", dataset_id), df.count(), len(df.columns))
