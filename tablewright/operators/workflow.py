"""Operators on tables about issues: reports, decisions, cleaning plan, application."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.groups import first_per_group
from ..functions.issues import ISSUE_SCHEMA, ISSUE_TYPES
from ..functions.text import strip

# Report categories and the issue types they stand for.
REPORT_TYPES = {
    "MISSING_VALUES": "missing_values",
    "DUPLICATE_ROWS": "duplicates",
    "TYPE_INCONSISTENCY": "other",
    "VALUE_RANGE": "outliers",
    "NEGATIVE_QUANTITY": "outliers",
    "OUTLIER": "outliers",
    "RARE_CATEGORY": "inconsistent_categories",
    "ID_INCONSISTENCY": "inconsistent_categories",
    "WHITESPACE": "whitespace",
    "SUPPLIER_VARIATIONS": "supplier_variations",
    "CATEGORY_DRIFT": "category_drift",
    "NEAR_DUPLICATE": "near_duplicates",
}
# Report severities, and the issue severities they stand for.
REPORT_SEVERITIES = {"ERROR": "high", "WARNING": "medium", "INFO": "low"}
# Heading of the text report.
REPORT_TITLE = "DATASET ERROR REPORT"
REPORT_RULE = "===================="

# Sentences about an analysis and an application.
SUMMARY_SENTENCE = "Found %d issues across %d categories."
APPLY_SENTENCE = "Applied %d issues; %d skipped"

DECISION_KEY = ["dataset_id", "issue_id"]


def _lookup(table: dict[str, str], key: Column) -> Column:
    entries = [F.lit(x) for item in table.items() for x in item]
    return F.try_element_at(F.create_map(*entries), key)


def analysis_summary(issues: DataFrame) -> DataFrame:
    """(dataset_id, issues, types, summary)."""
    per_type = issues.groupBy("dataset_id", "type").agg(F.count(F.lit(1)).alias("n"))
    totals = per_type.groupBy("dataset_id").agg(F.sum("n").alias("issues"), F.count(F.lit(1)).alias("types"))
    return totals.withColumn("summary", F.format_string(SUMMARY_SENTENCE, "issues", "types"))


def normalize_issues(raw: DataFrame) -> DataFrame:
    """Fill what an issue record may leave out; columns outside the record are dropped.

    A missing id becomes ``{dataset_id}_{type}``, a missing category ``quick_fixes``, a missing
    severity ``medium``.  Absent columns are added as nulls.
    """
    present = set(raw.columns)

    def field(f) -> Column:
        return (F.col(f.name) if f.name in present else F.lit(None)).cast(f.dataType)

    defaults = {
        "id": F.concat_ws("_", "dataset_id", F.coalesce(F.col("type"), F.lit("unknown"))),
        "category": F.lit("quick_fixes"),
        "severity": F.lit("medium"),
    }
    rows = raw.select(*[field(f).alias(f.name) for f in ISSUE_SCHEMA])
    return rows.withColumns({k: F.coalesce(F.col(k), v) for k, v in defaults.items()})


def normalize_analyses(analyses: DataFrame, now: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Split records (dataset_id, issues: array, summary, completedAt) into usable and rejected ones.

    A record without an ``issues`` array is rejected; a missing ``completedAt`` becomes now.
    """
    stamp = F.coalesce("completedAt", now if now is not None else F.current_timestamp())
    good = analyses.where("issues IS NOT NULL").withColumn("completedAt", stamp)
    return good, analyses.where("issues IS NULL")


def extract_json_text(text: Column) -> Column:
    """From the first ``{`` to the last ``}``; without such a span, the text without code fences."""
    stripped = strip(text)
    start = F.instr(stripped, "{")
    end = F.length(stripped) - F.instr(F.reverse(stripped), "}") + 1
    has_end = F.contains(stripped, F.lit("}"))
    body = F.substring(stripped, start, end - start + 1)
    fenced = strip(F.regexp_replace(stripped, r"\A```(?:json)?|```\z", ""))
    return F.when((start > 0) & has_end & (end > start), body).otherwise(fenced)


def extract_json_payload(df: DataFrame, text: str, schema: str, into: str = "payload") -> DataFrame:
    """Parse the JSON inside a noisy text column; what does not parse becomes null."""
    return df.withColumn(into, F.from_json(extract_json_text(F.col(text)), schema, {"mode": "PERMISSIVE"}))


def parse_report_lines(lines: DataFrame, text: str = "value", dataset_id: str = "dataset") -> DataFrame:
    """Lines ``[CATEGORY] SEVERITY: message`` as issue columns; other lines are left out.

    Columns: dataset_id, report_category, report_severity, type, severity, column, affected_rows,
    row_ids, description.
    """
    c = F.col(text)
    head = r"\[([A-Z_]+)\]\s+(ERROR|WARNING|INFO):\s*(.*)"
    category, level = F.regexp_extract(c, head, 1), F.regexp_extract(c, head, 2)
    message = F.trim(F.regexp_extract(c, head, 3))
    number = F.regexp_extract(message, r"\b(?:has|are|contains|in)\s+(\d+)\b|\((\d+) occurrence", 0)
    ids = F.regexp_extract(message, r"(?i)rows?:?\s*\[([^\]]*)\]", 1)
    return (
        lines.where(c.rlike(head))
        .select(
            F.lit(dataset_id).alias("dataset_id"),
            category.alias("report_category"),
            level.alias("report_severity"),
            F.coalesce(_lookup(REPORT_TYPES, category), F.lit("other")).alias("type"),
            _lookup(REPORT_SEVERITIES, level).alias("severity"),
            F.nullif(F.regexp_extract(message, r"[Cc]olumn '([^']*)'", 1), F.lit("")).alias("column"),
            F.regexp_extract(number, r"(\d+)", 1).try_cast("bigint").alias("affected_rows"),
            F.transform(F.regexp_extract_all(ids, F.lit(r"(\d+)"), 1), lambda x: x.cast("bigint")).alias("row_ids"),
            message.alias("description"),
        )
    )


def render_report(issues: DataFrame, rows: int, columns: int) -> DataFrame:
    """(part, id, line): heading, shape, then one line per issue, in order of (part, id).

    Write it with ``sink_report``; the lines never gather in one row.
    """
    spark = issues.sparkSession
    shape = f"Shape: {rows} rows x {columns} columns"
    head = spark.createDataFrame(
        [(0, "", REPORT_TITLE), (1, "", REPORT_RULE), (2, "", shape)], "part int, id string, line string"
    )
    by_type = {v: k for k, v in REPORT_TYPES.items() if v not in ("other",)}
    by_type["outliers"] = "OUTLIER"
    by_type["inconsistent_categories"] = "RARE_CATEGORY"
    level = _lookup({v: k for k, v in REPORT_SEVERITIES.items()}, F.col("severity"))
    label = F.coalesce(_lookup(by_type, F.col("type")), F.upper("type"))
    line = F.format_string(
        "- [%s] %s: Column '%s' has %d affected rows. %s",
        label,
        F.coalesce(level, F.lit("WARNING")),
        F.array_join("affectedColumns", ", "),
        F.coalesce("affectedRows", F.lit(0)),
        F.coalesce("description", F.lit("")),
    )
    body = issues.select(F.lit(3).alias("part"), "id", line.alias("line"))
    return head.unionByName(body).orderBy("part", "id", "line")


def decision_upsert(decisions: DataFrame, updates: DataFrame) -> DataFrame:
    """One decision per dataset and issue: the latest by ``updated_at``, an update on a tie."""
    both = decisions.withColumn("__new", F.lit(0)).unionByName(updates.withColumn("__new", F.lit(1)))
    order = [F.desc_nulls_last("updated_at"), F.desc("__new"), F.desc("accepted"), F.desc_nulls_last("reason")]
    return first_per_group(both, DECISION_KEY, order).drop("__new")


def _decided(issues: DataFrame, decisions: DataFrame) -> DataFrame:
    side = decisions.select(
        "dataset_id", F.col("issue_id").alias("id"), F.col("accepted").alias("__accepted"), F.col("reason").alias("__reason")
    )
    return issues.join(side, ["dataset_id", "id"], "left")


def apply_decisions(issues: DataFrame, decisions: DataFrame) -> DataFrame:
    """Attach the accepted flag; null where nothing was decided."""
    out = _decided(issues, decisions).withColumn("accepted", F.col("__accepted"))
    return out.select(*issues.columns)


def cleaning_plan(issues: DataFrame, decisions: DataFrame) -> DataFrame:
    """One row per issue with status accepted, rejected or pending, the reason and the detector."""
    accepted = F.col("__accepted")
    status = F.when(accepted.isNull(), "pending").when(accepted, "accepted").otherwise("rejected")
    return _decided(issues, decisions).select(
        "dataset_id",
        F.col("id").alias("issue_id"),
        "type",
        "category",
        "severity",
        "affectedColumns",
        "suggestedAction",
        F.col("investigation.rule").alias("detector"),
        F.col("__reason").alias("decision_reason"),
        status.alias("status"),
    )


def plan_summary(plan: DataFrame) -> DataFrame:
    """(dataset_id, accepted, rejected, pending), zero where a status does not occur."""
    return plan.groupBy("dataset_id").agg(
        *[F.count_if(F.col("status") == s).alias(s) for s in ("accepted", "rejected", "pending")]
    )


def apply_issues(issues: DataFrame, applied: DataFrame, requests: DataFrame) -> DataFrame:
    """(dataset_id, issue_id, position, outcome): what each requested id leads to.

    ``requests`` has dataset_id, issue_id and position.  Outcomes: applied, skipped_unknown,
    skipped_applied (earlier), skipped_repeated (asked before in the same request).
    """
    known = issues.select("dataset_id", F.col("id").alias("issue_id")).distinct().withColumn("__known", F.lit(True))
    done = applied.select(*DECISION_KEY).distinct().withColumn("__done", F.lit(True))
    first = requests.groupBy(*DECISION_KEY).agg(F.min("position").alias("__first"))
    outcome = (
        F.when(F.col("__known").isNull(), "skipped_unknown")
        .when(F.col("__done"), "skipped_applied")
        .when(F.col("position") > F.col("__first"), "skipped_repeated")
        .otherwise("applied")
    )
    judged = first.join(known, DECISION_KEY, "left").join(done, DECISION_KEY, "left")
    return requests.join(judged, DECISION_KEY).select(*DECISION_KEY, "position", outcome.alias("outcome"))


def apply_message(outcomes: DataFrame) -> DataFrame:
    return outcomes.groupBy("dataset_id").agg(
        F.format_string(
            APPLY_SENTENCE,
            F.count_if(F.col("outcome") == "applied"),
            F.count_if(F.col("outcome") != "applied"),
        ).alias("message")
    )


def decisions_from_applied(outcomes: DataFrame, updated_at: Column) -> DataFrame:
    """Accepted decisions for the issues just applied."""
    return outcomes.where("outcome = 'applied'").select(
        *DECISION_KEY, F.lit(True).alias("accepted"), F.lit(None).cast("string").alias("reason"), updated_at.alias("updated_at")
    )


def valid_updates(issues: DataFrame, updates: DataFrame) -> DataFrame:
    """Updates whose issue exists."""
    ids = issues.select("dataset_id", F.col("id").alias("issue_id"))
    return updates.join(ids, DECISION_KEY, "left_semi")


def record_decision(issues: DataFrame, decisions: DataFrame, updates: DataFrame) -> DataFrame:
    """Upsert the updates that name an existing issue; the new decision table."""
    return decision_upsert(decisions, valid_updates(issues, updates))


def smart_fix_responses(issues: DataFrame, answers: DataFrame) -> DataFrame:
    """Latest non-blank answer per smart-fix issue."""
    eligible = issues.where("category = 'smart_fixes'").select("dataset_id", F.col("id").alias("issue_id"))
    usable = answers.withColumn("response", strip(F.col("response"))).where("response <> ''")
    usable = usable.join(eligible, DECISION_KEY, "left_semi")
    return first_per_group(usable, DECISION_KEY, [F.desc_nulls_last("updated_at"), F.desc("response")])


def resolve_smart_fix(issues: DataFrame, answers: DataFrame) -> DataFrame:
    """(dataset_id, issue_id, type, response, action, value): what an answer asks for.

    ``intentional`` and ``keep`` change nothing; ``standardize`` asks for the repair of the issue's
    type; any other answer is a custom value to standardise on.
    """
    latest = smart_fix_responses(issues, answers)
    joined = latest.join(issues.select("dataset_id", F.col("id").alias("issue_id"), "type"), DECISION_KEY)
    repair = F.when(F.col("type") == "category_drift", "canonical_category").otherwise("standardize_most_frequent")
    key = F.lower("response")
    action = (
        F.when(key.isin("intentional", "keep"), "no_change").when(key == "standardize", repair).otherwise("standardize_canonical")
    )
    value = F.when(~key.isin("intentional", "keep", "standardize"), F.col("response"))
    return joined.select(*DECISION_KEY, "type", "response", action.alias("action"), value.alias("value"))


def category_totals(issues: DataFrame) -> DataFrame:
    return issues.groupBy("category").agg(
        F.count(F.lit(1)).alias("issues"), F.sum(F.coalesce("affectedRows", F.lit(0))).alias("affected_rows")
    )


def analysis_history(analyses: DataFrame, n: int = 10) -> DataFrame:
    """Latest ``n`` analyses per dataset, by completion time."""
    return first_per_group(analyses, ["dataset_id"], [F.desc("completed_at"), F.desc("analysis_id")], n)


def unknown_types(issues: DataFrame) -> DataFrame:
    """Issues whose type is outside the accepted names."""
    return issues.where(~F.col("type").isin(*ISSUE_TYPES))
