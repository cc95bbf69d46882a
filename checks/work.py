"""Registered queries on issues, decisions, text context and conversations, each with its SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from tablewright.functions.issues import (
    duplicate_severity,
    issue_id,
    ratio_of,
    severity_from_ratio,
)
from tablewright.functions.staging import new_folder, stage
from tablewright.operators import context, workflow
from tablewright.plans import analysis
from tablewright.sources import store

from .base import joined, us
from .detect import COLLAPSED, DRIFT, GAPS, MISSING, OTHERS, VARIATION
from .tables import ALL_COLUMNS, DIRTY_ROLES, dirty, table, with_dirty

PART_ROLES = analysis.Roles(key="p_partkey", product="p_name", category="p_brand")
DAY = "2024-02-01 00:00:00"


def accepted_text():
    """The flag as text: a boolean column with nulls has no common form in data frames."""
    return F.col("accepted").cast("string").alias("accepted")


def issues(s, d):
    """All detectors on the dirty view, and category drift on ``part``."""
    found = analysis.run_all_detectors(dirty(s, d), "events", DIRTY_ROLES)
    parts = analysis.drift_issues(table(s, d, "part"), "part", PART_ROLES)
    return analysis.without_position(found).unionByName(parts)


def run_all_detectors(s, d):
    out = analysis.run_all_detectors(dirty(s, d), "events", DIRTY_ROLES)
    output = F.col("investigation.output")
    return out.select(
        "position",
        "dataset_id",
        "id",
        "type",
        "severity",
        "description",
        joined("affectedColumns").alias("affected_columns"),
        "category",
        F.col("affectedRows").alias("affected_rows"),
        F.coalesce(output["sample_row_indices"], output["example_indices"]).alias("examples"),
        F.when(F.col("type") == "supplier_variations", output["examples"])
        .otherwise(output["departments"])
        .alias("named_values"),
        F.col("suggestedAction").alias("suggested_action"),
        output["example_pairs"].alias("example_pairs"),
        F.when(F.col("type") == "whitespace", output["examples"]).alias("stray_values"),
        evidence_text(F.col("investigation.evidence")).alias("evidence"),
    )


def evidence_text(pairs):
    """Pairs of before and after as one text."""
    return F.array_join(F.transform(pairs, lambda e: F.concat(F.coalesce(e["current"], F.lit("null")), F.lit(" -> "), e["fixed"])), "; ")


def issue_details(s, d):
    """All values of the issues of the dirty view, and of drifting parts."""
    found = analysis.issue_details(dirty(s, d), "events", DIRTY_ROLES)
    return found.unionByName(analysis.issue_details(table(s, d, "part"), "part", PART_ROLES))


def severity_ladder(s, d):
    """Severity of the share of each event type, and of its repeated users, under both scales."""
    df = dirty(s, d)
    total = df.agg(F.count(F.lit(1))).scalar()
    ratio = ratio_of(F.col("rows"), total)
    counts = df.groupBy("product").agg(F.count(F.lit(1)).alias("rows"))
    return counts.select(
        "product",
        "rows",
        severity_from_ratio(ratio).alias("severity"),
        severity_from_ratio(ratio, high=0.5, medium=0.2).alias("documented_severity"),
        duplicate_severity(ratio).alias("duplicate_severity"),
    )


def issue_ids(s, d):
    parts = table(s, d, "part")
    return parts.select(
        "p_partkey", issue_id(F.lit("part"), F.concat(F.lit("Category Drift "), F.initcap("p_name"))).alias("id")
    )


def decisions(found):
    """Decisions derived from the issues: two thirds are decided, by the length of their id."""
    n = F.length("id")
    return found.where(n % 3 != 0).select(
        "dataset_id",
        F.col("id").alias("issue_id"),
        (n % 2 == 0).alias("accepted"),
        F.concat(F.lit("reason "), n.cast("string")).alias("reason"),
        F.lit(DAY).cast("timestamp").alias("updated_at"),
    )


def updates(found):
    """Later decisions on some of the same issues, earlier ones on others, and an unknown issue."""
    n = F.length("id")
    known = found.where(n % 5 != 0).select(
        "dataset_id",
        F.col("id").alias("issue_id"),
        (n % 2 == 1).alias("accepted"),
        F.lit("changed").alias("reason"),
        F.when(n % 7 < 4, F.lit("2024-02-02 00:00:00")).otherwise(F.lit("2024-01-02 00:00:00")).cast("timestamp").alias("updated_at"),
    )
    stray = found.groupBy("dataset_id").agg(F.count(F.lit(1)).alias("n")).select(
        "dataset_id",
        F.lit("unknown").alias("issue_id"),
        F.lit(True).alias("accepted"),
        F.lit("stray").alias("reason"),
        F.lit(DAY).cast("timestamp").alias("updated_at"),
    )
    return known.unionByName(stray)


def shown_decisions(df):
    return df.select("dataset_id", "issue_id", "accepted", "reason", us("updated_at").alias("updated_us"))


def applied(found):
    n = F.length("id")
    return found.where(n % 4 == 0).select(
        "dataset_id", F.col("id").alias("issue_id"), F.lit(DAY).cast("timestamp").alias("updated_at")
    )


def requests(found):
    """Every issue asked for once, some twice, and one unknown id per dataset."""
    n = F.length("id")
    once = found.select("dataset_id", F.col("id").alias("issue_id"), n.cast("bigint").alias("position"))
    twice = found.where(n % 2 == 0).select("dataset_id", F.col("id").alias("issue_id"), (n + 1000).cast("bigint").alias("position"))
    stray = found.groupBy("dataset_id").agg(F.max(F.length("id")).cast("bigint").alias("position")).select(
        "dataset_id", F.lit("unknown").alias("issue_id"), "position"
    )
    return once.unionByName(twice).unionByName(stray)


def answers(found):
    """Two answers per issue: an early one, and a later one that is sometimes blank."""
    n = F.length("id")
    early = found.select(
        "dataset_id", F.col("id").alias("issue_id"), F.lit("keep").alias("response"), F.lit(DAY).cast("timestamp").alias("updated_at")
    )
    late = found.select(
        "dataset_id",
        F.col("id").alias("issue_id"),
        F.when(n % 4 == 0, " ").when(n % 4 == 1, "standardize").when(n % 4 == 2, "intentional").otherwise(" OTC ").alias("response"),
        F.lit("2024-02-02 00:00:00").cast("timestamp").alias("updated_at"),
    )
    return early.unionByName(late)


def issue_store(s, d):
    """Six artefacts, saved, replaced or added to in parts, and read back."""
    found = stage(issues(s, d), "issues")
    root = new_folder(s, "store")
    store.save(found, root, "issues")
    store.save(decisions(found).withColumn("reason", F.lit("to be replaced")), root, "decisions")
    # saving one dataset again must leave the other as it was
    for dataset in ("part", "events"):
        store.save_one(decisions(found), root, "decisions", dataset)
    for remainder in (0, 1):
        store.append(applied(found).where(F.length("issue_id") % 8 == 4 * remainder), root, "applied")
    store.save(workflow.cleaning_plan(found, decisions(found)), root, "plan")
    store.save(workflow.smart_fix_responses(found, answers(found)), root, "answers")
    for text in ("first", "second"):
        context_of = found.select("dataset_id", F.lit(text).alias("instructions"), F.lit(None).alias("column_edits"))
        store.save(context_of.distinct().withColumn("updated_at", F.lit(DAY).cast("timestamp")), root, "context")
    store.vacuum(s, root, "context")
    shown = {
        "issues": ("id", F.concat_ws("|", "type", "severity", F.col("affectedRows").cast("string"))),
        "decisions": ("issue_id", F.concat_ws("|", F.col("accepted").cast("string"), "reason")),
        "applied": ("issue_id", us("updated_at").cast("string")),
        "plan": ("issue_id", F.concat_ws("|", "category", "status")),
        "answers": ("issue_id", F.col("response")),
        "context": ("dataset_id", F.col("instructions")),
    }
    parts = [
        store.load(s, root, kind).select(F.lit(kind).alias("artefact"), "dataset_id", F.col(key).alias("key"), value.alias("value"))
        for kind, (key, value) in shown.items()
    ]
    return reduce(DataFrame.unionByName, parts)


def normalize_issues(s, d):
    found = issues(s, d)
    n = F.length("id")
    raw = found.select(
        "dataset_id",
        F.when(n % 2 == 0, F.col("id")).alias("id"),
        F.when(n % 5 != 0, F.col("type")).alias("type"),
        F.when(n % 3 != 0, F.col("severity")).alias("severity"),
        F.when(n % 4 != 0, F.col("category")).alias("category"),
        "affectedRows",
    )
    out = workflow.normalize_issues(raw)
    return out.select("dataset_id", "id", "type", "severity", "category", F.col("affectedRows").alias("affected_rows"))


PAYLOAD = "struct<issues:array<struct<type:string,affectedRows:bigint>>,k:bigint>"


def extract_json_payload(s, d):
    """The JSON of every event wrapped in prose or in a code fence; every tenth text is cut off."""
    events = table(s, d, "events")
    i = F.col("event_id")
    fence = F.concat(F.lit("```json\n"), F.col("props"), F.lit("\n```"))
    prose = F.concat(F.lit("Here it is: "), F.col("props"), F.lit(" - as asked."))
    text = F.when(i % 10 == 0, F.lit("no result { was found")).when(i % 2 == 0, fence).otherwise(prose)
    out = workflow.extract_json_payload(events.withColumn("reply", text), "reply", PAYLOAD)
    return out.select("event_id", F.col("payload.k").alias("k"))


def _report_lines(s, d):
    df = dirty(s, d)
    n = F.col("event_id")
    line = (
        F.when(F.col("quantity") < 0, F.format_string(
            "- [NEGATIVE_QUANTITY] WARNING: Column 'quantity' has %d negative values. Example rows: [%d, %d].", F.lit(1), n, n + 1))
        .when(F.col("product").isNull(), F.format_string(
            "[MISSING_VALUES] ERROR: Column 'product' has 12 missing values. Example rows: [%d].", n))
        .when(F.col("amount_text") == "N/A", F.lit("[SUMMARY] INFO: Column 'amount_text' (text) - 5 distinct values."))
        .otherwise(F.lit("nothing to report"))
    )
    return df.select("event_id", line.alias("value"))


def parse_report_lines(s, d):
    out = workflow.parse_report_lines(_report_lines(s, d), dataset_id="events")
    return out.select(
        "dataset_id", "report_category", "report_severity", "type", "severity", "column", "affected_rows",
        F.array_join(F.transform("row_ids", lambda x: x.cast("string")), ",").alias("row_ids"), "description",
    )


def render_report(s, d):
    df = dirty(s, d)
    return workflow.render_report(issues(s, d), df.count(), len(df.columns))


def record_decision(s, d):
    found = stage(issues(s, d), "issues")
    return shown_decisions(workflow.record_decision(found, decisions(found), updates(found)))


def cleaning_plan(s, d):
    found = stage(issues(s, d), "issues")
    plan = workflow.cleaning_plan(found, decisions(found))
    totals = workflow.plan_summary(plan)
    return plan.join(totals, "dataset_id").select(
        "dataset_id", "issue_id", "type", "category", "severity", joined("affectedColumns").alias("affected_columns"),
        "decision_reason", "status", F.col("accepted").alias("n_accepted"), F.col("rejected").alias("n_rejected"),
        F.col("pending").alias("n_pending"),
    )


def apply_issues(s, d):
    found = stage(issues(s, d), "issues")
    return workflow.apply_issues(found, applied(found), requests(found))


def with_found(build):
    def query(s, d):
        found = stage(issues(s, d), "issues")
        return build(found)

    return query


def analysis_history(s, d):
    """One analysis per conversation turn: the latest ten per conversation's speaker."""
    turns = table(s, d, "conversations")
    analyses = turns.select(
        F.col("role").alias("dataset_id"),
        F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("analysis_id"),
        (F.col("conv_id") * 100 + F.col("turn")).alias("completed_at"),
        F.length("text").alias("issue_count"),
    )
    return workflow.analysis_history(analyses, 10)


def rows_to_text(s, d):
    return context.rows_to_text(
        dirty(s, d).select("event_id", "event_type", "product", "order_list", "quantity"), ["event_id"], "events.csv"
    )


def session_history(s, d):
    turns = table(s, d, "conversations")
    new = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")).select(
        "conv_id",
        F.lit("user").alias("role"),
        F.format_string("and after %d turns?", "n").alias("text"),
        F.lit(1).alias("seq"),
    )
    out = context.session_history(context.append_turns(turns, new), 4)
    line = F.transform("messages", lambda m: F.concat_ws(":", m["turn"].cast("string"), m["role"], F.md5(m["text"])))
    return out.select("conv_id", F.array_join(line, "|").alias("messages"))


def similar_context(s, d):
    """The five vectors nearest to the centre of each label."""
    vectors = table(s, d, "embeddings")
    cells = vectors.select("label", F.posexplode("embedding").alias("pos", "x"))
    centre = cells.groupBy("label", "pos").agg(F.avg("x").alias("x"))
    ordered = F.array_sort(F.collect_list(F.struct("pos", "x")))  # one entry per dimension
    queries = centre.groupBy("label").agg(F.transform(ordered, lambda e: e["x"]).alias("embedding"))
    found = context.similar_context(vectors, queries.withColumnRenamed("label", "query"), 5)
    return found.withColumn("similarity", F.round("similarity", 6))


QUERIES = {
    "issue_store": issue_store,
    "run_all_detectors": run_all_detectors,
    "issue_details": issue_details,
    "severity_from_ratio": severity_ladder,
    "issue_id": issue_ids,
    "analysis_summary": lambda s, d: workflow.analysis_summary(issues(s, d)),
    "normalize_issues": normalize_issues,
    "extract_json_payload": extract_json_payload,
    "parse_report_lines": parse_report_lines,
    "render_report": render_report,
    "decision_upsert": with_found(lambda f: shown_decisions(workflow.decision_upsert(decisions(f), updates(f)))),
    "apply_decisions": with_found(
        lambda f: workflow.apply_decisions(f, decisions(f)).select("dataset_id", "id", accepted_text())
    ),
    "cleaning_plan": cleaning_plan,
    "apply_issues": apply_issues,
    "record_decision": record_decision,
    "smart_fix_responses": with_found(
        lambda f: workflow.smart_fix_responses(f, answers(f)).select(
            "dataset_id", "issue_id", "response", us("updated_at").alias("updated_us")
        )
    ),
    "resolve_smart_fix": with_found(lambda f: workflow.resolve_smart_fix(f, answers(f))),
    "category_totals": lambda s, d: workflow.category_totals(issues(s, d)),
    "analysis_history": analysis_history,
    "rows_to_text": rows_to_text,
    "session_history": session_history,
    "similar_context": similar_context,
}

PART_DRIFT = """ppairs AS (SELECT p_name AS entity, p_brand AS category, count(*) AS rows FROM part GROUP BY 1, 2),
pdrift AS (SELECT entity, count(*) AS k, CAST(sum(rows) AS BIGINT) AS affected_rows,
  string_agg(category, ', ' ORDER BY category) AS listed
  FROM ppairs GROUP BY entity HAVING count(*) > 1)"""

FACTS = f"""facts AS (SELECT count(*) AS n, count(*) FILTER ({MISSING}) AS missing,
  count(*) FILTER (product <> {COLLAPSED.format("product")}) AS blanks, count(*) FILTER ({VARIATION}) AS supplier FROM dirty),
dups AS (SELECT {ALL_COLUMNS}, count(*) AS copies FROM dirty GROUP BY ALL HAVING count(*) > 1),
near AS (SELECT count(*) FILTER (before_gap <= 1000000) AS pairs,
  count(*) FILTER (before_gap <= 1000000 OR after_gap <= 1000000) AS involved FROM gaps),
drifted AS (SELECT t.entity, t.affected_rows, string_agg(p.category, ', ' ORDER BY p.category) AS listed
  FROM totals t JOIN pairs p ON t.entity = p.entity AND p.category IS NOT NULL GROUP BY 1, 2)"""

ALL_PIPED = "event_id|user_id|event_type|product|order_list|dept_fullname|sale_date|quantity|amount|amount_text|date_text"
NEAR_PIPED = "event_id|user_id|event_type|product|order_list|dept_fullname|quantity|amount|amount_text|date_text|sale_date"


def _severity(x: str) -> str:
    return f"CASE WHEN {x} >= 0.25 THEN 'high' WHEN {x} >= 0.1 THEN 'medium' ELSE 'low' END"


def _first(where: str, n: int, source: str = "dirty") -> str:
    return (
        "(SELECT string_agg(CAST(event_id AS VARCHAR), ', ' ORDER BY event_id) FROM "
        f"(SELECT event_id FROM {source} WHERE {where} ORDER BY event_id LIMIT {n}))"
    )


EXAMPLES = (
    "(SELECT string_agg(v, ', ' ORDER BY v) FROM (SELECT DISTINCT trim(order_list) AS v FROM dirty "
    f"WHERE {VARIATION} ORDER BY v LIMIT 5))"
)
SPELLINGS = EXAMPLES.replace(" LIMIT 5", "")
ISSUES = f"""found AS (
  SELECT 0 AS position, 'events' AS dataset_id, 'events_missing_product' AS id, 'missing_values' AS type,
    {_severity("missing / n")} AS severity, '''product'' column contains ' || missing || ' missing or blank values (' ||
    printf('%.1f', missing * 100.0::DOUBLE / n) || '% of rows).' AS description, 'product' AS affected_columns,
    'quick_fixes' AS category, missing AS affected_rows, {_first(MISSING, 5)} AS examples, NULL AS named_values,
    'Fill missing product names using the barcode dictionary or manual review.' AS suggested_action FROM facts WHERE missing > 0
  UNION ALL SELECT 1, 'events', 'events_exact_duplicates', 'duplicates',
    CASE WHEN sum(copies) / (SELECT n FROM facts) < 0.15 THEN 'medium' ELSE 'high' END,
    'Detected ' || CAST(sum(copies) AS BIGINT) || ' exact duplicate rows. Keep the first instance and remove the rest.',
    '{ALL_PIPED}', 'quick_fixes', CAST(sum(copies) AS BIGINT), {_first("true", 10, "dups")}, NULL,
    'Deduplicate rows based on full row equality to eliminate repeated sales.' FROM dups HAVING count(*) > 0
  UNION ALL SELECT 2, 'events', 'events_product_whitespace', 'whitespace', {_severity("blanks / n")},
    blanks || ' product names contain stray whitespace or duplicated spaces.', 'product', 'quick_fixes', blanks, NULL, NULL,
    'Trim whitespace and collapse multiple spaces in the ''product'' field.'
    FROM facts WHERE blanks > 0
  UNION ALL SELECT 3, 'events', 'events_supplier_variations', 'supplier_variations', 'medium',
    'Detected ' || supplier || ' rows where supplier names deviate from ''Pharmax'' (examples: ' || {EXAMPLES} || ').',
    'order_list', 'smart_fixes', supplier, NULL, {SPELLINGS},
    'Confirm whether all variations should be standardized to ''Pharmax''.' FROM facts WHERE supplier > 0
  UNION ALL SELECT 4, 'events', 'events_category_drift_' || replace(lower(entity), ' ', '_'), 'category_drift', 'medium',
    'Product ''' || entity || ''' appears under multiple departments: ' || listed || '. Business confirmation is required.',
    'dept_fullname', 'smart_fixes', affected_rows, NULL, listed,
    'Select a canonical department for the product and reclassify inconsistent rows.' FROM drifted
  UNION ALL SELECT 5, 'events', 'events_near_duplicates', 'near_duplicates', 'medium',
    'Detected ' || pairs || ' near-duplicate row pairs (differences only within ±1 second on ''sale_date'').',
    '{NEAR_PIPED}', 'quick_fixes', involved, NULL, NULL,
    'Consolidate near-duplicates by keeping the earliest event or merging metrics.' FROM near WHERE pairs > 0),
issues AS (SELECT * EXCLUDE (position, examples, named_values, suggested_action) FROM found
  UNION ALL SELECT 'part', 'part_category_drift_' || replace(lower(entity), ' ', '_'), 'category_drift', 'medium',
    'Product ''' || entity || ''' appears under multiple departments: ' || listed || '. Business confirmation is required.',
    'p_brand', 'smart_fixes', affected_rows FROM pdrift)"""

def _pairs_of(rows: str, current: str, fixed: str, order: str) -> str:
    return (
        f"(SELECT string_agg(coalesce({current}, 'null') || ' -> ' || {fixed}, '; ' ORDER BY {order}) "
        f"FROM (SELECT * FROM {rows} ORDER BY {order} LIMIT 3))"
    )


def _moment(us: str) -> str:
    return f"CAST(make_timestamp({us}) AS VARCHAR)"


STRAY = f"product <> {COLLAPSED.format('product')}"
STRAY_VALUES = (
    "(SELECT string_agg(event_id || ': ''' || product || '''', ', ' ORDER BY event_id, product) "
    f"FROM (SELECT * FROM dirty WHERE {STRAY} ORDER BY event_id, product LIMIT 5))"
)
COUPLES = (
    f"(SELECT string_agg(event_id || ': ' || {_moment('a')} || ', ' || {_moment('b')}, '; ' ORDER BY event_id, a, b) "
    "FROM (SELECT * FROM couples ORDER BY event_id, a, b LIMIT 5))"
)
#: What the record of an issue has beside the issue: pairs of near duplicates, values with stray blanks, before and after.
EVIDENCE = f"""buckets AS (SELECT {OTHERS}, epoch_us(sale_date) // 1000000 AS bucket, count(*) AS rows,
  min(epoch_us(sale_date)) AS f, max(epoch_us(sale_date)) AS l FROM dirty GROUP BY ALL),
linked AS (SELECT *, CASE WHEN lag(bucket) OVER w = bucket - 1 AND f - lag(l) OVER w <= 1000000 THEN lag(l) OVER w END AS p
  FROM buckets WINDOW w AS (PARTITION BY {OTHERS} ORDER BY bucket)),
couples AS (SELECT event_id, coalesce(p, f) AS a, CASE WHEN p IS NULL THEN l ELSE f END AS b FROM linked WHERE rows > 1 OR p IS NOT NULL),
main AS (SELECT entity, first(category ORDER BY rows DESC, category) AS canonical FROM pairs WHERE category IS NOT NULL GROUP BY 1),
drift_examples AS (SELECT entity, string_agg(category || ' -> ' || canonical, '; ' ORDER BY category) AS evidence FROM
  (SELECT entity, category, canonical FROM pairs JOIN main USING (entity) WHERE category <> canonical
   QUALIFY row_number() OVER (PARTITION BY entity ORDER BY category) <= 3) GROUP BY 1),
evidence AS (SELECT 0 AS position, NULL AS entity, {_pairs_of(f"dirty WHERE {MISSING}", "product", "''", "event_id, product NULLS FIRST")} AS evidence
  UNION ALL SELECT 1, NULL, {_pairs_of("dups", "copies || ' copies of ' || event_id", "'1 row of ' || event_id", "event_id")}
  UNION ALL SELECT 2, NULL, {_pairs_of(f"dirty WHERE {STRAY}", "product", COLLAPSED.format("product"), "event_id, product")}
  UNION ALL SELECT 3, NULL, {_pairs_of(f"(SELECT DISTINCT trim(order_list) AS v FROM dirty WHERE {VARIATION})", "v", "'Pharmax'", "v")}
  UNION ALL SELECT 4, 'events_category_drift_' || replace(lower(entity), ' ', '_'), evidence FROM drift_examples
  UNION ALL SELECT 5, NULL, {_pairs_of("couples", _moment("a") + " || ', ' || " + _moment("b"), _moment("a"), "event_id, a, b")})"""
WITH_EVIDENCE = f"""SELECT found.*, CASE WHEN type = 'near_duplicates' THEN {COUPLES} END AS example_pairs,
  CASE WHEN type = 'whitespace' THEN {STRAY_VALUES} END AS stray_values, evidence
FROM found JOIN evidence ON found.position = evidence.position AND coalesce(entity, found.id) = found.id"""
DETAILS = f"""SELECT dataset_id, issue_id, row_number() OVER (PARTITION BY dataset_id, issue_id ORDER BY value) - 1 AS position, value,
  CAST(rows AS BIGINT) AS rows FROM (
  SELECT 'events' AS dataset_id, 'events_category_drift_' || replace(lower(entity), ' ', '_') AS issue_id, category AS value, p.rows
    FROM pairs p JOIN totals USING (entity) WHERE category IS NOT NULL
  UNION ALL SELECT 'part', 'part_category_drift_' || replace(lower(entity), ' ', '_'), category, p.rows FROM ppairs p JOIN pdrift USING (entity)
  UNION ALL SELECT 'events', 'events_supplier_variations', trim(order_list), count(*) FROM dirty WHERE {VARIATION} GROUP BY 3
  UNION ALL SELECT 'events', 'events_product_whitespace', product, count(*) FROM dirty WHERE {STRAY} GROUP BY 3)"""

DECIDED = f"""decisions AS (SELECT dataset_id, id AS issue_id, length(id) % 2 = 0 AS accepted, 'reason ' || length(id) AS reason,
  TIMESTAMP '{DAY}' AS updated_at FROM issues WHERE length(id) % 3 <> 0)"""
UPDATES = f"""updates AS (SELECT dataset_id, id AS issue_id, length(id) % 2 = 1 AS accepted, 'changed' AS reason,
  CASE WHEN length(id) % 7 < 4 THEN TIMESTAMP '2024-02-02' ELSE TIMESTAMP '2024-01-02' END AS updated_at
  FROM issues WHERE length(id) % 5 <> 0
  UNION ALL SELECT DISTINCT dataset_id, 'unknown', true, 'stray', TIMESTAMP '{DAY}' FROM issues)"""
ANSWERS = f"""answers AS (SELECT dataset_id, id AS issue_id, 'keep' AS response, TIMESTAMP '{DAY}' AS updated_at FROM issues
  UNION ALL SELECT dataset_id, id, CASE length(id) % 4 WHEN 0 THEN ' ' WHEN 1 THEN 'standardize' WHEN 2 THEN 'intentional'
  ELSE ' OTC ' END, TIMESTAMP '2024-02-02' FROM issues),
latest AS (SELECT a.dataset_id, issue_id, type, trim(response) AS response, updated_at FROM answers a
  JOIN issues i ON a.dataset_id = i.dataset_id AND issue_id = id WHERE i.category = 'smart_fixes' AND trim(response) <> ''
  QUALIFY row_number() OVER (PARTITION BY a.dataset_id, issue_id ORDER BY updated_at DESC) = 1)"""
REQUESTS = """requests AS (SELECT dataset_id, id AS issue_id, CAST(length(id) AS BIGINT) AS position FROM issues
  UNION ALL SELECT dataset_id, id, length(id) + 1000 FROM issues WHERE length(id) % 2 = 0
  UNION ALL SELECT dataset_id, 'unknown', max(length(id)) FROM issues GROUP BY 1)"""


def over_issues(sql: str, *ctes: str) -> str:
    return with_dirty(sql, GAPS, DRIFT, PART_DRIFT, FACTS, ISSUES, *ctes)


UPSERT = (
    "SELECT dataset_id, issue_id, accepted, reason, epoch_us(updated_at) AS updated_us FROM "
    "(SELECT *, 0 AS new FROM decisions UNION ALL SELECT *, 1 FROM updates{0}) "
    "QUALIFY row_number() OVER (PARTITION BY dataset_id, issue_id ORDER BY updated_at DESC, new DESC) = 1"
)
STATUS = "CASE WHEN accepted IS NULL THEN 'pending' WHEN accepted THEN 'accepted' ELSE 'rejected' END"
REPORT = """reports AS (SELECT CASE
  WHEN quantity < 0 THEN '[NEGATIVE_QUANTITY] WARNING: Column ''quantity'' has 1 negative values. Example rows: [' || event_id
    || ', ' || (event_id + 1) || '].'
  WHEN product IS NULL THEN '[MISSING_VALUES] ERROR: Column ''product'' has 12 missing values. Example rows: [' || event_id || '].'
  WHEN amount_text = 'N/A' THEN '[SUMMARY] INFO: Column ''amount_text'' (text) - 5 distinct values.'
  END AS line, quantity < 0 AS neg, event_id FROM dirty)"""
LABELS = (
    "CASE type WHEN 'missing_values' THEN 'MISSING_VALUES' WHEN 'duplicates' THEN 'DUPLICATE_ROWS' "
    "WHEN 'whitespace' THEN 'WHITESPACE' WHEN 'supplier_variations' THEN 'SUPPLIER_VARIATIONS' "
    "WHEN 'category_drift' THEN 'CATEGORY_DRIFT' WHEN 'near_duplicates' THEN 'NEAR_DUPLICATE' END"
)
LEVELS = "CASE severity WHEN 'high' THEN 'ERROR' WHEN 'medium' THEN 'WARNING' ELSE 'INFO' END"

ORACLE = {
    "issue_store": over_issues(
        "SELECT 'issues' AS artefact, dataset_id, id AS \"key\", type || '|' || severity || '|' || affected_rows AS value FROM issues "
        "UNION ALL SELECT 'decisions', dataset_id, issue_id, CAST(accepted AS VARCHAR) || '|' || reason FROM decisions "
        f"UNION ALL SELECT 'applied', dataset_id, id, CAST(epoch_us(TIMESTAMP '{DAY}') AS VARCHAR) FROM issues WHERE length(id) % 4 = 0 "
        f"UNION ALL SELECT 'plan', i.dataset_id, id, category || '|' || {STATUS} FROM issues i LEFT JOIN decisions d "
        "ON i.dataset_id = d.dataset_id AND id = issue_id "
        "UNION ALL SELECT 'answers', dataset_id, issue_id, response FROM latest "
        "UNION ALL SELECT DISTINCT 'context', dataset_id, dataset_id, 'second' FROM issues",
        DECIDED,
        ANSWERS,
    ),
    "run_all_detectors": over_issues(WITH_EVIDENCE, EVIDENCE),
    "issue_details": over_issues(DETAILS),
    "severity_from_ratio": with_dirty(
        f"SELECT product, rows, {_severity('r')} AS severity, "
        "CASE WHEN r >= 0.5 THEN 'high' WHEN r >= 0.2 THEN 'medium' ELSE 'low' END AS documented_severity, "
        "CASE WHEN r < 0.15 THEN 'medium' ELSE 'high' END AS duplicate_severity FROM "
        "(SELECT product, count(*) AS rows, count(*) / (SELECT count(*) FROM dirty) AS r FROM dirty GROUP BY 1)"
    ),
    "issue_id": "SELECT p_partkey, 'part_category_drift_' || replace(lower(p_name), ' ', '_') AS id FROM part",
    "analysis_summary": over_issues(
        "SELECT dataset_id, count(*) AS issues, count(DISTINCT type) AS types, "
        "'Found ' || count(*) || ' issues across ' || count(DISTINCT type) || ' categories.' AS summary FROM issues GROUP BY 1"
    ),
    "normalize_issues": over_issues(
        "SELECT dataset_id, CASE WHEN n % 2 = 0 THEN id ELSE dataset_id || '_' || CASE WHEN n % 5 <> 0 THEN type ELSE 'unknown' END "
        "END AS id, CASE WHEN n % 5 <> 0 THEN type END AS type, CASE WHEN n % 3 <> 0 THEN severity ELSE 'medium' END AS severity, "
        "CASE WHEN n % 4 <> 0 THEN category ELSE 'quick_fixes' END AS category, affected_rows "
        "FROM (SELECT *, length(id) AS n FROM issues)"
    ),
    "extract_json_payload": "SELECT event_id, CASE WHEN event_id % 10 <> 0 THEN "
    "CAST(regexp_extract(props, '(\\d+)', 1) AS BIGINT) END AS k FROM events",
    "parse_report_lines": with_dirty(
        "SELECT 'events' AS dataset_id, split_part(substring(line, 2), ']', 1) AS report_category, "
        "CASE WHEN neg THEN 'WARNING' WHEN line LIKE '[MISS%' THEN 'ERROR' ELSE 'INFO' END AS report_severity, "
        "CASE WHEN neg THEN 'outliers' WHEN line LIKE '[MISS%' THEN 'missing_values' ELSE 'other' END AS type, "
        "CASE WHEN neg THEN 'medium' WHEN line LIKE '[MISS%' THEN 'high' ELSE 'low' END AS severity, "
        "split_part(line, '''', 2) AS \"column\", "
        "CAST(CASE WHEN neg THEN 1 WHEN line LIKE '[MISS%' THEN 12 END AS BIGINT) AS affected_rows, "
        "CASE WHEN neg THEN event_id || ',' || (event_id + 1) WHEN line LIKE '[MISS%' THEN CAST(event_id AS VARCHAR) ELSE '' END "
        "AS row_ids, regexp_extract(line, '\\] [A-Z]+: (.*)', 1) AS description FROM reports WHERE line IS NOT NULL",
        REPORT,
    ),
    "render_report": over_issues(
        "SELECT 3 AS part, id, '- [' || " + LABELS + " || '] ' || " + LEVELS + " || ': Column ''' || "
        "replace(affected_columns, '|', ', ') || ''' has ' || affected_rows || ' affected rows. ' || description AS line FROM issues "
        "UNION ALL SELECT 0, '', 'DATASET ERROR REPORT' UNION ALL SELECT 1, '', '====================' "
        "UNION ALL SELECT 2, '', 'Shape: ' || n || ' rows x 11 columns' FROM facts"
    ),
    "decision_upsert": over_issues(UPSERT.format(""), DECIDED, UPDATES),
    "apply_decisions": over_issues(
        "SELECT i.dataset_id, id, CAST(accepted AS VARCHAR) AS accepted FROM issues i LEFT JOIN decisions d ON i.dataset_id = d.dataset_id AND id = issue_id",
        DECIDED,
    ),
    "cleaning_plan": over_issues(
        "SELECT dataset_id, issue_id, type, category, severity, affected_columns, decision_reason, status, "
        "count(*) FILTER (status = 'accepted') OVER w AS n_accepted, count(*) FILTER (status = 'rejected') OVER w AS n_rejected, "
        "count(*) FILTER (status = 'pending') OVER w AS n_pending FROM (SELECT i.dataset_id, id AS issue_id, type, category, "
        f"severity, affected_columns, reason AS decision_reason, {STATUS} AS status FROM issues i LEFT JOIN decisions d "
        "ON i.dataset_id = d.dataset_id AND id = issue_id) WINDOW w AS (PARTITION BY dataset_id)",
        DECIDED,
    ),
    "apply_issues": over_issues(
        "SELECT r.dataset_id, r.issue_id, r.position, CASE WHEN i.id IS NULL THEN 'skipped_unknown' "
        "WHEN length(i.id) % 4 = 0 THEN 'skipped_applied' WHEN r.position > min(r.position) OVER "
        "(PARTITION BY r.dataset_id, r.issue_id) THEN 'skipped_repeated' ELSE 'applied' END AS outcome "
        "FROM requests r LEFT JOIN issues i ON r.dataset_id = i.dataset_id AND r.issue_id = i.id",
        REQUESTS,
    ),
    "record_decision": over_issues(
        UPSERT.format(" WHERE (dataset_id, issue_id) IN (SELECT (dataset_id, id) FROM issues)"), DECIDED, UPDATES
    ),
    "smart_fix_responses": over_issues(
        "SELECT dataset_id, issue_id, response, epoch_us(updated_at) AS updated_us FROM latest", ANSWERS
    ),
    "resolve_smart_fix": over_issues(
        "SELECT dataset_id, issue_id, type, response, CASE WHEN response IN ('keep', 'intentional') THEN 'no_change' "
        "WHEN response <> 'standardize' THEN 'standardize_canonical' WHEN type = 'category_drift' THEN 'canonical_category' "
        "ELSE 'standardize_most_frequent' END AS action, "
        "CASE WHEN response NOT IN ('keep', 'intentional', 'standardize') THEN response END AS value FROM latest",
        ANSWERS,
    ),
    "category_totals": over_issues(
        "SELECT category, count(*) AS issues, CAST(sum(affected_rows) AS BIGINT) AS affected_rows FROM issues GROUP BY 1"
    ),
    "analysis_history": "SELECT dataset_id, analysis_id, completed_at, issue_count FROM (SELECT role AS dataset_id, "
    "conv_id || '-' || turn AS analysis_id, conv_id * 100 + turn AS completed_at, CAST(length(text) AS INTEGER) AS issue_count "
    "FROM conversations) QUALIFY row_number() OVER (PARTITION BY dataset_id ORDER BY completed_at DESC, analysis_id DESC) <= 10",
    "rows_to_text": with_dirty(
        "SELECT CAST(line_no AS INTEGER) AS line_no, line FROM (SELECT * FROM (VALUES (-2, 'Les données suivantes proviennent du fichier Excel : events.csv.'), "
        "(-1, 'Colonnes : event_id, event_type, product, order_list, quantity.'), (0, 'Voici un aperçu des lignes :')) v(line_no, line) "
        "UNION ALL SELECT line_no, 'Ligne ' || line_no || ' : ' || concat_ws('; ', 'event_id = ' || event_id, "
        "'event_type = ' || event_type, 'product = ' || product, 'order_list = ' || order_list, 'quantity = ' || quantity) "
        "FROM (SELECT *, row_number() OVER (ORDER BY event_id) AS line_no FROM dirty) WHERE line_no <= 50)"
    ),
    "session_history": "WITH a AS (SELECT conv_id, turn, role, text FROM conversations UNION ALL "
    "SELECT conv_id, max(turn) + 1, 'user', 'and after ' || count(*) || ' turns?' FROM conversations GROUP BY 1), "
    "l AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 4) "
    "SELECT conv_id, string_agg(turn || ':' || role || ':' || md5(text), '|' ORDER BY turn) AS messages FROM l GROUP BY 1",
    "similar_context": "WITH x AS (SELECT vec_id, label, CAST(unnest(embedding) AS DOUBLE) AS x, "
    "generate_subscripts(embedding, 1) AS pos FROM embeddings), c AS (SELECT label AS query, pos, avg(x) AS x FROM x GROUP BY 1, 2), "
    "s AS (SELECT query, vec_id, round(sum(c.x * x.x) / (sqrt(sum(c.x * c.x)) * sqrt(sum(x.x * x.x))), 9) AS similarity "
    "FROM x JOIN c USING (pos) GROUP BY 1, 2) SELECT query, vec_id, round(similarity, 6) AS similarity, "
    "CAST(row_number() OVER (PARTITION BY query ORDER BY similarity DESC, vec_id) AS INTEGER) AS rank FROM s "
    "QUALIFY row_number() OVER (PARTITION BY query ORDER BY similarity DESC, vec_id) <= 5",
}
