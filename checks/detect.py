"""Registered queries on detectors and evidence, each with its SQL for the other engine."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablewright.functions.issues import ratio_of, severity_from_ratio
from tablewright.functions.missing import is_missing
from tablewright.functions.text import collapse_blanks
from tablewright.operators import drift, duplicates, evidence, formats, missing, outliers, rules, variants, whitespace

from .base import us
from .tables import DIRTY_COLUMNS, dirty, table, with_dirty

STEM = "Pharmax"
BLANKS = r"\s+"
OTHERS = ", ".join(c for c in DIRTY_COLUMNS if c != "sale_date")
ALL = ", ".join(DIRTY_COLUMNS)


def missing_values(s, d):
    df = dirty(s, d)
    out = evidence.hit_summary(df, is_missing(df, "product"), "event_id", 5)
    ratio = ratio_of(F.col("affected_rows"), F.col("rows"))
    return out.select(
        "rows",
        "affected_rows",
        F.round(ratio, 9).alias("ratio"),
        severity_from_ratio(ratio).alias("severity"),
        F.array_join(F.transform("example_ids", lambda x: x.cast("string")), ",").alias("example_ids"),
    )


def exact_duplicates(s, d):
    return duplicates.exact_duplicates(dirty(s, d)).select("event_id", us("sale_date").alias("sale_us"), "product", "copies")


def duplicate_key_conflicts(s, d):
    return duplicates.duplicate_key_conflicts(dirty(s, d), "event_id", ["sale_date", "amount", "product"])


def category_drift_timing(s, d):
    out = drift.category_drift_timing(dirty(s, d), "product", "dept_fullname", "sale_date")
    return out.select(
        "entity",
        "category",
        "rows",
        *[us(c).alias(c) for c in ("first", "last", "entity_first", "entity_last")],
        "categories",
        "affected_rows",
    )


def zscore(s, d):
    out = outliers.zscore_summary(dirty(s, d), "amount")
    return out.select(
        "outlier_count", *[F.round(c, 6).alias(c) for c in ("outlier_percent", "mean", "std", "min", "max")]
    )


def missing_by_period(s, d):
    out = missing.missing_by_period(dirty(s, d), "product", "sale_date")
    return out.select(
        us("period").alias("period"),
        "rows",
        "missing_count",
        F.round("missing_percent", 6).alias("missing_percent"),
        F.round("missing_percent_of_table", 6).alias("missing_percent_of_table"),
    )


def temporal_profile(s, d):
    out = formats.temporal_profile(dirty(s, d), "sale_date", "amount")
    return out.select(
        us("period").alias("period"),
        "rows",
        "values",
        F.round("total", 4).alias("total"),
        F.round("mean", 6).alias("mean"),
        "min",
        "max",
    )


RULES = [
    rules.Rule("negative_quantity", "quantity < 0"),
    rules.Rule("free_item", "amount < 5 AND quantity > 0"),
    rules.Rule("no_such_column", "nowhere > 0"),
    rules.Rule("unpriced", lambda df: df.where(F.col("amount_text") == "N/A")),
    rules.Rule("supplier_absent", "order_list IS NULL"),
]


def custom_rule(s, d):
    return rules.custom_rule(dirty(s, d), RULES).withColumn("error", F.col("error").isNotNull())


def example_row_ids(s, d):
    df = dirty(s, d)
    hits = [
        ("missing", df.where(is_missing(df, "product"))),
        ("whitespace", whitespace.whitespace_normalize(df, "product")),
        ("negative", outliers.negative_quantity(df, "quantity")),
        ("invalid_date", formats.invalid_dates(df, "date_text")),
    ]
    parts = [h.select(F.lit(n).alias("issue"), "event_id") for n, h in hits]
    union = parts[0].union(parts[1]).union(parts[2]).union(parts[3])
    return evidence.example_row_ids(union, "issue", "event_id", 10)


PROBLEMS = {
    "missing_values": ["product", "order_list"],
    "duplicates": ["event_id", "sale_date"],
    "whitespace": ["product", "order_list"],
    "outliers": ["amount", "quantity"],
    "category_drift": ["product"],
    "invalid_dates": ["date_text"],
    "other": ["event_type"],
}


def problem_sample(s, d):
    df = dirty(s, d)
    out = None
    for issue, columns in PROBLEMS.items():
        part = evidence.problem_sample(df, issue, columns, ["event_id"], 10)
        text = F.concat_ws("|", *[F.coalesce(us(c) if c == "sale_date" else F.col(c), F.lit("-")).cast("string") for c in columns])
        part = part.select(F.lit(issue).alias("issue"), text.alias("cells"))
        out = part if out is None else out.union(part)
    return out


def supplier_family(s, d):
    """Rows of each spelling, of the first supplier column that a table has."""
    df = dirty(s, d).select("event_id", F.col("order_list").alias("Supplier Name"), F.col("product").alias("Manufacturer"))
    name = variants.first_present(df)
    return variants.supplier_family(df, name, STEM).withColumn("column", F.lit(name))


def issue_investigation(s, d):
    df = dirty(s, d)
    facts = df.agg(
        F.count_if(F.col("quantity") < 0).alias("negative"), F.count_if(F.col("amount_text") == "N/A").alias("unpriced")
    )
    issues = facts.select(F.lit("quantity").alias("issue"), "negative", "unpriced")
    examples = evidence.before_after_examples(df.where("quantity < 0"), "quantity", F.abs("quantity"))
    out = evidence.issue_investigation(
        issues,
        F.lit("quantity < 0"),
        {"negative": F.col("negative"), "unpriced": F.col("unpriced")},
        evidence.as_evidence(examples).scalar(),
    )
    i = F.col("investigation")
    return out.select(
        "issue",
        i["rule"].alias("rule"),
        i["success"].alias("success"),
        i["output"]["negative"].alias("negative"),
        i["output"]["unpriced"].alias("unpriced"),
        F.array_join(F.transform(i["evidence"], lambda e: F.concat(e["current"], F.lit(" -> "), e["fixed"])), "; ").alias("evidence"),
    )


QUERIES = {
    "missing_values": missing_values,
    "missing_values_any": lambda s, d: missing.missing_values_any(dirty(s, d), ["product", "order_list", "dept_fullname"])
    .select("event_id", "product", "order_list", "dept_fullname"),
    "exact_duplicates": exact_duplicates,
    "duplicate_groups": lambda s, d: duplicates.duplicate_groups(dirty(s, d)),
    "duplicates_on_subset": lambda s, d: duplicates.duplicates_on_subset(
        table(s, d, "lineitem"), ["l_orderkey", "l_linenumber"]
    ).select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"),
    "whitespace_normalize": lambda s, d: whitespace.whitespace_normalize(table(s, d, "documents"), "text").select(
        "doc_id", "n_chars"
    ),
    "whitespace_edges_or_double": lambda s, d: whitespace.whitespace_edges_or_double(dirty(s, d), "product").select(
        "event_id", "product"
    ),
    "whitespace_edges": lambda s, d: whitespace.whitespace_edges(dirty(s, d), ["product", "order_list"]).select(
        "event_id", "product", "order_list"
    ),
    "whitespace_kinds": lambda s, d: whitespace.whitespace_kinds(dirty(s, d), "product").select(
        "event_id", "product", "leading", "trailing", "multiple_internal"
    ),
    "supplier_variations": lambda s, d: variants.supplier_variations(dirty(s, d), "order_list", STEM),
    "supplier_family": supplier_family,
    "supplier_family_stats": lambda s, d: variants.supplier_family_stats(dirty(s, d), "order_list", STEM),
    "column_correlation": lambda s, d: outliers.column_correlation(table(s, d, "lineitem")).withColumn(
        "correlation", F.round("correlation", 9)
    ),
    "category_drift": lambda s, d: drift.category_drift(dirty(s, d), "product", "dept_fullname"),
    "category_drift_cutoff": lambda s, d: drift.category_drift_cutoff(
        dirty(s, d), "product", "click", "dept_fullname", "sale_date", "2024-01-15"
    ),
    "near_duplicates": lambda s, d: duplicates.near_duplicates(dirty(s, d), "sale_date"),
    "near_duplicate_rows": lambda s, d: duplicates.near_duplicate_rows(dirty(s, d), "sale_date").select(
        "event_id", us("sale_date").alias("sale_us"), "product", "copies"
    ),
    "outliers_iqr": lambda s, d: outliers.outliers_iqr(dirty(s, d), "amount").select("event_id", "amount"),
    "rare_values": lambda s, d: variants.rare_values(dirty(s, d), "product"),
    "invalid_dates": lambda s, d: formats.invalid_dates(dirty(s, d), "date_text").select("event_id", "date_text"),
    "type_inconsistency": lambda s, d: formats.type_inconsistency(dirty(s, d), "amount_text"),
    "value_range": lambda s, d: outliers.value_range(table(s, d, "customer"), "c_acctbal", 0, 9000).select(
        "c_custkey", "c_acctbal"
    ),
    "negative_quantity": lambda s, d: outliers.negative_quantity(dirty(s, d), "quantity").select("event_id", "quantity"),
    "rare_category": lambda s, d: variants.rare_category(table(s, d, "documents"), "text", 1).select(
        F.md5("value").alias("digest"), "rows"
    ),
    "id_consistency": lambda s, d: drift.id_consistency(table(s, d, "part"), "p_name", ["p_brand", "p_type"]),
    "category_drift_timing": category_drift_timing,
    "outliers_zscore": zscore,
    "duplicate_key_conflicts": duplicate_key_conflicts,
    "missing_by_period": missing_by_period,
    "missing_span": lambda s, d: missing.missing_span(dirty(s, d), "product", "sale_date").select(
        us("first").alias("first"), us("last").alias("last"), "rows"
    ),
    "missing_weekday_weekend": lambda s, d: missing.missing_weekday_weekend(dirty(s, d), "product", "sale_date").withColumn(
        "missing_percent", F.round("missing_percent", 6)
    ),
    "fuzzy_categories": lambda s, d: variants.fuzzy_categories(table(s, d, "part"), "p_name"),
    "case_space_variants": lambda s, d: variants.case_space_variants(dirty(s, d), "order_list"),
    "date_consistency": lambda s, d: formats.date_consistency_across(
        table(s, d, "lineitem"), table(s, d, "orders"), "l_orderkey", "o_orderkey", "o_orderdate", "l_shipdate"
    ).select("l_orderkey", "l_linenumber", us("l_shipdate").alias("ship_us"), us("o_orderdate").alias("order_us")),
    "pattern_check": lambda s, d: formats.pattern_check(dirty(s, d), "date_text", r"\d{4}-\d{2}-\d{2}").select(
        "event_id", "date_text"
    ),
    "temporal_profile": temporal_profile,
    "custom_rule": custom_rule,
    "problem_sample": problem_sample,
    "example_row_ids": example_row_ids,
    "before_after_examples": lambda s, d: evidence.before_after_examples(
        dirty(s, d), "product", collapse_blanks(F.col("product")), 5
    ),
    "issue_investigation": issue_investigation,
}

MISSING = "(product IS NULL OR trim(product) IN ('', 'NULL', 'null'))"
COLLAPSED = f"trim(regexp_replace({{0}}, '{BLANKS}', ' ', 'g'))"
EDGES = "{0} <> regexp_replace({0}, '^\\s+|\\s+$', '', 'g')"
VARIATION = "lower(trim(order_list)) LIKE 'pharmax%' AND trim(order_list) NOT IN ('Pharmax', 'pharmax')"
FREQ = "freq AS (SELECT product AS value, count(*) AS rows FROM dirty WHERE product IS NOT NULL GROUP BY 1)"
RARE = "rare AS (SELECT * FROM freq WHERE rows < (SELECT median(rows) FROM freq))"
FENCES = (
    "fences AS (SELECT quantile_cont({0}, 0.25) - 1.5 * (quantile_cont({0}, 0.75) - quantile_cont({0}, 0.25)) AS lo, "
    "quantile_cont({0}, 0.75) + 1.5 * (quantile_cont({0}, 0.75) - quantile_cont({0}, 0.25)) AS hi FROM dirty)"
)
GAPS = (
    f"gaps AS (SELECT *, epoch_us(sale_date) - epoch_us(lag(sale_date) OVER w) AS before_gap, "
    f"epoch_us(lead(sale_date) OVER w) - epoch_us(sale_date) AS after_gap FROM dirty "
    f"WINDOW w AS (PARTITION BY {OTHERS} ORDER BY sale_date))"
)
DRIFT = (
    "pairs AS (SELECT product AS entity, dept_fullname AS category, count(*) AS rows, min(sale_date) AS first, "
    "max(sale_date) AS last FROM dirty WHERE product IS NOT NULL GROUP BY 1, 2),\n"
    "totals AS (SELECT entity, count(category) AS categories, CAST(sum(rows) AS BIGINT) AS affected_rows, "
    "min(first) AS entity_first, max(last) AS entity_last FROM pairs GROUP BY 1 HAVING count(category) > 1)"
)
EDIT = "1 - levenshtein(a.norm, b.norm) / greatest(length(a.norm), length(b.norm))"
FUZZY = f"""WITH RECURSIVE vals AS (SELECT p_name AS value, lower(p_name) AS norm, count(*) AS rows FROM part
  WHERE p_name IS NOT NULL GROUP BY 1, 2),
norms AS (SELECT DISTINCT norm FROM vals),
links AS (SELECT a.norm AS a, b.norm AS b FROM norms a JOIN norms b ON a.norm <> b.norm AND {EDIT} > 0.85),
reach AS (SELECT norm AS a, norm AS b FROM norms UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
comp AS (SELECT a AS norm, min(b) AS "group" FROM reach GROUP BY 1),
grouped AS (SELECT "group", value, rows FROM vals JOIN comp USING (norm)),
totals AS (SELECT "group", count(*) AS variants, CAST(sum(rows) AS BIGINT) AS group_rows FROM grouped GROUP BY 1)
SELECT "group", value, rows, variants, group_rows FROM grouped JOIN totals USING ("group") WHERE variants > 1"""

_CELL = {"sale_date": "CAST(epoch_us(sale_date) AS VARCHAR)"}
PROBLEM_WHERE = {
    "missing_values": "product IS NULL OR order_list IS NULL",
    "duplicates": "(event_id, sale_date) IN (SELECT (event_id, sale_date) FROM dirty GROUP BY event_id, sale_date HAVING count(*) > 1)",
    "whitespace": f"coalesce({EDGES.format('product')}, false) OR coalesce({EDGES.format('order_list')}, false)",
    "outliers": "amount < (SELECT lo FROM fa) OR amount > (SELECT hi FROM fa) OR quantity < (SELECT lo FROM fq) "
    "OR quantity > (SELECT hi FROM fq)",
    "category_drift": "product IN (SELECT value FROM rare)",
    "invalid_dates": "date_text IS NOT NULL AND try_strptime(date_text, '%Y-%m-%d') IS NULL",
    "other": "true",
}


def _problem_sql() -> str:
    parts = []
    for issue, columns in PROBLEMS.items():
        cells = " || '|' || ".join(f"coalesce({_CELL.get(c, f'CAST({c} AS VARCHAR)')}, '-')" for c in columns)
        order = ", ".join(["event_id"] + [f"{c} NULLS FIRST" for c in columns])
        parts.append(
            f"SELECT * FROM (SELECT '{issue}' AS issue, {cells} AS cells FROM dirty WHERE {PROBLEM_WHERE[issue]} "
            f"ORDER BY {order} LIMIT 10)"
        )
    return with_dirty(
        " UNION ALL ".join(parts),
        FREQ,
        RARE,
        FENCES.format("amount").replace("fences AS", "fa AS"),
        FENCES.format("quantity").replace("fences AS", "fq AS"),
    )


def _ids(issue: str, where: str) -> str:
    return (
        f"SELECT '{issue}' AS issue, CAST(row_number() OVER (ORDER BY event_id) - 1 AS INTEGER) AS position, event_id "
        f"FROM (SELECT event_id FROM dirty WHERE {where} ORDER BY event_id LIMIT 10)"
    )


ORACLE = {
    "missing_values": with_dirty(
        "SELECT count(*) AS rows, n AS affected_rows, round(n / count(*), 9) AS ratio, "
        "CASE WHEN n / count(*) >= 0.25 THEN 'high' WHEN n / count(*) >= 0.1 THEN 'medium' ELSE 'low' END AS severity, "
        "(SELECT string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY event_id) FROM "
        f"(SELECT event_id FROM dirty WHERE {MISSING} ORDER BY event_id LIMIT 5)) AS example_ids "
        f"FROM dirty, (SELECT count(*) AS n FROM dirty WHERE {MISSING}) GROUP BY n"
    ),
    "missing_values_any": with_dirty(
        "SELECT event_id, product, order_list, dept_fullname FROM dirty "
        "WHERE product IS NULL OR order_list IS NULL OR dept_fullname IS NULL"
    ),
    "exact_duplicates": with_dirty(
        f"SELECT event_id, epoch_us(sale_date) AS sale_us, product, count(*) AS copies FROM dirty GROUP BY {ALL} "
        "HAVING count(*) > 1"
    ),
    "duplicate_groups": with_dirty(
        "SELECT CAST(sum(n) AS BIGINT) AS rows_involved, count(*) AS duplicate_groups FROM "
        f"(SELECT count(*) AS n FROM dirty GROUP BY {ALL} HAVING count(*) > 1)"
    ),
    "duplicates_on_subset": "SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice FROM lineitem "
    "QUALIFY count(*) OVER (PARTITION BY l_orderkey, l_linenumber) > 1",
    "whitespace_normalize": f"SELECT doc_id, n_chars FROM documents WHERE text <> {COLLAPSED.format('text')}",
    "whitespace_edges_or_double": with_dirty(
        f"SELECT event_id, product FROM dirty WHERE {EDGES.format('product')} OR contains(product, '  ')"
    ),
    "whitespace_edges": with_dirty(
        f"SELECT event_id, product, order_list FROM dirty WHERE {EDGES.format('product')} OR {EDGES.format('order_list')}"
    ),
    "whitespace_kinds": with_dirty(
        "SELECT * FROM (SELECT event_id, product, regexp_matches(product, '^\\s') AS \"leading\", "
        "regexp_matches(product, '\\s$') AS \"trailing\", contains(trim(product), '  ') AS multiple_internal "
        "FROM dirty WHERE product IS NOT NULL) WHERE \"leading\" OR \"trailing\" OR multiple_internal"
    ),
    "supplier_variations": with_dirty(
        f"SELECT trim(order_list) AS variant, count(*) AS rows FROM dirty WHERE {VARIATION} GROUP BY 1"
    ),
    "supplier_family": with_dirty(
        "SELECT v AS value, count(*) AS rows, 'Supplier Name' AS \"column\" FROM "
        f"(SELECT {COLLAPSED.format('order_list')} AS v FROM dirty) WHERE lower(v) LIKE 'pharmax%' GROUP BY 1"
    ),
    "supplier_family_stats": with_dirty(
        "SELECT count(*) AS family_total, count(*) FILTER (v = 'Pharmax') AS canonical, "
        "count(*) - count(*) FILTER (v = 'Pharmax') AS variations FROM "
        f"(SELECT {COLLAPSED.format('order_list')} AS v FROM dirty) WHERE lower(v) LIKE 'pharmax%'"
    ),
    "column_correlation": " UNION ALL ".join(
        f"SELECT '{a}' AS column_a, '{b}' AS column_b, round(corr({a}, {b}), 9) AS correlation FROM lineitem"
        for a, b in [
            (x, y)
            for i, x in enumerate(
                ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]
            )
            for y in ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"][i + 1 :]
        ]
    ),
    "category_drift": with_dirty(
        "SELECT entity, category, rows, categories, affected_rows FROM pairs JOIN totals USING (entity) "
        "WHERE category IS NOT NULL",
        DRIFT,
    ),
    "category_drift_cutoff": with_dirty(
        "SELECT dept_fullname AS category, count(*) AS rows, count(*) FILTER (sale_date < TIMESTAMP '2024-01-15') AS "
        "before_cutoff, count(*) FILTER (sale_date >= TIMESTAMP '2024-01-15') AS from_cutoff FROM dirty "
        "WHERE product = 'click' AND dept_fullname IS NOT NULL GROUP BY 1"
    ),
    "near_duplicates": with_dirty(
        "SELECT count(*) FILTER (before_gap <= 1000000) AS pairs, "
        "count(*) FILTER (before_gap <= 1000000 OR after_gap <= 1000000) AS rows_involved FROM gaps",
        GAPS,
    ),
    "near_duplicate_rows": with_dirty(
        "SELECT event_id, epoch_us(sale_date) AS sale_us, product, count(*) AS copies FROM gaps "
        f"WHERE before_gap <= 1000000 OR after_gap <= 1000000 GROUP BY {ALL}",
        GAPS,
    ),
    "outliers_iqr": with_dirty(
        "SELECT event_id, amount FROM dirty, fences WHERE amount < lo OR amount > hi", FENCES.format("amount")
    ),
    "rare_values": with_dirty("SELECT value, rows FROM rare", FREQ, RARE),
    "invalid_dates": with_dirty(f"SELECT event_id, date_text FROM dirty WHERE {PROBLEM_WHERE['invalid_dates']}"),
    "type_inconsistency": with_dirty(
        "SELECT amount_text AS value, count(*) AS rows FROM dirty WHERE amount_text IS NOT NULL "
        "AND TRY_CAST(amount_text AS DOUBLE) IS NULL AND (SELECT avg(CASE WHEN TRY_CAST(amount_text AS DOUBLE) IS NULL "
        "THEN 0 ELSE 1 END) FROM dirty WHERE amount_text IS NOT NULL) >= 0.5 GROUP BY 1"
    ),
    "value_range": "SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal < 0 OR c_acctbal > 9000",
    "negative_quantity": with_dirty("SELECT event_id, quantity FROM dirty WHERE quantity < 0"),
    "rare_category": "SELECT md5(text) AS digest, count(*) AS rows FROM documents WHERE text IS NOT NULL "
    "GROUP BY text HAVING count(*) <= 1",
    "id_consistency": "WITH long AS (SELECT p_name AS id, 'p_brand' AS attribute, p_brand AS value FROM part UNION ALL "
    "SELECT p_name, 'p_type', p_type FROM part), counts AS (SELECT id, attribute, value, count(*) AS rows FROM long "
    "WHERE id IS NOT NULL AND value IS NOT NULL GROUP BY ALL) SELECT id, attribute, value, rows, "
    'count(*) OVER (PARTITION BY id, attribute) AS "values" FROM counts '
    "QUALIFY count(*) OVER (PARTITION BY id, attribute) > 1",
    "category_drift_timing": with_dirty(
        "SELECT entity, category, rows, epoch_us(first) AS first, epoch_us(last) AS last, "
        "epoch_us(entity_first) AS entity_first, epoch_us(entity_last) AS entity_last, categories, affected_rows "
        "FROM pairs JOIN totals USING (entity) WHERE category IS NOT NULL",
        DRIFT,
    ),
    "outliers_zscore": with_dirty(
        "SELECT count(*) FILTER (abs(amount - mean) / std > 3) AS outlier_count, "
        "round(count(*) FILTER (abs(amount - mean) / std > 3) * 100.0::DOUBLE / count(*), 6) AS outlier_percent, "
        "round(any_value(mean), 6) AS mean, round(any_value(std), 6) AS std, round(min(amount), 6) AS min, "
        "round(max(amount), 6) AS max FROM dirty, (SELECT avg(amount) AS mean, stddev_samp(amount) AS std FROM dirty)"
    ),
    "duplicate_key_conflicts": with_dirty(
        "SELECT event_id, count(*) AS rows, count(DISTINCT sale_date) AS sale_date_values, "
        "count(DISTINCT amount) AS amount_values, count(DISTINCT coalesce(product, '<null>')) AS product_values, "
        "bool_and(c > 1) AS exact_copies FROM copies GROUP BY event_id HAVING count(*) > 1",
        f"copies AS (SELECT *, count(*) OVER (PARTITION BY {ALL}) AS c FROM dirty)",
    ),
    "missing_by_period": with_dirty(
        "SELECT epoch_us(CAST(date_trunc('day', sale_date) AS TIMESTAMP)) AS period, count(*) AS rows, "
        "count(*) - count(product) AS missing_count, "
        "round((count(*) - count(product)) * 100.0::DOUBLE / count(*), 6) AS missing_percent, "
        "round((count(*) - count(product)) * 100.0::DOUBLE / (SELECT count(*) FROM dirty), 6) AS missing_percent_of_table "
        "FROM dirty GROUP BY 1"
    ),
    "missing_span": with_dirty(
        "SELECT epoch_us(min(sale_date)) AS first, epoch_us(max(sale_date)) AS last, count(*) AS rows "
        "FROM dirty WHERE product IS NULL"
    ),
    "missing_weekday_weekend": with_dirty(
        "SELECT CASE WHEN dayofweek(sale_date) IN (0, 6) THEN 'weekend' ELSE 'weekday' END AS day_kind, "
        "count(*) AS rows, count(*) - count(product) AS missing_count, "
        "round((count(*) - count(product)) * 100.0::DOUBLE / count(*), 6) AS missing_percent FROM dirty GROUP BY 1"
    ),
    "fuzzy_categories": FUZZY,
    "case_space_variants": with_dirty(
        "SELECT spelling_key, value, rows, count(*) OVER (PARTITION BY spelling_key) AS spellings, "
        "CAST(sum(rows) OVER (PARTITION BY spelling_key) AS BIGINT) AS group_rows FROM vals "
        "QUALIFY count(*) OVER (PARTITION BY spelling_key) > 1",
        f"vals AS (SELECT order_list AS value, lower({COLLAPSED.format('order_list')}) AS spelling_key, count(*) AS rows "
        "FROM dirty WHERE order_list IS NOT NULL GROUP BY 1, 2)",
    ),
    "date_consistency": "SELECT l_orderkey, l_linenumber, epoch_us(l_shipdate) AS ship_us, epoch_us(o_orderdate) AS order_us "
    "FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_shipdate < o_orderdate",
    "pattern_check": with_dirty(
        "SELECT event_id, date_text FROM dirty WHERE NOT regexp_full_match(date_text, '\\d{4}-\\d{2}-\\d{2}')"
    ),
    "temporal_profile": with_dirty(
        "SELECT epoch_us(CAST(date_trunc('day', sale_date) AS TIMESTAMP)) AS period, count(*) AS rows, "
        'count(amount) AS "values", round(sum(amount), 4) AS total, round(avg(amount), 6) AS mean, '
        "min(amount) AS min, max(amount) AS max FROM dirty GROUP BY 1"
    ),
    "custom_rule": with_dirty(
        "SELECT 'negative_quantity' AS rule, true AS success, count(*) FILTER (quantity < 0) AS affected_rows, "
        "false AS error FROM dirty UNION ALL "
        "SELECT 'free_item', true, count(*) FILTER (amount < 5 AND quantity > 0), false FROM dirty UNION ALL "
        "SELECT 'no_such_column', false, NULL, true UNION ALL "
        "SELECT 'unpriced', true, count(*) FILTER (amount_text = 'N/A'), false FROM dirty UNION ALL "
        "SELECT 'supplier_absent', true, count(*) FILTER (order_list IS NULL), false FROM dirty"
    ),
    "problem_sample": _problem_sql(),
    "example_row_ids": with_dirty(
        " UNION ALL ".join(
            [
                _ids("missing", MISSING),
                _ids("whitespace", f"product <> {COLLAPSED.format('product')}"),
                _ids("negative", "quantity < 0"),
                _ids("invalid_date", PROBLEM_WHERE["invalid_dates"]),
            ]
        )
    ),
    "before_after_examples": with_dirty(
        f"SELECT DISTINCT product AS current, {COLLAPSED.format('product')} AS fixed FROM dirty "
        f"WHERE product IS DISTINCT FROM {COLLAPSED.format('product')} ORDER BY 1, 2 LIMIT 5"
    ),
    "issue_investigation": with_dirty(
        "SELECT 'quantity' AS issue, 'quantity < 0' AS rule, true AS success, "
        "CAST(count(*) FILTER (quantity < 0) AS VARCHAR) AS negative, "
        "CAST(count(*) FILTER (amount_text = 'N/A') AS VARCHAR) AS unpriced, (SELECT string_agg(DISTINCT quantity || ' -> ' || "
        "abs(quantity), '; ') FROM dirty WHERE quantity < 0) AS evidence FROM dirty"
    ),
}
