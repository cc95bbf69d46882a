"""Registered queries on repairs, each with its SQL for the other engine."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablewright.functions.text import collapse_blanks
from tablewright.operators import repair
from tablewright.operators.outliers import iqr_fences

from .base import us
from .detect import COLLAPSED, FENCES, MISSING
from .tables import DIRTY_COLUMNS, dirty, table, with_dirty

SUPPLIER_VARIANTS = ["Pharmax Ltd", "PHARMAX", " Pharmax ", "pharmax"]
DEPT_MAP = {"OTC": "OTC:General", "OTC:Cold&Flu": "OTC:General"}


def keyed(df, *names):
    return df.select("event_id", us("sale_date").alias("sale_us"), *names)


def fill_default(s, d):
    return keyed(repair.fill_default(dirty(s, d)), "product", "order_list", "dept_fullname", "quantity", "amount")


def _gappy(s, d):
    """The dirty view with amounts missing where the text amount is not a number."""
    return dirty(s, d).withColumn("amount", F.when(F.col("amount_text") != "N/A", F.col("amount")))


def fill_statistic(s, d):
    df = _gappy(s, d).withColumn("quantity", F.when(F.col("quantity") >= 0, F.col("quantity")))
    out = repair.fill_statistic(df, {"amount": "median", "order_list": "mode", "quantity": "mean"})
    return keyed(
        out, F.round("amount", 6).alias("amount"), "order_list", F.round("quantity", 6).alias("quantity")
    )


def fill_forward(s, d):
    out = repair.fill_forward(dirty(s, d), "product", ["user_id"], "sale_date", tie=["event_id"])
    return keyed(out, "user_id", "product")


def fill_lookup(s, d):
    out = repair.fill_lookup(dirty(s, d), "product", "user_id", tokens=("", "NULL", "null"))
    return keyed(out, "product")


def drop_duplicates(s, d):
    return keyed(repair.drop_duplicates(dirty(s, d)), "product", "amount")


def dedupe_by_key(s, d):
    return keyed(repair.dedupe_by_key(dirty(s, d), ["user_id", "event_type"], ["sale_date", "event_id"], "last"), "user_id", "event_type")


def collapse_near_duplicates(s, d):
    out = repair.collapse_near_duplicates(dirty(s, d), "sale_date", sum_columns=["quantity"])
    return keyed(out, "product", "quantity")


def cast_types(s, d):
    types = {"amount_text": "double", "date_text": "date"}
    out = repair.cast_types(dirty(s, d), types)
    return keyed(out, "amount_text", F.col("date_text").cast("string").alias("date_text"))


def parse_dates(s, d):
    out = repair.parse_dates(dirty(s, d), "date_text")
    return keyed(out, us("date_text").alias("parsed_us"))


def trim_collapse(s, d):
    out = repair.trim_collapse(table(s, d, "documents"), ["text"])
    return out.select("doc_id", F.md5("text").alias("digest"), F.length("text").alias("chars"))


def canonical_category(s, d):
    return repair.canonical_category(table(s, d, "part"), "p_name", "p_brand").select("p_partkey", "p_name", "p_brand")


def change_preview(s, d):
    df = dirty(s, d)
    out = repair.replace_column(df, "order_list", collapse_blanks(F.col("order_list")), keep_before="old")
    out = repair.standardize_canonical(out, "order_list", "Pharmax", SUPPLIER_VARIANTS)
    return repair.change_preview(out, "old", "order_list")


def correction_report(s, d):
    df = dirty(s, d)
    fences = iqr_fences(df, "amount")
    out = df.select(
        *[F.col(c).alias(f"old_{c}") for c in ("product", "order_list", "amount", "dept_fullname")], *df.columns
    )
    out = repair.trim_collapse(out, ["product"])
    out = repair.standardize_canonical(out, "order_list", "Pharmax", SUPPLIER_VARIANTS)
    out = repair.cap_outliers(out, "amount", fences=fences)
    out = repair.fill_default(out, ["dept_fullname"])
    pairs = [(f"old_{c}", c) for c in ("product", "order_list", "amount", "dept_fullname")]
    return repair.correction_report(out, pairs, kept=F.col("quantity") >= 0)


QUERIES = {
    "fill_default": fill_default,
    "fill_statistic": fill_statistic,
    "fill_forward": fill_forward,
    "fill_lookup": fill_lookup,
    "drop_duplicates": drop_duplicates,
    "dedupe_by_key": dedupe_by_key,
    "collapse_near_duplicates": collapse_near_duplicates,
    "cast_types": cast_types,
    "parse_dates": parse_dates,
    "trim_collapse": trim_collapse,
    "standardize_canonical": lambda s, d: keyed(
        repair.standardize_canonical(dirty(s, d), "order_list", "Pharmax", SUPPLIER_VARIANTS), "order_list"
    ),
    "standardize_most_frequent": lambda s, d: keyed(repair.standardize_most_frequent(dirty(s, d), "order_list"), "order_list"),
    "standardize_most_recent": lambda s, d: keyed(
        repair.standardize_most_recent(dirty(s, d), "order_list", "sale_date"), "order_list"
    ),
    "standardize_title_case": lambda s, d: keyed(repair.standardize_title_case(dirty(s, d), "order_list"), "order_list"),
    "replace_mapping": lambda s, d: keyed(repair.replace_mapping(dirty(s, d), "dept_fullname", DEPT_MAP), "dept_fullname"),
    "canonical_category": canonical_category,
    "cap_outliers": lambda s, d: keyed(repair.cap_outliers(dirty(s, d), "amount"), F.round("amount", 6).alias("amount")),
    "remove_outliers": lambda s, d: keyed(repair.remove_outliers(dirty(s, d), "amount"), "amount"),
    "change_preview": change_preview,
    "correction_report": correction_report,
}

K = "event_id, epoch_us(sale_date) AS sale_us"
OTHERS = ", ".join(c for c in DIRTY_COLUMNS if c != "sale_date")
VARIANT_LIST = ", ".join(f"'{v}'" for v in SUPPLIER_VARIANTS)
CANON = f"CASE WHEN order_list IN ({VARIANT_LIST}) THEN 'Pharmax' ELSE order_list END"
SPELL = f"lower({COLLAPSED.format('order_list')})"
TRIMMED = COLLAPSED.format("product")

ORACLE = {
    "fill_default": with_dirty(
        f"SELECT {K}, coalesce(product, '') AS product, coalesce(order_list, '') AS order_list, "
        "coalesce(dept_fullname, '') AS dept_fullname, coalesce(quantity, 0) AS quantity, coalesce(amount, 0) AS amount FROM dirty"
    ),
    "fill_statistic": with_dirty(
        f"SELECT {K}, round(coalesce(a, (SELECT median(a) FROM gappy)), 6) AS amount, "
        "coalesce(order_list, (SELECT order_list FROM gappy WHERE order_list IS NOT NULL GROUP BY 1 "
        "ORDER BY count(*) DESC, 1 LIMIT 1)) AS order_list, "
        "round(coalesce(CAST(q AS DOUBLE), (SELECT avg(q) FROM gappy)), 6) AS quantity FROM gappy",
        "gappy AS (SELECT *, CASE WHEN amount_text <> 'N/A' THEN amount END AS a, "
        "CASE WHEN quantity >= 0 THEN quantity END AS q FROM dirty)",
    ),
    "fill_forward": with_dirty(
        f"SELECT {K}, user_id, last_value(product IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY sale_date, event_id "
        "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS product FROM dirty"
    ),
    "fill_lookup": with_dirty(
        f"SELECT {K}, CASE WHEN {MISSING} THEN coalesce(value, product) ELSE product END AS product "
        "FROM dirty LEFT JOIN best ON user_id = key",
        f"counts AS (SELECT user_id AS key, product AS value, count(*) AS n FROM dirty WHERE NOT {MISSING} "
        "AND user_id IS NOT NULL GROUP BY 1, 2),\n"
        "best AS (SELECT key, value FROM counts QUALIFY row_number() OVER (PARTITION BY key ORDER BY n DESC, value) = 1)",
    ),
    "drop_duplicates": with_dirty(f"SELECT {K}, product, amount FROM (SELECT DISTINCT * FROM dirty)"),
    "dedupe_by_key": with_dirty(
        f"SELECT {K}, user_id, event_type FROM dirty QUALIFY row_number() OVER (PARTITION BY user_id, event_type "
        "ORDER BY sale_date DESC, event_id DESC) = 1"
    ),
    "collapse_near_duplicates": with_dirty(
        "SELECT event_id, min(epoch_us(sale_date)) AS sale_us, product, CAST(quantity * count(*) AS BIGINT) AS quantity "
        f"FROM chained GROUP BY {OTHERS}, chain",
        f"stepped AS (SELECT *, CASE WHEN epoch_us(sale_date) - epoch_us(lag(sale_date) OVER w) <= 1000000 THEN 0 ELSE 1 END "
        f"AS start FROM dirty WINDOW w AS (PARTITION BY {OTHERS} ORDER BY sale_date)),\n"
        f"chained AS (SELECT *, sum(start) OVER (PARTITION BY {OTHERS} ORDER BY sale_date ROWS UNBOUNDED PRECEDING) AS chain "
        "FROM stepped)",
    ),
    "cast_types": with_dirty(
        f"SELECT {K}, TRY_CAST(amount_text AS DOUBLE) AS amount_text, "
        "CAST(TRY_CAST(date_text AS DATE) AS VARCHAR) AS date_text FROM dirty"
    ),
    "parse_dates": with_dirty(f"SELECT {K}, epoch_us(try_strptime(date_text, '%Y-%m-%d')) AS parsed_us FROM dirty"),
    "trim_collapse": f"SELECT doc_id, md5(t) AS digest, CAST(length(t) AS INTEGER) AS chars FROM "
    f"(SELECT doc_id, {COLLAPSED.format('text')} AS t FROM documents)",
    "standardize_canonical": with_dirty(f"SELECT {K}, {CANON} AS order_list FROM dirty"),
    "standardize_most_frequent": with_dirty(
        f"SELECT {K}, coalesce(best, order_list) AS order_list FROM dirty LEFT JOIN top ON {SPELL} = spelling",
        f"counts AS (SELECT {SPELL} AS spelling, order_list AS v, count(*) AS n FROM dirty WHERE order_list IS NOT NULL GROUP BY 1, 2),\n"
        "top AS (SELECT spelling, v AS best FROM counts QUALIFY row_number() OVER (PARTITION BY spelling ORDER BY n DESC, v) = 1)",
    ),
    "standardize_most_recent": with_dirty(
        f"SELECT {K}, coalesce(best, order_list) AS order_list FROM dirty LEFT JOIN top ON {SPELL} = spelling",
        f"top AS (SELECT {SPELL} AS spelling, order_list AS best FROM dirty WHERE order_list IS NOT NULL "
        f"QUALIFY row_number() OVER (PARTITION BY {SPELL} ORDER BY sale_date DESC, order_list DESC) = 1)",
    ),
    "standardize_title_case": with_dirty(
        f"SELECT {K}, CASE order_list WHEN 'Pharmax Ltd' THEN 'Pharmax Ltd' WHEN ' Pharmax ' THEN ' Pharmax ' "
        "ELSE upper(left(order_list, 1)) || lower(substring(order_list, 2)) END AS order_list FROM dirty"
    ),
    "replace_mapping": with_dirty(
        f"SELECT {K}, CASE WHEN dept_fullname IN ('OTC', 'OTC:Cold&Flu') THEN 'OTC:General' ELSE dept_fullname END "
        "AS dept_fullname FROM dirty"
    ),
    "canonical_category": "WITH counts AS (SELECT p_name, p_brand, count(*) AS n FROM part GROUP BY 1, 2), "
    "top AS (SELECT p_name, p_brand AS best FROM counts QUALIFY row_number() OVER (PARTITION BY p_name ORDER BY n DESC, p_brand) = 1) "
    "SELECT p_partkey, p_name, best AS p_brand FROM part JOIN top USING (p_name)",
    "cap_outliers": with_dirty(
        f"SELECT {K}, round(CASE WHEN amount < lo THEN lo WHEN amount > hi THEN hi ELSE amount END, 6) AS amount FROM dirty, fences",
        FENCES.format("amount"),
    ),
    "remove_outliers": with_dirty(
        f"SELECT {K}, amount FROM dirty, fences WHERE NOT coalesce(amount < lo OR amount > hi, false)", FENCES.format("amount")
    ),
    "change_preview": with_dirty(
        'SELECT order_list AS "before", after, count(*) AS rows FROM (SELECT order_list, '
        f"CASE WHEN c IN ({VARIANT_LIST}) THEN 'Pharmax' ELSE c END AS after FROM "
        f"(SELECT order_list, {COLLAPSED.format('order_list')} AS c FROM dirty)) WHERE order_list IS DISTINCT FROM after GROUP BY 1, 2"
    ),
    "correction_report": with_dirty(
        " UNION ALL ".join(
            f"SELECT '{c}' AS \"column\", (SELECT count(*) FROM dirty) AS rows_before, count(*) AS rows_after, "
            f"count(*) FILTER ({c} IS DISTINCT FROM {new}) AS changes FROM dirty, fences WHERE quantity >= 0"
            for c, new in {
                "product": TRIMMED,
                "order_list": CANON,
                "amount": "CASE WHEN amount < lo THEN lo WHEN amount > hi THEN hi ELSE amount END",
                "dept_fullname": "coalesce(dept_fullname, '')",
            }.items()
        ),
        FENCES.format("amount"),
    ),
}
