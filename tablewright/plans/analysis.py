"""Whole analyses: all detectors on a table, and the decisions that follow."""

from __future__ import annotations

import logging
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.columns import column, floor_to, groupable, is_text, micros, quoted
from ..functions.groups import first_per_group, stage_shared
from ..functions.issues import (
    DETAIL_SCHEMA,
    ISSUE_SCHEMA,
    duplicate_severity,
    investigation,
    issue_id,
    issue_row,
    ratio_of,
    severity_from_ratio,
)
from ..functions.missing import is_missing
from ..functions.scan import positions
from ..functions.staging import stage
from ..operators import drift, duplicates, variants
from ..functions.text import collapse_blanks, has_stray_blanks

log = logging.getLogger(__name__)

SECOND = 1_000_000
# The order in which issues are listed.
ORDER = ("missing_values", "duplicates", "whitespace", "supplier_variations", "category_drift", "near_duplicates")
# Wording of the issues.  {column}, {stem} and {date} come from the roles.
DESCRIPTIONS = {
    "missing_values": "'{column}' column contains %d missing or blank values (%.1f%% of rows).",
    "duplicates": "Detected %d exact duplicate rows. Keep the first instance and remove the rest.",
    "whitespace": "%d product names contain stray whitespace or duplicated spaces.",
    "supplier_variations": "Detected %d rows where supplier names deviate from '{stem}' (examples: %s).",
    "category_drift": "Product '%s' appears under multiple departments: %s. Business confirmation is required.",
    "near_duplicates": "Detected %d near-duplicate row pairs (differences only within ±1 second on '{date}').",
}
# The suggested actions and the pattern of near duplicates.
ACTIONS = {
    "missing_values": "Fill missing product names using the barcode dictionary or manual review.",
    "duplicates": "Deduplicate rows based on full row equality to eliminate repeated sales.",
    "whitespace": "Trim whitespace and collapse multiple spaces in the '{column}' field.",
    "supplier_variations": "Confirm whether all variations should be standardized to '{stem}'.",
    "category_drift": "Select a canonical department for the product and reclassify inconsistent rows.",
    "near_duplicates": "Consolidate near-duplicates by keeping the earliest event or merging metrics.",
}
NEAR_PATTERN = "Occurrences clustered within one-second windows on {date}."
SLUGS = {
    "missing_values": "missing_product",
    "duplicates": "exact_duplicates",
    "whitespace": "product_whitespace",
    "supplier_variations": "supplier_variations",
    "category_drift": "category_drift_",
    "near_duplicates": "near_duplicates",
}
# Spellings named in the sentence of a supplier issue.
NAMED_SPELLINGS = 5
# Values named in an issue; ``issue_details`` has all of them, one a row.
NAMED = 50
# Pairs of a value and what the repair makes of it, in the evidence of an issue.
EXAMPLES = 3


@dataclass(frozen=True)
class Roles:
    """Which columns of a table the detectors look at.  The defaults are those of a sales table."""

    key: str
    product: str = "Product"
    supplier: str = "OrderList"
    category: str = "Dept Fullname"
    date: str = "Sale Date"
    supplier_stem: str = "Pharmax"
    lookup: str | None = None  # column that determines the product, such as a barcode


def _has(df: DataFrame, *names: str) -> bool:
    return all(n in df.columns for n in names)


def _worded(texts: dict[str, str], issue_type: str, roles: Roles) -> str:
    names = {"column": roles.product, "stem": roles.supplier_stem, "date": roles.date}
    # a percent sign in a name is not a placeholder of the format
    escape = (lambda v: v.replace("%", "%%")) if texts is DESCRIPTIONS else str
    return texts[issue_type].format(**{k: escape(v) for k, v in names.items()})


def _empty(df: DataFrame) -> DataFrame:
    return df.sparkSession.createDataFrame([], ISSUE_SCHEMA)


def _first_rows(hits: DataFrame, key: str, n: int, **values: Column) -> DataFrame:
    """One row: the first n rows in key order as an array ``rows`` of (id, values...); at most n are gathered."""
    rows = hits.select(column(key).alias("id"), *[v.alias(k) for k, v in values.items()]).orderBy("id", *values).limit(n)
    return rows.agg(F.array_sort(F.collect_list(F.struct("id", *values))).alias("rows"))


def _told(found: DataFrame, **parts: Column) -> Column:
    """What is to be told of a one-row table, as the fields of one scalar; it is looked up once."""
    return found.select(F.struct(*[p.alias(k) for k, p in parts.items()])).scalar()


def _ids(rows: str = "rows") -> Column:
    return F.array_join(F.transform(rows, lambda r: r["id"].cast("string")), ", ")


def _listed(values: Column, count: Column) -> Column:
    """Values as text; where there are more than are named, with their number."""
    more = F.when(count > F.size(values), F.format_string(", … (%d in all)", count)).otherwise("")
    return F.concat(F.array_join(values, ", "), more)


def _filled(value: Column, roles: Roles) -> Column:
    if roles.lookup:
        return F.lit(f"most frequent {roles.product} of its {roles.lookup}")
    return F.lit("")


# What the repair of an issue makes of a value, for the examples of its evidence.
REPAIRED: dict[str, Callable[[Column, Roles], Column]] = {
    "missing_values": _filled,
    "whitespace": lambda value, roles: collapse_blanks(value),
    "supplier_variations": lambda value, roles: F.lit(roles.supplier_stem),
}


def _evidence(issue_type: str, values: Column, roles: Roles) -> Column:
    """The first EXAMPLES values, as they are and as the repair of the issue would make them."""
    fix = REPAIRED[issue_type]
    pair = lambda v: F.struct(v.cast("string").alias("current"), fix(v.cast("string"), roles).alias("fixed"))
    return F.transform(F.slice(values, 1, EXAMPLES), pair)


def _missing_entry(df: DataFrame, roles: Roles, hit: Column, n: Column, ratio: Column) -> dict:
    values = F.transform("rows", lambda r: r["value"])
    first = _first_rows(df.where(hit), roles.key, 5, value=column(roles.product))
    told = _told(first, ids=_ids(), evidence=_evidence("missing_values", values, roles))
    return {
        "name": F.lit(SLUGS["missing_values"]),
        "severity": severity_from_ratio(ratio),
        "description": F.format_string(_worded(DESCRIPTIONS, "missing_values", roles), n, ratio * 100.0),
        "affected_columns": [roles.product],
        "suggested_action": _worded(ACTIONS, "missing_values", roles),
        "category": "quick_fixes",
        "investigation_": investigation(
            f"{roles.product} is null, blank or a null token",
            {"missing_rows": n, "sample_row_indices": told["ids"]},
            told["evidence"],
        ),
    }


def _blanks_entry(df: DataFrame, roles: Roles, hit: Column, n: Column, ratio: Column) -> dict:
    values = F.transform("rows", lambda r: r["value"])
    shown = F.transform("rows", lambda r: F.concat(r["id"].cast("string"), F.lit(": '"), r["value"], F.lit("'")))
    first = _first_rows(df.where(hit), roles.key, 5, value=column(roles.product))
    told = _told(first, examples=F.array_join(shown, ", "), evidence=_evidence("whitespace", values, roles))
    return {
        "name": F.lit(SLUGS["whitespace"]),
        "severity": severity_from_ratio(ratio),
        "description": F.format_string(_worded(DESCRIPTIONS, "whitespace", roles), n),
        "affected_columns": [roles.product],
        "suggested_action": _worded(ACTIONS, "whitespace", roles),
        "category": "quick_fixes",
        "investigation_": investigation(
            f"{roles.product} differs from its words joined by one space",
            {"issue_count": n, "examples": told["examples"]},
            told["evidence"],
        ),
    }


def _supplier_entry(df: DataFrame, roles: Roles, hit: Column, n: Column, ratio: Column) -> dict:
    stem = roles.supplier_stem
    spelled = variants.supplier_variations(df, roles.supplier, stem).select("variant")
    listed = spelled.orderBy("variant").limit(NAMED).agg(F.array_sort(F.collect_list("variant")).alias("listed"))
    told = _told(
        listed,
        listed=F.col("listed"),
        first=F.array_join(F.slice("listed", 1, NAMED_SPELLINGS), ", "),
        evidence=_evidence("supplier_variations", F.col("listed"), roles),
    )
    return {
        "name": F.lit(SLUGS["supplier_variations"]),
        "severity": F.lit("medium"),
        "description": F.format_string(_worded(DESCRIPTIONS, "supplier_variations", roles), n, told["first"]),
        "affected_columns": [roles.supplier],
        "suggested_action": _worded(ACTIONS, "supplier_variations", roles),
        "category": "smart_fixes",
        "investigation_": investigation(
            f"{roles.supplier} starts with {stem} in any case and is not that spelling",
            {"variation_count": n, "examples": _listed(told["listed"], spelled.agg(F.count(F.lit(1))).scalar())},
            told["evidence"],
        ),
    }


# Issues that are a count over single rows: the column they need, the test, the issue.
ROW_CHECKS = {
    "missing_values": ("product", lambda df, r: is_missing(df, r.product), _missing_entry),
    "whitespace": ("product", lambda df, r: has_stray_blanks(column(r.product)), _blanks_entry),
    "supplier_variations": (
        "supplier",
        lambda df, r: variants.is_supplier_variation(column(r.supplier), r.supplier_stem),
        _supplier_entry,
    ),
}


def row_issues(df: DataFrame, dataset_id: str, roles: Roles, checks: Sequence[str] = tuple(ROW_CHECKS)) -> DataFrame:
    """Missing values, stray blanks and supplier spellings, with ``position``.

    All counts come from one aggregate over the table; only the examples are separate reads.
    """
    rows, hits, entries = F.col("rows"), [], []
    for issue_type, (role, test, entry) in ((c, ROW_CHECKS[c]) for c in checks):
        name = getattr(roles, role)
        if not _has(df, name) or (issue_type == "whitespace" and not is_text(df, name)):
            continue
        try:
            hit, n = test(df, roles), F.col(issue_type)
            made = entry(df, roles, hit, n, ratio_of(n, rows))
            columns = issue_row(F.lit(dataset_id), type_=issue_type, affected_rows=n, **made)
            df.select(hit)  # fails here when it cannot be analysed
        except Exception:
            log.exception("detector %s failed", issue_type)
            continue
        hits.append(F.count_if(hit).alias(issue_type))
        entries.append(F.struct(*columns, F.lit(ORDER.index(issue_type)).alias("position")))
    if not entries:
        return _empty(df).withColumn("position", F.lit(0))
    facts = df.agg(F.count(F.lit(1)).alias("rows"), *hits)
    return facts.select(F.inline(F.array(*entries))).where("affectedRows > 0")


def _moment(df: DataFrame, roles: Roles) -> Column | None:
    """The date as a timestamp; None when it is absent or a text that does not parse throughout."""
    if not _has(df, roles.date):
        return None
    if not is_text(df, roles.date):
        return column(roles.date)
    parsed = F.try_to_timestamp(column(roles.date))
    broken = df.where(column(roles.date).isNotNull() & parsed.isNull())
    return None if broken.limit(1).count() else parsed


def copy_candidates(df: DataFrame, roles: Roles, moment: Column | None) -> DataFrame:
    """Rows that may equal another, or may do so but for a second of time.

    Both duplicate detectors work on these; equal rows always share a time slot as well.
    """
    if moment is None:
        return stage_shared(df, [F.xxhash64(*[groupable(df, c) for c in df.columns])])
    others = [groupable(df, c) for c in df.columns if c != roles.date]
    bucket = floor_to(micros(moment), SECOND)
    return stage_shared(df, [F.xxhash64(*others, bucket), F.xxhash64(*others, bucket + 1)])


def duplicate_issues(df: DataFrame, dataset_id: str, roles: Roles, candidates: DataFrame | None = None) -> DataFrame:
    if candidates is None:
        groups = duplicates.duplicate_rows(df)
    else:
        groups = duplicates.duplicate_rows(candidates, prune=False)
    facts = groups.agg(F.coalesce(F.sum("copies"), F.lit(0)).alias("n"))
    total = df.agg(F.count(F.lit(1))).scalar()
    n = F.col("n")
    copies = lambda r: F.format_string("%d copies of %s", r["copies"], r["id"].cast("string"))
    pair = lambda r: F.struct(copies(r).alias("current"), F.format_string("1 row of %s", r["id"].cast("string")).alias("fixed"))
    first = _first_rows(groups, roles.key, 10, copies=F.col("copies"))
    told = _told(first, ids=_ids(), evidence=F.transform(F.slice("rows", 1, EXAMPLES), pair))
    return facts.where(n > 0).select(
        *issue_row(
            F.lit(dataset_id),
            F.lit(SLUGS["duplicates"]),
            "duplicates",
            duplicate_severity(ratio_of(n, total)),
            F.format_string(_worded(DESCRIPTIONS, "duplicates", roles), n),
            list(df.columns),
            _worded(ACTIONS, "duplicates", roles),
            "quick_fixes",
            n,
            investigation(
                "rows equal in all columns",
                {"duplicate_rows": n, "example_indices": told["ids"]},
                told["evidence"],
            ),
        )
    )


def drift_issues(df: DataFrame, dataset_id: str, roles: Roles) -> DataFrame:
    """One issue per drifting entity; its text names its categories in order, NAMED at most."""
    if not _has(df, roles.product, roles.category):
        return _empty(df)
    pairs = drift.category_drift(df, roles.product, roles.category)
    pairs = pairs.withColumn("category", F.col("category").cast("string"))
    # the most frequent category of an entity, the smallest on a tie, as the repair chooses it
    canonical = pairs.groupBy("entity").agg(F.min_by("category", F.struct(-F.col("rows"), "category")).alias("canonical"))
    first = first_per_group(pairs, ["entity"], [F.col("category")], NAMED)
    per_entity = first.groupBy("entity").agg(
        F.max("affected_rows").alias("affected_rows"),
        F.max("categories").alias("categories"),
        F.array_sort(F.collect_list("category")).alias("named"),  # at most NAMED
    )
    names = _listed(F.col("named"), F.col("categories"))
    others = F.slice(F.filter("named", lambda c: c != F.col("canonical")), 1, EXAMPLES)
    pair = lambda c: F.struct(c.alias("current"), F.col("canonical").alias("fixed"))
    entity = F.col("entity").cast("string")
    return per_entity.join(canonical, "entity").select(
        *issue_row(
            F.lit(dataset_id),
            F.concat(F.lit(SLUGS["category_drift"]), entity),
            "category_drift",
            F.lit("medium"),
            F.format_string(_worded(DESCRIPTIONS, "category_drift", roles), entity, names),
            [roles.category],
            _worded(ACTIONS, "category_drift", roles),
            "smart_fixes",
            F.col("affected_rows"),
            investigation(
                f"distinct {roles.category} per {roles.product}",
                {"product": entity, "departments": names},
                F.transform(others, pair),
            ),
        )
    )


def issue_details(df: DataFrame, dataset_id: str, roles: Roles) -> DataFrame:
    """(dataset_id, issue_id, position, value, rows): every value an issue is about, one a row, in order.

    Categories of drifting entities, deviating supplier spellings, and values with stray blanks.  Nothing is
    gathered per issue, however many values it has.
    """
    parts = []
    name = lambda slug: F.lit(SLUGS[slug])
    if _has(df, roles.product, roles.category):
        pairs = drift.category_drift(df, roles.product, roles.category)
        own = F.concat(name("category_drift"), F.col("entity").cast("string"))
        parts.append(pairs.select(own.alias("name"), F.col("category").cast("string").alias("value"), "rows"))
    if _has(df, roles.supplier):
        spelled = variants.supplier_variations(df, roles.supplier, roles.supplier_stem)
        parts.append(spelled.select(name("supplier_variations").alias("name"), F.col("variant").alias("value"), "rows"))
    if _has(df, roles.product) and is_text(df, roles.product):
        stray = df.where(has_stray_blanks(column(roles.product))).groupBy(column(roles.product).alias("value"))
        counted = stray.agg(F.count(F.lit(1)).alias("rows"))
        parts.append(counted.select(name("whitespace").alias("name"), "value", "rows"))
    if not parts:
        return df.sparkSession.createDataFrame([], DETAIL_SCHEMA)
    every = reduce(DataFrame.unionByName, parts)
    every = every.select(issue_id(F.lit(dataset_id), F.col("name")).alias("issue_id"), "value", "rows")
    placed = positions(every, ["issue_id"], ["value"], "position")
    return placed.select(F.lit(dataset_id).alias("dataset_id"), "issue_id", "position", "value", "rows")


def near_duplicate_issues(
    df: DataFrame, dataset_id: str, roles: Roles, moment: Column | None = None, candidates: DataFrame | None = None
) -> DataFrame:
    """A text date counts only when all of it parses; otherwise nothing is reported."""
    moment = _moment(df, roles) if moment is None else moment
    if moment is None:
        return _empty(df)
    work = (df if candidates is None else candidates).withColumn(roles.date, moment)
    buckets = duplicates.near_duplicate_buckets(work, roles.date, 1.0, key=roles.key)
    # the buckets are read twice, for the counts and for the examples
    found = stage(buckets.where(duplicates.involved()).drop("g0", "g1", "bucket"), "near")
    facts = duplicates.summarise_near(found)
    # two consecutive moments of a bucket that holds or ends a pair
    second = F.when(F.col("linked_before"), F.col("first_us")).otherwise(F.col("last_us"))
    paired = found.where("rows > 1 OR linked_before").select(
        F.col("example").alias(roles.key), F.coalesce("previous_us", "first_us").alias("first"), second.alias("second")
    )
    moment_of = lambda us: F.timestamp_micros(us).cast("string")
    both = lambda r: F.concat_ws(", ", moment_of(r["first"]), moment_of(r["second"]))
    shown = F.transform("rows", lambda r: F.concat(r["id"].cast("string"), F.lit(": "), both(r)))
    pair = lambda r: F.struct(both(r).alias("current"), moment_of(r["first"]).alias("fixed"))
    rows = _first_rows(paired, roles.key, 5, first=F.col("first"), second=F.col("second"))
    told = _told(
        rows, ids=_ids(), pairs=F.array_join(shown, "; "), evidence=F.transform(F.slice("rows", 1, EXAMPLES), pair)
    )
    others = [c for c in df.columns if c != roles.date]
    return facts.where("pairs > 0").select(
        *issue_row(
            F.lit(dataset_id),
            F.lit(SLUGS["near_duplicates"]),
            "near_duplicates",
            F.lit("medium"),
            F.format_string(_worded(DESCRIPTIONS, "near_duplicates", roles), F.col("pairs")),
            [*others, roles.date],
            _worded(ACTIONS, "near_duplicates", roles),
            "quick_fixes",
            F.col("rows_involved"),
            investigation(
                f"rows equal but for {roles.date}, consecutive within one second",
                {"pair_count": F.col("pairs"), "example_rows": told["ids"], "example_pairs": told["pairs"]},
                told["evidence"],
            ),
            NEAR_PATTERN.format(date=roles.date),
        )
    )


def run_all_detectors(df: DataFrame, dataset_id: str, roles: Roles, isolate: bool = True) -> DataFrame:
    """Issues of all six detectors, in a fixed order (column ``position``).

    A detector whose columns are absent finds nothing.  One that cannot be planned is logged and
    left out.  With ``isolate`` each detector's issues are also written before they are united, so
    that one failing while it runs does not take the others with it.
    """
    parts: list[DataFrame] = []

    def attempt(name: str, build: Callable[[], DataFrame]) -> bool:
        try:
            part = build()
            if "position" not in part.columns:
                part = part.withColumn("position", F.lit(ORDER.index(name)))
            parts.append(stage(part, "issues") if isolate else part)
            return True
        except Exception:
            log.exception("detector %s failed", name)
            return False

    moment = shared = None
    try:
        moment = _moment(df, roles)
        shared = copy_candidates(df, roles, moment)
    except Exception:
        log.exception("no shared candidates: the duplicate detectors look for their own")
    if not attempt("rows", lambda: row_issues(df, dataset_id, roles)):
        # one of the checks that share a scan fails while it runs: each by itself
        for check in ROW_CHECKS:
            attempt(check, lambda: row_issues(df, dataset_id, roles, [check]))
    attempt("duplicates", lambda: duplicate_issues(df, dataset_id, roles, shared))
    attempt("near_duplicates", lambda: near_duplicate_issues(df, dataset_id, roles, moment, shared))
    attempt("category_drift", lambda: drift_issues(df, dataset_id, roles))
    if not parts:
        return _empty(df).withColumn("position", F.lit(0))
    return reduce(DataFrame.unionByName, parts)


def without_position(issues: DataFrame) -> DataFrame:
    return issues.select(*[quoted(f.name) for f in ISSUE_SCHEMA])
