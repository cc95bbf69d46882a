"""Detectors of spelling variants and rare values."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from math import floor

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.columns import column, is_absent
from ..functions.components import connected_components
from ..functions.staging import stage
from ..functions.text import collapse_blanks, spelling_key, strip

# Names under which a supplier column may appear; the first present wins.
SUPPLIER_COLUMNS = (
    "OrderList",
    "Supplier",
    "Supplier Name",
    "Supplier_Name",
    "Manufacturer",
    "Manufacturer Name",
)
# Candidates of one gram are spread over cells of about this many values per side.
CELL = 5_000
# Rounds in which the texts of a gram are compared with one of them.
LEADERS = 2


def first_present(df: DataFrame, candidates: Sequence[str] = SUPPLIER_COLUMNS) -> str | None:
    return next((c for c in candidates if c in df.columns), None)


def is_supplier_variation(text: Column, stem: str, accepted: Sequence[str] | None = None) -> Column:
    """Stripped value starts with the stem in any case but is not an accepted spelling."""
    spellings = list(accepted) if accepted is not None else [stem, stem.lower()]
    value = strip(text)
    return F.coalesce(F.startswith(F.lower(value), F.lit(stem.lower())) & ~value.isin(*spellings), F.lit(False))


def supplier_variations(df: DataFrame, name: str, stem: str, accepted: Sequence[str] | None = None) -> DataFrame:
    """(variant, rows): deviating spellings of a supplier name."""
    hits = df.where(is_supplier_variation(column(name), stem, accepted))
    return hits.groupBy(strip(column(name)).alias("variant")).agg(F.count(F.lit(1)).alias("rows"))


def supplier_family(df: DataFrame, name: str, stem: str) -> DataFrame:
    """(value, rows): spellings, blanks collapsed, that start with the stem in any case."""
    value = collapse_blanks(column(name))
    family = df.where(F.startswith(F.lower(value), F.lit(stem.lower())))
    return family.groupBy(value.alias("value")).agg(F.count(F.lit(1)).alias("rows"))


def supplier_family_stats(df: DataFrame, name: str, stem: str) -> DataFrame:
    """One row: rows of the family, rows spelled exactly as the stem, and the rest."""
    counts = supplier_family(df, name, stem)
    total = F.coalesce(F.sum("rows"), F.lit(0))
    canonical = F.coalesce(F.sum(F.when(F.col("value") == stem, F.col("rows"))), F.lit(0))
    return counts.agg(
        total.alias("family_total"), canonical.alias("canonical"), (total - canonical).alias("variations")
    )


def value_frequencies(df: DataFrame, name: str) -> DataFrame:
    counted = df.where(~is_absent(df, name)).groupBy(column(name).alias("value"))
    return counted.agg(F.count(F.lit(1)).alias("rows"))


def rare_values(df: DataFrame, name: str) -> DataFrame:
    """(value, rows): values whose frequency is strictly under the median frequency.

    The median is taken over a count per frequency.  Frequencies add up to the number of rows, so
    N rows have fewer than sqrt(2N) different ones and the aggregate stays small.
    """
    counts = value_frequencies(df, name)
    histogram = counts.groupBy("rows").agg(F.count(F.lit(1)).alias("values"))
    median = histogram.agg(F.percentile("rows", F.lit(0.5), F.col("values")))
    return counts.where(F.col("rows") < median.scalar())


def rows_with_rare_values(df: DataFrame, name: str) -> DataFrame:
    rare = stage(rare_values(df, name), "rare").select(F.col("value").alias("__value"))
    return df.join(rare, column(name) == F.col("__value"), "left_semi")


def rare_category(df: DataFrame, name: str, at_most: int = 1) -> DataFrame:
    """(value, rows): categories that occur at most ``at_most`` times."""
    return value_frequencies(df, name).where(F.col("rows") <= at_most)


def case_space_variants(df: DataFrame, name: str) -> DataFrame:
    """(spelling_key, value, rows, spellings, group_rows): groups with several raw spellings.

    Long form: a group is never gathered into one row.  Both levels aggregate counts only.
    """
    counts = value_frequencies(df, name).withColumn("spelling_key", spelling_key(F.col("value").cast("string")))
    totals = counts.groupBy("spelling_key").agg(
        F.count("value").alias("spellings"), F.sum("rows").alias("group_rows")
    )
    return counts.join(totals.where("spellings > 1"), "spelling_key")


def allowed_edits(length: Column, threshold: float) -> Column:
    """Most edits at which two texts, the longer of this length, are still above the threshold."""
    return F.greatest(F.lit(0), F.ceil((1 - threshold) * length + F.lit(1e-9)) - 1).cast("int")


def gram_size(threshold: float) -> int:
    """The longest grams of which two similar texts always share one (each edit destroys as many as a gram is long)."""
    return max(1, min(3, floor(1 / (1 - threshold) / 2 + 1e-9))) if threshold < 1 else 3


def gram_index(values: DataFrame, threshold: float) -> DataFrame:
    """(gram, at, norm): an index of the rarest grams of each text, with their places.

    If two texts are within k edits, at most k x q grams of either are lost in the other, and the others move by k places
    at most.  So among the first k x q + 1 grams of both, in one order for all texts, there is a common one (prefix
    filter) at places no further apart than k (position filter).  The order is by frequency: a gram
    that many texts hold is indexed only for texts that have no rarer ones.
    """
    q = gram_size(threshold)
    length = F.length("norm")
    edits = allowed_edits(F.floor(length / threshold + F.lit(1e-9)), threshold)
    starts = F.sequence(F.lit(1), F.greatest(length - (q - 1), F.lit(1)))
    grams = F.transform(starts, lambda i: F.substring(F.col("norm"), i, F.lit(q)))
    each = values.where(edits > 0).select("norm", F.posexplode(grams).alias("at", "gram"))
    load = each.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    # as many entries as a text has grams
    ranked = each.join(load, "gram").groupBy("norm").agg(F.array_sort(F.collect_list(F.struct("n", "gram", "at"))).alias("grams"))
    chosen = ranked.select("norm", F.explode(F.slice("grams", F.lit(1), q * edits + 1)).alias("g"))
    return chosen.select("g.gram", "g.at", "norm")


def similarity(a: Column, b: Column) -> Column:
    """1 - edit distance / longer length."""
    return 1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b))


def similar(pairs: DataFrame, threshold: float) -> DataFrame:
    """(a, b): the distinct pairs that are more similar than the threshold, of (a, b, shift) with one gram's places."""
    longer = F.greatest(F.length("a"), F.length("b"))
    edits = allowed_edits(longer, threshold)
    near = (F.abs(F.length("a") - F.length("b")) <= edits) & (F.abs("shift") <= edits) & (F.col("a") != F.col("b"))
    ordered = pairs.where(near).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    checked = stage(ordered.distinct(), "candidates")
    # the distance is worked out only up to one edit more than allowed, and is -1 beyond
    distance = F.call_function("levenshtein", F.col("a"), F.col("b"), edits + 1)
    return checked.where((distance >= 0) & (1 - distance / longer > threshold))


def similar_links(values: DataFrame, threshold: float = 0.85) -> DataFrame:
    """(a, b): links between texts in column ``norm`` that join all texts that are more similar than the threshold.

    Exact up to links inside a group that is joined already.  All texts of a gram are first compared with one of them,
    its leader, then those not linked to it with a leader of their own, LEADERS times.  Where texts of several groups
    are left in a gram, the texts outside its largest one are compared with all texts of the gram in other groups.
    So a gram that many alike texts share costs as many comparisons as it has texts, not their square.
    """
    index = stage(gram_index(values, threshold), "grams")
    links, open_ = [], index
    for _ in range(LEADERS):
        leaders = open_.groupBy("gram").agg(F.min(F.struct("norm", "at")).alias("l"))
        leaders = leaders.select("gram", F.col("l.norm").alias("leader"), F.col("l.at").alias("its"))
        met = open_.join(leaders, "gram").where("norm <> leader")
        pairs = met.select(F.col("leader").alias("a"), F.col("norm").alias("b"), (F.col("at") - F.col("its")).alias("shift"))
        found = stage(similar(pairs, threshold), "links")
        links.append(found)
        # a leader is the smallest text of its gram, so links have it first
        linked = (F.col("leader") == F.col("a")) & (F.col("norm") == F.col("b"))
        open_ = stage(met.join(found, linked, "left_anti").select("gram", "at", "norm"), "open")
        if not open_.head(1):
            break
    groups = stage(connected_components(_all(links), "a", "b"), "groups")
    placed = index.join(groups, F.col("norm") == F.col("node"), "left")
    grouped = stage(placed.select("gram", "at", "norm", F.coalesce("component", "norm").alias("g")), "grouped")
    return _all([*links, similar(_across(grouped), threshold)])


def _all(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionAll, parts)


def _across(grouped: DataFrame) -> DataFrame:
    """(a, b, shift): texts of one gram in different groups; at least one of them outside the gram's largest group.

    A gram with many texts is spread over a grid of cells, so that no task compares more than one cell.
    """
    sizes = grouped.groupBy("gram", "g").agg(F.count(F.lit(1)).alias("n"))
    load = sizes.groupBy("gram").agg(F.max_by("g", F.struct("n", "g")).alias("major"), F.sum("n").alias("all"), F.max("n").alias("most"))
    blocks = lambda n: F.ceil(n / CELL).cast("int")
    load = load.where(F.col("all") > F.col("most")).select(
        "gram", "major", blocks(F.col("all") - F.col("most")).alias("rows"), blocks(F.col("all")).alias("cols")
    )
    placed = grouped.join(load, "gram")
    own = lambda n: F.pmod(F.xxhash64("norm"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = placed.where(F.col("g") != F.col("major")).select(
        "gram", F.col("norm").alias("a"), F.col("at").alias("i"), F.col("g").alias("ga"), own("rows").alias("x"), every("cols").alias("y")
    )
    right = placed.select(
        "gram", F.col("norm").alias("b"), F.col("at").alias("j"), F.col("g").alias("gb"), own("cols").alias("y"), every("rows").alias("x")
    )
    met = left.join(right, ["gram", "x", "y"]).where(F.col("ga") != F.col("gb"))
    return met.select("a", "b", (F.col("i") - F.col("j")).alias("shift"))


def fuzzy_categories(df: DataFrame, name: str, threshold: float = 0.85) -> DataFrame:
    """(group, value, rows, variants, group_rows): similar spellings, compared in lower case.

    Similarity is 1 - edit distance / longer length, not the matching-blocks ratio.  Groups are the connected
    components of the similar pairs, so they do not depend on row order; ``group`` is the smallest member.
    """
    counts = stage(value_frequencies(df, name).withColumn("norm", F.lower(F.col("value"))), "values")
    links = similar_links(counts.select("norm").distinct(), threshold)
    groups = connected_components(links, "a", "b")
    grouped = counts.join(groups, F.col("norm") == F.col("node"), "left").select(
        F.coalesce("component", "norm").alias("group"), "value", "rows"
    )
    totals = grouped.groupBy("group").agg(F.count("value").alias("variants"), F.sum("rows").alias("group_rows"))
    return grouped.join(totals.where("variants > 1"), "group")
