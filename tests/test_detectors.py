from __future__ import annotations

import random
from datetime import datetime

import pytest
from conftest import rows_of
from pyspark.sql import functions as F

from tablewright.functions import text
from tablewright.functions.components import connected_components
from tablewright.functions.missing import is_missing
from tablewright.operators import drift, evidence, formats, missing, outliers, rules, variants, whitespace

BLANKS = [" ", "\t", "\n", " ", " ", "　", "\x1c", "\x1f", "\x85", "\r\n", "  ", " \t "]
WORDS = ["a", "b c", "é", ""]


def blank_texts():
    out = [None, "", "plain", "two words"]
    for b in BLANKS:
        out += [b, b + "x", "x" + b, "x" + b + "y", b + "x" + b + "y" + b, "line\n" + b]
    return out


def test_blank_rules_match_python(spark):
    texts = blank_texts()
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    t = F.col("t")
    got = df.select(
        "i",
        text.collapse_blanks(t),
        text.strip(t),
        text.has_stray_blanks(t),
        text.has_edge_blanks(t),
        whitespace.has_edge_or_double_blanks(t),
    ).collect()
    for i, collapsed, stripped, stray, edge, double in got:
        s = texts[i]
        if s is None:
            assert (collapsed, stripped, stray, edge, double) == (None, None, False, False, False)
            continue
        assert collapsed == " ".join(s.split()), repr(s)
        assert stripped == s.strip(), repr(s)
        assert stray == (s != " ".join(s.split())), repr(s)
        assert edge == (s != s.strip()), repr(s)
        assert double == (s != s.strip() or "  " in s), repr(s)


def test_whitespace_kinds(spark):
    data = [(" a",), ("a ",), ("a  b",), ("a b",), (None,), ("  ",)]
    out = whitespace.whitespace_kinds(spark.createDataFrame(data, "t string"), "t")
    assert rows_of(out) == [
        ("  ", True, True, False),
        (" a", True, False, False),
        ("a ", False, True, False),
        ("a  b", False, False, True),
    ]


def test_missing_tokens(spark):
    data = [(None,), ("",), (" NULL ",), ("null",), ("Null",), ("x",), (" ",)]
    df = spark.createDataFrame(data, "t string")
    assert df.where(is_missing(df, "t")).count() == 5
    assert df.where(is_missing(df, "t", ["x"])).count() == 2
    numbers = spark.createDataFrame([(1.0,), (None,), (float("nan"),)], "x double")
    assert missing.missing_values(numbers, "x").count() == 2
    assert missing.missing_values_any(numbers, ["x"]).count() == 2


def test_hit_summary_without_hits_and_rows(spark):
    df = spark.range(10)
    got = evidence.hit_summary(df, F.col("id") > 99, "id").first()
    assert (got["rows"], got["affected_rows"], got["ratio"], got["example_ids"]) == (10, 0, 0.0, [])
    none = evidence.hit_summary(df.where("id < 0"), F.col("id") > 0, "id").first()
    assert (none["rows"], none["affected_rows"], none["ratio"]) == (0, 0, 0.0)


def test_supplier_rules_differ(spark):
    data = [("Pharmax",), ("pharmax",), ("PHARMAX",), (" Pharmax  Ltd ",), ("Medico",), (None,), ("",)]
    df = spark.createDataFrame(data, "s string")
    assert rows_of(variants.supplier_variations(df, "s", "Pharmax")) == [("PHARMAX", 1), ("Pharmax  Ltd", 1)]
    assert variants.supplier_family_stats(df, "s", "Pharmax").first()[:] == (4, 1, 3)
    assert variants.supplier_family_stats(df.where("s = 'Medico'"), "s", "Pharmax").first()[:] == (0, 0, 0)
    assert variants.first_present(df.withColumnRenamed("s", "Manufacturer")) == "Manufacturer"
    assert variants.first_present(df) is None


def test_drift(spark):
    data = [("p", "A", 1), ("p", "B", 2), ("p", None, 3), ("q", "A", 1), ("q", None, 2), (None, "A", 1), (None, "B", 1)]
    df = spark.createDataFrame(data, "p string, c string, day int")
    assert rows_of(drift.category_drift(df, "p", "c")) == [("p", "A", 1, 2, 3), ("p", "B", 1, 2, 3)]
    assert rows_of(drift.drifting_entities(df, "p", "c")) == [("p", 2, 3)]
    timed = drift.category_drift_timing(df, "p", "c", "day")
    assert rows_of(timed, "category", "first", "last", "entity_last") == [("A", 1, 1, 3), ("B", 2, 2, 3)]
    assert drift.id_consistency(df, "p", ["c", "day"]).where("attribute = 'c'").count() == 2


@pytest.mark.parametrize(("size", "limit"), [(8, 1), (16, 7), (4_096, 10**6)])
def test_exact_quantiles(spark, size, limit, monkeypatch):
    import numpy as np

    monkeypatch.setattr(outliers, "SKETCH_SIZE", size)
    monkeypatch.setattr(outliers, "READ_LIMIT", limit)
    rng = random.Random(3)
    values = [rng.choice([0.0, 1e-9, 5.0]) for _ in range(400)] + [rng.lognormvariate(0, 8) for _ in range(300)] + [-1e12, 1e300]
    df = spark.createDataFrame([(v,) for v in [*values, None, float("nan")]], "x double")
    probabilities = [0.0, 0.25, 0.61, 0.9, 1.0]
    got = outliers.exact_quantiles(df, "x", probabilities)
    assert got == pytest.approx(list(np.quantile(values, probabilities)), rel=1e-12)


@pytest.mark.parametrize("limit", [100_000, 500])
def test_quantiles_of_many_values_take_few_scans(spark, monkeypatch, limit):
    """The same steps at every size: a sketch, a count, a reading; one more sketch and count while much is left."""
    import numpy as np

    monkeypatch.setattr(outliers, "READ_LIMIT", limit)
    edge = F.when(F.col("id") % 50 == 0, float("-inf")).when(F.col("id") % 70 == 1, float("inf"))
    noise = F.when(F.col("id") % 3 == 0, 7.0).otherwise(F.xxhash64("id") / 1e9)
    df = spark.range(1_500_000).select(F.coalesce(edge, noise).alias("x"))
    values = np.sort(df.toPandas()["x"].to_numpy())
    scans = []
    collect = type(df).collect
    monkeypatch.setattr(type(df), "collect", lambda self: scans.append(1) or collect(self))
    got = outliers.exact_quantiles(df, "x", [0.001, 0.25, 0.4, 0.75, 0.999])
    assert len(scans) <= (3 if limit > 500 else 5)
    at = lambda p: (len(values) - 1) * p
    low, high = ([float(values[int(f(at(p)))]) for p in (0.001, 0.25, 0.4, 0.75, 0.999)] for f in (np.floor, np.ceil))
    assert all(a <= g <= b for a, g, b in zip(low, got, high)) and got[0] == float("-inf") and got[-1] == float("inf")
    assert got[1] == pytest.approx(low[1] + (at(0.25) % 1) * (high[1] - low[1]))


def test_quantiles_of_nothing(spark):
    df = spark.createDataFrame([(None,)], "x double")
    assert outliers.exact_quantiles(df, "x", [0.5]) == [None]
    assert outliers.outliers_iqr(df, "x").count() == 0
    assert outliers.outliers_zscore(df, "x").count() == 0


def test_outliers(spark):
    values = [10.0] * 20 + [11.0] * 20 + [500.0, None, float("nan")]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    assert rows_of(outliers.outliers_iqr(df, "x")) == [(500.0,)]
    assert rows_of(outliers.outliers_zscore(df, "x")) == [(500.0,)]
    constant = spark.createDataFrame([(1.0,)] * 5, "x double")
    assert outliers.outliers_zscore(constant, "x").count() == 0


def test_iqr_bounds_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(1000).selectExpr("id", "cast(id as double) AS x").write.parquet(path)
    df = spark.read.parquet(path)
    plan = outliers.outliers_iqr(df, "x")._jdf.queryExecution().executedPlan().toString()
    assert "LessThan(x," in plan and "GreaterThan(x," in plan


def test_correlation(spark):
    df = spark.createDataFrame([(1.0, 2.0, 7), (2.0, 4.0, 7), (3.0, None, 7), (4.0, 8.0, 7)], "a double, b double, c int")
    got = {(r["column_a"], r["column_b"]): r["correlation"] for r in outliers.column_correlation(df).collect()}
    assert got[("a", "b")] == pytest.approx(1.0) and got[("a", "c")] is None


def test_correlation_of_many_columns_in_one_scan(spark):
    """Nulls pair by pair, large means, infinite values, and constant columns, against numpy."""
    import numpy as np

    draw = np.random.default_rng(2)
    base = draw.normal(size=(700, 1))
    values = np.hstack([1e9 + base, base + draw.normal(size=(700, 28)), np.full((700, 1), 0.1)])
    values[draw.random(values.shape) < 0.1] = np.nan
    values[3, 5] = np.inf
    names = [f"c{i}" for i in range(values.shape[1])]
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    df = spark.createDataFrame([tuple(None if np.isnan(x) else float(x) for x in r) for r in values], ", ".join(f"{n} double" for n in names))
    df = df.repartition(5).mapInArrow(count, df.schema)
    got = {(r.column_a, r.column_b): r.correlation for r in outliers.column_correlation(df).collect()}
    assert len(got) == len(names) * (len(names) - 1) // 2
    for (a, b), r in got.items():
        x, y = values[:, names.index(a)], values[:, names.index(b)]
        both = ~np.isnan(x) & ~np.isnan(y)
        if "c29" in (a, b):
            assert r is None or np.isinf(x[both]).any()
        elif np.isinf(x[both]).any() or np.isinf(y[both]).any():
            assert np.isnan(r)
        else:
            assert r == pytest.approx(np.corrcoef(x[both], y[both])[0, 1], abs=1e-6)
    assert seen.value < 3 * 700  # the table once, and the head of it


def test_dates_and_types(spark):
    data = [("2024-01-31",), ("31/12/2024",), ("2024-02-30",), ("soon",), (None,), (" 2024-01-01 ",)]
    df = spark.createDataFrame(data, "d string")
    assert rows_of(formats.invalid_dates(df, "d")) == [("2024-02-30",), ("soon",)]
    prices = spark.createDataFrame([("1",), ("2.5",), ("N/A",), (None,)], "p string")
    assert rows_of(formats.type_inconsistency(prices, "p")) == [("N/A", 1)]
    assert formats.type_inconsistency(prices, "p", min_share=0.9).count() == 0
    dates = spark.createDataFrame([(datetime(2024, 1, 2), datetime(2024, 1, 1))], "s timestamp, e timestamp")
    assert formats.date_consistency(dates, "s", "e").count() == 1
    mails = spark.createDataFrame([("a@b.co",), ("x",), ("a@b.co\n",), (None,)], "m string")
    assert rows_of(formats.pattern_check(mails, "m", r"[^@\s]+@[^@\s]+\.[a-z]+")) == [("a@b.co\n",), ("x",)]


def test_missing_over_time(spark):
    days = [datetime(2024, 1, 5), datetime(2024, 1, 6), datetime(2024, 1, 6), None]
    df = spark.createDataFrame([(d, v) for d, v in zip(days, [1, None, 2, None])], "d timestamp, v int")
    got = {r["period"]: (r["rows"], r["missing_count"], r["missing_percent_of_table"]) for r in missing.missing_by_period(df, "v", "d").collect()}
    assert got[days[1]] == (2, 1, 25.0) and got[None] == (1, 1, 25.0)
    assert missing.missing_span(df, "v", "d").first()[:] == (days[1], days[1], 1)
    kinds = rows_of(missing.missing_weekday_weekend(df, "v", "d"))
    assert kinds == [("weekday", 1, 0, 0.0), ("weekend", 2, 1, 50.0)]


def test_rare_values(spark):
    df = spark.createDataFrame([(v,) for v in "aaabbbccd"] + [(None,)], "v string")
    assert rows_of(variants.rare_values(df, "v")) == [("c", 2), ("d", 1)]
    assert variants.rows_with_rare_values(df, "v").count() == 3
    assert rows_of(variants.rare_category(df, "v")) == [("d", 1)]


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@pytest.mark.parametrize(("threshold", "cell"), [(0.85, 5000), (0.7, 3), (0.5, 5000), (0.3, 5000)])
def test_similar_links_join_what_brute_force_joins(spark, monkeypatch, threshold, cell):
    monkeypatch.setattr(variants, "CELL", cell)
    rng = random.Random(11)
    seeds = ["acme corporation limited", "acme", "techsupply incorporated", "é", "ab", "northern lights trading company"]
    texts = {""} | set(seeds)
    while len(texts) < 90:
        s = list(rng.choice(seeds))
        for _ in range(rng.randrange(0, 6)):
            at = rng.randrange(len(s) + 1)
            rng.choice([lambda: s.insert(at, rng.choice("abcé ")), lambda: s.pop(at) if at < len(s) else None])()
        texts.add("".join(s))
    texts = sorted(texts)
    expected = set()
    for i, a in enumerate(texts):
        for b in texts[i + 1 :]:
            if max(len(a), len(b)) and 1 - levenshtein(a, b) / max(len(a), len(b)) > threshold:
                expected.add(frozenset((a, b)))
    df = spark.createDataFrame([(t,) for t in texts], "norm string")
    links = variants.similar_links(df, threshold)
    got = {frozenset(r) for r in links.collect()}
    assert got <= expected and groups_of(got) == groups_of(expected)


def groups_of(links):
    """Texts joined by links, as sets."""
    own = {}
    for link in links:
        merged = set(link).union(*(own.get(x, ()) for x in link))
        own |= dict.fromkeys(merged, frozenset(merged))
        for x in merged:
            own[x] = frozenset(merged)
    return set(own.values())


def test_comparisons_grow_with_a_hot_gram_not_with_its_square(spark, monkeypatch):
    """Texts that all share most of their grams: one family of near copies, and texts alike only in a long passage."""
    def compared(copies):
        staged = []
        stage = variants.stage
        with monkeypatch.context() as patch:
            patch.setattr(variants, "stage", lambda df, label: staged.append((label, stage(df, label))) or staged[-1][1])
            rng = random.Random(1)
            near = [f"the very same long company name number {i:04d}" for i in range(copies)]
            # of so many letters that two of these words hardly share a gram by chance
            # of so many letters that two of these words hardly share a gram by chance
            word = lambda: "".join(chr(0x4E00 + rng.randrange(5_000)) for _ in range(14))
            unlike = [f"{word()} of the very same passage {word()}" for _ in range(copies)]
            df = spark.createDataFrame([(t,) for t in near + unlike], "norm string")
            links = {frozenset(r) for r in variants.similar_links(df).collect()}
        assert groups_of(links) == {frozenset(near)}
        return sum(df.count() for label, df in staged if label == "candidates")

    few, many = compared(150), compared(600)
    assert many < 6 * few and many < 4 * 600


def test_fuzzy_groups(spark):
    data = ["Acme Corp", "ACME CORP", "Acme Corp.", "Zenith", "zenith", "Medico", None]
    df = spark.createDataFrame([(v,) for v in data], "s string")
    got = rows_of(variants.fuzzy_categories(df, "s"), "group", "value", "variants")
    assert got == [
        ("acme corp", "ACME CORP", 3),
        ("acme corp", "Acme Corp", 3),
        ("acme corp", "Acme Corp.", 3),
        ("zenith", "Zenith", 2),
        ("zenith", "zenith", 2),
    ]
    assert variants.fuzzy_categories(df.where("s = 'Medico'"), "s").count() == 0


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(60)]  # a long chain
    edges += [(100, n) for n in range(101, 140)]  # a hub
    edges += [(rng.randrange(200, 300), rng.randrange(200, 300)) for _ in range(60)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            ra, rb = find(a), find(b)
            parent[max(ra, rb)] = min(ra, rb)
    expected = sorted((n, find(n)) for n in parent)
    df = spark.createDataFrame(edges, "a int, b int")
    assert sorted(tuple(r) for r in connected_components(df, "a", "b").collect()) == expected


def test_case_space_variants(spark):
    data = [("Acme  Corp",), ("acme corp",), ("acme corp",), ("Zenith",)]
    out = variants.case_space_variants(spark.createDataFrame(data, "s string"), "s")
    assert rows_of(out, "spelling_key", "value", "rows", "spellings", "group_rows") == [
        ("acme corp", "Acme  Corp", 1, 2, 3),
        ("acme corp", "acme corp", 2, 2, 3),
    ]


def test_custom_rules_go_on_after_failures(spark):
    df = spark.createDataFrame([(1, "5"), (2, "x"), (3, None)], "id int, t string")

    def broken(_):
        raise RuntimeError("no")

    checks = [
        rules.Rule("positive", "id > 1"),
        rules.Rule("syntax", "id >"),
        rules.Rule("cast", "cast(t as int) > 1"),  # fails while it runs
        rules.Rule("callable", lambda d: d.where("t IS NULL")),
        rules.Rule("broken", broken),
    ]
    got = {r["rule"]: (r["success"], r["affected_rows"]) for r in rules.custom_rule(df, checks).collect()}
    assert got == {
        "positive": (True, 2),
        "syntax": (False, None),
        "cast": (False, None),
        "callable": (True, 1),
        "broken": (False, None),
    }


def test_problem_sample_counts_a_row_once(spark):
    data = [(1, " a", None), (2, "b", " c "), (3, " d ", " e ")]
    df = spark.createDataFrame(data, "id int, t string, u string")
    assert evidence.problem_sample(df, "whitespace", ["t", "u"], ["id"]).count() == 3
    assert rows_of(evidence.problem_sample(df, "missing_values", ["u"], ["id"])) == [(None,)]
    assert evidence.problem_sample(df, "unheard of", ["t"], ["id"], 2).count() == 2


def test_example_ids(spark):
    hits = spark.range(100).selectExpr("id % 2 AS issue", "id")
    out = rows_of(evidence.example_row_ids(hits, "issue", "id", 3))
    assert out == [(0, 0, 0), (0, 1, 2), (0, 2, 4), (1, 0, 1), (1, 1, 3), (1, 2, 5)]
