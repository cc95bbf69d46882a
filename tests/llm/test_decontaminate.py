from __future__ import annotations

import re

from pyspark.sql import functions as F

from tablewright.llm import decontaminate

from .conftest import MEDIUM

ITEM = "A farmer walks 12 km to the town where Maria sells 5 kg of rice and then 12 km back before the sun goes down today."
OTHER = "the quick brown fox jumps over the lazy dog near the river bank while seven birds sing aloud"


def found(spark, documents, *texts, items=((1, ITEM), (2, OTHER))):
    benchmark = spark.createDataFrame(list(items), "item_id bigint, text string")
    rows = decontaminate.contaminated(documents(*enumerate(texts)), benchmark).collect()
    return {(r.doc_id, r.item_id): r.verbatim for r in rows}


def test_verbatim_changed_and_clean(spark, documents):
    changed = ITEM.replace("12", "31").replace("5 kg", "8 lb").replace("Maria", "Pedro")
    got = found(
        spark, documents,
        "Intro words. " + ITEM + " End.", changed, "nothing of it at all", OTHER.upper(), OTHER[:20],
        "before " + OTHER + " between " + ITEM, " ".join(OTHER.split()[:12]), " ".join(OTHER.split()[2:15]), ITEM[:45],
    )
    assert got == {(0, 1): True, (1, 1): False, (3, 2): True, (5, 2): True, (5, 1): True, (7, 2): True}


def test_slots_pair_one_to_one(spark, documents):
    item = "we add 3 and 4 then take the 3 away from the big pile of stones on the floor"
    assert found(spark, documents, item.replace("3", "9"), items=((1, item),)) == {(0, 1): False}
    # in the first 13 words, 3 stands for 9 once and for 3 once: no window with either counts
    short = " ".join(item.split()[:13])
    assert found(spark, documents, short, items=((1, item),)) == {(0, 1): True}
    assert found(spark, documents, short.replace("3", "9", 1), items=((1, item),)) == {}
    merged = item.replace("3", "4")
    assert (0, 1) not in found(spark, documents, " ".join(merged.split()[:14]), items=((1, item),))


def test_short_items_and_odd_rows(spark, documents, odd):
    assert found(spark, documents, "so Two words only here", "two words only", None, "", items=((1, "two words only"), (2, ""), (3, None), (None, "x y"))) == {
        (1, 1): True
    }
    benchmark = spark.createDataFrame([(1, "word after word word after word")], "item_id bigint, text string")
    assert decontaminate.contaminated(odd, benchmark).count() == 0
    assert decontaminate.contaminated(odd.limit(0), benchmark).count() == 0
    assert decontaminate.contaminated(odd, benchmark.limit(0)).count() == 0
    long = spark.createDataFrame([(1, "after word word " * 6)], "item_id bigint, text string")
    assert [tuple(r)[:2] for r in decontaminate.contaminated(odd, long).collect()] == [(5, 1)]


def test_plan_has_no_python(spark):
    docs, items = (spark.read.parquet(f"{MEDIUM}/{t}.parquet") for t in ("documents", "benchmark"))
    windows = decontaminate.benchmark_windows(items)
    plan = decontaminate.matched_windows(docs, windows)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow|CartesianProduct|NestedLoop", plan)


def test_query_finds_the_passages(spark):
    """Against 13-word runs of small-letter words; no benchmark text of this table has a slot."""
    docs, items = (spark.read.parquet(f"{MEDIUM}/{t}.parquet") for t in ("documents", "benchmark"))
    words = lambda t: re.findall(r"[^\W\d_]+", (t or "").lower())
    runs = {}
    for r in items.collect():
        w = words(r.text)
        for k in range(len(w) - 12):
            runs.setdefault(tuple(w[k : k + 13]), set()).add(r.item_id)
    want = set()
    for r in docs.collect():
        w = words(r.text)
        want |= {(r.doc_id, i) for k in range(len(w) - 12) for i in runs.get(tuple(w[k : k + 13]), ())}
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, items).collect()}
    assert want and got == want


def test_case_and_place_of_names_do_not_matter(spark, documents):
    copies = [ITEM.upper(), ITEM.lower(), ITEM.title(), ITEM.replace(" ", "\n"), "he asked, " + ITEM]
    assert found(spark, documents, *copies) == {(k, 1): True for k in range(5)}
    short = "What is the name of the longest river here"
    assert found(spark, documents, "he asked, " + short, "and what" + short[4:], items=((1, short),)) == {(0, 1): True, (1, 1): True}


def test_names_may_open_sentences(spark, documents):
    item = "Tom has 5 apples. Tom gives 2 of them to a friend. Tom then eats one more after lunch."
    other = item.replace("Tom", "Anna").replace("5", "9")
    mixed = other.replace("Anna", "Eve", 1)
    assert found(spark, documents, other, mixed.split(" Anna then")[0], items=((1, item),)) == {(0, 1): False}
    names = " ".join(f"Word{chr(97 + i)}" for i in range(20))
    assert found(spark, documents, names.replace("Word", "Other"), items=((1, names),)) == {}


def test_items_of_seven_words_inside_longer_texts(spark, documents):
    item = "every Seven words make one short item"
    texts = ["then " + item.upper() + " and much more text goes on after it", item, " ".join(item.split()[:6]) + " only with other words after"]
    assert found(spark, documents, *texts, items=((1, item),)) == {(0, 1): True, (1, 1): True}


def test_shifts_add_up(spark, documents):
    item = " ".join(f"word{chr(97 + i)}" for i in range(17)).replace("word", "w")
    w = item.split()
    put_in, left_out = " ".join([*w[:8], "more", *w[8:]]), " ".join([*w[:8], *w[9:]])
    far = " ".join([*w[:8], *["other"] * 40, *w[8:12]])
    assert found(spark, documents, put_in, left_out, far, items=((1, item),)) == {(0, 1): True, (1, 1): True}
    trip = "we took the first train of the day from Boston and came back with the last one at night"
    assert found(spark, documents, trip.replace("Boston", "New York"), items=((1, trip),)) == {(0, 1): True}
    # over the band, 3 stands for 9 and for 3: no window with either counts
    sums = "first we add 3 to all the old numbers and then we take 3 away from them again"
    wrong = sums.replace("3", "9", 1).replace("numbers", "big numbers")
    assert found(spark, documents, wrong, items=((1, sums),)) == {}


def test_filters_are_packed(spark, documents):
    """The plan holds its two filters as text of some 50 KB at most, whatever the benchmark."""
    item = " ".join(f"word{chr(97 + i)}" for i in range(20))
    benchmark = spark.createDataFrame([(1, item)], "item_id long, text string")
    found = decontaminate.matched_windows(documents((1, item), (2, "other words")), decontaminate.benchmark_windows(benchmark))
    assert len(found._jdf.queryExecution().executedPlan().toString()) < 250_000  # 1 MB as bytes
    assert found.where("doc = 1").count() == found.count() > 0


def test_every_mark_of_a_filter(spark):
    marks = [0, 1, 62, 63, 127, 64 * 5 + 7, decontaminate.MARKS - 1]
    windows = spark.createDataFrame([(m,) for m in marks], "mark0 int")
    every = spark.range(decontaminate.MARKS).select(F.col("id").cast("int").alias("m"))
    hit = every.where(decontaminate._is_marked(decontaminate._marks(windows, "mark0"), F.col("m")))
    assert sorted(r.m for r in hit.collect()) == marks
