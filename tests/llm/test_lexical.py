from __future__ import annotations

import random
import re
from collections import Counter
from math import floor, log

import pytest
from checks import compare
from pyspark.sql import functions as F

from tablewright.llm import lexical, queries

from .conftest import MEDIUM


def terms(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text or "")]


def brute(docs, items, best=10):
    held = [(i, Counter(terms(t)), len(terms(t))) for i, t in docs]
    number, total = sum(n > 0 for *_, n in held), sum(n for *_, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in items:
        scored = []
        for doc, counts, n in held:
            score = 0
            for t in terms(text):
                if counts[t]:
                    m = 100 - 75 + 75 * n * number // total
                    score += floor(1000 * log((2 * number + 2) / (2 * df[t] + 1))) * (10**9 * counts[t] // (1000 * counts[t] + 8 * m))
            if score > 0:
                scored.append((-score, doc is None, doc))
        out += [(item, k + 1, d, -s) for k, (s, _, d) in enumerate(sorted(scored, key=lambda x: x[:2] + (x[2] or 0,))[:best])]
    return sorted(out, key=str)


def found(spark, docs, items, **options):
    df = lexical.search(
        spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("rank", F.lit("mine")).withColumn("score", F.lit("mine")),
        spark.createDataFrame(items, "item_id bigint, text string").withColumn("term", F.lit("mine")).withColumn("n", F.lit("mine")),
        **options,
    )
    return sorted(map(tuple, df.select("item_id", "rank", "doc_id", "score").collect()), key=str)


@pytest.mark.parametrize(("postings", "cells"), [(lexical.POSTINGS, lexical.CELLS), (12, 7)])
def test_search_equals_brute_force(spark, monkeypatch, postings, cells):
    monkeypatch.setattr(lexical, "POSTINGS", postings)
    monkeypatch.setattr(lexical, "CELLS", cells)
    rng = random.Random(3)
    vocabulary = "a A bc Éa éa 12 x_y don't ñandú \x85 日本 z\x1cq".split(" ")
    text = lambda n: rng.choice(" ,\n").join(rng.choices(vocabulary, range(len(vocabulary), 0, -1), k=n))
    docs = [(i, text(rng.randrange(30))) for i in range(60)]
    docs += [(i, "bc 12 bc") for i in range(100, 140)]  # a group of ties
    docs += [(7, "again a"), (7, "again a"), (None, "again a"), (200, None), (201, ""), (202, "., \n"), (203, "word " * 50_000 + "bc")]
    items = [(i, text(8)) for i in range(8)] + [(3, "bc bc a"), (9, None), (10, ""), (11, "nowhere"), (12, "again again word")]
    assert found(spark, docs, items) == brute(docs, items)
    assert found(spark, docs, items, best=3) == brute(docs, items, 3)


def test_empty_tables(spark):
    assert found(spark, [], [(1, "a")]) == [] and found(spark, [(1, "a")], []) == []
    assert found(spark, [(1, " ")], [(1, "a")]) == []


def test_blocks_hold_a_bounded_index(spark, monkeypatch):
    monkeypatch.setattr(lexical, "POSTINGS", 50)
    items = spark.createDataFrame([(i, " ".join(f"t{i}x{k}" for k in range(10))) for i in range(40)] + [(99, " ".join(f"u{k}" for k in range(80)))], "item_id bigint, text string")
    entries = lexical.item_terms(items, "item_id", "text")
    count = lexical.blocks_of(entries)
    load = entries.groupBy(lexical._block(count)).agg(F.count(F.lit(1)).alias("n"), F.countDistinct(lexical.ROW).alias("items"))
    assert load.where("n > 50 AND items > 1").count() == 0 and load.where("n > 50").count() == 1


def test_query_equals_sql(spark):
    con = compare.connect(MEDIUM)
    assert compare.differences("op11", spark, con, MEDIUM, queries.op11_lexical_search, queries.LEXICAL_SQL) is None
