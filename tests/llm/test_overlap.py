from __future__ import annotations

import random

import numpy as np
import pytest

from tablewright.llm import overlap, simhash

from .conftest import MEDIUM


def shingles(text):
    parts = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    return {b" ".join(parts[i : i + 5]) for i in range(max(1, len(parts) - 4))} if parts else set()


def brute_near_copies(texts):
    """Smallest id reachable over links of 4 bits or of an overlap of 0.8; texts: id -> text."""
    root = {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(texts)
    bits = {i: simhash.fingerprint(texts[i], 5) for i in ids}
    sets = {i: shingles(texts[i]) for i in ids}
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            small, large = sorted((len(sets[a]), len(sets[b])))
            near = (bits[a] ^ bits[b]).bit_count() <= 4
            if not near and small >= 0.8 * large:
                shared = len(sets[a] & sets[b])
                near = shared >= 0.8 * (small + large - shared)
            if near:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in ids}


def named(df, key="doc_id"):
    return {r[key]: r.component_id for r in df.collect()}


def edited(rng, parts, changes):
    out = list(parts)
    for at in rng.sample(range(len(out)), changes):
        out[at] = f"changed{rng.randrange(10**6)}"
    return out


def test_overlap_of_sets():
    a, b = np.array([1, 2, 3, 4], np.uint64), np.array([2, 3, 4, 5], np.uint64)
    assert overlap.overlap(a, b) == 0.6 and overlap.overlap(a, a) == 1.0 and overlap.overlap(a[:0], a) == 0.0
    assert overlap.overlap(a[:0], a[:0]) == 1.0


def test_sets_are_those_of_the_shingles():
    rng = random.Random(2)
    texts = [None, "", " \t", "one", "One  two\nthree", "É é É é É é É", "a" * 50, "x\x1cy z w é #"]
    texts += [" ".join(rng.choice(["ab", "AB", "c", "ba"]) for _ in range(rng.randrange(30))) for _ in range(60)]
    for chosen in (texts, texts[:1], texts[3:4], []):
        sets = overlap.shingle_sets(chosen)
        named = [shingles(t) for t in chosen]
        assert [len(x) for x in sets] == [len(x) for x in named]
        for (a, x), (b, y) in zip(zip(sets, named), zip(sets[1:], named[1:])):
            assert len(np.intersect1d(a, b)) == len(x & y) and (np.diff(a.astype(float)) >= 0).all()


def test_sketches_differ_in_no_more_bits_than_sets_in_elements():
    rng = np.random.default_rng(4)
    for n in (3, 100, 5_000):
        pool = rng.integers(0, 1 << 63, n, np.uint64)
        a, b = (np.unique(rng.choice(pool, n - n // 4)) for _ in range(2))
        bits = np.unpackbits((overlap.parity(a) ^ overlap.parity(b)).view(np.uint8)).sum()
        assert bits <= len(np.setxor1d(a, b)) and len(overlap.parity(a)) * 64 == overlap.SKETCH


def test_prefixes_and_places_find_pairs_at_the_threshold():
    """Pairs at an overlap of 0.8 share an early element whose places allow the overlap, in any order."""
    rng = np.random.default_rng(1)
    for _ in range(400):
        pool = rng.permutation(1 << 12)[: rng.integers(2, 600)]
        shared = int(np.ceil(0.8 * len(pool)))
        cut = shared + int(rng.integers(0, len(pool) - shared + 1))
        a, b = np.sort(pool[:cut]), np.sort(np.concatenate([pool[:shared], pool[cut:]]))
        if overlap.overlap(a, b) < 0.8:
            continue
        first = [set(x[: overlap.prefix_length(len(x), 0.8)]) for x in (a, b)]
        least = np.ceil((len(a) + len(b)) * 0.8 / 1.8 - 1e-9)
        met = [min(len(a) - list(a).index(x), len(b) - list(b).index(x)) for x in first[0] & first[1]]
        assert met and max(met) >= least
        small, large = sorted((a, b), key=len)
        early = small[: int(len(small) - np.ceil(2 * len(small) * 0.8 / 1.8 - 1e-9)) + 1]
        assert set(early) & set(large[: overlap.prefix_length(len(large), 0.8)])


def near_copies(rng, copies, changes, base=True):
    """Copies of one text with some words changed, far from one another, and the text itself or not."""
    parts = [f"w{i}" for i in range(120)]
    return ([parts] if base else []) + [edited(rng, parts, changes) for _ in range(copies)]


@pytest.mark.parametrize("changes", [2, 6])
def test_pairs_grow_with_a_group_not_with_its_square(spark, documents, monkeypatch, changes):
    def compared(copies, base):
        staged = []
        with monkeypatch.context() as patch:
            patch.setattr(overlap, "stage", lambda df, label: staged.append((label, stage(df, label))) or staged[-1][1])
            table = {i: " ".join(t) for i, t in enumerate(near_copies(random.Random(changes), copies, changes, base))}
            got = named(overlap.components(documents(*table.items()), "doc_id"))
        if copies <= 150:
            assert got == brute_near_copies(table)
        return sum(df.count() for label, df in staged if label == "pairs")

    stage = overlap.stage
    few, many = compared(150, True), compared(600, True)
    assert many < 5 * few + 600
    if changes > 2:  # no text stands between them: they are unlike, and places tell so
        assert compared(150, False) <= 600


def test_groups_equal_brute_force(spark, documents):
    """Groups of edited texts in chains, a passage that many texts share, copies, and lone texts."""
    rng = random.Random(3)
    words = [f"w{i}" for i in range(3_000)]
    passage = rng.choices(words, k=60)
    texts = []
    for _ in range(25):
        base = rng.choices(words, k=rng.randrange(20, 200))
        texts += [base, edited(rng, base, len(base) // 50), edited(rng, base, max(1, len(base) // 12))]
        chain = edited(rng, texts[-1], max(1, len(base) // 60))
        texts += [chain, edited(rng, chain, max(1, len(base) // 60)), list(base)]
    texts += [passage + rng.choices(words, k=rng.randrange(5, 60)) for _ in range(60)]
    rng.shuffle(texts)
    table = {i: " ".join(t) for i, t in enumerate(texts)}
    got = named(overlap.components(documents(*table.items()), "doc_id"))
    assert got == brute_near_copies(table) and len(set(got.values())) < len(got) - 50


def test_a_second_group_in_a_leaders_cells(spark, documents, monkeypatch):
    """Members whose leader is unlike them are still compared with one another, in cells of any size."""
    order = overlap.shingle_counts
    monkeypatch.setattr(overlap, "shingle_counts", lambda *a: order(*a) * 0)  # any order will do
    shared = [f"s{i}" for i in range(30)]
    one, two, three = (shared + [f"{n}{i}" for i in range(60)] for n in "abc")
    rows = {0: one, 1: two, 2: [*two[:-1], "x"], 3: three, 4: [*three[:-1], "y"], 5: [*two[:-2], "z", "x"]}
    table = {i: " ".join(t) for i, t in rows.items()}
    for ids, leaders in ((overlap.FEW_IDS, 2), (0, 0), (0, 1)):
        monkeypatch.setattr(overlap, "FEW_IDS", ids)
        monkeypatch.setattr(overlap, "LEADERS", leaders)
        assert named(overlap.components(documents(*table.items()), "doc_id")) == {0: 0, 1: 1, 2: 1, 3: 3, 4: 3, 5: 1}


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, ""), (2, None), (3, " "), (4, "word"), (5, "WORD")]])
def test_odd_texts(documents, spark, rows):
    docs = documents(*rows) if rows else documents((1, "x")).limit(0)
    want = {4: 4, 5: 4} | {i: 1 for i in (1, 2, 3)}
    assert named(overlap.components(docs.selectExpr("*", "'mine' AS bits", "1 AS Size"), "doc_id")) == {i: want[i] for i, _ in rows}


def test_table_equals_brute_force(spark):
    docs = spark.read.parquet(f"{MEDIUM}/documents.parquet")
    assert named(overlap.components(docs, "doc_id")) == brute_near_copies({r.doc_id: r.text for r in docs.collect()})
