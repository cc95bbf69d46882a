from __future__ import annotations

import random

import pytest
import xxhash
from pyspark.sql import functions as F

from tablewright.llm import simhash

from .conftest import MEDIUM


def brute_fingerprint(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        lowered = lowered.replace(c, " ")
    parts = [p for p in lowered.split(" ") if p]
    if not parts:
        return 0
    shingles = [" ".join(parts[i : i + 4]) for i in range(max(1, len(parts) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(bits):
    """Smallest id reachable over links of 4 bits or fewer; bits: id -> fingerprint."""
    root = {i: i for i in bits}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(bits)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if (bits[a] ^ bits[b]).bit_count() <= 4:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("text", [None, "", " \t", "one", "Ä b C d", "a b c d", "x y z w v u", "A B c\x1cd e f g"])
def test_fingerprint(text):
    assert simhash.fingerprint(text) == brute_fingerprint(text)


def test_fingerprint_is_the_engine_hash(spark):
    assert spark.range(1).select(F.xxhash64(F.lit("one two"))).first()[0] == simhash.signed(xxhash.xxh64_intdigest("one two", 42))


def test_embedding_bounds_the_distance(spark):
    rng = random.Random(2)
    rows = []
    for _ in range(300):
        a = rng.getrandbits(64)
        b = a
        for _ in range(rng.randrange(9)):
            b ^= 1 << rng.randrange(64)
        rows.append((simhash.signed(a), simhash.signed(b)))
    df = spark.createDataFrame(rows, "a bigint, b bigint")
    near = F.bit_count(simhash.embedding(F.col("a")).bitwiseXOR(simhash.embedding(F.col("b"))))
    for r in df.select("a", "b", near.alias("d")).collect():
        count = lambda x: [(x >> s & 1) + (x >> s + 1 & 1) for s in range(0, 64, 2)]
        assert r.d == sum(abs(p - q) for p, q in zip(count(r.a), count(r.b), strict=True)) <= ((r.a ^ r.b) & (1 << 64) - 1).bit_count()


@pytest.mark.parametrize("cell", [simhash.CELL, 2, 0])
def test_links_equal_brute_force(spark, monkeypatch, cell):
    """Clusters in chains around random centres, by pairs in small cells or by variants in large ones."""
    monkeypatch.setattr(simhash, "CELL", cell)
    rng = random.Random(4)
    values = {rng.getrandbits(64) for _ in range(60)}
    for centre in list(values)[:6]:
        for _ in range(12):
            other = centre
            for _ in range(rng.randrange(1, 7)):
                other ^= 1 << rng.randrange(64)
            values.add(other)
    bits = dict(enumerate(sorted(values)))
    distinct = spark.createDataFrame([(simhash.signed(v),) for v in bits.values()], "bits bigint")
    found = simhash.cells(distinct, 7)
    links = simhash.sparse_links(found).union(simhash.dense_links(found)).collect()
    assert all(((a ^ b) & (1 << 64) - 1).bit_count() <= 4 for a, b in links)
    place = {simhash.signed(v): i for i, v in bits.items()}
    root = {i: i for i in bits}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        x, y = sorted((find(place[a]), find(place[b])))
        root[y] = x
    assert {i: find(i) for i in bits} == brute_components(bits)


def test_query_equals_brute_force(spark):
    docs = spark.read.parquet(f"{MEDIUM}/documents.parquet")
    bits = {r.doc_id: brute_fingerprint(r.text) for r in docs.collect()}
    want = brute_components(bits)
    got = simhash.components(docs).collect()
    assert {(r.doc_id, r.fingerprint, r.component_id) for r in got} == {(i, f"{bits[i]:016x}", want[i]) for i in bits}


def test_odd_rows(odd):
    rows = simhash.components(odd).collect()
    assert len(rows) == odd.count()
    zero = [r for r in rows if r.fingerprint == "0" * 16]
    assert len(zero) == 4 and {r.component_id for r in zero} == {1}
    assert [r.component_id for r in rows if r.doc_id is None and r.fingerprint != "0" * 16] == [None]
    assert simhash.components(odd.limit(0)).count() == 0


def test_more_groups_for_more_fingerprints(spark):
    assert [simhash.groups_for(n) for n in (0, 10**6, 10**8, 10**10)] == [7, 7, 9, 12]
    rng = random.Random(8)
    base = [rng.getrandbits(64) for _ in range(40)]
    near = [b ^ sum(1 << k for k in rng.sample(range(64), rng.randrange(1, 6))) for b in base for _ in range(4)]
    values = sorted({simhash.signed(x) for x in base + near})
    distinct = spark.createDataFrame([(v,) for v in values], "bits bigint")
    linked = {(a, b) for i, a in enumerate(values) for b in values[i + 1 :] if ((a ^ b) & (2**64 - 1)).bit_count() <= 4}
    for groups in simhash.GROUPS:
        assert {tuple(r) for r in simhash.fingerprint_links(distinct, groups).collect()} == linked


def test_chance_cells_are_not_joined(spark):
    """Fingerprints that share cells by chance only leave no row for a join; cells of two and three keep their links."""
    rng = random.Random(16)
    chance = {rng.getrandbits(64) for _ in range(4000)}
    distinct = lambda values: spark.createDataFrame([(simhash.signed(v),) for v in values], "bits bigint")
    alone = simhash.cells(distinct(chance), 7)
    # cells of four and more, few by chance, have a row a member
    assert alone.where(F.col("members") <= simhash.FEW).count() == 0 and alone.count() < 200
    centre = rng.getrandbits(64)
    near = {centre, centre ^ 3, centre ^ (7 << 40)}
    for group in (near, set(list(near)[:2])):
        links = simhash.fingerprint_links(distinct(chance | group), 7).collect()
        want = {(a, b) for a in group for b in group if simhash.signed(a) < simhash.signed(b) and (a ^ b).bit_count() <= 4}
        assert {tuple(r) for r in links} == {(simhash.signed(a), simhash.signed(b)) for a, b in want} and want
