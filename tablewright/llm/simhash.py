"""Near duplicates by SimHash: a popcount embedding, a grid join under Manhattan distance, an exact test.

The 64 bits are cut into 32 segments of two bits; a fingerprint's embedding is its 32 segment counts
(0, 1 or 2).  The Manhattan distance of two embeddings never exceeds the number of differing bits.  Counts
are held in unary (0, 1, 2 as 00, 01, 11), so that distance is the number of differing bits of two longs.

Grid: the segments form G groups, chosen by the number of fingerprints.  Two embeddings within distance D differ in at most D groups, so they
have the same counts in some G - D groups: they share a unit cell of one of the C(G, D) projections.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from ..functions.components import connected_components
from ..functions.staging import stage
from .texts import map_texts, without

WORDS = 4
SEED = 42
DISTANCE = 4
#: Groups of segments to choose from, by the number of fingerprints: more groups make more and smaller cells.
GROUPS = (7, 9, 12)
SEGMENT_BITS = 1.5  # entropy of a segment's count
PER_CELL = 16
#: Cells with more fingerprints than this are not joined pair by pair; see ``dense_links``.
CELL = 48
#: Cells with so many fingerprints are decided while they are counted.
FEW = 3
LOW_BITS = 0x5555555555555555


def shingle_hashes(text: str | None, words: int = WORDS) -> np.ndarray:
    """XXH64 of the lower-cased (A-Z) word shingles, repeats included; empty where there is no word."""
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return np.zeros(0, np.uint64)
    whole = memoryview(b" ".join(parts))
    ends = np.cumsum([len(p) + 1 for p in parts])
    starts = [0, *ends.tolist()]
    last = max(1, len(parts) - words + 1)
    digest = xxhash.xxh64_intdigest
    spans = zip(starts[:last], starts[min(words, len(parts)) :], strict=False)
    return np.fromiter((digest(whole[a : b - 1], SEED) for a, b in spans), np.uint64, last)


def majority(hashes: np.ndarray) -> int:
    """The 64 bits set in over half of the hashes."""
    ones = np.zeros(64, np.int64)
    last = len(hashes)
    for at in range(0, last, 1 << 16):
        bits = np.unpackbits(hashes[at : at + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > last).tobytes(), "big")


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """SimHash of the shingles; 0 where there is no word."""
    return majority(shingle_hashes(text, words))


def fingerprints(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), words: int = WORDS) -> DataFrame:
    """``keep`` plus bits: the fingerprint as a signed long."""

    def score(texts: list[str | None]) -> dict:
        return {"bits": np.array([fingerprint(t, words) for t in texts], np.uint64).view(np.int64)}

    return map_texts(without(docs, "bits"), "bits long", score, keep)


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def embedding(bits: Column) -> Column:
    """Segment counts in unary."""
    low = F.lit(LOW_BITS)
    high = F.shiftrightunsigned(bits, 1).bitwiseAND(low)
    own = bits.bitwiseAND(low)
    return high.bitwiseOR(own).bitwiseOR(F.shiftleft(high.bitwiseAND(own), 1))


def projections(groups: int, distance: int = DISTANCE) -> list[int]:
    """Bit masks: for every choice of groups - distance groups, the segments of those groups."""
    edges = [32 * g // groups for g in range(groups + 1)]
    own = [sum(3 << (2 * s) for s in range(edges[g], edges[g + 1])) for g in range(groups)]
    return [signed(sum(own[g] for g in chosen)) for chosen in combinations(range(groups), groups - distance)]


def groups_for(fingerprints: int) -> int:
    """The fewest groups at which an ordinary cell holds PER_CELL fingerprints at most."""
    room = lambda g: PER_CELL * 2 ** (32 * SEGMENT_BITS * (g - DISTANCE) / g)
    return next((g for g in GROUPS if fingerprints <= room(g)), GROUPS[-1])


def linked(a: Column, b: Column) -> Column:
    """Whether two fingerprints differ in ``DISTANCE`` bits or fewer; the embeddings are tested first."""
    near = F.bit_count(embedding(a).bitwiseXOR(embedding(b))) <= DISTANCE
    return near & (F.bit_count(a.bitwiseXOR(b)) <= DISTANCE)


def _pairs(bits: Column, others: Column) -> Column:
    """The pairs (a, b) of the members of a cell with ``FEW`` members at most; those of absent members hold a null."""
    second, third = F.get(others, F.lit(0)), F.get(others, F.lit(1))
    return F.array(*[F.struct(a.alias("a"), b.alias("b")) for a, b in ((bits, second), (bits, third), (second, third))])


def cells(distinct: DataFrame, groups: int) -> DataFrame:
    """(projection, cell, bits, others, members) for every cell in which there may be a link, staged.

    A cell of up to ``FEW`` members is one row: its least fingerprint and the others.  Least, greatest and the XOR of all
    name its members while they are counted, so it is left out at once if no two are linked, and nothing is joined: most cells
    that fingerprints share by chance end there.  A cell with more has a row for each member, and ``others`` is empty.
    """
    masks = F.array(*[F.lit(m) for m in projections(groups)])
    put = distinct.select("bits", embedding(F.col("bits")).alias("counts")).select(
        "bits", "counts", F.posexplode(masks).alias("projection", "mask")
    )
    put = put.select(F.col("projection").cast("short"), F.col("counts").bitwiseAND(F.col("mask")).alias("cell"), "bits")
    # one exchange, which the count and the join both read; the join's own test for nulls would make it another one
    put = put.where("cell IS NOT NULL").repartition("projection", "cell")
    shared = put.groupBy("projection", "cell").agg(
        F.count(F.lit(1)).alias("members"), F.min("bits").alias("least"), F.max("bits").alias("most"), F.bit_xor("bits").alias("odd")
    )
    few = F.col("members") <= FEW
    middle = F.col("odd").bitwiseXOR(F.col("least")).bitwiseXOR(F.col("most"))
    others = F.when(F.col("members") == 2, F.array("most")).when(few, F.array(middle, F.col("most"))).otherwise(F.array().cast("array<long>"))
    shared = shared.where("members > 1").select("projection", "cell", "members", F.col("least").alias("bits"), others.alias("others"))
    hit = F.exists(_pairs(F.col("bits"), F.col("others")), lambda p: F.coalesce(linked(p["a"], p["b"]), F.lit(False)))
    large = put.join(shared.where(~few).drop("bits"), ["projection", "cell"])
    return stage(shared.where(few & hit).unionByName(large), "cells")


def sparse_links(found: DataFrame) -> DataFrame:
    """(a, b): linked fingerprints that share a cell of at most ``CELL`` members."""
    small = found.where(F.col("members") <= CELL)
    known = small.where(F.col("members") <= FEW).select(F.inline(_pairs(F.col("bits"), F.col("others"))))
    more = small.where(F.col("members") > FEW).select("projection", "cell", "bits")
    met = more.withColumnRenamed("bits", "a").join(more.withColumnRenamed("bits", "b"), ["projection", "cell"]).select("a", "b")
    return known.union(met).where((F.col("a") < F.col("b")) & linked(F.col("a"), F.col("b"))).distinct()


def dense_links(found: DataFrame) -> DataFrame:
    """(a, b): enough links to join all linked fingerprints of the larger cells.

    Two fingerprints within 4 bits have a common variant within 2 bits of each.  Every member of a
    larger cell names its 2,081 variants, and each variant links those who name it to the smallest:
    linear in the members, no pair is formed, and the ends of each link are within 4 bits.
    """
    members = found.where(F.col("members") > CELL).select(F.explode(F.concat(F.array("bits"), "others")).alias("bits")).distinct()
    singles = [0, *(1 << i for i in range(64))]
    doubles = [(1 << i) | (1 << j) for i, j in combinations(range(64), 2)]
    flips = F.array(*[F.lit(signed(x)) for x in singles + doubles])
    named = members.select("bits", F.explode(flips).alias("flip"))
    named = named.select("bits", F.col("bits").bitwiseXOR(F.col("flip")).alias("variant"))
    least = F.min("bits").over(Window.partitionBy("variant"))
    return named.select("bits", least.alias("a")).where("a < bits").select("a", F.col("bits").alias("b")).distinct()


def components(
    docs: DataFrame, key: str = "doc_id", keep: tuple[str, ...] = (), words: int = WORDS, groups: int | None = None
) -> DataFrame:
    """``key`` and ``keep`` plus fingerprint and component_id for every row of ``docs``.

    component_id is the smallest key that links can reach; equal fingerprints are linked, texts
    without a word among them.  A row with a null key takes part and never names a component
    (its component_id is null only if all rows of the component have a null key).  Repeated rows come
    back each; columns named like results are replaced.
    """
    docs = without(docs, "fingerprint", "component_id", "bits", "root")
    keep = tuple(dict.fromkeys((key, *keep)))
    rows = stage(fingerprints(docs, keep, words), "fingerprints")
    return name_components(rows, key, keep, fingerprint_links(rows.select("bits").distinct(), groups))


def fingerprint_links(distinct: DataFrame, groups: int | None = None) -> DataFrame:
    """(a, b): links that connect all fingerprints within ``DISTANCE`` bits."""
    distinct = stage(distinct, "distinct")
    found = cells(distinct, groups or groups_for(distinct.count()))
    return sparse_links(found).union(dense_links(found))


def name_components(rows: DataFrame, key: str, keep: tuple[str, ...], links: DataFrame) -> DataFrame:
    """``keep`` plus fingerprint and the smallest key that links between fingerprints can reach."""
    classes = rows.groupBy("bits").agg(F.min(key).alias("least"))
    reached = connected_components(links, "a", "b").select(F.col("node").alias("bits"), F.col("component").alias("root"))
    rooted = classes.join(reached, "bits", "left").withColumn("root", F.coalesce("root", "bits"))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    lookup = stage(rooted.join(named, "root").select("bits", "component_id"), "components")
    text = F.lower(F.lpad(F.hex("bits"), 16, "0")).alias("fingerprint")
    return rows.join(lookup, "bits").select(*keep, text, "component_id")
