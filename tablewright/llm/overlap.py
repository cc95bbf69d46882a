"""Near copies by shingle overlap: what four bits of a fingerprint can't reach.

Two texts whose five-word shingles overlap by 0.8 differ in about ten of 64 fingerprint bits, too many for any exact
grid.  Here the fingerprint links of ``simhash`` are kept, and further links come from an exact prefix join on
the sets of shingle hashes.  All sets are put in one order, frequent shingles last.  Two sets of n and m elements that overlap
by t share c = t / (1 + t) * (n + m) elements at least, so they share one among the first n - ceil(t n) + 1 and
m - ceil(t m) + 1 (prefix filter), and the first one they share has places p and q with min(n - p, m - q) >= c (position
filter).  A passage that many texts share comes last in all of them and makes no pair of texts that differ elsewhere.

A shingle that many alike texts share costs as many comparisons as it has texts: all are compared with the
most central of them, the one with the fewest rarer shingles, and only texts that stay in different components are
compared with one another, by size and place.  Of the candidates, those whose parity sketches differ in more bits than
the sets may differ in elements are out (no set can differ in fewer elements than its sketch in bits); every other one is
decided on the two whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from math import ceil

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.components import connected_components
from ..functions.staging import stage
from . import simhash
from .texts import CHUNK_CHARS, map_texts, slices, sum_by_index, without

WORDS = 5
SIMILARITY = 0.8
_BASE, _UNBASE = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)
_BLANKS = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])
#: Shingles are counted in 2^COUNT_BITS groups by hash, only to put them in an order: 2 MB, whatever the corpus.
COUNT_BITS = 18
#: Rounds in which the texts of a shingle are compared with one of them.
LEADERS = 1
#: Ratio of the sizes that meet in one cell.
SIZE_STEP = 1.03
#: Bits of a parity sketch: whether a set has an odd number of the elements of each group of hashes.
SKETCH = 512
#: Up to so many ids of texts to be read are broadcast (16 MB); beyond, texts and ids are joined by shuffle.
FEW_IDS = 2_000_000
PAIRS_AT_ONCE = 128
INTERNAL = ("fingerprint", "component_id", "bits", "same", "size", "prefix", "sketch", "root")


def overlap(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sorted sets; 1 where both are empty."""
    shared = len(np.intersect1d(a, b, assume_unique=True))
    total = len(a) + len(b) - shared
    return shared / total if total else 1.0


def _powers(base: int, size: int) -> np.ndarray:
    factors = np.full(size, base, np.uint64)
    factors[:1] = 1
    return np.multiply.accumulate(factors)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def shingle_sets(texts: list[str | None], words: int = WORDS) -> list[np.ndarray]:
    """The sorted set of 64-bit hashes of each text's shingles: runs of ``words`` lower-cased (A-Z) words, or all of a
    shorter text.  Texts are hashed together, in chunks of bounded size."""
    ends = np.cumsum([len(t or "") for t in texts])
    out, at = [], 0
    while at < len(texts):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + CHUNK_CHARS, side="right")))
        out += _shingle_sets(texts[at:stop], words)
        at = stop
    return out


def _shingle_sets(texts: list[str | None], words: int) -> list[np.ndarray]:
    parts = [(t or "").encode("utf-8", "surrogatepass").lower() for t in texts]
    size = np.array([len(p) + 1 for p in parts], np.int64)
    codes = np.frombuffer(b" ".join([b"", *parts, b""]), np.uint8)
    edge = np.diff(_BLANKS[codes].astype(np.int8))
    first, last = np.flatnonzero(edge == -1) + 1, np.flatnonzero(edge == 1) + 1
    sums = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * _powers(_BASE, len(codes)), out=sums[1:])
    word = _mixed((sums[last] - sums[first]) * _powers(_UNBASE, len(codes))[first])
    # text i takes size[i] places after the first blank
    owner = np.searchsorted(np.cumsum(size), first - 1, side="right")
    number = np.bincount(owner, minlength=len(texts))
    begins = np.cumsum(number) - number
    factors = _powers(_BASE, words + 1)[1:]
    runs = max(0, len(word) - words + 1)
    joined = np.zeros(runs, np.uint64)
    for k in range(words):
        joined += word[k : k + runs] * factors[k]
    whole = np.flatnonzero(owner[:runs] == owner[words - 1 : words - 1 + runs]) if runs else np.zeros(0, np.int64)
    hashes, owners = [joined[whole]], [owner[whole]]
    for i in np.flatnonzero((number > 0) & (number < words)):
        own = word[begins[i] : begins[i] + number[i]]
        hashes.append(np.array([(own * factors[: len(own)]).sum(dtype=np.uint64) + np.uint64(len(own))]))
        owners.append(np.array([i]))
    value, of = _mixed(np.concatenate(hashes)), np.concatenate(owners)
    order = np.lexsort((value, of))
    value, of = value[order], of[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (of[1:] != of[:-1])
    return np.split(value[new], np.searchsorted(of[new], np.arange(1, len(texts))))


def _group(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - COUNT_BITS)).astype(np.int64)


def shingle_counts(docs: DataFrame, words: int = WORDS) -> np.ndarray:
    """How many texts hold a shingle of each group of hashes; a table of fixed size."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(1 << COUNT_BITS, np.int64)
        for batch in slices(batches, 0):
            hashes = np.concatenate([*shingle_sets(batch.column(0).to_pylist(), words), np.zeros(0, np.uint64)])
            found += np.bincount(_group(hashes), minlength=len(found))
        slots = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(slots, pa.int32()), pa.array(found[slots].astype(float))], names=["slot", "value"])

    out = np.zeros(1 << COUNT_BITS)
    found = sum_by_index(docs.select("text"), count).toArrow()  # a Row for each group would take 100 MB of the driver
    out[found["slot"].to_numpy()] = found["value"].to_numpy()
    return out


def prefix_length(size: int, similarity: float) -> int:
    return size - ceil(similarity * size - 1e-9) + 1 if size else 0


def parity(hashes: np.ndarray) -> np.ndarray:
    odd = np.bincount((hashes & np.uint64(SKETCH - 1)).astype(np.int64), minlength=SKETCH) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def signatures(docs: DataFrame, keep: tuple[str, ...], words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """``keep`` plus bits, same (a hash of the set of shingles), size (of that set), prefix (its first shingles in the
    common order) and sketch."""
    counts = docs.sparkSession.sparkContext.broadcast(shingle_counts(docs, words))

    def score(texts: list[str | None]) -> dict:
        out: dict[str, list] = {"bits": [], "same": [], "size": [], "prefix": [], "sketch": []}
        for text, hashes in zip(texts, shingle_sets(texts, words)):
            order = np.lexsort((hashes, counts.value[_group(hashes)]))[: prefix_length(len(hashes), similarity)]
            out["bits"].append(simhash.signed(simhash.fingerprint(text, words)))
            out["same"].append(simhash.signed(xxhash.xxh64_intdigest(hashes.tobytes())))
            out["size"].append(len(hashes))
            out["prefix"].append(hashes[order].view(np.int64))
            out["sketch"].append(parity(hashes))
        lists = pa.list_(pa.int64())
        types = {"bits": pa.int64(), "same": pa.int64(), "size": pa.int32(), "prefix": lists, "sketch": lists}
        return {name: pa.array(values, types[name]) for name, values in out.items()}

    return map_texts(docs, "bits long, same long, size int, prefix array<long>, sketch array<long>", score, keep)


def nodes_of(rows: DataFrame, key: str) -> DataFrame:
    """(node, bits, same, size, prefix, sketch), staged: equal sets with equal fingerprints are one node, their smallest key."""
    least = F.min(F.struct(key, "size", "prefix", "sketch")).alias("least")
    nodes = rows.where("size > 0").groupBy("bits", "same").agg(least)
    return stage(nodes.select(F.col(f"least.{key}").alias("node"), "bits", "same", "least.size", "least.prefix", "least.sketch"), "nodes")


def shared_shingles(nodes: DataFrame) -> DataFrame:
    """(shingle, place, node, bits, same, size): prefixes with the shingles that two nodes hold, staged."""
    put = nodes.select("node", F.posexplode("prefix").alias("place", "shingle"))
    repeated = put.groupBy("shingle").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("shingle")
    met = put.join(stage(repeated, "repeated"), "shingle", "left_semi")
    return stage(met.join(nodes.select("node", "bits", "same", "size"), "node"), "shared")


def _least_shared(a: Column, b: Column, similarity: float) -> Column:
    """Elements that sets of these sizes share if they overlap enough."""
    return F.ceil((a + b) * (similarity / (1 + similarity)) - F.lit(1e-9))


def _possible(similarity: float) -> Column:
    """Whether sizes and places of a shared shingle allow the overlap, of sides a and b."""
    sizes = F.least("a_size", "b_size") >= F.greatest("a_size", "b_size") * similarity - 1e-9
    left = F.least(F.col("a_size") - F.col("a_place"), F.col("b_size") - F.col("b_place"))
    return sizes & (left >= _least_shared(F.col("a_size"), F.col("b_size"), similarity))


def _side(df: DataFrame, side: str, *more: str | Column) -> DataFrame:
    own = ("node", "bits", "same", "size", "place")
    return df.select(*more, *[F.col(c).alias(f"{side}_{c}") for c in own])


PAIR = tuple(f"{side}_{c}" for side in "ab" for c in ("node", "bits", "same", "size"))


def to_leaders(open_: DataFrame, similarity: float) -> tuple[DataFrame, DataFrame]:
    """(pairs, members with their leader): each set with the most central one of every shingle."""
    first = F.min(F.struct("place", "node", "bits", "same", "size")).alias("leader")
    leaders = open_.groupBy("shingle").agg(first).select("shingle", "leader.*")
    met = _side(open_, "a", "shingle").join(_side(leaders, "b", "shingle"), "shingle").where("a_node <> b_node")
    return met.where(_possible(similarity)).select(*PAIR).distinct(), met


def _size_group(size: Column) -> Column:
    return F.floor(F.log(size) / F.log(F.lit(SIZE_STEP))).cast("int")


def across(found: DataFrame, links: DataFrame, similarity: float) -> DataFrame:
    """Pairs of sets that ``links`` leave in different components, by shingle, size and place.

    The smaller set of a pair has the shared shingle among its first n - ceil(2 t / (1 + t) n) + 1, and the larger one
    names the sizes that its own place allows.  Of each shingle's largest component only the texts that meet another
    component are compared with it.
    """
    reached = connected_components(links, "a", "b").select(F.col("node").alias("bits"), F.col("component").alias("root"))
    rooted = found.join(stage(reached, "reached"), "bits", "left").withColumn("root", F.coalesce("root", "bits"))
    rooted = stage(rooted, "rooted")
    roots = rooted.groupBy("shingle", "root").agg(F.count(F.lit(1)).alias("n"))
    mixed = roots.groupBy("shingle").agg(F.max_by("root", F.struct("n", "root")).alias("major"), F.count(F.lit(1)).alias("roots"))
    mixed = stage(mixed.where("roots > 1").select("shingle", "major"), "mixed")
    open_ = stage(rooted.join(mixed, "shingle").withColumn("minor", F.col("root") != F.col("major")), "open")
    size, left = F.col("size"), F.col("size") - F.col("place")
    small = open_.where(left >= _least_shared(size, size, similarity)).withColumn("g", _size_group(size))
    # sizes that a smaller partner may have: t n at least, and such that the rest of this set can hold what they share
    most = F.least(size.cast("double"), left * ((1 + similarity) / similarity) - size + 1e-6)
    least = F.greatest(F.lit(1.0), size * similarity - 1e-6)
    cells = small.groupBy("shingle", "g").agg(F.max("minor").alias("any_minor"))
    large = open_.where(most >= least).join(stage(cells, "cells"), "shingle")
    large = large.where(F.col("g").between(_size_group(least), _size_group(most)) & (F.col("minor") | F.col("any_minor")))
    keys = ["shingle", "g"]
    a = _side(small, "a", *keys, F.col("root").alias("a_root"), F.col("minor").alias("a_minor"))
    b = _side(large, "b", *keys, F.col("root").alias("b_root"), F.col("minor").alias("b_minor"))
    # joined in two parts, so that texts of the largest component are never paired with one another; hot cells are split by AQE
    one = a.where("a_minor").join(b, keys).where("a_root <> b_root")
    two = a.where("NOT a_minor").join(b.where("b_minor"), keys).where("a_root <> b_root")
    pairs = one.unionByName(two).where(_possible(similarity))
    smaller = F.col("a_node") < F.col("b_node")
    turned = [F.when(smaller, F.col(c)).otherwise(F.col(("b" if c[0] == "a" else "a") + c[1:])).alias(c) for c in PAIR]
    return pairs.select(*turned).distinct()


def texts_of(pairs: DataFrame, docs: DataFrame, key: str) -> DataFrame:
    """(node, t): whole texts of the nodes of some pairs, staged."""
    wanted = pairs.select(F.col("a_node").alias("node")).union(pairs.select(F.col("b_node").alias("node"))).distinct()
    wanted = stage(wanted, "wanted")
    ids = F.broadcast(wanted) if wanted.count() <= FEW_IDS else wanted
    return stage(docs.select(F.col(key).alias("node"), F.col("text").alias("t")).join(ids, "node", "left_semi"), "node_texts")


def likely(pairs: DataFrame, nodes: DataFrame, similarity: float) -> DataFrame:
    """Pairs of different sets whose sketches allow the overlap, staged."""
    sketches = nodes.select("node", "sketch")
    both = pairs.where("a_same <> b_same")
    for side in "ab":
        both = both.join(sketches.select(F.col("node").alias(f"{side}_node"), F.col("sketch").alias(f"{side}_sketch")), f"{side}_node")
    bits = F.zip_with("a_sketch", "b_sketch", lambda x, y: F.bit_count(x.bitwiseXOR(y)))
    different = F.aggregate(bits, F.lit(0), lambda n, x: n + x)
    allowed = F.col("a_size") + F.col("b_size") - 2 * _least_shared(F.col("a_size"), F.col("b_size"), similarity)
    return stage(both.where(different <= allowed).select("a_node", "a_bits", "b_node", "b_bits"), "likely")


def verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, key: str, words: int, similarity: float) -> DataFrame:
    """(a, b), as fingerprints: pairs whose whole sets overlap enough, staged.  Equal sets need no look."""
    pairs = stage(pairs, "pairs")
    other = likely(pairs, nodes, similarity)
    texts = texts_of(other, docs, key)
    both = other.join(texts.select(F.col("node").alias("a_node"), F.col("t").alias("a_text")), "a_node")
    both = both.join(texts.select(F.col("node").alias("b_node"), F.col("t").alias("b_text")), "b_node")

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in slices(batches, 2) for part in slices(iter([whole]), 3)):
            a_bits, b_bits, a_texts, b_texts = batch.columns
            a_sets, b_sets = (shingle_sets(side.to_pylist(), words) for side in (a_texts, b_texts))
            kept = pa.array([overlap(a, b) >= similarity for a, b in zip(a_sets, b_sets)], pa.bool_())
            yield pa.RecordBatch.from_arrays([a_bits.filter(kept), b_bits.filter(kept)], names=["a", "b"])

    decided = both.select("a_bits", "b_bits", "a_text", "b_text").mapInArrow(decide, "a long, b long")
    equal = pairs.where("a_same = b_same").select(F.col("a_bits").alias("a"), F.col("b_bits").alias("b"))
    with _small_batches(docs.sparkSession):
        return stage(decided.unionByName(equal).where("a <> b").distinct(), "overlap_links")


@contextmanager
def _small_batches(spark: SparkSession) -> Iterator[None]:
    """Rows with two texts each go to Python PAIRS_AT_ONCE at a time, which bounds what a task holds."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(PAIRS_AT_ONCE))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def components(
    docs: DataFrame, key: str, keep: tuple[str, ...] = (), words: int = WORDS, similarity: float = SIMILARITY
) -> DataFrame:
    """``key`` and ``keep`` plus fingerprint and component_id (the smallest key that links can reach).

    Texts are linked if their fingerprints differ in four bits or fewer, or if their sets of shingles overlap by
    ``similarity`` or more.  ``key`` must be unique and not null, such as a row number.  Null texts and texts
    without a word share one component; columns named like results are replaced.
    """
    docs = without(docs, *INTERNAL)
    keep = tuple(dict.fromkeys((key, *keep)))
    rows = stage(signatures(docs, keep, words, similarity), "signatures")
    links = stage(simhash.fingerprint_links(rows.select("bits").distinct()), "fingerprint_links")
    nodes = nodes_of(rows, key)
    found = shared_shingles(nodes)
    decided = lambda pairs: verified(pairs, nodes, docs, key, words, similarity)
    open_ = found
    for _ in range(LEADERS):
        pairs, met = to_leaders(open_, similarity)
        new = decided(pairs)
        links = links.unionByName(new)
        # those that are not linked to their leader directly get another one
        linked = (F.col("a_bits") == F.col("a")) & (F.col("b_bits") == F.col("b"))
        apart = met.where("a_bits <> b_bits").join(new, linked, "left_anti")
        open_ = stage(apart.select("shingle", *[F.col(f"a_{c}").alias(c) for c in ("node", "bits", "same", "size", "place")]), "apart")
    links = links.unionByName(decided(across(found, links, similarity)))
    return simhash.name_components(rows, key, keep, links)
