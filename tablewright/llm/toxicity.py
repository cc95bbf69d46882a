"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .labelled import labelled_sample
from .texts import Flat, flat_chunks, map_texts, ngrams, sigmoid, slices, split_number, sum_by_index, without

ORDERS = (4, 5, 6, 7)
BUCKETS = 1 << 18
#: Bound of the training sample, per class.
ROWS_PER_CLASS = 4_000
SMOOTHING = 1.0
#: Features the classifier is fitted on: of the n-grams whose log-count ratio is at least RATIO, those with
#: the largest likelihood-ratio statistic of presence against class, at least ASSOCIATION.
FEATURES = 1 << 12
RATIO = 1.0
ASSOCIATION = 14.0
EPOCHS = 200
RATE = 0.3
L1 = 3e-4


@dataclass
class ToxicityModel:
    """weights: classifier weight times log-count ratio for each bucket, 0 where it is not used."""

    weights: np.ndarray
    bias: float


def present(flat: Flat, texts: int, usable: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, bucket) among the n-grams whose bucket is marked in ``usable``."""
    keys = []
    for n in ORDERS:
        h, ok = ngrams(flat, n, buckets)
        ok &= usable[h]
        at = np.flatnonzero(ok)
        piece = np.searchsorted(flat.starts, at, side="right") - 1
        keys.append(flat.owner[piece] * buckets + h[at])
    key = np.unique(np.concatenate(keys))
    return key // buckets, key % buckets


def _presence(texts: list[str | None], usable: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same over whole texts, also those that take several chunks."""
    buckets = len(usable)
    found = [present(flat, len(texts), usable, buckets) for flat in flat_chunks(texts)]
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    key = np.unique(np.concatenate([d * buckets + b for d, b in found]))
    return key // buckets, key % buckets


def _class_counts(sample: DataFrame, buckets: int) -> np.ndarray:
    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, buckets), np.int64)
        every = np.ones(buckets, bool)
        for batch in slices(batches):
            y, texts = np.array(batch.column("y").to_pylist(), int), batch.column("text").to_pylist()
            for at in range(0, len(texts), 256):
                doc, bucket = _presence(texts[at : at + 256], every)
                own = y[at : at + 256][doc] == 1
                total[1] += np.bincount(bucket[own], minlength=buckets)
                total[0] += np.bincount(bucket[~own], minlength=buckets)
        for k in (0, 1):
            slot = np.flatnonzero(total[k])
            yield pa.RecordBatch.from_pydict(
                {
                    "y": pa.array(np.full(len(slot), k), pa.int32()),
                    "slot": pa.array(slot, pa.int32()),
                    "value": pa.array(total[k, slot], pa.float64()),
                }
            )

    found = sum_by_index(sample.select("y", "text"), gather, "y int, slot int").toPandas()
    counts = np.zeros((2, buckets))
    counts[found["y"], found["slot"]] = found["value"]
    return counts


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", modulus: int = 5, held: int = 0) -> ToxicityModel:
    """Fit on a bounded labelled sample.

    r = log of the smoothed class shares of each n-gram, by presence; logistic regression on r times
    presence, full-batch, in numpy.  The intercept is moved from the sample's class
    balance to that of all usable labels.  With labels of one class or none, the score is constant.
    """
    sample = labelled_sample(docs, labels, label, modulus, held, ROWS_PER_CLASS)
    usable = labels.where(F.col(label).isin(0, 1) & (split_number(modulus) != held))
    shares = {r[0]: r[1] for r in usable.groupBy(label).count().collect()}
    sizes = {r["y"]: r["count"] for r in sample.groupBy("y").count().collect()}
    if len(sizes) < 2:
        p = 0.5 if not shares else min(0.99, max(0.01, shares.get(1, 0) / sum(shares.values())))
        return ToxicityModel(np.zeros(BUCKETS, np.float32), float(np.log(p / (1 - p))))
    counts = _class_counts(sample, BUCKETS)
    ratio = np.log((counts[1] + SMOOTHING) / (sizes[1] + 2 * SMOOTHING)) - np.log(
        (counts[0] + SMOOTHING) / (sizes[0] + 2 * SMOOTHING)
    )
    strength = association(counts, np.array([sizes[0], sizes[1]], float))
    strength[np.abs(ratio) < RATIO] = 0
    chosen = np.sort(np.argsort(-strength, kind="stable")[:FEATURES])
    chosen = chosen[strength[chosen] >= ASSOCIATION]
    marked = np.zeros(BUCKETS, bool)
    marked[chosen] = True
    place = np.full(BUCKETS, -1, np.int32)
    place[chosen] = np.arange(len(chosen))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            y, texts = batch.column("y").to_pylist(), batch.column("text").to_pylist()
            for at in range(0, len(texts), 256):
                part = texts[at : at + 256]
                doc, bucket = _presence(part, marked)
                slots = np.split(place[bucket].astype("<u2"), np.searchsorted(doc, np.arange(1, len(part))))
                yield pa.RecordBatch.from_pydict(
                    {"y": pa.array(y[at : at + 256], pa.int32()), "slots": pa.array([s.tobytes() for s in slots])}
                )

    rows = sample.select("y", "text").mapInArrow(features, "y int, slots binary").toPandas()
    slots = [np.frombuffer(s, "<u2") for s in rows["slots"]]
    y = rows["y"].to_numpy(float)
    doc = np.repeat(np.arange(len(slots)), [len(s) for s in slots])
    slot = np.concatenate(slots).astype(np.int64)
    weights, bias = _regress(doc, slot, ratio[chosen], y)
    bias += np.log(shares[1] / shares[0]) - np.log(sizes[1] / sizes[0])
    table = np.zeros(BUCKETS, np.float32)
    table[chosen] = weights * ratio[chosen]
    return ToxicityModel(table, float(bias))


def association(counts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Likelihood-ratio statistic (G) of each n-gram's presence against the class."""
    total = 0.0
    share = sizes / sizes.sum()
    for seen in (counts, sizes[:, None] - counts):
        expected = seen.sum(axis=0) * share[:, None]
        total = total + 2 * (seen * np.log(np.maximum(seen, 1e-12) / np.maximum(expected, 1e-12))).sum(axis=0)
    return total


def _regress(doc: np.ndarray, slot: np.ndarray, ratio: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """Logistic regression under an L1 penalty: proximal gradient steps with Adagrad sizes, from w = 0."""
    w, b = np.zeros(len(ratio)), 0.0
    seen_w, seen_b = np.full(len(ratio), 1e-6), 1e-6
    value = ratio[slot]
    for _ in range(EPOCHS):
        z = np.bincount(doc, weights=value * w[slot], minlength=len(y)) + b
        error = (sigmoid(z) - y) / len(y)
        g = np.bincount(slot, weights=value * error[doc], minlength=len(ratio))
        seen_w += g * g
        seen_b += error.sum() ** 2
        step = RATE / np.sqrt(seen_w)
        w -= step * g
        w = np.sign(w) * np.maximum(np.abs(w) - step * L1, 0)
        b -= RATE * error.sum() / np.sqrt(seen_b)
    return w, b


def score(docs: DataFrame, model: ToxicityModel, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` plus score in 0..1 and predicted for every row (score >= 0.5).

    A null or empty text has no n-gram: its score is that of the intercept.  Columns of ``docs`` named
    score or predicted are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(texts: list[str | None]) -> dict:
        own = shared.value
        doc, bucket = _presence(texts, own.weights != 0)
        z = np.bincount(doc, weights=own.weights[bucket], minlength=len(texts)) + own.bias
        p = sigmoid(z)
        return {"score": p, "predicted": (p >= 0.5).astype(np.int32)}

    return map_texts(without(docs, "score", "predicted"), "score double, predicted int", run, keep)


def held_out_scores(docs: DataFrame, labels: DataFrame, modulus: int = 5, held: int = 0) -> DataFrame:
    """doc_id, held_out, score, predicted for every row; learned from rows that are not held out."""
    model = fit(docs, labels, "toxic", modulus, held)
    marked = without(docs, "held_out").withColumn("held_out", split_number(modulus) == held)
    return score(marked, model, ("doc_id", "held_out"))
