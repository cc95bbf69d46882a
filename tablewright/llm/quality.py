"""Quality classifier: learned word and n-gram vectors averaged per document, softmax output."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .labelled import labelled_sample
from .texts import Flat, flat_chunks, map_texts, ngrams, per_text_at, slices, split_number, without
from .texts import word_hashes, word_spans

ORDERS = (3, 4)
BUCKETS = 1 << 17
DIMENSIONS = 8
#: Bound of the training sample, per class.
ROWS_PER_CLASS = 2_000
EPOCHS = 6
RATE = 0.5
CLASSES = 2


@dataclass
class QualityModel:
    """vectors[bucket, dimension]; output[dimension, class]; bias[class]."""

    vectors: np.ndarray
    output: np.ndarray
    bias: np.ndarray


def tokens(flat: Flat, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(positions, buckets) of the words, of the marks of repeated words, and of the n-grams.

    A word equal to the one before it in the text adds one common mark, as a word pair feature that
    all repetitions share.
    """
    starts, ends = word_spans(flat)
    h = word_hashes(flat, starts, ends)
    yield starts, (h >> np.uint64(40)).astype(np.int64) & (buckets - 1)
    piece = np.searchsorted(flat.starts, starts, side="right")
    again = np.flatnonzero((h[1:] == h[:-1]) & (piece[1:] == piece[:-1])) + 1
    yield starts[again], np.zeros(len(again), np.int64)
    for n in ORDERS:
        bucket, ok = ngrams(flat, n, buckets)
        at = np.flatnonzero(ok)
        yield at, bucket[at].astype(np.int64)


def _features(sample: DataFrame, buckets: int) -> DataFrame:
    """(y, slots, times): each sampled document's distinct buckets and their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            slots, times = [], []
            for text in batch.column("text").to_pylist():
                total = np.zeros(buckets, np.int64)
                for flat in flat_chunks([text]):
                    for _, bucket in tokens(flat, buckets):
                        total += np.bincount(bucket, minlength=buckets)
                at = np.flatnonzero(total)
                slots.append(at.astype("<i4").tobytes())
                times.append(total[at].astype("<f4").tobytes())
            yield pa.RecordBatch.from_pydict(
                {"y": batch.column("y"), "slots": pa.array(slots, pa.binary()), "times": pa.array(times, pa.binary())}
            )

    return sample.select("y", "text").mapInArrow(run, "y int, slots binary, times binary")


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def train_vectors(rows: list[tuple[int, np.ndarray, np.ndarray]], buckets: int = BUCKETS) -> QualityModel:
    """Stochastic gradient descent, one document a step, in a fixed order with a falling rate."""
    rng = np.random.default_rng(7)
    vectors = rng.uniform(-1 / DIMENSIONS, 1 / DIMENSIONS, (buckets, DIMENSIONS)).astype(np.float32)
    output = np.zeros((DIMENSIONS, CLASSES), np.float32)
    bias = np.zeros(CLASSES, np.float32)
    steps, step = EPOCHS * len(rows), 0
    for _ in range(EPOCHS):
        for i in rng.permutation(len(rows)):
            y, slots, times = rows[i]
            share = times / times.sum() if len(times) else times
            hidden = share @ vectors[slots]
            error = softmax(hidden @ output + bias)
            error[y] -= 1
            rate = RATE * (1 - step / steps)
            back = output @ error
            output -= rate * np.outer(hidden, error)
            bias -= 0.1 * rate * error
            # a document's mean hides the single vector's share; the vectors step by the whole error
            vectors[slots] -= (10 * rate * share)[:, None] * back
            step += 1
    return QualityModel(vectors, output, bias)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", modulus: int = 3, held: int = 1) -> QualityModel:
    """Learn from a bounded labelled sample; with labels of one class or none the score is constant."""
    sample = labelled_sample(docs, labels, label, modulus, held, ROWS_PER_CLASS)
    got = _features(sample, BUCKETS).toPandas().sort_values(["y", "slots", "times"])
    rows = [
        (int(y), np.frombuffer(s, "<i4"), np.frombuffer(t, "<f4"))
        for y, s, t in zip(got["y"], got["slots"], got["times"], strict=True)
    ]
    if len({r[0] for r in rows}) < CLASSES:
        bias = np.array([0.0, 4.0 * (2 * rows[0][0] - 1) if rows else 0.0], np.float32)
        return QualityModel(np.zeros((BUCKETS, DIMENSIONS), np.float32), np.zeros((DIMENSIONS, CLASSES), np.float32), bias)
    return train_vectors(rows)


def score(docs: DataFrame, model: QualityModel, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` plus score (probability of label 1) and predicted (score >= 0.5) for every row.

    The mean of vectors times the output weights is the mean of each vector's own product, so the
    products are formed once and a document sums scalars.  A null or blank text has no vector: its
    hidden mean is zero and the output bias decides.  Columns named score or predicted are replaced.
    """
    gap = (model.vectors @ (model.output[:, 1] - model.output[:, 0])).astype(np.float32)
    shared = docs.sparkSession.sparkContext.broadcast((gap, float(model.bias[1] - model.bias[0])))

    def run(texts: list[str | None]) -> dict:
        products, bias = shared.value
        total, number = np.zeros(len(texts)), np.zeros(len(texts))
        for flat in flat_chunks(texts):
            for at, bucket in tokens(flat, len(products)):
                per_text_at(flat, at, products[bucket], total)
                per_text_at(flat, at, np.ones(len(at)), number)
        z = total / np.maximum(number, 1) + bias
        p = 1 / (1 + np.exp(-np.clip(z, -60, 60)))
        return {"score": p, "predicted": (p >= 0.5).astype(np.int32)}

    return map_texts(without(docs, "score", "predicted"), "score double, predicted int", run, keep)


def held_out_scores(docs: DataFrame, labels: DataFrame, modulus: int = 3, held: int = 1) -> DataFrame:
    """doc_id, held_out, score, predicted for every row; learned from rows that are not held out."""
    model = fit(docs, labels, "quality", modulus, held)
    marked = without(docs, "held_out").withColumn("held_out", split_number(modulus) == held)
    return score(marked, model, ("doc_id", "held_out"))
