"""LM scoring by masked pseudo-likelihood: every word is predicted from both its sides.

P(word | both sides) = P(class | both sides) * P(word | class): a window network predicts the class, and the
exact counts of all words of the corpus, a Spark table that grows with it, give each word's share of its class.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..functions.staging import stage
from .texts import Flat, flat_chunks, map_texts, slices, sum_by_index, without, word_hashes, word_spans

#: Words are hashed to slots; the most frequent slots of the corpus are classes of their own, the others share.
SLOTS = 1 << 16
OWN, SHARED = 224, 32
TOKENS = OWN + SHARED
PAD = TOKENS
OFFSETS = (-2, -1, 1, 2)
DIMENSIONS = 16
#: Words are dealt to MASK_EVERY parts by hash and place; the rounds share all parts, so each word is masked and learned from once.
MASK_EVERY = 8
ROUNDS = 2
#: Words that a task counts before it hands them on.
GATHER = 1 << 21
#: The most frequent words, whose counts every task has at hand; the counts of all others are joined.
HEAD = 1 << 16
BATCH = 512
RATE = 0.05


@dataclass
class WindowModel:
    """token_of[slot]; inputs[offset, token, dimension]; hidden[dimension]; output[token, dimension]; bias[token]."""

    token_of: np.ndarray
    inputs: np.ndarray
    hidden: np.ndarray
    output: np.ndarray
    bias: np.ndarray

    def parameters(self) -> list[np.ndarray]:
        return [self.inputs, self.hidden, self.output, self.bias]


def _words(flat: Flat) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, piece it stands in)."""
    starts, ends = word_spans(flat)
    return word_hashes(flat, starts, ends), np.searchsorted(flat.starts, starts, side="right") - 1


def _slots(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(44)).astype(np.int64) & (SLOTS - 1)


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n): occurrences of every word, by its 64-bit hash, in all documents."""

    def emit(held: list[np.ndarray]) -> pa.RecordBatch:
        word, n = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_pydict({"word": pa.array(word.view(np.int64)), "n": pa.array(n, pa.int64())})

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in slices(batches):
            for flat in flat_chunks(batch.column("text").to_pylist()):
                held.append(_words(flat)[0])
                size += len(held[-1])
                if size >= GATHER:
                    yield emit(held)
                    held, size = [], 0
        if size:
            yield emit(held)

    return docs.select("text").mapInArrow(gather, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _by_slot(words: DataFrame) -> np.ndarray:
    slot = F.shiftright("word", 44).bitwiseAND(F.lit(SLOTS - 1)).cast("int")
    found = words.groupBy(slot.alias("slot")).agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(SLOTS)
    counts[found["slot"]] = found["n"]
    return counts


def slot_counts(docs: DataFrame) -> np.ndarray:
    """Occurrences of each word slot in all documents."""
    return _by_slot(word_counts(docs))


def vocabulary(counts: np.ndarray) -> np.ndarray:
    token_of = OWN + np.arange(SLOTS) % SHARED
    top = np.argsort(-counts, kind="stable")[:OWN]
    token_of[top] = np.arange(len(top))
    return token_of.astype(np.int32)


def contexts(tokens: np.ndarray, piece: np.ndarray) -> np.ndarray:
    """[offset, place]: the token at each offset of each place, PAD beyond its own text."""
    reach = max(map(abs, OFFSETS))
    wide = np.full(len(tokens) + 2 * reach, PAD, np.int64)
    wide[reach : reach + len(tokens)] = tokens
    owner = np.full(len(wide), -1, np.int64)
    owner[reach : reach + len(tokens)] = piece
    out = np.empty((len(OFFSETS), len(tokens)), np.int64)
    for k, o in enumerate(OFFSETS):
        at = slice(reach + o, reach + o + len(tokens))
        out[k] = np.where(owner[at] == piece, wide[at], PAD)
    return out


def _hidden(model: WindowModel, around: np.ndarray) -> np.ndarray:
    total = model.hidden + model.inputs[0].take(around[0], axis=0)
    for k in range(1, len(OFFSETS)):
        total += model.inputs[k].take(around[k], axis=0)
    return np.tanh(total)


def log_probs(model: WindowModel, tokens: np.ndarray, piece: np.ndarray, block: int = 1 << 9) -> np.ndarray:
    """log P(token | both sides) of every place."""
    around = contexts(tokens, piece)
    out, every = np.empty(len(tokens), np.float32), np.ones(TOKENS, np.float32)
    for at in range(0, len(tokens), block):
        z = _hidden(model, around[:, at : at + block]) @ model.output.T
        z += model.bias
        own = z[np.arange(len(z)), tokens[at : at + block]]
        top = z.max(axis=1)
        z -= top[:, None]
        out[at : at + block] = own - top - np.log(np.exp(z, out=z) @ every)
    return out


def start(token_of: np.ndarray, counts: np.ndarray) -> WindowModel:
    """Small fixed random vectors, and the corpus's own token frequencies as output bias."""
    rng = np.random.default_rng(11)
    share = np.bincount(token_of, weights=counts, minlength=TOKENS) + 1.0
    near = lambda *shape: rng.normal(0, 0.1, shape).astype(np.float32)
    bias = np.log(share / share.sum()).astype(np.float32)
    return WindowModel(token_of, near(len(OFFSETS), TOKENS + 1, DIMENSIONS), near(DIMENSIONS), near(TOKENS, DIMENSIONS), bias)


def learn(model: WindowModel, tokens: np.ndarray, around: np.ndarray, seen: list[np.ndarray]) -> None:
    """One pass of stochastic gradient descent (Adagrad) over the masked places, in place."""
    rows, every = np.arange(len(OFFSETS))[:, None] * (TOKENS + 1), np.ones(TOKENS, np.float32)
    for at in range(0, len(tokens), BATCH):
        t, c = tokens[at : at + BATCH], around[:, at : at + BATCH]
        h = _hidden(model, c)
        error = h @ model.output.T
        error += model.bias
        error -= error.max(axis=1, keepdims=True)
        np.exp(error, out=error)
        error *= 1 / ((error @ every)[:, None] * len(t))
        error[np.arange(len(t)), t] -= 1 / len(t)
        back = (error @ model.output) * (1 - h * h)
        place = (c + rows)[:, :, None] * DIMENSIONS + np.arange(DIMENSIONS)
        weights = np.broadcast_to(back, place.shape).ravel()
        sums = np.bincount(place.ravel(), weights=weights, minlength=model.inputs.size)
        ones = np.ones(len(t), np.float32)
        grads = [sums.reshape(model.inputs.shape).astype(np.float32), ones @ back, error.T @ h, ones @ error]
        for p, g, s in zip(model.parameters(), grads, seen, strict=True):
            s += g * g
            p -= RATE * g / np.sqrt(s)


def masked_places(h: np.ndarray, piece: np.ndarray, turn: int, rounds: int) -> np.ndarray:
    """The places learned from in a round: of any ``rounds`` up to MASK_EVERY, each place has one."""
    place = np.arange(len(h)) - np.searchsorted(piece, piece)
    mixed = (h ^ (place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))) >> np.uint64(32)
    share = min(rounds, MASK_EVERY)
    return np.flatnonzero(mixed % np.uint64(MASK_EVERY) % np.uint64(share) == turn % share)


def _round(docs: DataFrame, model: WindowModel, turn: int, rounds: int) -> WindowModel:
    """Every task trains a copy on the masked words of its own documents; the copies are averaged.

    Copies weigh as the words they learned from.  Weighted parameters are summed in Spark by place,
    combined in each task first, so only one model comes to the driver.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    size = sum(p.size for p in model.parameters())

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = shared.value
        own = WindowModel(base.token_of, *[p.copy() for p in base.parameters()])
        seen = [np.full_like(p, 1e-6) for p in own.parameters()]
        learned = 0
        for batch in slices(batches):
            for flat in flat_chunks(batch.column("text").to_pylist()):
                h, piece = _words(flat)
                tokens = own.token_of[_slots(h)].astype(np.int64)
                masked = masked_places(h, piece, turn, rounds)
                learn(own, tokens[masked], contexts(tokens, piece)[:, masked], seen)
                learned += len(masked)
        if learned:
            flat_values = np.concatenate([p.ravel() for p in own.parameters()]).astype(float) * learned
            values = np.append(flat_values, learned)
            yield pa.RecordBatch.from_pydict(
                {"slot": pa.array(np.arange(size + 1), pa.int32()), "value": pa.array(values)}
            )

    found = sum_by_index(docs.select("text"), gather).toPandas()
    if not len(found):
        return model
    total = np.zeros(size + 1)
    total[found["slot"]] = found["value"]
    mean, at, parts = (total[:-1] / total[-1]).astype(np.float32), 0, []
    for p in model.parameters():
        parts.append(mean[at : at + p.size].reshape(p.shape))
        at += p.size
    return WindowModel(model.token_of, *parts)


def train(docs: DataFrame, rounds: int = ROUNDS) -> tuple[WindowModel, DataFrame]:
    """The network of classes, trained in rounds over all documents, and the counts of all their words."""
    words = stage(word_counts(docs), "words")
    counts = _by_slot(words)
    model = start(vocabulary(counts), counts)
    for turn in range(rounds):
        model = _round(docs, model, turn, rounds)
    return model, words


def score(docs: DataFrame, model: WindowModel, words: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` plus n_tokens, log_likelihood (the sum of conditional log-probabilities) and mean_log_prob.

    A word that occurs n times has the share n / (N + 1) of its class of N words; one that ``words`` doesn't
    have is scored as the unseen word, 1 / (N + 1).  The log of n comes from the head or, for all other words
    of two or more occurrences, from a join; for one occurrence it is 0.  A null or blank text has no token:
    log_likelihood 0 and mean_log_prob null.  Repeated rows are scored each.  Columns of ``docs`` named like
    results are replaced.
    """
    head = words.orderBy(F.desc("n"), "word").limit(HEAD).toPandas().sort_values("word")
    known, log_n = head["word"].to_numpy(np.int64), np.log(head["n"].to_numpy(float))
    sizes = np.bincount(model.token_of, weights=_by_slot(words), minlength=TOKENS)
    shared = docs.sparkSession.sparkContext.broadcast((model, known, log_n, np.log(sizes + 1)))

    def run(texts: list[str | None]) -> dict:
        own, known, log_n, log_size = shared.value
        total, number, left = np.zeros(len(texts)), np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
        rest = [np.zeros(0, np.int64)]
        for flat in flat_chunks(texts):
            h, piece = _words(flat)
            tokens = own.token_of[_slots(h)].astype(np.int64)
            owner = flat.owner[piece]
            values = log_probs(own, tokens, piece) - log_size[tokens]
            word = h.view(np.int64)
            if len(known):
                at = np.minimum(np.searchsorted(known, word), len(known) - 1)
                hit = known[at] == word
                values += np.where(hit, log_n[at], 0)
            else:
                hit = np.zeros(len(word), bool)
            rest.append(word[~hit])
            left += np.bincount(owner[~hit], minlength=len(texts))
            total += np.bincount(owner, weights=values, minlength=len(texts))
            number += np.bincount(owner, minlength=len(texts))
        ends = pa.array(np.append(0, np.cumsum(left)), pa.int32())
        lists = pa.ListArray.from_arrays(ends, pa.array(np.concatenate(rest)))
        return {"n_tokens": number, "log_likelihood": total, "rest_of_row": lists}

    plain = without(docs, "n_tokens", "log_likelihood", "mean_log_prob", "rest_of_row", "row_of_score")
    rows = map_texts(plain, "n_tokens long, log_likelihood double, rest_of_row array<long>", run, keep)
    rows = stage(rows.withColumn("row_of_score", F.monotonically_increasing_id()), "scored")
    tail = rows.select("row_of_score", F.explode("rest_of_row").alias("word")).join(words.where("n > 1"), "word")
    tail = tail.groupBy("row_of_score").agg(F.sum(F.log("n")).alias("log_n_of_rest"))
    whole = rows.drop("rest_of_row").join(tail, "row_of_score", "left")
    total = F.col("log_likelihood") + F.coalesce("log_n_of_rest", F.lit(0.0))
    mean = F.when(F.col("n_tokens") > 0, total / F.col("n_tokens"))
    return whole.select(*keep, "n_tokens", total.alias("log_likelihood"), mean.alias("mean_log_prob"))


def scored(docs: DataFrame) -> DataFrame:
    """doc_id, n_tokens, log_likelihood and mean_log_prob of every row under a model of the same rows."""
    return score(docs, *train(docs.select("text")))
