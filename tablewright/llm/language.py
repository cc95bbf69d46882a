"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from .texts import flat_chunks, map_texts, ngrams, per_text, slices, split_number, sum_by_index, without

ORDERS = (2, 3)
BUCKETS = 1 << 16
#: Bound of the training sample: about this many documents of each language, chosen by a hash of the id.
DOCS_PER_LANGUAGE = 4_000
SMOOTHING = 0.5
UNKNOWN = "und"
#: Most languages of a model, the most frequent ones (64 MB of probabilities); labels beyond are dirt.
MAX_LANGUAGES = 256
_LETTER = regex.compile(r"\p{L}")


@dataclass
class LanguageModel:
    """languages in order; log_probs[language, bucket]; log_priors[language]."""

    languages: list[str]
    log_probs: np.ndarray
    log_priors: np.ndarray


def _sample(docs: DataFrame, per_language: int) -> tuple[DataFrame, dict[str, int]]:
    frequent = docs.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(MAX_LANGUAGES)
    counts = {r["lang"]: r["n"] for r in frequent.collect()}
    share = F.lit(0)
    for lang, n in counts.items():
        share = F.when(F.col("lang") == lang, F.lit(min(1 << 20, (per_language << 20) // n))).otherwise(share)
    return docs.where(F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("sample")), F.lit(1 << 20)) < share), counts


def train(docs: DataFrame, per_language: int = DOCS_PER_LANGUAGE, buckets: int = BUCKETS) -> LanguageModel:
    """Learn from ``docs`` (doc_id, text, lang); rows with a null lang teach nothing.

    n-gram counts are summed in Spark and come to the driver as languages x buckets numbers at most.
    Priors come from all rows.  No row with a language gives a model that knows none.
    """
    known = docs.where("lang IS NOT NULL").select("doc_id", "text", "lang")
    sample, counts = _sample(known, per_language)
    languages = sorted(counts)
    place = {lang: i for i, lang in enumerate(languages)}

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in slices(batches):
            langs, texts = batch.column("lang").to_pylist(), batch.column("text").to_pylist()
            for lang in set(langs):
                own = [t for t, x in zip(texts, langs, strict=True) if x == lang]
                total = totals.setdefault(place[lang], np.zeros(buckets, np.int64))
                for flat in flat_chunks(own):
                    for n in ORDERS:
                        h, ok = ngrams(flat, n, buckets)
                        total += np.bincount(h[ok], minlength=buckets)
        for lang, total in totals.items():
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_pydict(
                {
                    "lang": pa.array(np.full(len(at), lang), pa.int32()),
                    "slot": pa.array(at, pa.int32()),
                    "value": pa.array(total[at], pa.float64()),
                }
            )

    grams = np.zeros((len(languages), buckets))
    if languages:
        found = sum_by_index(sample, gather, "lang int, slot int").toPandas()
        grams[found["lang"], found["slot"]] = found["value"]
    probs = np.log((grams + SMOOTHING) / (grams.sum(axis=1, keepdims=True) + SMOOTHING * buckets))
    totals = np.array([counts[x] for x in languages], float)
    priors = np.log(totals / totals.sum()) if languages else totals
    return LanguageModel(languages, probs.astype(np.float32), priors)


def predict(docs: DataFrame, model: LanguageModel, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` plus lang_pred and score, the posterior probability of the language.

    A text that is null or has no letter is ``und`` with score 0, as is every text when the model
    knows no language.  Equal posteriors go to the first language by name.  Columns of ``docs``
    named lang_pred or score are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(texts: list[str | None]) -> dict:
        own = shared.value
        usable = [t if t and own.languages and _LETTER.search(t) else None for t in texts]
        log = np.tile(own.log_priors, (len(texts), 1))
        for flat in flat_chunks(usable):
            for n in ORDERS:
                h, ok = ngrams(flat, n, own.log_probs.shape[1])
                for k in range(len(own.languages)):
                    values = own.log_probs[k][h]
                    values *= ok
                    column = np.zeros(len(texts))
                    per_text(flat, values, column)
                    log[:, k] += column
        if own.languages:
            best = log.argmax(axis=1)
            posterior = 1.0 / np.exp(log - log.max(axis=1, keepdims=True)).sum(axis=1)
        else:
            best = posterior = [0] * len(texts)
        return {
            "lang_pred": [own.languages[b] if t is not None else UNKNOWN for b, t in zip(best, usable, strict=True)],
            "score": [float(p) if t is not None else 0.0 for p, t in zip(posterior, usable, strict=True)],
        }

    docs = without(docs, "lang_pred", "score")
    return map_texts(docs, "lang_pred string, score double", score, keep)


def held_out_predictions(docs: DataFrame, modulus: int = 5) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row; trained on the rows that are not held out.

    Held out: crc32 of the id as text is divisible by ``modulus`` (a null id counts as empty text,
    so it is held out).  Repeated rows are predicted each by itself.
    """
    model = train(docs.where(split_number(modulus) != 0))
    marked = without(docs, "held_out").withColumn("held_out", split_number(modulus) == 0)
    return predict(marked, model, ("doc_id", "held_out"))
