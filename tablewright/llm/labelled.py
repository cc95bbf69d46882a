"""A bounded sample of labelled documents for the classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.staging import stage
from .texts import id_text, split_number


def labelled_sample(
    docs: DataFrame, labels: DataFrame, label: str, modulus: int, held: int, per_class: int
) -> DataFrame:
    """(doc_id, y, text) of at most ``per_class`` documents of each class, staged.

    Only rows whose crc32(id) mod ``modulus`` is not ``held`` take part, the ids with the smallest hash
    first.  The chosen ids are at most 2 x per_class rows, which bounds the broadcast.  An id that
    occurs more than once (in either table) counts once, with its smallest label and text.
    """
    ids = (
        labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & (split_number(modulus) != held))
        .groupBy("doc_id")
        .agg(F.min(label).cast("int").alias("y"))
        .withColumn("order", F.xxhash64(id_text(), F.lit("labels")))
    )
    chosen = None
    for y in (0, 1):
        part = ids.where(F.col("y") == y).orderBy("order", "doc_id").limit(per_class).select("doc_id", "y")
        chosen = part if chosen is None else chosen.union(part)
    chosen = stage(chosen, "labels")
    texts = docs.where(F.col("text").isNotNull()).select("doc_id", "text")
    found = texts.join(F.broadcast(chosen), "doc_id")
    return stage(found.groupBy("doc_id").agg(F.min("y").alias("y"), F.min("text").alias("text")), "labelled")
