"""Corpus pipeline: five stages over ``documents``, each written as Parquet and read again by the next.

Every stage takes (spark, docs, sf_dir).  All but the last return the columns of ``docs``; rows keep
their values.  Stages work on whatever rows they get: null or repeated ids, null or empty texts, an
empty table.  Rows are told apart by their place in the table, not by their id.  Columns beyond those of
``documents`` may have any name: the stages work on them under names of their own.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tablewright.functions.staging import remove, scratch, stage
from tablewright.llm import bpe, decontaminate, hosts, language, overlap, sharding
from tablewright.llm.queries import table, vocabulary_path

#: A document whose language has a lower posterior than this is rejected.
MIN_LANGUAGE_SCORE = 0.5
ROW = "row_of_stage"


#: Columns that the stages look at; all others are carried along.
OWN = ("doc_id", "text", "lang", "source", "n_chars")


def _renamed(docs: DataFrame) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """``docs`` with neutral names for all other columns, and what gives them their names back."""
    inner = [c if c in OWN and docs.columns.index(c) == i else f"column_{i}_of_docs" for i, c in enumerate(docs.columns)]
    return docs.toDF(*inner), lambda out: out.select(*inner).toDF(*docs.columns)


def _left_out(numbered: DataFrame, dropped: DataFrame) -> DataFrame:
    """Rows whose number is not in ``dropped``."""
    return numbered.join(stage(dropped.distinct(), "dropped"), ROW, "left_anti")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that pass the base rules and come from an accepted host."""
    inner, named = _renamed(docs)
    return named(hosts.judge(inner, "source", tuple(inner.columns)).where("kept"))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text has letters and a clear language; all rows with a language teach."""
    inner, named = _renamed(docs)
    predicted = language.predict(inner, language.train(inner), tuple(inner.columns))
    clear = (F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= MIN_LANGUAGE_SCORE)
    return named(predicted.where(clear))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first row, by place in the table, of each group of near copies: fingerprints of five-word shingles
    within 4 bits, or an overlap of those shingles of 0.8 or more."""
    inner, named = _renamed(docs)
    numbered, _ = sharding.row_numbers(inner, ROW)
    grouped = overlap.components(numbered, ROW)
    return named(_left_out(numbered, grouped.where(F.col(ROW) != F.col("component_id")).select(ROW)))


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold no benchmark item."""
    inner, named = _renamed(docs)
    numbered, _ = sharding.row_numbers(inner, ROW)
    leaked = decontaminate.contaminated(numbered, table(spark, sf_dir, "benchmark"), ROW)
    return named(_left_out(numbered, leaked.select(ROW)))


def bpe_codec(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All columns but the text, plus token ids and the digests of ids and decoded text.

    A column of ``docs`` with the name of a result is replaced by it.
    """
    inner, _ = _renamed(docs)
    kept = {c: old for c, old in zip(inner.columns, docs.columns) if c != "text"}
    encoded = bpe.encoded(inner, vocabulary_path(), tuple(kept))
    results = [c for c in encoded.columns if c not in kept]
    taken = {c.lower() for c in results}
    return encoded.select(*[F.col(c).alias(old) for c, old in kept.items() if old.lower() not in taken], *results)


STAGES = [
    ("quality_rules", quality_rules),
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("benchmark_decontamination", benchmark_decontamination),
    ("bpe_codec", bpe_codec),
]

#: Language models, fingerprints and byte-pair merges are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows.  What a stage has staged is removed when its result is written."""
    docs = table(spark, sf_dir, "documents")
    before = None
    for name, step in STAGES:
        with scratch(spark) as made:
            docs = stage(step(spark, docs, sf_dir), name)
            result = made.pop()  # the folder made last
        if before:
            remove(spark, before)
        before = result
    return docs
