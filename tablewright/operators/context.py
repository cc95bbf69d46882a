"""Rows as text, conversation histories, and nearest rows by embedding."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..functions.blocks import ROW, block_join, matrix, numbered, same_width
from ..functions.columns import column, quoted
from ..functions.groups import first_per_group

# Wording of the text context.
CONTEXT_HEADER = "Les données suivantes proviennent du fichier Excel : {name}."
CONTEXT_COLUMNS = "Colonnes : {columns}."
CONTEXT_INTRO = "Voici un aperçu des lignes :"
CONTEXT_LINE = "Ligne %d : %s"
CONTEXT_UNNAMED = "fichier_sans_nom"

#: Rows and queries of a block, and queries of one matrix product (16 MB of scores).
ROWS_EACH, QUERIES_EACH, QUERIES_AT_ONCE = 32_768, 16_384, 64
DIGITS = 9


def rows_to_text(df: DataFrame, key: Sequence[str], name: str | None = None, max_rows: int = 50) -> DataFrame:
    """(line_no, line): three header lines, then ``column = value; ...`` for the first rows.

    Null cells are skipped and rows without any value dropped; the others keep their number.
    """
    spark = df.sparkSession
    head = df.orderBy(*[quoted(k) for k in key]).limit(max_rows)
    # at most max_rows rows are numbered here
    numbered = head.withColumn("__no", F.row_number().over(Window.orderBy(*[quoted(k) for k in key])))
    cells = [F.when(column(c).isNotNull(), F.concat(F.lit(f"{c} = "), column(c).cast("string"))) for c in df.columns]
    body = numbered.select(F.col("__no").alias("line_no"), F.concat_ws("; ", *cells).alias("cells")).where("cells <> ''")
    lines = body.select("line_no", F.format_string(CONTEXT_LINE, "line_no", "cells").alias("line"))
    intro = [
        (-2, CONTEXT_HEADER.format(name=name or CONTEXT_UNNAMED)),
        (-1, CONTEXT_COLUMNS.format(columns=", ".join(df.columns))),
        (0, CONTEXT_INTRO),
    ]
    return spark.createDataFrame(intro, "line_no int, line string").unionByName(lines).orderBy("line_no")


def append_turns(history: DataFrame, new: DataFrame, session: str = "conv_id", turn: str = "turn") -> DataFrame:
    """Add new messages after the last turn of their session.

    ``new`` has the session, ``role``, ``text`` and ``seq`` (order within the request, from 1).
    """
    last = history.groupBy(quoted(session)).agg(F.max(column(turn)).alias("__last"))
    placed = new.join(last, session, "left").withColumn(turn, F.coalesce(F.col("__last"), F.lit(-1)) + F.col("seq"))
    return history.unionByName(placed.select(*[quoted(c) for c in history.columns]))


def session_history(
    messages: DataFrame, n: int = 50, session: str = "conv_id", turn: str = "turn"
) -> DataFrame:
    """(session, messages): the last ``n`` messages of every session as an ordered array."""
    recent = first_per_group(messages, [session], [column(turn).desc()], n)
    item = F.struct(column(turn).alias("turn"), "role", "text")
    return recent.groupBy(quoted(session)).agg(F.array_sort(F.collect_list(item)).alias("messages"))


def _unit(vectors: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(vectors, axis=1, keepdims=True)
    return vectors / np.where(norms == 0, 1, norms)


def _best(scores: np.ndarray, keys: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best scores of one query, ties by key."""
    cut = np.partition(scores, -k)[-k] if len(scores) > k else scores.min()
    near = np.flatnonzero(scores >= cut)
    return near[np.lexsort((keys[near], -scores[near]))][:k]


def _nearest(rows: pa.Table, queries: pa.Table, k: int) -> pa.Table:
    """(query, key, similarity): the best k rows of a block for every query of a block."""
    keys = rows[1].to_numpy()
    vectors, asked = same_width(_unit(matrix(rows[2])), _unit(matrix(queries[2])))
    found, owners = [], []
    for at in range(0, len(asked), QUERIES_AT_ONCE):
        # rounded, so that equal vectors tie whatever the order of summation
        scores = np.round(asked[at : at + QUERIES_AT_ONCE] @ vectors.T, DIGITS)
        for i, row in enumerate(scores, at):
            places = _best(row, keys, k)
            found.append((places, row[places]))
            owners += [i] * len(places)
    places, scores = (np.concatenate(part) for part in zip(*found))
    return pa.table({"q": queries[1].take(pa.array(owners)), "k": rows[1].take(pa.array(places)), "s": scores})


def similar_context(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = 5,
    key: str = "vec_id",
    embedding: str = "embedding",
    query: str = "query",
) -> DataFrame:
    """(query, key, similarity, rank): the ``k`` rows nearest to every query by cosine.

    ``queries`` has columns ``query`` and ``embedding``.  Blocks of queries are joined with blocks of rows; one
    matrix product gives all scores of a pair of blocks and its best k per query, so at most k rows per query
    and block are shuffled again.  Each table is scanned once and no query passes through the driver.
    """
    usable = vectors.where(column(embedding).isNotNull())
    rows = numbered(usable.select(column(key).alias("key"), column(embedding).alias("vector")), "vectors")
    asked = queries.where(column(embedding).isNotNull())
    asked = numbered(asked.select(column(query).alias("asked"), column(embedding).alias("vector")), "queries")
    types = dict(rows.dtypes) | dict(asked.dtypes)
    schema = f"{quoted(query)} {types['asked']}, {quoted(key)} {types['key']}, similarity double"

    def work(some: pa.Table, wanted: pa.Table) -> pa.Table:
        found = _nearest(some.select([ROW, "key", "vector"]), wanted.select([ROW, "asked", "vector"]), k)
        return found.rename_columns([query, key, "similarity"])

    best = block_join(rows, asked, work, schema, ROWS_EACH, QUERIES_EACH)
    top = first_per_group(best, [query], [F.desc("similarity"), column(key)], k)
    rank = F.row_number().over(Window.partitionBy(quoted(query)).orderBy(F.desc("similarity"), column(key)))
    return top.withColumn("rank", rank)
