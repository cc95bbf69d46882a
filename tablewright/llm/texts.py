"""Texts of an Arrow batch as flat numpy arrays, and hashed n-grams and words over them.

All texts of a chunk stand behind one another in one array of code points, each between two blanks,
so an n-gram with a blank only at its ends is a word's n-gram with its boundary marked and never
spans two texts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

CHUNK_CHARS = 1 << 18
#: Bytes of text that a task holds as Python strings at once (one longer text is held alone).
SLICE_BYTES = 1 << 22
BLANK = 32
_STEP = np.uint32(0x01000193)
_PRIME = 0x9E3779B97F4A7C15
_INVERSE = pow(_PRIME, -1, 1 << 64)


def id_text(column: str = "doc_id") -> Column:
    """The id as text; a null id counts as empty text, so every row falls on one side of a split."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def split_number(modulus: int, column: str = "doc_id") -> Column:
    return F.crc32(id_text(column)) % modulus


def without(df: DataFrame, *names: str) -> DataFrame:
    """Drop columns an operator is about to add (names compare as Spark compares them)."""
    taken = {n.lower() for n in names}
    return df.drop(*[c for c in df.columns if c.lower() in taken])


def map_texts(
    df: DataFrame,
    schema: str,
    score: Callable[[list[str | None]], dict[str, list | np.ndarray]],
    keep: tuple[str, ...] = (),
    text: str = "text",
) -> DataFrame:
    """Add the columns of ``schema`` that ``score`` computes from the texts of a batch to ``keep``."""
    kept = [df.schema[k] for k in keep]
    added = df.sparkSession.createDataFrame([], schema).schema
    out = type(added)([*kept, *added.fields])
    own = text in keep
    place = keep.index(text) if own else len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, place):
            values = score(batch.column(place).to_pylist())
            columns = [batch.column(i) for i in range(len(keep))]
            yield pa.RecordBatch.from_arrays([*columns, *[pa.array(values[f.name]) for f in added.fields]], names=out.names)

    columns = [F.col(k) for k in keep] + ([] if own else [F.col(text).alias("text_of_row")])
    return df.select(*columns).mapInArrow(run, out)


def slices(batches: Iterator[pa.RecordBatch], text: int | str = "text") -> Iterator[pa.RecordBatch]:
    """Rows of the batches in slices of bounded text size."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        at = 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            stop = max(at + 1, int(np.searchsorted(ends, before + SLICE_BYTES, side="right")))
            yield batch.slice(at, stop - at)
            at = stop


@dataclass
class Flat:
    """codes: code points of all pieces; starts: where each piece begins; owner: its text's index."""

    codes: np.ndarray
    starts: np.ndarray
    owner: np.ndarray
    blank: np.ndarray


def flat_chunks(texts: list[str | None], chars: int = CHUNK_CHARS) -> Iterator[Flat]:
    """Lower-cased texts in chunks of bounded size.

    A text longer than ``chars`` is cut at the last blank before the limit.  Where a run of
    ``chars`` characters has no blank at all, the cut counts as one.
    """
    pieces: list[str] = []
    owners: list[int] = []
    size = 0
    for i, text in enumerate(texts):
        if not text:
            continue
        at = 0
        while at < len(text):
            end = min(len(text), at + chars)
            if end < len(text):
                cut = max(text.rfind(" ", at + 1, end), text.rfind("\n", at + 1, end))
                end = cut if cut > at else end
            if size + end - at > chars and pieces:
                yield _flat(pieces, owners)
                pieces, owners, size = [], [], 0
            pieces.append(text[at:end].lower())
            owners.append(i)
            size += end - at
            at = end
    if pieces:
        yield _flat(pieces, owners)


def _flat(pieces: list[str], owners: list[int]) -> Flat:
    lengths = np.fromiter(map(len, pieces), np.int64, len(pieces)) + 2
    joined = " " + "  ".join(pieces) + " "
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    blank = codes <= BLANK
    if (codes < BLANK).any():
        codes = np.where(blank, np.uint32(BLANK), codes)
    starts = np.zeros(len(pieces), np.int64)
    np.cumsum(lengths[:-1], out=starts[1:])
    return Flat(codes, starts, np.array(owners), blank)


def ngrams(flat: Flat, n: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, usable) of the n-gram at every position; buckets is a power of two."""
    size = len(flat.codes) - n + 1
    if size <= 0:
        return np.zeros(0, np.uint32), np.zeros(0, bool)
    h = np.full(size, 0x811C9DC5 + n * 0x3D4D51CB & 0xFFFFFFFF, np.uint32)
    for k in range(n):
        h ^= flat.codes[k : size + k]
        h *= _STEP
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x85EBCA6B)
    h ^= h >> np.uint32(13)
    h &= np.uint32(buckets - 1)
    if n > 2:
        bad = flat.blank[1 : size + 1].copy()
        for k in range(2, n - 1):
            bad |= flat.blank[k : size + k]
    else:
        bad = flat.blank[:size] & flat.blank[n - 1 : size + n - 1]
    return h, ~bad


_POWERS: dict[str, np.ndarray] = {}


def _powers(base: int, size: int) -> np.ndarray:
    name = str(base)
    if name not in _POWERS or len(_POWERS[name]) < size:
        factors = np.full(size, base, np.uint64)
        factors[0] = 1
        _POWERS[name] = np.multiply.accumulate(factors)
    return _POWERS[name][:size]


def word_spans(flat: Flat) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every run of characters without a blank."""
    edge = np.diff(flat.blank.astype(np.int8))
    return np.flatnonzero(edge == -1) + 1, np.flatnonzero(edge == 1) + 1


def word_hashes(flat: Flat, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span's code points, whatever its place."""
    size = len(flat.codes)
    sums = np.zeros(size + 1, np.uint64)
    np.cumsum((flat.codes.astype(np.uint64) + np.uint64(1)) * _powers(_PRIME, size), out=sums[1:])
    h = (sums[ends] - sums[starts]) * _powers(_INVERSE, size)[starts]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


def per_text(flat: Flat, values: np.ndarray, out: np.ndarray) -> None:
    """Add the sum of ``values`` (one for each position, or fewer at the end) to the texts' totals."""
    if len(values):
        inside = flat.starts < len(values)
        sums = np.add.reduceat(values, flat.starts[inside], dtype=np.float64)
        np.add.at(out, flat.owner[inside], sums)


def per_text_at(flat: Flat, positions: np.ndarray, values: np.ndarray, out: np.ndarray) -> None:
    """The same for values at sorted positions."""
    piece = np.searchsorted(flat.starts, positions, side="right") - 1
    out += np.bincount(flat.owner[piece], weights=values, minlength=len(out))


def sum_by_index(df: DataFrame, run: Callable, keys: str = "slot int") -> DataFrame:
    """Sums of what the tasks gather: ``run`` maps batches to (keys..., value double) rows.

    Every task's rows are combined before the shuffle; the result is bounded by the model's size.
    """
    names = [k.split()[0] for k in keys.split(", ")]
    parts = df.mapInArrow(run, f"{keys}, value double")
    return parts.groupBy(*names).agg(F.sum("value").alias("value"))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -60, 60)))
