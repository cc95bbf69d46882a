"""Byte-pair encoding and decoding in batched numpy merge rounds.

A vocabulary file of the ``tokenizers`` format is read for its tables only; splitting, merging and
decoding are done here.  Covered: NFC and lower-casing normalisers, one splitting pattern, byte-level
symbols, a word-end suffix, special tokens, and no decoder (tokens joined by a blank).
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterable

import numpy as np
import regex
from pyspark.sql import DataFrame

from .texts import map_texts, without

#: Distinct words whose ids a task remembers; when full it starts anew (a bound on memory only).
REMEMBERED_WORDS = 100_000
#: Symbols merged at once.
BLOCK_SYMBOLS = 1 << 17
DIGEST = "n_tokens long, ids_sha256 string, decoded_sha256 string"


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


def lower(text: str) -> str:
    """Lower case letter by letter: a final sigma is no special case."""
    return text.replace("Σ", "σ").lower()


class BytePairs:
    """The tables of one vocabulary file, and encoding and decoding with them."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            self._load(json.load(f))

    def _load(self, spec: dict) -> None:
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        suffix = model["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        kinds = [n["type"] for n in spec["normalizer"]["normalizers"]]
        self.compose, self.fold = "NFC" in kinds, "Lowercase" in kinds
        pattern = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")["pattern"]["Regex"]
        # in this library \s also takes four control characters that are no white space in Unicode
        self.words = regex.compile(pattern.replace(r"[^\s", r"[^\p{White_Space}"))
        self.specials = regex.compile("|".join(map(regex.escape, self.special)) or r"(?!)")
        letters = byte_symbols()
        self.first = np.array([vocab[c] for c in letters], np.int64)
        self.last = np.array([vocab[c + suffix] for c in letters], np.int64)
        # merges: keys of pairs in order, the rank of each, and what each rank makes
        self.base = len(self.tokens) + 1
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        keys = np.array([vocab[a] * self.base + vocab[b] for a, b in pairs], np.int64)
        self.makes = np.array([vocab[a + b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order
        self.ids_of: dict[str, bytes] = {}
        self.text_of: dict[str, str] = {}

    def merge(self, words: list[bytes]) -> list[np.ndarray]:
        """Ids of each word (none empty).

        Every round finds each word's lowest-rank pair by binary search over the sorted pair keys
        and merges all its occurrences from the left; words without a pair leave the rounds.
        """
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        raw = np.frombuffer(b"".join(words), np.uint8)
        symbols = self.first[raw]
        ends = np.cumsum(lengths)
        symbols[ends - 1] = self.last[raw[ends - 1]]
        word = np.repeat(np.arange(len(words)), lengths)
        done: list[np.ndarray] = [symbols[:0]] * len(words)
        none = len(self.keys)
        while len(symbols):
            key = symbols[:-1] * self.base + symbols[1:]
            at = np.minimum(np.searchsorted(self.keys, key), none - 1)
            rank = np.where((self.keys[at] == key) & (word[:-1] == word[1:]), self.ranks[at], none)
            rank = np.append(rank, none)
            begin = np.flatnonzero(np.diff(word, prepend=-1))
            lowest = np.minimum.reduceat(rank, begin)
            size = np.diff(np.append(begin, len(word)))
            over = lowest == none
            for i in np.flatnonzero(over):
                done[word[begin[i]]] = symbols[begin[i] : begin[i] + size[i]]
            live = np.repeat(~over, size)
            chosen = rank == np.repeat(lowest, size)
            chosen &= live
            # of overlapping pairs (aaa) the first, third, ... in a row are merged
            spots = np.flatnonzero(chosen)
            if not len(spots):
                break
            run = np.cumsum(np.diff(spots, prepend=-2) != 1)
            offset = np.arange(len(spots)) - np.searchsorted(run, run)
            spots = spots[offset % 2 == 0]
            symbols[spots] = self.makes[rank[spots]]
            live[spots + 1] = False
            symbols, word = symbols[live], word[live]
        return done

    def _learn(self, words: Iterable[str]) -> None:
        block: list[str] = []
        held = 0
        for w in words:
            block.append(w)
            held += len(w)
            if held >= BLOCK_SYMBOLS:
                self._learn_block(block)
                block, held = [], 0
        if block:
            self._learn_block(block)

    def _learn_block(self, words: list[str]) -> None:
        for w, ids in zip(words, self.merge([w.encode("utf-8", "surrogatepass") for w in words]), strict=True):
            self.ids_of[w] = ids.astype("<u4").tobytes()
            self.text_of[w] = " ".join([self.tokens[i] for i in ids.tolist()])

    def split(self, text: str) -> list[str]:
        if self.compose and not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        return self.words.findall(lower(text) if self.fold else text)

    def _parts(self, text: str) -> list[str | int]:
        """Words in order; a special token that stands in the text is its id."""
        out: list[str | int] = []
        at = 0
        for m in self.specials.finditer(text):
            out += self.split(text[at : m.start()])
            out.append(self.special[m.group()])
            at = m.end()
        return out + self.split(text[at:]) if at else self.split(text)

    def encode_batch(self, texts: list[str | None]) -> list[tuple[bytes, str]]:
        """(ids as little-endian unsigned 32-bit integers, decoded text) of each text; null is empty."""
        parts = [self._parts(t) if t else [] for t in texts]
        new = {w for p in parts for w in p if w not in self.ids_of and isinstance(w, str)}
        if len(self.ids_of) + len(new) > REMEMBERED_WORDS:
            self.ids_of, self.text_of = {}, {}
            new = {w for p in parts for w in p if isinstance(w, str)}
        self._learn(new)
        for content, i in self.special.items():
            self.ids_of[i], self.text_of[i] = i.to_bytes(4, "little"), content
        ids, text = self.ids_of.__getitem__, self.text_of.__getitem__
        return [(b"".join(map(ids, p)), " ".join(map(text, p))) for p in parts]

    def encode(self, text: str | None) -> list[int]:
        return np.frombuffer(self.encode_batch([text])[0][0], "<u4").tolist()

    def decode(self, ids: Iterable[int]) -> str:
        """Tokens joined by a blank, special ones included."""
        return " ".join(self.tokens[i] for i in ids)


_LOADED: dict[str, BytePairs] = {}
#: Characters encoded together.
GROUP_CHARS = 1 << 18


def _pairs(spec_json: str) -> BytePairs:
    """One per Python worker: its word memory serves all batches."""
    name = hashlib.sha256(spec_json.encode()).hexdigest()
    if name not in _LOADED:
        _LOADED[name] = own = BytePairs.__new__(BytePairs)
        own._load(json.loads(spec_json))
    return _LOADED[name]


def _groups(texts: list[str | None]) -> Iterable[list[str | None]]:
    group: list[str | None] = []
    held = 0
    for t in texts:
        group.append(t)
        held += len(t or "")
        if held >= GROUP_CHARS:
            yield group
            group, held = [], 0
    if group:
        yield group


def _encode(df: DataFrame, path: str, schema: str, keep: tuple[str, ...], columns) -> DataFrame:
    with open(path, encoding="utf-8") as f:
        shared = df.sparkSession.sparkContext.broadcast(f.read())

    def score(texts: list[str | None]) -> dict:
        pairs = _pairs(shared.value)
        rows = [columns(ids, text) for group in _groups(texts) for ids, text in pairs.encode_batch(group)]
        return {f.split()[0]: [r[k] for r in rows] for k, f in enumerate(schema.split(", "))}

    return map_texts(without(df, *[f.split()[0] for f in schema.split(", ")]), schema, score, keep)


def encode(docs: DataFrame, path: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` plus ids (array<int>) and decoded, for every row; columns of these names are replaced.

    Null and empty texts have no ids and decode to the empty text.
    """
    return _encode(
        docs, path, "ids array<int>, decoded string", keep, lambda ids, text: (np.frombuffer(ids, "<u4").astype(np.int32), text)
    )


def encoded(docs: DataFrame, path: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` plus ids and the digests."""

    def columns(ids: bytes, text: str) -> tuple:
        return np.frombuffer(ids, "<u4").astype(np.int32), *digest(ids, text)

    return _encode(docs, path, "ids array<int>, " + DIGEST, keep, columns)


def digest(ids: bytes, text: str) -> tuple[int, str, str]:
    decoded = text.encode("utf-8", "surrogatepass")
    return len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded).hexdigest()


def digests(docs: DataFrame, path: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` plus the number of tokens and SHA-256 digests of the ids and of the decoded text."""
    return _encode(docs, path, DIGEST, keep, digest)
