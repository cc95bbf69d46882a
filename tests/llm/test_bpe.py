from __future__ import annotations

import hashlib

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from tablewright.llm import bpe, queries

tokenizers = pytest.importorskip("tokenizers")
PATH = queries.vocabulary_path()


@pytest.fixture(scope="module")
def both():
    return bpe.BytePairs(PATH), tokenizers.Tokenizer.from_file(PATH)


def agree(both, text):
    own, other = both
    ids = other.encode(text, add_special_tokens=False).ids
    return own.encode(text) == ids and own.decode(ids) == other.decode(ids, skip_special_tokens=False)


@pytest.mark.parametrize(
    "text",
    ["", "  ", "it's WE'LL don't", "aaaa aaaaaaa", "ΣΑΣ İstanbul", "x<|endoftext|>y <|startoftext|>", "日本 😀👍🏽", "école é",
     "a\u0085b\x1cc　d", "1234 ½ Ⅷ ٣", "a" * 3000 + "!" * 777, "\x00\x01"],
)
def test_equals_the_library(both, text):
    assert agree(both, text)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.characters(min_codepoint=9, max_codepoint=0x17F), max_size=60))
def test_equals_the_library_on_any_latin_text(both, text):
    assert agree(both, text)


def test_memory_bound_changes_nothing(both, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED_WORDS", 3)
    own = bpe.BytePairs(PATH)
    for text in ("one two three four five", "two six one"):
        assert own.encode(text) == both[1].encode(text, add_special_tokens=False).ids


def test_digests_of_whole_table(spark, both):
    from .conftest import SMALL

    docs = queries.table(spark, SMALL, "documents")
    got = {r.doc_id: r for r in queries.op2_bpe_codec(spark, SMALL).collect()}
    assert len(got) == docs.count()
    for r in docs.collect():
        ids = both[1].encode(r.text or "", add_special_tokens=False).ids
        text = both[1].decode(ids, skip_special_tokens=False)
        want = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
        assert tuple(got[r.doc_id])[1:] == want


def test_odd_rows(odd):
    rows = bpe.encode(odd, PATH).collect()
    assert len(rows) == odd.count()
    assert all(r.ids == [] and r.decoded == "" for r in rows if r.doc_id in (1, 2, 3))
    assert bpe.digests(odd.limit(0), PATH).count() == 0
