from __future__ import annotations

import pytest
from pyspark.sql import functions as F

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
LABELS = "doc_id bigint, quality int, toxic int"
SMALL, MEDIUM = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


@pytest.fixture
def documents(spark):
    """Makes a documents table from (doc_id, text, lang, source) rows."""

    def make(*rows):
        full = [(*r, *("en", "host")[len(r) - 2 :], len(r[1] or "")) for r in rows]
        return spark.createDataFrame(full, DOCS)

    return make


@pytest.fixture
def odd(documents):
    """Null, empty, blank and repeated texts, null and repeated ids, a very long text, and clashing columns."""
    long = "word after word " * 120_000
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "same text here"), (4, "same text here"), (None, "no id"), (None, None), (5, long)]
    names = ["bits", "score", "predicted", "held_out", "lang_pred", "ids", "n_tokens", "kept", "n_words", "Shard", "slot", "component_id"]
    return documents(*rows).withColumns({n: F.lit("mine") for n in names})
