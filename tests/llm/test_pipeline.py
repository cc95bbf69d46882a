from __future__ import annotations

import corpus_pipeline
from pyspark.sql import functions as F

from tablewright.llm import bpe, decontaminate, hosts, language, queries

from .conftest import SMALL
from .test_overlap import brute_near_copies


def ids(df):
    return {r.doc_id for r in df.select("doc_id").collect()}


def test_stages_equal_brute_force(spark):
    docs = queries.table(spark, SMALL, "documents")
    columns = docs.columns
    text = {r.doc_id: r.text for r in docs.collect()}

    kept = corpus_pipeline.quality_rules(spark, docs, SMALL)
    assert kept.columns == columns
    measured = dict(zip(text, zip(*hosts.measure(list(text.values())).values(), strict=True), strict=True))
    assert ids(kept) == {i for i, m in measured.items() if m[0] >= 20 and 100 * m[5] <= 30 * m[0]}

    spoken = corpus_pipeline.language_id(spark, kept, SMALL)
    found = language.predict(kept, language.train(kept)).collect()
    assert spoken.columns == columns and ids(spoken) == {r.doc_id for r in found if r.lang_pred != "und" and r.score >= 0.5}

    unique = corpus_pipeline.near_duplicates(spark, spoken, SMALL)
    roots = brute_near_copies({i: text[i] for i in ids(spoken)})
    left = ids(unique)
    assert unique.columns == columns and len(left) == len(set(roots.values())) and {roots[i] for i in left} == set(roots.values())

    clean = corpus_pipeline.benchmark_decontamination(spark, unique, SMALL)
    leaked = ids(decontaminate.contaminated(unique, queries.table(spark, SMALL, "benchmark")))
    assert clean.columns == columns and ids(clean) == left - leaked

    done = corpus_pipeline.run(spark, SMALL).collect()
    assert {r.doc_id for r in done} == left - leaked
    own = bpe.BytePairs(queries.vocabulary_path())
    assert all(r.ids == own.encode(text[r.doc_id]) and r.n_tokens == len(r.ids) for r in done)


def test_every_stage_takes_odd_rows(spark, documents):
    words = " ".join(f"word{i}" for i in range(40))
    rows = [(None, words), (None, words), (1, words + " more"), (1, None), (2, ""), (3, "## " * 50), (4, words)]
    docs = documents(*rows)
    for step in dict(corpus_pipeline.STAGES).values():
        out = step(spark, docs, SMALL)
        assert out.count() <= len(rows)
        assert step(spark, docs.limit(0), SMALL).count() == 0
    kept = corpus_pipeline.near_duplicates(spark, documents((None, words), (None, words), (7, words)), SMALL)
    assert kept.count() == 1


def test_every_stage_takes_any_extra_column(spark, documents):
    """Columns named like what the stages work with come through as they are."""
    words = [" ".join(f"word{i}x{k}" for i in range(40)) for k in range(4)]
    rows = [(k, w) for k, w in enumerate(words)] + [(9, words[0])]
    names = ["kept", "n_words", "host_rate", "score", "lang_pred", "ids", "n_tokens", "file_of_row", "index_of_row", "row_of_stage", "Bits", "place", "column_5_of_docs", "Source"]
    docs = documents(*rows)
    wide = docs.select("*", *[F.concat(F.lit(f"{n} of "), F.col("doc_id").cast("string")).alias(n) for n in names])
    for name, step in corpus_pipeline.STAGES:
        plain, out = step(spark, docs, SMALL), step(spark, wide, SMALL)
        if name != "bpe_codec":
            assert out.columns == wide.columns
        results = [c for c in plain.columns if c not in docs.columns]
        for r in (found := out.collect()):
            own = dict(zip(out.columns, r))
            assert all(own[n] == f"{n} of {r[0]}" for n in names if n not in results)
        assert sorted(r[0] for r in found) == sorted(r.doc_id for r in plain.collect())


def test_stages_on_filtered_tables_of_several_files(spark, documents, folder):
    """A filter leaves gaps in the places of a file; no row is mistaken for another."""
    words = lambda k: " ".join(f"word{i}x{k}" for i in range(40))
    rows = [(k, words(k // 2 if k % 10 == 0 else k + 1_000)) for k in range(40)] + [(100, words(0))]
    documents(*rows).repartition(3, "doc_id").write.parquet(f"{folder}/docs")
    some = spark.read.parquet(f"{folder}/docs").where("doc_id % 3 <> 1")
    kept = ids(corpus_pipeline.near_duplicates(spark, some, SMALL))
    groups = {}
    for k, text in rows:
        if k % 3 != 1:
            groups.setdefault(text, set()).add(k)
    assert len(kept) == len(groups) and all(len(kept & g) == 1 for g in groups.values())
