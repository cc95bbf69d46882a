from __future__ import annotations

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tablewright.llm import language, quality, texts, toxicity

SYLLABLES = {"aa": "ba be bi bo bu", "bb": "ka ke ki ko ku", "cc": "za ze zi zo zu"}


def words(rng, lang, n):
    return " ".join("".join(rng.choice(SYLLABLES[lang].split()) for _ in range(rng.randint(1, 3))) for _ in range(n))


def test_flat_chunks_keep_every_word():
    given = ["Ab cd", None, "", "x" * 25, "one two three four five six", " lead"]
    for chars in (4, 10, 1000):
        found = defaultdict(str)
        for flat in texts.flat_chunks(given, chars):
            starts, ends = texts.word_spans(flat)
            piece = np.searchsorted(flat.starts, starts, side="right") - 1
            for a, b, p in zip(starts, ends, piece, strict=True):
                found[int(flat.owner[p])] += "".join(map(chr, flat.codes[a:b])) + " "
        for i, t in enumerate(given):
            assert found[i].replace(" ", "") == (t or "").lower().replace(" ", "")
            if chars >= 10 and t and len(t) < 25:
                assert found[i].split() == t.lower().split()


def test_ngrams_and_word_hashes_depend_on_characters_only():
    (flat,) = texts.flat_chunks(["the theme", "a theme", "été"])
    h, ok = texts.ngrams(flat, 3, 1 << 16)
    seen = defaultdict(set)
    for i in np.flatnonzero(ok):
        seen["".join(map(chr, flat.codes[i : i + 3]))].add(int(h[i]))
    assert set(seen) == {" th", "the", "he ", "hem", "eme", "me ", " a ", " ét", "été", "té "}
    assert all(len(v) == 1 for v in seen.values()) and len({min(v) for v in seen.values()}) == len(seen)
    hashes = texts.word_hashes(flat, *texts.word_spans(flat))
    assert hashes[1] == hashes[3] and len(set(hashes.tolist())) == 4


def brute_language(train, text):
    """Multinomial naive Bayes on strings; hashing may only merge n-grams."""
    counts, priors = defaultdict(Counter), Counter()
    grams = lambda t: [g for w in t.lower().split() for n in (2, 3) for g in [f" {w} "[i : i + n] for i in range(len(w) + 3 - n)]]
    for t, lang in train:
        counts[lang].update(grams(t))
        priors[lang] += 1
    best = {}
    for lang, c in counts.items():
        total = sum(c.values()) + language.SMOOTHING * language.BUCKETS
        best[lang] = math.log(priors[lang] / len(train)) + sum(math.log((c[g] + language.SMOOTHING) / total) for g in grams(text))
    return max(sorted(best), key=best.get)


def test_language_equals_brute_force(documents):
    rng = random.Random(3)
    rows = [(i, words(rng, lang, rng.randint(1, 30)), lang) for i, lang in enumerate(["aa", "bb", "cc"] * 20)]
    got = {r.doc_id: r for r in language.held_out_predictions(documents(*rows)).collect()}
    train = [(t, lang) for i, t, lang in rows if zlib.crc32(str(i).encode()) % 5]
    for i, t, lang in rows:
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0)
        assert got[i].lang_pred == brute_language(train, t) == lang
        assert 0 <= got[i].score <= 1


def test_language_odd_rows(odd, documents, spark):
    got = language.held_out_predictions(odd)
    assert got.columns == ["doc_id", "held_out", "lang_pred", "score"]
    rows = got.collect()
    assert len(rows) == odd.count()
    by = {r.doc_id: r for r in rows}
    assert by[2].lang_pred == by[3].lang_pred == "und" and by[1].score == 0.0
    assert by[5].lang_pred == "en"
    untaught = language.held_out_predictions(documents((1, "text", None)))
    assert untaught.first().lang_pred == "und"
    assert language.held_out_predictions(odd.limit(0)).count() == 0


def test_language_needs_a_letter(documents):
    rows = [(i, "some plain words", "en") for i in range(1, 30)]
    numerals = {100: "½ ² ③ Ⅷ", 101: "12 _ 3", 102: "a", 103: "٣", 104: "语"}
    rows += [(i, t, None) for i, t in numerals.items()]
    got = {r.doc_id: r.lang_pred for r in language.held_out_predictions(documents(*rows)).collect()}
    assert [got[i] for i in numerals] == ["und", "und", "en", "und", "en"]


def test_only_frequent_labels_are_languages(documents, monkeypatch):
    monkeypatch.setattr(language, "MAX_LANGUAGES", 2)
    rows = [(i, t, lang) for i, (t, lang) in enumerate([("ba bo bi", "aa"), ("ku ko ka", "bb")] * 20 + [("zu za", "dirt 1"), ("zo zi", "dirt 2")])]
    model = language.train(documents(*rows))
    assert model.languages == ["aa", "bb"]


@pytest.fixture
def labelled(spark, documents):
    """Toxic: one insult among clean words; bad quality: symbols on every word."""
    rng = random.Random(5)
    rows, labels = [], []
    for i in range(600):
        parts = words(rng, "aa", 40).split()
        toxic, good = int(i % 4 == 0), int(i % 3 != 0)
        if toxic:
            parts[rng.randrange(40)] = rng.choice(["grobian", "trottel"])
        if not good:
            parts = [p + "###" for p in parts]
        rows.append((i, " ".join(parts)))
        labels.append((i, good, toxic))
    return documents(*rows), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")


def accuracy(scored, labels, name):
    held = scored.where("held_out").join(labels, "doc_id").collect()
    assert len(held) > 50 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in held)
    return sum(r.predicted == r[name] for r in held) / len(held)


def test_toxicity_on_held_out_rows(labelled):
    docs, labels = labelled
    assert accuracy(toxicity.held_out_scores(docs, labels), labels, "toxic") > 0.98


def test_quality_on_held_out_rows(labelled):
    docs, labels = labelled
    assert accuracy(quality.held_out_scores(docs, labels), labels, "quality") > 0.98


def test_held_out_labels_teach_nothing(labelled, spark):
    docs, labels = labelled
    turned = labels.selectExpr("doc_id", "if(crc32(string(doc_id)) % 5 = 0, 1 - toxic, toxic) AS toxic")
    a = {r.doc_id: r.score for r in toxicity.held_out_scores(docs, labels).collect()}
    b = {r.doc_id: r.score for r in toxicity.held_out_scores(docs, turned).collect()}
    assert a == b


@pytest.mark.parametrize("module", [toxicity, quality])
def test_classifiers_odd_rows(module, odd, spark):
    labels = spark.createDataFrame([(4, 1, 1), (4, 1, 1), (5, 0, 0), (9, 0, 1), (None, 1, 0), (2, None, None)], "doc_id bigint, quality int, toxic int")
    for given in (labels, labels.limit(0)):
        rows = module.held_out_scores(odd, given).collect()
        assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows)
    assert module.held_out_scores(odd.limit(0), labels).count() == 0


def test_presence_of_a_long_text_counts_once():
    marked = np.ones(toxicity.BUCKETS, bool)
    doc, bucket = toxicity._presence(["grobian " * 3, "grobian"], marked)
    assert Counter(doc.tolist())[1] > 0 and set(bucket[doc == 1]) <= set(bucket[doc == 0])
    assert len(set(zip(doc.tolist(), bucket.tolist(), strict=True))) == len(doc)
