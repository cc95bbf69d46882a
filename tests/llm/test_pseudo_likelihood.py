from __future__ import annotations

import math
import random
from collections import Counter

import numpy as np

from tablewright.llm import pseudo_likelihood as pl
from tablewright.llm.texts import flat_chunks


def small_model():
    return pl.start(pl.vocabulary(np.arange(pl.SLOTS, 0, -1.0)), np.ones(pl.SLOTS))


def test_contexts_stop_at_the_text():
    around = pl.contexts(np.array([1, 2, 3, 4]), np.array([0, 0, 0, 1]))
    assert around.T.tolist() == [[pl.PAD, pl.PAD, 2, 3], [pl.PAD, 1, 3, pl.PAD], [1, 2, pl.PAD, pl.PAD], [pl.PAD] * 4]


def test_log_probs_are_those_of_the_network():
    model = small_model()
    tokens, piece = np.array([3, 7, 200, 255, 0]), np.zeros(5, int)
    got = pl.log_probs(model, tokens, piece, block=2)
    around = pl.contexts(tokens, piece)
    for i, t in enumerate(tokens):
        h = np.tanh(model.hidden + sum(model.inputs[k][around[k, i]] for k in range(4)))
        z = model.output @ h + model.bias
        assert math.isclose(got[i], z[t] - math.log(np.exp(z).sum()), rel_tol=1e-4)


def test_gradient_descends():
    model = small_model()
    tokens = np.tile([5, 9, 14], 400)
    around = pl.contexts(tokens, np.zeros(len(tokens), int))
    before = pl.log_probs(model, tokens, np.zeros(len(tokens), int)).mean()
    seen = [np.full_like(p, 1e-6) for p in model.parameters()]
    for _ in range(10):
        pl.learn(model, tokens, around, seen)
    assert pl.log_probs(model, tokens, np.zeros(len(tokens), int)).mean() > before / 3


def test_counts_cover_all_documents(documents):
    rows = [(1, "a b a"), (2, "B c"), (3, None), (4, "")]
    counts = pl.slot_counts(documents(*rows))
    (flat,) = flat_chunks(["a b c"])
    a, b, c = pl._slots(pl._words(flat)[0])
    want = Counter({a: 2, b: 2, c: 1})
    assert counts.sum() == 5 and all(counts[k] == v for k, v in want.items())


def test_regular_text_scores_above_shuffled_text(documents):
    rng = random.Random(8)
    line = "the cat sat on the mat and the dog lay by the door"
    rows = [(i, " ".join([line] * 40)) for i in range(40)]
    mixed = line.split() * 40
    rng.shuffle(mixed)
    rows.append((100, " ".join(mixed)))
    got = {r.doc_id: r for r in pl.scored(documents(*rows)).collect()}
    assert got[0].mean_log_prob > got[100].mean_log_prob + 0.3
    assert got[0].n_tokens == 520 and math.isclose(got[0].log_likelihood, 520 * got[0].mean_log_prob)


def test_odd_rows(odd):
    rows = pl.scored(odd).collect()
    assert len(rows) == odd.count()
    assert all((r.n_tokens, r.log_likelihood, r.mean_log_prob) == (0, 0.0, None) for r in rows if r.doc_id in (1, 2, 3))
    assert pl.scored(odd.limit(0)).count() == 0


def test_every_place_is_learned_from_once():
    h = np.random.default_rng(3).integers(0, 1 << 63, 5000).astype(np.uint64)
    piece = np.repeat([0, 1], 2500)
    for rounds in (1, pl.ROUNDS, pl.MASK_EVERY):
        places = np.concatenate([pl.masked_places(h, piece, turn, rounds) for turn in range(rounds)])
        assert sorted(places.tolist()) == list(range(5000))


def test_rare_words_of_one_class_differ(documents, monkeypatch):
    """Two words of one shared class, in one context: their scores differ by the log of their counts."""
    filler = [f"w{i:04d}" for i in range(3000)]
    (flat,) = flat_chunks([" ".join(filler)])
    common = " ".join(filler[:600] * 20)
    token_of = pl.vocabulary(pl.slot_counts(documents((0, common), (1, " ".join(filler)))))
    tokens = token_of[pl._slots(pl._words(flat)[0])]
    first, second = [w for w, t in zip(filler[600:], tokens[600:], strict=True) if t == pl.OWN + 5][:2]
    rows = [(0, common), (1, " ".join(filler)), (2, " ".join([first] * 8)), (3, first), (4, second)]
    want = math.log(10 / 2)  # counts: in row 1 once each, 8 and 1 in row 2 and 3, 1 in row 4
    for head in (pl.HEAD, 100):
        monkeypatch.setattr(pl, "HEAD", head)
        got = {r.doc_id: r.log_likelihood for r in pl.scored(documents(*rows)).collect()}
        assert math.isclose(got[3] - got[4], want, rel_tol=1e-4)
