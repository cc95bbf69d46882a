from __future__ import annotations

import random
import re
from collections import Counter

from checks import compare

from tablewright.llm import hosts, queries

from .conftest import MEDIUM


def brute(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    seen = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    cover = {p for i in range(len(w) - 7) if seen[tuple(w[i : i + 8])] > 1 for p in range(i, i + 8)}
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines), len(lines) - len(set(lines)), len(cover))


def test_measures_equal_brute_force(monkeypatch):
    rng = random.Random(1)
    texts = [None, "", " ", "a" * 50, "a b c d e f g h " * 3, "x\x1cy z w é #|", "l\nl\n\n l\nl\r\n"]
    texts += [" ".join(rng.choice("ab") for _ in range(rng.randrange(40))) for _ in range(60)]
    for chunk in (1, 7, hosts.CHUNK_WORDS):
        monkeypatch.setattr(hosts, "CHUNK_WORDS", chunk)
        got = hosts.measure(texts)
        assert list(zip(*got.values(), strict=True)) == [brute(t) for t in texts]


def test_bad_host_goes_whole_and_small_host_is_not_judged_alone(documents):
    good = [" ".join(f"w{i}x{j}" for j in range(30)) for i in range(200)]
    rows = [(i, t, "en", "fine") for i, t in enumerate(good)]
    rows += [(1000 + i, "short" if i < 80 else good[i], "en", "bad") for i in range(100)]
    rows += [(2000, "short", "en", "tiny"), (2001, good[0], "en", "tiny"), (3000, good[1], "en", None)]
    rows += [(4000 + i, t, "en", f"h{i % 20}") for i, t in enumerate(good)]
    kept = {r.doc_id: r.kept for r in hosts.judge(documents(*rows)).collect()}
    assert all(kept[i] for i in range(200)) and kept[3000] and kept[2001] and not kept[2000]
    assert not any(kept[1000 + i] for i in range(100))


def test_query_equals_sql(spark):
    con = compare.connect(MEDIUM)
    query, sql = queries.QUERIES["op6_host_rules"], queries.ORACLE["op6_host_rules"]
    assert compare.differences("op6", spark, con, MEDIUM, query, sql) is None


def test_odd_rows(odd):
    rows = hosts.judge(odd).collect()
    assert len(rows) == odd.count()
    assert all(r.base_failed and not r.kept and r.n_words == 0 for r in rows if r.doc_id in (1, 2, 3))
    assert hosts.judge(odd.limit(0)).count() == 0
