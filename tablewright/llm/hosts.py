"""Quality rules judged by host: failure rates shrunk with an empirical beta prior."""

from __future__ import annotations

from collections import defaultdict
from itertools import count

import numpy as np
from pyspark.sql import DataFrame, functions as F

from ..functions.staging import stage
from .texts import map_texts, without

WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
#: Shares of a document that count as a failed rule when its host is judged.
MAX_SYMBOLS_PER_WORD = 0.5
MAX_DUP_LINE_SHARE = 0.3
#: A host goes when its shrunk share of failing documents is above this.
MAX_HOST_RATE = 0.5
CHUNK_WORDS = 1 << 17
MEASURES = "n_words long, word_chars long, n_symbols long, n_lines long, n_dup_lines long, n_repeat_words long"


def _pair_rank(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """A number for each (left, right), equal just where both are equal."""
    return np.unique(left * (int(right.max()) + 1) + right, return_inverse=True)[1]


def repeated_words(texts: list[list[bytes]], window: int = WINDOW) -> list[int]:
    """Per text, the words inside a window of words that occurs twice or more in that text.

    Windows are named exactly by doubling: numbers of pairs of numbers, three times for eight words.
    """
    lengths = np.array([len(t) for t in texts])
    if not lengths.sum():
        return [0] * len(texts)
    number: defaultdict[bytes, int] = defaultdict(count().__next__)
    rank = np.fromiter((number[w] for t in texts for w in t), np.int64, int(lengths.sum()))
    owner = np.repeat(np.arange(len(texts)), lengths)
    ends = np.cumsum(lengths)
    span = 1
    while span < window:
        if len(rank) <= span:
            return [0] * len(texts)
        rank = _pair_rank(rank[:-span], rank[span:])
        span *= 2
    start = np.arange(len(rank))
    inside = start + window <= ends[owner[: len(rank)]]
    start = start[inside]
    if not len(start):
        return [0] * len(texts)
    keys = owner[start] * (int(rank.max()) + 1) + rank[inside]
    _, name, times = np.unique(keys, return_inverse=True, return_counts=True)
    twice = start[times[name] > 1]
    cover = np.zeros(len(owner) + 1, np.int64)
    np.add.at(cover, twice, 1)
    np.add.at(cover, twice + window, -1)
    covered = np.cumsum(cover)[:-1] > 0
    return np.bincount(owner, weights=covered, minlength=len(texts)).astype(int).tolist()


def measure(texts: list[str | None]) -> dict:
    """The measures of each text; a null text has no words."""
    out: dict[str, list] = {m.split()[0]: [] for m in MEASURES.split(", ")}
    waiting: list[list[bytes]] = []
    held = 0
    for text in texts:
        text = text or ""
        raw = text.encode("utf-8", "surrogatepass")
        words = raw.split()
        lines = [x for x in raw.split(b"\n") if x.strip()] if b"\n" in raw else [raw] if words else []
        out["n_words"].append(len(words))
        out["word_chars"].append(len(text) - sum(text.count(c) for c in " \t\n\x0b\f\r"))
        out["n_symbols"].append(sum(text.count(c) for c in "#*$%&|<>"))
        out["n_lines"].append(len(lines))
        out["n_dup_lines"].append(len(lines) - len(set(lines)))
        waiting.append(words)
        held += len(words)
        if held >= CHUNK_WORDS:
            out["n_repeat_words"] += repeated_words(waiting)
            waiting, held = [], 0
    out["n_repeat_words"] += repeated_words(waiting)
    return out


def document_rules(docs: DataFrame, keep: tuple[str, ...] = ("doc_id", "source")) -> DataFrame:
    """Measures of every document, base_failed, and rule_failed (any rule, the base ones included)."""
    names = [m.split()[0] for m in MEASURES.split(", ")]
    measured = map_texts(without(docs, *names, "base_failed", "rule_failed"), MEASURES, measure, keep)
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    more = (F.col("n_symbols") > MAX_SYMBOLS_PER_WORD * F.col("n_words")) | (
        F.col("n_dup_lines") > MAX_DUP_LINE_SHARE * F.col("n_lines")
    )
    return measured.withColumn("base_failed", base).withColumn("rule_failed", base | more)


def host_verdicts(judged: DataFrame, host: str = "source", limit: float = MAX_HOST_RATE) -> DataFrame:
    """(host, n, failed, rate, host_ok): failing shares per host, shrunk towards all hosts.

    The beta prior is fitted by moments over the hosts' own rates: mean m and variance v give the
    strength m(1-m)/v - 1, held between 1 and 10,000 (1 where all hosts agree on 0 or 1, or there
    is one host, so a host of few documents is never judged by them alone).  A null host is a host.
    """
    per = stage(
        judged.groupBy(F.col(host).alias("host")).agg(
            F.count(F.lit(1)).alias("n"), F.sum(F.col("rule_failed").cast("long")).alias("failed")
        ),
        "hosts",
    )
    moments = per.agg(
        (F.sum("failed") / F.sum("n")).alias("mean"), F.coalesce(F.var_samp(F.col("failed") / F.col("n")), F.lit(0.0)).alias("var")
    ).first()
    mean, var = moments["mean"] or 0.0, moments["var"]
    strength = min(10_000.0, max(1.0, mean * (1 - mean) / var - 1 if var else 1.0))
    rate = (F.col("failed") + F.lit(mean * strength)) / (F.col("n") + F.lit(strength))
    return per.withColumn("rate", rate).withColumn("host_ok", F.col("rate") <= limit)


def judge(docs: DataFrame, host: str = "source", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, measures, base_failed, host_rate and kept for every row of ``docs``.

    kept: no base rule failed and the host is accepted.  Null and empty texts fail (no words);
    repeated rows count each; columns of ``docs`` with the names of results are replaced.
    """
    hosts = host_verdicts(document_rules(docs, (host,)), host)
    hosts = hosts.select(F.col("host").alias("judged_host"), F.col("rate").alias("host_rate"), "host_ok")
    docs = without(docs, "judged_host", "host_rate", "host_ok", "kept")
    judged = document_rules(docs, tuple(dict.fromkeys(("doc_id", host, *keep))))
    joined = judged.join(hosts, judged[host].eqNullSafe(hosts["judged_host"]), "left")
    return joined.withColumn("kept", ~F.col("base_failed") & F.col("host_ok")).drop("judged_host", "host_ok")
