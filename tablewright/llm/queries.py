"""The registered queries of the operators, and their SQL where SQL can express them."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import (
    bpe,
    chat,
    decontaminate,
    hard_negatives,
    hosts,
    language,
    lexical,
    nearest,
    pseudo_likelihood,
    quality,
    sharding,
    simhash,
    toxicity,
)
from .texts import without

#: Where the public vocabulary files lie; a parameter of the operators.
TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "word_bpe_49k.json"
SHARDS = 40


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary_path() -> str:
    own = Path(TOKENIZERS, VOCABULARY)
    if own.exists():
        return str(own)
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.held_out_predictions(table(spark, sf_dir, "documents"))


def op2_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), vocabulary_path())


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.held_out_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_simhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.components(table(spark, sf_dir, "documents"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = hosts.judge(table(spark, sf_dir, "documents"))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return judged.select("doc_id", *names)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.held_out_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    placed = sharding.assign(without(table(spark, sf_dir, "documents"), "size", "text_crc32", "law"), SHARDS)
    return placed.select(
        "doc_id",
        (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op9_chat_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.perspectives(table(spark, sf_dir, "conversations"))


def op10_pseudo_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudo_likelihood.scored(table(spark, sf_dir, "documents"))


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.contract(table(spark, sf_dir, "embeddings"))


def op13_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.contract(table(spark, sf_dir, "embeddings"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_language_id,
        op2_bpe_codec,
        op3_quality_classifier,
        op4_simhash_neardup,
        op5_decontaminate,
        op6_host_rules,
        op7_toxicity,
        op8_feistel_shards,
        op9_chat_perspectives,
        op10_pseudo_likelihood,
        op11_lexical_search,
        op12_hard_negatives,
        op13_nearest_neighbours,
    )
}

HOST_SQL = """WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS words FROM d),
windows AS (SELECT doc_id, i, array_to_string(words[i:i + 7], chr(10)) AS win
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 6)) AS i FROM w)),
twice AS (SELECT doc_id, win FROM windows GROUP BY ALL HAVING count(*) > 1),
covered AS (SELECT doc_id, count(DISTINCT p) AS n FROM
  (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM windows JOIN twice USING (doc_id, win)) GROUP BY doc_id),
lines AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
  FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d)
  WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY doc_id),
m AS (SELECT doc_id, source, len(words) AS n_words,
    length(regexp_replace(t, '[\\x20\\x09-\\x0D]', '', 'g')) AS word_chars,
    length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    coalesce(n_lines, 0) AS n_lines, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words
  FROM w LEFT JOIN lines USING (doc_id) LEFT JOIN covered USING (doc_id)),
j AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m),
h AS (SELECT source, count(*) AS n,
    sum(CASE WHEN base_failed OR n_symbols > 0.5 * n_words OR n_dup_lines > 0.3 * n_lines THEN 1 ELSE 0 END) AS failed
  FROM j GROUP BY source),
s AS (SELECT sum(failed) / sum(n) AS mean, coalesce(var_samp(failed / n), 0) AS v FROM h),
b AS (SELECT mean, CASE WHEN v > 0 THEN least(10000, greatest(1, mean * (1 - mean) / v - 1)) ELSE 1 END AS k FROM s),
ok AS (SELECT source, (failed + mean * k) / (n + k) <= 0.5 AS host_ok FROM h, b)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND host_ok AS kept
FROM j JOIN ok ON j.source IS NOT DISTINCT FROM ok.source"""

CHAT_SQL = """WITH c AS (SELECT conv_id, turn, replace(coalesce(text, ''), '<|', '<' || chr(8203) || '|') AS text,
    trim(regexp_replace(replace(coalesce(role, ''), '<|', '<' || chr(8203) || '|'), '\\s+', ' ', 'g')) AS name FROM conversations),
said AS (SELECT conv_id, turn, text, CASE WHEN name = '' THEN 'unknown' ELSE name END AS speaker FROM c),
voices AS (SELECT DISTINCT conv_id, speaker AS perspective FROM said WHERE speaker <> 'system'),
headed AS (SELECT s.conv_id, perspective, turn, speaker, text, '<|im_start|>' || CASE WHEN speaker = 'system' THEN 'system'
    WHEN speaker = perspective THEN 'assistant' ELSE 'user name=' || speaker END || chr(10) AS header
  FROM said s JOIN voices v ON s.conv_id IS NOT DISTINCT FROM v.conv_id),
rendered AS (SELECT *, header || text || '<|im_end|>' || chr(10) AS segment, speaker = perspective AS trainable FROM headed),
placed AS (SELECT *, row_number() OVER w - 1 AS position,
    CAST(sum(length(segment)) OVER (w ROWS UNBOUNDED PRECEDING) AS BIGINT) AS stop
  FROM rendered WINDOW w AS (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, speaker, segment))
SELECT conv_id, perspective, position, turn, speaker, segment, stop - length(segment) AS start, stop AS "end", trainable,
  CASE WHEN trainable THEN stop - length(segment) + length(header) END AS mask_start,
  CASE WHEN trainable THEN stop - 1 END AS mask_end
FROM placed"""

LEXICAL_SQL = """WITH d AS (SELECT row_number() OVER () AS r, doc_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
i AS (SELECT row_number() OVER () AS r, item_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM benchmark),
dt AS (SELECT r, doc_id, unnest(regexp_extract_all(t, '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM d),
it AS (SELECT r, item_id, term, count(*) AS q FROM
  (SELECT r, item_id, unnest(regexp_extract_all(t, '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM i) GROUP BY ALL),
tf AS (SELECT r, doc_id, term, count(*) AS tf FROM dt GROUP BY ALL),
n AS (SELECT r, count(*) AS n FROM dt GROUP BY r),
g AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS total FROM n),
m AS (SELECT r, 100 - 75 + ((75 * n * docs) // total) AS m FROM n, g),
w AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, g GROUP BY term, docs),
s AS (SELECT it.r AS i, item_id, tf.r, doc_id, CAST(sum(q * w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
  FROM it JOIN tf USING (term) JOIN w USING (term) JOIN m ON m.r = tf.r GROUP BY ALL),
k AS (SELECT *, CAST(row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM k WHERE rank <= 10"""

NEGATIVES_SQL = """WITH e AS (SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.r AS anchor, a.vec_id AS anchor_id, b.r, b.vec_id, a.label = b.label AS same,
    CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score FROM e a, e b WHERE a.vec_id % 100 = 0 AND a.r <> b.r),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, vec_id, r) <= 5)
SELECT p.anchor_id, p.vec_id AS positive_id,
  CAST(row_number() OVER (PARTITION BY p.anchor, p.r ORDER BY s.score DESC, s.vec_id, s.r) AS INTEGER) AS rank,
  s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score
FROM p JOIN s ON p.anchor = s.anchor AND NOT s.same AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score
QUALIFY rank <= 10"""

#: Only these: the others need learned models, XXH64, CRC-32, regular expressions that look behind, or are approximate.
ORACLE = {
    "op6_host_rules": HOST_SQL,
    "op9_chat_perspectives": CHAT_SQL,
    "op11_lexical_search": LEXICAL_SQL,
    "op12_hard_negatives": NEGATIVES_SQL,
}
