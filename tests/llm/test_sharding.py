from __future__ import annotations

import re
import zlib

import pytest
from pyspark.sql import functions as F

from tablewright.llm import queries, sharding

from .conftest import SMALL


@pytest.mark.parametrize("rows", [1, 2, 3, 5, 17, 100, 1000, 4097])
def test_permutation(spark, rows):
    got = [r[0] for r in spark.range(rows).select(sharding.permuted(F.col("id"), rows)).collect()]
    assert sorted(got) == list(range(rows))
    if rows >= 100:
        assert sum(a == b for a, b in enumerate(got)) < rows / 5
        other = [r[0] for r in spark.range(rows).select(sharding.permuted(F.col("id"), rows, 1)).collect()]
        assert other != got


def test_query(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    text = {r.doc_id: r.text or "" for r in docs.collect()}
    rows = queries.op8_feistel_shards(spark, SMALL).collect()
    assert {r.doc_id: (r.size, r.text_crc32) for r in rows} == {
        i: (len(t.encode()) + 16, zlib.crc32(t.encode())) for i, t in text.items()
    }
    shards = {}
    for r in rows:
        shards.setdefault(r.shard, []).append(r.slot)
    assert set(shards) == set(range(40)) and all(sorted(s) == list(range(len(s))) for s in shards.values())
    assert max(map(len, shards.values())) - min(map(len, shards.values())) <= 1
    assert {(r.law, r.grown_shard) for r in rows} == {("rows", None)}


def test_same_whatever_the_splits(spark, folder):
    spark.range(5000).selectExpr("id", "repeat('x', 50) AS text").repartition(5, "id").write.parquet(f"{folder}/t")
    table = spark.read.parquet(f"{folder}/t")
    before = sorted(map(tuple, sharding.assign(table, 7).select("id", "shard", "slot").collect()))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        after = sorted(map(tuple, sharding.assign(spark.read.parquet(f"{folder}/t"), 7).select("id", "shard", "slot").collect()))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert before == after
    expected = {(int(p) % 7, int(p) // 7) for p in range(5000)}
    assert {(s, k) for _, s, k in before} == expected


def test_written_shards_keep_the_order(spark, folder):
    table = spark.createDataFrame([(i, f"t{i}") for i in range(100)], "doc_id bigint, text string")
    sharding.write_shards(table, f"{folder}/out", 3)
    back = spark.read.parquet(f"{folder}/out")
    assert back.count() == 100
    assert sorted(r[0] for r in back.where("shard = 1").select("slot").collect()) == list(range(33))


def test_odd_rows(odd):
    rows = sharding.assign(odd, 3).collect()
    assert len(rows) == odd.count() and sorted((r.slot, r.shard) for r in rows) == sorted((i // 3, i % 3) for i in range(len(rows)))
    assert sharding.assign(odd.limit(0), 3).count() == 0


def test_plan_has_no_python(spark):
    plan = queries.op8_feistel_shards(spark, SMALL)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow|Exchange hash|Exchange range", plan)


def test_filtered_joined_and_limited_frames(spark, folder):
    """Places in files are used only where every row of a file is there."""
    spark.range(200).selectExpr("id", "id % 7 AS k").repartition(4, "id").write.parquet(f"{folder}/t")
    table = spark.read.parquet(f"{folder}/t")
    twice = table.join(spark.createDataFrame([(1,), (1,), (2,)], "k bigint"), "k")
    for df in (table, table.select("k"), table.where("id > 120"), table.where("id % 3 = 0").drop("k"), twice, table.limit(50), table.sample(0.5, 1)):
        n = df.count()
        numbered, rows = sharding.row_numbers(df)
        assert rows == n and sorted(r.row_number for r in numbered.collect()) == list(range(n))
        places = {(r.shard, r.slot) for r in sharding.assign(df, 7).collect()}
        assert places == {(p % 7, p // 7) for p in range(n)}
