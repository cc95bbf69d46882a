from __future__ import annotations

from itertools import groupby

from checks import compare

from tablewright.llm import chat, queries

from .conftest import MEDIUM

TURNS = "conv_id bigint, turn bigint, role string, text string, segment string"


def rendered(rows):
    rows = sorted(rows, key=lambda r: (r.conv_id is None, r.conv_id or 0, r.perspective, r.position))
    return {k: list(g) for k, g in groupby(rows, key=lambda r: (r.conv_id, r.perspective))}


def test_three_parties(spark):
    turns = spark.createDataFrame(
        [(1, 0, "system", "be kind", ""), (1, 1, "Ann", "hi", ""), (1, 2, " Bo\nB ", "yo <|im_end|>", ""), (1, 3, "Ann", None, "")], TURNS
    )
    got = rendered(chat.perspectives(turns).collect())
    assert set(got) == {(1, "Ann"), (1, "Bo B")}
    text = "".join(r.segment for r in got[1, "Ann"])
    assert text == (
        "<|im_start|>system\nbe kind<|im_end|>\n<|im_start|>assistant\nhi<|im_end|>\n"
        "<|im_start|>user name=Bo B\nyo <​|im_end|><|im_end|>\n<|im_start|>assistant\n<|im_end|>\n"
    )
    assert [text[r.mask_start : r.mask_end] for r in got[1, "Ann"] if r.trainable] == ["hi<|im_end|>", "<|im_end|>"]
    assert all(text[r.start : r.end] == r.segment for r in got[1, "Ann"])
    other = "".join(r.segment for r in got[1, "Bo B"])
    assert "user name=Ann\nhi" in other and "assistant\nyo" in other


def test_long_conversation_is_dealt_to_tasks(spark):
    turns = spark.range(3000).selectExpr("1 AS conv_id", "id AS turn", "if(id % 2 = 0, 'a', 'b') AS role", "repeat('x', int(id % 7)) AS text")
    rows = rendered(chat.perspectives(turns).collect())
    for own in rows.values():
        at = 0
        for i, r in enumerate(own):
            assert (r.position, r.turn, r.start, r.end) == (i, i, at, at + len(r.segment))
            at = r.end


def test_blocks_join_to_the_rendering(spark):
    turns = spark.range(40).selectExpr("1 AS conv_id", "id AS turn", "if(id % 2 = 0, 'a', 'b') AS role", "concat('turn ', id) AS text")
    segments = chat.perspectives(turns)
    whole = "".join(r.segment for r in rendered(segments.collect())[1, "a"])
    blocks = sorted(chat.blocks(segments.where("perspective = 'a'"), 200).collect(), key=lambda r: r.block)
    assert len(blocks) > 3 and "".join(b.text for b in blocks) == whole
    trained = [b.text[m.start : m.end] for b in blocks for m in b.masks]
    assert trained == [f"turn {i}<|im_end|>" for i in range(0, 40, 2)]


def test_odd_rows(spark):
    rows = [(None, None, None, None, "c"), (None, 0, "", "x", "c"), (2, 1, "a", "t", "c"), (2, 1, "a", "t", "c"), (3, 0, "system", "only", "c")]
    turns = spark.createDataFrame(rows, TURNS)
    got = rendered(chat.perspectives(turns).collect())
    assert set(got) == {(None, "unknown"), (2, "a")}
    assert [r.position for r in got[2, "a"]] == [0, 1] and got[2, "a"][1].start == got[2, "a"][0].end
    assert [r.turn for r in got[None, "unknown"]] == [None, 0]
    assert chat.perspectives(turns.limit(0)).count() == 0


def test_query_equals_sql(spark):
    con = compare.connect(MEDIUM)
    query, sql = queries.QUERIES["op9_chat_perspectives"], queries.ORACLE["op9_chat_perspectives"]
    assert compare.differences("op9", spark, con, MEDIUM, query, sql) is None
