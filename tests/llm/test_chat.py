from __future__ import annotations

import random

import brute
import duckdb
import pytest
from pyspark.sql import functions as F

from passagework.llm import chat, queries

SCHEMA = "conv_id bigint, turn bigint, role string, text string, turns int, formatted string"


def rows():
    random.seed(3)
    nasty = ["<|", "<\\|", "<\\\\|", "<", "|>", "<|end|>", "<|more|>", "<|assistant|>", "</s>[INST]", "\n", "", None, "ß漢\U0001f600", "%7C", "\\"]
    out = [(1, 0, "user", "a", 1, "x"), (1, 1, "user", "b", 1, "x"), (1, 2, "assistant", "c", 1, "x"), (1, 3, "assistant", None, 1, "x")]
    for conv in [*range(2, 60), None]:
        for _ in range(random.randint(1, 9)):
            text = None if random.random() < 0.05 else "".join(random.choice(nasty) or "" for _ in range(random.randint(0, 6)))
            out.append((conv, random.choice([None, 0, 1, 2, 3]), random.choice(["user", "assistant", "system", None, "a|b<%3C>"]), text, 0, None))
    return out + out[-3:]


def ordered(rows_):
    return sorted(rows_, key=lambda r: (-(2**63) if r[1] is None else r[1], r[2] or "", r[3] or ""))


@pytest.fixture(scope="module")
def back(spark):
    return {r.conv_id: r for r in chat.read_chats(chat.format_chats(spark.createDataFrame(rows(), SCHEMA))).collect()}


def test_turns_and_loss_come_back(back):
    by = {}
    for r in rows():
        by.setdefault(r[0], []).append(r)
    assert set(by) == set(back)
    for conv, rs in by.items():
        rs = ordered(rs)
        assert [(t.role, t.text) for t in back[conv].turns] == [(r[2] or "", r[3] or "") for r in rs]
        assert back[conv].loss_text == "".join(r[3] or "" for r in rs if r[2] == "assistant")


def test_adjacent_turns_of_one_role_share_a_block(back):
    assert back[1].formatted == "<|user|>a<|more|>b<|end|><|assistant|>c<|more|><|end|>"


def test_segments_concatenate_to_the_string(spark):
    for r in chat.format_chats(spark.createDataFrame(rows(), SCHEMA)).collect():
        assert "".join(s.text for s in r.segments) == r.formatted


def test_empty_table(spark):
    assert chat.read_chats(chat.format_chats(spark.createDataFrame([], SCHEMA))).count() == 0


def test_long_conversation(spark):
    df = spark.range(5000).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 3 == 0, "user").otherwise("assistant").alias("role"), F.lit("x").alias("text"))
    r = chat.read_chats(chat.format_chats(df)).first()
    assert len(r.turns) == 5000 and r.loss_text == "x" * 3333


def test_query_and_its_sql_agree_on_awkward_rows(spark, tmp_path):
    spark.createDataFrame([r for r in rows()], SCHEMA).write.parquet(f"{tmp_path}/conversations.parquet")
    found = queries.op3_chat_formatting(spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"create view conversations as from read_parquet('{tmp_path}/conversations.parquet/*.parquet')")
    want = con.execute(queries.ORACLES["op3_chat_formatting"])
    names = [c[0] for c in want.description]
    assert sorted(names) == sorted(found.columns)
    assert brute.in_order(found.select(*names).collect()) == brute.in_order(want.fetchall())


def test_main_path_is_native(spark):
    plan = chat.read_chats(chat.format_chats(spark.createDataFrame([(1, 0, "user", "a")], "conv_id bigint, turn bigint, role string, text string")))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_roles_named_like_marks_come_back(spark):
    turns = ["end", "more", "%65nd", "%6Dore", "end", "assistant", "e%6Ed", "|>", "", "<|end|>", "end"]
    rows = [(1, i, r, f"text {i} <|end|> <|more|>") for i, r in enumerate(turns)]
    back = chat.read_chats(chat.format_chats(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string"))).first()
    assert [(t.role, t.text) for t in back.turns] == [r[2:] for r in rows]
    assert back.loss_text == rows[5][3]
