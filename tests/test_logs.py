from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from passagework.errors import ChunkError
from passagework.operators import generation
from passagework.plans import answer, question_queries, turns
from passagework.sources import stores

ASKED = "query_id bigint, attempt int, prompt string"


def counted(path, fails=()):
    """A completion that writes down every prompt it is given."""

    def complete(prompt):
        with open(path, "a") as f:
            f.write(prompt + "\n")
        if prompt in fails:
            raise OSError("down")
        return prompt.upper()

    return generation.model_generator(complete)


def calls(path):
    return sorted(open(path).read().splitlines()) if os.path.exists(path) else []


def test_a_logged_call_is_made_once(spark, tmp_path):
    seen, log = f"{tmp_path}/seen", f"{tmp_path}/log"
    asked = spark.createDataFrame([(1, 1, "a"), (1, 1, "a"), (2, 1, "b"), (3, 1, None), (4, 1, "down")], ASKED)
    ask = generation.logged(counted(seen, {"down"}), log)
    found = ask(asked)
    assert calls(seen) == ["a", "b", "down"]
    spark.catalog.clearCache()
    for _ in range(2):
        assert sorted((r.query_id, r.raw) for r in found.collect()) == [(1, "A"), (2, "B"), (4, None)]
    assert calls(seen) == ["a", "b", "down"]
    # A later run asks for what is new: another question, another attempt, another prompt.
    ask(asked.union(spark.createDataFrame([(5, 1, "c"), (2, 2, "b"), (1, 1, "a2")], ASKED)))
    assert calls(seen) == ["a", "a2", "b", "b", "c", "down"]


def test_replies_from_a_logged_generator_call_no_model_again(spark, tmp_path, monkeypatch):
    """Two actions, with what was kept in memory lost between them."""
    seen = f"{tmp_path}/seen"
    made = []

    def once(questions, index, registry, generator, config):
        def writes(asked):
            def run(frames):
                for f in frames:
                    with open(seen, "a") as out:
                        out.writelines(f"{q}:{a}\n" for q, a in zip(f["query_id"], f["attempt"]))
                    yield f

            marked = asked.select("query_id", "attempt", "prompt").mapInPandas(run, "query_id bigint, attempt int, prompt string")
            return generator(marked)

        made.append(original(questions, index, registry, generation.logged(writes, f"{tmp_path}/log"), config))
        return made[-1]

    original = answer.answer_batch
    monkeypatch.setattr(answer, "answer_batch", once)
    replies = question_queries.batch(spark, "/root/testdata/sf0.001")
    first = sorted(map(str, replies.select("query_id", "type", "reason").collect()))
    answer.release(replies)
    spark.catalog.clearCache()
    assert sorted(map(str, replies.select("query_id", "type", "reason").collect())) == first
    asked = calls(seen)
    assert asked and len(asked) == len(set(asked))


def test_lines_are_numbered_across_blocks_and_files(spark, tmp_path):
    for name, n in (("a", 500), ("b", 1), ("c", 0), ("d", 37)):
        (tmp_path / f"{name}.txt").write_text("".join(f"{name} {i} {'x' * (i % 50)}\n" if i % 7 else "\n" for i in range(1, n + 1)))
    (tmp_path / "e.txt").write_bytes(b"e 1\r\ne 2\nlast")
    key, open_cost = "spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"
    before = {k: spark.conf.get(k) for k in (key, open_cost)}
    try:
        spark.conf.set(key, "300")
        spark.conf.set(open_cost, "10")
        rows = [(os.path.basename(r.file)[0], r.line_no, r.value) for r in stores.numbered_lines(spark, str(tmp_path)).collect()]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    want = [(p.name[0], i, line) for p in tmp_path.iterdir() if p.suffix == ".txt" for i, line in enumerate(p.read_bytes().decode().replace("\r\n", "\n").removesuffix("\n").split("\n") if p.stat().st_size else [], 1)]
    assert sorted(rows) == sorted(want) and len(rows) == 541


def test_reading_blocks_names_the_line(spark, tmp_path):
    good = '{"document_id": "d", "block_no": 0, "type": "paragraph", "text": "t", "heading_path": []}'
    (tmp_path / "blocks.json").write_text(f"{good}\n\n{good}\n" + '{"document_id": "d7", "type": "paragraph"}\n' + good)
    with pytest.raises(ChunkError, match="line 4 of .*blocks.json"):
        stores.read_blocks(spark, str(tmp_path))
    assert [(r.line_no, r.document_id, r.missing) for r in stores.bad_lines(spark, str(tmp_path)).collect()] == [(4, "d7", "text")]
    (tmp_path / "blocks.json").write_text(f"{good}\nnot json\n")
    assert [(r.line_no, r.missing) for r in stores.bad_lines(spark, str(tmp_path)).collect()] == [(2, "json")]
    with pytest.raises(ChunkError, match="line 2"):
        stores.read_blocks(spark, str(tmp_path))


def test_turns_are_counted_while_they_are_written(spark, tmp_path):
    rows = [("answer", None, "all"), ("answer", None, "fsa-chill"), ("out_of_scope", "medical", "none"), ("not_in_corpus", "no_supporting_chunks", "all")]
    replies = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "query_id int, type string, reason string, document_scope string")
    paths = f"{tmp_path}/replies", f"{tmp_path}/log"
    for batch in ("b1", "b2", "b1"):
        turns.write_replies(replies if batch == "b2" else replies.where("type <> 'answer'"), *paths, batch)
    log = {(r.batch, r.value): (r.n, r.turns) for r in turns.read_log(spark, paths[1]).collect()}
    assert log["b2", "answer"] == (2, 4) and log["b1", "answer"] == (0, 2) and log["b2", "one"] == (1, 4) and log["b1", "medical"] == (1, 2)
    assert len(log) == 2 * len(turns.figures())
    assert spark.read.parquet(paths[0]).groupBy("batch").agg(F.count(F.lit(1)).alias("n")).orderBy("batch").collect() == [("b1", 2), ("b2", 4)]


def test_no_page_is_asked_for_twice_and_hosts_are_spared(spark, tmp_path):
    from passagework.sources import fetch

    seen = f"{tmp_path}/seen"

    def get(url):
        import time

        with open(seen, "a") as f:
            f.write(f"begin {url}\n")
        time.sleep(0.2)
        with open(seen, "a") as f:
            f.write(f"end {url}\n")
        if url.endswith("/9"):
            raise OSError("refused")
        return b"<html>x</html>", 200, "text/html", url

    rows = [(f"a{i}", f"https://one.example/{i}", False) for i in range(10)] + [("b", "not a url", False)]
    found = fetch.fetch(spark.createDataFrame(rows, "document_id string, source_url string, landing_page boolean").repartition(8), get, per_host=1)
    for _ in range(2):
        assert {r.document_id: r.error for r in found.collect()} == {**{f"a{i}": "refused" if i == 9 else None for i in range(10)}, "b": None}
        spark.catalog.clearCache()
    lines = [x for x in open(seen).read().splitlines() if "one.example" in x]
    assert len(lines) == 20 and len(set(lines)) == 20
    assert all(a.split()[0] == "begin" and b == a.replace("begin", "end") for a, b in zip(lines[::2], lines[1::2])), "one request at a time"
