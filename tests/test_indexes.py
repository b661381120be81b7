from __future__ import annotations

import os
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from passagework.errors import VectorIndexError
from passagework.operators import inverted, retrieval
from passagework.operators.embedding import HashingEmbedder
from passagework.sources import buckets

INDEX = "chunk_id string, document_id string, ordinal int, embedding array<float>"


def points(n, seed=1, dim=8):
    rng = np.random.default_rng(seed)
    middles = rng.normal(size=(6, dim)) * 4
    return [(f"c{i:04d}", f"d{i % 6}", i % 6, (middles[i % 6] + rng.normal(size=dim)).tolist()) for i in range(n)]


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    rows = points(600) + [(f"same{i}", "d9", 9, [1.0] * 8) for i in range(40)] + [("none", "d0", 0, None), ("zero", "d0", 0, [0.0] * 8)]
    df = spark.createDataFrame(rows, INDEX)
    path = f"{tmp_path_factory.mktemp('lists')}/index"
    inverted.build(df, path, inverted.Coarse(lists=6))
    return df, path


def asked(spark, ids="string"):
    rows = [(i, v) for i, (_, _, _, v) in enumerate(points(30, seed=2))] + [(97, [1.0] * 8), (98, None), (99, [0.0] * 8)]
    return spark.createDataFrame(rows, "query_id bigint, embedding array<float>").withColumn("query_id", F.col("query_id").cast(ids))


def hits(df):
    return sorted((str(r.query_id), r.place, r.chunk_id, round(r.similarity, 6)) for r in df.collect())


@pytest.mark.parametrize("cells,blocks", [(1 << 16, 2048), (37, 4)])
def test_all_lists_give_the_exact_neighbours(spark, index, monkeypatch, cells, blocks):
    df, path = index
    monkeypatch.setattr(retrieval, "CELL_ROWS", cells)
    want = retrieval.nearest(df, asked(spark, "bigint").withColumn("scope_id", F.lit(None).cast("string")), 7)
    want = hits(want)
    monkeypatch.setattr(retrieval, "QUERIES_AT_ONCE", blocks)
    assert hits(inverted.search(spark, path, asked(spark), 7)) == want


def test_few_lists_find_most_and_open_no_other(spark, index):
    _, path = index
    exact = inverted.search(spark, path, asked(spark), 5)
    some = inverted.search(spark, path, asked(spark), 5, probes=3)
    assert 0.9 <= inverted.recall(some, exact) <= 1.0
    one = inverted.search(spark, path, asked(spark).where("query_id = '97'"), 5, probes=1)
    assert re.search(r"PartitionFilters: \[[^\]]*\(list#\d+ = \d+\)", one._jdf.queryExecution().toString())
    assert {r.chunk_id[:4] for r in one.collect()} == {"same"}


def test_ids_keep_their_type_and_twins_are_asked_each(spark, index):
    _, path = index
    q = spark.createDataFrame([("007", [1.0] * 8), ("007", [1.0] * 8)], "query_id string, embedding array<double>")
    found = inverted.search(spark, path, q, 2).collect()
    assert [r.query_id for r in found] == ["007"] * 4


def test_an_empty_index_and_no_questions(spark, index, tmp_path):
    _, path = index
    assert inverted.search(spark, path, asked(spark).limit(0), 3).count() == 0
    inverted.build(spark.createDataFrame([], INDEX), f"{tmp_path}/empty")
    assert inverted.train(spark.createDataFrame([], INDEX)).shape[0] == 0


# Buckets

STORE = "chunk_id string, text string, n int"


def files(path):
    return {os.path.join(d, f) for d, _, names in os.walk(path) for f in names if f.startswith("part-")}


def held(spark, path):
    return sorted((r.chunk_id, r.n) for r in buckets.read(spark, path).collect())


@pytest.fixture
def store(spark, tmp_path):
    path = f"{tmp_path}/store"
    buckets.create(spark.createDataFrame([(f"k{i}", "t", i) for i in range(200)], STORE), path, 16)
    return path


def test_untouched_buckets_keep_their_files(spark, store):
    before = files(store)
    changes = spark.createDataFrame([("k3", "t", -3), ("new", "t", 1000)], STORE)
    touched = buckets.upsert(spark, store, changes, spark.createDataFrame([("k4",), ("nobody",)], "chunk_id string"), 16)
    names = lambda fs, b: {f for f in fs if f"/bucket={b}/" in f}
    after = files(store)
    assert len(touched) <= 4 and all(names(before, b) == names(after, b) for b in range(16) if b not in touched)
    assert all(names(before, b).isdisjoint(names(after, b)) for b in touched)
    assert held(spark, store) == sorted([(f"k{i}", -3 if i == 3 else i) for i in range(200) if i != 4] + [("new", 1000)])
    assert buckets.upsert(spark, store, changes.limit(0), None, 16) == []


def test_a_bucket_that_loses_all_its_rows_goes(spark, store):
    rows = buckets.read(spark, store)
    gone = rows.where("bucket = 5").select("chunk_id")
    ids = {r.chunk_id for r in gone.collect()}
    buckets.upsert(spark, store, rows.limit(0).drop("bucket"), spark.createDataFrame([(i,) for i in ids], "chunk_id string"), 16)
    assert not files(f"{store}/bucket=5") and held(spark, store) == sorted((f"k{i}", i) for i in range(200) if f"k{i}" not in ids)


@pytest.mark.parametrize("at", ["staging", "replacing", "removing"])
def test_an_upsert_that_breaks_off_is_ended_or_dropped(spark, store, monkeypatch, at):
    changes = spark.createDataFrame([("k3", "t", -3)], STORE)
    write, delete, calls = buckets._write, buckets.delete, []

    def broken(rows, path, mode):
        calls.append(path)
        if at == "staging" or (at == "replacing" and path == store):
            raise OSError("lost")
        write(rows, path, mode)

    def kept(spark, path):
        if at == "removing" and path.endswith(".staged") and calls:
            raise OSError("lost")
        delete(spark, path)

    monkeypatch.setattr(buckets, "_write", broken)
    monkeypatch.setattr(buckets, "delete", kept)
    with pytest.raises(OSError, match="lost"):
        buckets.upsert(spark, store, changes, None, 16)
    monkeypatch.setattr(buckets, "_write", write)
    monkeypatch.setattr(buckets, "delete", delete)
    buckets.recover(spark, store)
    assert held(spark, store) == sorted((f"k{i}", -3 if i == 3 and at != "staging" else i) for i in range(200))
    buckets.upsert(spark, store, changes, None, 16)
    assert ("k3", -3) in held(spark, store) and not os.path.exists(f"{store}.staged")


def test_twice_in_one_batch_is_an_error(spark, store):
    with pytest.raises(VectorIndexError, match="k1"):
        buckets.upsert(spark, store, spark.createDataFrame([("k1", "t", 1), ("k1", "t", 2)], STORE), None, 16)


def scanned(df):
    """Files and rows that the scan of ``df`` read."""
    plan = df._jdf.queryExecution().executedPlan()
    plan.executeCollect()
    leaf = plan.collectLeaves().head()
    metric = lambda n: leaf.metrics().get(n).get().value()
    return metric("numFiles"), metric("numOutputRows")


def test_lookups_open_only_what_they_need(spark, tmp_path):
    path = f"{tmp_path}/big"
    buckets.create(spark.range(40000).select(F.format_string("k%06d", "id").alias("chunk_id"), F.lit("t").alias("text"), F.col("id").cast("int").alias("n")), path, 8)
    ids = spark.createDataFrame([("k000007",), ("k000007",), ("none",), (None,)], "chunk_id string")
    found = sorted((r.chunk_id, r.n, r.found) for r in buckets.lookup(spark, path, ids, 8).collect())
    assert found == [("k000007", 7, True), ("none", None, False)]
    one = ids.where("chunk_id = 'k000007'")
    n, _ = scanned(buckets.opened(spark, path, one, 8))
    assert n == len(files(path)) / 8
    absent = spark.createDataFrame([("k000007x",)], "chunk_id string")
    assert scanned(buckets.opened(spark, path, absent, 8))[1] == 0, "a Bloom filter or range answers without reading"


def test_many_ids_are_joined(spark, store, monkeypatch):
    monkeypatch.setattr(buckets, "PUSHED_IDS", 3)
    ids = spark.createDataFrame([(f"k{i}",) for i in range(0, 400, 7)], "chunk_id string")
    assert sorted((r.chunk_id, r.found) for r in buckets.lookup(spark, store, ids, 16).collect()) == sorted((f"k{i}", i < 200) for i in range(0, 400, 7))


# Versions

def counting(path):
    """An embedder that writes down every text it is given.  Made here, so that it travels to the workers whole."""

    class Counting(HashingEmbedder):
        def embed(self, texts):
            with open(path, "a") as f:
                f.writelines(t + "\n" for t in texts)
            return HashingEmbedder.embed(self, texts)

    return Counting(8)


def version(spark, path, rows):
    df = spark.createDataFrame(rows, "chunk_id string, text string")
    buckets.write_version(df, path)
    return df


def test_refresh_embeds_changed_chunks_alone(spark, tmp_path):
    one = [(f"c{i}", f"text {i}") for i in range(500)] + [("n", None)]
    two = [(i, t + "!" if i in ("c7", "c8") else t) for i, t in one if t is None or i not in ("c9",)] + [("new", "text new")]
    paths = [f"{tmp_path}/v{i}" for i in range(3)]
    first = version(spark, paths[0], one)
    log = f"{tmp_path}/asked"
    from passagework.operators.embedding import embedded

    buckets.create(embedded(first, counting(log), "text"), f"{tmp_path}/store", 16)
    os.remove(log)
    second = version(spark, paths[1], two)
    changes = buckets.refresh(spark, f"{tmp_path}/store", paths[0], paths[1], second, counting(log), 16)
    assert sorted((r.chunk_id, r.change) for r in changes.collect()) == [("c7", "changed"), ("c8", "changed"), ("c9", "removed"), ("new", "added")]
    assert sorted(open(log).read().splitlines()) == ["text 7!", "text 8!", "text new"]
    store = {r.chunk_id: r.embedding for r in buckets.read(spark, f"{tmp_path}/store").collect()}
    assert set(store) == {i for i, _ in two} and store["c7"] == HashingEmbedder(8).embed(["text 7!"])[0].tolist()
    version(spark, paths[2], two)
    os.remove(log)
    assert buckets.refresh(spark, f"{tmp_path}/store", paths[1], paths[2], second, counting(log), 16).count() == 0 and not os.path.exists(log)


def test_equal_roots_and_empty_versions(spark, tmp_path):
    version(spark, f"{tmp_path}/a", [("x", "1")])
    version(spark, f"{tmp_path}/b", [("x", "1")])
    version(spark, f"{tmp_path}/none", [])
    assert buckets.changed_chunks(spark, f"{tmp_path}/a", f"{tmp_path}/b").count() == 0
    assert [tuple(r)[:2] for r in buckets.changed_chunks(spark, f"{tmp_path}/none", f"{tmp_path}/a").collect()] == [("x", "added")]


@pytest.mark.parametrize("at_once", [2048, 5])
def test_questions_of_any_id_type_find_their_neighbours(spark, index, monkeypatch, at_once):
    df, _ = index
    monkeypatch.setattr(retrieval, "QUERIES_AT_ONCE", at_once)
    scoped = asked(spark).withColumn("scope_id", F.when(F.col("query_id").cast("int") % 3 == 0, "d1"))
    want = hits(retrieval.nearest(df, asked(spark, "bigint").withColumn("scope_id", F.when(F.col("query_id") % 3 == 0, "d1")), 4))
    assert hits(retrieval.nearest(df, scoped, 4)) == want and len(want) > 100
    twins = spark.createDataFrame([("007", None, [1.0] * 8), ("007", None, [1.0] * 8)], "query_id string, scope_id string, embedding array<double>")
    assert [r.query_id for r in retrieval.nearest(df, twins, 3).collect()] == ["007"] * 6
