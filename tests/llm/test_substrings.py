from __future__ import annotations

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from passagework.llm import substrings


def digest(df):
    return brute.in_order(df.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256)).collect())


def test_awkward_rows_match_brute_force(spark):
    rows = brute.awkward_documents()
    df = spark.createDataFrame(rows, brute.DOCUMENTS).repartition(3)
    assert digest(substrings.remove_repeats(df)) == brute.in_order(brute.remove_repeats(rows))


@pytest.mark.parametrize("windows", [50, 1 << 21])
def test_documents_match_brute_force_whatever_the_block(spark, monkeypatch, windows):
    monkeypatch.setattr(substrings, "BLOCK_WINDOWS", windows)
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [tuple(r) for r in df.collect()]
    found = digest(substrings.remove_repeats(df))
    assert found == brute.in_order(brute.remove_repeats(rows))
    assert sum(r[2] for r in found) > 0


def test_intervals_are_maximal_and_cover_what_goes(spark):
    df = spark.createDataFrame(brute.awkward_documents(), brute.DOCUMENTS)
    for r in substrings.remove_repeats(df).collect():
        assert sum(x.stop - x.first for x in r.removed) == r.n_removed
        assert all(a.stop < b.first for a, b in zip(r.removed, r.removed[1:]))


def test_empty_table_and_clashing_columns(spark):
    empty = spark.createDataFrame([], brute.DOCUMENTS)
    assert substrings.remove_repeats(empty).count() == 0
    df = spark.createDataFrame([(1, "a b", 5, "x"), (2, None, 6, "y")], "doc_id bigint, text string, grp int, kept string")
    assert digest(substrings.remove_repeats(df)) == [(1, 2, 0, brute.sha("a b")), (2, 0, 0, brute.sha(""))]


def test_groups_agree_with_spark(spark):
    ids = [0, 1, -1, 2**62, -(2**63), 123456789]
    df = spark.createDataFrame([(i,) for i in ids], "i bigint")
    want = [r[1] for r in sorted(df.selectExpr("i", "pmod(xxhash64(i), 37L) as g").collect(), key=lambda r: ids.index(r.i))]
    assert substrings.group_of(np.array(ids), 37).tolist() == want


@pytest.mark.parametrize("windows", [50, 1 << 21])
def test_wide_buckets_give_the_same(spark, monkeypatch, windows):
    """The way of very many buckets, on few."""
    monkeypatch.setattr(substrings, "MANY_BUCKETS", 4)
    monkeypatch.setattr(substrings, "BLOCK_WINDOWS", windows)
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert digest(substrings.remove_repeats(df.repartition(5))) == brute.in_order(brute.remove_repeats([tuple(r) for r in df.collect()]))


def test_rows_of_one_id_with_different_texts(spark):
    """Each is judged by its own words."""
    a, b = (" ".join(f"{x}{i}" for i in range(40)) for x in "ab")
    rows = [(1, a), (2, b + " " + a), (2, a + " " + b), (2, b), (3, "x " * 20 + b), (2, a + " " + b)]
    df = spark.createDataFrame([(*r, "en", "s", 0) for r in rows], brute.DOCUMENTS).coalesce(1)
    assert digest(substrings.remove_repeats(df)) == brute.in_order(brute.remove_repeats(rows))


def test_rows_without_an_id_are_dealt_by_their_texts(spark):
    rows = [(None, " ".join(f"n{i}x{j}" for j in range(20))) for i in range(200)] + [(1, "n0x0 and more")]
    df = spark.createDataFrame([(*r, "en", "s", 0) for r in rows], brute.DOCUMENTS)
    assert digest(substrings.remove_repeats(df)) == brute.in_order(brute.remove_repeats(rows))


def test_windows_whose_hashes_agree_are_told_apart_by_the_second():
    same = np.array([7, 7, 7, 9], np.uint64)
    more = np.array([1, 2, 1, 1], np.uint64) << np.uint64(48)
    rows = np.array([[10, 0, 0], [20, 0, 0], [30, 0, 0]])
    block = substrings.Block(buckets=1)
    block.add(rows, same, more, np.array([0, 1, 2, 1]), np.array([0, 0, 0, 1]))
    keys, covered = block.marks()
    columns = [keys.column(c).to_pylist() for c in (1, 2, 3)]
    assert sorted(zip(*(x.tolist() for x in substrings.keys_of(*columns)))) == [(7, 1, 10), (7, 2, 20), (9, 1, 20)]
    assert covered.num_rows == 1 and np.frombuffer(covered.column(1)[0].as_py(), "<i8").tolist() == [30, 0]
    assert substrings.judge(*columns, groups=5).num_rows == 0
    assert substrings.judge(*([*c, *c] for c in columns), groups=5).num_rows == 0
    other = substrings.bucket_rows(np.array([0], np.uint64), np.array([7], np.uint64), np.array([2], np.uint16), np.array([5]))
    met = substrings.judge(*([*c, *other.column(i).to_pylist()] for i, c in enumerate(columns, 1)), groups=5)
    assert [np.frombuffer(x, "<i8").tolist() for x in met.column(1).to_pylist()] == [[20]]


def test_windows_that_agree_in_all_stored_bits_are_told_apart_by_their_bucket():
    block = substrings.Block(buckets=2)
    block.add(np.array([[10, 0, 0], [20, 0, 0]]), np.array([7, 7], np.uint64), np.array([0, (1 << 32) - 1], np.uint64), np.array([0, 1]), np.array([0, 0]))
    keys, covered = block.marks()
    assert keys.column(0).to_pylist() == [0, 1] and covered.num_rows == 0


@pytest.mark.parametrize("ids", [[5], [-(2**63), -1, 0, 2**63 - 1], [1, 2, 3, 300, 70000, 2**40], list(range(1000))])
def test_packed_ids_come_back(ids):
    assert substrings.unpacked_ids(substrings.packed_ids(np.array(ids, np.int64))).tolist() == ids
    assert substrings.unpacked(substrings.packed(np.array([1, 255, 256, 2**33]))).tolist() == [1, 255, 256, 2**33]


def test_long_words_that_look_alike_to_a_polynomial_stay(spark):
    a, b = brute.look_alikes()
    rows = [(1, "w " * 12 + a), (2, "w " * 12 + b), (3, "w " * 12 + a)]
    df = spark.createDataFrame([(*r, "en", "s", 0) for r in rows], brute.DOCUMENTS)
    found = digest(substrings.remove_repeats(df))
    assert found == brute.in_order(brute.remove_repeats(rows))
    assert [r[2] for r in found] == [0, 0, 13]
