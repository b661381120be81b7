from __future__ import annotations

import random

import brute
import pytest
from pyspark.sql import functions as F

from passagework.llm import components, simhash


def digest(df):
    return brute.in_order(df.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")), "component_id").collect())


def test_awkward_rows_match_brute_force(spark):
    rows = brute.awkward_documents()
    assert digest(simhash.near_duplicates(spark.createDataFrame(rows, brute.DOCUMENTS).repartition(3))) == brute.in_order(brute.near_duplicates(rows))


def test_documents_match_brute_force(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert digest(simhash.near_duplicates(df)) == brute.in_order(brute.near_duplicates([tuple(r) for r in df.collect()]))


@pytest.mark.parametrize("crowded", [1, 3, 512])
@pytest.mark.parametrize("bits", [1, 2, 3])
def test_pairs_are_complete_even_in_crowded_segments(spark, crowded, bits):
    random.seed(bits)
    fps = {0, -1, -(2**63), 2**63 - 1}
    for centre in (random.getrandbits(64) for _ in range(4)):
        for _ in range(60):
            x = centre
            for b in random.sample(range(64) if _ % 2 else range(8), random.randint(0, 4)):
                x ^= 1 << b
            fps.add(x - (1 << 64) if x >> 63 else x)
    fps = sorted(fps)
    want = {(a, b) for i, a in enumerate(fps) for b in fps[i + 1 :] if bin((a ^ b) & (2**64 - 1)).count("1") <= bits}
    found = simhash.near_pairs(spark.createDataFrame([(x,) for x in fps], "fp bigint"), bits, crowded)
    assert {tuple(r) for r in found.distinct().collect()} == want


def test_components_of_chains_stars_and_loops(spark):
    links = [(i, i + 1) for i in range(10, 60)] + [(100, i) for i in range(101, 130)] + [(7, 7), (5, 6), (6, 5), (5, 6)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == {**{i: 10 for i in range(10, 61)}, **{i: 100 for i in range(100, 130)}, 7: 7, 5: 5, 6: 5}
    assert components.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_one_of_each_keeps_columns_and_clean_rows(spark):
    rows = brute.awkward_documents()
    df = spark.createDataFrame([(*r, "x") for r in rows], brute.DOCUMENTS + ", fp string")
    kept = simhash.one_of_each(df)
    assert kept.columns == df.columns
    want = {d for d, _, c in brute.near_duplicates(rows) if d is not None and d == c}
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted(want)
    assert kept.where("doc_id is null").count() == 2


def test_empty_table(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], brute.DOCUMENTS)).count() == 0
