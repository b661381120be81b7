from __future__ import annotations

import random
from itertools import combinations

import brute
import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F

from passagework.llm import alike, simhash


def planted():
    random.seed(11)
    rows = []
    for base in range(12):
        words = [f"w{random.randrange(9000)}" for _ in range(120)]
        for copy in range(6):
            other = list(words)
            for place in random.sample(range(120), copy):
                other[place] = f"x{random.randrange(9000)}"
            rows.append((10 * base + copy, " ".join(other), "en", "a", 0))
    return rows + [(500, None, "en", "a", 0), (501, "", "en", "a", 0), (502, "One two", "en", "a", 0), (503, "one  TWO", "en", "a", 0)]


def test_pipeline_stage_leaves_no_pair_of_similarity_of_four_fifths(spark):
    rows = planted()
    kept = corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, brute.DOCUMENTS).repartition(3), "")
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for c in brute.near_copies(rows).values()})


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_documents_match_brute_force(spark, sf):
    df = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")
    assert {r.doc_id: r.component_id for r in alike.near_copies(df).collect()} == brute.near_copies([tuple(r) for r in df.select("doc_id", "text").collect()])


def test_chains_are_linked_through_strays_of_a_cell(spark):
    """One band of one value: every node meets the others, few of them are alike."""
    rows = planted()
    o = alike.Alike(bands=200, rows=1)
    assert {r.doc_id: r.component_id for r in alike.near_copies(spark.createDataFrame(rows, brute.DOCUMENTS), o).collect()} == brute.near_copies(rows)


def test_empty_and_null_ids(spark):
    assert alike.near_copies(spark.createDataFrame([], brute.DOCUMENTS)).count() == 0
    df = spark.createDataFrame([(None, "a b", "en", "a", 0), (None, "a b", "en", "a", 0), (1, "a b", "en", "a", 0), (1, "a b", "en", "a", 0)], brute.DOCUMENTS)
    assert sorted(r.doc_id or 0 for r in alike.one_of_each(df).collect()) == [0, 0, 1]


@pytest.mark.parametrize("one", [alike.one_of_each, simhash.one_of_each])
def test_of_rows_with_one_id_the_smallest_text_stays(spark, one):
    rows = [(1, "b " * 9, "en", "z", 0), (1, "a " * 9, "en", "y", 0), (1, "a " * 9, "de", "x", 0), (2, None, "en", "a", 0), (3, "", "en", "a", 0), (None, None, "en", "a", 0), (None, "b " * 9, "en", "a", 0)]
    for n in (1, 4):
        kept = one(spark.createDataFrame([(*r, "t") for r in rows], brute.DOCUMENTS + ", TEXT string").repartition(n))
        assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars", "TEXT"]
        assert brute.in_order(r[:4] for r in kept.collect()) == brute.in_order([(1, "a " * 9, "de", "x"), (2, None, "en", "a"), (None, None, "en", "a"), (None, "b " * 9, "en", "a")])


def test_sketches_never_rule_out_a_pair():
    """They differ in no more bits than the sets in shingles, and in hardly fewer for short texts."""
    rng = np.random.default_rng(1)
    for n in (3, 200, 5000):
        a = rng.integers(0, 1 << 63, n).astype(np.uint64)
        b = np.concatenate([a[: n - n // 10], rng.integers(0, 1 << 63, n // 9).astype(np.uint64)])
        x, y = alike._sketches(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]))
        bits = int(np.bitwise_count(x ^ y).sum())
        assert 0.8 * min(len(np.setxor1d(a, b)), 400) <= bits <= len(np.setxor1d(a, b))


def test_fingerprints_alone_find_copies_within_three_bits(spark):
    """without bands the pairs of close fingerprints are still met, and those that are not alike stay apart."""
    random.seed(5)
    words = [f"w{random.randrange(9000)}" for _ in range(2000)]
    other = [f"v{random.randrange(9000)}" for _ in range(2000)]
    texts = [" ".join(words), " ".join([*words[:-1], "x"]), " ".join(["y", *words[1:]]), " ".join(other), "one two", "", None]
    prints = [simhash.fingerprint(t.encode()) for t in texts[:4]]
    assert (prints[0] ^ prints[1]).bit_count() <= 3 and (prints[0] ^ prints[2]).bit_count() <= 3 < (prints[0] ^ prints[3]).bit_count()
    docs = spark.createDataFrame([(i, t, "en", "a", 0) for i, t in enumerate(texts)], brute.DOCUMENTS)
    found = {r.doc_id: r.component_id for r in alike.near_copies(docs, alike.Alike(bands=0)).collect()}
    assert found == {0: 0, 1: 0, 2: 0, 3: 3, 4: 4, 5: 5, 6: 5}


def test_fingerprints_within_three_bits_share_a_cell(spark):
    random.seed(6)
    rows = []
    for _ in range(300):
        a = random.getrandbits(64)
        b = a
        for bit in random.sample(range(64), 3):
            b ^= 1 << bit
        rows.append(tuple(x - (1 << 64) if x >> 63 else x for x in (a, b)))
    df = spark.createDataFrame(rows, "a bigint, b bigint")
    assert df.where(~F.arrays_overlap(simhash.shared_cells(F.col("a")), simhash.shared_cells(F.col("b")))).count() == 0


def test_fingerprints_within_three_bits_meet_in_cells_whose_head_is_further_off(spark):
    """of a fingerprint cell all pairs within three bits are compared, not those with its head alone."""
    random.seed(9)
    words = [f"w{random.randrange(9000)}" for _ in range(2000)]
    texts = []
    for _ in range(150):
        other = list(words)
        for place in random.sample(range(2000), 18):
            other[place] = f"x{random.randrange(9000)}"
        texts.append(" ".join(other))
    prints = [simhash.fingerprint(t.encode()) for t in texts]
    edges = [0, 11, 22, 33, 44, 54, 64]
    masks = [sum((1 << b) - (1 << a) for a, b in three) for three in combinations(list(zip(edges, edges[1:])), 3)]
    bits = lambda i, j: (prints[i] ^ prints[j]).bit_count()
    close = [(b, c) for b, c in combinations(range(150), 2) if 0 < bits(b, c) <= 3]
    head, b, c = next((a, b, c) for b, c in close for a in range(150) if bits(a, b) > 3 and bits(a, c) > 3 and all((prints[a] ^ prints[b]) & m == 0 for m in masks if (prints[b] ^ prints[c]) & m == 0))
    docs = spark.createDataFrame([(i, texts[t], "en", "a", 0) for i, t in enumerate((head, b, c))], brute.DOCUMENTS)
    assert {r.doc_id: r.component_id for r in alike.near_copies(docs, alike.Alike(bands=0)).collect()} == {0: 0, 1: 1, 2: 1}
