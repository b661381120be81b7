from __future__ import annotations

from collections import Counter

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from passagework.llm import mixing


def test_targets_share_everything_and_stop_at_three_times():
    got = mixing.targets({"a": 10, "b": 1000, "c": 990, None: 100})
    # Weights 5, 2, 1, 5: a stops at 30 and the null source at 300; b and c share the rest 2 to 1.
    assert got == {"a": 30, None: 300, "b": pytest.approx((2100 - 330) * 2 / 3), "c": pytest.approx((2100 - 330) / 3)}
    assert sum(got.values()) == pytest.approx(2100)
    assert mixing.targets({}) == {}
    assert mixing.targets({"x": 0}) == {"x": 0}


def test_sources_stand_by_code_point():
    got = mixing.targets({"\U0001f600": 1000, "￿": 1000, "Z": 1000})
    assert got == {"Z": pytest.approx(1875), "￿": pytest.approx(750), "\U0001f600": pytest.approx(375)}


def test_permutations():
    for n in (1, 2, 3, 7, 64, 1000):
        for key in (1, 2):
            got = mixing.permuted(np.arange(n), np.full(n, n), np.full(n, key, np.uint64))
            assert sorted(got.tolist()) == list(range(n))
            assert mixing.permuted(got, np.full(n, n), np.full(n, key, np.uint64), back=True).tolist() == list(range(n))
    a, b = (mixing.permuted(np.arange(1000), np.full(1000, 1000), np.full(1000, k, np.uint64)) for k in (1, 2))
    assert (a != b).mean() > 0.9


def test_slots_fill_shards_by_the_draws_and_take_blocks_evenly(spark):
    plan = mixing.Plan({"a": 64 * 300, "b": 64 * 50, None: 64 * 1000}, 64, 128, 17, 3.0, (5, 2, 1))
    rows = mixing.slots(spark, plan).collect()
    by = Counter(r.src for r in rows)
    assert [by[i] for i in range(3)] == plan.slots
    for src in range(3):
        numbers = sorted(r.slot for r in rows if r.src == src)
        assert numbers == list(range(plan.slots[src]))
        times = Counter(r.block for r in rows if r.src == src)
        whole = plan.slots[src] // plan.blocks[src]
        assert set(times.values()) <= {whole, whole + 1}
    for shard in range(plan.shards - 2):
        assert Counter(r.src for r in rows if r.shard == shard) == Counter({i: int(n) for i, n in enumerate(plan.draw(shard)) if n})


def check(rows):
    by = {}
    for r in rows:
        by.setdefault(r.source, []).append(r)
    want = mixing.targets({s: sum(r.size for r in rs) for s, rs in by.items()})
    for s, rs in by.items():
        assert {r.target for r in rs} == {want[s]} and {r.source_size for r in rs} == {sum(r.size for r in rs)}
        assert abs(sum(r.taken for r in rs) - want[s]) <= 16 or sum(r.size for r in rs) < 32
    for r in rows:
        assert 0 <= r.taken <= 3 * r.size
        assert r.taken == sum(c.times * (c.stop - c.first) for c in r.cuts or [])
        assert all(0 <= c.first < c.stop <= r.size for c in r.cuts or [])


def test_documents_meet_their_targets_and_reruns_agree(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = mixing.mix_documents(df).collect()
    assert len(rows) == df.count()
    check(rows)
    again = mixing.mix_documents(df.repartition(5, F.rand(1))).collect()
    assert brute.in_order(r[:7] for r in rows) == brute.in_order(r[:7] for r in again)


def test_awkward_rows(spark):
    rows = brute.awkward_documents()
    df = spark.createDataFrame(rows, brute.DOCUMENTS)
    found = mixing.mix_documents(df).collect()
    assert brute.in_order((r.doc_id, r.source, r.size) for r in found) == brute.in_order((r[0], r[3], len(brute.WORDS.findall(r[1] or ""))) for r in rows)
    check(found)
    assert mixing.mix_documents(df.limit(0)).count() == 0
    assert mixing.mix_documents(df.where("doc_id = 7")).collect()[0].taken == 0


def test_mixed_documents_hold_what_is_taken(spark):
    rows = brute.awkward_documents()
    df = spark.createDataFrame([(*r, "kept") for r in rows], brute.DOCUMENTS + ", grp string")
    mixed = mixing.mixed_documents(df)
    assert mixed.columns == df.columns
    got = Counter()
    words = {r[0]: brute.WORDS.findall(r[1] or "") for r in rows if r[0] not in (None, 2)}
    for r in mixed.collect():
        assert r.grp == "kept" and r.n_chars == len(r.text)
        got[r.doc_id] += len(brute.WORDS.findall(r.text))
        if r.doc_id in words:
            assert set(brute.WORDS.findall(r.text)) <= set(words[r.doc_id])
    want = Counter()
    for r in mixing.mix_documents(df).collect():
        want[r.doc_id] += r.taken
    assert +got == +want


MASK = (1 << 64) - 1


def mixed_bits(x):
    """The fixed mixing of 64-bit numbers, in whole numbers."""
    x ^= x >> 31
    x = x * 0xD6E8FEB86659FD93 & MASK
    x ^= x >> 29
    x = x * 0xA0761D6478BD642F & MASK
    return x ^ x >> 32


def place_of(index, n, key):
    """Where a permutation of 0 .. n-1 sends ``index``: Feistel rounds, repeated until it falls inside."""
    half = max(1, ((max(n, 2) - 1).bit_length() + 1) // 2)
    while True:
        left, right = index >> half, index & (1 << half) - 1
        for r in range(4):
            left, right = right, left ^ mixed_bits(right + mixed_bits(key + r & MASK) & MASK) & (1 << half) - 1
        index = left << half | right
        if index < n:
            return index


@pytest.mark.parametrize("block, shard", [(32, 4096), (8, 64)])
def test_taken_words_are_those_of_a_plain_mix(spark, block, shard):
    """Shard by shard and slot by slot, over the words of each source laid out one after the other."""
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    found = mixing.mix_documents(df, block, shard).collect()
    buckets = max(1, df.count() // mixing.BUCKET_ROWS)
    rows = [tuple(r) for r in df.selectExpr("doc_id", "source", "text", f"pmod(xxhash64(doc_id, xxhash64(text)), {buckets}) as bucket", "xxhash64(text) as salt").collect()]
    sizes, laid = {}, {}
    for doc, source, text, _, _ in sorted(rows, key=lambda r: (r[3], r[0], len(brute.WORDS.findall(r[2] or "")), r[4])):
        n = len(brute.WORDS.findall(text or ""))
        sizes[source] = sizes.get(source, 0) + n
        laid.setdefault(source, []).extend([doc] * n)
    plan = mixing.Plan(sizes, block, shard, 17, 3.0, (5, 2, 1))
    given, taken = [0] * len(plan.names), Counter()

    def give(src):
        epoch, at_ = divmod(given[src], plan.blocks[src])
        key = mixed_bits(mixed_bits(17 + src) + epoch & MASK)
        first = place_of(at_, plan.blocks[src], key) * block
        taken.update(laid[plan.names[src]][first : first + block])
        given[src] += 1

    for number in range(sum(plan.slots) // shard):
        for src, n in enumerate(np.random.default_rng([17, number]).multinomial(shard, np.array(plan.slots) / sum(plan.slots))):
            for _ in range(min(int(n), plan.slots[src] - given[src])):
                give(src)
    for src, wanted in enumerate(plan.slots):
        while given[src] < wanted:
            give(src)
    assert {r.doc_id: r.taken for r in found} == {r[0]: taken[r[0]] for r in rows}


def test_rows_without_an_id_are_spread(spark):
    rows = [(None, f"some words of text {i}", "en", "a", 0) for i in range(3000)] + [(1, "x " * 50, "en", "b", 0)]
    df = spark.createDataFrame(rows, brute.DOCUMENTS)
    found = mixing.mix_documents(df).collect()
    check(found)
    sized = mixing.word_counts(df)
    buckets = sized.selectExpr("pmod(xxhash64(doc_id, salt), 12) as b").groupBy("b").count().collect()
    assert len(buckets) == 12 and max(r["count"] for r in buckets) < 400
    assert sum(len(brute.WORDS.findall(r.text)) for r in mixing.mixed_documents(df).collect()) == sum(r.taken for r in found)
