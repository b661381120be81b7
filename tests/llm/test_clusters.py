from __future__ import annotations

import hashlib
import math
import random

import numpy as np
import pytest

from passagework.llm import clusters, queries


def plainly(rows, k=40, rounds=5, dims=64, scale=256):
    """Whole Python numbers, all distances."""
    kept = [(i, [math.floor(scale * float(x)) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    key = lambda r: hashlib.sha256(f"2:{r[0]}".encode()).hexdigest() if r[0] is not None else "~"
    centroids = [v for _, v in sorted(kept, key=key)[:k]]

    def assigned():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centroids)) for _, v in kept]

    for _ in range(rounds):
        near = assigned()
        for j in range(len(centroids)):
            own = [v for (_, v), (_, of) in zip(kept, near) if of == j]
            if own:
                centroids[j] = [sum(x) // len(own) for x in zip(*own)]
    return sorted(((i, j, d) for (i, _), (d, j) in zip(kept, assigned())), key=repr), centroids


def found(df, **options):
    out = clusters.cluster(df, **options)
    return sorted(((r.vec_id, r.cluster, r.distance) for r in out.vectors.collect()), key=repr), out.centroids


@pytest.mark.parametrize("kind", ["float", "double"])
def test_awkward_rows_match_brute_force(spark, kind):
    rng = random.Random(3)
    vector = lambda: [rng.uniform(-2, 2) for _ in range(4)]
    rows = [(i, vector()) for i in range(300)]
    rows += [(900, [0.0] * 4)] * 30 + [(901, None), (902, []), (903, [1.0] * 3), (904, [1.0] * 5), (905, [1.0, None, 1.0, 1.0]), (906, [math.nan] * 4), (907, [math.inf, 0.0, 0.0, 0.0]), (None, [1.0, 2.0, 3.0, 4.0]), (7, [-1000.25, 1000.0, 0.1, 5e4])]
    df = spark.createDataFrame(rows, f"vec_id bigint, embedding array<{kind}>").repartition(5)
    rows = [tuple(r) for r in df.collect()]  # as that kind of number holds them
    assert found(df, k=9, dims=4, segments=2) == plainly(rows, k=9, dims=4)


def test_vectors_match_brute_force(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    assert found(df) == plainly([(r.vec_id, r.embedding) for r in df.collect()])


def test_equally_near_centroids_and_empty_clusters(spark):
    rows = [(i, [float(i % 2)] * 4) for i in range(40)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    got = found(df, k=12, dims=4, segments=4)
    assert got == plainly(rows, k=12, dims=4) and len({j for _, j, _ in got[0]}) == 2


def test_empty_tables_few_vectors_and_clashing_columns(spark):
    empty = spark.createDataFrame([], "vec_id bigint, embedding array<float>")
    assert found(empty) == ([], [])
    few = spark.createDataFrame([(1, [1.0, 2.0], "x", 5)], "vec_id int, embedding array<float>, cluster string, n int")
    assert found(few, dims=2, segments=1) == ([(1, 0, 0)], [[256, 512]])


def test_components_that_no_long_holds_are_an_error(spark):
    df = spark.createDataFrame([(1, [3e30] * 2)], "vec_id int, embedding array<float>")
    with pytest.raises(Exception, match="would not fit a long"):
        clusters.cluster(df, dims=2, segments=1)


def test_bounds_hold_and_spare_most_distances():
    rng = np.random.default_rng(5)
    middles = rng.integers(-(1 << 20), 1 << 20, (30, 64))
    values = middles[rng.integers(0, 30, 2000)] + rng.integers(-9, 9, (2000, 64))
    short, c_short = clusters.compressed(values, 8), clusters.compressed(middles, 8)
    exact = ((values[:, None, :] - middles[None]) ** 2).sum(2)
    assert (clusters.lower_bounds(short, clusters.squares(values), c_short, clusters.squares(middles)) <= exact).all()
    best, far, counted = clusters.nearest(values, short, middles, c_short)
    assert (best == exact.argmin(1)).all() and (far == exact.min(1)).all()
    assert counted < 2 * len(values)


def test_query_of_an_empty_table(spark, tmp_path):
    spark.createDataFrame([(1, [1.0])], "vec_id bigint, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert queries.op12_centroid_clustering(spark, str(tmp_path)).count() == 0
