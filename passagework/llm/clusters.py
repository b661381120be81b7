"""Exact integer k-means whose distances are screened by block norms.

A vector's segments are stored beside it in compressed form: for each segment the norm along the
all-ones direction (with its sign) and the norm of the rest.  By Cauchy and Schwarz the inner product of a vector
and a centroid is at most that of their compressed forms, which bounds their distance from below.  Only
centroids whose bound does not exceed an exact distance already known get exact integer distances.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagework.llm.arrowtext import column, raw, tidy
from passagework.llm.shared import Scratch, pick, stored

#: Vectors compared at once.
ROWS = 4096
#: Components stay under this, so that a squared distance of up to 64 of them fits a long.
LARGEST = 1 << 27


@dataclass(frozen=True)
class Clustering:
    """``vectors``: (vec_id, cluster, distance) per vector; ``centroids``: rows of whole numbers."""

    vectors: DataFrame
    centroids: list[list[int]]


def compressed(values: np.ndarray, segments: int) -> np.ndarray:
    """Per row, for each segment: its sum over the root of its length, and the norm of what that leaves."""
    parts = values.astype(np.float64).reshape(len(values), segments, values.shape[1] // segments)
    along = parts.sum(2) / np.sqrt(parts.shape[2])
    rest = np.sqrt(np.maximum((parts * parts).sum(2) - along * along, 0))
    return np.concatenate((along, rest), 1).astype(np.float32)


def squares(values: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", values, values)


def lower_bounds(short: np.ndarray, norms: np.ndarray, c_short: np.ndarray, c_norms: np.ndarray) -> np.ndarray:
    """(vectors, centroids): no squared distance is under its bound.  What is taken off covers the rounding of 32-bit numbers."""
    both = norms.astype(np.float64)[:, None] + c_norms.astype(np.float64)[None, :]
    return both - 2 * (short.astype(np.float64) @ c_short.astype(np.float64).T) - (1e-5 * both + 1)


def nearest(values: np.ndarray, short: np.ndarray, centroids: np.ndarray, c_short: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Of each vector the nearest centroid (of equally near ones the first), the squared distance to it, and how
    many exact distances that took."""
    bounds = lower_bounds(short, squares(values), c_short, squares(centroids))
    best = np.argmin(bounds, 1)
    found = squares(values - centroids[best])
    todo = bounds <= found[:, None]
    todo[np.arange(len(values)), best] = False
    counted = len(values)
    for j in range(len(centroids)):
        rows = np.flatnonzero(todo[:, j])
        rows = rows[bounds[rows, j] <= found[rows]]
        exact = squares(values[rows] - centroids[j])
        counted += len(rows)
        less = (exact < found[rows]) | ((exact == found[rows]) & (j < best[rows]))
        found[rows[less]], best[rows[less]] = exact[less], j
    return best, found, counted


def whole_numbers(vectors: pa.Array, dims: int, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows with just ``dims`` components, all finite, and floor(scale * component) of these."""
    if pa.types.is_fixed_size_list(vectors.type):
        vectors = vectors.cast(pa.list_(vectors.type.value_type))
    sizes = np.where(vectors.is_valid().to_numpy(zero_copy_only=False), vectors.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False), -1)
    right = np.flatnonzero(sizes == dims)
    flat = vectors.take(pa.array(right)).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, dims)  # null: NaN
    finite = np.isfinite(flat).all(1)
    scaled = np.floor(flat[finite] * scale)
    if scaled.size and np.abs(scaled).max() >= LARGEST:
        raise ValueError(f"vector components beyond {LARGEST // scale}: squared distances would not fit a long")
    return right[finite], scaled.astype(np.int64)


def _binary(values: np.ndarray, kind: str) -> pa.Array:
    width = values.shape[1] * np.dtype(kind).itemsize
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(width), len(values), [None, pa.py_buffer(np.ascontiguousarray(values.astype(kind)).tobytes())]).cast(pa.binary())


def _matrix(values: pa.Array, kind: str, columns: int) -> np.ndarray:
    return raw(values)[0].view(kind).reshape(-1, columns)


def prepared(vectors: DataFrame, dims: int, scale: int, segments: int) -> DataFrame:
    """(vec_id, whole binary, short binary) of the vectors that count."""
    vectors = pick(vectors, "vec_id", "embedding")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                part = batch.slice(start, ROWS)
                rows, values = whole_numbers(column(part, "embedding"), dims, scale)
                yield pa.RecordBatch.from_arrays([column(part, "vec_id").take(pa.array(rows)), _binary(values, "<i4"), _binary(compressed(values, segments), "<f4")], ["vec_id", "whole", "short"])

    return vectors.mapInArrow(tidy(run), f"vec_id {dict(vectors.dtypes)['vec_id']}, whole binary, short binary")


def _assigned(batches: Iterator[pa.RecordBatch], centroids: np.ndarray, segments: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, their vectors, clusters, distances), slice by slice."""
    c_short = compressed(centroids, segments)
    for batch in batches:
        for start in range(0, batch.num_rows, ROWS):
            part = batch.slice(start, ROWS)
            values = _matrix(column(part, "whole"), "<i4", centroids.shape[1]).astype(np.int64)
            best, found, _ = nearest(values, _matrix(column(part, "short"), "<f4", c_short.shape[1]), centroids, c_short)
            yield part, values, best, found


def moved(points: DataFrame, centroids: np.ndarray, segments: int) -> np.ndarray:
    """Each centroid's successor: the componentwise floor of the mean of the vectors nearest to it, itself if there is none.

    A task passes on one row of sums for each centroid; the driver gets one for each centroid in all."""
    k, dims = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((k, dims), np.int64), np.zeros(k, np.int64)
        for _, values, best, _ in _assigned(batches, centroids, segments):
            order = np.argsort(best, kind="stable")
            met, starts = np.unique(best[order], return_index=True)
            sums[met] += np.add.reduceat(values[order], starts) if len(met) else 0
            counts += np.bincount(best, minlength=k)
        held = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array(counts[held]), *(pa.array(c) for c in sums[held].T)], names)

    names = ["cluster", "n", *(f"s{i}" for i in range(dims))]
    partial = points.mapInArrow(tidy(run), ", ".join(["cluster int", *(f"{c} bigint" for c in names[1:])]))
    out = centroids.copy()
    for row in partial.groupBy("cluster").agg(*(F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in names[1:])).collect():
        out[row.cluster] = [int(s) // int(row.n) for s in row[2:]]
    return out


def cluster(vectors: DataFrame, k: int = 40, rounds: int = 5, seed: str = "2:", dims: int = 64, scale: int = 256, segments: int = 8) -> Clustering:
    """k-means of ``vectors`` (vec_id, embedding array<float or double>) in whole numbers floor(scale * component).

    Rows whose embedding is null, has another number of components, or a null or non-finite one do not count and
    are not returned.  Centroids start as the ``k`` vectors of least sha256(seed + vec_id) in hex (rows without
    vec_id last, rows of one vec_id by their numbers); fewer vectors give fewer centroids, none an empty
    result.  Each of ``rounds`` rounds replaces centroids as ``moved`` does; then vectors are assigned once more.  Of
    equally near centroids the first counts.  Repeated rows count as often as they stand.  Components of
    ``LARGEST`` or more, for which squared distances could exceed a long, are an error.
    """
    schema = f"vec_id {dict(pick(vectors, 'vec_id').dtypes)['vec_id']}, cluster int, distance bigint"
    with Scratch() as scratch:
        points = stored(prepared(vectors, dims, scale, segments), "points")
        order = F.coalesce(F.sha2(F.concat(F.lit(seed), F.col("vec_id").cast("string")), 256), F.lit("~"))
        first = points.select(order.alias("o"), "whole").orderBy("o", F.hex("whole")).limit(k).collect()
        centroids = np.array([np.frombuffer(r.whole, "<i4") for r in first], np.int64).reshape(-1, dims)
        if not len(centroids):
            return Clustering(vectors.sparkSession.createDataFrame([], schema), [])
        for _ in range(rounds):
            centroids = moved(points, centroids, segments)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part, _, best, found in _assigned(batches, centroids, segments):
                yield pa.RecordBatch.from_arrays([column(part, "vec_id"), pa.array(best, pa.int32()), pa.array(found, pa.int64())], ["vec_id", "cluster", "distance"])

        assigned = scratch.keep(stored(points.mapInArrow(tidy(run), schema), "assigned"))
    return Clustering(assigned, centroids.tolist())
