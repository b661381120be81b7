"""An approximate index: vectors in lists around coarse centroids, of which a query reads the nearest few.

The centroids are trained on a bounded sample; every vector is indexed.  The store is Parquet by list, so the lists that no
query probes are never opened.  Within a list vectors are dealt to cells of bounded size, which the questions pass by in blocks, so no list, however full
or much asked for, is held whole.  Scores are exact, and with all lists
probed so are the results.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from passagework.folders import delete, fresh_path
from passagework.operators.retrieval import _matrix, within_lists


@dataclass(frozen=True)
class Coarse:
    """``lists`` centroids, trained by ``rounds`` of k-means on the ``sample`` vectors of least hash of chunk_id."""

    lists: int = 32
    sample: int = 20_000
    rounds: int = 10


def train(vectors: DataFrame, coarse: Coarse = Coarse()) -> np.ndarray:
    """Unit centroids.  The sample, ``coarse.sample`` rows at most, is all that comes to the driver."""
    order = [F.xxhash64("chunk_id"), F.col("chunk_id")]
    held = vectors.where("embedding is not null").select("chunk_id", "embedding").orderBy(*order).limit(coarse.sample).collect()
    points = _matrix([r.embedding for r in held])
    middles = points[: coarse.lists]
    for _ in range(coarse.rounds if len(points) > coarse.lists else 0):
        own = np.argmax(points @ middles.T, axis=1)
        sums = np.zeros_like(middles)
        np.add.at(sums, own, points)
        there = np.linalg.norm(sums, axis=1) > 0
        middles = np.where(there[:, None], _matrix(list(sums)), middles)
    return middles


def _column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def _with_lists(rows: DataFrame, middles: np.ndarray, probes: int) -> DataFrame:
    """``rows`` with list: a row for each of its ``probes`` nearest centroids (of equally near ones the first)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            near = np.argsort(-np.round(_matrix(_column(batch, "embedding").to_pylist()) @ middles.T, 9), axis=1, kind="stable")[:, :probes]
            out = batch.take(pa.array(np.repeat(np.arange(batch.num_rows), near.shape[1])))
            yield pa.RecordBatch.from_arrays([*out.columns, pa.array(near.reshape(-1), pa.int32())], [*batch.schema.names, "list"])

    types = dict(rows.dtypes)
    return rows.where("embedding is not null").mapInArrow(run, ", ".join(f"`{c}` {types[c]}" for c in rows.columns) + ", list int")


def build(vectors: DataFrame, path: str, coarse: Coarse = Coarse()) -> None:
    """Writes the index of ``vectors`` (chunk_id, document_id, ordinal, embedding and any others) under ``path``.

    Rows without an embedding are left out.  Equal vectors share a list; a list of any size is written by several tasks."""
    spark = vectors.sparkSession
    middles = train(vectors, coarse)
    _with_lists(vectors, middles, 1).hint("rebalance", "list").write.partitionBy("list").parquet(f"{path}/vectors")
    spark.createDataFrame([(i, m.tolist()) for i, m in enumerate(middles)], "list int, centroid array<double>").coalesce(1).write.parquet(f"{path}/centroids")


def search(spark: SparkSession, path: str, questions: DataFrame, k: int, probes: int | None = None) -> DataFrame:
    """(query_id, similarity, place) and all columns of the index: the ``k`` nearest rows per question among the
    ``probes`` lists nearest to it, or among all (None), which is exact.

    ``questions``: query_id of any type, embedding.  Ties are settled as in ``retrieval.nearest``: similarity rounded to 6
    places, ordinal, chunk_id.  Questions without an embedding find nothing; rows that share a query_id are questions of
    their own."""
    held = [r.centroid for r in spark.read.parquet(f"{path}/centroids").orderBy("list").collect()]
    middles = np.array(held, float).reshape(len(held), -1)
    index = spark.read.parquet(f"{path}/vectors")
    others = [c for c in index.columns if c not in ("embedding", "list")]
    if not held:
        return index.join(questions.select("query_id").limit(0)).select("query_id", F.lit(0.0).alias("similarity"), *others, F.lit(1).alias("place"))
    at = fresh_path(spark, "questions")
    # Questions get numbers, which are settled by their being written; ids may be of any type.
    questions.where("embedding is not null").select(F.monotonically_increasing_id().alias("q"), "query_id", "embedding").write.parquet(at)
    asked = spark.read.parquet(at)
    probed = _with_lists(asked.select("q", "embedding"), middles, len(held) if probes is None else min(probes, len(held)))
    # At most as many numbers as there are lists; the others' files are not opened.
    wanted = sorted(r.list for r in probed.select("list").distinct().collect())
    met = within_lists(index.where(F.col("list").isin(wanted)), probed.withColumnRenamed("q", "_q"), others, k)
    order = Window.partitionBy("q").orderBy(F.round("similarity", 6).desc(), "ordinal", "chunk_id")
    best = met.withColumnRenamed("_q", "q").withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)
    return best.join(asked.select("q", "query_id"), "q").select("query_id", "similarity", *others, "place")


def recall(found: DataFrame, exact: DataFrame) -> float:
    """Share of the exact rows that were found; 1 where there are none."""
    keys = ["query_id", "chunk_id"]
    pairs = exact.select(*keys).join(found.select(*keys, F.lit(1).alias("hit")), keys, "left")
    r = pairs.agg(F.count("hit").alias("hit"), F.count(F.lit(1)).alias("all")).first()
    return r.hit / r.all if r["all"] else 1.0


__all__ = ["Coarse", "build", "delete", "recall", "search", "train"]
