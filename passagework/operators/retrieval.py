"""Exact cosine retrieval for a batch of questions.

Vectors are scored in place: each task multiplies its vectors, batch by batch, with the query vectors,
keeps the best rows per query as it goes, and passes on at most ``k`` of them at its end, so what is
shuffled is queries times k per task.  Questions that are restricted to documents meet
only these documents' rows, which a filter on document_id selects before anything is read.
Ties are settled on the whole key (rounded similarity, registry order, chunk id), so results do
not depend on how rows are dealt.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from passagework.config import EngineConfig
from passagework.errors import RetrievalError
from passagework.folders import fresh_path
from passagework.schemas import METADATA

#: Query vectors that are sent to the tasks at once; more are joined to the index in blocks of this size.
QUERIES_AT_ONCE = 2048
#: Rows of one cell where questions pass by in blocks.
CELL_ROWS = 1 << 15
#: Similarities that a task holds at once, and bytes of rows that it gathers beyond the best before it lets the others go.
SCORES_AT_ONCE, GATHERED = 1 << 20, 1 << 24


class Best:
    """The best ``k`` rows of each of ``n`` queries among those offered so far."""

    def __init__(self, n: int, k: int):
        self.n, self.k = n, k
        self.floor = np.full(n, -np.inf)
        self.held: list[pa.Table] = []
        self.size = self.bytes = self.kept = 0

    def score(self, rows: pa.RecordBatch, vectors: np.ndarray, asked: np.ndarray, queries: np.ndarray) -> None:
        """Offers ``rows`` with their unit vectors to ``queries``, whose vectors are ``asked``, so many at once that scores stay few."""
        at_once = max(1, SCORES_AT_ONCE // max(1, len(queries)))
        for i in range(0, len(vectors), at_once):
            similarity = vectors[i : i + at_once] @ asked.T
            np.subtract(1.0, similarity, out=similarity)
            np.subtract(1.0, similarity, out=similarity)
            self.offer(rows.slice(i, at_once), similarity, queries)

    def offer(self, rows: pa.RecordBatch, similarity: np.ndarray, queries: np.ndarray) -> None:
        """``similarity``: rows x queries, of which ``queries`` gives the numbers."""
        key = np.round(similarity, 6)
        floor = self.floor[queries]
        if len(key) > self.k:
            floor = np.maximum(floor, np.partition(key, len(key) - self.k, axis=0)[len(key) - self.k])
        r, q = np.nonzero(key >= floor)
        if len(r):
            taken = pa.Table.from_batches([rows]).take(pa.array(r))
            for name, values in (("_query", queries[q]), ("_similarity", similarity[r, q]), ("_key", key[r, q])):
                taken = taken.append_column(name, pa.array(values))
            self.held.append(taken)
            self.size += len(r)
            self.bytes += taken.nbytes
            # Twice the best at most, so that what is sorted was mostly new.
            if self.bytes > max(GATHERED, 2 * self.kept):
                self.rows()

    def rows(self) -> pa.Table | None:
        """The best rows so far, by query and place; all else is let go."""
        if not self.held:
            return None
        every = pa.concat_tables(self.held)
        every = every.take(pc.sort_indices(every, [("_query", "ascending"), ("_key", "descending"), ("ordinal", "ascending"), ("chunk_id", "ascending")]))
        query = every["_query"].to_numpy()
        first = np.flatnonzero(np.concatenate(([True], query[1:] != query[:-1])))
        place = np.arange(len(query)) - np.repeat(first, np.diff(np.append(first, len(query))))
        every = every.filter(pa.array(place < self.k)).combine_chunks()
        last = place == self.k - 1
        self.floor[query[last]] = np.round(every["_key"].to_numpy()[place[place < self.k] == self.k - 1], 6)
        self.held, self.size = [every], every.num_rows
        self.bytes = self.kept = every.nbytes
        return every


def _matrix(vectors: list) -> np.ndarray:
    """Unit vectors; a zero vector stays zero."""
    matrix = np.array(vectors, float).reshape(len(vectors), -1) if len(vectors) else np.zeros((0, 1))
    return matrix / np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-300)


class Asked:
    """Questions of one kind: all with a document they are restricted to, or all without."""

    def __init__(self, ids: list[int], scopes: list[str | None], vectors: list, k: int):
        self.ids, self.matrix, self.k = np.array(ids, np.int64), _matrix(vectors), k
        self.of: dict[str | None, np.ndarray] = {}
        for scope in dict.fromkeys(scopes):
            self.of[scope] = np.flatnonzero([s == scope for s in scopes])

    def nearest(self, batches: Iterator[pa.RecordBatch], others: list[str]) -> Iterator[pa.RecordBatch]:
        best = Best(len(self.ids), self.k)
        for batch in batches:
            if not batch.num_rows or not len(self.ids):
                continue
            vectors = _matrix(batch.column(batch.schema.get_field_index("embedding")).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1))
            rows = batch.select(others)
            if None in self.of:
                best.score(rows, vectors, self.matrix, np.arange(len(self.ids)))
                continue
            documents = np.array(batch.column(batch.schema.get_field_index("document_id")).to_pylist(), object)
            for scope in {*documents} & self.of.keys():
                own, queries = np.flatnonzero(documents == scope), self.of[scope]
                best.score(rows.take(pa.array(own)), vectors[own], self.matrix[queries], queries)
        yield from self._given(best, others)

    def among(self, vectors: np.ndarray, rows: pa.RecordBatch, others: list[str]) -> Iterator[pa.RecordBatch]:
        """The best of ``rows``, whose unit vectors are given, for each question."""
        best = Best(len(self.ids), self.k)
        best.score(rows, vectors, self.matrix, np.arange(len(self.ids)))
        yield from self._given(best, others)

    def _given(self, best: Best, others: list[str]) -> Iterator[pa.RecordBatch]:
        found = best.rows()
        if found is not None:
            query = found["_query"].to_numpy()
            for part in pa.table({"_q": self.ids[query], "similarity": found["_similarity"], **{c: found[c] for c in others}}).to_batches(max_chunksize=1 << 12):
                yield part


def nearest(index: DataFrame, questions: DataFrame, k: int) -> DataFrame:
    """(query_id, similarity, place) joined with all columns of ``index``: the ``k`` nearest rows per question.

    ``index``: chunk_id, document_id, ordinal (registry order of its document), embedding, and any
    others.  ``questions``: query_id, embedding, and scope_id, which restricts a question
    to one document (null: all).  Up to QUERIES_AT_ONCE questions go to the tasks that scan the
    index, which does not move; more never come to the driver: the index moves once, to cells
    that the questions pass by (``within_lists``).  Rows or questions without an embedding find nothing.  query_id may
    be of any type; questions that share one are questions of their own.
    """
    others = [c for c in index.columns if c != "embedding"]
    rows = index.where("embedding is not null").select("embedding", *others)
    asked = questions.select("query_id", "scope_id", "embedding").where("embedding is not null")
    spark = index.sparkSession
    few = asked.limit(QUERIES_AT_ONCE + 1).collect()
    # Tasks know questions by number; ids, of whatever type, are joined to what is found.
    if len(few) <= QUERIES_AT_ONCE:
        found = _in_place(rows, others, few, k)
        ids = F.broadcast(spark.createDataFrame([(i, r.query_id) for i, r in enumerate(few)], StructType([StructField("_q", LongType()), StructField("query_id", asked.schema["query_id"].dataType)])))
    else:
        at = fresh_path(spark, "questions")
        asked.select(F.monotonically_increasing_id().alias("_q"), "query_id", "scope_id", "embedding").write.parquet(at)
        numbered = spark.read.parquet(at)
        found, ids = _in_cells(rows, others, numbered, k), numbered.select("_q", "query_id")
    order = Window.partitionBy("_q").orderBy(F.round("similarity", 6).desc(), "ordinal", "chunk_id")
    best = found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)
    return best.join(ids, "_q").select("query_id", "similarity", *others, "place")


def _schema(rows: DataFrame, others: list[str]) -> str:
    types = dict(rows.dtypes)
    return "_q bigint, similarity double, " + ", ".join(f"`{c}` {types[c]}" for c in others)


def _in_place(rows: DataFrame, others: list[str], questions: list, k: int) -> DataFrame:
    """One scan for the questions without a scope, and one of the scopes' documents for the others."""

    def scan(part: DataFrame, wanted: list) -> DataFrame:
        asked = Asked([i for i, _ in wanted], [r.scope_id for _, r in wanted], [r.embedding for _, r in wanted], k)
        return part.mapInArrow(lambda batches: asked.nearest(batches, others), _schema(rows, others))

    free, held = ([(i, r) for i, r in enumerate(questions) if (r.scope_id is None) == plain] for plain in (True, False))
    scans = [scan(rows, free)] if free or not held else []
    if held:
        scans.append(scan(rows.where(F.col("document_id").isin(sorted({r.scope_id for _, r in held}))), held))
    return scans[0] if len(scans) == 1 else scans[0].unionByName(scans[1])


def _in_cells(rows: DataFrame, others: list[str], asked: DataFrame, k: int) -> DataFrame:
    """Any number of questions against all rows: those without a scope meet every row, the others their document's."""
    free = within_lists(rows.withColumn("list", F.lit(0)), asked.where("scope_id is null").select("_q", F.lit(0).alias("list"), "embedding"), others, k)
    held = within_lists(rows.withColumn("list", F.col("document_id")), asked.where("scope_id is not null").select("_q", F.col("scope_id").alias("list"), "embedding"), others, k)
    return free.unionByName(held)


def within_lists(rows: DataFrame, asked: DataFrame, others: list[str], k: int) -> DataFrame:
    """(_q, similarity) and ``others``: the best rows per question and cell among ``rows`` (list, embedding, chunk_id, others)
    of the lists that ``asked`` (_q bigint, list, embedding) names; a question may name several.

    A list's rows are dealt to cells of about CELL_ROWS.  Each row goes to one cell, once, however many questions there are;
    each question goes to all cells of its lists.  A task holds one cell's vectors and lets its questions pass by in
    blocks of QUERIES_AT_ONCE, so neither a full list nor one that is much asked for is held whole."""
    spark = rows.sparkSession
    types = dict(rows.dtypes)
    named = rows.join(asked.select("list").distinct(), "list", "left_semi")
    cells = named.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / CELL_ROWS).cast("bigint").alias("cells"))
    dealt = named.join(cells, "list").withColumn("cell", F.xxhash64("list", F.pmod(F.xxhash64("chunk_id"), "cells")))
    asks = asked.join(cells, "list").withColumn("cell", F.explode(F.transform(F.sequence(F.lit(0).cast("bigint"), F.col("cells") - 1), lambda c: F.xxhash64("list", c))))
    row = F.struct(*others) if others else F.struct(F.lit(0).alias("_none"))
    # Lists whose cells share a hash are told apart by the list itself.
    left = dealt.select("cell", F.col("list").cast("string").alias("list"), F.lit(0).alias("kind"), F.lit(None).cast("bigint").alias("_q"), F.col("embedding").cast("array<double>").alias("embedding"), row.alias("row"))
    right = asks.select("cell", F.col("list").cast("string").alias("list"), F.lit(1).alias("kind"), "_q", F.col("embedding").cast("array<double>").alias("embedding"), F.lit(None).cast(dict(left.dtypes)["row"]).alias("row"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at: tuple | None = None
        held: list[pa.RecordBatch] = []
        matrix: np.ndarray | None = None
        for batch in batches:
            column = lambda c: batch.column(batch.schema.get_field_index(c))  # noqa: B023, E731
            keys = [*zip(column("cell").to_pylist(), column("list").to_pylist(), column("kind").to_pylist())]
            edges = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]
            for first, stop in zip(edges, edges[1:]):
                if first == stop:
                    continue
                part, (cell, name, kind) = batch.slice(first, stop - first), keys[first]
                if (cell, name) != at:
                    at, held, matrix = (cell, name), [], None
                if kind == 0:
                    held.append(part)
                    continue
                if not held:
                    continue
                if matrix is None:
                    vectors = pa.Table.from_batches(held)
                    matrix = _matrix(vectors["embedding"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(vectors.num_rows, -1))
                    payload = pa.RecordBatch.from_struct_array(vectors["row"].combine_chunks()) if others else None
                for i in range(0, part.num_rows, QUERIES_AT_ONCE):
                    block = part.slice(i, QUERIES_AT_ONCE)
                    asked_ = Asked(block.column(block.schema.get_field_index("_q")).to_pylist(), [None] * block.num_rows, block.column(block.schema.get_field_index("embedding")).to_pylist(), k)
                    yield from asked_.among(matrix, payload, others)

    met = left.unionByName(right)
    # The number of tasks follows the session's; cells are many more than tasks where the index is large.
    met = met.repartition("cell").sortWithinPartitions("cell", "list", "kind")
    return met.mapInArrow(run, "_q bigint, similarity double, " + ", ".join(f"`{c}` {types[c]}" for c in others))


def integrity(index: DataFrame, registry: DataFrame) -> DataFrame:
    """(chunk_id, rule) of index rows that must not be retrieved: missing text or metadata, or a document outside the registry."""
    known = index.join(F.broadcast(registry.select("document_id", F.lit(True).alias("known"))), "document_id", "left")
    lacking = F.col("text").isNull()
    for c in METADATA:
        lacking = lacking | F.col(c).isNull()
    return known.withColumn("rule", F.when(lacking, "missing text or metadata").when(F.col("known").isNull(), "document_id outside the registry")).where("rule is not null").select("chunk_id", "rule")


def with_prefix(messages: DataFrame, config: EngineConfig = EngineConfig()) -> DataFrame:
    """``messages`` with query_text: the query prefix before the message; prefix_count is how often it stands in it."""
    text = F.concat(F.lit(config.query_prefix), "message")
    times = (F.length(text) - F.length(F.replace(text, F.lit(config.query_prefix)))) / len(config.query_prefix)
    return messages.withColumn("query_text", text).withColumn("prefix_count", times.cast("int"))


def prefix_violations(messages: DataFrame, count_tokens, config: EngineConfig = EngineConfig()) -> DataFrame:
    """(query_id, rule) of questions whose text holds the prefix more than once or is over the window; they are never cut."""
    rows = with_prefix(messages, config).withColumn("tokens", count_tokens(F.col("query_text")))
    rule = F.when(F.col("prefix_count") != 1, "query prefix must occur once").when(F.col("tokens") > config.max_sequence_length, "query is over the window")
    return rows.withColumn("rule", rule).where("rule is not null").select("query_id", "rule")


def kept(candidates: DataFrame, config: EngineConfig = EngineConfig()) -> DataFrame:
    """Candidates (place per query, scope_id) that are answered from, with their rank.

    The threshold, on the unrounded similarity, comes after the cut to candidates.  A scoped
    question keeps its first rows; another keeps at most so many per document and in all.
    """
    eligible = candidates.where(F.col("similarity") >= config.min_similarity)
    per_document = F.row_number().over(Window.partitionBy("query_id", "document_id").orderBy("place"))
    capped = eligible.withColumn("own", per_document).where(F.col("scope_id").isNotNull() | (F.col("own") <= config.max_chunks_per_document))
    limit = F.when(F.col("scope_id").isNotNull(), config.top_k_filtered).otherwise(config.top_k_all)
    ranked = capped.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("place")))
    return ranked.where(F.col("rank") <= limit).drop("own", "place")


def candidates(index: DataFrame, questions: DataFrame, config: EngineConfig = EngineConfig()) -> DataFrame:
    """Pre-threshold candidates: 24 nearest over all documents, 5 within a scoped question's document."""
    found = nearest(index, questions, max(config.candidate_k, config.top_k_filtered))
    scoped = found.join(questions.select("query_id", "scope_id"), "query_id")
    return scoped.where(F.col("place") <= F.when(F.col("scope_id").isNotNull(), config.top_k_filtered).otherwise(config.candidate_k))


def retrieve(index: DataFrame, questions: DataFrame, config: EngineConfig = EngineConfig(), registry: DataFrame | None = None) -> DataFrame:
    """Ranked hits per question; with ``registry``, a damaged index row stops the batch."""
    if registry is not None:
        bad = integrity(index, registry).orderBy("chunk_id").first()
        if bad is not None:
            raise RetrievalError(bad.chunk_id, bad.rule)
    return kept(candidates(index, questions, config), config)


def grouped(hits: DataFrame) -> DataFrame:
    """(query_id, ordinal, document_id, hits): groups per document; order them by ordinal, the registry's. Hits keep their rank order."""
    fields = F.struct("rank", "chunk_id", "similarity")
    return hits.groupBy("query_id", "ordinal", "document_id").agg(F.array_sort(F.collect_list(fields)).alias("hits"))


def candidate_counts(found: DataFrame) -> DataFrame:
    return found.groupBy("query_id").agg(F.count(F.lit(1)).alias("candidate_count"))
