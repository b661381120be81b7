"""What must hold before passages are published, and the figures of an index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passagework.config import EngineConfig
from passagework.functions import vectors as V
from passagework.schemas import CHUNK_TYPES, METADATA


def fingerprint(chunks: DataFrame, seq: str = "chunk_seq", by: list[str] | None = None) -> DataFrame:
    """SHA-256 over chunk_id and embed_text of all chunks in sequence.

    One hash over a sequence is sequential by definition; only ids and texts of one index (or of
    one group of ``by``) meet in a task.  ``fingerprint_tree`` has no such limit.
    """
    rows = chunks.select(*(by or []), seq, F.concat("chunk_id", "embed_text").alias("_t"))
    held = rows.groupBy(*(by or [])).agg(F.array_sort(F.collect_list(F.struct(seq, "_t"))).alias("_rows"))
    return held.select(*(by or []), F.sha2(F.array_join(F.transform("_rows", lambda r: r["_t"]), ""), 256).alias("fingerprint"))


def fingerprint_tree(chunks: DataFrame, seq: str = "chunk_seq", span: int = 4096) -> DataFrame:
    """A hash of hashes over spans of the sequence, for indexes of any size."""
    leaf = chunks.select(F.floor(F.col(seq) / span).alias("span"), F.struct(seq, F.sha2(F.concat("chunk_id", "embed_text"), 256).alias("h")).alias("x"))
    spans = leaf.groupBy("span").agg(F.array_sort(F.collect_list("x")).alias("xs")).select("span", F.sha2(F.array_join(F.transform("xs", lambda x: x["h"]), ""), 256).alias("h"))
    return spans.agg(F.array_sort(F.collect_list(F.struct("span", "h"))).alias("xs")).select(F.sha2(F.array_join(F.transform("xs", lambda x: x["h"]), ""), 256).alias("fingerprint"))


def window_check(chunks: DataFrame, tokens: Column, limit: int = 512, seq: str = "chunk_seq") -> DataFrame:
    """One row: the largest token count, and the first chunk over the limit (null if none)."""
    rows = chunks.withColumn("_n", tokens)
    return rows.agg(F.max("_n").alias("max_tokens"), F.min_by("chunk_id", F.when(F.col("_n") > limit, F.col(seq))).alias("first_over"))


def dimension_violations(vectors: DataFrame, dimension: int, column: str = "embedding") -> DataFrame:
    return vectors.where(F.size(column) != dimension)


def normalized(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """``vectors`` with unit embeddings and their norm before; zero vectors have a null embedding."""
    return vectors.withColumn("norm", V.l2_norm(F.col(column))).withColumn(column, V.l2_normalize(F.col(column)))


def chunk_violations(chunks: DataFrame, registry: DataFrame, config: EngineConfig = EngineConfig(), seq: str = "chunk_seq") -> DataFrame:
    """(seq, chunk_id, rule) of everything wrong with a chunk set; the smallest seq is reported first."""
    blank = lambda c: F.col(c).isNull() | (F.col(c) == "")
    copies = chunks.groupBy("chunk_id").agg(F.count(F.lit(1)).alias("n"), F.max(seq).alias(seq)).where("n > 1")
    rule = (
        F.when(~F.col("block_type").isin(*CHUNK_TYPES), "block_type cannot be indexed")
        .when(blank("text") | blank("embed_text") | blank("section_heading"), "chunk is missing text or a section heading")
        .when(F.startswith("embed_text", F.lit(config.query_prefix)), "embed_text starts with the query prefix")
    )
    uncovered = registry.join(chunks.select("document_id").distinct(), "document_id", "left_anti")
    last = F.lit(2**62)
    return (
        copies.select(F.col(seq).cast("bigint").alias("seq"), "chunk_id", F.lit("duplicate chunk_id").alias("rule"))
        .union(chunks.withColumn("rule", rule).where("rule is not null").select(F.col(seq).cast("bigint"), "chunk_id", "rule"))
        .union(uncovered.select(last, "document_id", F.lit("chunks do not cover every registry document")))
    )


def publishable(registry: DataFrame, manifest: DataFrame, files: DataFrame) -> DataFrame:
    """(ordinal, document_id, rule) of registry documents without an ok manifest row or without their file."""
    rows = registry.select("ordinal", "document_id").join(manifest.select("document_id", "status", "file"), "document_id", "left").join(files.select("file", F.lit(True).alias("there")), "file", "left")
    rule = F.when(F.col("status").isNull() | (F.col("status") != "ok"), "corpus manifest row is missing or stale").when(F.col("there").isNull(), "corpus manifest row is ok but the raw file is missing")
    return rows.withColumn("rule", rule).where("rule is not null").select("ordinal", "document_id", "rule")


def metadata_violations(chunks: DataFrame) -> DataFrame:
    """(chunk_id, field) of the first metadata field that is null or empty."""
    empty = [F.when(F.col(c).isNull() | (F.col(c).cast("string") == ""), F.lit(c)) for c in METADATA]
    return chunks.withColumn("field", F.coalesce(*empty)).where("field is not null").select("chunk_id", "field")


def manifest(chunks: DataFrame, tokens: Column, dimension: int, config: EngineConfig = EngineConfig(), seq: str = "chunk_seq") -> DataFrame:
    """The one-row figures of an index; embedded_at is UTC.  The fingerprint is ``fingerprint_tree``, which no single task has to make."""
    return (
        chunks.withColumn("_n", tokens).agg(F.max("_n").alias("max_tokens"), F.count(F.lit(1)).alias("chunk_count")).crossJoin(fingerprint_tree(chunks, seq))
        .select(F.lit(config.embedding_model).alias("model_name"), F.lit(dimension).alias("dimension"), F.lit(config.max_sequence_length).alias("max_sequence_length"), "max_tokens", "chunk_count", "fingerprint", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").alias("embedded_at"))
    )
