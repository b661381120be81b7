"""From stored documents to a published index."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagework.config import EngineConfig
from passagework.errors import VectorIndexError
from passagework.folders import delete
from passagework.operators import chunking, indexing
from passagework.operators.embedding import Embedder, embedded
from passagework.sources import stores


def publish(blocks: DataFrame, registry: DataFrame, retrieval_dates: DataFrame, embedder: Embedder, path: str, config: EngineConfig = EngineConfig(), current: DataFrame | None = None, without_uncut: bool = False) -> DataFrame:
    """Chunks, checks, embeds and publishes; returns the index manifest (one row).

    Nothing is put in place before every check has passed.  If ``current`` (an earlier manifest) has the
    same fingerprint and model, the store is left as it is.  Blocks, registry, pieces and chunks, which the checks read again, are
    written once, beside the store, and go when this returns; so each text is cut once and embedded once.
    ``without_uncut``: documents with a paragraph that cannot be cut are left out, of the registry too, instead of stopping the build.
    """
    spark = blocks.sparkSession
    work = f"{path}.building-{uuid.uuid4().hex}"

    def kept(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{work}/{name}")
        return spark.read.schema(df.schema).parquet(f"{work}/{name}")

    try:
        registry = kept(registry.withColumn("registry_ordinal", F.col("ordinal")), "registry")
        chunks = chunking.chunk_blocks(kept(blocks, "blocks"), registry, retrieval_dates, config, ("registry_ordinal",), kept, without_uncut)
        if without_uncut:
            registry = registry.join(chunking.uncut(spark.read.parquet(f"{work}/pieces")), "document_id", "left_anti")
        # A sequence over the whole set: registry order, then the chunk's own number.
        keyed = chunks.withColumn("chunk_seq", F.col("registry_ordinal").cast("bigint") * (1 << 40) + F.col("ordinal"))
        return _published(keyed, registry, embedder, path, config, current)
    finally:
        delete(spark, work)


def _published(keyed: DataFrame, registry: DataFrame, embedder: Embedder, path: str, config: EngineConfig, current: DataFrame | None) -> DataFrame:
    bad = indexing.chunk_violations(keyed, registry, config).orderBy("seq").first()
    if bad is not None:
        raise VectorIndexError(bad.chunk_id, bad.rule)
    tokens = embedder.count_tokens(F.col("embed_text"))
    over = indexing.window_check(keyed, tokens, config.max_sequence_length).first()
    if over.first_over is not None:
        raise VectorIndexError(over.first_over, f"embed_text is over {config.max_sequence_length} tokens; not truncated")
    figures = indexing.manifest(keyed, tokens, embedder.dimension, config).first()
    if current is not None:
        old = current.first()
        if old is not None and old.fingerprint == figures.fingerprint and old.model_name == config.embedding_model:
            return current
    vectors = indexing.normalized(embedded(keyed, embedder, "embed_text"))
    index = vectors.drop("norm", "ordinal").withColumnRenamed("registry_ordinal", "ordinal")

    def directed(rows: DataFrame) -> None:
        zero = rows.where(F.col("embedding").isNull() | (F.size("embedding") != embedder.dimension)).select("chunk_id").first()
        if zero is not None:
            raise VectorIndexError(zero.chunk_id, "embedding norm is zero or its dimension is wrong")

    many = registry.limit(stores.DOCUMENT_FOLDERS + 1).count() > stores.DOCUMENT_FOLDERS
    stores.write_index(index, path, figures.chunk_count, many, directed)
    return keyed.sparkSession.createDataFrame([figures])
