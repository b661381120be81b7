"""Keeps the passages of a growing folder of documents up to date.

    spark-submit jobs/refresh_passages.py --config jobs/refresh_passages.json

Each run takes the files that no run has taken (a file stream with a checkpoint, until there are no more),
drops documents whose text is the one already held, cuts the others into retrieval passages and appends them:

    <output>/passages   batch_id, lang (both partitions); doc_id, ordinal, chunk_id, text, tokens
    <output>/rejected   batch_id (partition); doc_id, block_no, error, start: paragraphs that no sentence end divides
    <output>/versions   batch_id (partition); doc_id, text_sha256, n_passages: what each batch made of a document
    <output>/log        batch_id (partition); rows read, documents taken and passages written, as JSON

Nothing that stands is rewritten, and a batch that is run again overwrites its own partitions with the same rows.  A
document's passages are those of its last version, which is written after them; ``current`` reads these.
"""

from __future__ import annotations

import os
import sys

if __name__ == "__main__":
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from jobs import common
from passagework.operators import chunking

LOG = common.log_of("refresh_passages")
DOCUMENTS = "doc_id bigint, text string, lang string"
PASSAGES = "doc_id bigint, ordinal int, chunk_id string, text string, tokens int, lang string, batch_id bigint"
REJECTED = "doc_id bigint, block_no bigint, error string, start string, batch_id bigint"
VERSIONS = "doc_id bigint, text_sha256 string, n_passages bigint, batch_id bigint"
RUNS = "rows_read bigint, without_id bigint, documents bigint, passages bigint, batch_id bigint"
TABLES = {"passages": (PASSAGES, ["batch_id", "lang"], "parquet"), "rejected": (REJECTED, ["batch_id"], "parquet"), "versions": (VERSIONS, ["batch_id"], "parquet"), "log": (RUNS, ["batch_id"], "json")}


def _table(spark: SparkSession, output: str, name: str) -> DataFrame:
    schema, _, kind = TABLES[name]
    return spark.read.schema(schema).format(kind).load(f"{output}/{name}")


def _write(df: DataFrame, output: str, name: str) -> None:
    """Puts a batch's rows into partitions that are this batch's alone."""
    _, parts, kind = TABLES[name]
    df.write.format(kind).mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*parts).save(f"{output}/{name}")


def last_versions(spark: SparkSession, output: str, before: int | None = None) -> DataFrame:
    """(doc_id, batch_id, text_sha256, n_passages) of each document's last version, of batches under ``before`` if given."""
    rows = _table(spark, output, "versions")
    rows = rows if before is None else rows.where(F.col("batch_id") < before)
    last = F.max(F.struct("batch_id", "text_sha256", "n_passages")).alias("v")
    return rows.groupBy("doc_id").agg(last).select("doc_id", "v.*")


def current(spark: SparkSession, output: str) -> DataFrame:
    """The passages of every document's last version."""
    return _table(spark, output, "passages").join(last_versions(spark, output).select("doc_id", "batch_id"), ["doc_id", "batch_id"], "left_semi")


def _newest(rows: DataFrame) -> DataFrame:
    """One row per doc_id: that of the file changed last (then the greater path, text and language)."""
    last = F.max(F.struct("changed", "path", "text", "lang")).alias("r")
    return rows.where("doc_id is not null").groupBy("doc_id").agg(last).select("doc_id", "r.text", "r.lang")


def blocks_of(docs: DataFrame) -> DataFrame:
    """Each line of a document as a paragraph block without headings: what ``chunking.packed_lines`` takes them for."""
    none = F.lit(None).cast("array<string>")
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))
    return lines.select(F.col("doc_id").cast("string").alias("document_id"), F.col("line_no").cast("bigint").alias("block_no"), F.lit("paragraph").alias("type"), F.col("line").alias("text"), none.alias("heading_path"), none.alias("header"))


def _take(rows: DataFrame, batch_id: int, output: str, target_tokens: int) -> None:
    spark = rows.sparkSession
    read, made = Observation(), Observation()
    rows = rows.observe(read, F.count(F.lit(1)).alias("rows"), F.count_if(F.col("doc_id").isNull()).alias("without_id"))
    docs = _newest(rows).withColumn("text_sha256", F.sha2(F.coalesce("text", F.lit("")), 256))
    held = last_versions(spark, output, batch_id).select("doc_id", "text_sha256")
    fresh = docs.join(held, ["doc_id", "text_sha256"], "left_anti")
    # A row per document with its passages and what was rejected of it: all three tables are parts of these.
    cut = chunking.packed_lines(fresh, target_tokens).persist()  # saves work; if it is lost it is made again
    batch = F.lit(batch_id).cast("bigint").alias("batch_id")
    passages = cut.select("doc_id", "lang", F.posexplode("passages").alias("ordinal", "p"))
    passages = passages.select("doc_id", "ordinal", F.concat_ws(":", "doc_id", "ordinal").alias("chunk_id"), "p.text", "p.tokens", "lang", batch)
    _write(passages.observe(made, F.count(F.lit(1)).alias("rows")), output, "passages")
    _write(cut.select("doc_id", F.inline("rejected")).select("*", batch), output, "rejected")
    _write(cut.select("doc_id", "text_sha256", F.size("passages").cast("bigint").alias("n_passages"), batch), output, "versions")
    documents = _table(spark, output, "versions").where(F.col("batch_id") == batch_id).count()
    cut.unpersist()
    run = (read.get["rows"], read.get["without_id"], documents, made.get["rows"], batch_id)
    _write(spark.createDataFrame([run], RUNS), output, "log")
    LOG.info("batch %d: read %d rows (%d without doc_id), took %d new or changed documents, wrote %d passages to %s", batch_id, *run[:4], output)


def refresh_passages(spark: SparkSession, source: str, output: str, checkpoint: str, target_tokens: int = 200, files_per_batch: int = 1000) -> dict:
    """Takes what is new in ``source``, a folder (or glob) of Parquet files of documents (doc_id, text, lang).

    Of several rows of one doc_id the one of the newest file counts; an earlier batch's passages give way to a later
    one's.  Rows without doc_id are counted and left out; null or blank texts make no passages and retire
    those the document had.  Returns the number of batches of this run and of current documents and passages."""
    for name, (schema, parts, kind) in TABLES.items():
        spark.createDataFrame([], schema).write.format(kind).mode("ignore").partitionBy(*parts).save(f"{output}/{name}")
    before = _table(spark, output, "log").count()
    stream = spark.readStream.schema(DOCUMENTS).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    rows = stream.select("doc_id", "text", "lang", F.col("_metadata.file_modification_time").alias("changed"), F.col("_metadata.file_path").alias("path"))
    query = (
        rows.writeStream.foreachBatch(lambda batch, batch_id: _take(batch, batch_id, output, target_tokens))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    batches = _table(spark, output, "log").count() - before
    totals = last_versions(spark, output).agg(F.count(F.lit(1)).alias("documents"), F.coalesce(F.sum("n_passages"), F.lit(0)).alias("passages")).first()
    done = {"batches": batches, "documents": totals.documents, "passages": totals.passages}
    LOG.info("read %s in %d batches; %s holds %d documents with %d passages", source, batches, output, done["documents"], done["passages"])
    return done


if __name__ == "__main__":
    common.main(
        "refresh_passages",
        "Keeps the passages of a growing folder of documents up to date.",
        refresh_passages,
        {
            "source": (str, "folder of Parquet files of documents"),
            "output": (str, "folder of the passages"),
            "checkpoint": (str, "folder of the stream's checkpoint"),
            "target_tokens": (int, "estimated tokens that a passage may have"),
            "files_per_batch": (int, "files of one batch"),
        },
        ("source", "output", "checkpoint"),
    )
