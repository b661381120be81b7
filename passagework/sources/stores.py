"""Tables in files: blocks and chunks as JSON lines or Parquet, the manifest, and the vector store."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from passagework import schemas
from passagework.errors import ChunkError, ParseError, VectorIndexError
from passagework.folders import delete

#: Up to so many documents the vector store has a folder for each; more are dealt to so many folders by a hash.
DOCUMENT_FOLDERS, DOCUMENT_BUCKETS = 1000, 256


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def swap(df: DataFrame, path: str, fmt: str = "parquet", partition_by: tuple[str, ...] = ()) -> None:
    """Writes beside ``path`` and renames: readers see the old table or the new one, never a part.

    The old one is kept as ``.previous`` until the new one is in place, and put back if that fails.
    """
    part = f"{path}.partial-{uuid.uuid4().hex}"
    writer = df.write.format(fmt)
    (writer.partitionBy(*partition_by) if partition_by else writer).save(part)
    _place(df.sparkSession, part, path)


def _place(spark: SparkSession, part: str, path: str) -> None:
    fs, target = _fs(spark, path)
    _, new = _fs(spark, part)
    _, old = _fs(spark, f"{path}.previous")
    fs.delete(old, True)
    moved = fs.exists(target) and fs.rename(target, old)
    if not fs.rename(new, target):
        if moved:
            fs.rename(old, target)
        raise VectorIndexError(path, "could not be put in place")
    fs.delete(old, True)


def write_blocks(blocks: DataFrame, path: str) -> None:
    """One JSON object per block in order of document and block; header stands only where there is one."""
    blocks.repartitionByRange("document_id", "block_no").sortWithinPartitions("document_id", "block_no").write.option("ignoreNullFields", "true").json(path)


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, value) of text files, lines from 1 as they stand in their file.

    A file is read in blocks, each by one task.  Lines of a block are counted first; the sums of the
    blocks before it, one row per block, give a block's lines their numbers."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), "value")
    blocks = lines.groupBy("file", "block").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"))
    before = F.sum("n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    starts = blocks.select("file", "block", (F.coalesce(before, F.lit(0)) - F.col("first") + 1).alias("shift"))
    return lines.join(starts, ["file", "block"]).select("file", (F.col("at") + F.col("shift")).alias("line_no"), "value")


def bad_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, document_id, missing) of JSON lines that are no blocks: missing is the first of document_id, type and
    text that a line lacks, or json.  Blank lines are no blocks and no faults."""
    rows = numbered_lines(spark, path).where(F.trim("value") != "").withColumn("v", F.try_parse_json("value"))
    # A field that is there counts, null or not, except a document's id.
    there = lambda c: F.try_variant_get("v", f"$.{c}", "variant").isNotNull()
    document_id = F.try_variant_get("v", "$.document_id", "string")
    missing = F.when(F.col("v").isNull() | ~F.startswith(F.schema_of_variant("v"), F.lit("OBJECT")), "json").when(F.coalesce(document_id, F.lit("")) == "", "document_id").when(~there("type"), "type").when(~there("text"), "text")
    return rows.select("file", "line_no", document_id.alias("document_id"), missing.alias("missing")).where("missing is not null")


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    """Stored blocks; the first line that is none stops the reading and is named."""
    rows = spark.read.schema(schemas.BLOCKS + ", _bad string").option("columnNameOfCorruptRecord", "_bad").json(path)
    if rows.where("_bad is not null or document_id is null or type is null or text is null").limit(1).collect():
        bad = bad_lines(spark, path).orderBy("file", "line_no").first()
        if bad is not None:
            raise ChunkError(bad.document_id or "corpus", f"block on line {bad.line_no} of {bad.file} is missing fields")
        raise ChunkError("corpus", "a block has a field of another type")
    return rows.drop("_bad")


def write_chunks(chunks: DataFrame, path: str) -> None:
    chunks.repartitionByRange("document_id", "ordinal").sortWithinPartitions("document_id", "ordinal").write.json(path)


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.schema(schemas.CHUNKS + ", ordinal int").json(path)
    lost = rows.where(" or ".join(f"{c.split()[0]} is null" for c in schemas.CHUNKS.split(", "))).select("chunk_id").limit(1).collect()
    if lost:
        raise VectorIndexError(str(lost[0].chunk_id), "chunk is missing fields")
    return rows


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """The manifest's documents, one row each; values of a wrong type are null."""
    return spark.read.option("multiLine", True).schema(f"generated_at string, documents array<struct<{schemas.MANIFEST.replace(' ', ':').replace(',:', ',')}>>").json(path).select(F.inline("documents"))


def write_manifest(rows: DataFrame, path: str) -> None:
    """One JSON object: generated_at (UTC) and the rows in registry order; put in place by a rename."""
    fields = [c.split()[0] for c in schemas.MANIFEST.split(", ")]
    one = rows.agg(F.array_sort(F.collect_list(F.struct("ordinal", F.struct(*fields).alias("row")))).alias("rows")).select(
        F.to_json(F.struct(F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX").alias("generated_at"), F.transform("rows", lambda r: r["row"]).alias("documents")), {"ignoreNullFields": "false"}).alias("value")
    )
    swap(one.coalesce(1), path, "text")


def scan_corpus(registry: DataFrame, manifest: DataFrame) -> DataFrame:
    """(ordinal, document_id, document_name, kind, file) in registry order; a row that is not ok stops the scan."""
    rows = registry.join(manifest.select("document_id", "status", "file"), "document_id", "left")
    bad = rows.where("status is null or status <> 'ok' or file is null or file = ''").orderBy("ordinal").first()
    if bad is not None:
        raise ParseError(bad.document_id, "manifest row is missing or not ok")
    return rows.select("ordinal", "document_id", "document_name", "kind", "file")


def file_kind(path: str = "path"):
    """html or pdf by suffix; null for others, which callers report."""
    return F.when(F.endswith(F.lower(path), F.lit(".html")), "html").when(F.endswith(F.lower(path), F.lit(".pdf")), "pdf")


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, kind, content, sha256) of raw files."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", file_kind().alias("kind"), "content", F.sha2("content", 256).alias("sha256"))


def bucket_of_document(document_id: Column) -> Column:
    return F.pmod(F.xxhash64(document_id.cast("string")), F.lit(DOCUMENT_BUCKETS)).cast("int")


def write_index(index: DataFrame, path: str, expected: int | None = None, bucketed: bool = False, check: Callable[[DataFrame], None] | None = None) -> int:
    """The vector store: Parquet by document, replaced as a whole; returns the number of rows, which must be ``expected``.

    ``bucketed``: many documents, which are dealt to DOCUMENT_BUCKETS folders by a hash and sorted there, instead of a folder for
    each, so that folders and files grow with the bytes.  ``check`` sees what is written before it is put in place."""
    spark = index.sparkSession
    part = f"{path}.partial-{uuid.uuid4().hex}"
    try:
        if bucketed:
            rows = index.withColumn("document_bucket", bucket_of_document(F.col("document_id"))).hint("rebalance", "document_bucket")
            rows.sortWithinPartitions("document_bucket", "document_id").write.option("parquet.bloom.filter.enabled#document_id", "true").partitionBy("document_bucket").parquet(part)
        else:
            index.write.partitionBy("document_id").parquet(part)
        rows = spark.read.parquet(part)
        n = rows.count()
        if expected is not None and n != expected:
            raise VectorIndexError(path, f"holds {n} rows, expected {expected}")
        if check is not None:
            check(rows)
        _place(spark, part, path)
    finally:
        delete(spark, part)
    return n


def upserted(index: DataFrame, changes: DataFrame) -> DataFrame:
    """``index`` with the rows of ``changes`` in place of those with the same chunk_id, of which no two may be equal."""
    twice = changes.groupBy("chunk_id").count().where("count > 1").select("chunk_id").limit(1).collect()
    if twice:
        raise VectorIndexError(str(twice[0].chunk_id), "stands more than once among the changes")
    return index.join(changes.select("chunk_id"), "chunk_id", "left_anti").unionByName(changes)


def open_index(spark: SparkSession, path: str, document_id: str | None = None) -> DataFrame:
    """The store; a document_id reads that document's partition alone, or its bucket's rows of about this id."""
    rows = spark.read.parquet(path)
    if document_id is not None:
        rows = rows.where(F.col("document_id") == document_id)
        if "document_bucket" in rows.columns:
            rows = rows.where(F.col("document_bucket") == bucket_of_document(F.lit(document_id)))
    return rows.drop("document_bucket")


def lookup(index: DataFrame, wanted: DataFrame) -> DataFrame:
    """(chunk_id, dimensions, norm, found) of requested ids; missing ones have found false."""
    from passagework.functions.vectors import l2_norm

    rows = wanted.select("chunk_id").join(index.select("chunk_id", "embedding"), "chunk_id", "left")
    return rows.select("chunk_id", F.when(F.col("embedding").isNotNull(), F.size("embedding")).alias("dimensions"), F.round(l2_norm(F.col("embedding")), 6).alias("norm"), F.col("embedding").isNotNull().alias("found"))
