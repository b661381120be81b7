"""A store in hash buckets: changes rewrite the buckets they touch, lookups open the buckets they ask for, and a tree of
hashes says which chunks a new version changes.

A table is Parquet partitioned by bucket, a hash of chunk_id.  Files are sorted by chunk_id and have Bloom filters on it, so a
lookup skips row groups by their ranges and filters.  Beside it may lie a tree: hashes of 65,536 groups of
chunks, of 256 groups of these, and of all; two versions are compared from the top, and only groups that
differ are looked into.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from passagework.errors import VectorIndexError
from passagework.folders import delete

BUCKETS = 256
#: Requested ids that are pushed to the files as a filter; more are joined to the buckets they fall into.
PUSHED_IDS = 1000
_TOP, _LEAVES = 256, 1 << 16
_HASHES = "chunk_id string, text_sha256 string, node int, top int"
_TREE = "node int, n bigint, a bigint, b bigint, level int"


def bucket_of(chunk_id: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(chunk_id.cast("string")), F.lit(buckets)).cast("int")


def _there(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def _write(rows: DataFrame, path: str, mode: str) -> None:
    """Each bucket in as many files as its size asks for; a bucket of any size is written by several tasks."""
    held = rows.hint("rebalance", "bucket").sortWithinPartitions("bucket", "chunk_id")
    writer = held.write.mode(mode).option("partitionOverwriteMode", "dynamic").option("parquet.bloom.filter.enabled#chunk_id", "true")
    writer.partitionBy("bucket").parquet(path)


def _once(rows: DataFrame, what: str) -> None:
    twice = rows.groupBy("chunk_id").count().where("count > 1 or chunk_id is null").select("chunk_id").limit(1).collect()
    if twice:
        raise VectorIndexError(str(twice[0].chunk_id), f"stands more than once (or is null) among the {what}")


def create(rows: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """Writes ``rows`` (chunk_id, any others) as a new store; no two may have one chunk_id."""
    _once(rows, "rows")
    _write(rows.withColumn("bucket", bucket_of(F.col("chunk_id"), buckets)), path, "errorifexists")


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def upsert(spark: SparkSession, path: str, changes: DataFrame, removed: DataFrame | None = None, buckets: int = BUCKETS) -> list[int]:
    """Puts the rows of ``changes`` in place of those with their chunk_id and takes out those of ``removed``; returns the
    buckets rewritten.  Files of other buckets stay as they are.

    First the touched buckets are written whole beside the store, then they replace those of the store; the note of which
    they are is written last.  After a crash ``recover``, which every call begins with, either finds that note and
    replaces the buckets again, or drops what was begun."""
    recover(spark, path)
    _once(changes, "changes")
    changes = changes.withColumn("bucket", bucket_of(F.col("chunk_id"), buckets))
    ids = changes.select("chunk_id", "bucket")
    if removed is not None:
        ids = ids.unionByName(removed.select("chunk_id", bucket_of(F.col("chunk_id"), buckets).alias("bucket")))
    touched = sorted(r.bucket for r in ids.select("bucket").distinct().collect())  # at most ``buckets`` numbers
    if not touched:
        return []
    old = read(spark, path).where(F.col("bucket").isin(touched))
    _write(old.join(ids.select("chunk_id"), "chunk_id", "left_anti").unionByName(changes), f"{path}.staged/rows", "overwrite")
    spark.createDataFrame([(b,) for b in touched], "bucket int").coalesce(1).write.parquet(f"{path}.staged/touched")
    recover(spark, path)
    return touched


def recover(spark: SparkSession, path: str) -> None:
    """Ends an upsert that was cut short, if there is one; can be repeated."""
    staged = f"{path}.staged"
    if _there(spark, f"{staged}/touched/_SUCCESS"):
        touched = {r.bucket for r in spark.read.parquet(f"{staged}/touched").collect()}
        rows = spark.read.schema(read(spark, path).schema).parquet(f"{staged}/rows")
        filled = {r.bucket for r in rows.select("bucket").distinct().collect()}
        _write(rows, path, "overwrite")
        for bucket in touched - filled:  # nothing overwrites a bucket that has lost its last row
            delete(spark, f"{path}/bucket={bucket}")
    delete(spark, staged)


def opened(spark: SparkSession, path: str, ids: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """The store's rows that may be those of ``ids`` (chunk_id), read from the buckets that these fall into.

    Up to PUSHED_IDS ids also go to the files as a filter, which their ranges and Bloom filters answer without reading."""
    asked = sorted(r.bucket for r in ids.select(bucket_of(F.col("chunk_id"), buckets).alias("bucket")).distinct().collect())
    rows = read(spark, path).where(F.col("bucket").isin(asked)) if asked else read(spark, path).limit(0)
    few = [r.chunk_id for r in ids.limit(PUSHED_IDS + 1).collect()]
    return rows.where(F.col("chunk_id").isin(few)) if 0 < len(few) <= PUSHED_IDS else rows


def lookup(spark: SparkSession, path: str, wanted: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """Rows of the store for the distinct ids of ``wanted`` (chunk_id), with found; ids that are not there have nulls and found false."""
    ids = wanted.select(F.col("chunk_id").cast("string").alias("chunk_id")).where("chunk_id is not null").distinct()
    found = opened(spark, path, ids, buckets).drop("bucket").withColumn("found", F.lit(True))
    return ids.join(found, "chunk_id", "left").withColumn("found", F.coalesce("found", F.lit(False)))


# The tree of hashes.

def _leaf(chunk_id: Column) -> Column:
    return F.pmod(F.xxhash64(chunk_id.cast("string")), F.lit(_LEAVES)).cast("int")


def hashes(rows: DataFrame) -> DataFrame:
    """(chunk_id, text_sha256, node, top) of ``rows`` (chunk_id, text)."""
    node = _leaf(F.col("chunk_id"))
    return rows.select(F.col("chunk_id").cast("string").alias("chunk_id"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"), node.alias("node"), (node / _TOP).cast("int").alias("top"))


def tree(leaves: DataFrame) -> DataFrame:
    """(level, node, n, a, b): chunks under each node and two hashes that do not depend on their order; level 0 is the
    root, 1 its 256 children, 2 their 65,536 children."""
    low = leaves.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("chunk_id", "text_sha256")).alias("a"), F.bit_xor(F.xxhash64("text_sha256", "chunk_id")).alias("b"))

    def above(nodes: DataFrame, node: Column) -> DataFrame:
        return nodes.groupBy(node.alias("node")).agg(F.sum("n").alias("n"), F.bit_xor(F.xxhash64("node", "n", "a", "b")).alias("a"), F.bit_xor(F.xxhash64("b", "a", "n", "node")).alias("b"))

    mid = above(low, (F.col("node") / _TOP).cast("int"))
    root = above(mid, F.lit(0))
    level = lambda df, i: df.select(F.lit(i).alias("level"), "node", "n", "a", "b")
    return level(root, 0).unionByName(level(mid, 1)).unionByName(level(low, 2))


def write_version(rows: DataFrame, path: str) -> None:
    """The hashes of ``rows`` (chunk_id, text) by top node, and their tree, under ``path``."""
    _once(rows, "rows")
    hashes(rows).write.partitionBy("top").parquet(f"{path}/leaves")
    tree(rows.sparkSession.read.schema(_HASHES).parquet(f"{path}/leaves")).coalesce(1).write.partitionBy("level").parquet(f"{path}/tree")


def changed_chunks(spark: SparkSession, old: str, new: str) -> DataFrame:
    """(chunk_id, change, text_sha256) between two written versions: added, changed or removed (hash null).

    Equal roots end it.  Else the children that differ are found level by level, and chunks are
    compared only under those, read from their partitions alone."""
    trees = [spark.read.schema(_TREE).parquet(f"{v}/tree") for v in (old, new)]

    def differ(level: int, below: list[int] | None) -> list[int]:
        a, b = (t.where(F.col("level") == level) for t in trees)
        if below is not None:
            a, b = (t.where((F.col("node") / _TOP).cast("int").isin(below)) for t in (a, b))
        met = a.select("node", F.struct("n", "a", "b").alias("x")).join(b.select("node", F.struct("n", "a", "b").alias("y")), "node", "full")
        return sorted(r.node for r in met.where(~F.col("x").eqNullSafe(F.col("y"))).select("node").collect())  # at most 65,536 numbers

    leaves = [spark.read.schema(_HASHES).parquet(f"{v}/leaves") for v in (old, new)]
    tops = differ(1, None) if differ(0, None) else []
    nodes = spark.createDataFrame([(n,) for n in differ(2, tops)] if tops else [], "node int")
    a, b = (x.where(F.col("top").isin(tops) if tops else F.lit(False)).join(F.broadcast(nodes), "node", "left_semi") for x in leaves)
    met = a.select("chunk_id", F.col("text_sha256").alias("before")).join(b.select("chunk_id", "text_sha256"), "chunk_id", "full")
    change = F.when(F.col("before").isNull(), "added").when(F.col("text_sha256").isNull(), "removed").when(F.col("before") != F.col("text_sha256"), "changed")
    return met.withColumn("change", change).where("change is not null").select("chunk_id", "change", "text_sha256")


def refresh(spark: SparkSession, store: str, old: str, new: str, rows: DataFrame, embedder, buckets: int = BUCKETS) -> DataFrame:
    """Brings a store of (chunk_id, text, embedding) from version ``old`` to ``new``, which holds ``rows`` (chunk_id,
    text): only added and changed chunks are embedded, only touched buckets rewritten.  Returns the changes."""
    from passagework.operators.embedding import embedded

    changes = changed_chunks(spark, old, new)
    fresh = rows.select(F.col("chunk_id").cast("string").alias("chunk_id"), "text").join(changes.where("change <> 'removed'").select("chunk_id"), "chunk_id", "left_semi")
    # What the model has made is written before anything else reads it, so it is asked once for each chunk.
    delete(spark, f"{store}.embedded")
    embedded(fresh, embedder, "text").write.parquet(f"{store}.embedded")
    upsert(spark, store, spark.read.parquet(f"{store}.embedded"), changes.where("change = 'removed'"), buckets)
    delete(spark, f"{store}.embedded")
    return changes
