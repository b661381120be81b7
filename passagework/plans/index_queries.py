"""Queries of the stored indexes: inverted lists, buckets that are upserted, lookups that skip files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passagework.folders import fresh_path
from passagework.functions.vectors import l2_norm
from passagework.operators import inverted
from passagework.plans.catalogue import query, table
from passagework.plans.question_queries import asked, vectors
from passagework.sources import buckets


@query("""
with idx as (select label::varchar || ':' || vec_id::varchar as chunk_id, label as ordinal, embedding::double[] as e from embeddings),
q as (select vec_id as query_id, embedding::double[] as e from embeddings where vec_id % 100 = 0),
scored as (select query_id, chunk_id, ordinal, list_dot_product(q.e, idx.e) / (sqrt(list_dot_product(q.e, q.e)) * sqrt(list_dot_product(idx.e, idx.e))) as sim from q join idx on true),
best as (select *, row_number() over (partition by query_id order by round(sim, 6) desc, ordinal, chunk_id) as place from scored qualify place <= 10)
select 'q' || query_id as query_id, place::integer as place, chunk_id, round(sim, 6) as similarity, true as recall_reached from best
""")
def knn_ivf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest of all vectors to those whose id is divisible by 100, with all lists probed, and whether a probe of
    20 of 32 lists finds 0.9 of them."""
    path = fresh_path(spark, "lists")
    inverted.build(vectors(spark, sf_dir), path)
    questions = asked(spark, sf_dir).select(F.concat(F.lit("q"), "query_id").alias("query_id"), "embedding")
    exact = inverted.search(spark, path, questions, 10)
    reached = inverted.recall(inverted.search(spark, path, questions, 10, probes=20), exact) >= 0.9
    return exact.select("query_id", "place", "chunk_id", F.round("similarity", 6).alias("similarity"), F.lit(reached).alias("recall_reached"))


@query("""
select vec_id, case when label = 3 then 99 else label end as label from embeddings where label <> 5
union all select vec_id + 1000000000, label from embeddings where label = 7
""")
def bucket_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A store of all vectors in buckets after an upsert: some rows changed, some added, some taken out."""
    path = fresh_path(spark, "buckets")
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("chunk_id"), "vec_id", "label", "embedding")
    buckets.create(rows, path)
    added = rows.where("label = 7").withColumn("vec_id", F.col("vec_id") + 1_000_000_000).withColumn("chunk_id", F.col("vec_id").cast("string"))
    buckets.upsert(spark, path, rows.where("label = 3").withColumn("label", F.lit(99)).unionByName(added), rows.where("label = 5"))
    return buckets.read(spark, path).select("vec_id", "label")


@query("""
with wanted as (select vec_id::varchar as chunk_id from embeddings where vec_id % 100 = 0 union select 'no ' || vec_id from embeddings where vec_id % 100 = 50)
select w.chunk_id, len(e.embedding)::integer as dimensions, round(sqrt(list_dot_product(e.embedding::double[], e.embedding::double[])), 6) as norm, e.vec_id is not null as found
from wanted w left join embeddings e on e.vec_id::varchar = w.chunk_id
""")
def pruned_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vectors whose id is divisible by 100, and ids that no vector has, looked up in a store of all vectors in buckets."""
    path = fresh_path(spark, "buckets")
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("chunk_id"), "vec_id", "embedding")
    buckets.create(rows, path)
    wanted = rows.where("vec_id % 100 = 0").select("chunk_id").union(rows.where("vec_id % 100 = 50").select(F.concat(F.lit("no "), "chunk_id")))
    found = buckets.lookup(spark, path, wanted)
    return found.select("chunk_id", F.when(F.col("found"), F.size("embedding")).alias("dimensions"), F.round(l2_norm(F.col("embedding")), 6).alias("norm"), "found")


@query("""
with v1 as (select doc_id::varchar as chunk_id, sha256(coalesce(text, '')) as h from documents),
v2 as (
    select doc_id::varchar as chunk_id, sha256(case when doc_id % 10 = 3 then coalesce(text, '') || ' again' else coalesce(text, '') end) as h from documents where doc_id % 10 <> 5
    union all select (doc_id + 1000000000)::varchar, sha256(coalesce(text, '')) from documents where doc_id % 10 = 7
)
select coalesce(v1.chunk_id, v2.chunk_id) as chunk_id, case when v1.h is null then 'added' when v2.h is null then 'removed' else 'changed' end as change, v2.h as text_sha256
from v1 full join v2 on v1.chunk_id = v2.chunk_id where v1.h is distinct from v2.h
""")
def changed_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a second version of the documents changes, found by descending two trees of hashes."""
    path = fresh_path(spark, "versions")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    edited = docs.where("doc_id % 10 <> 5").withColumn("text", F.when(F.col("doc_id") % 10 == 3, F.concat(F.coalesce("text", F.lit("")), F.lit(" again"))).otherwise(F.col("text")))
    added = docs.where("doc_id % 10 = 7").withColumn("doc_id", F.col("doc_id") + 1_000_000_000)
    as_chunks = lambda df: df.select(F.col("doc_id").cast("string").alias("chunk_id"), "text")
    buckets.write_version(as_chunks(docs), f"{path}/v1")
    buckets.write_version(as_chunks(edited.unionByName(added)), f"{path}/v2")
    return buckets.changed_chunks(spark, f"{path}/v1", f"{path}/v2")
