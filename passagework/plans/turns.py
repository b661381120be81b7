"""Replies written together with a log of what they were, counted on the way."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

# The types of replies and the reasons they may bear.
TYPES = ("answer", "not_in_corpus", "out_of_scope", "generation_unavailable")
REASONS = ("medical", "weight_target", "calorie_target", "nutrient_lookup", "no_supporting_chunks", "no_surviving_claims", "model_error")
LOG = "batch string, turns bigint, figure string, value string, n bigint"


def figures() -> dict[str, tuple[str, str]]:
    """Names of the observed counts: figure and value of each."""
    named = {f"type_{t}": ("type", t) for t in TYPES} | {f"reason_{r}": ("reason", r) for r in REASONS}
    return named | {"scope_all": ("document_scope", "all"), "scope_none": ("document_scope", "none"), "scope_one": ("document_scope", "one")}


def write_replies(replies: DataFrame, path: str, log: str, batch: str) -> DataFrame:
    """Writes ``replies`` (type, reason, document_scope and any others) to ``path``/batch=... and appends to the table at
    ``log`` how many there were of each type, reason and scope.

    The counts are taken while the replies are written; no other job reads them.  A batch that is written again
    replaces its replies and its log rows.  Returns the batch's log rows."""
    spark = replies.sparkSession
    seen = Observation()
    scope = F.when(F.col("document_scope").isin("all", "none"), F.col("document_scope")).otherwise("one")
    of = {"type": F.col("type"), "reason": F.col("reason"), "document_scope": scope}
    counts = [F.count_if(F.coalesce(of[f] == v, F.lit(False))).alias(name) for name, (f, v) in figures().items()]
    held = replies.withColumn("batch", F.lit(batch)).observe(seen, F.count(F.lit(1)).alias("turns"), *counts)
    held.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)
    got = seen.get
    rows = spark.createDataFrame([(got["turns"], f, v, got[name], batch) for name, (f, v) in figures().items()], "turns bigint, figure string, value string, n bigint, batch string")
    rows.coalesce(1).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(log)
    return rows


def read_log(spark: SparkSession, log: str) -> DataFrame:
    return spark.read.schema(LOG).parquet(log)
