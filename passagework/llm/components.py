"""Connected components of a link table, by minimum label."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from passagework.llm.shared import stored


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b: bigint); root is the smallest node it reaches.

    Each round gives every node the smallest label of its neighbours and then the label
    of its label (pointer jumping), so long chains shrink by doubling.  Labels only fall, so
    rounds come to an end; each is written to the shared folder.  No neighbour list is ever built: groups are
    reduced by ``min`` with partial aggregation, and joins carry one row per link.
    Self links are allowed; repeated links are harmless; an empty table gives no rows.
    """
    both = stored(
        links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a is not null and b is not null").distinct(),
        "links",
    )
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("root")), "labels")
    while True:
        near = (
            both.join(labels.select(F.col("node").alias("b"), F.col("root").alias("seen")), "b")
            .groupBy(F.col("a").alias("node"))
            .agg(F.min("seen").alias("seen"))
        )
        offered = labels.join(near, "node").select("node", "root", F.least("root", "seen").alias("low"))
        parents = labels.select(F.col("node").alias("low"), F.col("root").alias("up"))
        # A label is always a node, so the inner join loses nothing.
        step = stored(offered.join(parents, "low").select("node", F.least("low", "up").alias("new"), (F.least("low", "up") != F.col("root")).alias("moved")), "labels")
        labels = step.select("node", F.col("new").alias("root"))
        if not step.where("moved").limit(1).count():
            return labels


def one_of_each(docs: DataFrame, grouped: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The rows of ``docs`` that stay: of each group the document with the smallest doc_id.

    ``grouped`` gives (doc_id, component_id) for rows (doc_id, text).  All columns are kept, also those
    whose names differ in case alone.  Repeated rows of one doc_id count as copies: the one with the
    smallest text (null first) stays, then that whose other columns are smallest as JSON.
    Rows without a doc_id stay (they cannot be told from each other).
    """
    names = docs.columns
    held = {n: f"c{i}" for i, n in enumerate(names)}
    plain = docs.toDF(*held.values())
    doc_id, text = held["doc_id"], held["text"]
    given = plain.where(F.col(doc_id).isNotNull())
    keep = grouped(given.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))).where("doc_id = component_id")
    own = given.join(keep.select(F.col("doc_id").alias("_id")).distinct(), F.col(doc_id) == F.col("_id"), "left_semi")
    others = F.to_json(F.struct(*[c for c in held.values() if c not in (doc_id, text)] or [F.lit(0)]))
    place = F.row_number().over(Window.partitionBy(doc_id).orderBy(F.col(text).asc_nulls_first(), others))
    one = own.withColumn("_place", place).where("_place = 1").drop("_place")
    return one.unionByName(plain.where(F.col(doc_id).isNull())).toDF(*names)
