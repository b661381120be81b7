"""Replies: fixed refusals, answers, their JSON, and what a page shows of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Refusal texts and reasons.
REFERRAL = "I can’t help with medical advice or with personal calorie or weight targets. Please speak with a qualified health professional."
NUTRIENT_MESSAGE = "This assistant answers from dietary guidance documents and does not look up nutrient numbers for individual foods."
NOT_IN_CORPUS_MESSAGE = "The guidance I searched does not cover that."
UNAVAILABLE_MESSAGE = "I couldn’t generate an answer just now. Please try again."

SEARCHED = "array<struct<document_id:string,document_name:string,publisher:string,year:int>>"
SECTIONS = (
    "array<struct<document_id:string,document_name:string,publisher:string,year:int,source_url:string,"
    "claims:array<struct<text:string,chunk_ids:array<string>,section_heading:string>>>>"
)


def refusal_message(type_: Column, reason: Column) -> Column:
    """The fixed text of a refusal; null for an answer or an unknown reason."""
    return (
        F.when((type_ == "out_of_scope") & (reason == "nutrient_lookup"), NUTRIENT_MESSAGE)
        .when((type_ == "out_of_scope") & reason.isin("medical", "weight_target", "calorie_target"), REFERRAL)
        .when(type_ == "not_in_corpus", NOT_IN_CORPUS_MESSAGE)
        .when(type_ == "generation_unavailable", UNAVAILABLE_MESSAGE)
    )


def searched(registry: DataFrame, scope_id: Column) -> Column:
    """The searched documents in registry order: one if scoped, else all.  The registry is a literal array."""
    rows = registry.orderBy("ordinal").select("document_id", "document_name", "publisher", "year").collect()
    every = F.array(*[F.struct(F.lit(r.document_id).alias("document_id"), F.lit(r.document_name).alias("document_name"), F.lit(r.publisher).alias("publisher"), F.lit(r.year).cast("int").alias("year")) for r in rows])
    return F.filter(every, lambda d: scope_id.isNull() | (d["document_id"] == scope_id))


def response_json(type_: Column, reason: Column, message: Column, sections: Column, found: Column) -> Column:
    """The reply as JSON: an answer has no reason and no message."""
    answer = F.to_json(F.struct(type_.alias("type"), sections.alias("sections"), found.alias("searched")))
    refusal = F.to_json(F.struct(type_.alias("type"), reason.alias("reason"), message.alias("message"), sections.alias("sections"), found.alias("searched")))
    return F.when(type_ == "answer", answer).otherwise(refusal)


def presented(replies: DataFrame, registry: DataFrame) -> DataFrame:
    """(query_id, kind, message, sections, searched): what a page shows.

    An answer hides what was searched, as does a refused question; sections are in
    registry order; each claim repeats its section's document fields.
    """
    order = F.create_map(*[x for r in registry.select("document_id", "ordinal").collect() for x in (F.lit(r.document_id), F.lit(r.ordinal))])
    keyed = F.transform("sections", lambda s: F.struct(F.coalesce(F.try_element_at(order, s["document_id"]), F.lit(2**30)).alias("o"), s.alias("s")))
    flat = F.transform(
        F.array_sort(keyed, lambda a, b: F.when(a["o"] < b["o"], -1).when(a["o"] > b["o"], 1).otherwise(0)),
        lambda x: F.struct(
            x["s"]["document_id"].alias("document_id"),
            x["s"]["document_name"].alias("document_name"),
            F.transform(x["s"]["claims"], lambda c: F.struct(c["text"].alias("text"), c["section_heading"].alias("section_heading"), x["s"]["document_name"].alias("document_name"), x["s"]["publisher"].alias("publisher"), x["s"]["year"].alias("year"), x["s"]["source_url"].alias("source_url"))).alias("claims"),
        ),
    )
    views = F.transform("searched", lambda d: F.struct(d["document_name"].alias("document_name"), d["publisher"].alias("publisher"), d["year"].alias("year")))
    none = F.filter(views, lambda d: F.lit(False))
    return replies.select(
        "query_id", F.col("type").alias("kind"), F.when(F.col("type") == "answer", "").otherwise(F.col("message")).alias("message"),
        F.when(F.col("type") == "answer", flat).otherwise(F.filter(flat, lambda s: F.lit(False))).alias("sections"),
        F.when(F.col("type") == "not_in_corpus", views).otherwise(none).alias("searched"),
    )


def malformed(replies: DataFrame) -> DataFrame:
    """(query_id, rule) of replies that a page cannot show."""
    blank = lambda c: c.isNull() | (F.trim(c) == "")
    bad_section = F.exists("sections", lambda s: blank(s["document_id"]) | blank(s["document_name"]) | blank(s["publisher"]) | blank(s["source_url"]) | s["year"].isNull() | (F.size(s["claims"]) < 1) | F.exists(s["claims"], lambda c: blank(c["text"]) | blank(c["section_heading"])))
    rule = (
        F.when(~F.coalesce(F.col("type").isin("answer", "not_in_corpus", "out_of_scope", "generation_unavailable"), F.lit(False)), "response type is missing")
        .when((F.col("type") == "answer") & (F.col("sections").isNull() | bad_section), "section is incomplete")
        .when((F.col("type") != "answer") & blank(F.col("message")), "response is missing a message")
        .when((F.col("type") == "not_in_corpus") & F.col("searched").isNull(), "not_in_corpus is missing searched")
    )
    return replies.withColumn("rule", rule).where("rule is not null").select("query_id", "rule")


def picker(registry: DataFrame) -> DataFrame:
    """(position, label, document_id): "All documents" first, then names in registry order."""
    spark: SparkSession = registry.sparkSession
    head = spark.createDataFrame([(0, "All documents", None)], "position int, label string, document_id string")
    return head.union(registry.select((F.col("ordinal") + 1).alias("position"), F.col("document_name").alias("label"), "document_id"))
