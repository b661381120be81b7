"""Draft claims: parsing, citations, and evidence checks.

A question has few hits, so they travel as one array beside each claim; every check is
then an expression on that array and nothing is shuffled after the one join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from passagework.config import EngineConfig
from passagework.functions import text as T
from passagework.operators.guard import PERSONAL, scope_reason

# Words without content, and the drop reasons.
STOPWORDS = (
    "a", "an", "the", "of", "to", "and", "or", "in", "on", "for", "with", "is", "are", "was", "were", "be", "been", "being", "by", "that",
    "this", "it", "its", "as", "at", "from", "into", "than", "then", "so", "if", "but", "not", "no", "can", "should", "would", "could",
    "may", "might", "do", "does", "did", "has", "have", "had", "their", "there", "these", "those", "such", "per", "about", "over", "under",
    "less", "more", "your", "you",
)
BLENDED = r"(?i)(?U)\bthe guidelines(?:\s+collectively)?\s+say\b"

HIT = "struct<chunk_id:string,document_id:string,document_name:string,publisher:string,year:int,source_url:string,section_heading:string,text:string>"


def prompt(message: Column, groups: Column) -> Column:
    """The question, then each group's document id and its bracketed chunk ids and texts, blank lines between.

    ``groups``: array of (document_id, hits array of (chunk_id, text)) in registry order."""
    one = lambda h: F.concat(F.lit("["), h["chunk_id"], F.lit("]\n"), h["text"], F.lit("\n"))
    lines = F.transform(groups, lambda g: F.concat(g["document_id"], F.lit("\n"), F.array_join(F.transform(g["hits"], one), "\n")))
    return T.strip(F.concat(F.lit("Question:\n"), T.strip(message), F.lit("\n\n"), F.array_join(lines, "\n")))


_DRAFT = "struct<documents:array<struct<document_id:string,claims:array<struct<text:string,chunk_ids:array<string>>>>>>"


def parse_draft(raw: Column) -> Column:
    """Struct (error, documents): strict parsing of a generator's JSON object; extra fields are ignored.

    Types are judged on the parsed value itself, since a typed read would coerce them."""
    value = F.try_parse_json(raw)
    kind = lambda v, path: F.schema_of_variant(F.try_variant_get(v, path, "variant"))
    is_array = lambda v, path: F.coalesce(F.startswith(kind(v, path), F.lit("ARRAY<")), F.lit(False))
    is_text = lambda v, path: F.coalesce(kind(v, path) == "STRING", F.lit(False))
    is_object = lambda v: F.coalesce(F.startswith(F.schema_of_variant(v), F.lit("OBJECT<")), F.lit(False))
    items = lambda v, path: F.coalesce(F.try_variant_get(v, path, "array<variant>"), F.array().cast("array<variant>"))
    entries = items(value, "$.documents")
    claims = F.flatten(F.transform(entries, lambda e: items(e, "$.claims")))
    ids = F.flatten(F.transform(claims, lambda c: items(c, "$.chunk_ids")))
    error = (
        F.when(value.isNull(), "model output is not JSON")
        .when(~is_object(value), "model output is not a JSON object")
        .when(~is_array(value, "$.documents"), "model output has no documents array")
        .when(F.exists(entries, lambda e: ~is_object(e)), "document entry is not an object")
        .when(F.exists(entries, lambda e: ~is_text(e, "$.document_id") | ~is_array(e, "$.claims")), "document entry is missing document_id or claims")
        .when(F.exists(claims, lambda c: ~is_object(c)), "claim is not an object")
        .when(F.exists(claims, lambda c: ~is_text(c, "$.text") | ~is_array(c, "$.chunk_ids")), "claim is missing text or chunk_ids")
        .when(F.exists(ids, lambda i: F.schema_of_variant(i) != "STRING"), "chunk_ids must be strings")
    )
    return F.struct(error.alias("error"), F.when(error.isNull(), F.from_json(raw, _DRAFT)["documents"]).alias("documents"))


def drafts_of(parsed: DataFrame) -> DataFrame:
    """schemas.DRAFTS rows of (query_id, documents)."""
    entries = parsed.select("query_id", F.posexplode("documents").alias("document_pos", "d"))
    return entries.select("query_id", "document_pos", F.col("d.document_id").alias("document_id"), F.posexplode("d.claims").alias("claim_no", "c")).select("query_id", "document_pos", "document_id", "claim_no", F.col("c.text").alias("text"), F.col("c.chunk_ids").alias("chunk_ids"))


def numbers_supported(claim: Column, support: Column) -> Column:
    """Every number of the claim stands in the support without a digit next to it."""
    numbers = F.regexp_extract_all(claim, F.lit(r"(?U)\d+(?:\.\d+)?"), F.lit(0))
    return F.forall(numbers, lambda n: F.coalesce(F.regexp_like(support, F.concat(F.lit(r"(?U)(?<!\d)\Q"), n, F.lit(r"\E(?!\d)"))), F.lit(False)))


def content_words(text: Column) -> Column:
    found = F.regexp_extract_all(F.replace(F.lower(text), F.lit("ß"), F.lit("ss")), F.lit("[a-z]+"), F.lit(0))
    return F.array_except(found, F.array(*map(F.lit, STOPWORDS)))


def term_overlap(claim: Column, support: Column) -> Column:
    """Share of the claim's distinct content words that the support has; 1 without content words."""
    return overlap(content_words(claim), content_words(support))


def overlap(words: Column, support: Column) -> Column:
    """``term_overlap`` of content words that are at hand."""
    return F.when(F.size(words) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(words, support)) / F.size(words))


def resolved(chunk_ids: Column, own: Column) -> Column:
    """Cited ids, where a bare number that ends exactly one own hit's id stands for that id."""

    def one(cited: Column) -> Column:
        ends = F.filter(own, lambda h: F.endswith(h["chunk_id"], F.concat(F.lit(":"), cited)))
        held = F.exists(own, lambda h: h["chunk_id"] == cited)
        return F.when(~held & (F.size(ends) == 1), F.try_element_at(ends, F.lit(1))["chunk_id"]).otherwise(cited)

    return F.transform(chunk_ids, one)


def membership(chunk_ids: Column, own: Column, hits: Column) -> Column:
    """Null if all cited ids are own hits; foreign_chunk if one is another document's hit; else missing_chunk."""
    in_ = lambda held, cited: F.exists(held, lambda h: h["chunk_id"] == cited)
    outside = F.filter(chunk_ids, lambda i: ~in_(own, i))
    return F.when(F.size(chunk_ids) == 0, "missing_chunk").when(F.exists(outside, lambda i: in_(hits, i)), "foreign_chunk").when(F.size(outside) > 0, "missing_chunk")


def rendered(drafts: DataFrame, hits: DataFrame, registry: DataFrame) -> DataFrame:
    """Draft claims with their question's hits (array), their document's own hits and section fields.

    Documents outside the registry are left out.  Claims of one document are one section,
    in order of the draft.  Section fields come from the document's first hit, else the registry.
    """
    fields = F.struct(*[F.col(c) for c in ("rank", "chunk_id", "document_id", "document_name", "publisher", "year", "source_url", "section_heading", "text")])
    held = hits.groupBy("query_id").agg(F.array_sort(F.collect_list(fields)).alias("hits"))
    reg = registry.select("ordinal", "document_id", *[F.col(c).alias(f"reg_{c}") for c in ("document_name", "publisher", "year", "source_url")])
    rows = drafts.join(F.broadcast(reg), "document_id").join(held, "query_id", "left")
    none = F.filter(F.col("hits"), lambda h: F.lit(False))
    rows = rows.withColumn("hits", F.coalesce("hits", none, F.array().cast(f"array<{HIT.replace('struct<', 'struct<rank:int,')}>")))
    rows = rows.withColumn("own", F.filter("hits", lambda h: h["document_id"] == F.col("document_id")))
    anchor = F.try_element_at(F.col("own"), F.lit(1))
    for c in ("document_name", "publisher", "year", "source_url"):
        rows = rows.withColumn(c, F.coalesce(anchor[c], F.col(f"reg_{c}")))
    cited = F.filter(F.transform("chunk_ids", lambda i: F.try_element_at(F.filter(F.col("own"), lambda h: h["chunk_id"] == i), F.lit(1))), lambda h: h.isNotNull())
    order = Window.partitionBy("query_id", "document_id").orderBy("document_pos", "claim_no")
    return rows.withColumn("section_heading", F.coalesce(F.try_element_at(cited, F.lit(1))["section_heading"], F.lit(""))).withColumn("claim_pos", F.row_number().over(order))


def checked(claims: DataFrame, config: EngineConfig = EngineConfig(), whole_section: bool = True) -> DataFrame:
    """``rendered`` claims with resolved chunk_ids and drop_reason (null: the claim stays).

    ``whole_section``: a section whose own address (its document's first hit's) is not the registry's loses all its
    claims; else a claim is judged by the addresses of what it cites alone."""
    rows = claims.withColumn("chunk_ids", resolved(F.col("chunk_ids"), F.col("own")))
    cited = F.filter(F.transform("chunk_ids", lambda i: F.try_element_at(F.filter(F.col("own"), lambda h: h["chunk_id"] == i), F.lit(1))), lambda h: h.isNotNull())
    rows = rows.withColumn("cited", cited).withColumn("support", F.array_join(F.transform("cited", lambda h: h["text"]), "\n"))
    advice = scope_reason(F.col("text"))
    elsewhere = F.exists("cited", lambda h: h["source_url"] != F.col("reg_source_url"))
    elsewhere = (F.col("source_url") != F.col("reg_source_url")) | elsewhere if whole_section else elsewhere
    reason = (
        F.when(T.strip(F.col("text")) == "", "empty_text")
        .when(membership(F.col("chunk_ids"), F.col("own"), F.col("hits")).isNotNull(), membership(F.col("chunk_ids"), F.col("own"), F.col("hits")))
        .when(elsewhere, "bad_citation_url")
        .when(advice.isin(*PERSONAL), advice)
        .when(F.col("text").rlike(BLENDED), "blended_voice")
        .when(~numbers_supported(F.col("text"), F.col("support")), "unsupported_number")
        .when(term_overlap(F.col("text"), F.col("support")) < config.min_term_overlap, "low_term_overlap")
    )
    return rows.withColumn("drop_reason", reason)


def sections(claims: DataFrame) -> DataFrame:
    """(query_id, ordinal, document fields, claims) of documents with surviving claims.

    A section takes its fields from the first surviving claim's first cited chunk, and each
    claim its heading from its own first cited chunk."""
    alive = claims.where("drop_reason is null").withColumn("first", F.try_element_at(F.col("cited"), F.lit(1)))
    one = F.struct("claim_pos", F.struct("text", "chunk_ids", F.col("first.section_heading").alias("section_heading")).alias("claim"))
    out = alive.groupBy("query_id", "ordinal", "document_id").agg(F.min_by("first", "claim_pos").alias("anchor"), F.array_sort(F.collect_list(one)).alias("held"))
    return out.select("query_id", "ordinal", "document_id", *[F.col(f"anchor.{c}").alias(c) for c in ("document_name", "publisher", "year", "source_url")], F.transform("held", lambda x: x["claim"]).alias("claims"))


def dropped(claims: DataFrame) -> DataFrame:
    return claims.where("drop_reason is not null").select("query_id", "document_id", "claim_pos", "drop_reason", "text")
