"""A batch of questions from guard to reply, as one plan."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagework.config import EngineConfig
from passagework.operators import claims as C
from passagework.operators import guard, responses, retrieval

#: (questions with prompt) -> (query_id, raw): raw is a generator's output, null if it failed.
Generator = Callable[[DataFrame], DataFrame]


def drafted(hits: DataFrame, questions: DataFrame, generator: Generator) -> DataFrame:
    """(query_id, error, documents) for each question with hits: one call, and one more if its output does not parse."""
    groups = hits.groupBy("query_id", "ordinal", "document_id").agg(F.array_sort(F.collect_list(F.struct("rank", "chunk_id", "text"))).alias("hits"))
    held = groups.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("ordinal", "document_id", "hits"))).alias("groups"))
    asked = questions.join(held, "query_id").select("query_id", C.prompt(F.col("message"), F.col("groups")).alias("prompt"), F.lit(1).alias("attempt"))
    failed = F.col("raw").isNull() | (F.trim(F.col("raw")) == "")
    result = lambda asked_: asked_.select("query_id").join(generator(asked_), "query_id", "left").withColumn("call_failed", failed).withColumn("d", C.parse_draft(F.coalesce("raw", F.lit(""))))
    once = result(asked)
    again = asked.join(once.where(~F.col("call_failed") & F.col("d.error").isNotNull()).select("query_id"), "query_id", "left_semi").withColumn("attempt", F.lit(2))
    twice = result(again)
    settled = once.where(F.col("call_failed") | F.col("d.error").isNull()).unionByName(twice)
    return settled.select("query_id", F.when(F.col("call_failed"), "model call failed").otherwise(F.col("d.error")).alias("error"), F.when(~F.col("call_failed"), F.col("d.documents")).alias("documents"))


def answer_batch(questions: DataFrame, index: DataFrame, registry: DataFrame, generator: Generator, config: EngineConfig = EngineConfig(), check: bool = True) -> DataFrame:
    """(query_id, type, reason, message, sections, searched, response, document_scope, hit_count, dropped_reasons).

    ``questions``: query_id, message, document_id, embedding.  ``index``: schemas.CHUNKS with ordinal and
    embedding.  Questions that the guard refuses are neither searched nor generated for; those without
    hits are not generated for; each has exactly one reply.  Reply figures carry reason codes
    and never a dropped claim's text.
    """
    judged = guard.classify(questions, registry, check)
    open_ = judged.where("reason is null")
    # At most a few rows per question, used by several branches below: kept until ``release``, so that no
    # model is called twice.
    hits = retrieval.retrieve(index, open_, config).persist()
    counts = hits.groupBy("query_id").agg(F.count(F.lit(1)).alias("hit_count"))
    drafts = drafted(hits, open_, generator).persist()
    claims = C.checked(C.rendered(C.drafts_of(drafts.where("error is null")), hits, registry), config).persist()
    fields = ("document_id", "document_name", "publisher", "year", "source_url", "claims")
    answered = C.sections(claims).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("ordinal", F.struct(*fields).alias("s")))).alias("held")).select("query_id", F.transform("held", lambda x: x["s"]).alias("sections"))
    gone = claims.where("drop_reason is not null").groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("ordinal", "claim_pos", "drop_reason"))).alias("gone"))
    rows = (
        judged.select("query_id", F.col("reason").alias("guard_reason"), "scope_id")
        .join(counts, "query_id", "left")
        .join(drafts.select("query_id", F.col("error")), "query_id", "left")
        .join(answered, "query_id", "left")
        .join(gone, "query_id", "left")
        .withColumn("hit_count", F.coalesce("hit_count", F.lit(0)))
    )
    kind = (
        F.when(F.col("guard_reason").isNotNull(), "out_of_scope")
        .when(F.col("hit_count") == 0, "not_in_corpus")
        .when(F.col("error").isNotNull(), "generation_unavailable")
        .when(F.col("sections").isNull(), "not_in_corpus")
        .otherwise("answer")
    )
    why = (
        F.when(F.col("guard_reason").isNotNull(), F.col("guard_reason"))
        .when(F.col("hit_count") == 0, "no_supporting_chunks")
        .when(F.col("error").isNotNull(), "model_error")
        .when(F.col("sections").isNull(), "no_surviving_claims")
    )
    typed = rows.withColumn("type", kind).withColumn("reason", why).withColumn("message", responses.refusal_message(F.col("type"), F.col("reason")))
    found = responses.searched(registry, F.col("scope_id"))
    typed = typed.withColumn("searched", F.when(F.col("type").isin("answer", "not_in_corpus"), found).otherwise(F.filter(found, lambda d: F.lit(False))))
    typed = typed.withColumn("sections", F.coalesce("sections", F.array().cast(responses.SECTIONS)))
    scope = F.when(F.col("guard_reason").isNotNull(), "none").otherwise(F.coalesce("scope_id", F.lit("all")))
    replies = typed.select(
        "query_id", "type", "reason", "message", "sections", "searched",
        responses.response_json(F.col("type"), F.col("reason"), F.col("message"), F.col("sections"), F.col("searched")).alias("response"),
        scope.alias("document_scope"), "hit_count", F.coalesce(F.array_join(F.transform("gone", lambda g: g["drop_reason"]), ","), F.lit("")).alias("dropped_reasons"),
    )
    replies._held = (hits, drafts, claims)
    return replies


def release(replies: DataFrame) -> None:
    """Gives back what ``answer_batch`` kept for these replies; call it once they have been written."""
    for held in getattr(replies, "_held", ()):
        held.unpersist()


def documents(registry: DataFrame) -> DataFrame:
    """The documents a question may name, in registry order."""
    return registry.orderBy("ordinal").select("document_id", "document_name", "publisher", "year")


def health(index_ready: bool) -> dict[str, object]:
    """Status 200 when the index can be asked, else 503."""
    return {"status": 200 if index_ready else 503, "body": {"status": "ok" if index_ready else "unavailable"}}
