"""Queries of what is logged and asked for: calls of a generator, turns, requests, and lines of files that are no blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passagework.folders import fresh_path
from passagework.operators import generation, guard
from passagework.plans import catalogue as K
from passagework.plans import turns
from passagework.plans.catalogue import query, table
from passagework.plans.question_queries import OPENED, named_sql, opened, reason_sql
from passagework.registry import REGISTRY
from passagework.sources import fetch, stores


@query("""
select conv_id * 1000 + turn as query_id, 1 as attempt, count(*)::integer as calls, sha256('reply to ' || text) as raw_sha256 from conversations where text is not null group by conv_id, turn, text
""")
def logged_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All turns as prompts, asked for twice: the log has each call once."""
    path = fresh_path(spark, "calls")
    prompts = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), F.lit(1).alias("attempt"), F.col("text").alias("prompt"))
    ask = generation.logged(generation.model_generator(lambda prompt: "reply to " + prompt), path)
    ask(prompts)
    ask(prompts)
    log = spark.read.schema(generation.LOG).parquet(path)
    return log.groupBy("query_id", "attempt", "prompt_sha256").agg(F.count(F.lit(1)).cast("int").alias("calls"), F.max(F.sha2("raw", 256)).alias("raw_sha256")).drop("prompt_sha256")


_FIGURES = [("type", t) for t in turns.TYPES] + [("reason", r) for r in turns.REASONS] + [("document_scope", s) for s in ("all", "none", "one")]


@query(f"""
with {OPENED}, judged as (select query_id, {reason_sql(K.fold_sql('message'))} as reason, {named_sql('message')} as scope_id from opened),
replies as (
    select case when reason is not null then 'out_of_scope' when query_id % 3 = 0 then 'not_in_corpus' else 'answer' end as type, case when reason is not null then reason when query_id % 3 = 0 then 'no_supporting_chunks' end as reason,
        case when reason is not null then 'none' when scope_id is null then 'all' else 'one' end as document_scope from judged
), figures as (select * from (values {", ".join(f"('{f}', '{v}')" for f, v in _FIGURES)}) as v(figure, value))
select figure, value, (select count(*) from replies) as turns,
    (select count(*) from replies r where case figure when 'type' then r.type when 'reason' then r.reason else r.document_scope end = value) as n from figures
""")
def turn_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What became of all turns, counted while their replies are written."""
    path = fresh_path(spark, "turns")
    rows = opened(spark, sf_dir)
    judged = rows.select("query_id", guard.scope_reason(F.col("message")).alias("why"), guard.named_document(F.col("message"), [(d.document_id, list(d.aliases)) for d in REGISTRY]).alias("scope_id"))
    refused, lost = F.col("why").isNotNull(), F.col("query_id") % 3 == 0
    replies = judged.select(
        "query_id", F.when(refused, "out_of_scope").when(lost, "not_in_corpus").otherwise("answer").alias("type"), F.when(refused, F.col("why")).when(lost, "no_supporting_chunks").alias("reason"),
        F.when(refused, "none").otherwise(F.coalesce("scope_id", F.lit("all"))).alias("document_scope"),
    )
    turns.write_replies(replies, f"{path}/replies", f"{path}/log", "one")
    return turns.read_log(spark, f"{path}/log").select("figure", "value", "turns", "n")


@query("""
with asked as (select page_id, page_id % 7 as kind from pages)
select page_id::varchar as document_id, case when kind in (2, 5, 6) then 200 when kind = 1 then 404 end as http_status,
    case when kind = 2 then 'https://files.example/' || page_id || '/guide.pdf' when kind in (1, 5, 6) then 'https://host' || page_id % 5 || '.example/' || page_id end as final_url,
    case kind when 0 then 'timed out on ' || page_id when 1 then 'HTTP 404' when 3 then 'no English PDF link on the publication page' when 4 then 'English PDF link did not return a PDF' end as error,
    case when kind = 2 then '%PDF-1.7 of ' || page_id when kind = 1 then 'gone' when kind in (5, 6) then '<html>page ' || page_id || '</html>' end as body
from asked
""")
def fetched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A request for every page, of which some time out, some are not there and some are landing pages that lead to a PDF, to none, or astray."""
    import re

    def get(url: str) -> tuple[bytes, int, str, str]:
        n = int(re.search(r"/(\d+)", url).group(1))
        kind = n % 7
        if "files.example" in url:
            return (b"%PDF-1.7 of " + str(n).encode() if kind == 2 else b"<html>not here</html>"), 200, "application/pdf", url
        if kind == 0:
            raise TimeoutError(f"timed out on {n}")
        if kind == 1:
            return b"gone", 404, "text/html", url
        if kind in (2, 4):
            return f'<html lang="en"><a href="https://files.example/{n}/guia.pdf">Español</a><a href="https://files.example/{n}/guide.pdf" hreflang="en">Download</a></html>'.encode(), 200, "text/html", url
        return f"<html>page {n}</html>".encode(), 200, "text/html", url

    host = F.concat(F.lit("https://host"), F.col("page_id") % 5, F.lit(".example/"), "page_id")
    wanted = table(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("document_id"), host.alias("source_url"), (F.col("page_id") % 7).isin(2, 3, 4).alias("landing_page"))
    return fetch.fetch(wanted, get).select("document_id", "http_status", "final_url", "error", F.col("body").cast("string").alias("body"))


@query("""
with placed as (select doc_id, text, doc_id // 100 as grp, row_number() over (partition by doc_id // 100 order by doc_id) as line_no from documents)
select grp, line_no, case when doc_id % 17 in (3, 8) then doc_id::varchar end as document_id, case doc_id % 17 when 3 then 'text' when 5 then 'json' when 6 then 'json' when 8 then 'type' when 9 then 'document_id' end as missing
from placed where doc_id % 17 in (3, 5, 6, 8, 9)
""")
def bad_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as JSON lines, a hundred to a file, some with a field left out, cut short, no object, or blank; the faults
    are found again with the numbers of their lines."""
    path = fresh_path(spark, "lines")
    docs = table(spark, sf_dir, "documents")
    turn = F.col("doc_id") % 17
    said = lambda *without: F.to_json(F.struct(*[c for n, c in {"document_id": F.col("doc_id").cast("string").alias("document_id"), "type": F.lit("paragraph").alias("type"), "text": F.coalesce("text", F.lit("")).alias("text")}.items() if n not in without]))
    value = F.when(turn == 3, said("text")).when(turn == 5, F.substr(said(), F.lit(1), F.length(said()) - 1)).when(turn == 6, "[1]").when(turn == 7, "").when(turn == 8, said("type")).when(turn == 9, said("document_id")).otherwise(said())
    rows = docs.select("doc_id", F.expr("doc_id div 100").alias("grp"), value.alias("value"))
    rows.repartition("grp").sortWithinPartitions("grp", "doc_id").select("grp", "value").write.partitionBy("grp").text(path)
    found = stores.bad_lines(spark, path)
    return found.select(F.regexp_extract("file", r"/grp=(\d+)/", 1).cast("bigint").alias("grp"), "line_no", "document_id", "missing")
