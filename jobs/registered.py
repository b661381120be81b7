"""The jobs as registered queries: each runs its job twice over the whole tables and returns the output as it then stands."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs import refresh_passages, turn_report
from passagework.folders import fresh_path
from passagework.plans import catalogue as K
from passagework.plans.question_queries import reason_sql
from passagework.plans.text_queries import PACKED


def job1_refresh_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Current passages of all documents; the second run finds nothing new."""
    root = fresh_path(spark, "job1")
    for _ in range(2):
        # A pattern, since a stream reads a folder or what a pattern finds, and the table may be one file.
        refresh_passages.refresh_passages(spark, f"{sf_dir}/documents.parquet*", f"{root}/passages", f"{root}/checkpoint")
    found = refresh_passages.current(spark, f"{root}/passages")
    return found.select("doc_id", "ordinal", "chunk_id", "lang", "tokens", F.sha2("text", 256).alias("text_sha256"))


JOB1_SQL = f"""{PACKED}
select doc_id, ordinal::integer as ordinal, doc_id::varchar || ':' || ordinal::varchar as chunk_id, lang, {K.estimate_sql(K.words_sql("n.text"))} as tokens, sha256(n.text) as text_sha256
from numbered n join documents d using (doc_id)
"""


def job2_turn_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per user turn of all conversations; the second run replaces the first one's tables by the same rows."""
    root = fresh_path(spark, "job2")
    for _ in range(2):
        turn_report.turn_report(spark, f"{sf_dir}/conversations.parquet", f"{sf_dir}/documents.parquet", root)
    return spark.read.parquet(f"{root}/turns").select("conv_id", "turn", "outcome", "reason", "document_id", "n_words", "replied", "reply_words", "new_numbers")


JOB2_SQL = f"""
with turns as (
    select row_number() over () as r, conv_id, turn, role, coalesce(text, '') as text from conversations
), said as (
    select conv_id, turn, role, unnest(list_distinct(regexp_extract_all(text, '\\d+(?:\\.\\d+)?'))) as number from turns
), firsts as (
    select conv_id, number, min(turn) as turn from said group by conv_id, number
), fresh as (
    select conv_id, turn, count(distinct number) as new_numbers from said join firsts using (conv_id, turn, number) where role = 'assistant' group by conv_id, turn
), replies as (
    select conv_id, turn - 1 as turn, max({K.words_sql("text")}) as reply_words, max(coalesce(new_numbers, 0)) as new_numbers
    from turns left join fresh using (conv_id, turn) where role = 'assistant' group by conv_id, turn
), titles as (
    select doc_id, array_to_string(string_split(flat, ' ')[1:2], ' ') as alias from (select doc_id, {K.flat_sql("text")} as flat from documents) where len(string_split(flat, ' ')) >= 2
), aliases as (
    select alias, min(doc_id) as low, max(doc_id) as high from titles where alias <> 'healthy diet' group by alias
), asked as (
    select *, {K.flat_sql("text")} as flat, {reason_sql(K.fold_sql("text"))} as reason from turns where role = 'user'
), named as (
    select r, min(low) as low, max(high) as high from asked join aliases on contains(' ' || flat || ' ', ' ' || alias || ' ') group by r
)
select conv_id, turn, case when reason is not null then 'refused' when low is null then 'open' when low = high then 'named' else 'ambiguous' end as outcome, reason,
    case when low = high then low end as document_id, {K.words_sql("text")}::bigint as n_words, reply_words is not null as replied, coalesce(reply_words, 0)::bigint as reply_words,
    coalesce(new_numbers, 0)::bigint as new_numbers
from asked left join named using (r) left join replies using (conv_id, turn)
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"job1_refresh_passages": job1_refresh_passages, "job2_turn_report": job2_turn_report}
ORACLES = {"job1_refresh_passages": JOB1_SQL, "job2_turn_report": JOB2_SQL}
