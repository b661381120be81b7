"""Reports what became of the questions of a set of conversations.

    spark-submit jobs/turn_report.py --config jobs/turn_report.json

For every user turn: whether the scope guard refuses it and why, the one document that it names, the reply in the turn
after it, and how many numbers of the reply nobody has said before in that conversation.

    <output>/turns     outcome (partition); conv_id, turn, reason, document_id, n_words, replied, reply_words, new_numbers
    <output>/summary   outcome, reason, document_id, turns, replied, new_numbers, as JSON

Outcomes are refused, named, ambiguous (several documents) and open.  Each run replaces both tables, so a run that was
cut short is simply repeated.
"""

from __future__ import annotations

import os
import sys

if __name__ == "__main__":
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from jobs import common
from passagework.functions import text as T
from passagework.operators import guard

LOG = common.log_of("turn_report")


def titles(documents: DataFrame, words: int) -> DataFrame:
    """(document_id, alias): a document's first ``words`` words; documents of fewer have no alias."""
    return documents.select(F.col("doc_id").alias("document_id"), guard.opening(F.col("text"), words).alias("alias")).where("alias is not null")


def new_numbers(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, new_numbers): distinct numbers of an assistant's turn that no earlier turn of the conversation has."""
    said = turns.select("conv_id", "turn", "role", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"(?U)\d+(?:\.\d+)?"), F.lit(0)))).alias("number"))
    first = said.groupBy("conv_id", "number").agg(F.min("turn").alias("turn"))
    own = said.where("role = 'assistant'").select("conv_id", "turn", "number").distinct()
    return own.join(first, ["conv_id", "turn", "number"]).groupBy("conv_id", "turn").agg(F.count(F.lit(1)).alias("new_numbers"))


def report_rows(conversations: DataFrame, aliases: DataFrame) -> DataFrame:
    """A row per user turn of ``conversations`` (conv_id, turn, role, text)."""
    turns = conversations.select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    # Turns meet by their numbers, so a conversation of any length spreads over tasks.
    replies = turns.where("role = 'assistant'").groupBy("conv_id", "turn").agg(F.max(T.word_count(F.col("text"))).cast("bigint").alias("reply_words"))
    replies = replies.join(new_numbers(turns), ["conv_id", "turn"], "left").withColumn("turn", F.col("turn") - 1)
    asked = guard.named_by_table(turns.where("role = 'user'"), aliases, "text").withColumn("reason", guard.scope_reason(F.col("text")))
    outcome = F.when(F.col("reason").isNotNull(), "refused").when(F.col("n_named") == 1, "named").when(F.col("n_named") > 1, "ambiguous").otherwise("open")
    return asked.join(replies, ["conv_id", "turn"], "left").select(
        "conv_id",
        "turn",
        "reason",
        F.col("scope_id").alias("document_id"),
        T.word_count(F.col("text")).cast("bigint").alias("n_words"),
        F.col("reply_words").isNotNull().alias("replied"),
        F.coalesce("reply_words", F.lit(0).cast("bigint")).alias("reply_words"),
        F.coalesce("new_numbers", F.lit(0).cast("bigint")).alias("new_numbers"),
        outcome.alias("outcome"),
    )


def turn_report(spark: SparkSession, conversations: str, documents: str, output: str, title_words: int = 2) -> dict:
    """Writes the report of the Parquet tables ``conversations`` and ``documents`` (doc_id, text); returns its counts.

    A document is named by its first ``title_words`` words.  Null texts are empty, rows without conv_id or turn
    have no reply, repeated rows are reported each."""
    read, made = Observation(), Observation()
    turns = spark.read.parquet(conversations).observe(read, F.count(F.lit(1)).alias("rows"))
    rows = report_rows(turns, titles(spark.read.parquet(documents), title_words)).observe(made, F.count(F.lit(1)).alias("rows"))
    rows.write.mode("overwrite").partitionBy("outcome").parquet(f"{output}/turns")
    back = spark.read.parquet(f"{output}/turns")
    summary = back.groupBy("outcome", "reason", "document_id").agg(F.count(F.lit(1)).alias("turns"), F.count_if("replied").alias("replied"), F.sum("new_numbers").alias("new_numbers"))
    summary.write.mode("overwrite").json(f"{output}/summary")
    done = {"rows_read": read.get["rows"], "turns": made.get["rows"], **{r.outcome: r.n for r in back.groupBy("outcome").agg(F.count(F.lit(1)).alias("n")).collect()}}
    LOG.info("read %d rows of %s, wrote %d turns to %s: %s", done["rows_read"], conversations, done["turns"], output, done)
    return done


if __name__ == "__main__":
    common.main(
        "turn_report",
        "Reports what became of the questions of a set of conversations.",
        turn_report,
        {
            "conversations": (str, "Parquet table of turns"),
            "documents": (str, "Parquet table of documents"),
            "output": (str, "folder of the report"),
            "title_words": (int, "first words of a document that name it"),
        },
        ("conversations", "documents", "output"),
    )
