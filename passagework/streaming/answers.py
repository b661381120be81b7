"""Answering a stream of questions: each micro-batch is one run of the batch plan."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from passagework.config import EngineConfig
from passagework.plans.answer import Generator, answer_batch, release


def answer_stream(questions: DataFrame, embed: Callable[[DataFrame], DataFrame], index: DataFrame, registry: DataFrame, generator: Generator, path: str, checkpoint: str, config: EngineConfig = EngineConfig(), **trigger: object) -> StreamingQuery:
    """Appends replies to Parquet under ``path``, one folder per batch, so that a repeated batch replaces its own.

    Empty messages and unknown documents are left out of a batch instead of stopping the stream.
    """
    from passagework.operators.guard import question_violations

    def run(batch: DataFrame, batch_id: int) -> None:
        bad = question_violations(batch, registry).select("query_id").distinct()
        good = batch.join(bad, "query_id", "left_anti")
        replies = answer_batch(embed(good), index, registry, generator, config, check=False)
        replies.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
        release(replies)

    return questions.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
