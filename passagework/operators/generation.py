"""Claim generators: an interface for a model, and an extractive stand-in that needs none."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagework.folders import delete, fresh_path


def model_generator(complete: Callable[[str], str]) -> Callable[[DataFrame], DataFrame]:
    """A generator over ``complete(prompt)``, called in the tasks; a failed call gives null and stops nothing."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for query_id, prompt in zip(f["query_id"], f["prompt"]):
                try:
                    out.append((query_id, complete(prompt)))
                except Exception:  # noqa: BLE001  (any transport failure is a failed call)
                    out.append((query_id, None))
            yield pd.DataFrame(out, columns=["query_id", "raw"])

    return lambda asked: asked.select("query_id", "prompt").mapInPandas(run, "query_id bigint, raw string")


LOG = "query_id bigint, attempt int, prompt_sha256 string, raw string"


def logged(generator: Callable[[DataFrame], DataFrame], path: str) -> Callable[[DataFrame], DataFrame]:
    """``generator`` with a durable log: what it gives is written under ``path`` before it is read.

    A call is known by query_id, attempt and the prompt's hash.  Calls that the log holds are not made again, whatever
    became of caches and executors since, in this run or a later one; failed calls are logged too, with a null.  Only
    rows of a task that is lost before its output is committed can be asked for twice.  Repeated rows of
    one call are one call; rows without a prompt are not asked for.  The calls are made when the generator is
    applied, not when its result is read."""

    def run(asked: DataFrame) -> DataFrame:
        spark = asked.sparkSession
        calls = asked.where("prompt is not null").select("query_id", F.col("attempt").cast("int").alias("attempt"), "prompt", F.sha2("prompt", 256).alias("prompt_sha256"))
        calls = calls.dropDuplicates(["query_id", "attempt", "prompt_sha256"])
        spark.createDataFrame([], LOG).write.mode("ignore").parquet(path)
        keys = ["query_id", "attempt", "prompt_sha256"]
        # What is to be asked is settled by being written: the generator may read its questions more than once.
        at = fresh_path(spark, "calls")
        calls.join(spark.read.schema(LOG).parquet(path).select(*keys), keys, "left_anti").write.parquet(at)
        new = spark.read.schema(calls.schema).parquet(at)
        if new.limit(1).count():
            made = new.select(*keys).join(generator(new.select("query_id", "attempt", "prompt")), "query_id", "left")
            made.select(*keys, "raw").write.mode("append").parquet(path)
        delete(spark, at)
        return calls.select(*keys).join(spark.read.schema(LOG).parquet(path), keys).select("query_id", "raw")

    return run


def table_generator(drafts: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """A generator whose outputs are a table (query_id, attempt, raw)."""
    return lambda asked: asked.select("query_id", "attempt").join(drafts, ["query_id", "attempt"]).select("query_id", "raw")


def extract(prompt: str) -> str:
    """A draft that claims each retrieved chunk's first sentence."""
    documents: dict[str, list[dict[str, object]]] = {}
    current = None
    lines = prompt.split("\n")
    for i, line in enumerate(lines):
        if line.startswith("[") and line.endswith("]") and ":" in line and i + 1 < len(lines):
            chunk_id = line[1:-1]
            current = chunk_id.rsplit(":", 1)[0]
            text = lines[i + 1].split(". ")[0].rstrip(".") + "."
            documents.setdefault(current, []).append({"text": text, "chunk_ids": [chunk_id]})
    return json.dumps({"documents": [{"document_id": d, "claims": c} for d, c in documents.items()]}, ensure_ascii=False)
