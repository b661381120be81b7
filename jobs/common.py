"""What the jobs share: their command line and their log."""

from __future__ import annotations

import argparse
import json
import logging
from collections.abc import Callable

from pyspark.sql import SparkSession


def log_of(name: str) -> logging.Logger:
    return logging.getLogger(f"passagework.jobs.{name}")


def settings(spark: SparkSession, path: str | None, given: dict, known: set[str]) -> dict:
    """The settings of the JSON file at ``path``, read by Spark, with those given on the command line put over them."""
    held = json.loads(spark.read.text(path, wholetext=True).first()[0]) if path else {}
    unknown = set(held) - known
    if unknown:
        raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
    return {**held, **{k: v for k, v in given.items() if v is not None}}


def main(name: str, about: str, run: Callable[..., dict], options: dict[str, tuple[type, str]], needed: tuple[str, ...]) -> None:
    """Reads the settings, runs ``run(spark, **settings)`` in a session of its own and prints what it returns."""
    parser = argparse.ArgumentParser(description=about)
    parser.add_argument("--config", help="JSON file of settings")
    for key, (kind, what) in options.items():
        parser.add_argument(f"--{key.replace('_', '-')}", type=kind, help=what)
    args = vars(parser.parse_args())
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName(name).getOrCreate()
    try:
        held = settings(spark, args.pop("config"), args, set(options))
        missing = [k for k in needed if not held.get(k)]
        if missing:
            parser.error(f"missing settings: {', '.join(missing)}")
        print(json.dumps(run(spark, **held)))
    finally:
        spark.stop()
