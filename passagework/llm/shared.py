"""Helpers: the shared folder, materialised tables, sizes."""

from __future__ import annotations

import threading

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passagework.folders import delete, fresh_path


#: Scratch objects that are open in this thread, the innermost last.
_LOCAL = threading.local()


def _open() -> list[Scratch]:
    if not hasattr(_LOCAL, "held"):
        _LOCAL.held = []
    return _LOCAL.held


class Scratch:
    """Within ``with Scratch() as scratch``: tables that ``stored`` writes are deleted at the end, but for those
    that were given to ``keep`` because what is returned still reads them.  Threads do not see each other's."""

    def __init__(self) -> None:
        self.made: list[tuple[SparkSession, str]] = []
        self.kept: set[str] = set()

    def keep(self, df: DataFrame) -> DataFrame:
        self.kept.add(df._stored)
        return df

    def drop(self, df: DataFrame) -> None:
        """What ``stored`` has returned before goes with the rest; other frames stay."""
        if hasattr(df, "_stored"):
            self.made.append((df.sparkSession, df._stored))

    def __enter__(self) -> Scratch:
        _open().append(self)
        return self

    def __exit__(self, *_: object) -> None:
        _open().remove(self)
        for spark, path in self.made:
            if path in self.kept:
                if _open():
                    _open()[-1].made.append((spark, path))
                continue
            delete(spark, path)


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read again.

    This cuts lineage and survives lost executors: later stages only need the files.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._stored = path
    if _open():
        _open()[-1].made.append((spark, path))
    return back


def plan_bytes(df: DataFrame) -> int:
    """Catalyst's estimate of a frame's size; runs no job."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def parts_for(df: DataFrame, target: int, column: str = "text") -> int:
    """Partitions of about ``target`` bytes of ``df``, never under the session's shuffle partitions.

    Catalyst's estimate serves where it has one (files); else the column is measured.
    """
    spark = df.sparkSession
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    size = plan_bytes(df)
    if size > 1 << 55:
        size = (df.agg(F.sum(F.octet_length(column))).first()[0] or 0) // 2
    return max(least, -(-size // target))


def pick(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns.  Names that differ in case alone are told apart by exact match."""
    if len({c.lower() for c in df.columns}) == len(df.columns):
        return df.select(*names)
    kept = [f"_{i}" for i in range(len(df.columns))]
    renamed = df.toDF(*kept)
    return renamed.select(*[F.col(kept[df.columns.index(n)]).alias(n) for n in names])
