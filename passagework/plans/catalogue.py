"""Registered queries, each with the SQL that gives the same rows.

Queries over the driver's tables use whole tables.  What these tables do not hold (guard words,
layout boxes, drafts) comes from small fixtures that are written once and used by both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passagework.folders import fresh_path

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def literal(x: object) -> str:
    """A value as SQL that both dialects of these fixtures read alike."""
    if x is None:
        return "null"
    if isinstance(x, bool):
        return "true" if x else "false"
    if isinstance(x, (int, float)):
        return repr(x)
    if isinstance(x, (list, tuple)):
        return "[" + ", ".join(map(literal, x)) + "]"
    text = "'" + str(x).replace("'", "''") + "'"
    for c in "\n\t":
        text = text.replace(c, f"' || chr({ord(c)}) || '")
    return f"({text})" if "||" in text else text


class Fixture:
    """Rows with a Spark schema, and the same rows as a SQL table expression."""

    TYPES = {"string": "varchar", "int": "integer", "bigint": "bigint", "double": "double", "boolean": "boolean", "array<string>": "varchar[]", "array<array<string>>": "varchar[][]"}

    def __init__(self, schema: str, rows: list[tuple]):
        self.schema, self.rows = schema, rows
        self.columns = [c.split(" ") for c in schema.split(", ")]

    def df(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows, self.schema)

    @property
    def sql(self) -> str:
        names = ", ".join(c for c, _ in self.columns)
        casts = ", ".join(f"{c}::{self.TYPES[t]} as {c}" for c, t in self.columns)
        return f"(select {casts} from (values " + ", ".join("(" + ", ".join(map(literal, r)) + ")" for r in self.rows) + f") as v({names}))"


def folder(spark: SparkSession, name: str) -> str:
    """A fresh folder that all nodes reach."""
    return fresh_path(spark, name)


def any_sql(x: str, marks: tuple[str, ...]) -> str:
    """Whether ``x`` holds one of the marks."""
    return "(" + " or ".join(f"contains({x}, {literal(m)})" for m in marks) + ")"


def lower_sql(x: str) -> str:
    return f"replace(lower({x}), 'ß', 'ss')"


def plain_html_sql(x: str) -> str:
    """Entities of the pages as characters, and what a reader of the page makes of white space."""
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#x27;", "''"), ("&amp;", "&")):
        x = f"replace({x}, '{entity}', '{char}')"
    return normalize_sql(x)


def strip_sql(x: str) -> str:
    return f"regexp_replace({x}, '^[\\s\\x0b]+|[\\s\\x0b]+$', '', 'g')"


def words_sql(x: str) -> str:
    return f"len(list_filter(regexp_split_to_array({x}, '[\\s\\x0b]+'), lambda w: w <> ''))"


def estimate_sql(n: str) -> str:
    return f"round_even({n} * 1.3::double, 0)::integer"


def fold_sql(x: str) -> str:
    return f"replace(replace(replace(lower({x}), 'ß', 'ss'), '’', chr(39)), chr(160), ' ')"


def flat_sql(x: str) -> str:
    """Folded, punctuation as spaces, spaces collapsed."""
    return collapse_sql(f"regexp_replace({fold_sql(x)}, '[^\\pL\\pM\\p{{Nd}}\\p{{Nl}}\\p{{Pc}}\\s]+', ' ', 'g')")


def collapse_sql(x: str) -> str:
    return f"trim(regexp_replace({x}, '[\\s\\x0b]+', ' ', 'g'), ' ')"


#: Written out apart from the engine's own, so that a wrong one there shows.
_SPELLED = {0xFB00: "ff", 0xFB01: "fi", 0xFB02: "fl", 0xFB03: "ffi", 0xFB04: "ffl", 0x2011: "-", 0x00A0: " ", 0x200B: "", 0x00AD: ""}


def normalize_sql(x: str) -> str:
    for old, new in _SPELLED.items():
        x = f"replace({x}, chr({old}), '{new}')"
    return collapse_sql(x)


def content_sql(x: str) -> str:
    from passagework.operators.claims import STOPWORDS

    return f"list_distinct(list_filter(regexp_extract_all(replace(lower({x}), 'ß', 'ss'), '[a-z]+'), lambda w: not list_contains({literal(STOPWORDS)}, w)))"


__all__ = ["QUERIES", "ORACLES", "Fixture", "F", "query", "table"]
