from __future__ import annotations

import duckdb

from passagework.operators import chunking
from passagework.plans import registered

#: doc_id, text, lang, source: blank texts, white space beyond ASCII, and nulls and blanks where a heading's parts stand.
ROWS = [
    (1, "first", "en", "a"), (2, "", "en", "a"), (3, " \n\t ", "en", "a"), (4, None, "en", "a"), (5, " fifth \x0b of\r\na ", "de", "a"), (6, "no\u00a0break \u2003", "en", "a"), (7, "\u00a0", "en", "a"),
    (8, "no lang", None, "b"), (9, "blank lang", " ", "b"), (10, "x", "", "b"), (11, "no source", "en", None), (12, "", "en", None), (13, "also none", "en", None), (14, "spaced source", "en", " c "), (15, "empty source", "en", ""),
    (None, "no id", "en", "a"), (16, "last", "en", "a"),
]


def test_chunk_enrichment_follows_its_sql_on_awkward_documents(spark, tmp_path):
    """blank documents take numbers."""
    spark.createDataFrame(ROWS, "doc_id bigint, text string, lang string, source string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as from read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    want = con.execute(registered.ORACLES["chunk_enrichment"])
    columns = [c[0] for c in want.description]
    got = registered.QUERIES["chunk_enrichment"](spark, str(tmp_path)).select(*columns)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want.fetchall(), key=repr)


def test_numbers_skip_empty_pieces_unless_asked(spark):
    blocks = spark.createDataFrame([("d", i, "list_item", t, None, None) for i, t in enumerate(["a", " ", "b c"])] + [(None, 0, "list_item", "x", None, None)], "document_id string, block_no bigint, type string, text string, heading_path array<string>, header array<string>")
    ids = lambda rows: sorted(((r.chunk_id, r.text) for r in rows.collect()), key=str)
    assert ids(chunking.numbered(chunking.pieces(blocks))) == [("d:0", "a"), ("d:1", "b c"), (None, "x")]
    assert ids(chunking.numbered(chunking.pieces(blocks, blank_items=True), count_empty=True, space=r"\s+")) == [("d:0", "a"), ("d:2", "b c"), (None, "x")]
