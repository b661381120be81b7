from __future__ import annotations

import gzip
import hashlib
import os

import brute
import duckdb
import pytest
from pyspark.sql import functions as F

from passagework.llm import queries, warc

SCHEMA = "page_id bigint, url string, html string, digest string"
BIG = "<p>ä</p>" * 200


def rows():
    out = [(i, f"http://h{i % 3}/{i}?a b\r\nX: y", f"<html>{i}" + "x" * 1200, "z") for i in range(40)]
    out += [(100 + i, None if i % 2 else "http://x/", BIG, "z") for i in range(30)]
    out += [(300, "u", "short", "z"), (301, "u", "short", "z"), (302, "u", None, "z"), (303, "u", "", "z")]
    out += [(None, "u", BIG, "z"), (None, None, None, "z"), (129, "again", BIG, "z"), (5, "u", "y" * 999, "z"), (6, "u", "y" * 1000, "z"), (7, "u", "y" * 1000, "z"), (8, "u", "\r\n\r\nWARC/1.1\r\n" * 100, "z")]
    return out


def expected(rs):
    kept = {}
    for p, _, h, _ in rs:
        if len((h or "").encode()) >= 1000 and p is not None:
            kept[h] = max(kept.get(h, p), p)
    out = []
    for p, _, h, _ in rs:
        data = (h or "").encode()
        revisit = h in kept and p != kept[h]
        out.append((p, len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", kept[h] if revisit else None))
    return out


def columns(df):
    return brute.in_order(df.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect())


def test_every_row_has_its_record(spark):
    df = spark.createDataFrame(rows(), SCHEMA).repartition(4)
    assert columns(warc.read_archives(warc.write_archives(df))) == brute.in_order(expected(rows()))


def test_archives_are_plain_gzip_members_in_files_of_bounded_size(spark, tmp_path):
    a = warc.Archive(file_bytes=2000, gap=0, read_bytes=3000)
    df = spark.createDataFrame(rows(), SCHEMA)
    index = warc.write_archives(df, f"file://{tmp_path}", a)
    assert len(os.listdir(tmp_path)) > 5
    for r in index.collect():
        with open(f"{tmp_path}/{r.file}", "rb") as f:
            f.seek(r.offset)
            assert gzip.decompress(f.read(r.length)).startswith(b"WARC/1.1\r\n")
    assert columns(warc.read_archives(index, a)) == brute.in_order(expected(rows()))
    some = index.where(F.col("digest") == hashlib.sha1(BIG.encode()).hexdigest())
    back = warc.read_archives(some, a, with_payload=True).collect()
    assert len(back) == 32
    assert {bytes(r.payload).decode() for r in back if r.record_type == "response"} == {BIG}


def test_ranges_cover_each_record_once():
    records = [(0, 10), (10, 5), (30, 5), (200, 50), (250, 1000), (1250, 1)]
    got = warc.ranges(records, 20, 100)
    assert got == [(0, 35, [0, 1, 2]), (200, 250, [3]), (250, 1250, [4]), (1250, 1251, [5])]
    assert warc.ranges([], 1, 1) == []


def test_damage_is_noticed(spark, tmp_path):
    index = warc.write_archives(spark.createDataFrame(rows()[:5], SCHEMA), f"file://{tmp_path}")
    r = index.first()
    with open(f"{tmp_path}/{r.file}", "r+b") as f:
        f.seek(r.offset + r.length // 2)
        b = f.read(1)
        f.seek(r.offset + r.length // 2)
        f.write(bytes([b[0] ^ 255]))
    with pytest.raises(Exception, match="ArchiveError"):
        warc.read_archives(index).collect()


def test_query_and_its_sql_agree(spark, tmp_path):
    spark.createDataFrame(rows(), SCHEMA).write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"create view pages as from read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    want = con.execute(queries.ORACLES["op10_warc"])
    names = [c[0] for c in want.description]
    assert brute.in_order(queries.op10_warc(spark, str(tmp_path)).select(*names).collect()) == brute.in_order(want.fetchall())


def test_empty_table(spark):
    assert warc.read_archives(warc.write_archives(spark.createDataFrame([], SCHEMA))).count() == 0
