"""WARC archives: deduplicated writing, an index, and coalesced range reads.

Every record is a gzip member of its own.  Tasks write their archives to the shared folder
under names of their own attempt and return an index (file, offset, length, URL, digest), which is
written as a table before anything is read.  A lost task is run again under a new name; what its
first attempt left is in no index and is never read.  Reading starts from the
index: the selected records of a file, sorted by offset, are fetched in few large ranges.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagework.llm import arrowtext as at
from passagework.llm.shared import Scratch, fresh_path, parts_for, pick, stored

_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


class ArchiveError(ValueError):
    """A record that cannot be read or does not match its digest."""


@dataclass(frozen=True)
class Archive:
    """``least``: payload bytes from which equal payloads are stored once.  ``file_bytes``: size at which
    a file is closed.  ``gap`` and ``read_bytes``: ranges closer than the one are read together up to the other."""

    least: int = 1000
    file_bytes: int = 64 << 20
    gap: int = 64 << 10
    read_bytes: int = 8 << 20
    level: int = 2
    date: str = "2024-01-01T00:00:00Z"


def _name(page_id: int | None, digest: str) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}:{digest}>"


def _page(name: str) -> int | None:
    part = name.strip("<>").split(":")[2]
    return None if part == "none" else int(part)


def _uri(url: str) -> bytes:
    """The URL with white space and control characters percent-encoded, so that it stays on its line."""
    return b"".join(b"%%%02X" % b if b < 33 or b == 127 else bytes([b]) for b in url.encode())


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool, a: Archive) -> bytes:
    """One record as a gzip member: a response with its payload, or a revisit without it."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    head = [
        b"WARC/1.1",
        b"WARC-Type: " + (b"revisit" if revisit else b"response"),
        b"WARC-Record-ID: " + _name(page_id, digest).encode(),
        b"WARC-Date: " + a.date.encode(),
        b"WARC-Payload-Digest: sha1:" + digest.encode(),
        b"Content-Type: application/http; msgtype=response",
        b"Content-Length: %d" % len(block),
    ]
    if url is not None:
        head.insert(4, b"WARC-Target-URI: " + _uri(url))
    if revisit:
        head += [b"WARC-Profile: " + _PROFILE.encode(), b"WARC-Refers-To: " + _name(refers_to, digest).encode()]
    deflate = zlib.compressobj(a.level, zlib.DEFLATED, 31)
    return deflate.compress(b"\r\n".join(head) + b"\r\n\r\n" + block + b"\r\n\r\n") + deflate.flush()


def parse(member: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """Headers of the record, headers of its HTTP message, and the payload it holds."""
    try:
        whole = zlib.decompress(member, 31)
    except zlib.error as e:
        raise ArchiveError(str(e)) from e
    head, cut, rest = whole.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    size = int(fields.get("Content-Length", -1))
    if lines[0] != "WARC/1.1" or not cut or len(rest) != size + 4 or rest[size:] != b"\r\n\r\n":
        raise ArchiveError("not a whole record")
    http, cut, payload = rest[:size].partition(b"\r\n\r\n")
    if not cut:
        raise ArchiveError("no HTTP message")
    return fields, dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:]), payload


def _revisits(pages: DataFrame, least: int) -> DataFrame:
    """(page_id, digest, keeper) of the rows whose payload another page keeps: of equal payloads
    of ``least`` bytes or more, the page with the largest page_id."""
    facts = stored(pages.select("page_id", F.sha1("html").alias("digest"), F.octet_length("html").alias("n")).where(F.col("n") >= least), "digests")
    groups = stored(facts.groupBy("digest", "n").agg(F.max("page_id").alias("keeper"), F.count(F.lit(1)).alias("copies")).where("copies > 1"), "copies")
    total = facts.count()
    # A payload with over a thousandth of all rows is hot; there are under a thousand such, so
    # they are broadcast, and no join key with so many rows is shuffled.
    hot = groups.where(F.col("copies") > total / 1000).select("digest", "n", "keeper")
    cold = groups.where(F.col("copies") <= total / 1000).select("digest", "n", "keeper")
    found = facts.join(F.broadcast(hot), ["digest", "n"]).unionByName(facts.join(F.broadcast(hot), ["digest", "n"], "left_anti").join(cold, ["digest", "n"]))
    return found.where("keeper is not null and not page_id <=> keeper").select("page_id", "digest", "keeper").distinct()


_INDEX = "file string, offset bigint, length bigint, url string, digest string"


class _Writer:
    """Archives of one task attempt."""

    def __init__(self, folder: str, a: Archive):
        self.fs, self.root = pyarrow.fs.FileSystem.from_uri(folder)
        self.folder, self.a = folder, a
        self.name, self.stream, self.offset, self.n = uuid.uuid4().hex, None, 0, 0

    def put(self, member: bytes) -> tuple[str, int, int]:
        if self.stream is None or self.offset >= self.a.file_bytes:
            self.close()
            self.file = f"{self.name}-{self.n:05d}.warc.gz"
            self.stream, self.offset, self.n = self.fs.open_output_stream(f"{self.root}/{self.file}", compression=None), 0, self.n + 1
        at_ = self.offset
        self.stream.write(member)
        self.offset += len(member)
        return self.file, at_, len(member)

    def close(self) -> None:
        if self.stream is not None:
            self.stream.close()
            self.stream = None


def write_archives(pages: DataFrame, folder: str | None = None, archive: Archive = Archive()) -> DataFrame:
    """Writes one record per row of ``pages`` (page_id, url, html) and returns the stored index.

    The payload is the html in UTF-8 (null: empty).  Of rows with equal payloads of
    ``archive.least`` bytes or more, those with the largest page_id are responses, the others revisits that
    refer to it; all other rows are responses.  A row without page_id is never referred to.
    A null url is left out of its record.  Every repeated row has a record.  An empty
    table gives an empty index.  ``folder`` must be reached from all nodes; it is a
    fresh one in the shared folder by default.
    """
    spark = pages.sparkSession
    folder = folder or fresh_path(spark, "archives")
    fs, root = pyarrow.fs.FileSystem.from_uri(folder)
    fs.create_dir(root, recursive=True)
    rows = pick(pages, "page_id", "url", "html").select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = _Writer(folder, archive)
        for batch in batches:
            for part in at.slices(batch, "html"):
                data, off = at.raw(at.column(part, "html"))
                whole, spans = data.tobytes(), off.tolist()
                out = []
                columns = (at.column(part, c).to_pylist() for c in ("page_id", "url", "digest", "keeper", "revisit"))
                for (page_id, url, digest, keeper, revisit), a, b in zip(zip(*columns), spans, spans[1:]):
                    out.append((*writer.put(record(page_id, url, whole[a:b], digest, keeper, revisit, archive)), url, digest))
                types = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], ["file", "offset", "length", "url", "digest"])
        writer.close()

    with Scratch() as scratch:
        decided = _revisits(rows, archive.least)
        keyed = rows.withColumn("digest", F.sha1("html"))
        joined = keyed.join(decided, keyed["page_id"].eqNullSafe(decided["page_id"]) & (keyed["digest"] == decided["digest"]), "left").select(keyed["page_id"], "url", "html", keyed["digest"], "keeper", F.expr("keeper is not null").alias("revisit"))
        return scratch.keep(stored(joined.mapInArrow(at.tidy(run), _INDEX).select(F.lit(folder).alias("folder"), "*"), "index"))


def ranges(records: list[tuple[int, int]], gap: int, most: int) -> list[tuple[int, int, list[int]]]:
    """(first, stop, numbers of records) of the reads that cover records (offset, length) sorted by offset."""
    out: list[tuple[int, int, list[int]]] = []
    for i, (offset, length) in enumerate(records):
        if out and offset - out[-1][1] <= gap and offset + length - out[-1][0] <= most:
            first, stop, held = out[-1]
            held.append(i)
            out[-1] = (first, max(stop, offset + length), held)
        else:
            out.append((offset, offset + length, [i]))
    return out


def read_archives(index: DataFrame, archive: Archive = Archive(), with_payload: bool = False) -> DataFrame:
    """(page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload) of the records that ``index`` selects.

    All comes from the archives; a response whose payload does not match its digest, or a
    damaged record, stops the query with ArchiveError.  payload is null for revisits, and for all
    records unless ``with_payload``.  The index may be filtered: only the selected
    records are read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = list(zip(*(at.column(batch, c).to_pylist() for c in ("folder", "file", "offset", "length"))))
            a = 0
            while a < len(rows):
                b = a
                while b < len(rows) and rows[b][:2] == rows[a][:2]:
                    b += 1
                fs, root = pyarrow.fs.FileSystem.from_uri(rows[a][0])
                with fs.open_input_file(f"{root}/{rows[a][1]}") as f:
                    for first, stop, held in ranges([r[2:] for r in rows[a:b]], archive.gap, archive.read_bytes):
                        data = f.read_at(stop - first, first)
                        yield _read([data[rows[a + i][2] - first : rows[a + i][2] - first + rows[a + i][3]] for i in held], with_payload)
                a = b

    placed = index.select("folder", "file", "offset", "length").repartition(parts_for(index, 4 << 20, "url"), "file").sortWithinPartitions("folder", "file", "offset")
    return placed.mapInArrow(at.tidy(run), "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, payload binary")


def _read(members: list[bytes], with_payload: bool) -> pa.RecordBatch:
    out = []
    for member in members:
        fields, http, payload = parse(member)
        digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
        kind = fields["WARC-Type"]
        refers = None
        if kind == "revisit":
            refers = _page(fields["WARC-Refers-To"])
        elif hashlib.sha1(payload).hexdigest() != digest or len(payload) != int(http["Content-Length"]):
            raise ArchiveError(f"payload of {fields['WARC-Record-ID']} does not match its digest")
        out.append((_page(fields["WARC-Record-ID"]), fields.get("WARC-Target-URI"), int(http["Content-Length"]), digest, kind, refers, payload if with_payload and kind == "response" else None))
    types = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary())
    names = ("page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload")
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], list(names))
