"""Removal of passages that an earlier document already holds.

Every window of a fixed number of words gets a rolling (Rabin-Karp) hash.  The hashes
are counted in Spark: for each hash the smallest document that has it is found, in
two steps so that a passage shared by very many documents costs one row per block of
input and not one per document.  Windows that an earlier document has merge into
maximal intervals of words, which are removed.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagework.llm import arrowtext as at
from passagework.llm.shared import parts_for, pick

#: Windows that a map task holds at once.
BLOCK_WINDOWS = 1 << 20
#: Input bytes behind one bucket of hashes, and behind one group of texts.
BUCKET_BYTES = 4 << 20
GROUP_BYTES = 4 << 20
#: Buckets from which a block would meet too few windows of each: hashes then go by way of wider buckets.
MANY_BUCKETS = 1 << 14
#: Keys of rows: a bucket from 0 on; -1 - group for spans; _HASHES - group for hashes that a document is known to share.
_HASHES = -(1 << 62)

_MARKS = "key bigint, docs binary, counts binary, data binary"
_MARKS_ARROW = pa.schema([("key", pa.int64()), ("docs", pa.binary()), ("counts", pa.binary()), ("data", pa.binary())])
_OTHER, _LOW = 0x5851F42D4C957F2D, np.uint64((1 << 32) - 1)


def window_keys(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Two rolling hashes of each window of the given words, of 64 bits each, over two independent hashes of words.

    Of the second one 16 bits are stored and others choose the bucket, so windows are told apart by 80 bits and
    as many as number the buckets, of which there are more the more windows there are: the 1.5e26 pairs
    of the 1.7e13 windows of 100 TB agree by chance 0.03 times in all (64 bits: 8e6 times)."""
    return at.window_hashes(at.hash_words(data, starts, ends), width), at.window_hashes(at.hash_words(data, starts, ends, _OTHER), width)


def packed(values: np.ndarray) -> bytes:
    """Whole numbers from 0 on in as few bytes each as the largest needs, after that number of bytes."""
    size = next(n for n in (1, 2, 4, 8) if int(values.max(initial=0)) < 1 << 8 * n)
    return bytes([size]) + values.astype(f"<u{size}").tobytes()


def unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(data, f"<u{data[0]}", offset=1)


def packed_ids(ids: np.ndarray) -> bytes:
    """Rising ids: the first, and the steps between them."""
    return ids[:1].astype("<i8").tobytes() + packed(np.diff(ids.astype("<i8").view(np.uint64)))


def unpacked_ids(data: bytes) -> np.ndarray:
    first, steps = np.frombuffer(data, "<i8", 1).view(np.uint64), unpacked(data[8:]).astype(np.uint64)
    return np.cumsum(np.concatenate((first, steps)), dtype=np.uint64).view(np.int64)


def runs(*values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start of each run of equal values (of all given arrays), and the runs' lengths."""
    n = len(values[0])
    new = np.zeros(n, bool)
    new[:1] = True
    for v in values:
        new[1:] |= v[1:] != v[:-1]
    starts = np.flatnonzero(new)
    return starts, np.diff(np.append(starts, n))


def by_key(hashes: np.ndarray, *more: np.ndarray) -> np.ndarray:
    """An order in which equal keys stand together."""
    order = np.argsort(hashes)
    same = hashes[order][1:] == hashes[order][:-1]
    for m in more:
        if np.any(same & (m[order][1:] != m[order][:-1])):
            return np.lexsort((*more, hashes))
    return order


def table(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 4, _MARKS_ARROW.types)], schema=_MARKS_ARROW)


def scaled(bits: np.ndarray, n: int) -> np.ndarray:
    """32 random bits as a number under ``n``."""
    return (bits * np.uint64(n)) >> np.uint64(32)


def bucket_rows(bucket: np.ndarray, hashes: np.ndarray, more: np.ndarray, low: np.ndarray) -> pa.RecordBatch:
    """Rows (bucket, documents, windows of each, keys) of distinct keys with their smallest documents."""
    order = np.lexsort((low, bucket))
    bucket, hashes, more, low = bucket[order], hashes[order], more[order], low[order]
    starts, lengths = runs(bucket)
    out = []
    for a, n in zip(starts.tolist(), lengths.tolist()):
        docs = low[a : a + n]
        firsts, counts = runs(docs)
        out.append((int(bucket[a]), packed_ids(docs[firsts]), packed(counts), hashes[a : a + n].tobytes() + more[a : a + n].tobytes()))
    return table(out)


_KEY_BYTES = 10


def keys_of(docs: list[bytes], counts: list[bytes], data: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, stored bits of the second ones, documents) of rows of ``bucket_rows``."""
    sizes = [len(x) // _KEY_BYTES for x in data]
    return (
        np.concatenate([np.frombuffer(x, np.uint64, n) for x, n in zip(data, sizes)]),
        np.concatenate([np.frombuffer(x, np.uint16, n, 8 * n) for x, n in zip(data, sizes)]),
        np.concatenate([np.repeat(unpacked_ids(d), unpacked(c)) for d, c in zip(docs, counts)]),
    )


class Block:
    """Windows of consecutive rows, until there are enough of them to be summed up."""

    def __init__(self, buckets: int):
        self.buckets = buckets
        self.clear()

    def clear(self) -> None:
        self.rows: list[np.ndarray] = []  # (doc_id, text's number, group) of each row
        self.windows: list[tuple[np.ndarray, ...]] = []  # hash, second hash, row, place
        self.size = self.held = 0

    def add(self, rows: np.ndarray, hashes: np.ndarray, more: np.ndarray, row: np.ndarray, places: np.ndarray) -> None:
        self.rows.append(rows)
        self.windows.append((hashes, more, row + self.held, places))
        self.held += len(rows)
        self.size += len(hashes)

    def marks(self) -> Iterator[pa.RecordBatch]:
        """Per bucket the block's distinct keys, each with its smallest document; per group of
        texts the intervals that a smaller document of the same block covers."""
        if self.size:
            rows = np.concatenate(self.rows)
            hashes, more, row, places = (np.concatenate(x) for x in zip(*self.windows))
            self.windows = []
            order = by_key(hashes, more)
            hashes, more, row, places = hashes[order], more[order], row[order], places[order]
            starts, lengths = runs(hashes, more)
            docs = rows[row, 0]
            low = np.minimum.reduceat(docs, starts)
            later = docs > np.repeat(low, lengths)
            yield bucket_rows(scaled(more[starts] & _LOW, self.buckets), hashes[starts], (more[starts] >> np.uint64(48)).astype(np.uint16), low)
            yield covered(rows, row[later], places[later])
        self.clear()


def covered(rows: np.ndarray, row: np.ndarray, places: np.ndarray) -> pa.RecordBatch:
    """Rows (-1 - group, (doc_id, text's number) pairs, counts, (first, last) window pairs) of windows of ``rows``."""
    order = np.lexsort((places, row))
    row, places = row[order], places[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (places[1:] > places[:-1] + 1)
    first = np.flatnonzero(new)
    spans = np.stack([places[first], places[np.append(first[1:], len(row))[: len(first)] - 1]], 1).astype("<i4") if len(row) else np.zeros((0, 2), "<i4")
    starts, lengths = runs(row[first])
    held = rows[row[first][starts]]
    out = []
    for g in np.unique(held[:, 2]).tolist():
        of = np.flatnonzero(held[:, 2] == g)
        take = np.concatenate([spans[a : a + n] for a, n in zip(starts[of].tolist(), lengths[of].tolist())])
        out.append((-1 - g, np.ascontiguousarray(held[of, :2]).astype("<i8").tobytes(), lengths[of].astype("<i4").tobytes(), take.tobytes()))
    return table(out)


def _windows(docs: DataFrame, width: int, buckets: int, groups: int) -> DataFrame:
    """Rows for ``_judged``: from each map task's blocks."""
    wide = 1 if buckets <= MANY_BUCKETS else -(-buckets // int(buckets**0.5))  # about as many wide ones as buckets in each

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = Block(-(-buckets // wide))
        for batch in batches:
            for part in at.slices(batch, "text"):
                data, off = at.raw(at.column(part, "text"))
                begins, ends, first = at.find_words(data, off)
                if len(begins) < width:
                    continue
                row = np.repeat(np.arange(part.num_rows), np.diff(first))
                whole = np.flatnonzero(row[: 1 - width] == row[width - 1 :]) if width > 1 else np.arange(len(row))
                hashes, more = (x[whole] for x in window_keys(data, begins, ends, width))
                rows = np.stack([at.column(part, c).to_numpy(zero_copy_only=False) for c in ("doc_id", "tid", "grp")], 1)
                block.add(rows, hashes, more, row[whole], whole - first[row[whole]])
                if block.size >= BLOCK_WINDOWS:
                    yield from block.marks()
        yield from block.marks()

    found = docs.mapInArrow(at.tidy(run), _MARKS)
    return found if wide == 1 else _narrowed(found, wide, groups)


def _narrowed(marks: DataFrame, wide: int, groups: int) -> DataFrame:
    """Rows of wide buckets, each dealt to ``wide`` buckets by the first hash.  What meets here is summed up by
    blocks again, so that a row holds many keys whatever the number of buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def summed() -> Iterator[pa.RecordBatch]:
            if held:
                keys, *rest = zip(*held)
                hashes, more, docs = keys_of(*rest)
                key = np.repeat(np.array(keys, np.uint64), [len(x) // _KEY_BYTES for x in rest[2]])
                order = by_key(hashes, more, key)
                hashes, more, key, docs = hashes[order], more[order], key[order], docs[order]
                starts, lengths = runs(hashes, more, key)
                low = np.minimum.reduceat(docs, starts)
                yield bucket_rows(key[starts] * np.uint64(wide) + scaled(hashes[starts] >> np.uint64(32), wide), hashes[starts], more[starts], low)
                later = docs > np.repeat(low, lengths)
                yield shared_hashes(hashes[later], docs[later], groups, _HASHES)
                held.clear()

        for batch in batches:
            for key, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if key < 0:
                    yield table([(key, *row)])
                    continue
                held.append((key, *row))
                size += len(row[2]) // _KEY_BYTES
                if size >= BLOCK_WINDOWS:
                    yield from summed()
                    size = 0
        yield from summed()

    return marks.repartition("key").sortWithinPartitions("key").mapInArrow(at.tidy(run), _MARKS)


def shared_hashes(hashes: np.ndarray, docs: np.ndarray, groups: int, base: int = 0) -> pa.RecordBatch:
    """Rows (group, doc_ids, counts, hashes) of windows that a smaller document has; the key is ``base`` less the group if that is not 0."""
    order = np.argsort(docs, kind="stable")
    hashes, docs = hashes[order], docs[order]
    starts, lengths = runs(docs)
    ids = docs[starts]
    key = group_of(ids, groups)
    out = []
    for k in np.unique(key).tolist():
        of = np.flatnonzero(key == k)
        take = np.concatenate([hashes[a : a + n] for a, n in zip(starts[of].tolist(), lengths[of].tolist())])
        out.append((base - k if base else k, ids[of].astype("<i8").tobytes(), lengths[of].astype("<i4").tobytes(), take.tobytes()))
    return table(out)


def judge(docs: list[bytes], counts: list[bytes], data: list[bytes], groups: int) -> pa.RecordBatch:
    """``shared_hashes`` of the keys of one bucket whose smallest document is another."""
    hashes, more, low = keys_of(docs, counts, data)
    order = by_key(hashes, more)
    hashes, more, low = hashes[order], more[order], low[order]
    starts, lengths = runs(hashes, more)
    later = low > np.repeat(np.minimum.reduceat(low, starts), lengths)
    return shared_hashes(hashes[later], low[later], groups)


def _judged(windows: DataFrame, groups: int) -> DataFrame:
    """Rows (key, docs, counts, data) per group of texts: spans and shared hashes (key < 0)
    as they came, and hashes of windows whose smallest document is another (key >= 0: the group)."""

    def run(key: tuple, got: pa.Table) -> pa.Table:
        if key[0].as_py() < 0:
            return got.select(["key", "docs", "counts", "data"])
        found = pa.Table.from_batches([judge(*(got[c].to_pylist() for c in ("docs", "counts", "data")), groups)])
        at.release()
        return found

    return windows.groupBy("key").applyInArrow(run, _MARKS)


def group_of(ids: np.ndarray, groups: int) -> np.ndarray:
    """The group of texts of each doc_id: pmod(xxhash64(doc_id), groups), as Spark computes it."""
    u = np.uint64
    p1, p2, p3, p4, p5 = u(0x9E3779B185EBCA87), u(0xC2B2AE3D27D4EB4F), u(0x165667B19E3779F9), u(0x85EBCA77C2B2AE63), u(0x27D4EB2F165667C5)
    turn = lambda x, n: (x << u(n)) | (x >> u(64 - n))
    with np.errstate(over="ignore"):
        h = (u(42) + p5 + u(8)) ^ (turn(ids.astype(np.int64).view(u) * p2, 31) * p1)
        h = turn(h, 27) * p1 + p4
        h = (h ^ (h >> u(33))) * p2
        h = (h ^ (h >> u(29))) * p3
        h ^= h >> u(32)
    return h.view(np.int64) % groups


def cut_windows(tokens: np.ndarray, spans: np.ndarray, hashes: np.ndarray, width: int) -> np.ndarray:
    """Which words go: those under a window that starts in a span (first and last start) or whose hash is listed.

    The listed hashes are those of windows of this very document, so 64 bits tell them apart here."""
    starts = np.zeros(len(tokens) + 1, np.int64)
    if len(hashes):
        hit = np.flatnonzero(np.isin(at.window_hashes(tokens, width), hashes))
        starts[hit] += 1
        starts[hit + width] -= 1
    if len(spans):
        np.add.at(starts, spans[:, 0], 1)
        np.add.at(starts, spans[:, 1] + width, -1)
    return np.cumsum(starts)[:-1] > 0


def remove_repeats(docs: DataFrame, width: int = 13) -> DataFrame:
    """(doc_id, n_words, n_removed, kept, removed) per row of ``docs``.

    A word goes if a window of ``width`` consecutive words that covers it also starts in
    a document with a smaller doc_id; windows are judged on the input.  ``kept`` is the
    remaining words joined by one space, ``removed`` the maximal intervals of removed
    words (first, one past the last).  Null text: no words.  Rows of one doc_id, equal or
    not, do not remove each other's words; they meet in one task, as one document would.  A
    row without doc_id is kept whole and removes nothing.  Empty table: no rows.

    Windows are told apart by hashes (see ``window_keys``).
    """
    docs = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return _removed(docs, width, [])


def without_repeats(docs: DataFrame, width: int = 13) -> DataFrame:
    """The rows of ``docs`` without what ``remove_repeats`` takes; all columns are kept.

    A text that loses nothing stays as it is; others become their remaining words joined
    by one space, and n_chars, if there, follows.  Documents that lose every word go.
    """
    names = docs.columns
    held = {n: f"c{i}" for i, n in enumerate(names)}
    plain = docs.toDF(*held.values())
    found = _removed(plain.select(F.col(held["doc_id"]).cast("bigint").alias("doc_id"), F.col(held["text"]).cast("string").alias("text"), *held.values()), width, list(held.values()))
    text = F.when(F.col("n_removed") == 0, F.col(held["text"])).otherwise(F.col("kept"))
    out = found.where("n_removed = 0 or n_removed < n_words").withColumn(held["text"], text)
    if "n_chars" in held:
        out = out.withColumn(held["n_chars"], F.length(held["text"]).cast(docs.schema["n_chars"].dataType))
    return out.select(*held.values()).toDF(*names)


def _removed(docs: DataFrame, width: int, carry: list[str]) -> DataFrame:
    """``remove_repeats`` for (doc_id, text, carried columns)."""
    groups = parts_for(docs.select("text"), GROUP_BYTES)
    # Rows without doc_id are dealt by their texts: they need no marks.
    held = docs.withColumn("tid", F.xxhash64("text")).withColumn("grp", F.expr(f"pmod(if(doc_id is null, tid, xxhash64(doc_id)), {groups}L)"))
    found = _judged(_windows(held.where("doc_id is not null").select("doc_id", "tid", "text", "grp"), width, parts_for(docs.select("text"), BUCKET_BYTES), groups), groups)
    spans = F.expr(f"key < 0 and key > {_HASHES}L")
    grp = F.when(spans, -1 - F.col("key")).when(F.col("key") < 0, F.lit(_HASHES) - F.col("key")).otherwise(F.col("key"))
    found = found.select(grp.alias("grp"), spans.alias("spans"), "docs", "counts", "data")
    types = dict(docs.dtypes)

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        spans: dict[tuple, list] = {}
        hashes: dict[int, list] = {}
        for kind, ids, counts, data in zip(*(right[c].to_pylist() for c in ("spans", "docs", "counts", "data"))):
            ids, values = np.frombuffer(ids, "<i8"), np.frombuffer(data, "<i4").reshape(-1, 2) if kind else np.frombuffer(data, np.uint64)
            owners = [*map(tuple, ids.reshape(-1, 2).tolist())] if kind else ids.tolist()
            for owner, piece in zip(owners, np.split(values, np.cumsum(np.frombuffer(counts, "<i4"))[:-1])):
                (spans if kind else hashes).setdefault(owner, []).append(piece)
        out = {"n_words": [], "n_removed": [], "kept": [], "removed": []}
        for doc, tid, text in zip(left["doc_id"].to_pylist(), left["tid"].to_pylist(), left["text"]):
            data = text.as_buffer().to_pybytes() if text.is_valid else b""
            words = data.split()
            gone = []
            if (doc, tid) in spans or doc in hashes:
                begins, ends, _ = at.find_words(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
                tokens = at.hash_words(np.frombuffer(data, np.uint8), begins, ends)
                none = np.zeros((0, 2), np.int64)
                cut = cut_windows(tokens, np.concatenate(spans.get((doc, tid), [none])), np.concatenate(hashes.get(doc, [np.zeros(0, np.uint64)])), width)
                edges = np.flatnonzero(np.diff(np.concatenate(([0], cut.view(np.int8), [0])))).reshape(-1, 2)
                gone = [{"first": int(a), "stop": int(b)} for a, b in edges]
                kept = b" ".join(compress(words, (~cut).tolist()))
            else:
                kept = b" ".join(words)
            out["n_words"].append(len(words))
            out["n_removed"].append(sum(x["stop"] - x["first"] for x in gone))
            out["kept"].append(kept.decode())
            out["removed"].append(gone)
        span = pa.list_(pa.struct([("first", pa.int64()), ("stop", pa.int64())]))
        columns = [*(left[c] for c in carry), left["doc_id"], pa.array(out["n_words"], pa.int64()), pa.array(out["n_removed"], pa.int64()), pa.array(out["kept"], pa.string()), pa.array(out["removed"], span)]
        spans.clear()
        hashes.clear()
        at.release()
        return pa.Table.from_arrays(columns, [*carry, "doc_id", *out])

    schema = "doc_id bigint, n_words bigint, n_removed bigint, kept string, removed array<struct<first: bigint, stop: bigint>>"
    return held.groupBy("grp").cogroup(found.groupBy("grp")).applyInArrow(run, ", ".join([*(f"{c} {types[c]}" for c in carry), schema]))
