"""Media columns: payloads as PNG images in binary columns, and their perceptual hash.

A PNG is written and read chunk by chunk: each chunk's checksum is tested, image data is
deflated by zlib, and scan lines are filtered and unfiltered with numpy.  The feature is the
sign pattern of an image's low-frequency cosine transform (a perceptual hash).
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagework.llm import arrowtext as at
from passagework.llm.shared import pick

SIGNATURE = b"\x89PNG\r\n\x1a\n"
WIDTH = 64
#: Image data bytes in one IDAT chunk.
CHUNK = 1 << 20
#: Side of the square to which an image is averaged, and of the low-frequency corner that is kept.
SIDE, CORNER = 32, 8


class MediaError(ValueError):
    """Stored bytes that are not a readable image."""


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def write_png(samples: np.ndarray, level: int = 1) -> bytes:
    """An 8-bit grey image of ``samples`` (rows x width), all rows with filter None or all with Up, whichever deflates smaller."""
    rows, width = samples.shape
    lines = np.zeros((rows, width + 1), np.uint8)
    lines[:, 1:] = samples
    data = zlib.compress(lines.tobytes(), level)
    lines[:, 0] = 2
    lines[1:, 1:] -= samples[:-1]
    data = min(data, zlib.compress(lines.tobytes(), level), key=len)
    body = b"".join(_chunk(b"IDAT", data[i : i + CHUNK]) for i in range(0, len(data), CHUNK))
    return SIGNATURE + _chunk(b"IHDR", struct.pack(">IIBBBBB", width, rows, 8, 0, 0, 0, 0)) + body + _chunk(b"IEND", b"")


def chunks(stored: bytes) -> Iterator[tuple[bytes, bytes]]:
    """(kind, body) of each chunk, its checksum tested."""
    if stored[:8] != SIGNATURE:
        raise MediaError("not a PNG")
    i = 8
    while i < len(stored):
        if i + 12 > len(stored):
            raise MediaError("cut off")
        n = struct.unpack_from(">I", stored, i)[0]
        kind, body = stored[i + 4 : i + 8], stored[i + 8 : i + 8 + n]
        if len(body) != n or i + 12 + n > len(stored):
            raise MediaError("cut off")
        if zlib.crc32(body, zlib.crc32(kind)) != struct.unpack_from(">I", stored, i + 8 + n)[0]:
            raise MediaError(f"wrong checksum in {kind!r}")
        yield kind, body
        i += 12 + n
        if kind == b"IEND":
            return
    raise MediaError("no end")


def _paeth(a: int, b: int, c: int) -> int:
    p = a + b - c
    pa_, pb, pc = abs(p - a), abs(p - b), abs(p - c)
    return a if pa_ <= pb and pa_ <= pc else b if pb <= pc else c


def unfilter(lines: np.ndarray) -> np.ndarray:
    """Samples (rows x width) of filtered lines of one byte a sample, all five filter types.

    Runs of rows with filter None or Up are done at once, as sums down each column."""
    kinds, data = lines[:, 0], lines[:, 1:]
    if kinds.max(initial=0) > 4:
        raise MediaError("unknown filter")
    out = np.empty_like(data)
    edges = np.flatnonzero(np.diff(np.isin(kinds, (0, 2)).astype(np.int8))) + 1
    for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(kinds)]):
        if kinds[a] in (0, 2):
            # A row with filter None starts its columns anew: subtract what had been summed before it.
            first = data[a:b].copy()
            if a and kinds[a] == 2:
                first[0] += out[a - 1]
            total = np.cumsum(first, axis=0, dtype=np.uint8)
            start = np.maximum.accumulate(np.where((kinds[a:b] == 0) | (np.arange(b - a) == 0), np.arange(b - a), 0))
            before = np.zeros_like(total)
            before[1:] = total[:-1]
            out[a:b] = total - before[start]
            continue
        for i in range(a, b):
            above = out[i - 1] if i else np.zeros(data.shape[1], np.uint8)
            if kinds[i] == 1:
                out[i] = np.cumsum(data[i], dtype=np.uint8)
                continue
            left, row = 0, data[i].tolist()
            over = above.tolist()
            corner = 0
            for x, d in enumerate(row):
                guess = (left + over[x]) // 2 if kinds[i] == 3 else _paeth(left, over[x], corner)
                left, corner = (d + guess) & 255, over[x]
                row[x] = left
            out[i] = row
    return out


def read_png(stored: bytes) -> np.ndarray:
    """Samples (rows x width) of an 8-bit grey image without interlacing."""
    head, parts = None, []
    for kind, body in chunks(stored):
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            parts.append(body)
    if head is None or head[2:] != (8, 0, 0, 0, 0):
        raise MediaError("not an 8-bit grey image")
    width, rows = head[:2]
    try:
        data = zlib.decompress(b"".join(parts))
    except zlib.error as e:
        raise MediaError(str(e)) from e
    if len(data) != rows * (width + 1):
        raise MediaError("wrong amount of image data")
    return unfilter(np.frombuffer(data, np.uint8).reshape(rows, width + 1))


def _cosines(n: int, keep: int) -> np.ndarray:
    """The first ``keep`` rows of the orthonormal cosine transform of ``n`` points."""
    k, x = np.arange(keep)[:, None], np.arange(n)[None, :]
    out = np.cos(np.pi * k * (2 * x + 1) / (2 * n)) * np.sqrt(2 / n)
    out[0] /= np.sqrt(2)
    return out


_COSINES = _cosines(SIDE, CORNER)


def _averaged(samples: np.ndarray, n: int) -> np.ndarray:
    """``samples`` averaged over ``n`` equal stretches of rows (fractions of rows count by share)."""
    rows = len(samples)
    total = np.zeros((rows + 1, samples.shape[1]))
    np.cumsum(samples, axis=0, out=total[1:])
    cuts = np.arange(n + 1) * rows / n
    low = np.floor(cuts).astype(np.int64)
    high = np.minimum(low + 1, rows)
    at_cut = total[low] + (total[high] - total[low]) * (cuts - low)[:, None]
    return np.diff(at_cut, axis=0) * n / rows


def feature(samples: np.ndarray) -> str:
    """16 hex digits: which of the 8 x 8 lowest frequencies, save the constant one, lie above their median."""
    small = _averaged(_averaged(samples, SIDE).T, SIDE).T
    low = (_COSINES @ small @ _COSINES.T).ravel()
    # Rounding keeps equal images equal where summation differs in the last place.
    low = np.round(low, 6)
    bits = low > np.median(low[1:])
    bits[0] = False
    return np.packbits(bits).tobytes().hex()


def payload(text: bytes) -> bytes:
    """``text`` with bytes 0 up to a positive multiple of the width."""
    return text + bytes(-len(text) % WIDTH if text else WIDTH)


_STORED = "doc_id bigint, n_bytes bigint, media binary"


def store_texts(docs: DataFrame, text: str = "text", level: int = 1) -> DataFrame:
    """(doc_id, n_bytes, media) per row of ``docs``: the whole text as an image in a binary column.

    Null or empty text: 64 bytes 0.  n_bytes counts the text's own bytes, so that it can
    be taken out again.  Repeated rows give equal rows.  Empty table: no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in at.slices(batch, text):
                data, off = at.raw(at.column(part, text))
                whole, spans = data.tobytes(), off.tolist()
                images = [write_png(np.frombuffer(payload(whole[a:b]), np.uint8).reshape(-1, WIDTH), level) for a, b in zip(spans, spans[1:])]
                yield pa.RecordBatch.from_arrays([at.column(part, "doc_id"), pa.array(np.diff(off)), pa.array(images, pa.binary())], ["doc_id", "n_bytes", "media"])

    return pick(docs, "doc_id", text).withColumn("doc_id", F.col("doc_id").cast("bigint")).mapInArrow(at.tidy(run), _STORED)


def read_media(media: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature) from
    the stored images of ``store_texts`` output alone.  A damaged image stops the query with MediaError."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in at.slices(batch, "media"):
                rows = []
                for stored in at.column(part, "media").to_pylist():
                    samples = read_png(stored)
                    back = samples.tobytes()
                    rows.append((len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(stored), hashlib.sha256(stored).hexdigest(), feature(samples)))
                types = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
                names = ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
                yield pa.RecordBatch.from_arrays(
                    [at.column(part, "doc_id"), at.column(part, "n_bytes"), *(pa.array(c, t) for c, t in zip(zip(*rows), types))], ["doc_id", "n_bytes", *names]
                )

    return media.mapInArrow(at.tidy(run), "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string")
