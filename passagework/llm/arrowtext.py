"""Whole-column text work on Arrow buffers.

A string column of a record batch is one UTF-8 buffer plus offsets.  The helpers
here find words and hash them for all rows of a slice at once, so that Python runs
per slice and not per word.  Slices are cut by bytes, which bounds memory whatever
the number of rows in a batch; only a single text larger than the bound makes a
larger slice.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

SLICE_BYTES = 1 << 20
#: Words are maximal runs of bytes other than these (space, \t \n \v \f \r).
WORD_GAPS = b" \t\n\x0b\x0c\r"

_U64 = np.uint64
_BASE = _U64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2**64
_UNBASE = _U64(pow(int(_BASE), -1, 1 << 64))


def release() -> None:
    """Gives memory that is no longer used back to the system.

    Spark keeps a Python worker for later tasks, of any operator; what a task has freed would
    otherwise stay with it and add up beside the executor's heap."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # not the GNU C library
        pass


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` over a partition's batches, followed by ``release``."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        _GROWN.clear()
        release()

    return whole


def byte_set(values: bytes) -> np.ndarray:
    """Membership table over the 256 byte values."""
    table = np.zeros(256, bool)
    table[list(values)] = True
    return table


_GAP = byte_set(WORD_GAPS)


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    """The column of that exact name (names may clash in case only)."""
    return batch.column(batch.schema.get_field_index(name))


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets (len + 1) of a string or binary array; null counts as empty."""
    if texts.null_count:
        texts = pc.fill_null(texts, b"" if pa.types.is_binary(texts.type) or pa.types.is_large_binary(texts.type) else "")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, ends, data = texts.buffers()
    if len(texts) == 0 or ends is None:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    offsets = np.frombuffer(ends, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, name: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive parts of a batch with about ``limit`` bytes in that column, one row at least."""
    _, offsets = raw(column(batch, name))
    start, n = 0, batch.num_rows
    while start < n:
        stop = int(np.searchsorted(offsets, offsets[start] + limit, "right")) - 1
        stop = min(n, max(stop, start + 1))
        yield batch.slice(start, stop - start)
        start = stop


def find_words(data: np.ndarray, offsets: np.ndarray, gap: np.ndarray = _GAP) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word, and the first word of each row (len rows + 1)."""
    inside = ~gap[data]
    before = np.empty(len(data), bool)
    after = np.empty(len(data), bool)
    if len(data):
        before[0], after[-1] = False, False
        before[1:], after[:-1] = inside[:-1], inside[1:]
        edges = offsets[1:-1]
        edges = edges[(edges > 0) & (edges < len(data))]
        before[edges] = False
        after[edges - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def mix(x: np.ndarray) -> np.ndarray:
    """A fixed bijection on 64-bit values that spreads every bit (multiply and xor-shift)."""
    x = x ^ (x >> _U64(31))
    x = x * _U64(0xD6E8FEB86659FD93)
    x = x ^ (x >> _U64(29))
    x = x * _U64(0xA0761D6478BD642F)
    return x ^ (x >> _U64(32))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, _U64)
    out[:1] = 1
    return np.multiply.accumulate(out)


_GROWN: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i for i < n modulo 2**64."""
    if len(_GROWN.get("up", ())) < n:
        _GROWN["up"], _GROWN["down"] = _powers(_BASE, n), _powers(_UNBASE, n)
    return _GROWN["up"], _GROWN["down"]


#: Words of more bytes than this are hashed one by one by XXH64.
LONG_WORD = 64
_EIGHTHS = np.array([(1 << 8 * n) - 1 for n in range(9)], _U64)  # the first n of eight bytes


def hash_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0, limit: int = SLICE_BYTES) -> np.ndarray:
    """A 64-bit hash of each word's bytes: eight bytes at a time through ``mix``, long words by XXH64.

    ``mix`` is a bijection, so words of one length of up to eight bytes never agree; others agree by chance
    alone, whatever they repeat.  Two seeds give hashes that agree independently.  ``starts`` rise.  Work is cut
    at words, so memory stays near ``limit`` times a few bytes for texts of any length.
    """
    out = np.empty(len(starts), _U64)
    first = mix(np.array([seed], _U64) + _BASE)[0]
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + limit, "right")))
        low, size = starts[i], ends[i:j] - starts[i:j]
        part = np.append(data[low : ends[j - 1]], np.zeros(8, np.uint8))
        eights = np.ndarray(len(part) - 7, np.dtype("<u8"), part, 0, (1,))
        begins = starts[i:j] - low
        h = mix(first ^ (size.astype(_U64) * _BASE))
        live, done = np.flatnonzero((size > 0) & (size <= LONG_WORD)), 0
        while len(live):
            left = size[live] - done
            h[live] = mix(h[live] ^ (eights[begins[live] + done] & _EIGHTHS[np.minimum(left, 8)]))
            live, done = live[left > 8], done + 8
        for k in np.flatnonzero(size > LONG_WORD).tolist():
            h[k] = xxhash.xxh64_intdigest(part[begins[k] : begins[k] + size[k]], seed)
        out[i:j] = h
        i = j
    return out


def window_hashes(tokens: np.ndarray, width: int) -> np.ndarray:
    """Rolling polynomial hash (Rabin-Karp, modulo 2**64) of every run of ``width`` consecutive tokens."""
    n = len(tokens) - width + 1
    if n <= 0:
        return np.zeros(0, _U64)
    up, down = powers(len(tokens) + 1)
    sums = np.zeros(len(tokens) + 1, _U64)
    np.cumsum(tokens * up[: len(tokens)], out=sums[1:])
    return mix((sums[width:] - sums[:-width]) * down[:n])
