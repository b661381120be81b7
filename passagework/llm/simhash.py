"""SimHash fingerprints and near-duplicate groups by multi-index hashing.

A 64-bit fingerprint is cut into two 32-bit segments.  Two fingerprints that differ
in at most three bits agree in at least one segment up to one bit, so each one
probes, per segment, a table of segment values with the 33 values of the Hamming
ball of radius one; what it meets is verified on the whole fingerprint.  A segment
value held by very many fingerprints is not compared pair by pair: inside it the
same scheme runs again on the two 16-bit halves of the other segment.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passagework.llm import arrowtext as at
from passagework.llm import components as components_
from passagework.llm.components import components
from passagework.llm.shared import Scratch, pick, stored

SEED = 42
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: A shingle batch whose bit counts are taken at once.
_BITS_AT_ONCE = 1 << 16


def fingerprint(text: bytes, width: int = 3) -> int:
    """SimHash of ``text``: A-Z folded, words split at white space, ``width``-word shingles.

    A bit is 1 if it is set in over half of the shingles' XXH64 values (repeats count).
    A text of fewer words is one shingle; without words the fingerprint is 0.
    """
    words = text.translate(_FOLD).split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    begins = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - width + 1)
    stops = ends[min(width, len(words)) - 1 :]
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(64, np.int64)
    for i in range(0, n, _BITS_AT_ONCE):
        spans = zip(begins[i : i + _BITS_AT_ONCE].tolist(), stops[i : i + _BITS_AT_ONCE].tolist())
        h = np.array([digest(joined[a:b], SEED) for a, b in spans][: n - i], np.uint64)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, width: int = 3, text: str = "text") -> DataFrame:
    """(doc_id, fp) per row of ``docs``; fp is the fingerprint as a signed 64-bit integer.

    A null text counts as empty.  Rows are kept one to one, repeated ids included.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in at.slices(batch, text):
                data, off = at.raw(at.column(part, text))
                whole = data.tobytes()
                spans = off.tolist()
                fps = np.array([fingerprint(whole[a:b], width) for a, b in zip(spans, spans[1:])], np.uint64)
                yield pa.RecordBatch.from_arrays([at.column(part, "doc_id"), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return pick(docs, "doc_id", text).mapInArrow(at.tidy(run), "doc_id bigint, fp bigint")


def _ball(value: str, bits: int) -> str:
    """SQL: the Hamming ball of radius one around an integer of so many bits, as an array."""
    return f"concat(array({value}), transform(sequence(0, {bits - 1}), i -> {value} ^ shiftleft(1L, i)))"


def _halves(fp: str = "fp") -> str:
    """SQL: (segment number, segment value, rest of the fingerprint) for both 32-bit segments."""
    return (
        f"array(struct(0L as seg, {fp} & 4294967295L as val, shiftrightunsigned({fp}, 32) as rest),"
        f"struct(1L as seg, shiftrightunsigned({fp}, 32) as val, {fp} & 4294967295L as rest))"
    )


def near_pairs(fps: DataFrame, most_bits: int = 3, crowded: int = 512) -> DataFrame:
    """(a, b), a < b: all pairs of the distinct fingerprints in ``fps`` (fp) that differ in 1 to ``most_bits`` bits.

    ``most_bits`` is 3 at most, which two segments with balls of radius one cover.
    ``crowded``: segment values held by more fingerprints are split again by the
    16-bit halves of the remaining segment (which leaves at most 2**16 fingerprints
    in a cell); no pair is lost either way.
    """
    if not 0 < most_bits <= 3:
        raise ValueError("two 32-bit segments with radius one cover 1 to 3 bits")
    near = F.expr(f"a < b and bit_count(a ^ b) <= {most_bits}")
    table = fps.select("fp", F.inline(F.expr(_halves()))).select("fp", "rest", F.expr("shiftleft(seg, 32) | val").alias("cell"))
    probes = (
        fps.select("fp", F.inline(F.expr(_halves())))
        .select("fp", "rest", "seg", F.explode(F.expr(_ball("val", 32))).alias("val"))
        .select("fp", "rest", F.expr("shiftleft(seg, 32) | val").alias("cell"))
    )
    full = stored(table.groupBy("cell").count().where(F.col("count") > crowded).select("cell"), "crowded")
    if not full.limit(1).count():
        held = table.select(F.col("fp").alias("b"), "cell")
        return probes.select(F.col("fp").alias("a"), "cell").join(held.hint("shuffle_hash"), "cell").where(near).select("a", "b")
    roomy = table.join(full, "cell", "left_anti").select(F.col("fp").alias("b"), "cell")
    first = probes.select(F.col("fp").alias("a"), "cell").join(roomy.hint("shuffle_hash"), "cell").where(near).select("a", "b")
    quarters = "array(struct(0 as q, rest & 65535L as part), struct(1 as q, shiftrightunsigned(rest, 16) as part))"
    inner = table.join(full, "cell", "left_semi").select(F.col("fp").alias("b"), "cell", F.inline(F.expr(quarters)))
    asked = (
        probes.join(full, "cell", "left_semi")
        .select(F.col("fp").alias("a"), "cell", F.inline(F.expr(quarters)))
        .select("a", "cell", "q", F.explode(F.expr(_ball("part", 16))).alias("part"))
    )
    second = asked.join(inner, ["cell", "q", "part"]).where(near).select("a", "b")
    return first.union(second)


def shared_cells(fp: Column) -> Column:
    """20 hashes of a fingerprint; two fingerprints that differ in at most three bits have one or more of them in common.

    Three bits fall into at most three of six blocks, so the values of some three blocks (31 to 33 bits) agree."""
    edges = [0, 11, 22, 33, 44, 54, 64]
    blocks = [(1 << b) - (1 << a) for a, b in zip(edges, edges[1:])]
    masks = [sum(three) for three in combinations(blocks, 3)]
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    return F.array(*(F.xxhash64(F.lit(i), fp.bitwiseAND(F.lit(signed(m)))) for i, m in enumerate(masks)))


def near_duplicates(docs: DataFrame, width: int = 3, most_bits: int = 3, text: str = "text") -> DataFrame:
    """(doc_id, fp, component_id) per row of ``docs``.

    Rows are linked if their fingerprints differ in at most ``most_bits`` bits;
    component_id is the smallest doc_id reachable.  Documents with equal fingerprints
    stand behind one node of the link graph, however many they are.
    Null text: fingerprint 0, linked like any other.  Null doc_id: never a
    component_id, unless its component has no other id (then null).  Empty table: no rows.
    """
    with Scratch() as scratch:
        prints = scratch.keep(stored(fingerprints(docs, width, text), "fingerprints"))
        nodes = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("low")), "nodes")
        pairs = stored(near_pairs(nodes.select("fp"), most_bits).distinct(), "pairs")
        roots = components(pairs).select(F.col("node").alias("fp"), "root")
        grouped = scratch.keep(stored(nodes.join(roots, "fp", "left").select("fp", "low", F.coalesce("root", "fp").alias("root")), "rooted"))
    lows = grouped.groupBy("root").agg(F.min("low").alias("component_id"))
    named = grouped.join(lows, "root").select("fp", "component_id")
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")


def one_of_each(docs: DataFrame, width: int = 3, most_bits: int = 3) -> DataFrame:
    """The rows of ``docs`` that stay: one of each near-duplicate group (see ``components.one_of_each``)."""
    return components_.one_of_each(docs, lambda rows: near_duplicates(rows, width, most_bits).select("doc_id", "component_id"))
