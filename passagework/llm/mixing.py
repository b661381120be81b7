"""Mixing sources to target weights.

Each source's words, in a fixed order of its documents, are packed into blocks of a fixed
length.  The mix is a sequence of output shards of a fixed number of slots; each shard draws how
many of its slots go to which source (multinomial, seeded by the shard), and a last
shard settles the totals.  The k-th slot of a source takes block p(k mod n) of its n blocks,
where p is a pseudorandom permutation that depends on source and epoch (k div n).  So a
source that is taken e times over gives each block floor(e) or ceil(e) times.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from passagework.llm import arrowtext as at
from passagework.llm.shared import Scratch, parts_for, pick, stored

WORD = "[^\\x20\\x09-\\x0D]+"


def word_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` (doc_id, source and text) as (doc_id, source, size, salt): words per row (null text 0) and a hash of the text."""
    return pick(docs, "doc_id", "source", text).select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint").alias("size"),
        F.xxhash64(F.col(text).cast("string")).alias("salt"),
    )


def targets(sizes: dict[str | None, int], weights: tuple[float, ...] = (5, 2, 1), most: float = 3.0) -> dict[str | None, float]:
    """Words each source should give.

    Sources by code point, null last, have ``weights`` in turn and share the sum of all
    sizes; a target stops at ``most`` times its source's size and the excess is shared
    again by weight among the others, until none is above.
    """
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode("utf-32-be")))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    out: dict[str | None, float] = {}
    free, rest = list(order), float(sum(sizes.values()))
    while free:
        share = rest / sum(weight[s] for s in free)
        above = [s for s in free if share * weight[s] > most * sizes[s]]
        if not above:
            return out | {s: share * weight[s] for s in free}
        for s in above:
            out[s] = most * sizes[s]
            rest -= out[s]
        free = [s for s in free if s not in above]
    return out


def permuted(index: np.ndarray, n: np.ndarray, key: np.ndarray, back: bool = False) -> np.ndarray:
    """A pseudorandom permutation of 0 .. n-1 for each key, or its inverse: four Feistel rounds on the
    next even number of bits, repeated on the values that fall outside (cycle walking)."""
    half = np.maximum(1, (np.ceil(np.log2(np.maximum(n, 2).astype(float))).astype(np.int64) + 1) // 2).astype(np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)
    key = key.astype(np.uint64)

    def once(x: np.ndarray, at_: np.ndarray) -> np.ndarray:
        h, m, k = half[at_], mask[at_], key[at_]
        left, right = x >> h, x & m
        for r in reversed(range(4)) if back else range(4):
            if back:
                left, right = right ^ (at.mix(left + at.mix(k + np.uint64(r))) & m), left
            else:
                left, right = right, left ^ (at.mix(right + at.mix(k + np.uint64(r))) & m)
        return (left << h) | right

    out = once(index.astype(np.uint64), np.arange(len(index)))
    limit = n.astype(np.uint64)
    while len(far := np.flatnonzero(out >= limit)):
        out[far] = once(out[far], far)
    return out.astype(np.int64)


def epoch_keys(seed: int, src: np.ndarray, epoch: np.ndarray) -> np.ndarray:
    return at.mix(at.mix(np.full(len(src), seed, np.uint64) + src.astype(np.uint64)) + epoch.astype(np.uint64))


def slots_for(src: int, size: int, target: float, block: int, most: float, seed: int) -> int:
    """Slots of a source whose words come nearest to ``target``, never more than ``most`` whole passes.

    A last pass of part of the blocks may hold the source's last block, which can be short."""
    if not size:
        return 0
    n = -(-size // block)
    whole = int(target // size)
    left = target - whole * size
    short = n * block - size
    one = np.array([n])
    last = int(permuted(one - 1, one, epoch_keys(seed, np.array([src]), np.array([whole])), back=True)[0])
    near = {min(n, max(0, int(left // block) + d)) for d in range(-1, 3)}
    best = min(sorted(near), key=lambda r: abs(r * block - (short if last < r else 0) - left))
    return min(int(most) * n, whole * n + best)


_CUTS = "array<struct<first:bigint,stop:bigint,times:bigint>>"


class Plan:
    """The mix of a corpus: sources, their blocks and slots.  One row per source; sources are few."""

    def __init__(self, sizes: dict[str | None, int], block: int, shard: int, seed: int, most: float, weights: tuple[float, ...]):
        self.block, self.shard, self.seed, self.sizes = block, shard, seed, sizes
        self.target = targets(sizes, weights, most)
        self.names = sorted(sizes, key=lambda s: (s is None, (s or "").encode("utf-32-be")))
        self.blocks = [-(-sizes[s] // block) for s in self.names]
        self.slots = [slots_for(i, sizes[s], self.target[s], block, most, seed) for i, s in enumerate(self.names)]
        total = sum(self.slots)
        self.p = np.array(self.slots, float) / max(1, total)
        self.shards = total // shard

    def draw(self, shard: int) -> np.ndarray:
        """Slots of each source in a shard."""
        return np.random.default_rng([self.seed, shard]).multinomial(self.shard, self.p)


#: Shards whose draws one row of the tree of prefix sums holds.
_FAN = 4096


def slots(spark, plan: Plan) -> DataFrame:
    """(shard, src, slot, epoch, block): what each slot of the mix takes.

    Draws depend on the shard alone, so they are made where they are used.  Shards are
    summed by groups first; only group sums meet in one window, which gives each group the
    numbers its slots start from.  Draws beyond a source's total are void; what they
    leave short is given by the last shard, numbered ``plan.shards``.
    """
    groups = -(-plan.shards // _FAN)
    blocks, wanted = np.array(plan.blocks, np.int64), np.array(plan.slots, np.int64)

    def sums(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for g in f["id"].tolist():
                total = sum((plan.draw(s) for s in range(g * _FAN, min(plan.shards, (g + 1) * _FAN))), np.zeros(len(plan.p), np.int64))
                yield pd.DataFrame({"g": g, "src": range(len(total)), "n": total})

    def spelled(shard: int, first: np.ndarray, n: np.ndarray) -> pd.DataFrame:
        src = np.repeat(np.arange(len(n)), n)
        slot = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)
        size = blocks[src]
        epoch = slot // size
        return pd.DataFrame({"shard": shard, "src": src, "slot": slot, "epoch": epoch, "block": permuted(slot % size, size, epoch_keys(plan.seed, src, epoch))})

    def by_group(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for g, firsts in zip(f["g"].tolist(), f["at"]):
                at_ = np.array([x["first"] for x in firsts], np.int64)
                for s in range(g * _FAN, min(plan.shards, (g + 1) * _FAN)):
                    n = plan.draw(s)
                    yield spelled(s, at_, np.minimum(n, np.maximum(0, wanted - at_)))
                    at_ = at_ + n

    def settled(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # One row per stretch of a source's remaining slots.
        for f in frames:
            for src, first, n in zip(f["src"], f["first"], f["n"]):
                at_, counts = np.zeros(len(wanted), np.int64), np.zeros(len(wanted), np.int64)
                at_[src], counts[src] = first, n
                yield spelled(plan.shards, at_, counts)

    schema = "shard bigint, src int, slot bigint, epoch bigint, block bigint"
    grouped = spark.range(groups, numPartitions=max(1, min(groups, 4096))).mapInPandas(sums, "g bigint, src int, n bigint")
    before = grouped.select("g", "src", (F.sum("n").over(Window.partitionBy("src").orderBy("g")) - F.col("n")).alias("first"))
    starts = before.groupBy("g").agg(F.array_sort(F.collect_list(F.struct("src", "first"))).alias("at"))
    drawn = grouped.groupBy("src").agg(F.sum("n").alias("drawn"))
    totals = spark.createDataFrame([(i, n) for i, n in enumerate(plan.slots)], "src int, wanted bigint")
    rest = totals.join(drawn, "src", "left").select("src", F.least("wanted", F.coalesce("drawn", F.lit(0))).alias("first"), "wanted").where("first < wanted")
    step = plan.shard
    stretches = rest.select("src", "first", "wanted", F.explode(F.expr(f"sequence(0L, (wanted - first - 1) div {step})")).alias("part"))
    stretches = stretches.select("src", (F.col("first") + F.col("part") * step).alias("first"), F.least(F.lit(step), F.col("wanted") - F.col("first") - F.col("part") * step).alias("n"))
    return starts.mapInPandas(by_group, schema).unionByName(stretches.mapInPandas(settled, schema))


#: Rows of a bucket in which positions are summed up, and buckets that are summed up at once.
BUCKET_ROWS = 250
_BUCKETS_AT_ONCE = 1024


def _placed(sized: DataFrame, plan: Plan) -> DataFrame:
    """(doc_id, source, size, salt, src, start): where each document's words begin in its source.

    Documents stand in order of a hash bucket of id and text, then doc_id, size and text's hash.  Sums of
    buckets, and of many buckets in a row, give each its start, so no window holds more than
    some hundred documents or a thousand buckets, whatever the size of a source.
    """
    spark = sized.sparkSession
    order = spark.createDataFrame([(s, i) for i, s in enumerate(plan.names)], "source string, src int")
    buckets = max(1, sized.count() // BUCKET_ROWS)
    keyed = sized.join(order, sized["source"].eqNullSafe(order["source"])).select("doc_id", sized["source"], "size", "salt", "src", F.pmod(F.xxhash64("doc_id", "salt"), F.lit(buckets)).alias("bucket"))
    before = lambda x, within, by: F.sum(x).over(Window.partitionBy(*within).orderBy(by)) - F.col(x)
    sums = stored(keyed.groupBy("src", "bucket").agg(F.sum("size").alias("held")).withColumn("many", F.expr(f"bucket div {_BUCKETS_AT_ONCE}")), "buckets")
    tops = sums.groupBy("src", "many").agg(F.sum("held").alias("all")).select("src", "many", before("all", ["src"], "many").alias("top"))
    base = sums.select("src", "bucket", "many", before("held", ["src", "many"], "bucket").alias("inner")).join(tops, ["src", "many"]).select("src", "bucket", (F.col("inner") + F.col("top")).alias("base"))
    inner = Window.partitionBy("src", "bucket").orderBy(F.col("doc_id").asc_nulls_first(), "size", "salt").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    within = keyed.withColumn("start", F.sum("size").over(inner) - F.col("size"))
    return within.join(base, ["src", "bucket"]).select("doc_id", "source", "size", "salt", "src", (F.col("start") + F.col("base")).alias("start"))


def plan_for(sized: DataFrame, block: int = 32, shard: int = 4096, seed: int = 17, most: float = 3.0, weights: tuple[float, ...] = (5, 2, 1)) -> Plan:
    """The plan for (doc_id, source, size) rows; one sum per source comes to the driver."""
    sizes = {r["source"]: int(r["size"]) for r in sized.groupBy("source").agg(F.sum("size").alias("size")).collect()}
    return Plan(sizes, block, shard, seed, most, weights)


def mix_documents(docs: DataFrame, block: int = 32, shard: int = 4096, seed: int = 17) -> DataFrame:
    """(doc_id, source, size, salt, start, source_size, target, taken, cuts) per row of ``docs`` (doc_id, text, source).

    ``taken`` counts the words of the document that stand in the mix, repeats included;
    ``cuts`` lists them as (times, first, stop) ranges of its words, in order, without
    those not taken.  Targets: see ``targets``.  No document is taken over three times its
    size.  The result depends on ids, sources and texts alone, so reruns agree; ``salt`` is a hash of
    the text.  Null text: size 0.  Null source: a source of its own, last.  Repeated rows of a
    doc_id, and rows without one, are documents of their own, dealt by their texts.
    Empty table: no rows.
    """
    spark = docs.sparkSession
    with Scratch() as scratch:
        sized = stored(word_counts(docs), "sizes")
        plan = plan_for(sized, block, shard, seed)
        placed = scratch.keep(stored(_placed(sized, plan), "placed")) if plan.names else scratch.keep(sized)
    if not plan.names:
        return placed.select("doc_id", "source", "size", "salt", F.lit(0).cast("bigint").alias("start"), F.lit(0).cast("bigint").alias("source_size"), F.lit(0.0).alias("target"), F.lit(0).cast("bigint").alias("taken"), F.lit(None).cast(_CUTS).alias("cuts"))
    used = slots(spark, plan).groupBy("src", "block").agg(F.count(F.lit(1)).alias("times"))
    spans = F.expr(f"sequence(start div {block}, (start + size - 1) div {block})")
    spread = placed.where("size > 0").select("src", "doc_id", "start", "size", F.explode(spans).alias("block"))
    first = F.greatest(F.col("block") * block, F.col("start")) - F.col("start")
    stop = F.least((F.col("block") + 1) * block, F.col("start") + F.col("size")) - F.col("start")
    met = spread.join(used, ["src", "block"]).select("src", "start", "size", first.alias("first"), stop.alias("stop"), "times")
    # start and size tell the non-empty documents of a source apart.
    given = met.groupBy("src", "start", "size").agg(F.sum(F.expr("times * (stop - first)")).alias("taken"), F.array_sort(F.collect_list(F.struct("first", "stop", "times"))).alias("cuts"))
    facts = spark.createDataFrame([(i, plan.sizes[s], float(plan.target[s])) for i, s in enumerate(plan.names)], "src int, source_size bigint, target double")
    return (
        placed.join(given, ["src", "start", "size"], "left")
        .join(facts, "src")
        .select("doc_id", "source", "size", "salt", "start", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("bigint").alias("taken"), "cuts")
    )


#: Input bytes behind one group of texts.
GROUP_BYTES = 4 << 20


def mixed_documents(docs: DataFrame, block: int = 32, shard: int = 4096, seed: int = 17) -> DataFrame:
    """``docs`` as the mix takes them; all columns are kept.

    A document taken up to k times gives k rows; the j-th holds its words in blocks taken at
    least j times, in order (its unchanged text where these are all words, else joined
    by one space), and n_chars, if there, follows.  Documents of which nothing is taken go.
    """
    names = docs.columns
    held = {n: f"c{i}" for i, n in enumerate(names)}
    plain = docs.toDF(*held.values())
    doc_id, source, text = held["doc_id"], held["source"], held["text"]
    groups = parts_for(plain.select(text), GROUP_BYTES, text)
    mix = mix_documents(docs, block, shard, seed).where("taken > 0").select("doc_id", "source", "size", "salt", "start", "cuts", F.expr(f"pmod(xxhash64(doc_id, salt), {groups}L)").alias("grp"))
    types = dict(plain.dtypes)

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        wanted: dict[tuple, list] = {}
        order = right.sort_by([("start", "descending")])
        for d, s, salt, cuts in zip(*(order[c].to_pylist() for c in ("doc_id", "source", "salt", "cuts"))):
            wanted.setdefault((d, s, salt), []).append(cuts)
        take, texts = [], []
        for i, (d, s, salt, t) in enumerate(zip(*(left[c].to_pylist() for c in (doc_id, source, "salt", text)))):
            words = (t or "").encode().split()
            queue = wanted.get((d, s, salt))
            if not words or not queue:
                continue
            cuts = queue.pop()
            for j in range(1, max(c["times"] for c in cuts) + 1):
                kept = [(c["first"], c["stop"]) for c in cuts if c["times"] >= j]
                whole = sum(b - a for a, b in kept) == len(words)
                take.append(i)
                texts.append(t if whole else b" ".join(w for a, b in kept for w in words[a:b]).decode())
        wanted.clear()
        at.release()
        out = left.drop_columns(["grp", "salt"]).take(pa.array(take, pa.int64()))
        return out.set_column(out.schema.get_field_index(text), text, pa.array(texts, pa.string()))

    sides = plain.withColumn(doc_id, F.col(doc_id).cast("bigint")).withColumn("salt", F.xxhash64(F.col(text).cast("string")))
    sides = sides.withColumn("grp", F.expr(f"pmod(xxhash64({doc_id}, salt), {groups}L)"))
    types[doc_id] = "bigint"
    out = sides.groupBy("grp").cogroup(mix.groupBy("grp")).applyInArrow(run, ", ".join(f"{c} {types[c]}" for c in held.values()))
    if "n_chars" in held:
        out = out.withColumn(held["n_chars"], F.length(text).cast(docs.schema["n_chars"].dataType))
    return out.toDF(*names)
