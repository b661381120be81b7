"""Words of documents that stand in benchmark items, by winnowed fingerprints.

Of every ``width - gram + 1`` consecutive k-grams (``gram`` words each) the least hash is kept.  A span of ``width``
words holds just that many k-grams, so documents and items that share such a span keep the same hash of it: joining
the kept hashes misses no span.  A hash met is extended to the windows of ``width`` words that keep
it, which are compared word by word.  Items of fewer words are one
window; for each length among them all k-grams of that length are kept.

Built-in functions and joins only.  Long texts are cut into blocks that overlap by ``width - 1`` words.
"""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passagework.llm.shared import Scratch, pick, stored

#: Words are runs of characters other than these (ASCII but letters and digits).
GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Words of a text whose k-grams are one row's work.
BLOCK_WORDS = 4096


def words_of(text: Column) -> Column:
    """The words of a text, A-Z folded; null has none."""
    folded = F.translate(F.coalesce(text, F.lit("")), ascii_uppercase, ascii_lowercase)
    return F.array_remove(F.split(folded, GAPS), "")


def _folded(values: str, n: int, of: str) -> str:
    """``of`` all ``n`` neighbours, for every place of the array that has so many."""
    every = ", ".join(["x", *(f"get({values}, i + {j})" for j in range(1, n))])
    return f"slice(transform({values}, (x, i) -> {of}({every})), 1, greatest(size({values}) - {n - 1}, 0))" if n > 1 or of != "least" else values


def _marks(texts: DataFrame, carry: str, width: int, gram: int, short: list[int]) -> DataFrame:
    """(carry, n, pos, key) of texts (carry, words).

    With n = ``width`` they are the winnowed ones: the least hash of the k-grams in the windows from word pos on, where it
    changes, and again after as many windows as hold one k-gram.  Each window's least hash is thus
    recorded at itself or at most ``width - gram`` windows before it.  With n of ``short`` they are hashes of all
    runs of n words."""
    gap = width - gram + 1
    hashed = texts.where("size(words) > 0").select(carry, F.expr("transform(words, w -> xxhash64(w))").alias("h"))
    step = F.expr(f"transform(sequence(0L, (size(h) - 1) div {BLOCK_WORDS}), b -> struct(b * {BLOCK_WORDS} as at, slice(h, cast(b * {BLOCK_WORDS} + 1 as int), {BLOCK_WORDS + width - 1}) as h))")
    rows = hashed.select(carry, F.explode(step).alias("b")).select(carry, "b.at", "b.h")
    rows = rows.withColumn("g", F.expr(_folded("h", gram, "xxhash64"))).withColumn("low", F.expr(_folded("g", gap, "least")))
    kept = f"struct({width} as n, transform(low, (x, i) -> if(i % {gap} = 0 or x <> get(low, i - 1), x, null)) as keys)"
    # Runs that start in the next block are its own.
    whole = [f"struct({n} as n, slice({_folded('h', n, 'xxhash64')}, 1, {BLOCK_WORDS}) as keys)" for n in short]
    every = rows.select(carry, "at", F.explode(F.expr(f"array({', '.join([kept, *whole])})")).alias("m")).select(carry, "at", "m.n", F.posexplode("m.keys").alias("i", "key"))
    return every.where("key is not null").select(carry, "n", (F.col("at") + F.col("i")).alias("pos"), "key")


def _windows(spots: str) -> str:
    """All windows at ``spots``, an array of (n, first)."""
    return f"transform({spots}, s -> struct(s.n as n, s.first as first, concat_ws(' ', slice(words, cast(s.first + 1 as int), s.n)) as run))"


def find_contamination(docs: DataFrame, items: DataFrame, width: int = 10, gram: int = 5) -> DataFrame:
    """(doc_id, n_words, n_hit, spans, items) per row of ``docs`` (doc_id, text) against ``items`` (item_id, text).

    A window is ``width`` consecutive words of an item, or all words of a shorter one.  Document words inside
    an occurrence of a window are hit: ``spans`` are the maximal runs of hit words (first, one past the last),
    ``items`` the distinct ids, as sorted strings, of items with a window that occurs.  Null or empty
    texts have no words: nothing is hit in them and such items have no windows.  Rows of one doc_id, and rows without
    one, are judged each by its own text.  Items of one id count once; windows of items without an id hit
    words and are not listed.  Empty ``items``: nothing is hit; empty ``docs``: no rows.
    """
    if not 1 <= gram <= width:
        raise ValueError("a k-gram has at least one word and at most those of a window")
    docs, items = (pick(df, i, "text").select(F.col(i), F.col("text").cast("string").alias("text")) for df, i in ((docs, "doc_id"), (items, "item_id")))
    gap = width - gram
    with Scratch() as scratch:
        parts = items.select(F.col("item_id").cast("string").alias("item_id"), words_of(F.col("text")).alias("words")).where("size(words) > 0")
        starts = f"transform(sequence(0, greatest(size(words) - {width}, 0)), i -> struct(least(size(words), {width}) as n, i as first))"
        owned = parts.select("item_id", F.explode(F.expr(_windows(starts))).alias("x")).select("item_id", "x.run", "x.n").distinct()
        owned = stored(owned, "item_windows")
        # The number of a window is settled by the table's being written.
        windows = stored(owned.select("run", "n").distinct().select("run", "n", F.monotonically_increasing_id().alias("window")), "windows")
        short = sorted(r.n for r in owned.where(f"n < {width}").select("n").distinct().collect())  # fewer than ``width`` numbers
        keys = stored(_marks(owned.select(F.lit(0).alias("of"), F.split("run", " ").alias("words")).distinct(), "of", width, gram, short).select("key").distinct(), "keys")

        texts = docs.select("text", F.xxhash64("text").alias("tid")).where("text is not null")
        marks = _marks(texts.select("tid", words_of(F.col("text")).alias("words")), "tid", width, gram, short)
        # Texts that share a tid by chance get each other's places to look at, which changes nothing.
        spots = stored(marks.join(keys, "key", "left_semi").groupBy("tid").agg(F.collect_set(F.struct("n", "pos")).alias("spots")), "spots")
        # A window past the end has fewer words than its n and meets none.
        near = f"array_distinct(flatten(transform(spots, s -> if(s.n < {width}, array(struct(s.n, s.pos as first)), transform(sequence(s.pos, s.pos + {gap}), p -> struct(s.n, p as first))))))"
        met = texts.join(spots, "tid").select(F.sha2("text", 256).alias("sha"), words_of(F.col("text")).alias("words"), "spots")
        looked = met.select("sha", F.explode(F.expr(_windows(near))).alias("x")).select("sha", "x.n", "x.first", "x.run")
        hits = stored(looked.join(windows, ["run", "n"]).select("sha", "first", (F.col("first") + F.col("n")).alias("stop"), "window").distinct(), "hits")
        found = scratch.keep(stored(_spans(hits).join(_items(hits, owned.join(windows, ["run", "n"]).select("window", "item_id")), "sha"), "found"))
    n_words = F.size(words_of(F.col("text"))).cast("bigint").alias("n_words")
    whole = docs.select("doc_id", n_words, F.sha2("text", 256).alias("sha")).join(found, "sha", "left")
    return whole.select(
        "doc_id",
        "n_words",
        F.coalesce("n_hit", F.lit(0).cast("bigint")).alias("n_hit"),
        F.coalesce("spans", F.expr("cast(array() as array<struct<first: bigint, stop: bigint>>)")).alias("spans"),
        F.coalesce("items", F.expr("cast(array() as array<string>)")).alias("items"),
    )


def _spans(hits: DataFrame) -> DataFrame:
    """(sha, n_hit, spans) of each text: its hit windows, overlapping and adjacent ones merged."""
    by_place = "over (partition by sha order by first, stop"
    one = hits.select("sha", "first", "stop").distinct()
    opened = one.withColumn("opens", F.expr(f"coalesce(first > max(stop) {by_place} rows between unbounded preceding and 1 preceding), true)"))
    islands = opened.withColumn("island", F.expr(f"sum(cast(opens as int)) {by_place} rows unbounded preceding)"))
    merged = islands.groupBy("sha", "island").agg(F.min("first").alias("first"), F.max("stop").alias("stop"))
    return merged.groupBy("sha").agg(F.sum(F.expr("stop - first")).alias("n_hit"), F.array_sort(F.collect_list(F.struct("first", "stop"))).alias("spans"))


def _items(hits: DataFrame, owned: DataFrame) -> DataFrame:
    """(sha, items) of each text.  Texts that hold the same windows are one class, which meets the items once."""
    held = hits.groupBy("sha").agg(F.array_sort(F.collect_set("window")).alias("held"))
    held = held.withColumn("kind", F.sha2(F.array_join(F.transform("held", lambda w: w.cast("string")), ","), 256))
    kinds = held.select("kind", F.explode("held").alias("window")).distinct()
    items = kinds.join(owned, "window").groupBy("kind").agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    return held.select("sha", "kind").join(items, "kind").select("sha", "items")
