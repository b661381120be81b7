from __future__ import annotations

import random
import re

import brute
import pytest
from pyspark.sql import functions as F

from passagework.llm import contamination

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ITEMS = "item_id bigint, text string"


def split(text):
    return WORDS.findall((text or "").translate(FOLD))


def plainly(docs, items, width=10):
    """Every window of every item against every place of every document."""
    windows: dict[tuple, set] = {}
    for item, text in items:
        words = split(text)
        if words:
            for i in range(max(1, len(words) - width + 1)):
                windows.setdefault(tuple(words[i : i + width]), set()).add(item)
    out = []
    for doc, text, *_ in docs:
        words, hit, met = split(text), set(), set()
        for n in {len(w) for w in windows}:
            for i in range(len(words) - n + 1):
                owners = windows.get(tuple(words[i : i + n]))
                if owners is not None:
                    hit.update(range(i, i + n))
                    met |= owners
        spans = []
        for p in sorted(hit):
            if spans and spans[-1][1] == p:
                spans[-1][1] = p + 1
            else:
                spans.append([p, p + 1])
        out.append((doc, len(words), len(hit), spans, sorted(str(i) for i in met if i is not None)))
    return brute.in_order(out)


def found(spark, docs, items, **options):
    docs = spark.createDataFrame([d[:2] for d in docs], "doc_id bigint, text string").repartition(3)
    rows = contamination.find_contamination(docs, spark.createDataFrame(items, ITEMS), **options).collect()
    return brute.in_order((r.doc_id, r.n_words, r.n_hit, [[x.first, x.stop] for x in r.spans], list(r["items"])) for r in rows)


ITEM_ROWS = [
    (1, " ".join(f"shared{i}" for i in range(20, 45))),
    (2, "Loop, loop; LOOP loop loop loop loop loop loop loop loop loop"),
    (3, "the same line the same line the same line"),
    (3, "one two"),
    (4, None),
    (5, " .,; "),
    (None, "ein wort ü"),
    (10, " ".join(f"shared{i}" for i in range(30, 45))),
    (11, "symbols"),
]


def test_awkward_rows_match_brute_force(spark):
    docs = [r[:2] for r in brute.awkward_documents()]
    got = found(spark, docs, ITEM_ROWS)
    assert got == plainly(docs, ITEM_ROWS)
    assert {x for r in got for x in r[4]} == {"1", "10", "11", "2", "3"}


@pytest.mark.parametrize("letters,width,gram", [("ab", 10, 5), ("abc", 4, 2), ("ab", 6, 6), ("abcdefgh", 3, 1)])
def test_random_texts_match_brute_force(spark, letters, width, gram):
    """Few different words: ties of hashes, overlapping spans and short windows everywhere."""
    rng = random.Random(f"{letters}{width}")
    text = lambda n: " ".join(rng.choice(letters) for _ in range(n))
    items = [(i, text(rng.randint(0, 2 * width))) for i in range(12)]
    docs = [(i, text(rng.randint(0, 60))) for i in range(60)] + [(99, text(40) + " " + items[3][1])]
    assert found(spark, docs, items, width=width, gram=gram) == plainly(docs, items, width)


@pytest.mark.parametrize("block", [1, 7, 4096])
def test_blocks_of_long_texts_miss_nothing(spark, monkeypatch, block):
    monkeypatch.setattr(contamination, "BLOCK_WORDS", block)
    rng = random.Random(7)
    docs = [(i, " ".join(f"w{rng.randint(0, 400)}" for _ in range(300))) for i in range(6)]
    items = [(i, " ".join(docs[i % 6][1].split()[s : s + n])) for i, (s, n) in enumerate([(0, 10), (5, 40), (288, 12), (100, 9), (50, 3), (290, 10)])]
    got = found(spark, docs, items)
    assert got == plainly(docs, items) and sum(r[2] > 0 for r in got) == 6


def test_documents_match_brute_force(spark):
    folder = "/root/testdata/sf0.001"
    docs, items = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/benchmark.parquet")
    want = plainly([(r.doc_id, r.text) for r in docs.collect()], [tuple(r) for r in items.select("item_id", "text").collect()])
    got = [(r.doc_id, r.n_words, r.n_hit, [[x.first, x.stop] for x in r.spans], list(r["items"])) for r in contamination.find_contamination(docs, items).collect()]
    assert brute.in_order(got) == want and sum(r[2] > 0 for r in got) > 0


def test_empty_tables_and_clashing_columns(spark):
    none = spark.createDataFrame([], ITEMS)
    assert found(spark, [(1, "a b"), (2, None)], []) == [(1, 2, 0, [], []), (2, 0, 0, [], [])]
    assert contamination.find_contamination(none.toDF("doc_id", "text"), spark.createDataFrame(ITEM_ROWS, ITEMS)).count() == 0
    docs = spark.createDataFrame([(1, "x one two", "a", 3)], "doc_id int, text string, words string, window int")
    items = spark.createDataFrame([(1, "one TWO", "b")], "item_id int, text string, run string")
    assert [(r.n_hit, list(r["items"])) for r in contamination.find_contamination(docs, items).collect()] == [(2, ["1"])]


def test_no_python_runs_in_the_plan(spark):
    docs, items = spark.createDataFrame([(1, "a b")], "doc_id int, text string"), spark.createDataFrame([(1, "a b")], "item_id int, text string")
    marks = contamination._marks(docs.select("doc_id", contamination.words_of(F.col("text")).alias("words")), "doc_id", 10, 5, [1, 2])
    for df in (marks, contamination.find_contamination(docs, items)):
        plan = df._jdf.queryExecution().toString()
        assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
