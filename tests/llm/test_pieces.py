from __future__ import annotations

import random

import brute
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from passagework.llm import pieces, queries

PATH = queries.tokenizer_path()


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def ours():
    with open(PATH, "rb") as f:
        return pieces.Pieces(f.read())


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_any_text_as_the_library(text):
    with open(PATH, "rb") as f:
        model = pieces.loaded(f.read())
    assert model.encode(text) == model.library.encode(text)


def test_joined_pieces_and_long_words_as_the_library(ours, library):
    random.seed(4)
    names = list(ours.ids)
    for _ in range(3000):
        text = "".join(random.choice(names) for _ in range(random.randint(1, 7)))
        assert ours.encode(text) == library.encode(text)
    for text in ("".join(random.choice("aeinrst") for _ in range(30000)), "=" * 5000, " " * 777, "a" * 4097, "☃𝔘" * 300):
        assert ours.encode(text) == library.encode(text)


def test_documents_as_the_library(spark, library):
    rows = brute.awkward_documents() + [(r.doc_id, r.text, None, None, None) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    got = pieces.encode_documents(spark.createDataFrame(rows, brute.DOCUMENTS), PATH).collect()
    want = []
    for r in rows:
        ids = library.encode(r[1] or "")
        want.append((r[0], len(ids), tuple(ids), brute.sha(",".join(map(str, ids))), brute.sha(library.decode(ids))))
    assert brute.in_order((r[0], r[1], tuple(r[2]), r[3], r[4]) for r in got) == brute.in_order(want)


def test_empty_table(spark):
    assert pieces.encode_documents(spark.createDataFrame([], brute.DOCUMENTS), PATH).count() == 0
