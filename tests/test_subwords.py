from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from passagework.functions import subwords as S
from passagework.operators import indexing
from passagework.operators.embedding import HashingEmbedder

PIECES = ["[UNK]", "[CLS]", "[SEP]", "the", "un", "##aff", "##able", "##a", "##b", "a", "b", "ab", "##ab", "##abc", "c", "##c", "e", "##e", "e##", "##", "é", "漢", ".", "$", "##1", "1", "cafe", "ü"]


def library(pieces):
    from tokenizers import Tokenizer, models, normalizers, pre_tokenizers

    t = Tokenizer(models.WordPiece({p: i for i, p in enumerate(pieces)}, unk_token="[UNK]", max_input_chars_per_word=100))
    t.normalizer = normalizers.BertNormalizer(lowercase=True, strip_accents=True)
    t.pre_tokenizer = pre_tokenizers.BertPreTokenizer()
    return lambda text: len(t.encode(text, add_special_tokens=False).ids) + 2


def test_random_texts_count_as_by_the_library():
    rng = random.Random(4)
    own, want = S.Subwords(PIECES), library(PIECES)
    alphabet = list("aabbcce1. $-\n\té漢AB́ü_​ \x00") + ["unaffable ", "the ", "Café ", "a" * 101 + " ", "a" * 100 + " ", "##"]
    for _ in range(3000):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40)))
        assert own.count(text) == want(text), repr(text)


def test_documents_count_as_by_the_library(spark):
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    # Pieces of two and three letters that the texts have, by rule; nothing is learned.
    letters = sorted({c for t in texts for c in t.lower()})
    pieces = ["[UNK]", *letters, *(f"##{c}" for c in letters)] + [f"{m}{a}{b}" for a in "aeioudnrst" for b in "aeioudnrst" for m in ("", "##")]
    own, want = S.Subwords(pieces), library(pieces)
    assert [own.count(t) for t in texts] == [want(t) for t in texts]


def test_end_marks_against_the_longest_piece_tried_first():
    pieces = ["a", "b", "ab", "a</w>", "ab</w>", "ba</w>", "abb", "c</w>"]
    rules = S.Rules(inner="", end="</w>", specials=0)
    own = S.Subwords(pieces, rules)

    def plainly(word):
        n, at = 0, 0
        while at < len(word):
            for stop in range(len(word), at, -1):
                if word[at:stop] + ("</w>" if stop == len(word) else "") in pieces:
                    break
            else:
                return 1
            n, at = n + 1, stop
        return n

    rng = random.Random(1)
    for _ in range(500):
        word = "".join(rng.choice("abc") for _ in range(rng.randint(1, 9)))
        assert own.pieces_of(word) == plainly(word), word


def test_vocabulary_files(spark, tmp_path):
    import json

    (tmp_path / "v.txt").write_text("\n".join(PIECES))
    (tmp_path / "v.json").write_text(json.dumps({"model": {"vocab": {p: i for i, p in enumerate(PIECES)}}}))
    assert S.read_vocabulary(spark, str(tmp_path / "v.txt")) == PIECES == S.read_vocabulary(spark, str(tmp_path / "v.json"))


def test_too_many_pieces_are_an_error(spark, tmp_path, monkeypatch):
    (tmp_path / "v.txt").write_text("\n".join(PIECES))
    monkeypatch.setattr(S, "MOST_PIECES", 3)
    with pytest.raises(ValueError, match="over 3 pieces"):
        S.read_vocabulary(spark, str(tmp_path / "v.txt"))


def test_windows_are_checked_by_real_counts(spark):
    tokens = S.counter(spark, PIECES)
    rows = spark.createDataFrame([("x", 0, "ab abc"), ("y", 1, "unaffable " * 3), ("z", 2, None)], "chunk_id string, chunk_seq int, text string")
    assert [r.n for r in rows.select(tokens(F.col("text")).alias("n")).collect()] == [2 + 1 + 2, 2 + 9, 2]
    assert tuple(indexing.window_check(rows, tokens(F.col("text")), 10).first()) == (11, "y")
    assert [r.n for r in rows.select(HashingEmbedder(tokens=tokens).count_tokens(F.col("text")).alias("n")).collect()] == [5, 11, 2]
