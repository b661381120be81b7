"""All operators on the same awkward rows: clashing column names, nulls in each column, repeated rows, empty tables."""

from __future__ import annotations

import brute
import pytest

from passagework.llm import alike, chat, langid, licences, media, mixing, pieces, quality, queries, simhash, substrings, warc

#: Columns that differ from those an operator reads in case alone, or bear names that it makes itself.
CLASHES = "DOC_ID string, Text string, LANG int, Source double, N_Chars string, fp string, kept int, n_words string, node int, grp int, size string, text_ string"
CLASHING = ("x", "other words", 3, 1.5, "y", "z", 1, "w", 2, 3, "s", "t")

ON_DOCUMENTS = {
    "simhash": lambda docs: simhash.near_duplicates(docs),
    "simhash one of each": lambda docs: simhash.one_of_each(docs),
    "near copies": lambda docs: alike.near_copies(docs),
    "near copies one of each": lambda docs: alike.one_of_each(docs),
    "substrings": lambda docs: substrings.remove_repeats(docs),
    "substrings cut": lambda docs: substrings.without_repeats(docs),
    "licences": lambda docs: licences.scan_licences(docs),
    "media": lambda docs: media.read_media(media.store_texts(docs)),
    "pieces": lambda docs: pieces.encode_documents(docs, queries.tokenizer_path()),
    "language": lambda docs: langid.identify(docs, langid.Training(rounds=2)),
    "mixing": lambda docs: mixing.mix_documents(docs),
    "mixing texts": lambda docs: mixing.mixed_documents(docs),
    "quality": lambda docs: quality.judged(docs),
    "quality kept": lambda docs: quality.kept_documents(docs),
}


def result(df, names):
    return sorted(repr([r[df.columns.index(n)] for n in names]) for r in df.collect())


@pytest.mark.parametrize("name", ON_DOCUMENTS)
def test_clashing_columns_change_nothing(spark, name):
    rows = [r for r in brute.awkward_documents() if r[0] != 14] + [(20, None, None, None, None), (21, "some words", None, "a", 10), (None, "one two", "en", None, 7)]
    plain = ON_DOCUMENTS[name](spark.createDataFrame(rows, brute.DOCUMENTS))
    clashing = ON_DOCUMENTS[name](spark.createDataFrame([(*r, *CLASHING) for r in rows], f"{brute.DOCUMENTS}, {CLASHES}").repartition(3))
    names = plain.columns
    assert set(names) <= set(clashing.columns)
    assert result(clashing, names) == result(plain, names)
    if "doc_id" in names and "one of each" not in name and "kept" not in name and "texts" not in name and "cut" not in name:
        assert plain.count() == len(rows)


@pytest.mark.parametrize("name", ON_DOCUMENTS)
def test_empty_tables(spark, name):
    assert ON_DOCUMENTS[name](spark.createDataFrame([], f"{brute.DOCUMENTS}, {CLASHES}")).count() == 0


def test_conversations_with_clashing_columns(spark):
    rows = [(1, 0, "user", "a"), (1, 1, None, None), (1, 1, None, None), (None, 0, "assistant", "b"), (2, None, "end", "c"), (2, None, "more", ""), (2, 1, "more", "<|end|>")]
    schema = "conv_id bigint, turn bigint, role string, text string"
    plain = chat.read_chats(chat.format_chats(spark.createDataFrame(rows, schema)))
    clashing = chat.read_chats(chat.format_chats(spark.createDataFrame([(*r, 9, "q", "r", "s") for r in rows], f"{schema}, CONV_ID int, Turn string, ROLE string, Text string")))
    assert result(clashing, plain.columns) == result(plain, plain.columns)
    assert chat.format_chats(spark.createDataFrame([], f"{schema}, TEXT string")).count() == 0


def test_pages_with_clashing_columns(spark):
    long = "<p>" + "x" * 2000
    rows = [(1, "u", long), (2, None, long), (2, None, long), (None, "v", long), (3, "w", None), (None, None, None), (4, "z", "")]
    schema = "page_id bigint, url string, html string"
    plain = warc.read_archives(warc.write_archives(spark.createDataFrame(rows, schema)))
    clashing = warc.read_archives(warc.write_archives(spark.createDataFrame([(*r, "9", "q", b"r") for r in rows], f"{schema}, PAGE_ID string, Url string, HTML binary")))
    assert result(clashing, plain.columns) == result(plain, plain.columns) and plain.count() == len(rows)
    assert warc.read_archives(warc.write_archives(spark.createDataFrame([], f"{schema}, HTML binary"))).count() == 0
