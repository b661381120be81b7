from __future__ import annotations

import brute
import pytest
import regex

from passagework.llm import licences as lic


def test_base_matches_brute_force(spark):
    rows = brute.awkward_documents() + [(90, "cc by cc by; CC-BY all rights reservedx all rights reserved", "en", "a", 5), (91, "cc", "en", "a", 2), (92, "by", "en", "a", 2)]
    got = brute.in_order(lic.scan_licences(spark.createDataFrame(rows, brute.DOCUMENTS)).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels").collect())
    assert got == brute.in_order((r[0], *brute.phrases(r[1], lic.PHRASES)) for r in rows)
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = brute.in_order(lic.scan_licences(df).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels").collect())
    assert got == brute.in_order((r.doc_id, *brute.phrases(r.text, lic.PHRASES)) for r in df.collect())


NOTICE = "permission is hereby granted free of charge to any person"


@pytest.mark.parametrize("text, edits", [(NOTICE, 0), (NOTICE.replace("hereby", "herby"), 1), (NOTICE.upper().replace(" FREE", ", FREE"), 0), ("x " + NOTICE.replace("person", "pers0n").replace("free", "fre") + " y", 2), (NOTICE.replace("permission", "prmissin").replace("charge", "chrge"), 3)])
def test_notices_with_edits_are_found(spark, text, edits):
    text = "Präfix ä: " + text + "."
    r = lic.scan_licences(spark.createDataFrame([(1, text)], "doc_id bigint, text string")).first()
    assert r.labels == "mit" and r.base_labels == ""
    assert [m.edits for m in r.matches] == [edits]
    assert 0 < r.score <= 1 and r.score == pytest.approx(1 - edits / len(NOTICE))
    found = text[r.matches[0].first : r.matches[0].stop]
    assert found.lower()[:4] in (NOTICE[:4], "prmi") and len(found) >= len(NOTICE) - 3


def test_seeds_miss_nothing_that_a_full_search_finds():
    search = lic.Notices(lic.NOTICES, lic.Scan())
    import random

    random.seed(5)
    for notice, pattern, k in zip(lic.NOTICES, search.patterns, search.edits):
        for _ in range(40):
            chars = list("lorem ipsum dolor sit amet " + notice + " consectetur")
            for _ in range(random.randint(0, k)):
                i = random.randrange(27, 27 + len(notice))
                chars[i] = random.choice([chars[i], "", "q", chars[i] + "z"])
            text = "".join(chars)
            found = {m[0] for m in search.find(text.encode())}
            if regex.search(pattern, text):
                assert search.labels[list(lic.NOTICES).index(notice)] in {search.labels[i] for i in found}


def test_every_span_of_repeated_notices_is_found():
    """Spans against a scan of the whole text, which restarts where the last match ended."""
    search = lic.Notices(lic.NOTICES, lic.Scan())
    assert [(a, b, e) for n, a, b, e in search.find(b"gnu general public licence later gnu general public license") if n == 3] == [(0, 26, 1), (33, 59, 0)]
    import random

    random.seed(8)
    for number, (notice, k) in enumerate(zip(lic.NOTICES, search.edits)):
        full = regex.compile(f"(?e)(?<![a-z0-9])(?:{notice}){{e<={k}}}(?![a-z0-9])")
        for _ in range(20):
            copies = []
            for _ in range(4):
                chars = list(notice)
                for _ in range(random.randint(0, k)):
                    chars[random.randrange(1, len(notice) - 1)] = "q"
                copies.append("".join(chars))
            text = " later ".join(copies)
            want = [(m.start(), m.end(), sum(m.fuzzy_counts)) for m in full.finditer(text)]
            assert len(want) == 4
            assert [(a, b, e) for n, a, b, e in search.find(text.encode()) if n == number] == want


@pytest.mark.parametrize("gap", [1, 30, 5000])
def test_gap_runs_of_any_length_hide_no_notice(gap):
    search = lic.Notices(lic.NOTICES, lic.Scan())
    text = "x" + " " * gap + "all" + " " * gap + "rights" + " " * gap + "reservd" + " " * gap + "y"
    begin = 1 + gap
    assert [m for m in search.find(text.encode()) if search.labels[m[0]] == "reserved"] == [(list(lic.NOTICES).index("all rights reserved"), begin, begin + 16 + 2 * gap, 1)]


def test_nothing_is_found_in_clean_or_empty_texts(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "nothing of the kind " * 50)], "doc_id bigint, text string")
    for r in lic.scan_licences(df).collect():
        assert (r.n_base, r.first_word, r.labels, r.score, r.matches) == (0, None, "", 0.0, [])
    assert lic.scan_licences(df.limit(0)).count() == 0


def test_letters_beyond_ascii_end_no_notice(spark):
    rows = [(1, "éall rights reserved"), (2, "all rights reservedé"), (3, "é all rights reserved — é"), (4, "漢 " * 50 + "all rights resrved")]
    found = {r.doc_id: r for r in lic.scan_licences(spark.createDataFrame(rows, "doc_id int, text string")).collect()}
    assert [found[i].labels for i in (1, 2, 3, 4)] == ["", "", "reserved", "reserved"]
    assert [(m.first, m.stop) for m in found[4].matches if m.label == "reserved"] == [(100, 118)]
