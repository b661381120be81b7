from __future__ import annotations

import random
from pathlib import Path

import plain_outline
import pytest

from passagework.operators import outline

EVENTS = "document_id string, span bigint, ord bigint, page int, kind string, text string, level int, header array<string>, caption string, panel boolean, document_name string"
TEXTS = {
    "heading": ["Storing food", "and cooling it", "safely", "at home now", "References", "INDEX", "The Title Page", "the title page of", "12", "T h e q u i c k b r o w", "", "Check out FoodKeeper", "Chilling", "one two three four five six seven eight nine", None],
    "paragraph": ["A body paragraph that is long enough to stay, with many words.", "goes on here", "(in brackets)", "short", "all rights reserved, and more words to make this one long enough", "download the guide as PDF", "goes on in a long line that would stay if it stood alone here", None, "ISBN 12"],
    "list_item": ["Wash hands", "clean boards", "chill", "12", ""],
    "table": ["| a | b |\n| --- | --- |\n| 1 | 2 |", " ", "| T h e q u i c k b r o w |"],
    "cap": ["K", "A"],
}
CAPTIONS = [None, "", "Chill times", "References", "x" * 81, "The Title Page", "lower caption", "12"]


def document(rng, name, n, span):
    rows, page = [], 0
    kinds = rng.choice([["heading", "paragraph", "list_item", "table", "cap"], ["heading", "heading", "paragraph"], ["list_item", "paragraph", "paragraph"], ["cap", "paragraph", "heading"], ["heading"]])
    for i in range(n):
        page += rng.random() < 0.1
        kind = rng.choice(kinds)
        table = kind == "table"
        rows.append((name, i // span, 3 * i, page, kind, rng.choice(TEXTS[kind]), rng.randint(1, 3), ["a", "b"] if table else None, rng.choice(CAPTIONS) if table else None, table and rng.random() < 0.2, rng.choice([None, "The title page."]) if name == "d0" else "The title page."))
    title = rows[0][-1] if rows else None
    return [(*r[:-1], title) for r in rows]


def plainly(rows):
    fields = [c.split(" ")[0] for c in EVENTS.split(", ")]
    out = []
    for name in sorted({r[0] for r in rows}):
        events = [dict(zip(fields, r)) for r in rows if r[0] == name]
        events = [{**e, "text": e["text"] or "", "caption": e["caption"] or "", "header": e["header"] or []} for e in events]
        found = plain_outline.fold_document(events, events[0]["document_name"] or "")
        out += [(name, i, b["type"], b["text"], b["heading_path"], b["header"]) for i, b in enumerate(found)]
    return out


def folded(spark, rows):
    return sorted((tuple(r) for r in outline.fold_events(spark.createDataFrame(rows, EVENTS).repartition(4)).collect()), key=lambda r: (r[0], r[1]))


@pytest.mark.parametrize("span", [1, 7, 1000])
def test_random_documents_equal_the_plain_fold(spark, span):
    rng = random.Random(span)
    rows = [r for d in range(40) for r in document(rng, f"d{d}", rng.choice([1, 5, 60]), span)]
    want = plainly(rows)
    assert folded(spark, rows) == want
    assert {r[2] for r in want} == {"heading", "paragraph", "list_item", "table"} and any(len(r[4]) == 4 for r in want)


def test_long_chains_across_spans(spark):
    """Display lines that go on over many spans, and a list item that paragraphs of many spans continue."""
    heads = [("h", i // 2, i, 0, "heading", "Words first" if i == 0 else "one more", 2, None, None, False, "t") for i in range(23)]
    item = [("i", i // 2, i, 0, "list_item" if i == 0 else "paragraph", "Wash" if i == 0 else f"and {i}", 0, None, None, False, "t") for i in range(15)]
    rows = heads + item
    found = folded(spark, rows)
    assert found == plainly(rows) and len([r for r in found if r[0] == "i"]) == 1


def test_no_events(spark):
    assert folded(spark, []) == []


def test_texts_do_not_move_with_every_pass(spark, monkeypatch):
    """What the passes keep between them is narrow: a text is kept once, a heading's once more."""
    kept, fresh = [], outline.fresh_path

    def noted(session, name):
        kept.append(fresh(session, name))
        return kept[-1]

    monkeypatch.setattr(outline, "fresh_path", noted, raising=False)
    rows = [("d", i // 4, i, 0, "paragraph", "".join(random.Random(i).choices("ABCDEFGHIJKLMNOPQRSTUVWXYZ", k=5000)), 0, None, None, False, "t") for i in range(200)]
    found = folded(spark, rows)
    assert [r[3] for r in found] == [r[5] for r in rows]
    size = sum(f.stat().st_size for at in kept for f in Path(at.removeprefix("file://")).rglob("*.parquet"))
    assert kept and size < 2 * sum(len(r[5]) for r in rows)
