"""The fold of a document's events one by one, to hold the relational one against."""

from __future__ import annotations

import re

from passagework.operators import html_blocks as H
from passagework.operators.outline import SKIP_HEADING


class Run:
    """Blocks that read on from each other and become one: the first with the texts of all.

    Two kinds of run exist: a display heading that was set on several lines, and a list item whose
    sentence goes on in paragraphs.
    """

    def __init__(self, first: dict):
        self.first, self.texts, self.words = first, [first["text"]], len(first["text"].split())

    def takes(self, block: dict) -> bool:
        """Whether the run goes on in ``block``, the next one in the document."""
        lead = block["text"][:1]
        match self.first["type"], block["type"]:
            case "heading", "heading":
                return lead.islower() and self.words <= 8 and len(block["text"]) <= 40
            case "list_item", "paragraph":
                return (lead.islower() or lead == "(") and [*block["heading_path"]] == [*self.first["heading_path"]]
        return False

    def add(self, block: dict) -> None:
        self.texts.append(block["text"])
        self.words += len(block["text"].split())

    def block(self) -> dict:
        if len(self.texts) == 1:
            return self.first
        text = " ".join(self.texts)
        path = self.first["heading_path"]
        return {**self.first, "text": text, "heading_path": [*path[:-1], text] if self.first["type"] == "heading" else path, "header": None}


def joined(blocks: list[dict]) -> list[dict]:
    """``blocks`` of one document with each run made one block, in one pass."""
    runs: list[Run] = []
    for block in blocks:
        if runs and runs[-1].takes(block):
            runs[-1].add(block)
        else:
            runs.append(Run(block))
    return [r.block() for r in runs]


_SKIPPED = re.compile(f"^({SKIP_HEADING})$", re.IGNORECASE)


def _spaced(text: str) -> bool:
    runs = [len(t) for t in re.findall("[A-Za-z]+", text)]
    return len(runs) >= 8 and sum(n <= 2 for n in runs) > 0.45 * len(runs)


def _stays(kind: str, text: str) -> bool:
    """Whether a piece's normalized text, or a table, becomes a block."""
    if kind == "table":
        return bool(text) and not _spaced(text)
    bad = not text or H.DROP_TEXT.match(text) or H.PROMO.search(text) or _spaced(text)
    tail = text[:1].islower()  # a short line in lower case may be the end of a list item
    return not bad and not (kind == "paragraph" and (H.LICENCE.search(text) or (len(text) < 40 and not tail)))


def fold_document(events: list[dict], title: str) -> list[dict]:
    """Blocks of one document's events in order: heading path, skipped sections, drop caps, filters and merges.

    An event is a piece (kind, text, level), a drop cap (kind cap), or a table (kind table, text, header,
    caption, panel), each with its page.
    """
    outline, out = H.Outline(title), []
    skipping, cap = False, (None, "")
    for e in events:
        letter = cap[1] if cap[0] == e["page"] else ""
        cap = (e["page"], e["text"]) if e["kind"] == "cap" else (None, "")
        if e["kind"] == "cap":
            continue
        steps = [(e["kind"], letter + e["text"] if e["text"][:1].islower() else e["text"], int(e["level"]), None)]
        if e["kind"] == "table":
            steps = [("table", e["text"], 0, list(e["header"]))]
            if skipping or e["panel"]:
                continue
            if e["caption"] and len(e["caption"]) <= 80:
                steps.insert(0, ("heading", e["caption"], 1, None))
        for kind, text, level, header in steps:
            clean = text.strip() if kind == "table" else H.normalize(text)
            if kind == "heading":
                if not clean or _spaced(clean) or H.DROP_TEXT.match(clean):
                    continue
                skipping = bool(_SKIPPED.match(clean))
                if not skipping and outline.enter(level, clean) and not H.PROMO.search(clean):
                    out.append(outline.block("heading", clean))
            elif not skipping and _stays(kind, clean):
                out.append(outline.block(kind, clean, header))
    return [r for r in joined(out) if r["type"] != "paragraph" or len(r["text"]) >= 40]
