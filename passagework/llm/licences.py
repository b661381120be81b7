"""License scans: exact phrases, and short notices with a bounded number of edits.

Exact phrases are found on word hashes.  Notices are searched fuzzily: a notice with at
most k edits keeps one of any k + 1 parts of it intact, so an automaton of all parts
(seeds) locates candidates, and the regex library's bounded-error matching verifies
each one and reports its span and number of edits.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagework.llm import arrowtext as at
from passagework.llm.shared import pick

#: Exact phrases and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Short notices that are searched with edits, and their labels.
NOTICES = {
    "permission is hereby granted free of charge to any person": "mit",
    "licensed under the apache license version 2 0": "apache-2.0",
    "redistribution and use in source and binary forms": "bsd",
    "gnu general public license": "gpl",
    "gnu lesser general public license": "lgpl",
    "mozilla public license version 2 0": "mpl-2.0",
    "creative commons attribution": "cc-by",
    "this work is dedicated to the public domain": "public-domain",
    "all rights reserved": "reserved",
}


@dataclass(frozen=True)
class Scan:
    """One edit is allowed per ``edits_per`` characters of a notice, ``most_edits`` at most."""

    edits_per: int = 12
    most_edits: int = 3

    def edits(self, notice: str) -> int:
        return min(self.most_edits, len(notice) // self.edits_per)


# A-Z become a-z, all other bytes but a-z, 0-9 and those of non-ASCII characters become spaces:
# byte places stay what they are in the text.
_PLAIN = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_FOLD = np.frombuffer(_PLAIN, np.uint8)
_GAP = at.byte_set(bytes(b for b in range(256) if _PLAIN[b] == 32))


def parts(notice: str, n: int) -> list[tuple[str, int]]:
    """A seed (with its offset) in each of ``n`` consecutive parts of the notice.

    A seed is the longest stretch of a part without a space, since any run of gaps may stand
    for a space.  The cuts make the shortest seed as long as they can, which keeps
    candidates rare.
    """
    size = len(notice)

    def seed(a: int, b: int) -> tuple[int, int]:
        best, i = (0, a), a
        for word in notice[a:b].split(" "):
            best = max(best, (len(word), -i), key=lambda x: x[0])
            i += len(word) + 1
        return best[0], abs(best[1])

    held = [[seed(a, b) for b in range(size + 1)] for a in range(size + 1)]
    # best[m][b]: the longest possible shortest seed of m parts that end at b, and the last cut.
    best: list[list[tuple[int, int]]] = [[(size, 0) if b == 0 else (0, 0) for b in range(size + 1)]]
    for _ in range(n):
        best.append([max(((min(best[-1][a][0], held[a][b][0]), a) for a in range(b)), default=(0, 0)) for b in range(size + 1)])
    out, b = [], size
    for m in range(n, 0, -1):
        a = best[m][b][1]
        length, offset = held[a][b]
        out.append((notice[offset : offset + length], offset))
        b = a
    return out[::-1]


#: What a notice must not stand right beside: ASCII letters and digits, and bytes of characters beyond ASCII, which are letters here.
LETTERS = r"a-z0-9\x80-\xff"


class Notices:
    """Seeds of all notices in one automaton, and a bounded-error pattern for each notice.

    Texts are Latin-1 views of UTF-8 bytes, so positions are byte offsets."""

    def __init__(self, notices: dict[str, str], scan: Scan):
        self.labels = list(notices.values())
        self.lengths = [len(n) for n in notices]
        self.edits = [scan.edits(n) for n in notices]
        # At most k + 1 gaps of a pattern meet in one run (words between them cost an edit each), and k more
        # of its places may be edited: a longer run is matched just as one of this length is.
        self.most_gaps = 2 * max(self.edits, default=0) + 2
        self.slack = [2 * k + 16 + n.count(" ") * (self.most_gaps - 1) for n, k in zip(notices, self.edits)]
        self.patterns = []
        seeds: dict[str, list[tuple[int, int]]] = {}
        for i, notice in enumerate(notices):
            k = self.edits[i]
            self.patterns.append(regex.compile(f"(?e)(?<![{LETTERS}])(?:{notice.replace(' ', ' +')}){{e<={k}}}(?![{LETTERS}])"))
            for seed, offset in parts(notice, k + 1):
                seeds.setdefault(seed, []).append((i, offset))
        self.automaton = ahocorasick.Automaton()
        for seed, where in seeds.items():
            self.automaton.add_word(seed, (len(seed), where))
        self.automaton.make_automaton()

    def find(self, plain: bytes) -> list[tuple[int, int, int, int]]:
        """(notice, first byte, one past the last, edits) of the matches, in order of notice and place."""
        # Runs of gaps are searched cut to ``most_gaps``, so that no reach depends on their length.
        data = np.frombuffer(plain, np.uint8)
        gaps = np.zeros(len(data) + 1, np.int64)
        np.cumsum(data == 32, out=gaps[1:])
        kept, size = np.ones(len(data), bool), self.most_gaps + 1
        kept[size - 1 :] = gaps[size:] - gaps[:-size] < size
        place = np.flatnonzero(kept)
        text = data[kept].tobytes().decode("latin-1")
        around: dict[int, list[int]] = {}
        for end, (size, where) in self.automaton.iter(text):
            for notice, offset in where:
                around.setdefault(notice, []).append(end - size + 1 - offset)
        found = []
        for notice, starts in sorted(around.items()):
            found += [(i, int(place[a]), int(place[b - 1]) + 1, e) for i, a, b, e in self._verified(text, notice, sorted(set(starts)))]
        return found

    def _verified(self, text: str, notice: int, starts: list[int]) -> Iterator[tuple[int, int, int, int]]:
        slack = self.slack[notice]
        reach = self.lengths[notice] + slack
        upto = 0
        i = 0
        while i < len(starts):
            # Candidates that overlap are searched as one stretch.
            low = max(upto, starts[i] - slack)
            high = starts[i] + reach
            while i + 1 < len(starts) and starts[i + 1] - slack <= high:
                i += 1
                high = starts[i] + reach
            i += 1
            for m in self.patterns[notice].finditer(text, low, min(len(text), high)):
                yield notice, m.start(), m.end(), sum(m.fuzzy_counts)
                upto = m.end()


def _phrases(tokens: np.ndarray, row: np.ndarray, phrases: dict[str, str]) -> list[np.ndarray]:
    """Word numbers where each phrase starts."""
    out = []
    for phrase in phrases:
        words = phrase.encode().split()
        data = np.frombuffer(b"".join(words), np.uint8)
        ends = np.cumsum([len(w) for w in words])
        want = at.hash_words(data, ends - [len(w) for w in words], ends)
        n = len(tokens) - len(words) + 1
        if n <= 0:
            out.append(np.zeros(0, np.int64))
            continue
        hit = row[:n] == row[len(words) - 1 :]
        for j, h in enumerate(want):
            hit &= tokens[j : j + n] == h
        out.append(np.flatnonzero(hit))
    return out


_MATCH = "struct<label: string, first: bigint, stop: bigint, edits: int>"


def scan_licences(docs: DataFrame, phrases: dict[str, str] | None = None, notices: dict[str, str] | None = None, scan: Scan = Scan(), text: str = "text") -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, matches) per row of ``docs``.

    Words are runs of a-z, 0-9 and non-ASCII characters of the text with A-Z folded.
    n_base counts the places where a phrase's words stand consecutively; first_word and
    last_word are the smallest and largest of their starts.  ``labels`` adds those of
    notices within their edit bound; ``matches`` are the spans of these (label, first and
    one past the last character of the text, edits).  score is 1 for an exact phrase,
    else the best share of a notice's characters without edits, else 0.  Labels are
    distinct, sorted and comma-joined.  Null or empty text: no words, no labels, score 0,
    null places.  Repeated rows give equal rows.  Empty table: no rows.
    """
    phrases, notices = phrases or PHRASES, notices or NOTICES
    names = list(phrases.values())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Notices(notices, scan)
        for batch in batches:
            for part in at.slices(batch, text):
                data, off = at.raw(at.column(part, text))
                data = _FOLD[data]
                starts, ends, first = at.find_words(data, off, _GAP)
                n = np.diff(first)
                row = np.repeat(np.arange(part.num_rows), n)
                places: list[list[int]] = [[] for _ in range(part.num_rows)]
                labels: list[set[str]] = [set() for _ in range(part.num_rows)]
                for name, hits in zip(names, _phrases(at.hash_words(data, starts, ends), row, phrases)):
                    for r, w in zip(row[hits].tolist(), (hits - first[row[hits]]).tolist()):
                        places[r].append(w)
                        labels[r].add(name)
                whole, spans = data.tobytes(), off.tolist()
                out = {k: [] for k in ("n_base", "first_word", "last_word", "base_labels", "labels", "score", "matches")}
                for r in range(part.num_rows):
                    plain = whole[spans[r] : spans[r + 1]]
                    found = search.find(plain)
                    base, more = labels[r], {search.labels[m[0]] for m in found}
                    best = max((1 - m[3] / search.lengths[m[0]] for m in found), default=0.0)
                    out["n_base"].append(len(places[r]))
                    out["first_word"].append(min(places[r], default=None))
                    out["last_word"].append(max(places[r], default=None))
                    out["base_labels"].append(",".join(sorted(base)))
                    out["labels"].append(",".join(sorted(base | more)))
                    out["score"].append(1.0 if base else max(0.0, best))
                    chars = _chars(plain) if found else None
                    out["matches"].append([(search.labels[i], int(chars[a]), int(chars[b]), e) for i, a, b, e in found])
                match = pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("stop", pa.int64()), ("edits", pa.int32())]))
                out["matches"] = [[dict(zip(("label", "first", "stop", "edits"), m)) for m in ms] for ms in out["matches"]]
                types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), match)
                yield pa.RecordBatch.from_arrays(
                    [at.column(part, "doc_id"), pa.array(n, pa.int64()), *(pa.array(v, t) for v, t in zip(out.values(), types))], ["doc_id", "n_words", *out]
                )

    return pick(docs, "doc_id", text).withColumn("doc_id", F.col("doc_id").cast("bigint")).mapInArrow(
        at.tidy(run), f"doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double, matches array<{_MATCH}>"
    )


def _chars(plain: bytes) -> np.ndarray:
    """Characters before each byte place (continuation bytes are kept by the folding)."""
    before = np.zeros(len(plain) + 1, np.int64)
    np.cumsum((np.frombuffer(plain, np.uint8) & 0xC0) != 0x80, out=before[1:])
    return before
