"""Plain single-machine versions of the operators, and small tables of awkward rows."""

from __future__ import annotations

import hashlib
import re
from itertools import combinations

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
DOCUMENTS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def awkward_documents() -> list[tuple]:
    """Nulls in every column, empty, very long, tied and repeated rows, copies and shared passages."""
    passage = " ".join(f"shared{i}" for i in range(60))
    base = " ".join(f"word{i % 37}x{i}" for i in range(200))
    rows = [
        (1, base, "en", "a"),
        (2, base, "en", "a"),
        (2, base, "en", "a"),
        (3, base.replace("word5x5", "changed"), "en", "b"),
        (4, f"intro here {passage} tail end", "de", "b"),
        (5, f"other start {passage} other end of text", "de", None),
        (6, "", "fr", "c"),
        (7, None, "fr", "c"),
        (8, " \t\n ", None, "c"),
        (9, "one two", "en", "a"),
        (10, "ein wort 　 ü ß 漢字 \x0b\x0c x\r\ny", "de", "c"),
        (11, "the same line\nthe same line\n\nthe same line\n" * 30, "en", "a"),
        (12, "loop " * 400, "en", "a"),
        (13, "#*$%&|<> symbols ### " * 40, "es", "d"),
        (14, "long text " + " ".join(f"t{i * 7919 % 5000}" for i in range(60000)), "en", "a"),
        (None, base, "en", "a"),
        (None, None, None, None),
        (-5, passage, "en", "z\U0001f600"),
        (15, "Licensed CC-BY 4.0. ALL RIGHTS RESERVED; GNU General Public License cc by", "en", "�"),
    ]
    return [(i, t, lang, s, None if t is None else len(t)) for i, t, lang, s in rows]


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def remove_repeats(rows: list[tuple], width: int = 13) -> list[tuple]:
    low: dict[tuple, int] = {}
    split = [(r[0], WORDS.findall(r[1] or "")) for r in rows]
    for doc, words in split:
        for i in range(len(words) - width + 1):
            if doc is not None:
                w = tuple(words[i : i + width])
                low[w] = min(low.get(w, doc), doc)
    out = []
    for doc, words in split:
        gone = [False] * len(words)
        for i in range(len(words) - width + 1):
            if doc is not None and low[tuple(words[i : i + width])] < doc:
                gone[i : i + width] = [True] * width
        out.append((doc, len(words), sum(gone), sha(" ".join(w for w, g in zip(words, gone) if not g))))
    return out


def key(row: tuple) -> tuple:
    return tuple((x is not None, x) if not isinstance(x, (list, tuple)) else (True, tuple(x)) for x in row)


def in_order(rows) -> list[tuple]:
    return sorted((tuple(r) for r in rows), key=key)


XXH = (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)


def fingerprint(text: str | None, width: int = 3) -> int:
    import xxhash

    words = WORDS.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def near_duplicates(rows: list[tuple], width: int = 3, most: int = 3) -> list[tuple]:
    prints = [fingerprint(r[1], width) for r in rows]
    root = list(range(len(rows)))

    def find(i: int) -> int:
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= most:
                root[find(i)] = find(j)
    low: dict[int, int] = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            low[find(i)] = min(low.get(find(i), r[0]), r[0])
    return [(r[0], f"{prints[i]:016x}", low.get(find(i))) for i, r in enumerate(rows)]


def shingles(text: str | None) -> set[tuple]:
    words = WORDS.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def near_copies(rows: list[tuple]) -> dict[int, int]:
    """doc_id -> smallest doc_id reachable by similarities of 0.8 or more, all pairs compared."""
    sets, root = {r[0]: shingles(r[1]) for r in rows}, {r[0]: r[0] for r in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        if 5 * len(x & y) >= 4 * len(x | y):
            low, high = sorted((find(a), find(b)))
            root[high] = low
    return {d: find(d) for d in sets}


def quality(text: str | None) -> tuple:
    text = text or ""
    words = WORDS.findall(text)
    lines = [x for x in text.split("\n") if WORDS.search(x)]
    seen: dict[tuple, list[int]] = {}
    for i in range(len(words) - 2):
        seen.setdefault(tuple(words[i : i + 3]), []).append(i)
    repeated = {i + k for places in seen.values() if len(places) > 1 for i in places for k in range(3)}
    failed = len(words) < 50 or 100 * len(repeated) > 50 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(repeated), failed


def phrases(text: str | None, named: dict[str, str]) -> tuple:
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)
    places, labels = [], set()
    for phrase, label in named.items():
        want = phrase.split()
        for i in range(len(words) - len(want) + 1):
            if words[i : i + len(want)] == want:
                places.append(i)
                labels.add(label)
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def look_alikes() -> tuple[str, str]:
    """Two words of 1,024 letters that agree under every polynomial modulo 2**64: the Thue-Morse word and its complement."""
    bits = [0]
    for _ in range(10):
        bits += [1 - b for b in bits]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)
