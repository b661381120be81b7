"""Token counts by a subword vocabulary: in each word the longest piece first, over a trie of the pieces.

The vocabulary is a file that is a parameter: one piece per line, or a tokenizer's JSON with model.vocab.  Pieces
within a word bear a mark, before them (``inner``, as in ``##ing``) or at its end (``end``, as in ``ing</w>``).
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pandas as pd
import regex
from pyspark.sql import Column, SparkSession
from pyspark.sql.functions import pandas_udf

#: A vocabulary has fewer pieces than this; more are an error.
MOST_PIECES = 1 << 20
#: Words that a task remembers.
_REMEMBERED = 1 << 17
_END = ""  # where a piece ends in the trie; no character is empty


@dataclass(frozen=True)
class Rules:
    """How texts become words and words pieces.

    ``words``: what one word is, every match being one.  ``accents``: whether they stay.  ``spelled_bytes``: pieces are
    spelled by UTF-8 bytes, printable ones as themselves and the others as characters from U+0100 on.  A
    word that no pieces spell, or of over ``longest`` characters, is one unknown token.  ``specials`` are
    added to each text."""

    inner: str = "##"
    end: str = ""
    # Punctuation and ideographs are words of their own.
    words: str = r"[\p{P}$+<=>^`|~]|[㐀-䶿一-鿿豈-﫿\U00020000-\U0002fa1f]|[^\s\p{P}$+<=>^`|~㐀-䶿一-鿿豈-﫿\U00020000-\U0002fa1f]+"
    accents: bool = False
    spelled_bytes: bool = False
    longest: int = 100
    specials: int = 2


def _byte_letters() -> dict[int, str]:
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(0x100 + i) for i, b in enumerate(others)}


class Subwords:
    """The pieces as two tries, for the beginning of a word and for what goes on."""

    def __init__(self, pieces: Iterable[str], rules: Rules = Rules()):
        self.rules, self.word = rules, regex.compile(rules.words)
        self.letters = _byte_letters()
        self.known: dict[str, int] = {}
        self.first: dict = {}
        self.later: dict = {} if rules.inner else self.first
        for piece in pieces:
            trie = self.first
            if rules.inner and piece.startswith(rules.inner) and len(piece) > len(rules.inner):
                trie, piece = self.later, piece[len(rules.inner) :]
            ends = bool(rules.end) and piece.endswith(rules.end) and len(piece) > len(rules.end)
            for c in piece[: len(piece) - len(rules.end)] if ends else piece:
                trie = trie.setdefault(c, {})
            if piece:
                # Whether the piece may stand at the end of a word, and before it.
                last, middle = trie.get(_END, (False, False))
                trie[_END] = (last or ends or not rules.end, middle or not ends)

    def pieces_of(self, word: str) -> int:
        """Pieces of a word; an unknown one is one."""
        if len(word) > self.rules.longest:
            return 1
        if self.rules.spelled_bytes:
            word = "".join(self.letters[b] for b in word.encode())
        n, at, trie = 0, 0, self.first
        while at < len(word):
            node, upto = trie, 0
            for i in range(at, len(word)):
                node = node.get(word[i])
                if node is None:
                    break
                if _END in node and node[_END][0 if i + 1 == len(word) else 1]:
                    upto = i + 1
            if not upto:
                return 1
            n, at, trie = n + 1, upto, self.later
        return n

    def split(self, text: str) -> list[str]:
        text = text.lower()
        if not self.rules.accents:
            text = "".join(c for c in unicodedata.normalize("NFD", text) if unicodedata.category(c) != "Mn")
        text = "".join(c for c in text if c in "\t\n\r" or c.isspace() or unicodedata.category(c) not in ("Cc", "Cf") and c not in "\0�") if not self.rules.spelled_bytes else unicodedata.normalize("NFC", text)
        return self.word.findall(text)

    def count(self, text: str | None) -> int:
        """Tokens of a text with specials; null is empty."""
        total = self.rules.specials
        for word in self.split(text or ""):
            n = self.known.get(word)
            if n is None:
                if len(self.known) >= _REMEMBERED:
                    self.known.clear()
                n = self.known[word] = self.pieces_of(word)
            total += n
        return total


def read_vocabulary(spark: SparkSession, path: str) -> list[str]:
    """The pieces of a vocabulary file, read by Spark from wherever it lies."""
    if path.endswith(".json"):
        pieces = list(json.loads(spark.read.text(path, wholetext=True).first()[0])["model"]["vocab"])
    else:
        pieces = [r.value for r in spark.read.text(path).limit(MOST_PIECES + 1).collect()]
    if len(pieces) > MOST_PIECES:
        raise ValueError(f"the vocabulary has over {MOST_PIECES} pieces")
    return pieces


def counter(spark: SparkSession, pieces: list[str], rules: Rules = Rules()) -> Callable[[Column], Column]:
    """A function of a text column that gives its number of tokens; serves as an embedder's ``count_tokens``."""
    shared = spark.sparkContext.broadcast(pieces)  # fewer than MOST_PIECES short texts

    @pandas_udf("int")
    def tokens(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = Subwords(shared.value, rules)
        for texts in series:
            yield pd.Series([own.count(t) for t in texts], dtype="int32")

    return tokens
