"""SentencePiece BPE encoding from a merge-type prefix table, and decoding.

A sequence of pieces is the encoding of its text exactly if every two neighbours are
compatible, that is, if the merge rules encode their joint text as these two pieces.  So each
prefix of a text has one last piece: of all pieces that end there (found by an Aho-
Corasick automaton) the one that encodes itself and is compatible with the last piece of the
prefix before it.  A forward pass stores that piece per prefix; ids come from walking back.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagework.llm import arrowtext as at
from passagework.llm.shared import pick

SPACE = "▁"
#: Entries of the pair memory, and of each of the two generations of the word memory.
MEMORY = 1 << 18
#: Longest word, in characters, that is remembered.
LONGEST_KEPT = 64


class Pieces:
    """A SentencePiece BPE model (identity normalisation, byte fallback) as pieces and ranks."""

    def __init__(self, model: bytes):
        self.library = sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        plain = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.ids = {sp.id_to_piece(i): i for i in plain}
        self.text = {i: p for p, i in self.ids.items()}
        self.score = {p: sp.get_score(i) for p, i in self.ids.items()}
        self.bytes = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        if any(SPACE in p.lstrip(SPACE) for p in self.ids):
            raise ValueError("a piece holds a space after another character: words cannot be cut at spaces")
        if sp.decode(sp.encode(" A  b ")) != " A  b ":
            raise ValueError("the model normalises white space")
        # Only pieces that the merge rules reach can be the last piece of a prefix.
        self.automaton = ahocorasick.Automaton()
        self._size = sp.get_piece_size()
        for p in self._split_pieces():
            self.automaton.add_word(p, (len(p), self.ids[p]))
        self.automaton.make_automaton()
        self._known = frozenset(self.ids)
        # A character that no piece has ends a word: it stands for its bytes and joins nothing.
        cut = "".join(c for c in "\n\t\r" if not any(c in p for p in self.ids))
        self._cut = re.compile(f"{SPACE}+[^{SPACE}{cut}]*|[^{SPACE}{cut}]+|[{cut}]" if cut else f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")
        self._pairs: dict[int, bool] = {}
        self._new: dict[str, tuple[int, ...]] = {}
        self._old: dict[str, tuple[int, ...]] = {}

    def merges(self, text: str) -> tuple[list[str], list[tuple[str, str]]]:
        """The merge rules applied to a short text of known characters (best score first, then
        leftmost): the pieces that remain, and the pairs that were merged, in order."""
        parts: list[str | None] = list(text)
        n = len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap: list[tuple[float, int, str]] = []
        done: list[tuple[str, str]] = []

        def offer(i: int) -> None:
            if 0 <= i and after[i] < n:
                joint = parts[i] + parts[after[i]]
                if joint in self.score:
                    heapq.heappush(heap, (-self.score[joint], i, joint))

        for i in range(n - 1):
            offer(i)
        while heap:
            _, i, joint = heapq.heappop(heap)
            if parts[i] is None or after[i] >= n or parts[i] + parts[after[i]] != joint:
                continue
            j = after[i]
            done.append((parts[i], parts[j]))
            parts[i], parts[j] = joint, None
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            offer(i)
            offer(before[i])
        return [p for p in parts if p is not None], done

    def _split_pieces(self) -> list[str]:
        """Sets each reachable piece's last merge, and which pieces only grow by ever later merges; returns the reachable pieces."""
        order = {s: r for r, s in enumerate(sorted(set(self.score.values()), reverse=True))}
        self._rank = [-1] * self._size
        self._left, self._right = [-1] * self._size, [-1] * self._size
        self._steady = [True] * self._size
        reachable = []
        for p, i in sorted(self.ids.items(), key=lambda x: len(x[0])):
            whole, done = self.merges(p)
            if whole != [p]:
                continue
            reachable.append(p)
            if done:
                a, b = (self.ids[x] for x in done[-1])
                self._rank[i], self._left[i], self._right[i] = order[self.score[p]], a, b
                self._steady[i] = self._steady[a] and self._steady[b] and self._rank[i] > max(self._rank[a], self._rank[b])
        self._order = {p: order[s] for p, s in self.score.items()}
        return reachable

    def _fits(self, left: int, right: int) -> bool:
        """Whether the merge rules encode the joint text of two reachable pieces as these two.

        Their last merges are taken back one by one, latest first (of equal ones the right
        one, as the left comes first); if the two pieces that then meet could have merged before
        that, the joint text has another encoding.
        """
        if not (self._steady[left] and self._steady[right]):
            a, b = self.text[left], self.text[right]
            return self.merges(a + b)[0] == [a, b]
        rank, order, text = self._rank, self._order, self.text
        limit = 1 << 60
        while True:
            met = order.get(text[left] + text[right])
            if met is not None and met < limit:
                return False
            if rank[left] > rank[right]:
                limit, left = rank[left], self._right[left]
            elif rank[right] >= 0:
                limit, right = rank[right] + 1, self._left[right]
            else:
                return True

    def compatible(self, left: int, right: int) -> bool:
        """``_fits``, remembered."""
        known = self._pairs.get(left * self._size + right)
        if known is None:
            if len(self._pairs) >= MEMORY:
                self._pairs.clear()
            known = self._pairs[left * self._size + right] = self._fits(left, right)
        return known

    def _known_run(self, text: str) -> list[int]:
        """Ids of a text of known characters, by the prefix table."""
        last, size = [0] * len(text), [0] * len(text)
        pairs, n_pieces = self._pairs, self._size
        for end, (n, piece) in self.automaton.iter(text):
            if size[end]:
                continue
            start = end - n + 1
            if start:
                before = last[start - 1]
                fits = pairs.get(before * n_pieces + piece)
                if not (self.compatible(before, piece) if fits is None else fits):
                    continue
            last[end], size[end] = piece, n
        out = []
        at_ = len(text) - 1
        while at_ >= 0:
            out.append(last[at_])
            at_ -= size[at_]
        out.reverse()
        return out

    def _word(self, word: str) -> tuple[int, ...]:
        ids: list[int] = []
        run = 0
        for i, c in enumerate(word):
            if c not in self.ids:
                if run < i:
                    ids += self._known_run(word[run:i])
                ids += [self.bytes[b] for b in c.encode()]
                run = i + 1
        if run < len(word):
            ids += self._known_run(word[run:])
        return tuple(ids)

    def word(self, word: str) -> tuple[int, ...]:
        """Ids of what ``_cut`` takes for a word; words met again move to the new generation."""
        ids = self._old.get(word)
        if ids is None:
            ids = tuple(self._known_run(word)) if self._known.issuperset(word) else self._word(word)
        if len(word) <= LONGEST_KEPT:
            if len(self._new) >= MEMORY:
                self._old, self._new = self._new, {}
            self._new[word] = ids
        return ids

    def encode(self, text: str) -> list[int]:
        """Ids of ``text``, as the library's encode without begin, end or sampling.

        No piece has a space after another character, so words, each with the spaces before
        it, are encoded one by one."""
        if not text:
            return []
        held, out = self._new, []
        for w in self._cut.findall(SPACE + text.replace(" ", SPACE)):
            ids = held.get(w)
            if ids is None:
                ids = self.word(w)
                held = self._new
            out += ids
        return out

    def forget(self) -> None:
        self._new, self._old = {}, {}
        self._pairs.clear()

    def decode(self, ids: list[int]) -> str:
        return self.library.decode(ids)


_LOADED: dict[bytes, Pieces] = {}


def loaded(model: bytes) -> Pieces:
    """The model's tables, made once per Python worker."""
    key = hashlib.sha256(model).digest()
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = Pieces(model)
    return _LOADED[key]


def encode_documents(docs: DataFrame, model_path: str, with_ids: bool = True, text: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids, ids_sha256, decoded_sha256) per row of ``docs``.

    ``ids`` are all ids of the whole text (null instead of the array if ``with_ids`` is
    false); the digests are of the decimal ids joined by commas and of the text decoded
    from the ids.  Null text: empty, no ids.  Repeated rows give equal rows.  The model
    file (some hundred KB) is read on the driver and sent along.  Empty table: no rows.
    """
    with open(model_path, "rb") as f:
        model = f.read()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = loaded(model)
        decimal = np.array([str(i) for i in range(pieces.library.get_piece_size())], object)
        for batch in batches:
            for part in at.slices(batch, text, 1 << 20):
                counts, ids_digest, decoded, kept = [], [], [], []
                for t in at.column(part, text).to_pylist():
                    ids = pieces.encode(t or "")
                    counts.append(len(ids))
                    ids_digest.append(hashlib.sha256(",".join(decimal[ids].tolist()).encode() if ids else b"").hexdigest())
                    decoded.append(hashlib.sha256(pieces.decode(ids).encode()).hexdigest())
                    kept.append(np.array(ids, np.int32) if with_ids else None)
                yield pa.RecordBatch.from_arrays(
                    [at.column(part, "doc_id"), pa.array(counts, pa.int64()), pa.array(kept, pa.list_(pa.int32())), pa.array(ids_digest), pa.array(decoded)],
                    ["doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256"],
                )
        # The worker may go on to other tasks; what was remembered for this one is let go.
        pieces.forget()

    return pick(docs, "doc_id", text).withColumn("doc_id", F.col("doc_id").cast("bigint")).mapInArrow(at.tidy(run), "doc_id bigint, n_tokens bigint, ids array<int>, ids_sha256 string, decoded_sha256 string")
