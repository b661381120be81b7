"""Language identification of code-switched text by a linear-chain conditional random field.

Every word gets a label.  A word's emission scores come from its affixes, character
n-grams and lexicon entries; label transitions are learned with them, from word sequences in
which spans of documents in different languages alternate.  Forward-backward gives each
word's label probabilities; a document's language is the label with the largest mean.
"""

from __future__ import annotations

import re
import sys
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passagework.llm import arrowtext as at
from passagework.llm.shared import pick


def _numerals() -> str:
    """Ranges, for a character class, of the characters that ``\\w`` has beside letters, decimal digits and the underscore."""
    odd = [c for c in map(chr, range(sys.maxunicode + 1)) if c.isalnum() and not c.isalpha() and not c.isdecimal()]
    ends = [i for i in range(1, len(odd)) if ord(odd[i]) != ord(odd[i - 1]) + 1]
    return "".join(f"{odd[a]}-{odd[b - 1]}" for a, b in zip([0, *ends], [*ends, len(odd)]))


#: A word: up to 40 letters in a row (a longer run is cut).  Superscripts, fractions, circled and Roman numerals are no letters.
_LETTERS = re.compile(rf"[^\W\d_{_numerals()}]{{1,40}}")
UNKNOWN = "und"
#: Words that a chunk holds in the block-parallel passes, and words kept with their scores in memory.
CHUNK = 32
MEMORY = 1 << 17


@dataclass(frozen=True)
class Training:
    """``per_label``: about so many labelled documents of each language are learned from, chosen
    by a hash of doc_id; all others only count.  ``longest``: documents of more characters are
    not learned from.  ``most_labels``: more languages than that stop the training, since
    its sample, of ``per_label`` texts for each, is held by the driver.  ``length``: words of a training
    sequence.  ``span``: most words of one document in a row within it."""

    per_label: int = 200
    longest: int = 100_000
    most_labels: int = 256
    length: int = 64
    span: int = 48
    buckets: int = 1 << 16
    rounds: int = 30
    rate: float = 0.25
    decay: float = 1e-4
    seed: int = 11


def words_of(text: str | None) -> list[str]:
    return _LETTERS.findall(text.lower()) if text else []


class Model:
    """Hashed feature weights, transitions and a lexicon; everything a prediction uses."""

    def __init__(self, labels: list[str], buckets: int, lexicon: dict[str, int]):
        self.labels = labels
        self.buckets = buckets
        self.lexicon = lexicon
        self.weights = np.zeros((buckets, len(labels)), np.float32)
        self.moves = np.zeros((len(labels), len(labels)), np.float32)

    def features(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Buckets of all words' features, and the word of each: prefixes and suffixes of 1 to 3
        letters, 2- and 3-grams with the word's edges, lexicon entries, and one that all have."""
        if not words:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        text = np.frombuffer(("^" + "$^".join(words) + "$").encode("utf-32-le"), np.uint32).astype(np.uint64)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        starts = np.cumsum(sizes + 2) - sizes - 1
        word = np.arange(len(words))
        owner = np.repeat(word, sizes)
        place = np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + starts[owner]
        flat = [self._bucket(1, text[place], text[place + 1]), self._bucket(2, text[place - 1], text[place], text[place + 1])]
        owners = [owner, owner]
        for n in (1, 2, 3):
            of = np.flatnonzero(sizes >= n)
            first, last = starts[of], starts[of] + sizes[of] - n
            flat += [self._bucket(2 + n, *(text[first + i] for i in range(n))), self._bucket(5 + n, *(text[last + i] for i in range(n)))]
            owners += [of, of]
        known = [(i, e) for i, e in enumerate(map(self.lexicon.get, words)) if e is not None]
        if known:
            of, entry = np.array(known, np.int64).T
            whole = np.fromiter((zlib.crc32(words[i].encode()) for i in of), np.uint64, len(of))
            flat += [self._bucket(9, whole), self._bucket(10, entry.astype(np.uint64))]
            owners += [of, of]
        flat.append(np.zeros(len(words), np.int64))
        owners.append(word)
        return np.concatenate(flat), np.concatenate(owners)

    def _bucket(self, kind: int, *parts: np.ndarray) -> np.ndarray:
        h = np.full(len(parts[0]), kind, np.uint64)
        for part in parts:
            h = at.mix(h * np.uint64(0x9E3779B97F4A7C15) + part)
        return 1 + (h % np.uint64(self.buckets - 1)).astype(np.int64)

    def scores(self, flat: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
        return np.stack([np.bincount(owner, w[flat], n) for w in self.weights.T.astype(float)], 1) if n else np.zeros((0, len(self.labels)))


def _potentials(scores: np.ndarray) -> np.ndarray:
    return np.exp(scores - scores.max(axis=-1, keepdims=True))


def _unit(x: np.ndarray) -> np.ndarray:
    return x / x.sum(axis=-1, keepdims=True)


def posteriors(psi: np.ndarray, moves: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Label probabilities of every word of several sequences that stand one after the other.

    psi: potentials (words x labels), moves: exp of the transition scores.  Exact
    forward-backward in three passes: sequences are cut into chunks; each chunk's transfer
    matrix is multiplied up for all chunks at once; boundary messages run over the
    chunks; messages inside all chunks run at once.
    """
    n_labels = psi.shape[1]
    chunks = -(-lengths // CHUNK)
    if not chunks.sum():
        return np.zeros_like(psi)
    first = np.cumsum(lengths) - lengths
    chunk0 = np.cumsum(chunks) - chunks
    seq = np.repeat(np.arange(len(lengths)), chunks)
    begin = (np.arange(len(seq)) - chunk0[seq]) * CHUNK
    size = np.minimum(CHUNK, lengths[seq] - begin)
    place = np.minimum((first[seq] + begin)[:, None] + np.arange(CHUNK), len(psi) - 1)
    inside = np.arange(CHUNK) < size[:, None]
    p = psi[place]  # chunks x CHUNK x labels

    transfer = np.broadcast_to(np.eye(n_labels), (len(seq), n_labels, n_labels)).copy()
    for t in range(CHUNK):
        step = (transfer @ moves) * p[:, t, None, :]
        step /= step.sum(axis=(1, 2), keepdims=True)
        transfer = np.where(inside[:, t, None, None], step, transfer)

    # The message into a sequence's first word is uniform; it has passed no transition, so
    # it is chosen such that one transition makes it uniform up to the learned moves.
    ahead = np.empty((len(seq), n_labels))
    behind = np.empty((len(seq), n_labels))
    level = np.arange(len(seq)) - chunk0[seq]
    uniform = np.full(n_labels, 1 / n_labels)
    ahead[chunk0[chunks > 0]] = uniform
    behind[(chunk0 + chunks - 1)[chunks > 0]] = uniform
    by_level = np.argsort(level, kind="stable")
    cuts = np.searchsorted(level[by_level], np.arange(1, level.max() + 2))
    for k in range(1, level.max() + 1):
        at_ = by_level[cuts[k - 1] : cuts[k]]
        ahead[at_] = _unit(np.einsum("ci,cij->cj", ahead[at_ - 1], transfer[at_ - 1]))
    left = chunks[seq] - 1 - level
    by_left = np.argsort(left, kind="stable")
    cuts = np.searchsorted(left[by_left], np.arange(1, left.max() + 2))
    for k in range(1, left.max() + 1):
        at_ = by_left[cuts[k - 1] : cuts[k]]
        behind[at_] = _unit(np.einsum("cij,cj->ci", transfer[at_ + 1], behind[at_ + 1]))

    forward = np.empty_like(p)
    a = ahead
    for t in range(CHUNK):
        a = np.where(inside[:, t, None], _unit((a @ moves) * p[:, t]), a)
        forward[:, t] = a
    out = np.empty_like(psi)
    b = behind
    for t in range(CHUNK - 1, -1, -1):
        now = inside[:, t]
        out[place[now, t]] = _unit(forward[now, t] * b[now])
        b = np.where(now[:, None], _unit((b * p[:, t]) @ moves.T), b)
    return out


def train(rows: list[tuple[str, str]], how: Training = Training()) -> Model:
    """A model from (text, language) rows, by full-batch gradient steps on the conditional likelihood."""
    labels = sorted({lang for _, lang in rows})
    number = {lang: i for i, lang in enumerate(labels)}
    rng = np.random.default_rng(how.seed)
    counts: dict[str, Counter] = {}
    spans: list[tuple[list[str], int]] = []
    for text, lang in rows:
        words = words_of(text)
        i = 0
        while i < len(words):
            n = int(rng.integers(1, how.span + 1))
            spans.append((words[i : i + n], number[lang]))
            i += n
        for w in words:
            counts.setdefault(w, Counter())[number[lang]] += 1
    lexicon = {w: c.most_common(1)[0][0] for w, c in counts.items() if c.total() >= 3 and c.most_common(1)[0][1] >= 0.6 * c.total()}
    model = Model(labels, how.buckets, lexicon)
    if len(labels) < 2 or not spans:
        return model
    stream = [spans[i] for i in rng.permutation(len(spans))]
    types = {w: i for i, w in enumerate(counts)}
    ids = np.fromiter((types[w] for ws, _ in stream for w in ws), np.int64)
    gold = np.repeat([lab for _, lab in stream], [len(ws) for ws, _ in stream])
    lengths = np.full(-(-len(ids) // how.length), how.length)
    lengths[-1] -= lengths.sum() - len(ids)
    flat, owner = model.features(list(types))
    n, k = len(ids), len(labels)
    begins = np.zeros(n, bool)
    begins[np.cumsum(lengths) - lengths] = True
    told = np.zeros((k, k))
    np.add.at(told, (gold[:-1][~begins[1:]], gold[1:][~begins[1:]]), 1)
    target = np.zeros((len(types), k))
    np.add.at(target, (ids, gold), 1)
    state = [np.zeros_like(model.weights), np.zeros_like(model.weights), np.zeros_like(model.moves), np.zeros_like(model.moves)]
    for step in range(1, how.rounds + 1):
        psi = _potentials(model.scores(flat, owner, len(types)))[ids]
        moves = np.exp(model.moves.astype(float))
        post = posteriors(psi, moves, lengths)
        by_type = np.stack([np.bincount(ids, post[:, j], len(types)) for j in range(k)], 1) - target
        grad = np.stack([np.bincount(flat, by_type[owner, j], how.buckets) for j in range(k)], 1) / n + how.decay * model.weights
        pairs = _pair_sums(psi, moves, lengths, begins)
        grad_moves = (pairs - told) / n + how.decay * model.moves
        for g, at_, value in ((grad, 0, model.weights), (grad_moves, 2, model.moves)):
            state[at_] = 0.9 * state[at_] + 0.1 * g
            state[at_ + 1] = 0.99 * state[at_ + 1] + 0.01 * g * g
            value -= how.rate * (state[at_] / (1 - 0.9**step)) / (np.sqrt(state[at_ + 1] / (1 - 0.99**step)) + 1e-7)
    return model


def _pair_sums(psi: np.ndarray, moves: np.ndarray, lengths: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Expected number of each transition, from the messages of equally long training sequences."""
    k = psi.shape[1]
    size = int(lengths.max())
    padded = np.ones((len(lengths) * size, k))
    padded[: len(psi)] = psi
    p = padded.reshape(-1, size, k)
    forward = np.empty_like(p)
    forward[:, 0] = _unit(p[:, 0] * (np.full(k, 1 / k) @ moves))
    for t in range(1, size):
        forward[:, t] = _unit((forward[:, t - 1] @ moves) * p[:, t])
    total = np.zeros((k, k))
    b = np.full((len(p), k), 1 / k)
    inside = np.arange(size) < lengths[:, None]
    for t in range(size - 1, 0, -1):
        joint = forward[:, t - 1, :, None] * moves * (p[:, t] * b)[:, None, :]
        joint /= joint.sum(axis=(1, 2), keepdims=True)
        total += joint[inside[:, t]].sum(axis=0)
        b = np.where(inside[:, t, None], _unit((b * p[:, t]) @ moves.T), b)
    return total


class Labeller:
    """A model with the scores of the words met so far."""

    def __init__(self, model: Model):
        self.model = model
        self.moves = np.exp(model.moves.astype(float))
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.table = np.zeros((0, len(self.model.labels)))

    def potentials(self, words: list[str]) -> np.ndarray:
        number = self.number
        if len(number) > MEMORY:
            self.clear()
            number = self.number
        new = [w for w in dict.fromkeys(words) if w not in number]
        if new:
            for a in range(0, len(new), 20_000):
                some = new[a : a + 20_000]
                self.table = np.concatenate([self.table, _potentials(self.model.scores(*self.model.features(some), len(some)))])
            number.update(zip(new, range(len(number), len(number) + len(new))))
        return self.table[np.fromiter(map(number.__getitem__, words), np.int64, len(words))]

    def means(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Words per text, and mean label probabilities (0 for texts without words)."""
        split = [words_of(t) for t in texts]
        lengths = np.fromiter(map(len, split), np.int64, len(split))
        post = posteriors(self.potentials([w for ws in split for w in ws]), self.moves, lengths)
        total = np.zeros((len(post) + 1, len(self.model.labels)))
        np.cumsum(post, axis=0, out=total[1:])
        ends = np.cumsum(lengths)
        return lengths, (total[ends] - total[ends - lengths]) / np.maximum(1, lengths)[:, None]

    def tags(self, text: str) -> list[tuple[str, str, float]]:
        """(word, label, probability) of each word of one text."""
        words = words_of(text)
        if not words:
            return []
        post = posteriors(self.potentials(words), self.moves, np.array([len(words)]))
        return [(w, self.model.labels[i], float(p[i])) for w, p, i in zip(words, post, post.argmax(axis=1))]


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether crc32 of the id's decimal text leaves 0 modulo 5; a null id is never held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


def training_rows(docs: DataFrame, how: Training) -> list[tuple[str, str]]:
    """About ``how.per_label`` (text, lang) rows of each language, of documents that are not held out.

    Which rows are taken depends on a hash of doc_id; counts of languages cover all rows.  Raises
    ValueError for more than ``how.most_labels`` languages."""
    open_ = pick(docs, "doc_id", "text", "lang").where(~held_out() & F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & (F.length("text") <= how.longest))
    counts = {r["lang"]: r["count"] for r in open_.groupBy("lang").count().limit(how.most_labels + 1).collect()}
    if len(counts) > how.most_labels:
        raise ValueError(f"over {how.most_labels} languages: is lang a column of languages?")
    if not counts:
        return []
    shares = F.create_map(*[F.lit(x) for lang, n in sorted(counts.items()) for x in (lang, min(1.0, how.per_label / n))])
    drawn = F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 20)) < F.coalesce(F.try_element_at(shares, "lang"), F.lit(0.0)) * (1 << 20)
    return sorted((r["text"], r["lang"]) for r in open_.where(drawn).select("text", "lang").collect())


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) per row of ``docs``, from its text alone.

    score is the mean probability of the predicted label over all words of the text.
    Null or empty text, or one without a letter: "und" with score 0.  Repeated rows give equal
    rows.  A model without labels predicts "und" throughout.  Empty table: no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = Labeller(model)
        names = np.array([*model.labels, UNKNOWN], object)
        for batch in batches:
            for part in at.slices(batch, text):
                texts = at.column(part, text).to_pylist()
                if model.labels:
                    lengths, means = labeller.means(texts)
                    best = np.where(lengths > 0, means.argmax(axis=1), len(model.labels))
                    # Rounding keeps scores equal where texts meet others in a batch and sums differ in the last place.
                    score = np.round(np.where(lengths > 0, np.clip(means.max(axis=1), 0, 1), 0.0), 9)
                else:
                    best, score = np.zeros(len(texts), np.int64), np.zeros(len(texts))
                yield pa.RecordBatch.from_arrays([at.column(part, "doc_id"), pa.array(names[best].tolist(), pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    return pick(docs, "doc_id", text).withColumn("doc_id", F.col("doc_id").cast("bigint")).mapInArrow(at.tidy(run), "doc_id bigint, lang_pred string, score double")


def identify(docs: DataFrame, how: Training = Training()) -> DataFrame:
    """(doc_id, held_out, lang_pred, score): ``train`` on rows that are not held out, then ``predict`` all rows."""
    model = train(training_rows(docs, how), how)
    return predict(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
