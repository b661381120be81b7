"""Quality rules: simple limits, and robust multivariate outliers.

Six transformed statistics describe a document.  Per language and source, a minimum-covariance-
determinant estimate of their centre and scatter is fitted on all documents that pass
the simple limits.  A document is rejected if its squared Mahalanobis distance is beyond a far
quantile of the chi-squared law.

Equal points of a group count once: copies of a document, however many, say nothing about how
others vary, and would shrink the scatter to themselves.  A group's points are dealt by a hash into
chunks of bounded size; each chunk is concentrated from several deterministic starts until its
subset repeats, and what remains of all chunks together gives the group's centre and scatter.
A group of one chunk thus has its own estimate as it stands, and one of any size is never in one
task.  The same is done per language and for the whole corpus: a group's estimate is drawn
towards its language's by the weight of a few rows, and a group that is too small for an
estimate takes the next level's.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passagework.llm import arrowtext as at
from passagework.llm.shared import Scratch, pick, stored

_SYMBOL = at.byte_set(b"#*$%&|<>")
_LINE_END = at.byte_set(b"\n")
_CONTINUES = np.array([(b & 0xC0) == 0x80 for b in range(256)])

MEASURES = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, n_lines bigint"


def _sums(flags: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Number of set flags in each row's range."""
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[off[1:]] - total[off[:-1]]


def _again(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each key, whether it stands more than once, and whether an equal one stands before it."""
    order = np.argsort(keys, kind="stable")
    held = keys[order]
    same = held[1:] == held[:-1]
    many, later = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    later[order[1:]] = same
    many[order[1:]] = same
    many[order[:-1]] |= same
    return many, later


def measure(data: np.ndarray, off: np.ndarray, width: int = 3) -> list[np.ndarray]:
    """The columns of MEASURES for rows of UTF-8 bytes; equal words and lines are told by 64-bit hashes."""
    starts, ends, first = at.find_words(data, off)
    n_words = np.diff(first)
    chars = np.zeros(len(data) + 1, np.int64)
    np.cumsum(~_CONTINUES[data] & ~at._GAP[data], out=chars[1:])
    word_chars = chars[off[1:]] - chars[off[:-1]]
    row = np.repeat(np.arange(len(off) - 1), n_words)

    # Lines: row starts and newlines cut; only those with a word count.
    l_starts, l_ends, l_first = _lines(data, off)
    l_row = np.repeat(np.arange(len(off) - 1), np.diff(l_first))
    holds = np.searchsorted(starts, l_ends) > np.searchsorted(starts, l_starts)
    l_starts, l_ends, l_row = l_starts[holds], l_ends[holds], l_row[holds]
    salt = at.mix(np.arange(1, len(off), dtype=np.uint64))
    _, dup = _again(at.mix(at.hash_words(data, l_starts, l_ends) ^ salt[l_row])) if len(l_starts) else (None, np.zeros(0, bool))

    covered = np.zeros(len(starts) + 1, np.int64)
    if len(starts) >= width:
        whole = np.flatnonzero(row[: 1 - width] == row[width - 1 :])
        keys = at.window_hashes(at.hash_words(data, starts, ends), width)[whole]
        many, _ = _again(at.mix(keys ^ salt[row[whole]]))
        hit = whole[many]
        covered[hit] += 1
        np.add.at(covered, hit + width, -1)
    repeated = np.cumsum(covered)[:-1] > 0
    count = lambda rows: np.bincount(rows, minlength=len(off) - 1).astype(np.int64)
    return [n_words, word_chars, _sums(_SYMBOL[data], off), count(l_row[dup]), _sums(repeated, first), count(l_row)]


def _lines(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of the non-empty lines between newlines, and each row's first."""
    return at.find_words(data, off, _LINE_END)


def measured(docs: DataFrame, text: str = "text", carry: tuple[str, ...] = ("doc_id", "lang", "source")) -> DataFrame:
    """``carry`` columns and MEASURES per row; null text counts as empty."""
    docs = pick(docs, *dict.fromkeys([*carry, text]))
    types = dict(docs.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in at.slices(batch, text):
                columns = [pa.array(x, pa.int64()) for x in measure(*at.raw(at.column(part, text)))]
                yield pa.RecordBatch.from_arrays([*(at.column(part, c) for c in carry), *columns], [*carry, *(x.split()[0] for x in MEASURES.split(", "))])

    return docs.mapInArrow(at.tidy(run), ", ".join(f"`{c}` {types[c]}" for c in carry) + ", " + MEASURES)


def base_failed() -> Column:
    return F.expr("n_words < 50 or 100 * n_repeat_words > 50 * n_words")


#: Shares are taken as if a text held so many plain words and lines more: the shares of short texts move in coarse
#: steps, and this is the shortest text that the simple limits let pass.
_MORE_WORDS, _MORE_LINES = 50, 5

#: The transformed statistics: each is near symmetric on ordinary prose.  One symbol, one repeated line and the
#: words of one line and its repetition are no evidence, however short the text; counts are of what goes beyond.
STATISTICS = {
    "x0": "ln(1D + n_words)",
    "x1": "4D * ln(greatest(word_chars, 1) / greatest(n_words, 1))",
    "x2": f"asinh(100D * greatest(0, n_symbols - 1) / (n_words + {_MORE_WORDS}))",
    "x3": f"asinh(10D * greatest(0, n_dup_lines - 1) / (n_lines + {_MORE_LINES}))",
    "x4": f"asinh(10D * greatest(0D, n_repeat_words - 2D * n_words / greatest(n_lines, 1)) / (n_words + {_MORE_WORDS}))",
    "x5": "ln(greatest(n_words, 1) / greatest(n_lines, 1D))",
}
_X = list(STATISTICS)
_P = len(_X)
_PAIRS = [(i, j) for i in range(_P) for j in range(i, _P)]


def chi2_tail(x: float, p: int = _P) -> float:
    """P(chi-squared with an even number p of degrees of freedom > x)."""
    return math.exp(-x / 2) * sum((x / 2) ** k / math.factorial(k) for k in range(p // 2))


def chi2_quantile(tail: float, p: int = _P) -> float:
    """The value that chi-squared exceeds with probability ``tail``."""
    low, high = 0.0, 1000.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_tail(mid, p) > tail else (low, mid)
    return low


@dataclass(frozen=True)
class Outliers:
    """Parameters of the robust fit.

    ``half``: share of a group's distinct points that a fit covers.  ``tail``: chi-squared tail beyond which
    a row is rejected; 1e-9 is one in a billion documents that follow the fitted law,
    whatever the tables hold.  ``least_rows``: a group of fewer points takes the fit of its language, a
    language of fewer that of the corpus, and in a corpus of fewer nothing is rejected; five
    points for each statistic.  ``drawn``: points by which the next level's fit counts in
    a group's.  ``chunk``: points that are concentrated at once, on average.
    """

    half: float = 0.75
    tail: float = 1e-9
    least_rows: int = 5 * _P
    drawn: int = 5 * _P
    chunk: int = 4096


def _consistency(half: float) -> float:
    """Factor that makes the scatter of the nearest ``half`` of normal rows that of all."""
    return half / (1 - chi2_tail(chi2_quantile(1 - half), _P + 2))


def resolution(centre: np.ndarray) -> np.ndarray:
    """The smallest step of each statistic at a document like ``centre``: one word, character, symbol or
    repeated line more, or one repeated window.  A standard deviation is never taken to be less."""
    words = max(1.0, math.exp(centre[0]) - 1)
    chars, lines = words * math.exp(centre[1] / 4), max(1.0, words / math.exp(centre[5]))
    return np.array([math.log1p(1 / words), 4 * math.log1p(1 / chars), math.asinh(100 / (words + _MORE_WORDS)), math.asinh(10 / (lines + _MORE_LINES)), math.asinh(60 / (words + _MORE_WORDS)), math.log1p(1 / lines)])


def floored(scatter: np.ndarray, least: np.ndarray) -> np.ndarray:
    """``scatter`` with no variance under ``least`` squared, in any direction after scaling by these."""
    unit = scatter / np.outer(least, least)
    unit = unit + np.diag(np.maximum(0.0, 1 - np.diag(unit)))
    values, vectors = np.linalg.eigh(unit)
    return (vectors * np.maximum(values, 1 / 16)) @ vectors.T * np.outer(least, least)


def distances(x: np.ndarray, centre: np.ndarray, scatter: np.ndarray) -> np.ndarray:
    apart = x - centre
    return np.einsum("ij,ij->i", apart @ np.linalg.inv(scatter), apart)


def nearest(d2: np.ndarray, wanted: int) -> np.ndarray:
    """Which rows are the ``wanted`` nearest; the first ones among equals."""
    out = np.zeros(len(d2), bool)
    out[np.argsort(d2, kind="stable")[:wanted]] = True
    return out


def moments(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    centre = x.mean(axis=0)
    return centre, (x - centre).T @ (x - centre) / len(x)


def quantile(x: np.ndarray, share: float) -> np.ndarray:
    """Of each column the smallest value that so many of the rows do not exceed."""
    return np.sort(x, axis=0)[math.ceil(share * len(x)) - 1]


def starts(x: np.ndarray, least: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Deterministic first fits: quartile scales, signs of directions from the median, and bounded scores."""
    mid = quantile(x, 0.5)
    scale = np.maximum((quantile(x, 0.75) - quantile(x, 0.25)) / 1.349, least)
    unit = (x - mid) / scale
    spread = np.outer(scale, scale)
    length = np.maximum(np.linalg.norm(unit, axis=1), 1e-9)
    _, signs = moments(unit / length[:, None])
    _, scores = moments(np.tanh(unit))
    return [(mid, np.diag(scale**2)), (mid, floored(signs * _P * spread, least)), (mid, floored(scores * spread, least))]


def concentrated(x: np.ndarray, half: float) -> np.ndarray:
    """Which rows are the subset of share ``half`` with the smallest determinant that is reached from ``starts``.

    Each step takes the rows nearest to the fit of the last subset, until a subset is met again.
    Rows must come in an order of their own (as sorted), which settles ties.
    """
    least = resolution(quantile(x, 0.5))
    wanted = math.ceil(half * len(x))
    best, found = math.inf, np.ones(len(x), bool)
    for centre, scatter in starts(x, least):
        seen: set[bytes] = set()
        while True:
            subset = nearest(distances(x, centre, scatter), wanted)
            centre, scatter = moments(x[subset])
            scatter = floored(scatter, least)
            if subset.tobytes() in seen:
                break
            seen.add(subset.tobytes())
        size = np.linalg.slogdet(scatter)[1]
        if size < best - 1e-9:
            best, found = size, subset
    return found


#: Groups up to which sizes and fits (a few hundred bytes each) are broadcast; else they are shuffled, and Spark splits a hot group.
MOST_SENT = 20_000

_SUMS = ["n", *(f"s{i}" for i in range(_P)), *(f"q{i}{j}" for i, j in _PAIRS)]
#: Sums are taken in exact decimals, so that they do not depend on the order of rows.
_EXACT = "decimal(38, 10)"


def _concentrated(points: DataFrame, o: Outliers) -> DataFrame:
    """(level, grp, rows, n and sums over the concentrated rows) of each group of ``points`` (level, grp, x0..)."""
    points = stored(points, "points")
    sizes = stored(points.groupBy("level", "grp").agg(F.count(F.lit(1)).alias("size")), "sizes")
    dealt = points.join(F.broadcast(sizes) if sizes.count() <= MOST_SENT else sizes, ["level", "grp"]).withColumn("part", F.expr(f"pmod(xxhash64({', '.join(_X)}), greatest(1L, cast(ceil(size / {o.chunk}) as bigint)))"))

    def one(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by([(c, "ascending") for c in _X])
        x = np.column_stack([table[c].to_numpy() for c in _X])
        near = x[concentrated(x, o.half)]
        sums = [len(near), *near.sum(axis=0), *((near[:, i] * near[:, j]).sum() for i, j in _PAIRS)]
        head = {"level": pa.array([key[0].as_py()], pa.int32()), "grp": pa.array([key[1].as_py()], pa.string()), "rows": pa.array([len(x)], pa.int64())}
        return pa.table({**head, **{c: pa.array([float(v)]) for c, v in zip(_SUMS, sums)}})

    chunks = dealt.groupBy("level", "grp", "part").applyInArrow(one, "level int, grp string, rows bigint, " + ", ".join(f"{c} double" for c in _SUMS))
    return chunks.groupBy("level", "grp").agg(F.sum("rows").alias("rows"), *(F.sum(F.col(c).cast(_EXACT)).cast("double").alias(c) for c in _SUMS))


def _points(facts: DataFrame) -> DataFrame:
    """(level, grp, x0..): the distinct points of each group of language and source (level 0),
    of each language (1) and of the corpus (2), among rows that pass the simple limits."""
    groups = F.array(*[F.struct(F.lit(i).alias("level"), g.alias("grp")) for i, g in enumerate((F.col("own"), F.col("tongue"), F.lit("")))])
    rows = facts.where("not base_failed").select(F.inline(groups), *[F.expr(e).alias(x) for x, e in STATISTICS.items()])
    return rows.distinct()


def _estimate(sums: list[float], half: float) -> tuple[np.ndarray, np.ndarray]:
    """Centre and scatter from the sums of a concentrated subset."""
    total = dict(zip(_SUMS, sums))
    centre = np.array([total[f"s{i}"] for i in range(_P)]) / total["n"]
    scatter = np.empty((_P, _P))
    for i, j in _PAIRS:
        scatter[i, j] = scatter[j, i] = total[f"q{i}{j}"] / total["n"] - centre[i] * centre[j]
    return centre, _consistency(half) * scatter


def fit_of(levels: list[tuple[int, list[float]] | None], o: Outliers) -> tuple[np.ndarray, np.ndarray] | None:
    """Centre and scatter of a group from (rows, sums) of the corpus, of its language and of itself, each drawn
    towards the one before; levels that are missing or too small are passed over."""
    fit = None
    for held in levels:
        if held is None or held[0] < o.least_rows:
            continue
        centre, scatter = _estimate(held[1], o.half)
        if fit is not None:
            share = held[0] / (held[0] + o.drawn)
            centre, scatter = share * centre + (1 - share) * fit[0], share * scatter + (1 - share) * fit[1]
        fit = centre, floored(scatter, resolution(centre))
    return fit


_FIT = [*(f"m{i}" for i in range(_P)), *(f"w_{i}_{j}" for i, j in _PAIRS)]

def fitted(facts: DataFrame, o: Outliers) -> tuple[DataFrame, bool]:
    """(own, m.., w_..) of each group of ``facts`` (own, tongue, base_failed, MEASURES) that has a fit, and whether it is small enough to broadcast."""
    with Scratch() as scratch:
        fits = scratch.keep(stored(_fits(facts, o), "fits"))
    return fits, fits.count() <= MOST_SENT


def _fits(facts: DataFrame, o: Outliers) -> DataFrame:
    """The fits of all groups: from the estimates of each, of its language and of the corpus."""
    found = stored(_concentrated(_points(facts), o), "estimates")
    sums = F.struct("rows", F.array(*_SUMS).alias("sums"))
    level = lambda i, key: found.where(F.col("level") == i).select(F.col("grp").alias(key), sums.alias(f"e{i}"))
    groups = facts.where("not base_failed").select("own", "tongue").distinct().withColumn("every", F.lit(""))
    whole = groups.join(level(0, "own"), "own", "left").join(level(1, "tongue"), "tongue", "left").join(level(2, "every"), "every", "left").select("own", "e2", "e1", "e0")

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = []
            for r in batch.to_pylist():
                fit = fit_of([r[e] and (r[e]["rows"], r[e]["sums"]) for e in ("e2", "e1", "e0")], o)
                if fit is not None:
                    inverse = np.linalg.inv(fit[1])
                    out.append([r["own"], *fit[0].tolist(), *(float(inverse[i, j]) for i, j in _PAIRS)])
            columns = [*zip(*out)] if out else [()] * (1 + len(_FIT))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.float64() if i else pa.string()) for i, c in enumerate(columns)], ["own", *_FIT])

    return whole.mapInArrow(solve, "own string, " + ", ".join(f"{c} double" for c in _FIT))


def _distance() -> str:
    """SQL of the squared Mahalanobis distance, from columns m0.. (centre) and w_ij (inverse scatter)."""
    return " + ".join(f"{'' if i == j else '2 * '}w_{i}_{j} * ({_X[i]} - m{i}) * ({_X[j]} - m{j})" for i, j in _PAIRS)


def _judgeable(docs: DataFrame, lang: str, source: str) -> DataFrame:
    """``docs`` with base_failed and the keys of its groups: own (language and source) and tongue (language); null is a value."""
    key = lambda *names: F.to_json(F.struct(*[F.col(n).cast("string").alias(f"k{i}") for i, n in enumerate(names)]))
    return docs.withColumn("base_failed", base_failed()).withColumn("own", key(lang, source)).withColumn("tongue", key(lang))


def _scored(facts: DataFrame, fits: DataFrame, few: bool, o: Outliers) -> DataFrame:
    """``facts`` with columns distance2 and kept."""
    cut = chi2_quantile(o.tail)
    at_point = facts.select("*", *[F.expr(e).alias(x) for x, e in STATISTICS.items()]).join(F.broadcast(fits) if few else fits, "own", "left")
    return at_point.withColumn("distance2", F.when(~F.col("base_failed"), F.expr(_distance()))).withColumn(
        "kept", ~F.col("base_failed") & F.coalesce(F.col("distance2") <= cut, F.lit(True))
    )


def judged(docs: DataFrame, outliers: Outliers = Outliers()) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, base_failed,
    distance2, kept) per row of ``docs`` (doc_id, text, lang, source).

    Simple limits: under 50 words, or over half of the words in 3-word windows that the
    text repeats.  distance2 is the robust squared distance in the document's group of
    lang and source (null counts as a value), null where the simple limits reject the
    document or the corpus is too small for a fit.  Null or empty text: no words, rejected.
    Repeated rows are judged alike.  Empty table: no rows.
    """
    facts = stored(_judgeable(measured(docs), "lang", "source"), "measures")
    scored = _scored(facts, *fitted(facts, outliers), outliers)
    return scored.select("doc_id", *(x.split()[0] for x in MEASURES.split(", ")), "base_failed", "distance2", "kept")


def kept_documents(docs: DataFrame, outliers: Outliers = Outliers()) -> DataFrame:
    """The rows of ``docs`` that pass ``judged``, all columns kept.

    Fits come from a first pass; a second one measures each text again beside its row,
    so that no text is shuffled.
    """
    names = docs.columns
    held = {n: f"c{i}" for i, n in enumerate(names)}
    plain = docs.toDF(*held.values())
    lang, source, text = held["lang"], held["source"], held["text"]
    with Scratch() as scratch:
        fits, few = fitted(stored(_judgeable(measured(plain, text, (lang, source)), lang, source), "measures"), outliers)
        scratch.keep(fits)
    beside = _judgeable(measured(plain, text, tuple(held.values())), lang, source)
    return _scored(beside, fits, few, outliers).where("kept").select(*held.values()).toDF(*names)
