from __future__ import annotations

import random

import brute
import numpy as np
import pytest

from passagework.llm import quality

MEASURED = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def test_measures_match_brute_force(spark):
    rows = brute.awkward_documents() + [(r.doc_id + 1000, r.text, r.lang, r.source, 0) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    found = quality.judged(spark.createDataFrame(rows, brute.DOCUMENTS)).collect()
    assert brute.in_order(tuple(r[c] for c in MEASURED) for r in found) == brute.in_order((r[0], *brute.quality(r[1])) for r in rows)
    assert not any(r.kept and r.base_failed for r in found)


def documents(n=400):
    """Plain documents of one language and two sources, and a few odd ones among them."""
    random.seed(6)
    vocabulary = [f"w{'abcdefg'[i % 7] * (1 + i % 9)}{i}" for i in range(3000)]
    rows = []
    for i in range(n):
        text = "\n".join(" ".join(random.choice(vocabulary) for _ in range(random.randint(8, 20))) for _ in range(random.randint(5, 40)))
        rows.append((i, text, "en", "ab"[i % 2], len(text)))
    odd = [(1000 + i, rows[i][1].replace("w", "#$%&"), "en", "ab"[i % 2], 0) for i in range(20)]
    return rows, odd


def test_planted_outliers_go_and_plain_documents_stay(spark):
    plain, odd = documents()
    verdict = {r.doc_id: r for r in quality.judged(spark.createDataFrame(plain + odd, brute.DOCUMENTS)).collect()}
    assert all(verdict[r[0]].kept for r in plain)
    assert not any(verdict[r[0]].kept for r in odd)


def test_fit_is_robust_where_a_plain_covariance_is_not(spark):
    plain, odd = documents(300)
    odd = [(2000 + i, odd[i % 20][1], "en", "ab"[i % 2], 0) for i in range(80)]
    verdict = {r.doc_id: r for r in quality.judged(spark.createDataFrame(plain + odd, brute.DOCUMENTS)).collect()}
    assert not any(verdict[r[0]].kept for r in odd) and sum(verdict[r[0]].kept for r in plain) == len(plain)


def planted(plain):
    """For single statistics, documents that differ from the plain ones in it by about twice their usual range."""
    words = [r[1].split() for r in plain[:10]]
    for i, w in enumerate(words):
        yield "symbols", (3000 + i, " ".join(x + "#" * (n % 11 == 0) for n, x in enumerate(w)), "en", "ab"[i % 2], 0)
        yield "long words", (3100 + i, plain[i][1].replace("w", "".join(random.sample("bcdefghijklm", 11))), "en", "ab"[i % 2], 0)
        lines = [" ".join(f"{x}{random.randrange(99)}" for x in w[j : j + 8]) for j in range(0, len(w), 8)]
        yield "repeated lines", (3200 + i, "\n".join(f"{x}\nok\nso" for x in lines), "en", "ab"[i % 2], 0)


@pytest.mark.parametrize("kind", ["symbols", "long words", "repeated lines"])
def test_moderate_outliers_of_one_statistic_go(spark, kind):
    plain, _ = documents()
    odd = [row for name, row in planted(plain) if name == kind]
    verdict = {r.doc_id: r for r in quality.judged(spark.createDataFrame(plain + odd, brute.DOCUMENTS)).collect()}
    assert all(verdict[r[0]].kept for r in plain)
    assert not any(verdict[r[0]].base_failed for r in odd)
    assert not any(verdict[r[0]].kept for r in odd), sorted(verdict[r[0]].distance2 for r in odd)


def plain_fit(x):
    """Centre and scatter (before levels are joined) of the rows of ``x``: row by row, without chunks."""
    x = np.unique(x, axis=0)
    n, p = x.shape
    h = int(np.ceil(0.75 * n))
    low = lambda share: np.sort(x, axis=0)[int(np.ceil(share * n - 1e-9)) - 1]
    mid = low(0.5)

    def least(c):
        words = max(1.0, np.exp(c[0]) - 1)
        chars, lines = words * np.exp(c[1] / 4), max(1.0, words / np.exp(c[5]))
        return np.array([np.log(1 + 1 / words), 4 * np.log(1 + 1 / chars), np.arcsinh(100 / (words + 50)), np.arcsinh(10 / (lines + 5)), np.arcsinh(60 / (words + 50)), np.log(1 + 1 / lines)])

    def floor(s, sd):
        u = s / sd[:, None] / sd
        u[np.diag_indices(p)] = np.maximum(1, u.diagonal())
        w, v = np.linalg.eigh(u)
        return (v @ np.diag(np.maximum(w, 1 / 16)) @ v.T) * sd[:, None] * sd

    sd = least(mid)
    scale = np.maximum((low(0.75) - low(0.25)) / 1.349, sd)
    u = (x - mid) / scale
    directions = u / np.maximum(np.sqrt((u**2).sum(1)), 1e-9)[:, None]
    best = None
    for first in (np.diag(scale**2), floor(np.cov(directions.T, bias=True) * p * scale[:, None] * scale, sd), floor(np.cov(np.tanh(u).T, bias=True) * scale[:, None] * scale, sd)):
        centre, scatter, met = mid, first, set()
        while True:
            d2 = [float((r - centre) @ np.linalg.solve(scatter, r - centre)) for r in x]
            take = tuple(sorted(sorted(range(n), key=lambda i: (round(d2[i], 9), i))[:h]))
            centre, scatter = x[list(take)].mean(0), floor(np.cov(x[list(take)].T, bias=True), sd)
            if take in met:
                break
            met.add(take)
        size = np.linalg.slogdet(scatter)[1]
        if best is None or size < best[0] - 1e-9:
            best = size, x[list(take)]
    raw = np.cov(best[1].T, bias=True)
    return best[1].mean(0), raw * 0.75 / (1 - chi2.P(8, chi2.Q(6, 0.25))), least, floor


class chi2:
    """The chi-squared law with an even number of degrees of freedom."""

    @staticmethod
    def P(df, x):
        term, total = 1.0, 0.0
        for k in range(df // 2):
            total += term
            term *= x / 2 / (k + 1)
        return np.exp(-x / 2) * total

    @staticmethod
    def Q(df, tail):
        low, high = 0.0, 500.0
        while high - low > 1e-12 * max(1, high):
            mid = (low + high) / 2
            low, high = (mid, high) if chi2.P(df, mid) > tail else (low, mid)
        return low


def test_verdicts_are_those_of_a_plain_estimate(spark):
    """All of the smaller table: per language and source, drawn to the language's and the corpus's fits."""
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()
    found = {r.doc_id: r for r in quality.judged(spark.createDataFrame(rows)).collect()}
    points, groups = {}, {}
    for r in rows:
        words, chars, symbols, dup, again, failed = brute.quality(r.text)
        if failed:
            continue
        lines = len([x for x in r.text.split("\n") if brute.WORDS.search(x)])
        points[r.doc_id] = np.array([np.log(1 + words), 4 * np.log(chars / words), np.arcsinh(100 * max(0, symbols - 1) / (words + 50)), np.arcsinh(10 * max(0, dup - 1) / (lines + 5)), np.arcsinh(10 * max(0, again - 2 * words / lines) / (words + 50)), np.log(words / lines)])
        for key in ((), (r.lang,), (r.lang, r.source)):
            groups.setdefault(key, []).append(points[r.doc_id])
    fits = {}
    for key in sorted(groups, key=len):
        up = fits.get(key[:-1]) if key else None
        n = len(np.unique(groups[key], axis=0))
        if n < 30:
            fits[key] = up
            continue
        m, s, least, floor = plain_fit(np.array(groups[key]))
        if up is not None:
            share = n / (n + 30)
            m, s = share * m + (1 - share) * up[0], share * s + (1 - share) * up[1]
        fits[key] = m, floor(s, least(m))
    cut = chi2.Q(6, 1e-9)
    for r in rows:
        if r.doc_id in points:
            m, s = fits[(r.lang, r.source)]
            d2 = (points[r.doc_id] - m) @ np.linalg.inv(s) @ (points[r.doc_id] - m)
            assert found[r.doc_id].distance2 == pytest.approx(d2, rel=1e-4), (r.lang, r.source)
            assert found[r.doc_id].kept == (d2 <= cut)
    assert 0 < sum(not found[d].kept for d in points) < 0.2 * len(points)


def test_a_concentrated_subset_is_a_fixed_point():
    """A further step from the found subset changes nothing, and the far rows are not in it."""
    rng = np.random.default_rng(3)
    x = np.unique(np.concatenate([rng.normal(size=(300, 6)), rng.normal(4, 0.1, size=(60, 6))]), axis=0)
    subset = quality.concentrated(x, 0.75)
    assert subset.sum() == 270
    centre, scatter = quality.moments(x[subset])
    least = quality.resolution(quality.quantile(x, 0.5))
    again = quality.nearest(quality.distances(x, centre, quality.floored(scatter, least)), 270)
    assert np.array_equal(again, subset) and not subset[x.min(axis=1) > 3].any()


def test_groups_of_many_chunks_reject_the_same_outliers(spark):
    plain, odd = documents(600)
    df = spark.createDataFrame(plain + odd, brute.DOCUMENTS)
    verdict = {r.doc_id: r.kept for r in quality.judged(df, quality.Outliers(chunk=50)).collect()}
    assert all(verdict[r[0]] for r in plain) and not any(verdict[r[0]] for r in odd)


def test_copies_cost_one_row_and_do_not_split_a_group(spark):
    """A third of a source are copies of one document."""
    plain, odd = documents(200)
    copies = [(5000 + i, *plain[0][1:]) for i in range(100)]
    df = spark.createDataFrame(plain + odd + copies, brute.DOCUMENTS)
    facts = quality._judgeable(quality.measured(df), "lang", "source")
    points = quality._points(facts)
    assert points.where("level = 2").count() <= 220 < facts.where("not base_failed").count()
    verdict = {r.doc_id: r.kept for r in quality.judged(df).collect()}
    assert all(verdict[r[0]] for r in plain + copies) and not any(verdict[r[0]] for r in odd)


def test_extra_columns_with_clashing_names(spark):
    plain, odd = documents(60)
    df = spark.createDataFrame([(*r, "x", 1.5, None) for r in plain + odd], brute.DOCUMENTS + ", TEXT string, kept double, own string")
    kept = quality.kept_documents(df)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {r[0] for r in plain}
    assert quality.judged(df).where("kept").count() == len(plain)


def test_chi_squared():
    assert quality.chi2_quantile(0.05) == pytest.approx(12.5916, abs=1e-3)
    assert quality.chi2_quantile(0.5) == pytest.approx(5.3481, abs=1e-3)


def test_kept_documents_keep_columns(spark):
    plain, odd = documents(150)
    df = spark.createDataFrame([(*r, 7) for r in plain + odd + brute.awkward_documents()], brute.DOCUMENTS + ", n_words int")
    kept = quality.kept_documents(df)
    assert kept.columns == df.columns
    want = brute.in_order((r.doc_id,) for r in quality.judged(df).where("kept").collect())
    assert brute.in_order((r.doc_id,) for r in kept.collect()) == want


def test_empty_and_null_rows(spark):
    assert quality.judged(spark.createDataFrame([], brute.DOCUMENTS)).count() == 0
    df = spark.createDataFrame([(None, None, None, None, None), (1, "", None, "s", 0)], brute.DOCUMENTS)
    assert [(r.n_words, r.base_failed, r.kept) for r in quality.judged(df).collect()] == [(0, True, False)] * 2


def test_long_lines_that_look_alike_to_a_polynomial_are_not_repeated(spark):
    a, b = brute.look_alikes()
    df = spark.createDataFrame([(1, f"{a}\n{b}", "en", "s", 0), (2, f"{a}\n{a}", "en", "s", 0), (3, f"x y {a} x y {b}", "en", "s", 0)], brute.DOCUMENTS)
    assert sorted((r.doc_id, r.n_dup_lines, r.n_repeat_words) for r in quality.measured(df).collect()) == [(1, 0, 0), (2, 1, 0), (3, 0, 0)]


def test_words_have_hashes_that_agree_only_where_they_are_equal():
    import numpy as np

    from passagework.llm import arrowtext as at

    words = [w.encode() for w in ("a", "b", "aa", "a\0", "12345678", "123456789", "x" * 63, "x" * 64, "x" * 65, "x" * 64 + "y", *brute.look_alikes(), "a")]
    data, ends = np.frombuffer(b"".join(words), np.uint8), np.cumsum([len(w) for w in words])
    for seed in (0, 7):
        got = at.hash_words(data, ends - [len(w) for w in words], ends, seed)
        assert len(set(got.tolist())) == len(set(words)) and got[0] == got[-1]
        assert (got == at.hash_words(data, ends - [len(w) for w in words], ends, seed, limit=1)).all()
