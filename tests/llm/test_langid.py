from __future__ import annotations

import itertools
import zlib

import brute
import numpy as np
import pytest

from passagework.llm import langid


def enumerated(psi, moves):
    """Label probabilities by summing over all label sequences."""
    n, k = psi.shape
    out = np.zeros((n, k))
    for labels in itertools.product(range(k), repeat=n):
        p = psi[0, labels[0]] * moves[:, labels[0]].sum()
        for t in range(1, n):
            p *= moves[labels[t - 1], labels[t]] * psi[t, labels[t]]
        for t, x in enumerate(labels):
            out[t, x] += p
    return out / out.sum(axis=1, keepdims=True)


def test_forward_backward_is_exact():
    rng = np.random.default_rng(0)
    for lengths in ([5], [1, 7, 0, 3], [2, 2]):
        psi, moves = rng.random((sum(lengths), 3)) + 0.01, np.exp(rng.normal(size=(3, 3)))
        got, at = langid.posteriors(psi, moves, np.array(lengths)), 0
        for n in lengths:
            if n:
                assert got[at : at + n] == pytest.approx(enumerated(psi[at : at + n], moves))
            at += n


def test_chunks_do_not_matter(monkeypatch):
    rng = np.random.default_rng(1)
    lengths = np.array([0, 1, 31, 32, 33, 200, 64])
    psi, moves = rng.random((lengths.sum(), 4)) + 0.01, np.exp(rng.normal(size=(4, 4)))
    want = langid.posteriors(psi, moves, lengths)
    monkeypatch.setattr(langid, "CHUNK", 1000)
    assert langid.posteriors(psi, moves, lengths) == pytest.approx(want)


def test_gradient_of_transitions_matches_differences():
    rng = np.random.default_rng(2)
    psi, score = rng.random((7, 2)) + 0.1, rng.normal(size=(2, 2))
    lengths = np.array([4, 3])
    begins = np.array([1, 0, 0, 0, 1, 0, 0], bool)

    def log_z(s):
        total, at = 0.0, 0
        for n in lengths:
            z = 0.0
            for labels in itertools.product(range(2), repeat=int(n)):
                p = psi[at, labels[0]]
                for t in range(1, n):
                    p *= np.exp(s[labels[t - 1], labels[t]]) * psi[at + t, labels[t]]
                z += p
            total += np.log(z)
            at += n
        return total

    # The message into a first word is uniform times the moves; make that factor constant.
    score -= np.log(np.exp(score).sum(axis=0))
    pairs = langid._pair_sums(psi, np.exp(score), lengths, begins)
    for i, j in itertools.product(range(2), repeat=2):
        step = np.zeros((2, 2))
        step[i, j] = 1e-5
        assert pairs[i, j] == pytest.approx((log_z(score + step) - log_z(score - step)) / 2e-5, rel=1e-4)


def test_held_out_accuracy_and_purity_of_inputs(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = {r.doc_id: r for r in langid.identify(df).collect()}
    truth = {r.doc_id: r.lang for r in df.collect()}
    held = [i for i in truth if zlib.crc32(str(i).encode()) % 5 == 0]
    assert [i for i in rows if rows[i].held_out] == [i for i in rows if i in set(held)]
    assert sum(rows[i].lang_pred == truth[i] for i in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 for r in rows.values())
    # Held-out labels are not learned from.
    from pyspark.sql import functions as F

    spoilt = df.withColumn("lang", F.when(langid.held_out(), F.lit("xx")).otherwise(F.col("lang")))
    again = {r.doc_id: r.lang_pred for r in langid.identify(spoilt).collect()}
    assert again == {i: r.lang_pred for i, r in rows.items()}


def test_code_switched_words_get_their_own_labels(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.text, r.lang) for r in df.where("lang in ('fr', 'de')").collect()]
    model = langid.train(rows[:120], langid.Training())
    german = next(t for t, lang in rows[120:] if lang == "de").split()[:30]
    french = next(t for t, lang in rows[120:] if lang == "fr").split()[:30]
    tags = langid.Labeller(model).tags(" ".join(german + french))
    labels = [x[1] for x in tags]
    half = len(langid.words_of(" ".join(german)))
    assert np.mean([x == "de" for x in labels[:half]]) > 0.85 and np.mean([x == "fr" for x in labels[half:]]) > 0.85


def test_awkward_rows(spark):
    rows = brute.awkward_documents()
    found = langid.identify(spark.createDataFrame(rows, brute.DOCUMENTS)).collect()
    assert len(found) == len(rows)
    letterless = {r[0] for r in rows if r[0] is not None and not any(c.isalpha() for c in r[1] or "")}
    for r in found:
        assert (r.lang_pred == "und") == (r.doc_id in letterless) or r.doc_id is None
    empty = spark.createDataFrame([], brute.DOCUMENTS)
    assert langid.identify(empty).count() == 0
    unlabelled = spark.createDataFrame([(1, "some text", None, None, 9)], brute.DOCUMENTS)
    assert [tuple(r) for r in langid.identify(unlabelled).collect()] == [(1, False, "und", 0.0)]


def test_numerals_are_no_letters(spark):
    texts = ["² ½ ①", "Ⅷ ٣ 7", "x²", "一", None, "", "_", "ªº", "́"]
    model = langid.train([("the cat and the dog " * 9, "en"), ("der hund und die katze " * 9, "de")])
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    found = {r.doc_id: r.lang_pred for r in langid.predict(df, model).collect()}
    for i, t in enumerate(texts):
        assert (found[i] == "und") == (not any(c.isalpha() for c in t or "")), t


def test_a_column_of_too_many_languages_stops_the_training(spark):
    df = spark.createDataFrame([(i, "some words here", f"lang{i}", "s", 0) for i in range(40)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    with pytest.raises(ValueError, match="languages"):
        langid.training_rows(df, langid.Training(most_labels=10))
    assert langid.training_rows(df, langid.Training(longest=5)) == []


def test_predictions_of_a_fixed_model_are_those_of_a_plain_chain(spark):
    """Whole texts of the smallest table: word by word, message by message, without chunks or batches."""
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in df.collect()]
    model = langid.train(langid.training_rows(df, langid.Training(per_label=20)), langid.Training(rounds=8))
    found = {r.doc_id: r for r in langid.predict(df, model).collect()}
    moves, known = np.exp(model.moves.astype(float)), {}

    def word_scores(word):
        if word not in known:
            score = model.weights[model.features([word])[0]].astype(float).sum(axis=0)
            known[word] = np.exp(score - score.max())
        return known[word]

    for doc, text in rows:
        words, run = [], ""
        for c in (text or "").lower() + " ":
            if c.isalpha() and len(run) < 40:
                run += c
            else:
                words += [run] * bool(run)
                run = c if c.isalpha() else ""
        if not words:
            assert (found[doc].lang_pred, found[doc].score) == ("und", 0.0)
            continue
        emit = [word_scores(w) for w in words]
        ahead = [np.ones(len(model.labels)) @ moves * emit[0]]
        for e in emit[1:]:
            ahead.append(ahead[-1] / ahead[-1].sum() @ moves * e)
        behind, total = np.ones(len(model.labels)), np.zeros(len(model.labels))
        for a, e in zip(reversed(ahead), reversed(emit)):
            total += a * behind / (a * behind).sum()
            behind = moves @ (e * behind)
            behind /= behind.sum()
        mean = total / len(words)
        assert found[doc].lang_pred == model.labels[int(mean.argmax())]
        assert found[doc].score == pytest.approx(mean.max(), abs=1e-7)
