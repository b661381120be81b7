from __future__ import annotations

from itertools import count

import brute
import corpus_pipeline
import pytest
import sentencepiece

from passagework.llm import mixing, quality, queries, shared


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, out[-1], "/root/testdata/sf0.001").write.parquet(f"{folder}/{name}")
        out.append(spark.read.parquet(f"{folder}/{name}"))
    return out


def rows(df):
    return [tuple(r) for r in df.select("doc_id", "text", "lang", "source").collect()]


def test_each_stage_on_its_own_input(stages):
    docs, clean, unique, cut, mixed, ids = stages
    for df in (clean, unique, cut, mixed):
        assert df.columns == docs.columns
    good = {r[0] for r in rows(docs) if not brute.quality(r[1])[-1]}
    left = {r[0] for r in rows(clean)}
    assert left <= good and left == {r.doc_id for r in quality.judged(docs).where("kept").collect()}
    want = {*brute.near_copies(rows(clean)).values()}
    assert {r[0] for r in rows(unique)} == want and unique.count() == len(want)
    digests = {d: (n, gone, sha) for d, n, gone, sha in brute.remove_repeats(rows(unique))}
    original = {r[0]: r[1] for r in rows(unique)}
    for doc, text, *_ in rows(cut):
        assert brute.sha(" ".join(brute.WORDS.findall(text))) == digests[doc][2]
        assert digests[doc][1] or text == original[doc]
    assert {r[0] for r in rows(cut)} == {d for d, (n, gone, _) in digests.items() if gone < n or n == 0}
    taken = {r.doc_id: r.taken for r in mixing.mix_documents(cut).collect() if r.taken}
    got: dict[int, int] = {}
    for doc, text, *_ in rows(mixed):
        got[doc] = got.get(doc, 0) + len(brute.WORDS.findall(text))
    assert got == taken
    library = sentencepiece.SentencePieceProcessor(model_file=queries.tokenizer_path())
    assert brute.in_order((r.doc_id, tuple(r.ids)) for r in ids.collect()) == brute.in_order((d, tuple(library.encode(t))) for d, t, *_ in rows(mixed))


def test_run_gives_the_last_stage(spark, stages):
    found = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert brute.in_order(found.select("doc_id", "ids_sha256").collect()) == brute.in_order(stages[-1].select("doc_id", "ids_sha256").collect())


def test_registered_and_importable():
    import __spark_entry__ as entry

    names = entry.queries()
    assert "pipeline" in names and sum(n.startswith("op") for n in names) >= 10


def test_empty_documents(spark):
    docs = spark.createDataFrame([], brute.DOCUMENTS)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "")
    assert docs.count() == 0


def test_run_leaves_only_its_result(spark, tmp_path, monkeypatch):
    numbers = count()
    monkeypatch.setattr(shared, "fresh_path", lambda _, name: f"file://{tmp_path}/{name}-{next(numbers)}")
    found = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert [p.name.rsplit("-", 1)[0] for p in tmp_path.iterdir()] == ["sentencepiece_ids"]
    assert found.count() > 0
