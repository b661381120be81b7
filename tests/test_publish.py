from __future__ import annotations

import hashlib
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from passagework import registry as R
from passagework import schemas
from passagework.errors import ChunkError, VectorIndexError
from passagework.operators import embedding
from passagework.plans import build_index
from passagework.sources import stores


def marking(folder: str) -> embedding.HashingEmbedder:
    """One that leaves a file for each text that it is asked for, and has no direction for blanks."""

    class Marking(embedding.HashingEmbedder):
        def embed(self, texts):
            for text in texts:
                name = hashlib.sha256(text.encode()).hexdigest()
                open(f"{folder}/{name}-{sum(f.startswith(name) for f in os.listdir(folder))}", "x").close()
            return embedding.HashingEmbedder.embed(self, texts) * all("blank" not in t for t in texts)

    return Marking(16)


@pytest.fixture
def parts(spark):
    reg = R.registry(spark)
    blocks = spark.createDataFrame([(d.document_id, i, "list_item", f"text {i} {d.document_id}", None, None) for d in R.REGISTRY for i in range(3)], schemas.BLOCKS)
    return blocks, reg, reg.select("document_id", F.lit("2024-01-01").alias("retrieval_date"))


def test_many_documents_share_folders_and_each_text_is_embedded_once(spark, parts, tmp_path, monkeypatch):
    """F2: a folder for each page made a store of 0.1 GB take minutes."""
    asked, path = tmp_path / "asked", f"file://{tmp_path}/index"
    asked.mkdir()
    build_index.publish(*parts, marking(str(asked)), path)
    assert len([f for f in os.listdir(asked)]) == 21 and all(f.endswith("-0") for f in os.listdir(asked))
    single = sorted(map(tuple, stores.open_index(spark, path).select("chunk_id", "document_id", "text", "ordinal", "embedding").collect()))
    assert len([f for f in os.listdir(tmp_path / "index") if f.startswith("document_id=")]) == 7
    monkeypatch.setattr(stores, "DOCUMENT_FOLDERS", 6)
    monkeypatch.setattr(stores, "DOCUMENT_BUCKETS", 2)
    build_index.publish(*parts, embedding.HashingEmbedder(16), path)
    assert {f for f in os.listdir(tmp_path / "index") if "=" in f} <= {"document_bucket=0", "document_bucket=1"}
    store = stores.open_index(spark, path)
    assert sorted(map(tuple, store.select("chunk_id", "document_id", "text", "ordinal", "embedding").collect())) == single and "document_bucket" not in store.columns
    one = stores.open_index(spark, path, "fsa-chill")
    assert sorted(r.chunk_id for r in one.collect()) == ["fsa-chill:0", "fsa-chill:1", "fsa-chill:2"]
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "document_bucket" in plan.split("PartitionFilters")[1][:120] and "EqualTo(document_id,fsa-chill)" in plan
    assert sorted(f for f in os.listdir(tmp_path) if not f.startswith(".")) == ["asked", "index"]


def test_a_store_that_fails_its_checks_is_not_put_in_place(spark, parts, tmp_path):
    blocks, reg, dates = parts
    (tmp_path / "asked").mkdir()
    model, path = marking(str(tmp_path / "asked")), f"file://{tmp_path}/index"
    build_index.publish(blocks, reg, dates, model, path)
    with pytest.raises(VectorIndexError, match="norm is zero"):
        build_index.publish(blocks.withColumn("text", F.lit("blank")), reg, dates, model, path)
    with pytest.raises(VectorIndexError, match="expected 5"):
        stores.write_index(stores.open_index(spark, path), f"{path}2", 5)
    assert stores.open_index(spark, path).count() == 21 and stores.open_index(spark, path).where("text = 'blank'").count() == 0
    assert sorted(f for f in os.listdir(tmp_path) if not f.startswith(".")) == ["asked", "index"]


def test_embedded_texts_are_sums_of_signed_features():
    def plain(text, dimension):
        row, words = np.zeros(dimension), text.casefold().split()
        for feature, weight in [*((w, 1.0) for w in words), *((f"{a} {b}", 0.5) for a, b in zip(words, words[1:]))]:
            h = int.from_bytes(hashlib.blake2b(feature.encode(), digest_size=8).digest(), "little")
            row[h % dimension] += weight if h >> 63 else -weight
        return row

    texts = ["", " ", "One", "one two Straße one two", "a " * 500]
    assert np.array_equal(embedding.HashingEmbedder(24).embed(texts), np.array([plain(t, 24) for t in texts]))


def test_documents_that_cannot_be_cut_are_left_out_if_asked(spark, parts, tmp_path):
    blocks, reg, dates = parts
    long = spark.createDataFrame([("fsa-chill", 9, "paragraph", "word " * 300, None, None)], schemas.BLOCKS)
    path = f"file://{tmp_path}/index"
    manifest = build_index.publish(blocks.unionByName(long), reg, dates, embedding.HashingEmbedder(16), path, without_uncut=True)
    assert manifest.first().chunk_count == 18 and stores.open_index(spark, path).where("document_id = 'fsa-chill'").count() == 0
    with pytest.raises(ChunkError, match="no sentence boundary"):
        build_index.publish(blocks.unionByName(long), reg, dates, embedding.HashingEmbedder(16), path)
