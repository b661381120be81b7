from __future__ import annotations

import hashlib
import zlib

import brute
import numpy as np
import pytest

from passagework.llm import media


def filtered(samples, kinds):
    out = np.zeros((len(samples), samples.shape[1] + 1), np.uint8)
    for i, k in enumerate(kinds):
        out[i, 0] = k
        for x in range(samples.shape[1]):
            a = int(samples[i, x - 1]) if x else 0
            b = int(samples[i - 1, x]) if i else 0
            c = int(samples[i - 1, x - 1]) if i and x else 0
            near = min((abs(b - c), 0, a), (abs(a - c), 1, b), (abs(a + b - 2 * c), 2, c))[2]
            out[i, x + 1] = (int(samples[i, x]) - [0, a, b, (a + b) // 2, near][k]) & 255
    return out


@pytest.mark.parametrize("kinds", [(0, 2), (0, 1, 2, 3, 4), (3,), (4,), (2,), (1,)])
def test_unfilter_undoes_every_filter(kinds):
    rng = np.random.default_rng(1)
    for _ in range(10):
        samples = rng.integers(0, 256, (int(rng.integers(1, 40)), 16), dtype=np.uint8)
        assert (media.unfilter(filtered(samples, rng.choice(kinds, len(samples)))) == samples).all()


def test_damage_is_noticed():
    stored = media.write_png(np.arange(640, dtype=np.uint8).reshape(10, 64))
    for i in range(8, len(stored)):
        with pytest.raises(media.MediaError):
            media.read_png(stored[:i] + bytes([stored[i] ^ 1]) + stored[i + 1 :])
    with pytest.raises(media.MediaError):
        media.read_png(stored[:-20])


def test_payloads_come_back(spark):
    rows = brute.awkward_documents() + [(80, "x" * 64, "en", "a", 64), (81, "x" * 65, "en", "a", 65)]
    df = spark.createDataFrame(rows, brute.DOCUMENTS)
    got = brute.in_order(media.read_media(media.store_texts(df)).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32").collect())
    want = []
    for r in rows:
        text = (r[1] or "").encode()
        payload = text + b"\0" * (max(64, -(-len(text) // 64) * 64) - len(text))
        want.append((r[0], len(text), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:])))
    assert got == brute.in_order(want)


def test_stored_form_and_feature(spark):
    df = spark.createDataFrame([(1, "abc " * 500), (2, "abc " * 500), (3, "abc " * 499 + "abd "), (4, "".join(chr(33 + i * i % 90) for i in range(2000)))], "doc_id bigint, text string")
    stored = {r.doc_id: bytes(r.media) for r in media.store_texts(df).collect()}
    rows = {r.doc_id: r for r in media.read_media(media.store_texts(df)).collect()}
    for i, r in rows.items():
        assert (r.media_bytes, r.media_sha256) == (len(stored[i]), hashlib.sha256(stored[i]).hexdigest())
    assert rows[1].feature == rows[2].feature != rows[4].feature and len(rows[1].feature) == 16
    assert media.store_texts(df.limit(0)).count() == 0


def test_cosine_transform_matches_its_sum():
    rng = np.random.default_rng(2)
    x = rng.random((media.SIDE, media.SIDE))
    low = media._COSINES @ x @ media._COSINES.T
    n = media.SIDE
    for u, v in ((0, 0), (1, 0), (3, 5)):
        want = sum(x[i, j] * np.cos(np.pi * u * (2 * i + 1) / (2 * n)) * np.cos(np.pi * v * (2 * j + 1) / (2 * n)) for i in range(n) for j in range(n))
        assert low[u, v] == pytest.approx(want * (1 / n if u == v == 0 else 2 / n if u and v else np.sqrt(2) / n))
