from __future__ import annotations

import json
import random
import re

import numpy as np
import plain_outline
import pytest
from pyspark.sql import functions as F

from passagework import registry as R
from passagework import schemas
from passagework.config import EngineConfig
from passagework.errors import ChunkError, EmptyMessageError, FetchError, RetrievalError, UnknownDocumentError, VectorIndexError
from passagework.functions import text as T
from passagework.operators import chunking, claims, embedding, generation, guard, html_blocks, indexing, layout, responses, retrieval
from passagework.plans import answer, build_index
from passagework.sources import fetch, stores


@pytest.fixture(scope="module")
def reg(spark):
    return R.registry(spark).persist()


def one(spark, column, *values):
    names = [f"v{i}" for i in range(len(values))]
    return spark.createDataFrame([values], ", ".join(f"{n} string" for n in names)).select(column(*map(F.col, names)).alias("x")).first().x


# Text

def test_token_estimate_rounds_halves_to_even(spark):
    rows = spark.range(0, 20000).select("id", T.estimate(F.col("id")).alias("t")).collect()
    assert all(r.t == round(r.id * 1.3) for r in rows)


@pytest.mark.parametrize("n, over", [(153, False), (154, False), (155, True)])
def test_target_boundary(spark, n, over):
    assert (one(spark, T.estimate_tokens, "w " * n) > 200) is over


def test_registry_is_sound(reg):
    assert R.violations(reg).count() == 0 and reg.count() == 7


# HTML

PAGE = """<html><body><nav><p>navigation text that is long enough to be a paragraph</p></nav><main>
<div class="x gem-c-feedback y"><p>feedback text that is long enough to be a paragraph here</p></div>
<h1>How to chill food safely</h1><p>Keep cold food cold; this paragraph is long enough to be kept.</p><p>Too short.</p>
<h2>Storage</h2><ol start="3"><li>wash hands</li><li>4. dry hands<ul><li>with a <b>clean</b> towel</li></ul></li></ol>
<h3>Detail</h3><table><thead><tr><th>Food</th><th colspan="2">Time</th></tr><tr><th></th><th>Fridge</th><th>Freezer</th></tr></thead>
<tr><td rowspan="2">Ham</td><td>3 days</td><td>1 | 2 months</td></tr><tr><td>4 days</td><td></td></tr></table>
<h2>Licence</h2><p>All content is available under the Open Government Licence version three.</p><h4>dropped</h4>bare text
<p>An unclosed paragraph holds <b>what follows it<p>even another paragraph that was opened in it</div></main></body></html>"""


def test_html_page(spark):
    df = spark.createDataFrame([("a", "Doc", PAGE), ("b", "Doc", None), ("c", "Doc", "")], "document_id string, document_name string, html string")
    rows = html_blocks.html_blocks(df).orderBy("block_no").collect()
    assert {r.document_id for r in rows} == {"a"} and [r.block_no for r in rows] == list(range(len(rows)))
    assert [(r.type, r.text) for r in rows] == [
        ("heading", "How to chill food safely"),
        ("paragraph", "Keep cold food cold; this paragraph is long enough to be kept."),
        ("heading", "Storage"),
        ("list_item", "3. wash hands"),
        ("list_item", "4. dry hands"),
        ("list_item", "with a clean towel"),
        ("heading", "Detail"),
        ("table", "| Food | Time Fridge | Time Freezer |\n| --- | --- | --- |\n| Ham | 3 days | 1 \\| 2 months |\n| Ham | 4 days |  |"),
        ("heading", "Licence"),
        ("paragraph", "An unclosed paragraph holds what follows it even another paragraph that was opened in it"),
    ]
    assert rows[7].heading_path == ["Doc", "How to chill food safely", "Storage", "Detail"] and rows[7].header == ["Food", "Time Fridge", "Time Freezer"]
    assert rows[8].heading_path == ["Doc", "How to chill food safely", "Licence"]
    assert sorted(r.document_id for r in html_blocks.without_content(html_blocks.html_blocks(df), df).collect()) == ["b", "c"]


def test_heading_like_the_title_restarts_the_path(spark):
    html = "<h1>Part</h1><h2>Healthy diet fact</h2><h1>HEALTHY DIET (Fact sheet).</h1><h3>Deep</h3>"
    rows = html_blocks.blocks(html, "Healthy diet (Fact sheet)")
    assert [r["heading_path"] for r in rows] == [["Healthy diet (Fact sheet)", "Part"], ["Healthy diet (Fact sheet)", "Part", "Healthy diet fact"], ["Healthy diet (Fact sheet)", "Deep"]]


def test_deep_nesting_does_not_recurse():
    assert html_blocks.blocks("<div>" * 5000 + "<p>" + "word " * 12, "t")[0]["text"] == ("word " * 12).strip()


# Chunking

def plain_chunks(blocks, target=200):
    """The packing rules, one block after the other."""
    out, pack, words = [], [], 0

    def flush():
        nonlocal pack, words
        if pack:
            out.append(("paragraph", " ".join(pack)))
        pack, words = [], 0

    path = None
    for kind, text, heading in blocks:
        n = len(text.split())
        if kind == "paragraph":
            if not text.strip() or (text.count("_") > sum(c.isalnum() for c in text)):
                continue
            if round(n * 1.3) > target:
                flush()
                parts = [s.strip() for s in re.split(r'(?<=[.!?])\s+(?=[A-Z"“])', text.strip()) if s.strip()]
                held = []
                for s in parts:
                    if held and round(len(" ".join([*held, s]).split()) * 1.3) > target:
                        out.append(("paragraph", " ".join(held)))
                        held = []
                    held.append(s)
                out.append(("paragraph", " ".join(held)))
                continue
            if pack and (path != heading or round((words + n) * 1.3) > target):
                flush()
            path = heading
            pack.append(text.strip())
            words += n
            continue
        flush()
        if kind == "list_item" and text.strip():
            out.append((kind, text))
    flush()
    return [(k, " ".join(t.split())) for k, t in out]


def test_packing_matches_plain_rules(spark):
    random.seed(8)
    for trial in range(6):
        blocks = []
        for _ in range(120):
            kind = random.choices(["paragraph", "list_item", "heading"], [8, 1, 1])[0]
            text = random.choice(["", "____ a", "  x y ", " ".join(["word"] * random.randint(1, 154)), " ".join("Aa bb cc dd." for _ in range(random.randint(1, 90)))])
            blocks.append((kind, text if kind != "heading" else "Head", random.choice([["a"], ["a", "b"]])))
        df = spark.createDataFrame([("d", i, k, t, h, None) for i, (k, t, h) in enumerate(blocks)], schemas.BLOCKS).repartition(5)
        rows = chunking.numbered(chunking.pieces(df)).orderBy("ordinal").collect()
        assert [(r.block_type, r.text) for r in rows] == plain_chunks(blocks)
        assert [r.chunk_id for r in rows] == [f"d:{i}" for i in range(len(rows))]


def block(i, kind, text, path=("a",), header=None, doc="eatwell-guide"):
    return (doc, i, kind, text, list(path), header)


def dates(spark):
    return spark.createDataFrame([(d.document_id, "2024-01-02") for d in R.REGISTRY], "document_id string, retrieval_date string")


def test_chunks_carry_registry_fields(spark, reg):
    df = spark.createDataFrame([block(0, "heading", "H"), block(1, "list_item", "an\n item"), block(2, "table", "| F | T |\n| --- | --- |\n| ham | 3 |\n| F | T |\n|  | 4 |", (), ["F", "T"])], schemas.BLOCKS)
    rows = chunking.chunk_blocks(df, reg, dates(spark)).orderBy("ordinal").collect()
    assert [(r.chunk_id, r.block_type, r.text, r.section_heading) for r in rows] == [
        ("eatwell-guide:0", "list_item", "an item", "a"), ("eatwell-guide:1", "table_row", "F: ham | T: 3", "The Eatwell Guide booklet"), ("eatwell-guide:2", "table_row", "F: ham | T: 4", "The Eatwell Guide booklet")]
    assert rows[0].embed_text == "The Eatwell Guide booklet — a\nan item" and rows[0].year == 2018
    assert sorted(r.document_id for r in chunking.uncovered(chunking.chunk_blocks(df, reg, dates(spark)), reg).collect()) == sorted(d.document_id for d in R.REGISTRY if d.document_id != "eatwell-guide")


@pytest.mark.parametrize("bad, message", [(block(0, "paragraph", "w " * 200), "sentence boundary"), (block(0, "mystery", "x"), "unknown block type"), (block(0, "list_item", "x", doc="nowhere"), "not in the registry")])
def test_violations_stop_chunking(spark, reg, bad, message):
    with pytest.raises(ChunkError, match=message):
        chunking.chunk_blocks(spark.createDataFrame([bad], schemas.BLOCKS), reg, dates(spark))


# Layout

def test_layout_document(spark):
    body = "This is a body paragraph of the page that is clearly long enough to stay, with many words in it so that the page counts."
    boxes, lines = [], []

    def put(page, no, x0, y0, x1, text, size=11.0, bold=0):
        boxes.append(("d", page, no, x0, y0, x1, y0 + 20, text))
        lines.append(("d", page, x0, y0, x1, y0 + 20, size, len(text), bold * len(text), False))

    for page in range(3):
        put(page, 0, 50.0, 10.0, 500.0, "Repeated running head")
        put(page, 1, 50.0, 60.0, 500.0, "Safe storage" if page == 0 else "References" if page == 1 else "After that", 18.0)
        put(page, 2, 50.0, 100.0, 500.0, body)
        put(page, 3, 50.0, 140.0, 500.0, "• keep it cold always\n• keep it clean always")
        put(page, 4, 50.0, 180.0, 500.0, body + " Again.")
        put(page, 5, 50.0, 300.0, 500.0, "covered by the table and therefore not text")
        put(page, 6, 50.0, 800.0, 500.0, str(page + 1))
    schema = "document_id string, page int, box_no int, x0 double, y0 double, x1 double, y1 double, text string"
    sheets = spark.createDataFrame([("d", p, 600.0, 842.0) for p in range(3)], "document_id string, page int, width double, height double")
    grids = spark.createDataFrame([("d", 0, 0, 50.0, 295.0, 500.0, 330.0, [["Food", "Days"], ["Ham", "3"], ["Egg", "9"]])], "document_id string, page int, table_no int, x0 double, y0 double, x1 double, y1 double, cells array<array<string>>")
    found = layout.layout_blocks(
        spark.createDataFrame(boxes, schema),
        spark.createDataFrame(lines, "document_id string, page int, x0 double, y0 double, x1 double, y1 double, size double, chars int, bold_chars int, dingbat boolean"),
        sheets, grids, spark.createDataFrame([("d", "Title")], "document_id string, document_name string"),
    ).orderBy("block_no").collect()
    page = [("paragraph", body), ("list_item", "keep it cold always"), ("list_item", "keep it clean always"), ("paragraph", body + " Again.")]
    assert [(r.type, r.text) for r in found] == [("heading", "Safe storage"), *page, ("table", "| Food | Days |\n| --- | --- |\n| Ham | 3 |\n| Egg | 9 |"), ("heading", "After that"), *page, ("paragraph", "covered by the table and therefore not text")]
    assert found[1].heading_path == ["Title", "Safe storage"] and found[-1].heading_path == ["Title", "After that"]


def test_folds_merge_fragments_and_continuations():
    item = {"type": "list_item", "text": "Wash", "heading_path": ["t"], "header": None}
    assert plain_outline.joined([item, {**item, "type": "paragraph", "text": "hands"}, {**item, "type": "paragraph", "text": "(well)"}, {**item, "type": "paragraph", "text": "Next"}])[0]["text"] == "Wash hands (well)"
    head = {"type": "heading", "text": "Safe", "heading_path": ["t", "Safe"], "header": None}
    merged = plain_outline.joined([head, {**head, "text": "food"}, {**head, "text": "storage"}])
    assert [(r["text"], r["heading_path"]) for r in merged] == [("Safe food storage", ["t", "Safe food storage"])]
    events = [{"page": 0, "kind": "cap", "text": "K", "level": 0}, {"page": 0, "kind": "paragraph", "text": "eep the cold chain unbroken at all times, please.", "level": 3}]
    assert plain_outline.fold_document(events, "t")[0]["text"].startswith("Keep the cold")


# Retrieval

def vector(cosine, dim=16):
    v = np.zeros(dim)
    v[0], v[1] = cosine, np.sqrt(1 - cosine**2)
    return v.tolist()


def index(spark, rows):
    order = {d.document_id: i for i, d in enumerate(R.REGISTRY)}
    return spark.createDataFrame([(c, d, order[d], vector(s)) for c, d, s in rows], "chunk_id string, document_id string, ordinal int, embedding array<double>")


def question(spark, scope=None):
    return spark.createDataFrame([(1, scope, vector(1.0))], "query_id bigint, scope_id string, embedding array<double>")


def test_cap_limit_and_order(spark):
    ids = [d.document_id for d in R.REGISTRY]
    rows = [(f"{ids[0]}:{i}", ids[0], 0.9 - i * 0.001) for i in range(5)] + [(f"{d}:{i}", d, 0.8 - i * 0.001) for d in ids[1:4] for i in range(3)] + [(f"{ids[5]}:0", ids[5], 0.61)]
    hits = retrieval.retrieve(index(spark, rows).repartition(7), question(spark)).orderBy("rank").collect()
    assert [h.chunk_id for h in hits] == [f"{ids[0]}:0", f"{ids[0]}:1", f"{ids[0]}:2", f"{ids[1]}:0", f"{ids[2]}:0", f"{ids[3]}:0", f"{ids[1]}:1", f"{ids[2]}:1"]
    scoped = retrieval.retrieve(index(spark, rows), question(spark, ids[0])).orderBy("rank").collect()
    assert [h.chunk_id for h in scoped] == [f"{ids[0]}:{i}" for i in range(5)]


def test_ties_are_settled_by_registry_and_text_of_the_id(spark):
    rows = [("eatwell-guide:2", "eatwell-guide", 0.7), ("eatwell-guide:10", "eatwell-guide", 0.7), ("cold-food-storage:9", "cold-food-storage", 0.7), ("kitchen-companion:1", "kitchen-companion", 0.7000004)]
    hits = retrieval.retrieve(index(spark, rows), question(spark)).orderBy("rank").collect()
    assert [h.chunk_id for h in hits] == ["cold-food-storage:9", "eatwell-guide:10", "eatwell-guide:2", "kitchen-companion:1"]


def test_candidates_are_cut_before_the_threshold(spark):
    rows = [(f"eatwell-guide:{i:03d}", "eatwell-guide", 0.9) for i in range(30)] + [("fsa-chill:0", "fsa-chill", 0.8)]
    found = retrieval.candidates(index(spark, rows).repartition(5), question(spark))
    assert found.count() == 24 and [h.chunk_id for h in retrieval.kept(found).collect()] == ["eatwell-guide:000", "eatwell-guide:001", "eatwell-guide:002"]


def many(spark, n=200, scopes=(None,)):
    rng = np.random.default_rng(0)
    docs = [d.document_id for d in R.REGISTRY]
    rows = [(f"{docs[i % 7]}:{i}", docs[i % 7], i % 7, np.round(rng.normal(size=8), 1).tolist()) for i in range(n)]
    idx = spark.createDataFrame(rows, "chunk_id string, document_id string, ordinal int, embedding array<double>")
    qs = spark.createDataFrame([(i, scopes[i % len(scopes)], rng.normal(size=8).tolist()) for i in range(20)], "query_id bigint, scope_id string, embedding array<double>")
    return idx, qs


def by_hand(idx, qs, k):
    out = []
    for q in qs.collect():
        a = np.array(q.embedding)
        scored = [(-round(float(a @ np.array(r.embedding) / np.linalg.norm(a) / np.linalg.norm(r.embedding)), 6), r.ordinal, r.chunk_id) for r in idx.collect() if q.scope_id in (None, r.document_id)]
        out += [(q.query_id, i + 1, x[2]) for i, x in enumerate(sorted(scored)[:k])]
    return sorted(out)


@pytest.mark.parametrize("scopes", [(None,), ("fsa-chill", "eatwell-guide"), (None, "fsa-chill", "no such document")])
@pytest.mark.parametrize("at_once", [2048, 3])
def test_questions_in_any_number_give_the_same(spark, monkeypatch, scopes, at_once):
    monkeypatch.setattr(retrieval, "QUERIES_AT_ONCE", at_once)
    idx, qs = many(spark, scopes=scopes)
    for parts in (1, 7):
        assert sorted((r.query_id, r.place, r.chunk_id) for r in retrieval.nearest(idx.repartition(parts), qs, 5).collect()) == by_hand(idx, qs, 5)


def test_a_task_passes_on_k_rows_per_question(spark):
    """However many batches it reads, and with all similarities tied."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        idx, qs = many(spark, 4000)
        rows = idx.select("embedding", "chunk_id", "document_id", "ordinal").coalesce(1)
        found = retrieval._in_place(rows, ["chunk_id", "document_id", "ordinal"], qs.collect(), 5)
        assert found.groupBy("_q").count().where("count <> 5").count() == 0 and found.count() == 20 * 5
        tied = rows.withColumn("embedding", F.array(*[F.lit(1.0)] * 8))
        assert retrieval._in_place(tied, ["chunk_id", "document_id", "ordinal"], qs.collect(), 5).count() == 20 * 5
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_scoped_questions_read_their_documents_alone(spark, tmp_path):
    idx, qs = many(spark, scopes=("fsa-chill",))
    stores.write_index(idx, f"{tmp_path}/index")
    found = retrieval.nearest(stores.open_index(spark, f"{tmp_path}/index"), qs, 5)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(document_id" in plan and "fsa-chill" in plan.split("PartitionFilters")[1][:120]
    assert sorted((r.query_id, r.place, r.chunk_id) for r in found.collect()) == by_hand(idx, qs, 5)


def test_rows_without_a_vector_find_nothing(spark):
    idx, qs = many(spark, 10)
    bare = idx.withColumn("embedding", F.lit(None).cast("array<double>"))
    assert retrieval.nearest(idx.unionByName(bare), qs, 99).count() == 200
    assert retrieval.nearest(bare, qs, 5).count() == 0 and retrieval.nearest(idx, qs.limit(0), 5).count() == 0


def test_damaged_index_stops(spark, reg):
    with pytest.raises(RetrievalError):
        idx = index(spark, [("a:1", "eatwell-guide", 0.9)]).withColumns({c: F.lit(None).cast("string") for c in ("text", *schemas.METADATA) if c != "document_id"})
        retrieval.retrieve(idx, question(spark), registry=reg)


# Guard

def test_bad_questions_stop(spark, reg):
    schema = "query_id bigint, message string, document_id string"
    with pytest.raises(EmptyMessageError):
        guard.classify(spark.createDataFrame([(1, " \n", None)], schema), reg)
    with pytest.raises(UnknownDocumentError):
        guard.classify(spark.createDataFrame([(1, "x", "nowhere")], schema), reg)


@pytest.mark.parametrize("message, reason", [("I’m pregnant. Can I eat soft cheese?", "medical"), ("I WEIGH about 70", "weight_target"), ("Is protein in 100g of tofu high?", "nutrient_lookup"), ("fat in 10% of energy", None), ("éweigh too much", None), ("weight of a whole chicken", None)])
def test_reasons(spark, message, reason):
    assert one(spark, guard.scope_reason, message) == reason


# The whole plan

def plan(spark, reg, generator, messages, **changes):
    calls = []

    def recording(asked):
        calls.extend(asked.select("query_id", "attempt", "prompt").collect())
        return generator(asked)

    idx = index(spark, [("eatwell-guide:1", "eatwell-guide", 0.9), ("eatwell-guide:2", "eatwell-guide", 0.5), ("fsa-chill:0", "fsa-chill", 0.8)])
    idx = idx.join(reg.select("document_id", "document_name", "publisher", "year", "source_url"), "document_id").withColumns({"text": F.concat(F.lit("Eat 5 portions of fruit, says "), "chunk_id"), "section_heading": F.lit("Fruit"), "block_type": F.lit("paragraph"), "retrieval_date": F.lit("2024")})
    qs = spark.createDataFrame([(i, m, d, vector(c)) for i, (m, d, c) in enumerate(messages)], "query_id bigint, message string, document_id string, embedding array<double>")
    rows = {r.query_id: r for r in answer.answer_batch(qs, idx, reg, recording, EngineConfig(**changes)).collect()}
    return rows, calls


def test_each_question_gets_its_reply_and_only_needed_calls_are_made(spark, reg):
    generator = generation.model_generator(generation.extract)
    rows, calls = plan(spark, reg, generator, [("my weight", None, 1.0), ("fruit?", None, 1.0), ("fruit?", "kitchen-companion", 1.0), ("Eatwell Guide on fruit", None, 1.0)])
    assert {c.query_id for c in calls} == {1, 3}
    assert [rows[i].type for i in range(4)] == ["out_of_scope", "answer", "not_in_corpus", "answer"]
    assert [s.document_id for s in rows[1].sections] == ["eatwell-guide", "fsa-chill"] and rows[3].document_scope == "eatwell-guide"
    body = json.loads(rows[1].response)
    assert set(body) == {"type", "sections", "searched"} and len(body["searched"]) == 7 and body["sections"][0]["source_url"] == R.REGISTRY[4].source_url
    refused = json.loads(rows[0].response)
    assert refused == {"type": "out_of_scope", "reason": "weight_target", "message": responses.REFERRAL, "sections": [], "searched": []}
    missed = json.loads(rows[2].response)
    assert missed["reason"] == "no_supporting_chunks" and [d["document_id"] for d in missed["searched"]] == ["kitchen-companion"]
    spark.catalog.clearCache()


def test_failed_and_malformed_generation(spark, reg):
    drafts = spark.createDataFrame([(1, 1, "prose"), (1, 2, '{"documents": []}'), (2, 1, "prose"), (2, 2, "prose")], "query_id bigint, attempt int, raw string")
    rows, calls = plan(spark, reg, generation.table_generator(drafts), [("a", None, 1.0), ("b", None, 1.0), ("c", None, 1.0)])
    assert [(rows[i].type, rows[i].reason) for i in range(3)] == [("generation_unavailable", "model_error"), ("not_in_corpus", "no_surviving_claims"), ("generation_unavailable", "model_error")]
    assert sorted({(c.query_id, c.attempt) for c in calls}) == [(0, 1), (1, 1), (1, 2), (2, 1), (2, 2)]
    spark.catalog.clearCache()


def test_numbers_need_no_neighbouring_digit(spark):
    for claim, support, ok in (("1 day", "1.5 days", True), ("10 days", "100 days", False), ("1.5", "1x5", False), ("no number", "", True), ("2018", "in 2018.", True)):
        assert one(spark, claims.numbers_supported, claim, support) is ok


# Index

def test_publish_checks_and_skips(spark, reg, tmp_path):
    blocks = spark.createDataFrame([block(i, "list_item", f"text {d.document_id}", doc=d.document_id) for i, d in enumerate(R.REGISTRY)], schemas.BLOCKS)
    model = embedding.HashingEmbedder(32)
    path = f"file://{tmp_path}/index"
    manifest = build_index.publish(blocks, reg, dates(spark), model, path)
    first = manifest.first()
    assert first.chunk_count == 7 and first.dimension == 32 and stores.open_index(spark, path).count() == 7
    assert build_index.publish(blocks, reg, dates(spark), model, path, current=manifest) is manifest
    with pytest.raises(VectorIndexError, match="cover every registry document"):
        build_index.publish(blocks.where("document_id <> 'fsa-chill'"), reg, dates(spark), model, path)
    long = blocks.withColumn("text", F.when(F.col("document_id") == "fsa-chill", F.repeat(F.lit("w "), 600)).otherwise(F.col("text")))
    with pytest.raises(VectorIndexError, match="not truncated"):
        build_index.publish(long, reg, dates(spark), model, path)
    assert stores.open_index(spark, path, "fsa-chill").count() == 1
    looked = {r.chunk_id: r.found for r in stores.lookup(stores.open_index(spark, path), spark.createDataFrame([("fsa-chill:0",), ("x",)], "chunk_id string")).collect()}
    assert looked == {"fsa-chill:0": True, "x": False}


def test_zero_vectors_have_no_direction(spark):
    df = spark.createDataFrame([("a", [0.0, 0.0]), ("b", [3.0, 4.0])], "chunk_id string, embedding array<double>")
    assert {r.chunk_id: (r.norm, r.embedding) for r in indexing.normalized(df).collect()} == {"a": (0.0, None), "b": (5.0, [0.6, 0.8])}


# Sources

def test_manifest_round_trip_and_swap(spark, reg, tmp_path):
    path = f"file://{tmp_path}/manifest"
    rows = reg.select("ordinal", "document_id", "document_name", "publisher", "year", "source_url", *[F.lit(None).cast("int" if c == "http_status" else "string").alias(c) for c in ("downloaded_url", "retrieval_date", "sha256", "http_status", "content_type")], F.lit("ok").alias("status"), F.lit("f").alias("file"), F.lit(None).cast("string").alias("error"))
    for _ in range(2):
        stores.write_manifest(rows, path)
        back = stores.read_manifest(spark, path)
        assert [r.document_id for r in back.collect()] == [d.document_id for d in R.REGISTRY]
    assert stores.scan_corpus(reg, back).count() == 7
    assert not [p for p in tmp_path.iterdir() if "partial" in p.name or "previous" in p.name]


def test_fetch_follows_landing_pages_and_keeps_errors(spark):
    def get(url):
        if url.endswith("/land"):
            return b'<html lang="en"><a href="x_fre.pdf">Fr</a><a href="/y.pdf">Download</a></html>', 200, "text/html", url
        if url.endswith("y.pdf"):
            return b"%PDF-1.7", 200, "application/pdf", url
        if url.endswith("gone"):
            return b"", 404, "", url
        raise OSError("no route")

    docs = spark.createDataFrame([("a", "http://h/land", True), ("b", "http://h/gone", False), ("c", "http://h/down", False)], "document_id string, source_url string, landing_page boolean")
    rows = {r.document_id: r for r in fetch.fetch(docs, get).collect()}
    assert bytes(rows["a"].body) == b"%PDF-1.7" and rows["a"].final_url == "http://h/y.pdf"
    assert rows["b"].error == "HTTP 404" and rows["c"].error == "no route"
    with pytest.raises(FetchError):
        fetch.stop_on_failure(spark.createDataFrame([(0, "a", "stale", "x")], "ordinal int, document_id string, status string, error string"))


def test_raw_files(spark, tmp_path):
    (tmp_path / "a.html").write_text("<p>x")
    (tmp_path / "b.PDF").write_bytes(b"%PDF")
    (tmp_path / "c.txt").write_text("x")
    assert sorted((r.path.rsplit("/", 1)[1], r.kind) for r in stores.read_files(spark, str(tmp_path)).collect()) == [("a.html", "html"), ("b.PDF", "pdf"), ("c.txt", None)]


# Streaming

def test_stream_of_questions(spark, reg, tmp_path):
    from passagework.streaming.answers import answer_stream

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('{"query_id": 1, "message": "my weight"}\n{"query_id": 2, "message": " "}\n{"query_id": 3, "message": "fruit"}\n')
    stream = spark.readStream.schema("query_id bigint, message string, document_id string").json(f"{tmp_path}/in")
    idx = index(spark, [("eatwell-guide:1", "eatwell-guide", 0.9)]).join(reg.select("document_id", "document_name", "publisher", "year", "source_url"), "document_id").withColumns({"text": F.lit("Eat fruit."), "section_heading": F.lit("Fruit"), "block_type": F.lit("paragraph"), "retrieval_date": F.lit("2024")})
    embed = lambda df: df.withColumn("embedding", F.array(*map(F.lit, vector(1.0))))
    q = answer_stream(stream, embed, idx, reg, generation.model_generator(generation.extract), f"{tmp_path}/out", f"{tmp_path}/cp")
    q.awaitTermination(120)
    rows = spark.read.parquet(f"{tmp_path}/out").collect()
    assert sorted((r.query_id, r.type) for r in rows) == [(1, "out_of_scope"), (3, "answer")]
    spark.catalog.clearCache()


def test_chunks_round_trip_and_broken_blocks(spark, reg, tmp_path):
    blocks = spark.createDataFrame([block(0, "list_item", "an item"), block(1, "list_item", "ünother")], schemas.BLOCKS)
    chunks = chunking.chunk_blocks(blocks, reg, dates(spark))
    stores.write_chunks(chunks, f"{tmp_path}/chunks")
    back = stores.read_chunks(spark, f"{tmp_path}/chunks")
    columns = [c.split()[0] for c in schemas.CHUNKS.split(", ")]
    assert sorted(back.select(columns).collect()) == sorted(chunks.select(columns).collect())
    (tmp_path / "bad.json").write_text('{"document_id": "a", "type": "paragraph"}\n')
    with pytest.raises(ChunkError, match="missing fields"):
        stores.read_blocks(spark, f"{tmp_path}/bad.json")


def test_fixed_refusals_and_malformed_replies(spark, reg):
    rows = spark.createDataFrame([(1, "answer", None, [], []), (2, "nonsense", "m", [], []), (3, "out_of_scope", " ", [], []), (4, "not_in_corpus", "m", [], [])], f"query_id bigint, type string, message string, sections {responses.SECTIONS}, searched {responses.SEARCHED}")
    assert {r.query_id: r.rule for r in responses.malformed(rows).collect()} == {2: "response type is missing", 3: "response is missing a message"}
    assert [r.label for r in responses.picker(reg).orderBy("position").collect()][0] == "All documents"
    assert answer.health(True)["status"] == 200 and answer.health(False)["status"] == 503
    assert [r.document_id for r in answer.documents(reg).collect()] == [d.document_id for d in R.REGISTRY]
