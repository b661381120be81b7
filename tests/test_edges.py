"""Edges that the small tables do not have."""

from __future__ import annotations

from passagework.operators import chunking
from passagework.operators import claims as C
from passagework.operators import html_blocks as H
from passagework.registry import REGISTRY, registry


def test_a_claim_answers_for_what_it_cites_or_for_its_whole_section(spark):
    own = REGISTRY[5]
    hit = "query_id bigint, rank int, chunk_id string, similarity double, document_id string, document_name string, publisher string, year int, source_url string, section_heading string, text string"
    hits = spark.createDataFrame([(1, i, f"{own.document_id}:{i}", 0.9, own.document_id, "n", "p", 2000, url, "h", "Leftovers keep in the fridge.") for i, url in ((1, "http://elsewhere"), (2, own.source_url))], hit)
    drafts = spark.createDataFrame([(1, 0, own.document_id, 0, "Leftovers keep in the fridge.", [f"{own.document_id}:2"])], "query_id bigint, document_pos int, document_id string, claim_no int, text string, chunk_ids array<string>")
    claims = C.rendered(drafts, hits, registry(spark))
    assert C.checked(claims).first().drop_reason == "bad_citation_url"
    assert C.checked(claims, whole_section=False).first().drop_reason is None


def test_references_without_a_semicolon_are_characters_or_text():
    html = "<h1>Beef &amp; ham &lt; eggs &amp</h1><h2>&am &#38 &#x26; &copy; 1 &</h2>"
    assert [b["text"] for b in H.blocks(html, "t")] == ["Beef & ham < eggs &", "&am & & © 1 &"]
    assert [b["text"] for b in H.blocks(html, "t", open_references=False)] == ["Beef & ham < eggs &amp", "&am &#38 & © 1 &"]


def test_runs_of_a_message_do_not_carry_it(spark):
    from passagework.operators import guard

    long = "word " * 200 + "cold chain"
    messages = spark.createDataFrame([(1, long), (2, None), (3, ""), (4, long), (5, "other")], "i int, message string")
    found = guard.named_by_table(messages, spark.createDataFrame([("a", "cold chain"), ("b", "warm chain")], "document_id string, alias string"))
    assert sorted((r.i, r.scope_id, r.n_named) for r in found.collect()) == [(1, "a", 1), (2, None, 0), (3, None, 0), (4, "a", 1), (5, None, 0)]
    gathered = [x for x in found._jdf.queryExecution().optimizedPlan().toString().splitlines() if "min(low" in x]
    assert gathered and not any("_flat" in x for x in gathered)


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_grid_is_cleaned_once(spark):
    from passagework.operators import layout as L

    grids = spark.createDataFrame([("d", 0, 1, 0.0, 0.0, 9.0, 9.0, [["A", "B"], ["c", "d"], ["e", None]])], "document_id string, page int, table_no int, x0 double, y0 double, x1 double, y1 double, cells array<array<string>>")
    found = L.accepted_tables(grids.repartition(2), spark.createDataFrame([("d", 0, 600.0, 800.0)], "document_id string, page int, width double, height double"))
    assert _plan(found).count("transform(cells") == 1 and not found.count()


def test_a_line_is_judged_once_for_bullets(spark):
    from pyspark.sql import functions as F

    from passagework.operators import layout as L

    rows = spark.createDataFrame([(["• a", "b", "C", "•", "d"],)], "lines array<string>").repartition(2)
    found = L.once(rows, "p", L.bullet_pieces(F.col("lines"), F.lit(True))).where("size(p) > 0").select("p")
    assert _plan(found).count("(?U)^n\\s+[A-Z") == 1
    assert [(p["item"], p["text"]) for p in found.first().p] == [(True, "a b"), (False, "C"), (True, "d")]


def test_scores_at_once_do_not_grow_with_the_batch(monkeypatch):
    import numpy as np
    import pyarrow as pa

    from passagework.operators import retrieval as R

    monkeypatch.setattr(R, "SCORES_AT_ONCE", 64)
    monkeypatch.setattr(R, "GATHERED", 1024)
    seen, offer = [], R.Best.offer
    monkeypatch.setattr(R.Best, "offer", lambda self, rows, similarity, queries: seen.append(similarity.size) or offer(self, rows, similarity, queries))
    vectors = np.random.default_rng(1).normal(size=(200, 8))
    asked = R.Asked([*range(16)], [None] * 16, vectors[:16].tolist(), 3)
    batch = pa.RecordBatch.from_pydict({"embedding": vectors.tolist(), "chunk_id": [f"{i:03}" for i in range(200)], "ordinal": [0] * 200})
    found = pa.Table.from_batches(asked.nearest(iter([batch]), ["chunk_id", "ordinal"])).to_pylist()
    assert max(seen) <= 64
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    want = np.argsort(-np.round(unit[:16] @ unit.T, 6), axis=1, kind="stable")[:, :3]
    assert [r["chunk_id"] for r in found] == [f"{i:03}" for i in want.reshape(-1)]


def test_reading_order_sorts_the_boxes_of_a_page_twice(spark):
    from passagework.operators import layout as L

    boxes = spark.createDataFrame([("d", 0, i, 50.0, 10.0 * i, 280.0, 10.0 * i + 8) for i in range(3)], "document_id string, page int, box_no int, x0 double, y0 double, x1 double, y1 double").repartition(2)
    pages = spark.createDataFrame([("d", 0, 600.0)], "document_id string, page int, width double")
    found = L.column_order(boxes, pages)
    assert sorted((r.box_no, r.flow_no) for r in found.collect()) == [(0, 0), (1, 1), (2, 2)]
    plan = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    above = plan[: plan.index("Join")]
    assert above.count("Sort [") <= 2


def test_tables_are_labelled_without_a_shuffle(spark):
    """blank leading cells, rows wider than the header, repeats of it, and no given header."""
    texts = ["| A | B |\n|---|---|\n| x | 1 |\n|  | 2 | w |\n| a | b |\n|  |  |  | v |\n|  | |", "| A | B |\n| | q |", "", None]
    tables = spark.createDataFrame([("d", i, ["A", "", "C"] if i == 1 else None, t) for i, t in enumerate(texts)], "document_id string, block_no bigint, header array<string>, text string")
    found = chunking.table_rows(tables)
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, found.collect())) == [("d", 0, 2, "A: x | B: 1"), ("d", 0, 3, "A: x | B: 2 | w"), ("d", 0, 5, "A: x | B: 2 | w | v"), ("d", 0, 6, "A: x | B: 2"), ("d", 1, 0, "A: A | B"), ("d", 1, 1, "A: A | q")]
