from __future__ import annotations

import hashlib
import json
import os
import re
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from jobs import refresh_passages as R
from jobs import turn_report as J
from passagework.functions import text as T
from passagework.operators import chunking, guard
from passagework.plans.question_queries import MESSAGES
from passagework.registry import REGISTRY

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
DOCS = "doc_id bigint, text string, lang string, extra int"


class Place:
    """A source folder that grows, and what the job keeps."""

    def __init__(self, spark, folder):
        self.spark, self.source, self.output, self.checkpoint = spark, f"{folder}/in", f"{folder}/out", f"{folder}/check"

    def add(self, *rows):
        self.spark.createDataFrame([(i, t, lang, 1) for i, t, lang in rows], DOCS).coalesce(1).write.mode("append").parquet(self.source)

    def run(self, **more):
        return R.refresh_passages(self.spark, self.source, self.output, self.checkpoint, **more)

    def passages(self):
        return sorted((r.doc_id, r.ordinal, r.chunk_id, r.text, r.lang) for r in R.current(self.spark, self.output).collect())

    def files(self):
        return {os.path.join(d, f) for d, _, names in os.walk(self.output) for f in names if f.startswith("part-")}

    def log(self):
        return sorted((r.batch_id, r.rows_read, r.without_id, r.documents, r.passages) for r in self.spark.read.json(f"{self.output}/log").collect())


@pytest.fixture
def place(spark, tmp_path):
    return Place(spark, tmp_path)


def expected(docs):
    """Passages of (doc_id, text, lang): lines packed greedily to 200 estimated tokens (none here is over them)."""
    out = []
    for doc, text, lang in docs:
        packs, held = [], 0
        for line in filter(None, map(str.strip, (text or "").split("\n"))):
            n = len(line.split())
            if packs and round((held + n) * 1.3) <= 200:
                packs[-1], held = packs[-1] + " " + line, held + n
            else:
                packs, held = [*packs, line], n
        out += [(doc, i, f"{doc}:{i}", p, lang) for i, p in enumerate(packs)]
    return sorted(out)


def text(seed, n=90, lines=4):
    return "\n".join(" ".join(f"w{seed}x{i}x{j}" for j in range(n)) for i in range(lines))


def test_only_new_files_are_taken_and_last_versions_stand(place):
    place.add((1, text(1), "en"), (2, text(2), "de"), (3, text(3), None))
    place.add((4, "short", "en"), (None, "nobody's", "en"))
    assert place.run() == {"batches": 1, "documents": 4, "passages": len(expected([(1, text(1), "en"), (2, text(2), "de"), (3, text(3), None), (4, "short", "en")]))}
    first = place.files()
    assert place.run()["batches"] == 0 and place.files() == first
    # A changed document, one delivered again as it is, a retired one, a new one, one twice in a file.
    place.add((1, text(9, lines=2), "fr"), (2, text(2), "de"), (3, " \n", "en"), (5, "new one", "es"), (5, "new one", "es"))
    place.run()
    assert place.passages() == expected([(1, text(9, lines=2), "fr"), (2, text(2), "de"), (4, "short", "en"), (5, "new one", "es")])
    assert first < place.files(), "what stood before is not rewritten"
    assert [x[1:] for x in place.log()] == [(5, 1, 4, 13), (5, 0, 3, 3)]
    again = place.passages()
    assert place.run()["batches"] == 0 and place.passages() == again


def test_batches_of_one_file_give_the_same(place, spark, tmp_path):
    rows = [[(1, "one", "en"), (2, "two", "en")], [(1, "uno", "es")], [(3, "three", "en")]]
    for r in rows:
        place.add(*r)
    place.run(files_per_batch=1)
    assert [x[3] for x in place.passages()] == ["uno", "two", "three"]
    assert len(place.log()) == 3


@pytest.mark.parametrize("at", ["rejected", "versions", "log"])
def test_a_run_that_breaks_off_is_simply_repeated(place, monkeypatch, at):
    place.add((1, text(1), "en"), (2, text(2), "de"))
    place.run()
    place.add((1, "changed", "en"), (7, text(7), "de"))
    write = R._write

    def breaks(df, output, name):
        if name == at:
            raise OSError("lost")
        write(df, output, name)

    monkeypatch.setattr(R, "_write", breaks)
    with pytest.raises(Exception, match="lost"):
        place.run()
    if at == "rejected":
        assert place.passages() == expected([(1, text(1), "en"), (2, text(2), "de")]), "readers still see the last whole state"
    monkeypatch.setattr(R, "_write", write)
    place.run()
    assert place.passages() == expected([(1, "changed", "en"), (2, text(2), "de"), (7, text(7), "de")])
    assert len(place.log()) == 2


def test_uncuttable_paragraphs_are_set_aside(place, spark):
    place.add((1, "x " * 400 + "\nfine", "en"))
    place.run()
    assert [x[3] for x in place.passages()] == ["fine"]
    assert [(r.doc_id, r.block_no, r.error) for r in spark.read.parquet(f"{place.output}/rejected").collect()] == [(1, 0, "paragraph has no sentence boundary")]


def test_whole_documents_agree_with_one_batch_run(place, spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    half = docs.where("doc_id % 2 = 0"), docs.where("doc_id % 2 = 1")
    for part in half:
        part.write.mode("append").parquet(place.source)
        place.run()
    want = chunking.numbered(chunking.pieces(R.blocks_of(docs)))
    assert {x[2:4] for x in place.passages()} == {(r.chunk_id, r.text) for r in want.collect()}


def test_lines_are_cut_as_blocks_are(spark):
    long = ["One two. " * 90, 'He said. "Go on." ' * 60 + "x\x1cy z\x1f " * 50, "w " * 400, "é. \u00a0 Ça va.\u2003And so. " * 60, "a.\u3000B " * 200]
    odd = [None, "", " \n\u00a0\n", "\x1c", "a\x1db\x85c\r\nd", "____ ab\n____ abcde\n____ ½²一\n__ ___ !", "\u2003lead\u2028inner  gap \n\n next\u00a0"]
    whole = ["\n".join(["short one", *long[:2], "____", "tail", "tail two"]), "\n".join([long[2], "after", long[3]]), *long, *odd, "\n".join(f"{'w ' * 50}{i}" for i in range(12))]
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(whole)], "doc_id bigint, text string, lang string")
    pieces = chunking.pieces(R.blocks_of(docs))
    want = sorted((int(r.document_id), r.ordinal, r.text, r.tokens) for r in chunking.numbered(pieces).withColumn("tokens", T.estimate_tokens(F.col("text"))).collect())
    rows = chunking.packed_lines(docs).collect()
    assert [c for c in rows[0].asDict()] == ["doc_id", "lang", "passages", "rejected"] and len(rows) == len(whole)
    assert sorted((r.doc_id, i, p.text, p.tokens) for r in rows for i, p in enumerate(r.passages)) == want
    bad = sorted((int(r.document_id), r.block_no, r.error, r.text) for r in pieces.where("error is not null").collect())
    assert bad and sorted((r.doc_id, *b) for r in rows for b in r.rejected) == bad


def test_a_batch_is_cut_once_and_its_texts_move_once(place, monkeypatch):
    write, plans = R._write, {}

    def seen(df, output, name):
        if name in ("passages", "rejected", "versions"):
            plans[name] = df._jdf.queryExecution().optimizedPlan().toString().split("InMemoryRelation")[0]
        write(df, output, name)

    monkeypatch.setattr(R, "_write", seen)
    place.add((1, text(1), "en"), (2, "x " * 400, None), (3, None, "de"))
    assert place.run() == {"batches": 1, "documents": 3, "passages": 4}
    assert len(plans) == 3 and not any(re.search("MapInArrow|Join|Window|Aggregate|Repartition", p) for p in plans.values()), plans
    assert sorted((r.doc_id, r.n_passages) for r in R.last_versions(place.spark, place.output).collect()) == [(1, 4), (2, 0), (3, 0)]


def command(module, config, *more):
    run = subprocess.run([sys.executable, f"{ROOT}/jobs/{module}.py", "--config", str(config), *more], capture_output=True, text=True, cwd="/", env={**os.environ, "PYTHONPATH": ROOT}, timeout=300)
    assert run.returncode == 0, run.stderr[-2000:]
    return json.loads(run.stdout.strip().splitlines()[-1]), run.stderr


def test_command_line_of_refresh_passages(place, tmp_path):
    place.add((1, "one", "en"))
    config = tmp_path / "job.json"
    config.write_text(json.dumps({"source": place.source, "output": "nowhere", "checkpoint": place.checkpoint}))
    done, log = command("refresh_passages", config, "--output", place.output)
    assert done == {"batches": 1, "documents": 1, "passages": 1} and "read 1 rows" in log
    assert place.passages() == [(1, 0, "1:0", "one", "en")]


TURNS = "conv_id bigint, turn bigint, role string, text string"
ROWS = [
    (1, 0, "user", "What is my ideal weight?"),
    (1, 1, "assistant", "About 70 or 80, not 70.5"),
    (1, 2, "user", "And after Red apples, at 80?"),
    (1, 3, "assistant", "Then 80 or 90, 90"),
    (2, 0, "user", "red apples or green pears"),
    (2, 1, "user", "nothing"),
    (2, 3, "assistant", None),
    (None, 0, "user", "red APPLES!"),
    (3, 2, "user", None),
    (3, 3, "assistant", "5"),
    (3, 3, "assistant", "5 and 6 x"),
]
TITLES = [(10, "Red apples keep well"), (11, "Green, pears!"), (12, "green pears again"), (13, "one"), (14, None)]


def test_turn_report(spark, tmp_path):
    spark.createDataFrame(ROWS, TURNS).write.parquet(f"{tmp_path}/turns")
    spark.createDataFrame(TITLES, "doc_id bigint, text string").write.parquet(f"{tmp_path}/docs")
    run = lambda: J.turn_report(spark, f"{tmp_path}/turns", f"{tmp_path}/docs", f"{tmp_path}/out")
    read = lambda: sorted((tuple(r) for r in spark.read.parquet(f"{tmp_path}/out/turns").select("conv_id", "turn", "outcome", "reason", "document_id", "replied", "reply_words", "new_numbers").collect()), key=repr)
    done = run()
    assert done == {"rows_read": 11, "turns": 6, "refused": 1, "named": 2, "ambiguous": 1, "open": 2}
    want = [
        (1, 0, "refused", "weight_target", None, True, 6, 3),
        (1, 2, "named", None, 10, True, 5, 1),
        (2, 0, "ambiguous", None, None, False, 0, 0),
        (2, 1, "open", None, None, False, 0, 0),
        (None, 0, "named", None, 10, False, 0, 0),
        (3, 2, "open", None, None, True, 4, 2),
    ]
    assert read() == sorted(want, key=repr)
    assert run() == done and read() == sorted(want, key=repr)
    assert {(r.outcome, r.turns) for r in spark.read.json(f"{tmp_path}/out/summary").where("reason is null").groupBy("outcome").agg(F.sum("turns").alias("turns")).collect()} == {("named", 2), ("ambiguous", 1), ("open", 2)}


def test_command_line_of_turn_report(spark, tmp_path):
    spark.createDataFrame(ROWS, TURNS).write.parquet(f"{tmp_path}/turns")
    spark.createDataFrame(TITLES, "doc_id bigint, text string").write.parquet(f"{tmp_path}/docs")
    config = tmp_path / "job.json"
    config.write_text(json.dumps({"conversations": f"{tmp_path}/turns", "documents": f"{tmp_path}/docs", "output": f"{tmp_path}/out", "title_words": 3}))
    done, _ = command("turn_report", config)
    assert done["turns"] == 6 and done["open"] == 5


def test_named_by_table_agrees_with_the_registry_patterns(spark):
    aliases = spark.createDataFrame([(d.document_id, a) for d in REGISTRY for a in d.aliases], "document_id string, alias string")
    rows = guard.named_by_table(MESSAGES.df(spark), aliases).select("i", "message", "scope_id", guard.named_document(F.col("message"), [(d.document_id, list(d.aliases)) for d in REGISTRY]).alias("want")).collect()
    assert len(rows) == len(MESSAGES.rows) and all(r.scope_id == r.want for r in rows) and sum(r.want is not None for r in rows) >= 4


def test_named_by_table_of_odd_aliases(spark):
    messages = spark.createDataFrame([(1, "a b c"), (1, "a b c"), (2, None), (3, ""), (4, "x ü, y")], "i int, message string")
    alias = "document_id int, alias string"
    assert {r.n_named for r in guard.named_by_table(messages, spark.createDataFrame([], alias)).collect()} == {0}
    table = spark.createDataFrame([(1, "b C"), (2, "ü y"), (2, "Ü Y"), (3, "a-b"), (4, None), (None, "a"), (5, "")], alias)
    assert sorted((r.i, r.scope_id, r.n_named) for r in guard.named_by_table(messages, table).collect()) == [(1, 1, 1), (1, 1, 1), (2, None, 0), (3, None, 0), (4, 2, 1)]
    with pytest.raises(ValueError, match="over 2 words"):
        guard.named_by_table(messages, spark.createDataFrame([(1, "a b c")], alias), most_words=2)


def test_openings_are_the_first_words_of_the_whole_text_folded(spark):
    texts = ["Red apples keep well", " -- Straße, 12\u00a0Nord! x", "one", "", None, "a_b c'd e", "\u201cQuoted\u201d text\nmore", "É\u0301t\u00e9 ok no"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    for n in (1, 2, 3):
        words = F.split(guard.alias_text(F.col("t")), " ")
        whole = F.when((F.size(words) >= n) & (guard.alias_text(F.col("t")) != ""), F.array_join(F.slice(words, 1, n), " "))
        assert all(r.a == r.b for r in rows.select(guard.opening(F.col("t"), n).alias("a"), whole.alias("b")).collect())


def test_jobs_import_nothing_of_the_corpus_operators():
    code = "import sys; import jobs.registered; assert not any('llm' in m or m == 'corpus_pipeline' for m in sys.modules if m.startswith(('passagework', 'corpus')))"
    assert subprocess.run([sys.executable, "-c", code], cwd=ROOT, timeout=120).returncode == 0
    for name in os.listdir(f"{ROOT}/jobs"):
        if name.endswith(".py"):
            assert not re.search(r"\bllm\b|corpus_pipeline", open(f"{ROOT}/jobs/{name}").read())


def test_sha_of_versions_is_that_of_the_text(place, spark):
    place.add((1, "ü", "en"), (2, None, "en"))
    place.run()
    assert {r.doc_id: r.text_sha256 for r in R.last_versions(spark, place.output).collect()} == {1: hashlib.sha256("ü".encode()).hexdigest(), 2: hashlib.sha256(b"").hexdigest()}
