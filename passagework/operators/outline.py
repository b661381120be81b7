"""What a document's reader knows at each place, without any document being one group.

Blocks depend on what stands before them: the headings that are open, whether a section is skipped, the block that a
fragment goes on from.  Each of these is a running maximum or sum over the document's events, so it is found in two
levels: within spans of a document (windows over document_id and span), and over one row per span
(what the spans before it hold).  A document of any length so spreads over as many tasks as it has spans.

events: document_id, span, ord, page, kind, text, level, header, caption, panel, document_name; spans rise with
ord, which numbers a document's events (unique, need not be dense).  kind is heading, paragraph, list_item, table or
cap (a drop cap, which opens the next event of its page).

Texts move twice: to the event before (a drop cap may open them), and at the end to what became of them.  All passes between
them are over what was asked of a text once (``_pieces``), those of the outline over headings alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from passagework.folders import fresh_path, shared_dir
from passagework.functions import text as T
from passagework.operators import html_blocks as H

KEYS = ["document_id", "span"]
# Fixed value: headings after which a document is skipped.
SKIP_HEADING = r"references|bibliography|index|corrigenda|evaluation forms?|food safety contacts|acknowledgements|acknowledgments|further reading"
_DROP = r"(?iUd)" + H.DROP_TEXT.pattern
_PROMO = r"(?iUd)" + H.PROMO.pattern
_LICENCE = r"(?iUd)" + H.LICENCE.pattern
_LOWER = r"(?U)^\p{Lower}"


def _kept(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` written and read back; a pass then reads no more columns than it asks for."""
    at = fresh_path(rows.sparkSession, name)
    rows.write.option("compression", "zstd").parquet(at)
    return rows.sparkSession.read.schema(rows.schema).parquet(at)


def running(rows: DataFrame, order: str | list[str], totals_of: DataFrame | None = None, **values: tuple[str, Column, bool]) -> DataFrame:
    """``rows`` with running values in order within each document: name=(max or sum, column, whether the row itself counts).

    ``rows`` should be cut off from what made them (a checkpoint, a table), since they are read twice; ``totals_of`` are rows of all
    their spans that give the same values, where there are fewer."""
    own = Window.partitionBy(*KEYS).orderBy(*([order] if isinstance(order, str) else order))
    fold = {"max": F.max, "sum": F.sum}
    totals = (rows if totals_of is None else totals_of).groupBy(*KEYS).agg(*(fold[how](v).alias(f"_{n}") for n, (how, v, _) in values.items()))
    before = Window.partitionBy("document_id").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(*KEYS, *(fold[how](f"_{n}").over(before).alias(f"_{n}") for n, (how, _, _) in values.items()))
    out = rows.join(carried, KEYS)
    for n, (how, v, upto) in values.items():
        here = fold[how](v).over(own.rowsBetween(Window.unboundedPreceding, 0 if upto else -1))
        both = F.greatest(here, F.col(f"_{n}")) if how == "max" else F.coalesce(here, F.lit(0)) + F.coalesce(f"_{n}", F.lit(0))
        out = out.withColumn(n, both)
    return out.drop(*(f"_{n}" for n in values))


def _effective(clean: Column) -> Column:
    """Whether a heading's normalized text says anything about where the reader stands."""
    return (clean != "") & ~T.letterspaced(clean) & ~clean.rlike(_DROP)


def _stays(kind: Column, text: Column) -> Column:
    """Whether a piece's normalized text, or a table, becomes a block outside skipped sections."""
    table = (text != "") & ~T.letterspaced(text)
    bad = (text == "") | text.rlike(_DROP) | text.rlike(_PROMO) | T.letterspaced(text)
    return F.when(kind == "table", table).otherwise(~bad & ~((kind == "paragraph") & (text.rlike(_LICENCE) | ((F.length(text) < 40) & ~text.rlike(_LOWER)))))


def _pieces(events: DataFrame) -> DataFrame:
    """Headings, captions that may act as headings and all else that can become a block, in order (ord, a caption before its
    table), with their normalized texts and all that is asked of these: whether one may go on from what is before it, and
    stands if nothing is joined to it."""
    last = F.struct("ord", F.col("kind").alias("k"), F.col("page").alias("p"), F.when(F.col("kind") == "cap", F.col("text")).alias("cap"))
    rows = running(events, "ord", prev=("max", last, False))
    opened = (F.col("prev.k") == "cap") & (F.col("prev.p") == F.col("page")) & F.col("text").rlike(_LOWER)
    text = F.when(F.coalesce(opened, F.lit(False)), F.concat("prev.cap", "text")).otherwise(F.col("text"))
    clean = F.when(F.col("kind") == "table", T.strip(F.coalesce("text", F.lit("")))).otherwise(T.normalize(F.coalesce(text, F.lit(""))))
    rows = rows.withColumn("clean", clean).drop("prev").where("kind <> 'cap' and (kind <> 'table' or not panel)")
    caption = T.normalize(F.coalesce("caption", F.lit("")))
    counts = (F.col("kind") == "table") & (F.col("caption") != "") & (F.length("caption") <= 80) & _effective(caption)
    step = lambda n, kind, text, level, header: F.struct(F.lit(n).alias("n"), kind.alias("kind"), text.alias("text"), level.alias("level"), header.alias("header"))
    none = F.lit(None).cast("array<string>")
    main = step(1, F.col("kind"), F.col("clean"), F.greatest(F.col("level").cast("int"), F.lit(1)), F.when(F.col("kind") == "table", F.col("header")))
    both = F.when(F.coalesce(counts, F.lit(False)), F.array(step(0, F.lit("heading"), caption, F.lit(1), none), main)).otherwise(F.array(main))
    rows = rows.select(*KEYS, "document_name", (F.col("ord") * 2).alias("o"), F.explode(both).alias("s"))
    rows = rows.select(*KEYS, "document_name", (F.col("o") + F.col("s.n")).alias("ord"), (F.col("s.n") == 0).alias("caption"), "s.kind", "s.text", "s.level", "s.header")
    kind, text = F.col("kind"), F.col("text")
    heading, goes_on = kind == "heading", text.rlike(_LOWER)
    # A caption said something already; a heading that says nothing is no step.
    rows = rows.where(F.when(heading, F.col("caption") | _effective(text)).otherwise(_stays(kind, text)))
    return rows.select(
        "*", (heading & text.rlike(f"(?iu)^({SKIP_HEADING})$")).alias("skips"), (heading & T.same_title(text, F.coalesce("document_name", F.lit("")))).alias("home"),
        (~heading | ~text.rlike(_PROMO)).alias("stays"), F.when(heading, goes_on & (F.length(text) <= 40)).otherwise((kind == "paragraph") & (goes_on | F.startswith(text, F.lit("(")))).alias("goes_on"),
        ((kind != "paragraph") | (F.length(text) >= 40)).alias("stands"), F.when(heading, T.word_count(text)).alias("words"),
    )


def _marks(pieces: DataFrame) -> DataFrame:
    """(ord, skips, enters, depth) of the headings and captions that change where the reader stands.

    A section is skipped from a heading of SKIP_HEADING to the next heading.  Captions do not count inside one.
    A heading of level n stands at most one deeper than what was open; the depth d of the i-th heading is so the least
    of its level and one more than the depth before, and of i less the heading (or return to the title) that bounded it
    last: d = i - max(j - level of j) over the headings j since the reader was last at the title."""
    rows = pieces.where("kind = 'heading'").select(*KEYS, "ord", "caption", "skips", "home", "level")
    rows = running(rows, "ord", last_head=("max", F.when(~F.col("caption"), F.col("ord")), False), last_skip=("max", F.when(F.col("skips"), F.col("ord")), False))
    inside = F.coalesce(F.col("last_skip") >= F.coalesce("last_head", F.lit(-1)), F.lit(False))
    rows = rows.where(~(F.col("caption") & inside)).select(*KEYS, "ord", "skips", "level", (F.col("home") & ~F.col("skips")).alias("home"), (~F.col("home") & ~F.col("skips")).alias("enters"))
    rows = _kept(rows, "headings")
    rows = _kept(running(rows, "ord", i=("sum", F.col("enters").cast("bigint"), True), era=("sum", F.col("home").cast("bigint"), True)), "counted")
    bound = F.when(F.col("home"), F.struct("era", F.col("i").alias("t"))).when(F.col("enters"), F.struct("era", (F.col("i") - F.col("level")).alias("t")))
    rows = running(rows, "ord", bound=("max", bound, True))
    least = F.when(F.col("bound.era") == F.col("era"), F.col("bound.t"))
    depth = F.col("i") - F.when(F.col("era") == 0, F.greatest(least, F.lit(0))).otherwise(least)
    return rows.select(*KEYS, "ord", "skips", "enters", F.coalesce(depth, F.lit(0)).cast("int").alias("depth"))


def _open() -> dict[str, tuple[str, Column, bool]]:
    """The last heading of each depth (of rows with enters, depth and text), for ``running``."""
    return {f"h{d}": ("max", F.when(F.col("enters") & (F.col("depth") == d), F.struct("ord", "text")), True) for d in (1, 2, 3)}


def _blocks(pieces: DataFrame, heads: DataFrame) -> DataFrame:
    """Blocks before merging, without their texts: (ord, type, path, and what was asked of the text).

    ``path`` is 128 bits of a hash of the open headings, null where none is."""
    open_ = F.slice(F.array("h1.text", "h2.text", "h3.text"), 1, F.col("depth"))
    path = F.when(F.col("depth") > 0, F.unhex(F.substring(F.sha2(F.concat_ws(",", F.transform(open_, lambda x: F.sha2(x, 256))), 256), 1, 32)))
    asked = [*KEYS, "ord", "kind", "stays", "goes_on", "stands", "words"]
    marks = _kept(running(heads, "ord", **_open()).select(*asked, "skips", "enters", path.alias("path")), "marks")
    rows = pieces.where("kind <> 'heading'").select(*asked).unionByName(marks, allowMissingColumns=True)
    heading = F.col("kind") == "heading"
    rows = running(rows, "ord", mark=("max", F.when(heading, F.struct("ord", "skips", "path")), True))
    shown = F.when(heading, F.col("enters") & F.col("stays")).otherwise(~F.coalesce("mark.skips", F.lit(False)))
    return rows.where(shown).select(*KEYS, "ord", F.col("kind").alias("type"), "goes_on", "stands", "words", "mark.path")


def _starts(counts: Column) -> Column:
    """Which lines of display headings open one, for their word counts: a line joins while those before it have 8 words or fewer."""
    state = F.struct(F.lit(0).alias("held"), F.array().cast("array<boolean>").alias("opens"))

    def step(s: Column, n: Column) -> Column:
        goes_on = (s["held"] > 0) & (s["held"] <= 8)
        return F.struct(F.when(goes_on, s["held"] + n).otherwise(n).alias("held"), F.concat(s["opens"], F.array(~goes_on)).alias("opens"))

    return F.aggregate(counts, state, step, lambda s: s["opens"])


def _merged(blocks: DataFrame) -> DataFrame:
    """(document_id, span, ord, type, stands, members): the lines of a display heading made one, and paragraphs that go on from a
    list item joined to it; members are the (ord, span) of the blocks that became one.

    The lines of one display heading, and what goes on from one list item, are one row of the result and so are gathered."""
    rows = running(blocks, "ord", prev=("max", F.struct("ord", "type", "path"), False))
    line = (F.col("type") == "heading") & (F.col("prev.type") == "heading") & F.col("goes_on")
    tail = (F.col("type") == "paragraph") & F.col("prev.type").isin("list_item", "paragraph") & F.col("goes_on") & F.col("path").eqNullSafe(F.col("prev.path"))
    rows = _kept(rows.select(*KEYS, "ord", "type", "stands", "words", (~F.coalesce(line | tail, F.lit(False))).alias("opens")), "opened")
    rows = running(rows, "ord", opener=("max", F.when(F.col("opens"), F.struct("ord", "type")), True))
    rows = _kept(rows.select(*KEYS, "ord", "type", "stands", "words", (~F.col("opener.type").isin("heading", "list_item")).alias("alone"), F.col("opener.ord").alias("group")), "grouped")
    single = rows.where("alone").select(*KEYS, "ord", "type", "stands", F.array(F.struct("ord", "span")).alias("members"))
    held = rows.where("not alone").groupBy("document_id", "group").agg(F.array_sort(F.collect_list(F.struct("ord", "span", "type", "stands", "words"))).alias("b"))
    words = F.transform("b", lambda b: b["words"])
    # A list item's group has one opening line; a heading's may have several.
    opens = F.when(F.col("b")[0]["type"] == "heading", _starts(words)).otherwise(F.transform("b", lambda b, i: i == 0))
    held = held.withColumn("opens", opens)
    firsts = F.expr("filter(sequence(1, size(b)), i -> opens[i - 1])")
    held = held.withColumn("firsts", firsts)
    run = F.transform("firsts", lambda a, k: F.slice("b", a, F.coalesce(F.try_element_at(F.col("firsts"), k + 2), F.size("b") + 1) - a))
    held, f = held.select("document_id", F.explode(run).alias("r")), F.col("r")[0]
    members = F.transform("r", lambda b: F.struct(b["ord"].alias("ord"), b["span"].alias("span")))
    joined = held.select("document_id", f["span"].alias("span"), f["ord"].alias("ord"), f["type"].alias("type"), f["stands"].alias("stands"), members.alias("members"))
    return single.unionByName(joined)


def _told(pieces: DataFrame, heads: DataFrame, runs: DataFrame) -> DataFrame:
    """schemas.BLOCKS of the numbered ``runs`` (no, type, members): their texts, and the headings that are open there."""
    run = F.struct("no", "type", F.col("k").alias("k"), F.size("members").alias("size"))
    placed = runs.select("document_id", "no", "type", "members", F.posexplode("members").alias("k", "m")).select("document_id", F.col("m.span").alias("span"), F.col("m.ord").alias("ord"), run.alias("run"))
    # A text, its heading's place and what became of it meet by their span, where the headings before them are.
    mark = heads.select(*KEYS, "ord", F.struct("enters", "depth").alias("mark"))
    texts = pieces.select(*KEYS, "ord", "text", "header", "document_name", F.lit(True).alias("told"))
    rows = texts.unionByName(placed, allowMissingColumns=True).unionByName(mark, allowMissingColumns=True).repartition(*KEYS)
    same = Window.partitionBy(*KEYS, "ord")
    rows = rows.withColumn("run", F.max("run").over(same)).withColumn("mark", F.max("mark").over(same)).where("told and (run is not null or mark is not null)")
    rows = rows.select(*KEYS, "ord", "text", "header", "document_name", "run", "mark.enters", "mark.depth")
    spans = heads.select(*KEYS, "ord", "text", "enters", "depth").unionByName(pieces.select(*KEYS), allowMissingColumns=True)
    rows = running(rows, "ord", spans, now=("max", F.when(F.col("depth").isNotNull(), F.struct("ord", "depth")), True), **_open()).where("run is not null")
    open_ = F.slice(F.array("h1.text", "h2.text", "h3.text"), 1, F.coalesce("now.depth", F.lit(0)))
    path = F.filter(F.concat(F.array("document_name"), open_), lambda x: F.coalesce(x, F.lit("")) != "")
    rows = rows.select(F.col("document_id").cast("string").alias("document_id"), F.col("run.no").alias("block_no"), "run.type", "run.k", "run.size", "text", path.alias("heading_path"), "header")
    alone = rows.where("size = 1").select("document_id", "block_no", "type", "text", "heading_path", "header")
    first = lambda c: F.max(F.when(F.col("k") == 0, F.col(c)))
    held = rows.where("size > 1").groupBy("document_id", "block_no").agg(F.max("type").alias("type"), F.array_sort(F.collect_list(F.struct("k", "text"))).alias("b"), first("heading_path").alias("p"))
    held = held.withColumn("text", F.array_join(F.transform("b", lambda b: b["text"]), " "))
    path = F.when(F.col("type") == "heading", F.concat(F.slice("p", 1, F.size("p") - 1), F.array("text"))).otherwise(F.col("p"))
    return alone.unionByName(held.select("document_id", "block_no", "type", "text", path.alias("heading_path"), F.lit(None).cast("array<string>").alias("header")))


def fold_events(events: DataFrame) -> DataFrame:
    """schemas.BLOCKS of the documents' events, numbered from 0 in order.

    Headings set the path of what follows; one that repeats the document's name returns to it.  Sections under
    SKIP_HEADING, empty, letterspaced and promotional pieces, licence lines and short paragraphs go.  Null texts are
    empty.  A document without blocks gives no rows.  All events of a document have one document_name.  ``events`` are read
    twice, so they should be a table, a checkpoint or cheap to make."""
    shared_dir(events.sparkSession)  # where all that is kept goes
    pieces = _kept(_pieces(events.withColumn("panel", F.coalesce("panel", F.lit(False)))), "pieces")
    headings = pieces.where("kind = 'heading'").select(*KEYS, "ord", "kind", "text", "stays", "goes_on", "stands", "words")
    heads = _kept(_marks(pieces).join(headings, [*KEYS, "ord"]), "heads")
    runs = _merged(_kept(_blocks(pieces, heads), "blocks")).where("stands")
    runs = running(_kept(runs, "runs"), "ord", no=("sum", F.lit(1).cast("bigint"), False))
    return _told(pieces, heads, runs)
