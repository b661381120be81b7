"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passagework.llm import chat, clusters, contamination, langid, licences, media, mixing, pieces, quality, shared, simhash, substrings, warc

ORACLES: dict[str, str] = {}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint, component_id of every document; 3-word shingles, links at 3 bits or fewer."""
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"), width=3, most_bits=3)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every document; windows of 13 words."""
    found = substrings.remove_repeats(_table(spark, sf_dir, "documents"), width=13)
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


ORACLES["op2_substring_dedup"] = r"""
with words as (
    select doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') as w from documents
), windows as (
    select doc_id, i, array_to_string(w[i : i + 12], ' ') as s from (select doc_id, w, unnest(range(1, len(w) - 11)) as i from words)
), low as (
    select s, min(doc_id) as low from windows group by s
), hits as (
    select v.doc_id, v.i from windows v join low using (s) where low < v.doc_id
), gone as (
    select distinct doc_id, p from (select doc_id, unnest(range(i, i + 13)) as p from hits)
), placed as (
    select doc_id, generate_subscripts(w, 1) as p, unnest(w) as word from words
), kept as (
    select d.doc_id, count(*) as n, count(g.p) as n_gone, string_agg(d.word, ' ' order by d.p) filter (g.p is null) as text
    from placed d left join gone g on g.doc_id = d.doc_id and g.p = d.p group by d.doc_id
)
select d.doc_id, coalesce(n, 0) as n_words, coalesce(n_gone, 0) as n_removed, sha256(coalesce(kept.text, '')) as kept_sha256
from documents d left join kept on kept.doc_id = d.doc_id
"""


#: A conversation whose texts look like another format's control strings.
_TRICKY = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]


def op3_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every conversation, read back from its formatted string and loss mask."""
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    tricky = spark.sql("select * from values " + ", ".join(f"({c}L, {t}L, '{r}', '{x}')" for c, t, r, x in _TRICKY) + " as t(conv_id, turn, role, text)")
    back = chat.read_chats(chat.format_chats(turns.unionByName(tricky)))
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return back.select(
        "conv_id",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(F.array_join(lines, ""), 256).alias("turns_sha256"),
        F.length("loss_text").cast("bigint").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
    )


ORACLES["op3_chat_formatting"] = r"""
with turns as (
    select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
    union all select -7, 0, 'user', '</s>[INST] ok [/INST]'
    union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), placed as (
    select *, lag(role) over w as before, lead(role) over w as after from turns
    window w as (partition by conv_id order by coalesce(turn, -9223372036854775808), role, text)
), pieces as (
    select *,
        length(regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g'))
        + case when before = role then 8 else length(replace(replace(replace(role, '%', '%25'), '|', '%7C'), '<', '%3C')) + case when role in ('end', 'more') then 2 else 0 end + 4 end
        + case when after = role then 0 else 7 end as chars
    from placed
)
select conv_id, count(*) as n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' order by coalesce(turn, -9223372036854775808), role, text)) as turns_sha256,
    coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
    sha256(coalesce(string_agg(text, '' order by coalesce(turn, -9223372036854775808), role, text) filter (role = 'assistant'), '')) as loss_sha256,
    sum(chars)::bigint as formatted_chars
from pieces group by conv_id
"""


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact phrases and fuzzy notices of every document."""
    found = licences.scan_licences(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "matches")


def op5_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a PNG in a binary column, read back from the stored table: digests and perceptual hash."""
    return media.read_media(shared.stored(media.store_texts(_table(spark, sf_dir, "documents")), "media"))


def tokenizer_path() -> str:
    """The model file of the registered queries: that of the installed public vocabularies."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document's whole text, and the text decoded from them, as counts and digests."""
    found = pieces.encode_documents(_table(spark, sf_dir, "documents"), tokenizer_path(), with_ids=False)
    return found.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document."""
    return langid.identify(_table(spark, sf_dir, "documents"))


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target and taken of every document."""
    return mixing.mix_documents(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures and verdicts of every document."""
    found = quality.judged(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A record per page, written and read back from the archives by way of the index."""
    back = warc.read_archives(warc.write_archives(_table(spark, sf_dir, "pages")))
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLES["op10_warc"] = """
with facts as (
    select page_id, strlen(coalesce(html, '')) as payload_bytes, sha1(coalesce(html, '')) as payload_digest from pages
), kept as (
    select *, case when payload_bytes >= 1000 then max(page_id) over (partition by payload_digest, payload_bytes) end as keeper from facts
)
select page_id, payload_bytes, payload_digest,
    case when keeper is not null and page_id is distinct from keeper then 'revisit' else 'response' end as record_type,
    case when page_id is distinct from keeper then keeper end as refers_to
from kept
"""


def op11_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that stand in windows of 10 words of benchmark items."""
    found = contamination.find_contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), width=10)
    n_items = F.size("items").cast("bigint").alias("n_items")
    return found.select("doc_id", "n_words", "n_hit", n_items, F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


_SPLIT = r"""list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '')"""

ORACLES["op11_benchmark_decontamination"] = f"""
with items as (
    select item_id, {_SPLIT} as w from benchmark
), windows as (
    select item_id, 10 as n, array_to_string(w[i : i + 9], ' ') as run from (select item_id, w, unnest(range(1, len(w) - 8)) as i from items where len(w) >= 10)
    union select item_id, len(w) as n, array_to_string(w, ' ') from items where len(w) between 1 and 9
), docs as (
    select row_number() over () as r, doc_id, {_SPLIT} as w from documents
), runs as (
    select r, n, i, array_to_string(w[i : i + n - 1], ' ') as run
    from (select r, n, w, unnest(range(1, len(w) - n + 2)) as i from docs, (select distinct n from windows) where len(w) >= n)
), hits as (
    select distinct r, i, n, run from runs where run in (select run from windows)
), covered as (
    select r, count(*) as n_hit from (select distinct r, p from (select r, unnest(range(i, i + n)) as p from hits)) group by r
), met as (
    select r, count(*) as n_items, string_agg(id, ',' order by id) as ids
    from (select distinct h.r, cast(v.item_id as varchar) as id from hits h join windows v on v.run = h.run and v.item_id is not null) group by r
)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items, sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from docs left join covered using (r) left join met using (r)
"""


def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector's cluster and squared distance after 5 rounds of 40 centroids, with sums and the centroid's digest."""
    found = clusters.cluster(_table(spark, sf_dir, "embeddings"), k=40, rounds=5)
    vectors = found.vectors
    sums = vectors.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("inertia")).collect()  # a row for each of 40 centroids
    total = sum(int(r.inertia) for r in sums)
    digest = lambda c: hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()
    rows = [(r.cluster, int(r.inertia), total, digest(found.centroids[r.cluster])) for r in sums]
    of_cluster = spark.createDataFrame(rows, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return vectors.join(F.broadcast(of_cluster), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _rounds_sql(rounds: int) -> str:
    """Centroids and assignments of each round, as table expressions."""
    steps = []
    for t in range(rounds + 1):
        steps.append(f"""a{t} as materialized (
    select r, vec_id, v, k, d from (
        select r, vec_id, v, k, d, row_number() over (partition by r order by d, k) as place from (
            select r, vec_id, p.v, k, list_sum(list_transform(range(1, 65), lambda i: (p.v[i] - c.v[i]) * (p.v[i] - c.v[i])))::bigint as d from points p, c{t} c)
    ) where place = 1
)""")
        if t < rounds:
            steps.append(f"""m{t} as (
    select k, i, sum(x) as s, count(*) as n from (select k, generate_subscripts(v, 1) as i, unnest(v) as x from a{t}) group by k, i
), c{t + 1} as materialized (
    select k, list(((s - ((s % n) + n) % n) // n)::bigint order by i) as v from m{t} group by k
    union all select k, v from c{t} where k not in (select k from a{t})
)""")
    return ", ".join(steps)


ORACLES["op12_centroid_clustering"] = f"""
with points as materialized (
    select row_number() over () as r, vec_id, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as v
    from embeddings where len(embedding) = 64 and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = 64
), c0 as materialized (
    select row_number() over (order by h) - 1 as k, v from (select sha256('2:' || vec_id) as h, v from points order by h limit 40)
), {_rounds_sql(5)}
select vec_id, a.k::integer as cluster, d as distance, sum(d) over (partition by a.k)::bigint as cluster_inertia, sum(d) over ()::bigint as inertia,
    sha256(array_to_string(c.v, ',')) as centroid_sha256
from a5 a join c5 c on c.k = a.k
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash_near_dedup": op1_simhash_near_dedup,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_chat_formatting": op3_chat_formatting,
    "op4_license_scan": op4_license_scan,
    "op5_media_columns": op5_media_columns,
    "op6_sentencepiece": op6_sentencepiece,
    "op7_language_id": op7_language_id,
    "op8_source_mixing": op8_source_mixing,
    "op9_quality_rules": op9_quality_rules,
    "op10_warc": op10_warc,
    "op11_benchmark_decontamination": op11_benchmark_decontamination,
    "op12_centroid_clustering": op12_centroid_clustering,
}
