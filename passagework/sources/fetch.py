"""Fetching documents: the request edge, and what is decided about a response, as expressions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passagework.errors import FetchError
from passagework.folders import fresh_path

# Request header, languages, and marks of a bot challenge.
USER_AGENT = "Mozilla/5.0 (X11; Linux x86_64) AppleWebKit/537.36 (KHTML, like Gecko) Chrome/128.0.0.0 Safari/537.36"
NON_ENGLISH_LABELS = ("arabic", "chinese", "français", "french", "spanish", "español", "russian", "italiano", "italian", "japanese", "persian", "portuguese", "german", "deutsch", "korean")
NON_ENGLISH_CODES = ("_ara", "_chi", "_fre", "_spa", "_rus", "_ita", "_jpn", "_per", "_por", "_deu", "_ger", "_kor", "-ara", "-chi", "-fre", "-spa", "-rus", "-per", "-por", "-jpn", "-ita")
CHALLENGE = ("access denied", "errors.edgesuite.net", "request blocked", "pardon our interruption", "just a moment", "cf-browser-verification", "are you a robot")


def _any(text: Column, marks: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for m in marks:
        out = out | F.contains(text, F.lit(m))
    return out


def _lower(text: Column) -> Column:
    return F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))


def sniff(body: Column) -> Column:
    """pdf, html or unknown, from the first bytes of a body given as text."""
    stripped = F.regexp_replace(body, r"^[ \t\n\r\x0b\x0c]+", "")
    head = F.lower(F.substring(stripped, 1, 800))
    html = F.startswith(head, F.lit("<!doctype html")) | F.startswith(head, F.lit("<head")) | F.contains(head, F.lit("<html"))
    return F.when(F.startswith(stripped, F.lit("%PDF")), "pdf").when(html, "html").otherwise("unknown")


def is_challenge(body: Column) -> Column:
    """A page of at most 80,000 bytes whose first 12,000 hold a mark of a bot challenge."""
    return (F.octet_length(body) <= 80_000) & _any(_lower(F.substring(body, 1, 12_000)), CHALLENGE)


def body_problem(body: Column, expected: Column) -> Column:
    """Why a body cannot be used; null if it can."""
    empty = F.regexp_replace(body, r"^[ \t\n\r\x0b\x0c]+", "") == ""
    return (
        F.when(body.isNull() | empty, "empty body")
        .when((expected == "html") & is_challenge(body), "response is a bot-challenge page")
        .when(sniff(body) != expected, F.concat(F.lit("body is "), sniff(body), F.lit(", expected "), expected))
    )


def is_download_link(href: Column, label: Column) -> Column:
    low = _lower(href)
    content = F.contains(low, F.lit("iris.who.int")) & F.endswith(F.rtrim(low, F.lit("/")), F.lit("/content"))
    return F.contains(low, F.lit(".pdf")) | F.contains(low, F.lit("bitstream")) | F.startswith(_lower(label), F.lit("download")) | content


def is_non_english(href: Column, label: Column) -> Column:
    return _any(_lower(label), NON_ENGLISH_LABELS) | _any(_lower(href), NON_ENGLISH_CODES)


def is_english_marked(href: Column, label: Column, hreflang: Column) -> Column:
    return F.startswith(hreflang, F.lit("en")) | _any(_lower(F.concat_ws(" ", label, href)), ("english", "-eng", "_eng", "eng.pdf"))


def ranked_links(links: DataFrame) -> DataFrame:
    """(document_id, pos, href, score) of usable links: downloads that are not marked as another language."""
    download = F.startswith(_lower(F.col("label")), F.lit("download"))
    marked = is_english_marked(F.col("href"), F.col("label"), F.col("hreflang"))
    score = F.when(marked, 5).when(F.startswith("page_lang", F.lit("en")) & download, 4).otherwise(0) + F.when(download, 2).otherwise(0) + F.when(F.contains(_lower(F.col("href")), F.lit("bitstream")), 1).otherwise(0)
    usable = ~(F.startswith("href", F.lit("javascript:")) | F.startswith("href", F.lit("mailto:")))
    return links.where(usable & is_download_link(F.col("href"), F.col("label")) & ~is_non_english(F.col("href"), F.col("label"))).select("document_id", "pos", "href", score.alias("score"))


def best_links(links: DataFrame) -> DataFrame:
    """(document_id, href): the best score of each page, the first in order among equals."""
    return ranked_links(links).groupBy("document_id").agg(F.max_by("href", F.struct("score", -F.col("pos"))).alias("href"))


def without_link(pages: DataFrame, links: DataFrame) -> DataFrame:
    return pages.select("document_id").join(best_links(links), "document_id", "left_anti")


def merged_manifest(registry: DataFrame, previous: DataFrame, responses: DataFrame, today: Column | None = None) -> DataFrame:
    """The new manifest (schemas.MANIFEST and ordinal) from the previous one and this run's responses.

    ``responses``: document_id, body (text), http_status, content_type, final_url, error.  ``previous`` has
    in addition stored (whether the file is there).  An unchanged hash keeps the date; a failure
    keeps the previous file as stale, else is an error.  Rows after the first failure, in
    registry order, stay as they were.
    """
    today = F.date_format(F.current_timestamp(), "yyyy-MM-dd") if today is None else today
    old = previous.select("document_id", *[F.col(c).alias(f"old_{c}") for c in ("downloaded_url", "retrieval_date", "sha256", "http_status", "content_type", "status", "file", "error", "stored")])
    rows = registry.join(responses, "document_id", "left").join(old, "document_id", "left")
    problem = F.coalesce("error", F.when(F.col("http_status") >= 400, F.concat(F.lit("HTTP "), F.col("http_status").cast("string"))), body_problem(F.col("body"), F.col("kind")))
    rows = rows.withColumn("problem", problem).withColumn("new_sha", F.sha2("body", 256))
    failed = F.col("problem").isNotNull()
    kept = failed & F.coalesce("old_stored", F.lit(False))
    bad = rows.where(failed).agg(F.min("ordinal").alias("first_bad"))
    rows = rows.crossJoin(F.broadcast(bad))
    later = F.col("ordinal") > F.coalesce("first_bad", F.lit(2**30))
    value = lambda ok, stale, name: F.when(later, F.col(f"old_{name}")).when(~failed, ok).when(kept, stale)
    file = F.concat(F.lit("data/raw/"), "document_id", F.lit("/source."), "kind")
    date = F.when(F.col("new_sha") == F.col("old_sha256"), F.coalesce("old_retrieval_date", today)).otherwise(today)
    return rows.where(~later | F.col("old_status").isNotNull()).select(
        "ordinal", "document_id", "document_name", "publisher", "year", "source_url",
        value(F.col("final_url"), F.col("old_downloaded_url"), "downloaded_url").alias("downloaded_url"),
        value(date, F.col("old_retrieval_date"), "retrieval_date").alias("retrieval_date"),
        value(F.col("new_sha"), F.col("old_sha256"), "sha256").alias("sha256"),
        F.when(later, F.col("old_http_status")).when(failed, F.coalesce(F.when(F.col("error").isNull(), F.col("http_status")), F.when(kept, F.col("old_http_status")))).otherwise(F.col("http_status")).cast("int").alias("http_status"),
        value(F.col("content_type"), F.col("old_content_type"), "content_type").alias("content_type"),
        F.when(later, F.col("old_status")).when(~failed, "ok").when(kept, "stale").otherwise("error").alias("status"),
        value(file, file, "file").alias("file"),
        F.when(later, F.col("old_error")).when(failed, F.col("problem")).alias("error"),
    )


_RESPONSE = "document_id string, body binary, http_status int, content_type string, final_url string, error string"


def _got(documents: DataFrame, get: Callable[[str], tuple[bytes, int, str, str]], per_host: int) -> DataFrame:
    """One request for each (document_id, url), made in the tasks; what ``get`` raises becomes the row's error.

    A host's requests are dealt to ``per_host`` tasks at most, each of which makes one at a time.  Answers are written
    before they are read, so what is lost later is read again and not asked for again."""
    spark = documents.sparkSession

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for document_id, url in zip(f["document_id"], f["url"]):
                try:
                    body, status, kind, final = get(url)
                    out.append((document_id, body, status, kind, final, f"HTTP {status}" if status >= 400 else None))
                except Exception as e:  # noqa: BLE001  (any transport failure is a failed row)
                    out.append((document_id, None, None, None, None, str(e).strip() or type(e).__name__))
            yield pd.DataFrame(out, columns=["document_id", "body", "http_status", "content_type", "final_url", "error"])

    host = F.coalesce(F.try_parse_url("url", F.lit("HOST")), F.lit(""))
    dealt = documents.select("document_id", "url").withColumn("host", host).withColumn("slot", F.pmod(F.xxhash64("url"), F.lit(per_host)))
    at = fresh_path(spark, "answers")
    dealt.repartition("host", "slot").select("document_id", "url").mapInPandas(run, _RESPONSE).write.parquet(at)
    return spark.read.schema(_RESPONSE).parquet(at)


def fetch(documents: DataFrame, get: Callable[[str], tuple[bytes, int, str, str]], per_host: int = 2) -> DataFrame:
    """(document_id, body, http_status, content_type, final_url, error) by ``get(url)`` in the tasks.

    ``get`` returns body, status, content type and final URL; what it raises becomes the row's error.
    A landing page is followed to its best English PDF (``best_links``); the cited URL stays
    the registry's.  The requests are made when this is called, at most ``per_host`` of a host at a time; answers stand in
    the shared folder.
    """
    from passagework.operators.html_blocks import html_links

    first = _got(documents.withColumn("url", F.col("source_url")), get, per_host)
    landing = documents.where("landing_page").select("document_id").join(first.where("error is null"), "document_id")
    best = best_links(html_links(landing.select("document_id", F.col("final_url").alias("base_url"), F.make_valid_utf8(F.col("body").cast("string")).alias("html"))))
    second = _got(best.withColumn("url", F.col("href")), get, per_host)
    is_pdf = F.startswith(F.ltrim(F.decode(F.substring("body", 1, 1024), "ISO-8859-1"), F.lit(" \t\n\r\x0b\x0c")), F.lit("%PDF"))
    problem = F.when(F.col("error").isNull() & ~is_pdf, F.lit("English PDF link did not return a PDF")).otherwise(F.col("error"))
    followed = second.withColumn("error", problem)
    lost = landing.join(best, "document_id", "left_anti")
    columns = [c.split()[0] for c in _RESPONSE.split(", ")]
    none = [F.lit(None).cast(c.split()[1]).alias(c.split()[0]) for c in _RESPONSE.split(", ")[1:-1]]
    # A page that led nowhere has no body of its own.
    failed = followed.where("error is not null").select("document_id", *none, "error").unionByName(lost.select("document_id", *none, F.lit("no English PDF link on the publication page").alias("error")))
    rest = first.join(landing.select("document_id"), "document_id", "left_anti")
    return rest.select(columns).unionByName(followed.where("error is null").select(columns)).unionByName(failed.select(columns))


def stop_on_failure(manifest: DataFrame) -> None:
    """Raises for the first row, in registry order, that is not ok."""
    bad = manifest.where("status <> 'ok'").orderBy("ordinal").first()
    if bad is not None:
        raise FetchError(bad.document_id, bad.error or "download failed")
