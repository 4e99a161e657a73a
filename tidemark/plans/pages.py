"""Stored pages -> page corpus for the index (P1-P5, C1, C2, PF1, R1 order rule).

Each page is extracted, its url canonicalised (C1) and its host taken (C2). A document's id is a hash of its canonical
url, so it stays when the page moves to another page_id, and no two urls share one by accident of numbering
(``index_store.write_version`` refuses an index in which two do). Several pages may share a canonical url; indexing them one
after another, in order of arrival, page_id and content hash, skips pages without body text, leaves a document unchanged when
the body hash repeats (K4: title and snippet stay), and overwrites it when the body changes. The batch form reproduces that
end state with grouped aggregates only (no window over a url, so a url with very many pages is still combined map-side):

    last hash per url  ->  last page whose hash differs from it  ->  first page of the final run
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.html import add_page_fields
from tidemark.functions.text import body_hash
from tidemark.functions.urls import add_normalized_url, get_domain
from tidemark.operators.index import Index, build_index, skip_predicate
from tidemark.operators.util import materialize


URL_ID_DIGITS = 15


def url_id(url: Column) -> Column:
    """A document's id: 60 bits of the MD5 of its canonical url."""
    return F.conv(F.substring(F.md5(url), 1, URL_ID_DIGITS), 16, 10).cast("long")


def extract_pages(pages: DataFrame, links_before_removal: bool = False, max_links: int | None = None) -> DataFrame:
    """(page_id, raw_url, url, domain, title, snippet, body_text, links), and arrived_at where the pages have it."""
    more = ["arrived_at"] if "arrived_at" in pages.columns else []
    p = pages.select("page_id", F.col("url").alias("raw_url"), "html", *more)
    p = add_normalized_url(p, "raw_url", None, "url")
    p = add_page_fields(p, url="url", html="html", links_before_removal=links_before_removal, max_links=max_links)
    return p.select("page_id", "raw_url", "url", get_domain(F.col("url")).alias("domain"), "title", "snippet",
                    "body_text", "links", *more)


def settle_versions(extracted: DataFrame) -> DataFrame:
    """One row per canonical url: the end state of indexing its pages in order of (arrived_at, page_id, content hash).

    Output (doc_id, url, domain, title, snippet, body). A page that arrives twice with the same id and body counts once.
    """
    arrived = F.col("arrived_at") if "arrived_at" in extracted.columns else F.lit(None).cast("timestamp")
    kept = extracted.filter(skip_predicate(F.col("url"), F.col("body_text"))).withColumn("hash", body_hash(F.col("body_text")))
    kept = kept.withColumn("turn", F.struct(arrived.alias("arrived"), "page_id", "hash"))
    slim = kept.select("url", "turn")
    last = slim.groupBy("url").agg(F.max("turn").alias("last"))
    marked = slim.join(last, "url").withColumn("same", F.col("turn.hash") == F.col("last.hash"))
    brk = marked.groupBy("url").agg(F.max(F.when(~F.col("same"), F.col("turn"))).alias("last_diff"))
    final = marked.join(brk, "url").filter(F.col("same") & (F.col("last_diff").isNull() | (F.col("turn") > F.col("last_diff"))))
    start = final.groupBy("url").agg(F.min("turn").alias("turn"))
    winners = kept.join(start, ["url", "turn"]).dropDuplicates(["url"])
    return winners.select(url_id(F.col("url")).alias("doc_id"), "url", "domain", "title", "snippet", F.col("body_text").alias("body"))


def page_corpus(pages: DataFrame) -> DataFrame:
    """Extracted pages are written once: settling reads them several times, mostly for narrow columns, and the
    extraction (regexes over raw html) must not run once per reference."""
    extracted = materialize(extract_pages(pages).drop("links"))
    return settle_versions(extracted)


def index_pages(pages: DataFrame) -> Index:
    """The settled corpus is written once, as documents and terms are both read from it."""
    return build_index(materialize(page_corpus(pages)), require_url=True)
