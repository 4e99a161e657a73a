"""Crawl bookkeeping scenario derived from the stored ``pages`` table (M1-M5, SC4, G1, G2, A6).

The queue, domain statistics, fetch log, outcome log and robots cache are derived row by row from the
pages (their canonical url, domain, id and links), so every job's work grows with the table. Links are
read before element removal (K7 option): in this table every link sits inside ``<nav>``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import frontier as fr
from tidemark.operators import robots as rb
from tidemark.operators.util import materialize
from tidemark.plans.pages import extract_pages

BASE_TS = "2024-01-01 10:00:00"
AS_OF = "2024-01-01 10:05:00"
AGENTS = ["TidemarkBot/1.0", "GleanerBot/2.0"]
# robots.txt texts handed out to domains by length(domain) % 3
ROBOTS_TEXTS = [
    "",
    "User-agent: *\nDisallow: /en/\nCrawl-delay: 2\n\nUser-agent: TidemarkBot\nDisallow: /fr/\nAllow: /fr/1\n",
    "# house rules\nUser-agent: *\nDisallow: /\nAllow: /de/*$\n\nUser-agent: OtherBot\nUser-agent: TidemarkBot\n"
    "Disallow: /es/\nAllow: /es/*5$\nCrawl-delay: 5\n",
]


# the text that every domain had three days before its latest one
OLD_ROBOTS_TEXT = "User-agent: *\nDisallow: /\n"
PAGE_BUDGET, MAX_PAGES_PER_DOMAIN, MAX_DEPTH, MAX_BODY_BYTES = 50, 200, 4, 10_000


def ts(text: str):
    return F.lit(text).cast("timestamp_ntz")


def crawled_pages(pages: DataFrame) -> DataFrame:
    """(page_id, url, domain, links), one row per canonical url (smallest page_id), materialised."""
    ex = extract_pages(pages, links_before_removal=True).filter(F.col("url").isNotNull())
    one = ex.groupBy("url").agg(F.min_by(F.struct("page_id", "domain", "links"), "page_id").alias("r"))
    return materialize(one.select(F.col("r.page_id").alias("page_id"), "url", "r.domain", "r.links"))


def queue_table(cp: DataFrame) -> DataFrame:
    pid = F.col("page_id")
    disc = ts(BASE_TS) + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), pid.cast("decimal(18,6)"))
    status = F.when(F.pmod(pid, F.lit(6)) == 0, "done").when(F.pmod(pid, F.lit(6)) == 1, "failed").otherwise("pending")
    done_like = status.isin("done", "failed")
    return cp.select(
        pid.alias("id"), "url", "domain", F.pmod(pid, F.lit(5)).cast("int").alias("depth"), status.alias("status"),
        disc.alias("discovered_at"),
        F.when(done_like, disc + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0),
                                                    F.pmod(pid, F.lit(3)).cast("decimal(18,6)"))).alias("processed_at"),
        F.when(status == "failed", F.lit("timeout of 8000ms exceeded")).alias("error"),
    )


def domain_stats_table(queue: DataFrame) -> DataFrame:
    d = F.col("domain")
    return queue.groupBy("domain").agg(
        F.count_if(F.col("status") == "done").cast("int").alias("pages_crawled"),
        F.max("processed_at").alias("last_fetched_at"),
    ).select(
        "domain", "pages_crawled", "last_fetched_at",
        (F.lit(1000) + F.pmod(F.length(d), F.lit(3)) * 1000).cast("int").alias("crawl_delay_ms"),
        (F.pmod(F.length(d), F.lit(7)) == 0).alias("disallowed"),
    )


def fetch_log_table(cp: DataFrame, pages: DataFrame) -> DataFrame:
    pid = F.col("page_id")
    status = F.when(F.pmod(pid, F.lit(11)) == 0, 404).when(F.pmod(pid, F.lit(11)) == 1, 301).otherwise(200)
    ctype = F.when(F.pmod(pid, F.lit(13)) == 0, "application/pdf").otherwise("text/html; charset=utf-8")
    return cp.join(pages.select("page_id", "html"), "page_id").select(
        "page_id", "url", "domain", status.cast("int").alias("status"), ctype.alias("content_type"), "html",
        F.lit(None).cast("string").alias("error"))


def outcome_log(cp: DataFrame, pages: DataFrame) -> DataFrame:
    """What a crawl round decides about each page: robots rules first, then the fetch gate.

    A page that the rules forbid is ``disallowed``; a robots delay is a ``touch``. Every fourth page also failed a minute before; pages with
    page_id % 5 = 1 were not tried.
    """
    gate = fr.fetch_gate(fetch_log_table(cp, pages), max_bytes=MAX_BODY_BYTES).withColumnRenamed("outcome", "gated")
    probes = cp.select(F.col("page_id").alias("probe_id"), "url", "domain", F.lit(AGENTS[0]).alias("agent"))
    permission = rb.check_permission(probes, robots_table(cp)).withColumnRenamed("probe_id", "page_id")
    lg = cp.select("url", "page_id", "domain").filter(F.pmod("page_id", F.lit(5)) != 1).join(gate, "url").join(permission, "page_id")
    t = ts(AS_OF) + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.col("page_id").cast("decimal(18,6)"))
    minute = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(1), F.lit(0))
    no_delay, no_error = F.lit(None).cast("int").alias("crawl_delay_ms"), F.lit(None).cast("string").alias("error")
    decided = F.when(~F.col("allowed"), "disallowed").when(F.col("gated") == "failed", "failed").otherwise("done")
    main = lg.select("url", "domain", decided.alias("outcome"), t.alias("ts"), no_delay, F.when(decided == "failed", F.col("error")).alias("error"))
    earlier = lg.filter(F.pmod("page_id", F.lit(4)) == 0).select(
        "url", "domain", F.lit("failed").alias("outcome"), (t - minute).alias("ts"), no_delay, F.lit("socket hang up").alias("error"))
    touch = lg.filter(F.col("crawl_delay_ms").isNotNull()).select(
        "url", "domain", F.lit("touch").alias("outcome"), t.alias("ts"), F.col("crawl_delay_ms").cast("int").alias("crawl_delay_ms"), no_error)
    return main.unionByName(earlier).unionByName(touch)


def robots_table(cp: DataFrame) -> DataFrame:
    d = F.col("domain")
    k = F.pmod(F.length(d), F.lit(3))
    text = F.when(k == 0, ROBOTS_TEXTS[0]).when(k == 1, ROBOTS_TEXTS[1]).otherwise(ROBOTS_TEXTS[2])
    hours = F.pmod(F.length(d), F.lit(48))
    fetched = ts(AS_OF) - F.make_dt_interval(F.lit(0), hours.cast("int"), F.lit(0), F.lit(0))
    latest = cp.select("domain").distinct().select("domain", text.alias("rules_text"), fetched.alias("fetched_at"))
    older = latest.select("domain", F.lit(OLD_ROBOTS_TEXT).alias("rules_text"),
                          (F.col("fetched_at") - F.make_dt_interval(F.lit(3), F.lit(0), F.lit(0), F.lit(0))).alias("fetched_at"))
    return older.unionByName(latest)


def probes_table(cp: DataFrame) -> DataFrame:
    rows = [cp.select((F.col("page_id") * 10 + i).alias("probe_id"), "url", "domain", F.lit(a).alias("agent"))
            for i, a in enumerate(AGENTS)]
    return rows[0].unionByName(rows[1])


def edges_table(cp: DataFrame) -> DataFrame:
    """The pages' links, and from each page n the pages 2n + 1 and 2n + 2, so that paths have several steps."""
    links = fr.discovered_links(cp.withColumn("depth", F.lit(0)))
    up = cp.select(F.floor((F.col("page_id") - 1) / 2).alias("parent"), F.col("url"))
    tree = cp.select(F.col("page_id").alias("parent"), F.col("url").alias("src_url")).join(up, "parent").select("src_url", "url")
    return links.select("src_url", "url").union(tree)


def first_of_domain(cp: DataFrame) -> DataFrame:
    return cp.groupBy("domain").agg(F.min_by("url", "page_id").alias("url")).select("url")
