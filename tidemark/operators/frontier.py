"""Crawl frontier as table jobs (M1-M5, SC4, J1, J7, PF4, PF9, PF10, A6, A8, A10, L2).

The queue is a table (id, url, domain, depth, status, discovered_at, processed_at, error) with a unique
url; domain_stats holds (domain, pages_crawled, last_fetched_at, crawl_delay_ms, disallowed).
Every job takes an explicit ``as_of`` so results repeat.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.urls import add_normalized_url, get_domain
from tidemark.operators.util import materialize

DEFAULT_DELAY_MS = 1000


def discovered_links(pages: DataFrame, max_depth: int | None = None) -> DataFrame:
    """M1 part 1: (src_url, depth, pos, url, domain) for pages (url, depth, links), with a limit those below it (PF10):
    links resolved against the page's own url (K19), invalid ones dropped (PF9), first occurrence per page
    kept (A10)."""
    src = (pages if max_depth is None else pages.filter(F.col("depth") < max_depth)).select(
        F.col("url").alias("src_url"), "depth", F.posexplode("links").alias("pos", "href"))
    norm = add_normalized_url(src, "href", "src_url", "url").filter(F.col("url").isNotNull())
    norm = norm.withColumn("domain", get_domain(F.col("url"))).filter(
        F.col("domain").isNotNull() & (F.length("domain") > 0))
    first = norm.groupBy("src_url", "url").agg(
        F.min("pos").alias("pos"), F.first("depth").alias("depth"), F.first("domain").alias("domain"))
    return first.select("src_url", "depth", "pos", "url", "domain")


def enqueue(links: DataFrame, queue: DataFrame, as_of: Column) -> DataFrame:
    """M1 part 2 (J7): new queue rows for urls not known in any status; a url found by several pages
    enters once, at its smallest depth + 1 (K15)."""
    new = links.join(queue.select("url"), "url", "left_anti")
    return new.groupBy("url").agg(
        F.first("domain").alias("domain"), (F.min("depth") + 1).cast("int").alias("depth"),
    ).select("url", "domain", "depth", F.lit("pending").alias("status"), as_of.alias("discovered_at"))


def seed_queue(seeds: DataFrame, queue: DataFrame, as_of: Column) -> DataFrame:
    """SC3 + M1 at depth 0: seed urls (url) are canonicalised against themselves, urls without a host are
    skipped, urls already queued in any status are ignored; returns the new pending rows."""
    norm = add_normalized_url(seeds.select(F.col("url").alias("seed")), "seed", "seed", "url")
    norm = norm.withColumn("domain", get_domain(F.col("url"))).filter(
        F.col("domain").isNotNull() & (F.length("domain") > 0))
    links = norm.select(F.col("seed").alias("src_url"), F.lit(-1).alias("depth"), "url", "domain")
    return enqueue(links, queue, as_of)


def eligible(queue: DataFrame, domain_stats: DataFrame, as_of: Column, max_pages: int | None = None,
             blocked: DataFrame | None = None) -> DataFrame:
    """PF4 over J1: pending, domain not disallowed (nor in the block list, M4), under the lifetime page cap if one is
    given (K11), delay elapsed (strict) or never fetched."""
    ds = domain_stats.select("domain", "pages_crawled", "last_fetched_at", "crawl_delay_ms", "disallowed")
    j = queue.filter(F.col("status") == "pending").join(ds, "domain", "left")
    if blocked is not None:
        j = j.join(blocked.select("domain"), "domain", "left_anti")
    delay = F.coalesce(F.col("crawl_delay_ms"), F.lit(DEFAULT_DELAY_MS))
    waited = F.col("last_fetched_at") < as_of - F.make_dt_interval(
        F.lit(0), F.lit(0), F.lit(0), (delay / F.lit(1000.0)).cast("decimal(18,6)"))
    ok = (
        ~F.coalesce(F.col("disallowed"), F.lit(False))
        & (F.lit(True) if max_pages is None else F.coalesce(F.col("pages_crawled"), F.lit(0)) < max_pages)
        & (F.col("last_fetched_at").isNull() | waited)
    )
    return j.filter(ok).select(queue.columns)


def fetch_list(queue: DataFrame, domain_stats: DataFrame, as_of: Column, budget: int | None = None,
               max_pages: int | None = None, blocked: DataFrame | None = None) -> DataFrame:
    """M2 / L2: at most one url per domain (its oldest), then the oldest ``budget`` overall if one is given.

    The per-domain pick is an aggregate (min_by), so a domain holding a large part of the queue is reduced
    map-side; the overall cut is a top-k (TakeOrderedAndProject)."""
    e = eligible(queue, domain_stats, as_of, max_pages, blocked)
    key = F.struct("discovered_at", "id")
    one = e.groupBy("domain").agg(F.min_by(F.struct(*[c for c in e.columns if c != "domain"]), key).alias("r"))
    rows = one.select("domain", "r.*")
    return (rows if budget is None else rows.orderBy("discovered_at", "id").limit(budget)).select(e.columns)


def fetch_schedule(queue: DataFrame, domain_stats: DataFrame, as_of: Column, horizon_ms: int, budget: int | None = None,
                   max_pages: int | None = None, blocked: DataFrame | None = None) -> DataFrame:
    """M2 over a horizon: what a crawler fetches until ``as_of`` + ``horizon_ms``, and when: the queue's columns and fetch_at.

    A domain's urls follow each other in order of discovery, each later than the one before by more than its delay (whole
    milliseconds); the first slot is ``as_of``, or the first moment at which the delay since its last fetch has passed. The lifetime page cap
    counts the pages to come. With a budget, the earliest slots are kept, ties in order of discovery. A url's turn in its domain is
    its place in its range of the sorted queue plus the counts of earlier ranges, so a domain with a large part of the queue is spread.
    """
    ds = domain_stats.select("domain", "pages_crawled", "last_fetched_at", "crawl_delay_ms", "disallowed")
    j = queue.filter(F.col("status") == "pending").join(ds, "domain", "left").filter(~F.coalesce(F.col("disallowed"), F.lit(False)))
    if blocked is not None:
        j = j.join(blocked.select("domain"), "domain", "left_anti")
    # written once, so that a row's range is a fact
    ranged = materialize(j.repartitionByRange("domain", "discovered_at", "id").withColumn("_part", F.spark_partition_id()))
    counts = ranged.groupBy("domain", "_part").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy("domain").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("domain", "_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    own = Window.partitionBy("domain", "_part").orderBy("discovered_at", "id")
    turn = ranged.withColumn("_own", F.row_number().over(own)).join(before, ["domain", "_part"]).withColumn("_turn", F.col("_before") + F.col("_own") - 1)
    step = F.coalesce(F.col("crawl_delay_ms"), F.lit(DEFAULT_DELAY_MS)).cast("long") + 1
    millis = lambda n: F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (n / F.lit(1000)).cast("decimal(18,6)"))
    free_at = F.greatest(as_of, F.col("last_fetched_at") + millis(step))  # greatest skips a null: never fetched
    out = turn.withColumn("fetch_at", free_at + millis(F.col("_turn") * step)).filter(F.col("fetch_at") < as_of + millis(F.lit(horizon_ms)))
    if max_pages is not None:
        out = out.filter(F.coalesce(F.col("pages_crawled"), F.lit(0)) + F.col("_turn") < max_pages)
    out = out if budget is None else out.orderBy("fetch_at", "discovered_at", "id").limit(budget)
    return out.select(*queue.columns, "fetch_at")


def fetch_gate(fetch_log: DataFrame, max_bytes: int | None = None) -> DataFrame:
    """SC4: classify fetch responses -> (url, outcome, error). 200-399 with an html content type and, if a limit is given, a body
    of at most ``max_bytes`` is indexed; other 2xx/3xx responses are finished without indexing; anything else failed, with
    its whole message."""
    status_ok = (F.col("status") >= 200) & (F.col("status") < 400)
    too_big = F.lit(False) if max_bytes is None else F.octet_length(F.coalesce(F.col("html"), F.lit(""))) > max_bytes
    html = F.contains(F.coalesce(F.col("content_type"), F.lit("")), F.lit("text/html"))
    err = F.coalesce(F.col("error"), F.concat(F.lit("Request failed with status code "), F.col("status").cast("string")))
    outcome = (
        F.when(~status_ok | too_big, F.lit("failed"))
        .when(~html, F.lit("skipped-non-html"))
        .otherwise(F.lit("indexed"))
    )
    error = F.when(too_big & status_ok, F.lit(f"maxContentLength size of {max_bytes} exceeded")).when(~status_ok, err)
    return fetch_log.select("url", outcome.alias("outcome"), error.alias("error"))


def fold_outcomes(queue: DataFrame, domain_stats: DataFrame, outcomes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """M3: outcome log (url, domain, outcome, ts, crawl_delay_ms, error) -> new queue and domain_stats.

    outcome is one of done, failed, disallowed, or touch (a robots delay seen before the decision). The
    latest outcome per url sets status and processed_at, a failure also the error (others leave it); per domain, ``done`` adds a page, done,
    failed and touch move last_fetched_at, and a known delay replaces the stored one (A8). domain_stats is
    merged by a full outer join with coalesce (new domains start at 0 pages and 1000 ms)."""
    final = outcomes.filter(F.col("outcome").isin("done", "failed", "disallowed")).groupBy("url").agg(
        F.max_by(F.struct("outcome", "ts", "error"), "ts").alias("o"))
    q = queue.join(final, "url", "left").select(
        *[c for c in queue.columns if c not in ("status", "processed_at", "error")],
        F.coalesce(F.col("o.outcome"), F.col("status")).alias("status"),
        F.coalesce(F.col("o.ts"), F.col("processed_at")).alias("processed_at"),
        F.when(F.col("o.outcome") == "failed", F.col("o.error")).otherwise(F.col("error")).alias("error"),
    ).select(queue.columns)
    touching = outcomes.filter(F.col("outcome").isin("done", "failed", "touch"))
    per_domain = touching.groupBy("domain").agg(
        F.count_if(F.col("outcome") == "done").cast("int").alias("add_pages"),
        F.max("ts").alias("new_fetched"),
        F.max_by("crawl_delay_ms", F.when(F.col("crawl_delay_ms").isNotNull(), F.col("ts"))).alias("new_delay"),
    )
    ds = domain_stats.join(per_domain, "domain", "full_outer").select(
        "domain",
        (F.coalesce(F.col("pages_crawled"), F.lit(0)) + F.coalesce(F.col("add_pages"), F.lit(0))).cast("int")
        .alias("pages_crawled"),
        F.coalesce(F.col("new_fetched"), F.col("last_fetched_at")).alias("last_fetched_at"),
        F.coalesce(F.col("new_delay"), F.col("crawl_delay_ms"), F.lit(DEFAULT_DELAY_MS)).cast("int")
        .alias("crawl_delay_ms"),
        F.coalesce(F.col("disallowed"), F.lit(False)).alias("disallowed"),
    )
    return q, ds


def block_domains(domain_stats: DataFrame, domains: DataFrame) -> DataFrame:
    """M4: set the disallowed flag for the listed domains (upsert)."""
    flagged = domains.select("domain").distinct().withColumn("_block", F.lit(True))
    return domain_stats.join(flagged, "domain", "full_outer").select(
        "domain",
        F.coalesce(F.col("pages_crawled"), F.lit(0)).cast("int").alias("pages_crawled"),
        "last_fetched_at",
        F.coalesce(F.col("crawl_delay_ms"), F.lit(DEFAULT_DELAY_MS)).cast("int").alias("crawl_delay_ms"),
        (F.coalesce(F.col("_block"), F.lit(False)) | F.coalesce(F.col("disallowed"), F.lit(False))).alias("disallowed"),
    )


def queue_counts(queue: DataFrame) -> DataFrame:
    """Rows per status."""
    return queue.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def bfs_depths(seeds: DataFrame, edges: DataFrame, max_depth: int) -> DataFrame:
    """M5: bounded breadth-first expansion; (url, depth) with the smallest depth at which a url is reached.

    seeds (url); edges (src_url, url). Each round joins the current frontier with the edges and drops urls already seen. Every
    round's own urls are written once; the seen set is the union of the rounds."""
    frontier = materialize(seeds.select("url", F.lit(0).alias("depth")).distinct())
    rounds = [frontier]
    # partitioned by source once and written: each round shuffles only the (small) frontier
    e = materialize(edges.select("src_url", "url").distinct().repartition("src_url"))
    for d in range(1, max_depth + 1):
        nxt = frontier.select(F.col("url").alias("src_url")).join(e, "src_url").select("url").distinct()
        for seen in rounds:
            nxt = nxt.join(seen.select("url"), "url", "left_anti")
        frontier = materialize(nxt.select("url", F.lit(d).alias("depth")))
        if frontier.isEmpty():
            break
        rounds.append(frontier)
    out = rounds[0]
    for more in rounds[1:]:
        out = out.unionByName(more)
    return out
