"""Registered queries: name -> (spark, sf_dir) -> DataFrame. Each reads whole input tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.urls import add_normalized_url, classify_source, get_domain
from tidemark.operators import index as ix
from tidemark.operators import rank
from tidemark.plans import pages as pg
from tidemark.sources.tables import read_table

Query = Callable[[SparkSession, str], DataFrame]


def _dealt(df: DataFrame) -> DataFrame:
    """A small table can be one row group: dealt out once, so that every core takes part in the row work. A larger one stays as it is scanned."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def _documents_index(spark: SparkSession, sf_dir: str) -> ix.Index:
    return ix.index_documents_table(_dealt(read_table(spark, sf_dir, "documents", ["doc_id", "text"])))


def benchmark_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("query_id"), F.col("text").alias("query")
    )


def conversation_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn is a query; its id is the conversation and the turn, written out."""
    conv = read_table(spark, sf_dir, "conversations")
    return conv.select(F.concat_ws("/", "conv_id", "turn").alias("query_id"), F.col("text").alias("query"))


def q_postings(spark, sf_dir):
    return _documents_index(spark, sf_dir).postings.select("term", "doc_id", "tf_body", "tf_title")


def q_doc_lengths(spark, sf_dir):
    return _documents_index(spark, sf_dir).documents.select("doc_id", "body_length")


def q_corpus_stats(spark, sf_dir):
    return _documents_index(spark, sf_dir).stats


def q_doc_freq(spark, sf_dir):
    return _documents_index(spark, sf_dir).terms


def q_stem_vocab(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents", ["doc_id", "text"])
    words = docs.select(F.explode(ix.index_words(F.col("text"))).alias("word"))
    return ix.stem_table(words)


def q_query_terms(spark, sf_dir):
    return rank.query_terms(benchmark_queries(spark, sf_dir))


def _bm25(cap, limit, queries=benchmark_queries) -> Query:
    def run(spark, sf_dir):
        return rank.bm25_search(_documents_index(spark, sf_dir), queries(spark, sf_dir), limit=limit,
                                max_postings_per_term=cap)
    return run


def _pages(spark, sf_dir):
    return _dealt(read_table(spark, sf_dir, "pages"))


def q_page_fields(spark, sf_dir):
    ex = pg.extract_pages(_pages(spark, sf_dir))
    return ex.select("page_id", "url", "domain", "title", "snippet", "body_text",
                     F.size("links").alias("n_links"))


def q_page_links(spark, sf_dir):
    """Links with the K7 option (read before element removal), resolved against the page's url."""
    ex = pg.extract_pages(_pages(spark, sf_dir), links_before_removal=True)
    links = ex.select("page_id", F.col("url").alias("base"), F.posexplode("links").alias("pos", "href"))
    return add_normalized_url(links, "href", "base", "link_url").select(
        "page_id", F.col("pos").cast("int").alias("pos"), "href", "link_url")


def q_url_norm(spark, sf_dir):
    ex = pg.extract_pages(_pages(spark, sf_dir))
    return ex.select("page_id", "raw_url", "url", "domain", classify_source(F.col("url")).alias("source"))


def q_page_documents(spark, sf_dir):
    return pg.index_pages(_pages(spark, sf_dir)).documents


def q_page_postings(spark, sf_dir):
    return pg.index_pages(_pages(spark, sf_dir)).postings.select("term", "doc_id", "tf_body", "tf_title")


ENTITY_FORMS = ('<a data-href="/lost" href="/found?x=1&amp;y=2" title="p > q">more</a><p title="a > b">caf&#233; &eacute;t&eacute; &#8217;&#x2014;&mdash; '
                '&amp;lt; &#146; &nosuch; &#0;</p><nav-bar>bar</nav-bar><!-- <a href="/hidden">h</a> -->')
#: Nested, unclosed and mis-nested elements, tags of thousands of characters, and references without a semicolon.
HARD_MARKUP = (
    "<p>|</p><nav>one<nav>two</nav>three</nav><div><footer>open</div>after |<form><form>in</form>tail |</form><button>a<button>b</button>kept |"
    "<header><div></header>out </div>|<p title=don't class=x>apostrophe </p>|<img alt=\"a>b\" src=data:" + "A" * 8000 + "><i"
    + "".join(f' data-{n}="{n}>"' for n in range(200)) + "></i><a class href=/" + "x" * 3000 + ">long</a> |<!-->shown <!-- x --!>|"
    '&copy 2020 &ampx &notit; &notin; &#233 &#xe9 x |<a href="?a=1&copy=2&amp;lt=3&lt">refs</a>|<textarea><b>typed</b></textarea> |'
    '<script>"</nav><a href=/s>"</script>1 < 2 |')
#: Hosts handed out by page_id % 7, so that every source class occurs.
HOSTS = ["en.wikipedia.org", "www.youtube.com", "youtu.be", "www.instagram.com", "web.archive.org", "", "example.org"]


def _with_entities(pages):
    """The pages with the harder forms of markup in front of each article."""
    return pages.withColumn("html", F.replace(F.col("html"), F.lit("<article>"), F.lit("<article>" + ENTITY_FORMS)))


def _varied_hosts(pages):
    hosts = F.element_at(F.array(*[F.lit(h) for h in HOSTS]), (F.pmod("page_id", F.lit(len(HOSTS))) + 1).cast("int"))
    own = F.regexp_extract("url", r"^https?://([^/?#]*)", 1)
    rest = F.regexp_replace("url", r"^https?://[^/?#]*", "")
    return pages.withColumn("url", F.concat(F.lit("https://"), F.when(F.length(hosts) > 0, hosts).otherwise(own), rest))


def q_page_entities(spark, sf_dir):
    ex = pg.extract_pages(_with_entities(_pages(spark, sf_dir)))
    return ex.select("page_id", "title", "snippet", "body_text", F.array_join("links", " ").alias("links"))


def q_page_markup(spark, sf_dir):
    pages = _pages(spark, sf_dir).withColumn("html", F.replace(F.col("html"), F.lit("<article>"), F.lit("<article>" + HARD_MARKUP)))
    ex = pg.extract_pages(pages)
    return ex.select("page_id", "title", "snippet", "body_text", F.array_join("links", " ").alias("links"))


def _page_hits(spark, sf_dir, pages=None, queries=None, limit=20):
    idx = pg.index_pages(_pages(spark, sf_dir) if pages is None else pages)
    res = rank.bm25_search(idx, benchmark_queries(spark, sf_dir) if queries is None else queries, limit=limit)
    return rank.with_document_fields(res, idx.documents)


def q_page_search(spark, sf_dir):
    return _page_hits(spark, sf_dir)


def _varied_hits(spark, sf_dir):
    return _page_hits(spark, sf_dir, pages=_varied_hosts(_pages(spark, sf_dir)))


def q_source_counts(spark, sf_dir):
    return rank.tab_counts(_varied_hits(spark, sf_dir))


def q_tab_results(spark, sf_dir):
    """PF7, L4, PF13: the youtube tab, at most three results a query, with the address as displayed."""
    from tidemark.functions.urls import display_url

    rows = rank.tab_filter(_varied_hits(spark, sf_dir), "youtube", 3)
    return rows.select("query_id", F.col("tab_rank").cast("int").alias("tab_rank"), "id", display_url(F.col("url"), 30).alias("shown"))


def q_first_result(spark, sf_dir):
    """L3: the first result of every query only."""
    return _page_hits(spark, sf_dir, limit=1).select("query_id", "rank", "id", "score", "total_hits")


def q_search_response(spark, sf_dir):
    """SC7, U2, PF8: the answer to each query, the card in front; blank, stop-word and dictionary-word queries among them."""
    from tidemark.operators import enrich
    from tidemark.plans import activity

    asked = read_table(spark, sf_dir, "events").select(F.col("event_type").alias("query")).distinct()
    asked = asked.select((-2 - F.row_number().over(Window.orderBy("query"))).cast("long").alias("query_id"), "query")
    fixed = spark.createDataFrame([(-1, "   "), (-2, "the a an")], "query_id long, query string")
    queries = benchmark_queries(spark, sf_dir).unionByName(fixed).unionByName(asked)
    hits = _page_hits(spark, sf_dir, queries=queries, limit=5)
    cards = enrich.cards_for_queries(queries, activity.dictionary_table(spark))
    out = rank.search_response(queries, enrich.with_cards(hits, cards))
    return out.select("query_id", "query", F.col("totalHits").alias("total_hits"),
                      F.array_join(F.transform("results", lambda r: r["id"]), " ").alias("ids"),
                      F.array_join(F.transform("results", lambda r: F.coalesce(r["source"], F.lit("-"))), " ").alias("sources"))


def q_bm25_stored(spark, sf_dir):
    """The benchmark queries on a stored index: written as a version, read back, searched with folder pruning."""
    import uuid

    from tidemark.session import ensure_checkpoint_dir
    from tidemark.sources import index_store

    root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/stored-{uuid.uuid4().hex}"
    index_store.write_version(_documents_index(spark, sf_dir), root, 1)
    return rank.bm25_search(index_store.read_version(spark, root, 1), benchmark_queries(spark, sf_dir), 20)


def q_bm25_lookup(spark, sf_dir):
    """One query string, the three words that most benchmark items hold, on a stored index read only where they occur."""
    import uuid

    from tidemark.functions.text import index_words
    from tidemark.session import ensure_checkpoint_dir
    from tidemark.sources import index_store

    root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/stored-{uuid.uuid4().hex}"
    index_store.write_version(_documents_index(spark, sf_dir), root, 1)
    words = benchmark_queries(spark, sf_dir).select("query_id", F.explode(index_words(F.col("query"))).alias("word")).distinct()
    most = words.groupBy("word").count().orderBy(F.col("count").desc(), "word").limit(3).collect()
    return rank.search_one(index_store.read_version(spark, root, 1), " ".join(r["word"] for r in most), 20)


def _reindex(spark, sf_dir):
    from tidemark.plans import maintenance

    return maintenance.run(_pages(spark, sf_dir))


def q_reindex_modes(spark, sf_dir):
    return _reindex(spark, sf_dir).modes


def q_reindex_documents(spark, sf_dir):
    return _reindex(spark, sf_dir).documents_ts


def q_reindex_postings(spark, sf_dir):
    return _reindex(spark, sf_dir).index.postings.select("term", "doc_id", "tf_body", "tf_title")


def q_reindex_stats(spark, sf_dir):
    return _reindex(spark, sf_dir).index.stats


def q_recrawl_same_id(spark, sf_dir):
    from tidemark.plans import maintenance

    return maintenance.recrawled_same_id(_pages(spark, sf_dir))


def q_recrawl_moved_url(spark, sf_dir):
    from tidemark.plans import maintenance

    return maintenance.recrawled_moved_url(_pages(spark, sf_dir)).index.documents


def q_delete_documents(spark, sf_dir):
    from tidemark.plans import maintenance

    return maintenance.with_deletions(_pages(spark, sf_dir)).postings.select("term", "doc_id", "tf_body", "tf_title")


def q_delete_stats(spark, sf_dir):
    from tidemark.plans import maintenance

    return maintenance.with_deletions(_pages(spark, sf_dir)).stats


def _segments(spark, sf_dir):
    from tidemark.plans import maintenance

    return maintenance.segment_store(_pages(spark, sf_dir))


def _with_df(index):
    return index.postings.select("term", "doc_id", "tf_body", "tf_title").join(index.terms, "term")


def q_segment_documents(spark, sf_dir):
    """R1-R4 by sketches, opened buckets and tombstones: the documents, what the last batch did to them, and the statistics kept by differences."""
    store, modes = _segments(spark, sf_dir)
    index = store.index()
    out = index.documents.join(modes.filter("mode <> 'skipped'").select("doc_id", "mode", "length_delta"), "doc_id", "left")
    return out.withColumns({c: index.stats.select(c).scalar() for c in ("doc_count", "total_length")})


def q_segment_postings(spark, sf_dir):
    """Live postings of merged and newest segments, with the document frequencies kept by differences."""
    return _with_df(_segments(spark, sf_dir)[0].index())


def q_segment_search(spark, sf_dir):
    index = _segments(spark, sf_dir)[0].index()
    return rank.with_document_fields(rank.bm25_search(index, benchmark_queries(spark, sf_dir)), index)


def q_segment_deletions(spark, sf_dir):
    from tidemark.plans import maintenance

    return _with_df(maintenance.segments_without(_pages(spark, sf_dir)).index())


#: Raw forms of a host, handed out by page_id % 12.
HOST_FORMS = ["müller.de", "MÜLLER.De:443", "0x7f.1", "017700000001", "[::1]:80", "[2001:DB8:0:0:1:0:0:1]", "[::ffff:192.168.0.1]", "bücher.例え.jp",
              "ex%41mple.org", "１２７．０．０．１", "a..b.test", "256.1.1.1"]


def q_url_hosts(spark, sf_dir):
    """Each page's address with its host in another written form, and a link that is relative to it in spite of its scheme."""
    forms = F.element_at(F.array(*[F.lit(h) for h in HOST_FORMS]), (F.pmod("page_id", F.lit(len(HOST_FORMS))) + 1).cast("int"))
    rest = F.regexp_replace("url", r"^https?://[^/?#]*", "")
    pages = read_table(spark, sf_dir, "pages", ["page_id", "url"]).select("page_id", F.concat(F.lit("https://"), forms, rest).alias("raw"), F.lit("HTTPS:next?b=1").alias("link"))
    out = add_normalized_url(add_normalized_url(pages, "raw", None, "url"), "link", "url", "next")
    return out.select("page_id", "url", get_domain(F.col("url")).alias("domain"), "next")


def _crawl(spark, sf_dir):
    from tidemark.plans import crawl

    pages = _pages(spark, sf_dir)
    cp = crawl.crawled_pages(pages)
    queue = crawl.queue_table(cp)
    return crawl, pages, cp, queue


def q_enqueue_new(spark, sf_dir):
    crawl, _, cp, queue = _crawl(spark, sf_dir)
    from tidemark.operators import frontier as fr

    links = fr.discovered_links(cp.join(queue.select("url", "depth"), "url"), max_depth=crawl.MAX_DEPTH)
    return fr.enqueue(links, queue, crawl.ts(crawl.AS_OF))


def q_fetch_list(spark, sf_dir):
    crawl, _, cp, queue = _crawl(spark, sf_dir)
    from tidemark.operators import frontier as fr

    return fr.fetch_list(queue, crawl.domain_stats_table(queue), crawl.ts(crawl.AS_OF), crawl.PAGE_BUDGET,
                         crawl.MAX_PAGES_PER_DOMAIN)


def q_fetch_gate(spark, sf_dir):
    crawl, pages, cp, _ = _crawl(spark, sf_dir)
    from tidemark.operators import frontier as fr

    return fr.fetch_gate(crawl.fetch_log_table(cp, pages), max_bytes=crawl.MAX_BODY_BYTES)


def _folded(spark, sf_dir):
    crawl, pages, cp, queue = _crawl(spark, sf_dir)
    from tidemark.operators import frontier as fr

    return fr.fold_outcomes(queue, crawl.domain_stats_table(queue), crawl.outcome_log(cp, pages))


def q_outcome_queue(spark, sf_dir):
    return _folded(spark, sf_dir)[0]


def q_outcome_domains(spark, sf_dir):
    return _folded(spark, sf_dir)[1]


def q_queue_counts(spark, sf_dir):
    from tidemark.operators import frontier as fr

    return fr.queue_counts(_folded(spark, sf_dir)[0])


def q_bfs_depth(spark, sf_dir):
    crawl, _, cp, _ = _crawl(spark, sf_dir)
    from tidemark.operators import frontier as fr

    return fr.bfs_depths(crawl.first_of_domain(cp), crawl.edges_table(cp), crawl.MAX_DEPTH)


def q_seed_queue(spark, sf_dir):
    """SC3, M1: the pages' addresses as seeds; every third page is queued already."""
    crawl, pages, _, queue = _crawl(spark, sf_dir)
    from tidemark.operators import frontier as fr

    known = queue.filter(F.pmod("id", F.lit(3)) == 0)
    return fr.seed_queue(pages.select("url"), known, crawl.ts(crawl.AS_OF))


def q_seed_files(spark, sf_dir):
    """SC3: the pages' addresses written as seed files, a JSON array each, read back and queued; every third page is queued already."""
    import uuid

    from tidemark.operators import frontier as fr
    from tidemark.session import ensure_checkpoint_dir
    from tidemark.sources.tables import read_seed_list, write_seed_lists

    crawl, pages, _, queue = _crawl(spark, sf_dir)
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/seeds-{uuid.uuid4().hex}"
    write_seed_lists(pages.select("url"), folder)
    return fr.seed_queue(read_seed_list(spark, folder).select("url"), queue.filter(F.pmod("id", F.lit(3)) == 0), crawl.ts(crawl.AS_OF))


def q_fetch_schedule(spark, sf_dir):
    """M2: five seconds of polite fetching, a fifth of the pages at most."""
    from tidemark.operators import frontier as fr

    crawl, _, cp, queue = _crawl(spark, sf_dir)
    budget = max(1, cp.count() // 5)
    return fr.fetch_schedule(queue, crawl.domain_stats_table(queue), crawl.ts(crawl.AS_OF), 5000, budget, crawl.MAX_PAGES_PER_DOMAIN)


def q_blocked_domains(spark, sf_dir):
    """M4: the domains of every ninth page are blocked."""
    crawl, _, cp, queue = _crawl(spark, sf_dir)
    from tidemark.operators import frontier as fr

    return fr.block_domains(crawl.domain_stats_table(queue), cp.filter(F.pmod("page_id", F.lit(9)) == 0).select("domain"))


def q_robots_allowed(spark, sf_dir):
    crawl, _, cp, _ = _crawl(spark, sf_dir)
    from tidemark.operators import robots as rb

    return rb.check_permission(crawl.probes_table(cp), crawl.robots_table(cp))


def q_robots_stale(spark, sf_dir):
    crawl, _, cp, _ = _crawl(spark, sf_dir)
    from tidemark.operators import robots as rb

    return rb.cache_state(crawl.robots_table(cp), crawl.ts(crawl.AS_OF))


def _events(spark, sf_dir):
    return read_table(spark, sf_dir, "events")


def q_recent_queries(spark, sf_dir):
    from tidemark.operators import history
    from tidemark.plans import activity

    return history.recent_queries(activity.history_table(_events(spark, sf_dir)))


def q_suggest(spark, sf_dir):
    from tidemark.operators import history
    from tidemark.plans import activity

    ev = _events(spark, sf_dir)
    return history.suggestions(activity.history_table(ev), activity.suggestion_inputs(ev))


def q_suggest_indexed(spark, sf_dir):
    """H3 through trigram postings."""
    from tidemark.operators import history
    from tidemark.plans import activity

    ev = _events(spark, sf_dir)
    h = activity.history_table(ev)
    return history.indexed_suggestions(h, history.trigram_postings(h), activity.suggestion_inputs(ev))


def q_backup_restore(spark, sf_dir):
    from tidemark.plans import activity

    return activity.backup_scenario(_events(spark, sf_dir))


def q_history_log(spark, sf_dir):
    from tidemark.plans import activity

    return activity.logged_history(_events(spark, sf_dir))


def q_word_cards(spark, sf_dir):
    from tidemark.plans import activity

    return activity.word_cards(_dealt(read_table(spark, sf_dir, "documents", ["doc_id", "text"])), read_table(spark, sf_dir, "benchmark"))


def q_result_flags(spark, sf_dir):
    from tidemark.operators import history
    from tidemark.plans import activity

    ev = _events(spark, sf_dir)
    return history.bookmark_flags(activity.shown_results(ev), activity.bookmarks_table(ev))


def q_restore_user(spark, sf_dir):
    from tidemark.plans import activity

    return activity.restore_scenario(_events(spark, sf_dir))


def q_history_edit(spark, sf_dir):
    from tidemark.plans import activity

    return activity.edit_scenario(_events(spark, sf_dir))


def q_dict_cards(spark, sf_dir):
    from tidemark.plans import activity

    return activity.dictionary_cards(spark, _events(spark, sf_dir))


def q_stream_index(spark, sf_dir):
    """ST1: the pages table arrives as 4 files, one micro-batch each; the final stored postings."""
    from tidemark.plans import streaming_run

    return streaming_run.stream_pages(spark, _pages(spark, sf_dir)).postings.select(
        "term", "doc_id", "tf_body", "tf_title")


QUERIES: dict[str, Query] = {
    "postings": q_postings,
    "doc_lengths": q_doc_lengths,
    "corpus_stats": q_corpus_stats,
    "doc_freq": q_doc_freq,
    "stem_vocab": q_stem_vocab,
    "query_terms": q_query_terms,
    "bm25_batch": _bm25(None, 20),
    "bm25_capped": _bm25(50, 20),
    "bm25_uncapped": _bm25(None, 20),
    "bm25_conversations": _bm25(None, 10, conversation_queries),
    "page_fields": q_page_fields,
    "page_links": q_page_links,
    "url_norm": q_url_norm,
    "page_documents": q_page_documents,
    "page_postings": q_page_postings,
    "page_search": q_page_search,
    "source_counts": q_source_counts,
    "reindex_modes": q_reindex_modes,
    "reindex_documents": q_reindex_documents,
    "reindex_postings": q_reindex_postings,
    "reindex_stats": q_reindex_stats,
    "enqueue_new": q_enqueue_new,
    "fetch_list": q_fetch_list,
    "fetch_gate": q_fetch_gate,
    "outcome_queue": q_outcome_queue,
    "outcome_domains": q_outcome_domains,
    "queue_counts": q_queue_counts,
    "bfs_depth": q_bfs_depth,
    "robots_allowed": q_robots_allowed,
    "robots_stale": q_robots_stale,
    "recent_queries": q_recent_queries,
    "suggest": q_suggest,
    "result_flags": q_result_flags,
    "restore_user": q_restore_user,
    "dict_cards": q_dict_cards,
    "stream_index": q_stream_index,
    "page_entities": q_page_entities,
    "page_markup": q_page_markup,
    "tab_results": q_tab_results,
    "first_result": q_first_result,
    "search_response": q_search_response,
    "bm25_stored": q_bm25_stored,
    "bm25_lookup": q_bm25_lookup,
    "recrawl_same_id": q_recrawl_same_id,
    "recrawl_moved_url": q_recrawl_moved_url,
    "delete_documents": q_delete_documents,
    "delete_stats": q_delete_stats,
    "segment_documents": q_segment_documents,
    "segment_postings": q_segment_postings,
    "segment_search": q_segment_search,
    "segment_deletions": q_segment_deletions,
    "url_hosts": q_url_hosts,
    "seed_files": q_seed_files,
    "fetch_schedule": q_fetch_schedule,
    "suggest_indexed": q_suggest_indexed,
    "backup_restore": q_backup_restore,
    "history_log": q_history_log,
    "word_cards": q_word_cards,
    "seed_queue": q_seed_queue,
    "blocked_domains": q_blocked_domains,
    "history_edit": q_history_edit,
}
