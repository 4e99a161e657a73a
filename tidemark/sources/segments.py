"""An index kept as immutable segments: a batch costs the batch, not the corpus (SC5, SC6, J6, R1-R5, ST2).

Every applied batch adds one segment below the root and one commit that names the live segments:

    segment=S/documents/doc_bucket=B/   inserted and updated documents
    segment=S/terms_of/doc_bucket=B/    their terms, so that a later replacement can take its share off the document frequencies
    segment=S/postings/term_bucket=B/   their postings, sorted by term
    segment=S/terms/term_bucket=B/      change of every term's document frequency, negative for replaced and deleted documents
    segment=S/dead/                     (doc_id, segment): rows of earlier segments that no longer count
    segment=S/seen/                     (doc_id, crawled_at) of documents found unchanged
    segment=S/sketch/                   Bloom bits of the segment's ids, one bitmap per (doc_bucket, block)
    segment=S/stats/                    change of the document count and the total length
    commits/commit=N/                   the live segments of commit N with their sizes, one row each
    log/                                one row (commit, batch) per complete commit, written last

A document's rows are told apart by (doc_id, segment), so a replacement writes a tombstone and new rows and touches nothing else.
An incoming id is tested against the sketches first; only buckets with a possible hit are opened, and the stored side of that lookup
is scanned in place, as the incoming keys are the small side. Segments of one size tier are merged when there are FANIN of them,
so there are a few per tier and a document is rewritten once per tier. A segment's folder counts come from its own size.
Writing is idempotent: an unfinished segment is overwritten by the next attempt, and a batch whose name is in the log is not applied again.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.index import Index, build_documents, count_terms, counted_runs, in_rows, run_frequencies
from tidemark.operators.util import bucket, buckets_for, materialize
from tidemark.sources.index_store import BY_TERM

FANIN = 4
DOCS_PER_BUCKET = 1 << 21
POSTINGS_PER_BUCKET = 1 << 26
ROWS_PER_FILE = 1 << 20
#: A document's row is about as large as so many postings.
POSTINGS_PER_DOCUMENT_ROW = 16
#: Bits of a sketch block (what a bitmap aggregate holds), bits per id, and positions set per id: about one false hit in a hundred.
BLOCK_BITS = 32768
BITS_PER_ID = 10
POSITIONS = 5

_DOCUMENTS = ("doc_id bigint, url string, domain string, title string, snippet string, body_length int, content_hash string, "
              "crawled_at timestamp_ntz, updated_at timestamp_ntz")
_TABLES = {
    "documents": f"{_DOCUMENTS}, doc_bucket int", "terms_of": "doc_id bigint, terms array<string>, doc_bucket int",
    "postings": "term string, doc_id bigint, tf_body int, tf_title int, doc_len int, term_bucket int",
    "terms": "term string, df bigint, term_bucket int", "dead": "doc_id bigint, segment bigint", "seen": "doc_id bigint, crawled_at timestamp_ntz",
    "sketch": "doc_bucket int, block int, bits binary", "stats": "doc_count bigint, total_length bigint",
}
_COMMIT = "segment bigint, n_docs bigint, n_dead bigint, doc_buckets int, term_buckets int, sketch_blocks int"


@dataclass(frozen=True)
class Segment:
    segment: int
    n_docs: int
    n_dead: int
    doc_buckets: int
    term_buckets: int
    sketch_blocks: int


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


class SegmentIndex(Index):
    """The live rows of a commit, as one index. Lookups go segment by segment, so that each prunes its own folders."""

    def __init__(self, store: SegmentStore, segments: list[Segment]):
        self.store, self.segments = store, segments
        super().__init__(documents=self._documents(), postings=self._all("postings").drop("term_bucket"), stats=self._stats(),
                         terms=self._sum(self._raw("terms")))

    def _raw(self, table: str) -> DataFrame:
        return _union([self.store.read(s, table) for s in self.segments] or [self.store.empty(table)])

    def _live(self, segment: Segment, rows: DataFrame) -> DataFrame:
        """``rows`` of one segment without the documents that later segments replaced."""
        later = [s for s in self.segments if s.segment > segment.segment and s.n_dead]
        if not later:
            return rows
        dead = _union([self.store.read(s, "dead") for s in later]).where(F.col("segment") == segment.segment)
        return rows.join(dead.select("doc_id"), "doc_id", "left_anti")

    def _all(self, table: str) -> DataFrame:
        return _union([self._live(s, self.store.read(s, table)) for s in self.segments] or [self.store.empty(table)])

    def _documents(self) -> DataFrame:
        """Live documents; an unchanged one carries the time it was last seen."""
        seen = self._raw("seen").groupBy("doc_id").agg(F.max("crawled_at").alias("seen_at"))
        docs = self._all("documents").drop("doc_bucket").join(seen, "doc_id", "left")
        return docs.withColumn("crawled_at", F.greatest("crawled_at", "seen_at")).drop("seen_at")

    def _stats(self) -> DataFrame:
        total = self._raw("stats").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("doc_count", "total_length")])
        return total.withColumn("avg_length", F.when(F.col("doc_count") > 0, F.col("total_length") / F.col("doc_count")).otherwise(F.lit(0.0)))

    @staticmethod
    def _sum(terms: DataFrame) -> DataFrame:
        return terms.groupBy("term").agg(F.sum("df").alias("df")).where(F.col("df") > 0)

    def _per_segment(self, table: str, asked: DataFrame, key: str, column: str, count: str) -> DataFrame:
        parts = []
        for s in self.segments:
            own = asked.where(F.col(key).isNotNull()).withColumn(column, bucket(F.col(key), getattr(s, count)))
            rows = self.store.read(s, table)
            parts.append(self._live(s, rows.join(own, [column, key])) if "doc_id" in rows.columns else rows.join(own, [column, key]))
        return _union(parts or [self.store.empty(table).join(asked, key)]).drop(column)

    def with_df(self, terms: DataFrame) -> DataFrame:
        known = self._per_segment("terms", terms.select("term").distinct(), "term", "term_bucket", "term_buckets")
        return terms.join(self._sum(known), "term").select(*terms.columns, "df")

    def matches(self, terms: DataFrame) -> DataFrame:
        return self._per_segment("postings", terms, "term", "term_bucket", "term_buckets")

    def narrowed(self, terms: DataFrame) -> Index:
        """The live rows of a few terms; every segment is read by literal folders and terms, as ``Index.narrowed`` says."""
        found = terms.select("term", F.xxhash64("term").alias("hash")).where(F.length("term") > 0).distinct().collect()
        values = sorted(r["term"] for r in found)

        def own(s: Segment, table: str) -> DataFrame:
            folders = sorted({r["hash"] % s.term_buckets for r in found})
            return self.store.read(s, table).where(F.col("term_bucket").isin(folders) & F.col("term").isin(values)).drop("term_bucket")

        postings = _union([self._live(s, own(s, "postings")) for s in self.segments] or [self.store.empty("postings").drop("term_bucket")])
        frequencies = _union([own(s, "terms") for s in self.segments] or [self.store.empty("terms")])
        return Index(documents=self.documents, postings=postings, stats=self.stats, terms=self._sum(frequencies))

    def documents_of(self, found: DataFrame) -> DataFrame:
        rows = self._per_segment("documents", found, "doc_id", "doc_bucket", "doc_buckets")
        return rows.select("doc_id", "url", "title", "snippet", *[c for c in found.columns if c != "doc_id"])


class SegmentStore:
    """Segments and commits below ``root``, a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, root: str, fanin: int = FANIN, docs_per_bucket: int = DOCS_PER_BUCKET,
                 postings_per_bucket: int = POSTINGS_PER_BUCKET, rows_per_file: int = ROWS_PER_FILE):
        self.spark, self.root, self.fanin = spark, root.rstrip("/"), fanin
        self.docs_per_bucket, self.postings_per_bucket, self.rows_per_file = docs_per_bucket, postings_per_bucket, rows_per_file

    # reading

    def read(self, segment: Segment, table: str) -> DataFrame:
        return self.spark.read.schema(_TABLES[table]).parquet(f"{self.root}/segment={segment.segment}/{table}")

    def empty(self, table: str) -> DataFrame:
        return self.spark.createDataFrame([], _TABLES[table])

    def _log(self) -> list[tuple[int, str]]:
        """(commit, batch) of the complete commits, oldest first: one short row per applied batch."""
        try:
            rows = self.spark.read.schema("commit bigint, batch string").parquet(f"{self.root}/log").distinct().collect()
        except AnalysisException:  # nothing was written yet
            return []
        return sorted((r.commit, r.batch) for r in rows)

    def segments(self, commit: int | None = None) -> list[Segment]:
        """The live segments of a commit, by default of the last one."""
        commits = [c for c, _ in self._log()]
        if not commits:
            return []
        rows = self.spark.read.schema(_COMMIT).parquet(f"{self.root}/commits/commit={commits[-1] if commit is None else commit}").collect()
        return [Segment(**r.asDict()) for r in sorted(rows, key=lambda r: r.segment)]

    def index(self, commit: int | None = None) -> SegmentIndex:
        return SegmentIndex(self, self.segments(commit))

    # lookups

    def possible(self, ids: DataFrame, segments: list[Segment]) -> DataFrame:
        """(segment, doc_bucket, doc_id): where the sketches don't rule ``ids`` (doc_id) out. No stored document is read."""
        parts = [self.empty("dead").select("segment", F.lit(0).alias("doc_bucket"), "doc_id")]
        for s in segments:
            if s.n_docs:
                asked = ids.select("doc_id").withColumns({"doc_bucket": bucket(F.col("doc_id"), s.doc_buckets), "block": _block(F.col("doc_id"), s.sketch_blocks)})
                hits = self.read(s, "sketch").join(asked, ["doc_bucket", "block"])
                hits = hits.where(reduce(Column.__and__, [_bit(F.col("bits"), p) for p in _positions(F.col("doc_id"))]))
                parts.append(hits.select(F.lit(s.segment).cast("long").alias("segment"), "doc_bucket", "doc_id"))
        return _union(parts)

    def lookup(self, ids: DataFrame, segments: list[Segment]) -> tuple[DataFrame, dict[int, list[int]]]:
        """The live stored rows of ``ids`` with their segment, and the buckets that were opened for them in each segment."""
        possible = materialize(self.possible(ids, segments))
        opened: dict[int, list[int]] = {}
        for r in possible.select("segment", "doc_bucket").distinct().collect():  # at most the number of folders
            opened.setdefault(r.segment, []).append(r.doc_bucket)
        view = SegmentIndex(self, segments)
        parts = [self.empty("documents").withColumn("segment", F.lit(0).cast("long"))]
        for s in segments:
            if s.segment in opened:
                stored = self.read(s, "documents").where(F.col("doc_bucket").isin(opened[s.segment]))
                keys = possible.where(F.col("segment") == s.segment).select("doc_id")
                parts.append(view._live(s, stored.join(keys, "doc_id")).withColumn("segment", F.lit(s.segment).cast("long")))
        return materialize(_union(parts)), opened

    # writing

    def _write(self, number: int, table: str, rows: DataFrame, n_rows: int, order: list[str], within=lambda rows: rows) -> None:
        """Range partitions by ``order`` (a bucket first where there is one), about ROWS_PER_FILE rows each; ``within`` works on rows of one range."""
        files = max(1, -(-n_rows // self.rows_per_file))
        rows = rows.repartitionByRange(files, *order) if files > 1 else rows.coalesce(1) if n_rows < 1000 else rows.repartition(1)
        writer = within(rows).sortWithinPartitions(*order).write.mode("overwrite")
        writer = writer.options(**BY_TERM) if "term" in order else writer
        writer = writer.partitionBy(order[0]) if order[0].endswith("_bucket") else writer
        writer.parquet(f"{self.root}/segment={number}/{table}")

    def _write_segment(self, number: int, documents: DataFrame, postings: DataFrame | None, terms_of: DataFrame | None, gone_terms: DataFrame | None,
                       dead: DataFrame, seen: DataFrame, stats: DataFrame, terms: DataFrame | None = None, runs: DataFrame | None = None) -> Segment:
        """All tables of one segment, from ``postings`` or ``runs`` of them. ``documents``, ``dead``, ``seen`` and ``runs`` are written tables already."""
        n_docs, n_words = documents.agg(F.count(F.lit(1)), F.coalesce(F.sum("body_length"), F.lit(0))).first()
        n_dead, n_seen = dead.count(), seen.count()
        # a document has at most as many postings as words, but for its title
        out = Segment(number, n_docs, n_dead, buckets_for(n_docs, self.docs_per_bucket), buckets_for(n_words, self.postings_per_bucket),
                      max(1, math.ceil(n_docs * BITS_PER_ID / BLOCK_BITS / buckets_for(n_docs, self.docs_per_bucket))))
        by_doc = bucket(F.col("doc_id"), out.doc_buckets)
        self._write(number, "documents", documents.withColumn("doc_bucket", by_doc), n_docs * POSTINGS_PER_DOCUMENT_ROW, ["doc_bucket", "doc_id"])
        by_term, order = bucket(F.col("term"), out.term_buckets), ["term_bucket", "term", "doc_id"]
        if runs is None:
            self._write(number, "postings", postings.withColumn("term_bucket", by_term), n_words, order)
        else:  # runs are dealt and sorted as they are, so that their postings come almost in order
            self._write(number, "postings", runs.withColumns({"term_bucket": by_term, "doc_id": F.get("doc_ids", F.lit(0))}), n_words, order,
                        lambda rows: in_rows(rows.sortWithinPartitions(*order).drop("doc_id"), "term_bucket"))
        written = self.read(out, "postings")
        if terms_of is None:
            terms_of = written.groupBy("doc_id").agg(F.collect_list("term").alias("terms"))
        # a row holds all terms of a document, so its words count, not its row: one task for a million documents would be the whole job's last
        self._write(number, "terms_of", terms_of.withColumn("doc_bucket", by_doc), n_words, ["doc_bucket", "doc_id"])
        if terms is None:
            terms = run_frequencies(runs)
            if gone_terms is not None:
                terms = terms.unionByName(gone_terms).groupBy("term").agg(F.sum("df").alias("df")).where(F.col("df") != 0)
        self._write(number, "terms", terms.withColumn("term_bucket", by_term), n_words, ["term_bucket", "term"])
        ids = documents.select(by_doc.alias("doc_bucket"), _block(F.col("doc_id"), out.sketch_blocks).alias("block"),
                               F.explode(F.array(*_positions(F.col("doc_id")))).alias("position"))
        bits = ids.groupBy("doc_bucket", "block").agg(F.bitmap_construct_agg("position").alias("bits"))
        self._write(number, "sketch", bits, out.doc_buckets * out.sketch_blocks, ["doc_bucket", "block"])
        self._write(number, "dead", dead.select("doc_id", "segment"), n_dead, ["segment", "doc_id"])
        self._write(number, "seen", seen.select("doc_id", "crawled_at"), n_seen, ["doc_id"])
        self._write(number, "stats", stats.select("doc_count", "total_length"), 1, ["doc_count"])
        return out

    def _commit(self, segments: list[Segment], batch: str) -> int:
        log = self._log()
        number = log[-1][0] + 1 if log else 0
        rows = self.spark.createDataFrame([tuple(s.__dict__.values()) for s in segments], _COMMIT)
        rows.coalesce(1).write.mode("overwrite").parquet(f"{self.root}/commits/commit={number}")
        self.spark.createDataFrame([(number, batch)], "commit bigint, batch string").coalesce(1).write.mode("append").parquet(f"{self.root}/log")
        return number

    def applied(self, batch: str) -> bool:
        return batch in {b for _, b in self._log()}

    def apply(self, corpus: DataFrame, as_of: Column, batch: str, gone: DataFrame | None = None, skipped: DataFrame | None = None) -> DataFrame:
        """Index a settled batch (doc_id, url, domain, title, snippet, body) and delete the ids of ``gone`` (doc_id).

        Returns the batch's modes (url, doc_id, mode, length_delta). Unchanged bodies keep their rows (K4, R4). An id in both is
        deleted; ids that are not stored delete nothing. Two urls with one id raise ValueError. A batch applied before changes nothing.
        """
        if self.applied(batch):
            return self.spark.createDataFrame([], "url string, doc_id bigint, mode string, length_delta bigint")
        segments = self.segments()
        number = 1 + max([s.segment for s in segments], default=-1)
        fresh = materialize(corpus)
        removed = materialize(gone.select("doc_id").distinct()) if gone is not None else self.empty("dead").select("doc_id")
        incoming = build_documents(fresh.join(removed, "doc_id", "left_anti"))
        stored, _ = self.lookup(incoming.select("doc_id").unionByName(removed).distinct(), segments)
        old = stored.select("doc_id", F.col("url").alias("old_url"), F.col("content_hash").alias("old_hash"), F.col("body_length").alias("old_length"),
                            F.col("segment").alias("old_segment"))
        joined = materialize(incoming.join(old, "doc_id", "left").withColumn(
            "mode", F.when(F.col("old_segment").isNull(), "inserted").when(F.col("content_hash") == F.col("old_hash"), "unchanged").otherwise("updated")))
        other_url = F.col("old_segment").isNotNull() & ~F.col("url").eqNullSafe(F.col("old_url"))
        n_rows, n_ids, n_clashes = joined.agg(F.count(F.lit(1)), F.count_distinct("doc_id"), F.count_if(other_url)).first()
        if n_rows != n_ids or n_clashes:
            raise ValueError("two documents have one id")
        changed = joined.where(F.col("mode") != "unchanged")
        documents = materialize(changed.select("doc_id", "url", "domain", "title", "snippet", "body_length", "content_hash",
                                               as_of.cast("timestamp_ntz").alias("crawled_at"), as_of.cast("timestamp_ntz").alias("updated_at")))
        seen = materialize(joined.where(F.col("mode") == "unchanged").select("doc_id", as_of.cast("timestamp_ntz").alias("crawled_at")))
        dead = materialize(stored.join(changed.select("doc_id").unionByName(removed), "doc_id", "left_semi").select("doc_id", "segment", "body_length"))
        delta = F.when(F.col("mode") == "unchanged", F.lit(0)).otherwise(F.col("body_length") - F.coalesce("old_length", F.lit(0))).cast("long")
        modes = joined.select("url", "doc_id", "mode", delta.alias("length_delta"))
        if skipped is not None:
            modes = modes.unionByName(skipped.select("url", F.lit(None).cast("long").alias("doc_id"), F.lit("skipped").alias("mode"), F.lit(0).cast("long").alias("length_delta")))
        added = documents.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("body_length"), F.lit(0)).alias("length"))
        lost = dead.agg(F.count(F.lit(1)).alias("n_lost"), F.coalesce(F.sum("body_length"), F.lit(0)).alias("lost"))
        stats = added.join(lost).select((F.col("n") - F.col("n_lost")).alias("doc_count"), (F.col("length") - F.col("lost")).alias("total_length"))  # one row each
        counted = materialize(count_terms(fresh.join(documents.select("doc_id"), "doc_id", "left_semi")))
        made = self._write_segment(number, documents, None, None, self._terms_lost(dead, segments), dead, seen, stats, runs=counted_runs(counted))
        self._commit([*segments, made], batch)
        self.compact()
        return modes

    def _terms_lost(self, dead: DataFrame, segments: list[Segment]) -> DataFrame:
        """(term, df): minus the number of ``dead`` rows with that term."""
        opened = {}
        for s in segments:
            opened[s.segment] = bucket(F.col("doc_id"), s.doc_buckets)
        parts = [self.empty("terms_of").select("terms")]
        for s in segments:
            if s.n_docs:
                own = dead.where(F.col("segment") == s.segment).select("doc_id", opened[s.segment].alias("doc_bucket"))
                parts.append(self.read(s, "terms_of").join(own, ["doc_bucket", "doc_id"]).select("terms"))
        return _union(parts).select(F.explode("terms").alias("term")).groupBy("term").agg((-F.count(F.lit(1))).alias("df"))

    # compaction

    def tier(self, segment: Segment) -> int:
        return int(math.log(max(1, segment.n_docs, segment.n_dead), self.fanin) + 1e-9)

    def due(self, segments: list[Segment]) -> list[Segment]:
        """The segments of the smallest tier that holds FANIN or more."""
        tiers: dict[int, list[Segment]] = {}
        for s in segments:
            tiers.setdefault(self.tier(s), []).append(s)
        return next((tiers[t] for t in sorted(tiers) if len(tiers[t]) >= self.fanin), [])

    def compact(self) -> list[int]:
        """Merge tiers until none is full; returns the numbers of the segments made. Readers of earlier commits keep their files."""
        made = []
        while merged := self.due(segments := self.segments()):
            number = 1 + max(s.segment for s in segments)
            view, old = SegmentIndex(self, segments), [s.segment for s in merged]

            def alive(table: str, view=view, merged=merged) -> DataFrame:
                return _union([view._live(s, self.read(s, table)) for s in merged])

            documents = materialize(alive("documents").drop("doc_bucket"))
            # tombstones of documents in segments that stay, and last sightings of documents that count
            dead = materialize(_union([self.read(s, "dead") for s in merged]).where(~F.col("segment").isin(old)))
            seen = materialize(_union([self.read(s, "seen") for s in merged]).groupBy("doc_id").agg(F.max("crawled_at").alias("crawled_at")))
            stats = _union([self.read(s, "stats") for s in merged]).agg(F.sum("doc_count").alias("doc_count"), F.sum("total_length").alias("total_length"))
            terms = _union([self.read(s, "terms") for s in merged]).groupBy("term").agg(F.sum("df").alias("df")).where(F.col("df") != 0)
            out = self._write_segment(number, documents, alive("postings").drop("term_bucket"), alive("terms_of").drop("doc_bucket"), None,
                                      dead, seen, stats, terms)
            made.append(number)
            self._commit([*[s for s in segments if s not in merged], out], f"merge into segment {number}")
        return made


def _block(doc_id: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(doc_id, F.lit("block")), F.lit(blocks)).cast("int")


def _positions(doc_id: Column) -> list[Column]:
    return [F.pmod(F.xxhash64(doc_id, F.lit(i)), F.lit(BLOCK_BITS)) for i in range(POSITIONS)]


def _bit(bits: Column, position: Column) -> Column:
    """Whether a bitmap's bit is set (lowest bit of the first byte first)."""
    byte = F.conv(F.hex(F.substring(bits, (F.floor(position / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return F.floor(byte / F.pow(F.lit(2), position % 8)) % 2 == 1
