"""Scores of many queries over postings in chunks of whole documents.

The postings stand in the shared folder as ``Index.runs`` or ``in_chunks`` write them: a row is a term with the documents of a chunk that
hold it, a file holds whole chunks, one after the other, and a document is in one chunk. The queries are dealt into blocks; a task holds one
block and reads the files chunk by chunk. It keeps the best ``limit`` documents and the number of hits of each of its queries, so what is
shuffled and written is the queries and their results, however many chunks there are, and postings are never shuffled for a search.
Only where there are fewer blocks of queries than cores, the files are dealt too, and a query is answered once for each share of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import bm25
from tidemark.operators.util import materialize, open_shared

#: Postings that a task holds at once, about (whole chunks), and terms, repeats counted, of a block of queries.
HELD_POSTINGS = 6 << 20
BLOCK_QUERY_TERMS = 1 << 19
#: Rows of a file that are read at once.
READ_ROWS = 1 << 15
#: A term that one of so many documents holds has a row of all documents, the most frequent ones first; numbers in all rows at most.
COMMON = 32
ROW_NUMBERS = 1 << 25


def in_chunks(rows: DataFrame, key: str, values: list[str], chunks: int) -> DataFrame:
    """``rows`` (key, doc_id, values) written in ``chunks`` chunks of documents: (chunk, key, n_docs, doc_ids, values), each value a list."""
    chunk = F.pmod(F.xxhash64("doc_id", F.lit("block")), F.lit(chunks)).cast("int")
    dealt = rows.select(chunk.alias("chunk"), key, "doc_id", *values).repartition(chunks, "chunk")
    packed = dealt.groupBy("chunk", key).agg(F.collect_list(F.struct("doc_id", *values)).alias("p")).sortWithinPartitions("chunk", key)
    return materialize(packed.select("chunk", key, F.size("p").alias("n_docs"), F.col("p.doc_id").alias("doc_ids"), *[F.col(f"p.{c}").alias(c) for c in values]))


def best_in_chunks(postings: DataFrame, asked: DataFrame, n_terms: int, limit: int, avg_safe: float | None = None,
                   block_query_terms: int = BLOCK_QUERY_TERMS, held_postings: int = HELD_POSTINGS) -> DataFrame:
    """(query_id, doc_id, score, part_rank, part_hits): the first ``limit`` documents of every query, in every share of the files.

    ``postings`` is a written table in chunks, of scores (key, doc_ids, score), or of counts (key, doc_ids, tf_body, tf_title, doc_len) with
    ``avg_safe``. ``asked`` (query_id, key, weight) has about ``n_terms`` rows; ``weight`` is the idf of a term, or 1.
    """
    cores, files = asked.sparkSession.sparkContext.defaultParallelism, sorted(postings.inputFiles())
    query_blocks = max(1, -(-n_terms // block_query_terms))
    if query_blocks >= cores:
        query_blocks = cores * -(-query_blocks // cores)  # so that no core waits for the last of them
    shares = max(1, min(len(files), -(-cores // query_blocks)))
    block = F.pmod(F.xxhash64("query_id"), F.lit(query_blocks)).cast("int")
    dealt = asked.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))))
    dealt = dealt.select((block * shares + F.col("share")).alias("cell"), "query_id", "key", "weight")
    kind = asked.schema["query_id"].dataType.simpleString()
    run = partial(_answered, files=files, shares=shares, limit=limit, avg_safe=avg_safe, held_postings=held_postings)
    return dealt.repartitionById(query_blocks * shares, "cell").mapInArrow(run, f"query_id {kind}, doc_id bigint, score double, part_rank int, part_hits bigint")


def _answered(batches: Iterator, files: list[str], shares: int, limit: int, avg_safe: float | None, held_postings: int) -> Iterator:
    """The rows of ``best_in_chunks`` for the blocks of queries in ``batches`` (cell, query_id, key, weight)."""
    import pyarrow as pa
    import pyarrow.compute as pc

    batches = list(batches)
    table = pa.Table.from_batches(batches) if batches else None
    for cell in pc.unique(table.column("cell")).to_pylist() if batches else ():
        queries = _Queries(table.filter(pc.equal(table.column("cell"), cell)), limit)
        for postings in _held(files[cell % shares :: shares], queries.keys, queries.weights, avg_safe, held_postings):
            queries.meet(_Documents(postings, queries))
        yield from queries.best().to_batches()
        del queries
    pa.default_memory_pool().release_unused()


def _held(files: list[str], keys, weights, avg_safe: float | None, held_postings: int) -> Iterator:
    """Lists of whole chunks as ``_one_chunk`` gives them, about ``held_postings`` postings at once. ``keys`` are the keys asked for, ``weights`` theirs."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc
    import pyarrow.parquet as pq

    values = ["score"] if avg_safe is None else ["tf_body", "tf_title", "doc_len"]
    held, n = [], 0
    for uri in files:
        begun, last = [], -1
        with open_shared(uri) as source:
            file = pq.ParquetFile(source)
            key = next(c for c in file.schema_arrow.names if c in ("term", "number"))
            for batch in file.iter_batches(READ_ROWS, columns=["chunk", key, "doc_ids", *values]):
                at = pc.index_in(batch.column(key), value_set=keys.cast(batch.column(key).type))
                # rows of documents have no chunk
                rows = pa.table([at, *[batch.column(c) for c in ("chunk", "doc_ids", *values)]], ["at", "chunk", "doc_ids", *values])
                rows = rows.filter(pc.and_(pc.is_valid(at), pc.is_valid(batch.column("chunk"))))
                chunks = rows.column("chunk").to_numpy()
                borders = [*np.flatnonzero(np.append(True, chunks[1:] != chunks[:-1])[: len(chunks)]).tolist(), len(chunks)]
                for a, b in zip(borders, borders[1:], strict=False):
                    if chunks[a] < last:
                        raise ValueError(f"chunks of {uri} are not one after the other")
                    if chunks[a] > last and begun:
                        held.append(_one_chunk(begun))
                        begun, n = [], n + len(held[-1][0])
                    if n >= held_postings:
                        yield held
                        held, n = [], 0
                    begun.append(_flat(rows.slice(a, b - a), weights, avg_safe))
                    last = chunks[a]
        if begun:
            held.append(_one_chunk(begun))
            n += len(held[-1][0])
    if n:
        yield held


def _flat(rows, weights, avg_safe: float | None) -> tuple:
    """Rows of postings in lists as postings (place of the key, score, doc_id)."""
    import numpy as np
    import pyarrow.compute as pc

    flat = lambda name: pc.list_flatten(rows.column(name)).combine_chunks()
    at = np.repeat(rows.column("at").to_numpy().astype(np.int32), pc.list_value_length(rows.column("doc_ids")).to_numpy())
    if avg_safe is None:
        return at, weights[at] * flat("score").to_numpy(), flat("doc_ids")
    body, title, length = (flat(c).to_numpy().astype(np.float64) for c in ("tf_body", "tf_title", "doc_len"))
    length = np.where(length > 0, length, avg_safe)
    return at, bm25.term_score(weights[at], body + bm25.TITLE_BOOST * title, length, avg_safe), flat("doc_ids")


def _one_chunk(parts: list[tuple]) -> tuple:
    """The parts of one chunk by document: places of the keys, scores, and the documents' number of postings, id, whether it is known."""
    import numpy as np
    import pyarrow as pa

    at, scores = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
    ids = pa.concat_arrays([p[2] for p in parts]).dictionary_encode("encode")
    docs, n = ids.indices.to_numpy(), len(ids.dictionary)
    order = np.argsort(docs.astype(np.uint16) if n <= 1 << 16 else docs, kind="stable")
    return at[order], scores[order], np.bincount(docs, minlength=n), ids.dictionary.fill_null(0).to_numpy(), ids.dictionary.is_valid().to_numpy(False)


class _Documents:
    """Some documents in ascending order of id, with their postings.

    By document the scores are exact. By term they are whole numbers of ``unit``, rounded up, in rows of all documents for terms that many of
    these hold and in lists for others: with them a query finds the few documents whose exact score can matter.
    """

    def __init__(self, chunks: list[tuple], queries: _Queries):
        import numpy as np

        terms, scores, sizes, ids, known = zip(*chunks, strict=True)
        self.terms, self.scores = terms, scores
        ids, known = np.concatenate(ids), np.concatenate(known)
        order = np.lexsort((ids, known))  # a null id first, as Spark sorts them
        self.known, self.ids, self.n = known[order], ids[order], len(order)
        place = np.empty(self.n, np.int32)
        place[order] = np.arange(self.n)
        self.chunk = np.repeat(np.arange(len(sizes)), [len(x) for x in sizes])[order]
        self.ends = np.concatenate([np.cumsum(x) for x in sizes])[order]
        self.sizes = np.concatenate(sizes)[order]

        n_terms = len(queries.weights)
        counts, self.highest = np.zeros(n_terms, np.int64), np.zeros(n_terms)
        for at, score in zip(terms, scores, strict=True):
            counts += np.bincount(at, minlength=n_terms)
            np.maximum.at(self.highest, at, score)
        self.most = queries.sums(self.highest)
        # the usual query stays below 2 ** 16 units, any single score below 20,000
        self.unit = max(float(np.median(self.most)) / 12_000, float(self.highest.max()) / 20_000, 1e-300)
        common = np.flatnonzero(counts * COMMON > self.n)
        common = common[np.argsort(-counts[common], kind="stable")][: ROW_NUMBERS // self.n]
        self.row = np.full(n_terms, -1, np.int32)
        self.row[common] = np.arange(len(common))
        self.rows, rare, n = np.zeros((len(common), self.n), np.uint16), [], 0
        for at, score, size in zip(terms, scores, sizes, strict=True):
            docs, units, row = np.repeat(place[n : n + len(size)], size), np.ceil(score / self.unit).astype(np.uint16), self.row[at]
            n, kept = n + len(size), row >= 0
            self.rows[row[kept], docs[kept]] = units[kept]
            rare.append((at[~kept], docs[~kept], units[~kept]))
        at, docs, units = map(np.concatenate, zip(*rare, strict=True))
        del rare
        at = np.argsort(at, kind="stable")
        self.docs, self.units = docs[at], units[at]
        counts[common] = 0
        self.last = np.append(0, np.cumsum(counts))
        self.asked = np.zeros(n_terms, bool)
        self.room = np.zeros(self.n, np.uint16), np.zeros(self.n)

    def sums(self, terms, most: float):
        """The units of each document for a query of ``terms``: not below its exact score, and above it by less than a unit a term."""
        import numpy as np

        few, many = self.room
        if most / self.unit + len(terms) < 65_000:
            return self._add(terms, few)
        # in parts of less than 60,000 units
        many[:] = 0
        part = np.cumsum(np.ceil(self.highest[terms] / self.unit)) // 40_000
        for some in np.split(terms, np.flatnonzero(np.diff(part)) + 1):
            many += self._add(some, few)
        return many

    def _add(self, terms, units):
        import numpy as np

        units[:] = 0
        spans = [slice(a, b) for a, b in zip(self.last[terms].tolist(), self.last[terms + 1].tolist(), strict=True) if a < b]
        if spans:
            np.add.at(units, np.concatenate([self.docs[s] for s in spans], dtype=np.intp), np.concatenate([self.units[s] for s in spans]))
        rows = self.row[terms]
        for k in rows[rows >= 0].tolist():
            np.add(units, self.rows[k], units)
        return units

    def exact(self, terms, some):
        """The scores of the documents at ``some`` for a query of ``terms``."""
        import numpy as np

        sizes = self.sizes[some]
        spans = [(k, slice(b - n, b)) for k, b, n in zip(self.chunk[some].tolist(), self.ends[some].tolist(), sizes.tolist(), strict=True)]
        self.asked[terms] = True
        kept = self.asked[np.concatenate([self.terms[k][s] for k, s in spans])]
        self.asked[terms] = False
        return np.bincount(np.repeat(np.arange(len(some)), sizes)[kept], np.concatenate([self.scores[k][s] for k, s in spans])[kept], len(some))


class _Queries:
    """One block of queries, with the best documents of each so far."""

    def __init__(self, rows, limit: int):
        import numpy as np

        names, keys = (rows.column(c).combine_chunks().dictionary_encode("encode") for c in ("query_id", "key"))
        self.limit, self.names, self.keys = limit, names.dictionary, keys.dictionary
        at = keys.indices.to_numpy()
        self.weights = np.empty(len(self.keys))
        self.weights[at] = rows.column("weight").to_numpy()
        query = names.indices.to_numpy()
        self.terms = at[np.argsort(query, kind="stable")].astype(np.int64)
        self.starts = np.append(0, np.cumsum(np.bincount(query, minlength=len(self.names))))
        self.hits = np.zeros(len(self.names), np.int64)
        #: (rank keys, scores, ids, known) in order of rank, at most ``limit``.
        self.found: list[tuple | None] = [None] * len(self.names)

    def sums(self, of_term):
        """For each query, the sum over its terms."""
        import numpy as np

        return np.add.reduceat(of_term[self.terms], self.starts[:-1])

    def meet(self, block: _Documents) -> None:
        import numpy as np

        for i in np.flatnonzero(block.most).tolist():
            terms = self.terms[self.starts[i] : self.starts[i + 1]]
            units = block.sums(terms, block.most[i])
            hits = np.count_nonzero(units > 0)
            self.hits[i] += hits
            self._keep(i, terms, units, hits, block)

    def _keep(self, i: int, terms, units, hits: int, block: _Documents) -> None:
        import numpy as np

        found, limit, least = self.found[i], self.limit, 1.0
        full = found is not None and len(found[0]) == limit
        if full:
            least = (found[0][-1] - 1e-8) / block.unit - 1
        elif hits > limit:
            least = float(np.partition(units, block.n - limit)[block.n - limit]) - len(terms) - 1
        some = np.flatnonzero(units >= max(1, min(int(least), 1 << 62)) if units.dtype != np.uint16 or least < 65_536 else [])
        if not len(some):
            return
        scores = block.exact(terms, some)
        if full:
            above = scores >= found[0][-1] - 1e-8
            some, scores = some[above], scores[above]
            if not len(some):
                return
        new = np.round(scores, 9), scores, block.ids[some], block.known[some]
        if found:
            new = tuple(map(np.concatenate, zip(found, new, strict=True)))
        order = np.lexsort((new[2], new[3], -new[0]))[:limit]
        self.found[i] = tuple(x[order] for x in new)

    def best(self):
        import numpy as np
        import pyarrow as pa

        some = [i for i, f in enumerate(self.found) if f]
        counts = [len(self.found[i][0]) for i in some]
        joined = lambda k, kind: np.concatenate([self.found[i][k] for i in some] or [np.empty(0, kind)])
        return pa.table({
            "query_id": self.names.take(pa.array(np.repeat(some, counts).astype(np.int64))),
            "doc_id": pa.array(joined(2, np.int64), mask=~joined(3, bool)),
            "score": joined(1, np.float64),
            "part_rank": pa.array(np.concatenate([np.arange(1, n + 1) for n in counts] or [np.empty(0)]).astype(np.int32)),
            "part_hits": pa.array(np.repeat(self.hits[some], counts).astype(np.int64)),
        })
