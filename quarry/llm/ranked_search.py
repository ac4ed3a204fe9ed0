"""Ranked lexical search over postings in shards of documents.

A shard is a row: some megabytes of texts as compressed sparse rows, a row a
term, each posting with its document's place in the shard and its impact, an
integer computed when the index is made. A query adds its terms up, one after
the other, in a dense array with a cell a document of the shard; the best of each
shard meet in the end.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import count
from math import floor, log

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import bounded_batches, byte_slices, give_back, written
from quarry.llm.word_runs import LOWERED, runs

SHARD_BYTES = 4 << 20
SHARD_DOCUMENTS = 1 << 15
BLOCK_TERMS = 200_000  # distinct terms of the queries that are searched in one pass
LENGTH_SHARE = 75  # percent of the length's part in the impact
_IS_TERM = np.frombuffer(LOWERED, dtype=np.uint8) != 32


def n_terms(text: bytes | None) -> int:
    """Terms of a text, repeats included, a megabyte at a time."""
    total, inside = 0, False
    for at in range(0, len(text or b""), 1 << 20):
        part = _IS_TERM[np.frombuffer(text, dtype=np.uint8, count=min(1 << 20, len(text) - at), offset=at)]
        total += int(np.count_nonzero(part[1:] & ~part[:-1])) + int(part[0] and not inside)
        inside = bool(part[-1])
    return total


def corpus_size(docs: DataFrame, text_col: str = "text") -> tuple[int, int]:
    """(documents that have a term, terms of all of them)."""
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = terms = 0
        for batch in batches:
            for text in batch.column("text"):
                m = n_terms(text.as_buffer())
                n, terms = n + (m > 0), terms + m
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([terms])], names=["n", "terms"])

    rows = docs.select(F.col(text_col).cast("binary").alias("text")).where("text is not null").mapInArrow(counted, "n bigint, terms bigint")
    r = rows.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("terms"), F.lit(0)).alias("terms")).head()
    return r["n"], r["terms"]


def _lists(parts: list[np.ndarray]) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, parts)]).astype(np.int32)), pa.array(np.concatenate(parts) if parts else np.zeros(0, dtype=np.int64)))


class _Shard:
    """Documents on their way into a shard."""

    def __init__(self) -> None:
        self.known: defaultdict[bytes, int] = defaultdict(count().__next__)
        self.keys: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []
        self.lengths: list[int] = []
        self.ids: list[int | None] = []
        self.bytes = 0

    def add(self, doc_id: int | None, text: bytes) -> None:
        length, place = 0, len(self.ids)
        for words in runs(text):
            own, n = np.unique(np.fromiter(map(self.known.__getitem__, words), dtype=np.int64, count=len(words)), return_counts=True)
            self.keys.append(own << 32 | place)
            self.counts.append(n)
            length += len(words)
        if length:
            self.ids.append(doc_id)
            self.lengths.append(length)
            self.bytes += len(text)

    def full(self) -> bool:
        return self.bytes >= SHARD_BYTES or len(self.ids) >= SHARD_DOCUMENTS

    def row(self, shard: int, n_docs: int, all_terms: int) -> pa.RecordBatch:
        keys, at = np.unique(np.concatenate(self.keys), return_inverse=True)
        tf = np.zeros(len(keys), dtype=np.int64)
        np.add.at(tf, at, np.concatenate(self.counts))
        m = 100 - LENGTH_SHARE + LENGTH_SHARE * np.array(self.lengths, dtype=np.int64) * n_docs // all_terms
        place = keys & 0xFFFFFFFF
        impact = 1_000_000_000 * tf // (1000 * tf + 8 * m[place])
        bounds = np.searchsorted(keys >> 32, np.arange(len(self.known) + 1))
        one = lambda a, kind: pa.ListArray.from_arrays(pa.array([0, len(a)], type=pa.int32()), pa.array(a, type=kind))
        columns = [pa.array([shard]), one(self.ids, pa.int64()), one(list(self.known), pa.binary()), one(bounds, pa.int32()), one(place, pa.int32()), one(impact, pa.int32())]
        return pa.RecordBatch.from_arrays(columns, names=["shard", "ids", "terms", "bounds", "places", "impacts"])


_INDEX = "shard bigint, ids array<bigint>, terms array<binary>, bounds array<int>, places array<int>, impacts array<int>"


def build(docs: DataFrame, n_docs: int, all_terms: int, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The index of all documents that have a term: a row a shard, ``(shard, ids,
    terms, bounds, places, impacts)``; term i's postings are at bounds[i] to
    bounds[i + 1]. Documents stay in the tasks that read them."""
    def sharded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        shard = _Shard()
        try:
            for batch in batches:
                for some in byte_slices(batch, "text"):
                    for doc_id, text in zip(some.column("id").to_pylist(), some.column("text").to_pylist(), strict=True):
                        shard.add(doc_id, text)
                        if shard.full():
                            yield shard.row(number, n_docs, all_terms)
                            number, shard = number + 1, _Shard()
            if shard.ids:
                yield shard.row(number, n_docs, all_terms)
        finally:
            del shard
            give_back()

    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("binary").alias("text")).where("text is not null")
    return rows.mapInArrow(sharded, _INDEX)


def document_frequencies(index: DataFrame, terms: list[bytes]) -> np.ndarray:
    """In how many documents each term is. A task adds up its shards; the
    driver gets a row a term of ``terms``, which are one block's."""
    held = index.sparkSession.sparkContext.broadcast(terms)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, total = pa.array(held.value, type=pa.binary()), np.zeros(len(held.value), dtype=np.int64)
        for batch in batches:
            for k in range(batch.num_rows):
                at = pc.index_in(wanted, value_set=batch.column("terms")[k].values)
                bounds = batch.column("bounds")[k].values.to_numpy()
                here = np.flatnonzero(at.is_valid().to_numpy(zero_copy_only=False))
                place = at.drop_null().to_numpy()
                total[here] += bounds[place + 1] - bounds[place]
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], names=["term", "n"])

    out = np.zeros(len(terms), dtype=np.int64)
    for r in index.select("terms", "bounds").mapInArrow(counted, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n")).collect():
        out[r["term"]] = r["n"]
    held.unpersist()
    return out


def _best(score: np.ndarray, ids: np.ndarray, unnamed: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores above 0, equal ones by id, null ids last.
    argpartition finds the least score that belongs; all that have it are compared."""
    least = 1
    if len(score) > k:
        least = max(least, int(score[np.argpartition(score, len(score) - k)[len(score) - k]]))
    able = np.flatnonzero(score >= least)
    return able[np.lexsort((ids[able], unnamed[able], -score[able]))[:k]]


def _search_block(index: DataFrame, queries: list[tuple[int, dict[int, int]]], terms: list[bytes], weights: np.ndarray, k: int) -> DataFrame:
    """(query, doc_id, score): the k best of each task for each of the block's queries."""
    held = index.sparkSession.sparkContext.broadcast((queries, terms, weights))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, terms, weights = held.value
        wanted = pa.array(terms, type=pa.binary())
        none = np.zeros(0, dtype=np.int64)
        best = [(none, none, none.astype(bool))] * len(queries)
        try:
            for batch in batches:
                for r in range(batch.num_rows):
                    named = batch.column("ids")[r].values
                    ids, unnamed = pc.fill_null(named, 0).to_numpy(), named.is_null().to_numpy(zero_copy_only=False)
                    found = pc.fill_null(pc.index_in(wanted, value_set=batch.column("terms")[r].values), -1).to_numpy()
                    bounds, places, impacts = (batch.column(c)[r].values.to_numpy() for c in ("bounds", "places", "impacts"))
                    for q, (_, own) in enumerate(queries):
                        score = np.zeros(len(ids), dtype=np.int64)
                        for t, times in own.items():
                            if (at := found[t]) >= 0:
                                a, z = bounds[at], bounds[at + 1]
                                score[places[a:z]] += times * weights[t] * impacts[a:z]  # a document once a term
                        top = _best(score, ids, unnamed, k)
                        if len(top):
                            both = [np.concatenate(x) for x in zip(best[q], (score[top], ids[top], unnamed[top]), strict=True)]
                            top = _best(*both, k)
                            best[q] = tuple(x[top] for x in both)
            query = np.repeat(np.array([q[0] for q in queries], dtype=np.int64), [len(b[0]) for b in best])
            score, ids, unnamed = (np.concatenate(x) if best else none for x in (zip(*best, strict=True) if best else ((), (), ())))
            yield pa.RecordBatch.from_arrays([pa.array(query), pa.array(ids, mask=unnamed.astype(bool)), pa.array(score)], names=["query", "doc_id", "score"])
        finally:
            give_back()

    return index.select("ids", "terms", "bounds", "places", "impacts").mapInArrow(search, "query bigint, doc_id bigint, score bigint")


def _query_blocks(queries: DataFrame, most: int) -> Iterator[tuple[list[tuple[int, dict[int, int]]], list[bytes]]]:
    """Queries (row, text) in blocks of about ``most`` distinct terms, streamed through the driver."""
    known: defaultdict[bytes, int] = defaultdict(count().__next__)
    block: list[tuple[int, dict[int, int]]] = []
    for row, text in queries.toLocalIterator():
        times: Counter[int] = Counter()
        for words in runs(bytes(text)):
            times.update(map(known.__getitem__, words))
        if times:
            block.append((row, dict(times)))
        if len(known) >= most:
            yield block, list(known)
            known, block = defaultdict(count().__next__), []
    if block:
        yield block, list(known)


def search(
    docs: DataFrame, queries: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", query_id: str = "item_id", query_text: str = "text", k: int = 10, block_terms: int = BLOCK_TERMS
) -> DataFrame:
    """The ``k`` highest-scoring documents of each query: ``(query_id, rank,
    doc_id, score)``, scores above 0 only, equal ones by id, null ids last.

    All documents are in the index, with all their terms; null texts and texts
    without a term are in none. Queries of any number are taken in blocks of about
    ``block_terms`` distinct terms, each block in one pass over the index; queries
    without terms have no rows, nor has any where no document has a term.
    Repeated documents are documents of their own, and so are repeated
    queries: each query row has its own ranks.
    """
    numbered = written(queries.select(F.col(query_id).alias("query_id"), F.col(query_text).cast("binary").alias("text"), F.monotonically_increasing_id().alias("query")))
    n_docs, all_terms = corpus_size(docs, text_col)
    index = written(build(docs, n_docs, all_terms, id_col=id_col, text_col=text_col), large_rows=True)
    merged = docs.sparkSession.createDataFrame([], "query bigint, doc_id bigint, score bigint")
    for block, terms in _query_blocks(numbered.where("text is not null").select("query", "text"), block_terms):
        df = document_frequencies(index, terms)
        weights = np.array([floor(1000 * log((2 * n_docs + 2) / (2 * n + 1))) for n in df.tolist()], dtype=np.int64)
        merged = merged.unionByName(written(_search_block(index, block, terms, weights, k)))
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last()))
    top = merged.withColumn("rank", place).where(F.col("rank") <= k)
    return top.join(numbered.select("query", "query_id"), "query").select(F.col("query_id").alias(query_id), "rank", F.col("doc_id").alias(id_col), "score")


def oracle_sql() -> str:
    """The same in SQL, whole tables."""
    words = lambda t: f"regexp_extract_all(translate({t}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+')"
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {words('text')} AS w FROM documents WHERE text IS NOT NULL),
s AS (SELECT count(*)::BIGINT AS n, sum(len(w))::BIGINT AS l FROM d WHERE len(w) > 0),
p AS (SELECT r, any_value(doc_id) AS doc_id, any_value(n) AS n, term, count(*)::BIGINT AS tf FROM (SELECT r, doc_id, len(w)::BIGINT AS n, unnest(w) AS term FROM d) GROUP BY r, term),
f AS (SELECT term, floor(1000 * ln((2 * s.n + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM p, s GROUP BY term, s.n),
q AS (SELECT i, any_value(item_id) AS item_id, term, count(*)::BIGINT AS times FROM (SELECT row_number() OVER () AS i, item_id, unnest({words('text')}) AS term FROM benchmark WHERE text IS NOT NULL) GROUP BY i, term),
scored AS (SELECT i, any_value(q.item_id) AS item_id, r, any_value(p.doc_id) AS doc_id,
  sum(q.times * f.w * ((1000000000 * p.tf) // (1000 * p.tf + 8 * (100 - {LENGTH_SHARE} + ({LENGTH_SHARE} * p.n * s.n) // s.l))))::BIGINT AS score
  FROM q JOIN p USING (term) JOIN f USING (term) CROSS JOIN s GROUP BY i, r),
ranked AS (SELECT item_id, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST)::INTEGER AS rank, doc_id, score FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10
"""
