"""Importance resampling towards a target distribution over hashed n-grams.

Within a block of words, distinct words get numbers, n-grams are tuples of
numbers, and each distinct tuple is spelled and hashed once; the counts or gains
of its bucket go back to where it stands.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from math import floor, log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import bounded_batches, byte_slices, fresh, give_back, written
from quarry.llm.word_runs import numbered, runs

MOST_WORDS = 3  # of an n-gram
BUCKETS = 10_000


def _tuples(owners: np.ndarray, ids: np.ndarray, words: list[bytes], carried: int, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(owner, bucket) of every n-gram that ends at one of the words beyond the
    ``carried`` first ones, for each length of n-grams."""
    prefix, spelled = ids, words  # the number of the n-gram that ends at each place, and the spelling of each
    at = np.arange(len(ids))
    for n in range(1, MOST_WORDS + 1):
        if n > 1:
            joined = at[(at > 0)]
            joined = joined[(owners[joined] == owners[joined - 1]) & (prefix[joined - 1] >= 0)]
            pairs, back = np.unique(prefix[joined - 1] << 32 | ids[joined], return_inverse=True)
            spelled = [spelled[p >> 32] + b" " + words[p & 0xFFFFFFFF] for p in pairs.tolist()]
            prefix = np.full(len(ids), -1, dtype=np.int64)
            prefix[joined] = back
        hashed = np.fromiter(map(zlib.crc32, spelled), dtype=np.int64, count=len(spelled)) % buckets
        here = np.flatnonzero(prefix[carried:] >= 0) + carried
        yield owners[here], hashed[prefix[here]]


def _features(texts: list[bytes | None], buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Blocks of (owner of each word, owner of each n-gram, bucket of each). The
    last words of a block are carried on, so that no n-gram is lost between two."""
    last: tuple[int, list[bytes]] = (-1, [])
    stream = ((i, words) for i, text in enumerate(texts) for words in runs(text))
    for owners, ids, words in numbered(stream):
        own, m = owners, 0
        if len(owners) and last[1] and last[0] == owners[0]:
            m = len(last[1])
            number = {w: k for k, w in enumerate(words)}
            before = [number.setdefault(w, len(number)) for w in last[1]]
            words = list(number)
            owners, ids = np.concatenate((np.full(m, last[0]), owners)), np.concatenate((before, ids)).astype(np.int64)
        found = list(_tuples(owners, ids, words, m, buckets))
        yield own, np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])
        if len(owners):
            tail = [words[k] for k, o in zip(ids[-MOST_WORDS + 1 :].tolist(), owners[-MOST_WORDS + 1 :].tolist(), strict=True) if o == owners[-1]]
            last = (int(owners[-1]), tail)


def bucket_counts(texts: DataFrame, text_col: str = "text", buckets: int = BUCKETS) -> dict[int, int]:
    """How many n-grams of all texts fall into each bucket. A task adds up what
    it reads, so it sends ``buckets`` rows at most; so many come to the driver."""
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        try:
            for batch in batches:
                for some in byte_slices(batch, "text"):
                    for _, _, bucket in _features(some.column("text").to_pylist(), buckets):
                        total += np.bincount(bucket, minlength=buckets)
            seen = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], names=["bucket", "n"])
        finally:
            give_back()

    rows = texts.select(F.col(text_col).cast("binary").alias("text")).where("text is not null").mapInArrow(counted, "bucket bigint, n bigint")
    return {r["bucket"]: r["n"] for r in rows.groupBy("bucket").agg(F.sum("n").alias("n")).collect()}


def gains(source: dict[int, int], target: dict[int, int], buckets: int = BUCKETS) -> list[int]:
    """floor(1000 ln) of how much likelier each bucket is in the target, with
    one more n-gram in each bucket on both sides."""
    s, t = sum(source.values()) + buckets, sum(target.values()) + buckets
    return [floor(1000 * log((target.get(b, 0) + 1) * s / ((source.get(b, 0) + 1) * t))) for b in range(buckets)]


def noise(seed: int, key: Column) -> Column:
    """floor(1000 x) of a Gumbel number x made of the key and the seed."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296))).cast("long")


def weighted(docs: DataFrame, target: DataFrame, *, text_col: str = "text", target_text: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """``docs`` with ``n_words``, ``n_features`` and ``weight``. The columns of
    ``docs`` other than the text's keep their names and must not have these."""
    spark = docs.sparkSession
    bounded_batches(spark)
    of = spark.sparkContext.broadcast(np.array(gains(bucket_counts(docs, text_col, buckets), bucket_counts(target, target_text, buckets), buckets), dtype=np.int64))

    def weigh(texts: pa.Array) -> pa.Array:
        parts = []
        for some in byte_slices(pa.RecordBatch.from_arrays([texts], names=["text"]), "text"):
            n = some.num_rows
            n_words, n_features, weight = (np.zeros(n, dtype=np.int64) for _ in range(3))
            for owner, feature, bucket in _features(some.column("text").to_pylist(), buckets):
                n_words += np.bincount(owner, minlength=n)
                n_features += np.bincount(feature, minlength=n)
                np.add.at(weight, feature, of.value[bucket])
            parts.append(pa.StructArray.from_arrays([pa.array(n_words), pa.array(n_features), pa.array(weight)], names=["n_words", "n_features", "weight"]))
        return pa.concat_arrays(parts) if parts else pa.array([], type=pa.struct([(c, pa.int64()) for c in ("n_words", "n_features", "weight")]))

    @F.arrow_udf("struct<n_words:bigint,n_features:bigint,weight:bigint>")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        try:
            yield from map(weigh, batches)
        finally:
            give_back()

    m = fresh(docs, "m")
    return docs.withColumn(m, score(F.col(text_col).cast("binary"))).select(*(F.col(f"`{c}`") for c in docs.columns if c != text_col), f"{m}.*")


def resample(
    docs: DataFrame, target: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", target_text: str = "text", percent: int = 5, least_words: int = 20, seed: int = 42
) -> DataFrame:
    """One row a document: ``(id_col, n_features, weight, score, rank)``.

    The weight is the sum of the gains of the document's n-grams, the score
    adds noise of its id, and the ``percent`` of highest scores among documents of
    ``least_words`` words and more are drawn without replacement: ranks 1, 2
    and so on, ties to the smaller id, null ids last, repeated rows in any
    order; others have none. Null and empty texts have no n-grams and weight
    0. A null id's noise is that of the empty string. Empty tables on either
    side are a side without n-grams.

    No task sorts all rows: they are dealt by ranges of (score, id, row), and
    ranks go on from the counts of the ranges before.
    """
    spark = docs.sparkSession
    named = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.monotonically_increasing_id().alias("row"))
    scored = written(weighted(named, target, target_text=target_text).withColumn("score", F.col("weight") + noise(seed, F.col("id"))))
    able = scored.where(F.col("n_words") >= least_words)
    n = able.count()
    drawn = percent * n // 100
    order = [F.col("score").desc(), F.col("id").asc_nulls_last(), F.col("row")]
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // 1_000_000))
    dealt = written(able.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()))
    sizes = sorted((r["part"], r["count"]) for r in dealt.groupBy("part").count().collect())  # a row a range
    starts, before = [], 0
    for part, size in sizes:
        starts.append((part, before))
        before += size
    first = F.broadcast(spark.createDataFrame([x for x in starts if x[1] < drawn], "part int, before bigint"))  # a row a range
    place = F.col("before") + F.row_number().over(Window.partitionBy("part").orderBy(*order))
    ranked = dealt.join(first, "part").withColumn("rank", F.when(place <= drawn, place).cast("long"))
    none = F.lit(None).cast("long")
    rest = dealt.join(first, "part", "left_anti").withColumn("rank", none)
    small = scored.where(F.col("n_words") < least_words).withColumn("rank", none)
    out = [F.col("id").alias(id_col), "n_features", "weight", "score", "rank"]
    return ranked.select(*out).unionByName(rest.select(*out)).unionByName(small.select(*out))
