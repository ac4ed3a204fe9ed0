"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Fingerprints within ``radius`` bits share a point that is within half the
radius of both. So every distinct fingerprint emits its ball of that half
radius, the points are shuffled, and fingerprints that meet at a point are
linked. At most ``ball`` distinct fingerprints can meet at one point (65 for
radius 2), so no point gathers an unbounded group, however many documents share
a fingerprint: exact copies count once here. All that meet at a point lie
within the radius of each other, so a star to the smallest of them keeps
every connection, with no list of all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import bounded_batches, give_back, written
from quarry.llm.components import components

SEED = 42
_BLOCK = 50_000  # shingles whose bits are counted at once: 3 MB


def fingerprint(text: bytes | None, words_per_shingle: int, seed: int = SEED) -> int:
    """SimHash of one text as a signed 64-bit number; 0 without words."""
    words = text.lower().split() if text else []  # of bytes: ASCII letters and white space only
    if not words:
        return 0
    if len(words) < words_per_shingle:
        return int(np.uint64(xxhash.xxh64_intdigest(b" ".join(words), seed)).astype(np.int64))
    n = len(words) - words_per_shingle + 1
    shingles = map(b" ".join, zip(*(words[i : i + n] for i in range(words_per_shingle)), strict=True))
    h = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(seed)), dtype="<u8", count=n)
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, n, _BLOCK):
        bits = np.unpackbits(h[i : i + _BLOCK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.uint16)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<i8")[0])


def fingerprint_column(text: Column, words_per_shingle: int) -> Column:
    @F.arrow_udf("long")
    def simhash(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        try:
            for texts in batches:
                yield pa.array((fingerprint(t.as_py(), words_per_shingle) for t in texts), type=pa.int64())
        finally:
            give_back()

    return simhash(text.cast("binary"))


def ball(half: int) -> list[int]:
    """XOR masks of all points within ``half`` bits, as signed numbers."""
    masks = [sum(1 << b for b in bits) for k in range(half + 1) for bits in combinations(range(64), k)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def links(nodes: DataFrame, radius: int) -> DataFrame:
    """``nodes(rep, fp)``, fp distinct -> verified links ``(a, b)``, b < a."""
    if radius % 2:
        raise ValueError("the meeting argument for stars needs an even radius")
    masks = F.from_json(F.lit(str(ball(radius // 2))), "array<bigint>")
    points = nodes.select("rep", "fp", F.explode(masks).alias("mask")).select("rep", "fp", F.col("fp").bitwiseXOR(F.col("mask")).alias("point"))
    first = F.min(F.struct("rep", "fp")).over(Window.partitionBy("point"))
    return (
        points.withColumn("first", first)
        .where("rep <> first.rep")
        .where(F.bit_count(F.col("fp").bitwiseXOR(F.col("first.fp"))) <= radius)
        .select(F.col("rep").alias("a"), F.col("first.rep").alias("b"))
        .distinct()
    )


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words_per_shingle: int = 3, radius: int = 2) -> DataFrame:
    """One row a document: ``(id_col, fingerprint, component_id)``.

    A null or empty text has fingerprint zero and is linked like any other.
    Repeated ids are rows of their own. Rows with a null id join a class but
    never name it, unless they are all it has (component_id null). An empty
    table gives no rows. Other columns of ``docs`` are not read.
    """
    bounded_batches(docs.sparkSession)
    prints = written(
        docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), fingerprint_column(F.col(text_col), words_per_shingle).alias("fp"))
    )
    nodes = written(prints.groupBy("fp").agg(F.min("row").alias("rep"), F.min("id").alias("name")))
    found = components(written(links(nodes, radius))).withColumnRenamed("node", "rep")
    named = written(nodes.join(found, "rep", "left").select("fp", "name", F.coalesce("component", "rep").alias("class")))
    names = named.groupBy("class").agg(F.min("name").alias("component_id"))
    classes = written(named.join(names, "class").select("fp", "component_id"))
    return prints.join(classes, "fp", "left").select(
        F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )
