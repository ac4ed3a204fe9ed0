"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import bounded_batches, byte_slices, give_back, id_crc32

BUCKETS = 1 << 15
ORDERS = (2, 3)
#: Training documents per language, about: a hash of the id picks them.
SAMPLE = 1_500
#: Languages at most: the broadcast matrix then has 1,000 x 32,768 floats (131 MB).
MAX_LANGUAGES = 1_000
_BLOCK = 1 << 18  # characters handled at once
_LETTER = re.compile(r"[^\W\d_]")


def _blocks(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray, list[int]]]:
    """Code points of lower-cased texts, where each text's part begins, and
    whose it is. A long text comes in overlapping parts, so no n-gram is lost
    or seen twice."""
    parts, owners, n = [], [], 0
    over = max(ORDERS) - 1
    for i, t in enumerate(texts):
        t = (t or "").lower()
        for at in range(0, max(1, len(t) - over), _BLOCK):
            part = t[at : at + _BLOCK + over]
            parts.append(part)
            owners.append(i)
            n += len(part)
            if n >= _BLOCK:
                yield _joined(parts, owners)
                parts, owners, n = [], [], 0
    if parts:
        yield _joined(parts, owners)


def _joined(parts: list[str], owners: list[int]) -> tuple[np.ndarray, np.ndarray, list[int]]:
    lengths = np.array([len(p) for p in parts])
    points = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), dtype="<u4")
    return points, np.concatenate(([0], np.cumsum(lengths))), owners


def grams(points: np.ndarray, starts: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the n-grams that lie within one part, and where each part's
    begin among them."""
    n = len(points) - order + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64), np.zeros(len(starts), dtype=np.int64)
    h = np.full(n, order, dtype=np.uint32)
    for k in range(order):
        h = (h ^ points[k : k + n]) * np.uint32(16777619)
    inside = np.ones(n, dtype=bool)
    for k in range(1, order):
        cut = starts[1:-1] - k
        inside[cut[(cut >= 0) & (cut < n)]] = False
    counts = np.concatenate(([0], np.cumsum(inside)))
    return ((h >> np.uint32(17)) & np.uint32(BUCKETS - 1)).astype(np.int64)[inside], counts[np.minimum(starts, n)]


@dataclass
class Model:
    languages: list[str]
    log_prior: np.ndarray  # languages
    log_prob: np.ndarray  # buckets x languages

    def score(self, texts: list[str | None]) -> np.ndarray:
        total = np.zeros((len(texts), len(self.languages)))
        for points, starts, owners in _blocks(texts):
            for order in ORDERS:
                h, at = grams(points, starts, order)
                full = np.flatnonzero(np.diff(at))
                if len(full):
                    sums = np.add.reduceat(self.log_prob[h], at[:-1][full], axis=0, dtype=np.float64)
                    np.add.at(total, np.asarray(owners)[full], sums)
        return total + self.log_prior


def _posterior(total: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    best = total.argmax(axis=1)
    return best, 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)


def train(labelled: DataFrame, *, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", sample: int = SAMPLE) -> Model:
    """Counts n-grams of about ``sample`` documents per language, in Spark.

    The driver gets sums by (language, bucket), at most MAX_LANGUAGES * BUCKETS
    of them. Rows with a null text or language are left out; without any row
    the model has no language.
    """
    usable = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.col(id_col).alias("id"))
    rows = {r["lang"]: r["count"] for r in usable.groupBy("lang").count().orderBy("lang").limit(MAX_LANGUAGES + 1).collect()}
    if len(rows) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages: the model would be too large to broadcast")
    if not rows:
        return Model([], np.zeros(0), np.zeros((BUCKETS, 0), dtype=np.float32))
    languages = sorted(rows)
    share = usable.sparkSession.createDataFrame([(k, min(1.0, sample / n)) for k, n in rows.items()], "lang string, share double")
    drawn = usable.join(F.broadcast(share), "lang").where(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < F.col("share") * 1_000_000)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {k: i for i, k in enumerate(languages)}
        seen = np.zeros(len(languages) * BUCKETS, dtype=np.int64)
        for batch in batches:
            langs = [number[x] for x in batch.column("lang").to_pylist()]
            for points, starts, owners in _blocks(batch.column("text").to_pylist()):
                for order in ORDERS:
                    h, at = grams(points, starts, order)
                    of = np.repeat(np.asarray(langs)[owners], np.diff(at))
                    seen += np.bincount(of * BUCKETS + h, minlength=len(seen))
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(seen[at])], names=["cell", "n"])

    cells = drawn.select("lang", "text").mapInArrow(count, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(len(languages) * BUCKETS)
    counts[cells.column("cell").to_numpy()] = cells.column("n").to_numpy()
    counts = counts.reshape(len(languages), BUCKETS) + 0.1
    prior = np.array([rows[k] for k in languages], dtype=float)
    return Model(languages, np.log(prior / prior.sum()), np.log(counts / counts.sum(axis=1, keepdims=True)).T.astype(np.float32).copy())


def language_column(model: Model, text: Column, spark) -> Column:
    """struct<lang, score>: the likeliest language and its posterior; ``und``
    and 0 for a null text, one without a letter, or an empty model."""
    held = spark.sparkContext.broadcast(model)
    kind = pa.struct([("lang", pa.string()), ("score", pa.float64())])

    def predicted(texts: list[str | None]) -> pa.Array:
        m = held.value
        if not m.languages:
            return pa.array([{"lang": "und", "score": 0.0}] * len(texts), type=kind)
        best, p = _posterior(m.score(texts))
        known = [bool(t) and any(m[0].isalpha() for m in _LETTER.finditer(t)) for t in texts]  # numerals like ½ are no letters
        return pa.array([{"lang": m.languages[b], "score": float(s)} if k else {"lang": "und", "score": 0.0} for k, b, s in zip(known, best, p, strict=True)], type=kind)

    @F.arrow_udf("struct<lang:string,score:double>")
    def predict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        try:
            for texts in batches:
                parts = [predicted(some.column(0).to_pylist()) for some in byte_slices(pa.RecordBatch.from_arrays([texts], names=["text"]), "text", _BLOCK)]
                yield pa.concat_arrays(parts) if parts else pa.array([], type=kind)
        finally:
            give_back()

    return predict(text)


def identify(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> DataFrame:
    """``(id_col, held_out, lang_pred, score)`` for every row of ``docs``.

    Documents with crc32(id as text) mod 5 = 0 are held out; the rest with a
    language train. A null id is in neither fold's remainder 0: held_out is
    false and it doesn't train. Repeated rows are rows of their own.
    """
    bounded_batches(docs.sparkSession)
    rest = F.pmod(id_crc32(id_col), F.lit(5))
    model = train(docs.where(rest != 0), text_col=text_col, lang_col=lang_col, id_col=id_col, sample=sample)
    found = language_column(model, F.col(text_col), docs.sparkSession)
    return docs.select(F.col(id_col).alias("id"), F.coalesce(rest == 0, F.lit(False)).alias("held_out"), found.alias("found")).select(
        F.col("id").alias(id_col), "held_out", F.col("found.lang").alias("lang_pred"), F.col("found.score").alias("score")
    )
