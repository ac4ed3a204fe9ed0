"""Quality classifier: a factorisation machine over hashed words, structure
statistics and metadata.

score = sigmoid(b + <w, x> + 1/2 sum_f [(sum_i v_if x_i)^2 - sum_i (v_if x_i)^2]):
all pairs of features, in time linear in a document's features.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import bounded_batches, byte_slices, fresh, give_back, id_crc32

WORDS = 1 << 12
RANK = 8
#: Labelled documents per class that train, about: a hash of the id picks them.
SAMPLE = 2_000
_BLOCK = 1 << 18  # bytes handled at once
_SPACE = np.isin(np.arange(256), list(b" \t\n\r\x0b\x0c"))
_LOWER = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], dtype=np.uint64)
_CLASSES = {
    "upper": np.isin(np.arange(256), np.arange(65, 91)),
    "digit": np.isin(np.arange(256), np.arange(48, 58)),
    "symbol": np.isin(np.arange(256), list(b"#*$%&|<>{}[]\\^~=+@_/")),
    "loud": np.isin(np.arange(256), list(b"!?")),
    "beyond_ascii": np.arange(256) >= 128,
    "line": np.isin(np.arange(256), list(b"\n")),
}
STATS = (*_CLASSES, "per_word", "distinct", "words", "n_chars", "n_chars_missing")
_POWER = np.cumprod(np.full(64, 1_099_511_628_211, dtype=np.uint64), dtype=np.uint64)


def _blocks(texts: list[bytes | None]) -> Iterator[tuple[list[bytes], list[int]]]:
    """Texts in groups of about a block; a longer one is cut at white space."""
    parts, owners, n = [], [], 0
    for i, t in enumerate(texts):
        t = t or b""
        at = 0
        while at < len(t):
            end = at + _BLOCK
            if end < len(t):
                cut = max(t.rfind(b" ", at, end), t.rfind(b"\n", at, end))
                end = cut if cut > at else end
            parts.append(t[at:end])
            owners.append(i)
            n += end - at
            at = end
            if n >= _BLOCK:
                yield parts, owners
                parts, owners, n = [], [], 0
    if parts:
        yield parts, owners


def features(texts: list[bytes | None], n_chars: list[int | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rows, columns and values of the hashed words, ordered by row, and an
    array of statistics. Words: log(1 + count), scaled to length 1 a text."""
    n = len(texts)
    sums = np.zeros((n, len(_CLASSES) + 2))
    keys: list[np.ndarray] = []
    counts: list[np.ndarray] = []
    for parts, owners in _blocks(texts):
        owner = np.asarray(owners)
        a = np.frombuffer(b" ".join(parts) + b" ", dtype=np.uint8)
        starts = np.concatenate(([0], np.cumsum([len(p) + 1 for p in parts])[:-1]))
        ink = ~_SPACE[a]
        first = ink.copy()
        first[1:] &= ~ink[:-1]
        of_byte = np.flatnonzero(ink)
        begin = np.flatnonzero(first)
        for k, mask in enumerate(_CLASSES.values()):
            np.add.at(sums[:, k], owner, np.add.reduceat(mask[a], starts, dtype=np.int64))
        np.add.at(sums[:, -2], owner, np.add.reduceat(ink, starts, dtype=np.int64))
        if not len(begin):
            continue
        word = np.cumsum(first)[of_byte] - 1
        place = of_byte - begin[word]
        term = (_LOWER[a[of_byte]] + np.uint64(1)) * _POWER[np.minimum(place, 63)]
        h = np.add.reduceat(term, np.searchsorted(of_byte, begin))
        bucket = ((h * np.uint64(11_400_714_819_323_198_485)) >> np.uint64(64 - 12)).astype(np.int64)
        doc = owner[np.searchsorted(starts, begin, side="right") - 1]
        key, c = np.unique(doc * WORDS + bucket, return_counts=True)
        np.add.at(sums[:, -1], doc, 1)
        keys.append(key)
        counts.append(c)
    key, at = np.unique(np.concatenate(keys) if keys else np.zeros(0, np.int64), return_inverse=True)
    count = np.bincount(at, weights=np.concatenate(counts), minlength=len(key)) if len(key) else np.zeros(0)
    row, col = key // WORDS, key % WORDS
    value = np.log1p(count)
    norm = np.sqrt(np.bincount(row, weights=value * value, minlength=n)) if len(key) else np.ones(n)
    value = value / norm[row]
    inked, words = np.maximum(sums[:, -2], 1), np.maximum(sums[:, -1], 1)
    distinct = np.bincount(row, minlength=n) / words if len(key) else np.zeros(n)
    chars = np.array([math.log1p(max(0, c)) if c is not None else 0.0 for c in n_chars])
    missing = np.array([float(c is None) for c in n_chars])
    stats = np.column_stack([sums[:, : len(_CLASSES)] / inked[:, None], inked / words, distinct, np.log1p(sums[:, -1]), chars, missing])
    return row, col, value, stats


@dataclass
class Model:
    """w, v: over the hashed words and then the standardised statistics."""

    bias: float
    w: np.ndarray
    v: np.ndarray
    mean: np.ndarray
    scale: np.ndarray

    def standard(self, stats: np.ndarray) -> np.ndarray:
        return np.clip((stats - self.mean) / self.scale, -4, 4) / 4

    def score(self, row: np.ndarray, col: np.ndarray, value: np.ndarray, stats: np.ndarray) -> np.ndarray:
        s, n = self.standard(stats), len(stats)
        out = self.bias + s @ self.w[WORDS:]
        dot, square = s @ self.v[WORDS:], (s * s) @ (self.v[WORDS:] ** 2)
        if len(row):
            out += np.bincount(row, weights=value * self.w[col], minlength=n)
            for f in range(self.v.shape[1]):
                x = value * self.v[col, f]
                dot[:, f] += np.bincount(row, weights=x, minlength=n)
                square[:, f] += np.bincount(row, weights=x * x, minlength=n)
        return 1 / (1 + np.exp(-np.clip(out + 0.5 * (dot * dot - square).sum(axis=1), -40, 40)))


def fit(x: np.ndarray, stats: np.ndarray, y: np.ndarray, weight: np.ndarray, *, steps: int = 150, rate: float = 0.03, decay: float = 2e-4, seed: int = 7) -> Model:
    """Adam on the weighted logistic loss of the whole (bounded) sample.
    x: documents x WORDS, dense."""
    mean, scale = stats.mean(axis=0), np.maximum(stats.std(axis=0), 1e-3)
    rng = np.random.default_rng(seed)
    d = WORDS + stats.shape[1]
    p = np.concatenate([np.zeros((d, 1)), rng.normal(0, 0.05, (d, RANK))], axis=1).astype(np.float32)
    prior = np.average(y, weights=weight)
    bias = float(np.log((prior + 1e-3) / (1 - prior + 1e-3)))
    model = Model(bias, p[:, 0], p[:, 1:], mean, scale)
    x = np.concatenate([x, model.standard(stats).astype(np.float32)], axis=1)
    x2 = x * x
    weight = (weight / weight.sum()).astype(np.float32)
    m, s = np.zeros_like(p), np.zeros_like(p)
    mb = sb = 0.0
    for t in range(1, steps + 1):
        w, v = p[:, :1], p[:, 1:]
        dot = x @ v
        z = bias + (x @ w)[:, 0] + 0.5 * ((dot * dot).sum(1) - (x2 @ (v * v)).sum(1))
        g = ((1 / (1 + np.exp(-np.clip(z, -40, 40))) - y) * weight).astype(np.float32)
        grad = np.concatenate([x.T @ g[:, None], x.T @ (g[:, None] * dot) - v * (x2.T @ g)[:, None]], axis=1) + decay * p / 10
        m, s = 0.9 * m + 0.1 * grad, 0.999 * s + 0.001 * grad * grad
        p = p - rate * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.999**t)) + 1e-8)
        gb = float(g.sum())
        mb, sb = 0.9 * mb + 0.1 * gb, 0.999 * sb + 0.001 * gb * gb
        bias -= rate * (mb / (1 - 0.9**t)) / (math.sqrt(sb / (1 - 0.999**t)) + 1e-8)
    return Model(bias, p[:, 0].astype(float), p[:, 1:].astype(float), mean, scale)


_SPARSE = pa.struct([("cols", pa.list_(pa.int32())), ("vals", pa.list_(pa.float32())), ("stats", pa.list_(pa.float64()))])


def _sparse(texts: pa.Array, n_chars: pa.Array) -> pa.Array:
    row, col, value, stats = features(texts.to_pylist(), n_chars.to_pylist())
    cut = np.searchsorted(row, np.arange(len(texts) + 1))
    return pa.array(
        [{"cols": col[a:b].astype(np.int32), "vals": value[a:b].astype(np.float32), "stats": s} for a, b, s in zip(cut[:-1], cut[1:], stats, strict=True)], type=_SPARSE
    )


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", chars_col: str | None = "n_chars", sample: int = SAMPLE) -> Model:
    """A model from about ``sample`` labelled documents of each class.

    The weights of the classes restore their shares among all labelled
    rows. The driver gets the features of the sample (at most 4,096 a
    document), never a text. The drawn ids, about twice ``sample`` whatever the
    corpus, are broadcast. Null labels and ids are left out; a repeated label
    counts once; of documents that repeat an id the least text trains; labels
    without a document and documents without a label don't count. With one class or none the model
    scores all alike: 1, 0, or without any label 0.5.
    """
    y = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), (F.col(label_col) > 0).alias("y")).distinct()
    rows = {r["y"]: r["count"] for r in y.groupBy("y").count().collect()}
    share = F.when(F.col("y"), min(1.0, sample / max(1, rows.get(True, 0)))).otherwise(min(1.0, sample / max(1, rows.get(False, 0))))
    drawn = y.where(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < share * 1_000_000)
    chars = F.col(chars_col).cast("long") if chars_col in docs.columns else F.lit(None).cast("long")
    mine = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"), chars.alias("n"))
    sparse = F.arrow_udf(_sparse, "struct<cols:array<int>,vals:array<float>,stats:array<double>>")
    one = mine.join(F.broadcast(drawn), "id").groupBy("id", "y").agg(F.min(F.struct("text", "n")).alias("d"))  # of rows that repeat an id, one
    got = one.select("id", "y", sparse("d.text", "d.n").alias("f")).select("id", "y", "f.*").toArrow()
    got = got.sort_by([("id", "ascending"), ("y", "ascending")])
    labels_ = np.array(got.column("y").to_pylist(), dtype=np.float32)
    flat = Model(float(np.clip((rows.get(True, 0) - rows.get(False, 0)) * 1e9, -40, 40)), np.zeros(WORDS + len(STATS)), np.zeros((WORDS + len(STATS), RANK)), np.zeros(len(STATS)), np.ones(len(STATS)))
    if len(set(labels_.tolist())) < 2:
        return flat
    x = np.zeros((len(labels_), WORDS), dtype=np.float32)
    for i, (cols, vals) in enumerate(zip(got.column("cols"), got.column("vals"), strict=True)):
        x[i, cols.values.to_numpy()] = vals.values.to_numpy()
    weight = np.where(labels_ > 0, rows[True] / (labels_ > 0).sum(), rows[False] / (labels_ == 0).sum())
    return fit(x, np.array(got.column("stats").to_pylist()), labels_, weight)


def score_column(model: Model, text: Column, n_chars: Column, spark) -> Column:
    held = spark.sparkContext.broadcast(model)

    def scored(texts: pa.Array, chars: pa.Array) -> pa.Array:
        batch = pa.RecordBatch.from_arrays([texts, chars], names=["text", "chars"])
        out = [held.value.score(*features(some.column("text").to_pylist(), some.column("chars").to_pylist())) for some in byte_slices(batch, "text", _BLOCK)]
        return pa.array(np.concatenate(out) if out else np.zeros(0), type=pa.float64())

    @F.arrow_udf("double")
    def score(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        try:
            for texts, chars in batches:
                yield scored(texts, chars)
        finally:
            give_back()

    return score(text.cast("binary"), n_chars.cast("long"))


def with_scores(docs: DataFrame, labels: DataFrame, out: str, *, id_col: str = "doc_id", text_col: str = "text", chars_col: str = "n_chars", threshold: float = 0.7) -> DataFrame:
    """``docs`` and a struct column ``out``: held_out, score, predicted.

    Labels train from ids with crc32(id as text) mod 4 other than 2. Every row
    gets a score: null and empty texts have no words and are scored by their
    statistics. A null id isn't held out.
    """
    bounded_batches(docs.sparkSession)
    rest = F.pmod(id_crc32(id_col), F.lit(4))
    model = train(docs, labels.where(rest != 2), id_col=id_col, text_col=text_col, chars_col=chars_col)
    chars = F.col(chars_col) if chars_col in docs.columns else F.lit(None)
    score = score_column(model, F.col(text_col), chars, docs.sparkSession)
    scored = docs.withColumn(out, F.struct(F.coalesce(rest == 2, F.lit(False)).alias("held_out"), score.alias("score")))
    s = F.col(out)["score"]
    return scored.withColumn(out, F.struct(F.col(out)["held_out"].alias("held_out"), s.alias("score"), (s >= threshold).cast("int").alias("predicted")))


def classify(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", **names: object) -> DataFrame:
    """One row a document: ``(id_col, held_out, score, predicted)``, as
    ``with_scores()`` has them; repeated ids are rows of their own."""
    own = fresh(docs, "scored")
    return with_scores(docs, labels, own, id_col=id_col, **names).select(id_col, f"{own}.*")


def accepted(docs: DataFrame, labels: DataFrame, **names: object) -> DataFrame:
    """The rows of ``docs`` that are predicted good, with its own columns,
    whatever they are called."""
    own = fresh(docs, "scored")
    return with_scores(docs, labels, own, **names).where(F.col(own)["predicted"] == 1).drop(own)
