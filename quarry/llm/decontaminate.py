"""Benchmark decontamination with a generalised suffix automaton.

The automaton holds every run of words of every item. A text streams through it
word by word; the state reached and the length of the longest run that ends at
the word tell which windows of items end there.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import reduce
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import bounded_batches, byte_slices, fresh, give_back, written
from quarry.llm.word_runs import LOWERED, runs

_WORD_RE = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
#: An automaton has at most twice as many states as words; at some 300 bytes a
#: state this bounds what one broadcast holds to about 120 MB.
BLOCK_WORDS = 200_000
_PAIR_BITS = 1 << 22


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(LOWERED).split() if text else []


class Automaton:
    """Generalised suffix automaton over the words of ``(item_id, text)``."""

    def __init__(self, items: list[tuple[str, bytes]], window: int):
        self.window, self.vocab = window, {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        spelled = [(item, [self.vocab.setdefault(w, len(self.vocab)) for w in words_of(text)]) for item, text in items]
        spelled = [(item, ids) for item, ids in spelled if ids]
        for _, ids in spelled:
            last = 0
            for c in ids:
                last = self._extend(last, c)
        # of the runs of window words and more that end where a state's do, the shortest: its state
        self.top = [0] * len(self.next)
        for v in sorted(range(1, len(self.next)), key=self.length.__getitem__):
            if self.length[v] >= window:
                self.top[v] = v if self.length[self.link[v]] < window else self.top[self.link[v]]
        self.items: dict[int, set[str]] = defaultdict(set)  # whose text has the run
        own: list[list[tuple[int, str]]] = [[] for _ in self.next]  # short items that end here
        for item, ids in spelled:
            v = 0
            for c in ids:
                v = self.next[v][c]
                if self.top[v]:
                    self.items[self.top[v]].add(item)
            if len(ids) < window:
                own[v].append((len(ids), item))
        self.short: list[tuple[tuple[int, str], ...]] = [()] * len(self.next)
        for v in sorted(range(1, len(self.next)), key=self.length.__getitem__):
            self.short[v] = (*own[v], *self.short[self.link[v]])
        self.least = min((min(len(ids), window) for _, ids in spelled), default=0)
        self.pairs = np.zeros(_PAIR_BITS, dtype=bool)
        for _, ids in spelled:
            a = np.asarray(ids, dtype=np.int64)
            self.pairs[self._pair(a[:-1], a[1:])] = True

    @staticmethod
    def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (a.astype(np.int64) * 1_000_003 + b.astype(np.int64) * 7_919) & (_PAIR_BITS - 1)

    def _add(self, length: int, link: int, following: dict[int, int]) -> int:
        self.length.append(length)
        self.link.append(link)
        self.next.append(following)
        return len(self.next) - 1

    def _split(self, p: int, c: int, q: int) -> int:
        clone = self._add(self.length[p] + 1, self.link[q], dict(self.next[q]))
        while p != -1 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        self.link[q] = clone
        return clone

    def _extend(self, last: int, c: int) -> int:
        if c in self.next[last]:
            q = self.next[last][c]
            return q if self.length[q] == self.length[last] + 1 else self._split(last, c, q)
        cur = self._add(self.length[last] + 1, 0, {})
        p = last
        while p != -1 and c not in self.next[p]:
            self.next[p][c] = cur
            p = self.link[p]
        if p != -1:
            q = self.next[p][c]
            self.link[cur] = q if self.length[q] == self.length[p] + 1 else self._split(p, c, q)
        return cur

    def _runs(self, ids: np.ndarray) -> Iterator[tuple[int, int]]:
        """Stretches of words in which every pair is a pair of some item, if
        they are long enough for a window. No window lies outside of them."""
        if self.least == 0 or len(ids) < self.least:
            return
        known = ids >= 0
        ok = known if self.least == 1 else known[:-1] & known[1:] & self.pairs[self._pair(ids[:-1], ids[1:])]
        edge = np.flatnonzero(np.diff(np.concatenate(([False], ok, [False])).astype(np.int8)))
        more = 0 if self.least == 1 else 1
        for a, b in zip(edge[::2], edge[1::2], strict=True):
            if b - a + more >= self.least:
                yield int(a), int(b) + more

    def match(self, text: bytes | None) -> tuple[int, list[tuple[int, int]], set[str]]:
        """Words of the text, spans of words inside a window (merged, end
        exclusive), and the items whose windows occur."""
        parts = [np.fromiter(map(self.vocab.get, words, repeat(-1)), dtype=np.int32, count=len(words)) for words in runs(text)]
        ids = np.concatenate(parts) if parts else np.zeros(0, dtype=np.int32)
        spans: list[list[int]] = []
        found: set[str] = set()
        nxt, link, length, window, top = self.next, self.link, self.length, self.window, self.top
        tops: set[int] = set()
        for a, b in self._runs(ids):
            v = run = 0
            for i, c in enumerate(ids[a:b].tolist(), a):
                while v and c not in nxt[v]:
                    v = link[v]
                    run = length[v]
                if c in nxt[v]:
                    v, run = nxt[v][c], run + 1
                else:
                    continue
                start = i + 1
                if run >= window:
                    start = i + 1 - window
                    if top[v] not in tops:
                        tops.add(top[v])
                        found |= self.items[top[v]]
                for n, item in self.short[v]:
                    if n <= run:
                        start = min(start, i + 1 - n)
                        found.add(item)
                if start <= i:
                    while spans and spans[-1][1] >= start:
                        start = min(start, spans.pop()[0])
                    spans.append([start, i + 1])
        return len(ids), [(s, e) for s, e in spans], found


_FOUND = "struct<n_words:bigint,spans:array<struct<first:bigint,past:bigint>>,items:array<string>>"
_FOUND_ARROW = pa.struct(
    [("n_words", pa.int64()), ("spans", pa.list_(pa.struct([("first", pa.int64()), ("past", pa.int64())]))), ("items", pa.list_(pa.string()))]
)
_CLEAN = _FOUND[:-1] + ",clean:string>"


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def _found(rows: list[tuple[int, list[tuple[int, int]], set[str]]]) -> list[pa.Array]:
    """n_words, spans and items of each row."""
    spans, items = [r[1] for r in rows], [sorted(r[2]) for r in rows]
    first, past = np.asarray([s for own in spans for s in own], dtype=np.int64).reshape(-1, 2).T
    pairs = pa.StructArray.from_arrays([pa.array(first), pa.array(past)], names=["first", "past"])
    names = pa.array([i for own in items for i in own], type=pa.string())
    return [pa.array([r[0] for r in rows], type=pa.int64()), _lists(spans, pairs), _lists(items, names)]


def _structs(texts: pa.Array, found: Callable[[pa.RecordBatch], list], cut: bool, *more: pa.Array) -> pa.Array:
    """What is found in the texts, some megabytes at a time; ``cut``: and what the spans leave of each text that has any."""
    names = ["n_words", "spans", "items", *(["clean"] if cut else [])]
    batch = pa.RecordBatch.from_arrays([texts, *more], names=["text", *(f"more_{i}" for i in range(len(more)))])
    parts = []
    for some in byte_slices(batch, "text"):
        rows = found(some)
        own = _found(rows) + ([_cut(some.column("text"), [r[1] for r in rows])] if cut else [])
        parts.append(pa.StructArray.from_arrays(own, names=names))
    return pa.concat_arrays(parts) if parts else pa.array([], type=pa.struct([*_FOUND_ARROW, *([pa.field("clean", pa.string())] if cut else [])]))


# Both functions are called not deterministic: else Spark moves a filter on what they return below the
# projection and runs them for each, in workers of their own at the same time.


def _matcher(held: Broadcast, text: Column, cut: bool) -> Column:
    def found(some: pa.RecordBatch) -> list:
        match = held.value.match
        return [match(t.as_py()) for t in some.column("text")]

    @F.arrow_udf(_CLEAN if cut else _FOUND)
    def find(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        try:
            for texts in batches:
                yield _structs(texts, found, cut)
        finally:
            give_back()

    return find.asNondeterministic()(text.cast("binary"))


def _uniter(text: Column, passes: Column, cut: bool) -> Column:
    def united(parts: list[dict]) -> tuple[int, list[tuple[int, int]], set[str]]:
        spans = merged([(s["first"], s["past"]) for f in parts for s in f["spans"]])
        return parts[0]["n_words"], spans, {i for f in parts for i in f["items"]}

    @F.arrow_udf(_CLEAN if cut else _FOUND)
    def unite(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        try:
            for texts, found in batches:
                yield _structs(texts, lambda some: [united(x.as_py()) for x in some.column(1)], cut, found)
        finally:
            give_back()

    return unite.asNondeterministic()(text.cast("binary"), passes)


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, block_words: int, window: int) -> Iterator[list[tuple[str, bytes]]]:
    """Items in blocks of ``block_words`` words at most; a longer item comes in
    parts that overlap, so that every window is whole in one of them."""
    block: list[tuple[str, bytes]] = []
    n, most = 0, max(block_words, window)
    rows = benchmark.where(F.col(text_col).isNotNull()).select(F.col(id_col).cast("string"), F.col(text_col).cast("binary"))
    for item, text in rows.toLocalIterator():
        words = words_of(bytes(text))
        for at in range(0, max(1, len(words) - window + 1), most - window + 1):
            part = words[at : at + most]
            if block and n + len(part) > block_words:
                yield block
                block, n = [], 0
            block.append(("" if item is None else item, b" ".join(part)))
            n += len(part)
    yield block


def _lists(rows: list[list], values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, rows)]).astype(np.int32)), values)


def with_matches(
    docs: DataFrame, benchmark: DataFrame, out: str, *, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = 10, block_words: int = BLOCK_WORDS, cut: bool = False
) -> DataFrame:
    """``docs`` with a struct column ``out``: n_words, spans of words (merged,
    end exclusive) inside a window of an item, and those items' ids as sorted
    strings. ``cut``: and ``clean``, the text without its spans, null if it has none.

    A benchmark of any size is matched: its items are taken in blocks of at
    most ``block_words`` words, each with an automaton of its own. If there is
    more than one block, each has a pass of its own over the texts; its hits
    are written and its broadcast is dropped before the next, and the hits of a
    row are united at the end. So neither the driver nor a worker
    holds more than one block. Null and empty texts have no words and match
    nothing; null items are left out; an empty benchmark matches nothing.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    hold = lambda block: spark.sparkContext.broadcast(Automaton(block, window))
    blocks = _blocks(benchmark, item_id, item_text, block_words, window)
    first = next(blocks)
    second = next(blocks, None)
    if second is None:
        return docs.withColumn(out, _matcher(hold(first), F.col(text_col), cut))
    row, own = fresh(docs, "match_row"), fresh(docs, "match_parts")
    numbered = written(docs.withColumn(row, F.monotonically_increasing_id()))
    passes = []
    for block in chain([first, second], blocks):
        held = hold(block)
        hits = numbered.select(row, _matcher(held, F.col(text_col), False).alias("m"))
        # the first pass counts the words of every row
        passes.append(written(hits if not passes else hits.where(F.size("m.spans") > 0)))
        held.unpersist(blocking=True)
    whole = reduce(DataFrame.unionByName, passes).groupBy(row).agg(F.collect_list("m").alias(own))  # an entry a block at most
    return numbered.join(whole, row).withColumn(out, _uniter(F.col(text_col), F.col(own), cut)).drop(row, own)


def without_spans(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The text without the words of the spans and what follows each span up to
    the next word."""
    at = [m.start() for m in _WORD_RE.finditer(text)] + [len(text)]
    out, done = [], 0
    for s, e in spans:
        out.append(text[done : at[s]])
        done = at[e]
    return b"".join([*out, text[done:]])


def _cut(texts: pa.Array, spans: list[list[tuple[int, int]]]) -> pa.Array:
    """The texts without their spans, null for one that has none."""
    return pa.array([without_spans(t.as_py(), own) if own else None for t, own in zip(texts, spans, strict=True)], type=pa.binary()).cast(pa.string())


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", max_coverage: float = 0.5, window: int = 10, **names: object) -> DataFrame:
    """``docs`` without passages of the benchmark, same columns.

    Every span of words inside a window goes from its text. A document of
    which more than ``max_coverage`` of the words are hit goes as a whole.
    Documents with no hit stay as they are, null and empty texts too.
    """
    m = fresh(docs, "match")
    hit = F.aggregate(F.col(m)["spans"], F.lit(0).cast("long"), lambda n, s: n + s["past"] - s["first"])
    found = with_matches(docs, benchmark, m, text_col=text_col, window=window, cut=True, **names)
    kept = found.where(hit <= max_coverage * F.col(m)["n_words"])
    clean = F.coalesce(F.col(m)["clean"], F.col(text_col))
    return kept.withColumn(text_col, clean).select(*docs.columns)
