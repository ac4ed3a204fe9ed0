"""Token counts by a finite-state tokenizer.

A byte-level BPE vocabulary is compiled into a deterministic transducer over
bytes. Its state after some bytes of a pre-token says which vocabulary entries
may still end later, and what the encoding of the text before each is; a
transition says by how much the number of tokens changes. States are made when
a text first reaches them. Pre-tokens and chunks of long ones run through the
table side by side; a chunk's map, from the state in which it is entered to the
state in which it is left and its count, is composed with its neighbours' by a
prefix scan.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import bounded_batches, byte_slices, give_back

_BLOCK = 1 << 18  # characters handled at once
_CHUNK = 64  # bytes; longer pre-tokens are cut into chunks
_MOST_STATES = 150_000  # between blocks, a table that has more is made anew: some 150 MB
_ROUNDS = 6  # of the scan, before what is left is walked byte by byte
_LETTER, _NUMBER, _OTHER, _SPACE, _UNKNOWN, _NONE = range(6)
_BEFORE, _AFTER = 4, 3  # characters beside a position that decide whether a pre-token starts there
_FREE = -1


def _byte_spelling() -> dict[str, int]:
    """The character by which such vocabularies spell each byte: itself if it is
    visible in Latin-1, else one from U+0100 on."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(seen)]
    return {chr(b): b for b in seen} | {chr(256 + i): b for i, b in enumerate(hidden)}


@dataclass(frozen=True)
class Vocabulary:
    """What the driver reads out of a tokenizer file and sends to the workers:
    spellings of the merged tokens in order of their merges, as bytes, the
    tokens that each is made of, their ids, and the added tokens' literals."""

    spelled: list[bytes]
    halves: list[tuple[int, int]]
    ids: list[int]
    literals: tuple[str, ...]

    @classmethod
    def read(cls, path: str) -> Vocabulary:
        with open(path, encoding="utf-8") as f:
            whole = json.load(f)
        model, split = whole["model"], whole.get("pre_tokenizer") or {}
        plain = model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges", "byte_fallback"))
        if not plain or whole.get("normalizer") or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True):
            raise ValueError(f"{path} is not a byte-level BPE of the kind that this compiler knows")
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in whole.get("added_tokens", [])):
            raise ValueError(f"{path} has added tokens that take in what is beside them")
        byte = _byte_spelling()
        spelled = [bytes([b]) for b in range(256)]
        known = {s: i for i, s in enumerate(spelled)}
        halves = []
        for merge in model["merges"]:
            a, b = (bytes(byte[c] for c in half) for half in (merge.split(" ") if isinstance(merge, str) else merge))
            if a + b in known:
                raise ValueError(f"{path}: two merges make the same token")
            halves.append((known[a], known[b]))  # a half that a later merge makes is an error
            known[a + b] = len(spelled)
            spelled.append(a + b)
        written = {b: c for c, b in byte.items()}
        ids = [model["vocab"]["".join(written[b] for b in s)] for s in spelled]
        return cls(spelled, halves, ids, tuple(t["content"] for t in whole.get("added_tokens", [])))


class Transducer:
    """The table of transitions: (state, byte) -> next state and change of the count.

    A state is a tuple of (node, last, count): for every place in the pre-token
    from which a token may still reach beyond the bytes read, the node of the
    vocabulary's trie that the bytes since then lead to, the last token of the
    encoding that ends at that place (-1: the pre-token's start), and how many
    tokens that encoding has more than the one of all bytes. Of the
    vocabulary's tokens that end at the next byte, exactly one can follow the
    last token at its start, so it is the encoding's last token there.
    """

    def __init__(self, vocabulary: Vocabulary):
        self.rank = {pair: i for i, pair in enumerate(vocabulary.halves)}
        self.halves = vocabulary.halves
        self.child: dict[int, int] = {}
        self.token = [-1]
        inner = set()
        for t, s in enumerate(vocabulary.spelled):
            node = 0
            for b in s:
                inner.add(node)
                key = node << 8 | b
                node = self.child.get(key, -1)
                if node < 0:
                    node = self.child[key] = len(self.token)
                    self.token.append(-1)
            self.token[node] = t
        self.inner = inner
        self.sizes = np.array([len(s) for s in vocabulary.spelled], dtype=np.int64)
        self.edges: dict[tuple[int, bool], list[tuple[int, float]]] = {}
        self.follows: dict[tuple[int, int], bool] = {}
        self.forget()

    def forget(self, keep: dict[int, int] | None = None) -> dict[int, int]:
        """Start anew with the state of a pre-token's beginning and those of
        ``keep``, which is returned with their new numbers."""
        kept = {k: self.states[n] for k, n in (keep or {}).items()}
        self.states: list[tuple[tuple[int, int, int], ...]] = list(dict.fromkeys([((0, -1, 0),), *kept.values()]))
        self.number = {state: n for n, state in enumerate(self.states)}
        self.table: dict[int, int] = {}
        self._index(1 << 16)
        return {k: self.number[state] for k, state in kept.items()}

    def _index(self, size: int) -> None:
        """The table as two arrays, looked up by many keys at once."""
        self.keys, self.values = np.full(size, _FREE, dtype=np.int64), np.zeros(size, dtype=np.int64)
        self.shift = np.uint64(64 - size.bit_length() + 1)
        if self.table:
            self._insert(np.fromiter(self.table, dtype=np.int64), np.fromiter(self.table.values(), dtype=np.int64))

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def _insert(self, keys: np.ndarray, values: np.ndarray) -> None:
        at = self._slots(keys)
        while len(keys):
            free = np.flatnonzero(self.keys[at] == _FREE)
            _, one = np.unique(at[free], return_index=True)  # of those that want the same slot, one gets it
            won = free[one]
            self.keys[at[won]], self.values[at[won]] = keys[won], values[won]
            left = np.ones(len(keys), dtype=bool)
            left[won] = False
            keys, values, at = keys[left], values[left], (at[left] + 1) & (len(self.keys) - 1)

    def _edge(self, token: int, right: bool) -> list[tuple[int, float]]:
        """The tokens that stand at a token's edge while it is being merged, each
        with the rank of the merge that ends it."""
        found = self.edges.get((token, right))
        if found is None:
            found, t = [(token, float("inf"))], token
            while t >= 256:
                merge = t - 256
                t = self.halves[merge][1 if right else 0]
                found.append((t, merge))
            found.reverse()
            self.edges[token, right] = found
        return found

    def _stay_apart(self, left: int, right: int) -> bool:
        """Does BPE keep the border between two tokens? Merges come in order of
        rank and, within a rank, from the left: no pair of tokens that meet at the
        border may be merged before one of both is merged on its other side."""
        key = (left, right)
        known = self.follows.get(key)
        if known is None:
            a, b = self._edge(left, True), self._edge(right, False)
            i = j = 0
            known = True
            while True:
                (x, x_ends), (y, y_ends) = a[i], b[j]
                merge = self.rank.get((x, y))
                if merge is not None and merge < x_ends and merge <= y_ends:
                    known = False
                    break
                if i == len(a) - 1 and j == len(b) - 1:
                    break
                if x_ends <= y_ends:
                    i += 1
                else:
                    j += 1
            if len(self.follows) > 1_000_000:
                self.follows.clear()
            self.follows[key] = known
        return known

    def transition(self, key: int) -> int:
        """(next state << 8) + 128 + change of the count, for (state << 8) + byte."""
        found = self.table.get(key)
        if found is not None:
            return found
        b = key & 0xFF
        on, last, gain = [], None, 0
        for node, before, count in self.states[key >> 8]:  # longest token first
            node = self.child.get(node << 8 | b, -1)
            if node < 0:
                continue
            token = self.token[node]
            if last is None and token >= 0 and (before < 0 or self._stay_apart(before, token)):
                last, gain = token, count + 1
            if node in self.inner:
                on.append((node, before, count))
        state = (*((node, before, count - gain) for node, before, count in on), (0, last, 0))
        number = self.number.setdefault(state, len(self.states))
        if number == len(self.states):
            self.states.append(state)
        found = self.table[key] = number << 8 | (128 + gain)
        return found

    def look_up(self, keys: np.ndarray) -> np.ndarray:
        at = self._slots(keys)
        seen = self.keys[at]
        out = self.values[at]
        rest = np.flatnonzero(seen != keys)
        while len(rest):
            free = self.keys[at[rest]] == _FREE
            new, rest = rest[free], rest[~free]
            at[rest] = (at[rest] + 1) & (len(self.keys) - 1)
            if len(new):
                wanted = np.unique(keys[new])
                made = np.array([self.transition(k) for k in wanted.tolist()], dtype=np.int64)
                out[new] = made[np.searchsorted(wanted, keys[new])]
                if 2 * len(self.table) > len(self.keys):
                    self._index(4 * len(self.keys))
                    at[rest] = self._slots(keys[rest])
                else:
                    self._insert(wanted, made)
            hit = self.keys[at[rest]] == keys[rest]
            out[rest[hit]] = self.values[at[rest[hit]]]
            rest = rest[~hit]
        return out

    def run(self, raw: np.ndarray, begins: np.ndarray, lengths: np.ndarray, entered: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Chunks of ``raw``, each entered in a state: states in which they are left, and counts."""
        order = np.argsort(-lengths, kind="stable")
        at, states, counts = begins[order], entered[order].astype(np.int64), np.zeros(len(order), dtype=np.int64)
        active = np.searchsorted(-lengths[order], -np.arange(int(lengths.max(initial=0))), side="left")
        for i, m in enumerate(active.tolist()):
            found = self.look_up(states[:m] << 8 | raw[at[:m] + i])
            states[:m] = found >> 8
            counts[:m] += (found & 0xFF) - 128
        left, total = np.empty_like(states), np.empty_like(counts)
        left[order], total[order] = states, counts
        return left, total

    def walk(self, raw: bytes, state: int) -> tuple[int, int]:
        """As ``run()`` for one chunk, byte by byte."""
        count = 0
        for b in raw:
            found = self.transition(state << 8 | b)
            state, count = found >> 8, count + (found & 0xFF) - 128
        return state, count

    def tokens(self, blocks: Iterator[bytes]) -> np.ndarray:
        """The tokens of one pre-token, by their numbers here. Its bytes come in
        blocks; what is kept of each byte is the last token of the encoding that ends there."""
        last, state = array("i"), 0
        for raw in blocks:
            if len(self.states) > _MOST_STATES:
                state = self.forget({0: state})[0]
            for b in raw:
                state = self.transition(state << 8 | b) >> 8
                last.append(self.states[state][-1][1])
        out, at = array("i"), len(last)
        while at:
            out.append(last[at - 1])
            at -= int(self.sizes[last[at - 1]])
        return np.frombuffer(out, dtype=np.int32)[::-1]

    def scan(self, raw: np.ndarray, begins: np.ndarray, lengths: np.ndarray, entered: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """As ``run()`` for whole pre-tokens: their last states and counts.

        Long ones are cut into chunks. Each chunk's map is first known at the
        beginning state; every round feeds all chunks whose predecessor's
        outcome changed with that outcome. A chunk that is left in the same
        state as before ends the dependence, and since states mostly meet
        within a token or two, a few rounds compose all maps. Chunks that
        still depend on what was long before (long runs of one character) are
        walked in their order.
        """
        n = np.maximum(1, -(-lengths // _CHUNK))
        owner = np.repeat(np.arange(len(n)), n)
        firsts = np.cumsum(n) - n
        place = np.arange(len(owner)) - firsts[owner]
        at = begins[owner] + place * _CHUNK
        size = np.minimum(lengths[owner] - place * _CHUNK, _CHUNK)
        fed = np.where(place == 0, entered[owner], 0)
        left, counts = self.run(raw, at, size, fed)
        inner = np.flatnonzero(place > 0)
        for _ in range(_ROUNDS):
            again = inner[fed[inner] != left[inner - 1]]
            if not len(again):
                break
            fed[again] = left[again - 1]
            left[again], counts[again] = self.run(raw, at[again], size[again], fed[again])
        else:
            state_of: dict[tuple[int, bytes], tuple[int, int]] = {}
            for o in np.unique(owner[inner[fed[inner] != left[inner - 1]]]).tolist():
                for c in range(int(firsts[o]) + 1, int(firsts[o] + n[o])):
                    if fed[c] != left[c - 1]:
                        key = (int(left[c - 1]), raw[at[c] : at[c] + size[c]].tobytes())
                        if key not in state_of:
                            state_of[key] = self.walk(key[1], key[0])
                        fed[c] = key[0]
                        left[c], counts[c] = state_of[key]
        return left[firsts + n - 1], np.add.reduceat(counts, firsts) if len(firsts) else counts


class Counter:
    """Texts to token counts."""

    def __init__(self, vocabulary: Vocabulary):
        from tokenizers.pre_tokenizers import ByteLevel

        self.transducer = Transducer(vocabulary)
        self.literals = re.compile("|".join(map(re.escape, sorted(vocabulary.literals, key=len, reverse=True)))) if vocabulary.literals else None
        self.ids = np.array(vocabulary.ids, dtype="<u4")
        self.splitter = ByteLevel(add_prefix_space=False)
        self.kinds = np.full(0x110000, _UNKNOWN, dtype=np.uint8)

    def _kinds(self, points: np.ndarray) -> np.ndarray:
        """Letter, number, white space or other, as the library's own splitter
        takes each character; it is asked once for each."""
        kinds = self.kinds[points]
        if (kinds == _UNKNOWN).any():
            together = lambda a, c: len(self.splitter.pre_tokenize_str(a + c)) == 1
            for p in np.unique(points[kinds == _UNKNOWN]).tolist():
                c = chr(p)
                self.kinds[p] = _LETTER if together("a", c) else _NUMBER if together("1", c) else _OTHER if together("!", c) else _SPACE
            kinds = self.kinds[points]
        return kinds

    def _starts(self, points: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Where pre-tokens start. What decides is at most four characters before a place and three after."""
        n = len(points)
        kind = self._kinds(points)
        before = np.empty(n, dtype=np.uint8)
        before[0], before[1:] = _NONE, kind[:-1]
        before[first] = _NONE
        after = np.empty(n, dtype=np.uint8)
        after[-1], after[:-1] = _NONE, kind[1:]
        after[:-1][first[1:]] = _NONE
        blank = np.zeros(n, dtype=bool)  # a space is before it
        blank[1:] = points[:-1] == 32
        blank &= before == _SPACE
        space = kind == _SPACE
        start = np.where(space, (before != _SPACE) | ((after != _SPACE) & (after != _NONE)), (kind != before) & ~blank)
        for q in np.flatnonzero((points == 39) & (before != _OTHER) & ~blank & (after == _LETTER)).tolist():
            end = q + 1
            while end < min(n, q + 3) and not first[end]:
                end += 1
            tail = "".join(map(chr, points[q + 1 : end].tolist()))
            m = 2 if tail[:1] in "stmd" else 3 if tail in ("re", "ve", "ll") else 0
            if m:
                start[q + 1] = False
                if q + m < n and not first[q + m] and kind[q + m] == _LETTER:
                    start[q + m] = True
        return start

    def _block(self, parts: list[tuple[int, str, int, int]], totals: np.ndarray, states: dict[int, int]) -> None:
        """Parts (text, characters, how many of them are there for what is before
        and after only). A text that goes on has its state in ``states``."""
        whole = "".join(p[1] for p in parts)
        if not whole:
            return
        points = np.frombuffer(whole.encode("utf-32-le"), dtype="<u4")
        sizes = np.array([len(p[1]) for p in parts], dtype=np.int64)
        ends = np.cumsum(sizes)
        first = np.zeros(len(points), dtype=bool)
        first[(ends - sizes)[sizes > 0]] = True
        start = self._starts(points, first)
        width = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
        byte_ends = np.cumsum(width)
        raw = np.frombuffer(whole.encode(), dtype=np.uint8)
        low = ends - sizes + np.array([p[2] for p in parts], dtype=np.int64)
        high = ends - np.array([p[3] for p in parts], dtype=np.int64)
        own = np.zeros(len(points) + 1, dtype=np.int64)
        own[low] += 1
        own[high] -= 1
        own = np.cumsum(own[:-1]) > 0
        goes_on = {int(a): p[0] for p, a, z in zip(parts, low, high, strict=True) if p[2] and a < z and not start[a]}
        start[list(goes_on)] = True
        lanes = np.flatnonzero(start & own)
        part = np.searchsorted(ends, lanes, side="right")
        past = np.minimum(np.append(lanes[1:], len(points)), high[part])
        begin = byte_ends[lanes] - width[lanes]
        entered = np.zeros(len(lanes), dtype=np.int64)
        for a, text in goes_on.items():
            entered[np.searchsorted(lanes, a)] = states[text]
        left, counts = self.transducer.scan(raw, begin, byte_ends[past - 1] - begin, entered)
        of = np.array([p[0] for p in parts], dtype=np.int64)
        np.add.at(totals, of[part], counts)
        states.clear()
        for p, z in zip(parts, high, strict=True):
            if p[3]:
                states[p[0]] = int(left[np.searchsorted(lanes, z) - 1])

    def _pre_tokens(self, text: str) -> Iterator[tuple[bool, bytes]]:
        """(does it start here, bytes) of each pre-token of a text, a long one in blocks."""
        for at in range(0, len(text), _BLOCK):
            a, past = max(0, at - _BEFORE), min(len(text), at + _BLOCK)
            some = text[a : min(len(text), past + _AFTER)]
            points = np.frombuffer(some.encode("utf-32-le"), dtype="<u4")
            start = self._starts(points, np.arange(len(points)) == 0)
            cuts = np.unique([at - a, *np.flatnonzero(start).tolist(), past - a])
            cuts = cuts[(cuts >= at - a) & (cuts <= past - a)].tolist()
            for x, z in zip(cuts, cuts[1:], strict=False):
                yield bool(start[x]), some[x:z].encode()

    def encode(self, text: str) -> bytes:
        """Ids of a text without added tokens, little-endian unsigned 32-bit. For
        texts that nothing but this cuts: slow, but what it holds is 4 bytes a byte of a pre-token."""
        out = [b""]
        known: dict[bytes, bytes] = {}
        waiting: list[bytes] = []

        def done() -> None:
            whole = waiting[0] if len(waiting) == 1 and len(waiting[0]) <= _CHUNK else None
            ids = known.get(whole) if whole is not None else None
            if ids is None:
                ids = self.ids[self.transducer.tokens(iter(waiting))].tobytes()
                if whole is not None and len(known) < _MOST_STATES:
                    known[whole] = ids
            out.append(ids)
            waiting.clear()

        for starts, raw in self._pre_tokens(text):
            if starts and waiting:
                done()
            waiting.append(raw)
        if waiting:
            done()
        return b"".join(out)

    def count(self, texts: list[str]) -> np.ndarray:
        """Tokens of each text, by the library's default call without special tokens around it."""
        totals = np.zeros(len(texts), dtype=np.int64)
        pieces = []
        for i, text in enumerate(texts):
            if self.literals is not None and (found := len(self.literals.findall(text))):
                totals[i] += found
                pieces += [(i, x) for x in self.literals.split(text)]
            else:
                pieces.append((i, text))
        parts: list[tuple[int, str, int, int]] = []
        held = 0
        states: dict[int, int] = {}

        def flush() -> None:
            nonlocal held, states
            if len(self.transducer.states) > _MOST_STATES:
                states = self.transducer.forget(states)
            self._block(parts, totals, states)
            parts.clear()
            held = 0

        for i, text in pieces:
            for at in range(0, len(text), _BLOCK):
                if held and (at or len(text) > _BLOCK):
                    flush()  # a long text's parts come one a block, in order
                a, z = max(0, at - _BEFORE), min(len(text), at + _BLOCK + _AFTER)
                past = min(len(text), at + _BLOCK)
                parts.append((i, text[a:z], at - a, z - past))
                held += past - at
                if held >= _BLOCK:
                    flush()
        flush()
        return totals


_known: dict[str, Counter] = {}


def count_tokens(docs: DataFrame, *, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024) -> DataFrame:
    """One row a document: ``(id_col, n_bytes, n_tokens, over_limit)``.

    n_tokens is what the library gives for the whole text without begin and end
    tokens; added tokens' literals within a text count as one token. A null
    text is an empty one: 0 bytes, 0 tokens. Repeated ids and equal texts are
    rows of their own, other columns don't matter, an empty table gives no
    rows. A text of any length is read in blocks, also one that has no white
    space at all. The driver reads the vocabulary's file; workers get its
    merges by a broadcast (a fixed vocabulary, some megabytes). A worker keeps
    its table for the next task, as long as it is small.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    held = spark.sparkContext.broadcast(Vocabulary.read(tokenizer_path))

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _known.get(tokenizer_path)
        if counter is None:
            _known.clear()
            counter = _known[tokenizer_path] = Counter(held.value)
        try:
            for batch in batches:
                for some in byte_slices(batch, "text"):
                    text = some.column("text")
                    n = counter.count([t or "" for t in text.to_pylist()])
                    size = pc.fill_null(pc.binary_length(text), 0).cast(pa.int64())
                    yield pa.RecordBatch.from_arrays([some.column("id"), size, pa.array(n), pa.array(n > limit)], names=["id", "n_bytes", "n_tokens", "over_limit"])
        finally:
            if len(counter.transducer.states) > _MOST_STATES // 4:
                _known.clear()
            give_back()

    kind = docs.schema[id_col].dataType.simpleString()
    made = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(counts, f"id {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean")
    return made.withColumnRenamed("id", id_col)
