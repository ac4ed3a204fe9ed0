"""Best-fit packing of tokenised documents, planned on the histogram of lengths.

The plan never sees a document: it places counts. Pieces then take the planned
slots by joining on their rank within their length.
"""

from __future__ import annotations

import bisect
import os
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import bounded_batches, byte_slices, give_back, ranked, written

END = 2
_KEPT = 1_000_000  # spellings after which a task forgets and starts anew: about 30 MB
_LONG = 64  # characters; longer spellings are not remembered
_BLOCK = 1 << 18  # characters handled at once
_FAR = 1 << 22  # characters without white space from which a text is no longer cut by it
_CUT = re.compile(r"(?<=\S)(?=[ \n\r\t])")  # white space after anything else starts a pre-token
#: Letters and marks whose pre-tokens are plain to see. The apostrophe, which starts contractions, is not among them.
_LETTERS = [range(0x41, 0x5B), range(0x61, 0x7B), range(0xC0, 0xD7), range(0xD8, 0xF7), range(0xF8, 0x250), range(0x400, 0x482), range(0x48A, 0x530)]
_MARKS = [range(0x21, 0x27), range(0x28, 0x30), range(0x3A, 0x41), range(0x5B, 0x61), range(0x7B, 0x7F)]
_OTHER, _LETTER, _MARK, _DIGIT, _FEED, _BLANK, _SPACE = range(7)
_TOP = 0x3001  # no white space from here on
_rng = np.random.default_rng(9)
_LOW, _HIGH, _PLACE = (_rng.integers(1 << 64, size=n, dtype=np.uint64) for n in (1 << 12, 1 << 9, _LONG))


def _classes() -> np.ndarray:
    out = np.full(_TOP + 1, _OTHER, dtype=np.uint8)
    out[[c for c in range(_TOP) if chr(c).isspace()]] = _SPACE
    for kind, ranges in ((_LETTER, _LETTERS), (_MARK, _MARKS), (_DIGIT, [range(0x30, 0x3A)]), (_FEED, [range(10, 11)]), (_BLANK, [range(32, 33)])):
        for r in ranges:
            out[r.start : r.stop] = kind
    return out


_CLASS = _classes()


def _repeated(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """start, start + 1 and so on, count of them, for each start."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - counts), counts)


class Encoder:
    """Texts to ids.

    The vocabulary's pattern starts a new pre-token at every space that stands
    between two characters other than white space, and where runs of letters,
    digits and marks meet. Texts are cut there by array operations over many
    texts at once; a word with anything else in it (other scripts, apostrophes, other
    white space) stays whole. Each part is looked up by a 64-bit hash of its
    characters. A text is handled 256 KB at a time, cut where white space
    begins; one without any for four million characters goes to the compiled transducer. New parts go to the tokenizer, many in one string, whose ids
    are dealt out by the bytes that each stands for: plain ones to its model
    alone, since they are single pre-tokens, the others to all of it.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import WhitespaceSplit

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.path, self.bounded = path, None
        spelled = self.tokenizer.get_vocab()
        self.bytes_of = np.zeros(max(spelled.values()) + 1, dtype=np.int64)
        self.bytes_of[list(spelled.values())] = [len(x) for x in spelled]  # a character stands for a byte
        self.added = {t.content: np.asarray([i], dtype="<u4").tobytes() for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.literals = re.compile(f"({'|'.join(map(re.escape, sorted(self.added, key=len, reverse=True)))})") if self.added else None
        model = self.tokenizer.model
        getattr(model, "_resize_cache", lambda n: None)(0)  # what it is asked is always new
        self.merger = Tokenizer(model)
        self.merger.pre_tokenizer = WhitespaceSplit()
        seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
        self.alphabet = np.zeros(256, dtype="<u4")  # the model's spelling of bytes
        self.alphabet[seen] = seen
        self.alphabet[sorted(set(range(256)) - set(seen))] = 256 + np.arange(256 - len(seen))
        self.alphabet[9] = 32  # the separator of plain parts, which hold no tab
        self.forget()

    def forget(self) -> None:
        """The known parts: sorted hashes, and where in ``flat`` the ids of each are."""
        self.hashes = np.zeros(0, dtype=np.uint64)
        self.starts = np.zeros(0, dtype=np.int64)
        self.counts = np.zeros(0, dtype=np.int64)
        self.flat = np.zeros(0, dtype="<u4")

    def whole(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _together(self, parts: list[str], plain: bool) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the parts and how many each has. Unless plain, parts begin with a space."""
        ids, counts = [np.zeros(0, dtype="<u4")], [np.zeros(0, dtype=np.int64)]
        for at in range(0, len(parts), 8192):
            some = parts[at : at + 8192]
            raw = np.frombuffer(("\t" if plain else "").join(some).encode(), dtype=np.uint8)
            if plain:
                cuts = np.flatnonzero(raw == 9)
                ends = np.concatenate((cuts, [len(raw)])) - np.arange(len(some))
                spelled, by = self.alphabet[raw].tobytes().decode("utf-32-le"), self.merger
            else:
                ends = np.cumsum([len(p.encode()) for p in some])
                spelled, by = raw.tobytes().decode(), self.tokenizer
            own = np.asarray(by.encode_batch_fast([spelled], add_special_tokens=False)[0].ids, dtype="<u4")
            past = np.searchsorted(np.cumsum(self.bytes_of[own]), ends, side="right")
            ids.append(own)
            counts.append(np.diff(past, prepend=0))
        return np.concatenate(ids), np.concatenate(counts)

    def _spelled_out(self, parts: list[str], plain: np.ndarray, bare: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """As ``_together()``, for parts of every kind. bare: the first of a text, which have no space in front."""
        counts = np.zeros(len(parts), dtype=np.int64)
        ids, order = [], []
        alone = np.flatnonzero(~plain & bare)
        for at, own in ((np.flatnonzero(plain), True), (np.flatnonzero(~plain & ~bare), False)):
            found, n = self._together([parts[i] for i in at.tolist()], own)
            counts[at] = n
            ids.append(found)
            order.append(at)
        for i, e in zip(alone.tolist(), self.tokenizer.encode_batch_fast([parts[i] for i in alone.tolist()], add_special_tokens=False), strict=True):
            ids.append(np.asarray(e.ids, dtype="<u4"))
            counts[i] = len(ids[-1])
        order = np.concatenate((*order, alone))
        starts = np.zeros(len(parts), dtype=np.int64)
        starts[order] = np.cumsum(counts[order]) - counts[order]
        return np.concatenate(ids)[_repeated(starts, counts)], counts

    def _block(self, texts: list[str], goes_on: list[bool]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts and how many each has. goes_on: it begins with a
        space that stood between two characters other than white space."""
        lengths = np.array([len(t) for t in texts], dtype=np.int64)
        whole = "".join(texts)
        if not whole:
            return np.zeros(0, dtype="<u4"), np.zeros(len(texts), dtype=np.int64)
        points = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), dtype="<u4")
        n = len(points)
        begins = np.cumsum(lengths) - lengths
        has = lengths > 0
        going = np.array(goes_on, dtype=bool) & has
        first, last = np.zeros(n, dtype=bool), np.zeros(n, dtype=bool)
        first[begins[has & ~going]] = True
        last[(begins + lengths)[has] - 1] = True
        kind = _CLASS[np.minimum(points, _TOP)]
        empty = kind >= _FEED
        beside = np.empty(n, dtype=bool)  # white space or a text's end on either side
        beside[0], beside[1:] = True, empty[:-1]
        beside |= first
        beside[begins[going]] = False
        beside[:-1] |= empty[1:]
        beside |= last
        start = ((kind == _BLANK) & ~beside) | first
        odd = (kind == _OTHER) | (kind == _SPACE) | ((kind >= _FEED) & beside)
        word = np.flatnonzero(start)
        within = np.repeat(np.logical_or.reduceat(odd, word), np.diff(word, append=n))
        turn = np.empty(n, dtype=bool)
        turn[0], turn[1:] = True, (kind[1:] != kind[:-1]) & ~((kind[:-1] == _BLANK) & start[:-1])
        start |= turn & ~within
        at = np.flatnonzero(start)
        sizes = np.diff(at, append=n)
        place = np.minimum(np.arange(n) - np.repeat(at, sizes), _LONG - 1)
        mixed = _LOW[points & 0xFFF]
        if points.max() > 0xFFF:
            mixed = mixed ^ _HIGH[points >> 12]
        keys = np.add.reduceat(mixed * _PLACE[place], at)
        starts, counts, flat = self._placed(whole, at, sizes, keys, within, first)
        texts_at = np.searchsorted(at, np.append(begins, n))
        ends = np.concatenate(([0], np.cumsum(counts)))
        return flat[_repeated(starts, counts)], np.diff(ends[texts_at])

    def _placed(self, whole: str, at: np.ndarray, sizes: np.ndarray, keys: np.ndarray, within: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where the ids of each part are, how many, and the array that they are in."""
        if len(self.hashes) > _KEPT:
            self.forget()
        long = np.flatnonzero(sizes > _LONG)
        if len(long):  # each a part of its own: their hashes say too little
            short = np.flatnonzero(sizes <= _LONG)
            kept, back, of = np.unique(keys[short], return_index=True, return_inverse=True)
            back = short[back]
        else:
            kept, back, of = np.unique(keys, return_index=True, return_inverse=True)
        spot = np.searchsorted(self.hashes, kept)
        known = spot < len(self.hashes)
        known[known] = self.hashes[spot[known]] == kept[known]
        starts, counts = np.zeros(len(kept), dtype=np.int64), np.zeros(len(kept), dtype=np.int64)
        starts[known], counts[known] = self.starts[spot[known]], self.counts[spot[known]]
        new = np.concatenate((back[~known], long))
        parts = [whole[a : a + s] for a, s in zip(at[new].tolist(), sizes[new].tolist(), strict=True)]
        ids, n = self._spelled_out(parts, ~within[at[new]], first[at[new]])
        begin = len(self.flat) + np.cumsum(n) - n
        flat, m = np.concatenate((self.flat, ids)), len(new) - len(long)
        starts[~known], counts[~known] = begin[:m], n[:m]
        self.hashes = np.insert(self.hashes, spot[~known], kept[~known])
        self.starts = np.insert(self.starts, spot[~known], begin[:m])
        self.counts = np.insert(self.counts, spot[~known], n[:m])
        self.flat = flat[: len(self.flat) + int(n[:m].sum())]
        if not len(long):
            return starts[of], counts[of], flat
        all_starts, all_counts = np.zeros(len(at), dtype=np.int64), np.zeros(len(at), dtype=np.int64)
        all_starts[short], all_counts[short] = starts[of], counts[of]
        all_starts[long], all_counts[long] = begin[m:], n[m:]
        return all_starts, all_counts, flat

    def _without_spaces(self, text: str) -> bytes:
        """Ids of millions of characters without white space, which the library
        would hold at 50 bytes and more a character: by the compiled transducer."""
        if self.bounded is None:
            from quarry.llm.token_counts import Counter, Vocabulary

            self.bounded = Counter(Vocabulary.read(self.path))
        return self.bounded.encode(text)

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as little-endian unsigned 32-bit bytes."""
        out: list[list[bytes]] = [[] for _ in texts]
        parts: list[str] = []
        owners: list[int] = []
        goes_on: list[bool] = []
        n = 0

        def flush() -> None:
            nonlocal n
            ids, counts = self._block(parts, goes_on)
            raw, ends = ids.tobytes(), (4 * np.cumsum(counts)).tolist()
            for i, a, b in zip(owners, [0, *ends], ends, strict=False):
                out[i].append(raw[a:b])
            for done in (parts, owners, goes_on):
                done.clear()
            n = 0

        for i, text in enumerate(texts):
            at = 0
            while at < len(text):
                cut = _CUT.search(text, at + _BLOCK)
                end = cut.start() if cut else len(text)
                if end - at > _FAR:
                    if parts:
                        flush()
                    out[i].append(self._without_spaces(text[at:end]))
                    at = end
                    continue
                parts.append(text[at:end])
                owners.append(i)
                goes_on.append(at > 0 and text[at] == " " and not text[at + 1 : at + 2].isspace() and at + 1 < len(text))
                n += end - at
                at = end
                if n >= _BLOCK:
                    flush()
        if parts:
            flush()
        return [b"".join(x) for x in out]

    def encode_default(self, texts: list[str]) -> list[bytes]:
        """As the tokenizer's default call, which recognises added tokens within a text."""
        if self.literals is None or not any(map(self.literals.search, texts)):
            return self.encode(texts)
        parts = [self.literals.split(t) for t in texts]  # text, added token, text and so on
        ids = iter(self.encode([x for p in parts for x in p[::2]]))
        return [b"".join(self.added[x] if k % 2 else next(ids) for k, x in enumerate(p)) for p in parts]


def pieces_of(ids: bytes, size: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of so many ids: the first may be short."""
    n = len(ids) // 4
    first = n % size or size
    bounds = [0, *range(first, n + 1, size)]
    return [(a, b - a) for a, b in zip(bounds, bounds[1:], strict=False)]


def tokenised(docs: DataFrame, tokenizer_path: str, size: int, with_ids: bool) -> DataFrame:
    """``docs(id, text)`` -> a row a piece: ``(id, piece, start, length,
    ids_crc32)`` and, on request, the ids. Texts are taken a megabyte at a
    time; a worker drops its encoder when its task ends."""
    more = ", ids array<bigint>" if with_ids else ""
    schema = f"id {docs.schema['id'].dataType.simpleString()}, piece int, start bigint, length bigint, ids_crc32 bigint{more}"
    end = np.asarray([END], dtype="<u4").tobytes()

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(tokenizer_path)
        try:
            for batch in batches:
                for some in byte_slices(batch, "text", 1 << 20):
                    encoded = [x + end for x in encoder.encode_default([t or "" for t in some.column("text").to_pylist()])]
                    rows = [(i, k, start, n) for i, ids in enumerate(encoded) for k, (start, n) in enumerate(pieces_of(ids, size))]
                    i, k, start, n = np.asarray(rows, dtype=np.int64).reshape(-1, 4).T
                    own = [encoded[r[0]][4 * r[2] : 4 * (r[2] + r[3])] for r in rows]
                    columns = [some.column("id").take(pa.array(i)), pa.array(k.astype(np.int32)), pa.array(start), pa.array(n), pa.array(list(map(zlib.crc32, own)), type=pa.int64())]
                    if with_ids:
                        flat = np.frombuffer(b"".join(own), dtype="<u4").astype(np.int64)
                        columns.append(pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(n))).astype(np.int32)), pa.array(flat)))
                    yield pa.RecordBatch.from_arrays(columns, names=["id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])])
        finally:
            del encoder
            give_back()

    return docs.mapInArrow(pieces, schema)


def plan(histogram: dict[int, int], size: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over counts.

    Returns slots (length, first_rank, past_rank, first_bin, per_bin, offset):
    the pieces of that length with those ranks go to consecutive bins from
    first_bin, per_bin to each, from that offset on. Bins of equal free space are
    alike, so each step places a run of pieces in a run of bins; the work
    depends on the number of lengths, not of pieces.
    """
    free: dict[int, list[tuple[int, int]]] = defaultdict(list)  # free space -> runs of bins (first, count)
    spaces: list[int] = []
    slots, bins = [], 0

    def put_back(space: int, first: int, count: int) -> None:
        if space and count:
            if space not in free:
                bisect.insort(spaces, space)
            free[space].append((first, count))

    for length in sorted(histogram, reverse=True):
        rank, left = 0, histogram[length]
        while left:
            at = bisect.bisect_left(spaces, length)
            if at < len(spaces):
                space = spaces[at]
                first, count = free[space].pop()
                if not free[space]:
                    del free[space]
                    spaces.pop(at)
            else:
                space, first = size, bins
                count = -(-left // (size // length))
                bins += count
            per = space // length
            full, odd = divmod(left, per)
            full = min(full, count)
            if full:
                slots.append((length, rank, rank + full * per, first, per, size - space))
                put_back(space - per * length, first, full)
                rank, left = rank + full * per, left - full * per
                first, count = first + full, count - full
            if count and left and left < per:
                slots.append((length, rank, rank + left, first, left, size - space))
                put_back(space - left * length, first, 1)
                rank, left, first, count = rank + left, 0, first + 1, count - 1
            if space < size:
                put_back(space, first, count)
    return slots


def pack(
    docs: DataFrame, *, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", size: int = 1024, with_ids: bool = False
) -> DataFrame:
    """One row a piece: ``(id_col, piece, start, length, ids_crc32, sequence_id,
    offset)`` and, on request, ``ids``.

    Every document is its ids and the end id. Only documents longer than
    ``size`` are cut, into pieces of that length but for the first. A null
    text is an empty one: the end id alone. Repeated ids and equal texts are
    packed as rows of their own; an empty table gives no rows.

    The driver gets a histogram of at most ``size`` lengths and makes a plan
    from it. A length opens at most two new runs of bins, and each slot fills
    more than half of the free space of its run, so the plan has at most
    2 * size * log2(size) rows (20,480) whatever the corpus, and is broadcast.
    """
    spark: SparkSession = docs.sparkSession
    bounded_batches(spark)
    made = tokenised(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), tokenizer_path, size, with_ids)
    pieces = written(made.withColumn("row", F.monotonically_increasing_id()))
    histogram = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    columns = np.array(plan(histogram, size), dtype=np.int64).reshape(-1, 6).T
    # as an Arrow table: of a list Spark makes an RDD that Python workers of another kind read, which stay beside the others
    slots = spark.createDataFrame(pa.table(dict(zip(("slot_length", "first_rank", "past_rank", "first_bin", "per_bin", "slot_offset"), map(pa.array, columns), strict=True))))
    placed = ranked(pieces, "length", ["row"], "rank", sum(histogram.values()))
    here = (F.col("length") == F.col("slot_length")) & (F.col("rank") >= F.col("first_rank")) & (F.col("rank") < F.col("past_rank"))
    nth = F.col("rank") - F.col("first_rank")
    return placed.join(F.broadcast(slots), here).select(
        F.col("id").alias(id_col), "piece", "start", "length", "ids_crc32",
        (F.col("first_bin") + F.floor(nth / F.col("per_bin"))).cast("long").alias("sequence_id"),
        (F.col("slot_offset") + nth % F.col("per_bin") * F.col("length")).cast("long").alias("offset"),
        *(["ids"] if with_ids else []),
    )
