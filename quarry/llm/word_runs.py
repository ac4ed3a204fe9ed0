"""Texts as streams of words, a bounded number of bytes at a time."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator
from itertools import count

import numpy as np

#: Digits, letters and all bytes beyond ASCII are parts of words; A-Z become a-z, all else a space.
LOWERED = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def runs(text: bytes | None, most: int = 1 << 20) -> Iterator[list[bytes]]:
    """The words of a text in lists, each of ``most`` bytes of it or, where a word is longer, of that word."""
    if text is None:
        return
    at = 0
    while at < len(text):
        end = min(len(text), at + most)
        part = text[at:end].translate(LOWERED)
        while end < len(text) and part[-1] != 32:  # a word is cut: go on to its end
            more = text[end : end + 4096].translate(LOWERED)
            stop = more.find(b" ") + 1 or len(more)
            part, end = part + more[:stop], end + stop
        yield part.split()
        at = end


def numbered(blocks: Iterable[tuple[int, list[bytes]]], most: int = 500_000) -> Iterator[tuple[np.ndarray, np.ndarray, list[bytes]]]:
    """(owner, words) -> blocks of (owner of each word, its number in the
    block's dictionary, the dictionary). Owners come in rising order."""
    owners: list[int] = []
    sizes: list[int] = []
    ids: list[np.ndarray] = []
    known: defaultdict[bytes, int] = defaultdict(count().__next__)
    n = 0
    for owner, words in blocks:
        owners.append(owner)
        sizes.append(len(words))
        ids.append(np.fromiter(map(known.__getitem__, words), dtype=np.int64, count=len(words)))
        n += len(words)
        if n >= most:
            yield np.repeat(owners, sizes), np.concatenate(ids), list(known)
            owners, sizes, ids, n = [], [], [], 0
            known = defaultdict(count().__next__)
    if owners:
        yield np.repeat(owners, sizes), np.concatenate(ids), list(known)
