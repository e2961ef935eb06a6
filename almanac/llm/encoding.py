"""Token ids of whole texts, each distinct word encoded once by the tokenizer's own library.

A tokenizer qualifies when its rules never join anything across a separator of
`text.WORD`: then the ids of a text are those of its words in a row.  A worker
process keeps the ids of the words it has met, up to a bound, and texts become
gathers from that table.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pandas as pd

from almanac.llm.text import Words

#: Words that a worker keeps before it starts anew.
MOST_WORDS = 600_000


class Table:
    """Ids of words by row."""

    def clear(self) -> None:
        self.flat, self.used = np.zeros(1 << 16, np.int32), 0
        self.start, self.size = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64)

    def _put(self, n: int, ids: np.ndarray, sizes: np.ndarray) -> None:
        """Ids of rows from n on, in a row."""
        total = len(ids)
        while self.used + total > len(self.flat):
            self.flat = np.concatenate((self.flat, np.zeros_like(self.flat)))
        while n + len(sizes) > len(self.start):
            self.start, self.size = (np.concatenate((x, np.zeros_like(x))) for x in (self.start, self.size))
        self.flat[self.used : self.used + total] = ids
        self.size[n : n + len(sizes)] = sizes
        self.start[n : n + len(sizes)] = self.used + np.cumsum(sizes) - sizes
        self.used += total

    def gather(self, rows: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the given rows in a row; bounds of rows as bounds of ids."""
        sizes = self.size[rows]
        upto = np.concatenate(([0], np.cumsum(sizes)))
        at = np.repeat(self.start[rows] - upto[:-1], sizes)
        at += np.arange(len(at))
        return self.flat[at], upto[bounds]


class Memo(Table):
    """Ids by word.  encode gets a list of texts and returns a list of id lists."""

    def __init__(self, encode: Callable[[list[str]], list[list[int]]], most: int = MOST_WORDS):
        self.encode, self.most = encode, most
        self.clear()

    def clear(self) -> None:
        super().clear()
        self.row: dict[bytes, int] = {}

    def _add(self, keys: list[bytes]) -> None:
        found = self.encode([k.decode("utf-8", "replace") for k in keys])
        n, sizes = len(self.row), np.fromiter(map(len, found), np.int64, len(found))
        self._put(n, np.fromiter((i for ids in found for i in ids), np.int32, int(sizes.sum())), sizes)
        self.row.update(zip(keys, range(n, n + len(keys))))

    def rows(self, keys: list[bytes]) -> np.ndarray:
        """Rows of the given distinct words."""
        if len(self.row) > self.most:
            self.clear()
        get = self.row.get
        rows = [get(k, -1) for k in keys]
        if new := [k for k, r in zip(keys, rows) if r < 0]:
            self._add(new)
            rows = [self.row[k] for k in keys]
        return np.array(rows, np.int64)


class HashMemo(Table):
    """Ids by the hash of a word.  encode gets a list of words in UTF-8 and returns all ids in a row, and how many each word has.

    Words themselves aren't kept, so that there is room for more of them than in a Memo.
    """

    def __init__(self, encode: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]], most: int = 2 * MOST_WORDS):
        self.encode, self.most = encode, most
        self.clear()

    def clear(self) -> None:
        super().clear()
        self.known, self.at = np.zeros(0, np.uint64), np.zeros(0, np.int32)

    def ids(self, cut: Words) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in a row, and the bounds of each document's."""
        hashes = cut.hashes()
        codes, first = distinct(hashes)
        if len(self.known) > self.most:
            self.clear()
        order = np.argsort(hashes[first])
        first = first[order]
        hashes, place = hashes[first], np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        before = np.searchsorted(self.known, hashes)
        new = np.ones(len(hashes), bool)
        new[before < len(self.known)] = self.known[before[before < len(self.known)]] != hashes[before < len(self.known)]
        if new.any():
            data, n = cut.data.tobytes(), len(self.known)
            self._put(n, *self.encode([data[a:b] for a, b in zip(cut.start[first[new]].tolist(), cut.end[first[new]].tolist())]))
            self.at = np.insert(self.at, before[new], np.arange(n, n + int(new.sum()), dtype=np.int32))
            self.known = np.insert(self.known, before[new], hashes[new])
            before += np.cumsum(new) - new  # as many new ones stand before it
        return self.gather(self.at[before][place[codes]], cut.bounds)


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each key the number of its value, and for each value its first place."""
    codes, values = pd.factorize(keys)
    first = np.empty(len(values), np.int64)
    first[codes[::-1]] = np.arange(len(keys) - 1, -1, -1)
    return codes, first


# Kinds of bytes in words that are cut further: letters, digits, others, and what is not cut at all.
_LETTER, _DIGIT, _OTHER, _UNCUT = range(4)
_KIND = np.full(256, _UNCUT, np.uint8)
_KIND[0x21:0x7F] = _OTHER
_KIND[ord("0") : ord("9") + 1] = _DIGIT
_KIND[ord("A") : ord("Z") + 1] = _LETTER
_KIND[ord("a") : ord("z") + 1] = _LETTER
_KIND[[ord("'"), ord("<")]] = _UNCUT
#: Accented letters of the first 256 code points, as bytes after 0xC3.
_ACCENTED = np.zeros(256, bool)
_ACCENTED[0x80:0xC0] = True
_ACCENTED[[0x97, 0xB7]] = False


def lower_runs(cut: Words) -> Words:
    """Words of plain characters, lower-cased and cut into runs of letters, single digits and runs of others.

    Other words (with apostrophes, `<`, control characters, or letters beyond
    U+00FF) stay whole and unchanged.  For splitters that lower-case and make
    these cuts themselves, it leaves fewer distinct pieces.
    """
    n = len(cut.data)
    kind = _KIND[cut.data]
    lead = np.flatnonzero(cut.data[:-1] == 0xC3) if n else np.zeros(0, np.int64)
    lead = lead[_ACCENTED[cut.data[lead + 1]]]
    kind[lead] = _LETTER
    kind[lead + 1] = _LETTER
    bad = np.zeros(n + 1, np.int64)
    np.cumsum(kind == _UNCUT, out=bad[1:])
    plain = bad[cut.end] == bad[cut.start]
    inside = np.zeros(n + 1, np.int8)
    inside[cut.start[plain]] += 1
    inside[cut.end[plain]] -= 1
    inside = np.cumsum(inside, dtype=np.int8)[:n] > 0
    fresh = np.zeros(n, bool)
    if n:
        fresh[1:] = inside[1:] & ((kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT))
    fresh[cut.start] = True
    start = np.flatnonzero(fresh)
    whole = np.zeros(n, bool)
    whole[cut.start] = True
    owner = np.cumsum(whole[start]) - 1
    end = np.minimum(np.append(start[1:], n), cut.end[owner])
    data = cut.data.copy()
    upper = inside & (data >= ord("A")) & (data <= ord("Z"))
    data[upper] += 32
    second = lead + 1
    second = second[inside[second] & (data[second] < 0x9F)]
    data[second] += 0x20
    return Words(data, start, end, np.searchsorted(start, _starts(cut)), cut.offsets)


def _starts(cut: Words) -> np.ndarray:
    """The place of the first word of each document, and the end."""
    return np.append(cut.start, len(cut.data))[cut.bounds]


#: What lower_runs makes of plain words: one run; and such runs with spaces between them.
RUN = re.compile(r"[a-z\u00DF-\u00F6\u00F8-\u00FF]+|[0-9]|[!-&(-/:;=-@\[-`{-~]+")
RUNS = re.compile(rf"(?>{RUN.pattern})(?: (?>{RUN.pattern}))*+")
