"""Quality rules on repetition inside a document, by suffix array.

The words of many documents are ranked together, each document with symbols of
its own, so that no repeat crosses documents.  Prefix doubling refines the ranks
of suffixes that are not yet told apart; their ranks in every round are kept, and
the longest common prefix of neighbours in the suffix array is read from them.
The larger one of a suffix's two neighbouring prefixes is the longest substring
that starts there and occurs elsewhere in the document: the right end of its
LCP interval.  The union of these spans is that of all maximal repeated
substrings.  A document passes if the spans of MIN_REPEAT words or more cover at
most a fraction of its words and none is longer than a limit.  The base rule counts
spans of BASE_REPEAT words or more, so short phrases said again and again pass it
and fail here.

Defined results: a null, empty or blank text has no words, fails the base rule
on length and is not kept.  Repeated rows are measured each; ties do not arise.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from almanac.llm.shared import per_slice
from almanac.llm.text import Words, mix, powers, words

#: Shortest repeat that counts, in words.
MIN_REPEAT = 4
#: Largest part of a document's words inside repeats, and longest repeat in words.
MAX_COVERED = 0.3
MAX_LONGEST = 50
#: Base rule: fewest words, shortest repeat, and largest part of words inside repeats.
MIN_WORDS = 20
BASE_REPEAT = 8
BASE_COVERED = 0.3

_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def longest_repeats(symbols: np.ndarray, least: int) -> np.ndarray:
    """For each position, the length of the longest substring from there that occurs twice; 0 if below `least`.

    Each document must end in a symbol that occurs once.
    """
    n = len(symbols)
    best = np.zeros(n, np.int64)
    if n == 0:
        return best
    order = np.argsort(symbols, kind="stable")
    fresh = np.ones(n, bool)
    fresh[1:] = symbols[order[1:]] != symbols[order[:-1]]
    first = np.flatnonzero(fresh)
    rank = np.empty(n + 1, np.int64)
    rank[n] = -1
    rank[order] = np.repeat(first, np.diff(np.append(first, n)))
    alone = np.diff(np.append(first, n)) == 1
    active = order[~np.repeat(alone, np.diff(np.append(first, n)))]
    kept = [(active.astype(np.int32), rank[active].astype(np.int32))]
    step, repeated = 1, None
    while len(active):
        if step >= least and repeated is None:
            # Neighbours must share a prefix of the largest power of two up to `least`.
            repeated = active
        key = rank[active] * (n + 1) + rank[np.minimum(active + step, n)] + 1
        at = np.argsort(key, kind="stable")
        active, key = active[at], key[at]
        old = rank[active]
        group = np.ones(len(active), bool)
        group[1:] = old[1:] != old[:-1]
        parts = np.ones(len(active), bool)
        parts[1:] = key[1:] != key[:-1]
        place = np.arange(len(active))
        begin = np.maximum.accumulate(np.where(group, place, 0))
        part = np.maximum.accumulate(np.where(parts, place, 0))
        rank[active] = old + part - begin
        sizes = np.diff(np.append(np.flatnonzero(parts), len(active)))
        active = active[np.repeat(sizes > 1, sizes)]
        kept.append((active.astype(np.int32), rank[active].astype(np.int32)))
        step *= 2
    if repeated is None or not len(repeated):
        return best
    # All ranks differ now: order by them is the suffix array, here of the suffixes that can repeat.
    suffixes = repeated[np.argsort(rank[repeated], kind="stable")]
    a, b = suffixes[:-1], suffixes[1:]
    common = np.zeros(len(a), np.int64)
    ranks = np.full(n + 1, -1, np.int32)  # -1: alone in this round, equal to no other
    for level in range(len(kept) - 1, -1, -1):
        places, values = kept.pop()
        ranks[places] = values
        there = ranks[np.minimum(a + common, n)]
        common[(there >= 0) & (there == ranks[np.minimum(b + common, n)])] += 1 << level
        ranks[places] = -1
    np.maximum.at(best, a, common)
    np.maximum.at(best, b, common)
    best[best < least] = 0
    return best


def covered(best: np.ndarray, least: int) -> np.ndarray:
    """Whether each position is inside a repeat of at least `least`: the union of the spans."""
    edge = np.zeros(len(best) + 1, np.int64)
    at = np.flatnonzero(best >= least)
    edge[at] += 1
    np.subtract.at(edge, at + best[at], 1)
    return np.cumsum(edge)[:-1] > 0


def _per_doc(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate(([0], np.cumsum(flags)))[offsets])


def duplicate_lines(cut: Words) -> np.ndarray:
    """Per document, the lines with a word that equal an earlier line."""
    data, n = cut.data, len(cut.data)
    breaks = np.flatnonzero(data == 10)
    begin = np.unique(np.concatenate((breaks + 1, cut.offsets[:-1])))
    begin = begin[begin < n]
    doc = np.searchsorted(cut.offsets, begin, "right") - 1
    stop = np.minimum(np.append(breaks, n)[np.searchsorted(breaks, begin)], cut.offsets[doc + 1])
    worded = np.searchsorted(cut.start, stop) > np.searchsorted(cut.start, begin)
    begin, stop, doc = begin[worded], stop[worded], doc[worded]
    up, down = powers(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
    key = mix((sums[stop] - sums[begin]) * down[begin] + (stop - begin).astype(np.uint64))
    n_docs = len(cut.offsets) - 1
    distinct = np.unique(mix(key + mix(doc.astype(np.uint64))), return_index=True)[1]
    return np.bincount(doc, minlength=n_docs) - np.bincount(doc[distinct], minlength=n_docs)


def measure(texts: pa.Array) -> dict:
    cut = words(texts)
    n, n_docs = cut.counts, len(cut.offsets) - 1
    doc = cut.doc()
    # One end symbol after each document; places of words in the sequence with ends.
    place = np.arange(len(doc)) + doc
    symbols = np.zeros(len(doc) + n_docs, np.uint64)
    symbols[place] = mix(cut.hashes() ^ mix(doc.astype(np.uint64) + np.uint64(1)))
    symbols[cut.bounds[1:] + np.arange(n_docs)] = mix(np.arange(n_docs).astype(np.uint64) + np.uint64(1 << 62))
    best = longest_repeats(symbols, MIN_REPEAT)
    longest = np.zeros(n_docs, np.int64)
    np.maximum.at(longest, doc, best[place])
    n_repeat = _per_doc(covered(best, BASE_REPEAT)[place], cut.bounds)
    n_covered = _per_doc(covered(best, MIN_REPEAT)[place], cut.bounds)
    letters = np.zeros(len(cut.data) + 1, np.int64)
    np.cumsum((cut.data & 0xC0) != 0x80, out=letters[1:])
    chars = np.concatenate(([0], np.cumsum(letters[cut.end] - letters[cut.start])))
    failed = (n < MIN_WORDS) | (100 * n_repeat > round(100 * BASE_COVERED) * n)
    return {
        "n_words": n,
        "word_chars": np.diff(chars[cut.bounds]),
        "n_symbols": _per_doc(_SYMBOL[cut.data], cut.offsets),
        "n_dup_lines": duplicate_lines(cut),
        "n_repeat_words": n_repeat,
        "n_covered_words": n_covered,
        "longest_repeat": longest,
        "base_failed": failed,
        "kept": ~failed & (100 * n_covered <= round(100 * MAX_COVERED) * n) & (longest <= MAX_LONGEST),
    }


ADDED = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_covered_words long, longest_repeat long, base_failed boolean, kept boolean"


def repetition_rules(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns of docs, the base statistics, and whether the rules keep the document."""
    return per_slice(docs, ADDED, measure, keep)
