"""Substring dedup against a reference of its own: broadcast suffix automata of its shards.

Words covered by a window of WINDOW words that also stands in a text of the
reference leave the documents, as in `almanac.llm.repeats`; documents don't judge
each other here.

The words of the reference are counted first.  Up to `most` of them, its texts are
dealt into shards by hash, a task builds the suffix automaton of a shard and packs it
into five arrays, about 60 bytes a word, and all shards are broadcast.  Documents then
stream past them without a shuffle.  The matching statistics of many stretches of
words are followed at once, one step of all of them at a time.

A larger reference isn't broadcast: its windows meet those of the documents in the
shuffle of `repeats.repeated_windows`, with the same results.

Defined results: null texts stay null; texts of fewer than WINDOW words, on either
side, neither lose nor remove words; white space after a kept word stays as it was;
repeated and null rows of the reference change nothing; an empty reference or table
leaves all as it is.  Other columns pass through, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from almanac.llm.repeats import WINDOW, Automaton, cut_texts, removed_words, repeated_windows
from almanac.llm.shared import n_words
from almanac.llm.text import slices, words

#: Words of a reference that is broadcast, about 30 MB in all, and of a shard of it.
MOST_WORDS = 1 << 19
SHARD_WORDS = 1 << 17
#: Words of a stretch whose matches are followed in one lane.
STRETCH = 128

_PACKED = "symbols binary, keys binary, states binary, links binary, lengths binary"


@dataclass
class Packed:
    """A suffix automaton in arrays: transitions are found by binary search of state * symbols + symbol."""

    symbols: np.ndarray
    keys: np.ndarray
    states: np.ndarray
    links: np.ndarray
    lengths: np.ndarray

    @classmethod
    def of(cls, automaton: Automaton) -> Packed:
        sizes = [len(x) for x in automaton.next]
        reads = np.fromiter((symbol for x in automaton.next for symbol in x), np.uint64, sum(sizes))
        states = np.fromiter((state for x in automaton.next for state in x.values()), np.int32, sum(sizes))
        symbols = np.unique(reads)
        keys = np.repeat(np.arange(len(sizes)), sizes) * max(1, len(symbols)) + np.searchsorted(symbols, reads)
        order = np.argsort(keys)
        return cls(symbols, keys[order], states[order], np.array(automaton.link, np.int32), np.array(automaton.length, np.int32))

    def row(self) -> list[bytes]:
        return [x.tobytes() for x in (self.symbols, self.keys, self.states, self.links, self.lengths)]

    @classmethod
    def read(cls, row: list[bytes]) -> Packed:
        return cls(*(np.frombuffer(x, kind) for x, kind in zip(row, (np.uint64, np.int64, np.int32, np.int32, np.int32))))

    def ends(self, hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Whether a window that occurs here ends at each word; bounds are those of the documents."""
        found = np.zeros(len(hashes), bool)
        if not len(self.symbols) or not len(hashes):
            return found
        symbols = np.searchsorted(self.symbols, hashes)
        symbols[symbols == len(self.symbols)] = 0
        symbols[self.symbols[symbols] != hashes] = -1
        # A lane judges STRETCH words, and starts WINDOW - 1 words earlier in the same document.
        lanes = -(-np.diff(bounds) // STRETCH)
        doc = np.repeat(np.arange(len(lanes)), lanes)
        start = bounds[doc] + STRETCH * (np.arange(len(doc)) - np.repeat(np.cumsum(lanes) - lanes, lanes))
        end = np.minimum(start + STRETCH, bounds[doc + 1])
        at = np.maximum(bounds[doc], start - WINDOW + 1)
        state, length = np.zeros(len(doc), np.int64), np.zeros(len(doc), np.int64)
        while len(at):
            read = symbols[at]
            lost = read < 0
            state[lost], length[lost] = 0, 0
            open_ = np.flatnonzero(~lost)
            while len(open_):
                key = state[open_] * len(self.symbols) + read[open_]
                place = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                hit = self.keys[place] == key
                state[open_[hit]] = self.states[place[hit]]
                length[open_[hit]] += 1
                open_ = open_[~hit]
                at_root = state[open_] == 0
                length[open_[at_root]] = 0
                open_ = open_[~at_root]
                state[open_] = self.links[state[open_]]
                length[open_] = self.lengths[state[open_]]
            found[at[length >= WINDOW]] = True
            at = at + 1
            more = at < end
            if not more.all():
                at, end, state, length = at[more], end[more], state[more], length[more]
        return found


def shards(reference: DataFrame, n: int) -> DataFrame:
    """The packed automata of n shards of a reference; a shard is built in one task."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        built: dict[int, Automaton] = {}
        for batch in batches:
            cut = words(batch.column(1))
            hashes = cut.hashes()
            for shard, a, b in zip(batch.column(0).to_pylist(), cut.bounds.tolist(), cut.bounds[1:].tolist()):
                if b - a >= WINDOW:
                    built.setdefault(shard, Automaton()).add(hashes[a:b].tolist())
        for automaton in built.values():
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in Packed.of(automaton).row()], ["symbols", "keys", "states", "links", "lengths"])

    texts = reference.where("text IS NOT NULL").select(F.col("text").cast("string").alias("text")).distinct()
    dealt = texts.select(F.pmod(F.xxhash64("text"), F.lit(n)).alias("shard"), "text")
    return dealt.repartition(n, "shard").mapInArrow(build, _PACKED)


def remove_reference(docs: DataFrame, reference: DataFrame, most: int = MOST_WORDS) -> DataFrame:
    """docs with the words cut out of their texts that stand in windows of the reference's texts.

    most: words of a reference up to which it is broadcast.
    """
    size = reference.agg(F.sum(n_words(F.col("text").cast("string")))).first()[0] or 0
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"), F.col("text").cast("string").alias("text"))
    schema = StructType().add("doc", docs.schema).add("text", "string")
    cut = _broadcast(whole, reference, -(-size // SHARD_WORDS) or 1, schema) if size <= most else _shuffled(whole, reference, schema)
    return cut.select(*(F.col("text") if c == "text" else F.col(f"doc.`{c}`") for c in docs.columns))


def _broadcast(whole: DataFrame, reference: DataFrame, n: int, schema: StructType) -> DataFrame:
    held = whole.sparkSession.sparkContext.broadcast([[bytes(x) for x in r] for r in shards(reference, n).collect()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automata = [Packed.read(row) for row in held.value]
        for batch in batches:
            for a, b in slices(batch.column(1)):
                texts = batch.column(1)[a:b]
                found = words(texts)
                hashes, edge = found.hashes(), np.zeros(len(found.start) + 1, np.int64)
                ends = np.zeros(len(hashes), bool)
                for automaton in automata:
                    ends |= automaton.ends(hashes, found.bounds)
                last = np.flatnonzero(ends)
                np.add.at(edge, last - WINDOW + 1, 1)
                np.subtract.at(edge, last + 1, 1)
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], cut_texts(found, np.cumsum(edge)[:-1] > 0, texts)], ["doc", "text"])

    return whole.mapInArrow(run, schema)


def _shuffled(whole: DataFrame, reference: DataFrame, schema: StructType) -> DataFrame:
    """The same through the corpus's own dedup: the reference is one smaller document, the others are equal to each other."""
    both = reference.select(F.lit(0).alias("doc_id"), F.col("text").cast("string").alias("text")).union(whole.select(F.lit(1).alias("doc_id"), "text"))
    flags = repeated_windows(both).where("_id = 1").select("_row", "flags")
    flagged = whole.withColumn("_row", F.xxhash64(F.coalesce("text", F.lit("")))).join(flags, "_row", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column(1)):
                texts = batch.column(1)[a:b]
                found = words(texts)
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], cut_texts(found, removed_words(found, batch.column(2)[a:b]), texts)], ["doc", "text"])

    return flagged.select("doc", "text", F.coalesce("flags", F.array().cast("array<long>")).alias("flags")).mapInArrow(run, schema)
