"""Substring dedup: words in spans that repeat an earlier document, by suffix automata.

A span is a run of windows of WINDOW consecutive words each of which also starts
in a document with a smaller doc_id.  The reference is the corpus itself, so its
automata can't be broadcast whole; they are split into shards that meet the
documents they concern instead:

1. Every window has an anchor: the run of ANCHOR words in it with the smallest
   hash.  Equal windows have equal anchors, and neighbouring windows mostly share
   theirs, so there are about five times fewer anchors than words.
2. Anchors of two documents or more are shared; counts from each batch of texts find
   them, and are joined to a row an anchor and batch that lists its documents.  Only
   windows with a shared anchor go on.
3. The windows of a document around one anchor form a context.  A shard is an
   anchor with all contexts around it, in order of doc_id.  A generalised suffix
   automaton of the contexts so far gives the matching statistics of the next
   one: where the match is WINDOW words or longer, the window stood in a smaller
   document.  Only contexts with something new enter the automaton.
4. Flagged windows return to their documents; the words they cover are removed.

Copies of a whole text are flagged as such and send no contexts.  Equal contexts
inside one batch of texts are judged there: all but those of its
smallest document are flagged, and only one of them moves.  So a passage in a
third of all documents costs a row for each batch, not for each document; flags
found there go anywhere, not to their anchor.  An anchor of more than HOT
documents is salted: its contexts move window by window, and the hash of a window
says in which of its shards it is judged, so no automaton holds all surroundings.

A reference that isn't the corpus itself, and is of bounded size, is broadcast as
packed automata by `almanac.llm.reference`.

Defined results: a null or empty text has no words and loses none; texts of fewer
than WINDOW words lose none; rows with equal doc_id don't flag each other; a null
doc_id counts as larger than all others.  An empty table gives an empty result.
"""

from __future__ import annotations

import copy
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from almanac.llm.shared import release, written
from almanac.llm.text import Words, mix, rolling, slices, words

WINDOW = 13
ANCHOR = 5
#: Documents of an anchor for each shard it is split into.
HOT = 1 << 14
#: Bytes of a word's hash in a context.
_WORD_BYTES = 5
_NO_ID = (1 << 63) - 1
#: The flag of a document whose text is that of a smaller one.
ALL = -1


class Automaton:
    """A generalised suffix automaton over sequences of hashable symbols."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link, self.length = [-1], [0]

    def _copy(self, p: int, q: int, symbol) -> int:
        """A state for the part of q that p's transition reaches."""
        clone = len(self.next)
        self.next.append(dict(self.next[q]))
        self.link.append(self.link[q])
        self.length.append(self.length[p] + 1)
        self.link[q] = clone
        while p >= 0 and self.next[p].get(symbol) == q:
            self.next[p][symbol] = clone
            p = self.link[p]
        return clone

    def add(self, symbols: list) -> None:
        last = 0
        for symbol in symbols:
            q = self.next[last].get(symbol)
            if q is not None:
                last = q if self.length[q] == self.length[last] + 1 else self._copy(last, q, symbol)
                continue
            state, p = len(self.next), last
            self.next.append({})
            self.link.append(0)
            self.length.append(self.length[last] + 1)
            while p >= 0 and symbol not in self.next[p]:
                self.next[p][symbol] = state
                p = self.link[p]
            if p >= 0:
                q = self.next[p][symbol]
                self.link[state] = q if self.length[q] == self.length[p] + 1 else self._copy(p, q, symbol)
            last = state

    def matches(self, symbols: list) -> Iterator[int]:
        """For each place, the length of the longest suffix up to it that occurs in the automaton."""
        state = length = 0
        for symbol in symbols:
            while state and symbol not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            if symbol in self.next[state]:
                state = self.next[state][symbol]
                length += 1
            yield length


class Contexts:
    """Anchors and contexts of a batch of texts: windows start:start + n of a document share an anchor."""

    def __init__(self, cut: Words):
        self.hashes = cut.hashes()
        self.windows = rolling(self.hashes, WINDOW)
        counts = cut.counts
        # Windows by start, in documents long enough to have one.
        starts = np.arange(len(self.hashes))
        ends = np.repeat(cut.bounds[1:], counts)
        starts = starts[starts + WINDOW <= ends]
        anchors = rolling(self.hashes, ANCHOR)
        best, at = anchors[starts], starts.copy()
        for j in range(1, WINDOW - ANCHOR + 1):
            other = anchors[starts + j]
            less = other < best
            best = np.where(less, other, best)
            at = np.where(less, starts + j, at)
        doc = np.searchsorted(cut.bounds, starts, "right") - 1
        new = np.ones(len(starts), bool)
        new[1:] = (at[1:] != at[:-1]) | (doc[1:] != doc[:-1])
        first = np.flatnonzero(new)
        self.start, self.n = starts[first], np.diff(np.append(first, len(starts)))
        self.anchor, self.doc = best[first], doc[first]
        self.local = self.start - cut.bounds[self.doc]

    def take(self, which: np.ndarray) -> Contexts:
        """The given ones of these contexts."""
        some = copy.copy(self)
        for name in ("start", "n", "anchor", "doc", "local"):
            setattr(some, name, getattr(self, name)[which])
        return some

    def salted(self, salts: np.ndarray) -> Contexts:
        """A context for each window, whose anchor is mixed with its hash modulo the context's salts."""
        some = self.take(np.repeat(np.arange(len(self.n)), self.n))
        step = np.arange(len(some.n)) - np.repeat(np.cumsum(self.n) - self.n, self.n)
        some.start, some.local, some.n = some.start + step, some.local + step, np.ones(len(step), np.int64)
        some.anchor = mix(some.anchor + mix(some.windows[some.start] % np.repeat(salts, self.n).astype(np.uint64) + np.uint64(1)))
        return some

    def content(self) -> np.ndarray:
        """A hash of the words of each context: its first and last windows overlap, so they say all."""
        if not len(self.start):
            return np.zeros(0, np.uint64)
        return mix(self.windows[self.start] + mix(self.windows[self.start + self.n - 1] + self.n.astype(np.uint64)))

    def later(self, ids: np.ndarray) -> np.ndarray:
        """Whether an equal context here has a smaller id; ids are those of the documents."""
        ids, content = ids[self.doc], self.content()
        order = np.lexsort((ids, content))
        first = np.ones(len(order), bool)
        first[1:] = content[order][1:] != content[order][:-1]
        smallest = np.empty(len(order), np.int64)
        smallest[order] = ids[order][np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))] if len(order) else ids
        return ids > smallest

    def words(self, which: np.ndarray) -> pa.Array:
        """The hashed words of the given contexts, packed."""
        sizes = self.n[which] + WINDOW - 1
        upto = np.concatenate(([0], np.cumsum(sizes)))
        at = np.repeat(self.start[which] - upto[:-1], sizes) + np.arange(upto[-1])
        packed = self.hashes[at].view(np.uint8).reshape(-1, 8)[:, :_WORD_BYTES].tobytes()
        return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer((upto * _WORD_BYTES).astype(np.int32)), pa.py_buffer(packed)])


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _unsigned(x: pa.Array) -> np.ndarray:
    return np.asarray(x).astype(np.int64).view(np.uint64)


def _anchor_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b in slices(batch.column(0)):
            found = Contexts(words(batch.column(0)[a:b]))
            pairs = np.unique(np.stack((found.anchor, found.doc.astype(np.uint64))), axis=1)[0] if len(found.anchor) else found.anchor
            anchors, counts = np.unique(pairs, return_counts=True)
            yield pa.RecordBatch.from_arrays([_signed(anchors), pa.array(counts, pa.int64())], ["anchor", "n"])


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each anchor of a slice of texts: its first document, and the others in `more`, null where there are none."""
    for batch in batches:
        for a, b in slices(batch.column(2)):
            found = Contexts(words(batch.column(2)[a:b]))
            order = np.lexsort((found.doc, found.anchor))
            anchor, doc = found.anchor[order], found.doc[order]
            again = np.zeros(len(order), bool)
            again[1:] = (anchor[1:] == anchor[:-1]) & (doc[1:] == doc[:-1])
            anchor, doc = anchor[~again], doc[~again]
            first = np.ones(len(anchor), bool)
            first[1:] = anchor[1:] != anchor[:-1]
            ids, rows = batch.column(0)[a:b], batch.column(1)[a:b]
            one, others = pa.array(doc[first]), pa.array(doc[~first])
            upto = np.append(np.flatnonzero(first), len(anchor)) - np.arange(first.sum() + 1)
            more = pa.ListArray.from_arrays(pa.array(upto, pa.int32()), pa.StructArray.from_arrays([ids.take(others), rows.take(others)], ["_id", "_row"]), mask=pa.array(upto[1:] == upto[:-1]))
            yield pa.RecordBatch.from_arrays([_signed(anchor[first]), ids.take(one), rows.take(one), more], ["anchor", "_id", "_row", "more"])


def _marks(rows: pa.Array, anchors: pa.Array) -> np.ndarray:
    """A hash of document and anchor, for each anchor in an array column."""
    sizes = np.diff(np.asarray(rows.offsets))
    return mix(_unsigned(anchors) + mix(np.repeat(np.arange(len(sizes)), sizes).astype(np.uint64)))


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["anchor", "_id", "_row", "place", "words"]

    def rows(batch: pa.RecordBatch, a: int, found: Contexts, later: np.ndarray) -> pa.RecordBatch:
        take = pa.array(found.doc + a)
        packed = found.words(~later).take(pa.array(np.cumsum(~later) - 1, mask=later))
        doc, row = batch.column(0).take(take), batch.column(1).take(take)
        shard = np.where(later, _unsigned(row), found.anchor)  # what is flagged already needs no shard
        return pa.RecordBatch.from_arrays([_signed(shard), doc, row, pa.array(found.local * 16 + found.n, pa.int64()), packed], names)

    for batch in batches:
        for a, b in slices(batch.column(2)):
            found = Contexts(words(batch.column(2)[a:b]))
            shared, hot = batch.column(3)[a:b], batch.column(4)[a:b]
            mark = mix(found.anchor + mix(found.doc.astype(np.uint64)))
            here = np.isin(mark, _marks(shared, shared.flatten()))
            found, mark = found.take(here), mark[here]
            ids = np.asarray(batch.column(0))[a:b]
            later = found.later(ids)
            hot_rows = hot.flatten()
            hot_mark = _marks(hot, hot_rows.field("anchor"))
            split = np.isin(mark, hot_mark) & ~later
            yield rows(batch, a, found.take(~split), later[~split])
            if split.any():
                order = np.argsort(hot_mark)
                at = order[np.searchsorted(hot_mark, mark[split], sorter=order)]
                single = found.take(split).salted(np.asarray(hot_rows.field("salts"))[at])
                yield rows(batch, a, single, single.later(ids))


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows by anchor and id: windows of each context that stood in one with a smaller id.

    place is start * 16 + number of windows.

    A flag is start * 2**WINDOW + bits, one bit for each window from start.
    """
    shard, current, automaton, waiting = None, None, None, []
    for batch in batches:
        out: list[list[int]] = [[], [], []]
        columns = [batch.column(i).to_pylist() for i in range(5)]
        for anchor, doc, row, place, packed in zip(*columns):
            start, n = divmod(place, 16)
            if packed is None:  # flagged where it was found
                bits = (1 << n) - 1
            else:
                if anchor != shard:
                    shard, current, automaton, waiting = anchor, doc, None, []
                elif doc != current:
                    current = doc
                    if waiting and automaton is None:
                        automaton = Automaton()
                    for symbols in waiting:
                        automaton.add(symbols)
                    waiting = []
                symbols = [packed[i : i + _WORD_BYTES] for i in range(0, len(packed), _WORD_BYTES)]
                bits = 0
                if automaton is not None:
                    for i, length in enumerate(automaton.matches(symbols)):
                        if length >= WINDOW:
                            bits |= 1 << (i - WINDOW + 1)
                if bits != (1 << n) - 1:
                    waiting.append(symbols)
            if bits:
                out[0].append(doc), out[1].append(row), out[2].append((start << WINDOW) | bits)
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], ["_id", "_row", "flag"])


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.withColumns({"_id": F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)), "_row": F.xxhash64(F.coalesce(F.col("text"), F.lit("")))})


def _hits(texts: DataFrame) -> DataFrame:
    """(_id, _row, anchors, hot): the shared anchors of each document but copies of a smaller one, and the salts of hot ones."""
    counted = texts.select("text").mapInArrow(_anchor_counts, "anchor long, n long")
    shared = counted.groupBy("anchor").agg(F.sum("n").alias("n")).where("n > 1").select("anchor", F.ceil(F.col("n") / HOT).alias("salts"))
    met = texts.mapInArrow(_anchors, "anchor long, _id long, _row long, more array<struct<_id: long, _row: long>>").join(shared, "anchor")
    one = F.array(F.struct("_id", "_row"))
    found = met.select("anchor", "salts", F.explode(F.when(F.col("more").isNull(), one).otherwise(F.concat(one, "more"))).alias("doc")).select("anchor", "salts", "doc.*")
    hot = F.when(F.col("salts") > 1, F.struct("anchor", "salts"))
    hits = found.groupBy("_id", "_row").agg(F.collect_set("anchor").alias("anchors"), F.collect_set(hot).alias("hot"))
    return hits.join(_copied(texts), "_row", "left").where("first IS NULL OR first = _id").drop("first")


def _copied(texts: DataFrame) -> DataFrame:
    """(_row, first): texts of several documents, and the smallest of these."""
    return texts.groupBy("_row").agg(F.min("_id").alias("first"), F.max("_id").alias("last")).where("first < last").drop("last")


def repeated_windows(docs: DataFrame) -> DataFrame:
    """(_id, _row, flags) of the documents with windows that repeat a smaller one's; ALL flags a copy's."""
    spark = docs.sparkSession
    texts = _keyed(docs).select("_id", "_row", "text")
    hits = written(_hits(texts), "anchors")
    release(spark)
    contexts = texts.join(hits, ["_id", "_row"]).select("_id", "_row", "text", "anchors", "hot").mapInArrow(_contexts, "anchor long, _id long, _row long, place long, words binary")
    ordered = contexts.repartition("anchor").sortWithinPartitions("anchor", "_id")
    flags = written(ordered.mapInArrow(_judge, "_id long, _row long, flag long"), "flags")
    release(spark)
    copies = texts.join(_copied(texts), "_row").where("_id > first").select("_id", "_row", F.lit(ALL).cast("long").alias("flag"))
    return flags.union(copies).groupBy("_id", "_row").agg(F.collect_set("flag").alias("flags"))


def removed_words(cut: Words, flags: pa.Array) -> np.ndarray:
    """Whether each word is covered by a flagged window."""
    sizes = np.diff(np.asarray(flags.offsets))
    doc = np.repeat(np.arange(len(sizes)), sizes)
    raw = np.asarray(flags.flatten()).astype(np.int64)
    edge = np.zeros(len(cut.start) + 1, np.int64)
    for bit in range(WINDOW):
        on = (raw != ALL) & ((raw >> bit) & 1 == 1)
        start = cut.bounds[doc[on]] + (raw[on] >> WINDOW) + bit
        np.add.at(edge, start, 1)
        np.subtract.at(edge, start + WINDOW, 1)
    copies = np.zeros(len(sizes), bool)
    copies[doc[raw == ALL]] = True
    return (np.cumsum(edge)[:-1] > 0) | (copies & (cut.counts >= WINDOW))[cut.doc()]


def _kept(cut: Words, removed: np.ndarray, spaced: bool) -> tuple[bytes, list[int]]:
    """Bytes of the words that stay, and the edges of each document's.

    spaced: with the white space before the next word, as in the text; otherwise with one space each.
    """
    stay = np.flatnonzero(~removed)
    doc = cut.doc()[stay]
    start = cut.start[stay]
    if spaced:
        following = np.append(cut.start[1:], len(cut.data))
        end = np.minimum(following, cut.offsets[cut.doc() + 1])[stay] if len(stay) else start
    else:
        end = cut.end[stay] + 1
    sizes = end - start
    upto = np.concatenate(([0], np.cumsum(sizes)))
    at = np.repeat(start - upto[:-1], sizes) + np.arange(upto[-1])
    data = np.append(cut.data, np.uint8(0x20))[at]
    if not spaced:
        data[upto[1:] - 1] = 0x20
    return data.tobytes(), upto[np.searchsorted(doc, np.arange(len(cut.bounds)))].tolist()


def cut_texts(cut: Words, removed: np.ndarray, texts: pa.Array) -> pa.Array:
    """The texts without their removed words; those that lose none stay as they are."""
    data, edges = _kept(cut, removed, spaced=True)
    some = np.diff(np.concatenate(([0], np.cumsum(removed)))[cut.bounds]) > 0
    return pa.array([data[x:y].decode() if f else t for x, y, f, t in zip(edges, edges[1:], some.tolist(), texts.to_pylist())], pa.string())


def _with_flags(docs: DataFrame) -> DataFrame:
    """(doc, text, flags): whole rows, their texts and their flags."""
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"), "doc_id", "text")
    flagged = _keyed(rows).join(repeated_windows(docs), ["_id", "_row"], "left")
    return flagged.select("doc", "text", F.coalesce("flags", F.array().cast("array<long>")).alias("flags"))


def repeat_digests(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of all documents; kept words are joined by one space."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column(1)):
                cut = words(batch.column(1)[a:b])
                removed = removed_words(cut, batch.column(2)[a:b])
                data, edges = _kept(cut, removed, spaced=False)
                lost = np.diff(np.concatenate(([0], np.cumsum(removed)))[cut.bounds])
                digests = [hashlib.sha256(data[x : max(x, y - 1)]).hexdigest() for x, y in zip(edges, edges[1:])]
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], pa.array(cut.counts), pa.array(lost), pa.array(digests, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return _with_flags(docs).select("doc.doc_id", "text", "flags").mapInArrow(run, f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string")


def remove_repeats(docs: DataFrame) -> DataFrame:
    """docs with the repeated words cut out of their texts; texts that lose none stay as they are."""
    schema = StructType().add("doc", docs.schema).add("text", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column(1)):
                texts, flags = batch.column(1)[a:b], batch.column(2)[a:b]
                cut = words(texts)
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], cut_texts(cut, removed_words(cut, flags), texts)], ["doc", "text"])

    cut = _with_flags(docs).mapInArrow(run, schema)
    return cut.select(*(F.col("text") if c == "text" else F.col(f"doc.`{c}`") for c in docs.columns))
