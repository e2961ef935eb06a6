"""Near-duplicate classes by an n-gram Jaccard join with T-occurrence search.

Documents become sets of word shingles.  Equal sets are one node from the start,
so exact copies cost nothing below.  Sets of n and m shingles link when they share
T = ceil(t (n + m) / (1 + t)) or more.  Of the inverted lists of a set's shingles the
longest can be left out of the search, as many as T - 1 for the smallest partner:

1. All shingles have one order, by how many documents hold them (counts of CELLS hash
   cells, so rare ones come first) and then by hash.  Each node sends only the first of
   its shingles, to its short lists; a linked pair meets at the first shingle it shares.
   Positions in the order tell which sizes a partner may still have.  With some more
   shingles sent, linked sets share several lists; nodes that share fewer with all
   others need no search.  Any counts give the same links.
2. Hubs: in each short list the node where the shingle comes first, which has the fewest
   rare ones, is the hub, then the next one, HUBS times.  Other nodes that share enough
   lists with it are candidates, and all their shingles are probed by binary search in the
   hub's.  Copies of one text mostly link to it here, at a cost linear in their number.
3. Lists that hold nodes of several components without their hubs are searched whole, in
   groups of bounded size.  Each node outside a group's largest component is a query: its
   shortest lists are heap-merged, the longest ones left out and probed for the candidates
   that can still reach T (DivideSkip).  Nodes joined already are skipped, and only links
   leave the task.  A list of more than GROUP nodes is dealt into blocks, and each two
   blocks meet in one task.

Links go through large-star small-star.

Defined results: documents without words have an empty set, link with nothing and
are their own component; with fewer words than a shingle the whole sequence is
one shingle.  component_id ignores null doc_ids where there are others.
Repeated rows are equal sets.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from functools import reduce
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from almanac.llm.graph import components
from almanac.llm.shared import add_up, as_slices, release, written
from almanac.llm.text import Words, mix, rolling, slices, words

#: Most nodes in a group that one task searches, and their shingles; about, as groups are dealt by hash.
GROUP = 4096
GROUP_SHINGLES = 4 << 20
#: Hubs of a list, one after the other.
HUBS = 4
#: Hash cells that shingles are counted in, and slices of their vector.
CELLS = 1 << 20
SLICES = 256
#: Weight of a binary search, in arrays here, against merging an entry in the choice of L.
_MU = 0.0008


def shingles(cut: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each document, sorted: their documents and hashes."""
    hashes, counts = cut.hashes(), cut.counts
    at = np.arange(len(hashes))
    at = at[at + k <= np.repeat(cut.bounds[1:], counts)]
    doc = np.searchsorted(cut.bounds, at, "right") - 1
    values = rolling(hashes, k)[at]
    few = np.flatnonzero((counts > 0) & (counts < k))
    whole = np.full(len(few), 0x51ED270B, np.uint64)
    for j in range(k - 1):
        more = counts[few] > j
        whole[more] = mix(whole[more] * np.uint64(3) + hashes[cut.bounds[few[more]] + j])
    doc, values = np.concatenate((doc, few)), np.concatenate((values, whole))
    order = np.lexsort((values, doc))
    doc, values = doc[order], values[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (values[1:] != values[:-1])
    return doc[new], values[new]


def set_keys(doc: np.ndarray, values: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray]:
    """Size and 64-bit key of each document's set."""
    sizes = np.bincount(doc, minlength=n_docs)
    sums = np.concatenate(([np.uint64(0)], np.cumsum(mix(values), dtype=np.uint64)))
    edges = np.concatenate(([0], np.cumsum(sizes)))
    return sizes, mix(sums[edges[1:]] - sums[edges[:-1]] + sizes.astype(np.uint64))



def ranks(counts: np.ndarray) -> np.ndarray:
    """Counts of cells in eighths of a power of two, as one byte each."""
    return np.minimum(8 * np.log2(counts + 1.0), 255).astype(np.uint8)


def first_shared(n, percent: int):
    """The last position at which a set of n shingles may have the first one it shares with a linked, different set."""
    return n - -(-n * percent // 100)


def least_shared(n, percent: int):
    """How many of the shingles that are sent two linked sets of n shingles or more share; each sends as many more, less one."""
    return 1 + first_shared(n, percent) // 3


def prefixes(doc: np.ndarray, values: np.ndarray, n_docs: int, rank: np.ndarray, percent: int) -> tuple[np.ndarray, ...]:
    """The first shingles of each set: documents, shingles, positions in the order."""
    sizes = np.bincount(doc, minlength=n_docs)
    # By document, rank and hash; a stable sort leaves equal leading bits in the order of whole hashes.
    key = (doc.astype(np.uint64) << np.uint64(44)) | (rank[values & np.uint64(len(rank) - 1)].astype(np.uint64) << np.uint64(36)) | (values >> np.uint64(28))
    order = np.argsort(key, kind="stable")
    at = np.arange(len(doc)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    n = sizes[doc]
    # Sets too small for a different one within the threshold send nothing.
    sent = (at < first_shared(n, percent) + least_shared(n, percent)) & (n * (100 - percent) >= percent)
    return doc[sent], values[order][sent], at[sent]


class Index:
    """An inverted index of sets, in order of size, for T-occurrence searches."""

    def __init__(self, sets: list[np.ndarray], percent: int):
        self.percent, self.m = percent, len(sets)
        self.sizes = np.array([len(s) for s in sets], np.int64)
        values = np.concatenate(sets)
        owner = np.repeat(np.arange(self.m), self.sizes)
        self.values, rank = np.unique(values, return_inverse=True)
        self.keys = np.sort(rank * self.m + owner)  # one list a shingle, each in order of size

    def search(self, query: np.ndarray, upto: int | None = None, skip: np.ndarray | None = None) -> np.ndarray:
        """Sets, of those before `upto`, whose similarity with the query reaches the threshold; not those in skip."""
        p, n, m = self.percent, len(query), self.m
        low = int(np.searchsorted(self.sizes, -(-n * p // 100)))
        upto = min(m if upto is None else upto, int(np.searchsorted(self.sizes, n * 100 // p, "right")))
        if low >= upto:
            return np.zeros(0, np.int64)
        least = -(-p * (n + int(self.sizes[low])) // (100 + p))  # T, for the smallest set in question
        rank = np.searchsorted(self.values, query)
        rank = rank[self.values[np.minimum(rank, len(self.values) - 1)] == query]
        start, end = np.searchsorted(self.keys, rank * m + low), np.searchsorted(self.keys, rank * m + upto)
        some = end > start
        rank, start, end = rank[some], start[some], end[some]
        if len(rank) < least:
            return np.zeros(0, np.int64)
        order = np.argsort(end - start, kind="stable")
        longest = int((end - start)[order[-1]])
        aside = min(least - 1, int(least / (_MU * math.log2(longest + 1) + 1)))
        short, long = order[: len(order) - aside], order[len(order) - aside :]
        lists = [(self.keys[a:b] % m).tolist() for a, b in zip(start[short].tolist(), end[short].tolist())]
        merged = [(x, sum(1 for _ in same)) for x, same in groupby(heapq.merge(*lists))]
        found = np.array([x for x, c in merged if c >= least - aside], np.int64)
        counts = np.array([c for _, c in merged if c >= least - aside], np.int64)
        if skip is not None:
            keep = ~skip[found]
            found, counts = found[keep], counts[keep]
        needed = -(-p * (n + self.sizes[found]) // (100 + p))
        for i in range(0, len(long), 64):
            if not len(found):
                break
            probe = rank[long[i : i + 64], None] * m + found
            at = np.minimum(np.searchsorted(self.keys, probe), len(self.keys) - 1)
            counts = counts + (self.keys[at] == probe).sum(axis=0)
            alive = counts + max(0, len(long) - i - 64) >= needed
            found, counts, needed = found[alive], counts[alive], needed[alive]
        return found[counts >= needed]



def overlaps(query: np.ndarray, sets: list[np.ndarray]) -> np.ndarray:
    """How many shingles of each set the query holds, by binary search in it."""
    values = np.concatenate(sets)
    hit = query[np.minimum(np.searchsorted(query, values), len(query) - 1)] == values
    return np.add.reduceat(hit, np.cumsum([0, *map(len, sets[:-1])]), dtype=np.int64)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def _nodes(k: int):
    """A row for each document, and the counts of all shingles of a partition in slices."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(CELLS, np.int64)
        names = ["doc_id", "_row", "n", "node", "slice", "at", "by"]
        kind = pa.int64()
        for batch in batches:
            kind = batch.schema.field(0).type
            for a, b in slices(batch.column(2)):
                doc, values = shingles(words(batch.column(2)[a:b], lower=True), k)
                sizes, keys = set_keys(doc, values, b - a)
                found += np.bincount((values & np.uint64(CELLS - 1)).astype(np.int64), minlength=CELLS)
                node = pa.array(keys.view(np.int64), mask=sizes == 0)
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], batch.column(1)[a:b], pa.array(sizes, pa.int64()), node, pa.nulls(b - a, pa.int32()), pa.nulls(b - a, pa.binary()), pa.nulls(b - a, pa.binary())], names)
        for part in as_slices(found, SLICES):
            n = part.num_rows
            yield pa.RecordBatch.from_arrays([pa.nulls(n, kind), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), *part.columns], names)

    return run


def _prefixes(k: int, percent: int, rank):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for a, b in slices(batch.column(0)):
                doc, values = shingles(words(batch.column(0)[a:b], lower=True), k)
                sizes, keys = set_keys(doc, values, b - a)
                once = np.zeros(b - a, bool)  # of equal sets here, one
                for i, key in enumerate(keys.tolist()):
                    if sizes[i] and key not in seen:
                        once[i] = True
                        seen.add(key)
                keep = once[doc]
                doc, values, at = prefixes(doc[keep], values[keep], b - a, rank.value, percent)
                yield pa.RecordBatch.from_arrays([_signed(values), _signed(keys[doc]), pa.array(sizes[doc], pa.int64()), pa.array(at, pa.int64())], ["sig", "node", "n", "p"])

    return run


def _sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            new = []
            for i, node in enumerate(batch.column(0).to_pylist()):
                if node not in seen:
                    seen.add(node)
                    new.append(i)
            batch = batch.take(pa.array(new, pa.int64()))
            for a, b in slices(batch.column(1)):
                doc, values = shingles(words(batch.column(1)[a:b], lower=True), k)
                raw, edges = values.tobytes(), (8 * np.concatenate(([0], np.cumsum(np.bincount(doc, minlength=b - a))))).tolist()
                sets = [raw[x:y] for x, y in zip(edges, edges[1:])]
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], pa.array([len(s) // 8 for s in sets], pa.int64()), pa.array(sets, pa.binary())], ["node", "n", "shingles"])

    return run



def _groups(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[list[tuple]]:
    """Rows with equal values in the first columns; rows come sorted by them."""
    key, group = None, []
    for batch in batches:
        for row in zip(*(batch.column(i).to_pylist() for i in range(batch.num_columns))):
            if row[:n_keys] != key:
                if group:
                    yield group
                key, group = row[:n_keys], []
            group.append(row[n_keys:])
    if group:
        yield group


def _links(found: Iterator[tuple[int, int]]) -> Iterator[pa.RecordBatch]:
    """Rows (a, b) of at most some thousand links each."""
    out: list[tuple[int, int]] = []
    for link in found:
        out.append(link)
        if len(out) == 10_000:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out)], ["a", "b"])
            out = []
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out)], ["a", "b"])


def _hub_links(percent: int):
    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int]]:
        for group in _groups(batches, 2):  # hub, salt: (node, shingles, is hub)
            hub = next(((node, np.frombuffer(s, np.uint64)) for node, s, own in group if own), None)
            others = [(node, np.frombuffer(s, np.uint64)) for node, s, own in group if not own]
            if hub and others:
                shared = overlaps(hub[1], [s for _, s in others])
                sizes = np.array([len(s) for _, s in others])
                for i in np.flatnonzero((100 + percent) * shared >= percent * (sizes + len(hub[1]))).tolist():
                    yield others[i][0], hub[0]

    return lambda batches: _links(found(batches))


def _block_links(percent: int):
    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int]]:
        for group in _groups(batches, 3):  # list, two blocks: (node, component, block, shingles)
            group = sorted(group, key=lambda r: (len(r[3]), r[0]))
            sets, block = [np.frombuffer(r[3], np.uint64) for r in group], np.array([r[2] for r in group])
            index, roots = Index(sets, percent), np.unique([r[1] for r in group], return_inverse=True)[1]
            # Each pair of different components has a node outside the largest one.
            queries, meets = np.flatnonzero(roots != np.bincount(roots).argmax()), len(np.unique(block)) > 1
            for q in queries.tolist():
                skip = (roots == roots[q]) | (block == block[q]) if meets else roots == roots[q]
                for i in index.search(sets[q], skip=skip).tolist():
                    if roots[i] != roots[q]:
                        yield group[q][0], group[i][0]
                        roots[roots == roots[i]] = roots[q]

    return lambda batches: _links(found(batches))


def _from_hubs(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) among the pairs (hub, node); the nodes of a hub are dealt into groups of bounded size."""
    sizes = sets.select("node", "n")
    salts = pairs.join(sizes, "node").groupBy("hub").agg(F.ceil(F.greatest(F.count("*") / GROUP, F.sum("n") / GROUP_SHINGLES)).cast("int").alias("salts"))
    salts = written(salts, "hubs")
    spokes = pairs.join(salts, "hub").select("hub", F.pmod("node", "salts").cast("int").alias("salt"), "node", F.lit(False).alias("own"))
    centres = salts.select("hub", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.col("hub").alias("node"), F.lit(True).alias("own"))
    grouped = spokes.unionByName(centres).join(sets, "node").select("hub", "salt", "node", "shingles", "own").repartition("hub", "salt").sortWithinPartitions("hub", "salt")
    return written(grouped.mapInArrow(_hub_links(percent), "a long, b long"), "links")


def _from_lists(lists: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between nodes of different components in one list (list, node, component)."""
    blocks = lists.join(sets.select("node", "n"), "node").groupBy("list").agg(F.ceil(F.greatest(F.count("*") / GROUP, F.sum("n") / GROUP_SHINGLES)).cast("int").alias("blocks"))
    dealt = lists.join(blocks, "list").withColumn("block", F.pmod(F.xxhash64("node"), "blocks").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("list", F.least("block", "other").alias("one"), F.greatest("block", "other").alias("two"), "node", "component", "block").join(sets, "node")
    dealt = dealt.select("list", "one", "two", "node", "component", "block", "shingles")
    return written(dealt.repartition("list", "one", "two").sortWithinPartitions("list", "one", "two").mapInArrow(_block_links(percent), "a long, b long"), "links")


def _short_lists(sent: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Rows (sig, node, n, p, widest) of lists where links may begin, and (node, n, lists, more) of their nodes.

    Nodes that share fewer lists with others than a linked set would are left out.
    """
    n, p = F.col("n"), F.col("p")
    first = n - F.ceil(n * percent / 100)
    more = lambda size: 1 + F.floor((size - F.ceil(size * percent / 100)) / 3)
    ends = sent.groupBy("sig").agg(F.min("node").alias("low"), F.max("node").alias("high"))
    shared = written(sent.join(ends.where("low < high"), "sig").select("sig", "node", "n", "p").distinct(), "shared")
    # The smallest partner asks for least.
    enough = lambda rows: rows.groupBy("node").agg(F.first("n").alias("n"), F.collect_list("sig").alias("lists")).where(F.size("lists") >= more(F.ceil(F.col("n") * percent / 100)))
    alive = shared.join(enough(shared).select("node"), "node", "left_semi")
    ends = alive.groupBy("sig").agg(F.min("node").alias("low"), F.max("node").alias("high"))
    alive = written(alive.join(ends.where("low < high").select("sig"), "sig", "left_semi"), "alive")
    known = written(enough(alive).withColumn("more", more(F.col("n"))), "known")
    # A partner of a set whose first shared shingle stands at p has at most this many.
    widest = F.least(F.floor((n - p) * (100 + percent) / percent) - n, F.floor(n * 100 / percent))
    rows = alive.join(known.select("node"), "node", "left_semi").where(p <= first).withColumn("widest", widest)
    return rows.select("sig", "node", "n", "p", "widest"), known


def _useful(rows: DataFrame, kind: str = "node") -> DataFrame:
    """Rows of lists with several values of `kind`, and of sizes that can meet in their list; hub: the row where the shingle comes first."""
    ends = rows.groupBy("sig").agg(F.min(kind).alias("low"), F.max(kind).alias("high"), F.min("n").alias("least"), F.max("widest").alias("most"), F.min(F.struct("p", "node", "n")).alias("hub"))
    return rows.join(ends.where("low < high"), "sig").where("widest >= least AND n <= most").drop("low", "high", "least", "most")


def _hub_pairs(members: DataFrame, known: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Candidates (hub, node, shared): those of HUBS hubs of each list that share enough lists; and the rows that are left without these hubs."""
    found = []
    n, p, m, q = F.col("n"), F.col("p"), F.col("hub.n"), F.col("hub.p")
    needed = F.ceil(percent * (n + m) / (100 + percent))
    for i in range(HUBS):
        rows = written(_useful(members).where("node <> hub.node"), f"hub{i}")
        found.append(rows.where((n - p >= needed) & (m - q >= needed)).select(F.col("hub.node").alias("hub"), "node"))
        members = rows.drop("hub")
    pairs = reduce(DataFrame.union, found).distinct()
    pairs = pairs.join(known.select("node", "lists", "more"), "node").join(known.select(F.col("node").alias("hub"), F.col("lists").alias("theirs"), F.col("more").alias("most")), "hub")
    return pairs.select("hub", "node", F.size(F.array_intersect("lists", "theirs")).alias("shared"), F.least("more", "most").alias("least")).where("shared >= least").drop("least"), members


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, _row, n_shingles, component_id) of all documents (doc_id, text).

    Documents link when their sets of k-word shingles have a Jaccard similarity
    of percent / 100 or more; component_id is the smallest doc_id reachable.
    _row is a hash of the text, which tells apart rows with one doc_id.
    """
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    texts = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("_row"), "text")
    both = written(texts.mapInArrow(_nodes(k), f"doc_id {kind}, _row long, n long, node long, slice int, at binary, by binary"), "nodes")
    nodes = both.where("slice IS NULL").select("doc_id", "_row", "n", "node")
    rank = spark.sparkContext.broadcast(ranks(add_up(both.where("slice IS NOT NULL").select("slice", "at", "by"), CELLS, SLICES)))

    sent = written(texts.select("text").mapInArrow(_prefixes(k, percent, rank), "sig long, node long, n long, p long"), "prefixes")
    members, known = _short_lists(sent, percent)
    release(spark)
    owner = nodes.join(known.select("node"), "node", "left_semi").groupBy("node").agg(F.min(F.struct("doc_id", "_row")).alias("o")).select("node", F.col("o.doc_id").alias("_id"), F.col("o._row").alias("_row"))
    wanted = texts.join(owner, (texts["_row"] == owner["_row"]) & texts["doc_id"].eqNullSafe(owner["_id"])).select("node", "text")
    sets = written(wanted.mapInArrow(_sets(k), "node long, n long, shingles binary"), "sets")
    if sets.count() > sets.select("node").distinct().count():  # rows that are alike in doc_id and text
        sets = written(sets.dropDuplicates(["node"]), "sets")

    # Hubs: first the one that each node shares most with, then those of other components.
    pairs, members = _hub_pairs(members, known, percent)
    pairs = written(pairs, "pairs")
    release(spark)
    best = pairs.groupBy("node").agg(F.max_by("hub", F.struct("shared", "hub")).alias("hub"))
    links = _from_hubs(best.select("hub", "node"), sets, percent)
    first = components(links)
    apart = pairs.join(best, ["hub", "node"], "left_anti").join(first, "node", "left").withColumn("own", F.coalesce("root", "node")).drop("root")
    apart = apart.join(first.select(F.col("node").alias("hub"), "root"), "hub", "left").where(F.coalesce("root", "hub") != F.col("own"))
    apart = written(apart.select("hub", "node"), "apart")
    if not apart.isEmpty():
        links = links.union(_from_hubs(apart, sets, percent))
        first = components(links)

    # The hubs of a list are done with; lists of the same nodes are one.
    named = members.join(first, "node", "left").select("sig", "node", "n", "p", "widest", F.coalesce("root", "node").alias("component"))
    left = _useful(written(named, "named"), "component")
    ends = left.groupBy("sig").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("of"), F.count("*").alias("m"))
    one = ends.where("low < high").groupBy("of", "m").agg(F.min("sig").alias("sig"))
    release(spark)
    lists = written(left.join(one, "sig").select(F.col("sig").alias("list"), "node", "component"), "lists")
    if not lists.isEmpty():
        first = components(links.union(_from_lists(lists, sets, percent)))

    rooted = nodes.join(first, "node", "left").select("doc_id", "_row", "n", F.coalesce("root", "node").alias("_root"))
    smallest = rooted.where("_root IS NOT NULL").groupBy("_root").agg(F.min("doc_id").alias("_smallest"))
    return rooted.join(smallest, "_root", "left").select("doc_id", "_row", F.col("n").alias("n_shingles"), F.when(F.col("_root").isNull(), F.col("doc_id")).otherwise(F.col("_smallest")).alias("component_id"))


def keep_one(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """docs with one document of each component: that with the smallest doc_id, of its rows the one with the smallest hash."""
    found = near_duplicates(docs, k, percent)
    stay = found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("doc_id").agg(F.min("_row").alias("_row")).select(F.col("doc_id").alias("_id"), F.col("_row").alias("_keep"))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"), F.col("doc_id").alias("_doc"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("_row"))
    return rows.join(stay, (F.col("_row") == F.col("_keep")) & F.col("_doc").eqNullSafe(F.col("_id"))).select("doc.*")
