"""Mixing sources to target weights by min-cost flow over membership patterns.

Documents may belong to several sources.  Documents with the same set of sources
form one membership pattern; only patterns, never documents, enter the flow:

    supply -> pattern (capacity: its words for each pass, cost: the pass number)
           -> each of its sources (no limit)
           -> sink (capacity: the source's target)

The cost of a pass grows with its number (0 for the first, 1 for the second), so
a minimum-cost maximum flow repeats words only where fresh ones run out.  The
flow of a pattern is then turned into documents: whole passes take all of them,
the rest of a pass takes those whose seeded hash is at most the pattern's
threshold, large documents before the others, and small ones
with hashes beyond it fill what is left.  A
threshold comes from a histogram of hashes and from an exact running sum inside
one of its cells, so no task sees a whole source.  Hashes are of doc_id and text, so rows
with one doc_id, or none, are decided one by one.  Where the words run out between rows
alike in both, these are numbered, piece by piece of their files, and the first ones taken.

Defined results: a null or empty text has size 0 and takes 0; a null source is a
source of its own, last in order; an empty list of sources takes 0; of rows alike in
doc_id and text as many are taken as fit, the first ones by place if they differ elsewhere;
an empty table gives an empty result.  Columns of the input with the names of the result's are
replaced.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from almanac.llm.shared import n_words, written

#: Most membership patterns that the driver solves (some minutes; time grows with the square);
#: a bound on what it collects and broadcasts.
MAX_PATTERNS = 4000
#: A document with over one part in LARGE of a partial pass is decided before the others.
LARGE = 16

_PLAN = T.StructType([T.StructField(n, t) for n, t in (("_pattern", T.StringType()), ("_source_size", T.LongType()), ("_target", T.DoubleType()), ("_whole", T.LongType()), ("_rest", T.LongType()))])


@dataclass
class Mix:
    """sizes: (doc_id, _pattern, size, _key) of all documents; plan: one row for each pattern.

    ties: (_pattern, _key, _fit) of the rows alike between which a pattern's words run out, at
    most three a pattern, and how many of them still fit.
    """

    sizes: DataFrame
    plan: DataFrame
    ties: DataFrame | None


def targets(sizes: dict[str | None, int], weights: Sequence[float] = (3, 1, 2), share: float = 1.5, repeats: float = 2) -> dict[str | None, float]:
    """Words wanted of each source: shares by weight, none above `repeats` times its size.

    Sources take the weights in turn, by code point, null last.  What is above a
    limit is shared again by weight among the sources below theirs.
    """
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: float(weights[i % len(weights)]) for i, s in enumerate(order)}
    fixed: dict[str | None, float] = {}
    total = share * sum(sizes.values())
    while True:
        free = [s for s in order if s not in fixed]
        left = total - sum(fixed.values())
        per = left / sum(weight[s] for s in free) if free else 0.0
        over = [s for s in free if per * weight[s] > repeats * sizes[s]]
        if not over:
            return fixed | {s: per * weight[s] for s in free}
        fixed |= {s: float(repeats * sizes[s]) for s in over}


def min_cost_flow(arcs: list[tuple[int, int, int, int]], n: int, source: int, sink: int) -> list[int]:
    """Flow on each arc (from, to, capacity, cost): maximum, at least cost.

    Successive shortest paths with potentials; costs are not negative.
    """
    to, cap, cost, out = [], [], [], [[] for _ in range(n)]
    for a, b, c, w in arcs:
        for x, y, room, price in ((a, b, c, w), (b, a, 0, -w)):
            out[x].append(len(to))
            to.append(y), cap.append(room), cost.append(price)
    potential = [0] * n
    while True:
        far, via, heap = [None] * n, [-1] * n, [(0, source)]
        far[source] = 0
        while heap:
            d, x = heapq.heappop(heap)
            if d > far[x]:
                continue
            for e in out[x]:
                if cap[e] and (far[y := to[e]] is None or d + cost[e] + potential[x] - potential[y] < far[y]):
                    far[y] = d + cost[e] + potential[x] - potential[y]
                    via[y] = e
                    heapq.heappush(heap, (far[y], y))
        if far[sink] is None:
            return [cap[2 * i + 1] for i in range(len(arcs))]
        potential = [p + (f if f is not None else far[sink]) for p, f in zip(potential, far)]
        path, x = [], sink
        while x != source:
            path.append(via[x])
            x = to[via[x] ^ 1]
        room = min(cap[e] for e in path)
        for e in path:
            cap[e] -= room
            cap[e ^ 1] += room


def route(patterns: dict[str, int], weights: Sequence[float] = (3, 1, 2), share: float = 1.5, repeats: int = 2) -> list[tuple]:
    """Rows of the plan for {pattern as JSON list: words}: words taken in whole passes and beyond.

    A pattern's source_size and target are the sums over its sources.
    """
    members = {p: json.loads(p) for p in patterns}
    total = sum(patterns.values())
    sizes: dict[str | None, int] = {}
    for p, words in patterns.items():
        for s in members[p]:
            sizes[s] = sizes.get(s, 0) + words
    goal = targets(sizes, weights, share * total / sum(sizes.values()) if sum(sizes.values()) else share, repeats)
    at = {s: 2 + len(patterns) + i for i, s in enumerate(sizes)}
    arcs, taken = [], [0] * len(patterns)
    for i, (p, words) in enumerate(patterns.items()):
        arcs += [(0, 2 + i, words, again) for again in range(repeats)]
        arcs += [(2 + i, at[s], repeats * words, 0) for s in members[p]]
    arcs += [(at[s], 1, int(goal[s]), 0) for s in sizes]
    for (a, b, _, _), flow in zip(arcs, min_cost_flow(arcs, 2 + len(patterns) + len(sizes), 0, 1)):
        if a == 0:
            taken[b - 2] += flow
    return [(p, sum(sizes[s] for s in members[p]), float(sum(goal[s] for s in members[p])), t // words if words else 0, t % words if words else 0) for (p, words), t in zip(patterns.items(), taken)]


def _pattern(members: Column) -> Column:
    some = F.array_sort(F.array_distinct(F.filter(members, lambda s: s.isNotNull())))
    return F.to_json(F.when(F.exists(members, lambda s: s.isNull()), F.concat(some, F.array(F.lit(None).cast("string")))).otherwise(some))


def _key(seed: int) -> Column:
    return F.xxhash64(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce("text", F.lit("")))


def plan_mix(docs: DataFrame, members: Column | None = None, *, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, repeats: int = 2, seed: int = 1) -> Mix:
    """Sizes of the documents and the words that the mix takes of each membership pattern.

    docs has doc_id and text; members is a column with the array of a document's
    sources, by default the one in `source`.
    """
    spark = docs.sparkSession
    members = F.array("source") if members is None else members
    sizes = written(docs.select("doc_id", _pattern(members).alias("_pattern"), n_words(F.col("text")).alias("size"), _key(seed).alias("_key")).where("_pattern IS NOT NULL"), "sizes")
    totals = sizes.groupBy("_pattern").agg(F.sum("size").alias("size")).limit(MAX_PATTERNS + 1).collect()
    if len(totals) > MAX_PATTERNS:
        raise ValueError(f"over {MAX_PATTERNS} sets of sources")
    plan = spark.createDataFrame(route(dict(sorted((r[0], r[1]) for r in totals)), weights, share, repeats), _PLAN)

    # A partial pass takes large documents in proportion, then the others up to what is left, then small ones beyond.
    limits = sizes.join(F.broadcast(plan), "_pattern").groupBy("_pattern").agg(F.first("_rest").alias("_rest"), F.sum("size").alias("_words"), F.sum(F.when(F.col("size") * LARGE > F.col("_rest"), F.col("size")).otherwise(0)).alias("_in_large"))
    limits = limits.select("_pattern", "_rest", F.floor(F.col("_rest") * F.col("_in_large") / F.greatest("_words", F.lit(1))).cast("long").alias("_for_large")).collect()
    limits = spark.createDataFrame(limits, "_pattern string, _rest long, _for_large long")
    ranked = sizes.join(F.broadcast(limits), "_pattern")
    large = F.col("size") * LARGE > F.col("_rest")
    first = _cut(ranked.where(large), limits.selectExpr("_pattern", "_for_large _left"))
    second = limits.join(F.broadcast(first), "_pattern", "left").selectExpr("_pattern", "_rest - _for_large + coalesce(_left, _for_large) _left")
    second = _cut(ranked.where(~large), second)
    small = ranked.where(~large).join(F.broadcast(second), "_pattern").where("_key > _last AND size * 4 <= _left")
    third = _cut(small, second.select("_pattern", "_left"))
    for cut, last in ((first.drop("_left"), "_last_large"), (second, "_last"), (third.drop("_left"), "_last_small")):
        plan = plan.join(F.broadcast(cut.withColumnRenamed("_last", last).drop("_tie", "_fit")), "_pattern", "left")
    ties = first.unionByName(second).unionByName(third).where("_fit > 0").selectExpr("_pattern", "_tie _key", "_fit")
    return Mix(sizes, plan, None if ties.isEmpty() else ties)


def _cut(sizes: DataFrame, wanted: DataFrame) -> DataFrame:
    """(_pattern, _last, _left, _tie, _fit): what fits into the wanted words, but for _left of them.

    That is all documents with hashes up to _last, and _fit of those with the hash _tie.
    """
    spark = sizes.sparkSession
    cell = F.shiftright("_key", 52).alias("_cell")
    cells = sizes.groupBy("_pattern", cell).agg(F.sum("size").alias("_words"))
    upto = F.sum("_words").over(Window.partitionBy("_pattern").orderBy("_cell"))
    ends = cells.withColumn("_upto", upto).join(F.broadcast(wanted), "_pattern")
    # The cell in which the words run out, or the last one; then the documents of that cell alone.
    row = F.min(F.when(F.col("_upto") > F.col("_left"), F.struct("_cell", (F.col("_left") - F.col("_upto") + F.col("_words")).alias("_left"))))
    cut = ends.groupBy("_pattern").agg(F.coalesce(row, F.struct(F.lit(1 << 11).alias("_cell"), (F.first("_left") - F.max("_upto")).alias("_left"))).alias("c")).select("_pattern", "c.*")
    # Rows alike are one row here, so that a task sees the distinct documents of a cell.
    inside = sizes.select("_pattern", "size", "_key", cell).join(F.broadcast(cut), ["_pattern", "_cell"])
    inside = inside.groupBy("_pattern", "_key").agg(F.sum("size").alias("_words"), F.max("size").alias("size"), F.first("_left").alias("_left"))
    upto = F.sum("_words").over(Window.partitionBy("_pattern").orderBy("_key"))
    inside = inside.withColumn("_upto", upto)
    fits = F.col("_upto") <= F.col("_left")
    tie = F.struct("_key", F.floor((F.col("_left") - F.col("_upto") + F.col("_words")) / F.col("size")).cast("long").alias("n"), "size")
    fits = inside.groupBy("_pattern").agg(F.max(F.when(fits, F.col("_key"))).alias("_last"), F.coalesce(F.max(F.when(fits, F.col("_upto"))), F.lit(0)).alias("_sum"), F.min(F.when(~fits, tie)).alias("t"))
    start = F.when(F.col("_cell") == 1 << 11, F.lit((1 << 63) - 1)).when(F.col("_cell") == -(1 << 11), F.lit(-(1 << 63))).otherwise(F.shiftleft(F.col("_cell").cast("long"), 52) - 1)
    left = F.col("_left") - F.coalesce("_sum", F.lit(0)) - F.coalesce(F.col("t.n") * F.col("t.size"), F.lit(0))
    found = cut.join(fits, "_pattern", "left").select("_pattern", F.coalesce("_last", start).alias("_last"), left.alias("_left"), F.col("t._key").alias("_tie"), F.coalesce("t.n", F.lit(0)).alias("_fit"))
    return spark.createDataFrame(found.collect(), "_pattern string, _last long, _left long, _tie long, _fit long")


def _among(rows: DataFrame, ties: DataFrame | None) -> DataFrame:
    """rows, with whether each is one of those that still fit among rows alike (`_fits`).

    Rows at a tie are written, and numbered inside pieces of the files; a piece starts where the
    ones before it end, so that no task holds all rows alike.
    """
    if ties is None:
        return rows.withColumn("_fits", F.lit(False))
    at = ["_pattern", "_key"]
    ties = F.broadcast(ties)
    tied = written(rows.join(ties.drop("_fit"), at, "left_semi"), "ties").withColumn("_piece", F.spark_partition_id()).withColumn("_place", F.monotonically_increasing_id())
    inside = F.row_number().over(Window.partitionBy(*at, "_piece").orderBy("_place"))
    before = F.sum("_n").over(Window.partitionBy(*at).orderBy("_piece")) - F.col("_n")
    starts = tied.groupBy(*at, "_piece").agg(F.count("*").alias("_n")).withColumn("_start", before).drop("_n")
    tied = tied.withColumn("_at", inside).join(starts, [*at, "_piece"]).join(ties, at)
    tied = tied.select(*(F.col(f"`{c}`") for c in rows.columns), (F.col("_start") + F.col("_at") <= F.col("_fit")).alias("_fits"))
    return rows.join(ties.drop("_fit"), at, "left_anti").withColumn("_fits", F.lit(False)).unionByName(tied)


def _times() -> Column:
    """How often a document is taken; for rows with _key, _fits, size and the plan."""
    large = F.col("size") * LARGE > F.col("_rest")
    small = (F.col("_key") <= F.col("_last")) | ((F.col("_key") <= F.col("_last_small")) & (F.col("size") * 4 <= F.col("_left")))
    more = F.when(large, F.col("_key") <= F.col("_last_large")).otherwise(small) | F.col("_fits")
    return F.col("_whole") + F.coalesce(more, F.lit(False)).cast("long")


def taken_words(mix: Mix) -> DataFrame:
    """(doc_id, size, source_size, target, taken) of all documents."""
    rows = _among(mix.sizes, mix.ties).join(F.broadcast(mix.plan), "_pattern")
    return rows.select("doc_id", "size", F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), (_times() * F.col("size")).alias("taken"))


def mix_sources(docs: DataFrame, members: Column | None = None, *, seed: int = 1, **options) -> DataFrame:
    """The documents of the mix, one row for each time a document is taken, with docs' columns."""
    mix = plan_mix(docs, members, seed=seed, **options)
    members = F.array("source") if members is None else members
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row")
    rows = docs.select(row, _pattern(members).alias("_pattern"), n_words(F.col("text")).alias("size"), _key(seed).alias("_key"))
    rows = _among(rows.where("size > 0"), mix.ties).join(F.broadcast(mix.plan), "_pattern")
    return rows.select("_row", F.explode(F.array_repeat(F.lit(1), _times().cast("int")))).select("_row.*")
