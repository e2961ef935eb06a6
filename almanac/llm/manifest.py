"""Merkle manifest of a dataset: a tree for each source, a tree over their roots, and a proof for each row.

A row's leaf is a digest of its fields.  Rows get their places within a source by a
range partitioning, whose pieces are counted and summed up, so that no source is sorted
in one task.  Runs of 16 leaves and then of 16 nodes are grouped level by level; every
node is stored with its children's digests, its parent and its place below it.

A recursive query climbs from the leaves to the root.  The leaves of one run share all
that is above them, so a run climbs as one row: each of its leaves folds its own digest,
which may be of a tampered row, with its siblings at every level, and the siblings above
the run are appended once.  An upper level has a sixteenth of the nodes of the one below.

Defined results: rows with equal ids are ordered by their leaves, a null id comes first;
a null source is a source, the first one.  A leaf that is alone in its source is its
subroot; the subroot of the only source is the root.  The proof of a single row is the
digest of an empty text.  Of an empty table there is no row.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from almanac.llm.shared import written

FAN = 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Climbs from runs to the root.  Digests travel as 32 bytes each and are hashed as hex text.
CLIMB = """
WITH RECURSIVE climb (run, parent, folded, slots, above, subroot, root) AS (
  SELECT run, parent, folded, slots, above, subroot, root FROM {runs}
  UNION ALL
  SELECT c.run, n.parent,
    zip_with(c.folded, c.slots, (f, s) -> unhex(sha2(concat(left(n.hexes, 64 * s), lower(hex(f)), substring(n.hexes, 64 * s + 65)), 256))),
    transform(c.folded, f -> n.slot),
    CASE WHEN n.of_leaves THEN c.above ELSE concat(c.above, substring(n.children, 1, 32 * c.slots[0]), substring(n.children, 32 * c.slots[0] + 33)) END,
    CASE WHEN n.tops_source THEN n.digest ELSE c.subroot END,
    n.digest
  FROM climb c JOIN (SELECT *, lower(hex(children)) AS hexes FROM {nodes}) n ON c.parent = n.node
)
SELECT * FROM climb WHERE parent IS NULL
"""


@dataclass(frozen=True)
class Manifest:
    """runs: leaves of one run with ids and places; nodes: every inner node with children, parent and slot; n_sources."""

    runs: DataFrame
    nodes: DataFrame
    n_sources: int


def digest(text: Column) -> Column:
    """sha256 as 32 bytes."""
    return F.unhex(F.sha2(text, 256))


def row_text(values: list[Column]) -> Column:
    """What a row's leaf is the digest of: each value's length in bytes and text, `-` for a null."""
    texts = [v.cast("string") for v in values]
    return F.concat(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts))


def lower_text(docs: DataFrame, fields: tuple[str, ...] = FIELDS) -> tuple[Column, list[Column]]:
    """A tampering: which rows it touches, and their values afterwards (A-Z of the text in lower case)."""
    return F.crc32(F.col("doc_id").cast("string")) % 5 == 0, [F.translate(F.col(c), _UPPER, _LOWER) if c == "text" else F.col(c) for c in fields]


def _children(order: str, value: str = "digest") -> Column:
    """Digests of a group of at most FAN rows in their order, one after the other."""
    return F.aggregate(F.array_sort(F.collect_list(F.struct(order, value))), F.lit(b""), lambda all, x: F.concat(all, x[value]))


def numbered(rows: DataFrame, group: list[str], order: list[str], name: str) -> tuple[DataFrame, DataFrame]:
    """rows in ranges of (group, order) with `_at`, and the pieces of groups in them: (group, _part, _first, _before, n).

    A row's place in its group is `_at - _first + _before`, of n rows.
    """
    keys = [F.col(c).asc_nulls_first() for c in (*group, *order)]
    ranged = written(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id()), name)
    pieces = ranged.groupBy(*group, F.shiftright("_at", 33).alias("_part")).agg(F.min("_at").alias("_first"), F.count("*").alias("_rows"))
    whole = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))  # a row for each range and group, not for each row
    before = whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return ranged, pieces.select(*group, "_part", "_first", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"), F.sum("_rows").over(whole).alias("n"))


def _levels(first: DataFrame) -> list[DataFrame]:
    """Node tables (tree, level, place, width, children, digest), from the first level up to one node a tree."""
    levels = [written(first.withColumn("digest", digest(F.lower(F.hex("children")))), "nodes")]
    while not levels[-1].where("width > 1").isEmpty():
        up = levels[-1].where("width > 1").groupBy("tree", F.expr(f"place DIV {FAN}").alias("up"), (F.col("level") + 1).alias("level"), F.expr(f"(width + {FAN - 1}) DIV {FAN}").alias("width"))
        up = up.agg(_children("place").alias("children")).withColumnRenamed("up", "place")
        levels.append(written(up.withColumn("digest", digest(F.lower(F.hex("children")))), "nodes"))
    return levels


def _name(tree: Column, level: Column, place: Column) -> Column:
    return F.concat_ws("/", tree, level, place)


def build(docs: DataFrame, fields: tuple[str, ...] = FIELDS, source: str = "source", key: str = "doc_id", tampering: tuple[Column, list[Column]] | None = None) -> Manifest:
    """The manifest's node rows, written; with a tampering, runs also hold the digests of tampered rows."""
    changed = F.lit(None).cast("binary") if tampering is None else F.when(tampering[0], digest(row_text(tampering[1])))
    leaves = written(docs.select(F.col(source).cast("string").alias("source"), F.col(key).alias("id"), digest(row_text([F.col(c) for c in fields])).alias("leaf"), changed.alias("changed")), "leaves")
    ranged, pieces = numbered(leaves, ["source"], ["id", "leaf"], "leaves-in-order")
    ordered, parts = numbered(pieces.select("source", "n").distinct(), [], ["source"], "sources")
    parts = parts.withColumnsRenamed({"n": "n_sources"})
    sources = ordered.join(parts, F.shiftright(ordered["_at"], 33) == parts["_part"]).select(F.col("source").alias("_source"), (F.col("_at") - F.col("_first") + F.col("_before")).alias("tree"))
    n_sources = ordered.count()
    here = pieces.join(sources, pieces["source"].eqNullSafe(sources["_source"])).drop("source")
    placed = ranged.join(here, (F.shiftright(ranged["_at"], 33) == here["_part"]) & ranged["source"].eqNullSafe(here["_source"]))
    placed = placed.select("tree", "n", (F.col("_at") - F.col("_first") + F.col("_before")).alias("place"), "id", "leaf", "changed")
    members = F.array_sort(F.collect_list(F.struct("place", "leaf", "id", "changed")))
    runs = written(placed.groupBy("tree", "n", F.expr(f"place DIV {FAN}").alias("run")).agg(members.alias("members")), "runs")
    first = runs.where("n > 1").select("tree", F.lit(1).alias("level"), F.col("run").alias("place"), F.expr(f"(n + {FAN - 1}) DIV {FAN}").alias("width"), F.aggregate("members", F.lit(b""), lambda all, m: F.concat(all, m["leaf"])).alias("children"))
    levels = _levels(first)
    if n_sources > 1:
        tops = runs.where("n = 1").select("tree", F.col("members")[0]["leaf"].alias("digest"))
        for level in levels:
            tops = tops.union(level.where("width = 1").select("tree", "digest"))
        over = tops.groupBy(F.expr(f"tree DIV {FAN}").alias("place")).agg(_children("tree").alias("children"))
        levels += _levels(over.select(F.lit(-1).cast("long").alias("tree"), F.lit(1).alias("level"), "place", F.lit(-(-n_sources // FAN)).cast("long").alias("width"), "children"))
    return Manifest(runs, written(_linked(levels, n_sources), "linked"), n_sources)


def _over(tree: Column, n_sources: int) -> Column:
    """The node over a source's subroot; null where that is the root."""
    return F.when(F.lit(n_sources > 1), _name(F.lit(-1), F.lit(1), F.expr(f"tree DIV {FAN}")))


def _linked(levels: list[DataFrame], n_sources: int) -> DataFrame:
    """(node, parent, slot, children, digest, of_leaves, tops_source) of all levels; the root's parent is null."""
    rows = levels[0]
    for level in levels[1:]:
        rows = rows.unionByName(level)
    inside, tops = F.col("width") > 1, (F.col("width") == 1) & (F.col("tree") >= 0)
    parent = F.when(inside, _name(F.col("tree"), F.col("level") + 1, F.expr(f"place DIV {FAN}"))).when(tops, _over(F.col("tree"), n_sources))
    slot = F.when(inside, F.col("place") % FAN).otherwise(F.col("tree") % FAN).cast("int")
    return rows.select(_name(F.col("tree"), F.col("level"), F.col("place")).alias("node"), parent.alias("parent"), slot.alias("slot"), "children", "digest", ((F.col("level") == 1) & (F.col("tree") >= 0)).alias("of_leaves"), tops.alias("tops_source"))


def climb(manifest: Manifest) -> DataFrame:
    """(run, folded, above, subroot, root): what each run's leaves fold to at the root, and the siblings above the run."""
    spark = manifest.runs.sparkSession
    alone = F.col("n") == 1
    leaf = F.when(alone, F.col("members")[0]["leaf"])
    slots = F.transform("members", lambda m: F.when(alone, F.col("tree")).otherwise(m["place"]) % FAN).cast("array<int>")
    runs = manifest.runs.select(
        _name(F.col("tree"), F.lit(0), F.col("run")).alias("run"), F.when(alone, _over(F.col("tree"), manifest.n_sources)).otherwise(_name(F.col("tree"), F.lit(1), F.col("run"))).alias("parent"),
        F.transform("members", lambda m: F.coalesce(m["changed"], m["leaf"])).alias("folded"), slots.alias("slots"), F.lit(b"").alias("above"), leaf.alias("subroot"), leaf.alias("root"),
    )
    limit = "spark.sql.cteRecursionRowLimit"
    before = spark.conf.get(limit)
    spark.conf.set(limit, "-1")  # the rows grow with the data, the rounds with its logarithm
    try:
        return written(spark.sql(CLIMB, runs=runs, nodes=manifest.nodes), "climb")
    finally:
        spark.conf.set(limit, before)


def proofs(manifest: Manifest, key: str = "doc_id") -> DataFrame:
    """(key, leaf, subroot, root, proof_sha256, folded_root, verified) of every row, digests as hex text."""
    up = climb(manifest).withColumnRenamed("run", "_run")
    runs = manifest.runs.withColumn("_run", _name(F.col("tree"), F.lit(0), F.col("run")))
    children = F.aggregate("members", F.lit(b""), lambda all, m: F.concat(all, m["leaf"]))
    rows = runs.join(up, "_run").select(children.alias("_leaves"), "above", "subroot", "root", "folded", F.posexplode("members").alias("_i", "_m"))
    hex = lambda c: F.lower(F.hex(c))
    siblings = F.concat(F.substring("_leaves", F.lit(1), F.col("_i") * 32), F.substring("_leaves", F.col("_i") * 32 + 33, F.octet_length("_leaves")), F.col("above"))
    folded = F.get("folded", F.col("_i"))
    return rows.select(F.col("_m")["id"].alias(key), hex(F.col("_m")["leaf"]).alias("leaf"), hex(F.col("subroot")).alias("subroot"), hex(F.col("root")).alias("root"), F.sha2(hex(siblings), 256).alias("proof_sha256"), hex(folded).alias("folded_root"), (folded == F.col("root")).alias("verified"))
