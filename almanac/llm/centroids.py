"""Centroid clustering of vectors in whole numbers, with expressions of the JVM alone.

Components become whole numbers, so that distances, sums and centroids are exact and
don't depend on the order of rows.  Each round is one pass: the centroids stand in the
plan as literal arrays, `zip_with` and `aggregate` give each one's product with a
vector, `array_min` of (distance, cluster) structs chooses, and one sum for each
component, combined before the shuffle, moves the centroids.  Only k rows of sums reach
the driver.  A cluster may hold any share of the rows: its sums are formed in all tasks.

Defined results: a vector with another number of components, or one that is null, NaN
or infinite, is left out.  Whole components are held within +-2^27, so that distances
fit into 64 bits.  Rows with equal ids are clustered one by one; of equal starting keys
the smaller components come first, a null id's key last.  With fewer than k vectors there
are as many centroids as vectors; of an empty table the result is empty.  Equal
distances go to the smaller number, an empty cluster keeps its centroid, an inertia
beyond 64 bits is null.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from almanac.llm.shared import written

BOUND = 1 << 27
_GREATEST = 1.7976931348623157e308


def whole_vectors(vectors: DataFrame, id: str = "vec_id", column: str = "embedding", dims: int = 64, scale: int = 256) -> DataFrame:
    """(id, v, square): the vectors that count, as whole numbers floor(scale * x), and their squared lengths."""
    values = F.col(column).cast("array<double>")
    finite = F.coalesce(F.forall(values, lambda x: F.coalesce(x.between(-_GREATEST, _GREATEST), F.lit(False))), F.lit(False))  # NaN is above all numbers
    whole = F.transform(values, lambda x: F.greatest(F.lit(-BOUND), F.least(F.lit(BOUND), F.floor(x * scale))).cast("long"))
    return vectors.where((F.size(values) == dims) & finite).select(id, whole.alias("v")).withColumn("square", F.expr(_product("v")))


def _product(other: str) -> str:
    return f"aggregate(zip_with(v, {other}, (x, y) -> x * y), 0L, (s, p) -> s + p)"


def nearest(centroids: list[list[int]]) -> Column:
    """(distance, cluster) of the centroid nearest to v, by |v|^2 + |c|^2 - 2 vc."""
    each = (f"struct(square + {sum(x * x for x in c)}L - 2L * {_product('array(' + ', '.join(f'{x}L' for x in c) + ')')} AS distance, {k} AS cluster)" for k, c in enumerate(centroids))
    return F.expr(f"array_min(array({', '.join(each)}))")


def first_centroids(kept: DataFrame, id: str, k: int, seed: str) -> list[list[int]]:
    """The k vectors with the smallest sha256 of `seed:id`."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col(id).cast("string")), 256)
    return [list(r["v"]) for r in kept.select("v", key.alias("_key")).orderBy(F.col("_key").asc_nulls_last(), "v").limit(k).collect()]


def moved(kept: DataFrame, centroids: list[list[int]]) -> list[list[int]]:
    """Centroids after one round: the floor of each cluster's mean, an empty cluster's own."""
    dims = len(centroids[0])
    sums = kept.select("v", nearest(centroids).alias("near")).groupBy("near.cluster").agg(F.count("*").alias("n"), *(F.expr(f"sum(v[{i}]) AS s{i}") for i in range(dims)))
    after = list(centroids)
    for r in sums.collect():  # a row for each centroid at most
        after[r["cluster"]] = [r[f"s{i}"] // r["n"] for i in range(dims)]
    return after


def _within_64_bits(n: int) -> int | None:
    return int(n) if n < 1 << 63 else None


def cluster_vectors(vectors: DataFrame, id: str = "vec_id", column: str = "embedding", k: int = 40, rounds: int = 5, dims: int = 64, scale: int = 256, seed: str = "2") -> DataFrame:
    """(id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every vector that counts, after the rounds."""
    kept = written(whole_vectors(vectors, id, column, dims, scale), "vectors")
    centroids = first_centroids(kept, id, k, seed)
    if not centroids:
        centroids = [[0] * dims]  # nothing is assigned to it
    else:
        for _ in range(rounds):
            centroids = moved(kept, centroids)
    assigned = written(kept.select(id, nearest(centroids).alias("_near")).select(id, "_near.cluster", "_near.distance"), "clusters")
    totals = {r["cluster"]: r["total"] for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(20,0)")).alias("total")).collect()}
    each = F.lit([_within_64_bits(totals.get(c, 0)) for c in range(len(centroids))]).cast("array<long>")
    digests = F.lit([hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids])
    own = lambda values: F.element_at(values, F.col("cluster") + 1)
    whole = F.lit(_within_64_bits(sum(totals.values()))).cast("long")
    return assigned.select(id, "cluster", "distance", own(each).alias("cluster_inertia"), whole.alias("inertia"), own(digests).alias("centroid_sha256"))
