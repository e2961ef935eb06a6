"""Connected components of links that no machine holds whole."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from almanac.llm.shared import written


def components(links: DataFrame, rounds: int = 50) -> DataFrame:
    """(node, root): the smallest node that each node of links (a, b) reaches.

    Alternating large-star and small-star steps: each node points its larger,
    then its smaller neighbours at the smallest node around it.  A star's rows
    are spread by the nodes that point, so a centre of many links is no hot key
    for more than its own minimum, which is formed before the shuffle.
    """
    edges = written(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    seen = None
    for _ in range(rounds):
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen or not state[0]:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen = state
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        smallest = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
        large = both.join(smallest, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        smallest = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(smallest, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = written(small.union(smallest.select("a", F.col("m").alias("b"))).distinct(), "links")
    raise RuntimeError(f"not done after {rounds} rounds")
