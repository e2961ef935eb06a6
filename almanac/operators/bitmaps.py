"""Facets as bitmaps: counts of any conjunction without a scan of the catalog.

An item's ordinal is its bit.  The index has a row for each value of a facet and bucket
of 32,768 bits, and one of all items; `bitmap_construct_agg` builds them with a partial
aggregation.  Values of one facet are united, facets intersected, bucket by bucket, so
that a count reads the rows of the asked values alone: a bit an item and value.  Found
items of a keyword are one more bitmap.

Ordinals are meant to be dense, else buckets are sparse (and well compressed).  Items of
one ordinal count once, those without one not at all.  A null or absent value has no
bitmap; a facet's `all` row counts all items.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ALL = "all"
FACETS = ("status", "region", "platform")


def _bitmaps(rows: DataFrame, *keys: str) -> DataFrame:
    """(keys, bucket, bits) of rows (keys, ordinal)."""
    return rows.groupBy(*keys, F.bitmap_bucket_number("ordinal").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("ordinal")).alias("bits"))


def build(catalog: DataFrame, path: str) -> None:
    """Write the index: (facet, value, bucket, bits), in order of facet and value."""
    one = lambda facet, value: F.struct(F.lit(facet).alias("facet"), value.alias("value"))
    own = F.array(one(ALL, F.lit("")), one("status", F.col("status")), one("region", F.col("region")))
    platforms = F.transform(F.coalesce("platforms", F.array().cast("array<string>")), lambda p: one("platform", p))
    rows = catalog.where(F.col("ordinal").isNotNull()).select("ordinal", F.explode(F.concat(own, platforms)).alias("f")).select("ordinal", "f.facet", "f.value").where("value IS NOT NULL")
    _bitmaps(rows, "facet", "value").repartitionByRange("facet", "value", "bucket").sortWithinPartitions("facet", "value", "bucket").write.mode("overwrite").parquet(path)


def of_items(items: DataFrame) -> DataFrame:
    """(facet, value, bucket, bits) of found items, a facet of its own."""
    return _bitmaps(items.select(F.lit("found").alias("facet"), F.lit("").alias("value"), "ordinal").where("ordinal IS NOT NULL"), "facet", "value")


def _wanted(filters: dict[str, str | list[str] | None]) -> dict[str, list[str]]:
    """Facets with the values asked for; None, blank and `all` ask for nothing."""
    found = {}
    for facet, values in filters.items():
        if facet not in FACETS:
            raise ValueError(f"no facet {facet}")
        values = [v for v in ([values] if isinstance(values, str) or values is None else values)]
        if values and not any(v in (None, "", ALL) for v in values):
            found[facet] = values
    return found


def selected(index: DataFrame, found: DataFrame | None = None, **filters) -> DataFrame:
    """(bucket, bits) of the items that meet all filters, and are found."""
    wanted = _wanted(filters)
    asked = F.col("facet") == ALL
    for facet, values in wanted.items():
        asked = asked | ((F.col("facet") == facet) & F.col("value").isin(*values))
    rows = index.where(asked)
    rows = rows if found is None else rows.unionByName(found)
    united = rows.groupBy("bucket", "facet").agg(F.bitmap_or_agg("bits").alias("bits"))
    met = united.groupBy("bucket").agg(F.bitmap_and_agg("bits").alias("bits"), F.count("*").alias("n"))
    return met.where(F.col("n") == 1 + len(wanted) + (found is not None)).select("bucket", "bits")


def result_counts(index: DataFrame, found: DataFrame | None = None, **filters) -> DataFrame:
    """Items shown under the filters, and all items."""
    count = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.bitmap_count("bits"))), F.lit(0)).alias(kind)
    rows = selected(index, found, **filters).select(F.lit("shown").alias("kind"), "bits").union(index.where(F.col("facet") == ALL).select(F.lit("total"), "bits"))
    return rows.agg(count("shown"), count("total"))


def facet_counts(index: DataFrame, facet: str, found: DataFrame | None = None, **filters) -> DataFrame:
    """(facet, n): items by value of a facet under the filters, and an `all` row; values without items are left out."""
    values = index.where(F.col("facet") == facet).select(F.col("value").alias(facet), "bucket", "bits").union(index.where(F.col("facet") == ALL).select(F.lit(ALL), "bucket", "bits"))
    if found is not None or _wanted(filters):
        base = selected(index, found, **filters).withColumnRenamed("bits", "_base")
        both = values.join(base, "bucket").select(facet, "bucket", F.explode(F.array("bits", "_base")).alias("bits"))
        values = both.groupBy(facet, "bucket").agg(F.bitmap_and_agg("bits").alias("bits"))
    counts = values.groupBy(facet).agg(F.sum(F.bitmap_count("bits")).alias("n"))
    return counts.where((F.col("n") > 0) | (F.col(facet) == ALL))
