"""The catalog as a stored table in ranges of ids, for reads of few items.

Items lie in parts of PART ids each, sorted by id within them: a read of some ids
opens their parts alone, and in these skips row groups by their least and greatest id.
Beside them lies the catalog's first row, which a lookup of an unknown id returns.

Items without an id are left out; several with one id are all kept.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

#: Ids in one part, and pieces of a part that are dealt to tasks whole.
PART = 1 << 20
PIECES = 32


def part_of(item_id: Column, width: int) -> Column:
    return F.floor(item_id / F.lit(width)).cast("long")


@dataclass(frozen=True)
class StoredCatalog:
    path: str
    width: int
    schema: StructType

    def items(self, spark: SparkSession) -> DataFrame:
        """All items, with their `part`."""
        return spark.read.schema(StructType([*self.schema.fields, StructField("part", LongType())])).parquet(f"{self.path}/items")

    def some(self, spark: SparkSession, ids: list[int]) -> DataFrame:
        """The items with these ids, of which a caller has few."""
        parts = sorted({i // self.width for i in ids})
        return self.items(spark).where(F.col("part").isin(parts) & F.col("item_id").isin(ids)).drop("part")

    def lookup_or_first(self, spark: SparkSession, item_id: int) -> DataFrame:
        """The item with this id; without one, the first item of the catalog.  Two rows at most are compared, none is sorted."""
        hit = self.items(spark).where((F.col("part") == item_id // self.width) & (F.col("item_id") == item_id)).drop("part").withColumn("_rank", F.lit(0))
        both = hit.unionByName(spark.read.schema(self.schema).parquet(f"{self.path}/first").withColumn("_rank", F.lit(1)))
        row = F.struct(*(c for c in both.columns if c != "_rank"))
        return both.agg(F.min_by(row, F.struct("_rank", "ordinal")).alias("_r")).where("_r IS NOT NULL").select("_r.*")


def store_catalog(catalog: DataFrame, path: str, width: int = PART) -> StoredCatalog:
    """Write the catalog to a path in parts of `width` ids."""
    items = catalog.where(F.col("item_id").isNotNull()).withColumn("part", part_of(F.col("item_id"), width))
    # Pieces of known bounds: to find even ones by a sample, the catalog would be computed once more.
    items.repartition("part", part_of(F.col("item_id"), -(-width // PIECES))).sortWithinPartitions("part", "item_id").write.mode("overwrite").partitionBy("part").parquet(f"{path}/items")
    stored = StoredCatalog(path, width, catalog.schema)
    first = stored.items(catalog.sparkSession).drop("part")
    first = first.where(F.col("ordinal") == first.agg(F.min("ordinal")).scalar())  # so that whole rows are compared of these only
    first.agg(F.min_by(F.struct(*first.columns), "ordinal").alias("_r")).where("_r IS NOT NULL").select("_r.*").write.mode("overwrite").parquet(f"{path}/first")
    return stored
