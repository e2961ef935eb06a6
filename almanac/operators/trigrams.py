"""Substring search by an index of trigrams over the distinct values of the searched fields.

Items share their values: a title or a country is one value, however many items have it.
The index has three levels, so that grams are cut once a value and never meet items:

* lists (`path`): every place of a value begins a gram of three characters; two end marks
  close a value, so that its last characters begin grams too.  A row for each gram and
  chunk of value numbers has the sorted numbers of the chunk whose values have the gram.
* values (`path-values`): number, text in lower case and the text's hash, its key.
* items (`path-items`): a row for each value and chunk of ids, with the sorted ids of the
  chunk's items that have the value, under its key.

A gram or value of any frequency is spread over rows of at most CHUNK numbers or ids.
Lists are sorted by gram and items by key, so that a search reads the row groups of its
keyword's grams and values.

A search intersects the lists of its keyword's grams chunk by chunk, keeps the values that
have the keyword inside, since grams may come from different places, reads their items
from the stored catalog and verifies these with the same predicate as a search without
index, since keys are hashes.

Defined results: a blank keyword finds all items, as a filter without a value does; one
of one or two characters finds the grams that begin with it; null fields have no grams,
and the searched text and the keyword are in lower case.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from almanac.functions.columns import contains_keyword, keyword
from almanac.operators.predicates import SEARCHED
from almanac.sources.stored import StoredCatalog

#: Numbers or ids in one row at most; keys and candidates that are read by literals; more are joined.
CHUNK = 4096
FEW = 1000
END = "\0"


def _no_text() -> Column:
    return F.array().cast("array<string>")


def grams(text: Column) -> Column:
    """The grams that begin at each place of a text in lower case; none of a null or empty one."""
    letters = F.split(F.concat(F.lower(text), F.lit(END + END)), "")
    joined = lambda x, n: F.zip_with(x, F.slice(letters, n, F.size(letters)), lambda a, b: F.concat(a, b))
    return F.coalesce(F.slice(joined(joined(letters, 2), 3), 1, F.size(letters) - 2), _no_text())


def values(fields: tuple[str, ...], arrays: tuple[str, ...]) -> Column:
    """The texts of an item's fields in lower case, maybe repeated or null."""
    return F.concat(F.array(*map(F.lower, fields)), *(F.transform(F.coalesce(a, _no_text()), F.lower) for a in arrays))


def _lists(rows: DataFrame, by: tuple[str, ...], member: str, chunk: int) -> DataFrame:
    """(by, chunk, ids): the sorted members of each key in one chunk of them."""
    found = rows.groupBy(*by, F.floor(F.col(member) / F.lit(chunk)).alias("chunk"))
    return found.agg(F.sort_array(F.array_distinct(F.collect_list(member))).alias("ids"))


def build(catalog: DataFrame, path: str, fields: tuple[str, ...] = SEARCHED, arrays: tuple[str, ...] = ("genres",), chunk: int = CHUNK) -> None:
    """Write the index of a catalog's fields: lists (gram, chunk, ids of values), values (number, key, value), items (key, value, chunk, ids)."""
    rows = catalog.where(F.col("item_id").isNotNull()).select("item_id", F.explode(values(fields, arrays)).alias("value")).where("value != ''")
    lists = _lists(rows.withColumn("key", F.xxhash64("value")), ("key", "value"), "item_id", chunk)
    found = _written(lists.sortWithinPartitions("key", "chunk"), f"{path}-items").select("key", "value").distinct()
    # Numbers hold once they are written; grams are cut from what is read again.
    numbered = _written(found.select(F.monotonically_increasing_id().alias("number"), "key", "value"), f"{path}-values")
    cut = numbered.select("number", F.explode(F.array_distinct(grams(F.col("value")))).alias("gram"))
    _written(_lists(cut, ("gram",), "number", chunk).sortWithinPartitions("gram", "chunk"), path)


def _written(rows: DataFrame, path: str) -> DataFrame:
    rows.write.mode("overwrite").parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def found_values(spark: SparkSession, path: str, wanted: str) -> DataFrame:
    """(key): values that have a keyword inside, which isn't blank."""
    lists = spark.read.parquet(path)
    if len(wanted) < 3:
        numbers = lists.where(F.startswith("gram", F.lit(wanted))).select(F.explode("ids").alias("number")).distinct()
    else:
        parts = sorted({wanted[i : i + 3] for i in range(len(wanted) - 2)})
        met = lists.where(F.col("gram").isin(parts)).groupBy("chunk").agg(F.collect_list("ids").alias("lists")).where(F.size("lists") == len(parts))
        ids = F.aggregate(F.slice("lists", 2, len(parts)), F.col("lists")[0], F.array_intersect)
        numbers = met.select(F.explode(ids).alias("number"))
    return spark.read.parquet(f"{path}-values").join(numbers, "number", "left_semi").where(F.contains("value", F.lit(wanted))).select("key").distinct()


def candidates(spark: SparkSession, path: str, wanted: str, few: int | None = None) -> DataFrame:
    """(item_id): items that have a value with the keyword, which isn't blank.

    Up to `few` values are read by their keys, for which row groups are skipped; more of them, or all without `few`, meet the items in a join.
    """
    keys, items = found_values(spark, path, wanted), spark.read.parquet(f"{path}-items")
    first = [r["key"] for r in keys.limit(few + 1).collect()] if few is not None else None
    mine = items.where(F.col("key").isin(first)) if first is not None and len(first) <= few else items.join(keys, "key", "left_semi")
    return mine.select(F.explode("ids").alias("item_id")).distinct()


def search(spark: SparkSession, path: str, stored: StoredCatalog, query: str, fields: tuple[str, ...] = SEARCHED, arrays: tuple[str, ...] = ("genres",), few: int = FEW) -> DataFrame:
    """The items with the keyword in one of the fields, as the predicate over the whole catalog finds them.

    Up to `few` candidates are read by their ids, for which partitions and row groups are
    skipped; more of them meet the catalog in a join.
    """
    wanted = keyword(query)
    if not wanted:
        return stored.items(spark).drop("part")
    found = candidates(spark, path, wanted, few)
    first = [r["item_id"] for r in found.limit(few + 1).collect()]
    items = stored.some(spark, first) if len(first) <= few else stored.items(spark).drop("part").join(found, "item_id", "left_semi")
    return items.where(contains_keyword(query, *fields, arrays=arrays))
