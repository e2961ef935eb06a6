"""Streams that keep current state: wishlists, shelves and release dates.

Each stream drops events that were delivered before, folds the rest by key and
hands the keys that changed to a sink.  The sink keeps versions in buckets of
keys: a batch rewrites only the buckets it touches, under its own batch number,
so a batch that runs again writes the same files again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from almanac.operators import history, shelf
from almanac.sources.schemas import EVENTS
from almanac.sources.storage import new_folder, table
from almanac.sources.tables import actions, announcements

BUCKETS = 16
LATE = "1 day"


def raw_events(spark: SparkSession, path: str, files_per_batch: int = 8) -> DataFrame:
    """Raw events as they arrive in a folder, or in one file, with repeated ones."""
    path = f"{path[:-1]}[{path[-1]}]"  # a pattern may name a file, a plain path of a stream must be a folder
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_per_batch).parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def read_events(spark: SparkSession, path: str, files_per_batch: int = 8, late: str | None = LATE) -> DataFrame:
    """Raw events as they arrive in a folder, or in one file; repeated ones are known, and late ones taken, within `late`.

    late=None: all of them, whatever their order, for runs to the end of a table; the ids seen are kept.
    """
    events = raw_events(spark, path, files_per_batch)
    if late is None:
        return events.dropDuplicates(["event_id"])
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def wish_counts(log: DataFrame) -> DataFrame:
    return log.where(F.col("action") == "toggle").groupBy(*shelf.KEY).agg(F.count("*").alias("n"), F.max("seq").alias("seq"))


def shelf_marks(log: DataFrame) -> DataFrame:
    return log.where(F.col("action").isin("shelf_set", "shelf_clear")).groupBy(*shelf.KEY).agg(F.max_by("shelf_status", "seq").alias("shelf_status"))


def bucket_of(keys: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def touched_buckets(rows: DataFrame, keys: list[str], buckets: int = BUCKETS) -> list[int]:
    """The buckets that these rows' keys lie in, of `buckets` in all."""
    return [r[0] for r in rows.select(bucket_of(keys, buckets)).distinct().collect()]


def merge_into(path: str, keys: list[str], buckets: int = BUCKETS) -> Callable[[DataFrame, int], None]:
    """A sink that replaces the rows of the batch's keys, bucket by bucket.

    buckets stays the same for all of a sink's life; a task rewrites a whole bucket, so
    that it should grow with the number of keys to come.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark, bucket = batch.sparkSession, bucket_of(keys, buckets).alias("bucket")
        changed = batch.select("*", bucket).persist()
        touched = touched_buckets(changed, keys, buckets)
        kept = snapshot(spark, path, batch.schema, before=number, buckets=touched)
        merged = changed if kept is None else changed.unionByName(kept.withColumn("bucket", bucket).join(changed.select(*keys), keys, "left_anti"))
        merged.withColumn("version", F.lit(number)).repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "version").parquet(path)
        changed.unpersist()
        drop_old(spark, path, touched, number)

    return write


def drop_old(spark: SparkSession, path: str, buckets: list[int], number: int) -> None:
    """Remove versions that neither a reader of the newest one nor a second run of this batch looks at."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    files = hadoop(path).getFileSystem(spark._jsc.hadoopConfiguration())
    for bucket in buckets:
        found = [f.getPath() for f in files.listStatus(hadoop(f"{path}/bucket={bucket}"))]
        before = sorted((int(p.getName().split("=")[1]), i) for i, p in enumerate(found) if int(p.getName().split("=")[1]) < number)
        for _, i in before[:-1]:
            files.delete(found[i], True)


def snapshot(spark: SparkSession, path: str, schema, before: int | None = None, buckets: list[int] | None = None) -> DataFrame | None:
    """The newest version of each bucket, of versions before a batch number; None while nothing is written."""
    stored = StructType([*schema.fields, StructField("bucket", IntegerType()), StructField("version", LongType())])
    try:
        rows = spark.read.schema(stored).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    if before is not None:
        rows = rows.where(F.col("version") < before)
    if buckets is not None:
        rows = rows.where(F.col("bucket").isin(buckets))
    newest = rows.groupBy("bucket").agg(F.max("version").alias("version"))
    return rows.join(F.broadcast(newest), ["bucket", "version"]).select(*(f.name for f in schema))


def run_to_end(folded: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Run a stream over what has arrived and return the state it leaves."""
    spark = folded.sparkSession
    path = new_folder(spark, name)
    query = folded.writeStream.outputMode("update").foreachBatch(merge_into(path, keys)).option("checkpointLocation", new_folder(spark, f"{name}-progress")).trigger(availableNow=True).start()
    query.awaitTermination()
    schema = folded.schema
    found = snapshot(spark, path, schema)
    return spark.createDataFrame([], schema) if found is None else found


def stream_wishlist(spark: SparkSession, path: str) -> DataFrame:
    """(user_id, item_id): what users wish for after all events so far."""
    state = run_to_end(wish_counts(actions(read_events(spark, path, late=None))), shelf.KEY, "wishlist")
    return state.where("n % 2 = 1").select(*shelf.KEY)


def stream_shelf(spark: SparkSession, path: str) -> DataFrame:
    """(user_id, item_id, shelf_status) after all events so far."""
    return run_to_end(shelf_marks(actions(read_events(spark, path, late=None))), shelf.KEY, "shelf").where("shelf_status IS NOT NULL")


def stream_release_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(item_id, new_date, kind, seq): the newest official statement on each item so far."""
    feed = announcements(read_events(spark, f"{sf_dir}/events.parquet", late=None), table(spark, sf_dir, "orders"))
    last = F.max_by(F.struct("new_date", "kind", "seq"), "seq").alias("s")
    return run_to_end(history.official(feed).groupBy("item_id").agg(last), ["item_id"], "dates").select("item_id", "s.*")
