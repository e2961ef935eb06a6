"""The catalog, the announcements and the action log, derived from the base tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from almanac.sources.schemas import DIMENSIONS, SHELVES
from almanac.sources.storage import table

SNAPSHOT = "1998-04-15"


def _score(total: Column) -> Column:
    return F.expr("cast(1 as decimal(3,1))") + (total % 95).cast("decimal(4,0)") * F.expr("cast(0.1 as decimal(2,1))")


def _details(spark: SparkSession, sf_dir: str, only: DataFrame | None = None) -> DataFrame:
    """What the lines of an order say about its item: names, platforms, genres and scores; with only (item_id), of these orders."""
    lines = table(spark, sf_dir, "lineitem")
    if only is not None:
        lines = lines.join(only.select(F.col("item_id").alias("_only")), F.col("l_orderkey") == F.col("_only"), "left_semi")
    lines = lines.join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    whole = lambda c: F.sum(F.round(c).cast("bigint"))
    totals = (F.sum("l_quantity").cast("bigint"), whole(F.col("l_extendedprice")), whole(F.col("l_discount") * 100), whole(F.col("l_tax") * 100))
    return lines.groupBy(F.col("l_orderkey").alias("_key")).agg(
        F.min("p_name").alias("title"), F.max("p_name").alias("original_title"), F.min("p_brand").alias("publisher"),
        F.array_sort(F.collect_set(F.concat("l_returnflag", "l_linestatus"))).alias("platforms"), F.array_sort(F.collect_set("p_type")).alias("genres"),
        *(_score(t).cast("decimal(3,1)").alias(d) for t, d in zip(totals, DIMENSIONS)),
    )


def status_of(date: Column, snapshot: str = SNAPSHOT) -> Column:
    """An item without an official date is in development; a date decides between the others."""
    return F.when(date.isNull(), "development").when(date <= F.lit(snapshot).cast("date"), "released").otherwise("upcoming")


def with_page(rows: DataFrame, pages: DataFrame, key: Column) -> DataFrame:
    """rows with the url of one page each, dealt in turn along the key; the number of pages is part of the plan, not an action."""
    n = pages.agg(F.greatest(F.count("*"), F.lit(1))).scalar()
    return rows.withColumn("_page", key % n).join(pages.select("page_id", "url"), F.col("_page") == F.col("page_id"), "left").drop("_page", "page_id")


def with_details(spark: SparkSession, sf_dir: str, items: DataFrame, only: DataFrame | None = None) -> DataFrame:
    """Items with what their order lines say; with only (item_id), lines of other items are left out before they are aggregated."""
    items = items.join(_details(spark, sf_dir, only), F.col("item_id") == F.col("_key"), "left").drop("_key")
    return items.withColumns({n: F.coalesce(n, F.array().cast("array<string>")) for n in ("platforms", "genres")})


def _in_status(orders: DataFrame, status: str, snapshot: str) -> DataFrame:
    """Orders whose items have a status, by predicates on stored columns that reach the scan."""
    after = (F.lit(snapshot).cast("date") + F.expr("INTERVAL '1' DAY")).cast("timestamp_ntz")
    dated = F.col("o_orderstatus") != "P"
    if status == "development":
        return orders.where((F.col("o_orderstatus") == "P") | F.col("o_orderstatus").isNull() | F.col("o_orderdate").isNull())
    if status not in ("released", "upcoming"):
        return orders.where(F.lit(False))
    return orders.where(dated & ((F.col("o_orderdate") < after) if status == "released" else (F.col("o_orderdate") >= after)))


def catalog(spark: SparkSession, sf_dir: str, *, details: bool = True, sources: bool = False, snapshot: str = SNAPSHOT, status: str | None = None) -> DataFrame:
    """One row an order.  Without details, the columns that need order lines are left out, and the scan of these too.

    status keeps the items of one status, by what the orders store.  sources adds what the data-quality rules look at: provenance, declared status and declared date.
    """
    orders = table(spark, sf_dir, "orders")
    if status is not None:
        orders = _in_status(orders, status, snapshot)
    customer = table(spark, sf_dir, "customer")
    nation = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    items = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    key, day = F.col("o_orderkey"), F.col("o_orderdate").cast("date")
    date = F.when(F.col("o_orderstatus") != "P", day)
    columns = {
        "item_id": key, "ordinal": key, "developer": F.col("c_name"), "country": F.col("n_name"), "region": F.col("r_name"), "release_date": date, "status": status_of(date, snapshot),
        "date_label": F.coalesce(F.date_format(date, "yyyy.MM.dd"), F.lit("TBA")), "featured": F.col("o_orderpriority") == "1-URGENT", "signal": F.when(F.col("o_orderpriority") == "5-LOW", "interview").otherwise("official"),
        "score_mode": F.when(status_of(date, snapshot) == "released", "initial").otherwise("expected"), "summary": F.concat_ws(" ", "c_mktsegment", "o_orderpriority"), "fit": F.col("c_mktsegment"), "caution": F.col("o_orderpriority"),
    }
    if sources:
        items = with_page(items, table(spark, sf_dir, "pages"), key)
        declared = F.when((key % 97 == 0) | ((F.col("o_orderstatus") == "P") & (key % 10 != 0)), F.lit(None)).otherwise(day)
        columns |= {
            "source_label": F.col("r_name"), "source_url": F.col("url"), "checked_at": F.date_sub(F.lit(snapshot).cast("date"), (key % 2).cast("int")), "evidence": F.concat_ws(" ", "o_orderpriority", "c_mktsegment"),
            "declared_status": F.when(F.col("o_orderstatus") == "F", "released").when(F.col("o_orderstatus") == "O", "upcoming").otherwise("development"), "declared_date": declared,
        }
    items = items.select(*(c.alias(n) for n, c in columns.items()))
    return with_details(spark, sf_dir, items) if details else items


def _events(events: DataFrame) -> DataFrame:
    return events.select("event_id", "ts", "user_id", "event_type", F.get_json_object("props", "$.k").cast("bigint").alias("k"), F.floor("value").cast("bigint").alias("v"), "props")


def actions(events: DataFrame) -> DataFrame:
    """The log of what users did to items, from raw events (a batch or a stream)."""
    v = F.col("v")
    fifth = v % 5
    kind = F.col("event_type")
    return _events(events).select(
        F.col("event_id").alias("seq"), "ts", "user_id", F.when(F.col("k") % 10 == 9, -1).otherwise(F.col("k") % 10).cast("bigint").alias("item_id"),
        F.when(kind == "click", "toggle").when(kind == "view", F.when(fifth == 4, "shelf_clear").otherwise("shelf_set")).when(kind == "purchase", F.when(fifth == 4, "rate_reset").otherwise("rate")).when(kind == "signup", "note").otherwise("invalid").alias("action"),
        F.when((kind == "view") & (fifth != 4), F.element_at(F.array(*map(F.lit, SHELVES)), (fifth + 1).cast("int"))).alias("shelf_status"),
        F.when((kind == "purchase") & (fifth != 4), F.element_at(F.array(*map(F.lit, DIMENSIONS)), (v % 4 + 1).cast("int"))).alias("dimension"),
        F.when((kind == "purchase") & (fifth != 4), (F.expr("cast(1 as decimal(3,1))") + (v % 91).cast("decimal(4,0)") * F.expr("cast(0.1 as decimal(2,1))")).cast("decimal(3,1)")).alias("score"),
        F.when(kind == "signup", F.when(v % 3 == 0, "").otherwise(F.left("props", F.lit(500)))).alias("note"),
    )


def announcements(events: DataFrame, orders: DataFrame) -> DataFrame:
    """The feed of statements on release dates, from raw events."""
    raw = _events(events).withColumn("item_id", F.col("user_id") * 100 + F.col("k"))
    kind = F.element_at(F.create_map(*(F.lit(x) for pair in {"signup": "announcement", "click": "date_change", "view": "interview", "purchase": "event_preview", "error": "rumour"}.items() for x in pair)), F.col("event_type"))
    dates = orders.select(F.col("o_orderkey").alias("item_id"), F.col("o_orderdate").cast("date").alias("_day"))
    return raw.join(dates, "item_id", "left").select(F.col("event_id").alias("seq"), "ts", "item_id", F.col("ts").cast("date").alias("published_on"), kind.alias("kind"), F.date_add("_day", F.col("v").cast("int")).alias("new_date"))
