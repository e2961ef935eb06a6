"""What plans scan and shuffle, and the single fold of the log against the separate ones."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from almanac.functions import columns as C
from almanac.operators import quality, ranking, shelf, state
from almanac.plans import queries
from almanac.plans.queries import QUERIES
from almanac.sources import tables
from almanac.sources.schemas import DIMENSIONS

from test_fixtures import frame, item, log

DATA = "/root/testdata/sf0.001"


def physical(df) -> str:
    """The physical plan, as it is before any part of it has run."""
    return df._jdf.queryExecution().executedPlan().toString()


def scans(df, name) -> int:
    return physical(df).count(f"{DATA}/{name}.parquet")


@pytest.mark.parametrize(("name", "table", "most"), [
    ("my_shelf", "events", 1), ("my_shelf", "lineitem", 1), ("shelf_stats", "events", 1), ("shelf_stats", "lineitem", 0), ("state_orphans", "events", 1), ("state_orphans", "customer", 0), ("state_orphans", "orders", 1),
    ("state_encode", "events", 1), ("state_explode", "events", 1), ("state_encode", "lineitem", 1), ("effective_scores", "events", 1), ("effective_scores", "lineitem", 1), ("card_projection", "events", 1), ("card_projection", "lineitem", 1),
    ("radar", "lineitem", 1), ("filter_status", "lineitem", 1), ("sort_recommend_topk", "lineitem", 1), ("facet_status", "lineitem", 0),
])
def test_scans(spark, name, table, most):
    assert scans(QUERIES[name](spark, DATA), table) <= most


def test_predicates_reach_the_scans(spark):
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    shown = physical(QUERIES["filter_status"](spark, DATA))
    assert "GreaterThanOrEqual(o_orderdate,1998-04-16" in shown and "Not(EqualTo(o_orderstatus,P))" in shown
    assert "LessThan(o_orderdate,1998-04-16" in physical(QUERIES["radar"](spark, DATA))
    assert "EqualTo(user_id,7)" in physical(QUERIES["card_projection"](spark, DATA))
    top = physical(QUERIES["sort_date_asc_topk"](spark, DATA))
    assert "LeftSemi" in top and top.count("TakeOrderedAndProject") + top.count("TopK") >= 1


@pytest.mark.parametrize("status", ["released", "upcoming", "development", "other"])
def test_status_by_stored_columns_is_the_status(spark, tmp_path, status):
    rows = [(1, 1, "F", "1998-04-15 23:59:59"), (2, 1, "O", "1998-04-16 00:00:00"), (3, 1, "P", "1998-01-01 00:00:00"), (4, 1, None, "1998-01-01 00:00:00"), (5, 1, "F", None), (6, 1, "P", None), (7, 1, "O", "1998-04-15 00:00:00")]
    orders = spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_orderstatus string, o_orderdate string").withColumns({"o_orderdate": F.col("o_orderdate").cast("timestamp_ntz"), "o_orderpriority": F.lit("5-LOW")})
    orders.write.parquet(str(tmp_path / "orders.parquet"))
    for name in ("nation", "region"):
        spark.read.parquet(f"{DATA}/{name}.parquet").write.parquet(str(tmp_path / f"{name}.parquet"))
    spark.read.parquet(f"{DATA}/customer.parquet").withColumn("c_custkey", F.col("c_custkey") + 1 - F.lit(spark.read.parquet(f"{DATA}/customer.parquet").agg(F.min("c_custkey")).first()[0])).write.parquet(str(tmp_path / "customer.parquet"))
    every = tables.catalog(spark, str(tmp_path), details=False)
    ids = lambda df: sorted(r["item_id"] for r in df.collect())
    assert ids(every) == [1, 2, 3, 4, 5, 6, 7]
    assert ids(tables.catalog(spark, str(tmp_path), details=False, status=status)) == ids(every.where(F.col("status") == status))


def test_keys_first_is_the_same_order(spark):
    for order in ("recommend", "date-asc", "date-desc"):
        name = f"sort_{order.replace('-', '_')}_topk"
        want = ranking.top(tables.catalog(spark, DATA), order, 20).select("rank", "item_id", "title", C.mean_score().cast("double").alias("mean"))
        assert sorted(map(tuple, QUERIES[name](spark, DATA).select("rank", "item_id", "title", "mean").collect())) == sorted(map(tuple, want.collect()))


def test_one_fold_equals_four(spark):
    draw, rows = random.Random(4), []
    for seq in range(600):
        action = draw.choice(["toggle", "shelf_set", "shelf_clear", "rate", "rate_reset", "note", "invalid"])
        more = {"shelf_set": {"shelf_status": draw.choice(["playing", "finished"])}, "rate": {"dimension": draw.choice(DIMENSIONS), "score": C_score(draw)}, "note": {"note": draw.choice(["", "text"])}}.get(action, {})
        rows.append((seq, draw.randrange(4), draw.randrange(-1, 4), action, more))
    rows += draw.sample(rows, 200)  # delivered twice
    draw.shuffle(rows)
    events = log(spark, rows)
    items = frame(spark, [item(i, scores=(i + 1, None if i == 2 else 5, 6, 7)) for i in range(4)])
    parts = {"wishlist": shelf.wishlist_current(events), "shelf": shelf.shelf_current(events), "ratings": shelf.ratings_current(events, items), "notes": shelf.notes_current(events)}
    folded = state.fold(events)
    same = lambda a, b: sorted(map(str, a.select(*sorted(b.columns)).collect())) == sorted(map(str, b.select(*sorted(b.columns)).collect()))
    assert same(state.my_shelf(items, folded), shelf.my_shelf(items, **parts))
    assert same(state.shelf_stats(items, folded), shelf.shelf_stats(items, parts["wishlist"], parts["shelf"], parts["ratings"]))
    assert same(state.orphans(items, folded), shelf.orphans(items, **parts))
    assert same(state.documents(folded, items), shelf.state_documents(**parts))
    assert same(state.on_shelf(folded).select("user_id", "item_id"), shelf.personal_ids(parts["wishlist"], parts["shelf"]))


def C_score(draw):
    from decimal import Decimal

    return Decimal(draw.randrange(10, 100)) / 10


def test_divert_writes_once_and_counts_on_the_way(spark, tmp_path):
    items, _, rules, _ = queries._quality(spark, DATA)
    good, bad, counts = quality.divert(items, rules, str(tmp_path / "out"))
    assert {tuple(r) for r in quality.summary(items, rules).collect()} == set(counts)
    clean, rest = quality.publish(items, rules)
    ids = lambda df: sorted(r["item_id"] for r in df.select("item_id").collect())
    assert ids(good) == ids(clean) and ids(bad) == ids(rest) and good.columns == items.columns
    assert sum(len(r["broken"]) for r in bad.collect()) == quality.violations(items, rules, "item", "item_id").count()
    none = quality.divert(items.limit(0), rules, str(tmp_path / "none"))
    assert none[0].collect() == none[1].collect() == [] and all(c == f == 0 for _, c, f in none[2])


def test_documents_set_apart_and_written_by_bucket(spark, tmp_path):
    docs = spark.createDataFrame([(1, '{"wishlist":["3"],"shelf":{"3":"playing"}}'), (2, '{"wishlist":["3"'), (3, "{}"), (4, None), (5, "no json")], "user_id long, doc string")
    good, bad = shelf.set_apart(docs, str(tmp_path / "apart"))
    assert {r["user_id"]: (r["wishlist"], r["shelf"], r["ratings"], r["notes"]) for r in good.collect()} == {1: (["3"], {"3": "playing"}, {}, {}), 3: ([], {}, {}, {})}
    assert {tuple(r) for r in bad.collect()} == {(2, '{"wishlist":["3"'), (4, None), (5, "no json")}
    path = str(tmp_path / "state")
    shelf.write_state(docs, path, buckets=2)
    bucket = {r["user_id"]: r["b"] for r in docs.select("user_id", F.pmod(F.xxhash64("user_id"), F.lit(2)).alias("b")).collect()}
    again = [(u, "new") for u, b in bucket.items() if b == bucket[1]]
    shelf.write_state(spark.createDataFrame(again, "user_id long, doc string"), path, buckets=2)
    was = {r["user_id"]: r["doc"] for r in docs.collect()}
    assert {r["user_id"]: r["doc"] for r in shelf.read_state(spark, path).collect()} == {**was, **dict(again)}
