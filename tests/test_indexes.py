"""Stored catalog, trigram index and bitmaps against scans of the catalog, and what they read."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from almanac.operators import bitmaps, predicates, trigrams
from almanac.sources import tables
from almanac.sources.stored import store_catalog

from test_fixtures import frame, item

DATA = "/root/testdata/sf0.001"
QUERIES = ["ring", "RING", "ing", "in", "g", " a ", "%", "_", "a_c", "x  y", "日本", "本", "😀", "b😀c", "ab", "zzz", "zz", "le 2o", "brand#1", "ÉTÉ", "aaa", "aaaa", "aaaaa", "\0", "a\0"]


def plan(df) -> str:
    return df._jdf.queryExecution().toString()


@pytest.fixture(scope="module")
def odd(spark):
    rows = [item(1, title="The Ring"), item(2, title="100% pure"), item(3, developer="A_C", title=None), item(4, country="x  y"), item(5, genres=["other", "String", None], title=""), item(6, genres=None, title="日本語"), item(7, title="b😀cd"), item(8, title="aa"), item(9, title="aaaa"), item(10_000, title="été ab"), item(10_001, title="zz", genres=[]), item(-5, title="bring in"), item(3, title="again three a_c"), item(None, title="no id ring")]
    return frame(spark, [{**r, "ordinal": i} for i, r in enumerate(rows)])


@pytest.mark.parametrize("few", [0, 1000])
def test_search_equals_the_predicate(spark, odd, tmp_path, few):
    stored = store_catalog(odd, str(tmp_path / "catalog"), width=100)
    trigrams.build(odd, str(tmp_path / "grams"), chunk=4)
    for query in [*QUERIES, "", "　"]:
        want = predicates.select_items(odd.where("item_id IS NOT NULL"), query=query)
        got = trigrams.search(spark, str(tmp_path / "grams"), stored, query, few=few)
        assert sorted(r["ordinal"] for r in got.collect()) == sorted(r["ordinal"] for r in want.collect()), query


def test_search_of_random_keywords(spark, tmp_path):
    catalog = tables.catalog(spark, DATA)
    stored = store_catalog(catalog, str(tmp_path / "catalog"), width=256)
    trigrams.build(stored.items(spark), str(tmp_path / "grams"), chunk=128)
    draw, texts = random.Random(5), [t for r in catalog.select("title", "developer", "publisher", "country").collect() for t in r if t]
    for _ in range(6):
        text = draw.choice(texts)
        at = draw.randrange(len(text))
        query = text[at : at + draw.randrange(1, 9)]
        want = predicates.select_items(catalog, query=query).select("item_id")
        got = trigrams.search(spark, str(tmp_path / "grams"), stored, query).select("item_id")
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())), query


def test_search_reads_candidates_only(spark, tmp_path):
    rows = [item(i, title=f"title number {i}") for i in range(2000)] + [item(1234, title="a needle here")]
    catalog = frame(spark, [{**r, "ordinal": i} for i, r in enumerate(rows)])
    stored = store_catalog(catalog, str(tmp_path / "catalog"), width=100)
    trigrams.build(catalog, str(tmp_path / "grams"), chunk=64)
    lists = spark.read.parquet(str(tmp_path / "grams"))
    assert lists.agg(F.max(F.size("ids"))).first()[0] <= 64
    assert sorted(r[0] for r in trigrams.candidates(spark, str(tmp_path / "grams"), "needle").collect()) == [1234]
    found = trigrams.search(spark, str(tmp_path / "grams"), stored, "needle")
    assert [r["title"] for r in found.collect()] == ["a needle here"]
    assert "PartitionFilters: [isnotnull(part" in plan(found) and "(part#" in plan(found)
    assert "PushedFilters: [In(gram, [dle,edl,eed,nee])]" in plan(trigrams.candidates(spark, str(tmp_path / "grams"), "needle"))
    parts = {r[0].split("part=")[1].split("/")[0] for r in stored.some(spark, [1234]).select(F.input_file_name()).collect()}
    assert parts == {"12"}


def test_grams_are_cut_once_a_value(spark, tmp_path):
    sizes = {}
    for n in (10, 1000):
        rows = [item(i, title="One Title", developer="maker" if i % 2 else "MAKER", genres=["other", "One title"]) for i in range(n)]
        trigrams.build(frame(spark, [{**r, "ordinal": i} for i, r in enumerate(rows)]), str(tmp_path / f"{n}"), chunk=64)
        sizes[n] = spark.read.parquet(str(tmp_path / f"{n}")).agg(F.sum(F.size("ids"))).first()[0]
        for few in (None, 0, 1000):
            found = trigrams.candidates(spark, str(tmp_path / f"{n}"), "one t", few)
            assert sorted(r[0] for r in found.collect()) == list(range(n))
    assert sizes[10] == sizes[1000]  # lists hold values, however many items share them
    text = "日b😀c" * 300
    cut = spark.createDataFrame([(text,), ("",), (None,), ("A",)], "t string").select(trigrams.grams(F.col("t"))).collect()
    assert cut[0][0] == [(text + "\0\0")[i : i + 3] for i in range(1200)] and [r[0] for r in cut[1:]] == [[], [], ["a\0\0"]]


def test_lookup_reads_one_part_and_sorts_nothing(spark, tmp_path):
    catalog = tables.catalog(spark, DATA)
    stored = store_catalog(catalog, str(tmp_path / "catalog"), width=100)
    for key in (3, 777, -1, 10**9):
        got = stored.lookup_or_first(spark, key).drop("platforms", "genres").collect()
        want = predicates.lookup_or_first(catalog, key).drop("platforms", "genres").collect()
        assert [r.asDict() for r in got] == [r.asDict() for r in want]
    shown = plan(stored.lookup_or_first(spark, 777)).split("== Physical Plan ==")[1]
    assert "Sort" not in shown.replace("SortAggregate", "") and "EqualTo(item_id,777)" in shown and "part#" in shown
    empty = store_catalog(catalog.limit(0), str(tmp_path / "none"))
    assert empty.lookup_or_first(spark, 3).collect() == [] and empty.items(spark).collect() == []
    trigrams.build(empty.items(spark), str(tmp_path / "grams"))
    assert trigrams.search(spark, str(tmp_path / "grams"), empty, "ring").collect() == []


def test_storing_computes_the_catalog_once(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def named(x):
        seen.add(1)
        return f"title {x}"

    catalog = frame(spark, [{**item(i), "ordinal": o} for i, o in zip((*range(500), 7, -5, None), (*range(3, 503), 2, None, 1))])
    stored = store_catalog(catalog.withColumn("title", named("item_id")), str(tmp_path / "catalog"), width=100)
    assert seen.value == 502  # once an item with an id
    assert [r["ordinal"] for r in spark.read.parquet(f"{stored.path}/first").collect()] == [2]
    rows = stored.items(spark).select("part", "item_id", F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("at")).collect()
    assert sorted(r["item_id"] for r in rows) == sorted([*range(500), 7, -5]) and all(r["part"] == r["item_id"] // 100 for r in rows)
    for file in {r["file"] for r in rows}:
        ids = [r["item_id"] for r in sorted(rows, key=lambda r: r["at"]) if r["file"] == file]
        assert ids == sorted(ids)


def test_bitmap_counts_equal_scans(spark, odd, tmp_path):
    rows = [item(i, platforms=p, region=r, status=s) for i, (p, r, s) in enumerate([(None, "ASIA", "released"), (["AF", "NO"], "EUROPE", "released"), (["NO"], None, "upcoming"), ([], "ASIA", None), (["AF"], "ASIA", "released"), (["AF", "AF", None], "EUROPE", "development")])]
    catalog = frame(spark, [{**r, "ordinal": o} for r, o in zip(rows, (0, 1, 32_768, 32_769, 70_000, -3))])
    bitmaps.build(catalog, str(tmp_path / "bits"))
    index = spark.read.parquet(str(tmp_path / "bits"))
    for status in (None, "all", "released", "upcoming", "none"):
        for region in ("", "ASIA", "EUROPE"):
            for platform in (None, "AF", "NO"):
                filters = {"status": status, "region": region, "platform": platform}
                assert bitmaps.result_counts(index, **filters).first() == predicates.result_counts(catalog, **filters).first(), filters
    both = bitmaps.result_counts(index, status=["released", "upcoming"], region="ASIA").first()
    assert both["shown"] == catalog.where("status IN ('released', 'upcoming') AND region = 'ASIA'").count()
    found = bitmaps.of_items(catalog.where("ordinal IN (1, 70000, -3)"))
    assert bitmaps.result_counts(index, found, status="released").first() == (2, 6)
    counts = lambda df: {tuple(r) for r in df.collect()}
    assert counts(bitmaps.facet_counts(index, "region", found)) == {("all", 3), ("ASIA", 1), ("EUROPE", 2)}
    assert counts(bitmaps.facet_counts(index, "platform", status="released")) == {("all", 3), ("AF", 2), ("NO", 1)}
    assert counts(bitmaps.facet_counts(index, "status")) == {("all", 6), ("released", 3), ("upcoming", 1), ("development", 1)}
    assert bitmaps.result_counts(index.limit(0)).first() == (0, 0)
    with pytest.raises(ValueError):
        bitmaps.result_counts(index, colour="red")


def test_bitmap_counts_scan_no_catalog(spark, tmp_path):
    bitmaps.build(tables.catalog(spark, DATA), str(tmp_path / "bits"))
    shown = plan(bitmaps.result_counts(spark.read.parquet(str(tmp_path / "bits")), status="released"))
    assert "orders" not in shown and "PushedFilters: [Or(EqualTo(facet,all)" in shown
