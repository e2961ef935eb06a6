"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns, for every operator and stage."""

from __future__ import annotations

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from almanac.llm import jaccard, language_model, media, mixing, pieces, quality, repeats, repetition, token_counts, token_files

LONG = " ".join(f"word{i % 977}x{i % 89}" for i in range(30_000))
TEXT = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen"
ROWS = [(0, TEXT, "en", "a", 1), (0, TEXT, "en", "a", 1), (1, None, None, None, None), (2, "", "en", "b", 0), (3, " \n\t ", "en", "b", 4), (None, TEXT, "en", "c", 9), (None, None, None, None, None), (4, "x", "en", "a", 1), (5, LONG, "de", "b", 9), (6, TEXT + " more", "en", "", 3), (6, "other text under one id", "en", "a", 3), (7, "É ß 日本 🙂 <|endoftext|> it's", "fr", "a", 5)]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = ["_id", "_row", "_key", "_pattern", "size", "node", "n", "flags", "anchors", "doc", "words", "key", "kept", "score", "n_words", "ids", "hub", "_times", "word"]


def fixture(spark, rows=ROWS, clash=True):
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    return docs.withColumns({c: F.lit(f"own {c}") for c in CLASH}) if clash else docs


def path(name):
    return public_tokenizers.path(name)


OPERATORS = {
    "mixing": lambda d: mixing.taken_words(mixing.plan_mix(d)),
    "language model": lambda d: language_model.lm_scores(d, path("word_bpe_49k.json")),
    "jaccard": lambda d: jaccard.near_duplicates(d),
    "token counts": lambda d: token_counts.token_counts(d, path("byte_bpe_50k.json")),
    "repetition": lambda d: repetition.repetition_rules(d),
    "pieces": lambda d: pieces.piece_digests(d, path("piece_bpe_32k.model")),
    "quality": lambda d: quality.quality_scores(d),
    "repeats": lambda d: repeats.repeat_digests(d),
    "token files": lambda d: token_files.token_files(d, path("word_bpe_49k.json")),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_a_row_for_each_row(spark, name):
    found = OPERATORS[name](fixture(spark)).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in found) == sorted((r[0] is None, r[0] or 0) for r in ROWS)


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, name):
    assert OPERATORS[name](fixture(spark, [])).collect() == []


@pytest.mark.parametrize("stage", [s for s, _ in corpus_pipeline.STAGES[:-1]])
def test_stages_keep_columns_and_values(spark, stage):
    docs = fixture(spark)
    found = dict(corpus_pipeline.STAGES)[stage](spark, docs, "")
    assert found.columns == docs.columns
    for r in found.collect():
        assert all(r[c] == f"own {c}" for c in CLASH)
    assert dict(corpus_pipeline.STAGES)[stage](spark, fixture(spark, []), "").collect() == []


def test_last_stage(spark):
    assert len(dict(corpus_pipeline.STAGES)["SentencePiece"](spark, fixture(spark), "").collect()) == len(ROWS)


def test_media_edges(spark):
    rows = [(1, 0, "user", None), (1, 1, "user", "a b"), (2, 0, None, ""), (3, 0, "user", TEXT), (3, 0, "user", TEXT), (None, 0, "user", "x"), (100, 0, "user", TEXT + " " + TEXT)]
    talk = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").withColumns({c: F.lit(1) for c in ("id", "key", "frames")})
    found = {r["id"]: r for r in media.search(media.fingerprints(media.recordings(talk), "text", media.melodies), F.col("id") % 100 == 0).collect()}
    assert set(found) == {1, 2, 3, 100}
    assert found[2]["n_frames"] == 0 and found[2]["n_links"] == 0
    # A repeated turn is heard twice, so that 3 sounds like 100: one class, which doesn't link with itself.
    assert found[3]["class_id"] == found[100]["class_id"] == 3 and found[3]["n_links"] == 0
    assert media.search(media.fingerprints(media.recordings(talk.limit(0)), "text", media.melodies), F.col("id") % 100 == 0).collect() == []


def test_defined_results(spark):
    docs = fixture(spark, clash=False)
    sizes = {(r["doc_id"], r["size"]): r for r in mixing.taken_words(mixing.plan_mix(docs)).collect()}
    assert sizes[(1, 0)]["taken"] == 0 and all(r["taken"] <= 2 * r["size"] for r in sizes.values())
    same = jaccard.near_duplicates(docs).collect()
    assert {r["component_id"] for r in same if r["doc_id"] in (0, 6) and r["n_shingles"] > 5} == {0}
    assert all(r["component_id"] == r["doc_id"] for r in same if r["n_shingles"] == 0)
    cut = {(r["doc_id"], r["n_words"]): r["n_removed"] for r in repeats.repeat_digests(docs).collect()}
    assert cut[(0, 15)] == 0 and cut[(None, 15)] == 15 and cut[(6, 16)] == 15 and cut[(1, 0)] == 0
    kept = {r["doc_id"]: r["kept"] for r in quality.quality_scores(docs).collect()}
    assert not kept[1] and not kept[2] and not kept[3]
    files = sorted(token_files.token_files(docs, path("word_bpe_49k.json")).collect(), key=lambda r: r["start"])
    assert [r["start"] for r in files] == [sum(r["n_tokens"] for r in files[:i]) for i in range(len(files))]
    assert [r["doc_id"] for r in files][-2:] == [None, None] and files[-1]["n_tokens"] + files[-2]["n_tokens"] == 1 + 1 + files[0]["n_tokens"] - 1
