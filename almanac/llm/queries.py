"""The queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from almanac.llm import centroids, jaccard, language_model, manifest, media, mixing, pieces, quality, repeats, repetition, token_counts, token_files, url_filters


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _tokenizer(name: str) -> str:
    """The place of a public tokenizer's file on this machine and the executors'."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken_words(mixing.plan_mix(_table(spark, sf_dir, "documents")))


def op2_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.lm_scores(_table(spark, sf_dir, "documents"), _tokenizer("word_bpe_49k.json"))


def op3_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(_table(spark, sf_dir, "documents"), k=3, percent=90).drop("_row")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(_table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"))


def op5_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.repetition_rules(_table(spark, sf_dir, "documents")).drop("longest_repeat")


def op6_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.piece_digests(_table(spark, sf_dir, "documents"), _tokenizer("piece_bpe_32k.model"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(_table(spark, sf_dir, "documents"))


def op8_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.repeat_digests(_table(spark, sf_dir, "documents"))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = token_files.token_files(_table(spark, sf_dir, "documents"), _tokenizer("word_bpe_49k.json"))
    return files.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op10_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    prints = media.fingerprints(media.recordings(_table(spark, sf_dir, "conversations")), "text", media.melodies)
    return media.search(prints, F.col("id") % 100 == 0).withColumnRenamed("id", "conv_id")


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster_vectors(_table(spark, sf_dir, "embeddings"))


def op12_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return manifest.proofs(manifest.build(docs, tampering=manifest.lower_text(docs)))


URL_RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]


def op13_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.url_verdicts(_table(spark, sf_dir, "pages"), URL_RULES)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mixing": op1_mixing,
    "op2_language_model": op2_language_model,
    "op3_jaccard": op3_jaccard,
    "op4_token_counts": op4_token_counts,
    "op5_repetition": op5_repetition,
    "op6_pieces": op6_pieces,
    "op7_quality": op7_quality,
    "op8_repeats": op8_repeats,
    "op9_token_files": op9_token_files,
    "op10_media": op10_media,
    "op11_centroids": op11_centroids,
    "op12_manifest": op12_manifest,
    "op13_url_filters": op13_url_filters,
}

#: H of columns as DuckDB has it: digests are hex text.
_LEAF = "sha256(" + " || ".join(f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')" for c in ("doc_id", "source", "lang", "n_chars", "{text}")) + ")"
_TAMPERED = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_CRC32 = """xor(list_reduce([4294967295] || list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT)),
  lambda c, b: list_reduce([xor(c, b)] || range(8), lambda v, i: xor(v >> 1, 3988292384 * (v & 1)))), 4294967295)"""


def _round(n: int) -> str:
    """Assignment n to the centroids c<n>, and the centroids after it."""
    return f"""
p{n} AS (SELECT id, k, CAST(sum((x - c) * (x - c)) AS BIGINT) AS distance FROM x JOIN c{n} USING (i) GROUP BY id, k),
a{n} AS MATERIALIZED (SELECT id, arg_min(k, distance * 64 + k) AS k, min(distance) AS distance FROM p{n} GROUP BY id),
m{n} AS (SELECT k, i, sum(x) AS s, count(*) AS n FROM x JOIN a{n} USING (id) GROUP BY k, i),
c{n + 1} AS MATERIALIZED (SELECT k, i, coalesce(CAST((s - ((s % n) + n) % n) // n AS BIGINT), c) AS c FROM c{n} LEFT JOIN m{n} USING (k, i))"""


_WORDS = "list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')"



def _repeats(name: str, least: int) -> str:
    """n<name>: the words of each document inside windows of `least` words found twice."""
    window = " || ' ' || ".join(f"lead(v, {i}) OVER o" for i in range(least))
    return f"""g{name} AS (SELECT doc_id, i, {window} AS s FROM v WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
r{name} AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS c FROM g{name} WHERE s IS NOT NULL) WHERE c > 1),
n{name} AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest(generate_series(i, i + {least - 1})) AS j FROM r{name}) GROUP BY doc_id)"""


ORACLE_SQL: dict[str, str] = {
    "op5_repetition": f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, {_WORDS} AS w FROM documents),
v AS MATERIALIZED (SELECT doc_id, unnest(w) AS v, unnest(generate_series(1, len(w))) AS i FROM d),
{_repeats("4", repetition.MIN_REPEAT)},
{_repeats("8", repetition.BASE_REPEAT)},
h AS (SELECT doc_id, w, unnest(generate_series(1, len(w) - {repetition.MAX_LONGEST})) AS i FROM d SEMI JOIN r8 USING (doc_id)),
l AS (SELECT DISTINCT doc_id FROM (SELECT doc_id, array_to_string(w[i:i + {repetition.MAX_LONGEST}], ' ') AS s FROM h) GROUP BY doc_id, s HAVING count(*) > 1),
b AS (SELECT doc_id, count(*) - count(DISTINCT s) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS s FROM d) WHERE regexp_matches(s, '[^\x20\x09-\x0D]') GROUP BY doc_id),
m AS (SELECT d.doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
  coalesce(b.n, 0) AS n_dup_lines, coalesce(n8.n, 0) AS n_repeat_words, coalesce(n4.n, 0) AS n_covered_words, l.doc_id IS NOT NULL AS has_long FROM d LEFT JOIN n8 USING (doc_id) LEFT JOIN n4 USING (doc_id) LEFT JOIN b USING (doc_id) LEFT JOIN l USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_covered_words, base_failed, NOT base_failed AND 100 * n_covered_words <= 30 * n_words AND NOT has_long AS kept
FROM (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)""",
    "op8_repeats": f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
g AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS s FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 12)) AS i FROM d)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY s) AS first FROM g) WHERE first < doc_id),
x AS (SELECT doc_id, list(DISTINCT j) AS x FROM (SELECT doc_id, unnest(generate_series(i, i + 12)) AS j FROM r) GROUP BY doc_id),
k AS (SELECT d.doc_id, len(w) AS n_words, coalesce(len(x), 0) AS n_removed, coalesce(w, []) AS w, coalesce(x, []) AS x FROM d LEFT JOIN x USING (doc_id)),
o AS (SELECT doc_id, string_agg(v, ' ' ORDER BY j) AS kept FROM (SELECT doc_id, unnest(w) AS v, unnest(generate_series(1, len(w))) AS j, x FROM k) WHERE NOT list_contains(x, j) GROUP BY doc_id)
SELECT k.doc_id, n_words, n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM k LEFT JOIN o USING (doc_id)""",
    "op11_centroids": f"""
WITH v AS (SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id), embedding) AS id, vec_id, embedding FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0),
x AS MATERIALIZED (SELECT id, i, CAST(floor(256 * CAST(embedding[i] AS DOUBLE)) AS BIGINT) AS x FROM (SELECT id, embedding, unnest(range(1, 65)) AS i FROM v)),
c0 AS MATERIALIZED (SELECT id - 1 AS k, i, x AS c FROM x WHERE id <= 40),{",".join(_round(n) for n in range(6))},
d AS (SELECT k, sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY i)) AS centroid_sha256 FROM c5 GROUP BY k)
SELECT vec_id, CAST(k AS INTEGER) AS cluster, distance, CAST(sum(distance) OVER (PARTITION BY k) AS BIGINT) AS cluster_inertia, CAST(sum(distance) OVER () AS BIGINT) AS inertia, centroid_sha256
FROM a5 JOIN v USING (id) JOIN d USING (k)""",
    "op12_manifest": f"""
WITH RECURSIVE leaf AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY source) AS n, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS s
  FROM (SELECT doc_id, source, {_LEAF.format(text="text")} AS leaf, CASE WHEN {_CRC32} % 5 = 0 THEN {_LEAF.format(text=_TAMPERED)} ELSE {_LEAF.format(text="text")} END AS start FROM documents)),
tree AS (SELECT s, 0 AS l, i, n, leaf AS h FROM leaf
  UNION ALL SELECT s, l + 1, i // 16, (n + 15) // 16, sha256(string_agg(h, '' ORDER BY i)) FROM tree WHERE n > 1 GROUP BY s, l, i // 16, n),
top AS (SELECT 0 AS l, s AS i, (SELECT count(DISTINCT s) FROM leaf) AS n, h FROM tree WHERE n = 1
  UNION ALL SELECT l + 1, i // 16, (n + 15) // 16, sha256(string_agg(h, '' ORDER BY i)) FROM top WHERE n > 1 GROUP BY l, i // 16, n),
depth AS (SELECT s, max(l) AS d, arg_max(h, l) AS subroot FROM tree GROUP BY s),
node AS MATERIALIZED (SELECT s, l, i, h, n FROM tree WHERE n > 1 UNION ALL SELECT z.s, d + l, i, h, top.n FROM top JOIN (SELECT s, d FROM depth) z ON true WHERE top.n > 1),
run AS MATERIALIZED (SELECT s, l, i // 16 AS r, list(h ORDER BY i) AS hs FROM node GROUP BY s, l, i // 16),
climb AS (SELECT doc_id, leaf, leaf.s, i, 0 AS l, d, start AS h, '' AS proof, subroot FROM leaf JOIN depth ON depth.s = leaf.s
  UNION ALL SELECT doc_id, leaf, c.s, p // 16, c.l + 1, d, sha256(array_to_string(hs[1:p % 16] || [h] || hs[p % 16 + 2:], '')), proof || array_to_string(hs[1:p % 16] || hs[p % 16 + 2:], ''), subroot
  FROM (SELECT *, CASE WHEN l = d THEN s ELSE i END AS p FROM climb) c JOIN run ON run.s = c.s AND run.l = c.l AND run.r = c.p // 16)
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, h AS folded_root, h = root AS verified
FROM (SELECT *, (SELECT arg_max(h, l) FROM top) AS root FROM climb) WHERE l = d + (SELECT max(l) FROM top)""",
}
