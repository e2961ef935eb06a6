"""URL filters: rules on host and path, and for all other URLs logistic regression on hashed character n-grams.

Host and path are cut by expressions of the JVM, and rules are decided there too: a rule
fits its host and all subdomains where the path starts with the rule's; the longest
fitting one wins.  The regression is trained on the driver from a small labelled table,
at most TRAIN_URLS rows of it.  Its features are the n-grams of three to five bytes of
the host between dots, and of the path, in two spaces of hash buckets; each part's are
scaled to length one, so that a long path doesn't drown the host.  A URL's score needs
nothing but the weights, so scoring is one pass without a shuffle.

Defined results: a URL that is null or has no `://` has an empty host and path; it fits
no rule, has score 0 and is allowed.  Of fitting rules of equal length the one with the
longer host wins, of equal rules the one listed first.  With no labelled rows every
other URL scores 0.5 and is allowed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BooleanType, DoubleType, StructField, StructType

from almanac.llm.text import buffers, mix, rolling, slices

BUCKETS = 1 << 15
SIZES = (3, 4, 5)
#: Rows of the labelled table that the regression is trained on: those with the smallest hashes.
TRAIN_URLS = 5000

# Names of sites that a crawl leaves out, by kind, and of sites that it keeps.
BLOCKED_NAMES = """
grand-casino casino-royal onlinecasino casinobonus lucky-slots pokerwins jackpot-win vegas-wins winbig spin-win
sports-bets betnow freebets best-bets betting-tips livebets
ad-server ads-click adtracker track-ads tracking-pixel clicktrack banner-ads popads
adult-videos adultcams xxx-adult hot-xxx porn-hd sexcams adult-dating
cheap-meds buy-pills cheap-viagra pharmapills online-pills diet-pills cheaprx
spam-links linkfarm seo-spam spammers content-farm link-farms spamblog
payday-cash free-money earncash cheap-loans free-iphones prizewinner keygen-crack warez-free fake-watches cheap-replica
""".split()
ALLOWED_NAMES = """
history thenews weather library university museum physics national thestation theatre station thestar
fashion education school garden recipes music travels bookshop gardening football chess nature
theorem relation thesis nations position creation edition thetheory thoughts another northern weather-maps
hospital railway maps science film-reviews health parliament cityhall sport culture economy politics
painting brand strings evening threads bread stables thinking kitchen gathering mathematics ethics
docs code-forum archive mailing-lists papers project languages open-data old-books river-guide city-news farmers
restore breathing heather thinner tonight stone ionosphere action-films fathers earthen thrones ableton
""".split()
# Both kinds stand in the same surroundings, so that only names tell them apart.
_PREFIXES = ("", "www.", "m.", "blog.", "shop.", "en.")
_ENDINGS = (".com", ".net", ".org", ".info", ".example.com", ".co.uk", ".example.net", ".de", ".example.org", ".fr")
_PATHS = ("/", "/en/{n}", "/index.html", "/de/{n}/", "/fr/{n}.html", "/article/{n}", "/es/{n}", "/a/b/{n}", "/en/{n}.html", "", "/page/{n}/", "/de/{n}", "/2019/05/{n}")


def example_urls() -> list[tuple[str, bool]]:
    """(url, blocked): a small labelled table, each name on three pages."""
    rows = [(name, blocked) for blocked, names in ((True, BLOCKED_NAMES), (False, ALLOWED_NAMES)) for name in names]
    surrounded = []
    for i, (name, blocked) in enumerate(row for row in rows for _ in range(3)):
        surrounded.append((f"https://{_PREFIXES[i * 5 % 6 if i % 2 else 0]}{name}{_ENDINGS[i * 7 % 10]}{_PATHS[i * 8 % 13].format(n=i * 37 % 9973)}", blocked))
    return surrounded


def labelled_urls(spark: SparkSession) -> DataFrame:
    """example_urls() as a table (url, blocked)."""
    return spark.createDataFrame(example_urls(), "url string, blocked boolean")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z in lower case) and path of a URL, both empty without `://`."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), "^[^?#]*", 0)
    lower = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(lower, F.lit("")), F.coalesce(path, F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """(rule, verdict) of the longest of the rules (verdict, host/path) that fits; null if none does."""
    found = None
    for verdict, rule in sorted(rules, key=lambda r: (-len(r[1]), -r[1].index("/"))):
        cut = rule.index("/")
        fits = F.endswith(F.concat(F.lit("."), host), F.lit(f".{rule[:cut]}")) & F.startswith(path, F.lit(rule[cut:]))
        value = F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))
        found = F.when(fits, value) if found is None else found.when(fits, value)
    return F.lit(None).cast("struct<rule:string,verdict:string>") if found is None else found


def _grams(part: pa.Array, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(url, bucket) of every n-gram of one part of URLs."""
    data, offsets = buffers(part)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    rows, found = [], []
    for n in SIZES:
        keys = rolling(data.astype(np.uint64), n)
        inside = row[: len(keys)] == row[n - 1 :] if len(keys) else np.zeros(0, bool)
        rows.append(row[: len(keys)][inside])
        found.append(mix(keys[inside] + np.uint64(seed * 8 + n)) % np.uint64(BUCKETS))
    return np.concatenate(rows), np.concatenate(found).astype(np.int64)


def features(host: pa.Array, path: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(url, bucket, value) of hashed n-grams; the values of each part have length one."""
    dotted = pa.array([f".{h}." if h else "" for h in host.to_pylist()], pa.large_string())
    rows, keys, values = [], [], []
    for seed, part in enumerate((dotted, path)):
        row, key = _grams(part, seed)
        both, n = np.unique(row * BUCKETS + key, return_counts=True)
        row, key = both // BUCKETS, both % BUCKETS
        length = np.sqrt(np.bincount(row, n.astype(float) ** 2, len(host)))
        rows, keys, values = [*rows, row], [*keys, key + seed * BUCKETS], [*values, n / length[row]]
    return np.concatenate(rows), np.concatenate(keys), np.concatenate(values)


def train(host: pa.Array, path: pa.Array, labels: np.ndarray, rounds: int = 400, rate: float = 0.1, decay: float = 1e-3) -> np.ndarray:
    """Weights of the buckets of host and path, and the bias last, by Adam on all rows at once."""
    weights = np.zeros(2 * BUCKETS + 1)
    if not len(labels):
        return weights
    row, key, value = features(host, path)
    mean, square = np.zeros_like(weights), np.zeros_like(weights)
    for t in range(1, rounds + 1):
        off = (_logistic(np.bincount(row, weights[key] * value, len(labels)) + weights[-1]) - labels) / len(labels)
        slope = np.append(np.bincount(key, off[row] * value, 2 * BUCKETS) + decay * weights[:-1], off.sum())
        mean, square = 0.9 * mean + 0.1 * slope, 0.999 * square + 0.001 * slope**2
        weights -= rate * mean / (1 - 0.9**t) / (np.sqrt(square / (1 - 0.999**t)) + 1e-8)
    return weights


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def fit(labelled: DataFrame) -> np.ndarray:
    """Weights from a labelled table (url, blocked); a row with a null in either teaches nothing."""
    host, path = host_and_path(F.col("url"))
    rows = labelled.where(F.col("url").isNotNull() & F.col("blocked").isNotNull()).select(host.alias("host"), path.alias("path"), F.col("blocked").cast("double").alias("y"))
    rows = rows.orderBy(F.xxhash64("host", "path"), "host", "path", "y").limit(TRAIN_URLS).collect()
    return train(pa.array([r["host"] for r in rows], pa.large_string()), pa.array([r["path"] for r in rows], pa.large_string()), np.array([r["y"] for r in rows]))


def url_verdicts(pages: DataFrame, rules: list[tuple[str, str]], labelled: DataFrame | None = None, keep: tuple[str, ...] = ("page_id",), url: str = "url", threshold: float = 0.5) -> DataFrame:
    """The kept columns of pages with host, path, rule, the regression's score that the URL is one to block, and the verdict."""
    spark = pages.sparkSession
    held = spark.sparkContext.broadcast(fit(labelled_urls(spark) if labelled is None else labelled))
    host, path = host_and_path(F.col(url).cast("string"))
    cut = pages.select(*keep, host.alias("_host"), path.alias("_path"))
    kept = len(keep)
    schema = StructType([*cut.schema.fields, StructField("_score", DoubleType()), StructField("_high", BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = to_arrow_schema(schema)
        for batch in batches:
            for a, b in slices(pc.binary_join_element_wise(batch.column(kept), batch.column(kept + 1), "")):
                part = batch.slice(a, b - a)
                at, to = part.column(kept), part.column(kept + 1)
                row, key, value = features(at, to)
                score = _logistic(np.bincount(row, held.value[key] * value, b - a) + held.value[-1])
                score[np.diff(buffers(at)[1]) + np.diff(buffers(to)[1]) == 0] = 0.0
                columns = [*part.columns, pa.array(score), pa.array(score > threshold)]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, out)], schema=out)

    judged = cut.mapInArrow(run, schema).withColumn("_rule", rule_of(F.col("_host"), F.col("_path"), rules))
    verdict = F.coalesce(F.col("_rule.verdict"), F.when(F.col("_high"), "block").otherwise("allow"))
    return judged.select(*keep, F.col("_host").alias("host"), F.col("_path").alias("path"), F.col("_rule.rule").alias("rule"), F.col("_score").alias("score"), verdict.alias("verdict"))
