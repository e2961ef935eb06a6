"""Quality classifier from weak labels: heuristics vote, EM weighs them, a hashed linear scorer decides.

Heuristic labellers look at symbols, capitals, marks and repetition, and vote
good, bad or not at all.  Expectation-maximisation over the counts of vote
patterns estimates how often each labeller says bad of bad and of good documents;
only the counts reach the driver, one for each pattern of the few labellers.  The
posteriors of a sample of documents then train a logistic scorer over hashed
features of words: their shape, and whether a word or a pair of words has stood
before in the document.  The scorer decides on all documents by itself.

The sample has TRAIN_DOCS documents, those with the smallest hashes of doc_id and
text; the counts of votes cover all documents.

Defined results: a null, empty or blank text has score 0 and is not kept.  Equal
texts have equal scores.  With no documents to learn from, every document with
words scores 0.5 and is kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from almanac.llm.shared import per_slice
from almanac.llm.text import Words, mix, rolling, slices, words

#: Documents that the scorer is trained on, and its buckets.
TRAIN_DOCS = 4000
BUCKETS = 1 << 12
BAD, GOOD, SILENT = 1, 0, 2
LABELLERS = ("symbols", "bars", "capitals", "marks", "word ends", "words again", "pairs again")

_LOWER, _UPPER, _DIGIT = ord("a"), ord("A"), ord("0")
_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[ord("a") : ord("z") + 1] = _LOWER
_SHAPE[0x80:] = _LOWER
_SHAPE[ord("A") : ord("Z") + 1] = _UPPER
_SHAPE[ord("0") : ord("9") + 1] = _DIGIT
_SYMBOL = np.isin(np.arange(256), list(b"#*$%&|<>"))
_END = np.isin(np.arange(256), list(b".,;:?!)\"'")) | np.isin(_SHAPE, [_LOWER, _UPPER, _DIGIT])


def _again(keys: np.ndarray) -> np.ndarray:
    return pd.Series(keys).duplicated().to_numpy()


class Signs:
    """What labellers and scorer look at, for each word of a batch."""

    def __init__(self, cut: Words):
        self.cut, self.n = cut, cut.counts
        doc = cut.doc()
        own = mix(doc.astype(np.uint64))
        hashes = cut.hashes()
        self.again = _again(hashes + own)
        self.pair_again = np.zeros(len(hashes), bool)
        if len(hashes) > 1:
            pairs = rolling(hashes, 2) + own[:-1]
            self.pair_again[:-1] = _again(pairs) & (doc[1:] == doc[:-1])

    def sum(self, flags: np.ndarray) -> np.ndarray:
        """Flags of words, per document."""
        return np.diff(np.concatenate(([0], np.cumsum(flags)))[self.cut.bounds])

    def bytes(self, flags: np.ndarray) -> np.ndarray:
        """Flags of bytes, per document."""
        return np.diff(np.concatenate(([0], np.cumsum(flags)))[self.cut.offsets])

    def features(self) -> np.ndarray:
        """Three hashed features of each word: its shape, and repetition of it and of its pair."""
        cut = self.cut
        kinds = _SHAPE[cut.data]
        new = np.ones(len(kinds), bool)
        new[1:] = kinds[1:] != kinds[:-1]
        new[cut.start] = True
        upto = np.concatenate(([0], np.cumsum(new)))
        runs = Words(kinds[new], upto[cut.start], upto[cut.end], cut.bounds, cut.offsets)
        long = np.minimum(self.n, 1 << 12)[cut.doc()]
        size = np.log2(long + 1).astype(np.uint64)  # repetition grows with the document
        found = [runs.hashes(), mix(np.uint64(7) + self.again + np.uint64(2) * size), mix(np.uint64(99) + self.pair_again + np.uint64(2) * size)]
        return np.stack([(x % np.uint64(BUCKETS)).astype(np.int64) for x in found])

    def votes(self) -> np.ndarray:
        """Documents by labellers: BAD, GOOD or SILENT."""
        n = np.maximum(self.n, 1)
        data = self.cut.data
        upper, lower = self.bytes(_SHAPE[data] == _UPPER), self.bytes(_SHAPE[data] == _LOWER)
        ends = ~_END[data[self.cut.end - 1]] if len(self.cut.end) else np.zeros(0, bool)
        # (value, good up to, bad from, words needed to tell)
        rules = (
            (self.bytes(_SYMBOL[data]) / n, 0.05, 0.15, 3),
            (self.bytes(data == ord("|")) / n, 0.02, 0.1, 3),
            (upper / np.maximum(upper + lower, 1), 0.3, 0.6, 5),
            (self.bytes(data == ord("!")) / n, 0.1, 0.4, 3),
            (self.sum(ends) / n, 0.1, 0.4, 5),
            (self.sum(self.again) / n, 0.5, 0.75, 20),
            (self.sum(self.pair_again) / n, 0.2, 0.4, 20),
        )
        out = np.full((len(self.n), len(rules)), SILENT)
        for j, (value, good, bad, needed) in enumerate(rules):
            tells = self.n >= needed
            out[tells & (value <= good), j] = GOOD
            out[tells & (value >= bad), j] = BAD
        return out


def _code(votes: np.ndarray) -> np.ndarray:
    return votes @ 3 ** np.arange(len(LABELLERS))


def _decode(codes: np.ndarray) -> np.ndarray:
    return codes[:, None] // 3 ** np.arange(len(LABELLERS)) % 3


class LabelModel:
    """Prior and vote rates of bad and good documents, by EM over pattern counts."""

    def __init__(self, codes: np.ndarray, counts: np.ndarray, rounds: int = 100):
        votes = _decode(codes)
        says, tells = votes == BAD, votes != SILENT
        bad = np.where(says.any(axis=1), 0.9, 0.1)
        for _ in range(rounds):
            self.prior = float((counts @ bad + 1) / (counts.sum() + 2))
            self.rates = []
            for weight in (counts * bad, counts * (1 - bad)):
                self.rates.append((weight @ says + 0.5) / (weight @ tells + 1))
            self.rates[0] = np.maximum(self.rates[0], self.rates[1])  # no labeller is worse than chance
            now = self._bad(votes)
            if len(now) == 0 or np.abs(now - bad).max() < 1e-6:
                break
            bad = now

    def _bad(self, votes: np.ndarray) -> np.ndarray:
        says, quiet = votes == BAD, votes == GOOD
        bad, good = (says @ np.log(r) + quiet @ np.log(1 - r) for r in self.rates)
        odds = np.clip(np.log(self.prior) - np.log(1 - self.prior) + bad - good, -30, 30)
        return 1 / (1 + np.exp(-odds))

    def good(self, codes: np.ndarray) -> np.ndarray:
        """Posterior probability that documents with these votes are good."""
        return 1 - self._bad(_decode(codes))


def train_scorer(features: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, rounds: int = 300, rate: float = 0.3, keep: float = 1e-4) -> np.ndarray:
    """Weights of a logistic scorer with soft labels, the last one its bias, by Adam on the whole sample."""
    weights = np.zeros(BUCKETS + 1)
    if not features:
        return weights
    row = np.repeat(np.arange(len(features)), [len(f) for f, _ in features])
    column, value = np.concatenate([f for f, _ in features]), np.concatenate([v for _, v in features])
    mean, square = np.zeros_like(weights), np.zeros_like(weights)
    for t in range(1, rounds + 1):
        score = 1 / (1 + np.exp(-np.bincount(row, weights[column] * value, len(features)) - weights[-1]))
        off = (score - labels) / len(features)
        slope = np.append(np.bincount(column, off[row] * value, BUCKETS), off.sum()) + keep * weights / len(features)
        mean, square = 0.9 * mean + 0.1 * slope, 0.999 * square + 0.001 * slope**2
        weights -= rate * mean / (1 - 0.9**t) / (np.sqrt(square / (1 - 0.999**t)) + 1e-8)
    return weights


def fit(docs: DataFrame) -> np.ndarray:
    """Weights of the scorer for these documents."""
    votes = per_slice(docs, "code int", lambda texts: {"code": _code(Signs(words(texts)).votes())}, keep=())
    counts = votes.groupBy("code").count().collect()  # at most 3 ** len(LABELLERS)
    total = sum(r["count"] for r in counts)
    model = LabelModel(np.array([r["code"] for r in counts], np.int64), np.array([r["count"] for r in counts], float))

    def measure(texts: pa.Array) -> dict:
        signs = Signs(words(texts))
        found, bounds = signs.features(), signs.cut.bounds
        rows = [np.unique(found[:, a:b], return_counts=True) for a, b in zip(bounds, bounds[1:])]
        return {"code": _code(signs.votes()), "buckets": [f.astype("<u2").tobytes() for f, _ in rows], "counts": [c.astype("<u4").tobytes() for _, c in rows]}

    key = F.xxhash64(F.col("doc_id").cast("string"), "text")
    limit = -(1 << 63) + min((1 << 64) - 1, int((1 << 64) * 1.2 * TRAIN_DOCS / max(total, 1)))
    few = docs.select("doc_id", "text", key.alias("key")).where(F.col("key") <= limit)
    sample = per_slice(few, "code int, buckets binary, counts binary", measure, keep=("key",)).orderBy("key", "code").limit(TRAIN_DOCS).collect()
    features = []
    for r in sample:
        n = np.frombuffer(r["counts"], "<u4").astype(float)
        features.append((np.frombuffer(r["buckets"], "<u2").astype(np.int64), 3 * n / max(n.sum(), 1)))
    return train_scorer(features, model.good(np.array([r["code"] for r in sample], np.int64)) if sample else np.zeros(0))


def _scores(signs: Signs, weights: np.ndarray) -> np.ndarray:
    """The scorer's probability that each document is good; 0 without words."""
    sums = np.diff(np.concatenate(([0], np.cumsum(weights[signs.features()].sum(axis=0))))[signs.cut.bounds])
    return np.where(signs.n > 0, 1 / (1 + np.exp(-sums / np.maximum(signs.n, 1) - weights[-1])), 0.0)


def quality_scores(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), threshold: float = 0.5) -> DataFrame:
    """The kept columns of docs, n_words, the scorer's score, and whether it reaches the threshold."""
    held = docs.sparkSession.sparkContext.broadcast(fit(docs))

    def measure(texts: pa.Array) -> dict:
        signs = Signs(words(texts))
        score = _scores(signs, held.value)
        return {"n_words": signs.n, "score": score, "kept": score >= threshold}

    return per_slice(docs, "n_words long, score double, kept boolean", measure, keep)


def keep_good(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The documents that the classifier keeps, with docs' columns."""
    held = docs.sparkSession.sparkContext.broadcast(fit(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column(at)):
                part = batch.slice(a, b - a)
                signs = Signs(words(part.column(at)))
                yield part.filter(pa.array((signs.n > 0) & (_scores(signs, held.value) >= threshold)))

    at = docs.columns.index("text")
    return docs.mapInArrow(run, docs.schema)
