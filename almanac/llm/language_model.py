"""Scores of a small causal self-attention language model, beside a unigram baseline.

The model reads subword ids of a tokenizers file; every id of it is a class of its own, with
its own vector and its own counts.  The most frequent ones, of all documents that are not held
out, that stand in the same texts, some ids apart, form groups, by singular vectors; a rarer
one joins the group that stands among the same ids.  One attention layer with learned biases
by distance and one hidden layer predict the group of the next class, as what they add to how
often that group follows the last class; in the group, classes have their smoothed frequencies
after the last class.  A document is cut into blocks; each block attends to itself and to
the block before it under a causal mask, so the context windows overlap and every id
is scored once.  Blocks of many documents are scored together.

Counts of pairs of frequent classes (CLASSES) are one table that is broadcast.  All other pairs
would have no bound there: they meet in a shuffle by pair, as rare words do, and what they
add to the scores returns by document.

Counts of ids and of class pairs cover all training documents, and training, plain
numpy (Adam), passes over all of their blocks.  It has ROUNDS rounds, each with its own
part of the documents: shards of about SHARD_DOCS documents, dealt by hash, train at
once from the same weights, and their weights and moments are averaged by blocks.
Sums over partitions meet in a shuffle by slice of the vector, so no task holds more
than a slice and what comes in.

The baseline needs the count of every word in all training documents.  Frequent
words (HEAD, as in HEAD_DOCS documents; any choice gives the same counts) are added up in
each partition and return to all documents in a broadcast of HEAD numbers.  All
other words meet in a shuffle by word, and their contributions return in another
by document, summed over all words of a partition first.

Defined results: a null or empty text is the end token alone.  Repeated rows are
scored each.  A null doc_id isn't held out.  An empty table gives no rows.
"""

from __future__ import annotations

import copy
import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from almanac.llm.encoding import lower_runs
from almanac.llm.shared import add_up, as_slices, written
from almanac.llm.text import slices, words
from almanac.llm.token_files import forget_words, vocabulary, word_memo

#: Rounds of the pass over all training documents, and documents in a shard.
ROUNDS = 4
SHARD_DOCS = 16_000
#: Ids that a shard's blocks are made of at a time, and blocks in a step.
CHUNK = 1 << 18
BATCH = 256
#: Frequent words whose counts are broadcast, and the documents that say which they are.
HEAD = 1 << 16
HEAD_DOCS = 3000
#: Slices of the vectors that are added up over partitions.
SLICES = 64
BLOCK = 16
GROUPS = 32
#: Places for frequent ids, whose pairs are counted in one table; the classes of all other ids come after them.
CLASSES = 1600
#: Columns that frequent classes are dealt to, to tell what stands beside rarer ones.
COLUMNS = 32
WIDTH = 8
HIDDEN = 16
#: Logarithm of sums of exponentials from which on the maximum is subtracted first, lest these leave the range of 32 bits.
STEEP = 60.0
#: Distances at which classes of one text are counted, for groups.
APART = (4, 8)
#: Weight of the frequencies without the last class.
SMOOTH = 20.0


def like_groups(near: np.ndarray, n_groups: int) -> np.ndarray:
    """Order of classes such that equal slices of it are groups with like neighbours.

    near: how often one class stands near another.  Halves by the median of one
    singular vector after the other.
    """
    scaled = np.log1p(near) - np.log1p(near.sum(axis=1, keepdims=True)) / 2 - np.log1p(near.sum(axis=0, keepdims=True)) / 2
    left, _, right = np.linalg.svd(scaled, full_matrices=False)
    parts, depth = [np.arange(len(near))], 0
    while len(parts) < n_groups and depth < 12:
        by = (left if depth % 2 == 0 else right.T)[:, depth // 2]
        parts = [half for part in parts for half in np.array_split(part[np.argsort(by[part], kind="stable")], 2)]
        depth += 1
    return np.concatenate(parts)


def id_counts(ids: np.ndarray, bounds: np.ndarray, size: int) -> np.ndarray:
    """How often each id occurs; the end id, `size`, once a text."""
    counts = np.bincount(ids, minlength=size + 1).astype(float)
    counts[size] = len(bounds) - 1
    return counts


def first_classes(counts: np.ndarray) -> np.ndarray:
    """Of each id: 0 for the rarer ones, else its number in the tables of frequent ones."""
    own = np.union1d(np.argsort(-counts, kind="stable")[: CLASSES - 2], [len(counts) - 1])
    first = np.zeros(len(counts), np.int64)
    first[own] = 1 + np.arange(len(own))
    return first


def follows(first: np.ndarray, ids: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """For each time that one class follows another, its place in a table of them; the end id stands before and after each text."""
    read = first[np.insert(ids, bounds, len(first) - 1)]  # the end id stands before, between and after texts
    return read[:-1] * CLASSES + read[1:]


def apart(first: np.ndarray, ids: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """For each time that one class stands APART from another in a text, its place in a table of them."""
    read, doc = first[ids], np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    return np.concatenate([(read[:-d] * CLASSES + read[d:])[doc[:-d] == doc[d:]] for d in APART])


def columns_beside(first: np.ndarray, ids: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """For each time that a rarer id stands APART from a class, before or after it: the place of the id and the class's column in a table of them."""
    read, doc, found = first[ids], np.repeat(np.arange(len(bounds) - 1), np.diff(bounds)), []
    rare = np.flatnonzero(read == 0)
    for d in (*APART, *(-d for d in APART)):
        at = rare[(rare + d >= 0) & (rare + d < len(ids))]
        at = at[doc[at] == doc[at + d]]
        found.append(ids[at].astype(np.int64) * COLUMNS + read[at + d] % COLUMNS)
    return np.concatenate(found)


def rare_pairs(first: np.ndarray, ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of ids in a row, ends too, one of which is a rarer one: both, and the document of the second."""
    read = np.insert(ids, bounds, len(first) - 1).astype(np.int64)
    rare = first[read] == 0
    at = np.flatnonzero(rare[:-1] | rare[1:])
    return read[at], read[at + 1], np.searchsorted(bounds[:-1] + np.arange(len(bounds) - 1), at, "right") - 1


def classes_and_groups(first: np.ndarray, near: np.ndarray, columns: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order of frequent classes, the class of each id, and the group of each class. columns: the table of columns_beside()."""
    n, rare, near = CLASSES, np.flatnonzero(first == 0), near.reshape(CLASSES, CLASSES).astype(np.float32)
    order = like_groups(near, GROUPS)
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    classes = place[first]
    classes[rare] = n + np.arange(len(rare))
    among = ((near + near.T) @ np.eye(COLUMNS, dtype=np.float32)[np.arange(n) % COLUMNS])[order].reshape(GROUPS, -1, COLUMNS).sum(axis=1) + 1
    likely = columns.reshape(-1, COLUMNS)[rare] @ np.log(among / among.sum(axis=1, keepdims=True)).T
    return order, classes, np.concatenate((np.repeat(np.arange(GROUPS), n // GROUPS), likely.argmax(axis=1)))


def add_rows(at: np.ndarray, x: np.ndarray, n: int) -> np.ndarray:
    """Sums of the rows of x by their places."""
    width = x.shape[1]
    return np.bincount((at + n * np.arange(width)[:, None]).ravel(), x.T.ravel(), n * width).reshape(width, n).T


def steep(total: np.ndarray) -> bool:
    """Whether a sum of exponentials is so large or small, or lost, that the maximum has to be subtracted first."""
    return len(total) > 0 and not (math.exp(-STEEP) < total.min() and total.max() < math.exp(STEEP))


def falling(done: float, rate: float = 0.01) -> float:
    return rate * (1 - 0.95 * done)


class Adam:
    """Moments of a model's gradient."""

    def __init__(self, w: dict):
        self.mean, self.square, self.t = {k: np.zeros_like(x) for k, x in w.items()}, {k: np.zeros_like(x) for k, x in w.items()}, 0

    def step(self, w: dict, g: dict, speed: float, rows: np.ndarray) -> None:
        """rows: those of the classes' vectors that g is about; the others stay as they are."""
        self.t += 1
        for k, x in g.items():
            mean, square = self.mean[k], self.square[k]
            if k == "in":
                mean, square = mean.take(rows, axis=0), square.take(rows, axis=0)
            mean += 0.1 * (x - mean)
            square += 0.01 * (x * x - square)
            by = (speed * (mean / (1 - 0.9**self.t)) / (np.sqrt(square / (1 - 0.99**self.t)) + 1e-8)).astype(np.float32)
            if k == "in":
                self.mean[k][rows], self.square[k][rows], w[k][rows] = mean, square, w[k].take(rows, axis=0) - by
            else:
                w[k] -= by


class Model:
    """Weights and classes; score() gives the log10 probability of each text."""

    def __init__(self, ids: np.ndarray, bounds: np.ndarray, size: int, seed: int = 7):
        """ids: those to learn classes from; size: ids that the tokenizer has; one more ends a text."""
        counts = id_counts(ids, bounds, size)
        first = first_classes(counts)
        follow, near, columns = (np.bincount(f(first, ids, bounds), minlength=n).astype(float) for f, n in ((follows, CLASSES**2), (apart, CLASSES**2), (columns_beside, len(first) * COLUMNS)))
        order, self.classes, self.group = classes_and_groups(first, near, columns)
        a, b, _ = rare_pairs(first, ids, bounds)
        more = np.bincount(self.classes[a] * GROUPS + self.group[self.classes[b]], minlength=len(self.group) * GROUPS)
        self.build(counts, order, follow, more, seed)
        self.pairs = np.unique(self.classes[a] * len(self.group) + self.classes[b], return_counts=True)

    @classmethod
    def of(cls, counts: np.ndarray, placed: tuple[np.ndarray, np.ndarray, np.ndarray], follow: np.ndarray, more: np.ndarray, seed: int = 7) -> Model:
        """From id_counts(), classes_and_groups() and the table of follows() of all documents, and how often a group follows a class in rare_pairs().

        What likelihood() gives for such a pair is then without frequency(), for which the pair's count is needed.
        """
        model = cls.__new__(cls)
        order, model.classes, model.group = placed
        model.pairs = None
        model.build(counts, order, follow, more, seed)
        return model

    def build(self, counts: np.ndarray, order: np.ndarray, follow: np.ndarray, more: np.ndarray, seed: int) -> None:
        size, n, every = len(counts) - 1, CLASSES, len(self.group)
        self.end = size
        self.inside = np.zeros(size + 1, np.float32)  # log share of an id in its class: all of it
        # Frequencies of groups after a class, and of classes of a group after a class.
        share = np.bincount(self.classes, counts, every)
        rare = share[n:]
        share = np.concatenate((share[:n] + 0.1, (rare.sum() + 0.1) * (rare + 0.5) / (rare + 0.5).sum()))
        group = np.bincount(self.group, share, GROUPS)
        self.within = share / group[self.group]
        after = follow.reshape(n, n).copy()
        after[0], after[:, 0] = 0, 0  # rarer ids, which are in `more`
        after = after[np.ix_(order, order)]
        groups = more.reshape(every, GROUPS).astype(float)
        groups[:n] += after.reshape(n, GROUPS, -1).sum(axis=2)
        self.lead = np.log((groups + SMOOTH * group / group.sum()) / (groups.sum(axis=1, keepdims=True) + SMOOTH)).astype(np.float32)
        self.mass = np.log(groups + SMOOTH).astype(np.float32)
        self.step = (np.log(after + SMOOTH * self.within[:n]) - np.repeat(self.mass[:n], n // GROUPS, axis=1)).astype(np.float32)
        rng = np.random.default_rng(seed)
        draw = lambda *shape, by: (rng.standard_normal(shape) * by).astype(np.float32)
        self.w = {
            "in": draw(n, WIDTH, by=0.5), "qkv": draw(WIDTH, 3 * WIDTH, by=WIDTH**-0.5), "near": np.zeros(2 * BLOCK, np.float32), "mix": draw(WIDTH, WIDTH, by=WIDTH**-0.5),
            "up": draw(WIDTH, HIDDEN, by=WIDTH**-0.5), "up0": np.zeros(HIDDEN, np.float32), "down": draw(HIDDEN, WIDTH, by=HIDDEN**-0.5),
            "group": np.concatenate((draw(WIDTH, GROUPS, by=0.02), np.zeros((1, GROUPS), np.float32))),
        }
        self.w["in"] = np.concatenate((self.w["in"], draw(every - n, WIDTH, by=0.05)))
        at = np.arange(BLOCK)
        distance = at[:, None] - np.arange(-BLOCK, BLOCK)[None, :]
        self.distance, self.future = np.clip(distance, 0, 2 * BLOCK - 1), distance < 0

    @staticmethod
    def windows(x: np.ndarray, columns: slice) -> np.ndarray:
        """Columns of x by blocks, each with the one before it; x has a block more in front."""
        part = x[:, columns]
        return np.ndarray((len(x) // BLOCK - 1, 2 * BLOCK, part.shape[1]), x.dtype, x, columns.start * x.itemsize, (BLOCK * x.strides[0], *x.strides))

    def attend(self, qkv: np.ndarray, near: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Exponentials for the keys of a block and the one before, and the sums of values and ones weighed by them.

        qkv: scaled queries, keys, values and a one of all ids, after a block that is not seen; first: blocks without one before.
        """
        q, k, v = qkv[BLOCK:, :WIDTH].reshape(-1, BLOCK, WIDTH), self.windows(qkv, slice(WIDTH, 2 * WIDTH)), self.windows(qkv, slice(2 * WIDTH, None))
        for once in (False, True):
            a = q @ k.transpose(0, 2, 1)
            a += near
            a[first, :, :BLOCK] = -1e9
            if once:
                a -= a.max(axis=2, keepdims=True)
            with np.errstate(over="ignore", invalid="ignore"):
                np.exp(a, out=a)
                c = (a @ v).reshape(-1, WIDTH + 1)
            if not steep(c[:, WIDTH]):
                break
        return a, c

    def near(self) -> np.ndarray:
        return np.where(self.future, np.float32(-1e9), self.w["near"][self.distance])

    def scaled(self) -> np.ndarray:
        """Weights of scaled queries, keys and values."""
        found = self.w["qkv"].copy()
        found[:, :WIDTH] *= WIDTH**-0.5
        return found

    def forward(self, given: np.ndarray, first: np.ndarray) -> dict:
        """given: classes of consecutive blocks; first: those that don't see the one before."""
        w, s = self.w, given.shape[1]
        x = w["in"].take(given.ravel(), axis=0)
        qkv = np.zeros((len(x) + s, 3 * WIDTH + 1), x.dtype)
        scaled = self.scaled()
        np.matmul(x, scaled, out=qkv[s:, :-1])
        qkv[:, -1] = 1
        a, c = self.attend(qkv, self.near(), first)
        total = c[:, WIDTH:].copy()
        c /= total
        h = np.ones_like(c)  # a one after h and after z, for what is added
        np.add(x, c[:, :WIDTH] @ w["mix"], out=h[:, :WIDTH])
        u = h @ np.concatenate((w["up"], w["up0"][None]))
        np.maximum(u, 0, out=u)
        z = u @ np.concatenate((w["down"], np.zeros((HIDDEN, 1), x.dtype)), axis=1)
        z += h
        return {"x": x, "scaled": scaled, "qkv": qkv, "a": a, "total": total, "c": c, "h": h, "u": u, "z": z}

    def tables(self) -> dict:
        """What a class alone decides, for scoring: its vector, and its query, key, value as mixed in, and a one."""
        w, size = self.w, len(self.w["in"])
        q, k, v = np.split(w["in"] @ self.scaled(), 3, axis=1)
        zero = np.zeros((size, 1), np.float32)
        return {
            "x": np.concatenate((w["in"], zero), axis=1), "qkv": np.concatenate((q, k, v @ w["mix"], zero + 1), axis=1), "near": self.near(),
            "up": np.concatenate((w["up"], w["up0"][None])), "down": np.concatenate((w["down"], np.zeros((HIDDEN, 1), np.float32)), axis=1),
        }

    def read(self, t: dict, given: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The z of forward(), from tables()."""
        given = given.ravel()
        qkv = np.zeros((len(given) + BLOCK, 3 * WIDTH + 1), np.float32)
        t["qkv"].take(given, axis=0, out=qkv[BLOCK:], mode="clip")
        h = self.attend(qkv, t["near"], first)[1]
        h /= h[:, WIDTH:].copy()
        h += t["x"].take(given, axis=0)
        u = h @ t["up"]
        np.maximum(u, 0, out=u)
        h += u @ t["down"]
        return h

    def logits(self, z: np.ndarray, given: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Exponentials for groups, their sums, and the logits of given groups; where they are steep, less their maximum."""
        for once in (False, True):
            p = z @ self.w["group"]
            p += self.lead.take(given.ravel(), axis=0)
            if once:
                p -= p.max(axis=1, keepdims=True)
            own = p.ravel().take(np.arange(0, p.size, GROUPS) + group)
            with np.errstate(over="ignore"):
                np.exp(p, out=p)
            total = p @ np.ones(GROUPS, p.dtype)
            if not steep(total):
                break
        return p, total, own

    def likelihood(self, z: np.ndarray, given: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Log probability of each target class: of its group, and of it in the group."""
        given, group = given.ravel(), self.group.take(target)
        _, total, out = self.logits(z, given, group)
        out -= np.log(total)
        rare = np.flatnonzero(np.maximum(given, target) >= CLASSES)
        pair = given * CLASSES + target
        pair[rare] = 0
        steps = self.step.ravel().take(pair)
        if len(rare):
            steps[rare] = -self.mass[given[rare], group[rare]]
            if self.pairs is not None:
                steps[rare] += np.log(self.frequency(target[rare], self.count(given[rare], target[rare])))
        out += steps
        return out

    def frequency(self, target: np.ndarray, count: np.ndarray) -> np.ndarray:
        """Of a class after another that it follows so often, before it is divided by that of its group."""
        return count + SMOOTH * self.within[target]

    def count(self, given: np.ndarray, target: np.ndarray) -> np.ndarray:
        """How often pairs of rare_pairs() occur."""
        (keys, counts), wanted = self.pairs, given * len(self.group) + target
        at = np.minimum(np.searchsorted(keys, wanted), max(len(keys) - 1, 0))
        return np.where(keys[at] == wanted, counts[at], 0) if len(keys) else np.zeros(len(wanted))

    def gradient(self, given: np.ndarray, first: np.ndarray, target: np.ndarray, real: np.ndarray, rows: np.ndarray | None = None, at: np.ndarray | None = None) -> tuple[float, dict]:
        """Mean loss of the groups of real targets, and its gradient. rows: classes of given, whose places in it are `at`; that of vectors is then about theirs alone."""
        w, (m, s) = self.w, given.shape
        f, g = self.forward(given, first), {}
        x, c, target = f["x"], f["c"][:, :WIDTH], self.group.take(target.ravel())
        scale = (real.ravel() / max(int(real.sum()), 1)).astype(x.dtype)
        p, total, own = self.logits(f["z"], given, target)
        loss = float((np.log(total) - own) @ scale)
        p *= (scale / total)[:, None]
        p.ravel()[np.arange(0, p.size, GROUPS) + target] -= scale
        g["group"] = f["z"].T @ p
        dz = p @ w["group"][:WIDTH].T
        g["down"] = f["u"].T @ dz
        du = dz @ w["down"].T
        du *= f["u"] > 0
        up = f["h"].T @ du
        g["up"], g["up0"] = up[:WIDTH], up[WIDTH]
        dh = dz + du @ w["up"].T
        g["mix"] = c.T @ dh
        dc = np.empty_like(f["c"])  # by the sum of exponentials; and what the logits have in common, for the ones beside the values
        np.divide(dh @ w["mix"].T, f["total"], out=dc[:, :WIDTH])
        np.negative(np.einsum("nw,nw->n", dc[:, :WIDTH], c), out=dc[:, WIDTH])
        dc = dc.reshape(m, s, -1)
        q, k, v = f["qkv"][s:, :WIDTH].reshape(m, s, -1), self.windows(f["qkv"], slice(WIDTH, 2 * WIDTH)), self.windows(f["qkv"], slice(2 * WIDTH, None))
        da = dc @ v.transpose(0, 2, 1)
        da *= f["a"]
        g["near"] = np.bincount(self.distance.ravel(), (da.sum(axis=0) * ~self.future).ravel(), 2 * BLOCK).astype(x.dtype)
        dboth = np.empty((m, 2 * s, 2 * WIDTH), x.dtype)  # of keys and values by windows; then by blocks
        np.matmul(da.transpose(0, 2, 1), q, out=dboth[:, :, :WIDTH])
        np.matmul(f["a"].transpose(0, 2, 1), dc[:, :, :WIDTH], out=dboth[:, :, WIDTH:])
        dkv = dboth[:, s:].copy()
        dkv[:-1] += dboth[1:, :s]
        dq, dkv = (da @ k).reshape(m * s, WIDTH), dkv.reshape(m * s, 2 * WIDTH)
        g["qkv"] = np.concatenate((x.T @ dq * x.dtype.type(WIDTH**-0.5), x.T @ dkv), axis=1)
        dx = dh + dq @ f["scaled"][:, :WIDTH].T
        dx += dkv @ f["scaled"][:, WIDTH:].T
        at = given.ravel() if rows is None else at
        g["in"] = add_rows(at, dx, len(w["in"]) if rows is None else len(rows)).astype(x.dtype, order="C")
        return loss, g

    def learn(self, ids: np.ndarray, bounds: np.ndarray, adam: Adam, rng: np.random.Generator, speed: Callable[[float], float], batch: int = BATCH) -> tuple[float, int]:
        """One pass over the documents in seeded order: mean loss and blocks. speed: rate by the share of them that is done."""
        order = rng.permutation(len(bounds) - 1)
        sizes = np.diff(bounds)[order]
        ids = ids[np.arange(len(ids)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(bounds[:-1][order], sizes)]
        given, first, target, real = self.blocks(ids, np.concatenate(([0], np.cumsum(sizes))))
        target, total, place = self.classes[target], [], np.empty(len(self.group), np.int64)
        for i in range(0, len(given), batch):
            part, alone = slice(i, i + batch), first[i : i + batch].copy()
            alone[0] = True
            read = given[part].ravel()
            place[read] = np.arange(len(read))
            rows = read[place[read] == np.arange(len(read))]  # each class once
            place[rows] = np.arange(len(rows))
            loss, g = self.gradient(given[part], alone, target[part], real[part], rows, place[read])
            total.append(loss)
            adam.step(self.w, g, speed(i / len(given)), rows)
        return float(np.mean(total)) if total else 0.0, len(given)

    def train(self, ids: np.ndarray, bounds: np.ndarray, epochs: int = 1, batch: int = BATCH, rate: float = 0.01, seed: int = 7) -> list[float]:
        """Adam with a falling rate over documents that fit in memory; the mean losses of the passes."""
        rng, adam = np.random.default_rng(seed), Adam(self.w)
        return [self.learn(ids, bounds, adam, rng, lambda x: falling((e + x) / epochs, rate), batch)[0] for e in range(epochs)]  # noqa: B023

    def to_train(self) -> Model:
        """What learn() needs of it, without the tables of likelihood()."""
        part = copy.copy(self)
        part.step = part.mass = part.within = part.inside = part.pairs = None
        return part

    def state(self, adam: Adam) -> np.ndarray:
        """Weights and moments as one vector."""
        return np.concatenate([x.ravel() for part in (self.w, adam.mean, adam.square) for x in part.values()])

    def restore(self, state: np.ndarray, t: int) -> Adam:
        """Takes the weights of state(); its moments, after t steps."""
        adam, at = Adam(self.w), 0
        adam.t = t
        for part in (self.w, adam.mean, adam.square):
            for k, x in part.items():
                part[k] = state[at : at + x.size].reshape(x.shape).astype(np.float32)
                at += x.size
        return adam

    def blocks(self, ids: np.ndarray, bounds: np.ndarray):
        """Documents in blocks: classes read, first blocks, ids to predict, and which are real.

        Each text ends with the end id, which also stands before its first one.
        """
        sizes = np.diff(bounds) + 1
        n = -(-sizes // BLOCK)
        start = np.cumsum(n) - n
        target = np.full((int(n.sum()), BLOCK), self.end, ids.dtype if len(ids) else np.int64)
        flat = target.ravel()
        at = np.arange(len(ids)) + np.repeat(start * BLOCK - bounds[:-1], sizes - 1)
        flat[at] = ids
        real = (np.arange(len(flat)) - np.repeat(start * BLOCK, n * BLOCK) < np.repeat(sizes, n * BLOCK)).reshape(target.shape)
        given = np.empty_like(flat)
        given[1:] = flat[:-1]
        given[start * BLOCK] = self.end
        given = self.classes[given].reshape(target.shape)
        first = np.zeros(len(given), bool)
        first[start] = True
        return given, first, target, real

    def score(self, ids: np.ndarray, bounds: np.ndarray, batch: int = BATCH) -> np.ndarray:
        """log10 probability of each document."""
        given, first, target, real = self.blocks(ids, bounds)
        found, classes, tables = np.zeros(len(given)), self.classes[target], self.tables()
        for i in range(0, len(given), batch):
            j, lead = min(i + batch, len(given)), int(i > 0)  # the last block of the batch before comes along, to be seen
            z = self.read(tables, given[i - lead : j], first[i - lead : j])[lead * BLOCK :]
            own = self.likelihood(z, given[i:j], classes[i:j].ravel())
            found[i:j] = np.where(real[i:j], own.reshape(j - i, BLOCK), 0).sum(axis=1, dtype=np.float64)
        n = -(-(np.diff(bounds) + 1) // BLOCK)
        return np.diff(np.concatenate(([0.0], np.cumsum(found)))[np.concatenate(([0], np.cumsum(n)))]) / np.log(10)


def _texts(docs: DataFrame) -> DataFrame:
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 10 == 0, F.lit(False))
    return docs.select("doc_id", F.xxhash64(F.col("doc_id").cast("string"), "text").alias("_key"), held.alias("held_out"), "text")


PARTS = "slice int, at binary, by binary"


def _ids(column: pa.Array, dtype: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids of serialised documents, and bounds."""
    held = [np.frombuffer(x.as_buffer(), dtype).astype(np.int32) for x in column]
    return np.concatenate(held), np.cumsum([0, *map(len, held)])


def _chunks(batches: Iterator[pa.RecordBatch], dtype: str) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Keys, ids and bounds of documents (_key, ids), of about CHUNK ids at a time."""
    keys, held, size = [], [], 0
    for batch in _then_none(batches):
        for key, x in zip(batch.column(0).to_pylist(), batch.column(1)) if batch is not None else ():
            keys.append(key)
            held.append(np.frombuffer(x.as_buffer(), dtype).astype(np.int32))
            size += len(held[-1])
            if size >= CHUNK:
                yield np.array(keys, np.int64), np.concatenate(held), np.cumsum([0, *map(len, held)])
                keys, held, size = [], [], 0
    if keys:
        yield np.array(keys, np.int64), np.concatenate(held), np.cumsum([0, *map(len, held)])


def head_words(train: DataFrame, total: int) -> np.ndarray:
    """Hashes of the most frequent words of the HEAD_DOCS documents with the smallest keys."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column(1)):
                cut = words(batch.column(1)[a:b], lower=True)
                hashes = cut.hashes()
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], pa.array([hashes[x:y].tobytes() for x, y in zip(cut.bounds, cut.bounds[1:])], pa.binary())], ["_key", "words"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = [np.zeros(0, np.uint64)]
        for batch in batches:
            hashes += [np.frombuffer(x, np.uint64) for x in batch.column(0).to_pylist()]
        values, counts = np.unique(np.concatenate(hashes), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array([np.sort(values[np.argsort(-counts, kind="stable")[:HEAD]]).tobytes()], pa.binary())], ["head"])

    limit = -(1 << 63) + min((1 << 64) - 1, int((1 << 64) * 1.2 * HEAD_DOCS / max(total, 1)))
    sample = train.where(F.col("_key") <= limit).select("_key", "text").mapInArrow(measure, "_key long, words binary").orderBy("_key").limit(HEAD_DOCS)
    return np.frombuffer(sample.coalesce(1).select("words").mapInArrow(count, "head binary").first()[0], np.uint64)


def encoded(texts: DataFrame, tokenizer: str) -> DataFrame:
    """texts with the ids of each text, serialised as _dtype() says."""
    dtype = _dtype(tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column(3)):
                part = batch.slice(a, b - a)
                ids, bounds = word_memo(tokenizer).ids(lower_runs(words(part.column(3))))
                raw, edges = ids.astype(dtype).tobytes(), (bounds * np.dtype(dtype).itemsize).tolist()
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([raw[x:y] for x, y in zip(edges, edges[1:])], pa.binary())], [*part.schema.names, "ids"])

    kind = texts.schema["doc_id"].dataType.simpleString()
    return written(texts.mapInArrow(run, f"doc_id {kind}, _key long, held_out boolean, text string, ids binary"), "ids")


def id_totals(train: DataFrame, tokenizer: str) -> np.ndarray:
    """id_counts() of all training documents (_key, ids) of encoded()."""
    size, dtype = vocabulary(tokenizer), _dtype(tokenizer)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(size + 1)
        for _, ids, bounds in _chunks(batches, dtype):
            found += id_counts(ids, bounds, size)
        yield from as_slices(found, SLICES)

    return add_up(train.select("_key", "ids").mapInArrow(count, PARTS), size + 1, SLICES)


def rare_rows(texts: DataFrame, tokenizer: str, counts: np.ndarray) -> DataFrame:
    """(pair, _key, n): of each text its rare_pairs(), as one number, and how often they occur; negative if it is held out."""
    dtype = _dtype(tokenizer)
    held = texts.sparkSession.sparkContext.broadcast(first_classes(counts))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, ids, bounds in _chunks(batches, dtype):
            a, b, doc = rare_pairs(held.value, ids, bounds)
            found = pd.DataFrame({"p": a * len(held.value) + b, "d": doc}).groupby(["d", "p"], sort=False).size().reset_index(name="n")
            yield pa.RecordBatch.from_arrays([pa.array(found["p"].to_numpy(np.int64)), pa.array(keys[found["d"].to_numpy(np.int64)]), pa.array(found["n"].to_numpy(np.int64))], ["pair", "_key", "n"])

    parts = [texts.where(where).select("_key", "ids").mapInArrow(send, "pair long, _key long, n long").select("pair", "_key", n.alias("n")) for where, n in (("NOT held_out", F.col("n")), ("held_out", -F.col("n")))]
    rows = written(parts[0].unionByName(parts[1]), "pairs")
    held.destroy()
    return rows


def rare_sums(rare: DataFrame, model: Model) -> DataFrame:
    """(_key, sum): of each text what the frequency() of its rare_rows() adds to its score."""
    held = rare.sparkSession.sparkContext.broadcast((model.classes, model.within))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes, within = held.value
        for batch in batches:
            target = classes[np.asarray(batch.column(0)) % len(classes)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.log10(np.asarray(batch.column(1)) + SMOOTH * within[target]))], ["pair", "log"])

    logs = rare.groupBy("pair").agg(F.sum(F.greatest("n", F.lit(0))).alias("c")).mapInArrow(weigh, "pair long, log double")
    return rare.join(logs, "pair").groupBy("_key").agg(F.sum(F.abs("n") * F.col("log")).alias("sum"))


def fit(train: DataFrame, tokenizer: str, total: int) -> Model:
    """The model, of all training documents (_key, held_out, ids) of encoded(), `total` in number."""
    counts = id_totals(train, tokenizer)
    return fit_from(train, tokenizer, total, counts, rare_rows(train, tokenizer, counts))


def fit_from(train: DataFrame, tokenizer: str, total: int, counts: np.ndarray, rare: DataFrame) -> Model:
    """fit() from id_totals() and from rare_rows() of the training documents, maybe of others too."""
    spark, size, dtype = train.sparkSession, vocabulary(tokenizer), _dtype(tokenizer)
    train, n = train.select("_key", "ids"), CLASSES**2
    first = first_classes(counts)
    held = spark.sparkContext.broadcast(first)

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_words(tokenizer)  # all texts are encoded
        first, found = held.value, np.zeros(2 * n + (size + 1) * COLUMNS)
        for _, ids, bounds in _chunks(batches, dtype):
            for at, f in ((0, follows), (n, apart), (2 * n, columns_beside)):
                np.add.at(found, at + f(first, ids, bounds), 1.0)
        yield from as_slices(found, SLICES)

    total_pairs = add_up(train.mapInArrow(pairs, PARTS), 2 * n + (size + 1) * COLUMNS, SLICES)
    held.destroy()
    placed = classes_and_groups(first, total_pairs[n : 2 * n], total_pairs[2 * n :])
    follow = total_pairs[:n].copy()
    del total_pairs
    held_groups, every = spark.sparkContext.broadcast(placed[1:]), len(placed[2])

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (classes, group), found = held_groups.value, np.zeros(every * GROUPS)
        for batch in batches:
            a, b = np.divmod(np.asarray(batch.column(0)), len(classes))
            found += np.bincount(classes[a] * GROUPS + group[classes[b]], np.asarray(batch.column(1)), len(found))
        yield from as_slices(found, SLICES)

    more = add_up(rare.where("n > 0").select("pair", "n").mapInArrow(groups, PARTS), every * GROUPS, SLICES)
    held_groups.destroy()
    model = Model.of(counts, placed, follow, more)
    del follow, more
    shards, state, t = max(1, -(-total // SHARD_DOCS)), model.state(Adam(model.w)), 0
    held_model = spark.sparkContext.broadcast(model.to_train())
    for i in range(ROUNDS):
        state, t = _round(train, dtype, held_model, state, t, i, shards)
    held_model.destroy()
    model.restore(state, t)
    return model


def _round(train: DataFrame, dtype: str, held_model: Broadcast, state: np.ndarray, t: int, i: int, shards: int) -> tuple[np.ndarray, int]:
    """State and steps after one round: the mean of what the shards make of the round's documents, those in its range of keys."""
    held = train.sparkSession.sparkContext.broadcast(state.astype(np.float32))
    low, high = (-(1 << 63) + ((1 << 64) * x // ROUNDS) for x in (i, i + 1))

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, state = held_model.value, held.value
        adam, n, rng = model.restore(state, t), 0, None
        for keys, ids, bounds in _chunks(batches, dtype):
            rng = rng or np.random.default_rng([7, i, int(keys[0]) + (1 << 63)])
            # Keys are even over their range and sorted, so they say how much of the pass is done.
            done = (int(keys[0]) + (1 << 63)) / (1 << 64)
            n += model.learn(ids, bounds, adam, rng, lambda _: falling(done))[1]  # noqa: B023
        if n:
            moved = np.concatenate((model.state(adam), [n, float(n) * adam.t]))
            moved[:-2] -= state
            moved[:-2] *= n
            yield from as_slices(moved, SLICES)

    mine = train.where((F.col("_key") >= low) & (F.col("_key") <= high - 1)).repartition(shards, "_key").sortWithinPartitions("_key", "ids")
    total = add_up(mine.mapInArrow(learn, PARTS), len(state) + 2, SLICES)
    held.destroy()
    return (state.astype(np.float32) + total[:-2] / total[-2], round(total[-1] / total[-2])) if total[-2] else (state, t)


def _dtype(tokenizer: str) -> str:
    """Two bytes an id, or four if the vocabulary needs it."""
    return "<u2" if vocabulary(tokenizer) <= 1 << 16 else "<i4"


DOC, WORD, TOTAL = 0, 1, 2


class Head:
    """Places of hashes among sorted ones, each looked for among the few with the same first bits."""

    def __init__(self, hashes: np.ndarray, bits: int = 18):
        self.hashes, self.shift = hashes, np.uint64(64 - bits)
        self.start = np.searchsorted(hashes, np.arange(1 << bits, dtype=np.uint64) << self.shift).astype(np.int32)

    def __len__(self) -> int:
        return len(self.hashes)

    def find(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places, and whether each hash is there."""
        if not len(self):
            return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
        at = self.start.take((wanted >> self.shift).astype(np.int64)).astype(np.int64)
        left, last = np.arange(len(wanted)), len(self) - 1
        np.minimum(at, last, out=at)
        while len(left := left[(self.hashes.take(at[left]) < wanted[left]) & (at[left] < last)]):
            at[left] += 1
        return at, self.hashes.take(at) == wanted


def word_sums(texts: DataFrame, head: np.ndarray) -> DataFrame:
    """(kind, id, sum, n): of each text its words outside the head, sum of log10(c + 0.1) and known words;
    of each head word its count; and of all training words distinct ones (id) and occurrences (n)."""
    held = texts.sparkSession.sparkContext.broadcast(head)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = held.value
        find, totals = Head(head).find, np.zeros(len(head), np.int64)
        for batch in batches:
            for a, b in slices(batch.column(2)):
                cut = words(batch.column(2)[a:b], lower=True)
                hashes, doc = cut.hashes(), cut.doc()
                out = np.asarray(batch.column(1)[a:b].cast(pa.int8()))[doc] == 1
                at, inside = find(hashes)
                totals += np.bincount(at[inside & ~out], minlength=len(head))
                hashes, doc = hashes[~inside], doc[~inside]
                pairs = pd.DataFrame({"h": hashes, "d": doc}).groupby(["d", "h"], sort=False).size()
                doc, hashes = pairs.index.get_level_values(0).to_numpy(), pairs.index.get_level_values(1).to_numpy().astype(np.uint64)
                n = pairs.to_numpy().astype(np.int32)
                keys, out = np.asarray(batch.column(0)[a:b]), np.asarray(batch.column(1)[a:b].cast(pa.int8()))
                n = np.where(out[doc] == 1, -n, n) if len(doc) else n
                yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), pa.array(keys[doc] if len(doc) else np.zeros(0, np.int64)), pa.array(n, pa.int64())], ["word", "_key", "n"])
        some = np.flatnonzero(totals)
        for i in range(0, len(some), 10_000):
            part = some[i : i + 10_000]
            yield pa.RecordBatch.from_arrays([pa.array(head[part].view(np.int64)), pa.nulls(len(part), pa.int64()), pa.array(totals[part], pa.int64())], ["word", "_key", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows by word: its count over all rows gives each text's share."""
        distinct = occurrences = 0

        def rows(kind: int, ids, sums, n) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), kind), pa.int32()), pa.array(ids, pa.int64()), pa.array(sums, pa.float64()), pa.array(n, pa.int64())], ["kind", "id", "sum", "n"])

        left: list[np.ndarray] | None = None  # the last word's rows so far
        for table in _then_none(batches):
            if table is None:
                word, key, null, n = left or [np.zeros(0, np.int64)] * 4
                last = len(word)
            else:
                word, n = np.asarray(table.column(0)), np.asarray(table.column(2)).astype(np.int64)
                null, key = np.asarray(table.column(1).is_null()), np.asarray(table.column(1).fill_null(0))
                if left is not None:
                    word, key, null, n = (np.concatenate(x) for x in zip(left, (word, key, null, n)))
                if not len(word):
                    continue
                last = int(np.searchsorted(word == word[-1], True)) if word[-1] != word[0] else 0
                left = [x[last:] for x in (word, key, null, n)]
            word, key, null, n = word[:last], key[:last], null[:last], n[:last]
            if not last:
                continue
            new = np.ones(last, bool)
            new[1:] = word[1:] != word[:-1]
            group = np.cumsum(new) - 1
            c = np.bincount(group, np.maximum(n, 0)).astype(np.int64)
            distinct += int((c > 0).sum())
            occurrences += int(c.sum())
            top = np.unique(group[null])
            if len(top):
                yield rows(WORD, word[new][top], np.zeros(len(top)), c[top])
            mine = ~null
            times, known = np.abs(n[mine]), c[group[mine]]
            codes, keys = pd.factorize(key[mine])
            if len(keys):
                yield rows(DOC, keys, np.bincount(codes, times * np.log10(known + 0.1)), np.bincount(codes, times * (known > 0)).astype(np.int64))
        yield rows(TOTAL, [distinct], [0.0], [occurrences])

    sent = texts.select("_key", "held_out", "text").mapInArrow(send, "word long, _key long, n long")
    counted = sent.repartition("word").sortWithinPartitions("word").mapInArrow(count, "kind int, id long, sum double, n long")
    # The distinct words of all partitions are added up under one id.
    counted = counted.select("kind", F.when(F.col("kind") == TOTAL, 0).otherwise(F.col("id")).alias("id"), F.when(F.col("kind") == TOTAL, F.col("id")).otherwise(F.col("sum")).alias("sum"), "n")
    return counted.groupBy("kind", "id").agg(F.sum("sum").alias("sum"), F.sum("n").alias("n"))


def _then_none(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def lm_scores(docs: DataFrame, tokenizer: str) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of all documents."""
    spark = docs.sparkSession
    texts = encoded(_texts(docs), tokenizer)
    train = texts.where("NOT held_out")
    ends = train.count()
    ids = id_totals(train, tokenizer)
    rare = rare_rows(texts, tokenizer, ids)
    model, head = fit_from(train, tokenizer, ends, ids, rare), head_words(train, ends)
    sums = written(word_sums(texts, head), "words")
    found = {r["id"]: r["n"] for r in sums.where(F.col("kind") == WORD).select("id", "n").collect()}
    counts = np.array([found.get(h, 0) for h in head.view(np.int64).tolist()], np.int64)
    total = sums.where(F.col("kind") == TOTAL).agg(F.sum("sum"), F.sum("n")).first()
    n, v = int(total[1] or 0) + ends, int(total[0] or 0) + (ends > 0)
    held = spark.sparkContext.broadcast((model, head, counts))
    kind, dtype = docs.schema["doc_id"].dataType.simpleString(), _dtype(tokenizer)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, head, counts = held.value
        find = Head(head).find
        for batch in batches:
            for a, b in slices(batch.column(3), 1 << 20):
                text = batch.column(3)[a:b]
                cut = words(text, lower=True)
                at, inside = find(cut.hashes())
                share = np.where(inside, np.log10(counts[at] + 0.1), 0.0) if len(head) else np.zeros(len(at))
                known = inside & (counts[at] > 0) if len(head) else inside
                add = lambda x: np.diff(np.concatenate(([0], np.cumsum(x)))[cut.bounds])  # noqa: E731, B023
                ids, bounds = _ids(batch.column(4)[a:b], dtype)
                columns = [batch.column(0)[a:b], batch.column(1)[a:b], batch.column(2)[a:b], pa.array(cut.counts + 1, pa.int64()), pa.array(add(known), pa.int64()), pa.array(add(share), pa.float64()), pa.array(model.score(ids, bounds), pa.float64())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "_key", "held_out", "n_tokens", "_known", "_share", "score"])

    scored = texts.mapInArrow(measure, f"doc_id {kind}, _key long, held_out boolean, n_tokens long, _known long, _share double, score double")
    # Rows that are alike in doc_id and text have one key, and its sums hold all of them.
    alike = texts.groupBy("_key").agg(F.count("*").alias("_alike"))
    mine = sums.where(F.col("kind") == DOC).select(F.col("id").alias("_key"), F.col("sum").alias("_sum"), F.col("n").alias("_n"), F.lit(0.0).alias("_pairs"))
    mine = mine.unionByName(rare_sums(rare, model).select("_key", F.lit(0.0).alias("_sum"), F.lit(0).cast("long").alias("_n"), F.col("sum").alias("_pairs")))
    mine = mine.groupBy("_key").agg(*(F.sum(c).alias(c) for c in ("_sum", "_n", "_pairs"))).join(alike, "_key").select("_key", (F.col("_sum") / F.col("_alike")).alias("_sum"), (F.col("_n") / F.col("_alike")).cast("long").alias("_n"), (F.col("_pairs") / F.col("_alike")).alias("_pairs"))
    base = F.col("_share") + F.coalesce("_sum", F.lit(0.0)) + float(np.log10(ends + 0.1)) - F.col("n_tokens") * float(np.log10(n + 0.1 * (v + 1)))
    return scored.join(mine, "_key", "left").select("doc_id", "held_out", "n_tokens", (F.col("_known") + F.coalesce("_n", F.lit(0)) + int(ends > 0)).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"), base.alias("base_score"), (F.col("score") + F.coalesce("_pairs", F.lit(0.0))).alias("score"))
