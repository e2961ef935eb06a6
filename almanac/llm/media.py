"""Chroma fingerprints of recordings in a media column, and their alignment.

A recording becomes an image of pitch classes over time.  Rectangle filters on
its integral image compare areas of the last frames; each gives two bits, and a
frame's bits are packed into one integer.  Two recordings are aligned by the
histogram of offsets at which they have equal integers, and judged by the rate of
differing bits over the overlap at the best offset.

The search takes a stated set of queries against all recordings: queries go out
in blocks of bounded size, and every task aligns its own recordings with a block.
One block at a time is held and its links are written before the next one goes out,
so neither the driver nor a plan grows with the number of queries.
Recordings with equal fingerprints form one class, which is searched once.

Defined results: a null or empty recording has no frames, matches nothing and is
in one class with its like.  Ties between queries go to the smaller id.  Turns
without conv_id belong to no conversation and make no recording.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from almanac.llm.shared import new_path, written
from almanac.llm.text import words

RATE = 2000
FRAME = 256
HOP = 128
WINDOW = 12
#: Steps of a filter's value between its four codes, and the codes: neighbours differ in one bit.
STEPS = np.array([-0.3, 0.0, 0.3])
CODES = np.array([0, 1, 3, 2], np.uint32)
#: A match: at most this rate of differing bits over at least half of the shorter recording and MIN_OVERLAP frames,
#: at an offset with MIN_VOTES equal integers, or fewer where a recording hardly ever changes.
MAX_ERROR = 0.15
MIN_OVERLAP = 8
MIN_VOTES = 3
#: Bytes of fingerprints in one block of queries.
BLOCK_BYTES = 8 << 20
#: Votes that are counted at once; a recording with more, such as one with long silence, takes several rounds.
VOTES = 1 << 20

#: (kind, first pitch class, pitch classes, frames) of the filters; sizes divide by two and three.
FILTERS = [(i % 6, 0 if i % 3 == 0 else 5 * i % 7, 12 if i % 3 == 0 else 6, 12 if i % 2 == 0 else 6) for i in range(16)]


def read_wav(data: bytes) -> tuple[np.ndarray, int]:
    """Samples of a 16-bit PCM file, channels averaged, and their rate."""
    if data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, channels, rate, samples = 12, 1, RATE, np.zeros(0, np.int16)
    while at + 8 <= len(data):
        name, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        if name == b"fmt ":
            kind, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", data, at + 8)
            if kind != 1 or bits != 16:
                raise ValueError("only 16-bit PCM is read")
        elif name == b"data":
            samples = np.frombuffer(data[at + 8 : at + 8 + size // (2 * channels) * 2 * channels], "<i2")
        at += 8 + size + size % 2
    return samples.reshape(-1, channels).mean(axis=1), rate


def write_wav(samples: np.ndarray, rate: int = RATE) -> bytes:
    raw = samples.astype("<i2").tobytes()
    return b"RIFF" + struct.pack("<I", 36 + len(raw)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, rate, 2 * rate, 2, 16) + b"data" + struct.pack("<I", len(raw)) + raw


_NOTES = np.rint(8000 * np.sin(2 * np.pi * 220 * 2 ** (np.arange(24)[:, None] / 12) * np.arange(HOP)[None, :] / RATE)).astype(np.int16)


def melodies(texts: pa.Array) -> list[np.ndarray]:
    """A recording of each text: one note a word, its pitch from the word's hash."""
    cut = words(texts)
    notes = (cut.hashes() % np.uint64(24)).astype(np.int64)
    return [_NOTES[notes[a:b]].ravel() for a, b in zip(cut.bounds, cut.bounds[1:])]


def chroma(samples: np.ndarray, rate: int = RATE) -> np.ndarray:
    """Frames by pitch classes, each frame of length one, or zero if silent."""
    n = max(0, (len(samples) - FRAME) // HOP + 1) if len(samples) >= FRAME else int(len(samples) > 0)
    if n == 0:
        return np.zeros((0, 12))
    samples = np.pad(np.asarray(samples, np.float32), (0, max(0, FRAME - len(samples))))
    frames = np.lib.stride_tricks.sliding_window_view(samples, FRAME)[::HOP][:n]
    pitch = np.fft.rfftfreq(FRAME, 1 / rate)
    heard = np.flatnonzero((pitch > 0.1 * rate) & (pitch < 0.45 * rate))
    into = np.zeros((len(heard), 12))
    into[np.arange(len(heard)), np.rint(12 * np.log2(pitch[heard] / 440)).astype(int) % 12] = 1
    shape, out = np.hanning(FRAME).astype(np.float32), []
    for i in range(0, n, 4096):
        power = np.abs(np.fft.rfft(frames[i : i + 4096] * shape)[:, heard]) ** 2 @ into
        size = np.sqrt((power**2).sum(axis=1, keepdims=True))
        out.append(np.where(size > 1e-6, power / np.maximum(size, 1e-6), 0))
    return np.concatenate(out)


def fingerprint(image: np.ndarray) -> np.ndarray:
    """One packed integer for each WINDOW frames; a shorter recording is padded with silence."""
    if not len(image):
        return np.zeros(0, np.uint32)
    if len(image) < WINDOW:
        image = np.pad(image, ((0, WINDOW - len(image)), (0, 0)))
    sums = np.zeros((len(image) + 1, 13))
    sums[1:, 1:] = image.cumsum(axis=0).cumsum(axis=1)
    n = len(image) - WINDOW + 1

    def area(t: int, y: int, w: int, h: int) -> np.ndarray:
        return sums[t + w : t + w + n, y + h] - sums[t : t + n, y + h] - sums[t + w : t + w + n, y] + sums[t : t + n, y]

    packed = np.zeros(n, np.uint32)
    for kind, y, h, w in FILTERS:
        t = WINDOW - w
        whole = area(t, y, w, h)
        if kind == 0:  # all of it against the rest of these frames
            part, whole = whole, area(t, 0, w, 12)
        elif kind == 1:  # low half
            part = area(t, y, w, h // 2)
        elif kind == 2:  # early half
            part = area(t, y, w // 2, h)
        elif kind == 3:  # chessboard
            part = area(t, y, w // 2, h // 2) + area(t + w // 2, y + h // 2, w // 2, h // 2)
        elif kind == 4:  # middle third of pitches
            part = area(t, y + h // 3, w, h // 3)
        else:  # middle third of frames
            part = area(t + w // 3, y, w // 3, h)
        value = np.log((1 + part) / (1 + whole - part))
        packed = packed << np.uint32(2) | CODES[np.searchsorted(STEPS, np.round(value, 6))]
    return packed


def _wav_samples(column: pa.Array) -> list[np.ndarray]:
    return [read_wav(x)[0] if x else np.zeros(0) for x in column.to_pylist()]


def fingerprints(media: DataFrame, column: str = "audio", decode: Callable[[pa.Array], list[np.ndarray]] = _wav_samples, id_column: str = "id") -> DataFrame:
    """(id, frames): the fingerprint of each recording, as packed unsigned 32-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([fingerprint(chroma(s)).tobytes() for s in decode(part.column(1))], pa.binary())], ["id", "frames"])

    kind = media.schema[id_column].dataType.simpleString()
    return media.select(F.col(id_column).alias("id"), column).mapInArrow(run, f"id {kind}, frames binary")


def _turns(prints: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Integers, owners and places where a recording's integer changes."""
    owner = np.repeat(np.arange(len(prints)), [len(p) for p in prints])
    values = np.concatenate([*prints, np.zeros(0, np.uint32)])
    place = np.arange(len(values)) - np.repeat(np.cumsum([0, *map(len, prints)])[:-1], [len(p) for p in prints])
    new = np.ones(len(values), bool)
    new[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
    return values[new], owner[new], place[new]


def bit_errors(a: np.ndarray, b: np.ndarray, offset: int) -> tuple[int, int]:
    """Differing bits and frames of the overlap when b starts `offset` frames after a's start."""
    start, end = max(0, offset), min(len(a), len(b) + offset)
    if end <= start:
        return 0, 0
    return int(np.bitwise_count(a[start:end] ^ b[start - offset : end - offset]).sum()), end - start


def _votes(own_place: np.ndarray, low: np.ndarray, n: np.ndarray, owner: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of (query, offset) and their votes: frame i of a recording meets the n[i] query frames from low[i]."""
    ends = np.cumsum(n)
    keys, votes = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for start in range(0, int(ends[-1]), VOTES):
        vote = np.arange(start, min(start + VOTES, int(ends[-1])))
        i = np.searchsorted(ends, vote, "right")
        at = vote - (ends[i] - n[i]) + low[i]
        more, counts = np.unique(owner[at] * (1 << 32) + (own_place[i] - place[at]) + (1 << 31), return_counts=True)
        keys, back = np.unique(np.concatenate((keys, more)), return_inverse=True)
        votes = np.bincount(back, np.concatenate((votes, counts)), len(keys)).astype(np.int64)
    return keys, votes


def align(queries: list[np.ndarray], prints: list[np.ndarray]) -> list[tuple[int, int, int, float]]:
    """(recording, query, offset of the query in it, rate of differing bits) of all matches."""
    values, owner, place = _turns(queries)
    turns = np.bincount(owner, minlength=len(queries))
    order = np.argsort(values, kind="stable")
    values, owner, place = values[order], owner[order], place[order]
    own_values, own, own_place = _turns(prints)
    found = []
    for d in range(len(prints)):
        a, b = np.searchsorted(own, d), np.searchsorted(own, d, "right")
        low, high = np.searchsorted(values, own_values[a:b]), np.searchsorted(values, own_values[a:b], "right")
        n = high - low
        if not n.sum():
            continue
        keys, votes = _votes(own_place[a:b], low, n, owner, place)
        enough = votes >= np.minimum(MIN_VOTES, np.minimum(b - a, turns[keys >> 32]))
        keys, votes = keys[enough], votes[enough]
        rank = np.lexsort((keys, -votes, keys >> 32))
        first = np.ones(len(rank), bool)
        first[1:] = (keys[rank[1:]] >> 32) != (keys[rank[:-1]] >> 32)
        for key in keys[rank[first]].tolist():
            q, offset = key >> 32, (key & ((1 << 32) - 1)) - (1 << 31)
            bits, overlap = bit_errors(prints[d], queries[q], offset)
            if overlap >= max(MIN_OVERLAP, min(len(prints[d]), len(queries[q])) / 2) and bits <= MAX_ERROR * 32 * overlap:
                found.append((d, q, offset, bits / (32 * overlap)))
    return found


def search(prints: DataFrame, is_query) -> DataFrame:
    """(id, n_frames, class_id, n_links, best_query, best_offset, bit_error_rate) of all recordings.

    prints: as from fingerprints(), ids not null.  is_query: a condition on id.
    A class links with the classes of queries that match it, itself left out.
    """
    spark = prints.sparkSession
    keyed = written(prints.withColumn("key", F.sha2("frames", 256)), "prints")
    classes = keyed.groupBy("key").agg(F.min("id").alias("class_id"), F.max(is_query).alias("asks"), F.max(F.length("frames")).alias("bytes"))
    first = written(keyed.join(classes, "key").where("id = class_id").select("class_id", "asks", "frames").dropDuplicates(["class_id"]), "classes")
    asks = first.where("asks AND length(frames) > 0")
    blocks = max(1, -(-(asks.agg(F.sum(F.length("frames"))).first()[0] or 0) // BLOCK_BYTES))
    kind = prints.schema["id"].dataType.simpleString()
    links, path = f"class_id {kind}, query {kind}, offset long, error double", new_path(spark, "links")

    def against(block: list) -> None:
        held = spark.sparkContext.broadcast(([r["class_id"] for r in block], [bytes(r["frames"]) for r in block]))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, queries = held.value[0], [np.frombuffer(x, np.uint32) for x in held.value[1]]
            for batch in batches:
                mine = batch.column(0).to_pylist()
                found = [(mine[d], ids[q], offset, error) for d, q, offset, error in align(queries, [np.frombuffer(x, np.uint32) for x in batch.column(1).to_pylist()]) if mine[d] != ids[q]]
                columns = list(zip(*found)) or [(), (), (), ()]
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], batch.column(0).type), pa.array(columns[1], batch.column(0).type), pa.array(columns[2], pa.int64()), pa.array(columns[3], pa.float64())], ["class_id", "query", "offset", "error"])

        first.select("class_id", "frames").mapInArrow(run, links).write.mode("append").parquet(path)
        held.destroy()

    for i in range(blocks):
        against(asks.where(F.pmod(F.xxhash64("class_id"), F.lit(blocks)) == i).select("class_id", "frames").collect())
    found = spark.read.schema(links).parquet(path)
    best = found.groupBy("class_id").agg(F.count("*").alias("n_links"), F.min(F.struct("error", "query", "offset")).alias("best"))
    rows = keyed.join(classes.select("key", "class_id"), "key").join(best, "class_id", "left")
    return rows.select("id", (F.length("frames") / 4).cast("long").alias("n_frames"), "class_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.col("best.query").alias("best_query"), F.col("best.offset").alias("best_offset"), F.col("best.error").alias("bit_error_rate"))


def recordings(conversations: DataFrame) -> DataFrame:
    """(id, text): the words of each conversation in order of turns, of which melodies() makes its recording."""
    turns = F.array_sort(F.collect_list(F.struct("turn", F.coalesce("text", F.lit("")).alias("text"))))
    whole = conversations.where("conv_id IS NOT NULL").groupBy("conv_id").agg(turns.alias("turns"))
    return whole.select(F.col("conv_id").alias("id"), F.array_join(F.transform("turns", lambda t: t["text"]), " ").alias("text"))
