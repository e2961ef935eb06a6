"""Token-id files: documents compressed one by one with a shared zstandard dictionary.

Ids are serialised as little-endian integers of two bytes, or four if the
vocabulary needs it.  The dictionary is trained on the serialised ids of a
sample (up to TRAIN_DOCS documents with the smallest hashes among those of at most
TRAIN_CHARS characters, which are the ones a dictionary helps); every document
is then encoded and compressed alone.  Documents are put in order by ranges of
doc_id, nulls last, and each range writes blocks:

    magic, SHA-256 of the dictionary, bytes an id, number of documents,
    offsets of the frames (unsigned 64-bit, one more than documents), frames

so that one document is read with its block's index and one frame.  Blocks are
the binary column of a Parquet table, written by Spark itself: any store that
Spark reaches will do, and a lost task is written again.

Defined results: a null or empty text is a document with the end id alone; rows
with the same doc_id follow each other by checksum; an empty table gives files
without blocks.
"""

from __future__ import annotations

import hashlib
import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from almanac.llm.encoding import RUN, RUNS, HashMemo, lower_runs
from almanac.llm.shared import new_path, written
from almanac.llm.text import slices, words

TRAIN_DOCS = 2000
TRAIN_CHARS = 4096
DICTIONARY_BYTES = 64 << 10
BLOCK_BYTES = 4 << 20
LEVEL = 3
#: Words that the library encodes in one call, whose memory grows with them.
AT_ONCE = 1024
_MAGIC = b"ALMIDS1\0"
_HEAD = struct.Struct("<8s32sBQ")

_memos: dict[str, HashMemo] = {}


def word_memo(tokenizer: str) -> HashMemo:
    """This process's memo of a tokenizers file that lower-cases and treats words and runs apart.

    Runs of plain characters go straight to the library's merges, AT_ONCE new ones together where
    the model marks the ends of words; any other word takes the whole way through its normaliser
    and splitter.
    """
    if tokenizer not in _memos:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        library = Tokenizer.from_file(tokenizer)
        merges, suffix = Tokenizer(library.model), getattr(library.model, "end_of_word_suffix", None)
        merges.pre_tokenizer = pre_tokenizers.Split(" ", "removed")
        last = np.zeros(library.get_vocab_size(with_added_tokens=True), bool)
        last[[i for t, i in library.get_vocab(with_added_tokens=False).items() if suffix and t.endswith(suffix)]] = True
        shown = {b: chr(0x100 + (b - 0x7F + 33 if b < 0xA1 else 67)) for b in (0x9F, 0xA0, 0xAD)}  # the model's names of bytes, where they aren't the code points

        def named(text: str) -> str:
            if not text.isascii():
                text = text.encode().decode("latin-1")
                for b, name in shown.items():
                    text = text.replace(chr(b), name)
            return text

        def some(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
            joined = b" ".join(words).decode("utf-8", "replace")
            if RUNS.fullmatch(joined):
                ids = np.array(merges.encode_batch_fast([named(joined)], add_special_tokens=False)[0].ids, np.int32)
                ends = np.flatnonzero(last[ids]) + 1
                if len(ends) == len(words) and ends[-1] == len(ids):
                    return ids, np.diff(ends, prepend=0)
            texts = [w.decode("utf-8", "replace") for w in words]
            merge, plain = library.model.tokenize, [RUN.fullmatch(t) for t in texts]
            whole = iter(library.encode_batch_fast([t for t, p in zip(texts, plain) if not p], add_special_tokens=False))
            found = [[x.id for x in merge(named(t))] if p else next(whole).ids for t, p in zip(texts, plain)]
            sizes = np.fromiter(map(len, found), np.int64, len(found))
            return np.fromiter((i for ids in found for i in ids), np.int32, int(sizes.sum())), sizes

        def encode(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
            ids, sizes = zip(*(some(words[i : i + AT_ONCE]) for i in range(0, len(words), AT_ONCE)))
            return np.concatenate(ids), np.concatenate(sizes)

        _memos[tokenizer] = HashMemo(encode)
    return _memos[tokenizer]


def forget_words(tokenizer: str) -> None:
    """Drop the words that this process has met, if any."""
    if tokenizer in _memos:
        _memos[tokenizer].clear()


def vocabulary(tokenizer: str) -> int:
    """Ids of a tokenizers file, added ones too."""
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer).get_vocab_size(with_added_tokens=True)


def train_dictionary(samples: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A dictionary for such samples; their own bytes where they are too few to train on, maybe none."""
    import zstandard

    if sum(map(len, samples)) >= 8 * size:
        return zstandard.train_dictionary(size, samples).as_bytes()
    return b"".join(samples)[-size:] if sum(map(len, samples)) >= 8 else b""


class Frames:
    """Compresses and restores documents with one dictionary."""

    def __init__(self, dictionary: bytes):
        import zstandard

        kind = {"dict_data": zstandard.ZstdCompressionDict(dictionary)} if dictionary else {}
        self.hash = hashlib.sha256(dictionary).digest()
        self.compress = zstandard.ZstdCompressor(level=LEVEL, write_checksum=False, write_dict_id=False, **kind).compress
        self.restore = zstandard.ZstdDecompressor(**kind).decompress


def write_block(frames: list[bytes], width: int, dictionary_hash: bytes) -> bytes:
    offsets = np.concatenate(([0], np.cumsum([len(f) for f in frames]))).astype("<u8")
    return b"".join([_HEAD.pack(_MAGIC, dictionary_hash, width, len(frames)), offsets.tobytes(), *frames])


class Block:
    """Reads the documents of one block."""

    def __init__(self, data: bytes, frames: Frames):
        magic, dictionary_hash, self.width, self.n = _HEAD.unpack_from(data)
        if magic != _MAGIC:
            raise ValueError("not a block of token ids")
        if dictionary_hash != frames.hash:
            raise ValueError("written with another dictionary")
        self.data, self.frames = memoryview(data), frames
        self.offsets = np.frombuffer(data, "<u8", self.n + 1, _HEAD.size).astype(np.int64)
        self.at = _HEAD.size + self.offsets.nbytes

    def document(self, i: int) -> np.ndarray:
        raw = self.frames.restore(self.data[self.at + self.offsets[i] : self.at + self.offsets[i + 1]])
        return np.frombuffer(raw, f"<u{self.width}")


def write_token_files(docs: DataFrame, tokenizer: str, path: str, *, end_id: int = 1, width: int | None = None) -> None:
    """Write the ids of docs (doc_id, text), each followed by end_id, to `path`; in `width` bytes, by default what they need."""
    spark = docs.sparkSession
    width = width or (2 if max(vocabulary(tokenizer) - 1, end_id) < 1 << 16 else 4)
    dtype = f"<u{width}"

    def serialised(texts: pa.Array) -> list[bytes]:
        ids, bounds = word_memo(tokenizer).ids(lower_runs(words(texts)))
        if len(ids) and int(ids.max()) >= 1 << 8 * width:
            raise OverflowError(f"id {ids.max()} has more than {width} bytes")
        raw, end = ids.astype(dtype).tobytes(), np.array([end_id], dtype).tobytes()
        edges = (bounds * width).tolist()
        return [raw[a:b] + end for a, b in zip(edges, edges[1:])]

    def encode_only(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(serialised(batch.column(0)), pa.binary())], ["ids"])

    short = docs.where(F.length("text") <= TRAIN_CHARS).select(F.xxhash64(F.col("doc_id").cast("string"), "text").alias("_key"), "text")
    # Hashes are even over their range: those of the sample are below a limit, so few rows meet to be sorted.
    limit = -(1 << 63) + min((1 << 64) - 1, int((1 << 64) * 1.2 * TRAIN_DOCS / max(short.count(), 1)))
    short = short.where(F.col("_key") <= limit).orderBy("_key").limit(TRAIN_DOCS)
    dictionary = train_dictionary([r[0] for r in short.select("text").mapInArrow(encode_only, "ids binary").collect()])
    held = spark.sparkContext.broadcast(dictionary)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frames = Frames(held.value)
        for batch in batches:
            for a, b in slices(batch.column(1)):
                raw = serialised(batch.column(1)[a:b])
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], pa.array([zlib.crc32(r) for r in raw], pa.int64()), pa.array([len(r) // width for r in raw], pa.int64()), pa.array(map(frames.compress, raw), pa.binary())], ["doc_id", "crc", "n", "frame"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    compressed = written(docs.select("doc_id", "text").mapInArrow(encode, f"doc_id {kind}, crc long, n long, frame binary"), "frames")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, block, dictionary_hash = TaskContext.get().partitionId(), 0, hashlib.sha256(held.value).digest()
        ids, sizes, frames, before = [], [], [], 0

        def out() -> pa.RecordBatch:
            row = [[shard], [block], [before], [ids], [sizes], [write_block(frames, width, dictionary_hash)]]
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, (pa.int32(), pa.int32(), pa.int64(), pa.list_(doc_type), pa.list_(pa.int64()), pa.binary()))], ["shard", "block", "before", "doc_ids", "sizes", "data"])

        for batch in batches:
            doc_type = batch.column(0).type
            for doc, n, frame in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3)):
                ids.append(doc), sizes.append(n), frames.append(frame.as_py())
                if len(frames) >= 16384 or len(frames) % 64 == 0 and sum(map(len, frames)) >= BLOCK_BYTES:
                    yield out()
                    block, before = block + 1, before + sum(sizes)
                    ids, sizes, frames = [], [], []
        if frames:
            yield out()

    order = [F.col("doc_id").asc_nulls_last(), F.col("crc")]
    ranged = compressed.repartitionByRange(*order).sortWithinPartitions(*order)
    ranged.mapInArrow(pack, f"shard int, block int, before long, doc_ids array<{kind}>, sizes array<long>, data binary").write.parquet(f"{path}/blocks")
    spark.createDataFrame([(dictionary, hashlib.sha256(dictionary).hexdigest())], "data binary, sha256 string").write.parquet(f"{path}/dictionary")


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids): every document of the files with its ids as 32-bit binary."""
    blocks = spark.read.parquet(f"{path}/blocks")
    held = spark.sparkContext.broadcast(bytes(spark.read.parquet(f"{path}/dictionary").first()["data"]))
    # One row a shard with its ids.  Shards are ranges in order, as many as the writer had partitions.
    last = F.col("before") + F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x)
    shards = blocks.groupBy("shard").agg(F.max(last).alias("n")).collect()
    starts, total = [], 0
    for r in sorted(shards, key=lambda r: r["shard"]):
        starts.append((r["shard"], total))
        total += r["n"]
    begin = F.broadcast(spark.createDataFrame(starts, "shard int, begin long"))

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frames = Frames(held.value)
        for batch in batches:
            for i in range(batch.num_rows):
                block = Block(batch.column(3)[i].as_py(), frames)
                sizes = np.array(batch.column(2)[i].as_py(), np.int64)
                starts = batch.column(0)[i].as_py() + np.cumsum(sizes) - sizes
                docs = batch.column(1)[i].values
                for a in range(0, block.n, 1024):
                    ids = [block.document(j).astype("<u4").tobytes() for j in range(a, min(a + 1024, block.n))]
                    yield pa.RecordBatch.from_arrays([docs[a : a + len(ids)], pa.array(starts[a : a + len(ids)], pa.int64()), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())], ["doc_id", "start", "n_tokens", "ids"])

    kind = blocks.schema["doc_ids"].dataType.elementType.simpleString()
    rows = blocks.join(begin, "shard").select((F.col("begin") + F.col("before")).alias("start"), "doc_ids", "sizes", "data")
    return rows.mapInArrow(unpack, f"doc_id {kind}, start long, n_tokens long, ids binary")


def token_files(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Write the files to the shared folder and read them back."""
    path = new_path(docs.sparkSession, "ids")
    write_token_files(docs, tokenizer, path)
    return read_token_files(docs.sparkSession, path)
