"""SentencePiece encoding and decoding with the `tokenizers` library as backend.

The model's protobuf is read field by field, and a `tokenizers` tokenizer is
rebuilt from it: the normaliser (precompiled map, extra spaces, dummy prefix),
the marker for spaces, unigram scores or the merges that BPE scores imply, and
byte fallback.  Texts are cut where no piece of the vocabulary can reach across:
before a space that follows something else, and around characters that occur in
no piece.  Each distinct chunk is encoded once per worker, many at a time and
multithreaded, and compared with the `sentencepiece` library; where the two
differ, the ids stay those of the backend and `parity` is false for the document.

Defined results: a null or empty text has no ids and decodes to the empty text.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from almanac.llm.encoding import Memo, distinct
from almanac.llm.shared import per_slice
from almanac.llm.text import Words, buffers

_MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2


def _fields(data: bytes) -> Iterator[tuple[int, int | float | bytes]]:
    """(number, value) of each field of a protobuf message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 0x7F) << shift
            shift += 7
            if byte < 0x80:
                return value

    while at < len(data):
        number, kind = divmod(varint(), 8)
        if kind == 0:
            yield number, varint()
        elif kind == 2:
            size = varint()
            at += size
            yield number, data[at - size : at]
        else:
            size = 4 if kind == 5 else 8
            at += size
            yield number, struct.unpack("<f" if kind == 5 else "<d", data[at - size : at])[0]


@dataclass
class Model:
    """What a SentencePiece model file says."""

    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    kind: int = UNIGRAM
    byte_fallback: bool = False
    charsmap: bytes = b""
    dummy_prefix: bool = True
    trim_spaces: bool = True
    escape_spaces: bool = True
    unknown: int = 0


def read_model(path: str) -> Model:
    """Parse a model file."""
    with open(path, "rb") as file:
        data = file.read()
    model = Model()
    for number, value in _fields(data):
        if number == 1:
            piece = dict(_fields(value))
            model.pieces.append((piece[1].decode(), piece.get(2, 0.0), piece.get(3, NORMAL)))
        elif number == 2:
            trainer = dict(_fields(value))
            model.kind, model.byte_fallback, model.unknown = trainer.get(3, UNIGRAM), bool(trainer.get(35, 0)), trainer.get(40, 0)
        elif number == 3:
            rules = dict(_fields(value))
            model.charsmap = rules.get(2, b"")
            model.dummy_prefix, model.trim_spaces, model.escape_spaces = (bool(rules.get(n, 1)) for n in (3, 4, 5))
    return model


def merges(model: Model) -> list[tuple[str, str]]:
    """The merges that a BPE model's scores imply, best score first."""
    number = {piece: i for i, (piece, _, kind) in enumerate(model.pieces) if kind in (NORMAL, USER, UNUSED)}
    found = []
    for piece, i in number.items():
        for at in range(1, len(piece)):
            left, right = piece[:at], piece[at:]
            if left in number and right in number:
                found.append((-model.pieces[i][1], i, number[left], number[right], left, right))
    return [(left, right) for *_, left, right in sorted(found)]


def build(model: Model, prefix: bool = True):
    """A tokenizers tokenizer for the model; without prefix, for a chunk of normalised text."""
    from tokenizers import Tokenizer, decoders, models, normalizers

    if model.kind == BPE:
        vocabulary = {piece: i for i, (piece, _, _) in enumerate(model.pieces)}
        tokenizer = Tokenizer(models.BPE(vocab=vocabulary, merges=merges(model), unk_token=model.pieces[model.unknown][0], fuse_unk=True, byte_fallback=model.byte_fallback, cache_capacity=0))
    elif model.kind == UNIGRAM:
        tokenizer = Tokenizer(models.Unigram([(piece, score) for piece, score, _ in model.pieces], model.unknown, model.byte_fallback))
    else:
        raise ValueError("neither a unigram nor a BPE model")
    steps = [normalizers.Precompiled(model.charsmap)] if model.charsmap else []
    if model.trim_spaces:
        from tokenizers import Regex

        steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
    if prefix and model.dummy_prefix:
        steps.append(normalizers.Prepend(_MARK if model.escape_spaces else " "))
    if model.escape_spaces:
        steps.append(normalizers.Replace(" ", _MARK))
    tokenizer.normalizer = normalizers.Sequence(steps)
    tokenizer.decoder = decoders.Sequence([decoders.Replace(_MARK, " "), decoders.ByteFallback(), decoders.Fuse(), *([decoders.Strip(" ", 1, 0)] if model.dummy_prefix else [])])
    return tokenizer


class Codec:
    """Encodes and decodes columns of texts with one model file."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = read_model(path)
        normal = [piece for piece, _, kind in self.model.pieces if kind in (NORMAL, USER, UNUSED)]
        self.whole = bool(self.model.kind != BPE or self.model.charsmap or self.model.trim_spaces or not (self.model.dummy_prefix and self.model.escape_spaces) or any(_MARK in p.lstrip(_MARK) for p in normal))
        self.alone = not any("\n" in p for p in normal)
        self.library, self.other = build(self.model, prefix=self.whole), sentencepiece.SentencePieceProcessor(model_file=path)
        self.memo = Memo(self._encode)
        shown = [bytes([int(p[3:-1], 16)]) if kind == BYTE else b"" if kind == CONTROL else p.replace(_MARK, " ").encode() for p, _, kind in self.model.pieces]
        self.size = np.array([len(b) for b in shown], np.int64)
        self.start, self.shown = np.cumsum(self.size) - self.size, np.frombuffer(b"".join(shown), np.uint8)
        self.bad: set[bytes] = set()

    def _encode(self, chunks: list[str]) -> list[list[int]]:
        os.environ["TOKENIZERS_PARALLELISM"] = "true"
        ids = [e.ids for e in self.library.encode_batch_fast(chunks, add_special_tokens=False)]
        # The other library puts a space before each text: it stands for the chunk's own, or a line break divides it off.
        there = self.other.encode([c[1:] if c[0] in (" ", _MARK) and len(c) > 1 else "\n" + c for c in chunks], num_threads=1)
        there = [t if c[0] in (" ", _MARK) and len(c) > 1 else t[2:] for c, t in zip(chunks, there)]
        self.bad.update(c.encode() for c, a, b in zip(chunks, ids, there) if a != b)
        return ids

    def chunks(self, data: np.ndarray, offsets: np.ndarray) -> Words:
        """Texts, each behind the dummy prefix, cut where no piece reaches across."""
        sizes = np.diff(offsets)
        full = sizes > 0
        new = offsets + np.concatenate(([0], np.cumsum(full)))
        out = np.full(int(new[-1]), 0x20, np.uint8)
        firsts = new[:-1][full]
        plain = np.ones(len(out), bool)
        plain[firsts] = False
        out[plain] = data
        n = len(out)
        begins = np.zeros(n + 1, bool)
        space = out == 0x20
        marked = np.zeros(n + 1, bool)  # after a space or a literal marker
        marked[1:] = space
        literal = np.flatnonzero((out[:-2] == 0xE2) & (out[1:-1] == 0x96) & (out[2:] == 0x81)) if n > 2 else np.zeros(0, np.int64)
        marked[literal + 3] = True
        begins[:n] = space & ~marked[:n]
        if self.alone:
            breaks = np.flatnonzero(out == 0x0A)
            begins[breaks] = True
            begins[breaks + 1] = True
        begins[firsts] = True
        start = np.flatnonzero(begins[:n])
        return Words(out, start, np.append(start[1:], n) if len(start) else start, np.searchsorted(start, new), new)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all texts in a row, the bounds of each, and whether the other library gives the same."""
        if self.whole:
            os.environ["TOKENIZERS_PARALLELISM"] = "true"
            given = [t or "" for t in texts.to_pylist()]
            found = [e.ids for e in self.library.encode_batch_fast(given, add_special_tokens=False)]
            parity = np.array([a == b for a, b in zip(found, self.other.encode(given, num_threads=1))], bool)
            return np.array([i for x in found for i in x], np.int64), np.cumsum([0, *map(len, found)]), parity
        cut = self.chunks(*buffers(texts))
        codes, first = distinct(cut.hashes())
        raw = cut.data.tobytes()
        keys = [raw[a:b] for a, b in zip(cut.start[first].tolist(), cut.end[first].tolist())]
        rows = self.memo.rows(keys)
        ids, bounds = self.memo.gather(rows[codes], cut.bounds)
        wrong = np.array([k in self.bad for k in keys], bool) if self.bad else np.zeros(len(keys), bool)
        return ids, bounds, np.bincount(cut.doc(), wrong[codes], len(cut.bounds) - 1) == 0

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all texts in a row, and the offsets of each; the dummy prefix is dropped."""
        if self.whole:
            shown = [t.encode() for t in self.library.decode_batch([ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])], skip_special_tokens=False)]
            return np.frombuffer(b"".join(shown), np.uint8), np.cumsum([0, *map(len, shown)])
        sizes = self.size[ids]
        upto = np.concatenate(([0], np.cumsum(sizes)))
        at = np.repeat(self.start[ids] - upto[:-1], sizes)
        at += np.arange(len(at))
        out, edges = self.shown[at], upto[bounds]
        some = np.diff(edges) > 0
        first = edges[:-1][some]
        first = first[out[first] == 0x20]
        keep = np.ones(len(out), bool)
        keep[first] = False
        return out[keep], edges - np.searchsorted(first, edges)


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """This process's codec for a model file."""
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def encode_pieces(docs: DataFrame, model: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns of docs, and `ids` with the pieces of each text."""

    def measure(texts: pa.Array) -> dict:
        ids, bounds, parity = codec(model).encode(texts)
        return {"ids": pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids, pa.int32())), "parity": parity}

    return per_slice(docs, "ids array<int>, parity boolean", measure, keep)


def decode_pieces(rows: DataFrame, model: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns of rows, and `text` decoded from their `ids`."""
    from pyspark.sql.types import StructType

    schema = StructType([rows.schema[c] for c in keep]).add("text", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(len(keep)).fill_null([])
            bounds = np.asarray(ids.offsets, np.int64)
            data, edges = codec(model).decode(np.asarray(ids.values)[bounds[0] : bounds[-1]], bounds - bounds[0])
            raw = data.tobytes()
            texts = [raw[a:b].decode("utf-8", "replace") for a, b in zip(edges.tolist(), edges[1:].tolist())]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), pa.array(texts, pa.string())], names=[*keep, "text"])

    return rows.select(*keep, "ids").mapInArrow(run, schema)


def piece_digests(docs: DataFrame, model: str, keep: tuple[str, ...] = ("doc_id",), with_ids: bool = False) -> DataFrame:
    """Encode and decode in one go: n_bytes, n_tokens, ids_crc32, parity, and whether the text came back.

    Equal texts in a row, as a mix repeats them, are encoded once.  `with_ids` adds the ids.
    """

    def measure(texts: pa.Array) -> dict:
        again = np.zeros(len(texts), bool)
        again[1:] = np.asarray(pc.fill_null(pc.equal(texts[1:], texts[:-1]), False))
        row = np.cumsum(~again) - 1
        texts = texts.take(pa.array(np.flatnonzero(~again)))
        ids, bounds, parity = codec(model).encode(texts)
        data, edges = codec(model).decode(ids, bounds)
        raw, edge = ids.astype("<u4").tobytes(), (4 * bounds).tolist()
        was, offsets = buffers(texts)
        now, then, a, b = data.tobytes(), was.tobytes(), edges.tolist(), offsets.tolist()
        mark = _MARK.encode()
        same = [now[a[i] : a[i + 1]] == then[b[i] : b[i + 1]].replace(mark, b" ") for i in range(len(b) - 1)]
        found = {"n_bytes": np.diff(offsets), "n_tokens": np.diff(bounds), "ids_crc32": [zlib.crc32(raw[x:y]) for x, y in zip(edge, edge[1:])], "parity": parity, "round_trip": same}
        if with_ids:
            found["ids"] = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids, pa.int32()))
        return {c: (v if isinstance(v, pa.Array) else pa.array(v)).take(pa.array(row)) for c, v in found.items()}

    added = "n_bytes long, n_tokens long, ids_crc32 long, parity boolean, round_trip boolean" + ", ids array<int>" * with_ids
    return per_slice(docs, added, measure, keep)
