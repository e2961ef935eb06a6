"""The whole corpus pipeline against plain versions of its stages; fingerprints and their search against direct sums and brute force."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import corpus_pipeline
import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import sentencepiece
from pyspark.sql import functions as F

from almanac.llm import media, mixing, quality, text

WORD = re.compile(text.WORD)


def plain_classes(texts, k, percent):
    """The first of each class of near duplicates, by all pairs."""
    sets = {}
    for i, t in texts.items():
        w = [x.lower() if x.isascii() else x for x in WORD.findall(t)]
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} or {tuple(w)}
    root = {i: i for i in texts}
    for a in texts:
        for b in texts:
            small, large = sorted((len(sets[a]), len(sets[b])))
            if a < b and 100 * small >= percent * large and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                old, new = max(root[a], root[b]), min(root[a], root[b])
                root = {i: new if r == old else r for i, r in root.items()}
    return {i for i, r in root.items() if i == r}


def plain_cut(texts, k=13):
    """Texts without the words of windows that start in an earlier document too."""
    first, out = {}, {}
    for i, t in sorted(texts.items()):
        found = list(WORD.finditer(t))
        w, gone = [m.group() for m in found], [False] * len(found)
        for j in range(len(w) - k + 1):
            if first.setdefault(tuple(w[j : j + k]), i) < i:
                gone[j : j + k] = [True] * k
        starts = [m.start() for m in found] + [len(t)]
        out[i] = "".join(t[starts[j] : starts[j + 1]] for j in range(len(w)) if not gone[j]) if any(gone) else t
    return out


def test_run_is_what_plain_stages_give(spark, tmp_path):
    table = pq.read_table("/root/testdata/sf0.001/documents.parquet").to_pandas()
    rng = random.Random(5)
    good = [t for t in table.text if t and t.isascii() and 60 <= len(WORD.findall(t)) <= 300][:40]
    extra, start = [], int(table.doc_id.max()) + 1
    for t in good:  # edited once to thrice, some of them across the threshold, and a passage of another one
        w = WORD.findall(t)
        for _ in range(rng.randrange(1, 4)):
            w[rng.randrange(len(w))] = f"edit{rng.randrange(1000)}"
        extra.append(" ".join(w))
        extra.append(" ".join(WORD.findall(rng.choice(good))[5:50] + [f"new{rng.randrange(10**6)}" for _ in range(60)]))
    more = pd.DataFrame({"doc_id": range(start, start + len(extra)), "text": extra, "lang": "en", "source": [rng.choice(table.source.dropna().unique()) for _ in extra], "n_chars": [len(t) for t in extra]})
    path = tmp_path / "documents.parquet"
    pq.write_table(pa.Table.from_pandas(pd.concat([table, more])[list(table.columns)], preserve_index=False), path)

    docs = spark.read.parquet(str(path))
    found = corpus_pipeline.run(spark, str(tmp_path)).collect()
    good = {r["doc_id"]: r["text"] for r in quality.keep_good(docs).collect()}
    assert 0 < len(good) < docs.count()
    stay = plain_classes(good, 5, 80)
    assert len(stay) < len(good)
    texts = plain_cut({i: good[i] for i in stay})
    assert any(texts[i] != good[i] for i in stay)

    other = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    ids = {i: other.encode(t) for i, t in texts.items()}
    crc = {i: zlib.crc32(np.array(x, "<u4").tobytes()) for i, x in ids.items()}
    assert {r["doc_id"] for r in found} <= set(texts)
    assert all(r["ids"] == ids[r["doc_id"]] and r["n_tokens"] == len(r["ids"]) for r in found)
    assert all(r["ids_crc32"] == crc[r["doc_id"]] and r["parity"] for r in found)

    source = {r["doc_id"]: r["source"] for r in docs.select("doc_id", "source").collect()}
    size, taken, largest = Counter(), Counter(), Counter()
    for i, t in texts.items():
        n = len(WORD.findall(t))
        size[source[i]] += n
        largest[source[i]] = max(largest[source[i]], n)
    times = Counter(r["doc_id"] for r in found)
    for i, n in times.items():
        assert n <= 2
        taken[source[i]] += n * len(WORD.findall(texts[i]))
    assert all(abs(taken[s] - want) <= largest[s] for s, want in mixing.targets(dict(size)).items())


def plain_fingerprint(image):
    """Codes of the filters from sums of the image's cells, one by one."""
    image = np.pad(image, ((0, max(0, media.WINDOW - len(image))), (0, 0)))
    out = []
    for t in range(len(image) - media.WINDOW + 1):
        packed = 0
        for kind, y, h, w in media.FILTERS:
            frames = image[t + media.WINDOW - w : t + media.WINDOW]
            block = frames[:, y : y + h]
            rest = block.sum()
            if kind == 0:
                part, rest = block.sum(), frames.sum()
            elif kind == 1:
                part = block[:, : h // 2].sum()
            elif kind == 2:
                part = block[: w // 2].sum()
            elif kind == 3:
                part = block[: w // 2, : h // 2].sum() + block[w // 2 : 2 * (w // 2), h // 2 : 2 * (h // 2)].sum()
            elif kind == 4:
                part = block[:, h // 3 : 2 * (h // 3)].sum()
            else:
                part = block[w // 3 : 2 * (w // 3)].sum()
            value = round(float(np.log((1 + part) / (1 + rest - part))), 6)
            packed = packed << 2 | int(media.CODES[sum(value > s for s in media.STEPS)])
        out.append(packed)
    return out


@pytest.mark.parametrize("n", [1, 11, 12, 60])
def test_packed_integers_are_direct_sums(n):
    rng = np.random.default_rng(n)
    image = rng.random((n, 12)) ** 4
    assert media.fingerprint(image).tolist() == plain_fingerprint(image)


def test_search_in_small_blocks_finds_what_brute_force_finds(spark, monkeypatch):
    rng = random.Random(9)
    base = [[f"w{rng.randrange(400)}" for _ in range(rng.randrange(40, 160))] for _ in range(12)]
    rows = []
    for i in range(60):
        words = [w if rng.random() > 0.03 else f"w{rng.randrange(400)}" for w in base[i % 12]]
        rows.append((i, " ".join(["rest"] * (i % 7) + words)))
    rows += [(60, " ".join(["rest"] * 300)), (61, " ".join(["rest"] * 280)), (62, None)]
    prints = media.fingerprints(spark.createDataFrame(rows, "id long, text string"), "text", media.melodies)
    frames = {r["id"]: np.frombuffer(bytes(r["frames"]), np.uint32) for r in prints.collect()}

    def match(a, b):
        for offset in range(-len(b), len(a)):
            bits, n = media.bit_errors(a, b, offset)
            if n >= max(media.MIN_OVERLAP, min(len(a), len(b)) / 2) and bits <= media.MAX_ERROR * 32 * n:
                return True
        return False

    queries = [i for i in frames if i % 5 == 0]
    want = {i: sum(match(frames[i], frames[q]) for q in queries if q != i) for i in frames}
    monkeypatch.setattr(media, "BLOCK_BYTES", 1500)
    monkeypatch.setattr(media, "VOTES", 100)
    got = {r["id"]: r["n_links"] for r in media.search(prints, F.col("id") % 5 == 0).collect()}
    assert len({bytes(f) for f in map(bytes, frames.values())}) == len(rows)  # each its own class
    assert all(got[i] <= want[i] for i in want)
    assert sum(got.values()) >= 0.9 * sum(want.values()) > 0
    assert got[61] >= 1 and got[62] == 0
