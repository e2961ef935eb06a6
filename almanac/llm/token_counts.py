"""Token counts of a byte-level BPE tokenizer by compiled finite-state transducers.

Two deterministic transducers count the tokens of `tokenizers`' byte-level BPE:

* The *splitter* reads classes of characters and cuts a text into the pieces that
  merges cannot cross.  It has a dozen states, so a chunk of text is a map from
  the state before it to the state after it.  The maps of all chunks are built
  side by side, and a parallel prefix scan composes them into the state at each
  chunk's start; a last pass then finds the cuts.
* The *merger* reads the bytes of a piece.  After each prefix it knows the last
  token of the prefix's encoding, and that token's start is a prefix whose
  encoding is the beginning of the same one.  A state holds, for every start from
  which a vocabulary token may still grow, the node reached in the vocabulary's
  trie, the token before it, and the number of tokens up to it relative to now.
  Each transition is annotated with the change in the number of tokens.  Every
  piece begins in the initial state, whatever came before it: its map is constant
  and all pieces run side by side.

A sequence of tokens is what the merges make of its bytes if and only if every
two neighbours are what the merges make of theirs; the library itself is asked
about pairs of tokens, and about the class of each character, once for each.
States and transitions are compiled when a text first needs them and kept by the
worker process; beyond MOST_STATES the table starts anew.

Defined results: a null or empty text has no bytes and no tokens.  Added tokens
inside a text are single tokens, as by the library's default.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from almanac.llm.shared import per_slice
from almanac.llm.text import buffers

MOST_STATES = 250_000
MOST_PAIRS = 500_000
#: Characters in a chunk of the splitter's scan.
CHUNK = 128

# Classes of characters, as the library's splitter treats them.
UNKNOWN, LETTER, NUMBER, OTHER, SPACE, BLANK = range(6)
# Symbols of the splitter: a character's class and what little it must know of the next ones.
_IN_LETTER, _IN_NUMBER, _IN_OTHER, _QUOTE_1, _QUOTE_2, _RUN, _LAST_BLANK, _LAST_SPACE = range(8)
# States of the splitter: a cut comes next; inside a run of letters, numbers, others or white space;
# after a blank that belongs to what follows; one or two characters before a contraction's end.
_CUT, _L, _N, _O, _W, _AFTER_BLANK, _ONE_MORE, _TWO_MORE = range(8)
_RESET = 8  # added to a symbol that begins a text


def _splitter() -> tuple[np.ndarray, np.ndarray]:
    """Next state and cut flag by symbol (and _RESET) * 8 + state."""
    state, cut = np.zeros((16, 8), np.uint8), np.ones((16, 8), bool)
    for symbol, inside in ((_IN_LETTER, _L), (_IN_NUMBER, _N), (_IN_OTHER, _O), (_QUOTE_1, _O), (_QUOTE_2, _O)):
        fresh = {_QUOTE_1: _ONE_MORE, _QUOTE_2: _TWO_MORE}.get(symbol, inside)
        state[symbol] = fresh
        for before in (inside, _AFTER_BLANK):
            state[symbol, before], cut[symbol, before] = inside, False
    state[_IN_LETTER, _ONE_MORE], cut[_IN_LETTER, _ONE_MORE] = _CUT, False
    state[_IN_LETTER, _TWO_MORE], cut[_IN_LETTER, _TWO_MORE] = _ONE_MORE, False
    state[_RUN], cut[_RUN, _W] = _W, False
    state[_LAST_BLANK], state[_LAST_SPACE] = _AFTER_BLANK, _CUT
    state[_RESET:] = state[:_RESET, _CUT][:, None]
    return state.ravel(), cut.ravel()


_NEXT, _IS_CUT = _splitter()


class Splitter:
    """Cuts texts into pieces; classify tells the class of a code point."""

    def __init__(self, classify):
        self.classify, self.classes = classify, np.zeros(0x110000, np.uint8)

    def cuts(self, points: np.ndarray, resets: np.ndarray) -> np.ndarray:
        """Flags of characters that begin a piece; resets are flags of those that begin a text."""
        n = len(points)
        kinds = self.classes[points]
        if not kinds.all():
            new = np.unique(points[kinds == UNKNOWN])
            self.classes[new] = [self.classify(int(c)) for c in new]
            kinds = self.classes[points]
        symbols = np.array([0, _IN_LETTER, _IN_NUMBER, _IN_OTHER, _RUN, _RUN], np.uint8)[kinds]
        # White space before something else in the same text is the last of its run.
        ahead = np.zeros(n, bool)
        ahead[:-1] = ~resets[1:]
        solid = kinds < SPACE
        last = np.zeros(n, bool)
        last[:-1] = ~solid[:-1] & solid[1:] & ahead[:-1]
        symbols[last] = np.where(kinds[last] == BLANK, _LAST_BLANK, _LAST_SPACE)
        quotes = np.flatnonzero(points == ord("'"))
        quotes = quotes[ahead[quotes]]
        if len(quotes):
            one = points[quotes + 1]
            symbols[quotes[np.isin(one, [ord(c) for c in "stmd"])]] = _QUOTE_1
            two = quotes[ahead[quotes + 1]]
            one, then = points[two + 1], points[two + 2]
            symbols[two[((one == ord("r")) | (one == ord("v"))) & (then == ord("e")) | (one == ord("l")) & (then == ord("l"))]] = _QUOTE_2
        return self.scan(symbols + _RESET * resets.astype(np.uint8))

    @staticmethod
    def scan(symbols: np.ndarray) -> np.ndarray:
        """Cut flags by chunk maps, their prefix scan, and a pass from each chunk's state."""
        n = len(symbols)
        lanes = -(-n // CHUNK)
        padded = np.zeros(lanes * CHUNK, np.uint8)
        padded[:n] = symbols
        steps = np.ascontiguousarray(padded.reshape(lanes, CHUNK).T) * np.uint8(8)
        maps = np.tile(np.arange(8, dtype=np.uint8), (lanes, 1))
        for symbol in steps:
            maps = _NEXT[symbol[:, None] + maps]
        reach = 1
        while reach < lanes:
            # maps[i] becomes: first the map that ends `reach` chunks before, then this one.
            maps[reach:] = np.take_along_axis(maps[reach:], maps[:-reach].astype(np.intp), axis=1)
            reach *= 2
        state = np.zeros(lanes, np.uint8)
        state[1:] = maps[:-1, _CUT]
        cuts = np.empty((CHUNK, lanes), bool)
        for t, symbol in enumerate(steps):
            at = symbol + state
            cuts[t] = _IS_CUT[at]
            state = _NEXT[at]
        return cuts.T.ravel()[:n]


class Merger:
    """The transducer of byte-pair merges, compiled as texts ask for it."""

    def __init__(self, vocabulary: dict[bytes, int], encode):
        """encode: the library's merges of a byte string, as ids."""
        self.encode = encode
        self.token, self.bytes, self.child = {}, {}, [{}]
        for key, number in vocabulary.items():
            node = 0
            for b in key:
                nodes = self.child[node]
                if b not in nodes:
                    nodes[b] = len(self.child)
                    self.child.append({})
                node = nodes[b]
            self.token[node], self.bytes[number] = number, key
        self.pairs: dict[tuple[int, int], bool] = {}
        self.whole: dict[int, bool] = {}
        self.clear()

    def clear(self) -> None:
        first = ((0, -1, 0),)
        self.states, self.number = [first], {first: 0}
        self.column, self.columns, self.width = np.full(256, -1, np.int64), 0, 64
        self.next, self.change = np.full(1024 * 64, -1, np.int32), np.zeros(1024 * 64, np.int16)

    def fits(self, before: int, token: int) -> bool:
        """Whether the merges of the two tokens' bytes give the two tokens."""
        if before < 0:
            if token not in self.whole:
                self.whole[token] = self.encode(self.bytes[token]) == [token]
            return self.whole[token]
        pair = (before, token)
        if pair not in self.pairs:
            self.pairs[pair] = self.encode(self.bytes[before] + self.bytes[token]) == [before, token]
        return self.pairs[pair]

    def step(self, state: tuple, byte: int) -> tuple[tuple, int]:
        """The state after one more byte, and the change in the number of tokens."""
        kept, token, change = [], None, 0
        for node, before, tokens in state:
            node = self.child[node].get(byte)
            if node is None:
                continue
            if token is None and node in self.token and self.fits(before, self.token[node]):
                token, change = self.token[node], tokens + 1
            if self.child[node]:
                kept.append((node, before, tokens))
        return (*((node, before, tokens - change) for node, before, tokens in kept), (0, token, 0)), change

    def _compile(self, state: int, byte: int, at: int) -> None:
        after, change = self.step(self.states[state], byte)
        if after not in self.number:
            self.number[after] = len(self.states)
            self.states.append(after)
            if len(self.states) * self.width > len(self.next):
                self._resize(2 * len(self.next) // self.width, self.width)
        self.next[at], self.change[at] = self.number[after], change

    def _resize(self, rows: int, width: int) -> None:
        for name, empty in (("next", -1), ("change", 0)):
            old = getattr(self, name).reshape(-1, self.width)
            new = np.full((rows, width), empty, old.dtype)
            new[: len(old), : self.width] = old
            setattr(self, name, new.ravel())
        self.width = width

    def counts(self, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Tokens of each piece data[start:start + size]."""
        if len(self.states) > MOST_STATES:
            self.clear()
        if len(self.pairs) > MOST_PAIRS:
            self.pairs.clear()
        for b in np.flatnonzero(np.bincount(data, minlength=256)):
            if self.column[b] < 0:
                if self.columns == self.width:
                    self._resize(len(self.next) // self.width, 2 * self.width)
                self.column[b], self.columns = self.columns, self.columns + 1
        by_column = np.zeros(256, np.int64)
        by_column[self.column[self.column >= 0]] = np.flatnonzero(self.column >= 0)
        # Longest first, so that those still running stand in front; 16-bit keys sort fastest.
        most = int(size.max()) if len(size) else 0
        order = np.argsort((most - size).astype(np.uint16 if most < 1 << 16 else np.int64), kind="stable")
        start, size = start[order], size[order]
        columns = self.column[data]
        longer = len(size) - np.cumsum(np.bincount(size))  # pieces of over t bytes
        state, total = np.zeros(len(start), np.int32), np.zeros(len(start), np.int32)
        for t in range(int(size[0]) if len(size) else 0):
            m = int(longer[t])
            keys = state[:m].astype(np.int64) * self.width + columns[start[:m] + t]
            after = self.next[keys]
            if (after < 0).any():
                for key in np.unique(keys[after < 0]).tolist():
                    self._compile(key // self.width, int(by_column[key % self.width]), key)
                after = self.next[keys]
            total[:m] += self.change[keys]
            state[:m] = after
        counts = np.empty_like(total)
        counts[order] = total
        return counts


class Counter:
    """Counts tokens of texts for one tokenizers file with byte-level BPE."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        library = Tokenizer.from_file(path)
        rules = json.loads(library.to_str())
        pre, model = rules["pre_tokenizer"], rules["model"]
        if rules["normalizer"] or pre["type"] != "ByteLevel" or not pre["use_regex"] or pre["add_prefix_space"] or model["type"] != "BPE" or model["end_of_word_suffix"] or model["ignore_merges"]:
            raise ValueError(f"{path} isn't a byte-level BPE with the usual splitter")
        plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        shown = {b: chr(b) for b in plain}
        shown |= {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in shown)}
        back = {c: b for b, c in shown.items()}
        added = {t["content"] for t in rules["added_tokens"]}
        self.added = [t.encode() for t in sorted(added, key=len, reverse=True)]
        vocabulary = {bytes(back[c] for c in token): number for token, number in model["vocab"].items() if token not in added}
        self.merger = Merger(vocabulary, lambda raw: [t.id for t in library.model.tokenize("".join(map(shown.get, raw)))])
        cut = library.pre_tokenizer.pre_tokenize_str

        def classify(point: int) -> int:
            c = chr(point)
            for kind, probe in ((LETTER, "a"), (NUMBER, "1"), (OTHER, "!")):
                if len(cut(probe + c)) == 1:
                    return kind
            return BLANK if c == " " else SPACE

        self.splitter = Splitter(classify)

    def __call__(self, texts: pa.Array) -> dict:
        data, offsets = buffers(texts)
        n = len(offsets) - 1
        begins, singles = offsets[:-1], np.zeros(0, np.int64)
        whole = data.tobytes()
        for special in self.added:
            at, found = whole.find(special), []
            while at >= 0:
                if offsets[np.searchsorted(offsets, at, "right")] >= at + len(special):
                    found.append(at)
                at = whole.find(special, at + len(special))
            if found:
                singles = np.append(singles, found)
                begins = np.concatenate((begins, found, np.array(found) + len(special)))
        firsts = np.flatnonzero((data & 0xC0) != 0x80)
        points = np.frombuffer(whole.decode().encode("utf-32-le"), np.uint32)
        resets = np.zeros(len(data) + 1, bool)
        resets[begins] = True
        start = firsts[self.splitter.cuts(points, resets[firsts])] if len(data) else np.zeros(0, np.int64)
        if len(singles):  # what the splitter cut inside them is one piece
            inside = np.searchsorted(np.sort(singles), start, "right") - 1
            held = np.sort(singles)[np.maximum(inside, 0)]
            widths = np.array([next(len(s) for s in self.added if whole.startswith(s, h)) for h in held.tolist()]) if len(held) else held
            start = start[(inside < 0) | (start == held) | (start >= held + widths)]
        size = np.diff(np.append(start, len(data)))
        counts = self.merger.counts(data, start, size)
        counts[np.isin(start, singles)] = 1
        upto = np.concatenate(([0], np.cumsum(counts)))[np.searchsorted(start, offsets)]
        return {"n_bytes": np.diff(offsets), "n_tokens": np.diff(upto)} if n else {"n_bytes": [], "n_tokens": []}


_counters: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    """This process's counter for a tokenizers file."""
    if path not in _counters:
        _counters[path] = Counter(path)
    return _counters[path]


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 1024, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns of docs, n_bytes, n_tokens, and whether n_tokens is over the limit."""
    counted = per_slice(docs, "n_bytes long, n_tokens long", lambda texts: counter(tokenizer)(texts), keep)
    return counted.selectExpr("*", f"n_tokens > {int(limit)} AS over_limit")
