"""Token ids of whole texts by the tokenizers library, with each distinct pre-token encoded once per worker.

The library splits a text at a fixed pattern before it merges bytes, and no merge crosses a split. For texts of plain
characters (ASCII and Latin letters, which every Unicode version classes alike) the same split is found by array operations, distinct
pre-tokens go through the library, and their ids are gathered from a table. All other texts, and those that hold a special
token's string, go through the library whole. Either way the ids are the library's.
"""

from __future__ import annotations

import itertools
import os
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex

PLAIN = re.compile(r"[\n\t\r\x20-\x7e\xa1-ɏ]*")


LETTER, NUMBER, BLANK, OTHER, EDGE = 0, 1, 2, 3, 4
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")


def _classes() -> np.ndarray:
    """The class of each plain character; EDGE (character 0) stands between texts."""
    out = np.full(0x250, OTHER, np.uint8)
    for c in range(1, 0x250):
        x = chr(c)
        out[c] = LETTER if regex.fullmatch(r"\p{L}", x) else NUMBER if regex.fullmatch(r"\p{N}", x) else BLANK if x in " \n\t\r" else OTHER
    out[0] = EDGE
    return out


CLASSES = _classes()


def token_starts(c: np.ndarray) -> np.ndarray:
    """Where the library's byte-level split pattern starts a pre-token, over plain characters with EDGE around each text.

    A run of letters, of numbers or of other characters is one, with a space right before it; of several blanks before such a run
    the last stands apart; an apostrophe that starts a run takes a contraction's letters.
    """
    k = CLASSES[c]
    before, after = np.concatenate([[EDGE], k[:-1]]), np.concatenate([k[1:], [EDGE]])
    space = np.concatenate([[False], c[:-1] == 32])
    blank = k == BLANK
    starts = np.where(blank, (before != BLANK) | ((after != BLANK) & (after != EDGE)), (k != before) & ~space) | (k == EDGE) | (before == EDGE)
    for p in np.flatnonzero((c == 39) & (before != OTHER) & ~space & (after == LETTER)):
        tail = c[p + 1 : p + 3].tobytes().decode("utf-32-le")
        if word := next((w for w in CONTRACTIONS if tail.startswith(w)), None):
            starts[p + 1] = False
            starts[p + 1 + len(word)] = True
    return starts


def split_texts(texts: list[str]) -> tuple[pa.Array, np.ndarray]:
    """All pre-tokens of plain texts, and how many each text has; no Python object is made for one."""
    edge = "\0"
    flat = edge + edge.join(texts) + edge
    c = np.frombuffer(flat.encode("utf-32-le"), np.uint32)
    at = np.flatnonzero(token_starts(c))
    width = np.cumsum(1 + (c >= 0x80), dtype=np.int32)  # plain characters take one or two bytes
    offsets = np.append(width[at] - 1 - (c[at] >= 0x80), width[-1]).astype(np.int32)
    words = pa.StringArray.from_buffers(len(at), pa.py_buffer(offsets), pa.py_buffer(flat.encode()))
    edges = np.flatnonzero(c[at] == 0)
    keep = np.ones(len(at), bool)
    keep[edges] = False
    return words.filter(pa.array(keep)), np.diff(edges) - 1


#: Distinct pre-tokens that a worker remembers before it starts anew.
MEMO = 400_000


class Memo(dict):
    """word -> its place in the table; an unknown word gets the next place and waits in ``new`` for its ids."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        at = self[word] = len(self)
        self.new.append(word)
        return at


class Encoder:
    def __init__(self, path: str, memo: int = MEMO):
        self.memo = memo
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.special = [t.content for t in self.lib.get_added_tokens_decoder().values()]
        #: a pre-token of its own between letters, and its only id
        self.bar = "\x00"
        self.bar_id = self.lib.encode(self.bar, add_special_tokens=False).ids[0]
        self.clear()

    def clear(self) -> None:
        self.index = Memo()
        self.ids, self.sizes, self.used, self.n = np.zeros(1 << 16, np.uint32), np.zeros(1 << 14, np.int64), 0, 0

    def _add(self, flat: np.ndarray, sizes: np.ndarray) -> None:
        while self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while self.n + len(sizes) > len(self.sizes):
            self.sizes = np.concatenate([self.sizes, np.zeros_like(self.sizes)])
        self.ids[self.used : self.used + len(flat)] = flat
        self.sizes[self.n : self.n + len(sizes)] = sizes
        self.used += len(flat)
        self.n += len(sizes)

    def learn(self) -> None:
        """Ids of the waiting words, in order. Stretches of words of letters go through the library as one text."""
        words, self.index.new = self.index.new, []
        for letters, run in itertools.groupby(words, key=lambda w: w.lstrip(" ").isalpha()):
            run = list(run)
            if letters:
                got = self.lib.encode_batch_fast([self.bar.join(run[i : i + 20_000]) + self.bar for i in range(0, len(run), 20_000)], add_special_tokens=False)
                flat = np.concatenate([np.array(e.ids, np.uint32) for e in got])
                ends = np.flatnonzero(flat == self.bar_id)
                self._add(flat[flat != self.bar_id], np.diff(ends, prepend=-1) - 1)
            else:
                got = [e.ids for e in self.lib.encode_batch_fast(run, add_special_tokens=False)]
                self._add(np.fromiter(itertools.chain.from_iterable(got), np.uint32), np.fromiter(map(len, got), np.int64, len(got)))

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each text, as unsigned 32-bit numbers; none for null or empty texts."""
        out: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(texts)
        if self.n > self.memo:
            self.clear()
        known = []
        for k, t in enumerate(texts):
            if not t:
                continue
            if PLAIN.fullmatch(t) is None or any(s in t for s in self.special):
                out[k] = np.array(self.lib.encode(t, add_special_tokens=False).ids, np.uint32)
            else:
                known.append(k)
        if not known:
            return out
        words, counts = split_texts([texts[k] for k in known])
        coded = words.dictionary_encode()
        place = np.fromiter(map(self.index.__getitem__, coded.dictionary.to_pylist()), np.int64, len(coded.dictionary))
        at = place[coded.indices.to_numpy()]
        if self.index.new:
            self.learn()
        first = np.cumsum(self.sizes[: self.n]) - self.sizes[: self.n]
        size = self.sizes[at]
        ends = np.cumsum(size)
        flat = self.ids[np.repeat(first[at] - (ends - size), size) + np.arange(ends[-1])]
        bounds = np.concatenate([[0], ends[np.cumsum(counts) - 1]])
        for k, a, b in zip(known, bounds, bounds[1:], strict=False):
            out[k] = flat[a:b]
        return out


@lru_cache(maxsize=2)
def encoder(path: str, memo: int = MEMO) -> Encoder:
    return Encoder(path, memo)
