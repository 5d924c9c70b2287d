"""Token ids of whole batches of texts with a byte-level BPE file of the tokenizers library.

Such a tokenizer cuts a text into pre-tokens first, and a pre-token's ids do not depend on what stands
around it. The cuts of a batch are found at once on its bytes; equal pre-tokens are then brought together
by Arrow, and the library encodes each one a worker has not met before, many of them in one text, as most of a call's
time is not spent on ids. What a code point counts as (letter, number, white space, other) is asked of the library itself.

The library gets whole texts that hold one of its added tokens, a code point without a class here,
and all texts if the file has a normalizer, another pre-tokenizer or settings that this does not know.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from functools import lru_cache
from itertools import chain, compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLANK, LETTER, NUMBER, OTHER, UNKNOWN = range(5)
# Code points that get a class: all planes that texts commonly use.
RANGES = (range(0xD800), range(0xE000, 0x10000), range(0x1F000, 0x1FB00))
POINTS = 0x1FB00
# The contractions that the byte-level rule keeps as one pre-token.
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")
CACHE = 600_000
MISSES = 4096
# Pre-tokens that are joined in one text for the library.
JOINED = 64


@lru_cache(maxsize=2)
def load(path: str):
    """(tokenizer, pattern of its added tokens, classes of code points or None where only the library can tell)."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    added = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
    with open(path, encoding="utf-8") as f:
        about = json.load(f)
    cuts = about.get("pre_tokenizer") or {}
    known = (about.get("normalizer") is None and about["model"]["type"] == "BPE" and about["model"].get("dropout") is None
             and cuts.get("type") == "ByteLevel" and cuts.get("use_regex", True) and not cuts.get("add_prefix_space", True)
             and all(not t.lstrip and not t.rstrip for t in tokenizer.get_added_tokens_decoder().values()))
    return tokenizer, re.compile("|".join(map(re.escape, added)) or r"(?!)"), _classes(tokenizer) if known else None


def _classes(tokenizer) -> np.ndarray:
    """Class of each code point: it is of the kind with which it forms one pre-token."""
    classes = np.full(POINTS, UNKNOWN, np.uint8)
    for points in RANGES:
        kinds = []
        for mate in "a1!":
            text = "".join(f"{mate}{chr(p)}\n" for p in points)
            begins = np.zeros(len(text) + 1, bool)
            begins[[start for _, (start, _) in tokenizer.pre_tokenizer.pre_tokenize_str(text)]] = True
            kinds.append(~begins[1:3 * len(points):3])
        classes[points.start:points.stop] = np.select(kinds, [LETTER, NUMBER, OTHER], BLANK)
    return classes


def point_classes(data: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Class of the code point that each byte of valid UTF-8 belongs to."""
    out = np.append(classes[:128], np.full(128, UNKNOWN, np.uint8))[data]
    wide = np.flatnonzero(data >= 0xC0)
    if len(wide):
        lead = data[wide]
        size = np.where(lead < 0xE0, 2, np.where(lead < 0xF0, 3, 4))
        point = np.where(lead < 0xE0, lead & 0x1F, np.where(lead < 0xF0, lead & 0x0F, lead & 0x07)).astype(np.int64)
        for i in range(1, 4):
            more = np.flatnonzero(size > i)
            point[more] = point[more] << 6 | (data[wide[more] + i] & 0x3F)
        kind = np.full(len(wide), UNKNOWN, np.uint8)
        inside = point < POINTS
        kind[inside] = classes[point[inside]]
        for i in range(4):
            more = np.flatnonzero(size > i)
            out[wide[more] + i] = kind[more]
    return out


def pre_token_starts(data: np.ndarray, heads: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """Places where pre-tokens begin in texts that begin at ``heads``."""
    n = len(data)
    first = np.zeros(n, bool)
    first[heads[heads < n]] = True
    runs = first.copy()
    runs[1:] |= kind[1:] != kind[:-1]
    begins = runs.copy()
    # The last blank of a run before something else stands alone, or goes with that if it is a space.
    behind = np.flatnonzero(runs[1:] & (kind[1:] != BLANK) & (kind[:-1] == BLANK) & ~first[1:]) + 1
    last = behind - 1
    for _ in range(2):
        last -= (data[last] & 0xC0) == 0x80
    begins[last] = True
    begins[behind[data[behind - 1] == 0x20]] = False
    # A contraction begins with an apostrophe that no pre-token has taken and that a letter follows.
    marks = np.flatnonzero((data[:-1] == 0x27) & begins[:-1] & (kind[1:] == LETTER) & ~first[1:])
    if len(marks):
        padded = np.concatenate([data, np.zeros(3, np.uint8)])
        texts = np.concatenate([first, np.ones(3, bool)])
        for ending in CONTRACTIONS:
            fits = np.ones(len(marks), bool)
            for i, c in enumerate(ending.encode(), 1):
                fits &= (padded[marks + i] == c) & ~texts[marks + i]
            found = marks[fits]
            begins[found + 1] = False
            after = found + 1 + len(ending)
            begins[after[after < n]] = True
    return np.flatnonzero(begins)


def _bytes(texts: pa.Array) -> list[bytes]:
    """The UTF-8 of each string of a large_string array that begins at its buffers' beginning."""
    ends = np.frombuffer(texts.buffers()[1], np.int64)[:len(texts) + 1].tolist()
    data = (texts.buffers()[2] or pa.py_buffer(b"")).to_pybytes()
    return [data[i:j] for i, j in zip(ends[:-1], ends[1:], strict=True)]


class Encoder:
    """Ids of texts in one worker. What it has met stays in a cache, which is emptied when full."""

    def __init__(self, path: str, cache: int = CACHE):
        self.tokenizer, self.added, self.classes = load(path)
        self.cache, self.known = cache, {}
        self.vocabulary = self.tokenizer.get_vocab_size()
        self.width = np.dtype(np.uint16 if self.vocabulary <= 2**16 else np.uint32)
        # a token of a byte-level file has one character for each byte it stands for
        self.bytes = np.zeros(max(self.tokenizer.get_vocab().values(), default=0) + 1, np.int64)
        for token, i in self.tokenizer.get_vocab().items():
            self.bytes[i] = len(token)
        # what a pre-token of joined texts may begin with, behind one space
        self.heads = set() if self.classes is None else set(map(chr, np.flatnonzero((self.classes != BLANK) & (self.classes != UNKNOWN)).tolist()))

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, self.width) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _lookup(self, pieces: list[bytes]) -> list[bytes]:
        if len(self.known) > self.cache:
            self.known = {}
        found = list(map(self.known.get, pieces))
        misses = [i for i, x in enumerate(found) if x is None]
        for start in range(0, len(misses), MISSES):
            some = misses[start:start + MISSES]
            for i, ids in zip(some, self._coded([pieces[i] for i in some]), strict=True):
                found[i] = self.known[pieces[i]] = ids
        return found

    def _coded(self, pieces: list[bytes]) -> list[bytes]:
        """The library's ids of each pre-token. It gets texts of many pre-tokens, and the bytes that ids stand for tell where a
        pre-token's ids end. A pre-token that does not begin with one space has a line feed before it; no rule of the
        byte-level cuts joins what stands on the two sides of these. Runs of blanks go to the library one by one, and all
        pre-tokens if the ids of any do not end where it does or an added token came about."""
        texts = [p.decode() for p in pieces]
        fit = [(t[1:2] if t[0] == " " else t[0]) in self.heads for t in texts]
        parts = [t if t[0] == " " else "\n" + t for t, f in zip(texts, fit, strict=True) if f]
        joined = ["".join(parts[i:i + JOINED]) for i in range(0, len(parts), JOINED)]
        found: list[bytes] = []
        if joined and not any(map(self.added.search, joined)):
            coded = self.tokenizer.encode_batch_fast(joined, add_special_tokens=False)
            ids = np.array(list(chain.from_iterable(e.ids for e in coded)), self.width)
            steps = self.bytes[ids]
            places = np.append(0, np.cumsum(steps))
            sizes = np.fromiter(compress(map(len, pieces), fit), np.int64, len(parts))
            fed = np.fromiter((t[0] == "\n" for t in parts), np.int64, len(parts))
            ends = np.cumsum(sizes + fed)
            begins = ends - sizes
            first, last = np.searchsorted(places, begins), np.searchsorted(places, ends)
            # ids without bytes would leave open whose they are
            if places[-1] == ends[-1] and steps.all() and (places[first] == begins).all() and (places[last] == ends).all():
                data, w = ids.tobytes(), self.width.itemsize
                found = [data[i:j] for i, j in zip((first * w).tolist(), (last * w).tolist(), strict=True)]
        if not found:
            fit = [False] * len(pieces)
        alone = [t for t, f in zip(texts, fit, strict=True) if not f]
        # an array of the machine's numbers takes a few ids several times faster than numpy does
        single = (array(self.width.char, e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(alone, add_special_tokens=False))
        joint = iter(found)
        return [next(joint) if f else next(single) for f in fit]

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of each text; null counts as empty."""
        texts = pc.fill_null(texts, "").cast(pa.large_string())
        if self.classes is None:
            return self.whole(texts.to_pylist())
        at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
        raw = memoryview(texts.buffers()[2] or b"")[int(at[0]):int(at[-1])]
        at = at - at[0]
        data = np.frombuffer(raw, np.uint8)
        kind = point_classes(data, self.classes)
        odd = np.flatnonzero(np.add.reduceat(np.append(kind == UNKNOWN, False), at[:-1]) * (np.diff(at) > 0)) if (kind == UNKNOWN).any() else []
        whole = {int(i) for i in odd}
        content = texts.to_pylist() if whole or self._may_hold_added(raw) else None
        if content:
            whole |= {i for i, t in enumerate(content) if self.added.search(t)}
        starts = pre_token_starts(data, at[:-1], kind) if len(data) else np.empty(0, np.int64)
        spans = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(np.append(starts, len(data))), pa.py_buffer(raw))
        coded = spans.dictionary_encode()
        number = coded.indices.to_numpy()
        # of texts that go to the library whole no pre-token needs to be known
        used = np.ones(len(starts), bool)
        first = np.searchsorted(starts, at)
        for i in whole:
            used[first[i]:first[i + 1]] = False
        names = _bytes(coded.dictionary)
        if whole:
            needed = np.unique(number[used]).tolist()
            found = [b""] * len(names)
            for i, ids in zip(needed, self._lookup([names[i] for i in needed]), strict=True):
                found[i] = ids
        else:
            found = self._lookup(names)
        store = np.frombuffer(b"".join(found), self.width)
        length = np.fromiter(map(len, found), np.int64, len(found)) // self.width.itemsize
        place = np.cumsum(length) - length
        sizes = length[number]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        ids = store[np.repeat(place[number] - (ends - sizes), sizes) + np.arange(total)]
        cuts = np.append(0, ends)[first]
        out = [ids[i:j] for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
        if whole:
            rows = sorted(whole)
            for i, x in zip(rows, self.whole([content[i] for i in rows]), strict=True):
                out[i] = x
        return out

    def _may_hold_added(self, raw: memoryview) -> bool:
        data = bytes(raw)
        return any(t.content.encode() in data for t in self.tokenizer.get_added_tokens_decoder().values())


@lru_cache(maxsize=1)
def worker_encoder(path: str) -> Encoder:
    """The encoder of a worker; what it has met serves the worker's later tasks too."""
    return Encoder(path)
