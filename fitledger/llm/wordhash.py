"""Hashes of all words of an Arrow batch of texts at once, with A-Z lower-cased.

Works on the UTF-8 bytes: the separators of the word rules are ASCII, and no byte of a longer
character is. A hash is a polynomial over a word's bytes modulo 2**64, mixed."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

LOWER = np.arange(256, dtype=np.uint64) + 1
LOWER[65:91] += 32
# Byte classes of words: all but blank and \t-\r; letters, digits and whatever is not ASCII.
NOT_BLANK = np.ones(256, bool)
NOT_BLANK[[32, *range(9, 14)]] = False
ALNUM = np.zeros(256, bool)
ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
STEP = 0x9E3779B97F4A7C15
CHUNK_BYTES = 1_000_000


def powers(n: int) -> np.ndarray:
    p = np.full(max(n, 1), 0xD6E8FEB86659FD93, np.uint64)
    p[0] = 1
    return np.cumprod(p, dtype=np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(STEP)
    return h ^ (h >> np.uint64(29))


def sized_chunks(batches: Iterator[pa.RecordBatch], columns: tuple[str, ...], size: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches with about ``size`` bytes in the named text or binary columns, one row at least."""
    for b in batches:
        ends = np.cumsum(sum(pc.fill_null(pc.binary_length(b.column(c)), 0).to_numpy(zero_copy_only=False) for c in columns), dtype=np.int64)
        start = 0
        while start < b.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + size, side="right")))
            yield b.slice(start, stop - start)
            start = stop


def text_chunks(batches: Iterator[pa.RecordBatch], text: str = "text", size: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``size`` bytes of text, one row at least."""
    return sized_chunks(batches, (text,), size)


# Scripts that are written without blanks, as ranges of code points.
NO_BLANKS = [(0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3040, 0x30FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x3FFFF)]


def alone(data: np.ndarray) -> np.ndarray:
    """Places of bytes where a character of a script without blanks begins, and where the one after it does."""
    lead = np.flatnonzero(data >= 0xE0)
    if not len(lead):
        return lead
    long = data[lead] >= 0xF0
    padded = np.concatenate([data, np.zeros(3, np.uint8)]).astype(np.int64)
    a, b, c, d = (padded[lead + i] for i in range(4))
    point = np.where(long, (a & 7) << 18 | (b & 63) << 12 | (c & 63) << 6 | (d & 63), (a & 15) << 12 | (b & 63) << 6 | (c & 63))
    found = np.zeros(len(lead), bool)
    for first, last in NO_BLANKS:
        found |= (point >= first) & (point <= last)
    ends = lead[found] + np.where(long[found], 4, 3)
    return np.concatenate([lead[found], ends[ends < len(data)]])


def word_hashes(texts: pa.Array, is_word: np.ndarray, split: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, and the place of each text's first one (and the end). With ``split`` every
    character of a script without blanks is a word."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[at[0]:at[-1]]
    at = at - at[0]
    if not len(data):
        return np.empty(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    inside = is_word[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    heads = at[:-1][at[:-1] < len(data)]
    begins[heads] = inside[heads]  # a text begins a word of its own
    if split:
        cuts = alone(data)
        begins[cuts] = inside[cuts]
    starts = np.flatnonzero(begins)
    if not len(starts):
        return np.empty(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    where = np.flatnonzero(inside)
    first = np.searchsorted(where, starts)
    lengths = np.diff(np.append(first, len(where)))
    place = np.arange(len(where)) - np.repeat(first, lengths)
    values = LOWER[data[where]] * powers(int(lengths.max()))[place]
    return mix(np.add.reduceat(values, first)), np.searchsorted(starts, at)
