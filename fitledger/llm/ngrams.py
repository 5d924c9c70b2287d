"""Hashed character n-grams of many words at once, for the models of this folder."""

from __future__ import annotations

import numpy as np

MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def word_grams(words: list[str], shortest: int, longest: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(word number, bucket) of every n-gram of ``<word>``, all lengths from ``shortest`` to ``longest``."""
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 2
    points = code_points("".join(f"<{w}>" for w in words)).astype(np.uint64)
    owner = np.repeat(np.arange(len(words)), lengths)
    left = np.repeat(np.cumsum(lengths), lengths) - np.arange(len(points))  # places up to the word's end
    owners, buckets = [], []
    rolled = np.zeros(len(points), np.uint64)
    for n in range(1, longest + 1):
        rolled = rolled[: len(points) - n + 1] * MULTIPLIER + points[n - 1:] if n > 1 else points * MULTIPLIER
        if n >= shortest:
            fits = left[: len(rolled)] >= n
            mixed = (rolled[fits] ^ (rolled[fits] >> np.uint64(29))) * MULTIPLIER
            owners.append(owner[: len(rolled)][fits])
            buckets.append((mixed >> np.uint64(64 - bits)).astype(np.int64))
    return np.concatenate(owners), np.concatenate(buckets)
