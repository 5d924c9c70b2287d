"""Toxicity by subword bags: n-gram embeddings, averaged, under a linear softmax.

A word is the bag of the character n-grams of ``<word>``; a misspelling nobody has labelled
still shares most of them. Embeddings and softmax are trained together in numpy on the driver,
on at most ``per_class`` labelled texts of each class, chosen by a hash of their ids. Labels
say that a text is toxic but not where, so the model reads windows of a few words and a text
scores as its worst window: in training the worst window of each text is picked anew each
round, first by how much more often its n-grams occur in toxic texts, then by the model.

With averaging and a linear layer every n-gram has one number for its pull on the score, so
scoring needs a small broadcast table, a cache of words per task and running sums over the text.

Defined results
* A null or empty text has the score of an empty bag, below the threshold wherever the model was
  trained. Without labelled texts of both classes every score is 0.
* Labels that are null teach nothing; of repeated labels the largest counts. A null doc_id is never
  held out and never learned from. Repeated rows are scored each; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, crc_fold, lower_ascii, split_words
from .ngrams import word_grams

BITS, DIM, SHORTEST, LONGEST = 17, 8, 2, 5
WINDOW = 3
FOLDS, HELD_OUT = 3, 1
PER_CLASS = 2000
ROUNDS, BATCH, RATE, KEEP = 16, 128, 0.15, 0.5
THRESHOLD = 0.7
CACHE = 300_000


class Words:
    """Numbers the distinct words of texts and keeps the n-grams of each."""

    def __init__(self):
        self.number: dict[str, int] = {}

    def ids(self, text: str) -> np.ndarray:
        n = self.number
        words = split_words(lower_ascii(text))
        return np.fromiter((n.setdefault(w, len(n)) for w in words), np.int64, len(words))


def _windows(sums: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean pull of every window of WINDOW words (or the whole text, if that is shorter), and its start."""
    w = min(WINDOW, len(sums))
    total, n = np.cumsum(np.append(0.0, sums)), np.cumsum(np.append(0, counts))
    return (total[w:] - total[:-w]) / np.maximum(n[w:] - n[:-w], 1), w


def train(texts: list[str], labels: list[int], seed: int = 7) -> tuple[np.ndarray, float]:
    """Pull of each n-gram bucket and the bias: score = sigmoid(mean pull + bias)."""
    rng = np.random.default_rng(seed)
    words = Words()
    docs = [words.ids(t) for t in texts]
    y = np.array(labels)
    full = np.array([len(d) > 0 for d in docs])
    owner, bucket = word_grams(list(words.number), SHORTEST, LONGEST, BITS)
    order = np.argsort(owner, kind="stable")
    bucket, n_words = bucket[order], len(words.number)
    counts = np.bincount(owner, minlength=n_words)
    begin = np.cumsum(np.append(0, counts))
    grams = [bucket[begin[i]:begin[i + 1]] for i in range(n_words)]

    # how much more often a bucket occurs in toxic texts, counted once per text
    pull = np.zeros(2**BITS)
    for d, label in zip(docs, y, strict=True):
        own = np.unique(np.concatenate([grams[i] for i in np.unique(d)])) if len(d) else []
        pull[own] += 1 / (y == 1).sum() if label else -1 / (y == 0).sum()

    table = rng.normal(0, 0.1, (2**BITS, DIM)).astype(np.float32)
    layer = rng.normal(0, 0.1, (DIM, 2)).astype(np.float32)
    bias = np.zeros(2, np.float32)
    seen = np.full(2**BITS, 1e-6, np.float32)
    seen_layer = np.full((DIM, 2), 1e-6, np.float32)
    for _ in range(ROUNDS):
        sums = np.bincount(np.repeat(np.arange(n_words), counts), weights=pull[bucket], minlength=n_words)
        bags, target = [], []
        for at in np.flatnonzero(full):
            d = docs[at]
            means, w = _windows(sums[d], counts[d])
            worst = int(means.argmax())
            picks = {worst} if y[at] else {worst, int(rng.integers(len(means)))}
            for start in picks:
                bags.append(np.concatenate([grams[i] for i in d[start:start + w]]))
                target.append(y[at])
        shuffled = rng.permutation(len(bags))
        for some in np.array_split(shuffled, max(1, len(bags) // BATCH)):
            # a random half of each bag, so that no single n-gram carries a word
            halves = [b[rng.random(len(b)) < KEEP] for b in (bags[i] for i in some)]
            halves = [h if len(h) else bags[i] for h, i in zip(halves, some, strict=True)]
            idx = np.concatenate(halves)
            sizes = np.array(list(map(len, halves)))
            starts = np.append(0, np.cumsum(sizes)[:-1])
            goal = np.eye(2, dtype=np.float32)[np.array(target)[some]]
            mean = np.add.reduceat(table[idx], starts) / sizes[:, None]
            logits = mean @ layer + bias
            p = np.exp(logits - logits.max(1, keepdims=True))
            error = (p / p.sum(1, keepdims=True) - goal) / len(some)
            by_bag = error @ layer.T / sizes[:, None]
            used, inverse = np.unique(idx, return_inverse=True)
            grad = np.zeros((len(used), DIM), np.float32)
            np.add.at(grad, inverse, np.repeat(by_bag, sizes, axis=0).astype(np.float32))
            seen[used] += (grad**2).mean(1)
            table[used] -= RATE * grad / np.sqrt(seen[used])[:, None]
            g = mean.T @ error
            seen_layer += g**2
            layer -= (RATE * g / np.sqrt(seen_layer)).astype(np.float32)
            bias -= RATE * error.sum(0)
        pull = (table @ (layer[:, 1] - layer[:, 0])).astype(np.float64)
    return pull.astype(np.float32), float(bias[1] - bias[0])


def training_rows(docs: DataFrame, labels: DataFrame, per_class: int) -> list:
    """At most ``per_class`` texts of each label outside the held-out fold, those with the smallest hash of their id."""
    ids = labels.select(F.col("doc_id").cast("long"), F.col("toxic").cast("int").alias("toxic")).filter(
        F.col("toxic").isin(0, 1) & (crc_fold(F.col("doc_id"), FOLDS) != HELD_OUT)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    picks = [ids.filter(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for k in (0, 1)]
    # 2 * per_class ids at most, and one text for each
    chosen = picks[0].unionByName(picks[1]).withColumnRenamed("doc_id", "l_id")
    return (docs.select(F.col("doc_id").cast("long"), "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("l_id"))
            .groupBy("doc_id").agg(F.max("text").alias("text"), F.max("toxic").alias("toxic")).collect())


def _score(pull: np.ndarray | None, bias: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number: dict[str, int] = {}
        sums = counts = np.empty(0)
        for b in chunks(batches, 200):
            texts = [split_words(lower_ascii(t or "")) for t in b.column("text").to_pylist()]
            if pull is not None:
                if len(number) > CACHE:
                    number, sums, counts = {}, np.empty(0), np.empty(0)
                new = list({w for w in chain.from_iterable(texts) if w not in number})
                if new:
                    number.update(zip(new, range(len(number), len(number) + len(new)), strict=True))
                    owner, bucket = word_grams(new, SHORTEST, LONGEST, BITS)
                    sums = np.append(sums, np.bincount(owner, weights=pull[bucket], minlength=len(new)))
                    counts = np.append(counts, np.bincount(owner, minlength=len(new)))
            scores = np.zeros(len(texts))
            for i, words in enumerate(texts):
                if pull is not None:
                    ids = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
                    worst = _windows(sums[ids], counts[ids])[0].max() if words else 0.0
                    scores[i] = 1 / (1 + np.exp(-(worst + bias)))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(scores)], names=["doc_id", "held_out", "score"])
    return run


def toxicity(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted."""
    rows = training_rows(docs, labels, per_class)
    toxic = [r.toxic for r in sorted(rows, key=lambda r: r.doc_id)]
    pull, bias = None, 0.0
    if 0 < sum(toxic) < len(toxic):
        pull, bias = train([r.text or "" for r in sorted(rows, key=lambda r: r.doc_id)], toxic)
    held_out = F.coalesce(crc_fold(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False)).alias("held_out")
    return (docs.select(F.col("doc_id").cast("long"), held_out, "text")
            .mapInArrow(_score(pull, bias), "doc_id long, held_out boolean, score double")
            .withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int")))
