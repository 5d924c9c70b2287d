"""Benchmark decontamination with spaced seeds.

A seed is a fixed mask over consecutive words; the hash of the words it looks at ignores the
others, so a passage is found although words in it were replaced. An item's length decides which masks it gets. Seeds of
the benchmark fill a Bloom filter sized by their number, which is all that the scan of the documents gets. Words around
the seeds that pass it are cut out once per stretch of a document.

A pair counts if four fifths of the item's words stand in place along an offset, or if the best run along it, that loses four for
a differing word and gains one for an equal one, holds enough equal words. For each length the least number of seeds
that any such pair has in common at its offset is known (``agreeing``). So of an item's seeds the commonest ones, one fewer than that,
need not be looked up: a phrase that stands in many items and documents does not make pairs of them. What the others find is a
candidate (stretch, item, offset) only if enough seeds agree there, which is counted on hashes; then its words are compared.

Defined results
* Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` with A-Z lower-cased; in scripts without blanks (``wordhash.NO_BLANKS``) every
  character is a word. Null and empty texts have none, and an item without words matches nothing.
* An item of fewer than ``LEAST_ITEM`` words says little about where it came from: all its words must stand in place, and ``short`` is true.
* Other pairs count if four fifths of the item's words stand in place at one offset, or if the run has ``LEAST_RUN`` equal words.
* One row per (doc_id, item_id), the offset with the most equal words (ties: the shortest, then the first place): those in place
  from the first to the last one, or the run's if fewer than four fifths stand in place; repeated rows give the same pairs. Null
  ids are values like others, other columns are ignored. Empty documents or an empty benchmark give an empty result.
* A stretch of a long text reaches as far as the longest item has words around its seeds; only these words leave the scan.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bloom import bits_for, bloom, held
from .common import chunks, stored
from .wordhash import ALNUM, mix, text_chunks, word_hashes

# Families of fixed masks; 1 looks at the word, 0 ignores it. An item gets the first family of which every pair that counts
# has two seeds or more in common, and below LEAST_ITEM words a single mask of its own length.
FAMILIES = (("110111", "11100101", "10001111"), ("11101", "1100101"), ("111", "11011"))
LEAST_ITEM = 6
LEAST_RUN = 12
# Words hashed at once, so that the arrays stay in the processor's cache.
BLOCK = 32_768


def _windows(masks: tuple[str, ...]) -> tuple[int, np.ndarray]:
    """(longest mask, seeds that end in each window of so many words, a bit for each equal one)."""
    span = max(map(len, masks))
    windows = np.arange(2**span)
    return span, sum(((windows & int(m, 2)) == int(m, 2)).astype(np.int64) for m in masks)


@lru_cache(maxsize=None)
def least_in_place(n: int, masks: tuple[str, ...]) -> int:
    """Least number of agreeing seeds when at most a fifth of n words differ, over all placements."""
    span, ends = _windows(masks)
    states = 2 ** (span - 1)
    best = np.full((n // 5 + 1, states), n * len(masks) + 1)
    best[0, 0] = 0
    for _ in range(n):
        after = np.full_like(best, n * len(masks) + 1)
        for bit in (0, 1):
            window = (np.arange(states) << 1) | bit
            value = best + ends[window]
            value = np.concatenate([np.full((1, states), n * len(masks) + 1), value[:-1]]) if bit == 0 else value
            # two windows lead to each state: with and without the word that leaves it
            np.minimum.at(after, (slice(None), window & (states - 1)), value)
        best = after
    return int(best.min())


@lru_cache(maxsize=None)
def least_in_run(masks: tuple[str, ...]) -> int:
    """Least number of agreeing seeds in a run with LEAST_RUN equal words. No beginning of a best run scores below zero, so
    up to its twelfth equal word a run has four equal words before the first differing one and eight before the second."""
    span, ends = _windows(masks)
    least = LEAST_RUN * len(masks)
    for m in range(LEAST_RUN // 4):
        for sizes in product(range(LEAST_RUN + 1), repeat=m + 1):
            if sum(sizes) == LEAST_RUN and all(sum(sizes[:j + 1]) >= 4 * (j + 1) for j in range(m)):
                window, seeds = 0, 0
                for bit in "0".join("1" * k for k in sizes):
                    window = (window << 1 | int(bit)) & (2**span - 1)
                    seeds += int(ends[window])
                least = min(least, seeds)
    return least


@lru_cache(maxsize=None)
def masks_for(n: int) -> tuple[tuple[str, ...], int]:
    """(masks of an item of n words, number of seeds that agree in every pair that counts)."""
    if n < LEAST_ITEM:
        return ("1" * n,), 1
    # beyond this length no pair in place has fewer agreeing seeds than one of this length: every five words more bring some
    for masks in FAMILIES:
        agreeing = least_in_place(min(n, 45 + n % 5), masks)
        if n >= LEAST_RUN:
            agreeing = min(agreeing, least_in_run(masks))
        if agreeing >= 2:
            return masks, agreeing
    raise AssertionError("the last family has two agreeing seeds for every length")


def multipliers(mask: str) -> list[tuple[int, np.uint64]]:
    """(place, odd factor) of each word the mask looks at."""
    return [(i, np.uint64(xxhash.xxh64_intdigest(f"{mask}/{i}".encode()) | 1)) for i, c in enumerate(mask) if c == "1"]


def seed_hashes(tokens: np.ndarray, mask: str) -> np.ndarray:
    """Hash of the looked-at words at every start of the mask."""
    n = len(tokens) - len(mask) + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for i, factor in multipliers(mask):
        h += tokens[i:i + n] * factor
    return mix(h)


def benchmark_items(benchmark: DataFrame) -> DataFrame:
    """item_key, item_id, hashed words, their number n and ``agreeing`` of every item with a word."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_chunks(batches):
            words, at = word_hashes(b.column("text"), ALNUM, split=True)
            sizes = np.diff(at)
            tokens = [words[i:j].view(np.int64) for i, j in zip(at[:-1], at[1:], strict=True)]
            out = pa.RecordBatch.from_arrays(
                [b.column("item_key"), b.column("item_id"), pa.array(tokens, pa.list_(pa.int64())), pa.array(sizes.astype(np.int32)),
                 pa.array([masks_for(n)[1] if n else 0 for n in sizes.tolist()], pa.int32())],
                names=["item_key", "item_id", "item_tokens", "n", "agreeing"])
            yield out.filter(pa.array(sizes > 0))

    return (benchmark.select(F.xxhash64("item_id", "text").alias("item_key"), F.col("item_id").cast("long"), "text").distinct()
            .mapInArrow(run, "item_key long, item_id long, item_tokens array<long>, n int, agreeing int"))


def item_seeds(items: DataFrame) -> DataFrame:
    """(hash, item_key, item_pos) of every seed of every item."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches, 500):
            keys, pos, found = [], [], []
            for key, tokens in zip(b.column("item_key").to_pylist(), b.column("item_tokens").to_pylist(), strict=True):
                for mask in masks_for(len(tokens))[0]:
                    h = seed_hashes(np.array(tokens, np.int64).view(np.uint64), mask)
                    keys += [key] * len(h)
                    pos.append(np.arange(len(h)))
                    found.append(h)
            h = np.concatenate([np.empty(0, np.uint64), *found])
            yield pa.RecordBatch.from_arrays(
                [pa.array(h.view(np.int64)), pa.array(keys, pa.int64()), pa.array(np.concatenate([np.empty(0, np.int64), *pos]).astype(np.int32))],
                names=["hash", "item_key", "item_pos"])

    return items.select("item_key", "item_tokens").mapInArrow(run, "hash long, item_key long, item_pos int")


STRETCH = "stretch string, doc_id long, begin int, tokens array<long>, hits array<struct<pos:int,hash:long>>"
HITS = pa.list_(pa.struct([("pos", pa.int32()), ("hash", pa.int64())]))


def stretches(docs: DataFrame, bits: np.ndarray, masks: list[str], reach: int) -> DataFrame:
    """Parts of documents around seeds that pass the filter, with the words there and the seeds. ``reach`` words on both
    sides of a seed belong to it; seeds closer than that share a stretch."""
    shared = docs.sparkSession.sparkContext.broadcast(bits)
    span = max(map(len, masks), default=0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_chunks(batches):
            tokens, at = word_hashes(b.column("text"), ALNUM, split=True)
            own = np.repeat(np.arange(b.num_rows), np.diff(at))  # row of each word
            pos, found = [], []
            for mask in masks:
                for start in range(0, len(tokens), BLOCK):
                    h = seed_hashes(tokens[start:start + BLOCK + len(mask) - 1], mask)
                    some = np.flatnonzero(held(shared.value, h))
                    first = some + start
                    inside = own[first] == own[first + len(mask) - 1]
                    pos.append(first[inside])
                    found.append(h[some[inside]])
            pos, found = np.concatenate([np.empty(0, np.int64), *pos]), np.concatenate([np.empty(0, np.uint64), *found]).view(np.int64)
            order = np.lexsort((found, pos))
            pos, found = pos[order], found[order]
            cut = np.flatnonzero((np.diff(pos) > reach) | (np.diff(own[pos]) > 0)) + 1
            docs_, hashes = b.column("doc_id"), b.column("text_hash")
            rows = []
            for i, j in zip([0, *cut], [*cut, len(pos)], strict=True):
                if i == j:
                    continue
                row = int(own[pos[i]])
                doc = docs_[row].as_py()
                begin = max(int(at[row]), int(pos[i]) - reach)
                end = min(int(at[row + 1]), int(pos[j - 1]) + span + reach)
                rows.append((f"{doc}/{hashes[row].as_py()}/{begin - at[row]}", doc, begin - int(at[row]), tokens[begin:end].view(np.int64),
                             [{"pos": p - begin, "hash": h} for p, h in zip(pos[i:j].tolist(), found[i:j].tolist(), strict=True)]))
            columns = list(zip(*rows, strict=True)) or [()] * 5
            types = [pa.string(), pa.int64(), pa.int32(), pa.list_(pa.int64()), HITS]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)],
                                             names=["stretch", "doc_id", "begin", "tokens", "hits"])

    return docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_hash"), "text").mapInArrow(run, STRETCH)


def lookups(seeds: DataFrame, hits: DataFrame, items: DataFrame) -> DataFrame:
    """The seeds that are looked up: all of an item's but the commonest ones, one fewer than agree in every pair that counts."""
    found = hits.groupBy("hash").agg(F.count("*").alias("n_hits"))
    place = F.row_number().over(Window.partitionBy("item_key").orderBy(F.col("n_hits").desc(), "hash", "item_pos"))
    counted = seeds.join(found, "hash").join(items.select("item_key", "agreeing"), "item_key")
    return counted.withColumn("place", place).filter(F.col("place") >= F.col("agreeing")).select("hash", "item_key", "item_pos")


def candidates(seeds: DataFrame, hits: DataFrame, items: DataFrame) -> DataFrame:
    """(stretch, item_key, shift) at which enough seeds agree. Only places that a looked-up seed finds are counted."""
    places = hits.join(lookups(seeds, hits, items), "hash").select(
        "stretch", "item_key", (F.col("pos") - F.col("item_pos")).alias("shift")).distinct()
    # the seeds of a document's place and of the item meet per candidate, so common ones make no pairs of their own
    agree = (places.join(hits, "stretch").join(seeds, ["item_key", "hash"])
             .filter(F.col("pos") - F.col("item_pos") == F.col("shift"))
             .groupBy("stretch", "item_key", "shift").agg(F.count_distinct("pos", "hash").alias("n_seeds")))
    return agree.join(items.select("item_key", "agreeing"), "item_key").filter(F.col("n_seeds") >= F.col("agreeing")).select("stretch", "item_key", "shift")


def best_run(item: np.ndarray, doc: np.ndarray, offset: int) -> tuple[int, int, int]:
    """(equal words, first and last word of the item) of the best run with item word i beside document word i + offset."""
    lo, hi = max(0, -offset), min(len(item), len(doc) - offset)
    if hi <= lo:
        return 0, 0, 0
    same = item[lo:hi] == doc[lo + offset:hi + offset]
    gain = np.cumsum(np.where(same, 1, -4))
    before = np.append(0, gain[:-1])
    least = np.minimum.accumulate(before)
    score = gain - least
    # of runs with one score the longest has the most equal words
    start, end = max(((int(before[:e + 1].argmin()), e) for e in np.flatnonzero(score == score.max()).tolist()), key=lambda x: x[1] - x[0])
    return int(same[start:end + 1].sum()), lo + start, lo + end


def in_place(item: np.ndarray, doc: np.ndarray, offset: int) -> tuple[int, int, int]:
    """(equal words, first and last equal word of the item) of all words with item word i beside document word i + offset."""
    lo, hi = max(0, -offset), min(len(item), len(doc) - offset)
    same = lo + np.flatnonzero(item[lo:hi] == doc[lo + offset:hi + offset]) if hi > lo else np.empty(0, np.int64)
    return (len(same), int(same[0]), int(same[-1])) if len(same) else (0, 0, 0)


VERIFIED = "doc_id long, item_id long, n_match int, n_run int, item_words int, doc_start int, item_start int"


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in VERIFIED.split(", ")]
    types = [pa.int64(), pa.int64(), *[pa.int32()] * 5]
    for b in batches:
        rows = []
        numbers = zip(*(b.column(c).to_pylist() for c in ("doc_id", "item_id", "begin", "shift")), strict=True)
        # views on the batch: a very long document may stand in it once for each of its candidates
        words = zip(b.column("item_tokens"), b.column("tokens"), strict=True)
        for (doc_id, item_id, begin, shift), (own, others) in zip(numbers, words, strict=True):
            item, doc = own.values.to_numpy(), others.values.to_numpy()
            n, first, last = in_place(item, doc, shift)
            whole = 5 * n >= 4 * len(item) if len(item) >= LEAST_ITEM else n == len(item)
            if not whole:
                n, first, last = best_run(item, doc, shift)
            if whole or n >= LEAST_RUN:
                rows.append((doc_id, item_id, n, last - first + 1, len(item), begin + first + shift, first))
        columns = list(zip(*rows, strict=True)) or [()] * 7
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Per pair: doc_id, item_id, n_match (equal words), n_run (words of the run), item_words, doc_start, item_start
    (words from 0), share (equal words of the item's) and short."""
    items = stored(benchmark_items(benchmark), "items")
    seeds = stored(item_seeds(items), "item-seeds")
    # a row for each length that occurs
    lengths = [r.n for r in items.select("n").distinct().collect()]
    masks = sorted({m for n in lengths for m in masks_for(n)[0]})
    distinct = seeds.select("hash").distinct()
    filled = bloom(distinct, "hash", bits_for(distinct.count()))
    found = stored(stretches(docs, filled, masks, max(lengths, default=0)), "stretches")
    hits = found.select("stretch", F.explode("hits").alias("h")).select("stretch", "h.pos", "h.hash")
    pairs = candidates(seeds, hits, items)
    # repeated rows have equal stretches
    once = found.select("stretch", "doc_id", "begin", "tokens").dropDuplicates(["stretch"])
    # documents' words come last, so that they are not shuffled once for each candidate
    checked = (pairs.join(items, "item_key").join(once, "stretch")
               .select("doc_id", "item_id", "begin", "shift", "tokens", "item_tokens").mapInArrow(_verify, VERIFIED))
    order = F.struct("n_match", -F.col("n_run"), -F.col("doc_start"), -F.col("item_start"))
    best = checked.groupBy("doc_id", "item_id").agg(F.max_by(F.struct("n_match", "n_run", "item_words", "doc_start", "item_start"), order).alias("x"))
    return best.select("doc_id", "item_id", "x.*").withColumns({"share": F.col("n_match") / F.col("item_words"), "short": F.col("item_words") < LEAST_ITEM})
