"""Quality rules with host verdicts.

Every text is measured once (counts only; texts go no further). Failures of the rules are
summed by host, hosts' failure rates are shrunk with an empirical beta prior whose mean and
spread come from all hosts, and the verdict on a host decides how strict the soft rules are
for its documents: a document of an ordinary host may fail one soft rule, a document of a
poor host none. A document that fails no rule is kept whatever its host.

Defined results
* A null or empty text has no words and fails the base rule. A null source is a host of its own.
* Repeated rows count once each. Extra columns are ignored by ``rule_counts``.
* With a single host, or hosts that all have the same rate, there is no spread to learn from:
  the prior then outweighs every host and no host is poor.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, chunks, split_words, stored

SYMBOLS = "#*$%&|<>"
NGRAM = 8
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"]
# A host is poor when its shrunk failure rate is above this many times the mean of all documents.
POOR_RATIO = 1.25


def repeated_words(words: list[str], n: int = NGRAM) -> int:
    """Words that stand in an n-word window found twice or more."""
    m = len(words) - n + 1
    if m < 2:
        return 0
    hashes = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    rolled = hashes[:m].copy()
    for j in range(1, n):
        rolled *= np.uint64(0x9E3779B97F4A7C15)
        rolled += hashes[j:m + j]
    order = np.argsort(rolled)
    same = rolled[order[1:]] == rolled[order[:-1]]
    if not same.any():
        return 0
    starts = np.zeros(m, bool)
    starts[order[1:][same]] = True
    starts[order[:-1][same]] = True
    steps = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(starts)
    steps[at] += 1
    steps[at + n] -= 1
    return int((np.cumsum(steps[:-1]) > 0).sum())


def measure(text: str | None) -> tuple[int, ...]:
    """The values of COUNTS for one text."""
    text = text or ""
    words = split_words(text)
    lines = text.split("\n")
    seen: set[str] = set()
    repeats = full = 0
    for line in lines:
        if line.strip(BLANKS):
            full += 1
            repeats += line in seen
            seen.add(line)
    return (len(words), len(text) - sum(map(text.count, BLANKS)), sum(map(text.count, SYMBOLS)), repeats,
            repeated_words(words), full)


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in chunks(batches, 1000):
        rows = list(map(measure, b.column("text").to_pylist()))
        columns = np.array(rows, np.int64).reshape(-1, len(COUNTS)).T
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("source"), *map(pa.array, columns)],
                                         names=["doc_id", "source", *COUNTS])


def rule_counts(docs: DataFrame) -> DataFrame:
    """doc_id, source and COUNTS of every document."""
    schema = "doc_id long, source string, " + ", ".join(f"{c} long" for c in COUNTS)
    return docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), "text").mapInArrow(_measure, schema)


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def soft_failures() -> Column:
    """Soft rules failed: symbols beside words, symbols outnumbering words, repeated lines, odd word lengths."""
    rules = [10 * F.col("n_symbols") > F.col("n_words"),
             F.col("n_symbols") > F.col("n_words"),
             10 * F.col("n_dup_lines") > 3 * F.col("n_lines"),
             (F.col("word_chars") < 3 * F.col("n_words")) | (F.col("word_chars") > 12 * F.col("n_words"))]
    return sum((r.cast("int") for r in rules), F.lit(0))


def host_rates(flags: DataFrame) -> DataFrame:
    """Per host: n documents, k that fail, shrunk rate and whether it is poor.

    ``flags`` has source and failed. The beta prior is fitted by moments: its mean is the share of
    failing documents, its variance that of the hosts' rates, weighted by size, less what
    chance alone gives."""
    hosts = flags.groupBy("source").agg(F.count("*").alias("n"), F.sum(F.col("failed").cast("long")).alias("k"))
    whole = hosts.agg(F.sum("n").alias("all_n"), F.sum("k").alias("all_k"), F.count("*").alias("n_hosts"),
                      F.sum(F.col("k") * F.col("k") / F.col("n")).alias("squares"))
    mean = F.col("all_k") / F.col("all_n")
    between = F.col("squares") / F.col("all_n") - mean * mean
    chance = mean * (1 - mean) * F.col("n_hosts") / F.col("all_n")
    spread = between - chance
    prior = whole.select(
        mean.alias("mean"),
        # alpha + beta; without spread the prior outweighs any host
        F.when(spread > 0, F.greatest(F.lit(0.0), F.try_divide(mean * (1 - mean), spread) - 1)).otherwise(F.lit(1e18)).alias("weight"))
    rate = (F.col("k") + F.col("mean") * F.col("weight")) / (F.col("n") + F.col("weight"))
    # one row on the right
    return hosts.join(F.broadcast(prior)).select(
        "source", "n", "k", rate.alias("rate"), (rate > POOR_RATIO * F.col("mean")).alias("poor"))


def quality_verdicts(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, the counts, base_failed, soft_failures, host_rate and kept."""
    flags = stored(rule_counts(docs).withColumns({"base_failed": base_failed(), "soft_failures": soft_failures()})
                   .withColumn("failed", F.col("base_failed") | (F.col("soft_failures") > 0)), "quality")
    hosts = host_rates(flags).select(F.col("source").alias("h_source"), "rate", "poor")
    joined = flags.join(hosts, flags.source.eqNullSafe(hosts.h_source), "left")
    allowed = F.when(F.col("poor"), 0).otherwise(1)
    return joined.select("doc_id", *COUNTS, "base_failed", "soft_failures", F.col("rate").alias("host_rate"),
                         (~F.col("base_failed") & (F.col("soft_failures") <= allowed)).alias("kept"))


def quality_digest(docs: DataFrame) -> DataFrame:
    return quality_verdicts(docs).drop("n_lines", "soft_failures", "host_rate")


QUALITY_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
grams AS (
  SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM d)),
rep AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS n FROM grams) WHERE n > 1),
covered AS (SELECT doc_id, count(DISTINCT i + j)::BIGINT AS n FROM rep, range(8) r(j) GROUP BY doc_id),
lines AS (
  SELECT doc_id, sum(n)::BIGINT AS n_lines, (sum(n) - count(*))::BIGINT AS n_dup
  FROM (SELECT doc_id, l, count(*) AS n FROM (SELECT doc_id, unnest(ls) AS l FROM d)
        WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY doc_id, l) GROUP BY doc_id),
c AS (
  SELECT d.doc_id, source, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
         len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, coalesce(n_dup, 0) AS n_dup_lines,
         coalesce(covered.n, 0) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines
  FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN lines USING (doc_id)),
f AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
         (10 * n_symbols > n_words)::INT + (n_symbols > n_words)::INT + (10 * n_dup_lines > 3 * n_lines)::INT
         + (word_chars < 3 * n_words OR word_chars > 12 * n_words)::INT AS soft FROM c),
h AS (SELECT source, count(*) AS n, count(*) FILTER (base_failed OR soft > 0) AS k FROM f GROUP BY source),
a AS (SELECT sum(k) / sum(n) AS m, sum(n) AS nn, count(*) AS hs, sum(k * k / n) / sum(n) AS sq FROM h),
p AS (SELECT m, CASE WHEN sq - m * m - m * (1 - m) * hs / nn > 0
                THEN greatest(0.0, m * (1 - m) / (sq - m * m - m * (1 - m) * hs / nn) - 1) ELSE 1e18 END AS wt FROM a),
v AS (SELECT source, (k + m * wt) / (n + wt) > 1.25 * m AS poor FROM h, p)
SELECT f.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND soft <= CASE WHEN poor THEN 0 ELSE 1 END AS kept
FROM f JOIN v ON f.source IS NOT DISTINCT FROM v.source
"""
