"""Mixing sources to target weights by weighted random order (Efraimidis and Spirakis).

Only DataFrame functions. Source sizes are one partial aggregation; targets are found by
filling the sources up to a common level per weight, in closed form over the few rows of the
sources. A document's key is -ln(u) / w with u from a hash of its id and w its quality weight:
documents sorted by key are a weighted sample without replacement for every prefix. The
sorted order is summed in two levels, buckets of the key inside each source and documents
inside each bucket, so a source that holds a third of all rows is worked on by many tasks.
Complete epochs come first; the rest of a target is a prefix of the order, and the document
at its end is taken up to the budget, so a source's words meet its target to within one word.

Defined results
* A null text has size 0. A null source is one source, after all others. Sources without words have target 0.
* u depends on the doc_id only, so reruns agree. Ties and repeated rows are ordered by id and
  size; rows equal in both can stand in for each other. A null doc_id has one fixed u.
* Other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, stored

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST_EPOCHS = 2
# Key buckets of a source; raise it for sources beyond some 10 billion documents.
BUCKETS = 1024


def sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source, size and quality weight. Texts whose words are 3 to 13 characters long on
    average weigh 1, others a half."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    mean = F.try_divide(F.length("text"), F.col("size"))
    return docs.select("doc_id", "source", "text", size.alias("size")).select(
        "doc_id", "source", "size", F.when(mean.between(4, 14), 1.0).otherwise(0.5).alias("weight"))


def source_targets(sized: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: int = MOST_EPOCHS) -> DataFrame:
    """source, source_size and target. Sources are a dimension: the windows run over one row each."""
    rank = W.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(rank) - 1, F.lit(len(weights))) + 1).cast("int"))
    # the size of everything is summed before the sources are ranked, from the same few rows
    rows = (sized.groupBy("source").agg(F.sum("size").alias("source_size")).select("source", "source_size", weight.alias("w"))
            .withColumn("cap", most * F.col("source_size")))
    fill = W.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    every = W.orderBy(F.lit(1)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    upto = fill.rowsBetween(W.unboundedPreceding, W.currentRow)
    left = share * F.sum("source_size").over(every) - (F.sum("cap").over(upto) - F.col("cap"))
    rows = rows.withColumn("level", left / (F.sum("w").over(every) - F.sum("w").over(upto) + F.col("w")))
    # the sources that the level does not fill share one level, the highest of those
    open_level = F.max(F.when(F.col("cap") > F.col("level") * F.col("w"), F.col("level"))).over(every)
    target = F.coalesce(F.least(F.col("cap").cast("double"), open_level * F.col("w")), F.col("cap").cast("double"))
    return rows.select("source", "source_size", target.alias("target"))


def sample_key(doc_id: Column, weight: Column, seed: str = "") -> Column:
    """-ln(u) / w, u in (0, 1) from the id's md5."""
    digest = F.md5(F.concat(F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit("null"))).cast("binary"))
    u = (F.conv(F.substring(digest, 1, 12), 16, 10).cast("long") + 0.5) / float(2**48)
    return -F.log(u) / weight


def mix(docs: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: int = MOST_EPOCHS) -> DataFrame:
    """Per document: doc_id, size, source_size, target, taken (words, repeats counted), source."""
    sized = stored(sizes(docs).withColumn("key", sample_key(F.col("doc_id"), F.col("weight")))
                   .withColumn("bucket", F.floor(BUCKETS * (1 - F.exp(-F.col("key")))).cast("int"))
                   # a source name that is never null, for joins and windows on the same keys
                   .withColumn("sk", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n"))), "mix-sizes")
    targets = source_targets(sized, weights, share, most).withColumn("sk", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n"))).drop("source")
    epochs = F.when(F.col("source_size") > 0, F.least(F.floor(F.try_divide(F.col("target"), F.col("source_size").cast("double"))), F.lit(most))).otherwise(0)
    ahead = W.partitionBy("sk").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    buckets = (sized.groupBy("sk", "bucket").agg(F.sum("size").alias("bucket_size"))
               .withColumn("ahead", F.coalesce(F.sum("bucket_size").over(ahead), F.lit(0)))
               .join(targets, "sk")
               .select(F.col("sk").alias("b_sk"), F.col("bucket").alias("b_bucket"), "ahead", "source_size", "target", epochs.cast("long").alias("epochs")))
    inside = W.partitionBy("sk", "bucket").orderBy("key", F.col("doc_id").asc_nulls_first(), "size").rowsBetween(W.unboundedPreceding, W.currentRow)
    rest = F.floor(F.col("target") - F.col("epochs") * F.col("source_size")) - F.col("ahead") - F.col("upto") + F.col("size")
    return (sized.join(buckets, (F.col("sk") == F.col("b_sk")) & (F.col("bucket") == F.col("b_bucket")))
            .withColumn("upto", F.sum("size").over(inside))
            .select("doc_id", "size", "source_size", "target",
                    (F.col("epochs") * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest))).cast("long").alias("taken"),
                    "source"))


def mix_digest(docs: DataFrame) -> DataFrame:
    return mix(docs).drop("source")


MIX_SQL = r"""
WITH s AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, text FROM documents),
k AS (
  SELECT doc_id, source, size,
         -ln((('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null')), 1, 12))::BIGINT + 0.5::DOUBLE) / 281474976710656.0::DOUBLE)
         / CASE WHEN length(text) / size BETWEEN 4 AND 14 THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END AS key
  FROM s),
g AS (
  SELECT source, sum(size)::BIGINT AS source_size, 2 * sum(size)::BIGINT AS cap,
         [5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS w FROM k GROUP BY source),
l AS (
  SELECT *, (1.5::DOUBLE * (SELECT sum(source_size) FROM g)::DOUBLE - (sum(cap) OVER f - cap)::DOUBLE)
            / ((SELECT sum(w) FROM g) - sum(w) OVER f + w)::DOUBLE AS level
  FROM g WINDOW f AS (ORDER BY cap / w, source NULLS LAST ROWS UNBOUNDED PRECEDING)),
t AS (
  SELECT source, source_size,
         coalesce(least(cap::DOUBLE, (SELECT max(level) FROM l WHERE cap > level * w) * w), cap::DOUBLE) AS target FROM l),
e AS (SELECT *, CASE WHEN source_size > 0 THEN least(floor(target / source_size), 2)::BIGINT ELSE 0 END AS epochs FROM t)
SELECT doc_id, size, source_size, target,
       (epochs * size + greatest(0, least(size, floor(target - epochs * source_size)::BIGINT
          - (sum(size) OVER (PARTITION BY k.source ORDER BY key, doc_id NULLS FIRST, size ROWS UNBOUNDED PRECEDING)) + size)))::BIGINT AS taken
FROM k JOIN e ON k.source IS NOT DISTINCT FROM e.source
"""
