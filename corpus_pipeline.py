"""A training-text pipeline of five operators: quality rules, line dedup, near duplicates,
benchmark decontamination and a mix of the sources. Each stage reads what its predecessor wrote.

A row is told apart by a hash of its id and text, so stages also work where ids are null or
repeat: rows that are equal in both share a verdict. All stages but the last return the columns of
documents; the last adds the size and the target of its source, and the words taken.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fitledger.llm import decontaminate, host_quality, jaccard_join, line_dedup, mixing
from fitledger.llm.common import stored, table

# Near copies: five words a shingle, Jaccard similarity 0.8 or more.
NEAR_WORDS, NEAR_PERCENT = 5, 80
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def row_key() -> Column:
    return F.xxhash64("doc_id", "text")


def keyed(docs: DataFrame) -> DataFrame:
    """The operators' view of ``docs``: the row key stands for the id."""
    return docs.select(row_key().alias("doc_id"), "text", "source")


def without(docs: DataFrame, keys: DataFrame) -> DataFrame:
    return docs.withColumn("row_key", row_key()).join(keys.distinct(), "row_key", "left_anti").select(*COLUMNS)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    verdicts = host_quality.quality_verdicts(keyed(docs))
    return without(docs, verdicts.filter(~F.col("kept")).select(F.col("doc_id").alias("row_key")))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of a line that stands in ten documents or more the first one stays. A document of which nothing
    is left goes."""
    bitmaps = line_dedup.line_bitmaps(docs, min_docs=10, min_chars=1, keep_first=True)
    kept = line_dedup.apply_bitmaps(docs, bitmaps, ("lang", "source", "n_chars"))
    full = (F.col("n_dropped") == 0) | F.col("kept_text").rlike(r"[^\x20\x09-\x0D]")
    return kept.filter(full).select("doc_id", F.col("kept_text").alias("text"), "lang", "source",
                                    F.when(F.col("n_dropped") == 0, F.col("n_chars")).otherwise(F.length("kept_text")).cast("long").alias("n_chars"))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies the document with the smallest id stays, nulls last."""
    found = jaccard_join.jaccard_components(keyed(docs), NEAR_WORDS, NEAR_PERCENT).select(F.col("doc_id").alias("k"), "component_id").distinct()
    ids = docs.select(row_key().alias("row_key"), "doc_id").distinct()
    rank = F.struct(F.col("doc_id").isNull(), "doc_id", "row_key")
    first = ids.join(found, F.col("row_key") == F.col("k")).groupBy("component_id").agg(F.min(rank).alias("m"))
    stays = first.select(F.col("m.row_key").alias("row_key"))
    # equal rows share a key, so they meet here and one of them stays
    return (docs.withColumn("row_key", row_key()).join(stored(stays, "stays"), "row_key", "left_semi")
            .dropDuplicates(["row_key"]).select(*COLUMNS))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark. Items of a few words say little about where they came
    from, and take no document out."""
    found = decontaminate.contaminated(keyed(docs), table(spark, sf_dir, "benchmark")).filter(~F.col("short"))
    return without(docs, found.select(F.col("doc_id").alias("row_key")))


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes, with the words it takes of them (repeats counted)."""
    mixed = mixing.mix(keyed(docs)).filter("taken > 0").select(
        F.col("doc_id").alias("row_key"), "size", "source_size", "target", "taken")
    texts = docs.withColumn("row_key", row_key()).dropDuplicates(["row_key"])
    return mixed.join(texts, "row_key").select(*COLUMNS, "size", "source_size", "target", "taken")


STAGES = [
    ("quality_rules", quality_stage),
    ("line_dedup", line_stage),
    ("jaccard_join", near_stage),
    ("decontamination", decontamination_stage),
    ("source_mix", mix_stage),
]

# Near duplicates and substitution-tolerant overlaps have no SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
