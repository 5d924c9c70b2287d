"""Document stores read with the binaryFile source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PDF_MAGIC = "%PDF"


def vetted(content: Column, magic: str = PDF_MAGIC) -> Column:
    """True when the payload starts with the magic bytes; empty and foreign bodies do not."""
    head = F.substring(content.cast("binary"), 1, len(magic.encode()))
    return F.coalesce(head == F.lit(magic).cast("binary"), F.lit(False))


def vet_payloads(df: DataFrame, content: str = "content", magic: str = PDF_MAGIC) -> DataFrame:
    """df with ``vetted``, and ``sha256`` of the payloads that pass."""
    ok = vetted(F.col(content), magic)
    return df.withColumns({"vetted": ok, "sha256": F.when(ok, F.sha2(F.col(content).cast("binary"), 256))})


def read_store(spark: SparkSession, folder: str, content: bool = True) -> DataFrame:
    """Files under ``folder``; without ``content`` only names and sizes are read."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return df if content else df.select("path", "length", "modificationTime")


def corpus_keys(files: DataFrame, path: str = "path") -> DataFrame:
    """files that are documents, with their key. The suffix test ignores case, the suffix
    strip does not, so ``A.PDF`` keeps its suffix in the key."""
    name = F.regexp_extract(F.col(path), r"([^/]*)$", 1)
    return (files.filter(F.lower(F.col(path)).endswith(".pdf"))
            .withColumn("eo_number", F.upper(F.regexp_replace(name, r"\.pdf$", ""))))


def bootstrap_corpus(files: DataFrame, approvals: DataFrame, run_id: str) -> DataFrame:
    """Work items for stored documents whose approval is not complete yet."""
    done = approvals.filter(F.col("state") == "complete").select("eo_number")
    return corpus_keys(files).join(done, "eo_number", "left_anti").select(
        "eo_number", F.col("path").alias("gcs_uri"), F.lit("discovered").alias("state"),
        F.concat(F.lit(run_id + "_"), F.col("eo_number")).alias("item_id"))
