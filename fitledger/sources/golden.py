"""Hand-checked answers and produced records kept as one JSON file per approval."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.records import validate_records
from ..operators.scoring import record_checks, score_records
from ..operators.state import latest_per_key
from ..schemas import BASELINE, RECORD


def _stem(suffix: str) -> Column:
    name = F.regexp_extract(F.input_file_name(), r"([^/]*)$", 1)
    return F.upper(F.regexp_replace(name, suffix.replace(".", r"\.") + "$", ""))


def _json(spark: SparkSession, folder: str, schema: str, suffix: str) -> DataFrame:
    return (spark.read.schema(schema).option("multiLine", True).option("pathGlobFilter", f"*{suffix}")
            .json(folder).withColumn("doc", _stem(suffix)))


def read_expected(spark: SparkSession, folder: str) -> DataFrame:
    """Expected records keyed by ``doc``, the upper-cased file stem."""
    return _json(spark, folder, RECORD, ".json")


def read_produced(spark: SparkSession, folder: str, suffix: str = ".agent.json") -> DataFrame:
    return _json(spark, folder, RECORD, suffix)


def read_baseline(spark: SparkSession, folder: str, suffix: str = ".legacy.json") -> DataFrame:
    """Baseline records with their stored document id as key; they carry no rows."""
    base = _json(spark, folder, BASELINE, suffix)
    rows = RECORD[RECORD.index("fitment ") + len("fitment "):RECORD.index(", confidence")]
    return base.withColumn("eo_number", F.coalesce("_doc_id", "doc")).withColumn("fitment", F.lit(None).cast(rows))


def read_payload_text(spark: SparkSession, folder: str, suffix: str = ".agent.json") -> DataFrame:
    """Whole files as text, for validation of the record types."""
    return (spark.read.text(folder, wholetext=True, pathGlobFilter=f"*{suffix}")
            .select(_stem(suffix).alias("doc"), F.col("value").alias("payload")))


def accuracy_report(expected: DataFrame, sources: dict[str, DataFrame]) -> DataFrame:
    """Scores of every expected record against every source, as rows with ``source``."""
    parts = [score_records(expected, got).withColumn("source", F.lit(name)) for name, got in sources.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def check_report(records: DataFrame, payloads: DataFrame) -> DataFrame:
    """doc with the three checks of a produced record: types, key format, required fields."""
    types = validate_records(payloads).select("doc", F.col("valid").alias("schema"))
    return record_checks(records).select("doc", "eo_format", "required_fields").join(types, "doc")


def write_latest(extractions: DataFrame, folder: str, key: str = "eo_number") -> None:
    """Latest payload per key with its prompt version, as JSON lines.
    extractions: key, created_at, id, prompt_version, payload (struct)"""
    latest = latest_per_key(extractions, key, ["created_at", "id"])
    latest.select("payload.*", F.col("prompt_version").alias("_prompt_version")).write.mode("overwrite").json(folder)
