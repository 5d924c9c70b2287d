"""The registered queries of this folder and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import ans_ids, centroids, decontaminate, fill_middle, host_quality, jaccard_join, language_id, license_scan, line_dedup, mixing, token_counts, toxicity, warc
from .common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc": lambda spark, sf: warc.warc_digest(table(spark, sf, "pages"), min_bytes=0),
    "op2_license_scan": lambda spark, sf: license_scan.license_digest(table(spark, sf, "documents")),
    "op3_token_counts": lambda spark, sf: token_counts.token_counts(table(spark, sf, "documents")),
    "op4_mixing": lambda spark, sf: mixing.mix_digest(table(spark, sf, "documents")),
    "op5_toxicity": lambda spark, sf: toxicity.toxicity(table(spark, sf, "documents"), table(spark, sf, "labels")),
    "op6_jaccard_join": lambda spark, sf: jaccard_join.jaccard_components(table(spark, sf, "documents")),
    "op7_host_quality": lambda spark, sf: host_quality.quality_digest(table(spark, sf, "documents")),
    "op8_language_id": lambda spark, sf: language_id.language_digest(table(spark, sf, "documents")),
    "op9_decontaminate": lambda spark, sf: decontaminate.contaminated(table(spark, sf, "documents"), table(spark, sf, "benchmark")),
    "op10_line_dedup": lambda spark, sf: line_dedup.line_digest(table(spark, sf, "documents"), min_docs=10, min_chars=1),
    "op11_fill_middle": lambda spark, sf: fill_middle.fill_middle_digest(table(spark, sf, "documents")),
    "op12_token_ids": lambda spark, sf: ans_ids.ids_digest(table(spark, sf, "documents")),
    "op13_centroids": lambda spark, sf: centroids.cluster_digest(table(spark, sf, "embeddings")),
}

ORACLES: dict[str, str] = {
    "op2_license_scan": license_scan.LICENSE_SQL,
    "op4_mixing": mixing.MIX_SQL,
    "op7_host_quality": host_quality.QUALITY_SQL,
    "op10_line_dedup": line_dedup.LINE_SQL,
    "op11_fill_middle": fill_middle.FILL_SQL,
    "op13_centroids": centroids.cluster_sql(),
}
