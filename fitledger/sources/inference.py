"""Request lines for a batch model job and its response lines. The model itself is not here:
a caller may put any ``infer`` between the two."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.records import record_faults, typed_record


def request_lines(items: DataFrame, approvals: DataFrame, prompt: str, response_schema: str = "{}",
                  key: str = "eo_number") -> DataFrame:
    """key and ``line``: one JSON request per item, with its document's address.
    approvals: key, gcs_uri"""
    null = F.lit(None).cast("string")
    part = F.struct(null.alias("text"), F.struct(
        F.col("gcs_uri").alias("fileUri"), F.lit("application/pdf").alias("mimeType")).alias("fileData"))
    ask = F.struct(F.lit(prompt).alias("text"), F.lit(None).cast(
        "struct<fileUri:string,mimeType:string>").alias("fileData"))
    request = F.struct(
        F.array(F.struct(F.lit("user").alias("role"), F.array(ask, part).alias("parts"))).alias("contents"),
        F.struct(F.lit(0).alias("temperature"), F.lit("application/json").alias("responseMimeType"),
                 F.parse_json(F.lit(response_schema)).alias("responseSchema"),
                 F.lit(65535).alias("maxOutputTokens")).alias("generationConfig"))
    return items.join(approvals.select(key, "gcs_uri"), key).select(
        key, F.to_json(F.struct(request.alias("request"))).alias("line"))


def write_lines(lines: DataFrame, folder: str) -> None:
    lines.select("line").write.mode("overwrite").text(folder)


def key_from_uri(uri: Column) -> Column:
    name = F.regexp_extract(uri, r"([^/]*)$", 1)
    return F.upper(F.regexp_replace(name, r"\.pdf$", ""))


def read_lines(lines: DataFrame, line: str = "line") -> DataFrame:
    """Every line, parsed once, with ``reject``, ``eo_number``, ``finish_reason``, ``usable``, ``record``, ``tok_in`` and ``tok_out``.

    reject: ``blank``, or ``unreadable`` for text that is not JSON or names no document; null otherwise. Unusable: no response, a
    finish other than STOP, or text that is no valid record; such lines go back to the queue."""
    def get(path: str, kind: str) -> Column:
        return F.try_variant_get("_v", path, kind)

    parsed = lines.withColumn("_v", F.try_parse_json(F.col(line)))
    uris = F.transform(get("$.request.contents[0].parts", "array<variant>"), lambda p: F.try_variant_get(p, "$.fileData.fileUri", "string"))
    finish = get("$.response.candidates[0].finishReason", "variant")
    parsed = parsed.withColumns({
        "_uri": F.get(F.filter(uris, lambda u: F.coalesce(u, F.lit("")) != ""), F.lit(0)),
        "_answered": F.schema_of_variant(get("$.response", "variant")).startswith("OBJECT"),
        "_value": F.try_parse_json(get("$.response.candidates[0].content.parts[0].text", "string")),
        # A finish reason that is absent counts as STOP; one that is null does not.
        "finish_reason": F.when(finish.isNull(), "STOP").otherwise(get("$.response.candidates[0].finishReason", "string")),
        "tok_in": F.coalesce(get("$.response.usageMetadata.promptTokenCount", "bigint"), F.lit(0).cast("long")),
        "tok_out": F.coalesce(get("$.response.usageMetadata.candidatesTokenCount", "bigint"), F.lit(0).cast("long")),
    })
    usable = (F.col("_uri").isNotNull() & F.col("_answered") & (F.col("finish_reason") == "STOP")
              & F.col("_value").isNotNull() & (F.size(record_faults("_value")) == 0))
    reject = F.when(F.col("_uri").isNull(), F.when(F.btrim(F.coalesce(line, F.lit("")), F.lit(" \t\r\n")) == "", "blank").otherwise("unreadable"))
    return (parsed.withColumns({"reject": reject, "eo_number": key_from_uri(F.col("_uri")), "usable": F.coalesce(usable, F.lit(False))})
            .withColumn("record", F.when(F.col("usable"), typed_record("_value")))
            .drop("_v", "_uri", "_value", "_answered"))


def read_responses(lines: DataFrame, line: str = "line") -> DataFrame:
    """The lines that can be read, as in ``read_lines``."""
    return read_lines(lines, line).filter(F.col("reject").isNull()).drop("reject")


def with_inference(requests: DataFrame, infer: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]],
                   schema: str = "eo_number string, line string") -> DataFrame:
    """Hook for a caller's model: ``infer`` gets and gives Arrow-backed pandas batches."""
    return requests.mapInPandas(infer, schema)
