"""Matching of whole documents, as the daily run and an approved review need it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vocab as v
from ..operators import matching as M

EVENT = ("doc BIGINT, agent STRING, action STRING, reason STRING, model_read STRING, removed INT, `count` BIGINT, "
         "gemini_resolved BIGINT, fitment_index BIGINT, confidence DOUBLE")
REVIEW = "doc BIGINT, source STRING, reason STRING, agent_notes STRING, payload STRING"


@dataclass
class Matched:
    """What matching gives: folded records to store and the classes they name, matches per document (zero included), reviews and events."""

    matches: DataFrame
    classes: DataFrame
    totals: DataFrame
    reviews: DataFrame
    events: DataFrame


def application_rows(records: DataFrame) -> DataFrame:
    """Application rows of records, one per row, with their position."""
    return records.select("doc", F.posexplode("fitment").alias("row_idx", "_r")).select(
        "doc", F.col("row_idx").cast("long").alias("row_idx"), "_r.*")


def event(agent: str, action: str, **fields: Column) -> Column:
    """One event as a struct with all fields of EVENT but ``doc``."""
    kinds = {"reason": "string", "model_read": "string", "removed": "int", "count": "bigint", "gemini_resolved": "bigint", "fitment_index": "bigint",
             "confidence": "double"}
    values = [fields.get(name, F.lit(None)).cast(kind).alias(name) for name, kind in kinds.items()]
    return F.struct(F.lit(agent).alias("agent"), F.lit(action).alias("action"), *values)


def match_documents(records: DataFrame, catalog: DataFrame, decisions: DataFrame, invalid: DataFrame,
                    keep: Callable[[DataFrame, str], DataFrame]) -> Matched:
    """Match ``records`` (doc, part_numbers, category, device_name, manufacturer, fitment).

    decisions: a resolver's answers (doc, row_idx, seq, vehicle_ids, rationale, confidence); invalid: doc of answers that could not
    be read as a whole, none of which counts. ``keep`` writes a table of the run and reads it back, so each later step works on what is
    stored. Rows ask twice what fits them, for those without a match and for the best ones: that costs less than writing all matches
    and shuffling them. Matches stay folded; who reads them writes the vehicles out.
    """
    rows = application_rows(records)
    classes = keep(M.vehicle_classes(catalog), "classes")
    unresolved = keep(M.unresolved_rows(rows, catalog), "unresolved")
    answered = decisions.join(invalid.select("doc"), "doc", "left_anti")
    outcomes = keep(M.resolver_outcomes(answered, unresolved, catalog), "outcomes")
    hits = M.application_matches(rows, classes, folded=True, by_doc=True)
    merged = keep(M.merge_resolved(M.best_matches(hits), outcomes, classes), "merged")

    resolved = (F.col("method") == v.METHOD_RESOLVED).cast("long")
    counts = M.sized(merged, classes).groupBy("doc").agg(F.sum("n_vehicles").alias("match_count"), F.sum(resolved * F.col("n_vehicles")).alias("n_resolved"))
    totals = records.select("doc").join(counts, "doc", "left").fillna(
        0, ["match_count", "n_resolved"])
    waiting = unresolved.groupBy("doc").agg(F.count("*").alias("n"))
    unread = waiting.join(invalid.select("doc").distinct(), "doc", "left_semi")

    asked = rows.select(*M.ROW_KEY, F.struct(*[c for c in rows.columns if c not in M.ROW_KEY]).alias("fitment"))
    unsure = outcomes.filter(F.col("outcome") == "review").join(asked, M.ROW_KEY)
    reviews = unsure.select(
        "doc", F.concat_ws("-", F.lit("row"), "row_idx", "seq").alias("source"), F.lit("ambiguous_match").alias("reason"), F.col("rationale").alias("agent_notes"),
        F.to_json(F.struct("fitment", F.col("vehicle_ids").alias("proposed_vehicle_ids"))).alias("payload")).unionByName(unread.select(
            "doc", F.lit("resolver").alias("source"), F.lit("ambiguous_match").alias("reason"), F.lit("resolver output failed validation").alias("agent_notes"),
            F.to_json(F.struct(F.col("n").alias("unresolved_count"))).alias("payload")))

    agent = "matchmaker"
    events = waiting.select("doc", event(agent, "resolving", count=F.col("n")).alias("e"))
    events = events.unionByName(unread.select("doc", event(agent, "resolver_output_invalid").alias("e")))
    events = events.unionByName(outcomes.filter(F.col("outcome") == "rejected").select(
        "doc", event(agent, "resolver_hallucinated_ids", fitment_index=F.col("row_idx")).alias("e")))
    events = events.unionByName(totals.select("doc", event(agent, "matched", count=F.col("match_count"), gemini_resolved=F.col("n_resolved")).alias("e")))
    return Matched(M.match_records(merged, rows, records), classes, totals, reviews, events.select("doc", "e.*"))
