"""Response lines of a batch job to stored extractions, and the audit and matching that follow.

Every input line has one outcome. The extraction of a stored line and its cost count whatever becomes of it afterwards, so no later
ingest pays for a document twice. Documents whose later calls failed (``errors``) keep their extraction and go
back to the queue, or fail for good when their attempts are used up; all others go through the daily run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vocab as v
from ..operators import ingest as I
from ..operators import quality as Q
from ..operators.reports import zero_filled
from ..operators import state as S
from . import daily
from .matching_run import event

# What becomes of a line beside the outcomes that are tallied.
REJECTS = ["blank", "unreadable", "no_item", "tripped", "unread"]


def ingest_batch(tables: daily.DailyTables, lines: DataFrame, items: DataFrame, errors: DataFrame, limit: float, run_id: str, now: float,
                 baseline: DataFrame, catalog: DataFrame, verdicts: DataFrame, decisions: DataFrame, invalid: DataFrame,
                 draw: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(lines with their outcome, work items that change).

    lines: as ``sources.inference.read_lines`` gives them, with ``seq``. items: id, doc, eo_number, attempts, created_at. errors: doc, error.
    outcome: complete, needs_review, bounced, skipped, retry or failed, or one of REJECTS. Only what lines cost is held against
    ``limit``; what the calls of the audit cost is for the caller's model to meter.
    """
    keep = tables.keep(run_id)
    newest = S.latest_per_key(items, "doc", ["created_at", "id"])
    numbers = newest.select("doc", "eo_number")
    held = tables.extractions.read().select("doc").distinct().join(numbers, "doc").select("eo_number")
    split = keep(I.ingest_lines(lines.select("seq", "eo_number", "usable", "tok_in", "tok_out", "reject", "record"), newest, held, limit), "lines")
    stored = split.filter(F.col("outcome") == "stored").join(newest.select(F.col("id").alias("item_id"), "doc", "attempts"), "item_id")
    told = errors.groupBy("doc").agg(F.min("error").alias("error"))
    taken = keep(stored.join(told, "doc", "left").select("doc", "item_id", "seq", "attempts", "error", F.col("eo_number").alias("doc_key"), "record.*",
                                                         (F.coalesce("attempts", F.lit(0)) + 1).alias("tries")), "stored")

    chance = Q.repeatable_draw(F.col("doc_key")) if draw is None else draw
    ready = taken.filter("error IS NULL").withColumn("draw", chance)
    daily.run_batch(tables, ready, baseline, catalog, verdicts, decisions, invalid, run_id, now)
    broken = taken.filter("error IS NOT NULL")
    fields = [f for f in daily.RECORD_FIELDS if f in taken.columns]
    tables.extractions.replace(broken, broken.select("doc", F.lit(1).alias("version"), F.to_json(F.struct(*fields)).alias("payload"), F.lit(now).alias("created_at")))
    given_up = broken.filter(F.col("tries") >= v.MAX_ATTEMPTS)
    tables.approvals.upsert(given_up.select("doc", F.lit("failed").alias("state")))
    read = taken.select("doc", event("batchfill", "extracted", confidence=F.col("confidence")).alias("e")).select("doc", "e.*")
    tables.add_events(read, f"{run_id}-lines")

    audited = tables.spark.read.parquet(f"{tables.root}/runs/{run_id}/audited").select("doc", F.col("outcome").alias("verdict"))
    final = keep(taken.join(audited, "doc", "left").select(
        "seq", F.when(F.col("error").isNotNull(), F.when(F.col("tries") >= v.MAX_ATTEMPTS, "failed").otherwise("retry"))
        .when(F.col("verdict") == "accepted", "complete").otherwise("needs_review").alias("final"), "tries", "error"), "final")
    out = keep(split.drop("record", "reject", "usable").join(final, "seq", "left").withColumn("outcome", F.coalesce("final", "outcome")).drop("final"), "outcomes")
    return out, item_changes(out)


def item_changes(outcomes: DataFrame) -> DataFrame:
    """id, status, stage, attempts and last_error of the items that lines name; null where a field stays. The last line of an item
    that says something counts."""
    o = F.col("outcome")
    told = outcomes.filter(o.isin("complete", "needs_review", "bounced", "tripped", "retry", "failed"))
    # a stored line outranks bounced ones of the same item: its extraction is there
    rank = F.struct(o != "bounced", "seq")
    last = told.groupBy("item_id").agg(F.max_by(F.struct("outcome", "tries", "error"), rank).alias("x")).select("item_id", "x.*")
    broken = o.isin("retry", "failed")
    return last.select(F.col("item_id").alias("id"),
                       F.when(o.isin("complete", "needs_review"), "done").when(o == "failed", "failed").otherwise("pending").alias("status"),
                       F.when(o == "complete", "complete").when(o == "needs_review", "review").alias("stage"),
                       F.when(broken, F.col("tries")).alias("attempts"), F.when(broken, F.substring("error", 1, 500)).alias("last_error"))


def tally(outcomes: DataFrame) -> DataFrame:
    """Lines per outcome, all outcomes present."""
    return zero_filled(outcomes, "outcome", [*v.INGEST_OUTCOMES, *REJECTS])
