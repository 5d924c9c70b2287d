"""Counts, spend, timelines and feeds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vocab as v
from ..functions.text import token_cost
from .ordered import last_known_before


def zero_filled(df: DataFrame, column: str, values: list[str]) -> DataFrame:
    """Rows per value of a fixed list, zero when there are none; other values are left out."""
    spark = df.sparkSession
    fixed = spark.range(1).select(F.explode(F.array(*[F.lit(x) for x in values])).alias(column))
    counts = df.filter(F.col(column).isin(values)).groupBy(column).agg(F.count("*").alias("n"))
    return fixed.join(counts, column, "left").select(column, F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def state_counts(approvals: DataFrame) -> DataFrame:
    """Approvals per report state, with the total over those states."""
    counts = zero_filled(approvals, "state", v.STATES)
    return counts.withColumn("total", F.sum("n").over(Window.partitionBy(F.lit(1))))


def all_states(approvals: DataFrame) -> DataFrame:
    return approvals.groupBy(F.coalesce("state", F.lit("unknown")).alias("state")).agg(F.count("*").alias("n"))


def counts_toward_spend(trigger: Column) -> Column:
    """Scheduled and backfill runs; hand-started and batch runs do not count."""
    return (trigger == "scheduled") | trigger.startswith("backfill")


def total_spend(runs: DataFrame, trigger: str = "trigger_kind", cost: str = "cost_usd") -> DataFrame:
    hit = F.when(counts_toward_spend(F.col(trigger)), F.col(cost))
    return runs.agg(F.coalesce(F.sum(hit), F.lit(0)).alias("spend"))


def cost_per_document(runs: DataFrame, extractions: DataFrame, trigger: str = "trigger_kind",
                      cost: str = "cost_usd") -> DataFrame:
    """One row: spend, extractions and unrounded cents per extraction, null unless both are positive."""
    n = extractions.select(F.count("*")).scalar()
    out = total_spend(runs, trigger, cost).withColumn("extractions", n)
    return out.withColumn("cents", F.when(
        (F.col("spend") > 0) & (F.col("extractions") > 0), F.col("spend") / F.col("extractions") * 100))


def run_summary(events: DataFrame, outcomes: dict[str, str], cost: str = "cost_usd") -> DataFrame:
    """Per run: cost and token sums and one counter per outcome.
    outcomes: counter name -> value of ``action`` it counts"""
    counters = [F.sum(F.when(F.col("action") == action, 1).otherwise(0)).alias(name)
                for name, action in outcomes.items()]
    return events.groupBy("run_id").agg(
        F.sum(cost).alias("cost_usd"), F.sum("tok_in").alias("tok_in"), F.sum("tok_out").alias("tok_out"), *counters)


def cost_projection(calls: DataFrame, documents: int = v.CORPUS_DOCUMENTS) -> DataFrame:
    """Average tokens per call and the cost of a corpus at that average."""
    avg = calls.agg(F.avg("tok_in").alias("avg_in"), F.avg("tok_out").alias("avg_out"))
    return avg.withColumn("projected_usd", F.lit(documents) * token_cost(F.col("avg_in"), F.col("avg_out")))


def event_timeline(events: DataFrame, keys: list[str], order: list[str], chunk: Column | None = None) -> DataFrame:
    """events with ``elapsed``: seconds since the last event of the same timeline whose time is
    known; null for the first one and for events without a time. Times do not decrease along
    ``order``. A very long timeline is worked on in chunks, not in one task."""
    placed = last_known_before(events, keys, order, "ts", chunk, "_prev")
    return placed.withColumn("elapsed", F.col("ts") - F.col("_prev")).drop("_prev")


def with_unknown(events: DataFrame, key: str = "doc", name: str = "(unknown)") -> DataFrame:
    return events.withColumn(key, F.coalesce(F.col(key).cast("string"), F.lit(name)))


def latest_feed(runs: DataFrame, events: DataFrame, n: int = 50) -> DataFrame:
    """The last ``n`` events of the newest run. Only one run id is broadcast."""
    newest = runs.orderBy(F.col("started_at").desc(), F.col("run_id")).limit(1).select("run_id")
    return (events.filter(F.col("ts").isNotNull()).join(F.broadcast(newest), "run_id")
            .orderBy(F.col("ts").desc(), F.col("event_id").desc()).limit(n))


def recent_runs(runs: DataFrame, n: int) -> DataFrame:
    return runs.orderBy(F.col("started_at").desc(), F.col("id")).limit(n)


def run_events(events: DataFrame, limit: int = 500, after: DataFrame | None = None) -> DataFrame:
    """First ``limit`` timed events of every run, and whether the run has more. The rank limit cuts rows inside each task
    before the shuffle.

    after: run_id, ts and event_id of the last event that was shown of a run; its events behind that one are given. Runs that it
    does not name start at their beginning. ``next_cursors`` of a page is the ``after`` of the next one, so every event is
    reached."""
    timed = events.filter(F.col("ts").isNotNull())
    if after is not None:
        seen = after.select("run_id", F.struct("ts", "event_id").alias("_seen"))
        timed = timed.join(seen, "run_id", "left").filter(F.col("_seen").isNull() | (F.struct("ts", "event_id") > F.col("_seen"))).drop("_seen")
    w = Window.partitionBy("run_id").orderBy("ts", "event_id")
    page = timed.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= limit)
    sizes = timed.groupBy("run_id").agg((F.count("*") > limit).alias("truncated"))
    return page.join(sizes, "run_id")


def next_cursors(page: DataFrame) -> DataFrame:
    """run_id, ts and event_id behind which the next page of each run that has one begins."""
    last = F.max(F.struct("ts", "event_id")).alias("x")
    return page.filter("truncated").groupBy("run_id").agg(last).select("run_id", "x.*")
