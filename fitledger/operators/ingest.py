"""Splitting batch responses into outcomes, in line order and within a budget."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .ordered import ranged, running_sum
from .state import latest_per_key


def attach_items(lines: DataFrame, items: DataFrame, key: str = "eo_number") -> DataFrame:
    """lines with the newest work item of their key; lines without an item are dropped."""
    newest = latest_per_key(items, key, ["created_at", "id"]).select(key, F.col("id").alias("item_id"))
    return lines.join(newest, key)


def pending_ingest(lines: DataFrame, extractions: DataFrame, key: str = "eo_number") -> DataFrame:
    """Lines whose key has no stored extraction yet."""
    return lines.join(extractions.select(key).distinct(), key, "left_anti")


def ingest_lines(lines: DataFrame, items: DataFrame, extractions: DataFrame, limit: float,
                 key: str = "eo_number", order: str = "seq") -> DataFrame:
    """Every line once, with ``item_id``, ``usd`` and an ``outcome``:

    blank, unreadable   as ``reject`` says; such a line names no document
    no_item             no work item waits for the key
    skipped             the key has an extraction, stored before or by an earlier line
    bounced             unusable response; the item goes back to the queue
    stored              usable and within the budget
    tripped             the line whose cost would pass the budget: charged, not stored
    unread              after the tripped line, whatever it holds

    lines: key, order, usable, tok_in, tok_out and reject. Costs are exact decimals, so the running total is
    the same whatever order partial sums are added in. The lines are range partitioned by ``order`` and kept, so the
    costly parsing behind them is done once, and their running total is made of one total per partition.
    """
    known = extractions.select(key).distinct().withColumn("_known", F.lit(True))
    newest = latest_per_key(items, key, ["created_at", "id"]).select(key, F.col("id").alias("item_id"))
    read = ranged(lines, [], [order])
    j = read.join(newest, key, "left").join(known, key, "left")
    here = F.col("reject").isNull() & F.col("item_id").isNotNull()
    first = j.filter(here & F.col("usable") & F.col("_known").isNull()).groupBy(key).agg(F.min(order).alias("_first"))
    usd = T.token_cost(F.col("tok_in"), F.col("tok_out"), batch=True).cast("decimal(18,8)")
    j = j.join(first, key, "left").withColumns({
        "usd": usd,
        "_stores": here & F.coalesce(F.col(order) == F.col("_first"), F.lit(False)),
        "_skips": F.col("_known").isNotNull() | F.coalesce(F.col(order) > F.col("_first"), F.lit(False))})
    charged = j.withColumn("_cost", F.when(F.col("_stores"), F.col("usd")).otherwise(F.lit(0).cast("decimal(18,8)")))
    run = running_sum(charged, [], [order], "_cost", F.col("_range"), "_cum")
    top = F.lit(limit).cast("decimal(18,8)")
    outcome = (F.when(F.col("_cum") - F.col("_cost") > top, "unread")
               .when(F.col("reject").isNotNull(), F.col("reject")).when(F.col("item_id").isNull(), "no_item")
               .when(F.col("_stores") & (F.col("_cum") > top), "tripped")
               .when(F.col("_skips"), "skipped").when(F.col("_stores"), "stored").otherwise("bounced"))
    return run.withColumn("outcome", outcome).drop("_known", "_first", "_stores", "_skips", "_cost", "_cum", "_range")


def ingest_split(lines: DataFrame, items: DataFrame, extractions: DataFrame, limit: float,
                 key: str = "eo_number", order: str = "seq") -> DataFrame:
    """Lines with a work item: key, order, item_id, usd and outcome, as in ``ingest_lines``."""
    read = lines.select(key, order, "usable", "tok_in", "tok_out", F.lit(None).cast("string").alias("reject"))
    out = ingest_lines(read, items, extractions, limit, key, order)
    return out.filter(F.col("item_id").isNotNull()).select(key, order, "item_id", "usd", "outcome")
