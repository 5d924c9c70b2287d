"""Discovery, supersession and one-off repairs of the approval registry."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import labels as L
from ..session import reliable


def discover_new(listing: DataFrame, known: DataFrame, key: str = "eo_number") -> DataFrame:
    """Listing rows whose key is not known yet; only the key of ``known`` is read."""
    return listing.join(known.select(key), key, "left_anti")


def admit(new: DataFrame, payloads: DataFrame, key: str = "eo_number") -> tuple[DataFrame, DataFrame]:
    """(approval rows for new keys with a vetted payload, events for every new key).
    payloads: key, gcs_uri, vetted, sha256"""
    j = new.join(payloads, key, "left").withColumn("_ok", F.coalesce("vetted", F.lit(False)))
    approvals = j.filter("_ok").select(key, F.lit("discovered").alias("state"), "pdf_url", "gcs_uri", "sha256")
    events = j.select(key, F.lit("scout").alias("agent"),
                      F.when(F.col("_ok"), "discovered").otherwise("discover_failed").alias("action"),
                      F.when(~F.col("_ok"), "no usable document").alias("error"))
    return approvals, events


def mark_superseded(accepted: DataFrame, approvals: DataFrame, key: str = "doc") -> DataFrame:
    """approvals with ``state`` and ``superseded_by`` set where an accepted approval names
    them; of several successors the one audited last counts. Unknown predecessors are ignored.
    accepted: key, audited_at, supersedes (array)

    Set-based on purpose: the outcome does not depend on the order records were processed in.
    """
    heirs = (accepted.select(F.explode("supersedes").alias("_old"), F.col(key).alias("_new"), "audited_at")
             .groupBy("_old").agg(F.max(F.struct("audited_at", "_new")).alias("_h"))
             .select(F.col("_old").alias(key), F.col("_h._new").alias("_heir")))
    return (approvals.drop("superseded_by").join(heirs, key, "left")
            .withColumn("superseded_by", F.col("_heir"))
            .withColumn("state", F.when(F.col("_heir").isNotNull(), "superseded").otherwise(F.col("state")))
            .drop("_heir"))


def lineage(starts: DataFrame, edges: DataFrame, approvals: DataFrame, depth: int = 5,
            key: str = "doc") -> DataFrame:
    """Nodes reached from each start within ``depth`` hops in each direction, each once at its
    least depth.

    edges: direction, src, dst. Gives start, direction, node, depth, exists, state, capped.
    All starts and both directions walk together. Edges are kept once and read once a hop; a hop keeps only
    nodes that its walk has not seen, so branches that meet again do not multiply and a cycle ends where it
    closes. Every hop is kept in the shared checkpoint folder, so the plan does not grow with the depth, and the walk stops with the
    first hop that finds nothing. The start itself is never reported. ``capped`` marks walks whose last hop found new
    nodes, so their chain may go on.
    """
    ways = ["start", "direction", "node"]
    step = reliable(edges.select("direction", F.col("src").alias("node"), "dst").distinct())
    front = starts.select(F.col(key).alias("start")).distinct().join(step.withColumnRenamed("node", "start"), "start").select(
        "start", "direction", F.col("dst").alias("node"))
    seen = None
    for d in range(1, depth + 1):
        new = front.filter(F.col("start") != F.col("node")).distinct()
        if seen is not None:
            new = new.join(seen.select(*ways), ways, "left_anti")
        hop = reliable(new.withColumn("depth", F.lit(d)))
        if d > 1 and hop.isEmpty():
            break
        seen = hop if seen is None else seen.unionByName(hop)
        front = hop.join(step, ["direction", "node"]).select("start", "direction", F.col("dst").alias("node"))
    ends = seen.groupBy("start", "direction").agg((F.max("depth") == depth).alias("capped"))
    known = approvals.select(F.col(key).alias("node"), "state", F.lit(True).alias("_known"))
    return (seen.join(ends, ["start", "direction"]).join(known, "node", "left")
            .select(*ways, "depth", F.coalesce("_known", F.lit(False)).alias("exists"), "state", "capped"))


def supersedes_edges(approvals: DataFrame, key: str = "doc") -> DataFrame:
    """Edges from an approval back to those it replaces."""
    return approvals.select(F.lit("back").alias("direction"), F.col(key).alias("src"),
                            F.explode("supersedes").alias("dst"))


def superseded_by_edges(approvals: DataFrame, key: str = "doc") -> DataFrame:
    """Edges from an approval forward to the one that replaced it."""
    return approvals.filter(F.col("superseded_by").isNotNull()).select(
        F.lit("forward").alias("direction"), F.col(key).alias("src"), F.col("superseded_by").alias("dst"))


def repair_missing_url(approvals: DataFrame, listing: DataFrame, key: str = "eo_number", order: list[str] | None = None) -> DataFrame:
    """Fill a missing address from the listing, leave every other address alone. Where a listing
    repeats a key, the address that comes last by ``order`` (page and row) counts; without one, its smallest address."""
    some = listing.filter(F.coalesce("pdf_url", F.lit("")) != "")
    chosen = F.max_by("pdf_url", F.struct(*order)) if order else F.min("pdf_url")
    found = some.groupBy(key).agg(chosen.alias("_found"))
    return (approvals.join(found, key, "left")
            .withColumn("pdf_url", F.coalesce(F.nullif("pdf_url", F.lit("")), F.col("_found"), F.col("pdf_url")))
            .drop("_found"))


def repair_status(approvals: DataFrame, wrong: str = "eo_status") -> DataFrame:
    """Move a superseded marker from a wrongly named column to ``state``; drop that column."""
    return approvals.withColumn(
        "state", F.when(F.col(wrong) == "superseded", F.col(wrong)).otherwise(F.col("state"))).drop(wrong)


def approval_detail(approvals: DataFrame, extractions: DataFrame, baseline: DataFrame, items: DataFrame,
                    key: str = "doc") -> DataFrame:
    """Approval with its latest extraction, baseline and newest work item; approval fields
    fall back to the extraction's. extractions and items must already be latest per key."""
    ex = extractions.select(key, *[F.col(c).alias("x_" + c) for c in
                                   ("manufacturer", "device_name", "category", "confidence")])
    base = baseline.select(key, F.col("fitment_count").alias("baseline_rows"))
    it = items.select(key, F.col("status").alias("item_status"), F.coalesce("last_error", F.lit("")).alias("last_error"),
                      F.coalesce("attempts", F.lit(0)).alias("attempts"), F.coalesce("stage", F.lit("unknown")).alias("stage"))
    return (approvals.join(ex, key, "left").join(base, key, "left").join(it, key, "left")
            .select(key, "state", L.safe_link(F.col("pdf_url")).alias("link"),
                    *[F.coalesce(c, "x_" + c).alias(c) for c in ("manufacturer", "device_name", "category", "confidence")],
                    "baseline_rows", "item_status", "last_error", "attempts", "stage"))
