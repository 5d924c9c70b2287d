"""Work items, reviews and keyed tables as batch transformations: each function takes the
current tables and gives the rows to write; storage and locking stay with the table format."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vocab as v
from .ordered import running_count


def latest_per_key(df: DataFrame, key: str | list[str], order: list[str]) -> DataFrame:
    """Newest row per key. The rank limit is applied in every task before the shuffle, so a
    hot key sends one row per task."""
    keys = [key] if isinstance(key, str) else key
    w = Window.partitionBy(*keys).orderBy(*[F.col(c).desc_nulls_last() for c in order])
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") == 1).drop("_rn")


def is_claimable(status: Column, lease_expires: Column, now: Column) -> Column:
    """Pending, or in progress with a lease that has run out."""
    expired = F.coalesce(lease_expires, F.lit(0.0)) < now
    return F.coalesce((status == "pending") | ((status == "in_progress") & expired), F.lit(False))


def backlog_head(items: DataFrame, now: Column, n: int) -> DataFrame:
    """The ``n`` oldest claimable items."""
    ready = items.filter(is_claimable(F.col("status"), F.col("lease_expires"), now))
    return ready.orderBy("created_at", "id").limit(n)


def backlog_head_by_stage(items: DataFrame, now: Column, n: int) -> DataFrame:
    ready = items.filter(is_claimable(F.col("status"), F.col("lease_expires"), now))
    w = Window.partitionBy("stage").orderBy("created_at", "id")
    return ready.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= n)


def attempt_update(items: DataFrame, outcomes: DataFrame, max_attempts: int = v.MAX_ATTEMPTS) -> DataFrame:
    """items after processing. outcomes: id, outcome, error; outcome is complete,
    needs_review, budget, or error. Items without an outcome are unchanged.

    Both sides grow with the corpus and error texts may be long, which no estimate of Spark's knows beforehand,
    so neither side is broadcast."""
    j = items.join(outcomes.hint("merge"), "id", "left")
    tries = F.coalesce("attempts", F.lit(0)) + 1
    failed = F.col("outcome") == "error"
    done = F.col("outcome").isin("complete", "needs_review")
    return j.withColumns({
        "status": F.when(done, "done").when(F.col("outcome") == "budget", "pending")
        .when(failed & (tries >= max_attempts), "failed").when(failed, "pending").otherwise(F.col("status")),
        "stage": F.when(F.col("outcome") == "complete", "complete")
        .when(F.col("outcome") == "needs_review", "review").otherwise(F.col("stage")),
        "attempts": F.when(failed, tries).otherwise(F.col("attempts")),
        "last_error": F.when(failed, F.col("error")).otherwise(F.col("last_error")),
    }).drop("outcome", "error")


def batch_eligible(items: DataFrame) -> DataFrame:
    """Items for a batch job: pending ones, and failed ones whose failure is transient, reset;
    never those over the input cap."""
    e = F.coalesce("last_error", F.lit(""))
    transient = (F.col("status") == "failed") & (T.classify_failure(e) == "transient")
    return (items.filter(~T.is_token_cap(e) & ((F.col("status") == "pending") | transient))
            .withColumns({"attempts": F.when(transient, 0).otherwise(F.col("attempts")),
                          "status": F.lit("pending")}))


def heal_plan(items: DataFrame, kind: str, cap: int, eligible: Column | None = None) -> DataFrame:
    """Failed items of one failure kind with ``action``: requeue the first ``cap`` in
    (created_at, id) order, and mark items that have just reached the heal limit once.

    Items at the limit do not use up the cap. Only ``cap`` rows are ordered, by a top-k.
    """
    failed = items.filter((F.col("status") == "failed") & (T.classify_failure(F.col("last_error")) == kind))
    healed = F.coalesce("heal_count", F.lit(0))
    open_items = failed.filter(healed < v.HEAL_LIMIT)
    if eligible is not None:
        open_items = open_items.filter(eligible)
    requeue = open_items.orderBy("created_at", "id").limit(cap).withColumn("action", F.lit("requeue"))
    parked = failed.filter(healed == v.HEAL_LIMIT).withColumn("action", F.lit("heal_limit_reached"))
    # Items behind the last one requeued were never looked at, so their limit is not noted yet.
    last = requeue.select(F.max(F.struct("created_at", "id"))).scalar()
    short = requeue.select(F.count("*") < cap).scalar()
    seen = parked.withColumns({"_short": short, "_last": last}).filter(
        F.col("_short") | (F.struct("created_at", "id") < F.col("_last")))
    return requeue.unionByName(seen.drop("_last", "_short"))


def heal_updates(plan: DataFrame) -> DataFrame:
    """Item fields after a heal plan: heal_count + 1 for both actions, a fresh start for
    requeued items only."""
    fresh = F.col("action") == "requeue"
    return plan.withColumns({
        "heal_count": F.coalesce("heal_count", F.lit(0)) + 1,
        "status": F.when(fresh, "pending").otherwise(F.col("status")),
        "attempts": F.when(fresh, 0).otherwise(F.col("attempts")),
        "last_error": F.when(fresh, "").otherwise(F.col("last_error")),
    })


def heal_events(plan: DataFrame, requeued_action: str = "requeued_transient", key: str = "doc") -> DataFrame:
    return plan.select(F.lit("healer").alias("agent"), key, F.when(
        F.col("action") == "requeue", requeued_action).otherwise(F.col("action")).alias("action"))


def requeue_reviews(reviews: DataFrame, reasons: list[str], run_id: str, now: Column,
                    key: str = "doc") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(closed reviews, approvals to reset, new work items) for open reviews of some reasons."""
    hit = reviews.filter((F.col("status") == "open") & F.col("reason").isin(reasons))
    closed = hit.withColumns({"status": F.lit("superseded_by_reprocess"), "resolved_at": now})
    keys = hit.select(key).distinct()
    reset = keys.withColumn("state", F.lit("discovered"))
    items = keys.select(F.concat(F.lit(run_id + "_"), F.col(key).cast("string")).alias("id"), key,
                        F.lit(run_id).alias("run_id"), F.lit("pending").alias("status"),
                        F.lit("extract").alias("stage"), F.lit(0).alias("attempts"))
    return closed, reset, items


def review_outcomes(decisions: DataFrame, reviews: DataFrame, order: list[str]) -> DataFrame:
    """decisions with ``result``: not_found, conflict (no longer open, or closed by an earlier
    decision), rejected, invalid (corrections give no valid record; nothing changes) or approved,
    and the review and approval states that follow, null where nothing changes.
    decisions: id, action, valid and the columns of ``order``, which tell in what order the
    decisions about one review came"""
    at = F.struct(*order)
    closing = (F.col("action") == "reject") | F.col("valid")
    first = decisions.filter(closing).groupBy("id").agg(F.min(at).alias("_first"))
    j = (decisions.join(reviews.select("id", "doc", F.col("status").alias("_status")), "id", "left").join(first, "id", "left"))
    result = (F.when(F.col("_status").isNull(), "not_found").when((F.col("_status") != "open") | (at > F.col("_first")), "conflict")
              .when(F.col("action") == "reject", "rejected").when(~F.col("valid"), "invalid").otherwise("approved"))
    j = j.withColumn("result", result).drop("_status", "_first")
    return j.withColumns({
        "review_status": F.when(F.col("result").isin("rejected", "approved"), F.col("result")),
        "approval_state": F.when(F.col("result") == "rejected", "failed").when(F.col("result") == "approved", "complete")})


def manual_retry(requests: DataFrame, items: DataFrame, key: str = "doc") -> DataFrame:
    """requests (key) with ``result``: requeued when the newest item failed, otherwise why not."""
    newest = latest_per_key(items, key, ["created_at", "id"]).select(key, "id", "status")
    return requests.join(newest, key, "left").withColumn(
        "result", F.when(F.col("status").isNull(), "no work item").when(F.col("status") == "failed", "requeued")
        .otherwise(F.concat(F.lit("not failed (status="), "status", F.lit(")"))))


def merge_upsert(current: DataFrame, changes: DataFrame, key: str = "doc", order: str | None = None) -> DataFrame:
    """Table after a partial upsert. changes: key, and per column c a flag ``has_c`` next to
    ``c``; a column whose flag is not true keeps its value, a null with the flag overwrites.
    Where keys repeat, ``order`` names the column that tells which change came last: each column
    takes the last change that flags it. Without ``order`` a repeated key is an error."""
    cols = [c for c in current.columns if c != key]
    if order is None:
        # grouped by the key of the join below, so this needs no shuffle of its own
        one = F.when(F.count("*") > 1, F.raise_error(F.lit("a key of the changes repeats; name their order"))).otherwise(F.lit(True))
        changes = changes.groupBy(key).agg(*[F.any_value(c).alias(c) for c in changes.columns if c != key], one.alias("_one")).filter("_one").drop("_one")
    else:
        changes = changes.groupBy(key).agg(*[
            x for c in cols for x in (F.max_by(c, F.when(F.col("has_" + c), F.col(order))).alias(c), F.max("has_" + c).alias("has_" + c))])
    new = changes.select(F.col(key).alias("_k"), *[
        x for c in cols for x in (F.col(c).alias("n_" + c), F.col("has_" + c).alias("h_" + c))])
    j = current.join(new, current[key] == new["_k"], "full_outer")
    return j.select(F.coalesce(key, "_k").alias(key), *[
        F.when(F.coalesce("h_" + c, F.lit(False)), F.col("n_" + c)).otherwise(F.col(c)).alias(c) for c in cols])


def replace_by_key(existing: DataFrame, processed: DataFrame, new: DataFrame, key: str = "doc", when: Column | None = None) -> DataFrame:
    """existing without the rows of processed keys, plus the new rows. Keys come from
    ``processed``, so a key with no new rows still loses its old ones. ``when``, over columns of existing and other ones of
    processed, tells which rows of a key go; without it all do."""
    if when is None:
        return existing.join(processed.select(key).distinct(), key, "left_anti").unionByName(new)
    done = processed.withColumnRenamed(key, "_key")
    return existing.join(done, (F.col(key) == F.col("_key")) & when, "left_anti").unionByName(new)


def number_versions(extractions: DataFrame, key: str = "doc") -> DataFrame:
    """extractions with ``version``: 1, 2, ... per key in order of creation. Counted by range partitions, so that
    a key with very many versions is not one task's work."""
    return running_count(extractions, [key], ["created_at", "id"], None, "version")


def constrained_topk(approvals: DataFrame, registry: DataFrame, n: int, key: str = "doc") -> DataFrame:
    """The ``n`` most recent processed approvals of the registry, of which at least one
    supersedes an approval that is still known: if none of them does, the last one gives way
    to the next that does. Empty when there are too few, or when no such approval exists.
    approvals: key, state, first_seen, supersedes. Column ``star`` marks superseding ones.

    Three top-k passes; at most n + 1 rows are ever compared.
    """
    eligible = approvals.filter(F.col("state").isin("complete", "superseded")).join(
        registry.select(key).distinct(), key, "left_semi")
    preds = eligible.select(key, F.explode("supersedes").alias("_p"))
    stars = (preds.join(approvals.select(F.col(key).alias("_p")), "_p", "left_semi")
             .select(key).distinct().withColumn("star", F.lit(True)))
    marked = eligible.select(key, F.coalesce("first_seen", F.lit(0.0)).alias("first_seen")).join(
        stars, key, "left").withColumn("star", F.coalesce("star", F.lit(False)))
    newest = [F.col("first_seen").desc(), F.col(key)]
    window = marked.orderBy(*newest).limit(n).withColumn("_src", F.lit(0))
    spare = marked.filter("star").orderBy(*newest).limit(1).withColumn("_src", F.lit(1))
    both = window.unionByName(spare)
    stats = Window.partitionBy(F.lit(1))
    ranked = both.withColumns({
        "_n": F.sum(F.when(F.col("_src") == 0, 1).otherwise(0)).over(stats),
        "_has": F.max(F.when((F.col("_src") == 0) & F.col("star"), 1).otherwise(0)).over(stats),
        "_spare": F.max("_src").over(stats),
        "_rn": F.row_number().over(stats.orderBy("_src", F.col("first_seen").desc(), F.col(key)))})
    keep = ((F.col("_n") == n) & (F.col("_spare") == 1)
            & F.when(F.col("_has") == 1, F.col("_src") == 0)
            .otherwise((F.col("_src") == 1) | (F.col("_rn") < n)))
    return ranked.filter(keep).select(key, "first_seen", "star")


RELATED = ("extractions", "matches", "work_items", "reviews")


def take_snapshot(tables: dict[str, DataFrame], staged: DataFrame, key: str = "doc") -> dict[str, DataFrame]:
    """Rows of every table that belong to staged keys, and the approvals of the first known
    predecessor of each (``predecessors``) as they are now.

    ``approvals`` must carry ``supersedes``. The result is to be written before the tables
    are changed.
    """
    keys = staged.select(key).distinct()
    snap = {name: df.join(keys, key, "left_semi") for name, df in tables.items()}
    named = snap["approvals"].select(F.col(key).alias("_s"), F.posexplode("supersedes").alias("_pos", "_p"))
    known = named.join(tables["approvals"].select(F.col(key).alias("_p")), "_p", "left_semi")
    first = known.groupBy("_s").agg(F.min(F.struct("_pos", "_p")).alias("_f")).select(
        F.col("_f._p").alias(key)).distinct()
    snap["predecessors"] = tables["approvals"].join(first, key, "left_semi").join(keys, key, "left_anti")
    return snap


def stage_out(tables: dict[str, DataFrame], snap: dict[str, DataFrame], staged: DataFrame,
              key: str = "doc") -> dict[str, DataFrame]:
    """Tables without the staged keys; predecessors go back to complete."""
    keys = staged.select(key).distinct()
    out = {name: df.join(keys, key, "left_anti") for name, df in tables.items()}
    reset = snap["predecessors"].select(key, F.lit(True).alias("_reset"))
    out["approvals"] = (out["approvals"].join(reset, key, "left")
                        .withColumn("state", F.when(F.col("_reset"), "complete").otherwise(F.col("state")))
                        .withColumn("superseded_by", F.when(F.col("_reset"), None).otherwise(F.col("superseded_by")))
                        .drop("_reset"))
    return out


def restore(tables: dict[str, DataFrame], snap: dict[str, DataFrame], key: str = "doc") -> dict[str, DataFrame]:
    """Undo stage_out exactly: every row and every predecessor as it was."""
    out = {name: df.unionByName(snap[name]) for name, df in tables.items()}
    out["approvals"] = (out["approvals"].join(snap["predecessors"].select(key), key, "left_anti")
                        .unionByName(snap["predecessors"]))
    return out


def snapshot_summary(snap: dict[str, DataFrame], key: str = "doc") -> DataFrame:
    """Rows per table and staged key, counted before the tables are brought together."""
    parts = [df.groupBy(key).agg(F.count("*").alias("n")).withColumn("part", F.lit(name))
             for name, df in snap.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
