"""Streams whose rows come in several micro-batches: results depend on the rows, not on the batches."""

import os
import random

import pytest
from pyspark.sql import functions as F

from fitledger.streaming import streams as T

SCHEMA = "id long, ts double, event_id long, what string"


def stream(spark, folder, batches, schema=SCHEMA):
    """A stream that gives one list of rows per micro-batch."""
    for n, rows in enumerate(batches):
        part = f"{folder}/part{n}"
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(part)
        for f in os.listdir(part):
            if f.endswith(".parquet"):
                os.utime(f"{part}/{f}", (1_000_000 + n, 1_000_000 + n))
    return (spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True)
            .option("pathGlobFilter", "*.parquet").parquet(str(folder)))


ERRORS = [(1, 100.0, 1, "error"), (1, 101.0, 2, "error"), (1, 102.0, 3, "error"), (1, 103.0, 4, "heal")]


def outcomes(df):
    return df.select("id", "ts", "event_id", F.col("what").alias("outcome"))


def retry(spark, folder, batches, late=60.0):
    history = spark.createDataFrame([r for b in batches for r in b], SCHEMA)
    return sorted(map(tuple, T.retry_table(outcomes(stream(spark, folder, batches)), outcomes(history), late).collect()))


@pytest.mark.parametrize("batches", [[ERRORS], [ERRORS[1:], ERRORS[:1]], [ERRORS[3:], ERRORS[1:3], ERRORS[:1]]])
def test_retry_state_follows_event_order(spark, tmp_path, batches):
    assert retry(spark, tmp_path, batches) == [(1, "pending", 0, 1)]


def test_retry_state_of_items_with_clocks_of_their_own(spark, tmp_path):
    """What is old for one item is news for another."""
    late = [[(1, 100.0, 1, "error")], [(2, 900.0, 9, "done")], [(1, 901.0, 2, "error")], [(1, 902.0, 3, "error"), (2, 10.0, 4, "error")]]
    assert retry(spark, tmp_path, late) == [(1, "failed", 3, 0), (2, "done", 1, 0)]


# The last file is older than all that is final for its items.
BACKLOG = [[(1, 1000.0, 4, "error"), (2, 1000.0, 5, "done")], [(2, 5000.0, 6, "error")], [(2, 6000.0, 7, "heal")],
           [(1, 100.0, 1, "error"), (1, 101.0, 2, "error"), (3, 50.0, 3, "error")]]


@pytest.mark.parametrize("order", [(0, 1, 2, 3), (3, 2, 1, 0), (1, 3, 0, 2)])
def test_retry_state_counts_a_backlog_in_any_order(spark, tmp_path, order):
    assert retry(spark, tmp_path, [BACKLOG[n] for n in order]) == [(1, "failed", 3, 0), (2, "pending", 1, 0), (3, "pending", 1, 0)]


def test_late_outcomes_come_out(spark, tmp_path):
    batches = [[(1, 100.0, 1, "error"), (1, 500.0, 2, "error")], [(1, 100.0, 0, "done"), (1, 470.0, 3, "heal")]]
    rows = T.drain_batches(T.retry_states(outcomes(stream(spark, tmp_path, batches)), 60.0), "late").collect()
    assert [(r.id, r.ts, r.event_id, r.outcome) for r in rows if r.kind == "late"] == [(1, 100.0, 0, "done")]
    assert sorted((r.batch, r.status, r.attempts) for r in rows if r.kind == "state") == [(0, "pending", 2), (1, "pending", 2)]


def test_state_does_not_grow_with_history(spark, tmp_path):
    """Sixty outcomes of an item in ten files: what waits is the last minute's."""
    batches = [[(1, 1000.0 * n + i, 10 * n + i, "error") for i in range(6)] for n in range(10)]
    progress = str(tmp_path / "progress")
    rows = T.retry_states(outcomes(stream(spark, tmp_path / "in", batches)), 60.0)
    rows.writeStream.outputMode("update").foreachBatch(lambda b, n: b.collect()).option("checkpointLocation", progress).trigger(availableNow=True).start().awaitTermination()
    held = spark.read.format("statestore").option("path", progress).option("stateVarName", "waiting").option("flattenCollectionTypes", True).load()
    assert held.count() == 6
    assert spark.read.format("statestore").option("path", progress).option("stateVarName", "now").load().count() == 1


def test_both_folds_agree(spark):
    """The fold of a table and that of a stream's item, over random outcomes."""
    rnd = random.Random(3)
    rows = [(i, float(k), k, rnd.choice(["error", "error", "heal", "done"])) for i in range(200) for k in range(rnd.randint(1, 30))]
    rnd.shuffle(rows)
    want = {}
    for i, _, _, what in sorted(rows):
        want[i] = T.retry_step(*want.get(i, ("pending", 0, 0)), what)
    assert {r.id: (r.status, r.attempts, r.heal_count) for r in T.fold_outcomes(outcomes(spark.createDataFrame(rows, SCHEMA))).collect()} == want


def test_activity_leaves_the_state_with_its_span(spark, tmp_path):
    day = 86_400.0
    batches = [[(1, 10.0, 1, "a"), (1, 20.0, 2, "b"), (2, 15.0, 3, "c")], [(1, 20.0, 4, "d")], [(3, 2 * day, 5, "e")], [(3, 3 * day, 6, "f")]]
    events = stream(spark, tmp_path / "in", batches).select(F.lit("r").alias("run_id"), F.col("id").alias("doc"), F.timestamp_seconds("ts").alias("at"), "ts", "event_id", F.col("what").alias("action"))
    last = T.drain_updates(T.run_activity(events), ["run_id", "doc", "span"], "activity")
    assert sorted((r.doc, r.action, r.n_events, r.idle) for r in T.idle_ages(last).collect()) == [(1, "d", 3, 3 * day - 20), (2, "c", 1, 3 * day - 15), (3, "e", 1, day), (3, "f", 1, 0.0)]
    q = T.run_activity(events).writeStream.outputMode("append").foreachBatch(lambda b, n: b.collect()).option("checkpointLocation", str(tmp_path / "p")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert q.lastProgress.stateOperators[0].numRowsTotal == 2  # the spans that are still open


WORK = [(1, 1000.0, 2, "in_progress"), (1, 990.0, 1, "done")]
CLOCK = [(9, 5000.0, 9, "done")]


@pytest.mark.parametrize("batches", [[WORK, CLOCK], [WORK[:1], WORK[1:], CLOCK], [WORK[1:], WORK[:1], CLOCK]])
def test_stuck_items_ignore_older_rows(spark, tmp_path, batches):
    rows = stream(spark, tmp_path, batches).select("id", F.timestamp_seconds("ts").alias("at"), "ts", "event_id", F.col("what").alias("status"))
    assert [tuple(r) for r in T.drain(T.stuck_items(rows), "stuck").collect()] == [(1, 1000.0)]


def test_stuck_items_see_updates_in_time(spark, tmp_path):
    batches = [[(1, 1000.0, 1, "in_progress")], [(1, 1500.0, 2, "in_progress")], [(1, 2050.0, 3, "done")], CLOCK]
    rows = stream(spark, tmp_path, batches).select("id", F.timestamp_seconds("ts").alias("at"), "ts", "event_id", F.col("what").alias("status"))
    assert T.drain(T.stuck_items(rows), "stuck").count() == 0


def test_feed_remembers_a_run_without_timed_events(spark, tmp_path):
    schema = "run_id string, started_at double, ts double, event_id long"
    old, new, older = ("a", 1.0, 5.0, 1), ("b", 2.0, None, 2), ("a", 1.0, 6.0, 3)
    feed = T.live_feed(stream(spark, tmp_path / "in", [[old], [new], [older]], schema), str(tmp_path / "out"))()
    assert feed.count() == 0
    feed = T.live_feed(stream(spark, tmp_path / "in2", [[old], [new], [older], [("b", 2.0, 9.0, 4)]], schema), str(tmp_path / "out2"))()
    assert [r.event_id for r in feed.collect()] == [4]
