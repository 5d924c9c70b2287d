"""Structured Streaming forms of the jobs that follow live activity.

Lateness: event-time operators take a ``late`` delay; rows older than the watermark are
dropped by Spark. The state of an item is kept per key by Spark's state store.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..functions import vocab as v
from ..session import checkpoint_dir


def work_folder(spark: SparkSession, name: str) -> str:
    """New folder for one stream's output and progress, inside the shared checkpoint folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def drain(stream: DataFrame, name: str) -> DataFrame:
    """Run an append stream over all data that is there now and read back what it wrote."""
    spark = stream.sparkSession
    folder = work_folder(spark, name)
    q = (stream.writeStream.format("parquet").outputMode("append").option("path", f"{folder}/out")
         .option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


def drain_batches(stream: DataFrame, name: str) -> DataFrame:
    """Run an update stream and read back all it gave, with the number of the ``batch``. Each batch is
    written under its number, so a batch that is run again replaces itself."""
    spark = stream.sparkSession
    folder = work_folder(spark, name)

    def keep(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch={n}")

    q = (stream.writeStream.outputMode("update").foreachBatch(keep)
         .option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.option("basePath", f"{folder}/out").schema(
        f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in stream.schema)}, batch INT"
    ).parquet(f"{folder}/out")


def drain_updates(stream: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Run an update stream and give the last state of every key."""
    rows = drain_batches(stream, name)
    rest = [c for c in stream.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("_s")).select(*keys, "_s.*")


def discoveries(listing: DataFrame, known: DataFrame, key: str = "eo_number") -> DataFrame:
    """Keys of a listing stream that are not in the known table, each once."""
    return listing.join(known.select(key), key, "left_anti").dropDuplicates([key])


def discoveries_within(listing: DataFrame, known: DataFrame, seen_at: str, late: str,
                       key: str = "eo_number") -> DataFrame:
    """As ``discoveries`` for an endless listing: keys are remembered for ``late`` only, so the
    state stays bounded; older repeats must by then be in the known table."""
    return (listing.withWatermark(seen_at, late).join(known.select(key), key, "left_anti")
            .dropDuplicatesWithinWatermark([key]))


def run_totals(events: DataFrame, counters: dict[str, str], cost: str = "cost_usd") -> DataFrame:
    """Running cost, token and outcome sums per run; use update mode."""
    outcomes = [F.sum(F.when(F.col("action") == a, 1).otherwise(0)).alias(n) for n, a in counters.items()]
    return events.groupBy("run_id").agg(F.sum(cost).alias("cost_usd"), F.sum("tok_in").alias("tok_in"),
                                        F.sum("tok_out").alias("tok_out"), *outcomes)


def activity_sessions(events: DataFrame, gap: str = "20 seconds", late: str = "1 minute",
                      key: str = "run_id", at: str = "at") -> DataFrame:
    """Stretches of activity per run. A stretch is given once the run has been idle for
    ``gap``; its end plus the gap is the moment the run counts as idle."""
    return (events.withWatermark(at, late)
            .groupBy(key, F.session_window(F.col(at), gap).alias("w"))
            .agg(F.count("*").alias("n_events"))
            .select(key, F.col("w.start").alias("active_from"), F.col("w.end").alias("idle_at"), "n_events"))


def live_feed(events: DataFrame, folder: str, n: int = 50) -> Callable[[], DataFrame]:
    """Start a stream that keeps the last ``n`` events of the newest run under ``folder``; the
    returned function waits for it and reads the feed, empty when no batch ran. What is carried
    from one batch to the next is the newest run, which may have no timed event yet, and at most
    ``n`` rows.

    events: run_id, started_at, ts, event_id, ...
    """
    spark = events.sparkSession
    schema = events.schema
    runs = events.select("run_id", "started_at").schema
    written: list[int] = []

    def merge(batch: DataFrame, number: int) -> None:
        rows, starts = batch, batch.select("run_id", "started_at")
        if number > 0:
            rows = rows.unionByName(spark.read.schema(schema).parquet(f"{folder}/feed/{number - 1}"))
            starts = starts.unionByName(spark.read.schema(runs).parquet(f"{folder}/newest/{number - 1}"))
        (starts.orderBy(F.col("started_at").desc(), F.col("run_id")).limit(1)
         .write.mode("overwrite").parquet(f"{folder}/newest/{number}"))
        newest = spark.read.schema(runs).parquet(f"{folder}/newest/{number}").select("run_id")
        feed = (rows.filter("ts IS NOT NULL").join(F.broadcast(newest), "run_id", "left_semi")
                .orderBy(F.col("ts").desc(), F.col("event_id").desc()).limit(n))
        feed.coalesce(1).write.mode("overwrite").parquet(f"{folder}/feed/{number}")
        written.append(number)

    q = (events.writeStream.foreachBatch(merge).option("checkpointLocation", f"{folder}/progress")
         .trigger(availableNow=True).start())

    def read() -> DataFrame:
        q.awaitTermination()
        if not written:
            return spark.createDataFrame([], schema)
        return spark.read.schema(schema).parquet(f"{folder}/feed/{written[-1]}")

    return read


# An item after some outcomes, and an outcome that waits for others that may still come before it.
RETRY_STATE = "status string, attempts int, heal_count int, folded_ts double, folded_id long, newest double"
WAITING = "ts double, event_id long, outcome string"
RETRY_ROWS = f"kind string, id long, status string, attempts int, heal_count int, {WAITING}"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def retry_step(status: str, attempts: int, heals: int, outcome: str) -> tuple[str, int, int]:
    if outcome == "heal":
        return ("pending", 0, heals + 1) if status == "failed" and heals < v.HEAL_LIMIT else (status, attempts, heals)
    if outcome == "error":
        return ("failed" if attempts + 1 >= v.MAX_ATTEMPTS else "pending"), attempts + 1, heals
    return "done", attempts, heals


class RetryFold(StatefulProcessor):
    """Folds the outcomes of an item in (ts, event_id) order. What is older than the item's newest outcome by ``late`` seconds is final
    and lives on in three numbers; what is younger waits in a list."""

    def __init__(self, late: float):
        self.late = late

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.now = handle.getValueState("now", RETRY_STATE)
        self.waiting = handle.getListState("waiting", WAITING)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = [r for b in rows for r in zip(b["ts"].tolist(), b["event_id"].tolist(), b["outcome"].tolist())]
        *now, folded_ts, folded_id, newest = self.now.get() if self.now.exists() else ("pending", 0, 0, float("-inf"), -1, float("-inf"))
        passed = (folded_ts, folded_id)
        held = [tuple(r) for r in self.waiting.get()] if self.waiting.exists() else []
        rest = sorted(held + [r for r in new if r[:2] > passed])
        newest = max([newest, *(r[0] for r in rest)])
        final = sum(r[0] <= newest - self.late for r in rest)
        for ts, event_id, outcome in rest[:final]:
            now, passed = retry_step(*now, outcome), (ts, event_id)
        self.now.update((*now, *passed, newest))
        if rest[final:]:
            self.waiting.put(rest[final:])
        elif held:
            self.waiting.clear()
        for *_, outcome in rest[final:]:
            now = retry_step(*now, outcome)
        out = [("state", key[0], *now, None, None, None)]
        out += [("late", key[0], None, None, None, *r) for r in new if r[:2] <= (folded_ts, folded_id)]
        frame = pd.DataFrame(out, columns=[c.split()[0] for c in RETRY_ROWS.split(", ")])
        yield frame.astype({"attempts": "Int32", "heal_count": "Int32", "event_id": "Int64"})

    def close(self) -> None:
        pass


def retry_states(outcomes: DataFrame, late: float = 60.0) -> DataFrame:
    """Outcomes (id, ts in seconds, event_id, outcome: done, error or heal) to rows of RETRY_ROWS; use update mode.

    kind ``state``: an item after all its outcomes so far, those that wait counted in the place they have so far. kind ``late``: an outcome
    older than what is final for its item; it comes out as a row of its own and is not dropped. The state of an item is
    its numbers and the outcomes of its last ``late`` seconds, however long its history is. Every item has a clock of its own, so a backlog
    whose files follow no common order makes an outcome late only if its own item has gone on. No other state store keeps lists,
    so the session's is set to RocksDB."""
    outcomes.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    return outcomes.select("id", "ts", "event_id", "outcome").groupBy("id").transformWithStateInPandas(RetryFold(late), RETRY_ROWS, "Update", "None")


def fold_outcomes(outcomes: DataFrame) -> DataFrame:
    """id, status, attempts and heal_count after all outcomes of a table, in (ts, event_id) order."""
    def step(acc: Column, e: Column) -> Column:
        healed = (e["outcome"] == "heal") & (acc["status"] == "failed") & (acc["heal_count"] < v.HEAL_LIMIT)
        tries = acc["attempts"] + 1
        status = (F.when(healed, "pending").when(e["outcome"] == "heal", acc["status"])
                  .when(e["outcome"] == "error", F.when(tries >= v.MAX_ATTEMPTS, "failed").otherwise("pending")).otherwise("done"))
        attempts = F.when(healed, 0).when(e["outcome"] == "error", tries).otherwise(acc["attempts"])
        return F.struct(status.alias("status"), attempts.cast("int").alias("attempts"),
                        (acc["heal_count"] + F.when(healed, 1).otherwise(0)).cast("int").alias("heal_count"))

    start = F.struct(F.lit("pending").alias("status"), F.lit(0).alias("attempts"), F.lit(0).alias("heal_count"))
    rows = F.array_sort(F.collect_list(F.struct("ts", "event_id", "outcome")))
    return outcomes.groupBy("id").agg(F.aggregate(rows, start, step).alias("s")).select("id", "s.*")


def retry_table(stream: DataFrame, history: DataFrame, late: float = 60.0, name: str = "retry") -> DataFrame:
    """Run ``retry_states`` over all that is there and give the state of every item. Items with late outcomes are folded anew from
    ``history``, the table behind the stream; only their rows are read for that. So the result is the same for any files in any order."""
    rows = drain_batches(retry_states(stream, late), name)
    order = F.col("batch")
    states = rows.filter("kind = 'state'").groupBy("id").agg(F.max_by(F.struct("status", "attempts", "heal_count"), order).alias("s")).select("id", "s.*")
    behind = rows.filter("kind = 'late'").select("id").distinct()
    again = fold_outcomes(history.select("id", "ts", "event_id", "outcome").join(behind, "id", "left_semi"))
    return states.join(behind, "id", "left_anti").unionByName(again)


def stuck_items(updates: DataFrame, at: str = "at", lease: int = v.LEASE_SECONDS, late: str = "1 minute") -> DataFrame:
    """One alert per item that stays in progress for ``lease`` seconds without an update; use append mode.

    Updates of an item that follow each other within the lease are one session; when the watermark has passed its end and the last
    update in (ts, event_id) order says in progress, the item is stuck since then. The sessions are Spark's own state: one row
    per open session, closed by event time, whatever batches the updates came in.
    updates: id, at (timestamp), ts (the same in seconds), event_id, status"""
    return (updates.withWatermark(at, late)
            .groupBy("id", F.session_window(F.col(at), f"{lease} seconds 1 microsecond"))
            .agg(F.max_by(F.struct("status", "ts"), F.struct("ts", "event_id")).alias("last"))
            .filter("last.status = 'in_progress'").select("id", F.col("last.ts").alias("since")))


def run_activity(events: DataFrame, span: str = "1 day", late: str = "1 minute", at: str = "at") -> DataFrame:
    """Last event of every approval of a run, within spans of event time: run_id, doc, span start, ts, action, n_events.

    Use update mode for what happens now, append mode for spans that are over. A span leaves the state when the watermark has passed it,
    so the state holds the approvals of the open spans only. ``idle_ages`` tells how long each has been still."""
    last = F.max_by(F.struct("ts", "action"), F.struct("ts", "event_id"))
    return (events.withWatermark(at, late).groupBy("run_id", "doc", F.window(F.col(at), span).alias("w"))
            .agg(last.alias("last"), F.count("*").alias("n_events"))
            .select("run_id", "doc", F.col("w.start").alias("span"), "last.ts", "last.action", "n_events"))


def idle_ages(activity: DataFrame) -> DataFrame:
    """activity with ``idle``: seconds since the approval's last event, at the time of its run's last one."""
    newest = activity.groupBy("run_id").agg(F.max("ts").alias("_newest"))
    return activity.join(newest, "run_id").withColumn("idle", F.col("_newest") - F.col("ts")).drop("_newest")


def epoch_timestamp(seconds: Column) -> Column:
    return F.timestamp_seconds(seconds)
