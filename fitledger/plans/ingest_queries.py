"""The whole ingest of a batch job's output: lines to outcomes, work items and states.

The lines are those of ``b_response_lines``; before them stand lines made of the labels that are blank, no JSON, without an
address, or about a document that nobody asked for.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vocab as v
from ..sources import inference as N
from ..streaming.streams import work_folder
from . import daily, ingest_run
from .registry import query
from .registry_queries import responses_sql

RUN_ID, NOW, LIMIT = "ingest-1", 1_750_000_000.0, 1.0


def all_lines(t) -> DataFrame:
    odd = t.labels.select((-F.col("doc_id") - 1).alias("seq"), F.expr(
        """CASE doc_id % 4 WHEN 0 THEN 'not json' WHEN 1 THEN ' ' WHEN 2 THEN '{"request":{"contents":[{"parts":[{"text":"read"}]}]},"response":null}'
           ELSE concat('{"request":{"contents":[{"parts":[{"fileData":{"fileUri":"store://x/z-', doc_id, '.pdf"}}]}]},"response":null}') END""").alias("line"))
    return t.b_response_lines.select("seq", "line").unionByName(odd)


_done: dict[tuple[str, str], tuple[daily.DailyTables, DataFrame, DataFrame]] = {}


def ingested(t) -> tuple[daily.DailyTables, DataFrame, DataFrame]:
    key = (t.spark.sparkContext.applicationId, t.sf_dir)
    if key not in _done:
        spark = t.spark
        tables = daily.DailyTables(spark, work_folder(spark, "ingest"), buckets=16)
        docs = t.customer.select(F.col("c_custkey").cast("long").alias("doc"), F.concat(F.lit("D-"), "c_custkey").alias("eo_number"), "c_nationkey")
        tables.create(approvals=docs.select("doc", "eo_number", F.lit("matching").alias("state")),
                      extractions=docs.filter("c_nationkey < 4").select("doc", F.lit(1).alias("version"), F.lit("{}").alias("payload"), F.lit(1.0).alias("created_at")))
        items = t.b_items.filter("stage <> 'review'").select("id", F.col("doc").cast("long").alias("doc"), F.concat(F.lit("D-"), "doc").alias("eo_number"), "attempts", "created_at")
        errors = docs.filter("doc % 10 = 3").select("doc", F.concat(F.lit("503 at "), "doc").alias("error"))
        empty = {"baseline": "doc bigint, part_numbers array<string>, fitment_count int", "verdicts": "doc bigint, verdict string, corrections string, reasons array<string>",
                 "decisions": "doc bigint, row_idx bigint, seq bigint, vehicle_ids array<bigint>, rationale string, confidence double", "invalid": "doc bigint"}
        outcomes, changes = ingest_run.ingest_batch(
            tables, N.read_lines(all_lines(t)), items, errors, LIMIT, RUN_ID, NOW, catalog=t.b_catalog, draw=(F.col("seq") * 7919 % 1000) / 1000,
            **{k: spark.createDataFrame([], s) for k, s in empty.items()})
        _done[key] = (tables, outcomes, changes)
    return _done[key]


LINES_SQL = f"""
  WITH n AS MATERIALIZED (SELECT * FROM b_items WHERE stage <> 'review' QUALIFY row_number() OVER (PARTITION BY doc ORDER BY created_at DESC, id DESC) = 1),
  l AS (SELECT r.seq, r.eo_number, r.doc, n.id AS item_id, n.attempts, r.usable, r.doc IN (SELECT c_custkey FROM customer WHERE c_nationkey < 4) AS known,
     CAST((tok_in * 0.75 + tok_out * 3.75) / 2e6 AS DECIMAL(18, 8)) AS usd FROM ({responses_sql()}) r LEFT JOIN n ON n.doc = r.doc),
  f AS (SELECT doc, min(seq) AS first FROM l WHERE usable AND NOT known AND item_id IS NOT NULL GROUP BY 1),
  c AS (SELECT l.*, coalesce(seq = first, false) AS stores, known OR coalesce(seq > first, false) AS skips,
     CASE WHEN seq = first THEN usd ELSE 0 END AS cost FROM l LEFT JOIN f ON f.doc = l.doc),
  w AS (SELECT *, sum(cost) OVER (ORDER BY seq ROWS UNBOUNDED PRECEDING) AS cum FROM c),
  o AS (SELECT *, CASE WHEN cum - cost > {LIMIT} THEN 'unread' WHEN item_id IS NULL THEN 'no_item' WHEN stores AND cum > {LIMIT} THEN 'tripped'
     WHEN skips THEN 'skipped' WHEN stores THEN 'stored' ELSE 'bounced' END AS split FROM w),
  x AS (SELECT b.seq, json_extract_string(b.payload, '$.category') AS category, CASE json_extract_string(b.payload, '$.confidence') WHEN 'true' THEN 1.0
      ELSE CAST(json_extract_string(b.payload, '$.confidence') AS DOUBLE) END AS confidence FROM b_response_lines b JOIN o ON o.seq = b.seq AND split = 'stored'),
  ingest AS MATERIALIZED (SELECT o.seq, o.eo_number, o.doc, o.item_id, CAST(o.usd AS DOUBLE) AS usd, coalesce(attempts, 0) + 1 AS tries, x.category, x.confidence,
     CASE WHEN split <> 'stored' THEN split WHEN doc % 10 = 3 THEN CASE WHEN coalesce(attempts, 0) + 1 >= {v.MAX_ATTEMPTS} THEN 'failed' ELSE 'retry' END
       WHEN x.category IS NOT NULL AND x.confidence >= 0.75 AND CAST(o.seq * 7919 % 1000 AS DOUBLE) / 1000 >= 0.05 THEN 'complete' ELSE 'needs_review' END AS outcome
   FROM o LEFT JOIN x ON x.seq = o.seq
   UNION ALL SELECT -doc_id - 1, CASE WHEN doc_id % 4 = 3 THEN concat('Z-', doc_id) END, NULL, NULL, 0.0, 1, NULL, NULL,
     CASE doc_id % 4 WHEN 1 THEN 'blank' WHEN 3 THEN 'no_item' ELSE 'unreadable' END FROM labels)"""


@query("ingest_run_lines", f"{LINES_SQL} SELECT seq, eo_number, item_id, usd, outcome FROM ingest")
def ingest_run_lines(t):
    return ingested(t)[1].select("seq", "eo_number", "item_id", F.col("usd").cast("double").alias("usd"), "outcome")


@query("ingest_run_tally", f"""{LINES_SQL}
  SELECT o.outcome, count(i.seq) AS n FROM (SELECT unnest({[*v.INGEST_OUTCOMES, *ingest_run.REJECTS]}) AS outcome) o LEFT JOIN ingest i ON i.outcome = o.outcome GROUP BY 1""")
def ingest_run_tally(t):
    return ingest_run.tally(ingested(t)[1])


@query("ingest_run_items", f"""{LINES_SQL}
  SELECT item_id AS id, CASE WHEN outcome IN ('complete', 'needs_review') THEN 'done' WHEN outcome = 'failed' THEN 'failed' ELSE 'pending' END AS status,
    CASE outcome WHEN 'complete' THEN 'complete' WHEN 'needs_review' THEN 'review' END AS stage, CASE WHEN outcome IN ('retry', 'failed') THEN tries END::INTEGER AS attempts,
    CASE WHEN outcome IN ('retry', 'failed') THEN concat('503 at ', doc) END AS last_error
  FROM ingest WHERE outcome IN ('complete', 'needs_review', 'bounced', 'tripped', 'retry', 'failed')
  QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY outcome <> 'bounced' DESC, seq DESC) = 1""")
def ingest_run_items(t):
    return ingested(t)[2]


@query("ingest_run_states", f"""{LINES_SQL}
  SELECT c_custkey::BIGINT AS doc, CASE i.outcome WHEN 'complete' THEN 'complete' WHEN 'needs_review' THEN 'needs_review' WHEN 'failed' THEN 'failed' ELSE 'matching' END AS state,
    (c_nationkey < 4 OR i.doc IS NOT NULL) AS extracted
  FROM customer LEFT JOIN (SELECT * FROM ingest WHERE outcome IN ('complete', 'needs_review', 'retry', 'failed')) i ON i.doc = c_custkey""")
def ingest_run_states(t):
    tables = ingested(t)[0]
    stored = tables.extractions.read().select("doc").distinct().withColumn("extracted", F.lit(True))
    return tables.approvals.read().select("doc", "state").join(stored, "doc", "left").fillna(False, ["extracted"])


@query("ingest_run_events", f"""{LINES_SQL}
  SELECT doc, 'batchfill' AS agent, 'extracted' AS action, confidence FROM ingest WHERE outcome IN ('complete', 'needs_review', 'retry', 'failed')
  UNION ALL SELECT doc, 'auditor', CASE outcome WHEN 'complete' THEN 'accepted' ELSE 'escalated' END, NULL FROM ingest WHERE outcome IN ('complete', 'needs_review')""")
def ingest_run_events(t):
    return ingested(t)[0].events().filter("action IN ('extracted', 'accepted', 'escalated')").select("doc", "agent", "action", "confidence")
