"""Report, search and facet queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vocab as v
from ..operators import reports as P
from ..operators import search as H
from ..operators import state as S
from ..sources.part_index import PartIndex
from ..streaming.streams import work_folder
from . import registry_queries as RQ
from .registry import query


def cents(t):
    """Runs with their cost as whole ten-thousandths, so that sums are exact."""
    return t.b_runs.withColumn("cost_usd", F.round(F.col("cost_usd") * 10000).cast("long"))


def matches(t):
    return t.b_matches.withColumn("part_numbers", F.array("pn1", "pn2"))


@query("state_counts", f"""
  WITH s AS (SELECT unnest({v.STATES}) AS state), c AS (SELECT s.state, count(a.doc) AS n FROM s LEFT JOIN b_approvals a ON a.state = s.state GROUP BY 1)
  SELECT state, n, CAST(sum(n) OVER () AS BIGINT) AS total FROM c""")
def state_counts(t):
    return P.state_counts(t.b_approvals)


@query("all_states", "SELECT coalesce(state, 'unknown') AS state, count(*) AS n FROM b_approvals GROUP BY 1")
def all_states(t):
    return P.all_states(t.b_approvals)


@query("spend_total", """SELECT CAST(coalesce(sum(CAST(round(cost_usd * 10000) AS BIGINT)), 0) AS BIGINT) AS spend FROM b_runs
   WHERE trigger_kind = 'scheduled' OR starts_with(trigger_kind, 'backfill')""")
def spend_total(t):
    return P.total_spend(cents(t))


@query("plain_counts", """SELECT (SELECT count(*) FROM b_items) AS extractions, (SELECT count(*) FROM b_reviews WHERE status = 'open') AS open_reviews""")
def plain_counts(t):
    n = t.b_items.select(F.count("*")).scalar()
    return t.b_reviews.filter("status = 'open'").agg(F.count("*").alias("open_reviews")).withColumn("extractions", n)


@query("cost_per_document", """
  SELECT spend, n AS extractions, round(spend / n * 100, 6) AS cents FROM (SELECT CAST(sum(CAST(round(cost_usd * 10000) AS BIGINT)) AS BIGINT) AS spend FROM b_runs
   WHERE trigger_kind = 'scheduled' OR starts_with(trigger_kind, 'backfill')), (SELECT count(*) AS n FROM b_items)""")
def cost_per_document(t):
    return P.cost_per_document(cents(t), t.b_items).withColumn("cents", F.round("cents", 6))


RUN_SQL = """SELECT run_id, CAST(sum(CAST(round(cost_usd * 1e6) AS BIGINT)) AS BIGINT) AS cost_usd, CAST(sum(tok_in) AS BIGINT) AS tok_in, CAST(sum(tok_out) AS BIGINT) AS tok_out,
    count(*) FILTER (action = 'discovered') AS new_eos, count(*) FILTER (action = 'matched') AS completed, count(*) FILTER (action = 'escalated') AS needs_review
  FROM b_events GROUP BY 1"""
RUN_COUNTERS = {"new_eos": "discovered", "completed": "matched", "needs_review": "escalated"}


def micro_events(df):
    return df.withColumn("cost_usd", F.round(F.col("cost_usd") * 1e6).cast("long"))


@query("run_summary", RUN_SQL)
def run_summary(t):
    return P.run_summary(micro_events(t.b_events), RUN_COUNTERS)


@query("ingest_outcomes", f"""
  SELECT o.outcome, count(s.seq) AS n FROM (SELECT unnest(['stored', 'bounced', 'skipped', 'tripped', 'unread', 'failed']) AS outcome) o
  LEFT JOIN ({RQ.SPLIT_SQL}) s ON s.outcome = o.outcome GROUP BY 1""")
def ingest_outcomes(t):
    return P.zero_filled(RQ.ingest_split(t), "outcome", ["stored", "bounced", "skipped", "tripped", "unread", "failed"])


@query("cost_projection", """
  SELECT round(avg_in, 6) AS avg_in, round(avg_out, 6) AS avg_out, round(6055 * (avg_in * 0.75 + avg_out * 3.75) / 1e6, 6) AS projected_usd
  FROM (SELECT CAST(sum(tok_in) AS DOUBLE) / count(*) AS avg_in, CAST(sum(tok_out) AS DOUBLE) / count(*) AS avg_out FROM b_events)""")
def cost_projection(t):
    return P.cost_projection(t.b_events).select(*[F.round(c, 6).alias(c) for c in ("avg_in", "avg_out", "projected_usd")])


@query("event_timeline", """
  SELECT event_id, run_id, coalesce(CAST(doc AS VARCHAR), '(unknown)') AS doc,
    round(ts - max(ts) OVER (PARTITION BY run_id, doc ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 5) AS elapsed FROM b_events""")
def event_timeline(t):
    events = P.with_unknown(t.b_events)
    out = P.event_timeline(events, ["run_id", "doc"], ["event_id"])
    return out.select("event_id", "run_id", "doc", F.round("elapsed", 5).alias("elapsed"))


@query("latest_feed", """
  SELECT event_id, run_id, action FROM b_events WHERE ts IS NOT NULL AND run_id = (SELECT run_id FROM b_events GROUP BY 1 ORDER BY min(ts) DESC, run_id LIMIT 1)
  ORDER BY ts DESC, event_id DESC LIMIT 50""")
def latest_feed(t):
    runs = t.b_events.groupBy("run_id").agg(F.min("ts").alias("started_at"))
    return P.latest_feed(runs, t.b_events).select("event_id", "run_id", "action")


@query("recent_runs", "SELECT id, trigger_kind, started_at FROM b_runs ORDER BY started_at DESC, id LIMIT 20")
def recent_runs(t):
    return P.recent_runs(t.b_runs, 20).select("id", "trigger_kind", "started_at")


@query("run_events", """
  SELECT run_id, event_id, CAST(place AS INT) AS place, n > 100 AS truncated FROM (SELECT run_id, event_id, row_number() OVER (PARTITION BY run_id ORDER BY ts, event_id) AS place,
    count(*) OVER (PARTITION BY run_id) AS n FROM b_events WHERE ts IS NOT NULL) WHERE place <= 100""")
def run_events(t):
    return P.run_events(t.b_events, 100).select("run_id", "event_id", "place", "truncated")


@query("facets", """
  SELECT DISTINCT 'make' AS kind, CAST(NULL AS VARCHAR) AS parent, make AS value FROM b_catalog UNION SELECT 'year', NULL, CAST(year AS VARCHAR) FROM b_catalog
  UNION SELECT 'induction', NULL, induction FROM b_catalog WHERE induction IS NOT NULL UNION SELECT 'model', make, model FROM b_catalog""")
def facets(t):
    return H.facets(t.b_catalog)


@query("cascade", """
  WITH c AS (SELECT *, regexp_replace(CAST(displacement_l AS VARCHAR), '\\.0$', '') AS l FROM b_catalog)
  SELECT DISTINCT 0 AS level, year, CAST(NULL AS VARCHAR) AS make, CAST(NULL AS VARCHAR) AS model, CAST(NULL AS VARCHAR) AS trim, CAST(NULL AS BIGINT) AS vehicle_id, CAST(NULL AS VARCHAR) AS label FROM c
  UNION SELECT 1, year, make, NULL, NULL, NULL, NULL FROM c UNION SELECT 2, year, make, model, NULL, NULL, NULL FROM c UNION SELECT 3, year, make, model, trim, NULL, NULL FROM c
  UNION ALL SELECT 4, year, make, model, trim, vehicle_id, concat_ws(' ', CASE WHEN displacement_l <> 0 THEN l || 'L' END, cylinders || '-cyl',
    CASE induction WHEN 'NA' THEN 'N/A' WHEN 'TURBO' THEN 'Turbo' WHEN 'SC' THEN 'Supercharged' END) FROM c""")
def cascade(t):
    return H.cascade_rows(t.b_catalog).drop("litres", "induction", "cylinders")


@query("cascade_lists", """
  SELECT 1 AS level, CAST(year AS VARCHAR) AS parent, string_agg(DISTINCT make, '|' ORDER BY make) AS options FROM b_catalog GROUP BY year
  UNION ALL SELECT 2, concat(year, '/', make), string_agg(DISTINCT model, '|' ORDER BY model) FROM b_catalog GROUP BY year, make
  UNION ALL SELECT 3, concat(year, '/', make, '/', model), string_agg(DISTINCT trim, '|' ORDER BY trim) FROM b_catalog GROUP BY year, make, model
  UNION ALL SELECT 0, '', string_agg(DISTINCT CAST(year AS VARCHAR), '|' ORDER BY CAST(year AS VARCHAR)) FROM b_catalog
  UNION ALL SELECT 4, concat_ws('/', year, make, model, trim), string_agg(concat_ws('~', label, vehicle_id, displacement_l, coalesce(induction, '-'), cylinders), '|' ORDER BY label, vehicle_id)
  FROM (SELECT *, concat_ws(' ', CASE WHEN displacement_l <> 0 THEN regexp_replace(CAST(displacement_l AS VARCHAR), '\\.0$', '') || 'L' END, cylinders || '-cyl',
    CASE induction WHEN 'NA' THEN 'N/A' WHEN 'TURBO' THEN 'Turbo' WHEN 'SC' THEN 'Supercharged' END) AS label FROM b_catalog) GROUP BY year, make, model, trim""")
def cascade_lists(t):
    def text(o):
        facts = F.concat_ws("~", o["value"], o["vehicle_id"], o["litres"], F.coalesce(o["induction"], F.lit("-")), o["cylinders"])
        return F.when(o["vehicle_id"].isNull(), o["value"]).otherwise(facts)

    return H.cascade_lists(t.b_catalog).select(
        "level", F.array_join("parent", "/").alias("parent"), F.array_join(F.transform("options", text), "|").alias("options"))


@query("facet_filter", """
  SELECT * FROM (SELECT 'exact' AS kind, vehicle_id FROM b_catalog WHERE make = 'Brand#7' AND year = 1990)
  UNION ALL SELECT * FROM (SELECT 'range', vehicle_id FROM b_catalog WHERE induction = 'NA' AND year >= 1980 AND year <= 2000)""")
def facet_filter(t):
    exact = H.facet_filter(t.b_catalog, make="Brand#7", year=1990, year_min=2010)
    span = H.facet_filter(t.b_catalog, induction="NA", year_min=1980, year_max=2000)
    return exact.select(F.lit("exact").alias("kind"), "vehicle_id").unionByName(span.select(F.lit("range").alias("kind"), "vehicle_id"))


@query("prefix_search", "SELECT c_custkey, c_name FROM customer WHERE starts_with(c_name, 'Customer#00000012')")
def prefix_search(t):
    return H.prefix_search(t.customer.select("c_custkey", "c_name"), "c_name", "Customer#00000012")


@query("known_keys", "SELECT c_name FROM customer")
def known_keys(t):
    return t.customer.select("c_name")


@query("reviews_by_status", "SELECT id, doc, status FROM b_reviews WHERE status IN ('approved', 'rejected')")
def reviews_by_status(t):
    return t.b_reviews.filter(F.col("status").isin("approved", "rejected")).select("id", "doc", "status")


@query("keyset_page", """
  SELECT c_name, max(c_name) OVER () AS next_cursor FROM (SELECT c_name FROM customer WHERE c_mktsegment = 'BUILDING' AND starts_with(c_name, 'Customer#0000')
    AND c_name > 'Customer#000000100' ORDER BY c_name LIMIT 50)""")
def keyset_page(t):
    return H.keyset_page(t.customer.select("c_name", "c_mktsegment"), "c_name", "Customer#000000100", "Customer#0000",
                         {"c_mktsegment": "BUILDING"}).select("c_name", "next_cursor")


@query("review_page", """
  WITH o AS (SELECT id, created_at FROM b_reviews WHERE status = 'open'),
  c AS (SELECT max(created_at) AS at FROM b_reviews WHERE id = 1000)
  SELECT * FROM (SELECT 'next' AS page, id, false AS fell_back FROM o, c WHERE (o.created_at, o.id) > (c.at, 1000) ORDER BY created_at, id LIMIT 50)
  UNION ALL SELECT * FROM (SELECT 'stale', id, true FROM o ORDER BY created_at, id LIMIT 50)""")
def review_page(t):
    cols = ["id", "fell_back"]
    return (H.review_page(t.b_reviews, 1000).select(F.lit("next").alias("page"), *cols)
            .unionByName(H.review_page(t.b_reviews, -5).select(F.lit("stale").alias("page"), *cols)))


@query("resolved_reviews", """
  SELECT id, status FROM b_reviews WHERE status IN ('approved', 'rejected') ORDER BY coalesce(resolved_at, 0) DESC, id LIMIT 20""")
def resolved_reviews(t):
    return H.resolved_reviews(t.b_reviews).select("id", "status")


@query("part_number_search", "SELECT doc, vehicle_id, tier FROM b_matches WHERE pn1 = '7-K' OR pn2 = '7-K'")
def part_number_search(t):
    return H.part_number_rows(matches(t), "7-K").select("doc", "vehicle_id", "tier")


@query("part_search", """
  WITH g AS (SELECT doc, arg_min((manufacturer, device_name), (vehicle_id, device_name, manufacturer)) AS m FROM b_matches WHERE pn1 = '7-K' OR pn2 = '7-K' GROUP BY 1)
  SELECT doc, m[1] AS manufacturer, m[2] AS device_name, (SELECT count(*) FROM g) > 50 AS truncated,
    CASE WHEN (SELECT count(*) FROM g) > 50 THEN (SELECT max(doc) FROM (SELECT doc FROM g ORDER BY doc LIMIT 50)) END AS next_doc FROM g ORDER BY doc LIMIT 50""")
def part_search(t):
    return H.part_search(matches(t), "7-K")


_indexed: dict[tuple[str, str], PartIndex] = {}


def written_index(t) -> PartIndex:
    """The index of all matches on shared storage; one per session and folder."""
    key = (t.spark.sparkContext.applicationId, t.sf_dir)
    if key not in _indexed:
        index = PartIndex(t.spark, work_folder(t.spark, "parts"), buckets=16)
        index.build(matches(t))
        _indexed[key] = index
    return _indexed[key]


@query("part_lookup", """
  WITH g AS (SELECT n.number, doc, arg_min((manufacturer, device_name), (vehicle_id, device_name, manufacturer)) AS m, count(DISTINCT vehicle_id) AS n_vehicles,
      row_number() OVER (PARTITION BY n.number ORDER BY doc) AS p, count(*) OVER (PARTITION BY n.number) AS total
    FROM b_matches JOIN (SELECT unnest(['S1', '7-K']) AS number) n ON pn1 = n.number OR pn2 = n.number GROUP BY 1, 2),
  x AS (SELECT *, (p - 1) // 50 AS page, max(doc) OVER (PARTITION BY number, (p - 1) // 50) AS last FROM g WHERE p <= 100)
  SELECT number AS part_number, page::INTEGER AS page, doc, m[1] AS manufacturer, m[2] AS device_name, n_vehicles, CASE WHEN total > (page + 1) * 50 THEN last END AS next_after FROM x""")
def part_lookup(t):
    """Two pages of a number that stands on every approval, and of one that stands on some."""
    index, out = written_index(t), []
    for number in ("S1", "7-K"):
        after = None
        for page in range(2):
            rows = index.lookup(number, after, 50)
            out.append(rows.withColumn("page", F.lit(page)))
            cursor = rows.select("next_after").first()
            after = cursor.next_after if cursor else None
            if after is None:
                break
    return reduce(DataFrame.unionByName, out).select("part_number", "page", "doc", "manufacturer", "device_name", "n_vehicles", "next_after")


@query("run_event_pages", """
  SELECT run_id, event_id, CAST(1 + (p - 1) // 100 AS INT) AS page FROM (SELECT run_id, event_id, row_number() OVER (PARTITION BY run_id ORDER BY ts, event_id) AS p
    FROM b_events WHERE ts IS NOT NULL) WHERE p <= 200""")
def run_event_pages(t):
    """The first two pages of every run; the second begins behind the cursors of the first."""
    first = P.run_events(t.b_events, 100)
    more = P.next_cursors(first)
    second = P.run_events(t.b_events.join(more.select("run_id"), "run_id", "left_semi"), 100, more)
    return first.select("run_id", "event_id", F.lit(1).alias("page")).unionByName(second.select("run_id", "event_id", F.lit(2).alias("page")))


@query("part_index", """
  SELECT part_number, count(DISTINCT doc) AS n_approvals, count(DISTINCT vehicle_id) AS n_vehicles FROM (
    SELECT pn1 AS part_number, doc, vehicle_id FROM b_matches UNION ALL SELECT pn2, doc, vehicle_id FROM b_matches) GROUP BY 1""")
def part_index(t):
    return H.part_index_sizes(H.part_index(matches(t)))


@query("vehicle_parts", """
  SELECT doc, section, section_label, CAST(row_number() OVER (PARTITION BY section, section_label ORDER BY device_name, manufacturer, doc) AS INT) AS place FROM (
   SELECT *, CASE WHEN category IS NULL THEN 10 WHEN category = 'intake' THEN 1 WHEN category = 'boost' THEN 2 WHEN category = 'other' THEN 8 ELSE 9 END AS section,
     CASE WHEN category IS NULL THEN 'Uncategorized' ELSE upper(category[1:1]) || category[2:] END AS section_label FROM b_matches WHERE vehicle_id = 42)""")
def vehicle_parts(t):
    return H.vehicle_parts(matches(t), 42).select("doc", "section", "section_label", "place")


@query("vehicle_parts_active", """
  SELECT m.doc, m.device_name FROM b_matches m JOIN b_approvals a ON a.doc = m.doc WHERE m.vehicle_id = 42 AND m.category = 'boost' AND a.state IS DISTINCT FROM 'superseded'""")
def vehicle_parts_active(t):
    return H.vehicle_parts(matches(t), 42, "boost", t.b_approvals).select("doc", "device_name")


@query("newest_failures", """
  SELECT doc, coalesce(last_error, '') AS last_error, attempts, stage FROM b_items QUALIFY row_number() OVER (PARTITION BY doc ORDER BY created_at DESC, id DESC) = 1""")
def newest_failures(t):
    newest = S.latest_per_key(t.b_items.select("doc", "id", "created_at", "last_error", "attempts", "stage"), "doc", ["created_at", "id"])
    return newest.select("doc", F.coalesce("last_error", F.lit("")).alias("last_error"), "attempts", "stage")
