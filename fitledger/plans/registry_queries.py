"""Listing, ingest, registry and state queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ingest as I
from ..operators import ordered as O
from ..operators import registry as G
from ..operators import state as S
from ..sources import documents as D
from ..sources import inference as N
from ..sources import listing as P
from ..sources import reference_data as B
from .registry import query
from .text_queries import sql_failure, any_word
from ..functions import vocab as v

NOW = 880_000_000.0


def encoded_pages(t):
    """Customers as delta-compressed listing pages of at most 500 rows: every second key is a
    dictionary index, a repeated address sets mask bit 1, and each page carries foreign rows."""
    return t.sql(r"""
        SELECT page_no, concat('{"results":[{"result":{"data":{"dsr":{"DS":[{"ValueDicts":{"D0":[',
            array_join(transform(array_sort(collect_list(struct(pos, c_name))), x -> concat('"', x.c_name, '"')), ','),
            '],"D1":["BUILDING","AUTOMOBILE"]},"PH":[{"DM0":["not-a-row",',
            array_join(transform(array_sort(collect_list(struct(pos, cells))), x -> x.cells), ',5,'), ']}]}]}}}}]}') AS payload
        FROM (SELECT page_no, pos, c_name,
                concat('{"C":[', CASE WHEN pos % 2 = 0 THEN CAST(pos AS STRING) ELSE concat('"', c_name, '"') END,
                  CASE WHEN seg = prev THEN '],"R":2}' WHEN seg = 'BUILDING' THEN ',0]}' WHEN seg = 'AUTOMOBILE' THEN ',1],"R":0}'
                       ELSE concat(',"', seg, '"],"R":null}') END) AS cells
              FROM (SELECT CAST(floor(c_custkey / 400) AS INT) AS page_no, CAST(c_custkey % 400 AS INT) AS pos, c_name, c_mktsegment AS seg,
                      lag(c_mktsegment) OVER (PARTITION BY floor(c_custkey / 400) ORDER BY c_custkey) AS prev
                    FROM customer))
        GROUP BY page_no""")


@query("listing_decode", """
  SELECT CAST(floor(c_custkey / 400) AS INT) AS page_no, c_name AS eo_number, c_mktsegment AS pdf_url FROM customer""")
def listing_decode(t):
    return P.decode_pages(encoded_pages(t)).select("page_no", "eo_number", "pdf_url")


@query("listing_merge", """
  SELECT concat(c_mktsegment, '-', c_nationkey) AS eo_number, arg_max(c_name, c_custkey) AS pdf_url FROM customer GROUP BY 1""")
def listing_merge(t):
    rows = t.customer.select(F.floor(F.col("c_custkey") / 400).alias("page_no"), (F.col("c_custkey") % 400).alias("row_no"),
                             F.concat("c_mktsegment", F.lit("-"), "c_nationkey").alias("eo_number"), F.col("c_name").alias("pdf_url"))
    return P.merge_pages(rows)


@query("payload_vet", """
  SELECT page_id, starts_with(html, '<!DOCTYPE html><html lang="en"') AS vetted,
         CASE WHEN starts_with(html, '<!DOCTYPE html><html lang="en"') THEN sha256(html) END AS sha256 FROM pages""")
def payload_vet(t):
    return D.vet_payloads(t.pages.withColumnRenamed("html", "content"), magic='<!DOCTYPE html><html lang="en"').select(
        "page_id", "vetted", "sha256")


STORE_SQL = """SELECT doc, concat('store/', lang, CASE doc % 4 WHEN 0 THEN '/d-' WHEN 1 THEN '/D-' ELSE '/x/d-' END, doc,
   CASE doc % 5 WHEN 0 THEN '.PDF' WHEN 1 THEN '.log' ELSE '.pdf' END) AS path FROM b_records"""


@query("bootstrap_corpus", f"""
  WITH f AS (SELECT path, upper(CASE WHEN path LIKE '%.pdf' THEN left(n, length(n) - 4) ELSE n END) AS eo_number
    FROM (SELECT path, regexp_extract(path, '([^/]*)$', 1) AS n FROM ({STORE_SQL})) WHERE lower(path) LIKE '%.pdf')
  SELECT f.eo_number, f.path AS gcs_uri, concat('run1_', f.eo_number) AS item_id FROM f
  WHERE f.eo_number NOT IN (SELECT concat('D-', doc) FROM b_approvals WHERE state = 'complete')""")
def bootstrap_corpus(t):
    files = t.b_records.select(F.concat(
        F.lit("store/"), "lang", F.expr("CASE doc % 4 WHEN 0 THEN '/d-' WHEN 1 THEN '/D-' ELSE '/x/d-' END"), "doc",
        F.expr("CASE doc % 5 WHEN 0 THEN '.PDF' WHEN 1 THEN '.log' ELSE '.pdf' END")).alias("path"))
    known = t.b_approvals.select(F.concat(F.lit("D-"), "doc").alias("eo_number"), "state")
    return D.bootstrap_corpus(files, known, "run1").select("eo_number", "gcs_uri", "item_id")


WINNERS_SQL = """SELECT * FROM (SELECT p_partkey, concat('D-', p_size, '-', p_brand) AS eo_number, p_name, p_type, p_partkey % 150 AS m,
   row_number() OVER (PARTITION BY p_size, p_brand ORDER BY p_partkey DESC) AS rn FROM part) WHERE rn = 1"""


def baseline(t):
    parts = t.part.select(F.col("p_partkey").alias("part_id"), F.concat(F.lit("D-"), "p_size", F.lit("-"), "p_brand").alias("eo_number"),
                          F.col("p_name").alias("device_name"), F.col("p_type").alias("category"), (F.col("p_partkey") % 150).alias("manufacturer_id"))
    makers = t.supplier.select(F.col("s_suppkey").alias("manufacturer_id"), F.col("s_name").alias("manufacturer"))
    return B.import_baseline(parts, makers, t.lineitem.select(F.col("l_partkey").alias("part_id")))


@query("baseline_import", f"""
  SELECT eo_number, p_name AS device_name, s_name AS manufacturer, p_type AS category, coalesce(n, 0) AS fitment_count
  FROM ({WINNERS_SQL}) LEFT JOIN supplier ON s_suppkey = m
  LEFT JOIN (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_partkey = p_partkey""")
def baseline_import(t):
    return baseline(t).drop("part_id")


@query("baseline_numbers", f"""
  SELECT eo_number, concat(l_partkey, '-', l_suppkey) AS number FROM ({WINNERS_SQL}) JOIN lineitem ON l_partkey = p_partkey""")
def baseline_numbers(t):
    numbers = t.lineitem.select(F.col("l_partkey").alias("part_id"), F.concat("l_partkey", F.lit("-"), "l_suppkey").alias("number"))
    return B.baseline_numbers(baseline(t), numbers)


@query("catalog_import", """
  SELECT CAST(p_partkey AS VARCHAR) AS vehicle_id, 1970 + p_size AS year, p_brand AS make, p_name AS model, p_type AS trim, p_retailprice AS displacement_l,
    CASE p_type WHEN 'STANDARD' THEN 'NA' WHEN 'MEDIUM' THEN 'NA' WHEN 'PROMO' THEN 'TURBO' WHEN 'LARGE' THEN 'SC' END AS induction, p_size AS cylinders FROM part""")
def catalog_import(t):
    raw = t.part.select(F.col("p_partkey").alias("id"), (F.col("p_size") + 1970).alias("year"), F.col("p_brand").alias("make"),
                        F.col("p_name").alias("model"), F.col("p_type").alias("trim"), F.col("p_retailprice").alias("engine_displacement_l"),
                        F.expr("CASE p_type WHEN 'STANDARD' THEN 'na' WHEN 'MEDIUM' THEN 'carb' WHEN 'PROMO' THEN 'turbo' WHEN 'LARGE' THEN 'supercharged' WHEN 'SMALL' THEN 'diesel' ELSE 'other' END").alias("engine_induction"),
                        F.col("p_size").alias("engine_cylinders"))
    return B.import_catalog(raw)


ELIGIBLE_SQL = f"""SELECT id, doc, status, CASE WHEN status = 'failed' THEN 0 ELSE attempts END AS attempts FROM b_items
   WHERE NOT {any_word("coalesce(last_error, '')", v.TOKEN_CAP_MARKERS)} AND (status = 'pending' OR (status = 'failed' AND {sql_failure('last_error')} = 'transient'))"""


@query("batch_eligible", f"SELECT id, doc, 'pending' AS status, attempts FROM ({ELIGIBLE_SQL})")
def batch_eligible(t):
    return S.batch_eligible(t.b_items).select("id", "doc", "status", "attempts")


@query("request_lines", f"""
  SELECT i.id, concat('{{"request":{{"contents":[{{"role":"user","parts":[{{"text":"read it"}},{{"fileData":{{"fileUri":"store://d/', i.doc, '.pdf","mimeType":"application/pdf"}}}}]}}],',
    '"generationConfig":{{"temperature":0,"responseMimeType":"application/json","responseSchema":{{}},"maxOutputTokens":65535}}}}}}') AS line
  FROM ({ELIGIBLE_SQL}) i JOIN customer ON c_custkey = i.doc""")
def request_lines(t):
    uris = t.customer.select(F.col("c_custkey").alias("doc"), F.concat(F.lit("store://d/"), "c_custkey", F.lit(".pdf")).alias("gcs_uri"))
    items = S.batch_eligible(t.b_items).select("doc", "id")
    keyed = items.join(uris, "doc").select(F.col("id"), "gcs_uri")
    return N.request_lines(keyed.select("id"), keyed, "read it", key="id")


RESPONSES_SQL = """
  SELECT seq, concat('D-', doc) AS eo_number, CAST(doc AS BIGINT) AS doc, seq % 8 NOT IN (0, 1, 2, 4) AND f.faults = '' AS usable,
    CASE WHEN seq % 8 IN (0, 1) OR seq % 6 = 0 THEN 0 ELSE seq % 5000 END AS tok_in, CASE WHEN seq % 8 IN (0, 1) OR seq % 6 = 0 THEN 0 ELSE seq % 700 END AS tok_out,
    CASE WHEN seq % 8 NOT IN (0, 1, 2, 4) AND f.faults = '' THEN json_extract_string(payload, '$.category') END AS category
  FROM (SELECT seq, doc, CASE WHEN json_valid(payload) THEN payload END AS payload FROM b_response_lines) JOIN ({faults}) f ON f.id = seq"""


def responses_sql():
    from .quality_queries import FAULTS_SQL
    return RESPONSES_SQL.replace("{faults}", FAULTS_SQL)


@query("response_ingest", f"SELECT seq, eo_number, usable, tok_in, tok_out, category FROM ({responses_sql()})")
def response_ingest(t):
    return N.read_responses(t.b_response_lines.select("seq", "line")).select(
        "seq", "eo_number", "usable", "tok_in", "tok_out", "record.category")


def ingest_inputs(t):
    lines = N.read_responses(t.b_response_lines.select("seq", "line"))
    items = t.b_items.filter("stage <> 'review'").withColumn("eo_number", F.concat(F.lit("D-"), "doc"))
    stored = t.customer.filter(F.col("c_nationkey") < 4).select(F.concat(F.lit("D-"), "c_custkey").alias("eo_number"))
    return lines, items, stored


@query("ingest_pending", f"""
  SELECT seq, eo_number FROM ({responses_sql()}) WHERE doc NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey < 4)""")
def ingest_pending(t):
    lines, _, stored = ingest_inputs(t)
    return I.pending_ingest(lines, stored).select("seq", "eo_number")


SPLIT_SQL = f"""
  WITH n AS (SELECT doc, arg_max(id, (created_at, id)) AS item_id FROM b_items WHERE stage <> 'review' GROUP BY 1),
  l AS (SELECT r.*, n.item_id, r.doc IN (SELECT c_custkey FROM customer WHERE c_nationkey < 4) AS known,
     CAST((tok_in * 0.75 + tok_out * 3.75) / 2e6 AS DECIMAL(18, 8)) AS usd FROM ({responses_sql()}) r JOIN n ON n.doc = r.doc),
  f AS (SELECT doc, min(seq) AS first FROM l WHERE usable AND NOT known GROUP BY 1),
  c AS (SELECT l.*, coalesce(seq = first, false) AS stores, known OR coalesce(seq > first, false) AS skips,
     CASE WHEN seq = first THEN usd ELSE 0 END AS cost FROM l LEFT JOIN f ON f.doc = l.doc),
  w AS (SELECT *, sum(cost) OVER (ORDER BY seq ROWS UNBOUNDED PRECEDING) AS cum FROM c)
  SELECT seq, eo_number, item_id, CAST(usd AS DOUBLE) AS usd, CASE WHEN cum - cost > 0.5 THEN 'unread' WHEN stores AND cum > 0.5 THEN 'tripped'
     WHEN skips THEN 'skipped' WHEN stores THEN 'stored' ELSE 'bounced' END AS outcome FROM w"""


@query("ingest_split", SPLIT_SQL)
def ingest_split(t):
    lines, items, stored = ingest_inputs(t)
    out = I.ingest_split(lines, items, stored, 0.5)
    return out.select("seq", "eo_number", "item_id", F.col("usd").cast("double").alias("usd"), "outcome")


@query("discover_new", """
  SELECT d.doc_id, concat('https://docs.example.org/eo/d-', d.doc_id, '.pdf') AS pdf_url FROM documents d
  WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)""")
def discover_new(t):
    listing = t.documents.select("doc_id", F.lit(None).cast("string").alias("pdf_url"))
    new = G.discover_new(listing, t.labels, "doc_id")
    url = P.fallback_url(F.concat(F.lit("D-"), F.col("doc_id")), "https://docs.example.org/eo")
    return new.select("doc_id", F.coalesce("pdf_url", url).alias("pdf_url"))


def superseding(t):
    """Orders that name the two orders before them, when audited."""
    a = t.b_approvals
    return a.filter("state = 'complete'").select(
        "doc", F.col("first_seen").alias("audited_at"), F.array(F.col("doc") - 1, F.col("doc") - 3).alias("supersedes"))


@query("supersede_mark", """
  WITH h AS (SELECT old AS doc, arg_max(doc, (first_seen, doc)) AS heir FROM (
     SELECT doc, first_seen, unnest([doc - 1, doc - 3]) AS old FROM b_approvals WHERE state = 'complete') GROUP BY 1)
  SELECT a.doc, CASE WHEN heir IS NOT NULL THEN 'superseded' ELSE state END AS state, heir AS superseded_by
  FROM b_approvals a LEFT JOIN h ON h.doc = a.doc""")
def supersede_mark(t):
    marked = G.mark_superseded(superseding(t), t.b_approvals.withColumn("superseded_by", F.lit(None)))
    return marked.select("doc", "state", "superseded_by")


@query("lineage", """
  WITH RECURSIVE walk AS (
    SELECT doc AS start, prev AS node, 1 AS depth, 'back' AS direction FROM b_edges WHERE prev IS NOT NULL AND doc IN (SELECT doc_id FROM documents)
    UNION SELECT prev, doc, 1, 'forward' FROM b_edges WHERE prev IN (SELECT doc_id FROM documents)
    UNION SELECT w.start, CASE w.direction WHEN 'back' THEN e.prev ELSE e.doc END, w.depth + 1, w.direction
      FROM walk w JOIN b_edges e ON (w.direction = 'back' AND e.doc = w.node AND e.prev IS NOT NULL) OR (w.direction = 'forward' AND e.prev = w.node)
      WHERE w.depth < 5 AND w.node <> w.start),
  near AS (SELECT start, node, direction, min(depth) AS depth FROM walk WHERE node <> start GROUP BY 1, 2, 3)
  SELECT w.start, w.node, w.depth, w.direction, l.doc_id IS NOT NULL AS exists, max(w.depth) OVER (PARTITION BY w.start, w.direction) = 5 AS capped
  FROM near w LEFT JOIN labels l ON l.doc_id = w.node""")
def lineage(t):
    edges = t.b_edges.filter("prev IS NOT NULL").select(F.inline(F.array(
        F.struct(F.lit("back").alias("direction"), F.col("doc").alias("src"), F.col("prev").alias("dst")),
        F.struct(F.lit("forward").alias("direction"), F.col("prev").alias("src"), F.col("doc").alias("dst")))))
    known = t.labels.select(F.col("doc_id").alias("doc"), F.lit("complete").alias("state"))
    starts = t.documents.select(F.col("doc_id").alias("doc"))
    return G.lineage(starts, edges, known).select("start", "node", "depth", "direction", "exists", "capped")


@query("repair_missing_url", """
  SELECT a.doc, coalesce(a.pdf_url, CASE WHEN d.doc_id IS NOT NULL THEN concat('https://new.example.org/', d.doc_id) END) AS pdf_url
  FROM b_approvals a LEFT JOIN documents d ON d.doc_id = a.doc""")
def repair_missing_url(t):
    listing = t.documents.select(F.col("doc_id").alias("doc"), F.concat(F.lit("https://new.example.org/"), "doc_id").alias("pdf_url"))
    return G.repair_missing_url(t.b_approvals, listing, "doc").select("doc", "pdf_url")


@query("repair_status", "SELECT doc, CASE WHEN eo_status = 'superseded' THEN 'superseded' ELSE state END AS state FROM b_approvals")
def repair_status(t):
    return G.repair_status(t.b_approvals).select("doc", "state")


@query("approval_detail", """
  WITH it AS (SELECT * FROM b_items QUALIFY row_number() OVER (PARTITION BY doc ORDER BY created_at DESC, id DESC) = 1)
  SELECT a.doc, a.state, CASE WHEN starts_with(a.pdf_url, 'https://') THEN a.pdf_url END AS link, a.manufacturer, a.device_name,
    coalesce(a.category, r.category) AS category, a.confidence, CAST(len(b.lines) AS INT) AS baseline_rows, it.status AS item_status,
    CASE WHEN it.doc IS NOT NULL THEN coalesce(it.last_error, '') END AS last_error, it.attempts, it.stage
  FROM b_approvals a LEFT JOIN b_records r ON r.doc = a.doc LEFT JOIN b_records b ON b.doc + 1 = a.doc LEFT JOIN it ON it.doc = a.doc""")
def approval_detail(t):
    base = t.b_records.select((F.col("doc") + 1).alias("doc"), F.size("fitment").alias("fitment_count"))
    items = S.latest_per_key(t.b_items, "doc", ["created_at", "id"])
    return G.approval_detail(t.b_approvals, t.b_records, base, items)


@query("claimable_items", f"SELECT id, status FROM b_items WHERE status = 'pending' OR (status = 'in_progress' AND lease_expires < {NOW})")
def claimable_items(t):
    return t.b_items.filter(S.is_claimable(F.col("status"), F.col("lease_expires"), F.lit(NOW))).select("id", "status")


@query("backlog_head", f"""
  WITH c AS (SELECT id, stage, created_at FROM b_items WHERE status = 'pending' OR (status = 'in_progress' AND lease_expires < {NOW}))
  SELECT * FROM (SELECT 'all' AS kind, id, stage FROM c ORDER BY created_at, id LIMIT 100)
  UNION ALL SELECT 'stage', id, stage FROM c QUALIFY row_number() OVER (PARTITION BY stage ORDER BY created_at, id) <= 20""")
def backlog_head(t):
    top = S.backlog_head(t.b_items, F.lit(NOW), 100).select(F.lit("all").alias("kind"), "id", "stage")
    return top.unionByName(S.backlog_head_by_stage(t.b_items, F.lit(NOW), 20).select(F.lit("stage").alias("kind"), "id", "stage"))


@query("attempt_update", """
  SELECT id, CASE WHEN o IN (0, 1) THEN 'done' WHEN o = 2 THEN 'pending' WHEN o = 3 THEN CASE WHEN attempts + 1 >= 3 THEN 'failed' ELSE 'pending' END ELSE status END AS status,
    CASE o WHEN 0 THEN 'complete' WHEN 1 THEN 'review' ELSE stage END AS stage, CASE WHEN o = 3 THEN attempts + 1 ELSE attempts END AS attempts,
    CASE WHEN o = 3 THEN repeat(concat('boom ', id, ' '), 90) ELSE last_error END AS last_error
  FROM (SELECT *, CASE WHEN status = 'done' THEN 9 ELSE least(id % 5, 3) END AS o FROM b_items)""")
def attempt_update(t):
    outcomes = t.b_items.filter("status <> 'done'").select(
        "id", F.expr("CASE id % 5 WHEN 0 THEN 'complete' WHEN 1 THEN 'needs_review' WHEN 2 THEN 'budget' ELSE 'error' END").alias("outcome"),
        F.expr("repeat(concat('boom ', id, ' '), 90)").alias("error"))
    return S.attempt_update(t.b_items, outcomes).select("id", "status", "stage", "attempts", "last_error")


def heal_sql(kind: str, cap: int, also: str = "true") -> str:
    return f"""
  WITH f AS (SELECT * FROM b_items WHERE status = 'failed' AND {sql_failure('last_error')} = '{kind}'),
  q AS (SELECT * FROM f WHERE heal_count < 3 AND {also} ORDER BY created_at, id LIMIT {cap}),
  z AS (SELECT max((created_at, id)) AS last, count(*) AS n FROM q)
  SELECT id, 'requeue' AS action, heal_count + 1 AS heal_count, 'pending' AS status, 0 AS attempts, '' AS last_error FROM q
  UNION ALL SELECT f.id, 'heal_limit_reached', heal_count + 1, status, attempts, last_error FROM f, z WHERE heal_count = 3 AND (n < {cap} OR (created_at, id) < last)"""


@query("heal_requeue", f"SELECT id, action FROM ({heal_sql('transient', 25)})")
def heal_requeue(t):
    return S.heal_plan(t.b_items, "transient", v.TRANSIENT_CAP).select("id", "action")


@query("refetch_requeue", f"SELECT id, action FROM ({heal_sql('corrupt_source', 10, 'attempts > 0')})")
def refetch_requeue(t):
    has_url = F.col("attempts") > 0
    return S.heal_plan(t.b_items, "corrupt_source", v.CORRUPT_CAP, has_url).select("id", "action")


@query("heal_updates", heal_sql("transient", 1000))
def heal_updates(t):
    return S.heal_updates(S.heal_plan(t.b_items, "transient", 1000)).select(
        "id", "action", "heal_count", "status", "attempts", "last_error")


@query("requeue_reviews", """
  WITH h AS (SELECT * FROM b_reviews WHERE status = 'open' AND reason IN ('validation_failure', 'legacy_divergence'))
  SELECT 'review' AS kind, CAST(id AS VARCHAR) AS id, 'superseded_by_reprocess' AS status FROM h
  UNION ALL SELECT DISTINCT 'approval', CAST(doc AS VARCHAR), 'discovered' FROM h
  UNION ALL SELECT DISTINCT 'item', concat('again_', doc), 'pending' FROM h""")
def requeue_reviews(t):
    closed, reset, items = S.requeue_reviews(t.b_reviews, ["validation_failure", "legacy_divergence"], "again", F.lit(NOW))
    return (closed.select(F.lit("review").alias("kind"), F.col("id").cast("string").alias("id"), "status")
            .unionByName(reset.select(F.lit("approval").alias("kind"), F.col("doc").cast("string").alias("id"), F.col("state").alias("status")))
            .unionByName(items.select(F.lit("item").alias("kind"), "id", "status")))


@query("resolve_reviews", """
  SELECT d.doc_id AS id, CASE WHEN r.id IS NULL THEN 'not_found' WHEN r.status <> 'open' THEN 'conflict' WHEN d.doc_id % 3 = 0 THEN 'rejected'
     WHEN quality = 0 THEN 'invalid' ELSE 'approved' END AS result
  FROM labels d LEFT JOIN b_reviews r ON r.id = d.doc_id""")
def resolve_reviews(t):
    decisions = t.labels.select(F.col("doc_id").alias("id"), F.expr("if(doc_id % 3 = 0, 'reject', 'approve')").alias("action"),
                                (F.col("quality") > 0).alias("valid"))
    return S.review_outcomes(decisions, t.b_reviews, ["id"]).select("id", "result")


@query("manual_retry", """
  WITH it AS (SELECT * FROM b_items QUALIFY row_number() OVER (PARTITION BY doc ORDER BY created_at DESC, id DESC) = 1)
  SELECT c_custkey AS doc, CASE WHEN it.doc IS NULL THEN 'no work item' WHEN status = 'failed' THEN 'requeued' ELSE concat('not failed (status=', status, ')') END AS result
  FROM customer LEFT JOIN it ON it.doc = c_custkey""")
def manual_retry(t):
    return S.manual_retry(t.customer.select(F.col("c_custkey").alias("doc")), t.b_items).select("doc", "result")


@query("merge_upsert", """
  SELECT coalesce(a.doc, d.doc_id) AS doc, CASE WHEN d.doc_id % 2 = 0 THEN d.lang ELSE a.state END AS state,
     CASE WHEN d.doc_id % 3 = 0 THEN NULL ELSE a.category END AS category
  FROM (SELECT doc, state, category FROM b_approvals WHERE category IS NOT NULL) a FULL JOIN documents d ON d.doc_id = a.doc""")
def merge_upsert(t):
    current = t.b_approvals.filter("category IS NOT NULL").select("doc", "state", "category")
    changes = t.documents.select(F.col("doc_id").alias("doc"), F.col("lang").alias("state"), (F.col("doc_id") % 2 == 0).alias("has_state"),
                                 F.lit(None).cast("string").alias("category"), (F.col("doc_id") % 3 == 0).alias("has_category"))
    return S.merge_upsert(current, changes)


@query("replace_matches", """
  SELECT doc, vehicle_id, tier FROM b_matches WHERE doc NOT IN (SELECT doc_id FROM documents)
  UNION ALL SELECT doc_id, n_chars, 'exact' FROM documents WHERE lang = 'en'""")
def replace_matches(t):
    new = t.documents.filter("lang = 'en'").select(F.col("doc_id").alias("doc"), F.col("n_chars").alias("vehicle_id"), F.lit("exact").alias("tier"))
    return S.replace_by_key(t.b_matches.select("doc", "vehicle_id", "tier"), t.documents.select(F.col("doc_id").alias("doc")), new)


@query("extraction_versions", "SELECT id, doc, row_number() OVER (PARTITION BY doc ORDER BY created_at, id) AS version FROM b_items")
def extraction_versions(t):
    return S.number_versions(t.b_items).select("id", "doc", "version")


@query("latest_extraction", """
  SELECT doc, id, status, created_at FROM b_items QUALIFY row_number() OVER (PARTITION BY doc ORDER BY created_at DESC, id DESC) = 1""")
def latest_extraction(t):
    return S.latest_per_key(t.b_items, "doc", ["created_at", "id"]).select("doc", "id", "status", "created_at")


@query("budget_prefix", """
  SELECT id, run_id, CAST(spent AS DOUBLE) AS spent FROM (SELECT id, run_id, sum(CAST(floor(cost_usd * 1000) AS BIGINT)) OVER (PARTITION BY run_id ORDER BY created_at, id
     ROWS UNBOUNDED PRECEDING) AS spent FROM b_items) WHERE spent <= 200000""")
def budget_prefix(t):
    items = t.b_items.withColumn("cost", F.floor(F.col("cost_usd") * 1000))
    return O.budget_prefix(items, ["run_id"], ["created_at", "id"], "cost", 200_000).select(
        "id", "run_id", F.col("spent").cast("double").alias("spent"))


def with_predecessors(t):
    """Approvals that may name others as predecessors, and who superseded them."""
    return t.b_approvals.select(
        "doc", "state", "first_seen", F.expr("CASE WHEN doc % 3 = 0 THEN array(doc - 4, doc - 2) ELSE array(-1L) END").alias("supersedes"),
        F.expr("CASE WHEN state = 'superseded' THEN doc + 2 END").alias("superseded_by"))


@query("constrained_topk", """
  WITH e AS (SELECT doc, first_seen, doc % 401 = 0 AS star FROM b_approvals WHERE state IN ('complete', 'superseded') AND pdf_url IS NOT NULL),
  w AS (SELECT * FROM e ORDER BY first_seen DESC, doc LIMIT 25), s AS (SELECT * FROM e WHERE star ORDER BY first_seen DESC, doc LIMIT 1)
  SELECT * FROM w WHERE (SELECT bool_or(star) FROM w) AND EXISTS (SELECT 1 FROM s)
  UNION ALL SELECT * FROM (SELECT * FROM w ORDER BY first_seen DESC, doc LIMIT 24) WHERE NOT (SELECT bool_or(star) FROM w) AND EXISTS (SELECT 1 FROM s)
  UNION ALL SELECT * FROM s WHERE NOT (SELECT bool_or(star) FROM w)""")
def constrained_topk(t):
    a = t.b_approvals.select("doc", "state", "first_seen", F.expr("CASE WHEN doc % 401 = 0 THEN array(doc) ELSE array(-1L) END").alias("supersedes"))
    return S.constrained_topk(a, t.b_approvals.filter("pdf_url IS NOT NULL"), 25)


def state_tables(t):
    return {"approvals": with_predecessors(t), "matches": t.b_matches.select("doc", "vehicle_id", "tier"),
            "work_items": t.b_items.select("doc", "id", "status"), "reviews": t.b_reviews.select("doc", "id", "reason")}


PRED_SQL = """SELECT DISTINCT coalesce(b.doc, c.doc) AS doc FROM b_approvals a LEFT JOIN b_approvals b ON b.doc = a.doc - 4 LEFT JOIN b_approvals c ON c.doc = a.doc - 2
   WHERE a.doc % 3 = 0 AND a.doc IN (SELECT doc_id FROM labels) AND coalesce(b.doc, c.doc) NOT IN (SELECT doc_id FROM labels)"""


@query("holdback_snapshot", f"""
  SELECT 'approvals' AS part, doc, count(*) AS n FROM b_approvals WHERE doc IN (SELECT doc_id FROM labels) GROUP BY 2
  UNION ALL SELECT 'matches', doc, count(*) FROM b_matches WHERE doc IN (SELECT doc_id FROM labels) GROUP BY 2
  UNION ALL SELECT 'work_items', doc, count(*) FROM b_items WHERE doc IN (SELECT doc_id FROM labels) GROUP BY 2
  UNION ALL SELECT 'reviews', doc, count(*) FROM b_reviews WHERE doc IN (SELECT doc_id FROM labels) GROUP BY 2
  UNION ALL SELECT 'predecessors', doc, 1 FROM ({PRED_SQL})""")
def holdback_snapshot(t):
    return S.snapshot_summary(S.take_snapshot(state_tables(t), t.labels.select(F.col("doc_id").alias("doc")))).select("part", "doc", "n")


@query("holdback_roundtrip", f"""
  SELECT 'staged' AS phase, doc, CASE WHEN doc IN ({PRED_SQL}) THEN 'complete' ELSE state END AS state,
    CASE WHEN state = 'superseded' AND doc NOT IN ({PRED_SQL}) THEN doc + 2 END AS superseded_by FROM b_approvals WHERE doc NOT IN (SELECT doc_id FROM labels)
  UNION ALL SELECT 'restored', doc, state, CASE WHEN state = 'superseded' THEN doc + 2 END FROM b_approvals""")
def holdback_roundtrip(t):
    staged = t.labels.select(F.col("doc_id").alias("doc"))
    tables = state_tables(t)
    snap = S.take_snapshot(tables, staged)
    out = S.stage_out(tables, snap, staged)
    back = S.restore(out, snap)
    cols = ["doc", "state", "superseded_by"]
    return out["approvals"].select(F.lit("staged").alias("phase"), *cols).unionByName(
        back["approvals"].select(F.lit("restored").alias("phase"), *cols))
