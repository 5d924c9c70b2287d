"""Record quality, routing, corrections and scoring queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import quality as Q
from ..operators import records as R
from ..operators import scoring as S
from ..sources import golden as G
from . import daily
from .registry import query

ISSUES_SQL = """
  SELECT r.doc, array_to_string(list_filter([
      CASE WHEN NOT regexp_matches(r.eo_number, '^[A-Z0-9]{1,3}(-[A-Z0-9]{1,6}){1,3}$') THEN 'bad_eo_number' END,
      CASE WHEN rows.bad_year THEN 'bad_year' END, CASE WHEN rows.bad_l THEN 'bad_displacement' END,
      CASE WHEN len(list_filter(r.part_numbers, lambda p: NOT (length(trim(p)) BETWEEN 2 AND 48)
             OR regexp_matches(trim(p), '[<>_{}]'))) > 0 THEN 'bad_part_number' END,
      CASE WHEN r.category IS NULL THEN 'no_category' END], lambda x: x IS NOT NULL), ',') AS issues
  FROM b_records r JOIN (
    SELECT doc, bool_or(year_start < 1900 OR year_start > 2035 OR year_end < 1900 OR year_end > 2035
             OR year_start > year_end) AS bad_year, bool_or(displacement_l < 0.04 OR displacement_l > 120) AS bad_l
    FROM b_record_rows GROUP BY doc) rows ON rows.doc = r.doc"""
DIVERGENCE_SQL = """
  SELECT doc, CASE WHEN base IS NULL THEN 0.0 ELSE
     round_even(((1 - CASE WHEN len(a) + len(b) = 0 THEN 1.0 ELSE shared / (len(a) + len(b) - shared) END)
      + (1 - CASE WHEN greatest(na, nb) = 0 THEN 1.0 ELSE CAST(least(na, nb) AS DOUBLE) / greatest(na, nb) END)) / 2, 3) END AS div
  FROM (SELECT r.doc, b.doc AS base, r.part_numbers AS a, coalesce(b.part_numbers, []) AS b, len(r.lines) AS na,
          coalesce(len(b.lines), 0) AS nb, CAST(len(list_intersect(r.part_numbers, b.part_numbers)) AS DOUBLE) AS shared
        FROM b_records r LEFT JOIN b_records b ON b.doc + 1 = r.doc)"""
ROUTE_SQL = f"""
  SELECT r.doc, i.issues, d.div, r.confidence, CASE WHEN i.issues <> '' THEN 'validation_failure'
     WHEN r.confidence < 0.75 THEN 'low_confidence' WHEN d.div > 0.4 THEN 'legacy_divergence'
     WHEN r.draw < 0.05 THEN 'qa_sample' END AS reason
  FROM b_records r JOIN ({ISSUES_SQL}) i ON i.doc = r.doc JOIN ({DIVERGENCE_SQL}) d ON d.doc = r.doc"""


def shifted(t):
    """The record of the document before, taken as the older answer for a document."""
    return t.b_records.withColumn("doc", F.col("doc") + 1)


def routed(t):
    base = shifted(t).select("doc", "part_numbers", F.size("fitment").alias("fitment_count"))
    return daily.route(t.b_records, base)


@query("gate_issues", ISSUES_SQL)
def gate_issues(t):
    issues = Q.gate_issues(F.col("eo_number"), F.col("fitment"), F.col("part_numbers"), F.col("category"))
    return t.b_records.select("doc", F.array_join(issues, ",").alias("issues"))


@query("baseline_divergence", f"SELECT doc, round(div, 6) AS div FROM ({DIVERGENCE_SQL})")
def baseline_divergence(t):
    return routed(t).select("doc", F.round("div", 6).alias("div"))


@query("route_records", f"SELECT doc, issues, reason FROM ({ROUTE_SQL})")
def route_records(t):
    return routed(t).select("doc", F.array_join("issues", ",").alias("issues"), "reason")


@query("dedupe_rows", """
  WITH keyed AS (SELECT doc, pos, model, row_number() OVER (PARTITION BY doc, year_start, year_end, make, model,
      displacement_l, induction, cylinders, list_sort(part_numbers) ORDER BY pos) AS rn FROM b_record_rows)
  SELECT doc, CAST(count(*) AS INT) AS n_before, CAST(count(*) FILTER (rn > 1) AS INT) AS removed,
         sha256(string_agg(model, '|' ORDER BY pos) FILTER (rn = 1)) AS kept_digest FROM keyed GROUP BY doc""")
def dedupe_rows(t):
    return Q.with_deduped_rows(t.b_records).select(
        "doc", (F.size("fitment") + F.col("removed")).alias("n_before"), "removed",
        F.sha2(F.array_join(F.transform("fitment", lambda r: r["model"]), "|"), 256).alias("kept_digest"))


@query("identity_fix", """
  SELECT doc, concat('D-', doc % 1000, '-', doc) AS eo_number,
         CASE WHEN eo_number <> concat('D-', doc % 1000, '-', doc) THEN eo_number END AS model_read FROM b_records""")
def identity_fix(t):
    keyed = t.b_records.select("doc", "eo_number").withColumn(
        "doc_key", F.concat(F.lit("D-"), F.col("doc") % 1000, F.lit("-"), F.col("doc")))
    return Q.fix_identity(keyed).select("doc", "eo_number", F.when(F.col("key_corrected"), F.col("key_read")).alias("model_read"))


FAULTS_SQL = """
  SELECT id, CASE WHEN payload IS NULL THEN 'not_json' WHEN json_type(payload) <> 'OBJECT' THEN 'not_object'
   ELSE array_to_string(list_filter([
    CASE WHEN coalesce(json_type(payload, '$.eo_number'), 'X') <> 'VARCHAR' THEN 'eo_number' END,
    CASE WHEN coalesce(json_type(payload, '$.manufacturer'), 'NULL') NOT IN ('NULL', 'VARCHAR') THEN 'manufacturer' END,
    CASE WHEN coalesce(json_type(payload, '$.category'), 'NULL') <> 'NULL' AND json_extract_string(payload, '$.category')
      NOT IN ('intake', 'boost', 'cat', 'engine', 'exhaust', 'ignition', 'tune', 'other') THEN 'category' END,
    CASE WHEN NOT coalesce(CASE json_extract_string(payload, '$.confidence') WHEN 'true' THEN 1.0 ELSE
      TRY_CAST(json_extract_string(payload, '$.confidence') AS DOUBLE) END BETWEEN 0 AND 1, false) THEN 'confidence' END,
    CASE WHEN json_type(payload, '$.part_numbers') IS NOT NULL AND (json_type(payload, '$.part_numbers') <> 'ARRAY'
      OR len(list_filter(json_type(payload, '$.part_numbers[*]'), lambda k: k <> 'VARCHAR')) > 0) THEN 'part_numbers' END,
    CASE WHEN json_type(payload, '$.fitment') IS NOT NULL AND (json_type(payload, '$.fitment') <> 'ARRAY'
      OR len(list_filter(json_extract_string(payload, '$.fitment[*].year_start'), lambda y: NOT regexp_matches(y, '^[0-9]+(\\.0*)?$'))) > 0
      OR len(list_filter(json_extract_string(payload, '$.fitment[*].induction'), lambda y: y NOT IN ('NA', 'TURBO', 'SC'))) > 0) THEN 'fitment' END
   ], lambda x: x IS NOT NULL), ',') END AS faults
  FROM (SELECT id, CASE WHEN json_valid(payload) THEN payload END AS payload FROM b_record_json)"""


@query("validate_records", f"SELECT id, faults, faults = '' AS valid FROM ({FAULTS_SQL})")
def validate_records(t):
    return R.validate_records(t.b_record_json).select("id", F.array_join("faults", ",").alias("faults"), "valid")


@query("apply_corrections", f"""
  WITH ok AS (SELECT j.id, CASE WHEN json_valid(j.payload) THEN j.payload END AS payload, c.corrections AS c FROM b_record_json j JOIN ({FAULTS_SQL}) f ON f.id = j.id AND f.faults = ''
    JOIN b_corrections c ON c.id = j.id)
  SELECT id, CASE WHEN json_type(c, '$.category') IS NOT NULL THEN json_extract_string(c, '$.category')
       ELSE json_extract_string(payload, '$.category') END AS category,
     coalesce(json_extract_string(c, '$.eo_number'), json_extract_string(payload, '$.eo_number')) AS eo_number,
     CASE coalesce(json_extract_string(c, '$.confidence'), json_extract_string(payload, '$.confidence')) WHEN 'true' THEN 1.0
       ELSE CAST(coalesce(json_extract_string(c, '$.confidence'), json_extract_string(payload, '$.confidence')) AS DOUBLE) END AS confidence,
     coalesce(array_to_string(coalesce(json_extract_string(c, '$.part_numbers[*]'), []) , ','), '') AS new_parts, true AS valid
  FROM ok""")
def apply_corrections(t):
    ok = R.validate_records(t.b_record_json).filter("valid").select("id", "value")
    fixed = R.apply_corrections(ok.join(t.b_corrections, "id"))
    rec = fixed.withColumn("r", R.typed_record("value"))
    return rec.select("id", "r.category", "r.eo_number", "r.confidence",
                      F.when(F.array_contains("r.part_numbers", "Z9"), F.array_join("r.part_numbers", ",")).otherwise("").alias("new_parts"), "valid")


@query("corrections_check", """
  SELECT id, CASE WHEN payload = '' THEN NULL WHEN NOT json_valid(payload) THEN 'Corrections must be valid JSON.'
    WHEN json_type(payload) <> 'OBJECT' THEN 'Corrections must be a JSON object of field: value pairs.' END AS error
  FROM b_record_json""")
def corrections_check(t):
    return t.b_record_json.select("id", R.corrections_error(F.col("payload")).alias("error"))


def as_struct(df, name):
    return df.select("doc", F.struct("manufacturer", "device_name", "category", "confidence", "part_numbers", "fitment",
                                     F.size("fitment").alias("fitment_count")).alias(name))


@query("change_set", """
  SELECT a.doc, array_to_string(list_filter([
      CASE WHEN a.category IS DISTINCT FROM b.category THEN 'category' END,
      CASE WHEN a.confidence IS DISTINCT FROM b.confidence THEN 'confidence' END,
      CASE WHEN a.device_name IS DISTINCT FROM b.device_name THEN 'device_name' END,
      CASE WHEN a.lines IS DISTINCT FROM b.lines OR a.lang <> b.lang THEN 'fitment' END,
      CASE WHEN a.manufacturer IS DISTINCT FROM b.manufacturer THEN 'manufacturer' END], lambda x: x IS NOT NULL), ',') AS changed
  FROM b_records a JOIN b_records b ON b.doc + 1 = a.doc""")
def change_set(t):
    j = as_struct(t.b_records, "new").join(as_struct(shifted(t), "old"), "doc")
    changes = R.change_set("old", "new", ["manufacturer", "device_name", "category", "confidence"])
    return j.select("doc", F.coalesce(F.array_join(F.array_sort(F.map_keys(changes)), ","), F.lit("")).alias("changed"))


@query("record_diff", """
  WITH p AS (SELECT a.doc, a.part_numbers AS x, coalesce(b.part_numbers, []) AS y, a.device_name IS DISTINCT FROM b.device_name AS device_name_changed,
      a.manufacturer IS DISTINCT FROM b.manufacturer AS manufacturer_changed, a.category IS DISTINCT FROM b.category AS category_changed,
      len(a.lines) AS new_rows, coalesce(len(b.lines), 0) AS base_rows
    FROM b_records a LEFT JOIN b_records b ON b.doc + 1 = a.doc),
  w AS (SELECT doc, coalesce(x.w, y.w) AS w, x.w IS NOT NULL AS inx, y.w IS NOT NULL AS iny FROM
     (SELECT doc, unnest(x) AS w FROM p) x FULL JOIN (SELECT doc, unnest(y) AS w FROM p) y USING (doc, w)),
  d AS (SELECT doc, sha256(coalesce(string_agg(w, '|' ORDER BY w) FILTER (NOT iny), '')) AS added, sha256(coalesce(string_agg(w, '|' ORDER BY w) FILTER (NOT inx), '')) AS removed,
     sha256(coalesce(string_agg(w, '|' ORDER BY w) FILTER (inx AND iny), '')) AS kept FROM w GROUP BY doc)
  SELECT p.doc, device_name_changed, manufacturer_changed, category_changed, CAST(new_rows AS INT) AS new_rows, CAST(base_rows AS INT) AS base_rows, CAST(new_rows AS INT) AS new_rows_with_parts, added, removed, kept
  FROM p JOIN d ON p.doc = d.doc""")
def record_diff(t):
    out = R.record_diff(t.b_records, shifted(t).withColumn("fitment_count", F.size("fitment")))
    return out.select("doc", "device_name_changed", "manufacturer_changed", "category_changed", "new_rows", "base_rows",
                      "new_rows_with_parts", *[F.sha2(F.array_join(c, "|"), 256).alias(c) for c in ("added", "removed", "kept")])


F1_SQL = "CASE WHEN len({a}) + len({b}) = 0 THEN 1.0 ELSE 2.0 * len(list_intersect({a}, {b})) / (len({a}) + len({b})) END"


@query("set_f1", f"""
  SELECT a.doc, round({F1_SQL.format(a='a.part_numbers', b='b.part_numbers')}, 6) AS f1
  FROM b_records a JOIN b_records b ON b.doc + 1 = a.doc""")
def set_f1(t):
    j = t.b_records.select("doc", "part_numbers").join(
        shifted(t).select("doc", F.col("part_numbers").alias("other")), "doc")
    return j.select("doc", F.round(S.set_f1(F.col("part_numbers"), F.col("other")), 6).alias("f1"))


KEYED_SQL = """SELECT doc, year_start, lower(model) AS model, list_distinct(arg_max(part_numbers, pos)) AS pns
    FROM b_record_rows GROUP BY 1, 2, 3"""
SCORE_SQL = f"""
  SELECT e.doc, e.source, CASE WHEN g.doc IS NULL THEN 0.0 ELSE ((e.eo_number = g.eo_number)::INT
      + (e.manufacturer IS NOT DISTINCT FROM g.manufacturer)::INT + (e.category IS NOT DISTINCT FROM g.category)::INT) / 3.0 END AS scalar,
    CASE WHEN g.doc IS NULL THEN 0.0 ELSE {F1_SQL.format(a='e.part_numbers', b='g.part_numbers')} END AS pn_f1,
    CASE WHEN g.doc IS NULL THEN 0.0 ELSE k.assoc END AS assoc_f1,
    CAST(coalesce(len(g.lines), 0) - len(e.lines) AS INT) AS fit_delta,
    CASE WHEN g.doc IS NULL THEN 0 ELSE k.matched END AS matched, CASE WHEN g.doc IS NULL THEN len(e.lines) ELSE k.n END AS total
  FROM b_records e LEFT JOIN b_records g ON g.doc + 1 = e.doc
  JOIN (SELECT e.doc, count(*) AS n, count(g.doc) AS matched,
          avg(CASE WHEN g.doc IS NULL THEN 0.0 ELSE {F1_SQL.format(a='e.pns', b='g.pns')} END) AS assoc
        FROM ({KEYED_SQL}) e LEFT JOIN ({KEYED_SQL}) g ON g.doc + 1 = e.doc AND g.year_start = e.year_start AND g.model = e.model
        GROUP BY e.doc) k ON k.doc = e.doc"""


@query("record_score", f"""SELECT doc, round(scalar, 6) AS scalar, round(pn_f1, 6) AS pn_f1, round(assoc_f1, 6) AS assoc_f1,
   fit_delta, matched, total FROM ({SCORE_SQL})""")
def record_score(t):
    s = S.score_records(t.b_records, shifted(t))
    return s.select("doc", *[F.round(c, 6).alias(c) for c in ("scalar", "pn_f1", "assoc_f1")], "fit_delta", "matched", "total")


@query("score_summary", f"""SELECT source, count(*) AS n, round(avg(scalar), 6) AS scalar, round(avg(pn_f1), 6) AS pn_f1,
   round(avg(assoc_f1), 6) AS assoc_f1 FROM ({SCORE_SQL}) GROUP BY 1""")
def score_summary(t):
    s = S.score_records(t.b_records, shifted(t)).join(t.b_records.select("doc", "source"), "doc")
    return S.score_summary(s).select("source", "n", *[F.round(c, 6).alias(c) for c in ("scalar", "pn_f1", "assoc_f1")])


@query("record_checks", """
  SELECT doc, regexp_matches(eo_number, '^[A-Z0-9]{1,3}(-[A-Z0-9]{1,6}){1,3}$') AS eo_format,
         (manufacturer IS NOT NULL AND category IS NOT NULL AND len(part_numbers) >= 1) AS required_fields FROM b_records""")
def record_checks(t):
    return S.record_checks(t.b_records).select("doc", "eo_format", "required_fields")


@query("accuracy_report", f"""
  SELECT 'older' AS source, count(*) AS n, round(avg(scalar), 6) AS scalar, round(avg(pn_f1), 6) AS pn_f1, round(avg(assoc_f1), 6) AS assoc_f1 FROM ({SCORE_SQL})
  UNION ALL SELECT 'same', count(*), 1.0, 1.0, 1.0 FROM b_records""")
def accuracy_report(t):
    """Every record against two sources: the document before, and itself."""
    scores = G.accuracy_report(t.b_records, {"older": shifted(t), "same": t.b_records})
    return S.score_summary(scores).select("source", "n", *[F.round(c, 6).alias(c) for c in ("scalar", "pn_f1", "assoc_f1")])


@query("check_rates", f"""
  WITH c AS (SELECT regexp_matches(eo_number, '^[A-Z0-9]{{1,3}}(-[A-Z0-9]{{1,6}}){{1,3}}$') AS f,
      (manufacturer IS NOT NULL AND category IS NOT NULL AND len(part_numbers) >= 1) AS r FROM b_records)
  SELECT 'eo_format' AS check, count(*) AS n, CAST(sum(f::INT) AS BIGINT) AS passed, round(avg(f::INT), 6) AS rate FROM c
  UNION ALL SELECT 'required_fields', count(*), CAST(sum(r::INT) AS BIGINT), round(avg(r::INT), 6) FROM c
  UNION ALL SELECT 'schema', count(*), count(*) FILTER (faults = ''), round(count(*) FILTER (faults = '') / count(*), 6) FROM ({FAULTS_SQL})""")
def check_rates(t):
    rates = S.check_rates(S.record_checks(t.b_records), ["eo_format", "required_fields"])
    types = S.check_rates(R.validate_records(t.b_record_json).select(F.col("valid").alias("schema")), ["schema"])
    return rates.unionByName(types).withColumn("rate", F.round("rate", 6))


AUDIT_SQL = f"""
  WITH r AS (SELECT r.*, x.category, x.eo_number, CASE r.doc % 4 WHEN 0 THEN 'accept' WHEN 1 THEN 'fix' WHEN 2 THEN 'escalate' ELSE 'maybe' END AS verdict
    FROM ({ROUTE_SQL}) r JOIN b_records x ON x.doc = r.doc),
  f AS (SELECT *, CASE doc % 3 WHEN 0 THEN true WHEN 1 THEN false ELSE true END AS fix_ok,
    list_filter(string_split(issues, ','), lambda i: i <> '' AND NOT (doc % 3 = 0 AND i = 'no_category') AND NOT (doc % 3 = 2 AND i = 'bad_eo_number')) AS left_over FROM r),
  o AS (SELECT *, reason IS NULL OR (verdict = 'accept' AND issues = '') OR (verdict = 'fix' AND fix_ok AND len(left_over) = 0) AS accepted FROM f)
  SELECT doc, CASE WHEN accepted THEN 'accepted' ELSE 'escalated' END AS outcome,
    CASE WHEN accepted THEN NULL WHEN verdict IN ('maybe', 'fix') THEN 'validation_failure' ELSE reason END AS final_reason,
    CASE WHEN accepted THEN NULL WHEN verdict = 'maybe' THEN 'critique output failed validation'
      WHEN verdict = 'fix' AND NOT fix_ok THEN 'p. 1; p. 2 (corrections failed validation)'
      WHEN verdict = 'accept' THEN concat('gate: ', replace(issues, ',', ', '), '; critic: p. 1; p. 2')
      ELSE 'p. 1; p. 2' END AS notes
  FROM o"""


def verdicts(t):
    """Second opinions on every document, some with corrections that do not validate."""
    return t.documents.select(
        F.col("doc_id").alias("doc"),
        F.expr("CASE doc_id % 4 WHEN 0 THEN 'accept' WHEN 1 THEN 'fix' WHEN 2 THEN 'escalate' ELSE 'maybe' END").alias("verdict"),
        F.expr("""CASE doc_id % 3 WHEN 0 THEN '{"category":"intake"}' WHEN 1 THEN '{"confidence":7}' ELSE '{"eo_number":"D-9-9"}' END""").alias("corrections"),
        F.array(F.lit("p. 1"), F.lit("p. 2")).alias("reasons"))


@query("audit_outcome", AUDIT_SQL)
def audit_outcome(t):
    return daily.audit(routed(t), verdicts(t)).select("doc", "outcome", "final_reason", "notes")


@query("trajectory_check", """
  WITH e AS (SELECT doc, agent, row_number() OVER (PARTITION BY doc ORDER BY coalesce(ts, 0), event_id) AS p FROM b_events WHERE doc IS NOT NULL),
  x AS (SELECT doc, min(p) FILTER (agent = 'extractor') AS pe FROM e GROUP BY 1),
  a AS (SELECT e.doc, min(p) AS pa FROM e JOIN x ON x.doc = e.doc WHERE agent = 'auditor' AND p > pe GROUP BY 1),
  m AS (SELECT e.doc, min(p) AS pm FROM e JOIN a ON a.doc = e.doc WHERE agent = 'matchmaker' AND p > pa GROUP BY 1),
  j AS (SELECT o.doc, o.state, coalesce(o.state IN ('complete', 'superseded'), false) AS state_ok, x.doc IS NOT NULL AS seen, pm IS NOT NULL AS order_ok
    FROM b_approvals o LEFT JOIN x ON x.doc = o.doc LEFT JOIN m ON m.doc = o.doc)
  SELECT doc, CASE WHEN seen THEN state_ok AND order_ok ELSE state_ok END AS ok,
    CASE WHEN NOT seen THEN concat('state-only (state=', coalesce(state, 'None'), '), no events found') WHEN state_ok AND order_ok THEN 'ok'
      ELSE array_to_string(list_filter([CASE WHEN NOT state_ok THEN concat('state=', coalesce(state, 'None')) END,
         CASE WHEN NOT order_ok THEN 'missing/out-of-order stage' END], lambda s: s IS NOT NULL), '; ') END AS note
  FROM j""")
def trajectory_check(t):
    return S.trajectory_check(t.b_approvals, t.b_events)
