"""Catalog matching queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import match as M
from ..operators import matching as op
from .registry import query

# SQL shared by the checks below: the plain form of candidates, matches and best match.
CANDIDATES = """
  SELECT r.doc, r.row_idx, c.vehicle_id, r.model AS rmodel, c.model AS cmodel,
         r.displacement_l AS rl, r.induction AS ri, r.cylinders AS rc,
         c.displacement_l AS cl, c.induction AS ci, c.cylinders AS cc
  FROM b_app_rows r JOIN b_catalog c ON lower(r.make) = lower(c.make)
   AND c.year BETWEEN coalesce(nullif(r.year_start, 0), 0) AND coalesce(nullif(r.year_end, 0), 9999)"""
TIERED = f"""
  SELECT doc, row_idx, vehicle_id,
         CASE WHEN rl IS NULL THEN 'generic' WHEN cl IS NULL OR abs(cl - rl) > 0.15 THEN NULL
              WHEN ri <> '' AND ri = ci THEN CASE WHEN rc <> 0 AND rc = cc THEN 'exact' ELSE 'high' END
              ELSE 'medium' END AS tier
  FROM ({CANDIDATES})
  WHERE (starts_with(lower(cmodel), lower(rmodel))
         AND substr(lower(cmodel), length(rmodel) + 1, 1) IN ('', ' ', '-', '/'))
     OR (starts_with(lower(rmodel), lower(cmodel))
         AND substr(lower(rmodel), length(cmodel) + 1, 1) IN ('', ' ', '-', '/'))"""
MATCHED = f"SELECT * FROM ({TIERED}) WHERE tier IS NOT NULL"
BEST = f"""
  SELECT doc, vehicle_id, tier, row_idx FROM (
    SELECT *, row_number() OVER (PARTITION BY doc, vehicle_id ORDER BY
      CASE tier WHEN 'exact' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END, row_idx) AS rn
    FROM ({MATCHED})) WHERE rn = 1"""
UNRESOLVED = f"""
  SELECT c.doc, c.row_idx, count(*) AS n_candidates
  FROM ({CANDIDATES}) c LEFT JOIN (SELECT DISTINCT doc, row_idx FROM ({MATCHED})) m
    ON c.doc = m.doc AND c.row_idx = m.row_idx
  WHERE m.doc IS NULL GROUP BY 1, 2"""
OUTCOMES = f"""
  SELECT doc, row_idx, seq, rationale, confidence, n_valid, first_id, second_id,
         CASE WHEN confidence < 0.75 THEN 'review' WHEN n_valid = 0 THEN 'rejected'
              ELSE 'accepted' END AS outcome
  FROM (SELECT d.doc, d.row_idx, d.seq, d.rationale, d.confidence,
               (a.vehicle_id IS NOT NULL)::INT + (b.vehicle_id IS NOT NULL)::INT AS n_valid,
               a.vehicle_id AS first_id, b.vehicle_id AS second_id
        FROM b_decisions d JOIN ({UNRESOLVED}) u ON d.doc = u.doc AND d.row_idx = u.row_idx
        LEFT JOIN ({CANDIDATES}) a ON a.doc = d.doc AND a.row_idx = d.row_idx AND a.vehicle_id = d.id1
        LEFT JOIN ({CANDIDATES}) b ON b.doc = d.doc AND b.row_idx = d.row_idx AND b.vehicle_id = d.id2)"""


def app_rows(t):
    return t.b_app_rows.withColumn(
        "part_numbers", F.when(F.col("part_number").isNotNull(), F.array("part_number"))
        .otherwise(F.array().cast("array<string>")))


def decisions(t):
    return t.b_decisions.select("doc", "row_idx", "seq", F.array("id1", "id2").alias("vehicle_ids"),
                                "rationale", "confidence")


def matches(t, folded=False):
    return op.application_matches(app_rows(t), t.b_catalog, folded=folded, by_doc=folded)


def unresolved(t):
    return op.unresolved_rows(app_rows(t), t.b_catalog)


def outcomes(t):
    return op.resolver_outcomes(decisions(t), unresolved(t), t.b_catalog)


def doc_parts(t):
    return t.b_approvals.select("doc", F.array("eo_number").alias("part_numbers"),
                                "category", "device_name", "manufacturer")


@query("candidate_join", f"""
  SELECT r.doc, r.row_idx, count(c.vehicle_id) AS n_candidates
  FROM b_app_rows r LEFT JOIN ({CANDIDATES}) c ON r.doc = c.doc AND r.row_idx = c.row_idx
  GROUP BY 1, 2""")
def candidate_join(t):
    return op.candidate_counts(t.b_app_rows, t.b_catalog).select("doc", "row_idx", "n_candidates")


@query("application_match", MATCHED)
def application_match(t):
    return matches(t)


@query("best_match", BEST)
def best_match(t):
    return op.expanded(op.best_matches(matches(t, folded=True)), t.b_catalog)


@query("match_records", f"""
  SELECT m.doc, m.vehicle_id, m.tier, 'deterministic' AS method,
         coalesce(r.part_number, a.eo_number) AS part_numbers, a.category, a.device_name, a.manufacturer
  FROM ({BEST}) m JOIN b_app_rows r ON m.doc = r.doc AND m.row_idx = r.row_idx
  LEFT JOIN b_approvals a ON a.doc = m.doc""")
def match_records(t):
    out = op.match_records(op.best_matches(matches(t, folded=True)), app_rows(t), doc_parts(t))
    return op.expanded(out.withColumn("part_numbers", F.array_join("part_numbers", ",")), t.b_catalog)


@query("match_counts", f"""
  SELECT a.doc, count(m.vehicle_id) AS match_count
  FROM b_approvals a LEFT JOIN ({BEST}) m ON a.doc = m.doc GROUP BY 1""")
def match_counts(t):
    return op.match_counts(t.b_approvals, op.sized(op.best_matches(matches(t, folded=True)), t.b_catalog))


@query("unresolved_rows", UNRESOLVED)
def unresolved_rows(t):
    return unresolved(t).select("doc", "row_idx", "n_candidates")


@query("candidate_cap", f"""
  SELECT doc, row_idx, n_candidates, part_no, string_agg(CAST(vehicle_id AS VARCHAR), ',' ORDER BY vehicle_id) AS candidate_ids
  FROM (SELECT u.doc, u.row_idx, u.n_candidates, c.vehicle_id,
           (row_number() OVER (PARTITION BY u.doc, u.row_idx ORDER BY c.vehicle_id) - 1) // 20 AS part_no
        FROM ({UNRESOLVED}) u JOIN ({CANDIDATES}) c ON u.doc = c.doc AND u.row_idx = c.row_idx)
  GROUP BY 1, 2, 3, 4""")
def candidate_cap(t):
    sent = op.resolver_requests(unresolved(t), t.b_catalog, 20)
    ids = F.array_join(F.col("candidate_ids").cast("array<string>"), ",")
    return sent.select("doc", "row_idx", "n_candidates", "part_no", ids.alias("candidate_ids"))


@query("resolver_filter", f"SELECT doc, row_idx, seq, outcome, CAST(n_valid AS BIGINT) AS n_valid FROM ({OUTCOMES})")
def resolver_filter(t):
    return outcomes(t).select("doc", "row_idx", "seq", "outcome",
                              F.coalesce(F.size("valid_ids"), F.lit(0)).cast("long").alias("n_valid"))


@query("resolver_review", f"""
  SELECT o.doc, o.row_idx, 'ambiguous_match' AS reason, o.rationale AS agent_notes,
         concat(d.id1, ',', d.id2) AS proposed
  FROM ({OUTCOMES}) o JOIN b_decisions d ON o.doc = d.doc AND o.row_idx = d.row_idx AND o.seq = d.seq
  WHERE outcome = 'review'""")
def resolver_review(t):
    return op.resolver_reviews(outcomes(t)).select(
        "doc", "row_idx", "reason", "agent_notes",
        F.array_join(F.col("proposed_vehicle_ids").cast("array<string>"), ",").alias("proposed"))


@query("resolver_merge", f"""
  WITH best AS ({BEST}), extra AS (
    SELECT doc, vehicle_id, row_idx, rationale, row_number() OVER (PARTITION BY doc, vehicle_id ORDER BY seq, row_idx, rationale) AS rn
    FROM (SELECT doc, row_idx, seq, first_id AS vehicle_id, rationale FROM ({OUTCOMES}) WHERE outcome = 'accepted' AND first_id IS NOT NULL
          UNION ALL
          SELECT doc, row_idx, seq, second_id, rationale FROM ({OUTCOMES}) WHERE outcome = 'accepted' AND second_id IS NOT NULL))
  SELECT doc, vehicle_id, tier, row_idx, 'deterministic' AS method, NULL AS rationale FROM best
  UNION ALL
  SELECT e.doc, e.vehicle_id, 'generic', e.row_idx, 'gemini_resolved', e.rationale FROM extra e
  WHERE rn = 1 AND NOT EXISTS (SELECT 1 FROM best b WHERE b.doc = e.doc AND b.vehicle_id = e.vehicle_id)""")
def resolver_merge(t):
    # Which rows have no match is asked again without building matches: that takes no disk, and the matches, many more than the rows, do.
    merged = op.merge_resolved(op.best_matches(matches(t, folded=True)), outcomes(t), t.b_catalog)
    return op.expanded(merged, t.b_catalog)


@query("model_prefix_match", """
  SELECT doc, row_idx, p_partkey,
         coalesce((starts_with(lower(p_name), lower(model)) AND substr(lower(p_name), length(model) + 1, 1) IN ('', ' ', '-', '/'))
          OR (starts_with(lower(model), lower(p_name)) AND substr(lower(model), length(p_name) + 1, 1) IN ('', ' ', '-', '/')), false) AS fits
  FROM b_app_rows JOIN part ON p_partkey = CAST(row_idx % 1000000000000000000 AS BIGINT) // 1000000000""")
def model_prefix_match(t):
    named = t.b_app_rows.withColumn("p_partkey", F.expr("(row_idx % 1000000000000000000) div 1000000000"))
    return named.join(t.part, "p_partkey").select(
        "doc", "row_idx", "p_partkey", M.model_matches(F.col("model"), F.col("p_name")).alias("fits"))


@query("engine_tier", """
  SELECT doc, row_idx, vehicle_id,
         CASE WHEN r.displacement_l IS NULL THEN 'generic'
              WHEN c.displacement_l IS NULL OR abs(c.displacement_l - r.displacement_l) > 0.15 THEN 'none'
              WHEN r.induction <> '' AND r.induction = c.induction
                THEN CASE WHEN r.cylinders <> 0 AND r.cylinders = c.cylinders THEN 'exact' ELSE 'high' END
              ELSE 'medium' END AS tier
  FROM b_app_rows r JOIN b_catalog c ON c.vehicle_id = ((r.row_idx % 1000000000000000000) // 1000000000) + 3""")
def engine_tier(t):
    rows = t.b_app_rows.withColumn("vehicle_id", F.expr("(row_idx % 1000000000000000000) div 1000000000 + 3"))
    cat = t.b_catalog.select("vehicle_id", F.col("displacement_l").alias("cl"),
                             F.col("induction").alias("ci"), F.col("cylinders").alias("cc"))
    tier = M.engine_tier(F.col("displacement_l"), F.col("induction"), F.col("cylinders"),
                         F.col("cl"), F.col("ci"), F.col("cc"))
    return rows.join(cat, "vehicle_id").select("doc", "row_idx", "vehicle_id",
                                               F.coalesce(tier, F.lit("none")).alias("tier"))
