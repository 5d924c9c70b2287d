"""Text parsing and label queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import labels as L
from ..functions import text as T
from ..functions import vocab as v
from ..operators import quality
from .registry import query


def quote(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def case_of(expr: str, table: dict, otherwise: str = "NULL") -> str:
    whens = " ".join(f"WHEN {quote(k) if isinstance(k, str) else k} THEN "
                     f"{quote(x) if isinstance(x, str) else x}" for k, x in table.items())
    return f"CASE {expr} {whens} ELSE {otherwise} END"


def any_word(expr: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({expr}, {quote(w)})" for w in words) + ")"


def any_start(expr: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"starts_with({expr}, {quote(w)})" for w in words) + ")"


def sql_normalize(expr: str) -> str:
    e = f"trim({expr})"
    for p in (v.MODEL_TRAILING_PARENS, v.MODEL_WEIGHT_SPEC, v.MODEL_DISPLACEMENT_SPEC,
              v.MODEL_TRAILING_DIGITS, v.MODEL_SUFFIX):
        e = f"regexp_replace({e}, {quote(p)}, '')"
    words = f"list_transform(string_split_regex(trim({e}), '\\s+'), lambda w: {case_of('w', v.MODEL_WORDS, 'w')})"
    return f"trim(array_to_string({words}, ' '))"


def sql_litres(cid: str) -> str:
    return (f"CAST({case_of(f'CAST({cid} AS INT)', v.CID_LITRES, f'round(CAST({cid} AS DOUBLE) * 0.016387, 2)')}"
            " AS DOUBLE)")


def sql_displacement(expr: str) -> str:
    t = f"lower({expr})"
    g = {k: f"nullif(regexp_extract({t}, {quote(p)}, 1), '')" for k, p in
         (("l", v.DISPLACEMENT_LITRES), ("p", v.DISPLACEMENT_CID_PARENS), ("c", v.DISPLACEMENT_CID))}
    return (f"CASE WHEN regexp_matches({t}, {quote(v.DISPLACEMENT_OPEN)}) THEN NULL "
            f"WHEN {g['l']} IS NOT NULL THEN CAST({g['l']} AS DOUBLE) "
            f"WHEN {g['p']} IS NOT NULL THEN {sql_litres(g['p'])} "
            f"WHEN {g['c']} IS NOT NULL THEN {sql_litres(g['c'])} END")


def sql_induction(expr: str) -> str:
    return "CASE " + " ".join(f"WHEN contains(lower({expr}), {quote(p)}) THEN {quote(x)}"
                              for p, x in v.INDUCTION_PHRASES) + " END"


def sql_cylinders(expr: str) -> str:
    n = f"TRY_CAST(nullif(regexp_extract({expr}, {quote(v.CYLINDERS_COUNT)}, 1), '') AS INT)"
    m = f"TRY_CAST(nullif(regexp_extract({expr}, {quote(v.CYLINDERS_LAYOUT)}, 1), '') AS INT)"
    return f"CASE WHEN coalesce({n}, 0) <> 0 THEN {n} ELSE coalesce({m}, {n}) END"


def sql_category(expr: str) -> str:
    return "CASE " + " ".join(f"WHEN {any_word(f'lower({expr})', ws)} THEN {quote(slug)}"
                              for slug, ws in v.CATEGORY_RULES) + " ELSE 'other' END"


def sql_failure(expr: str) -> str:
    e = f"coalesce({expr}, '')"
    return (f"CASE WHEN {any_word(f'lower({e})', v.CORRUPT_MARKERS)} THEN 'corrupt_source' "
            f"WHEN {any_start(e, v.PERMANENT_PREFIXES)} OR {any_word(e, v.TOKEN_CAP_MARKERS)} THEN 'permanent' "
            f"WHEN {any_start(e, v.TRANSIENT_PREFIXES)} OR {any_word(e, v.TRANSIENT_MARKERS)} THEN 'transient' "
            "ELSE 'permanent' END")


SQL_MAKE = r"regexp_replace(lower(trim(make_text)), '[-\s]+', ' ', 'g')"


@query("normalize_model", f"SELECT p_partkey, {sql_normalize('model_text')} AS model FROM b_raw_text")
def normalize_model(t):
    return t.b_raw_text.select("p_partkey", T.normalize_model(F.col("model_text")).alias("model"))


@query("expand_models", f"""
  WITH parts AS (
    SELECT p_partkey, model_text, list_transform(string_split(model_text, '/'), lambda p: trim(p)) AS ps FROM b_raw_text),
  named AS (
    SELECT p_partkey, CASE WHEN NOT contains(model_text, '/') THEN [model_text]
      WHEN regexp_matches(ps[1], '^.*?\\d+$') AND len(list_filter(ps[2:], lambda p: NOT regexp_matches(p, '^\\d+$'))) = 0
      THEN list_concat([ps[1]], list_transform(ps[2:], lambda p: regexp_extract(ps[1], '^(.*?)(\\d+)$', 1) || p))
      ELSE ps END AS names FROM parts)
  SELECT p_partkey, pos, {sql_normalize('name')} AS model
  FROM (SELECT p_partkey, CAST(generate_subscripts(names, 1) - 1 AS INT) AS pos, unnest(names) AS name FROM named)""")
def expand_models(t):
    return t.b_raw_text.select("p_partkey", F.posexplode(T.expand_models(F.col("model_text"))).alias("pos", "model"))


@query("expand_makes", """
  SELECT p_partkey, unnest(CASE WHEN contains(make_text, '/')
    THEN list_filter(list_transform(string_split(make_text, '/'), lambda p: trim(p)), lambda p: p <> '')
    ELSE [trim(make_text)] END) AS make FROM b_raw_text""")
def expand_makes(t):
    return t.b_raw_text.select("p_partkey", F.explode(T.expand_makes(F.col("make_text"))).alias("make"))


@query("parse_displacement", f"""
  SELECT p_partkey, {sql_displacement('engine_text')} AS displacement_l,
         {sql_litres('p_size * 10')} AS size_litres FROM b_raw_text JOIN part USING (p_partkey)""")
def parse_displacement(t):
    return t.b_raw_text.join(t.part.select("p_partkey", "p_size"), "p_partkey").select(
        "p_partkey", T.parse_displacement(F.col("engine_text")).alias("displacement_l"),
        T.cid_to_litres(F.col("p_size") * 10).alias("size_litres"))


@query("parse_induction", f"SELECT p_partkey, {sql_induction('engine_text')} AS induction FROM b_raw_text")
def parse_induction(t):
    return t.b_raw_text.select("p_partkey", T.parse_induction(F.col("engine_text")).alias("induction"))


@query("parse_engine", f"""
  SELECT p_partkey, {sql_displacement('engine_text')} AS displacement_l, {sql_induction('engine_text')} AS induction,
         {sql_cylinders('engine_text')} AS cylinders FROM b_raw_text""")
def parse_engine(t):
    return t.b_raw_text.select("p_partkey", T.parse_engine(F.col("engine_text")).alias("e")).select("p_partkey", "e.*")


@query("categorize", f"""
  SELECT 'device' AS kind, p_partkey AS id, {sql_category('device_text')} AS category FROM b_raw_text
  UNION ALL SELECT 'document', doc_id, {sql_category('text')} FROM documents""")
def categorize(t):
    devices = t.b_raw_text.select(F.lit("device").alias("kind"), F.col("p_partkey").alias("id"),
                                  T.categorize(F.col("device_text")).alias("category"))
    return devices.unionByName(t.documents.select(
        F.lit("document").alias("kind"), F.col("doc_id").alias("id"), T.categorize(F.col("text")).alias("category")))


@query("make_coverage", f"""
  WITH known AS (SELECT DISTINCT regexp_replace(lower(trim(p_brand)), '[-\\s]+', ' ', 'g') AS k FROM part
    UNION SELECT unnest([{', '.join(quote(' '.join(m.replace('-', ' ').split())) for m in v.POWERSPORTS_MAKES)}])),
  named AS (SELECT p_partkey, {SQL_MAKE} AS m FROM b_raw_text),
  aliased AS (SELECT p_partkey, m, coalesce({case_of('m', {k: x.replace('-', ' ') for k, x in v.MAKE_ALIASES.items()})},
    {case_of("replace(m, ' ', '')", {k: x.replace('-', ' ') for k, x in v.MAKE_ALIASES.items()})}) AS a FROM named)
  SELECT p_partkey, m AS make, (m IN (SELECT k FROM known) OR coalesce(a IN (SELECT k FROM known), false)) AS known
  FROM aliased""")
def make_coverage(t):
    return quality.make_coverage(t.b_raw_text.withColumnRenamed("make_text", "make"),
                                 t.b_catalog).select("p_partkey", F.col("make_norm").alias("make"), "known")


@query("part_number_check", """
  SELECT p_partkey, length(trim(parts_text)) BETWEEN 2 AND 48 AND NOT regexp_matches(trim(parts_text), '[<>_{}]') AS ok
  FROM b_raw_text""")
def part_number_check(t):
    return t.b_raw_text.select("p_partkey", T.part_number_ok(F.col("parts_text")).alias("ok"))


@query("split_list", """
  SELECT p_partkey, unnest(list_filter(list_transform(string_split(parts_text, ','), lambda p: trim(p)),
                                       lambda p: p <> '')) AS part_number FROM b_raw_text""")
def split_list(t):
    return t.b_raw_text.select("p_partkey", F.explode(T.split_list(F.col("parts_text"))).alias("part_number"))


@query("key_format", r"""
  SELECT doc, regexp_matches(eo_number, '^[A-Z0-9]{1,3}(-[A-Z0-9]{1,6}){1,3}$') AS ok,
         CASE WHEN starts_with(pdf_url, 'https://') THEN pdf_url END AS link,
         coalesce(CAST(nullif(regexp_extract(concat(eo_number, '_v', doc % 12), '_v(\d+)$', 1), '') AS INT), 1) AS version
  FROM b_approvals""")
def key_format(t):
    return t.b_approvals.select(
        "doc", T.key_format_ok(F.col("eo_number")).alias("ok"), L.safe_link(F.col("pdf_url")).alias("link"),
        T.version_of(F.concat("eo_number", F.lit("_v"), F.col("doc") % 12)).alias("version"))


@query("classify_failures", f"""
  SELECT id, {sql_failure('last_error')} AS kind, {any_word("coalesce(last_error, '')", v.TOKEN_CAP_MARKERS)} AS token_cap,
         CASE WHEN contains(coalesce(last_error, ''), '429') THEN {quote(v.HINT_RATE_LIMIT)}
              WHEN contains(coalesce(last_error, ''), '1048576') THEN {quote(v.HINT_TOO_LARGE)} END AS hint
  FROM b_items""")
def classify_failures(t):
    e = F.col("last_error")
    return t.b_items.select("id", T.classify_failure(e).alias("kind"), T.is_token_cap(e).alias("token_cap"),
                            L.failure_hint(e).alias("hint"))


@query("token_cost", """
  SELECT event_id, round(tok_in * 0.75 / 1e6 + tok_out * 3.75 / 1e6, 10) AS usd,
         round((tok_in * 0.75 + tok_out * 3.75) / 2e6, 10) AS batch_usd FROM b_events""")
def token_cost(t):
    i, o = F.col("tok_in"), F.col("tok_out")
    return t.b_events.select("event_id", F.round(T.token_cost(i, o), 10).alias("usd"),
                             F.round(T.token_cost(i, o, batch=True), 10).alias("batch_usd"))


@query("engine_label", """
  WITH v AS (SELECT vehicle_id, year, trim, CASE WHEN vehicle_id % 5 = 0 THEN 0 ELSE cylinders END AS cyl, displacement_l,
    induction FROM b_catalog), p AS (SELECT *, list_filter([
      CASE WHEN displacement_l <> 0 THEN regexp_replace(CAST(displacement_l AS VARCHAR), '\\.0$', '') || 'L' END,
      CASE WHEN cyl <> 0 THEN CAST(cyl AS VARCHAR) || '-cyl' END,
      CASE induction WHEN 'NA' THEN 'N/A' WHEN 'TURBO' THEN 'Turbo' WHEN 'SC' THEN 'Supercharged' END],
      lambda x: x IS NOT NULL) AS ps FROM v)
  SELECT vehicle_id, CASE WHEN len(ps) = 0 THEN 'Unspecified engine' ELSE array_to_string(ps, ' ') END AS label,
         CASE WHEN trim = 'SMALL' THEN 'Base' ELSE trim END AS trim_label FROM p""")
def engine_label(t):
    cyl = F.when(F.col("vehicle_id") % 5 == 0, 0).otherwise(F.col("cylinders"))
    trim = F.when(F.col("trim") == "SMALL", "").otherwise(F.col("trim"))
    return t.b_catalog.select("vehicle_id", L.engine_label(F.col("displacement_l"), cyl, F.col("induction")).alias("label"),
                              L.trim_label(trim).alias("trim_label"))


@query("year_label", """
  SELECT doc, row_idx, CASE WHEN ys IS NULL AND year_end IS NULL THEN '—'
    WHEN ys IS NOT NULL AND year_end IS NOT NULL AND ys <> year_end THEN concat(ys, '–', year_end)
    ELSE CAST(coalesce(ys, year_end) AS VARCHAR) END AS label
  FROM (SELECT doc, row_idx, nullif(year_start, 0) AS ys, year_end FROM b_app_rows)""")
def year_label(t):
    return t.b_app_rows.select("doc", "row_idx", L.year_range(
        F.nullif(F.col("year_start"), F.lit(0)), F.col("year_end")).alias("label"))


@query("tier_badge", """
  SELECT doc, vehicle_id, tier, CASE WHEN tier IN ('exact', 'high') THEN 'green' WHEN tier = 'medium' THEN 'amber' ELSE 'red' END AS badge,
         CASE tier WHEN 'exact' THEN 'Exact match' WHEN 'medium' THEN 'Medium confidence' ELSE 'Generic fit' END AS label
  FROM b_matches""")
def tier_badge(t):
    return t.b_matches.select("doc", "vehicle_id", "tier", L.tier_badge(F.col("tier")).alias("badge"),
                              L.tier_label(F.col("tier")).alias("label"))


@query("category_order", """
  SELECT category, count(*) AS n, CASE WHEN category IS NULL THEN 10 WHEN category = 'intake' THEN 1 WHEN category = 'boost' THEN 2
     WHEN category = 'other' THEN 8 ELSE 9 END AS place,
     CASE WHEN category IS NULL THEN 'Uncategorized' ELSE upper(category[1:1]) || category[2:] END AS label
  FROM b_matches GROUP BY 1""")
def category_order(t):
    c = F.col("category")
    return t.b_matches.groupBy("category").agg(F.count("*").alias("n")).withColumns(
        {"place": L.category_order(c), "label": L.category_label(c)})


@query("age_bucket", """
  SELECT event_id, CASE WHEN ts IS NULL THEN '—' WHEN age < 60 THEN 'just now'
      WHEN floor(age / 60) < 60 THEN CAST(CAST(floor(age / 60) AS BIGINT) AS VARCHAR) || 'm ago'
      WHEN floor(age / 3600) < 24 THEN CAST(CAST(floor(age / 3600) AS BIGINT) AS VARCHAR) || 'h ago'
      ELSE CAST(CAST(floor(age / 86400) AS BIGINT) AS VARCHAR) || 'd ago' END AS age
  FROM (SELECT event_id, ts, greatest(0.0, 1705708800.0 - ts) AS age FROM b_events)""")
def age_bucket(t):
    return t.b_events.select("event_id", L.age_bucket(F.col("ts"), F.lit(1705708800.0)).alias("age"))


@query("number_labels", """
  SELECT id, concat('$', printf('%.2f', floor(cost_usd * 100) / 100)) AS cost, format('{:,}', CAST(floor(started_at) AS BIGINT)) AS n,
     CASE WHEN length(trigger_kind) > 9 THEN concat(left(trigger_kind, 9), '…') ELSE trigger_kind END AS short,
     CASE WHEN floor(cost_usd + 0.5) < 60 THEN concat('+', CAST(floor(cost_usd + 0.5) AS BIGINT), 's')
       ELSE concat('+', CAST(floor(floor(cost_usd + 0.5) / 60) AS BIGINT), 'm ', lpad(CAST(CAST(floor(cost_usd + 0.5) AS BIGINT) % 60 AS VARCHAR), 2, '0'), 's')
     END AS elapsed
  FROM b_runs""")
def number_labels(t):
    c = F.col("cost_usd")
    return t.b_runs.select("id", L.money(F.floor(c * 100) / 100).alias("cost"),
                           L.count_label(F.floor("started_at")).alias("n"),
                           L.truncate(F.col("trigger_kind"), 9).alias("short"), L.elapsed_label(c).alias("elapsed"))


@query("event_detail", """
  SELECT event_id, coalesce(CASE action
    WHEN 'reading' THEN 'reading PDF (rung ' || rung || ')…'
    WHEN 'critiquing' THEN 'second-opinion critique…'
    WHEN 'resolving' THEN 'resolving ' || n || ' ambiguous matches via Gemini…'
    WHEN 'extracted' THEN 'rung ' || ladder_step || ' · ' || CASE ladder_step WHEN 1 THEN 'native PDF' WHEN 2 THEN 'image fallback'
        ELSE 'rung ' || ladder_step END || ' · conf ' || format('{:.2f}', confidence)
    WHEN 'escalated' THEN '→ human review (' || reason || ')'
    WHEN 'matched' THEN n || ' vehicles' || CASE WHEN resolved > 0 THEN ', ' || resolved || ' resolved by Gemini' ELSE '' END
    WHEN 'requeued_transient' THEN 'forgave transient failure'
    WHEN 'heal_limit_reached' THEN 'parked for human (3 strikes)'
    WHEN 'discover_failed' THEN 'download failed: ' || error
    WHEN 'failed_both_rungs' THEN 'extraction failed on both rungs'
    WHEN 'resolver_output_invalid' THEN 'resolver output rejected'
    WHEN 'resolver_hallucinated_ids' THEN 'hallucinated ids filtered' END, '') AS detail
  FROM b_events""")
def event_detail(t):
    c = [F.col(x) for x in ("action", "rung", "ladder_step", "confidence", "n", "resolved", "reason", "error")]
    return t.b_events.select("event_id", L.event_detail(*c).alias("detail"))


@query("first_lines", r"""
  SELECT id, coalesce(nullif(trim(split_part(agent_notes, chr(10), 1)), ''), '—') AS headline FROM b_reviews""")
def first_lines(t):
    return t.b_reviews.select("id", L.first_line(F.col("agent_notes")).alias("headline"))
