"""Views that give the star-schema test tables the shapes the jobs work on.

Plain relational views are one SQL text used by both engines. Views that need nested
values have one text per engine.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from ..session import spread

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()

# Tables whose rows fan out or carry long text, so that work should start on all cores.
HEAVY = {"lineitem", "documents", "pages"}

# One text for both engines; epoch_s(x) is seconds since 1970 as a double.
SHARED_VIEWS = {
    "b_catalog": """
        SELECT p_partkey AS vehicle_id, CAST(1970 + p_size AS INT) AS year, p_brand AS make,
               p_name AS model, p_type AS trim,
               CAST(CAST(round(p_retailprice * 10) AS BIGINT) - 9000 AS DOUBLE) / 100 AS displacement_l,
               CASE WHEN p_type IN ('STANDARD', 'MEDIUM') THEN 'NA'
                    WHEN p_type IN ('PROMO', 'LARGE') THEN 'TURBO'
                    WHEN p_type = 'ECONOMY' THEN 'SC' END AS induction,
               CAST(4 + 2 * (p_partkey % 3) AS INT) AS cylinders
        FROM part""",
    # (order, line, part, supplier, quantity) identifies a line; packed in that order it is
    # the position of the row in its document, without a sort per document.
    "b_app_rows": """
        SELECT l_orderkey AS doc,
               CAST(l_linenumber AS BIGINT) * 1000000000000000000 + l_partkey * 1000000000
                 + l_suppkey * 100 + CAST(l_quantity AS BIGINT) AS row_idx,
               make,
               CASE WHEN l_linenumber = 5 THEN concat('the ', model)
                    WHEN l_linenumber % 2 = 0 THEN split_part(model, ' ', 1)
                    WHEN l_linenumber % 3 = 0 THEN concat(model, ' GT')
                    ELSE model END AS model,
               CASE WHEN l_discount = 0.0 THEN 0 ELSE year - l_linenumber END AS year_start,
               CASE WHEN l_discount = 0.1 THEN NULL
                    ELSE year + CAST(l_quantity AS BIGINT) % 3 END AS year_end,
               CASE WHEN l_returnflag <> 'N' THEN displacement_l END AS displacement_l,
               CASE WHEN l_linestatus <> 'O' THEN induction END AS induction,
               cylinders,
               CASE WHEN l_tax > 0 THEN concat(CAST(l_partkey AS STRING), '-', CAST(l_suppkey AS STRING))
                 END AS part_number
        FROM lineitem JOIN b_catalog ON l_partkey = vehicle_id""",
    # Answers of a resolver for every line: one id that may fit and one that rarely does. Most
    # lines are matched already, so their answers are to be ignored.
    "b_decisions": """
        SELECT l_orderkey AS doc,
               CAST(l_linenumber AS BIGINT) * 1000000000000000000 + l_partkey * 1000000000
                 + l_suppkey * 100 + CAST(l_quantity AS BIGINT) AS row_idx,
               l_suppkey AS seq,
               CASE WHEN l_returnflag = 'A' THEN l_partkey + 1 ELSE l_partkey END AS id1,
               l_partkey + 25 AS id2,
               concat('line ', CAST(l_linenumber AS STRING)) AS rationale,
               l_discount * 10 AS confidence
        FROM lineitem""",
    "b_approvals": """
        SELECT o_orderkey AS doc,
               concat(CASE WHEN o_orderkey % 13 = 0 THEN 'bad ' ELSE 'D-' END,
                      CAST(o_orderkey % 900 AS STRING), '-', CAST(o_orderkey AS STRING)) AS eo_number,
               c_name AS manufacturer, c_mktsegment AS device_name,
               CASE o_orderpriority WHEN '1-URGENT' THEN 'intake' WHEN '2-HIGH' THEN 'boost'
                    WHEN '3-MEDIUM' THEN 'tune' WHEN '5-LOW' THEN 'other' END AS category,
               CASE WHEN o_orderkey % 50 = 0 THEN NULL WHEN o_orderkey % 51 = 0 THEN 'archived'
                    WHEN o_orderkey % 7 = 0 THEN 'discovered' WHEN o_orderkey % 7 = 1 THEN 'matching'
                    WHEN o_orderkey % 7 = 2 THEN 'needs_review' WHEN o_orderkey % 7 = 3 THEN 'failed'
                    WHEN o_orderkey % 7 = 4 THEN 'superseded' ELSE 'complete' END AS state,
               CASE WHEN o_orderkey % 5 = 1 THEN concat('http://docs.example.org/', CAST(o_orderkey AS STRING))
                    WHEN o_orderkey % 5 > 1 THEN concat('https://docs.example.org/', CAST(o_orderkey AS STRING))
                 END AS pdf_url,
               epoch_s(o_orderdate) AS first_seen,
               CAST(o_orderkey % 100 AS DOUBLE) / 100 AS confidence,
               CASE WHEN o_orderkey % 6 = 0 THEN 'superseded' END AS eo_status
        FROM orders JOIN customer ON o_custkey = c_custkey""",
    # Raw names, makes, engines and device texts in the many spellings documents use.
    "b_raw_text": """
        SELECT p_partkey,
               CASE p_partkey % 14 WHEN 0 THEN concat('F150 Pickup ', p_name)
                 WHEN 1 THEN concat(p_name, ' 2WD') WHEN 2 THEN concat(p_name, ' (', p_type, ')')
                 WHEN 3 THEN concat('F-150/', CAST(p_size * 10 AS STRING), '/350')
                 WHEN 4 THEN concat(p_name, ' GVWR>', CAST(p_size AS STRING), ' LBS')
                 WHEN 5 THEN concat(p_name, ' 2.7L V6') WHEN 6 THEN concat('K1500 ', p_name, ' 4x4')
                 WHEN 7 THEN concat(p_name, ' ', CAST(p_size AS STRING))
                 WHEN 8 THEN concat('Prelude / ', p_name, ' Coupe') WHEN 9 THEN concat('  ', p_name, '  ')
                 WHEN 10 THEN concat('Tundra 1500 Hybrid ', p_name) WHEN 11 THEN 'E250 Van'
                 WHEN 12 THEN concat(p_name, ' Plug-in Hybrid') ELSE concat('C2500/', p_name) END AS model_text,
               CASE p_partkey % 7 WHEN 0 THEN p_brand WHEN 1 THEN 'VW' WHEN 2 THEN 'Harley  Davidson'
                 WHEN 3 THEN concat(p_brand, '/Pontiac') WHEN 4 THEN 'chevy /  / GMC'
                 WHEN 5 THEN ' CAN-AM' ELSE concat(p_name, ' Works') END AS make_text,
               CASE p_partkey % 11 WHEN 0 THEN concat(CAST(p_size AS STRING), '.7L V8 Turbocharged')
                 WHEN 1 THEN '(460 CID) supercharged V-8' WHEN 2 THEN '350 CID carbureted 8 cyl'
                 WHEN 3 THEN 'up to 6.0L' WHEN 4 THEN '6-cylinder naturally aspirated 4.0 liter'
                 WHEN 5 THEN 'I4 non-turbo' WHEN 6 THEN 'V6 5.7-liter fuel injected'
                 WHEN 7 THEN concat(CAST(p_size + 100 AS STRING), '-cid') WHEN 8 THEN 'all engines'
                 WHEN 9 THEN '' END AS engine_text,
               concat(p_name, CASE p_partkey % 13 WHEN 0 THEN ' Cold Air kit' WHEN 1 THEN ' Turbocharger'
                 WHEN 2 THEN ' CATALYTIC converter' WHEN 3 THEN ' Shorty Headers' WHEN 4 THEN ' ECU remap'
                 WHEN 5 THEN ' ecu tuner' WHEN 6 THEN ' Fuel Injector rail' WHEN 7 THEN ' Coil pack'
                 WHEN 8 THEN ' intake manifold' WHEN 9 THEN ' air intake turbo kit' WHEN 10 THEN ' Programmer'
                 ELSE ' bracket' END) AS device_text,
               CASE p_partkey % 8 WHEN 0 THEN concat(' ', p_type, '-', CAST(p_size AS STRING), ' , ,X_', p_brand)
                 WHEN 1 THEN concat(p_name, ',', p_name) WHEN 2 THEN '3' WHEN 3 THEN '<PN>'
                 WHEN 4 THEN concat(p_name, p_name, p_name, p_name, p_name) ELSE CAST(p_partkey AS STRING)
                 END AS parts_text
        FROM part""",
    # Record JSON with the faults a loose producer makes.
    "b_record_json": """
        SELECT o_orderkey AS id,
               CASE WHEN o_orderkey % 23 = 0 THEN '{"eo_number": "D-1", "confi'
                    WHEN o_orderkey % 29 = 0 THEN '[1, 2]'
                    ELSE concat('{"eo_number":',
                 CASE o_orderkey % 17 WHEN 0 THEN 'null' WHEN 1 THEN '17'
                   ELSE concat('"D-', CAST(o_orderkey AS STRING), '"') END,
                 CASE o_orderkey % 7 WHEN 0 THEN ',"category":null' WHEN 1 THEN ',"category":"weird"' WHEN 2 THEN ''
                   ELSE ',"category":"boost"' END,
                 CASE o_orderkey % 19 WHEN 0 THEN ',"confidence":1.7' WHEN 1 THEN ',"confidence":"0.5"'
                   WHEN 2 THEN ',"confidence":"high"' WHEN 3 THEN '' WHEN 4 THEN ',"confidence":true'
                   ELSE concat(',"confidence":0.', CAST(o_orderkey % 90 + 10 AS STRING)) END,
                 CASE o_orderkey % 11 WHEN 0 THEN ',"fitment":[]'
                   WHEN 1 THEN ',"fitment":[{"year_start":"2001","induction":"NA"}]'
                   WHEN 2 THEN ',"fitment":[{"year_start":2000},{"year_start":2000.5}]'
                   WHEN 3 THEN ',"fitment":[{"induction":"DIESEL"}]' WHEN 4 THEN ',"fitment":{"a":1}'
                   WHEN 5 THEN ',"fitment":[{"year_start":2000.0,"cylinders":8,"extra":[1]}]'
                   WHEN 6 THEN ',"fitment":null' ELSE '' END,
                 CASE o_orderkey % 13 WHEN 0 THEN ',"part_numbers":["A1",2]' WHEN 1 THEN ',"part_numbers":"A1"'
                   WHEN 2 THEN ',"manufacturer":5' ELSE ',"part_numbers":["A1","B2"]' END,
                 '}') END AS payload
        FROM orders""",
    "b_corrections": """
        SELECT o_orderkey AS id,
               CASE o_orderkey % 5 WHEN 0 THEN '{"category":"tune"}' WHEN 1 THEN '{"category":null,"notes":"by hand"}'
                 WHEN 2 THEN '{"confidence":0.9,"eo_number":"D-9-9"}' WHEN 3 THEN '{"part_numbers":["Z9"]}' END AS corrections
        FROM orders""",
    # Output lines of a batch inference job, with the gaps such output has.
    "b_response_lines": """
        SELECT o_orderkey AS seq, concat('{"request":{"contents":[{"role":"user","parts":[{"text":"read"},',
                 CASE o_orderkey % 3 WHEN 0 THEN 'null,' WHEN 1 THEN '{"text":null,"fileData":null},' ELSE '' END,
                 '{"fileData":{"fileUri":"store://docs/pdfs/d-', CAST(o_custkey AS STRING),
                 '.pdf","mimeType":"application/pdf"}}]}]},"response":',
                 CASE o_orderkey % 8 WHEN 0 THEN 'null'
                   WHEN 1 THEN '{"candidates":[]}'
                   ELSE concat('{"candidates":[{"content":{"parts":[{"text":"',
                     replace(payload, '"', concat(chr(92), '"')), '"}]}',
                     CASE o_orderkey % 8 WHEN 2 THEN ',"finishReason":"MAX_TOKENS"' WHEN 3 THEN '' WHEN 4 THEN ',"finishReason":null'
                       ELSE ',"finishReason":"STOP"' END, '}]',
                     CASE o_orderkey % 6 WHEN 0 THEN '' ELSE concat(',"usageMetadata":{"promptTokenCount":',
                       CAST(o_orderkey % 5000 AS STRING), ',"candidatesTokenCount":', CAST(o_orderkey % 700 AS STRING), '}') END, '}')
                 END, '}') AS line,
               payload, o_custkey AS doc
        FROM orders JOIN b_record_json ON id = o_orderkey""",
    "b_items": """
        SELECT o_orderkey AS id, o_custkey AS doc,
               concat('run-', CAST(o_orderkey % 40 AS STRING)) AS run_id,
               CASE o_orderkey % 4 WHEN 0 THEN 'pending' WHEN 1 THEN 'in_progress'
                    WHEN 2 THEN 'failed' ELSE 'done' END AS status,
               CASE o_orderkey % 3 WHEN 0 THEN 'extract' WHEN 1 THEN 'review' ELSE 'complete' END AS stage,
               CAST(o_orderkey % 3 AS INT) AS attempts,
               CAST(floor(o_orderkey / 4) % 6 AS INT) AS heal_count,
               epoch_s(o_orderdate) AS created_at,
               epoch_s(o_orderdate) + o_orderkey % 2000 AS lease_expires,
               CASE floor(o_orderkey / 4) % 9 WHEN 0 THEN '429 RESOURCE_EXHAUSTED: slow down'
                    WHEN 1 THEN '400 INVALID_ARGUMENT. 1048576 tokens' WHEN 2 THEN '503 UNAVAILABLE'
                    WHEN 3 THEN 'Failed to load document (PDFium: Data format error)'
                    WHEN 4 THEN '400 RESOURCE_EXHAUSTED' WHEN 5 THEN 'DEADLINE_EXCEEDED while calling'
                    WHEN 6 THEN 'input has 1,048,577 tokens, max 1,048,576' WHEN 7 THEN ''
                 END AS last_error,
               o_totalprice / 100000 AS cost_usd
        FROM orders""",
    "b_runs": """
        SELECT c_custkey AS id,
               CASE c_mktsegment WHEN 'HOUSEHOLD' THEN 'scheduled' WHEN 'MACHINERY' THEN 'backfill'
                    WHEN 'BUILDING' THEN 'backfill-worker-3' WHEN 'FURNITURE' THEN 'batch-backfill'
                    ELSE 'manual' END AS trigger_kind,
               CAST(1700000000 + (c_custkey * 7919) % 1000003 AS DOUBLE) AS started_at,
               abs(c_acctbal) / 100 AS cost_usd
        FROM customer""",
    "b_events": """
        SELECT event_id, CAST(CAST(ts AS DATE) AS STRING) AS run_id,
               CASE WHEN event_id % 97 > 0 THEN user_id END AS doc,
               CASE event_type WHEN 'view' THEN 'scout' WHEN 'click' THEN 'extractor'
                    WHEN 'purchase' THEN 'auditor' WHEN 'signup' THEN 'matchmaker' ELSE 'healer' END AS agent,
               CASE WHEN event_id % 101 > 0 THEN epoch_s(ts) END AS ts,
               value / 1000 AS cost_usd,
               CAST(floor(value * 10) AS BIGINT) AS tok_in, CAST(floor(value) AS BIGINT) AS tok_out,
               CASE event_id % 13 WHEN 0 THEN 'reading' WHEN 1 THEN 'critiquing' WHEN 2 THEN 'resolving'
                    WHEN 3 THEN 'extracted' WHEN 4 THEN 'escalated' WHEN 5 THEN 'matched'
                    WHEN 6 THEN 'requeued_transient' WHEN 7 THEN 'heal_limit_reached'
                    WHEN 8 THEN 'discover_failed' WHEN 9 THEN 'failed_both_rungs'
                    WHEN 10 THEN 'resolver_output_invalid' WHEN 11 THEN 'resolver_hallucinated_ids'
                    ELSE 'discovered' END AS action,
               CAST(CASE WHEN event_id % 4 > 0 THEN event_id % 4 END AS INT) AS rung,
               CAST(CASE WHEN event_id % 5 > 0 THEN event_id % 5 END AS INT) AS ladder_step,
               CASE WHEN event_id % 3 > 0 THEN CAST(event_id % 100 AS DOUBLE) / 100 END AS confidence,
               CAST(CASE WHEN event_id % 7 > 0 THEN event_id % 50 END AS INT) AS n,
               CAST(CASE WHEN event_id % 2 > 0 THEN event_id % 6 END AS INT) AS resolved,
               CASE WHEN event_id % 3 > 0 THEN event_type END AS reason,
               CASE WHEN event_id % 4 > 0 THEN props END AS error
        FROM events""",
    "b_reviews": """
        SELECT conv_id * 100 + turn AS id, conv_id AS doc,
               CASE turn % 4 WHEN 0 THEN 'validation_failure' WHEN 1 THEN 'low_confidence'
                    WHEN 2 THEN 'legacy_divergence' ELSE 'qa_sample' END AS reason,
               text AS agent_notes,
               CASE (conv_id + turn) % 4 WHEN 0 THEN 'approved' WHEN 1 THEN 'rejected' ELSE 'open' END AS status,
               CAST(1700000000 + (conv_id % 50) * 60 AS DOUBLE) AS created_at,
               CASE WHEN (conv_id + turn) % 4 < 2 THEN CAST(1700003600 + (conv_id * 37) % 1009 AS DOUBLE)
                 END AS resolved_at
        FROM conversations""",
    "b_matches": """
        SELECT l_orderkey AS doc, l_partkey AS vehicle_id,
               CASE l_returnflag WHEN 'A' THEN 'exact' WHEN 'R' THEN 'medium' ELSE 'generic' END AS tier,
               concat(CAST(l_suppkey AS STRING), '-K') AS pn1, concat('S', CAST(l_linenumber AS STRING)) AS pn2,
               CASE WHEN l_linenumber = 1 THEN NULL WHEN l_linenumber = 2 THEN 'header'
                    WHEN l_linenumber = 3 THEN 'other' WHEN l_linenumber = 4 THEN 'intake'
                    ELSE 'boost' END AS category,
               concat('device ', CAST(l_linenumber AS STRING)) AS device_name,
               concat('maker ', CAST(l_suppkey % 10 AS STRING)) AS manufacturer
        FROM lineitem""",
    # A catalog in the terms of the records: one vehicle per document.
    "b_doc_catalog": """
        SELECT doc_id AS vehicle_id, CAST(1880 + length(text) % 170 AS INT) AS year, lang AS make,
               split_part(text, ' ', 1) AS model, CAST(length(text) % 60 AS DOUBLE) / 10 AS displacement_l,
               CASE WHEN length(text) % 2 = 0 THEN 'NA' END AS induction,
               CAST(4 + length(text) % 3 AS INT) AS cylinders
        FROM documents""",
    # What a daily run works on: approvals that wait, each with a record, and the record's rows numbered as they stand in it.
    "b_run_records": """
        SELECT doc, eo_number AS doc_key, CASE WHEN doc % 17 = 0 THEN concat('X-', CAST(doc AS STRING)) ELSE eo_number END AS eo_number,
               manufacturer, device_name, category, CAST(55 + doc % 45 AS DOUBLE) / 100 AS confidence,
               CAST(doc * 7919 % 1000 AS DOUBLE) / 1000 AS draw, first_seen
        FROM b_approvals WHERE state IN ('discovered', 'matching')""",
    "b_run_rows": """
        SELECT r.doc, r.row_idx AS rid, row_number() OVER (PARTITION BY r.doc ORDER BY r.row_idx) - 1 AS row_idx,
               r.make, r.model, r.year_start, r.year_end, r.displacement_l, r.induction, r.cylinders, r.part_number
        FROM b_app_rows r JOIN b_run_records n ON n.doc = r.doc""",
    # Most documents replace the one forty places before them: chains of many lengths. Some replace another one too, so that ways
    # part and meet again, and some pairs replace each other.
    "b_edges": """
        SELECT doc_id AS doc, CASE WHEN doc_id % 6 > 0 AND doc_id >= 40 THEN doc_id - 40 END AS prev FROM documents
        UNION ALL SELECT doc_id, doc_id - 80 FROM documents WHERE doc_id % 10 = 3 AND doc_id >= 80
        UNION ALL SELECT doc_id, doc_id + 40 FROM documents WHERE doc_id % 97 = 5""",
}

_SPARK_ONLY = {
    # One record per document; one row per line of its text.
    "b_records": r"""
        SELECT doc_id AS doc, lang, source, n_chars,
               CASE WHEN doc_id % 11 = 0 THEN concat('x_', doc_id)
                    ELSE concat('D-', doc_id % 1000, '-', doc_id) END AS eo_number,
               CASE WHEN doc_id % 9 > 0 THEN source END AS manufacturer,
               CASE doc_id % 5 WHEN 0 THEN NULL WHEN 1 THEN 'intake' WHEN 2 THEN 'boost'
                    WHEN 3 THEN 'tune' ELSE 'other' END AS category,
               concat('device ', lang) AS device_name,
               CAST(doc_id * 37 % 100 AS DOUBLE) / 100 AS confidence,
               CAST(doc_id * 7919 % 1000 AS DOUBLE) / 1000 AS draw,
               array_distinct(split(text, '[ \\n]+')) AS part_numbers,
               transform(split(text, '\\n'), line -> named_struct(
                 'part_numbers', split(line, ' '),
                 'year_start', 1880 + length(line) % 170,
                 'year_end', 1880 + length(line) % 170 + length(split_part(line, ' ', 1)) % 5 - 1,
                 'make', lang, 'model', split_part(line, ' ', 1), 'trim_note', CAST(NULL AS STRING),
                 'displacement_l', CAST(length(line) % 60 AS DOUBLE) / 10,
                 'induction', CASE WHEN length(line) % 2 = 0 THEN 'NA' END,
                 'cylinders', CAST(4 + length(line) % 3 AS INT))) AS fitment
        FROM documents""",
}

_DUCK_ONLY = {
    "b_records": r"""
        SELECT doc_id AS doc, lang, source, n_chars,
               CASE WHEN doc_id % 11 = 0 THEN concat('x_', doc_id)
                    ELSE concat('D-', doc_id % 1000, '-', doc_id) END AS eo_number,
               CASE WHEN doc_id % 9 > 0 THEN source END AS manufacturer,
               CASE doc_id % 5 WHEN 0 THEN NULL WHEN 1 THEN 'intake' WHEN 2 THEN 'boost'
                    WHEN 3 THEN 'tune' ELSE 'other' END AS category,
               concat('device ', lang) AS device_name,
               CAST(doc_id * 37 % 100 AS DOUBLE) / 100 AS confidence,
               CAST(doc_id * 7919 % 1000 AS DOUBLE) / 1000 AS draw,
               list_distinct(string_split_regex(text, '[ \n]+')) AS part_numbers,
               string_split(text, chr(10)) AS lines
        FROM documents""",
    "b_record_rows": r"""
        SELECT doc, pos, string_split(line, ' ') AS part_numbers,
               1880 + length(line) % 170 AS year_start,
               1880 + length(line) % 170 + length(split_part(line, ' ', 1)) % 5 - 1 AS year_end,
               lang AS make, split_part(line, ' ', 1) AS model,
               CAST(length(line) % 60 AS DOUBLE) / 10 AS displacement_l,
               CASE WHEN length(line) % 2 = 0 THEN 'NA' END AS induction,
               4 + length(line) % 3 AS cylinders
        FROM (SELECT doc, lang, generate_subscripts(lines, 1) - 1 AS pos, unnest(lines) AS line
              FROM b_records)""",
}

_EPOCH = re.compile(r"epoch_s\((\w+)\)")
DUCK_VIEWS = {k: _EPOCH.sub(r"epoch(\1)", s) for k, s in SHARED_VIEWS.items()} | _DUCK_ONLY
# On Spark the views that build and parse JSON per order start on all cores.
_WIDE = {"b_record_json", "b_response_lines"}
SPARK_VIEWS = {
    k: _EPOCH.sub(r"(CAST(unix_micros(CAST(\1 AS TIMESTAMP)) AS DOUBLE) / 1e6)", s)
    for k, s in SHARED_VIEWS.items()
} | _SPARK_ONLY
SPARK_VIEWS |= {k: SPARK_VIEWS[k].replace("FROM orders", "FROM orders_spread") for k in _WIDE}


class Tables:
    """Tables of one data folder and the views over them, as lazy DataFrames."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")
        self._made: dict[str, DataFrame] = {}
        spark.conf.set("spark.sql.session.timeZone", "UTC")

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in self._made:
            if name.endswith("_spread"):
                self._made[name] = spread(getattr(self, name.removesuffix("_spread")))
            elif name in TABLES:
                scan = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
                self._made[name] = spread(scan) if name in HEAVY else scan
            elif name in SPARK_VIEWS:
                self._made[name] = self.sql(SPARK_VIEWS[name])
            else:
                raise AttributeError(name)
        return self._made[name]

    def over(self, view: str, **tables: DataFrame) -> DataFrame:
        """A view over other inputs, such as a stream in place of a table."""
        other = Tables(self.spark, self.sf_dir)
        other._made.update(tables)
        return getattr(other, view)

    def sql(self, text: str) -> DataFrame:
        """Spark SQL over tables and views named in FROM and JOIN clauses."""
        used: dict[str, DataFrame] = {}

        def place(m: re.Match) -> str:
            used[m.group(2)] = getattr(self, m.group(2))
            return f"{m.group(1)} {{{m.group(2)}}}"

        names = "|".join([*TABLES, "orders_spread", *SPARK_VIEWS])
        body = text.replace("{", "{{").replace("}", "}}")
        body = re.sub(rf"\b(FROM|JOIN)\s+({names})\b", place, body)
        return self.spark.sql(body, **used)
