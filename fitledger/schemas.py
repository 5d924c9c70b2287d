"""Fixed schemas. Nothing in the library infers a schema from data."""

from __future__ import annotations

# Field names of a record and of its application rows.
TEXT_FIELDS = ["issue_date", "manufacturer", "device_name", "description", "notes"]
ROW_INTS = ["year_start", "year_end", "cylinders"]
ROW_TEXTS = ["make", "model", "trim_note"]

APPLICATION_ROW = ("part_numbers ARRAY<STRING>, year_start INT, year_end INT, make STRING, model STRING, "
                   "trim_note STRING, displacement_l DOUBLE, induction STRING, cylinders INT")

RECORD = ("eo_number STRING, issue_date STRING, manufacturer STRING, device_name STRING, category STRING, "
          "description STRING, supersedes ARRAY<STRING>, part_numbers ARRAY<STRING>, "
          f"fitment ARRAY<STRUCT<{APPLICATION_ROW.replace(' ARRAY', ': ARRAY').replace(' INT', ': INT').replace(' STRING', ': STRING').replace(' DOUBLE', ': DOUBLE')}>>, "
          "confidence DOUBLE, sections_confidence MAP<STRING, DOUBLE>, illegible_pages ARRAY<INT>, notes STRING")

BASELINE = ("_doc_id STRING, device_name STRING, manufacturer STRING, category STRING, "
            "part_numbers ARRAY<STRING>, fitment_count INT")

CATALOG = ("vehicle_id STRING, year INT, make STRING, model STRING, trim STRING, displacement_l DOUBLE, "
           "induction STRING, cylinders INT")

APPROVALS = ("eo_number STRING, state STRING, pdf_url STRING, gcs_uri STRING, sha256 STRING, first_seen DOUBLE, "
             "device_name STRING, manufacturer STRING, category STRING, part_numbers ARRAY<STRING>, "
             "supersedes ARRAY<STRING>, superseded_by STRING, confidence DOUBLE, audited_at DOUBLE, match_count INT")

MATCHES = ("vehicle_id STRING, eo_number STRING, tier STRING, method STRING, part_numbers ARRAY<STRING>, "
           "category STRING, device_name STRING, manufacturer STRING, rationale STRING")

WORK_ITEMS = ("id STRING, eo_number STRING, run_id STRING, status STRING, stage STRING, attempts INT, "
              "lease_expires DOUBLE, created_at DOUBLE, worker STRING, last_error STRING, heal_count INT")

REVIEWS = ("id STRING, eo_number STRING, reason STRING, agent_notes STRING, payload STRING, status STRING, "
           "created_at DOUBLE, resolved_at DOUBLE")

RUNS = ("id STRING, trigger STRING, status STRING, started_at DOUBLE, finished_at DOUBLE, cost_usd DOUBLE, "
        "tok_in BIGINT, tok_out BIGINT, new_eos INT, completed INT, needs_review INT, failed INT, healed INT, "
        "refetched INT, time_capped BOOLEAN")

RUN_EVENTS = ("run_id STRING, ts DOUBLE, agent STRING, action STRING, eo STRING, rung INT, ladder_step INT, "
              "confidence DOUBLE, count INT, gemini_resolved INT, reason STRING, error STRING, "
              "removed INT, model_read STRING, fitment_index INT")
