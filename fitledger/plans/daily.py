"""The daily run as one batch over all records: audit, match and write the tables.

No step handles one record at a time. The records are expected as extracted; a caller's model
may have produced them between sources.inference.request_lines and read_responses.

``audited`` and what matching finds are written once under the run's folder and read by all outputs. The
tables of ``DailyTables`` are changed by key, so a run touches the buckets of its documents and of the approvals they
supersede, and leaves all other files alone. A run can be repeated: all its changes are by key.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import quality as Q
from ..operators import records as R
from ..session import dimension_join, fits_broadcast
from ..sources.tables import BUCKETS, CODEC, KeyedTable, append_run, read_runs
from .matching_run import EVENT, REVIEW, Matched, event, match_documents

# Fields of a record that a correction may change; ``notes`` of the audited rows are those of the verdict.
RECORD_FIELDS = ["eo_number", "confidence", "category", "part_numbers", "fitment", "issue_date", "manufacturer",
                 "device_name", "description", "supersedes", "sections_confidence", "illegible_pages"]


def route(records: DataFrame, baseline: DataFrame) -> DataFrame:
    """records with ``issues``, ``div`` and ``reason``.

    records: doc, draw, the record fields. baseline: doc, part_numbers, fitment_count
    """
    base = baseline.select("doc", F.col("part_numbers").alias("_bp"), F.col("fitment_count").alias("_bn"),
                           F.lit(True).alias("_base"))
    # rules and row counts come before the join: a reader of the verdict alone has no row array shuffled
    judged = records.withColumns({
        "issues": Q.gate_issues(F.col("eo_number"), F.col("fitment"), F.col("part_numbers"), F.col("category")),
        "_n": F.size("fitment")})
    scored = judged.join(base, "doc", "left").withColumn("div", Q.divergence(
        F.col("part_numbers"), F.col("_n"), F.col("_bp"), F.col("_bn"), F.coalesce("_base", F.lit(False)))).drop("_n", "_bp", "_bn", "_base")
    return scored.withColumn("reason", Q.route_reason(
        F.col("issues"), F.col("div"), F.col("confidence"), F.col("draw")))


def audit(routed: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Routed records with ``outcome``, ``final_reason``, ``notes`` and the record as corrected.

    Only records sent for a second look with verdict ``fix`` are taken apart as JSON. Every record
    field that ``routed`` has takes over its correction. ``before`` is the record as it was, as JSON, where a correction was
    taken over and the record is not accepted all the same; else null.
    verdicts: doc, verdict, corrections (JSON text), reasons
    """
    fields = [f for f in RECORD_FIELDS if f in routed.columns]
    judged = routed.join(verdicts, "doc", "left")
    needs_fix = F.col("reason").isNotNull() & (F.col("verdict") == "fix")
    value = F.parse_json(F.to_json(F.struct(*fields)))
    fixed = R.apply_corrections(judged.withColumn("value", F.when(needs_fix, value)))
    rec = fixed.withColumn("_r", R.typed_record("value")).withColumn("fix_valid", F.col("valid"))
    rec = rec.withColumn("fix_issues", Q.gate_issues(
        F.col("_r.eo_number"), F.col("_r.fitment"), F.col("_r.part_numbers"), F.col("_r.category")))
    out = Q.resolve_verdicts(rec)
    take = (F.col("verdict") == "fix") & F.col("reason").isNotNull() & F.col("fix_valid")
    before = F.when(take & (F.col("outcome") != "accepted"), F.to_json(F.struct(*fields)))
    return out.withColumns({"before": before} | {f: F.when(take, F.col(f"_r.{f}")).otherwise(F.col(f)) for f in fields}).drop(
        "_r", "value", "merged_json", "faults", "valid", "fix_valid", "fix_issues", "corrections")


APPROVALS = ("doc BIGINT, eo_number STRING, state STRING, first_seen DOUBLE, device_name STRING, manufacturer STRING, category STRING, "
             "part_numbers ARRAY<STRING>, supersedes ARRAY<STRING>, superseded_by BIGINT, confidence DOUBLE, audited_at DOUBLE, match_count BIGINT")
MATCHES = ("doc BIGINT, vehicle_id BIGINT, tier STRING, method STRING, part_numbers ARRAY<STRING>, category STRING, "
           "device_name STRING, manufacturer STRING, rationale STRING")
MEMBERS = "class_id STRING, vehicle_ids ARRAY<BIGINT>"
EXTRACTIONS = "doc BIGINT, version INT, payload STRING, created_at DOUBLE"
REVIEWS = f"id STRING, {REVIEW}, status STRING, created_at DOUBLE, resolved_at DOUBLE"


class MatchTable(KeyedTable):
    """Matches by document. A match holds for all vehicles of a class alike, so it is stored once, with the ``class_id`` and the
    ``listing`` that tells which vehicles these are; ``read`` gives a row per vehicle. A match of one vehicle alone has neither.

    A listing holds all classes of a catalog and is named by a digest of its content: runs over one catalog share it, and one that is
    named by stored matches never changes.
    """

    def __init__(self, spark: SparkSession, root: str, buckets: int):
        super().__init__(spark, f"{root}/matches", f"{MATCHES}, listing STRING, class_id STRING", buckets=buckets)
        self.listings = f"{root}/listings"

    def create(self, rows: DataFrame) -> None:
        self.spark.createDataFrame([], f"{MEMBERS}, listing STRING").write.mode("overwrite").partitionBy("listing").parquet(self.listings)
        super().create(rows)

    def members(self) -> DataFrame:
        """class_id, vehicle_ids and listing."""
        return read_runs(self.spark, self.listings, MEMBERS, "listing")

    def add_members(self, members: DataFrame) -> None:
        append_run(members, self.listings, "listing")

    def list_classes(self, classes: DataFrame) -> str:
        """Stores the members of ``classes`` and gives the name of their listing."""
        members = classes.select("class_id", F.sort_array(F.transform("_ids", lambda e: e["vehicle_id"].cast("bigint"))).alias("vehicle_ids"))
        one = F.sha2(F.concat_ws(":", "class_id", F.array_join("vehicle_ids", ",", "null")), 256)
        # sums do not depend on the order of the classes; 60 bits of a digest each, so they are exact
        sums = [F.sum(F.conv(F.substring(one, 15 * i + 1, 15), 16, 10).cast("decimal(20,0)")) for i in range(4)]
        listing = hashlib.sha256(str(tuple(members.agg(F.count("*"), *sums).first())).encode()).hexdigest()
        self.add_members(members.withColumn("listing", F.lit(listing)))
        return listing

    def written_out(self, folded: DataFrame) -> DataFrame:
        """Rows of ``stored``, or some columns of them, with a row per vehicle."""
        members = self.members()
        kept = [c for c in folded.columns if c not in ("listing", "class_id")]
        found = dimension_join(folded, members, ["listing", "class_id"], ["doc"], fits_broadcast(members), "left")
        out = found.withColumn("_v", F.explode(F.coalesce("vehicle_ids", F.array("vehicle_id"))))
        return out.select(*(F.col("_v").alias(c) if c == "vehicle_id" else c for c in kept))

    def read(self, buckets: list[int] | None = None) -> DataFrame:
        return self.written_out(self.stored(buckets))


class DailyTables:
    """The tables that runs change, under one folder that driver and executors share."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS):
        self.spark, self.root = spark, root.rstrip("/")
        self.approvals = KeyedTable(spark, f"{self.root}/approvals", APPROVALS, buckets=buckets)
        self.matches = MatchTable(spark, self.root, buckets)
        self.extractions = KeyedTable(spark, f"{self.root}/extractions", EXTRACTIONS, buckets=buckets)
        self.reviews = KeyedTable(spark, f"{self.root}/reviews", REVIEWS, buckets=buckets)

    def create(self, **rows: DataFrame) -> None:
        """First rows of the tables; columns that are not given are null, tables that are not given are empty."""
        for name in ("approvals", "matches", "extractions", "reviews"):
            table = getattr(self, name)
            empty = self.spark.createDataFrame([], table.schema)
            table.create(empty.unionByName(rows[name], allowMissingColumns=True) if name in rows else empty)

    def keep(self, run_id: str) -> Callable[[DataFrame, str], DataFrame]:
        """Writes a table of a run and reads it back."""
        def write(df: DataFrame, name: str) -> DataFrame:
            path = f"{self.root}/runs/{run_id}/{name}"
            df.write.mode("overwrite").option("compression", CODEC).parquet(path)
            return self.spark.read.schema(df.schema).parquet(path)
        return write

    def add_events(self, events: DataFrame, run_id: str) -> None:
        append_run(events.withColumn("run_id", F.lit(run_id)), f"{self.root}/events")

    def events(self) -> DataFrame:
        return read_runs(self.spark, f"{self.root}/events", EVENT)

    def add_reviews(self, reviews: DataFrame, docs: DataFrame, run_id: str, now: float) -> None:
        """Opens reviews of a run's ``docs``. Their ids are made of run and source, so a repeated run does not open them twice."""
        new = reviews.select(F.concat_ws("-", F.lit(run_id), "doc", "source").alias("id"), *reviews.columns, F.lit("open").alias("status"),
                             F.lit(now).alias("created_at"), F.lit(None).cast("double").alias("resolved_at"))
        buckets = self.reviews.touched(docs)
        old = self.reviews.read(buckets).join(docs.select("doc"), "doc", "left_semi").join(new.select("id"), "id", "left_anti")
        self.reviews.replace(docs, old.unionByName(new))

    def store_matches(self, done: Matched) -> None:
        """Every document that was matched loses its old matches, also when it has no new ones."""
        listing = self.matches.list_classes(done.classes)
        self.matches.replace(done.totals, done.matches.withColumns({
            "vehicle_id": F.col("vehicle_id").cast("bigint"), "listing": F.when(F.col("class_id").isNotNull(), listing)}))


def audited_records(records: DataFrame, baseline: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Identity, repeated rows, rules, routing and second opinions in one pass over the records.

    records: doc, doc_key (the number the document was asked for by), draw and the record fields.
    """
    return audit(route(Q.with_deduped_rows(Q.fix_identity(records)), baseline), verdicts)


def stored_record(audited: DataFrame) -> Column:
    """The record as it goes into the extraction: corrections of records that were not accepted stay out of it."""
    return F.coalesce("before", F.to_json(F.struct(*[f for f in RECORD_FIELDS if f in audited.columns])))


def audit_events(audited: DataFrame) -> DataFrame:
    """Events of the audit, several a record, without a shuffle."""
    agent, accepted = "auditor", F.col("outcome") == "accepted"
    found = F.array_compact(F.array(
        F.when(F.col("key_corrected"), event(agent, "eo_number_corrected_from_identity", model_read=F.col("key_read"))),
        F.when(F.col("removed") > 0, event(agent, "deduped_rows", removed=F.col("removed"))),
        F.when(F.col("reason").isNotNull(), event(agent, "critiquing")),
        F.when(accepted, event(agent, "accepted")).otherwise(event(agent, "escalated", reason=F.col("final_reason")))))
    return audited.select("doc", F.explode(found).alias("e")).select("doc", "e.*")


def superseded(accepted: DataFrame, tables: DailyTables) -> DataFrame:
    """(doc, heir) of known approvals that accepted ones name as predecessors; of several heirs the greatest one counts."""
    named = accepted.select(F.explode("supersedes").alias("_old"), F.col("doc").alias("_new"))
    heirs = named.groupBy(F.col("_old").cast("bigint").alias("doc")).agg(F.max("_new").alias("heir")).filter("doc IS NOT NULL")
    known = tables.approvals.read(tables.approvals.touched(heirs)).select("doc")
    return heirs.join(known, "doc", "left_semi")


def approval_changes(audited: DataFrame, totals: DataFrame, heirs: DataFrame, now: float) -> DataFrame:
    """One row per approval that changes, with a flag for every column that does."""
    accepted = F.col("outcome") == "accepted"
    taken = ["device_name", "manufacturer", "category", "part_numbers", "supersedes", "confidence"]
    own = audited.join(totals.select("doc", "match_count"), "doc", "left").select(
        "doc", accepted.alias("_accepted"), *taken, "match_count").join(heirs, "doc", "full_outer")
    old = F.col("heir").isNotNull()
    state = F.when(old, "superseded").when(F.col("_accepted"), "complete").otherwise("needs_review")
    done = F.coalesce("_accepted", F.lit(False))
    return own.select("doc", *taken, "match_count", state.alias("state"), F.lit(now).alias("audited_at"), F.col("heir").alias("superseded_by"),
                      *(done.alias(f"has_{c}") for c in [*taken, "match_count", "audited_at"]),
                      F.lit(True).alias("has_state"), old.alias("has_superseded_by"))


def run_batch(tables: DailyTables, records: DataFrame, baseline: DataFrame, catalog: DataFrame, verdicts: DataFrame,
              decisions: DataFrame, invalid: DataFrame, run_id: str, now: float) -> None:
    """One daily run: records to audited records, matches, reviews, approvals and events.

    decisions and invalid are a resolver's answers, as in ``match_documents``. An accepted record's approval is complete and an
    escalated one's needs review; an approval that an accepted one names is superseded, whatever became of it in
    this run, so the outcome does not depend on the order of the records.
    """
    keep = tables.keep(run_id)
    # the last stored version is joined to the records where they are shuffled for the audit, so payloads need no join of their own
    known = records.join(last_versions(tables.extractions.read()), "doc", "left")
    audited = keep(audited_records(known, baseline, verdicts), "audited")
    accepted = audited.filter(F.col("outcome") == "accepted")
    escalated = audited.filter(F.col("outcome") == "escalated")
    done = match_documents(accepted.select("doc", "part_numbers", "category", "device_name", "manufacturer", "fitment"), catalog, decisions, invalid, keep)
    totals = keep(done.totals, "totals")
    heirs = keep(superseded(accepted, tables), "superseded")

    fields = [f for f in RECORD_FIELDS if f in audited.columns]
    opened = escalated.select("doc", F.lit("audit").alias("source"), F.col("final_reason").alias("reason"), F.col("notes").alias("agent_notes"),
                              F.to_json(F.struct(*fields)).alias("payload"))
    tables.store_matches(Matched(done.matches, done.classes, totals, done.reviews, done.events))
    tables.add_reviews(opened.unionByName(done.reviews), audited, run_id, now)
    ended = F.coalesce(F.col("version") >= F.col("_last"), F.lit(True))
    tables.extractions.replace(audited.select("doc", "_last"), updated_extractions(audited, now), ended)
    tables.approvals.upsert(approval_changes(audited, totals, heirs, now))
    tables.add_events(audit_events(audited).unionByName(done.events), run_id)


def last_versions(versions: DataFrame) -> DataFrame:
    """doc, ``_last`` (its last stored version) and ``_made`` (when that was created; several times if it is stored several times)."""
    made = F.collect_list(F.struct("version", "created_at"))
    return versions.filter("doc IS NOT NULL").groupBy("doc").agg(F.max("version").alias("_last"), made.alias("_all")).select(
        "doc", "_last", F.transform(F.filter("_all", lambda e: e["version"] == F.col("_last")), lambda e: e["created_at"]).alias("_made"))


def updated_extractions(audited: DataFrame, now: float) -> DataFrame:
    """The last version of every audited document with its new payload; a document without any gets its first."""
    made = F.when(F.size("_made") > 0, F.col("_made")).otherwise(F.array(F.lit(None).cast("double")))
    return audited.select("doc", F.coalesce("_last", F.lit(1)).alias("version"), stored_record(audited).alias("payload"), F.explode(made).alias("_at")).select(
        "doc", "version", "payload", F.coalesce("_at", F.lit(now)).alias("created_at"))
