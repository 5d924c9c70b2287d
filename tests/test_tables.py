"""Keyed tables, the daily run on a small set of records, and decisions about its reviews."""

import glob
import json
import os

import pytest
from pyspark.sql import functions as F

from fitledger.operators import matching as M
from fitledger.plans import daily, review
from fitledger.plans.matching_run import Matched
from fitledger.schemas import APPLICATION_ROW
from fitledger.sources.tables import KeyedTable

FITMENT = f"array<struct<{APPLICATION_ROW.replace(' ARRAY', ': ARRAY').replace(' INT', ': INT').replace(' STRING', ': STRING').replace(' DOUBLE', ': DOUBLE')}>>"


def files(folder):
    return {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{folder}/**/*.parquet", recursive=True)}


def bucket_of(path):
    return int(path.split("bucket=")[1].split("/")[0])


@pytest.fixture()
def table(spark, tmp_path):
    t = KeyedTable(spark, str(tmp_path / "t"), "doc BIGINT, a STRING, b INT", buckets=8)
    t.create(spark.createDataFrame([(i, f"a{i}", i) for i in range(100)], t.schema))
    return t


def rows(t):
    return sorted(map(tuple, t.read().collect()))


def test_replace_touches_only_its_buckets(spark, table):
    before = files(table.path)
    keys = spark.createDataFrame([(3,), (500,)], "doc bigint")
    touched = table.replace(keys, spark.createDataFrame([(3, "new", 0), (3, "new", 1)], table.schema))
    after = files(table.path)
    assert 1 <= len(touched) <= 2
    assert {f for f in before if bucket_of(f) not in touched} == {f for f in after if bucket_of(f) not in touched}
    assert all(before[f] == after[f] for f in before if bucket_of(f) not in touched)
    assert rows(table) == sorted([(i, f"a{i}", i) for i in range(100) if i != 3] + [(3, "new", 0), (3, "new", 1)])


def test_last_row_of_a_bucket_goes(spark, table):
    table.replace(spark.range(100).select(F.col("id").alias("doc")), spark.createDataFrame([], table.schema))
    assert rows(table) == []
    table.upsert(spark.createDataFrame([(7, "back")], "doc bigint, a string"))
    assert rows(table) == [(7, "back", None)]


def test_upsert_changes_flagged_columns_only(spark, table):
    changes = spark.createDataFrame([(1, "x", None, True, True), (2, "y", 5, False, True), (200, "z", 9, True, False)], "doc bigint, a string, b int, has_a boolean, has_b boolean")
    table.upsert(changes)
    found = {r[0]: r[1:] for r in rows(table)}
    assert found[1] == ("x", None) and found[2] == ("a2", 5) and found[200] == ("z", None) and found[3] == ("a3", 3)


def test_upsert_refuses_repeated_keys(spark, table):
    before = files(table.path)
    with pytest.raises(Exception, match="repeats"):
        table.upsert(spark.createDataFrame([(1, "x"), (1, "y")], "doc bigint, a string"))
    assert files(table.path) == before


def test_no_keys_no_write(spark, table):
    before = files(table.path)
    assert table.replace(spark.createDataFrame([], "doc bigint"), spark.createDataFrame([], table.schema)) == []
    assert files(table.path) == before


def record(doc, number, model, category="boost", confidence=0.9, twice=False, supersedes=()):
    row = (["R1"], 2000, 2001, "Ford", model, None, 2.0, "NA", 4)
    return (doc, f"D-{doc}", number, "maker", "device", category, confidence, 0.5, ["P1"], list(supersedes), [row, row] if twice else [row])


RECORD = ("doc bigint, doc_key string, eo_number string, manufacturer string, device_name string, category string, confidence double, draw double, "
          f"part_numbers array<string>, supersedes array<string>, fitment {FITMENT}")


@pytest.fixture()
def run(spark, tmp_path):
    """Four records: accepted, accepted in spite of a misread number and repeated rows, escalated, and one without a match."""
    tables = daily.DailyTables(spark, str(tmp_path / "daily"), buckets=8)
    approvals = spark.createDataFrame([(i, "discovered") for i in range(1, 40)], "doc bigint, state string")
    old = spark.createDataFrame([(i, 99, "exact") for i in range(1, 40)], "doc bigint, vehicle_id bigint, tier string")
    tables.create(approvals=approvals, matches=old)
    records = spark.createDataFrame([record(1, "D-1", "Ranger"), record(2, "X-9", "Ranger XL", twice=True, supersedes=("1", "30", "777")),
                                     record(3, "D-3", "Ranger", category=None), record(4, "D-4", "Focus")], RECORD)
    catalog = spark.createDataFrame([(10, 2000, "Ford", "Ranger", 2.0, "NA", 4), (11, 2001, "ford", "Ranger", 2.1, "TURBO", 4)],
                                    "vehicle_id bigint, year int, make string, model string, displacement_l double, induction string, cylinders int")
    answers = spark.createDataFrame([(4, 0, 1, [11], "same car", 0.9), (4, 0, 2, [55], "made up", 0.9), (4, 0, 3, [10], "not sure", 0.2), (1, 0, 4, [11], "not asked", 0.9)],
                                    "doc bigint, row_idx bigint, seq bigint, vehicle_ids array<bigint>, rationale string, confidence double")
    given = {"records": records, "baseline": spark.createDataFrame([], "doc bigint, part_numbers array<string>, fitment_count int"), "catalog": catalog,
             "verdicts": spark.createDataFrame([], "doc bigint, verdict string, corrections string, reasons array<string>"), "decisions": answers,
             "invalid": spark.createDataFrame([], "doc bigint")}
    daily.run_batch(tables, run_id="r1", now=5.0, **given)
    return tables, given


def state(tables):
    return {name: sorted(map(str, getattr(tables, name).read().collect())) for name in ("approvals", "matches", "reviews", "extractions")} | {
        "events": sorted(map(str, tables.events().collect()))}


def test_daily_run(spark, run):
    tables, given = run
    approvals = {r.doc: r for r in tables.approvals.read().collect()}
    assert [approvals[i].state for i in (1, 2, 3, 4, 30, 31)] == ["superseded", "complete", "needs_review", "complete", "superseded", "discovered"]
    assert (approvals[1].superseded_by, approvals[1].match_count, approvals[30].superseded_by, approvals[30].match_count) == (2, 2, 2, None) and 777 not in approvals
    matches = {(r.doc, r.vehicle_id): r for r in tables.matches.read().collect()}
    assert {k: matches[k].tier for k in matches if k[0] < 5} == {(1, 10): "exact", (1, 11): "medium", (2, 10): "exact", (2, 11): "medium", (3, 99): "exact", (4, 11): "generic"}
    assert matches[4, 11].rationale == "same car" and matches[4, 11].method == "gemini_resolved" and (31, 99) in matches
    events = [(r.doc, r.action, r.removed, r["count"], r.fitment_index) for r in tables.events().orderBy("doc", "action").collect()]
    assert events == [(1, "accepted", None, None, None), (1, "matched", None, 2, None), (2, "accepted", None, None, None), (2, "deduped_rows", 1, None, None),
                      (2, "eo_number_corrected_from_identity", None, None, None), (2, "matched", None, 2, None), (3, "critiquing", None, None, None),
                      (3, "escalated", None, None, None), (4, "accepted", None, None, None), (4, "matched", None, 1, None), (4, "resolver_hallucinated_ids", None, None, 0),
                      (4, "resolving", None, 1, None)]
    reviews = {r.doc: r for r in tables.reviews.read().collect()}
    assert sorted(reviews) == [3, 4] and json.loads(reviews[4].payload)["proposed_vehicle_ids"] == [10] and json.loads(reviews[4].payload)["fitment"]["model"] == "Focus"
    once = state(tables)
    before = files(tables.root)
    daily.run_batch(tables, run_id="r1", now=5.0, **given)
    assert state(tables) == once
    # files of buckets without a document of the run
    kept = [f for f in before if "/matches/" in f and bucket_of(f) not in tables.matches.touched(given["records"])]
    assert kept and all(files(tables.root)[f] == before[f] for f in kept)


def test_unread_resolver_output(spark, run):
    tables, given = run
    daily.run_batch(tables, run_id="r2", now=6.0, **(given | {"invalid": spark.createDataFrame([(4,), (1,)], "doc bigint")}))
    assert [(r.id, json.loads(r.payload)) for r in tables.reviews.read().filter("id LIKE 'r2%' AND doc <> 3").collect()] == [("r2-4-resolver", {"unresolved_count": 1})]
    assert [r.doc for r in tables.events().filter("action = 'resolver_output_invalid'").collect()] == [4]
    assert tables.matches.read().filter("doc = 4").count() == 0


def decide(spark, run, rows):
    tables, given = run
    decisions = spark.createDataFrame(rows, "id string, seq int, action string, corrections string")
    results = review.resolve_reviews(tables, decisions, given["catalog"], given["decisions"], given["invalid"], "v1", 9.0)
    return tables, {(r.id, r.seq): r.result for r in results.collect()}


def test_review_decisions(spark, run):
    tables, got = decide(spark, run, [("r1-3-audit", 1, "approve", '{"confidence": 7}'), ("r1-3-audit", 2, "approve", '{"category": "tune", "notes": "ok"}'),
                                      ("r1-3-audit", 3, "reject", None), ("nothing", 1, "reject", None), ("r1-4-row-0-3", 1, "reject", None)])
    assert got == {("r1-3-audit", 1): "invalid", ("r1-3-audit", 2): "approved", ("r1-3-audit", 3): "conflict", ("nothing", 1): "not_found", ("r1-4-row-0-3", 1): "rejected"}
    last = tables.extractions.read().filter("doc = 3").orderBy("version").collect()
    assert [r.version for r in last] == [1, 2] and json.loads(last[1].payload)["category"] == "tune" and "category" not in json.loads(last[0].payload)
    assert sorted((r.vehicle_id, r.category) for r in tables.matches.read().filter("doc = 3").collect()) == [(10, "tune"), (11, "tune")]
    approvals = {r.doc: (r.state, r.match_count) for r in tables.approvals.read().collect()}
    assert approvals[3] == ("complete", 2) and approvals[4] == ("failed", 1) and approvals[1] == ("superseded", 2)
    assert {r.id: (r.status, r.resolved_at) for r in tables.reviews.read().collect()} == {"r1-3-audit": ("approved", 9.0), "r1-4-row-0-3": ("rejected", 9.0)}


def test_invalid_decisions_change_nothing(spark, run):
    before = state(run[0])
    tables, got = decide(spark, run, [("r1-3-audit", 1, "approve", '{"fitment": 3}'), ("r1-3-audit", 2, "approve", '{"eo_number": null}')])
    assert set(got.values()) == {"invalid"} and state(tables) == before


def test_two_approvals_of_a_document(spark, run):
    """The second version stands on the first; what is matched is the last one."""
    tables, given = run
    extra = tables.reviews.read().filter("doc = 3").withColumn("id", F.lit("r1-3-more"))
    keep = tables.keep("x")(tables.reviews.read().filter("doc = 3").unionByName(extra), "both")
    tables.reviews.replace(keep.select("doc"), keep)
    _, got = decide(spark, run, [("r1-3-more", 2, "approve", '{"category": "intake"}'), ("r1-3-audit", 1, "approve", '{"category": "tune", "description": "first"}')])
    assert set(got.values()) == {"approved"}
    versions = {r.version: json.loads(r.payload) for r in tables.extractions.read().filter("doc = 3").collect()}
    assert (versions[2]["category"], versions[3]["category"], versions[3]["description"]) == ("tune", "intake", "first")
    assert {r.category for r in tables.matches.read().filter("doc = 3").collect()} == {"intake"}


def test_matches_are_stored_by_class_and_read_by_vehicle(spark, tmp_path):
    """Three vehicles that differ in trim are one stored row a document; a later catalog does not change what was stored before."""
    tables = daily.DailyTables(spark, str(tmp_path / "daily"), buckets=4)
    tables.create(matches=spark.createDataFrame([(1, 99, "exact"), (7, None, "high")], "doc bigint, vehicle_id bigint, tier string"))
    assert sorted((r.doc, r.vehicle_id) for r in tables.matches.read().collect() if r.doc == 1) == [(1, 99)] and tables.matches.columns[-1] == "class_id"

    def store(docs, vehicles):
        catalog = spark.createDataFrame([(i, 2000, "Ford", m, 2.0, "NA", 4) for i, m in vehicles],
                                        "vehicle_id bigint, year int, make string, model string, displacement_l double, induction string, cylinders int")
        classes = M.vehicle_classes(catalog)
        rows = spark.createDataFrame([(d, None, "exact", "deterministic", ["P"], None, None, None, None) for d in docs], daily.MATCHES)
        rows = rows.crossJoin(classes.select("class_id")).unionByName(spark.createDataFrame([(docs[0], 55, "generic", "gemini_resolved", ["P"], None, None, None, "why")], daily.MATCHES)
                                                                     .withColumn("class_id", F.lit(None).cast("string")))
        tables.store_matches(Matched(rows, classes, rows.select("doc").distinct(), None, None))

    def found(doc):
        return sorted((r.vehicle_id or -1, r.tier) for r in tables.matches.read().filter(F.col("doc") == doc).collect())

    store([1, 2], [(10, "Ranger"), (11, "Ranger"), (12, "Ranger"), (None, "Focus")])
    first = [(-1, "exact"), (10, "exact"), (11, "exact"), (12, "exact")]
    assert found(1) == sorted([*first, (55, "generic")]) and found(2) == first and found(7) == [(-1, "high")]
    assert tables.matches.stored().filter("doc = 2").count() == 2
    store([2], [(10, "Ranger"), (13, "Ranger")])
    assert found(1) == sorted([*first, (55, "generic")]) and found(2) == [(10, "exact"), (13, "exact"), (55, "generic")]
    assert sorted(r.doc for r in tables.matches.read(tables.matches.touched(spark.createDataFrame([(2,)], "doc bigint"))).collect() if r.doc == 2) == [2, 2, 2]


def test_validity_of_decisions_is_written_once(spark, tmp_path):
    """What follows from the verdicts reads them; it does not parse the records again."""
    tables = daily.DailyTables(spark, str(tmp_path / "daily"), buckets=4)
    decisions = spark.createDataFrame([("a", "approve", '{"confidence": 7}', 1), ("a", "approve", None, 2), ("b", "approve", None, 1)], "id string, action string, corrections string, seq int")
    reviews = spark.createDataFrame([("a", 1, "open"), ("b", 2, "open")], "id string, doc bigint, status string")
    latest = spark.createDataFrame([(1, '{"eo_number": "D-1", "confidence": 0.5}')], "doc bigint, payload string")
    out = review.judged(decisions, reviews, latest, tables.keep("v1"))
    assert {(r.id, r.seq): r.result for r in out.collect()} == {("a", 1): "invalid", ("a", 2): "approved", ("b", 1): "no_extraction"}
    assert "schema_of_variant" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_changes_are_written_without_a_shuffle_by_bucket(spark, tmp_path):
    """Rows go from the tasks that made them into the files of their buckets; only sorted tables are dealt out by bucket first."""
    t = KeyedTable(spark, str(tmp_path / "t"), "doc BIGINT, x STRING", buckets=4)
    t.create(spark.range(0, 1000, 1, 3).selectExpr("id AS doc", "concat('x', id) AS x"))
    assert t.read().count() == 1000
    by_bucket = {}
    for f in files(str(tmp_path / "t")):
        if f.endswith(".parquet"):
            by_bucket[bucket_of(f)] = by_bucket.get(bucket_of(f), 0) + 1
    assert set(by_bucket) == {0, 1, 2, 3} and set(by_bucket.values()) == {4}  # three tasks, and the row that marks the bucket
    assert all(".zstd." in f for f in files(str(tmp_path / "t")) if f.endswith(".parquet"))


def test_stored_versions_after_an_audit(spark, tmp_path):
    """The last version takes the payload, earlier ones stay; a version stored twice stays twice, a document without one gets its first."""
    stored = spark.createDataFrame([(1, 1, "a", 1.0), (1, 2, "b", 2.0), (2, 1, "c", None), (3, 4, "d", 4.0), (3, 4, "e", 5.0), (3, None, "f", 6.0), (8, 7, "g", 7.0)], daily.EXTRACTIONS)
    t = KeyedTable(spark, str(tmp_path / "t"), daily.EXTRACTIONS, buckets=4)
    t.create(stored)
    audited = spark.createDataFrame([(1, "D-1", None), (2, "D-2", '{"eo_number":"old"}'), (3, "D-3", None), (4, "D-4", None)], "doc bigint, eo_number string, before string")
    known = audited.join(daily.last_versions(t.read()), "doc", "left")
    t.replace(known.select("doc", "_last"), daily.updated_extractions(known, 9.0), F.coalesce(F.col("version") >= F.col("_last"), F.lit(True)))
    got = sorted((r.doc, r.version, r.payload, r.created_at) for r in t.read().collect())
    assert got == [(1, 1, "a", 1.0), (1, 2, '{"eo_number":"D-1"}', 2.0), (2, 1, '{"eo_number":"old"}', 9.0), (3, 4, '{"eo_number":"D-3"}', 4.0),
                   (3, 4, '{"eo_number":"D-3"}', 5.0), (4, 1, '{"eo_number":"D-4"}', 9.0), (8, 7, "g", 7.0)]
