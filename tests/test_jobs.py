import json

from pyspark.sql import functions as F

from fitledger.operators import ingest as I
from fitledger.operators import ordered as O
from fitledger.operators import registry as G
from fitledger.operators import reports as P
from fitledger.operators import state as S
from fitledger.plans import daily
from fitledger.schemas import RECORD
from fitledger.sources import inference as N
from fitledger.sources import listing as L


def page(rows, d0=(), d1=()):
    return json.dumps({"results": [{"result": {"data": {"dsr": {"DS": [
        {"ValueDicts": {"D0": list(d0), "D1": list(d1)}, "PH": [{"DM0": rows}]}]}}}}]})


def test_listing_page_mechanics(spark):
    rows = [{"C": [0, 0], "R": 0}, {"C": [1], "R": 2}, {"C": None, "R": 3}, "not-a-row", {"C": [2], "R": 2}, {"C": [3, 1], "R": 0},
            {"C": 7}, {"C": ["D-9"], "R": 2}, {"C": None, "R": 0}, {"C": ["lost"], "R": 2}, {"C": [9, 0]}, {"C": ["x", "y"], "R": "1"}]
    df = spark.createDataFrame([(1, page(rows, ["D-1", "D-2", "D-3", "D-4"], ["a.pdf", "b.pdf"])), (2, "{"), (3, page([]))],
                               "page_no int, payload string")
    got = {r.eo_number: r.pdf_url for r in L.decode_pages(df).collect()}
    assert got == {"D-1": "a.pdf", "D-2": "a.pdf", "D-3": "a.pdf", "D-4": "b.pdf", "D-9": "b.pdf"}
    merged = L.merge_pages(spark.createDataFrame([(1, 5, "k", "old"), (2, 1, "k", "new")], "page_no int, row_no int, eo_number string, pdf_url string"))
    assert merged.head().pdf_url == "new"


def test_response_lines(spark):
    def line(resp, parts=None):
        parts = parts or [{"text": "p"}, None, {"fileData": None}, {"fileData": {"fileUri": "s://b/pdfs/d-5.pdf"}}]
        return json.dumps({"request": {"contents": [{"parts": parts}]}, "response": resp})

    good = {"candidates": [{"content": {"parts": [{"text": json.dumps({"eo_number": "D-5", "confidence": 1})}]}}]}
    cut = {"candidates": [{**good["candidates"][0], "finishReason": "MAX_TOKENS"}]}
    df = spark.createDataFrame([(1, line(good)), (2, line(cut)), (3, line(None)), (4, line({})), (5, line(good, [{"text": "x"}]))], "seq int, line string")
    out = {r.seq: r for r in N.read_responses(df).collect()}
    assert {k: r.usable for k, r in out.items()} == {1: True, 2: False, 3: False, 4: False}
    assert out[1].eo_number == "D-5" and out[1].tok_in == 0 and out[1].record.eo_number == "D-5"


def test_ingest_stops_at_the_tripping_line(spark):
    lines = spark.createDataFrame([(1, "A", True, 1_000_000, 0), (2, "B", False, 0, 0), (3, "B", True, 1_000_000, 0), (4, "A", True, 5, 0),
                                   (5, "C", True, 1_000_000, 0), (6, "E", True, 1, 0), (7, "Z", True, 1, 0)],
                                  "seq long, eo_number string, usable boolean, tok_in long, tok_out long")
    items = spark.createDataFrame([(k, f"i{k}", 1.0) for k in "ABCDE"], "eo_number string, id string, created_at double")
    none = spark.createDataFrame([("D",)], "eo_number string")
    got = {r.seq: r.outcome for r in I.ingest_split(lines, items, none, 0.8).collect()}
    assert got == {1: "stored", 2: "bounced", 3: "stored", 4: "skipped", 5: "tripped", 6: "unread"}


def test_running_sum_is_independent_of_chunks(spark):
    df = spark.range(500).select((F.col("id") % 3).alias("k"), "id", (F.col("id") * 7 % 11).alias("x"))
    runs = [{(r.k, r.id): r.cum for r in O.running_sum(df, ["k"], ["id"], "x", F.floor(F.col("id") / n)).collect()} for n in (1, 17, 1000)]
    ranged = {(r.k, r.id): r.cum for r in O.running_sum(df, ["k"], ["id"], "x").collect()}
    assert runs[0] == runs[1] == runs[2] == ranged
    within = O.budget_prefix(df, ["k"], ["id"], "x", 100, F.floor(F.col("id") / 17)).groupBy("k").agg(F.max("spent").alias("m")).collect()
    assert all(r.m <= 100 for r in within)


def test_running_sum_of_a_hot_key_and_of_many_chunks(spark):
    """One key holds nine rows of ten; 100,000 chunks of one row each give what range partitions give."""
    df = spark.range(100_000).select(F.when(F.col("id") % 10 > 0, 1).otherwise(F.col("id")).alias("k"), "id", (F.col("id") % 7).alias("x"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert O.ranged(df, ["k"], ["id"]).filter("k = 1").select("_range").distinct().count() > 1
        hot = O.running_sum(df, ["k"], ["id"], "x")
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    got = hot.agg(F.sum(F.xxhash64("k", "id", "cum").cast("decimal(38,0)"))).head()[0]
    fine = O.running_sum(df, ["k"], ["id"], "x", F.col("id")).agg(F.sum(F.xxhash64("k", "id", "cum").cast("decimal(38,0)"))).head()[0]
    assert got == fine
    last = hot.filter("id = 99999").head().cum
    assert last == sum(i % 7 for i in range(100_000) if i % 10 > 0)


def test_running_sum_keeps_null_keys_and_orders(spark):
    df = spark.createDataFrame([(None, 1, 5), (None, 2, 6), ("a", None, 1), ("a", 3, 2)], "k string, o int, x int")
    assert sorted((r.k or "", r.o or 0, r.cum) for r in O.running_sum(df, ["k"], ["o"], "x").collect()) == [("", 1, 5), ("", 2, 11), ("a", 0, 1), ("a", 3, 3)]


def test_running_sum_keeps_rows_of_null_keys(spark):
    df = spark.createDataFrame([(None, 1, 5), (None, 2, 6), ("a", 3, 7), (None, 40, 1)], "k string, id long, x long")
    got = {r.id: r.cum for r in O.running_sum(df, ["k"], ["id"], "x", F.floor(F.col("id") / 10)).collect()}
    assert got == {1: 5, 2: 11, 3: 7, 40: 12}


def test_timeline_gap_skips_unknown_times(spark):
    df = spark.createDataFrame([(1, "r", "a", 10.0), (2, "r", "a", None), (3, "r", "a", 14.0), (4, "r", None, 15.0)],
                               "event_id long, run_id string, doc string, ts double")
    out = P.event_timeline(P.with_unknown(df), ["run_id", "doc"], ["event_id"], F.col("event_id"))
    assert {r.event_id: r.elapsed for r in out.collect()} == {1: None, 2: None, 3: 4.0, 4: None}


def test_lineage_depth_cycle_and_cap(spark):
    edges = spark.createDataFrame([("back", i, i - 1) for i in range(1, 9)] + [("back", 0, 8), ("back", 3, 99)], "direction string, src long, dst long")
    known = spark.range(9).select(F.col("id").alias("doc"), F.lit("complete").alias("state"))
    out = G.lineage(spark.createDataFrame([(3,), (99,)], "doc long"), edges, known).collect()
    got = {r.node: (r.depth, r.exists, r.capped) for r in out if r.start == 3}
    assert got == {2: (1, True, True), 99: (1, False, True), 1: (2, True, True), 0: (3, True, True), 8: (4, True, True), 7: (5, True, True)}


def test_topk_swaps_in_a_superseding_approval(spark):
    def pick(rows, n):
        df = spark.createDataFrame(rows, "doc string, state string, first_seen double, supersedes array<string>")
        return [r.doc for r in S.constrained_topk(df, df, n).orderBy(F.desc("first_seen")).collect()]

    rows = [("a", "complete", 5.0, []), ("b", "complete", 4.0, ["zz"]), ("c", "superseded", 3.0, ["a"]), ("d", "failed", 9.0, ["a"])]
    assert pick(rows, 2) == ["a", "c"] and pick(rows, 3) == ["a", "b", "c"]
    assert pick(rows, 4) == [] and pick(rows[:2], 2) == []


def test_heal_limit_is_noted_once(spark):
    items = spark.createDataFrame([(i, f"d{i}", "failed", "429 x", h, float(i)) for i, h in enumerate([0, 3, 2, 4, 1, 3])],
                                  "id long, doc string, status string, last_error string, heal_count int, created_at double").withColumn("attempts", F.lit(3))
    plan = S.heal_plan(items, "transient", 2)
    assert {(r.id, r.action) for r in plan.collect()} == {(0, "requeue"), (2, "requeue"), (1, "heal_limit_reached")}
    after = {r.id: (r.status, r.heal_count) for r in S.heal_updates(plan).collect()}
    assert after == {0: ("pending", 1), 2: ("pending", 3), 1: ("failed", 4)}


def test_empty_new_set_still_deletes_and_upsert_nulls(spark):
    old = spark.createDataFrame([(1, "x"), (2, "y")], "doc long, v string")
    assert [r.doc for r in S.replace_by_key(old, spark.createDataFrame([(1,)], "doc long"), old.limit(0)).collect()] == [2]
    ch = spark.createDataFrame([(1, None, True), (2, "z", False), (3, "n", True)], "doc long, v string, has_v boolean")
    assert {r.doc: r.v for r in S.merge_upsert(old, ch).collect()} == {1: None, 2: "y", 3: "n"}




def test_upsert_takes_the_last_change_of_each_column(spark):
    current = spark.createDataFrame([(1, "a", "b"), (2, "c", "d")], "doc long, x string, y string")
    changes = spark.createDataFrame(
        [(1, 1, "x1", True, None, False), (1, 2, None, False, "y2", True), (1, 3, None, True, "no", False), (3, 1, "x3", True, None, False)],
        "doc long, seq int, x string, has_x boolean, y string, has_y boolean")
    got = sorted(map(tuple, S.merge_upsert(current, changes, order="seq").collect()))
    assert got == [(1, None, "y2"), (2, "c", "d"), (3, "x3", None)]


def test_first_closing_decision_wins(spark):
    reviews = spark.createDataFrame([(1, "d1", "open"), (2, "d2", "done")], "id long, doc string, status string")
    rows = [(1, 1, "approve", False), (1, 2, "reject", True), (1, 3, "approve", True), (2, 4, "reject", True), (3, 5, "reject", True)]
    out = S.review_outcomes(spark.createDataFrame(rows, "id long, seq int, action string, valid boolean"), reviews, ["seq"])
    assert {r.seq: (r.result, r.approval_state) for r in out.collect()} == {
        1: ("invalid", None), 2: ("rejected", "failed"), 3: ("conflict", None), 4: ("conflict", None), 5: ("not_found", None)}


def test_repeated_listing_key_gives_one_approval(spark):
    approvals = spark.createDataFrame([("k", None), ("l", "kept")], "eo_number string, pdf_url string")
    listing = spark.createDataFrame([("k", "y"), ("k", "x"), ("l", "z")], "eo_number string, pdf_url string")
    assert sorted(map(tuple, G.repair_missing_url(approvals, listing).collect())) == [("k", "x"), ("l", "kept")]


def test_fix_changes_every_field(spark):
    row = {"part_numbers": ["P1"], "year_start": 2000, "year_end": 2001, "make": "Ford", "model": "F-150", "trim_note": None,
           "displacement_l": 5.0, "induction": None, "cylinders": 8}
    rec = (1, "D-1", 0.9, "tune", ["P1"], [row], "old", ["D-0"], {"a": 0.5}, "low_confidence")
    kind = RECORD[RECORD.index("fitment "):RECORD.index(", confidence")]
    routed = spark.createDataFrame([rec], f"doc long, eo_number string, confidence double, category string, part_numbers array<string>, {kind}, "
                                          "manufacturer string, supersedes array<string>, sections_confidence map<string,double>, reason string")
    verdicts = spark.createDataFrame([(1, "fix", '{"manufacturer": "new", "supersedes": ["D-9"], "sections_confidence": {"a": 1}}', ["r"])],
                                     "doc long, verdict string, corrections string, reasons array<string>")
    got = daily.audit(routed.withColumns({"issues": F.array().cast("array<string>"), "div": F.lit(0.0), "draw": F.lit(1.0)}), verdicts).head()
    assert (got.outcome, got.manufacturer, got.supersedes, got.sections_confidence, got.category) == ("accepted", "new", ["D-9"], {"a": 1.0}, "tune")


def test_long_errors_are_not_broadcast(spark):
    items = spark.range(20).selectExpr("id", "'pending' AS status", "'extract' AS stage", "CAST(id % 3 AS INT) AS attempts", "'' AS last_error")
    outcomes = items.filter("id > 3").selectExpr("id", "if(id % 2 = 0, 'error', 'complete') AS outcome", "repeat('boom ', 90) AS error")
    out = S.attempt_update(items, outcomes)
    assert "Broadcast" not in out._jdf.queryExecution().sparkPlan().toString()
    got = {r.id: (r.status, r.attempts, r.last_error) for r in out.collect()}
    assert got[2] == ("pending", 2, "") and got[8] == ("failed", 3, "boom " * 90) and got[9] == ("done", 0, "") and len(got) == 20
