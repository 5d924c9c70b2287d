import json

import pytest

from fitledger.operators import scoring as S
from fitledger.sources import golden as G


def row(model, parts):
    return {"part_numbers": parts, "year_start": 2000, "year_end": 2000, "make": "Ford", "model": model, "trim_note": None,
            "displacement_l": 5.0, "induction": None, "cylinders": 8}


def record(key, parts, rows, **kw):
    return {"eo_number": key, "manufacturer": "m", "device_name": "d", "category": "tune", "part_numbers": parts,
            "fitment": rows, "confidence": 0.9, **kw}


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    top = tmp_path_factory.mktemp("golden")
    for name in ("expected", "actual"):
        (top / name).mkdir()

    def write(path, x):
        (top / path).write_text(json.dumps(x, indent=1))

    same = record("D-1", ["1", "2"], [row("F-150", ["1", "2"])])
    write("expected/d-1.json", same)
    write("actual/d-1.agent.json", same)
    write("actual/d-1.legacy.json", {"_doc_id": "D-1", "device_name": "d", "manufacturer": "m", "category": "tune", "part_numbers": ["1", "2"], "fitment_count": 1})
    write("expected/d-2.json", record("D-2", ["1", "2"], [row("F-150", ["1"]), row("F-250", ["2"])]))
    write("actual/d-2.agent.json", record("D-2", ["2", "3"], [row("F-250", ["2"])]))
    write("actual/d-3.agent.json", {"eo_number": "D-3", "confidence": "high"})
    return str(top)


def test_accuracy_report(spark, folder):
    expected = G.read_expected(spark, f"{folder}/expected")
    produced = G.read_produced(spark, f"{folder}/actual")
    report = G.accuracy_report(expected, {"new": produced, "old": G.read_baseline(spark, f"{folder}/actual")})
    got = {(r.source, r.doc): r for r in report.collect()}
    same, other, old = got["new", "D-1"], got["new", "D-2"], got["old", "D-1"]
    assert (same.pn_f1, same.assoc_f1, same.fit_delta, same.matched) == (1.0, 1.0, 0, same.total)
    # one of two numbers found, one of two given is right; the mean over all expected rows, of which one is missing
    assert (other.pn_f1, other.assoc_f1, other.fit_delta) == (0.5, 0.5, -1)
    assert (old.pn_f1, old.assoc_f1) == (1.0, 0.0)
    means = {r.source: r for r in S.score_summary(report).collect()}
    assert means["new"].pn_f1 == 0.75


def test_checks_of_produced_files(spark, folder):
    produced = G.read_produced(spark, f"{folder}/actual")
    checks = {r.doc: r for r in G.check_report(produced, G.read_payload_text(spark, f"{folder}/actual")).collect()}
    assert set(checks) == {"D-1", "D-2", "D-3"}
    assert checks["D-1"].schema and checks["D-1"].eo_format and checks["D-1"].required_fields
    assert not checks["D-3"].schema


def test_latest_export(spark, tmp_path):
    rows = [("D-1", 1.0, 1, "v1", ("a",)), ("D-1", 2.0, 2, "v2", ("b",)), ("D-2", 1.0, 3, "v1", ("c",))]
    G.write_latest(spark.createDataFrame(rows, "eo_number string, created_at double, id long, prompt_version string, payload struct<x:string>"), str(tmp_path / "out"))
    assert sorted((r.x, r._prompt_version) for r in spark.read.json(str(tmp_path / "out")).collect()) == [("b", "v2"), ("c", "v1")]


SCORED = ("doc long, eo_number string, manufacturer string, category string, part_numbers array<string>, "
          "fitment array<struct<part_numbers:array<string>,year_start:int,model:string>>")


def test_lists_that_no_single_text_can_hold(spark):
    """Nulls, separators, empty texts and empty lists stay apart from each other, whatever form a list is shuffled in."""
    lists = [None, [], [""], [None], ["", ""], ["a", "b"], ["a\x1fb"], ["a", None, "b"], ["a", "b\x1f"], ["b", "a", "a"], ["a"]]
    pairs = [(i * 100 + j, a, b) for i, a in enumerate(lists) for j, b in enumerate(lists)]
    e, g = (spark.createDataFrame([(x[0], "D", None, None, x[side], [(x[side], None, "m")]) for x in pairs], SCORED) for side in (1, 2))
    want = {}
    for doc, a, b in pairs:
        a, b = set(a or []), set(b or [])
        want[doc] = 1.0 if a == b else 2 * len(a & b) / (len(a) + len(b))
    got = S.score_records(e, g).collect()
    assert {r.doc: r.pn_f1 for r in got} == {r.doc: r.assoc_f1 for r in got} == want


def test_last_row_of_a_slot_and_records_without_key(spark):
    rows = [(["x"], 2000, "M"), (["y"], 2000, "m"), (["z"], None, "m"), (["z"], None, None)]
    e = spark.createDataFrame([(1, "D", None, "c", [], rows), (None, "D", None, "c", [], rows[:1]), (2, "D", None, "c", [], None)], SCORED)
    g = spark.createDataFrame([(1, "D", None, "d", [], [(["y"], 2000, "m"), (["z"], None, "M"), (["q"], 2001, "m")]),
                               (None, "D", None, "c", [], rows[:1]), (2, "D", None, "c", [], [])], SCORED)
    got = {r.doc: r for r in S.score_records(e, g).collect()}
    assert (got[1].assoc_f1, got[1].matched, got[1].total, got[1].fit_delta) == (2 / 3, 2, 3, -1)
    assert (got[None].scalar, got[None].assoc_f1, got[None].matched, got[None].total) == (0.0, 0.0, 0, 1)
    assert (got[2].assoc_f1, got[2].total, got[2].fit_delta) == (1.0, 0, 0)


def test_entries_cross_as_texts_and_once_a_table(spark):
    """Lists are a multiple of their text when shuffled; a table that is compared with itself and another is shuffled once."""
    rows = [(["p%d" % j for j in range(i % 7)], 2000, "m") for i in range(20)]
    e = spark.createDataFrame([(i, "D", None, "c", ["a", "b"], rows) for i in range(50)], SCORED)
    older = e.withColumn("doc", e.doc + 1)
    plan = S.score_records(e, older)._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "max_by" not in plan
    report = S.score_summary(G.accuracy_report(e, {"older": older, "same": e}))
    report.collect()
    assert "ReusedExchange" in report._jdf.queryExecution().executedPlan().toString()
