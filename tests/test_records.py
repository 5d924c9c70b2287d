import contextlib
import io
import json
import re

import pytest
from pyspark.sql import functions as F

from fitledger.operators import quality as Q
from fitledger.operators import records as R
from fitledger.operators import scoring as S
from fitledger.plans import daily
from fitledger.schemas import APPLICATION_ROW

OK = {"eo_number": "D-1", "confidence": 0.9}


@pytest.mark.parametrize("record, faults", [
    (OK, []), ({**OK, "category": "bogus"}, ["category"]), ({**OK, "confidence": 1.5}, ["confidence"]),
    ({**OK, "confidence": "0.5"}, []), ({"confidence": 0.5}, ["eo_number"]),
    ({**OK, "fitment": [{"year_start": "2000", "displacement_l": "5.0"}]}, []), ({**OK, "fitment": [{"year_start": 2000.5}]}, ["fitment"]),
    ({**OK, "fitment": None}, ["fitment"]), ({**OK, "part_numbers": ["a", 1]}, ["part_numbers"]), ({**OK, "notes": 5}, ["notes"]),
    ({**OK, "illegible_pages": [1, 2.0]}, []), ({**OK, "sections_confidence": {"a": 0.1, "b": "x"}}, ["sections_confidence"]),
    ({**OK, "fitment": [{"induction": "DIESEL"}]}, ["fitment"]), ({**OK, "unknown": {"x": 1}}, [])])
def test_faults(spark, record, faults):
    df = spark.createDataFrame([(json.dumps(record),)], "payload string")
    assert R.validate_records(df).head().faults == faults


def test_text_that_is_no_record(spark):
    df = spark.createDataFrame([("{",), ("[1]",), (None,)], "payload string")
    assert [r.faults for r in R.validate_records(df).collect()] == [["not_json"], ["not_object"], ["not_json"]]


def test_explicit_null_overwrites_and_revalidates(spark):
    df = spark.createDataFrame([(json.dumps({**OK, "category": "tune", "notes": "x"}), '{"category": null, "confidence": 0.2}'),
                                (json.dumps(OK), '{"confidence": 7}'), (json.dumps(OK), None)], "payload string, corrections string")
    out = R.apply_corrections(R.validate_records(df)).withColumn("r", R.typed_record("value")).collect()
    assert json.loads(out[0].merged_json) == {"eo_number": "D-1", "notes": "x", "category": None, "confidence": 0.2}
    assert [o.valid for o in out] == [True, False, True]
    assert out[0].r.category is None and out[0].r.confidence == 0.2


def test_typed_record_is_whole(spark):
    text = json.dumps({**OK, "sections_confidence": {"a": 0.5, "b": 1}, "illegible_pages": [2, 4]})
    df = R.validate_records(spark.createDataFrame([(text,), (json.dumps(OK),)], "payload string")).withColumn("r", R.typed_record("value"))
    got = [(r.r.sections_confidence, r.r.illegible_pages) for r in df.collect()]
    assert got == [({"a": 0.5, "b": 1.0}, [2, 4]), ({}, [])]


def row(model, pns, **kw):
    return {"part_numbers": pns, "year_start": 2000, "year_end": 2001, "make": "a", "model": model, "trim_note": None,
            "displacement_l": 5.0, "induction": None, "cylinders": None, **kw}


def test_dedupe_keeps_first_and_order_and_is_idempotent(spark):
    rows = [row("b", ["2", "1"]), row("a", ["1"]), row("b", ["1", "2"]), row("a", ["1"], cylinders=4), row("a", ["1"])]
    df = spark.createDataFrame([(rows,)], f"fitment array<struct<{APPLICATION_ROW.replace(', ', ',').replace(' ', ':')}>>")
    once = Q.with_deduped_rows(df)
    twice = Q.with_deduped_rows(once.drop("removed"))
    assert [(r.model, r.part_numbers, r.cylinders) for r in once.head().fitment] == [
        ("b", ["2", "1"], None), ("a", ["1"], None), ("a", ["1"], 4)]
    assert once.head().removed == 2 and twice.head().removed == 0


def test_gate(spark):
    df = spark.createDataFrame([("d 1", [row("x", [], year_start=1899)], ["<x>"], None),
                                ("D-1", [row("x", [], year_start=2005, year_end=2001)], ["3C"], "tune"),
                                ("D-1", [row("x", [], displacement_l=130.0)], [], "tune"), ("D-1", [], ["GO Kit"], "tune")],
                               f"k string, f array<struct<{APPLICATION_ROW.replace(', ', ',').replace(' ', ':')}>>, p array<string>, c string")
    got = df.select(Q.gate_issues(F.col("k"), F.col("f"), F.col("p"), F.col("c")).alias("i")).collect()
    assert [r.i for r in got] == [["bad_eo_number", "bad_year", "bad_part_number", "no_category"], ["bad_year"], ["bad_displacement"], []]


def test_f1_is_symmetric_and_divergence_edges(spark):
    df = spark.createDataFrame([([], []), (["a"], []), (["a", "b"], ["b"]), (["a", "a"], ["a"])], "a array<string>, b array<string>")
    f = df.select(S.set_f1(F.col("a"), F.col("b")).alias("x"), S.set_f1(F.col("b"), F.col("a")).alias("y")).collect()
    assert [round(r.x, 4) for r in f] == [1.0, 0.0, 0.6667, 1.0] and all(r.x == r.y for r in f)
    d = df.select(Q.divergence(F.col("a"), F.size("a"), F.col("b"), F.size("b"), F.lit(True)).alias("d")).collect()
    assert [r.d for r in d] == [0.0, 1.0, 0.5, 0.25]


def test_change_set(spark):
    df = spark.sql("SELECT named_struct('category', 'a', 'confidence', 1D, 'fitment', array(1)) AS o, "
                   "named_struct('category', CAST(NULL AS STRING), 'confidence', 1D, 'fitment', array(1, 2)) AS n")
    assert json.loads(df.select(F.to_json(R.change_set("o", "n", ["category", "confidence"])).alias("j")).head().j) == {
        "category": None, "fitment": [1, 2]}
    assert df.select(R.change_set("o", "o", ["category", "confidence"]).alias("j")).head().j is None


def test_record_diff_without_row_arrays_in_the_shuffle(spark):
    rows = "array<struct<model:string,part_numbers:array<string>>>"
    records = spark.createDataFrame([
        (1, "d", "m", "tune", ["A", "B", "A"], [("x", ["A"]), ("y", None), ("z", [])]), (2, None, None, None, None, None),
        (3, "d", "m", "tune", ["A"], []), (4, "d", "m", "tune", ["C", "A"], [("x", ["A"])])],
        f"doc long, device_name string, manufacturer string, category string, part_numbers array<string>, fitment {rows}")
    baseline = spark.createDataFrame([(1, "d", "n", None, ["C", "B", "B"], 2), (2, None, None, None, [], None), (4, "d", "m", "tune", ["A", "C"], 1)],
                                     "doc long, device_name string, manufacturer string, category string, part_numbers array<string>, fitment_count int")
    out = R.record_diff(records, baseline)
    assert {r.doc: tuple(r)[1:] for r in out.collect()} == {
        1: (False, True, True, ["A"], ["C"], ["B"], 2, 3, 1), 2: (False, False, False, [], [], [], 0, 0, 0),
        3: (True, True, True, ["A"], [], [], 0, 0, 0), 4: (False, False, False, [], [], ["A", "C"], 1, 1, 1)}


def test_route_reads_rows_before_the_join(spark):
    row = "struct<model:string,make:string,year_start:int,year_end:int,displacement_l:double,induction:string,cylinders:int,trim_note:string,part_numbers:array<string>>"
    records = spark.createDataFrame([(1, 0.5, "D-1-1", 0.9, "tune", ["A"], [])],
                                    f"doc long, draw double, eo_number string, confidence double, category string, part_numbers array<string>, fitment array<{row}>")
    baseline = spark.createDataFrame([(1, ["A"], 0)], "doc long, part_numbers array<string>, fitment_count int")
    routed = daily.route(records, baseline)
    assert {"fitment", "issues", "div", "reason"} <= set(routed.columns) and not {c for c in routed.columns if c.startswith("_")}
    old, shown = spark.conf.get("spark.sql.autoBroadcastJoinThreshold"), io.StringIO()
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        with contextlib.redirect_stdout(shown):
            routed.select("doc", "div", "reason").explain("formatted")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    shuffled = re.findall(r"\) Exchange\nInput \[\d+\]: \[(.*)\]", shown.getvalue())
    assert any("_n#" in columns for columns in shuffled) and not any("fitment#" in columns for columns in shuffled)


def test_lists_of_texts_hold_texts_only(spark):
    given = ['["A"]', "[]", '["A", 1]', '["A", null]', "null", '"A"', '{"a": "b"}', '[["A"]]']
    rows = [(i, f'{{"eo_number": "D", "confidence": 1, "part_numbers": {x}, "fitment": [{{"part_numbers": {x}}}]}}') for i, x in enumerate(given)]
    out = R.validate_records(spark.createDataFrame(rows, "i int, payload string"))
    assert [r.faults for r in out.orderBy("i").collect()] == [[], []] + [["part_numbers", "fitment"]] * 6
    # a list's items are asked for their kind and for nothing else
    assert R._texts("x", "k").count("transform") == 0
