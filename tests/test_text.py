import pytest
from pyspark.sql import functions as F

from fitledger.functions import labels as L
from fitledger.functions import match as M
from fitledger.functions import text as T


def values(spark, texts, fn):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, s string")
    return [r[1] for r in sorted(df.select("i", fn(F.col("s")).alias("o")).collect())]


def test_models(spark):
    cases = {"F150 Pickup 2WD": "F-150", "F250 3.9L AWD GVWR>5120 LBS": "F-250", "Tundra 2500 4WD": "Tundra",
             "Mustang Convertible": "Mustang", "F-150": "F-150", "F-150 5": "F-150", "Accord (SE)": "Accord",
             "K1500 Blazer": "C/K 1500 Blazer",
             "F150\u00a0Pickup 2WD": "F-150", "\u2003Accord\u00a0": "Accord", "Foo HD a\nPickup": "Foo", "A HD x Pickup\nfoo": "A"}
    assert values(spark, list(cases), T.normalize_model) == list(cases.values())


def test_slash_lists(spark):
    assert values(spark, ["F-150/250/350", "Prelude / Integra", "F-150", "A1/B"], T.expand_models) == [
        ["F-150", "F-250", "F-350"], ["Prelude", "Integra"], ["F-150"], ["A1", "B"]]
    assert values(spark, ["Chev/Pontiac", " Chevrolet ", "a / / b"], T.expand_makes) == [
        ["Chev", "Pontiac"], ["Chevrolet"], ["a", "b"]]


def test_engines(spark):
    got = values(spark, ["6.2L V8 supercharged", "(460 CID)", "350 CID 8-cylinder", "up to 6.0L", "I4 turbo", "199 cid", ""],
                 T.parse_engine)
    assert [(g.displacement_l, g.induction, g.cylinders) for g in got] == [
        (6.2, "supercharged", 8), (7.54, None, None), (5.74, None, 8), (None, None, None), (None, "turbo", 4),
        (3.26, None, None), (None, None, None)]


def test_categories(spark):
    assert values(spark, ["Cold Air System", "TURBOCHARGER kit", "muffler", "thing"], T.categorize) == [
        "intake", "boost", "exhaust", "other"]


@pytest.mark.parametrize("error, kind", [
    ("429 RESOURCE_EXHAUSTED: slow down", "transient"), ("503 UNAVAILABLE", "transient"), ("DEADLINE_EXCEEDED", "transient"),
    ("400 bad request, 429 in the text", "permanent"), ("429 but input 1,048,576", "permanent"), ("", "permanent"),
    (None, "permanent"), ("Failed to load document (PDFium: Data format error).", "corrupt_source"), ("port 5000 x", "permanent")])
def test_failures(spark, error, kind):
    assert values(spark, [error], T.classify_failure) == [kind]


def test_labels(spark):
    one = spark.range(1)

    def show(c):
        return one.select(c.alias("x")).head()[0]

    lit = F.lit
    assert show(L.engine_label(lit(5.7), lit(8), lit("TURBO"))) == "5.7L 8-cyl Turbo"
    assert show(L.engine_label(lit(5.0), lit(0), lit(None).cast("string"))) == "5L"
    assert show(L.engine_label(lit(0.0), lit(None).cast("int"), lit(""))) == "Unspecified engine"
    assert show(L.year_range(lit(1999), lit(2003))) == "1999–2003"
    assert show(L.age_bucket(lit(100.0), lit(50.0))) == "just now"
    assert show(L.age_bucket(lit(0.0), lit(7300.0))) == "2h ago"
    assert show(L.elapsed_label(lit(65.2))) == "+1m 05s"
    assert show(L.money(lit(None).cast("double"))) == "$0.00"
    assert show(L.count_label(lit(1234567))) == "1,234,567"
    assert show(L.truncate(lit("abcdef"), 3)) == "abc…"
    assert show(L.local_time(lit(1704067200.0))) == "Dec 31, 2023, 16:00:00"
    assert show(L.event_time(lit(None).cast("double"))) == "--:--:--"
    assert show(L.first_line(lit("  \nx"))) == "—"
    assert show(L.category_label(lit("intake"))) == "Intake"
    assert show(L.failure_hint(lit("429 x"))).startswith("(rate-limit")


def test_model_prefix_rule(spark):
    pairs = [("Tundra", "Tundra 25 Electric", True), ("Celica GT", "Celica", True), ("Rangers United", "Ranger", False),
             ("", "Ranger", False), ("c/k", "C/K 1500", True), ("F-150", "f", True), ("F1", "F", False)]
    df = spark.createDataFrame(pairs, "a string, b string, ok boolean")
    got = df.select("ok", M.model_matches(F.col("a"), F.col("b")).alias("m"),
                    M.first_word(M.fold(F.col("a"))).eqNullSafe(M.first_word(M.fold(F.col("b")))).alias("w")).collect()
    assert all(r.ok == r.m for r in got)
    assert all(r.w for r in got if r.m)


def test_part_numbers_are_stripped_once(spark):
    rows = ["A1", "A", " A ", " A1 ", "A1\n", "A B", "A<1", "", None, "x" * 48, "x" * 49, "éé", "é", "a_b", "A1 ", "​1"]
    out = spark.createDataFrame([(i, x) for i, x in enumerate(rows)], "i int, p string").select("i", T.part_number_ok(F.col("p")).alias("ok"))
    assert [r.ok for r in out.orderBy("i").collect()] == [True, False, False, True, True, True, False, False, None, True, False, True, False, False, True, True]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("trim(") == 1
