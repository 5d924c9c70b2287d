from collections import Counter

from pyspark.sql import functions as F

from fitledger import session as S
from fitledger.operators import matching as op

CATALOG = "vehicle_id long, year int, make string, model string, displacement_l double, induction string, cylinders int"


def rows_of(spark, n):
    """Nine rows in ten are of one make and model, the others of 300 makes."""
    rare = F.concat(F.lit("make "), (F.col("id") % 300).cast("string"))
    return spark.range(n).select(
        F.col("id").alias("doc"), F.lit(0).cast("long").alias("row_idx"), F.when(F.col("id") % 10 > 0, "Ford").otherwise(rare).alias("make"),
        F.lit("Ranger XL").alias("model"), F.lit(2001).alias("year_start"), F.lit(2002).alias("year_end"), F.lit(None).cast("double").alias("displacement_l"),
        F.lit("").alias("induction"), F.lit(None).cast("int").alias("cylinders"), F.array(F.lit("P")).alias("part_numbers"))


def catalog_of(spark):
    makes = ["FORD", *(f"Make {i}" for i in range(0, 300, 20))]
    return spark.createDataFrame([(100 * i + y, 2000 + y, m, "Ranger", None, "NA", 4) for i, m in enumerate(makes) for y in range(4)], CATALOG)


def test_broadcast_check_counts_rows_and_bytes(spark):
    df = spark.range(10).select("id", F.repeat(F.lit("x"), 1000).alias("s"))
    assert S.fits_broadcast(df) and S.fits_broadcast(df, 10) and S.fits_broadcast(df.limit(0), 0, 0)
    assert not S.fits_broadcast(df, 9)
    assert not S.fits_broadcast(df, 10, 9_999)
    assert not S.fits_broadcast(spark.range(2).select(F.sequence(F.lit(0), F.lit(9999)).alias("a")), 10, 50_000)


def test_only_hot_keys_get_parts(spark):
    keyed = rows_of(spark, 20_000).select(F.lower("make").alias("k"))
    found = S.hot_keys(keyed, ["k"], 20).collect()
    ford = spark.range(1).select(F.xxhash64(F.lit("ford"))).first()[0]
    assert [(r.key_hash, r.parts) for r in found] == [(ford, 18)]
    assert S.hot_keys(keyed.limit(0), ["k"], 20).collect() == []
    # every key of an even input fits a task
    even = spark.range(20_000).select((F.col("id") % 100).alias("k"))
    assert S.hot_keys(even, ["k"], 20).collect() == []


def test_skewed_make_is_spread_and_its_catalog_rows_alone_repeat(spark):
    rows, catalog = rows_of(spark, 20_000), catalog_of(spark)
    old = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    try:
        for k, v in zip(old, ("-1", "false", "24"), strict=True):
            spark.conf.set(k, v)
        want = Counter(map(tuple, op.application_matches(rows, catalog).collect()))
        salted = op.application_matches(rows, catalog, bound=1)
        assert Counter(map(tuple, salted.collect())) == want and sum(want.values()) > 36_000
        loads = [r["count"] for r in salted.groupBy(F.spark_partition_id().alias("p")).count().collect()]
        assert max(loads) < sum(loads) / 3
        for how in ("left", "left_semi", "left_anti"):
            keyed, cat = rows.select(F.lower("make").alias("k"), "doc"), catalog.select(F.lower("make").alias("k"), "vehicle_id")
            forms = [Counter(map(tuple, S.dimension_join(keyed, cat, ["k"], ["doc"], fits, how).collect())) for fits in (True, False)]
            assert forms[0] == forms[1] and forms[0]
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_null_keys_and_empty_sides(spark):
    big = spark.createDataFrame([(i, None if i % 2 else "a") for i in range(40)], "doc long, k string")
    small = spark.createDataFrame([("a", 1), (None, 2)], "k string, v int")
    for fits in (True, False):
        assert S.dimension_join(big, small, ["k"], ["doc"], fits).count() == 20
        assert S.dimension_join(big, small, ["k"], ["doc"], fits, "left").count() == 40
        assert S.dimension_join(big, small, ["k"], ["doc"], fits, "left_anti").count() == 20
        assert S.dimension_join(big.limit(0), small, ["k"], ["doc"], fits).count() == 0
        assert S.dimension_join(big, small.limit(0), ["k"], ["doc"], fits, "left").count() == 40
