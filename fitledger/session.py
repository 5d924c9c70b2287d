"""Session settings and the few session-level helpers the jobs share."""

from __future__ import annotations

import tempfile
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Rows, and bytes of these rows as JSON, up to which a dimension is broadcast on request. The
# check is taken with a LIMIT of one row more, so it reads no more than this many rows.
BROADCAST_ROW_BOUND = 500_000
BROADCAST_BYTE_BOUND = 200_000_000
# Keys that the sketch of frequent keys counts, and those of them that may be salted.
TRACKED_KEYS, HOT_KEYS = 8192, 1024
# Rows that ``dealt`` gives a task, few enough that what they fan out to is grouped in memory.
ROWS_A_TASK = 50_000


def build_session(app: str = "fitledger", master: str | None = None, **conf: str) -> SparkSession:
    """Session with the settings the library relies on; a cluster passes its own
    master, shuffle width and memory through spark-submit or ``conf``."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    }
    for k, v in {**base, **conf}.items():
        b = b.config(k, v)
    return b.getOrCreate()


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder named by ``spark.checkpoint.dir``. A session in one process may go without
    the setting and gets a folder of its own; on a cluster, where executors do not see each
    other's disks, a missing setting is an error."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="fitledger-ckpt-")
        spark.conf.set("spark.checkpoint.dir", path)
    spark.sparkContext.setCheckpointDir(path)
    return path


def fits_broadcast(df: DataFrame, bound: int = BROADCAST_ROW_BOUND, byte_bound: int = BROADCAST_BYTE_BOUND) -> bool:
    """True when ``df`` has at most ``bound`` rows of at most ``byte_bound`` bytes together; reads at
    most ``bound + 1`` rows. JSON text stands for the size of a row, null fields for eight bytes."""
    size = F.octet_length(F.to_json(F.struct("*"))) + 8 * len(df.columns)
    found = df.limit(bound + 1).select(size.cast("long").alias("size")).agg(F.count("*").alias("n"), F.sum("size").alias("bytes")).first()
    return found["n"] <= bound and (found["bytes"] or 0) <= byte_bound


def hot_keys(df: DataFrame, keys: list[str], tasks: int) -> DataFrame:
    """(key_hash, parts) of the keys that hold more rows than one of ``tasks`` equal tasks, with the
    number of such tasks they would fill: at most HOT_KEYS rows.

    Counts come from a sketch of fixed size, combined before its shuffle. Their error, some rows in
    a thousand of all, only moves the number of parts.
    """
    sketch = F.expr(f"approx_top_k(xxhash64({', '.join(f'`{k}`' for k in keys)}), {HOT_KEYS}, {TRACKED_KEYS})")
    found = df.agg(F.count("*").alias("n"), sketch.alias("top")).select("n", F.explode("top").alias("t"))
    parts = F.ceil(F.col("t.count") * tasks / F.col("n")).cast("int")
    return found.select(F.col("t.item").alias("key_hash"), parts.alias("parts")).filter(F.col("parts") > 1)


def dimension_join(big: DataFrame, small: DataFrame, keys: list[str], salt_on: list[str],
                   small_fits: bool, how: str = "inner", when: Column | None = None,
                   tasks: int | None = None, like: DataFrame | None = None) -> DataFrame:
    """Join a large side to a dimension whose keys may be badly skewed on the large side.

    ``small_fits`` is the outcome of ``fits_broadcast``: when true the dimension is
    broadcast and the large side is not shuffled at all. Otherwise both are shuffled by key. A key
    with more rows than one of ``tasks`` tasks should have (by default the shuffle's partitions) is cut into as
    many parts as it would fill, by a hash of ``salt_on``, and only its rows of the dimension are
    repeated, once per part. Which keys these are is found inside the same query (``hot_keys``), in the large side, which is read
    twice for that, or in ``like``, rows of much the same keys that cost less. Both
    forms give the same rows. ``when`` is a further condition over the columns of both sides;
    ``how`` is inner, left, left_semi or left_anti.
    """
    right = small.withColumnsRenamed({k: f"_dim_{k}" for k in keys})
    match = [F.col(k) == F.col(f"_dim_{k}") for k in keys] + ([] if when is None else [when])
    drop = [f"_dim_{k}" for k in keys]
    if small_fits:
        right = F.broadcast(right)
    else:
        tasks = tasks or int(big.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        hot = hot_keys(big if like is None else like, keys, tasks).withColumnsRenamed({"key_hash": "_key_hash", "parts": "_parts"})
        parts, left_out = F.coalesce(F.col("_parts"), F.lit(1)), ["_key_hash", "_parts"]
        # at most HOT_KEYS rows, so this broadcast is bounded whatever the input
        big = (big.join(F.broadcast(hot), F.xxhash64(*keys) == F.col("_key_hash"), "left")
               .withColumn("_salt", F.pmod(F.xxhash64(*salt_on), parts).cast("int")).drop(*left_out))
        right = (right.join(F.broadcast(hot), F.xxhash64(*(f"_dim_{k}" for k in keys)) == F.col("_key_hash"), "left")
                 .withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1))).drop(*left_out))
        match.append(F.col("_salt") == F.col("_part"))
        drop += ["_salt", "_part"]
    return big.join(right, reduce(and_, match), how).drop(*drop)


def dealt(df: DataFrame, key: str) -> DataFrame:
    """df dealt by a hash of ``key`` to tasks of some ROWS_A_TASK rows. What is grouped or joined by ``key`` and further columns behind it
    needs no shuffle of its own, for which the session lets joins use a partitioning by some of their keys. Rows are counted
    first: their number, not their bytes, tells how much they fan out to."""
    spark = df.sparkSession
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // ROWS_A_TASK)), key)


def reliable(df: DataFrame) -> DataFrame:
    """df computed once and kept in the shared checkpoint folder, so that costly input is not
    computed again per use and a lost executor does not start it over."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def spread(df: DataFrame) -> DataFrame:
    """Even out a scan that arrives in fewer parts than half the cores (one small file with
    a single row group); any scan with enough parts is returned untouched, without a shuffle."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() * 2 <= cores else df
