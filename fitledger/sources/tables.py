"""Keyed tables on shared storage, written by buckets of their key.

A table is a folder of Parquet files, partitioned by ``bucket``, a hash of the key. A run that changes some
keys reads and rewrites the buckets of these keys only (dynamic partition overwrite); files of other buckets are
neither read nor touched. The number of buckets is fixed when a table is made: choose it so that a bucket is
some files of a usual size.

Every bucket written holds one row without a key (``_live`` false), so that a bucket whose last row goes is still
rewritten; readers do not see it. A change of a table is one Spark job: its tasks have read the old files before the
job's commit puts the new ones in their place. Rows go from the task that made them into the files of its buckets, with no
shuffle for the layout: a bucket has at most one file a task, and tasks are those of the shuffle by key that a change
needs anyway, which adaptive execution keeps at a usual size. Only sorted tables are dealt out by bucket first. A run that fails before the commit leaves the table as it was and
can be repeated, since all changes are by key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import state as S

BUCKETS = 64
CODEC = "zstd"  # of all files that runs write


class KeyedTable:
    def __init__(self, spark: SparkSession, path: str, schema: str, key: str = "doc", buckets: int = BUCKETS, sort: list[str] | None = None):
        """``sort``: columns by which the rows of a file are ordered, so that readers skip what they do not ask for."""
        self.spark, self.path, self.key, self.buckets, self.sort = spark, path, key, buckets, sort or []
        self.schema = spark.createDataFrame([], schema).schema
        self.columns = self.schema.fieldNames()

    def bucket(self, key: Column | None = None) -> Column:
        return F.pmod(F.xxhash64(F.col(self.key) if key is None else key), F.lit(self.buckets)).cast("int")

    def _files(self) -> DataFrame:
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in self.schema)
        return self.spark.read.schema(f"{schema}, _live BOOLEAN, bucket INT").parquet(self.path)

    def read(self, buckets: list[int] | None = None) -> DataFrame:
        """All rows, or those of some buckets."""
        return self.stored(buckets)

    def stored(self, buckets: list[int] | None = None) -> DataFrame:
        """The same as it lies in the files, which is what changes of the table work on."""
        files = self._files() if buckets is None else self._files().filter(F.col("bucket").isin(buckets))
        return files.filter("_live").select(*self.columns)

    def touched(self, keys: DataFrame) -> list[int]:
        """Buckets of the keys; never more than the table has."""
        return sorted(r.bucket for r in keys.select(self.bucket().alias("bucket")).distinct().collect())

    def _write(self, rows: DataFrame, buckets: list[int]) -> None:
        live = rows.select(*self.columns, F.lit(True).alias("_live"), self.bucket().alias("bucket"))
        marks = self.spark.createDataFrame([(b, False) for b in buckets], "bucket int, _live boolean").coalesce(1)
        out = live.unionByName(marks, allowMissingColumns=True)
        # rebalance joins small buckets in one task and splits large ones over several
        out = out.hint("rebalance", "bucket").sortWithinPartitions("bucket", *self.sort) if self.sort else out
        out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", CODEC).partitionBy("bucket").parquet(self.path)

    def create(self, rows: DataFrame) -> None:
        self._write(rows, list(range(self.buckets)))

    def replace(self, keys: DataFrame, rows: DataFrame, when: Column | None = None) -> list[int]:
        """Rows of ``keys`` give way to ``rows``, which must be rows of these keys; with ``when`` only those stored rows for which it
        holds. Returns the buckets rewritten."""
        buckets = self.touched(keys)
        if buckets:
            self._write(S.replace_by_key(self.stored(buckets), keys, rows.select(*self.columns), self.key, when), buckets)
        return buckets

    def upsert(self, changes: DataFrame) -> list[int]:
        """Partial rows by key: a column that ``changes`` has takes its value where its flag ``has_<column>`` is true or
        missing; other columns stay. Keys of ``changes`` must not repeat. Returns the buckets rewritten."""
        buckets = self.touched(changes)
        if buckets:
            given = set(changes.columns)
            flagged = changes.select(self.key, *[
                x for f in self.schema if f.name != self.key for x in (
                    (F.col(f.name) if f.name in given else F.lit(None)).cast(f.dataType).alias(f.name),
                    (F.col(f"has_{f.name}") if f"has_{f.name}" in given else F.lit(f.name in given)).alias(f"has_{f.name}"))])
            self._write(S.merge_upsert(self.stored(buckets), flagged, self.key), buckets)
        return buckets


def append_run(rows: DataFrame, path: str, run: str = "run_id") -> None:
    """Rows of runs, one folder a run: a run that is repeated replaces its own rows and leaves all others alone."""
    (rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", CODEC).partitionBy(run).parquet(path))


def read_runs(spark: SparkSession, path: str, schema: str, run: str = "run_id") -> DataFrame:
    return spark.read.schema(f"{schema}, {run} STRING").parquet(path)
