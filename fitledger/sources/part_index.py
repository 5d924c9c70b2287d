"""The inverted part index on shared storage: one bucket is opened for one part number.

One row per part number and approval, with what a search shows of it. The rows are partitioned by a hash of the number and sorted by
(number, approval), so a lookup prunes to one bucket before any file is opened, and inside it to the row groups that hold the number. A
number that stands on very many approvals lies in several files of its bucket, and is read in pages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import search as H
from .tables import BUCKETS, KeyedTable

INDEX = "part_number STRING, doc BIGINT, manufacturer STRING, device_name STRING, n_vehicles BIGINT"


class PartIndex:
    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark = spark
        self.table = KeyedTable(spark, path, INDEX, key="part_number", buckets=buckets, sort=["part_number", "doc"])

    def build(self, matches: DataFrame) -> None:
        """Index of all matches: doc, vehicle_id, part_numbers, manufacturer, device_name."""
        self.table.create(H.part_index_rows(matches))

    def update(self, docs: DataFrame, before: DataFrame, after: DataFrame) -> list[int]:
        """Bring the index up to date after the matches of ``docs`` changed: numbers that these documents had ``before`` or have
        ``after`` are touched, rows of other documents under them stay. Returns the buckets rewritten."""
        keys = docs.select("doc").distinct()
        new = H.part_index_rows(after.join(keys, "doc", "left_semi"))
        old = before.join(keys, "doc", "left_semi").select(F.explode("part_numbers").alias("part_number"))
        numbers = old.unionByName(new.select("part_number")).distinct()
        kept = self.table.read(self.table.touched(numbers)).join(numbers, "part_number", "left_semi").join(keys, "doc", "left_anti")
        return self.table.replace(numbers, kept.unionByName(new))

    def files(self, number: str) -> DataFrame:
        """The rows of a number; its bucket is a constant of the plan."""
        here = self.table.bucket(F.lit(number))
        return self.table._files().filter((F.col("bucket") == here) & (F.col("part_number") == number) & F.col("_live")).select(*self.table.columns)

    def lookup(self, number: str, after: int | None = None, size: int = H.PAGE) -> DataFrame:
        """Approvals that list the number, in key order, ``size`` of them behind the approval ``after``. ``next_after`` is what to
        ask with for the next page, null on the last one."""
        rows = self.files(number)
        rows = rows if after is None else rows.filter(F.col("doc") > after)
        return H.page_with_cursor(rows, ["doc"], size).withColumnRenamed("next_doc", "next_after")
