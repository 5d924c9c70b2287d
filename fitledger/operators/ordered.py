"""Running values over one long order without putting that order into one task.

The order is cut into chunks. Chunk totals are summed first; a window then runs over the few totals and, inside each
chunk, over its rows. A caller can name a column that never decreases along the order as the chunk. Without one the
rows are range partitioned by keys and order, and every partition is a chunk: then there are as many totals as
partitions, however long the order is, and one hot key is spread over many tasks. That costs a job of its own, because both
passes must see the same partitions, which are kept in the shared checkpoint folder.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import reliable


def _cut(df: DataFrame, keys: list[str], chunk: Column) -> DataFrame:
    """df with ``_k``, keys and chunk as one struct: rows of null keys stay together and are
    not lost when totals are joined back."""
    return df.withColumn("_k", F.struct(*keys, chunk.alias("_chunk")))


def ranged(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """df range partitioned by keys and order, kept, with the partition's number in ``_range``. Rows that are equal in
    keys and order share a partition, so the order should tell rows apart."""
    return reliable(df.repartitionByRange(*keys, *order).withColumn("_range", F.spark_partition_id()))


def _chunked(df: DataFrame, keys: list[str], order: list[str], chunk: Column | None) -> DataFrame:
    if chunk is None:
        return _cut(ranged(df, keys, order), keys, F.col("_range")).drop("_range")
    return _cut(df, keys, chunk)


def _before(totals: DataFrame, keys: list[str], value: Column) -> DataFrame:
    w = Window.partitionBy(*[F.col(f"_k.{k}") for k in keys]).orderBy("_k._chunk").rowsBetween(
        Window.unboundedPreceding, -1)
    return totals.select("_k", value.over(w).alias("_before"))


def running_sum(df: DataFrame, keys: list[str], order: list[str], value: str, chunk: Column | None = None,
                name: str = "cum") -> DataFrame:
    """df with ``name``: sum of ``value`` up to and including the row, per ``keys``."""
    cut = _chunked(df, keys, order, chunk)
    before = _before(cut.groupBy("_k").agg(F.sum(value).alias("_t")), keys, F.sum("_t"))
    inside = Window.partitionBy("_k").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    zero = F.lit(0)
    return (cut.withColumn("_in", F.sum(value).over(inside)).join(before, "_k")
            .withColumn(name, F.coalesce("_in", zero) + F.coalesce("_before", zero))
            .drop("_k", "_in", "_before"))


def last_known_before(df: DataFrame, keys: list[str], order: list[str], value: str, chunk: Column | None = None,
                      name: str = "prev") -> DataFrame:
    """df with ``name``: the latest non-null ``value`` before the row, per ``keys``. ``value``
    must not decrease along the order, which makes the latest one the greatest one."""
    cut = _chunked(df, keys, order, chunk)
    before = _before(cut.groupBy("_k").agg(F.max(value).alias("_t")), keys, F.max("_t"))
    inside = Window.partitionBy("_k").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (cut.withColumn("_in", F.max(value).over(inside)).join(before, "_k")
            .withColumn(name, F.coalesce("_in", "_before")).drop("_k", "_in", "_before"))


def running_count(df: DataFrame, keys: list[str], order: list[str], chunk: Column | None, name: str) -> DataFrame:
    """df with ``name``: 1, 2, ... per ``keys`` in order."""
    ones = df.withColumn("_one", F.lit(1).cast("long"))
    return running_sum(ones, keys, order, "_one", chunk, name).drop("_one")


def budget_prefix(df: DataFrame, keys: list[str], order: list[str], cost: str, limit, chunk: Column | None = None) -> DataFrame:
    """Rows in order until the next cost would pass ``limit``; costs are not negative, so the
    rows kept are exactly those whose running cost stays within it."""
    return running_sum(df, keys, order, cost, chunk, "spent").filter(F.col("spent") <= F.lit(limit))
