"""Imports of the older baseline and of the vehicle catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vocab as v
from ..functions.text import lookup


def read_jdbc(spark: SparkSession, url: str, table: str, **options: str) -> DataFrame:
    """Table of a relational source; pass partitionColumn, lowerBound, upperBound and
    numPartitions for a parallel read."""
    return spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()


def winning_parts(parts: DataFrame) -> DataFrame:
    """Of several parts with one key the last one.
    parts: part_id, eo_number, device_name, category, manufacturer_id"""
    fields = F.struct("part_id", "device_name", "category", "manufacturer_id")
    return parts.groupBy("eo_number").agg(F.max_by(fields, "part_id").alias("p")).select("eo_number", "p.*")


def import_baseline(parts: DataFrame, manufacturers: DataFrame, fitments: DataFrame) -> DataFrame:
    """Flat baseline record per key with its fitment count. Winners are picked first, so that
    only their fitments are counted; counts combine on the map side.
    manufacturers: manufacturer_id, manufacturer; fitments: part_id"""
    winners = winning_parts(parts)
    counts = (fitments.join(winners.select("part_id"), "part_id", "left_semi")
              .groupBy("part_id").agg(F.count("*").alias("n")))
    return (winners.join(manufacturers, "manufacturer_id", "left").join(counts, "part_id", "left")
            .select("eo_number", "part_id", "device_name", "manufacturer", "category",
                    F.coalesce("n", F.lit(0)).cast("long").alias("fitment_count")))


def baseline_numbers(baseline: DataFrame, numbers: DataFrame) -> DataFrame:
    """(eo_number, number) of every baseline record. Kept as rows, so a part with very many
    numbers is not gathered into one task. numbers: part_id, number"""
    return numbers.join(baseline.select("part_id", "eo_number"), "part_id").select("eo_number", "number")


def import_catalog(vehicles: DataFrame) -> DataFrame:
    """Catalog rows with the induction text mapped to the record vocabulary.
    vehicles: id, year, make, model, trim, engine_displacement_l, engine_induction, engine_cylinders"""
    return vehicles.select(
        F.col("id").cast("string").alias("vehicle_id"), "year", "make", "model", "trim",
        F.col("engine_displacement_l").alias("displacement_l"),
        lookup(F.col("engine_induction"), v.CATALOG_INDUCTION).alias("induction"),
        F.col("engine_cylinders").alias("cylinders"))
