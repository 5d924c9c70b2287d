"""Checks and corrections on extracted records.

A record is one row with its application rows as an array of structs, so every check is an
expression on one row and needs no shuffle; only baselines and verdicts are joined in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vocab as v
from ..functions.bind import let
from ..session import fits_broadcast

ROW_FIELDS = ["model", "make", "year_start", "year_end", "displacement_l", "induction",
              "cylinders", "trim_note"]


def make_coverage(rows: DataFrame, catalog: DataFrame) -> DataFrame:
    """rows with ``make_norm`` and ``known``: the make, or its alias, is in the catalog or a
    powersports make. A coverage fact, not a reason to reject."""
    known = catalog.select(T.normalize_make(F.col("make")).alias("_k")).distinct()
    known = F.broadcast(known) if fits_broadcast(known) else known
    named = rows.withColumns({"make_norm": T.normalize_make(F.col("make")),
                              "_alias": T.make_alias(F.col("make"))})
    direct = known.withColumnRenamed("_k", "make_norm").withColumn("_d", F.lit(True))
    through = known.withColumnRenamed("_k", "_alias").withColumn("_a", F.lit(True))
    return (named.join(direct, "make_norm", "left").join(through, "_alias", "left")
            .withColumn("known", F.coalesce(
                F.col("_d") | F.col("_a"), F.col("_d"), F.col("_a"), F.lit(False))
                | T.is_powersports(F.col("make_norm"))
                | F.coalesce(T.is_powersports(F.col("_alias")), F.lit(False)))
            .drop("_alias", "_d", "_a"))


def dedupe_rows(fitment: Column) -> Column:
    """Application rows without exact repeats; the first of equal rows stays, in order.

    Part numbers count as a sorted list. Rows are sorted with their position, each row that
    equals its left neighbour is dropped, and the rest are put back in order: n log n within
    the record and no shuffle.
    """
    keyed = F.array_sort(F.transform(fitment, lambda r, i: F.struct(
        F.struct(*[r[f].alias(f) for f in ROW_FIELDS],
                 F.array_sort(F.coalesce(r["part_numbers"], F.array().cast("array<string>"))).alias("p")).alias("k"),
        i.alias("i"))))

    def first_places(sorted_rows: Column) -> Column:
        firsts = F.filter(sorted_rows, lambda e, j: (j == 0) | ~F.get(sorted_rows, j - 1)["k"].eqNullSafe(e["k"]))
        return F.array_sort(F.transform(firsts, lambda e: e["i"]))

    return F.transform(let(keyed, first_places), lambda i: F.get(fitment, i))


def with_deduped_rows(records: DataFrame) -> DataFrame:
    """records with repeats removed and ``removed`` counting them."""
    return (records.withColumn("_rows", dedupe_rows(F.col("fitment")))
            .withColumn("removed", F.size("fitment") - F.size("_rows"))
            .withColumn("fitment", F.col("_rows")).drop("_rows"))


def gate_issues(eo_number: Column, fitment: Column, part_numbers: Column, category: Column) -> Column:
    """Ordered list of rule violations; empty when the record passes."""
    low, high = v.YEAR_RANGE
    dlow, dhigh = v.DISPLACEMENT_RANGE

    def off(y: Column) -> Column:
        return F.coalesce((y < low) | (y > high), F.lit(False))

    def bad_years(r: Column) -> Column:
        a, b = r["year_start"], r["year_end"]
        inverted = F.coalesce((a != 0) & (b != 0) & (a > b), F.lit(False))
        return off(a) | off(b) | inverted

    def bad_displacement(r: Column) -> Column:
        return F.coalesce(~r["displacement_l"].between(dlow, dhigh), F.lit(False))

    return F.array_compact(F.array(
        F.when(~T.key_format_ok(eo_number), "bad_eo_number"),
        F.when(F.exists(fitment, bad_years), "bad_year"),
        F.when(F.exists(fitment, bad_displacement), "bad_displacement"),
        F.when(F.exists(part_numbers, lambda p: ~T.part_number_ok(p)), "bad_part_number"),
        F.when(category.isNull(), "no_category"),
    ))


def distinct_list(c: Column) -> Column:
    return F.array_distinct(F.coalesce(c, F.array().cast("array<string>")))


def divergence(parts: Column, n_rows: Column, base_parts: Column, base_rows: Column,
               has_base: Column) -> Column:
    """Mean of part-number dissimilarity (1 - Jaccard) and row-count dissimilarity; zero
    without a baseline. Rounded to three digits, ties to even, as the ceiling is compared with that."""
    a, b = distinct_list(parts), distinct_list(base_parts)
    shared = F.size(F.array_intersect(a, b)).cast("double")
    union = F.size(a) + F.size(b) - shared
    pn = F.when(union == 0, 1.0).otherwise(shared / union)
    nb = F.coalesce(base_rows, F.lit(0))
    most = F.greatest(n_rows, nb)
    rows = F.when(most == 0, 1.0).otherwise(F.least(n_rows, nb) / most)
    return F.when(has_base, F.bround(((1 - pn) + (1 - rows)) / 2, 3)).otherwise(0.0)


def repeatable_draw(key: Column, seed: int = 0) -> Column:
    """A number in [0, 1) that stays the same for a key, so that reruns route alike."""
    return F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(10_000)) / F.lit(10_000.0)


def route_reason(issues: Column, div: Column, confidence: Column, draw: Column) -> Column:
    """Why a record needs a second look, null when it can be accepted as it is."""
    return (F.when(F.size(issues) > 0, "validation_failure")
            .when(confidence < v.CONFIDENCE_FLOOR, "low_confidence")
            .when(div > v.DIVERGENCE_CEILING, "legacy_divergence")
            .when(draw < v.QA_RATE, "qa_sample"))


def fix_identity(records: DataFrame, requested: str = "doc_key") -> DataFrame:
    """The requested key outranks the key read from the document; ``key_corrected`` marks
    replaced keys and ``key_read`` keeps what was read."""
    return (records.withColumn("key_read", F.col("eo_number"))
            .withColumn("key_corrected", ~F.col("eo_number").eqNullSafe(F.col(requested)))
            .withColumn("eo_number", F.col(requested)))


def resolve_verdicts(df: DataFrame) -> DataFrame:
    """Outcome of a routed record given a second opinion.

    Needs ``reason`` (null: accepted without a second look), ``issues``, ``verdict``,
    ``reasons`` (array), and for verdict ``fix`` ``fix_valid`` and ``fix_issues`` of the
    corrected record. Adds ``outcome``, ``final_reason`` and ``notes``.
    """
    said = F.array_join(F.coalesce("reasons", F.array().cast("array<string>")), "; ")
    kind = F.col("verdict")
    unknown = ~F.coalesce(kind.isin("accept", "fix", "escalate"), F.lit(False))
    fixed = (kind == "fix") & F.col("fix_valid") & (F.size("fix_issues") == 0)
    accepted = F.col("reason").isNull() | fixed | ((kind == "accept") & (F.size("issues") == 0))
    notes = (F.when(unknown, "critique output failed validation")
             .when((kind == "fix") & ~F.col("fix_valid"), F.concat(said, F.lit(" (corrections failed validation)")))
             .when(kind == "accept", F.concat(F.lit("gate: "), F.array_join("issues", ", "), F.lit("; critic: "), said))
             .otherwise(said))
    accepted = F.coalesce(accepted, F.lit(False))
    return df.withColumns({
        "outcome": F.when(accepted, "accepted").otherwise("escalated"),
        "final_reason": F.when(accepted, None).when(unknown | (kind == "fix"), "validation_failure")
        .otherwise(F.col("reason")),
        "notes": F.when(~accepted, notes),
    })
