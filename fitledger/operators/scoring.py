"""Accuracy of produced records against expected ones.

Rows are compared exploded, keyed by (record, year, folded model), so the work of a very long
record spreads over the cluster; only sums per record are brought together. Lists of part numbers cross as one text each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.bind import let
from .quality import distinct_list


def set_f1(a: Column, b: Column) -> Column:
    """F1 of two arrays taken as sets; 1 when both are empty, 0 when one is."""
    a, b = distinct_list(a), distinct_list(b)
    both = F.size(a) + F.size(b)
    return F.when(both == 0, 1.0).otherwise(
        F.size(F.array_intersect(a, b)).cast("double") * 2 / both)


SEPARATOR = "\x1f"


def _packed(items: Column) -> Column:
    """A list of texts as one text, which is a fraction of the list's size when it is shuffled. A list stays a list if it is empty
    or its texts cannot be told apart in one: if it holds nulls, separators or bytes that are no UTF-8."""
    none = F.array().cast("array<string>")

    def pack(text: Column) -> Column:
        marks = F.octet_length(text) - F.octet_length(F.replace(text, F.lit(SEPARATOR), F.lit("")))
        plain = (F.size(items) > 0) & (marks == F.size(items) - 1) & F.is_valid_utf8(text)
        return F.when(plain, F.struct(text.alias("text"), F.lit(None).cast("array<string>").alias("list"))).otherwise(
            F.struct(F.lit(None).cast("string").alias("text"), F.coalesce(items, none).alias("list")))

    # a null counts as a separator
    return let(F.array_join(items, SEPARATOR, SEPARATOR), pack)


def _unpacked(packed: str) -> Column:
    return F.coalesce(F.split(f"{packed}.text", SEPARATOR, -1), F.col(f"{packed}.list"))


def _entries(records: DataFrame, key: str, side: str) -> DataFrame:
    """One entry for the record itself (``head``) and one per (year_start, folded model) in ``_slot``, which also holds the record's
    key; of rows with one slot the last one stays. A single pass over the records and one shuffle.

    Entries are sorted once behind the shuffle, in the order that the join of two sides needs too: nearly
    all slots of a record differ, so aggregating them before the shuffle would only sort them once more. ``_hash`` is
    the slot's; numbers are sorted faster than structs."""
    def entry(head: bool, year: Column, model: Column, pos: Column, pns: Column, about) -> Column:
        slot = F.struct(F.col(key).alias("key"), F.lit(head).alias("head"), year.cast("int").alias("year"), model.alias("model"))
        return F.struct(slot.alias("_slot"), pos.cast("int").alias("_pos"), _packed(pns).alias("pns"), about.alias("about"))

    about = F.struct("eo_number", "manufacturer", "category", F.coalesce(F.size("fitment"), F.lit(0)).alias("n_rows"))
    kind = records.select(about.alias("a")).schema["a"].dataType
    head = entry(True, F.lit(None), F.lit(""), F.lit(0), F.col("part_numbers"), about)
    rows = F.transform("fitment", lambda r, i: entry(
        False, r["year_start"], F.lower(F.coalesce(r["model"], F.lit(""))), i, r["part_numbers"], F.lit(None).cast(kind)))
    all_entries = F.when(F.col("fitment").isNull(), F.array(head)).otherwise(F.concat(F.array(head), rows))
    of_slot = Window.partitionBy("_hash", "_slot").orderBy("_pos", "pns", "about")
    hashed = records.select(F.inline(all_entries)).withColumn("_hash", F.xxhash64("_slot"))
    return hashed.withColumn("_later", F.lead("_pos").over(of_slot)).filter("_later IS NULL").select(
        "_hash", "_slot", F.struct("pns", "about").alias(side))


def score_records(expected: DataFrame, got: DataFrame, key: str = "doc") -> DataFrame:
    """Per expected record: scalar share, part-number F1, association F1 over every expected
    key, row delta, and matched and total keys. Unrounded. A record that was not produced
    scores zero and has all its raw rows as total."""
    e = _entries(expected, key, "_e")
    g = _entries(got, key, "_g")
    # The slot struct makes null years equal, and both sides are already spread by it. A record without a key meets none.
    pairs = e.join(g, ["_hash", "_slot"], "left")
    head, hit = F.col("_slot.head"), F.col("_g").isNotNull() & F.col("_slot.key").isNotNull()
    f1 = F.when(F.col("_e.pns.text") == F.col("_g.pns.text"), 1.0).otherwise(set_f1(_unpacked("_e.pns"), _unpacked("_g.pns")))
    pairs = pairs.withColumn("_f1", F.when(hit, f1))
    f1 = F.col("_f1")
    same = [F.col(f"_e.about.{c}").eqNullSafe(F.col(f"_g.about.{c}")).cast("int") for c in ("eo_number", "manufacturer", "category")]
    s = pairs.groupBy(F.col("_slot.key").alias(key)).agg(
        F.max(F.when(head & hit, True)).alias("_got"),
        F.max(F.when(head & hit, (same[0] + same[1] + same[2]) / 3)).alias("_scalar"),
        F.max(F.when(head & hit, f1)).alias("_pn"),
        F.max(F.when(head, F.col("_e.about.n_rows"))).alias("_en"), F.max(F.when(head & hit, F.col("_g.about.n_rows"))).alias("_gn"),
        F.sum(F.when(~head, F.when(hit, f1).otherwise(0.0))).alias("_assoc"),
        F.count(F.when(~head & hit, 1)).alias("_matched"), F.count(F.when(~head, 1)).alias("_keys"))
    missing = F.col("_got").isNull()
    empty_ok = F.when(F.col("_gn") == 0, 1.0).otherwise(0.0)
    return s.select(
        key,
        F.coalesce("_scalar", F.lit(0.0)).alias("scalar"), F.coalesce("_pn", F.lit(0.0)).alias("pn_f1"),
        F.when(missing, 0.0).when(F.col("_keys") == 0, empty_ok).otherwise(F.col("_assoc") / F.col("_keys")).alias("assoc_f1"),
        (F.coalesce("_gn", F.lit(0)) - F.col("_en")).alias("fit_delta"), F.col("_matched").alias("matched"),
        F.when(missing, F.col("_en").cast("long")).otherwise(F.col("_keys")).alias("total"))


def score_summary(scores: DataFrame, by: str = "source") -> DataFrame:
    return scores.groupBy(by).agg(
        F.count("*").alias("n"), F.avg("scalar").alias("scalar"), F.avg("pn_f1").alias("pn_f1"),
        F.avg("assoc_f1").alias("assoc_f1"))


def record_checks(records: DataFrame) -> DataFrame:
    """records with ``eo_format`` and ``required_fields``; the type check is validate_records."""
    def filled(c: str) -> Column:
        return F.coalesce(F.col(c) != "", F.lit(False))

    return records.withColumns({
        "eo_format": T.key_format_ok(F.col("eo_number")),
        "required_fields": filled("manufacturer") & filled("category")
        & (F.coalesce(F.size("part_numbers"), F.lit(0)) >= 1),
    })


def check_rates(checked: DataFrame, checks: list[str]) -> DataFrame:
    """check, n, passed and rate of each check column, from one pass over the records."""
    sums = checked.agg(F.count("*").alias("n"), *[F.sum(F.col(c).cast("long")).alias(c) for c in checks])
    rows = F.array(*[F.struct(F.lit(c).alias("check"), F.coalesce(c, F.lit(0).cast("long")).alias("passed")) for c in checks])
    return sums.select("n", F.inline(rows)).select("check", "n", "passed", F.try_divide("passed", "n").alias("rate"))


def trajectory_check(approvals: DataFrame, events: DataFrame, key: str = "doc") -> DataFrame:
    """ok and a note per approval: final state reached, and an extractor event followed by an
    auditor event followed by a matchmaker event.

    The order holds exactly when some auditor event lies between the first extractor event
    and the last matchmaker event, so two plain aggregates replace a per-approval sort.
    events: key, agent, ts, event_id (missing ts sorts first as zero, event_id breaks ties).
    """
    at = F.struct(F.coalesce("ts", F.lit(0.0)).alias("ts"), F.col("event_id"))
    placed = events.filter(F.col(key).isNotNull()).select(key, "agent", at.alias("_at"))
    ends = placed.groupBy(key).agg(
        F.min(F.when(F.col("agent") == "extractor", F.col("_at"))).alias("_first"),
        F.max(F.when(F.col("agent") == "matchmaker", F.col("_at"))).alias("_last"))
    middle = (placed.filter(F.col("agent") == "auditor").join(ends, key)
              .filter((F.col("_at") > F.col("_first")) & (F.col("_at") < F.col("_last")))
              .select(key).distinct().withColumn("_mid", F.lit(True)))
    j = approvals.select(key, "state").join(ends.select(key, F.lit(True).alias("_seen")), key, "left").join(
        middle, key, "left")
    state_ok = F.coalesce(F.col("state").isin("complete", "superseded"), F.lit(False))
    order_ok = F.col("_mid").isNotNull()
    state_note = F.concat(F.lit("state="), F.coalesce("state", F.lit("None")))
    note = (F.when(F.col("_seen").isNull(), F.concat(F.lit("state-only ("), state_note, F.lit("), no events found")))
            .when(state_ok & order_ok, "ok")
            .otherwise(F.concat_ws("; ", F.when(~state_ok, state_note),
                                   F.when(~order_ok, F.lit("missing/out-of-order stage")))))
    ok = F.when(F.col("_seen").isNull(), state_ok).otherwise(state_ok & order_ok)
    return j.select(key, ok.alias("ok"), note.alias("note"))


