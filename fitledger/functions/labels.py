"""Display text for reports, as Column expressions. Absent values count as JavaScript
falsy values do in the source reports: null, zero and empty text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vocab as v
from .text import lookup, strip

DASH = "—"


def _number_text(c: Column) -> Column:
    """Shortest decimal text, without a trailing ``.0``."""
    return F.regexp_replace(c.cast("string"), r"\.0$", "")


def _truthy_number(c: Column) -> Column:
    return F.when(c != 0, c)


def engine_label(litres: Column, cylinders: Column, induction: Column,
                 empty: str = "Unspecified engine") -> Column:
    label = F.concat_ws(
        " ",
        F.concat(_number_text(_truthy_number(litres)), F.lit("L")),
        F.concat(_number_text(_truthy_number(cylinders)), F.lit("-cyl")),
        F.coalesce(lookup(induction, v.INDUCTION_LABELS), F.nullif(induction, F.lit(""))),
    )
    return F.when(label == "", empty).otherwise(label)


def year_range(start: Column, end: Column) -> Column:
    return (F.when(start.isNull() & end.isNull(), DASH)
            .when(start.isNotNull() & end.isNotNull() & (start != end),
                  F.concat(start.cast("string"), F.lit("–"), end.cast("string")))
            .otherwise(F.coalesce(start, end).cast("string")))


def trim_label(trim: Column) -> Column:
    return F.coalesce(F.nullif(trim, F.lit("")), F.lit("Base"))


def tier_badge(tier: Column) -> Column:
    return F.when(tier.isin("exact", "high"), "green").when(tier == "medium", "amber").otherwise("red")


def tier_label(tier: Column) -> Column:
    return F.coalesce(lookup(tier, v.TIER_LABELS), tier)


def category_label(category: Column) -> Column:
    c = F.nullif(category, F.lit(""))
    return F.coalesce(F.concat(F.upper(F.left(c, F.lit(1))), F.substr(c, F.lit(2))),
                      F.lit("Uncategorized"))


def category_order(category: Column) -> Column:
    """Sort key: fixed order first, unknown categories next, missing last. Sort by this,
    then by the category text."""
    c = F.nullif(category, F.lit(""))
    place = F.array_position(F.array(*[F.lit(x) for x in v.CATEGORY_DISPLAY_ORDER]), c)
    n = len(v.CATEGORY_DISPLAY_ORDER)
    return (F.when(c.isNull(), n + 2).when(place > 0, place.cast("int")).otherwise(n + 1))


def age_bucket(ts: Column, now: Column) -> Column:
    age = F.greatest(F.lit(0.0), now - ts)
    minutes = F.floor(age / 60)
    hours = F.floor(minutes / 60)
    return (F.when(ts.isNull(), DASH)
            .when(age < 60, "just now")
            .when(minutes < 60, F.concat(minutes.cast("string"), F.lit("m ago")))
            .when(hours < 24, F.concat(hours.cast("string"), F.lit("h ago")))
            .otherwise(F.concat(F.floor(hours / 24).cast("string"), F.lit("d ago"))))


def elapsed_label(seconds: Column) -> Column:
    total = F.floor(seconds + 0.5)
    return (F.when(seconds.isNull() | (seconds < 0), DASH)
            .when(total < 60, F.concat(F.lit("+"), total.cast("string"), F.lit("s")))
            .otherwise(F.concat(F.lit("+"), F.floor(total / 60).cast("string"), F.lit("m "),
                                F.lpad((total % 60).cast("string"), 2, "0"), F.lit("s"))))


def money(usd: Column) -> Column:
    return F.concat(F.lit("$"), F.format_string("%.2f", F.coalesce(F.nanvl(usd, F.lit(0.0)), F.lit(0.0))))


def count_label(n: Column) -> Column:
    return F.format_number(F.coalesce(n, F.lit(0)), 0)


def truncate(c: Column, limit: int) -> Column:
    s = F.coalesce(c, F.lit(""))
    return F.when(F.length(s) > limit, F.concat(F.left(s, F.lit(limit)), F.lit("…"))).otherwise(s)


def local_time(ts: Column, pattern: str = "MMM dd, yyyy, HH:mm:ss", missing: str = DASH,
               zone: str = "America/Los_Angeles") -> Column:
    """Epoch seconds as wall-clock text of ``zone``; the session zone must be UTC."""
    return F.coalesce(F.date_format(F.from_utc_timestamp(F.timestamp_seconds(ts), zone), pattern),
                      F.lit(missing))


def event_time(ts: Column) -> Column:
    return local_time(ts, "HH:mm:ss", "--:--:--")


def failure_hint(error: Column) -> Column:
    e = F.coalesce(error, F.lit(""))
    return F.when(e.contains("429"), v.HINT_RATE_LIMIT).when(e.contains("1048576"), v.HINT_TOO_LARGE)


def first_line(notes: Column) -> Column:
    line = strip(F.substring_index(notes, "\n", 1))
    return F.coalesce(F.nullif(line, F.lit("")), F.lit(DASH))


def safe_link(url: Column) -> Column:
    return F.when(url.startswith("https://"), url)


def event_detail(action: Column, rung: Column, ladder_step: Column, confidence: Column, count: Column,
                 resolved: Column, reason: Column, error: Column) -> Column:
    """Detail text of a run event; empty when the action has none or lacks its fields."""
    def text(*parts) -> Column:
        return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])

    step_name = F.coalesce(lookup(ladder_step, {1: "native PDF", 2: "image fallback"}),
                           text("rung ", ladder_step))
    matched = F.when(resolved > 0, text(count, " vehicles, ", resolved, " resolved by Gemini")).otherwise(
        text(count, " vehicles"))
    fixed = {
        "critiquing": "second-opinion critique…",
        "requeued_transient": "forgave transient failure",
        "heal_limit_reached": "parked for human (3 strikes)",
        "failed_both_rungs": "extraction failed on both rungs",
        "resolver_output_invalid": "resolver output rejected",
        "resolver_hallucinated_ids": "hallucinated ids filtered",
    }
    detail = (F.when(action == "reading", text("reading PDF (rung ", rung, ")…"))
              .when(action == "resolving", text("resolving ", count, " ambiguous matches via Gemini…"))
              .when(action == "extracted", text("rung ", ladder_step, " · ", step_name, " · conf ",
                                                F.format_string("%.2f", confidence)))
              .when(action == "escalated", text("→ human review (", F.nullif(reason, F.lit("")), ")"))
              .when(action == "matched", matched)
              .when(action == "discover_failed", text("download failed: ", F.nullif(error, F.lit(""))))
              .otherwise(lookup(action, fixed)))
    incomplete = (action == "extracted") & confidence.isNull()
    return F.when(incomplete, "").otherwise(F.coalesce(detail, F.lit("")))

