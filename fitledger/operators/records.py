"""Typed validation, corrections and comparison of record JSON.

Records arrive as JSON text. They are read as VARIANT so that every scalar keeps the type it
was written with; the rules then accept what a lax typed reader accepts (numeric text for
numbers, whole floats for integers) and name the field of every value it would refuse.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vocab as v
from ..schemas import TEXT_FIELDS, ROW_INTS, ROW_TEXTS


# The rules are SQL text: a rule takes the names of a value and of its kind and gives the
# condition under which a lax typed reader accepts the value.

_names = count()


def _let(value: str, body: Callable[[str], str]) -> str:
    """SQL of ``body(value)`` with ``value`` computed once, however often the body uses it."""
    x = f"x{next(_names)}"
    return f"get(transform(array({value}), {x} -> {body(x)}), 0)"


def _part(value: str, path: str) -> str:
    return f"try_variant_get({value}, '{path}', 'variant')"


def _kind(value: str) -> str:
    return f"coalesce(schema_of_variant({value}), 'MISSING')"


def _as(value: str, kind: str) -> str:
    return f"try_variant_get({value}, '$', '{kind}')"


def _words(words: list[str]) -> str:
    return ", ".join(f"'{w}'" for w in words)


def _text(_: str, kind: str) -> str:
    return f"{kind} = 'STRING'"


def _word_of(words: list[str]):
    return lambda x, k: f"({k} = 'STRING' AND {_as(x, 'string')} IN ({_words(words)}))"


def _number_of(x: str, k: str) -> str:
    """The number a lax reader takes from a value, null when it takes none."""
    return (f"CASE WHEN {k} = 'STRING' THEN try_cast(trim({_as(x, 'string')}) AS DOUBLE) "
            f"WHEN {k} = 'BOOLEAN' THEN CAST(CAST({_as(x, 'boolean')} AS INT) AS DOUBLE) "
            f"WHEN {k} RLIKE '^(BIGINT|INT|SMALLINT|TINYINT|DOUBLE|FLOAT|DECIMAL)' THEN {_as(x, 'double')} END")


def _numeric(x: str, k: str) -> str:
    return f"({_number_of(x, k)}) IS NOT NULL"


def _whole(x: str, k: str) -> str:
    return _let(_number_of(x, k), lambda n: f"({n} IS NOT NULL AND {n} = floor({n}))")


def _share(x: str, k: str) -> str:
    return f"({_number_of(x, k)}) BETWEEN 0 AND 1"


def _optional(rule):
    return lambda x, k: f"({k} IN ('MISSING', 'VOID') OR {rule(x, k)})"


def _all_items(items: str, rule) -> str:
    i = f"i{next(_names)}"
    return f"forall({items}, {i} -> {_holds(i, rule)})"


def _list_of(rule):
    """Missing is fine (empty list); null is not; every item must pass."""
    return lambda x, k: (f"({k} = 'MISSING' OR (startswith({k}, 'ARRAY') AND "
                         f"{_all_items(_as(x, 'array<variant>'), rule)}))")


def _texts(x: str, k: str) -> str:
    """As ``_list_of(_text)``. Lists of texts are by far the longest ones; their items need nothing but their kind, asked once."""
    i = f"i{next(_names)}"
    items = f"forall({_as(x, 'array<variant>')}, {i} -> {_kind(i)} = 'STRING')"
    return f"({k} = 'MISSING' OR (startswith({k}, 'ARRAY') AND {items}))"


def _map_of(rule):
    entries = "map_values({})"
    return lambda x, k: (f"({k} = 'MISSING' OR (startswith({k}, 'OBJECT') AND "
                         f"{_all_items(entries.format(_as(x, 'map<string,variant>')), rule)}))")


def _holds(value: str, rule) -> str:
    return _let(value, lambda p: _let(_kind(p), lambda k: f"coalesce({rule(p, k)}, false)"))


ROW_RULES = {
    **{f: _optional(_whole) for f in ROW_INTS}, **{f: _optional(_text) for f in ROW_TEXTS},
    "displacement_l": _optional(_numeric), "induction": _optional(_word_of(v.INDUCTIONS)),
    "part_numbers": _texts,
}


def _row(x: str, k: str) -> str:
    fields = [_holds(_part(x, f"$.{name}"), rule) for name, rule in ROW_RULES.items()]
    return " AND ".join([f"startswith({k}, 'OBJECT')", *fields])


RECORD_RULES = {
    "eo_number": _text, **{f: _optional(_text) for f in TEXT_FIELDS},
    "category": _optional(_word_of(v.CATEGORIES)), "confidence": _share,
    "supersedes": _texts, "part_numbers": _texts, "illegible_pages": _list_of(_whole),
    "sections_confidence": _map_of(_numeric), "fitment": _list_of(_row),
}


def record_faults(value: str) -> Column:
    """Names of the faulty fields of the record VARIANT in column ``value``, ``not_json`` or
    ``not_object`` for text that is no record at all; empty when the record is valid."""
    faults = ", ".join(f"CASE WHEN NOT {_holds(_part(value, f'$.{name}'), rule)} THEN '{name}' END"
                       for name, rule in RECORD_RULES.items())
    return F.expr(f"CASE WHEN {value} IS NULL THEN array('not_json') "
                  f"WHEN {_as(value, 'map<string,variant>')} IS NULL THEN array('not_object') "
                  f"ELSE array_compact(array({faults})) END")


def validate_records(df: DataFrame, payload: str = "payload") -> DataFrame:
    """df with ``value`` (VARIANT), ``faults`` and ``valid``."""
    return (df.withColumn("value", F.try_parse_json(F.col(payload)))
            .withColumn("faults", record_faults("value"))
            .withColumn("valid", F.size("faults") == 0))


def typed_record(value: str) -> Column:
    """Struct of the valid record VARIANT in column ``value``, with coerced scalars and empty
    lists for missing ones."""
    def text(x: str, f: str) -> str:
        return f"'{f}', try_variant_get({x}, '$.{f}', 'string')"

    def number(x: str, f: str, kind: str) -> str:
        n = _let(_part(x, f"$.{f}"), lambda p: _let(_kind(p), lambda k: _number_of(p, k)))
        return f"'{f}', CAST({n} AS {kind})"

    def texts(x: str, f: str) -> str:
        return f"'{f}', coalesce(try_variant_get({x}, '$.{f}', 'array<string>'), CAST(array() AS ARRAY<STRING>))"

    row = ", ".join([texts("r", "part_numbers"), number("r", "year_start", "INT"), number("r", "year_end", "INT"),
                     text("r", "make"), text("r", "model"), text("r", "trim_note"),
                     number("r", "displacement_l", "DOUBLE"), text("r", "induction"), number("r", "cylinders", "INT")])
    rows = f"transform(try_variant_get({value}, '$.fitment', 'array<variant>'), r -> named_struct({row}))"
    fields = [text(value, "eo_number"), *[text(value, f) for f in TEXT_FIELDS], text(value, "category"),
              number(value, "confidence", "DOUBLE"), texts(value, "supersedes"), texts(value, "part_numbers"),
              f"'fitment', coalesce({rows}, array())",
              f"'sections_confidence', coalesce(try_variant_get({value}, '$.sections_confidence', 'map<string,double>'), CAST(map() AS MAP<STRING, DOUBLE>))",
              f"'illegible_pages', coalesce(try_variant_get({value}, '$.illegible_pages', 'array<int>'), CAST(array() AS ARRAY<INT>))"]
    return F.expr(f"named_struct({', '.join(fields)})")


def merged(value: Column, corrections: Column) -> Column:
    """Top-level merge of two record VARIANTs: a corrected field replaces the whole old one,
    an explicit null included. Gives ``map<string, variant>``."""
    old, new = (F.try_variant_get(x, "$", "map<string,variant>") for x in (value, corrections))
    kept = F.map_filter(old, lambda k, _: ~F.array_contains(F.map_keys(new), k))
    return F.when(new.isNull(), old).otherwise(F.map_concat(kept, new))


def apply_corrections(df: DataFrame, value: str = "value", corrections: str = "corrections") -> DataFrame:
    """df with ``merged_json``, and ``faults`` and ``valid`` of the merged record."""
    fixed = F.to_json(merged(F.col(value), F.try_parse_json(F.col(corrections))))
    return validate_records(df.withColumn("merged_json", fixed), "merged_json")


def corrections_error(text: Column) -> Column:
    """Why a corrections text is refused, null when it is empty or a JSON object."""
    t = F.btrim(text, F.lit(" \t\r\n"))
    value = F.try_parse_json(t)
    return (F.when(t.isNull() | (t == ""), None)
            .when(value.isNull(), "Corrections must be valid JSON.")
            .when(~F.schema_of_variant(value).startswith("OBJECT"),
                  "Corrections must be a JSON object of field: value pairs."))


CHANGE_FIELDS = ["manufacturer", "device_name", "description", "category", "issue_date", "confidence"]


def change_set(old: str, new: str, scalars: list[str] | None = None, rows: str = "fitment") -> Column:
    """Changed top-level fields of struct ``new`` against struct ``old`` as
    ``map<string, variant>``; the row array is sent whole when any row differs; null when
    nothing changed."""
    def entry(name: str, value: Column) -> Column:
        return F.struct(F.lit(name).alias("key"), value.alias("value"))

    entries = [F.when(~F.col(f"{old}.{f}").eqNullSafe(F.col(f"{new}.{f}")),
                      entry(f, F.col(f"{new}.{f}").cast("variant")))
               for f in (CHANGE_FIELDS if scalars is None else scalars)]
    entries.append(F.when(~F.col(f"{old}.{rows}").eqNullSafe(F.col(f"{new}.{rows}")),
                          entry(rows, F.to_variant_object(F.col(f"{new}.{rows}")))))
    changed = F.array_compact(F.array(*entries))
    return F.when(F.size(changed) > 0, F.map_from_entries(changed))


def record_diff(records: DataFrame, baseline: DataFrame) -> DataFrame:
    """Per record: doc, flags and part-number sets against its baseline, and rows on both sides.

    records:  doc, device_name, manufacturer, category, part_numbers, fitment
    baseline: doc, device_name, manufacturer, category, part_numbers, fitment_count

    Rows are counted and part numbers made distinct before the sides meet, so neither row arrays
    nor repeated part numbers are shuffled.
    """
    names = ["device_name", "manufacturer", "category"]
    parts = F.array_distinct(F.coalesce("part_numbers", F.array().cast("array<string>")))
    rows = F.col("fitment")
    new = records.select("doc", *names, parts.alias("_b"), F.coalesce(F.size(rows), F.lit(0)).alias("new_rows"), F.coalesce(F.size(F.filter(
        rows, lambda r: F.coalesce(F.size(r["part_numbers"]), F.lit(0)) > 0)), F.lit(0)).alias("new_rows_with_parts"))
    old = baseline.select("doc", *(F.col(f).alias(f"_{f}") for f in names), parts.alias("_a"), F.col("fitment_count").alias("_n"))
    a, b = F.coalesce("_a", F.array().cast("array<string>")), F.col("_b")
    return new.join(old, "doc", "left").select(
        "doc", *((~F.col(f"_{f}").eqNullSafe(F.col(f))).alias(f"{f}_changed") for f in names),
        F.array_sort(F.array_except(b, a)).alias("added"), F.array_sort(F.array_except(a, b)).alias("removed"),
        F.array_sort(F.array_intersect(b, a)).alias("kept"), F.coalesce("_n", F.lit(0)).alias("base_rows"), "new_rows", "new_rows_with_parts")
