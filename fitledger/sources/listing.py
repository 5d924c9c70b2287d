"""Registry listing pages: decode, merge, and fallback addresses.

A page is one JSON response of at most 500 rows. Its rows are delta-compressed: ``C`` holds
the new cells, bit n of ``R`` says that column n repeats the row before, and an integer cell
is an index into the page's dictionaries.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.bind import let

_DATA = "$.results[0].result.data.dsr.DS[0]"
_CELLS = "array<struct<i:bigint,s:string>>"


def _get(value: Column, path: str, kind: str) -> Column:
    return F.try_variant_get(value, path, kind)


def _cells(row: Column) -> Column:
    """New cells of a row as (index, text) pairs; empty for a missing or null list."""
    def cell(c: Column) -> Column:
        kind = F.schema_of_variant(c)
        return F.struct(F.when(kind == "BIGINT", _get(c, "$", "bigint")).alias("i"),
                        F.when(kind == "STRING", _get(c, "$", "string")).alias("s"))

    return F.coalesce(F.transform(_get(row, "$.C", "array<variant>"), cell), F.array()).cast(_CELLS)


def _merge(carry: Column, new: Column, mask: Column) -> Column:
    """Carried cells with the columns whose mask bit is clear replaced, left to right."""
    def repeated(n: Column) -> Column:
        return F.bit_get(mask, n) == 1

    def column(old: Column, n: Column) -> Column:
        fresh_before = F.size(F.filter(F.sequence(F.lit(0), n), lambda k: (k < n) & ~repeated(k)))
        return F.when(repeated(n), old).otherwise(F.coalesce(F.get(new, fresh_before), old))

    return F.transform(carry, column)


def decode_pages(pages: DataFrame, payload: str = "payload") -> DataFrame:
    """pages with one output row per resolved pair: ``row_no``, ``eo_number``, ``pdf_url``.

    Rows that are no object, or whose cells or mask have the wrong type, are skipped and leave
    the carried row as it was. Each page is folded on its own, so pages run in parallel.
    """
    def resolve(cell: Column, words: Column) -> Column:
        return F.nullif(F.coalesce(F.get(words, cell["i"].cast("int")), cell["s"]), F.lit(""))

    def kind(row: Column, field: str) -> Column:
        return F.coalesce(F.schema_of_variant(_get(row, field, "variant")), F.lit("VOID"))

    def advance(acc: Column, cells: Column, page: Column) -> Column:
        pair = F.when(F.size(cells) >= 2, F.struct(
            F.size(acc["out"]).alias("row_no"),
            resolve(F.get(cells, F.lit(0)), page["d0"]).alias("eo_number"),
            resolve(F.get(cells, F.lit(1)), page["d1"]).alias("pdf_url")))
        return F.struct(cells.alias("carry"), F.array_append(acc["out"], pair).alias("out"))

    def step(acc: Column, row: Column, page: Column) -> Column:
        mask = F.coalesce(_get(row, "$.R", "bigint"), F.lit(0).cast("bigint"))
        carry, c_kind = acc["carry"], kind(row, "$.C")
        readable = (F.schema_of_variant(row).startswith("OBJECT")
                    & (c_kind.startswith("ARRAY") | (c_kind == "VOID"))
                    & (kind(row, "$.R").isin("VOID", "BIGINT") | (F.size(carry) == 0)))
        cells = let(_cells(row), lambda new: F.when(
            (mask != 0) & (F.size(carry) > 0), _merge(carry, new, mask)).otherwise(new))
        return F.when(F.coalesce(readable, F.lit(False)), let(cells, lambda c: advance(acc, c, page))).otherwise(acc)

    def fold(page: Column) -> Column:
        start = F.struct(F.array().cast(_CELLS).alias("carry"),
                         F.array().cast("array<struct<row_no:int,eo_number:string,pdf_url:string>>").alias("out"))
        return F.aggregate(page["rows"], start, lambda acc, row: step(acc, row, page), lambda acc: acc["out"])

    def parts(value: Column) -> Column:
        def words(name: str) -> Column:
            return F.coalesce(_get(value, f"{_DATA}.ValueDicts.{name}", "array<string>"),
                              F.array().cast("array<string>"))
        return F.struct(words("D0").alias("d0"), words("D1").alias("d1"),
                        _get(value, f"{_DATA}.PH[0].DM0", "array<variant>").alias("rows"))

    pairs = let(F.try_parse_json(F.col(payload)), lambda value: let(parts(value), fold))
    return (pages.select(*pages.columns, F.explode(pairs).alias("_p")).select(*pages.columns, "_p.*")
            .filter("eo_number IS NOT NULL AND pdf_url IS NOT NULL"))


def merge_pages(rows: DataFrame) -> DataFrame:
    """One address per key: the last row of the last page wins.
    rows: page_no, row_no, eo_number, pdf_url"""
    return rows.groupBy("eo_number").agg(
        F.max_by("pdf_url", F.struct("page_no", "row_no")).alias("pdf_url"))


def fallback_url(key: Column, base: str) -> Column:
    """Conventional address of a key's document under ``base``."""
    return F.concat(F.lit(base.rstrip("/") + "/"), F.lower(key), F.lit(".pdf"))
