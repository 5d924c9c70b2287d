"""Approval search, paging, facets and parts per vehicle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import labels as L

PAGE = 50


def _one():
    """Window over a page that is already cut to its size."""
    return Window.partitionBy(F.lit(1))


def prefix_search(df: DataFrame, column: str, prefix: str) -> DataFrame:
    """Rows whose text starts with ``prefix``; the filter reaches the parquet scan."""
    return df.filter(F.col(column).startswith(prefix))


def part_number_rows(matches: DataFrame, number: str) -> DataFrame:
    return matches.filter(F.array_contains("part_numbers", number))


def keyset_page(df: DataFrame, key: str, cursor: str | None = None, prefix: str | None = None,
                equals: dict | None = None, size: int = PAGE) -> DataFrame:
    """The next ``size`` rows in key order, each with ``next_cursor``, the last key of the page."""
    for c, x in (equals or {}).items():
        df = df.filter(F.col(c) == x)
    if prefix:
        df = prefix_search(df, key, prefix)
    if cursor is not None:
        df = df.filter(F.col(key) > cursor)
    return df.orderBy(key).limit(size).withColumn("next_cursor", F.max(key).over(_one()))


def review_page(reviews: DataFrame, cursor=None, size: int = PAGE) -> DataFrame:
    """The next ``size`` open reviews, oldest first. A cursor whose review is gone gives page
    one with ``fell_back`` set."""
    page = reviews.filter(F.col("status") == "open")
    stale = F.lit(False)
    if cursor is not None:
        at = reviews.filter(F.col("id") == cursor).select(F.max("created_at")).scalar()
        page = page.withColumn("_at", at)
        after = (F.col("created_at") > F.col("_at")) | (
            (F.col("created_at") == F.col("_at")) & (F.col("id") > F.lit(cursor)))
        page = page.filter(F.col("_at").isNull() | after)
        stale = F.col("_at").isNull()
    return page.withColumn("fell_back", stale).drop("_at").orderBy("created_at", "id").limit(size)


def resolved_reviews(reviews: DataFrame, size: int = 20) -> DataFrame:
    """Latest resolved reviews, over all of them."""
    return (reviews.filter(F.col("status").isin("approved", "rejected"))
            .orderBy(F.coalesce("resolved_at", F.lit(0.0)).desc(), F.col("id")).limit(size))


def facet_filter(catalog: DataFrame, make=None, model=None, induction=None, year=None, year_min=None,
                 year_max=None, size: int | None = None) -> DataFrame:
    """Vehicles that meet every facet given. An exact year disables the year range; a vehicle
    without a year fails either bound. All of them, or the first ``size`` by year and id."""
    for column, x in (("make", make), ("model", model), ("induction", induction)):
        if x:
            catalog = catalog.filter(F.col(column) == x)
    if year is not None:
        catalog = catalog.filter(F.col("year") == year)
    else:
        if year_min is not None:
            catalog = catalog.filter(F.col("year") >= year_min)
        if year_max is not None:
            catalog = catalog.filter(F.col("year") <= year_max)
    if size is None:
        return catalog
    return catalog.orderBy(F.coalesce("year", F.lit(0)), "vehicle_id").limit(size)


def _filled(c: str) -> Column:
    return F.nullif(c, F.lit(""))


def facets(catalog: DataFrame) -> DataFrame:
    """Distinct facet values as rows (kind, parent, value), blanks left out; models have their
    make as parent. One pass over the catalog and one combine."""
    def facet(kind: str, value: Column, parent: Column | None = None) -> Column:
        return F.struct(F.lit(kind).alias("kind"),
                        (F.lit(None).cast("string") if parent is None else parent).alias("parent"),
                        value.cast("string").alias("value"))

    rows = F.array(facet("make", _filled("make")), facet("year", F.col("year")),
                   facet("induction", _filled("induction")),
                   facet("model", F.when(_filled("make").isNotNull(), _filled("model")), _filled("make")))
    return catalog.select(F.inline(rows)).filter(F.col("value").isNotNull()).distinct()


CASCADE = ["year", "make", "model", "trim"]


def cascade_rows(catalog: DataFrame) -> DataFrame:
    """Rows of the year, make, model, trim, engine cascade. Levels 0 to 3 list distinct
    options; level 4 lists every engine with its label, vehicle and facts (litres, induction, cylinders). Vehicles without year,
    make, model or id are left out, a missing trim is shown as Base. One rollup gives all levels."""
    full = catalog.filter(F.col("year").isNotNull() & _filled("make").isNotNull()
                          & _filled("model").isNotNull() & F.col("vehicle_id").isNotNull())
    engine = F.struct("vehicle_id", L.engine_label(F.col("displacement_l"), F.col("cylinders"), F.col("induction")).alias("label"),
                      F.col("displacement_l").alias("litres"), "induction", "cylinders")
    named = full.select("year", "make", "model", L.trim_label(F.col("trim")).alias("trim"), engine.alias("engine"))
    # the grouping id has one bit for each column rolled up: 0 is an engine, 15 a year, 31 the whole catalog
    rolled = named.rollup(*CASCADE, "engine").agg(F.grouping_id().alias("_rolled")).filter("_rolled < 31")
    level = (4 - F.log2(F.col("_rolled") + 1)).cast("int")
    return rolled.select(level.alias("level"), *CASCADE, "engine.*")


def cascade_lists(catalog: DataFrame) -> DataFrame:
    """The cascade as one sorted option list per parent, the shape of the published snapshot: options are
    (value, vehicle_id, litres, induction, cylinders), of which levels 0 to 3 have the value only.
    Lists are as long as one parent has options."""
    path = F.array(F.col("year").cast("string"), "make", "model", "trim", "label")
    option = F.struct(F.get(path, F.col("level")).alias("value"), "vehicle_id", "litres", "induction", "cylinders")
    return cascade_rows(catalog).select("level", F.slice(path, F.lit(1), F.col("level")).alias("parent"), option.alias("_o")).groupBy("level", "parent").agg(
        F.array_sort(F.collect_list("_o")).alias("options"))


def page_with_cursor(rows: DataFrame, order: list[str], size: int) -> DataFrame:
    """The first ``size`` rows in order, each with ``next_<column>`` of the order: where the next page begins behind, null on the
    last page. Only ``size`` + 1 rows are compared."""
    page = rows.orderBy(*order).limit(size + 1)
    ranked = page.withColumns({"_more": F.count("*").over(_one()) > size, "_rn": F.row_number().over(_one().orderBy(*order))}).filter(F.col("_rn") <= size)
    last = F.max(F.struct(*order)).over(_one())
    return ranked.withColumns({f"next_{c}": F.when(F.col("_more"), last[c]) for c in order}).drop("_more", "_rn")


def part_search(matches: DataFrame, number: str, size: int = PAGE, after: int | None = None) -> DataFrame:
    """Approvals with a match that lists the part number, in key order behind the approval ``after``; all matches are
    scanned (``sources.part_index`` opens one bucket). The fields come from the match with the least vehicle id, ``truncated`` says
    whether there are more approvals than shown, and ``next_doc`` what to ask with for them."""
    rows = part_index_rows(part_number_rows(matches, number).withColumn("part_numbers", F.array(F.lit(number))))
    rows = rows if after is None else rows.filter(F.col("doc") > after)
    page = page_with_cursor(rows.select("doc", "manufacturer", "device_name"), ["doc"], size)
    return page.withColumn("truncated", F.col("next_doc").isNotNull()).select("doc", "manufacturer", "device_name", "truncated", "next_doc")


def part_index_rows(matches: DataFrame) -> DataFrame:
    """One row per part number and approval: the fields of the match with the least vehicle id, and how many vehicles. Minimums and
    counts combine before the shuffle."""
    listed = matches.select(F.explode(F.array_distinct("part_numbers")).alias("part_number"), "doc", "vehicle_id", "manufacturer", "device_name")
    grouped = listed.groupBy("part_number", "doc").agg(
        F.min_by(F.struct("manufacturer", "device_name"), F.struct("vehicle_id", "device_name", "manufacturer")).alias("m"),
        F.count_distinct("vehicle_id").alias("n_vehicles"))
    return grouped.select("part_number", "doc", "m.manufacturer", "m.device_name", "n_vehicles")


def part_index(matches: DataFrame) -> DataFrame:
    """Inverted index rows (part_number, doc, vehicle_id), each once. Kept as rows: a part
    number on a third of all matches is then no longer than any other. Write it bucketed or
    sorted by part_number so that one number reads a few files."""
    return matches.select(F.explode("part_numbers").alias("part_number"), "doc", "vehicle_id").distinct()


def part_index_sizes(index: DataFrame) -> DataFrame:
    """Approvals and vehicles per part number, counted through partial distinct sets."""
    return index.groupBy("part_number").agg(
        F.count_distinct("doc").alias("n_approvals"), F.count_distinct("vehicle_id").alias("n_vehicles"))


def vehicle_parts(matches: DataFrame, vehicle_id, category: str | None = None,
                  approvals: DataFrame | None = None) -> DataFrame:
    """Parts of a vehicle with their section and place: sections in display order, parts by
    device then manufacturer. Superseded approvals are shown unless ``approvals`` is given."""
    df = matches.filter(F.col("vehicle_id") == vehicle_id)
    if category:
        df = df.filter(F.col("category") == category)
    if approvals is not None:
        gone = approvals.filter(F.col("state") == "superseded").select("doc")
        df = df.join(gone, "doc", "left_anti")
    c = F.col("category")
    section = Window.partitionBy("section", "section_label").orderBy(
        F.coalesce("device_name", F.lit("")), F.coalesce("manufacturer", F.lit("")), "doc")
    return (df.withColumns({"section": L.category_order(c), "section_label": L.category_label(c)})
            .withColumn("place", F.row_number().over(section)))


