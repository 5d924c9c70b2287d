"""Application rows against the vehicle catalog.

Inputs
  rows     doc, row_idx, make, model, year_start, year_end, displacement_l, induction,
           cylinders, part_numbers; (doc, row_idx) is unique
  catalog  vehicle_id, year, make, model, displacement_l, induction, cylinders

Whether a row fits a vehicle depends on seven attributes of the vehicle, and vehicles that differ in trim only
share them all. Rows meet each set of attributes once (a class of vehicles). ``application_matches(..., folded=True)`` and what
follows from it carry ``class_id`` in place of ``vehicle_id``, and ``expanded`` writes the vehicles out last, with no
shuffle of pairs behind it. Rows are not shuffled to meet the classes while these are within the broadcast bound,
and wide columns are joined back to the winners.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import match as M
from ..functions import vocab as v
from ..session import BROADCAST_ROW_BOUND, dealt, dimension_join, fits_broadcast

ROW_KEY = ["doc", "row_idx"]
OPEN_START, OPEN_END = 0, 9999
# What decides whether and how well a vehicle fits, as _catalog_keys names it.
ATTRIBUTES = ["_y", "_make", "_cm", "_word", "_cl", "_ci", "_cc"]
# Those of them that decide whether it fits; the others decide how well.
COARSE = ATTRIBUTES[:5]


def make_key(make: Column) -> Column:
    return F.lower(F.coalesce(make, F.lit("")))


def _year_bounds(rows: DataFrame) -> DataFrame:
    """Zero and null years are open ends."""
    return rows.withColumns({
        "_lo": F.coalesce(F.nullif(F.col("year_start").cast("int"), F.lit(0)), F.lit(OPEN_START)),
        "_hi": F.coalesce(F.nullif(F.col("year_end").cast("int"), F.lit(0)), F.lit(OPEN_END)),
    })


def candidate_counts(rows: DataFrame, catalog: DataFrame, bound: int = BROADCAST_ROW_BOUND) -> DataFrame:
    """rows plus ``n_candidates``: catalog vehicles of the make inside the year range.

    Counted from a cumulative year profile per make, so no candidate pair is built.
    """
    per_year = (catalog.filter(F.col("year").between(OPEN_START, OPEN_END))
                .groupBy(make_key(F.col("make")).alias("_make"), F.col("year").cast("int").alias("_y"))
                .agg(F.count("*").alias("_n")))
    profile = (per_year.groupBy("_make")
               .agg(F.collect_list(F.struct("_y", "_n")).alias("_years"),
                    F.min("_y").alias("_first"), F.max("_y").alias("_last"))
               .withColumn("_cum", F.transform(
                   F.sequence("_first", "_last"),
                   lambda y: F.aggregate(F.filter("_years", lambda e: e["_y"] <= y),
                                         F.lit(0).cast("long"), lambda a, e: a + e["_n"])))
               .select("_make", "_first", "_last", "_cum"))

    def upto(y: Column) -> Column:
        y = F.least(y, F.col("_last"))
        return F.when(y < F.col("_first"), F.lit(0).cast("long")).otherwise(
            F.get("_cum", y - F.col("_first")))

    keyed = _year_bounds(rows).withColumn("_make", make_key(F.col("make")))
    joined = dimension_join(keyed, profile, ["_make"], ROW_KEY, fits_broadcast(profile, bound), "left")
    n = F.greatest(upto(F.col("_hi")) - upto(F.col("_lo") - 1), F.lit(0).cast("long"))
    return joined.withColumn("n_candidates", F.coalesce(n, F.lit(0).cast("long"))).drop(
        "_make", "_first", "_last", "_cum", "_lo", "_hi")


def application_matches(rows: DataFrame, catalog: DataFrame,
                        bound: int = BROADCAST_ROW_BOUND, folded: bool = False, by_doc: bool = False) -> DataFrame:
    """(doc, row_idx, vehicle_id, tier) for every row and vehicle that fit; with ``folded`` class_id stands for the vehicle. With ``by_doc``
    rows that meet a broadcast catalog are dealt by document first, so whatever is grouped by document and more behind it
    shuffles rows in place of matches.

    Rows and vehicles meet under (make, first word of the model). Sets of attributes that differ in induction and cylinders
    only are asked once whether they fit, since these decide the tier alone. While the catalog is within the broadcast bound, its
    sets lie under their key by year: a row looks its key up once, passes over the years outside its range and asks
    the sets of the others, displacement first and then the two-way prefix rule. Beyond the bound the same is a condition of a shuffled join.
    """
    if folded:
        one = vehicle_classes(catalog).select("class_id", F.explode("_variants").alias("_a")).select("class_id", "_a.*")
        fine = F.struct("_ci", "_cc", "class_id")
    else:
        one = _catalog_keys(catalog).groupBy(*ATTRIBUTES).agg(F.collect_list(F.struct("vehicle_id")).alias("_ids"))
        fine = F.struct("_ci", "_cc", "_ids")
    side = one.groupBy(*COARSE).agg(F.collect_list(fine).alias("_fine"))
    met = _meet(rows, side, bound, by_doc, "_fine").select(*ROW_KEY, "_rl", "_ri", "_rc", "_cl", F.explode("_fine").alias("_f"))
    tier = M.engine_tier(*(F.col(c) for c in ("_rl", "_ri", "_rc", "_cl", "_f._ci", "_f._cc"))).alias("tier")
    if folded:
        return met.select(*ROW_KEY, "_f.class_id", tier)
    return met.select(*ROW_KEY, tier, F.explode("_f._ids").alias("_v")).select(*ROW_KEY, "_v.vehicle_id", "tier")


def _meet(rows: DataFrame, side: DataFrame, bound: int, by_doc: bool, *carry: str) -> DataFrame:
    """Rows as in ``_row_keys`` and the sets of ``COARSE`` attributes that fit them, with the columns ``carry`` of the sets."""
    if not fits_broadcast(side, bound):
        return dimension_join(_row_keys(rows), side, ["_make", "_word"], ROW_KEY, False, when=_fits())
    named = F.collect_list(F.struct("_cm", "_cl", *carry)).alias("_named")
    dated = (side.groupBy("_make", "_word", "_y").agg(named)
             .groupBy("_make", "_word").agg(F.collect_list(F.struct("_y", "_named")).alias("_dates")))
    keyed = _row_keys(dealt(rows, "doc") if by_doc else rows)
    found = dimension_join(keyed, dated, ["_make", "_word"], ROW_KEY, True)
    kept = [c for c in keyed.columns if c not in ("_make", "_word")]
    in_range = found.select(*kept, F.explode("_dates").alias("_d")).filter(F.col("_d._y").between(F.col("_lo"), F.col("_hi")))
    asked = in_range.select(*kept, F.explode("_d._named").alias("_n"))
    cm, cl = F.col("_n._cm"), F.col("_n._cl")
    return asked.filter(_engine_fits(cl)).filter(_name_fits(cm)).select(
        *kept, cl.alias("_cl"), *(F.col(f"_n.{c}").alias(c) for c in carry))


def vehicle_classes(catalog: DataFrame) -> DataFrame:
    """class_id, ``_variants`` (the sets of attributes), ``_ids`` (the vehicles) and n_vehicles. A vehicle listed several times has
    several variants; each vehicle is in one class, named after its smallest vehicle. Classes that are given come back as they
    are: wherever a catalog is only asked for its classes, a run can pass those it has stored."""
    if "_variants" in catalog.columns:
        return catalog
    by_id = _catalog_keys(catalog).groupBy("vehicle_id").agg(F.array_sort(F.collect_set(F.struct(*ATTRIBUTES))).alias("_variants"))
    return by_id.groupBy("_variants").agg(
        F.coalesce(F.min("vehicle_id").cast("string"), F.lit("none")).alias("class_id"),
        F.collect_list(F.struct("vehicle_id")).alias("_ids"), F.count("*").alias("n_vehicles"))


def expanded(folded: DataFrame, catalog: DataFrame, bound: int = BROADCAST_ROW_BOUND) -> DataFrame:
    """One row per vehicle of each row's class, ``vehicle_id`` in the place of ``class_id``; a row without a class keeps its vehicle."""
    members = vehicle_classes(catalog).select("class_id", "_ids")
    own = F.array(F.struct("vehicle_id")) if "vehicle_id" in folded.columns else F.array().cast(members.schema["_ids"].dataType)
    kept = [c for c in folded.columns if c != "vehicle_id"]
    out = dimension_join(folded, members, ["class_id"], ["doc"], fits_broadcast(members, bound), "left")
    return out.select(*kept, F.explode(F.coalesce("_ids", own)).alias("_v")).select(
        *(F.col("_v.vehicle_id") if c == "class_id" else F.col(c) for c in kept))


def sized(folded: DataFrame, catalog: DataFrame, bound: int = BROADCAST_ROW_BOUND) -> DataFrame:
    """folded rows with ``n_vehicles``, the number of vehicles each one stands for."""
    sizes = vehicle_classes(catalog).select("class_id", "n_vehicles")
    out = dimension_join(folded, sizes, ["class_id"], ["doc"], fits_broadcast(sizes, bound), "left")
    return out.withColumn("n_vehicles", F.coalesce("n_vehicles", F.lit(1).cast("long")))


def _engine_fits(cl: Column) -> Column:
    """Whether ``engine_tier`` has a tier, which displacements alone decide."""
    return F.col("_rl").isNull() | (F.abs(cl - F.col("_rl")) <= F.lit(v.DISPLACEMENT_TOLERANCE))


def _name_fits(cm: Column) -> Column:
    return M.extends(cm, F.col("_rm")) | M.extends(F.col("_rm"), cm)


def _fits() -> Column:
    return F.col("_y").between(F.col("_lo"), F.col("_hi")) & _engine_fits(F.col("_cl")) & _name_fits(F.col("_cm"))


def _row_keys(rows: DataFrame, *keep: str) -> DataFrame:
    model = M.fold(F.col("model"))
    return _year_bounds(rows).select(
        *ROW_KEY, *keep, "_lo", "_hi", make_key(F.col("make")).alias("_make"), model.alias("_rm"),
        M.first_word(model).alias("_word"), F.col("displacement_l").alias("_rl"),
        F.col("induction").alias("_ri"), F.col("cylinders").alias("_rc"))


def _catalog_keys(catalog: DataFrame) -> DataFrame:
    model = M.fold(F.col("model"))
    return catalog.select(
        "vehicle_id", F.col("year").cast("int").alias("_y"), make_key(F.col("make")).alias("_make"),
        model.alias("_cm"), M.first_word(model).alias("_word"), (F.col("displacement_l") + F.lit(0.0)).alias("_cl"),
        F.col("induction").alias("_ci"), F.col("cylinders").alias("_cc"))


def best_matches(matches: DataFrame) -> DataFrame:
    """Best tier per (doc, vehicle), or per (doc, class) of folded matches; the earliest row wins a tie.

    One pass of minimums per tier: the buffers are plain longs, so the aggregate is
    hash-based and combines on the map side before the shuffle.
    """
    firsts = [F.min(F.when(F.col("tier") == t, F.col("row_idx"))).alias(f"_{t}") for t in v.TIERS]
    best_tier = F.coalesce(*[F.when(F.col(f"_{t}").isNotNull(), t) for t in v.TIERS])
    who = "class_id" if "class_id" in matches.columns else "vehicle_id"
    return (matches.groupBy("doc", who).agg(*firsts)
            .select("doc", who, best_tier.alias("tier"),
                    F.coalesce(*[F.col(f"_{t}") for t in v.TIERS]).alias("row_idx")))


def match_records(best: DataFrame, rows: DataFrame, approvals: DataFrame,
                  method: str = v.METHOD_DETERMINISTIC) -> DataFrame:
    """Denormalised records: the row's part numbers, or the document's when it has none. A ``method``
    and a ``rationale`` that ``best`` brings along are kept. Folded rows stay folded. Matches that lie by document are not shuffled.

    approvals: doc, part_numbers, category, device_name, manufacturer
    """
    row_parts = rows.select(*ROW_KEY, F.col("part_numbers").alias("_row_pns"))
    docs = approvals.select("doc", F.col("part_numbers").alias("_doc_pns"),
                            "category", "device_name", "manufacturer")
    # hash tables are made of a task's rows and documents; sorting the matches to merge them is what the hints spare
    return (best.join(row_parts.hint("shuffle_hash"), ROW_KEY).join(docs.hint("shuffle_hash"), "doc", "left")
            .select("doc", *(c for c in ("class_id", "vehicle_id") if c in best.columns), "tier", (F.col("method") if "method" in best.columns else F.lit(method).alias("method")),
                    F.when(F.size("_row_pns") > 0, F.col("_row_pns"))
                    .otherwise(F.col("_doc_pns")).alias("part_numbers"),
                    "category", "device_name", "manufacturer", *(c for c in ("rationale",) if c in best.columns)))


def unresolved_rows(rows: DataFrame, catalog: DataFrame, bound: int = BROADCAST_ROW_BOUND) -> DataFrame:
    """Rows with no match but at least one candidate: doc, row_idx, make, year_start,
    year_end, n_candidates. An anti join on the matching condition; no match is built."""
    keep = ["make", "year_start", "year_end", "n_candidates"]
    open_rows = candidate_counts(rows, catalog, bound).filter(F.col("n_candidates") > 0)
    # induction and cylinders decide how well a vehicle fits, not whether it does
    side = _catalog_keys(catalog).select(*COARSE).distinct()
    return dimension_join(_row_keys(open_rows, *keep), side, ["_make", "_word"], ROW_KEY,
                          fits_broadcast(side, bound), "left_anti", _fits()).select(*ROW_KEY, *keep)


def unresolved_after(rows: DataFrame, catalog: DataFrame, matches: DataFrame, bound: int = BROADCAST_ROW_BOUND) -> DataFrame:
    """As ``unresolved_rows``, from matches that are there already: rows meet the catalog once, and
    what is joined here are row keys."""
    open_rows = rows.join(matches.select(*ROW_KEY).distinct(), ROW_KEY, "left_anti")
    counted = candidate_counts(open_rows, catalog, bound)
    return counted.filter(F.col("n_candidates") > 0).select(*ROW_KEY, "make", "year_start", "year_end", "n_candidates")


def resolver_requests(unresolved: DataFrame, catalog: DataFrame, part_size: int,
                      bound: int = BROADCAST_ROW_BOUND) -> DataFrame:
    """What to send to a resolver: doc, row_idx, n_candidates, part_no and ``candidate_ids``, at most
    ``part_size`` sorted ids. Every candidate of a row is in exactly one part, numbered from 0; the
    decisions about the parts of a row meet again by ``seq`` in ``merge_resolved``."""
    span = ["_make", "_lo", "_hi"]
    keyed = _year_bounds(unresolved).select(*ROW_KEY, "n_candidates", "_lo", "_hi", make_key(F.col("make")).alias("_make"))
    keyed = keyed.withColumn("_copies", F.count("*").over(Window.partitionBy(*ROW_KEY)))
    single, several = keyed.filter("_copies = 1").drop("_copies"), keyed.filter("_copies > 1").drop("_copies")
    cat = catalog.select("vehicle_id", F.col("year").cast("int").alias("_y"),
                         make_key(F.col("make")).alias("_make"))
    fits = fits_broadcast(cat, bound)

    def parts(asked: DataFrame, who: list[str], *keep: str) -> DataFrame:
        pairs = dimension_join(asked, cat, ["_make"], who, fits, when=F.col("_y").between(F.col("_lo"), F.col("_hi")))
        place = F.row_number().over(Window.partitionBy(*who).orderBy("vehicle_id")) - 1
        # the grouping refines the window's keys, so both use one shuffle
        return (pairs.select(*who, *keep, "vehicle_id", F.floor(place / part_size).cast("long").alias("part_no"))
                .groupBy(*who, *keep, "part_no").agg(F.array_sort(F.collect_list("vehicle_id")).alias("candidate_ids")))

    def lists() -> DataFrame:
        """Rows of one make and year range have the same candidates: these are listed once per range."""
        spans = single.select(*span).distinct()
        dated = cat.groupBy("_make", "_y").agg(F.collect_list(F.struct("vehicle_id")).alias("_ids"))
        by_make = dated.groupBy("_make").agg(F.collect_list(F.struct("_y", F.sort_array("_ids.vehicle_id").alias("_ids"))).alias("_dates"))
        if not fits_broadcast(by_make, bound):
            return single.join(parts(spans, span), span).drop(*span)
        # The ranges lie where their rows do, so their lists are made there and handed to the rows with no shuffle and no sort of candidates.
        inside = F.filter("_dates", lambda d: d["_y"].between(F.col("_lo"), F.col("_hi")))
        ids = F.sort_array(F.flatten(F.transform(inside, lambda d: d["_ids"])))
        # exploding an array of one holds the optimizer from copying what stands in it to every place that asks for it
        listed = dimension_join(spans, by_make, ["_make"], span, True).select(*span, F.explode(F.array(ids)).alias("_all")).filter(F.size("_all") > 0)
        cut = F.transform(F.sequence(F.lit(0), F.ceil(F.size("_all") / part_size).cast("int") - 1),
                          lambda p: F.array_compact(F.slice("_all", p * part_size + 1, part_size)))
        met = single.hint("shuffle_hash").join(listed.select(*span, F.explode(F.array(cut)).alias("_parts")), span)
        return met.select(*ROW_KEY, "n_candidates", F.posexplode("_parts").alias("part_no", "candidate_ids")).withColumn(
            "part_no", F.col("part_no").cast("long"))

    # Rows that share a key share their parts too and are listed together.
    return lists().select(*ROW_KEY, "n_candidates", "part_no", "candidate_ids").unionByName(
        parts(several, ROW_KEY, "n_candidates").select(*ROW_KEY, "n_candidates", "part_no", "candidate_ids"))


def resolver_outcomes(decisions: DataFrame, unresolved: DataFrame, catalog: DataFrame,
                      floor: float = v.CONFIDENCE_FLOOR, bound: int = BROADCAST_ROW_BOUND) -> DataFrame:
    """One row per decision about an unresolved row, with ``outcome``:

    review    confidence under the floor
    rejected  ids were proposed and none is a candidate of the row
    accepted  otherwise; ``valid_ids`` holds the proposed ids that are candidates

    decisions: doc, row_idx, seq, vehicle_ids, rationale, confidence. Validity is decided
    from the candidate rule itself (make and year range), so no candidate set is built.
    """
    spans = _year_bounds(unresolved).select(*ROW_KEY, "_lo", "_hi",
                                            make_key(F.col("make")).alias("_make"))
    proposed = decisions.join(spans, ROW_KEY).select(
        *ROW_KEY, "seq", "rationale", "confidence", "_lo", "_hi", "_make",
        F.posexplode_outer("vehicle_ids").alias("_pos", "vehicle_id"))
    cat = catalog.select("vehicle_id", F.col("year").cast("int").alias("_y"),
                         make_key(F.col("make")).alias("_cmake"))
    checked = dimension_join(
        proposed, cat, ["vehicle_id"], [*ROW_KEY, "seq"], fits_broadcast(catalog, bound), "left",
        (F.col("_make") == F.col("_cmake")) & F.col("_y").between(F.col("_lo"), F.col("_hi")),
        like=decisions.select(F.explode("vehicle_ids").alias("vehicle_id")))

    def ids(when: Column) -> Column:
        """Ids of a decision in proposed order; as many as the decision names."""
        placed = F.array_sort(F.collect_list(F.when(when, F.struct("_pos", "vehicle_id"))))
        return F.transform(placed, lambda e: e["vehicle_id"])

    grouped = checked.groupBy(*ROW_KEY, "seq", "rationale", "confidence").agg(
        ids(F.col("vehicle_id").isNotNull()).alias("vehicle_ids"), ids(F.col("_cmake").isNotNull()).alias("valid_ids"))
    outcome = (F.when(F.col("confidence") < floor, "review")
               .when((F.size("vehicle_ids") > 0) & (F.size("valid_ids") == 0), "rejected")
               .otherwise("accepted"))
    return grouped.withColumn("outcome", outcome)


def resolver_reviews(outcomes: DataFrame) -> DataFrame:
    """Review rows for decisions below the confidence floor."""
    return outcomes.filter(F.col("outcome") == "review").select(
        "doc", "row_idx", F.lit("ambiguous_match").alias("reason"),
        F.col("rationale").alias("agent_notes"), F.col("vehicle_ids").alias("proposed_vehicle_ids"))


def merge_resolved(best: DataFrame, outcomes: DataFrame, catalog: DataFrame | None = None, bound: int = BROADCAST_ROW_BOUND) -> DataFrame:
    """Deterministic matches always stay; of accepted decisions the first one in ``seq``
    order adds a vehicle that is still missing, at tier generic and with its rationale.

    With folded ``best`` the catalog is needed, and what comes out is folded: added vehicles have no class.
    """
    why = F.col("rationale") if "rationale" in outcomes.columns else F.lit(None).cast("string")
    added = (outcomes.filter(F.col("outcome") == "accepted")
             .select("doc", "row_idx", "seq", why.alias("rationale"), F.explode("valid_ids").alias("vehicle_id"))
             .groupBy("doc", "vehicle_id").agg(F.min(F.struct("seq", "row_idx", "rationale")).alias("_first")))
    if "class_id" not in best.columns:
        return _merged(best, added)
    classes = vehicle_classes(catalog)
    member = classes.select("class_id", F.explode("_ids").alias("_v")).select("class_id", "_v.vehicle_id")
    if fits_broadcast(classes.select("class_id", "_ids"), bound):
        return _merged_folded(best, added.join(member, "vehicle_id", "left"), classes)
    firm, unsure = best.filter(F.col("tier").isNotNull()), best.filter(F.col("tier").isNull())
    missing = (added.join(member, "vehicle_id", "left").join(firm.select("doc", "class_id"), ["doc", "class_id"], "left_anti")
               .select("doc", "vehicle_id", "_first"))
    late = _merged(expanded(unsure, classes, bound), missing)
    stay = firm.select("doc", "class_id", F.lit(None).cast(late.schema["vehicle_id"].dataType).alias("vehicle_id"), "tier", "row_idx",
                       F.lit(v.METHOD_DETERMINISTIC).alias("method"), F.lit(None).cast("string").alias("rationale"))
    return stay.unionByName(late.withColumn("class_id", F.lit(None).cast("string")))


def _merged_folded(best: DataFrame, added: DataFrame, classes: DataFrame) -> DataFrame:
    """``_merged`` in one pass over ``best``, which is costly and not stored. added: doc, vehicle_id, _first, class_id."""
    lists = added.groupBy("doc", "class_id").agg(F.collect_list(F.struct("vehicle_id", "_first")).alias("_added"))
    # a class without a tier (its rows have no position) is written out here, so that added vehicles meet their own
    unsure = classes.select(F.col("class_id").alias("_class"), F.col("_ids.vehicle_id").alias("_own"))
    met = (best.select("doc", "class_id", "tier", "row_idx", F.lit(True).alias("_here"))
           .join(lists.hint("shuffle_hash"), ["doc", "class_id"], "full_outer")
           .join(F.broadcast(unsure), F.col("_here") & F.col("tier").isNull() & (F.col("class_id") == F.col("_class")), "left"))
    firm, ids = F.col("tier").isNotNull(), F.col("_added.vehicle_id")
    kind = classes.schema["_ids"].dataType.elementType["vehicle_id"].dataType
    none = F.array().cast(f"array<{kind.simpleString()}>")
    own = F.array_except(F.coalesce("_own", none), F.coalesce(ids, none))
    out = met.select("doc", "class_id", "tier", "row_idx", "_added", F.posexplode(
        F.when(firm, F.array(F.lit(None).cast(kind))).otherwise(F.concat(F.coalesce(ids, none), own))).alias("_pos", "vehicle_id"))
    first = F.when(~firm, F.get("_added", F.col("_pos"))["_first"])
    return out.select(
        "doc", F.when(firm, F.col("class_id")).alias("class_id"), "vehicle_id", F.coalesce("tier", F.lit("generic")).alias("tier"),
        F.coalesce("row_idx", first["row_idx"]).alias("row_idx"),
        F.when(firm, v.METHOD_DETERMINISTIC).otherwise(v.METHOD_RESOLVED).alias("method"),
        F.nullif(first["rationale"], F.lit("")).alias("rationale"))


def _merged(best: DataFrame, added: DataFrame) -> DataFrame:
    # Both sides are grouped by (doc, vehicle_id), so this join needs no further shuffle.
    both = best.select("doc", "vehicle_id", "tier", "row_idx").join(added, ["doc", "vehicle_id"], "full_outer")
    return both.select(
        "doc", "vehicle_id", F.coalesce("tier", F.lit("generic")).alias("tier"),
        F.coalesce("row_idx", "_first.row_idx").alias("row_idx"),
        F.when(F.col("tier").isNotNull(), v.METHOD_DETERMINISTIC).otherwise(v.METHOD_RESOLVED).alias("method"),
        F.when(F.col("tier").isNull(), F.nullif(F.col("_first.rationale"), F.lit(""))).alias("rationale"))


def match_counts(approvals: DataFrame, best: DataFrame) -> DataFrame:
    """Matches per approval, zero when none. Folded rows count by their ``n_vehicles`` (see ``sized``)."""
    n = F.sum("n_vehicles") if "n_vehicles" in best.columns else F.count("*")
    counts = best.groupBy("doc").agg(n.alias("match_count"))
    return approvals.select("doc").join(counts, "doc", "left").select(
        "doc", F.coalesce("match_count", F.lit(0).cast("long")).alias("match_count"))
