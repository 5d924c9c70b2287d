import itertools
import random

from pyspark.sql import functions as F

from fitledger.operators import matching as op

CATALOG = "vehicle_id long, year int, make string, model string, displacement_l double, induction string, cylinders int"
ROWS = ("doc long, row_idx long, make string, model string, year_start int, year_end int, displacement_l double, "
        "induction string, cylinders int, part_numbers array<string>")


def brute(rows, cat):
    def fold(x):
        return (x or "").lower().strip()

    out = set()
    for r, v in itertools.product(rows, cat):
        a, b = fold(r[3]), fold(v[3])
        s, l = (a, b) if len(a) <= len(b) else (b, a)
        if not s or not l.startswith(s) or (l[len(s):] and l[len(s)] not in " -/"):
            continue
        if (r[2] or "").lower() != (v[2] or "").lower() or not (r[4] or 0) <= v[1] <= (r[5] or 9999):
            continue
        if r[6] is None:
            tier = "generic"
        elif v[4] is None or abs(v[4] - r[6]) > 0.15:
            continue
        else:
            tier = "medium"
            if r[7] and r[7] == v[5]:
                tier = "exact" if r[8] and r[8] == v[6] else "high"
        out.add((r[0], r[1], v[0], tier))
    return out


def sample(seed=3):
    rnd = random.Random(seed)
    models = ["F-150", "F-150 XL", "F", "Ranger", "Rangerand", "C/K", "C/K 1500", "", None, "-x", "Celica GT", "Celica"]
    pick = rnd.choice
    cat = [(i, rnd.randint(1998, 2004), pick(["Ford", "FORD", None]), pick(models), pick([None, 5.0, 5.1, 5.3]),
            pick([None, "NA", "TURBO"]), pick([None, 0, 4, 8])) for i in range(60)]
    rows = [(d, i, pick(["ford", "Ford", ""]), pick(models), pick([None, 0, 1999, 2001]), pick([None, 0, 2001, 2003]),
             pick([None, 5.0, 5.2]), pick([None, "", "NA", "TURBO"]), pick([None, 0, 4, 8]), pick([[], ["P"]]))
            for d in range(12) for i in range(8)]
    return rows, cat


def test_matches_equal_brute_force_broadcast_and_salted(spark):
    rows, cat = sample()
    r, c = spark.createDataFrame(rows, ROWS), spark.createDataFrame(cat, CATALOG)
    want = brute(rows, cat)
    for bound in (1000, 1):
        assert {tuple(x) for x in op.application_matches(r, c, bound).collect()} == want
    best = {(x.doc, x.vehicle_id): (x.tier, x.row_idx) for x in op.best_matches(op.application_matches(r, c)).collect()}
    rank = {"exact": 0, "high": 1, "medium": 2, "generic": 3}
    for key in {(d, v) for d, _, v, _ in want}:
        assert best[key] == min(((t, i) for d, i, v, t in want if (d, v) == key), key=lambda e: (rank[e[0]], e[1]))
    hits = {(d, i) for d, i, _, _ in want}
    candidates = {}
    for a, v in itertools.product(rows, cat):
        if (a[2] or "").lower() == (v[2] or "").lower() and (a[4] or 0) <= v[1] <= (a[5] or 9999):
            candidates.setdefault((a[0], a[1]), []).append(v[0])
    for bound in (1000, 1):
        open_rows = op.unresolved_rows(r, c, bound)
        assert {(x.doc, x.row_idx): x.n_candidates for x in open_rows.collect()} == {
            k: len(ids) for k, ids in candidates.items() if k not in hits}
        sent = {(x.doc, x.row_idx, x.part_no): x.candidate_ids for x in op.resolver_requests(open_rows, c, 3, bound).collect()}
        assert sent == {(*k, p): sorted(ids)[3 * p:3 * p + 3] for k, ids in candidates.items() if k not in hits
                        for p in range((len(ids) + 2) // 3)}


def test_first_decision_wins_and_deterministic_stays(spark):
    best = spark.createDataFrame([(1, 10, "high", 0)], "doc long, vehicle_id long, tier string, row_idx long")
    out = spark.createDataFrame([(1, 5, 1, "accepted", [10, 11], "first"), (1, 4, 2, "accepted", [11], "second"), (1, 6, 3, "review", [12], "unsure")],
                                "doc long, row_idx long, seq long, outcome string, valid_ids array<long>, rationale string")
    got = {tuple(r) for r in op.merge_resolved(best, out).collect()}
    assert got == {(1, 10, "high", 0, "deterministic", None), (1, 11, "generic", 5, "gemini_resolved", "first")}
    untold = {tuple(r) for r in op.merge_resolved(best, out.drop("rationale")).collect()}
    assert untold == {(1, 10, "high", 0, "deterministic", None), (1, 11, "generic", 5, "gemini_resolved", None)}


def test_document_parts_fill_in(spark):
    rows, cat = sample()
    r, c = spark.createDataFrame(rows, ROWS), spark.createDataFrame(cat, CATALOG)
    docs = spark.range(12).select(F.col("id").alias("doc"), F.array(F.lit("D")).alias("part_numbers"),
                                  F.lit("tune").alias("category"), F.lit("d").alias("device_name"), F.lit("m").alias("manufacturer"))
    recs = op.match_records(op.best_matches(op.application_matches(r, c)), r, docs).collect()
    assert recs and {tuple(x.part_numbers) for x in recs} == {("P",), ("D",)}


def test_folded_matches_give_the_same_with_repeated_and_null_vehicles(spark):
    rows, cat = sample(5)
    cat += [(1000 + i, *x[1:]) for i, x in enumerate(cat)]  # the same attributes under other ids
    cat += [cat[3], (7, *cat[8][1:]), (None, *cat[9][1:]), (None, *cat[10][1:])]  # a vehicle twice, with other attributes, without an id
    rows += [(1, None, *rows[9][2:])]
    r, c = spark.createDataFrame(rows, ROWS), spark.createDataFrame(cat, CATALOG)
    out = spark.createDataFrame([(d, 5, d, "accepted", [10, 1010, 55], "why") for d in range(12)],
                                "doc long, row_idx long, seq long, outcome string, valid_ids array<long>, rationale string")
    plain = op.application_matches(r, c)
    for bound in (10000, 1):
        folded = op.application_matches(r, c, bound, folded=True)
        assert folded.count() < plain.count()
        best = op.best_matches(folded)

        def same(got, want):
            assert got.columns == want.columns
            assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))

        same(op.expanded(best, c, bound), op.best_matches(plain))
        merged = op.expanded(op.merge_resolved(best, out, c, bound), c, bound)
        want = op.merge_resolved(op.best_matches(plain), out)
        same(merged.select(*want.columns), want)
        docs = spark.range(14).withColumnRenamed("id", "doc")
        same(op.match_counts(docs, op.sized(best, c, bound)), op.match_counts(docs, op.best_matches(plain)))


def test_rows_of_one_range_share_their_candidates(spark):
    rows, cat = sample()
    r, c = spark.createDataFrame(rows + rows[:9], ROWS), spark.createDataFrame(cat, CATALOG)
    left = op.unresolved_rows(r, c)
    sent = op.resolver_requests(left, c, 3)
    asked = {}
    for x in left.collect():
        ids = [v[0] for v in cat if (v[2] or "").lower() == x.make.lower() and (x.year_start or 0) <= v[1] <= (x.year_end or 9999)]
        asked.setdefault((x.doc, x.row_idx), []).extend(ids)
    got = {(x.doc, x.row_idx, x.part_no): x.candidate_ids for x in sent.collect()}
    assert got == {(*k, p): sorted(ids)[3 * p:3 * p + 3] for k, ids in asked.items() for p in range((len(ids) + 2) // 3)}
    assert any(len(ids) > len(set(ids)) for ids in asked.values())


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_row_looks_its_key_up_once(spark):
    rows, cat = sample(7)
    r, c = spark.createDataFrame(rows, ROWS), spark.createDataFrame(cat, CATALOG)
    joins = [x for x in plan(op.application_matches(r, c)).splitlines() if "BroadcastHashJoin" in x]
    # a condition in the join would be asked of every vehicle of the key, whatever its year
    assert len(joins) == 1 and joins[0].rstrip().endswith("Inner, BuildRight, false")


def test_matches_by_document_are_the_same_and_not_shuffled(spark):
    rows, cat = sample(9)
    rows += [(None, 3, *rows[9][2:]), (4, None, *rows[9][2:]), rows[20]]
    cat += [(1000 + i, *x[1:]) for i, x in enumerate(cat)] + [(None, *cat[9][1:])]
    r, c = spark.createDataFrame(rows, ROWS), spark.createDataFrame(cat, CATALOG)
    docs = spark.range(12).select(F.col("id").alias("doc"), F.array(F.lit("D")).alias("part_numbers"),
                                  F.lit("tune").alias("category"), F.lit("d").alias("device_name"), F.lit("m").alias("manufacturer"))

    def found(bound, by_doc):
        best = op.best_matches(op.application_matches(r, c, bound, folded=True, by_doc=by_doc))
        return best, op.match_records(best, r, docs), op.match_counts(docs, op.sized(best, c, bound))

    for bound in (10000, 1):
        for got, want in zip(found(bound, True), found(bound, False), strict=True):
            assert got.columns == want.columns
            assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect())) != []
    for df in found(10000, True):
        assert "class_id" not in "".join(x for x in plan(df).splitlines() if "Exchange hashpartitioning(doc" in x)


def test_candidates_are_listed_where_their_rows_lie(spark):
    rows, cat = sample(11)
    cat += [(None, *cat[9][1:]), cat[4], (500, None, *cat[3][2:])]  # places of vehicles without an id are counted, their ids left out
    r, c = spark.createDataFrame(rows, ROWS), spark.createDataFrame(cat, CATALOG)
    left = op.unresolved_rows(r, c)
    sent = op.resolver_requests(left, c, 3)
    assert sorted(map(repr, sent.collect())) == sorted(map(repr, op.resolver_requests(left, c, 3, 1).collect())) != []
    # one sort of candidates is left, for rows that share a key
    assert plan(op.resolver_requests(left, c, 3)).count("row_number()") == 1


def test_merging_reads_the_best_matches_once(spark):
    rows, cat = sample(5)
    rows += [(d, None, *rows[9][2:]) for d in (1, 40, 41)]
    cat += [(None, *cat[9][1:])]
    r, c = spark.createDataFrame(rows, ROWS), spark.createDataFrame(cat, CATALOG)
    out = spark.createDataFrame([(d, 5, s, "accepted", [10, 10 + d % 50, 55, 9999], "why" if s else "") for d in (*range(12), 40, 77) for s in (0, 1)],
                                "doc long, row_idx long, seq long, outcome string, valid_ids array<long>, rationale string")
    best = op.best_matches(op.application_matches(r, c, folded=True, by_doc=True))
    merged = op.merge_resolved(best, out, c)
    want = op.merge_resolved(op.best_matches(op.application_matches(r, c)), out)
    got = op.expanded(merged, c).select(*want.columns)
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect())) != []
    assert want.filter("row_idx IS NULL").count() > 0
    assert plan(merged).count("BroadcastHashJoin [_make") == plan(best).count("BroadcastHashJoin [_make") == 1
