"""The part index on disk: one bucket per lookup, pages that reach every approval, updates by document; event pages."""

import re

import pytest
from pyspark.sql import functions as F

from fitledger.operators import reports as P
from fitledger.operators import search as H
from fitledger.sources.part_index import PartIndex

MATCH = "doc bigint, vehicle_id bigint, part_numbers array<string>, manufacturer string, device_name string"


def matches(spark, rows):
    return spark.createDataFrame([(d, v, p, f"maker {d}", f"device {v}") for d, v, p in rows], MATCH)


# One number on every approval, and one of its own for each.
ROWS = [(d, v, ["HOT", f"N{d}", f"N{d}"]) for d in range(130) for v in (d + 1, d)]


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    found = PartIndex(spark, str(tmp_path_factory.mktemp("index") / "parts"), buckets=8)
    found.build(matches(spark, ROWS))
    return found


def test_lookup_opens_one_bucket(spark, index, capsys):
    index.files("N17").explain("formatted")
    plan = capsys.readouterr().out
    # the bucket is a constant, by which Spark drops folders before it opens a file
    assert re.search(r"PartitionFilters: \[[^\]]*\(bucket#\d+ = \d+\)", plan)
    assert re.search(r"PushedFilters: \[[^\n]*EqualTo\(part_number,N17\)", plan)
    folders = {r[0].split("bucket=")[1].split("/")[0] for r in index.table._files().select(F.input_file_name()).collect()}
    here = {r[0].split("bucket=")[1].split("/")[0] for r in index.files("N17").select(F.input_file_name()).collect()}
    assert len(folders) == 8 and len(here) == 1
    row = index.lookup("N17").collect()
    assert [(r.doc, r.manufacturer, r.device_name, r.n_vehicles, r.next_after) for r in row] == [(17, "maker 17", "device 17", 2, None)]
    assert index.lookup("absent").collect() == []


def test_pages_reach_every_approval(spark, index):
    seen, after = [], None
    for _ in range(10):
        page = index.lookup("HOT", after, 50).orderBy("doc").collect()
        seen += [r.doc for r in page]
        after = page[-1].next_after
        assert after is None or after == page[-1].doc
        if after is None:
            break
    assert seen == list(range(130))


def test_scan_and_index_agree(spark, index):
    scan = H.part_search(matches(spark, ROWS), "HOT", 40, 60).collect()
    page = index.lookup("HOT", 60, 40).collect()
    assert sorted((r.doc, r.manufacturer, r.device_name, r.next_doc) for r in scan) == sorted((r.doc, r.manufacturer, r.device_name, r.next_after) for r in page)
    assert len(scan) == 40 and all(r.truncated for r in scan)


def test_update_by_document(spark, tmp_path):
    found = PartIndex(spark, str(tmp_path / "parts"), buckets=8)
    before = matches(spark, ROWS)
    found.build(before)
    after = matches(spark, [r for r in ROWS if r[0] not in (3, 4)] + [(3, 500, ["HOT", "NEW"])])
    docs = spark.createDataFrame([(3,), (4,)], "doc bigint")
    touched = found.update(docs, before, after)
    assert len(touched) < 8
    want = sorted(map(tuple, H.part_index_rows(after).collect()))
    assert sorted(map(tuple, found.table.read().collect())) == want


def test_event_pages_reach_every_event(spark):
    events = spark.createDataFrame([(f"r{i % 3}", float(i // 7), i, "a") for i in range(200)] + [("r0", None, 900, "b"), ("solo", 1.0, 901, "c")],
                                   "run_id string, ts double, event_id long, action string")
    seen, after = [], None
    for _ in range(10):
        page = P.run_events(events, 25, after).cache()
        seen += [(r.run_id, r.event_id) for r in page.orderBy("run_id", "ts", "event_id").collect()]
        cursors = P.next_cursors(page)
        if cursors.isEmpty():
            break
        # runs that are through are not asked for again
        events = events.join(cursors.select("run_id"), "run_id", "left_semi")
        after = spark.createDataFrame(cursors.collect(), cursors.schema)
    assert sorted(seen) == sorted([(f"r{i % 3}", i) for i in range(200)] + [("solo", 901)])
    assert len(seen) == len(set(seen))


def test_page_with_cursor_of_a_pair(spark):
    rows = spark.range(10).select((F.col("id") % 2).alias("a"), "id")
    page = H.page_with_cursor(rows, ["a", "id"], 3).orderBy("a", "id").collect()
    assert [(r.a, r.id, r.next_a, r.next_id) for r in page] == [(0, 0, 0, 4), (0, 2, 0, 4), (0, 4, 0, 4)]
    assert H.page_with_cursor(rows, ["id"], 10).first().next_id is None
