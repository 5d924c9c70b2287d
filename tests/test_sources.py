"""Readers, writers and small row makers: a document store, request lines and a caller's model, admission, heal events, edges."""

import pandas as pd
from pyspark.sql import functions as F

from fitledger.operators import registry as G
from fitledger.operators import state as S
from fitledger.sources import documents as D
from fitledger.sources import inference as N


def test_store_of_documents(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "d-1.pdf").write_bytes(b"%PDF-1.7 one")
    (tmp_path / "D-2.PDF").write_bytes(b"<html>")
    (tmp_path / "notes.txt").write_bytes(b"%PDF not a document by name")
    vetted = D.corpus_keys(D.vet_payloads(D.read_store(spark, str(tmp_path)))).collect()
    assert {(r.eo_number, r.vetted, r.sha256 is not None) for r in vetted} == {("D-1", True, True), ("D-2.PDF", False, False)}
    assert D.read_store(spark, str(tmp_path), content=False).columns == ["path", "length", "modificationTime"]


def test_request_lines_through_a_model(spark, tmp_path):
    items = spark.createDataFrame([("D-1",), ("D-2",)], "eo_number string")
    stored = spark.createDataFrame([("D-1", "s://b/pdfs/d-1.pdf"), ("D-2", "s://b/pdfs/d-2.pdf")], "eo_number string, gcs_uri string")
    asked = N.request_lines(items, stored, "read it")
    N.write_lines(asked, str(tmp_path / "lines"))
    assert spark.read.text(str(tmp_path / "lines")).count() == 2

    def model(batches):
        for b in batches:
            answer = '"response":{"candidates":[{"content":{"parts":[{"text":"{\\"eo_number\\":\\"X\\",\\"confidence\\":1}"}]}}]}}'
            yield pd.DataFrame({"eo_number": b["eo_number"], "line": b["line"].str[:-1] + "," + answer})

    got = N.read_lines(N.with_inference(asked, model).select("line")).collect()
    assert sorted((r.eo_number, r.usable, r.reject, r.record.eo_number) for r in got) == [("D-1", True, None, "X"), ("D-2", True, None, "X")]


def test_lines_that_cannot_be_read(spark):
    lines = spark.createDataFrame([(1, ""), (2, " \t\r\n"), (3, None), (4, "{"), (5, "[]"), (6, '{"request":{"contents":[{"parts":[{"fileData":{"fileUri":""}}]}]}}'),
                                   (7, '{"request":{"contents":[{"parts":[{"fileData":{"fileUri":"x/d-7.pdf"}}]}]},"response":"text"}')], "seq int, line string")
    got = {r.seq: (r.reject, r.usable, r.eo_number) for r in N.read_lines(lines).collect()}
    assert got == {1: ("blank", False, None), 2: ("blank", False, None), 3: ("blank", False, None), 4: ("unreadable", False, None), 5: ("unreadable", False, None),
                   6: ("unreadable", False, None), 7: (None, False, "D-7")}


def test_admission_of_new_keys(spark):
    new = spark.createDataFrame([("A", "u1"), ("B", "u2"), ("C", None)], "eo_number string, pdf_url string")
    payloads = spark.createDataFrame([("A", "g1", True, "s1"), ("B", "g2", False, None)], "eo_number string, gcs_uri string, vetted boolean, sha256 string")
    approvals, events = G.admit(new, payloads)
    assert [tuple(r) for r in approvals.collect()] == [("A", "discovered", "u1", "g1", "s1")]
    assert sorted((r.eo_number, r.action, r.error is not None) for r in events.collect()) == [("A", "discovered", False), ("B", "discover_failed", True), ("C", "discover_failed", True)]


def test_events_of_a_heal_plan(spark):
    plan = spark.createDataFrame([(1, "requeue"), (2, "heal_limit_reached")], "doc int, action string")
    assert sorted(tuple(r) for r in S.heal_events(plan).collect()) == [("healer", 1, "requeued_transient"), ("healer", 2, "heal_limit_reached")]


def test_lineage_of_approvals(spark):
    """Edges come from the approvals' own columns, in both directions."""
    approvals = spark.createDataFrame([(1, "superseded", [], 2), (2, "superseded", [1], 3), (3, "complete", [2, 99], None)],
                                      "doc long, state string, supersedes array<long>, superseded_by long")
    edges = G.supersedes_edges(approvals).unionByName(G.superseded_by_edges(approvals))
    got = G.lineage(approvals.select("doc"), edges, approvals).filter("start <> 2").orderBy("start", "depth", "node").collect()
    assert [(r.start, r.direction, r.node, r.depth, r.exists, r.state) for r in got] == [
        (1, "forward", 2, 1, True, "superseded"), (1, "forward", 3, 2, True, "complete"), (3, "back", 2, 1, True, "superseded"),
        (3, "back", 99, 1, False, None), (3, "back", 1, 2, True, "superseded")]


def test_missing_address_comes_from_the_later_page(spark):
    listing = spark.createDataFrame([(1, 0, "k", "a-first"), (2, 0, "k", "z-later"), (3, 0, "k", "")], "page_no int, row_no int, eo_number string, pdf_url string")
    approvals = spark.createDataFrame([("k", None), ("m", "own")], "eo_number string, pdf_url string")
    assert {r.eo_number: r.pdf_url for r in G.repair_missing_url(approvals, listing, order=["page_no", "row_no"]).collect()} == {"k": "z-later", "m": "own"}
    same = listing.select("eo_number", F.col("pdf_url"))
    assert {r.eo_number: r.pdf_url for r in G.repair_missing_url(approvals, same).collect()}["k"] == "a-first"
