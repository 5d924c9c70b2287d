"""WARC archives: exact round trips, revisits, broken segments."""

import base64
import gzip
import hashlib
import io

from fitledger.llm import warc

PAGE = "page_id long, url string, html string, payload string, record_type string, first int"


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "x", "y", 1) for i, u, h in rows], PAGE).repartition(3)


def digest(html):
    return base64.b32encode(hashlib.sha1((html or "").encode()).digest()).decode()


ROWS = [(1, "http://a/", "<p>é</p>"), (2, "http://b/\r\nX: y", "<p>é</p>"), (3, None, None), (4, "u", ""), (5, "u", "x\r\n\r\nWARC/1.1\r\n\r\n" * 900),
        (6, "u", "日本語" * 20_000), (7, "u", "日本語" * 20_000), (8, "u", "0\r\n\r\n"), (9, "u", "y" * 3990), (None, "u", "no page"), (None, "v", "no page")]


def test_digest_query(spark):
    got = {r.page_id: r for r in warc.warc_digest(pages(spark, ROWS), 0).collect() if r.page_id is not None}
    first = {}
    for i, _, h in ROWS:
        if i is not None:
            first.setdefault(h or "", i)
    assert len(got) == 9
    for i, _, h in ROWS:
        if i is None:
            continue
        r = got[i]
        origin = first[h or ""]
        assert (r.payload_bytes, r.payload_digest, r.status) == (len((h or "").encode()), digest(h), "ok")
        assert (r.record_type, r.refers_to) == (("response", None) if i == origin else ("revisit", origin))


def test_least_size_of_a_revisit(spark):
    got = {r.page_id: r.record_type for r in warc.warc_digest(pages(spark, [(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abc"), (4, "u", "abc")]), 3).collect()}
    assert got == {1: "response", 2: "response", 3: "response", 4: "revisit"}


def test_payloads_come_back(spark, tmp_path):
    for segment in (50, 8192):
        path = str(tmp_path / f"warc-{segment}")
        warc.write_warc(pages(spark, ROWS), path, 0, segment)
        rows = warc.read_warc(spark, path).collect()
        assert len(rows) == len(ROWS) and all(r.status == "ok" for r in rows)
        payloads = {r.page_id: bytes(r.payload) for r in rows if r.record_type == "response" and r.page_id is not None}
        assert payloads == {i: (h or "").encode() for i, _, h in ROWS if i in (1, 3, 5, 6, 8, 9)}


def test_repeated_rows_and_hot_payload(spark):
    rows = [(i, "u", "hot " * 3000) for i in range(200)] + [(500, "u", "twice " * 3000)] * 2
    got = warc.warc_digest(pages(spark, rows), 0).collect()
    assert len(got) == 202 and all(r.status == "ok" for r in got)
    assert [r.page_id for r in got if r.record_type == "response"].count(0) == 1
    assert sorted(r.page_id for r in got if r.record_type == "response") == [0, 500, 500]
    assert all(r.refers_to == 0 for r in got if r.record_type == "revisit")


def test_empty_table(spark):
    assert warc.warc_digest(pages(spark, []), 0).collect() == []


def archive(folder, records):
    folder.mkdir()
    # one member for each record, as crawlers write them
    (folder / "x.warc.gz").write_bytes(b"".join(gzip.compress(r + b"\r\n\r\n") for r in records))
    return str(folder)


def test_broken_archives(spark, tmp_path):
    whole = warc.page_records(1, "u", b"z" * 500, None, False, 100)
    assert len(whole) > 3
    other = warc.page_records(2, "u", b"q" * 500, None, False, 10_000)
    cases = {"ok": whole, "missing_segment": whole[:2] + whole[3:], "bad_length": [r.replace(b"Total-Length: ", b"Total-Length: 1") for r in whole],
             "bad_framing": [other[0].replace(b"1f4\r\n", b"1f5\r\n")], "bad_digest": [other[0].replace(b"qqqq", b"qqqr")]}
    for status, records in cases.items():
        rows = warc.read_warc(spark, archive(tmp_path / status, list(reversed(records)))).collect()
        assert [r.status for r in rows] == [status]
    assert warc.read_warc(spark, archive(tmp_path / "no_last", whole[:-1])).first().status == "missing_segment"
    assert warc.read_warc(spark, archive(tmp_path / "no_first", whole[1:])).first().status == "missing_segment"


def test_chunked_framing():
    for n in (0, 1, 9, 10, 11, 25):
        assert warc.dechunk(warc.chunked(b"a\r\n" * n, 10)) == b"a\r\n" * n
    assert warc.dechunk(b"3;name=value\r\nabc\r\n0\r\n\r\n") == b"abc"
    assert warc.dechunk(b"3\r\nab") is None and warc.dechunk(b"") is None and warc.dechunk(b"zz\r\n") is None


def test_parse_skips_blank_lines():
    records = list(warc.parse(io.BytesIO(b"\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 2\r\n\r\nhi\r\n\r\n")))
    assert [(r[1], r[9]) for r in records] == [("response", b"hi")]
