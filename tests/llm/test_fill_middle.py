"""Fill-in-the-middle: piece tables against a plain version on strings, exact round trips."""

import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from fitledger.llm import fill_middle as fim

DOCS = "doc_id long, text string, h1 string, pieces int, form string, output int, n string"


def documents(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, "y", 2, "z") for i, t in rows], DOCS).repartition(3)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def expected(doc_id, text, seed=1, plain_from=90, spm_below=20):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    key = sha(f"{seed}:{'' if doc_id is None else doc_id}")
    h = [int(key[i:i + 8], 16) for i in range(0, 32, 8)]
    n = len(units)
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= plain_from:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, middle, suffix = ("".join(units[i:j]) for i, j in ((0, a), (a, b), (b, n)))
    if h[3] % 100 < spm_below:
        return n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


TEXTS = ["", None, "a", "<P>", "a <S> b", "<M", "x<P", "S>y<", "<<P", "P>P>", "Zoë añade 日本語 tests 😀😀 ok", "\n\n \t", "é", "a\x00b", "AbC9dEf", "word " * 40_000, "日本" * 30_000]
ROWS = [(i, t) for i, t in enumerate(TEXTS * 12)] + [(None, "no id here"), (None, None), (7, "again, again"), (7, "again, again"), (-5, "negative id")]


def test_against_plain_version(spark):
    docs = documents(spark, ROWS)
    got = fim.fill_middle_digest(docs).collect()
    want = []
    for i, t in ROWS:
        n, form, prefix, middle, output = expected(i, t)
        want.append((i, n, form, prefix, middle, sha(output), sha(t or "")))
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    assert {r.form for r in got} == {"plain", "psm", "spm"}


def test_texts_and_descriptors(spark):
    rows = [(i, f"Document {i}: ünïcode words, " * (i % 5)) for i in range(60)]
    tables = fim.piece_tables(documents(spark, rows), seed=9, plain_from=50, spm_below=50)
    outputs = fim.fill(tables)
    got = {r.doc_id: r for r in outputs.collect()}
    back = {r.doc_id: r.restored for r in fim.restore(outputs).collect()}
    for i, t in rows:
        n, form, prefix, middle, output = expected(i, t, 9, 50, 50)
        assert (got[i].n, got[i].form, got[i].prefix_chars, got[i].middle_chars, got[i].output) == (n, form, prefix, middle, output)
        assert back[i] == t
    for r in tables.collect():
        # descriptors cover each byte of the text once, and no more than three of them lie in it
        inside = sorted((p.start, p.length) for p in r.pieces if p.buffer == fim.TEXT)
        assert sum(k for _, k in inside) == len(r.text.encode()) and len(inside) <= 3
        assert [p for p in r.pieces if p.buffer == fim.MARK and p.length != 3] == []


def test_all_plain_and_none_plain(spark):
    rows = [(i, "some words here") for i in range(30)]
    assert {r.form for r in fim.piece_tables(documents(spark, rows), plain_from=0).collect()} == {"plain"}
    assert {r.form for r in fim.piece_tables(documents(spark, rows), plain_from=100, spm_below=100).collect()} == {"spm"}


def test_empty_table(spark):
    got = fim.fill_middle_digest(documents(spark, []))
    assert got.collect() == []
    assert got.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]


@settings(max_examples=300, deadline=None)
@given(st.text("aB <>PSM\né日😀"), st.data())
def test_cut_arrange_inverse(text, data):
    raw = text.encode()
    first = data.draw(st.integers(0, len(raw)))
    second = data.draw(st.integers(first, len(raw)))
    whole = [(fim.TEXT, 0, len(raw))] if raw else []
    parts = fim.cut(whole, first, second)
    joined = [b"".join(fim.slices(p, memoryview(raw))) for p in parts]
    assert joined == [raw[:first], raw[second:], raw[first:second]]
    assert b"".join(fim.slices(fim.inverse(parts), memoryview(raw))) == raw
    if not re.search("<[PSM]>", text):
        for form in fim.FORMS:
            output = b"".join(fim.slices(fim.arrange(parts, form), memoryview(raw)))
            back = fim.inverse(fim.arranged_pieces(output, form))
            assert b"".join(fim.slices(back, memoryview(output))) == raw
            assert fim.stream_sha256(back, memoryview(output)) == hashlib.sha256(raw).hexdigest()


def test_split_several_descriptors():
    pieces = [(0, 5, 3), (1, 0, 2), (0, 9, 4)]
    for at in range(10):
        left, right = fim.split(pieces, at)
        assert sum(k for *_, k in left) == at and sum(k for *_, k in right) == 9 - at
    assert fim.split(pieces, 4) == ([(0, 5, 3), (1, 0, 1)], [(1, 1, 1), (0, 9, 4)])
