"""Token ids as rANS blocks: against the library, exact round trips, broken files."""

import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from fitledger.llm import ans_ids as A
from fitledger.llm import byte_bpe

DOCS = "doc_id long, text string, ids int, shard string, h int, salt int, n string"
PATH = A.default_tokenizer()


def documents(spark, rows, parts=3):
    return spark.createDataFrame([(i, t, 1, "x", 2, 3, "y") for i, t in rows], DOCS).repartition(parts)


def library(texts, path=PATH):
    return [e.ids for e in Tokenizer.from_file(path).encode_batch([t or "" for t in texts], add_special_tokens=False)]


def expected(rows, end_id=0):
    """(doc_id, start, n, crc) with null ids first; rows of one id must have texts of equal length in ids."""
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    out, at = [], 0
    for (i, _), ids in zip(order, library([t for _, t in order])):
        raw = np.array([*ids, end_id], "<u4").tobytes()
        out.append((i, at, len(raw) // 4, zlib.crc32(raw)))
        at += len(raw) // 4
    return out


def key(rows):
    return sorted(map(tuple, rows), key=lambda r: r[1])


TEXTS = ["", None, "a", "It's the dogs' 's 'twas I'll we've you'd", "  two  blanks\n\n\tand tabs \n", "<|endoftext|> inside <|endoftext|>", "日本語 テスト 한국어", "Ωé²½ Ⅷ १२३",
         "😀😀 ok", "a b c　d", "\U00020000 rare", "x\u0000y\u001cz\u0085w", "!?.,--- ...'s", "1234567 89a1b2", "don'tx 'dd's"]


def test_against_the_library(spark):
    rows = [(i * 3 - 20, t) for i, t in enumerate(TEXTS * 4)]
    got = A.ids_digest(documents(spark, rows)).collect()
    assert key(got) == expected(rows)


def test_null_ids_repeated_rows_and_other_end(spark):
    rows = [(None, "no id"), (None, "no id"), (5, "twice"), (5, "twice"), (5, "twice"), (2, None), (9, "")]
    got = A.ids_digest(documents(spark, rows), end_id=77).collect()
    assert key(got) == expected(rows, 77)


def test_long_texts_span_blocks(spark, monkeypatch):
    """Documents of one id less, as many and more than a block holds, and several blocks long."""
    sizes = [A.BLOCK - 2, A.BLOCK - 1, A.BLOCK, 1, 2 * A.BLOCK - 1, 2 * A.BLOCK, 5, 3 * A.BLOCK + 7]
    rows = [(i, " a" * n) for i, n in enumerate(sizes)]
    docs = documents(spark, rows, 2)
    path = A.shared_path(spark, "ids-long")
    A.write_ids(docs, path, PATH)
    runs = A.read_digests(spark, path).collect()
    assert {r.doc_id: sum(x.doc_id == r.doc_id for x in runs) for r in runs} == {0: 1, 1: 1, 2: 2, 3: 1, 4: 2, 5: 3, 6: 1, 7: 4}
    assert key(A.whole_documents(A.read_digests(spark, path)).collect()) == expected(rows)
    parts = A.read_ids(spark, path).collect()
    for i, n in enumerate(sizes):
        ids = [x for r in sorted((r for r in parts if r.doc_id == i), key=lambda r: r.part) for x in r.ids]
        assert ids == [257] * n + [0]


def test_files_follow_the_order(spark):
    rows = [(i, f"document {i} " * (i % 40)) for i in range(400)]
    path = A.shared_path(spark, "ids-order")
    A.write_ids(documents(spark, rows, 5), path, PATH)
    files = sorted(spark.read.format("binaryFile").load(f"{path}/blocks").collect(), key=lambda r: r.path)
    ids, first = [], 0
    for f in files:
        for r in A.records(bytes(f.content)):
            assert r.first == first
            first += r.n
            ids += r.docs["doc_id"].tolist()
    assert ids == list(range(400))


def test_one_id_holds_a_third_of_the_rows(spark):
    rows = [(1, "hot row")] * 300 + [(i, f"row {i}") for i in range(2, 600)]
    assert key(A.ids_digest(documents(spark, rows, 6)).collect()) == expected(rows)


def test_empty_table(spark):
    got = A.ids_digest(documents(spark, []))
    assert got.collect() == [] and got.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]


def test_other_tokenizer_goes_to_the_library(spark):
    """A file with another pre-tokenizer has no cuts of its own here, and still gives the library's ids."""
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    assert byte_bpe.load(path)[2] is None
    rows = [(i, t) for i, t in enumerate(TEXTS)]
    got = key(A.ids_digest(documents(spark, rows), tokenizer=path).collect())
    assert [r[2] for r in got] == [len(x) + 1 for x in library([t for _, t in rows], path)]


ALPHABET = [*"abst remdvlLS''''  \n\t\r  12!?.,-\"<|>", "'s", "'re", "'ll", "'ve", "é", "ß", " ", " ", "　", "日", "Ω", "²", "½", "😀", "​", "’", "\u0085", "\u001c",
            "\u0000", "﻿", "\U00020000", "́", "<|endoftext|>", "Ⅷ", "१"]


def test_cuts_of_random_texts():
    rnd = random.Random(8)
    encoder = byte_bpe.Encoder(PATH, cache=500)  # so small that it is emptied often
    for plain in (False, True):
        letters = [c for c in ALPHABET if not plain or c not in ("\U00020000", "<|endoftext|>")]
        texts = ["".join(rnd.choices(letters, k=rnd.randint(0, 50))) for _ in range(4000)] + [None, ""]
        for start in range(0, len(texts), 500):
            some = texts[start:start + 500]
            # a slice, whose buffers do not begin with it
            got = encoder.encode(pa.array(["left out", *some]).slice(1))
            assert [x.tolist() for x in got] == library(some)
    assert encoder.encode(pa.array([], pa.string())) == [] and encoder.encode(pa.array([None], pa.string()))[0].tolist() == []


class Counted:
    """A tokenizer that counts the texts it is given."""

    def __init__(self, tokenizer):
        self.tokenizer, self.texts = tokenizer, 0

    def encode_batch_fast(self, texts, **kw):
        self.texts += len(texts)
        return self.tokenizer.encode_batch_fast(texts, **kw)

    def __getattr__(self, name):
        return getattr(self.tokenizer, name)


def test_new_pre_tokens_share_texts():
    rnd = random.Random(3)
    words = sorted({"".join(rnd.choices("abcdeßé", k=rnd.randint(3, 12))) for _ in range(3000)})
    encoder = byte_bpe.Encoder(PATH)
    encoder.tokenizer = Counted(encoder.tokenizer)
    texts = [" ".join(words), "\n".join(words), "\n\n \t".join(words[:50])]
    assert [x.tolist() for x in encoder.encode(pa.array(texts))] == library(texts)
    assert encoder.tokenizer.texts < len(words) / 10


def test_joined_pre_tokens_make_no_added_token():
    """Two pre-tokens that stand apart in the text would be an added token in a text of both."""
    encoder = byte_bpe.Encoder(PATH)
    encoder.tokenizer.add_tokens(["ab cd"])
    encoder.added = re.compile("ab cd")
    try:
        assert encoder._coded([b" ab", b" cd", b"xy", b" "]) == [np.array(x, encoder.width).tobytes() for x in library([" ab", " cd", "xy", " "])]
    finally:
        byte_bpe.load.cache_clear()


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 3 * A.SEGMENT + 100), st.integers(1, 300), st.integers(0, 2**32))
def test_coder_round_trip(n, vocabulary, seed):
    rng = np.random.default_rng(seed)
    ids = np.minimum(rng.geometric(0.05, n) - 1, vocabulary - 1)
    table = A.Table(A.scaled(np.bincount(ids, minlength=vocabulary)))
    r = A.Record(memoryview(A.record(3, 4, 5, b"", ids, table)))
    assert (r.shard, r.block, r.first, r.n) == (3, 4, 5, n) and (r.ids(table) == ids).all()
    # from any checkpoint to any other
    for begin in range(len(r.marks)):
        for end in range(begin + 1, len(r.marks) + 1):
            assert (r.ids(table, begin, end) == ids[begin * A.SEGMENT:end * A.SEGMENT]).all()


def test_table_codes_ids_it_has_not_seen():
    table = A.Table(A.scaled(np.array([5, 0, 0, 7])))
    ids = np.array([1, 2, 1, 0, 3] * 50)
    assert (A.Record(memoryview(A.record(0, 0, 0, b"", ids, table))).ids(table) == ids).all()


def test_scaled_counts():
    for counts in ([0, 0, 0], [1, 2, 3], [10**18, 1, 0], [0] * 50_000 + [10**15]):
        freq = A.scaled(np.array(counts, np.int64))
        assert freq.sum() == 2**A.BITS and freq.min() >= 1
    with pytest.raises(ValueError):
        A.scaled(np.zeros(20, np.int64), 4)


def test_size_is_near_the_entropy():
    rng = np.random.default_rng(1)
    ids = np.minimum(rng.zipf(1.3, A.BLOCK) - 1, 9_999)
    counts = np.bincount(ids, minlength=10_000)
    p = counts[counts > 0] / len(ids)
    least = -(p * np.log2(p)).sum() * len(ids) / 8
    assert len(A.record(0, 0, 0, b"", ids, A.Table(A.scaled(counts)))) < 1.08 * least


def test_broken_records_raise():
    ids = np.arange(3000) % 50
    table = A.Table(A.scaled(np.bincount(ids, minlength=50)))
    whole = A.record(0, 0, 0, b"", ids, table)
    for at in (0, 5, 9, 30, A.HEADER.size + 2, len(whole) - 1):
        broken = bytearray(whole)
        broken[at] ^= 1
        with pytest.raises(ValueError):
            A.Record(memoryview(bytes(broken)))
    with pytest.raises(ValueError):
        A.Record(memoryview(whole[:-1]))
    with pytest.raises(ValueError):
        A.Record(memoryview(whole)).ids(A.Table(A.scaled(np.arange(1, 51))))
    r = A.Record(memoryview(whole))
    r.words = r.words[::-1].copy()
    with pytest.raises(ValueError):
        r.ids(table)


def test_joined_checksums():
    rnd = random.Random(2)
    for _ in range(50):
        a, b = rnd.randbytes(rnd.randint(0, 100)), rnd.randbytes(rnd.randint(0, 5000))
        assert A.join_crc(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)
