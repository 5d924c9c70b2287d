"""License scan, token counts, toxicity, quality and language: edge cases, brute force, held-out accuracy."""

import os
import re
import zlib
from collections import Counter
from itertools import chain

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import __spark_entry__ as entry
from check import plain
from fitledger.llm import host_quality, language_id, license_scan, token_counts, toxicity
from fitledger.llm.common import lower_ascii, split_words

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
DOC = "doc_id long, text string, lang string, source string, n_words string, words string, hits int, failed int, n int"
WITH_SQL = ["op2_license_scan", "op4_mixing", "op7_host_quality", "op10_line_dedup"]


def docs(spark, rows):
    return spark.createDataFrame([(i, t, lang, s, "x", "y", 1, 2, 3) for i, t, lang, s in rows], DOC)


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not here")
@pytest.mark.parametrize("name", WITH_SQL)
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{FOLDER}/documents.parquet'")
    df = entry.queries()[name](spark, FOLDER)
    cols = sorted(df.columns)
    rel = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in rel.description]
    assert sorted(names) == cols
    want = [tuple(plain(r[names.index(c)]) for c in cols) for r in rel.fetchall()]
    got = [tuple(plain(x) for x in r) for r in df.select(*cols).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


@given(st.text(alphabet=st.sampled_from("aB é\t\n\x0b\x0c\r\x1c\x85\xa0　 .İ"), max_size=40))
def test_words_and_lower(text):
    assert split_words(text) == re.findall(r"[^\x20\x09-\x0D]+", text)
    assert lower_ascii(text) == "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


# ---- licenses


def scan_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower_ascii(text or ""))


def test_license_brute_force(spark):
    texts = [None, "", "...", "Released under the MIT License.", "under the mit license under the MIT\nlicense",
             "Apache License, Version 2.0; CC BY-NC 4.0", "cc by nc cc by nc", "the mit", "license " * 3000 + "under the mit license",
             "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
             "obtaining a copy", "GNU General Public License", "x under the terms of the GNU General Public License as published by the Free Software Foundation",
             "é under the mit license é", "mit " * 5000]
    rows = [(i, t, "en", "s") for i, t in enumerate(texts)] + [(None, texts[3], "en", "s"), (3, texts[3], "en", "s")]
    got = license_scan.license_scan(docs(spark, rows)).collect()
    assert len(got) == len(rows)
    by_text = dict(zip([r[0] for r in rows], [r[1] for r in rows], strict=True))
    for r in got:
        words = scan_words(by_text[r.doc_id])
        base = [(t.label, i) for t in license_scan.TEMPLATES if t.base for i in range(len(words)) if tuple(words[i:i + len(t.key)]) == t.key]
        assert (r.n_words, r.n_base) == (len(words), len(base))
        assert (r.first_word, r.last_word) == ((min(i for _, i in base), max(i for _, i in base)) if base else (None, None))
        assert r.base_labels == ",".join(sorted({x for x, _ in base}))
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(","))) and 0 <= r.score <= 1
    labels = {r.doc_id: r.labels for r in got if r.doc_id is not None}
    assert labels[9] == "mit" and labels[10] == "" and labels[12] == "gpl" and labels[11] == ""


def test_license_empty(spark):
    assert license_scan.license_digest(docs(spark, [])).collect() == []


# ---- tokens


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(token_counts.default_path())


def whole(tokenizer, text):
    return len(tokenizer.encode(text or "", add_special_tokens=False).ids)


PIECES = ["the", "The", "THAT's", "it'll", "don't", "é", "É", "ß", "ſ", "İ", "ı", "é", "1234", "½", "²", "...", "!?'s", "日本", "Ж", "­", "\x00", "\x1c",
          "\x85", "\xa0", " ", "<|endoftext|>", "<|startoftext|", "<|", "aaaaaaaaaaaaaaaaaaaaaaaaa", "🎉", "'", "''re", "ﬁ", "ŉ", "ª"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([*PIECES, " ", "\n", "\t"]), max_size=25))
def test_tokens_like_the_library(tokenizer, parts):
    text = "".join(parts)
    assert token_counts.Counts(None, {}).count([text]) == [whole(tokenizer, text)]


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_tokens_any_text(tokenizer, text):
    text = text.encode("utf-8", "ignore").decode()
    assert token_counts.Counts(None, {}, cache=5).count([text, text]) == [whole(tokenizer, text)] * 2


def test_token_query_and_sample(spark, tokenizer):
    texts = [None, "", "a b c " * 1500, " ".join(PIECES), "x" * 100_000, "repeat", "repeat"]
    rows = [(i, t, "en", "s") for i, t in enumerate(texts)] + [(None, "null id", "en", "s")]
    want = sorted(((i, len((t or "").encode()), whole(tokenizer, t), whole(tokenizer, t) > 2048) for i, t, *_ in rows), key=repr)
    for size in (0, 3, 2000):
        assert sorted(map(tuple, token_counts.token_counts(docs(spark, rows), frequent_words=size).collect()), key=repr) == want
    assert token_counts.token_counts(docs(spark, [])).collect() == []


SCRIPTS = ["naïve “quotes” — dashes… 5 € ™ ≠ →", "Привет, мир! ёж ЙОД", "ΣΟΦΙΑ σοφίας Ά", "日本語のテキスト。", "한국어 각", "עברית ١٢٣ ४५", "ǅ Ǆ ẞ İI ⅷ Ⅷ",
           "e\u0301 \u212b \u2126 \u200b \u2028x\u3000y", "𝒜 🎉🎊", "\u00ad\u061c\ufeff", "it’s it's"]


def test_tokens_of_all_scripts(tokenizer):
    counts = token_counts.Counts(None, {})
    assert counts.count(SCRIPTS) == [whole(tokenizer, t) for t in SCRIPTS]
    # typographic signs and most letters need no library call for the whole text
    assert all(counts.pre_tokens(SCRIPTS[i]) is not None for i in (0, 1, 3, 4))


def test_tokens_of_every_code_point(tokenizer):
    points = [chr(p) for r in (range(1, 0xD800), range(0xE000, 0x11000), range(0x1D400, 0x1D800), range(0x1F000, 0x20100)) for p in r]
    texts = [f"a{c}a 1{c}1 !{c}! {c}" for c in points]
    counts = token_counts.Counts(None, {})
    wrong = [hex(ord(c)) for c, n, e in zip(points, counts.count(texts), tokenizer.encode_batch(texts, add_special_tokens=False), strict=True) if n != len(e.ids)]
    assert wrong == []


def test_tokens_of_another_file(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    other, texts = Tokenizer.from_file(path), [*SCRIPTS, "It's 1234 Blanks   and\n\nlines", ""]
    got = token_counts.token_counts(docs(spark, [(i, t, "en", "s") for i, t in enumerate(texts)]), path).collect()
    assert sorted((r.doc_id, r.n_tokens) for r in got) == [(i, whole(other, t)) for i, t in enumerate(texts)]


def test_frequent_words_come_from_all_rows(spark):
    # sorted by what they hold: a prefix of the table would see one word only
    rows = [(i, f"w{'abcdefgh'[i // 50]} " * 20 + "x" * 100, "en", "s") for i in range(400)]
    found = token_counts.frequent_lengths(docs(spark, rows).repartitionByRange(8, "doc_id"), size=8)
    assert set(found) == {f"w{c}" for c in "abcdefgh"}


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abcdefghijklmnop"), max_size=30), max_size=30))
def test_heavy_words_bound(texts):
    counts, true = token_counts.Counts(None, {}), Counter(chain.from_iterable(texts))
    found = dict(token_counts.heavy_words([[" ".join(t) for t in texts]], counts, table=8, keep=100))
    total = sum(true.values())
    # whoever holds more than a fifth of all words is never lost, and no count is too large
    assert all(n <= true[w] for w, n in found.items()) and all(w in found for w, n in true.items() if 5 * n > total)


# ---- quality


def brute_repeats(words, n=8):
    grams = [tuple(words[i:i + n]) for i in range(len(words) - n + 1)]
    return len({i + j for i, g in enumerate(grams) if grams.count(g) > 1 for j in range(n)})


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from("ab"), max_size=40))
def test_repeated_words(words):
    assert host_quality.repeated_words(words) == brute_repeats(words)


def test_quality_hosts(spark):
    good = " ".join(f"word{i}" for i in range(40))
    noisy = " ".join(f"word{i} |" for i in range(9)) + " " + " ".join(f"text{i}" for i in range(25))
    rows = [(i, good, "en", "clean") for i in range(200)] + [(200 + i, noisy, "en", "poor") for i in range(60)]
    rows += [(300 + i, good, "en", "poor") for i in range(20)] + [(400, noisy, "en", "clean"), (401, None, "en", None), (402, "", "en", None), (403, good, "en", None)]
    kept = {r.doc_id: r.kept for r in host_quality.quality_verdicts(docs(spark, rows)).collect()}
    assert all(kept[i] for i in range(200)) and not any(kept[200 + i] for i in range(60)) and all(kept[300 + i] for i in range(20))
    assert kept[400] and not kept[401] and not kept[402] and kept[403]
    assert host_quality.quality_digest(docs(spark, [])).collect() == []


def test_quality_one_host(spark):
    rows = [(i, " ".join(f"w{i} #" for i in range(30)), "en", "only") for i in range(5)]
    assert not any(r.kept for r in host_quality.quality_verdicts(docs(spark, rows)).collect())  # two soft rules fail


# ---- toxicity and language


def fold(i, n):
    return zlib.crc32(str(i).encode()) % n


def test_toxicity_held_out(spark):
    rnd = np.random.default_rng(1)
    neutral = [f"{a}{b}" for a in ("ron", "tel", "mor", "pas", "lin", "dau") for b in ("ta", "ke", "lo", "mi", "sun", "ver", "bin")]
    insults = ["grumblewort", "snotfang", "mudbrain"]

    def text(bad):
        words = list(rnd.choice(neutral, rnd.integers(5, 120)))
        if bad:
            words.insert(int(rnd.integers(len(words))), str(rnd.choice(insults)))
        return " ".join(words)

    rows = [(i, text(i % 3 == 0), "en", "s") for i in range(900)]
    labels = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(900)] + [(0, 1, 1), (1, 0, None), (None, 1, 1)],
                                   "doc_id long, quality int, toxic int")
    extra = [(2000, None, "en", "s"), (2001, "", "en", "s"), (None, "ronta", "en", "s"), (2002, "ronta snotfamg telke", "en", "s"), (2003, "ronta " * 20_000, "en", "s")]
    got = toxicity.toxicity(docs(spark, rows + extra), labels).collect()
    assert len(got) == 905 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    held = [r for r in got if r.held_out and r.doc_id < 900]
    assert len(held) > 200 and all(r.held_out == (fold(r.doc_id, 3) == 1) for r in got if r.doc_id is not None)
    assert np.mean([r.predicted == int(r.doc_id % 3 == 0) for r in held]) > 0.97
    score = {r.doc_id: r.score for r in got}
    assert score[2000] == score[2001] < 0.7 and score[2003] < 0.5 < score[2002]  # an unseen misspelling


def test_toxicity_without_labels(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r.score for r in toxicity.toxicity(docs(spark, [(1, "a", "en", "s")]), none).collect()] == [0.0]
    assert toxicity.toxicity(docs(spark, []), none).collect() == []


def brute_viterbi(scores, switch):
    value, back = scores[0].astype(np.float64), []
    for s in scores[1:]:
        best = int(value.argmax())
        came = [k if value[k] >= value[best] - switch else best for k in range(len(value))]
        value = np.array([value[k] if c == k else value[best] - switch for k, c in enumerate(came)]) + s
        back.append(came)
    out = [int(value.argmax())]
    for came in reversed(back):
        out.append(came[out[-1]])
    return out[::-1]


def test_viterbi_side_by_side():
    rnd = np.random.default_rng(2)
    lengths = rnd.integers(0, 30, 40)
    scores = -rnd.integers(0, 60, (lengths.sum(), 3)).astype(np.float32)
    got = language_id.viterbi(scores, lengths, 25.0).tolist()
    want, at = [], 0
    for n in lengths:
        want += brute_viterbi(scores[at:at + n], 25.0) if n else []
        at += n
    assert got == want


def test_language_spans(spark):
    samples = {"en": "the house and the garden with that river which they have been watching", "ru": "дом и сад где река которую они долго смотрели вчера",
               "de": "das haus und der garten mit dem fluss welchen sie schon lange ansehen"}
    rnd = np.random.default_rng(3)
    rows = [(i, " ".join(rnd.permutation(samples[lang].split())), lang, "s") for i, lang in enumerate(list(samples) * 60)]
    extra = [(1000, None, "en", "s"), (1001, "1234 ...", "en", "s"), (1002, samples["de"] + " " + samples["ru"], None, "s"), (None, samples["en"], "en", "s"),
             (1003, "", None, "s"), (1004, "the house " * 20_000, None, "s")]
    got = {r.doc_id: r for r in language_id.language_spans(docs(spark, rows + extra)).collect()}
    held = [r for i, r in got.items() if i is not None and i < 180 and r.held_out]
    assert held and all(r.lang_pred == list(samples)[r.doc_id % 3] for r in held)
    assert all(r.held_out == (fold(i, 5) == 0) for i, r in got.items() if i is not None)
    assert [(got[i].lang_pred, got[i].score) for i in (1000, 1001, 1003)] == [("und", 0.0)] * 3
    assert [(s.lang, s.start) for s in got[1002].spans] == [("de", 0), ("ru", len(samples["de"].split()))]
    assert got[1004].lang_pred == "en" and len(got[1004].spans) == 1


def test_language_nothing_learned(spark):
    rows = [(1, "words", None, "s"), (2, None, None, "s")]
    assert {r.lang_pred for r in language_id.language_digest(docs(spark, rows)).collect()} == {"und"}
    assert language_id.language_digest(docs(spark, [])).collect() == []
