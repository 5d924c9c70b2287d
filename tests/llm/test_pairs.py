"""Jaccard join, decontamination and the pipeline against brute force."""

import itertools
import random
import re

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from fitledger.llm import decontaminate, host_quality, jaccard_join, line_dedup
from fitledger.llm.common import lower_ascii
from fitledger.llm.wordhash import ALNUM, NO_BLANKS, NOT_BLANK, word_hashes

DOC = "doc_id long, text string, lang string, source string, n_chars long"
EXTRA = "doc_id long, text string, lang string, source string, n_chars long, sig string, token string, head string, n string, stretch int"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", f"s{k % 3}", len(t or "")) for k, (i, t) in enumerate(rows)], DOC)


def wide(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", 1, "a", "b", "c", "d", 1) for i, t in rows], EXTRA).repartition(5)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", lower_ascii(text or ""))


def test_word_hashes_keep_texts_apart():
    texts = ["Ab cd", None, "", "cd", "ab\x1ccd é,É", "x" * 100_000, "AB  Cd "]
    for mask, pattern in ((NOT_BLANK, r"[^\x20\x09-\x0D]+"), (ALNUM, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")):
        column = pa.array(["skipped", *texts])[1:]
        h, at = word_hashes(column, mask)
        want = [re.findall(pattern, lower_ascii(t or "")) for t in texts]
        assert np.diff(at).tolist() == list(map(len, want))
        seen = {}
        for value, word in zip(h.tolist(), (w for own in want for w in own), strict=True):
            assert seen.setdefault(word, value) == value
        assert len(set(seen.values())) == len(seen)


def brute_components(rows):
    sets = []
    for _, t in rows:
        w = words(t)
        sets.append({tuple(w[i:i + 3]) for i in range(len(w) - 2)} if len(w) >= 3 else {tuple(w)} if w else set())
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and find(a) != find(b):
                both = len(sets[a] & sets[b])
                if 100 * both >= 90 * (len(sets[a]) + len(sets[b]) - both):
                    parent[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    return sorted(((i, len(s), least.get(find(k), i) if s else i) for k, ((i, _), s) in enumerate(zip(rows, sets, strict=True))), key=repr)


def family(rnd, base, n, edits, kinds=("replace", "drop", "insert", "cut")):
    """Near copies of ``base``; the vocabulary of new words is small, so edits also meet."""
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rnd.randint(0, edits)):
            kind, at = rnd.choice(kinds), rnd.randrange(len(w))
            if kind == "replace":
                w[at] = f"new{rnd.randrange(300)}"
            elif kind == "drop":
                del w[at]
            elif kind == "insert":
                w.insert(at, f"new{rnd.randrange(300)}")
            else:
                w = w[: len(w) - rnd.randint(1, 4)]
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_jaccard_brute_force(spark, seed):
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    bases = [[rnd.choice(vocabulary) for _ in range(rnd.choice([40, 90, 140]))] for _ in range(4)]
    texts = []
    for k, base in enumerate(bases):  # beyond COMMON members: dense nodes, leaders and grey pairs
        texts += family(rnd, base, (220, 150, 90, 3)[k], 7)
    texts += [" ".join(bases[1][: 90 - k]) for k in range(0, 40)] * 2  # a chain of cut copies
    texts += [" ".join(bases[0][:30] + [rnd.choice(vocabulary) for _ in range(60)]) for _ in range(100)]  # a shared passage
    texts += ["", None, "  ", "one", "ONE", "one two", "two one", "a b c", "A\tb\nc", "a b c d"]
    rnd.shuffle(texts)
    rows = [(1000 + i, t) for i, t in enumerate(texts)]
    rows += [(5, texts[0]), (5, texts[0]), (None, texts[1]), (None, None), (None, "only here and nowhere else")]
    got = sorted(map(tuple, jaccard_join.jaccard_components(wide(spark, rows)).collect()), key=repr)
    assert got == brute_components(rows)


def test_jaccard_empty_and_long(spark):
    assert jaccard_join.jaccard_components(wide(spark, [])).collect() == []
    long = " ".join(f"w{i}" for i in range(30_000))
    rows = [(1, long), (2, long + " more"), (3, "x" * 100_000), (4, "same " * 1000)]
    got = sorted(map(tuple, jaccard_join.jaccard_components(wide(spark, rows)).collect()))
    assert got == [(1, 29_998, 1), (2, 29_999, 1), (3, 1, 3), (4, 1, 4)]


def test_components_chain(spark):
    n = 60
    edges = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(100, 101), (101, 100), (7, 7)], "a long, b long")
    got = {r.node: r.root for r in jaccard_join.components(edges).collect()}
    assert got == {**{i: 0 for i in range(n + 1)}, 100: 100, 101: 100}


# ---- near copies by five words and 0.8


def brute_near(rows, shingle=5, percent=80):
    """Component of each row number, by the rule of the pipeline's stage."""
    sets = []
    for _, t in rows:
        w = words(t)
        sets.append({tuple(w[i:i + shingle]) for i in range(len(w) - shingle + 1)} if len(w) >= shingle else {tuple(w)} if w else set())
    root = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and root[a] != root[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                low, high = sorted((root[a], root[b]))
                root = [low if x == high else x for x in root]
    return root


@pytest.mark.parametrize(("seed", "shingle", "percent"), [(1, 5, 80), (2, 5, 80), (3, 4, 85)])
def test_jaccard_rule_brute_force(spark, seed, shingle, percent):
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    bases = [[rnd.choice(vocabulary) for _ in range(rnd.choice([40, 90, 140]))] for _ in range(4)]
    texts = []
    for k, base in enumerate(bases):
        texts += family(rnd, base, (200, 140, 90, 3)[k], 6)
    texts += [" ".join(bases[1][: len(bases[1]) - k]) for k in range(0, 30)] * 2
    texts += [" ".join(bases[0][:30] + [rnd.choice(vocabulary) for _ in range(60)]) for _ in range(80)]
    texts += ["", None, "  ", "one", "ONE", "one two", "two one", "a b c d", "A\tb\nc d", "a b c d e"]
    rnd.shuffle(texts)
    rows = [(1000 + i, t) for i, t in enumerate(texts)]
    got = {r.doc_id: r.component_id for r in jaccard_join.jaccard_components(wide(spark, rows), shingle, percent).collect()}
    assert got == {1000 + i: 1000 + k for i, k in enumerate(brute_near(rows, shingle, percent))}


def test_near_stage_takes_appended_cut_and_replaced_copies(spark):
    rnd = random.Random(12)
    text = lambda n: [f"w{rnd.randrange(5000)}" for _ in range(n)]
    rows = []
    for k in range(12):
        base = text(200)
        changed = [x if i % 50 != 25 else f"new{k}" for i, x in enumerate(base)]  # 2 % of the words, one by one
        copies = (base, base + text(40), base[:170], changed, base + text(70))  # the last one is below 0.8
        rows += [(10 * k + n, " ".join(w)) for n, w in enumerate(copies)]
    got = corpus_pipeline.near_stage(spark, docs(spark, rows), "").collect()
    want = {rows[i][0] for i, k in enumerate(brute_near(rows)) if i == k}
    assert {r.doc_id for r in got} == want == {10 * k + n for k in range(12) for n in (0, 4)}


# ---- decontamination


SINGLES = "".join(f"{chr(a)}-{chr(b)}" for a, b in NO_BLANKS)
TOKEN = re.compile(rf"[{SINGLES}]|[^\x00-\x2F\x3A-\x60\x7B-\x7F{SINGLES}]+")


def alnum(text):
    return TOKEN.findall(lower_ascii(text or ""))


def counts(item, doc):
    """Four fifths of the item in place at one offset, or a best run with LEAST_RUN equal words; a short item word for word."""
    if len(item) < decontaminate.LEAST_ITEM:
        return bool(item) and any(doc[o:o + len(item)] == item for o in range(len(doc)))
    for o in range(-len(item) + 1, len(doc)):
        same = [doc[k + o] == x for k, x in enumerate(item) if 0 <= k + o < len(doc)]
        if 5 * sum(same) >= 4 * len(item):
            return True
        if sum(same) >= decontaminate.LEAST_RUN:
            sums = list(itertools.accumulate((1 if x else -4 for x in same), initial=0))
            runs = [(sums[j] - sums[i], sum(same[i:j])) for i in range(len(sums)) for j in range(i + 1, len(sums))]
            if max(runs)[1] >= decontaminate.LEAST_RUN:
                return True
    return False


def brute_contaminated(rows, items):
    """All pairs that count, short items included."""
    split = {t: alnum(t) for _, t in rows}
    sets = {t: set(w) for t, w in split.items()}
    out = set()
    for item_id, text in items:
        item = alnum(text)
        # a quick look first; words that repeat within the item tell less
        need = min(decontaminate.LEAST_RUN, -(-4 * len(item) // 5)) if len(set(item)) == len(item) else 1
        out |= {(i, item_id) for i, t in rows if len(set(item) & sets[t]) >= need and counts(item, split[t])}
    return out


def test_decontamination_brute_force(spark):
    """Items of 1 to 300 words, some of them Chinese or Thai; whole, changed, cut and shifted passages in many documents."""
    rnd = random.Random(4)
    vocabulary = [f"w{i}" for i in range(3000)]
    noise = lambda n: [rnd.choice(vocabulary) for _ in range(n)]
    sizes = [1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15, 16, 19, 20, 25, 31, 45, 60, 90, 300]
    items = [(i, " ".join(f"i{i}w{k}" for k in range(n))) for i, n in enumerate(sizes)]
    han = "天地玄黄宇宙洪荒日月盈昃辰宿列张寒来暑往秋收冬藏闰馀成岁律吕调阳"
    items += [(40, han), (41, han[8:16]), (42, "ราชการไทยและภาษา"), (43, "x 天地 y 宇宙 z ok go"), (50, None), (51, ""), (0, items[0][1]), (None, items[16][1])]
    rows = [(i, " ".join(noise(60))) for i in range(20)]
    for i, text in items:
        w = alnum(text)
        glue = "" if i in (40, 41, 42) else " "
        for kind in range(8):
            places = set(rnd.sample(range(len(w)), min(len(w), [0, 0, 1, len(w) // 5, len(w) // 5 + 1, len(w) // 4, 0, 0][kind])))
            x = ["別" if glue == "" and k in places else f"o{k}" if k in places else y for k, y in enumerate(w)]
            x = x[len(w) // 6:] if kind == 6 else x[: len(w) // 2] + ["inserted"] + x[len(w) // 2:] if kind == 7 else x
            body = glue.join(x)
            rows.append((100 + len(rows), " ".join([*noise(rnd.randint(0, 30)), body.upper() if kind == 1 else body, *noise(rnd.randint(0, 30))])))
    rows += [(2000, None), (2001, ""), (2002, " ".join(alnum(items[5][1]) * 30)), (None, items[9][1]), (rows[30][0], rows[30][1])]
    benchmark = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, doc_id string")
    got = decontaminate.contaminated(wide(spark, rows), benchmark).collect()
    pairs = [(r.doc_id, r.item_id) for r in got]
    assert len(pairs) == len(set(pairs))
    assert set(pairs) == brute_contaminated(rows, items) and len(pairs) > 100
    assert {r.item_id for r in got if r.short} <= {0, 1, 2, 3, 4} and {r.item_id for r in got if not r.short} >= {40, 41, 42}


def test_seeds_agree_in_every_pair_that_counts():
    """The least numbers of agreeing seeds against all placements of differing words."""
    def seeds(bits, masks):
        return sum(all(bits[i + j] for j, c in enumerate(m) if c == "1") for m in masks for i in range(len(bits) - len(m) + 1))

    for masks in decontaminate.FAMILIES:
        for n in (6, 9, 10, 14, 15):
            least = min(seeds([k not in places for k in range(n)], masks) for places in itertools.combinations(range(n), n // 5))
            assert decontaminate.least_in_place(n, masks) == least
    for n in range(6, 120):
        masks, agreeing = decontaminate.masks_for(n)
        assert agreeing >= 2 and all("0" in m for m in masks) or n < 12
        assert agreeing <= decontaminate.least_in_place(n, masks)


def test_hot_phrases_make_no_pairs(spark):
    """200 items and 1,000 documents share phrases of four and of six words; only planted passages are candidates."""
    rnd = random.Random(5)
    vocabulary = [f"w{i}" for i in range(20_000)]
    noise = lambda n: " ".join(rnd.choice(vocabulary) for _ in range(n))
    for phrase in ("which of the following", "which of the following is true"):
        items = [(i, f"{noise(8)} {phrase} {noise(rnd.randint(4, 30))}") for i in range(200)]
        rows = [(i, f"{noise(20)} {phrase} {noise(20)}") for i in range(1000)] + [(2000 + i, f"{noise(9)} {items[i][1]} {noise(5)}") for i in range(20)]
        benchmark = spark.createDataFrame(items, "item_id long, text string")
        docs_ = wide(spark, rows)
        kept = decontaminate.benchmark_items(benchmark).cache()
        seeds = decontaminate.item_seeds(kept).cache()
        bits = decontaminate.bloom(seeds.select("hash"), "hash", decontaminate.bits_for(seeds.count()))
        masks = sorted({m for r in kept.collect() for m in decontaminate.masks_for(r.n)[0]})
        found = decontaminate.stretches(docs_, bits, masks, 60)
        hits = found.select("stretch", decontaminate.F.explode("hits").alias("h")).select("stretch", "h.pos", "h.hash")
        looked_up = hits.join(decontaminate.lookups(seeds, hits, kept), "hash").count()
        n = decontaminate.candidates(seeds, hits, kept).count()
        got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs_, benchmark).collect()}
        assert got == {(2000 + i, i) for i in range(20)}
        assert n == 20 and looked_up < 10 * (len(got) + len(rows))


def test_decontamination_hot_item_and_empty(spark):
    rnd = random.Random(6)
    item = " ".join(f"q{rnd.randrange(1000)}" for _ in range(40))
    benchmark = spark.createDataFrame([(1, item)], "item_id long, text string")
    rows = [(i, f"before{i} {item} after{i}" if i % 3 == 0 else f"clean{i} text") for i in range(300)]
    got = decontaminate.contaminated(wide(spark, rows), benchmark).collect()
    assert {r.doc_id for r in got} == set(range(0, 300, 3)) and all(r.share == 1.0 and r.doc_start == 1 for r in got)
    assert decontaminate.contaminated(wide(spark, []), benchmark).collect() == []
    assert decontaminate.contaminated(wide(spark, rows), benchmark.limit(0)).collect() == []


def test_decontamination_finds_every_placement_of_replaced_words(spark):
    items = {n: [f"n{n}w{i}" for i in range(n)] for n in range(6, 31)}
    rows, want = [], set()
    for n, w in items.items():
        for k in range(1, min(3, n // 5) + 1):
            for places in itertools.combinations(range(n), k):
                changed = [f"other{i}" if i in places else x for i, x in enumerate(w)]
                want.add((len(rows), n, n - k))
                rows.append((len(rows), " ".join(["before", "it", *changed, "after", "it"])))
    benchmark = spark.createDataFrame([(n, " ".join(w)) for n, w in items.items()], "item_id long, text string")
    got = decontaminate.contaminated(wide(spark, rows), benchmark).collect()
    assert {(r.doc_id, r.item_id, r.n_match) for r in got} == want


def test_decontamination_four_fifths_in_place(spark):
    rnd = random.Random(8)
    items, rows = [], []
    # nine words at either end, and every fourth of the words between them replaced
    for n in [6, 7, 10, 11, 15, 15, 21, 30, 45, 86, 86]:
        items.append((len(items), [f"i{len(items)}w{k}" for k in range(n)]))
    for i, w in items:
        for share in (0.1, 0.2, 0.25, 0.3):
            for _ in range(6):
                places = set(rnd.sample(range(len(w)), round(share * len(w))))
                rows.append((len(rows), " ".join([*["x"] * rnd.randint(0, 3), *(f"o{k}" if k in places else x for k, x in enumerate(w)), "y"])))
        rows.append((len(rows), " ".join(f"o{k}" if 9 <= k < len(w) - 9 and (k - 9) % 4 == 0 else x for k, x in enumerate(w))))
        rows.append((len(rows), " ".join(f"o{k}" if k % 5 == 4 else x for k, x in enumerate(w))))
    want = {(d, i) for d, text in rows for i, w in items if counts(w, alnum(text))}
    benchmark = spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id long, text string")
    got = [(r.doc_id, r.item_id) for r in decontaminate.contaminated(wide(spark, rows), benchmark).collect()]
    assert sorted(got) == sorted(want)


# ---- pipeline


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rnd = random.Random(9)
    vocabulary = [f"w{i}" for i in range(2000)]
    text = lambda n: " ".join(rnd.choice(vocabulary) for _ in range(n))
    items = [(i, text(40)) for i in range(3)]
    rows = [(i, text(60) + "\n" + text(30)) for i in range(80)]
    rows += [(100 + i, "A line that many pages share\n" + text(50)) for i in range(15)]
    rows += [(200 + i, rows[i][1] + " more") for i in range(10)] + [(300 + i, rows[3][1]) for i in range(4)]
    rows += [(400 + i, text(40) + " " + items[i % 3][1]) for i in range(6)]
    rows += [(500, None), (501, "too short"), (502, "again and again " * 40), (None, text(50)), (None, text(50)), (5, rows[5][1])]
    folder = tmp_path_factory.mktemp("corpus")
    docs(spark, rows).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder), rows, items


def brute_pipeline(rows, items):
    kept = [(i, t) for i, t in rows if len(words(t)) >= 20 and 100 * host_quality.repeated_words(words(t)) <= 30 * len(words(t))]
    where = {}
    for i, t in kept:
        for pos, line in enumerate(t.split("\n")):
            where.setdefault(line_dedup.line_key(line), []).append((i is None, i or 0, pos))
    common = {k: min(v) for k, v in where.items() if len({x[:2] for x in v}) >= 10}
    cut = [(i, "\n".join(x for pos, x in enumerate(t.split("\n"))
                         if common.get(line_dedup.line_key(x), (i is None, i or 0, pos)) == (i is None, i or 0, pos))) for i, t in kept]
    ids = {k: (k, t) for k, t in enumerate(x[1] for x in cut)}
    numbered = sorted(((cut[k][0] is None, cut[k][0] or 0, cut[k][1]), k) for k in ids)
    order = {k: n for n, (_, k) in enumerate(numbered)}
    unique = brute_near([cut[k] for _, k in numbered])  # by rank
    first = [cut[k] for _, k in numbered if unique[order[k]] == order[k]]
    leaks = {i for i, k in brute_contaminated(first, items) if len(alnum(dict(items)[k])) >= decontaminate.LEAST_ITEM}
    return [(i, t) for i, t in first if i not in leaks]


def test_pipeline_brute_force(spark, corpus):
    folder, rows, items = corpus
    got = corpus_pipeline.run(spark, folder)
    assert got.columns[:5] == corpus_pipeline.COLUMNS
    found = got.collect()
    before_mix = brute_pipeline(rows, items)
    # the stages up to the mix are held to equality, the mix to its rules: it leaves out what its targets leave out
    spark_, docs_ = spark, spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs_ = stage(spark_, docs_, folder)
    assert sorted(((r.doc_id, r.text) for r in docs_.collect()), key=repr) == sorted(before_mix, key=repr)
    assert {(r.doc_id, r.text) for r in found} <= set(before_mix)
    sizes, taken = {}, {}
    for r in found:
        sizes[r.source] = r.source_size
        taken[r.source] = taken.get(r.source, 0) + r.taken
        assert r.size == len(words(r.text)) and r.taken <= 2 * r.size
        assert abs(r.n_chars - len(r.text)) == 0
    assert sum(sizes.values()) == sum(len(words(t)) for _, t in before_mix)
    assert all(abs(taken[r.source] - r.target) <= 1 for r in found)


def test_pipeline_stages_are_deterministic_and_take_empty_tables(spark, corpus):
    folder, _, _ = corpus
    docs_ = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        once, again = (sorted(map(tuple, stage(spark, docs_.repartition(n), folder).collect()), key=repr) for n in (2, 5))
        assert once == again
        assert stage(spark, docs_.filter("1 = 0"), folder).collect() == []
