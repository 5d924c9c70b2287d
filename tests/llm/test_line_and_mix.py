"""Line dedup and mixing: edge cases, hot keys over many partitions, brute force."""

import hashlib
import random
import re
from collections import defaultdict

import numpy as np

from fitledger.llm import line_dedup, mixing

DOC = "doc_id long, text string, source string, hi string, n_lines string"
BLANK = " \t\n\x0b\x0c\r"


def docs(spark, rows, parts=3):
    """Rows with extra columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, s, "x", "y") for i, t, s in rows], DOC).repartition(parts)


def key(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(BLANK))


def expected_lines(rows, min_docs, min_chars):
    where = defaultdict(set)
    for i, t, _ in rows:
        for line in (t or "").split("\n"):
            where[key(line)].add((i, t))
    out = []
    for i, t, _ in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(key(x)) < min_chars or len(where[key(x)]) < min_docs]
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=repr)


def run_lines(spark, rows, min_docs=3, min_chars=1, parts=3):
    return sorted(map(tuple, line_dedup.line_digest(docs(spark, rows, parts), min_docs, min_chars).collect()), key=repr)


def test_lines_nulls_blanks_and_case(spark):
    rows = [(1, None, "a"), (2, "", "a"), (3, "Menu\nown 3\n\n", "a"), (4, " MENU\t\nown 4", None), (5, "menu\nÉtoile", "b"),
            (6, "étoile\nMENU", "b"), (None, "menu\nx", "b"), (7, "\n\n", "b")]
    assert run_lines(spark, rows) == expected_lines(rows, 3, 1)


def test_lines_repeated_rows_count_once(spark):
    rows = [(1, "same\nline", "a")] * 5 + [(2, "other", "a")]
    assert run_lines(spark, rows, 3) == expected_lines(rows, 3, 1)


def test_lines_hot_key_over_partitions(spark):
    rnd = random.Random(3)
    rows = [(i, "\n".join(["Hot line", f"own {i}", f"pair {i // 2}", *["Hot line"] * rnd.randint(0, 2), f"group {i % 40}"]), "s") for i in range(600)]
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    try:
        assert run_lines(spark, rows, 10) == expected_lines(rows, 10, 1)
        maps = line_dedup.dropped_lines(docs(spark, rows), 10, keep_first=True).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    gone = {(r.doc_id, r.pos) for r in maps}
    kept = defaultdict(int)
    for i, t, _ in rows:
        for pos, line in enumerate(t.split("\n")):
            kept[line] += (i, pos) not in gone
    assert kept["Hot line"] == 1 and all(kept[f"group {g}"] == 1 for g in range(40))
    assert all(kept[f"own {i}"] == 1 for i in range(600)) and all(kept[f"pair {i}"] == 2 for i in range(300))


def test_lines_documents_over_partition_edges_count_once(spark):
    rows = [(i, "\n".join([f"own {i}", *["nine documents"] * 300]), "s") for i in range(9)]
    rows += [(50, "\n".join(["one document"] * 4000), "s"), (None, "\n".join(["no id"] * 2000), "s")]
    rows += [(100 + i, "\n".join(["ten documents"] * 200), "s") for i in range(10)]
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for parts in ("1", "7", "40"):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            assert run_lines(spark, rows, 10) == expected_lines(rows, 10, 1)
            kept_first = line_dedup.dropped_lines(docs(spark, rows), 10, keep_first=True).count()
            assert kept_first == 10 * 200 - 1
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_lines_min_chars_and_long_text(spark):
    rows = [(i, "ab\nabc\n" + "z" * 200_000, "s") for i in range(3)]
    assert run_lines(spark, rows, 3, 3) == expected_lines(rows, 3, 3)


def test_lines_empty_table(spark):
    assert run_lines(spark, []) == []


def test_bitmap_round_trip():
    for n in (1, 7, 8, 9, 1000):
        drop = np.arange(0, n, 3)
        keep = np.ones(n, bool)
        keep[drop] = False
        assert (line_dedup.unpack(line_dedup.pack(drop, n), n) == keep).all()


def targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    cap, out, left, full = {s: 2 * sizes[s] for s in names}, {}, 1.5 * sum(sizes.values()), set()
    while True:
        open_ = [s for s in names if s not in full]
        level = (left - sum(cap[s] for s in full)) / max(1, sum(weight[s] for s in open_))
        over = {s for s in open_ if level * weight[s] > cap[s]}
        if not over:
            return {s: float(cap[s]) if s in full else level * weight[s] for s in names}
        full |= over


def test_mix_targets_and_takes(spark):
    rnd = random.Random(5)
    rows = [(i, " ".join("w" * rnd.randint(1, 9) for _ in range(rnd.choice([0, 1, 5, 40, 300]))), rnd.choice(["a", "b", "c", "d", None, "é"] + ["hot"] * 6))
            for i in range(1500)]
    rows += [(None, None, "a"), (None, "x y", "a"), (7, rows[7][1], rows[7][2])]
    got = mixing.mix(docs(spark, rows)).collect()
    assert len(got) == len(rows)
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    want = targets(sizes)
    taken = defaultdict(int)
    for r in got:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6 * (1 + want[r.source])
        assert 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
        # complete epochs come first
        assert r.taken >= int(r.target // r.source_size if r.source_size else 0) * r.size
    assert all(abs(taken[s] - want[s]) <= 1 for s in sizes)
    again = mixing.mix(docs(spark, rows, 7)).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, again), key=repr)


def test_mix_empty_and_wordless(spark):
    assert mixing.mix(docs(spark, [])).collect() == []
    got = mixing.mix(docs(spark, [(1, None, None), (2, " ", "a")])).collect()
    assert [(r.size, r.target, r.taken) for r in got] == [(0, 0.0, 0)] * 2
