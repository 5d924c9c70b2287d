"""Line dedup: lines that many documents share are dropped, by keep bitmaps instead of text.

Every line becomes a narrow row (128-bit key hash, document, position). The rows are range
partitioned by hash, document and position and sorted the same way, so equal lines stand
together and a very common line is spread over many partitions. Each partition is then
streamed once: a run of equal hashes is counted in documents as it passes and its rows come
out as dropped. Runs that touch the edge of a partition may go on in the next one; a first
pass counts those (two rows per partition at most) and their totals decide them; a document
that goes on over a partition's edge counts once.
Documents get a compressed bitmap of kept lines; texts take no part in any of this.

Defined results
* A null or empty text is one empty line. Keys shorter than ``min_chars`` code points are never dropped.
* A document is one (doc_id, text); a repeated row counts as the same document and gets the same
  bitmap. A null doc_id is a value like any other.
* With ``keep_first`` the line of the smallest (doc_id, text hash, position) of a key stays.
* Only documents that lose a line have a row in the bitmaps. Other columns are ignored by
  ``line_bitmaps``; ``apply_bitmaps`` returns its own columns only.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, chunks, stored

LINES = "hi long, lo long, doc_id long, no_id int, text_hash long, pos int, n_lines int"
DROPS = "doc_id long, no_id int, text_hash long, pos int, n_lines int"
ORDER = ["hi", "lo", "no_id", "doc_id", "text_hash", "pos"]


def line_key(line: str) -> bytes:
    """Stripped and A-Z lower-cased; bytes.lower touches ASCII letters only."""
    return line.strip(BLANKS).encode("utf-8", "surrogatepass").lower()


def _emit(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in LINES.split(", ")]
        types = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32()]
        schema = pa.schema(list(zip(names, types, strict=True)))
        for batch in chunks(batches, 1000):
            out: list[list] = [[] for _ in range(7)]
            for doc, text, text_hash in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                lines = (text or "").split("\n")
                for pos, line in enumerate(lines):
                    key = line_key(line)
                    # a key of so many bytes has at least a quarter as many code points
                    if len(key) < 4 * min_chars and len(key.decode("utf-8", "surrogatepass")) < min_chars:
                        continue
                    h = xxhash.xxh3_128_intdigest(key)
                    row = ((h >> 64) - 2**63, (h & (2**64 - 1)) - 2**63, doc or 0, int(doc is None), text_hash, pos, len(lines))
                    for column, value in zip(out, row, strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], schema=schema)
    return run


def _columns(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
    return {n: batch.column(i).to_numpy(zero_copy_only=False) for i, n in enumerate(batch.schema.names)}


def _runs(c: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the runs of equal keys, and flags of rows that begin another document of their run."""
    n = len(c["hi"])
    change = np.ones(n, bool)
    change[1:] = (c["hi"][1:] != c["hi"][:-1]) | (c["lo"][1:] != c["lo"][:-1])
    other = change.copy()
    for k in ("no_id", "doc_id", "text_hash"):
        other[1:] |= c[k][1:] != c[k][:-1]
    return np.flatnonzero(change), other


EDGES = "hi long, lo long, n_docs long, begin array<long>, end array<long>"


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """First and last run of a partition: key, documents in it, and its first and last row (no_id, doc_id, text_hash, pos)."""
    first = last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        c = _columns(batch)
        starts, other = _runs(c)
        docs = np.add.reduceat(other.astype(np.int64), starts)
        ends = np.append(starts[1:], batch.num_rows) - 1
        for at in sorted({0, len(starts) - 1}):
            begin, end = ([int(c[k][i]) for k in ORDER[2:]] for i in (starts[at], ends[at]))
            key = (int(c["hi"][starts[at]]), int(c["lo"][starts[at]]))
            if at == 0 and last is not None and key == last["key"]:
                last["n"] += int(docs[0]) - (last["end"][:3] == begin[:3])
                last["end"] = end
            else:
                last = {"key": key, "n": int(docs[at]), "begin": begin, "end": end}
                first = first or last
    runs = [] if first is None else [first] if first is last else [first, last]
    yield pa.RecordBatch.from_arrays(
        [pa.array([x["key"][i] for x in runs], pa.int64()) for i in (0, 1)] + [pa.array([x["n"] for x in runs], pa.int64())]
        + [pa.array([x[k] for x in runs], pa.list_(pa.int64())) for k in ("begin", "end")],
        names=["hi", "lo", "n_docs", "begin", "end"])


def _edge_totals(runs: list) -> dict[tuple[int, int], int]:
    """Documents of each key of ``runs``. A document that goes on in the next partition counts once."""
    totals: dict[tuple[int, int], int] = {}
    ends: dict[tuple[int, int], list[int]] = {}
    for r in sorted(runs, key=lambda r: (r.hi, r.lo, r.begin)):
        key = (r.hi, r.lo)
        totals[key] = totals.get(key, 0) + r.n_docs - (key in ends and ends[key] == r.begin[:3])
        ends[key] = r.end[:3]
    return totals


def _stream(min_docs: int, keep_first: bool, edges: dict[tuple[int, int], tuple[int, tuple]]):
    """Rows to drop of a sorted partition. Held back at a batch's end: the rows of its last run, as
    long as that has fewer than ``min_docs`` documents."""
    names = [x.split()[0] for x in DROPS.split(", ")]

    def out(c, rows):
        return pa.RecordBatch.from_pydict({n: c[n][rows] for n in names})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, common = None, None  # rows of an open run; key of an open run that is known to be dropped
        for batch in batches:
            c = _columns(batch)
            if held is not None:
                c = {k: np.concatenate([held[k], v]) for k, v in c.items()}
            if not len(c["hi"]):
                continue
            starts, other = _runs(c)
            docs = np.add.reduceat(other.astype(np.int64), starts)
            keys = list(zip(c["hi"][starts].tolist(), c["lo"][starts].tolist(), strict=True))
            drop = docs >= min_docs
            spared = starts.copy() if keep_first else np.full(len(starts), -1)
            for at, key in enumerate(keys):
                if at == 0 and key == common:
                    drop[0], spared[0] = True, -1  # its first row went by in an earlier batch
                if key in edges:
                    total, head = edges[key]
                    drop[at] = total >= min_docs
                    begins = tuple(int(c[k][starts[at]]) for k in ORDER[2:])
                    if begins != head:
                        spared[at] = -1
            lengths = np.diff(np.append(starts, len(c["hi"])))
            rows = np.repeat(drop, lengths)
            rows[spared[spared >= 0]] = False
            last = int(starts[-1])
            if drop[-1] or keys[-1] in edges:
                held, common = None, keys[-1] if drop[-1] else None
            else:
                held, common = {k: v[last:] for k, v in c.items()}, None
            yield out(c, np.flatnonzero(rows))
    return run


def dropped_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, keep_first: bool = False) -> DataFrame:
    """(doc_id, no_id, text_hash, pos, n_lines) of every line to drop; no_id is 1 for a null doc_id."""
    spark = docs.sparkSession
    lines = stored(docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text"))
                   .mapInArrow(_emit(min_chars), LINES), "lines")
    # kept by partition, because both passes must see the same edges
    ranged = lines.repartitionByRange(*ORDER).sortWithinPartitions(*ORDER).checkpoint()
    # at most two rows per partition, however long the table is
    edges = {key: [n, None] for key, n in _edge_totals(ranged.mapInArrow(_edges, EDGES).collect()).items()}
    if keep_first and edges:
        heads = (lines.join(F.broadcast(spark.createDataFrame(list(edges), "hi long, lo long")), ["hi", "lo"])
                 .groupBy("hi", "lo").agg(F.min(F.struct(*ORDER[2:])).alias("head")))
        for r in heads.collect():
            edges[r.hi, r.lo][1] = tuple(r.head)
    return ranged.mapInArrow(_stream(min_docs, keep_first, {k: tuple(v) for k, v in edges.items()}), DROPS)


def pack(positions: np.ndarray, n_lines: int) -> bytes:
    """Compressed bitmap of kept lines, first line in the lowest bit."""
    keep = np.ones(n_lines, np.uint8)
    keep[positions] = 0
    return zlib.compress(np.packbits(keep, bitorder="little").tobytes())


def unpack(bitmap: bytes, n_lines: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8), count=n_lines, bitorder="little").astype(bool)


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        maps = [pack(np.asarray(p), n) for p, n in zip(b.column("drops").to_pylist(), b.column("n_lines").to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays(
            [b.column("doc_id"), b.column("text_hash"), b.column("n_lines"), pa.array(maps, pa.binary())],
            names=["doc_id", "text_hash", "n_lines", "keep_bitmap"])


def line_bitmaps(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, keep_first: bool = False) -> DataFrame:
    """(doc_id, text_hash, n_lines, keep_bitmap) of each document that loses a line.

    ``docs`` has doc_id and text; text_hash is xxhash64 of the text. ``unpack`` reads a bitmap."""
    return (dropped_lines(docs, min_docs, min_chars, keep_first)
            .groupBy("no_id", "doc_id", "text_hash")
            .agg(F.collect_set("pos").alias("drops"), F.max("n_lines").alias("n_lines"))
            .select(F.when(F.col("no_id") == 0, F.col("doc_id")).alias("doc_id"), "text_hash", "drops", "n_lines")
            .mapInArrow(_pack, "doc_id long, text_hash long, n_lines int, keep_bitmap binary"))


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in chunks(batches, 1000):
        kept, total, gone = [], [], []
        for text, bitmap in zip(b.column("text").to_pylist(), b.column("keep_bitmap").to_pylist(), strict=True):
            lines = (text or "").split("\n")
            keep = [] if bitmap is None else unpack(bitmap, len(lines)).tolist()
            kept.append(text or "" if bitmap is None else "\n".join(x for x, k in zip(lines, keep, strict=True) if k))
            total.append(len(lines))
            gone.append(keep.count(False))
        yield pa.RecordBatch.from_arrays(
            [b.column("row"), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())],
            names=["row", "n_lines", "n_dropped", "kept_text"])


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the ``carry`` columns, n_lines, n_dropped and kept_text for every row of ``docs``."""
    left = docs.select(F.struct(F.col("doc_id").cast("long").alias("doc_id"), *carry).alias("row"), "text", F.xxhash64("text").alias("text_hash"))
    right = bitmaps.select(F.col("doc_id").alias("b_id"), F.col("text_hash").alias("b_hash"), "keep_bitmap")
    joined = left.join(right, F.col("row.doc_id").eqNullSafe(F.col("b_id")) & (F.col("text_hash") == F.col("b_hash")), "left")
    row = joined.schema["row"].dataType.simpleString()
    return joined.select("row", "text", "keep_bitmap").mapInArrow(
        _apply, f"row {row}, n_lines long, n_dropped long, kept_text string").select("row.*", "n_lines", "n_dropped", "kept_text")


def line_digest(docs: DataFrame, min_docs: int = 10, min_chars: int = 1) -> DataFrame:
    """Per document: doc_id, n_lines, n_dropped, kept_sha256 (lowercase hex of the kept text)."""
    return apply_bitmaps(docs, line_bitmaps(docs, min_docs, min_chars)).select(
        "doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


LINE_SQL = r"""
WITH l AS (
  SELECT doc_id, g AS pos, string_split(coalesce(text, ''), chr(10))[g] AS line,
         translate(trim(string_split(coalesce(text, ''), chr(10))[g], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM documents, range(1, len(string_split(coalesce(text, ''), chr(10))) + 1) t(g)),
common AS (SELECT k FROM l WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(c.k)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE c.k IS NULL), '')) AS kept_sha256
FROM l LEFT JOIN common c ON l.k = c.k GROUP BY doc_id
"""
