"""Token ids as binary files, coded with a static range asymmetric numeral system (rANS).

Writing
1. Documents are range partitioned and sorted by id, tokenized, and cut into blocks of at most
   ``BLOCK`` ids. A document that does not fit into what is left of a block begins a new one; only longer
   documents lie in several. A partition is a shard; its blocks go out as they fill, so memory does not depend on its size.
2. One pass over the blocks counts every id. The counts are scaled to ``2**BITS``; every id of the vocabulary gets
   one at least, so the table also codes texts that it was not made from. All blocks share this table.
3. A block is coded by itself. It has segments of ``SEGMENT`` ids, dealt over ``LANES`` interleaved states, and
   a checkpoint for each segment: where its words begin, the states to begin with, and a checksum of its
   ids. So blocks are decoded in parallel by Spark, and all segments of a block together by numpy.

Files (little-endian). ``table``: Parquet rows (id, freq) and, in id -1, the checksum of the table. ``blocks``: records
one after another, each followed by a line feed, because Spark's text writer stores them. A record is
* the header ``HEADER``: magic, crc32 of all that follows, bytes of the record, shard, block, crc32 of the table, place of
  the first id among all ids, ids, documents, segments, words
* per document ``DOC``: doc_id, its number in the shard, number of this part, ids in this block, flags (1: null id, 2: last part)
* per segment ``MARK``: place of its first word, crc32 of its ids as unsigned 32-bit integers
* states (segments x lanes, 64 bits) and words (32 bits)
File names and records follow the order of doc_id.

Defined results
* A null text counts as empty: its document is the end id alone. A null doc_id comes first. Repeated rows
  are documents of their own, in any order among themselves; of rows with one id but different texts, the hash decides.
* Long texts span blocks, so a block and all that a task holds of it are bounded; only the text itself is whole in its task.
* An empty table gives files without blocks, and no rows. Other columns are ignored.
* A record or a segment whose checksum does not fit, or a table that is not the one the blocks were coded with, raises.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_dir
from .byte_bpe import worker_encoder
from .common import chunks, shared_path, stored
from .wordhash import text_chunks

BITS = 20
LOW = np.uint64(2**31)
LANES = 64
SEGMENT = 8_192
BLOCK = 131_072
# Records in a file, so that a reader's task holds a few megabytes.
FILE_BLOCKS = 32
END_ID = 0
CHUNK_BYTES = 4_000_000

MAGIC = b"rID1"
HEADER = struct.Struct("<4sIIIIIQIIII")
DOC = np.dtype([("doc_id", "<i8"), ("row", "<i8"), ("part", "<i4"), ("n", "<i4"), ("flags", "<i4")])
MARK = np.dtype([("word", "<u4"), ("crc", "<u4")])
NULL_ID, LAST = 1, 2

BLOCKS = "shard int, block int, first long, n int, docs binary, ids binary"
RUNS = "shard int, row long, doc_id long, part int, last boolean, start long, n long, crc long"


# The coder

def scaled(counts: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Frequencies of all ids that sum to 2**bits, each at least one."""
    total, room = sum(map(int, counts)), 2**bits - len(counts)
    if room < 0:
        raise ValueError(f"a vocabulary of {len(counts)} needs more than {bits} bits")
    # whole numbers of any size: counts times room may pass 64 bits
    freq = np.array([1 + (int(c) * room // total if total else 0) for c in counts], np.int64)
    freq[int(np.argmax(counts))] += 2**bits - int(freq.sum())
    return freq


class Table:
    """Frequencies with what coding and decoding look up."""

    def __init__(self, freq: np.ndarray, bits: int = BITS):
        if int(freq.sum()) != 2**bits or freq.min() < 1:
            raise ValueError("the frequencies do not fill the range")
        self.bits = np.uint64(bits)
        self.crc = zlib.crc32(freq.astype("<u4").tobytes())
        # behind the last id an id of the whole range, which leaves a state as it is, for lanes without an id
        self.freq = np.append(freq, 2**bits).astype(np.uint64)
        self.base = np.append(np.cumsum(freq) - freq, 0).astype(np.uint64)
        self.slots = np.repeat(np.arange(len(freq), dtype=np.uint32), freq)

    @property
    def blank(self) -> int:
        return len(self.freq) - 1


def deal(ids: np.ndarray, blank: int) -> np.ndarray:
    """ids as (segments, steps, lanes), filled up with ``blank``."""
    segments = -(-len(ids) // SEGMENT)
    room = np.full(segments * SEGMENT, blank, np.int64)
    room[:len(ids)] = ids
    return room.reshape(segments, SEGMENT // LANES, LANES)


def encode(ids: np.ndarray, table: Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place of each segment's first word, states, words). Steps are coded from the last to the first."""
    dealt = deal(ids, table.blank)
    segments, steps, lanes = dealt.shape
    x = np.full((segments, lanes), LOW, np.uint64)
    out, sent = np.zeros(dealt.shape, np.uint32), np.zeros(dealt.shape, bool)
    top = np.uint64(63) - table.bits
    for t in range(steps - 1, -1, -1):
        f = table.freq[dealt[:, t]]
        full = x >= f << top
        out[:, t], sent[:, t] = x & np.uint64(0xFFFFFFFF), full
        x = np.where(full, x >> np.uint64(32), x)
        q = x // f
        x = (q << table.bits) + (x - q * f) + table.base[dealt[:, t]]
    per_segment = sent.sum((1, 2))
    return np.cumsum(per_segment) - per_segment, x, out[sent]


def decode(n: int, first_words: np.ndarray, states: np.ndarray, words: np.ndarray, table: Table) -> np.ndarray:
    """The ids of segments, all decoded side by side. Any run of consecutive segments can be given; n counts their ids."""
    segments, steps = len(states), SEGMENT // LANES
    x, at = states.copy(), first_words.astype(np.int64)
    out = np.empty((segments, steps, LANES), np.uint32)
    words = np.append(words, np.uint32(0)).astype(np.uint64)
    mask = np.uint64(2 ** int(table.bits) - 1)
    left = np.clip(n - SEGMENT * np.arange(segments), 0, SEGMENT)[:, None] - np.arange(LANES)[None, :]
    for t in range(steps):
        there = left > t * LANES
        slot = x & mask
        ids = table.slots[slot]
        out[:, t] = ids
        y = table.freq[ids] * (x >> table.bits) + slot - table.base[ids]
        few = (y < LOW) & there
        rank = np.cumsum(few, 1)
        take = np.minimum(at[:, None] + rank - 1, len(words) - 1)
        y = np.where(few, y << np.uint64(32) | words[take], y)
        x = np.where(there, y, x)
        at += rank[:, -1]
    if n and (x != LOW).any():
        raise ValueError("a state does not come back to where coding began")
    return out.reshape(-1)[:n]


# Records

def segment_crcs(ids: np.ndarray) -> list[int]:
    wide = ids.astype("<u4")
    return [zlib.crc32(wide[i:i + SEGMENT].tobytes()) for i in range(0, len(wide), SEGMENT)]


def record(shard: int, block: int, first: int, docs: bytes, ids: np.ndarray, table: Table) -> bytes:
    words_at, states, words = encode(ids, table)
    marks = np.zeros(len(states), MARK)
    marks["word"], marks["crc"] = words_at, segment_crcs(ids)
    body = docs + marks.tobytes() + states.astype("<u8").tobytes() + words.astype("<u4").tobytes()
    head = HEADER.pack(MAGIC, 0, HEADER.size + len(body), shard, block, table.crc, first, len(ids), len(docs) // DOC.itemsize, len(states), len(words))
    return MAGIC + struct.pack("<I", zlib.crc32(body, zlib.crc32(head[8:]))) + head[8:] + body


class Record:
    """A record as read from a file. ``ids`` decodes it, or the segments from one checkpoint to another."""

    def __init__(self, content: memoryview):
        magic, crc, size, self.shard, self.block, self.table_crc, self.first, self.n, n_docs, segments, n_words = HEADER.unpack_from(content)
        if magic != MAGIC or len(content) < size or zlib.crc32(content[8:size]) != crc:
            raise ValueError("a record's checksum does not fit")
        self.size, at = size, HEADER.size
        parts = []
        for kind, count in ((DOC, n_docs), (MARK, segments), (np.dtype("<u8"), segments * LANES), (np.dtype("<u4"), n_words)):
            parts.append(np.frombuffer(content, kind, count, at))
            at += kind.itemsize * count
        self.docs, self.marks, states, self.words = parts
        self.states = states.reshape(segments, LANES)

    def ids(self, table: Table, begin: int = 0, end: int | None = None) -> np.ndarray:
        if table.crc != self.table_crc:
            raise ValueError("the block was coded with another table")
        end = len(self.marks) if end is None else end
        n = min(self.n, end * SEGMENT) - begin * SEGMENT
        out = decode(n, self.marks["word"][begin:end], self.states[begin:end], self.words, table)
        if segment_crcs(out) != self.marks["crc"][begin:end].tolist():
            raise ValueError("a segment's checksum does not fit")
        return out


def records(content: bytes) -> Iterator[Record]:
    view, at = memoryview(content), 0
    while at < len(view):
        found = Record(view[at:])
        yield found
        at += found.size + 1  # and the line feed


# Writing

class Packer:
    """Fills blocks with the ids of documents in the order they come."""

    def __init__(self, shard: int):
        self.shard, self.block, self.first, self.row = shard, 0, 0, 0
        self.docs, self.ids, self.n = [], [], 0

    def flush(self) -> tuple | None:
        if not self.n:
            return None
        out = (self.shard, self.block, self.first, self.n, np.array(self.docs, DOC).tobytes(), np.concatenate(self.ids).tobytes())
        self.block, self.first = self.block + 1, self.first + self.n
        self.docs, self.ids, self.n = [], [], 0
        return out

    def add(self, doc_id: int | None, ids: np.ndarray) -> Iterator[tuple]:
        if self.n and len(ids) > BLOCK - self.n:
            yield self.flush()
        for part, begin in enumerate(range(0, len(ids), BLOCK)):
            some = ids[begin:begin + BLOCK]
            flags = (NULL_ID if doc_id is None else 0) | (LAST if begin + len(some) == len(ids) else 0)
            self.docs.append((doc_id or 0, self.row, part, len(some), flags))
            self.ids.append(some)
            self.n += len(some)
            if self.n == BLOCK:
                yield self.flush()
        self.row += 1


def _blocks(path: str, end_id: int):
    names = [x.split()[0] for x in BLOCKS.split(", ")]
    types = [pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary()]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) or [()] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(path)
        packer, end = Packer(TaskContext.get().partitionId()), np.array([end_id], encoder.width)
        for b in text_chunks(batches, size=CHUNK_BYTES):
            rows = []
            for doc_id, ids in zip(b.column("doc_id").to_pylist(), encoder.encode(b.column("text")), strict=True):
                rows += packer.add(doc_id, np.concatenate([ids, end]))
            if rows:
                yield batch(rows)
        last = packer.flush()
        if last:
            yield batch([last])
    return run


def _width(vocabulary: int) -> np.dtype:
    return np.dtype(np.uint16 if vocabulary <= 2**16 else np.uint32)


def _tally(vocabulary: int):
    """Per task one row for each id and each shard that it has seen."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, shards = np.zeros(vocabulary, np.int64), {}
        for b in chunks(batches, 16):
            for shard, n, ids in zip(*(b.column(c).to_pylist() for c in ("shard", "n", "ids")), strict=True):
                shards[shard] = shards.get(shard, 0) + n
                counts += np.bincount(np.frombuffer(ids, _width(vocabulary)), minlength=vocabulary)
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(["id"] * len(some) + ["shard"] * len(shards)), pa.array([*some.tolist(), *shards], pa.int64()), pa.array([*counts[some].tolist(), *shards.values()], pa.int64())],
            names=["kind", "key", "n"])
    return run


def write_ids(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID) -> None:
    """Writes ``table`` and ``blocks`` under ``path``, in a store that all executors share. ``tokenizer`` names the
    file on every worker."""
    spark = docs.sparkSession
    vocabulary = worker_encoder(tokenizer).vocabulary
    checkpoint_dir(spark)
    order = [F.col("doc_id").asc_nulls_first(), "h", "salt"]
    ranged = (docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("h"), F.rand(12).alias("salt"))
              .repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text"))
    # kept by partition: the shards and their order are what both passes below rely on
    blocks = ranged.mapInArrow(_blocks(tokenizer, end_id), BLOCKS).checkpoint()
    # at most one row per id of the vocabulary and one per partition, however long the table is
    totals = blocks.select("shard", "n", "ids").mapInArrow(_tally(vocabulary), "kind string, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(vocabulary, np.int64)
    for r in totals:
        if r.kind == "id":
            counts[r.key] = r.n
    freq = scaled(counts)
    begins, at = {}, 0
    for shard, n in sorted((r.key, r.n) for r in totals if r.kind == "shard"):
        begins[shard], at = at, at + n
    crc = Table(freq).crc
    spark.createDataFrame([(-1, crc), *enumerate(freq.tolist())], "id int, freq long").coalesce(1).write.parquet(f"{path}/table")

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Table(freq)
        for b in chunks(batches, 8):
            out = [record(r["shard"], r["block"], begins[r["shard"]] + r["first"], r["docs"], np.frombuffer(r["ids"], _width(vocabulary)), table)
                   for r in b.to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])

    (blocks.mapInArrow(code, "record binary").select(F.col("record").cast("string").alias("value"))
     .write.option("lineSep", "\n").option("maxRecordsPerFile", FILE_BLOCKS).text(f"{path}/blocks"))


# Reading

def read_table(spark: SparkSession, path: str) -> Table:
    rows = {r.id: r.freq for r in spark.read.schema("id int, freq long").parquet(f"{path}/table").collect()}
    table = Table(np.array([rows[i] for i in range(len(rows) - 1)], np.int64))
    if table.crc != rows[-1]:
        raise ValueError("the table's checksum does not fit")
    return table


def _read(freq: np.ndarray, values):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Table(freq)
        for b in chunks(batches, 1):
            for content in b.column("content").to_pylist():
                for r in records(content):
                    yield values(r, r.ids(table))
    return run


def _run_columns(r: Record) -> list[pa.Array]:
    d = r.docs
    start = r.first + np.cumsum(d["n"].astype(np.int64)) - d["n"]
    return [pa.array(np.full(len(d), r.shard, np.int32)), pa.array(np.ascontiguousarray(d["row"])), pa.array(d["doc_id"].tolist(), pa.int64(), mask=(d["flags"] & NULL_ID) > 0),
            pa.array(np.ascontiguousarray(d["part"])), pa.array((d["flags"] & LAST) > 0), pa.array(start), pa.array(d["n"].astype(np.int64))]


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(f"{path}/blocks").select("content")


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """What lies in the files: shard, row, doc_id, part, last, start, n and ``ids`` of every part of every document."""
    def values(r: Record, ids: np.ndarray) -> pa.RecordBatch:
        offsets = np.append(0, np.cumsum(r.docs["n"])).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids.astype(np.int32)))
        return pa.RecordBatch.from_arrays([*_run_columns(r), lists], names=["shard", "row", "doc_id", "part", "last", "start", "n", "ids"])

    freq = read_table(spark, path).freq[:-1].astype(np.int64)
    return _files(spark, path).mapInArrow(_read(freq, values), RUNS.replace("crc long", "ids array<int>"))


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """The same with ``crc``, the crc32 of the part's ids as unsigned 32-bit integers, instead of the ids."""
    def values(r: Record, ids: np.ndarray) -> pa.RecordBatch:
        wide, crcs, at = memoryview(ids.astype("<u4").tobytes()), [], 0
        for n in r.docs["n"].tolist():
            crcs.append(zlib.crc32(wide[at:at + 4 * n]))
            at += 4 * n
        return pa.RecordBatch.from_arrays([*_run_columns(r), pa.array(crcs, pa.int64())], names=["shard", "row", "doc_id", "part", "last", "start", "n", "crc"])

    freq = read_table(spark, path).freq[:-1].astype(np.int64)
    return _files(spark, path).mapInArrow(_read(freq, values), RUNS)


def _times(matrix: list[int], vector: int) -> int:
    out = 0
    for row in matrix:
        if vector & 1:
            out ^= row
        vector >>= 1
    return out


def join_crc(left: int, right: int, n_bytes: int) -> int:
    """crc32 of two byte strings put together, from their own and the second one's length: the first one's
    is carried over ``n_bytes`` zero bytes by squaring the matrix of one zero bit."""
    matrix = [0xEDB88320, *(1 << i for i in range(31))]  # fixed value: the polynomial of crc32, reflected
    n = 8 * n_bytes
    while n:
        if n & 1:
            left = _times(matrix, left)
        matrix = [_times(matrix, row) for row in matrix]
        n >>= 1
    return left ^ right


def _join_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        crcs = []
        for parts in b.column("parts").to_pylist():
            if [p["part"] for p in parts] != list(range(len(parts))) or not parts[-1]["last"]:
                raise ValueError("a part of a document is missing")
            crc = 0
            for p in parts:
                crc = join_crc(crc, p["crc"], 4 * p["n"])
            crcs.append(crc)
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("start"), b.column("n_tokens"), pa.array(crcs, pa.int64())],
                                         names=["doc_id", "start", "n_tokens", "ids_crc32"])


def whole_documents(runs: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of documents from the digests of their parts. Only documents of several
    parts are grouped, and of these only lengths and checksums, in the order of the parts."""
    single = (F.col("part") == 0) & F.col("last")
    alone = runs.filter(single).select("doc_id", "start", F.col("n").alias("n_tokens"), F.col("crc").alias("ids_crc32"))
    part = F.struct("part", "last", "n", "crc")
    split = runs.filter(~single).groupBy("shard", "row").agg(
        F.max("doc_id").alias("doc_id"), F.min("start").alias("start"), F.sum("n").alias("n_tokens"), F.sort_array(F.collect_list(part)).alias("parts"))
    joined = split.mapInArrow(_join_parts, "doc_id long, start long, n_tokens long, ids_crc32 long")
    return alone.unionByName(joined)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def ids_digest(docs: DataFrame, tokenizer: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Writes the files, reads them back and returns per document: doc_id, start, n_tokens, ids_crc32."""
    spark = docs.sparkSession
    path = shared_path(spark, "token-ids")
    write_ids(docs, path, tokenizer or default_tokenizer(), end_id)
    return whole_documents(stored(read_digests(spark, path), "id-runs"))
