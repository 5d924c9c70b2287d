"""Fill-in-the-middle by piece tables.

A document is a list of descriptors (buffer, start, length) over two buffers that never change:
its own UTF-8 bytes and the sentinels. Cutting splits the descriptor that holds the place, an
arrangement permutes the three parts and puts a sentinel's descriptor before each, and the inverse
permutation gives the text back. Hashes read the buffers descriptor by descriptor. Only
``fill`` and ``restore`` copy bytes, once, because their result is a text.

Everything happens within a row, so there is no shuffle, whatever the source of a document.

Defined results
* A null text counts as empty. An empty text, one that holds a sentinel, and the share that the
  hash of the id leaves alone keep their form ``plain``: one descriptor over the whole text.
* Units are ``[A-Za-z]+|[^A-Za-z]`` over code points, found on the bytes: a letter run, or any
  other code point. The cuts lie between units, so no code point is cut in two.
* The choice depends on ``seed`` and doc_id only. Rows of one id get the same draws; a null
  doc_id draws like an empty one. Repeated rows give repeated results.
* Other columns are ignored, whatever their names. An empty table gives an empty result.
* A batch is cut to about a megabyte of text, one document at least, so long texts come alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .wordhash import text_chunks

SENTINELS = (b"<P>", b"<S>", b"<M>")
MARKS = b"".join(SENTINELS)
TEXT, MARK = 0, 1
# Parts (0 prefix, 1 suffix, 2 middle) in the order in which a form writes them.
FORMS = {"psm": (0, 1, 2), "spm": (1, 0, 2)}
PLAIN_FROM, SPM_BELOW = 90, 20

Piece = tuple[int, int, int]
TABLE = ("doc_id long, text string, n long, form string, prefix_chars long, middle_chars long, "
         "pieces array<struct<buffer:int,start:long,length:long>>")
PIECES = pa.list_(pa.struct([("buffer", pa.int32()), ("start", pa.int64()), ("length", pa.int64())]))

LETTER = np.zeros(256, bool)
LETTER[[*range(65, 91), *range(97, 123)]] = True


def split(pieces: list[Piece], at: int) -> tuple[list[Piece], list[Piece]]:
    """The descriptors before and after place ``at``; the one that holds it is split."""
    before: list[Piece] = []
    for i, (buffer, start, length) in enumerate(pieces):
        if at < length:
            left = [(buffer, start, at)] if at else []
            return before + left, [(buffer, start + at, length - at), *pieces[i + 1:]]
        before.append((buffer, start, length))
        at -= length
    return before, []


def cut(pieces: list[Piece], first: int, second: int) -> list[list[Piece]]:
    """Prefix, suffix and middle of a piece table cut at two places, first <= second."""
    prefix, rest = split(pieces, first)
    middle, suffix = split(rest, second - first)
    return [prefix, suffix, middle]


def arrange(parts: list[list[Piece]], form: str) -> list[Piece]:
    """The parts in the order of ``form``, each behind its sentinel."""
    return [p for i in FORMS[form] for p in ((MARK, 3 * i, 3), *parts[i])]


def arranged_pieces(output: bytes, form: str) -> list[list[Piece]]:
    """Prefix, suffix and middle as descriptors over an output. The text has no sentinel of its own,
    and none can arise at a seam, so each sentinel stands where it is first found."""
    at, found = 0, []
    for i in FORMS[form]:
        begin = output.index(SENTINELS[i], at)
        found.append((i, begin, begin + 3))
        at = begin + 3
    ends = [begin for _, begin, _ in found[1:]] + [len(output)]
    parts: list[list[Piece]] = [[], [], []]
    for (i, _, start), end in zip(found, ends, strict=True):
        parts[i] = [(TEXT, start, end - start)] if end > start else []
    return parts


def inverse(parts: list[list[Piece]]) -> list[Piece]:
    """The descriptors of the text: prefix, middle, suffix, without sentinels."""
    prefix, suffix, middle = parts
    return [*prefix, *middle, *suffix]


def slices(pieces: list[Piece], text: memoryview) -> Iterator[memoryview]:
    buffers = (text, memoryview(MARKS))
    for buffer, start, length in pieces:
        yield buffers[buffer][start:start + length]


def stream_sha256(pieces: list[Piece], text: memoryview) -> str:
    digest = hashlib.sha256()
    for part in slices(pieces, text):
        digest.update(part)
    return digest.hexdigest()


def units(data: np.ndarray, heads: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(flags of bytes that begin a unit, flags of bytes that begin a code point). ``heads`` are the places
    where texts begin; a unit does not run on into the next text."""
    lead = (data & 0xC0) != 0x80
    letter = LETTER[data]
    begins = lead.copy()
    begins[1:] &= ~(letter[1:] & letter[:-1])
    begins[heads[heads < len(data)]] = True
    return begins, lead


def _buffers(texts: pa.Array) -> tuple[memoryview, np.ndarray]:
    """The bytes of all texts of an array and the places where each begins (and the end)."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = memoryview(texts.buffers()[2] or b"")[int(at[0]):int(at[-1])]
    return data, at - at[0]


def _cut_batch(b: pa.RecordBatch, plain_from: int, spm_below: int) -> pa.RecordBatch:
    data, at = _buffers(b.column("text"))
    begins, lead = units(np.frombuffer(data, np.uint8), at[:-1])
    unit_at = np.flatnonzero(begins)
    points = np.concatenate([np.zeros(1, np.int64), np.cumsum(lead)])
    first_unit = np.searchsorted(unit_at, at)
    draws = [b.column(f"h{i}").to_numpy() for i in range(1, 5)]
    forms, prefix_chars, middle_chars, tables = [], [], [], []
    counts = np.diff(first_unit)
    for row, n in enumerate(counts.tolist()):
        begin, end = int(at[row]), int(at[row + 1])
        own = bytes(data[begin:end])
        pieces: list[Piece] = [(TEXT, 0, end - begin)] if own else []
        h1, h2, h3, h4 = (int(d[row]) for d in draws)
        if not own or h3 % 100 >= plain_from or any(s in own for s in SENTINELS):
            form, chars = "plain", (None, None)
        else:
            form = "spm" if h4 % 100 < spm_below else "psm"
            # a cut after n units is the end of the text
            places = [int(unit_at[first_unit[row] + m]) if m < n else end for m in sorted((h1 % (n + 1), h2 % (n + 1)))]
            pieces = arrange(cut(pieces, places[0] - begin, places[1] - begin), form)
            chars = (int(points[places[0]] - points[begin]), int(points[places[1]] - points[places[0]]))
        forms.append(form)
        prefix_chars.append(chars[0])
        middle_chars.append(chars[1])
        tables.append([{"buffer": x, "start": s, "length": k} for x, s, k in pieces])
    columns = [b.column("doc_id"), pc.fill_null(b.column("text"), ""), pa.array(counts, pa.int64()), pa.array(forms, pa.string()),
               pa.array(prefix_chars, pa.int64()), pa.array(middle_chars, pa.int64()), pa.array(tables, PIECES)]
    return pa.RecordBatch.from_arrays(columns, names=["doc_id", "text", "n", "form", "prefix_chars", "middle_chars", "pieces"])


def draw(doc_id: Column, seed: int, group: int) -> Column:
    """The ``group``-th group of eight hexadecimal digits of sha256 of seed and id, as a number."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    return F.conv(F.substring(F.sha2(key.cast("binary"), 256), 8 * group - 7, 8), 16, 10).cast("long")


def piece_tables(docs: DataFrame, seed: int = 1, plain_from: int = PLAIN_FROM, spm_below: int = SPM_BELOW) -> DataFrame:
    """doc_id, text, n (units), form, prefix_chars, middle_chars and ``pieces``, the arranged descriptors.

    ``plain_from`` of 100 draws and more leave a document as it is; of the others ``spm_below`` of 100 begin with the suffix."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_chunks(batches):
            yield _cut_batch(b, plain_from, spm_below)

    doc_id = F.col("doc_id").cast("long")
    return docs.select(doc_id.alias("doc_id"), "text", *(draw(doc_id, seed, i).alias(f"h{i}") for i in range(1, 5))).mapInArrow(run, TABLE)


def _fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    keep = ["doc_id", "n", "form", "prefix_chars", "middle_chars"]
    for b in text_chunks(batches):
        data, at = _buffers(b.column("text"))
        outputs, digests = [], []
        for row, table in enumerate(b.column("pieces").to_pylist()):
            text = data[int(at[row]):int(at[row + 1])]
            pieces = [(p["buffer"], p["start"], p["length"]) for p in table]
            outputs.append(b"".join(slices(pieces, text)))
            digests.append(stream_sha256(pieces, text))
        yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(outputs, pa.binary()), pa.array(digests, pa.string())],
                                         names=[*keep, "output", "output_sha256"])


def fill(tables: DataFrame) -> DataFrame:
    """Piece tables written out: doc_id, n, form, prefix_chars, middle_chars, output, output_sha256."""
    return tables.mapInArrow(_fill, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output binary, output_sha256 string"
                             ).withColumn("output", F.col("output").cast("string"))


def _restore(carry: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_chunks(batches, "output"):
            data, at = _buffers(b.column("output"))
            texts, digests = [], []
            for row, form in enumerate(b.column("form").to_pylist()):
                output = data[int(at[row]):int(at[row + 1])]
                pieces = [(TEXT, 0, len(output))] if form not in FORMS else inverse(arranged_pieces(bytes(output), form))
                texts.append(b"".join(slices(pieces, output)))
                digests.append(stream_sha256(pieces, output))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in carry), pa.array(texts, pa.binary()), pa.array(digests, pa.string())],
                                             names=[*carry, "restored", "restored_sha256"])
    return run


def restore(outputs: DataFrame) -> DataFrame:
    """``outputs`` without ``output``, with ``restored`` and ``restored_sha256``: the texts, rebuilt from output and form alone."""
    carry = [c for c in outputs.columns if c not in ("output", "restored", "restored_sha256")]
    schema = ", ".join(f"`{c}` {outputs.schema[c].dataType.simpleString()}" for c in carry)
    used = outputs.select(*carry, "output")
    return used.mapInArrow(_restore(carry), f"{schema}, restored binary, restored_sha256 string").withColumn("restored", F.col("restored").cast("string"))


def fill_middle_digest(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256."""
    return restore(fill(piece_tables(docs))).drop("restored")


FILL_SQL = r"""
WITH u AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS t,
         sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h
  FROM documents),
d AS (SELECT *, len(t) AS n, ('0x' || substr(h, 1, 8))::BIGINT AS h1, ('0x' || substr(h, 9, 8))::BIGINT AS h2,
             ('0x' || substr(h, 17, 8))::BIGINT AS h3, ('0x' || substr(h, 25, 8))::BIGINT AS h4 FROM u),
f AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
             CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain'
                  WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM d),
p AS (SELECT *, array_to_string(t[1:a], '') AS prefix, array_to_string(t[a + 1:b], '') AS middle, array_to_string(t[b + 1:], '') AS suffix FROM f),
o AS (SELECT *, CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                     ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END AS output FROM p),
r AS (SELECT *, CASE form
    WHEN 'plain' THEN output
    WHEN 'psm' THEN substr(output, 4, strpos(output, '<S>') - 4) || substr(output, strpos(output, '<M>') + 3)
                    || substr(output, strpos(output, '<S>') + 3, strpos(output, '<M>') - strpos(output, '<S>') - 3)
    ELSE substr(output, strpos(output, '<P>') + 3, strpos(output, '<M>') - strpos(output, '<P>') - 3)
         || substr(output, strpos(output, '<M>') + 3) || substr(output, 4, strpos(output, '<P>') - 4) END AS restored FROM o)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(prefix) END::BIGINT AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(middle) END::BIGINT AS middle_chars,
       sha256(output) AS output_sha256, sha256(restored) AS restored_sha256
FROM r
"""
