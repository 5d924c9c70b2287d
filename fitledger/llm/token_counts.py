"""Token counts by a map-side lookup in two tiers; no pre-token is ever shuffled.

A text is cut into pre-tokens with the tokenizer's own rule, and every distinct pre-token has
a fixed number of tokens. The first tier is a small broadcast table of frequent pre-tokens
and their lengths; what it lacks is encoded once by the library and kept in the worker's
cache, which is emptied back to the first tier when it is full.

The first tier comes from all rows: every task counts its pre-tokens in a table of bounded size
(Misra and Gries: when it is full, all counts go down and the smallest ones leave), hands on its
commonest ``TASK_WORDS``, and one aggregate adds those up. At most ``FREQUENT`` pre-tokens of at most
``LONGEST`` characters reach the driver. It is a cache: counts are the same with any table, or none.

What a code point counts as (letter, number, white space, other) is asked of the library. Texts with a
code point whose form depends on its neighbours (combining marks, parts of Hangul syllables, the capital
sigma), with control characters, or with one of the tokenizer's special strings go to the library whole,
and so do all texts if the file has another normalizer or pre-token rule than the one known here.

Defined results: a null text counts as empty (0 bytes, 0 tokens); repeated rows are counted
each; an empty table gives no rows; very long texts are counted whole; other columns are ignored.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks

# The normalizer and the pre-token rule of word_bpe_49k.json.
NORMALIZER = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
RULE = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
# Code points that get a class: the planes that texts commonly use, without surrogates and private ones.
RANGES = (range(0x09, 0xD800), range(0xF900, 0x10000), range(0x1F000, 0x1FB00))
# Code points whose form depends on their neighbours though they are no marks: Hangul parts and the capital sigma.
TIED = (range(0x1100, 0x1200), range(0xA960, 0xA980), range(0xD7B0, 0xD800), range(0x03A3, 0x03A4))
FREQUENT = 20_000
TASK_WORDS = 8_192
TASK_TABLE = 65_536
LONGEST = 64
CACHE = 500_000
LIMIT = 2048


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _ranges(points: list[int]) -> str:
    """The points as the inside of a pattern's character class."""
    runs = [[p for _, p in run] for _, run in groupby(enumerate(points), lambda x: x[1] - x[0])]
    return "".join(f"{re.escape(chr(r[0]))}-{re.escape(chr(r[-1]))}" for r in runs)


def _patterns(tokenizer) -> tuple[re.Pattern, re.Pattern]:
    """(pre-tokens, what only the library can tell) in the library's own classes of code points."""
    tied = {p for r in TIED for p in r}
    # a mark may join what stands before it
    points = [p for r in RANGES for p in r if p not in tied and not unicodedata.category(chr(p)).startswith(("M", "Cs", "Co", "Cn"))]
    lower = tokenizer.normalizer.normalize_str
    blank = {p for p in points if p < 0x3001 and lower(f"a{chr(p)}a") == "a a"}
    simple = [p for p in points if p in blank or p >= 0x20 and lower(f"a{chr(p)}a") == f"a{chr(p).lower()}a" and len(chr(p).lower()) == 1]
    cut = tokenizer.pre_tokenizer.pre_tokenize_str

    def joins(mate: str) -> set[int]:
        begins = {start for _, (start, _) in cut("".join(f"{mate}{chr(p)} " for p in simple))}
        return {p for i, p in enumerate(simple) if 3 * i + 1 not in begins} - blank

    letters, others = joins("a"), joins("!")
    digits = set(simple) - letters - others - blank
    letter, digit, white = (_ranges(sorted(c)) for c in (letters, digits, blank))
    return re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{letter}]+|[{digit}]|[^{white}{letter}{digit}]+"), re.compile(f"[^{_ranges(simple)}]")


@lru_cache(maxsize=2)
def _tokenizer(path: str | None):
    """(tokenizer, pattern of its special strings, patterns of pre-tokens and of what only the library can tell, or None)."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    path = path or default_path()
    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    added = tokenizer.get_added_tokens_decoder().values()
    with open(path, encoding="utf-8") as f:
        about = json.load(f)
    normalizer, cuts, model = about.get("normalizer") or {}, (about.get("pre_tokenizer") or {}).get("pretokenizers") or [], about["model"]
    known = (normalizer.get("normalizers") == NORMALIZER and len(cuts) == 2 and model["type"] == "BPE" and model.get("dropout") is None
             and cuts[0] == {"type": "Split", "pattern": {"Regex": RULE}, "behavior": "Removed", "invert": True}
             and cuts[1]["type"] == "ByteLevel" and not cuts[1]["add_prefix_space"] and not cuts[1].get("use_regex", True)
             and not any(t.lstrip or t.rstrip or t.normalized for t in added))
    special = re.compile("|".join(re.escape(t.content) for t in added) or r"(?!)")
    return tokenizer, special, _patterns(tokenizer) if known else None


def _lengths(tokenizer, texts: list[str]) -> list[int]:
    return [len(e.ids) for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


class Counts:
    """Counts tokens of texts in one worker; the cache lives as long as the task."""

    def __init__(self, path: str | None, frequent: dict[str, int], cache: int = CACHE):
        self.tokenizer, self.special, self.patterns = _tokenizer(path)
        self.frequent, self.cache = frequent, cache
        self.known = dict(frequent)

    def pre_tokens(self, text: str) -> list[str] | None:
        """None where only the library can tell."""
        if self.patterns is None or self.patterns[1].search(text) or self.special.search(text):
            return None
        return self.patterns[0].findall(text.lower())

    def count(self, texts: list[str]) -> list[int]:
        cut = list(map(self.pre_tokens, texts))
        if len(self.known) > self.cache:
            self.known = dict(self.frequent)
        misses = [p for p in set(chain.from_iterable(c for c in cut if c)) if p not in self.known]
        for start in range(0, len(misses), 4096):
            some = misses[start:start + 4096]
            self.known.update(zip(some, _lengths(self.tokenizer, some), strict=True))
        whole = iter(_lengths(self.tokenizer, [t for t, c in zip(texts, cut, strict=True) if c is None]))
        get = self.known.__getitem__
        return [next(whole) if c is None else sum(map(get, c)) for c in cut]


def heavy_words(texts: Iterator[list[str]], counts: Counts, table: int = TASK_TABLE, keep: int = TASK_WORDS) -> list[tuple[str, int]]:
    """At most ``keep`` of the commonest pre-tokens, from a table of at most ``table`` and one text's own. A count is too
    small by the (table / 2)-th largest count at each time the table was full, so common ones are never lost."""
    seen = Counter()
    for text in chain.from_iterable(texts):
        seen.update({p: n for p, n in Counter(counts.pre_tokens(text)).items() if len(p) <= LONGEST})
        if len(seen) > table:
            least = sorted(seen.values(), reverse=True)[table // 2]
            seen = Counter({p: n - least for p, n in seen.items() if n > least})
    return seen.most_common(keep)


def frequent_lengths(docs: DataFrame, path: str | None = None, size: int = FREQUENT) -> dict[str, int]:
    """At most ``size`` of the commonest pre-tokens of all texts, with their numbers of tokens."""
    counts = Counts(path, {})
    if counts.patterns is None or not size:
        return {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts = ([t or "" for t in b.column("text").to_pylist()] for b in chunks(batches, 200))
        found = heavy_words(texts, Counts(path, {}))
        yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in found], pa.string()), pa.array([n for _, n in found], pa.int64())], names=["word", "n"])

    found = docs.select("text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    top = [r.word for r in found.orderBy(F.desc("n"), "word").limit(size).collect()]
    return dict(zip(top, _lengths(counts.tokenizer, top), strict=True))


def token_counts(docs: DataFrame, path: str | None = None, limit: int = LIMIT, frequent_words: int = FREQUENT) -> DataFrame:
    """Per document: doc_id, n_bytes, n_tokens, over_limit. ``path`` names the tokenizer's file on every worker."""
    frequent = docs.sparkSession.sparkContext.broadcast(frequent_lengths(docs, path, frequent_words))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = Counts(path, frequent.value)
        for b in chunks(batches, 200):
            n = counts.count([t or "" for t in b.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_bytes"), pa.array(n, pa.int64())],
                                             names=["doc_id", "n_bytes", "n_tokens"])

    n_bytes = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes")
    return (docs.select(F.col("doc_id").cast("long"), n_bytes, "text")
            .mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")
            .withColumn("over_limit", F.col("n_tokens") > limit))
