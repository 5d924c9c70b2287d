"""Language ID of mixed texts: script ranges, n-gram scores per word, Viterbi over the words.

The script of a word's letters narrows the languages that it can be in. Each word has a log
likelihood per language from character n-grams, and the best sequence of languages under a
penalty for each switch labels the text word by word, so spans of another language stand out
and single odd words do not. The document's language is the one with most letters.

The n-gram tables come from at most ``per_lang`` texts of each language, chosen by a hash of
their ids; a table has a fixed number of buckets per language and is what the tasks get. The
Viterbi steps run over many texts side by side, one numpy step per word position.

Defined results
* A null text, or one without any letter, is ``und`` with score 0 and no spans. If nothing could be learned, so is every text.
* A letter whose script no learned language uses speaks for none of them.
* Of languages with equally many letters the alphabetically first wins. ``score`` is its share of all letters.
* Null languages teach nothing. A null doc_id is never held out and never learned from; repeated ids are learned once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import chunks, crc_fold
from .ngrams import code_points, word_grams

FOLDS, HELD_OUT = 5, 0
PER_LANG = 400
BITS, SHORTEST, LONGEST = 15, 1, 4
SWITCH = 12.0
# A language uses a script if so large a share of its letters is written in it.
SCRIPT_SHARE = 0.02
CACHE = 300_000
SPLIT = re.compile(r"[^\x20\x09-\x0D]+")
UNKNOWN = "und"

# Blocks of letters, (script, first, last); what is in none of them is one more script.
SCRIPTS = [
    ("latin", 0x41, 0x24F), ("latin", 0x1E00, 0x1EFF), ("greek", 0x370, 0x3FF), ("greek", 0x1F00, 0x1FFF),
    ("cyrillic", 0x400, 0x52F), ("armenian", 0x530, 0x58F), ("hebrew", 0x590, 0x5FF), ("arabic", 0x600, 0x77F),
    ("devanagari", 0x900, 0x97F), ("bengali", 0x980, 0x9FF), ("tamil", 0xB80, 0xBFF), ("thai", 0xE00, 0xE7F),
    ("georgian", 0x10A0, 0x10FF), ("hangul", 0xAC00, 0xD7AF), ("kana", 0x3040, 0x30FF), ("han", 0x3400, 0x9FFF),
]
SCRIPT_NAMES = [*dict.fromkeys(s for s, _, _ in SCRIPTS), "other"]


@lru_cache(maxsize=1)
def script_table() -> np.ndarray:
    """Per code point the number of its script, -1 where it is no letter."""
    table = np.full(0x110000, SCRIPT_NAMES.index("other"), np.int8)
    for name, first, last in SCRIPTS:
        table[first:last + 1] = SCRIPT_NAMES.index(name)
    table[[i for i in range(0x110000) if not chr(i).isalpha()]] = -1
    return table


def letters(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Number of letters of each word, and how many of them are in each script."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    script = script_table()[code_points("".join(words))]
    owner = np.repeat(np.arange(len(words)), lengths)[script >= 0]
    flat = owner * len(SCRIPT_NAMES) + script[script >= 0]
    by_script = np.bincount(flat, minlength=len(words) * len(SCRIPT_NAMES)).reshape(len(words), -1)
    return by_script.sum(1), by_script


class Model:
    """Log probabilities of n-gram buckets and scripts of each language."""

    def __init__(self, texts: list[str], langs: list[str]):
        self.langs = sorted(set(langs))
        grams = np.zeros((len(self.langs), 2**BITS))
        used = np.zeros((len(self.langs), len(SCRIPT_NAMES)))
        for k, lang in enumerate(self.langs):
            for text in (t for t, x in zip(texts, langs, strict=True) if x == lang):
                words = [w.lower() for w in SPLIT.findall(text)]
                if words:
                    grams[k] += np.bincount(word_grams(words, SHORTEST, LONGEST, BITS)[1], minlength=2**BITS)
                    used[k] += letters(words)[1].sum(0)
        smooth = grams + 0.5
        self.table = np.log(smooth / smooth.sum(1, keepdims=True)).astype(np.float32)
        self.scripts = used >= SCRIPT_SHARE * np.maximum(used.sum(1, keepdims=True), 1)

    def score(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Log likelihoods (word, language) and numbers of letters. Words without a letter score alike everywhere."""
        n, by_script = letters(words)
        owner, bucket = word_grams([w.lower() for w in words], SHORTEST, LONGEST, BITS)
        out = np.stack([np.bincount(owner, weights=row[bucket], minlength=len(words)) for row in self.table], 1)
        # languages that use the script of some of the word's letters; where none does, all stay
        fits = (by_script @ self.scripts.T.astype(np.int64)) > 0
        fits |= ~fits.any(1, keepdims=True)
        out = np.where(fits, out, out.min(1, keepdims=True) - 50)
        known = (by_script @ self.scripts.any(0)) > 0
        out[(n == 0) | ~known] = 0
        return (out - out.max(1, keepdims=True)).astype(np.float32), n


def viterbi(scores: np.ndarray, lengths: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """Best language of each word. ``scores`` holds the texts' words one after the other; the
    texts are stepped through side by side, the longest first."""
    starts = np.append(0, np.cumsum(lengths)[:-1])
    order = np.argsort(-lengths, kind="stable")
    starts, ends = starts[order], lengths[order]
    active = np.searchsorted(-ends, -np.arange(ends.max(initial=0)), side="left")  # texts longer than t
    n_langs = scores.shape[1]
    came = np.zeros(scores.shape, np.int16)
    value = np.zeros((len(ends), n_langs), np.float32)
    own = np.arange(n_langs, dtype=np.int16)
    last = np.zeros(len(ends), np.int64)
    for t in range(len(active)):
        a = active[t]
        v, at = value[:a], starts[:a] + t
        if t:
            best = v.argmax(1)
            jump = v[np.arange(a), best] - switch
            stay = v >= jump[:, None]
            came[at] = np.where(stay, own, best[:, None])
            v = np.where(stay, v, jump[:, None])
        value[:a] = v + scores[at]
        over = active[t + 1] if t + 1 < len(active) else 0
        last[over:a] = value[over:a].argmax(1)
    out = np.zeros(len(scores), np.int16)
    for t in range(len(active) - 1, -1, -1):
        a = active[t]
        at = starts[:a] + t
        out[at] = last[:a]
        last[:a] = came[at, last[:a]]
    return out


def _label(model: Model | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number: dict[str, int] = {}
        scores = n_letters = None
        for b in chunks(batches, 1000):
            texts = [SPLIT.findall(t or "") for t in b.column("text").to_pylist()]
            if len(number) > CACHE:
                number, scores = {}, None
            new = list({w for w in chain.from_iterable(texts) if w not in number}) if model else []
            if new:
                number.update(zip(new, range(len(number), len(number) + len(new)), strict=True))
                s, n = model.score(new)
                scores, n_letters = (s, n) if scores is None else (np.concatenate([scores, s]), np.concatenate([n_letters, n]))
            lengths = np.fromiter(map(len, texts), np.int64, len(texts))
            if model and lengths.sum():
                ids = np.fromiter(map(number.__getitem__, chain.from_iterable(texts)), np.int64, lengths.sum())
                best, weight = viterbi(scores[ids], lengths), n_letters[ids]
            else:
                best = weight = np.zeros(lengths.sum(), np.int64)
            rows, end = [], np.cumsum(lengths)
            for stop, length in zip(end, lengths, strict=True):
                own, w = best[stop - length:stop], weight[stop - length:stop]
                if not w.sum():
                    rows.append((UNKNOWN, 0.0, []))
                    continue
                share = np.bincount(own, weights=w, minlength=len(model.langs)) / w.sum()
                cut = np.append(0, np.flatnonzero(np.diff(own)) + 1)
                spans = [{"lang": model.langs[own[i]], "start": int(i), "words": int(n)} for i, n in zip(cut, np.diff(np.append(cut, length)), strict=True)]
                rows.append((model.langs[int(share.argmax())], float(share.max()), spans))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("held_out"), pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.float64()),
                 pa.array([r[2] for r in rows], pa.list_(pa.struct([("lang", pa.string()), ("start", pa.int32()), ("words", pa.int32())])))],
                names=["doc_id", "held_out", "lang_pred", "score", "spans"])
    return run


def training_rows(docs: DataFrame, per_lang: int) -> list:
    """At most ``per_lang`` texts of each language outside the held-out fold: those whose ids have the
    smallest hashes. A hash's level is its number of binary digits, so each level holds about twice
    the ids of the one below. Counts per language and level tell up to which level ids are ranked,
    and the rank meets a few times ``per_lang`` ids of a language however many rows it has."""
    learn = F.col("lang").isNotNull() & F.col("text").isNotNull() & (crc_fold(F.col("doc_id"), FOLDS) != HELD_OUT)
    h = F.xxhash64("doc_id").bitwiseAND(F.lit(2**63 - 1))
    rows = docs.filter(learn).withColumn("level", F.floor(F.log2(h + F.lit(1.0))).cast("int"))
    # at most 64 levels a language; distinct ids, as one id may stand in very many rows. They are hashed anew:
    # the sketch hashes as ``h`` does, and ids of one level have hashes with equal leading bits, which it needs to differ.
    other = F.xxhash64("doc_id", F.lit("level"))
    counts = rows.groupBy("lang", "level").agg(F.approx_count_distinct(other).alias("n"))
    below = F.coalesce(F.sum("n").over(W.partitionBy("lang").orderBy("level").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    # twice the texts, which makes up for the approximate counts
    levels = counts.withColumn("below", below).filter(F.col("below") < 2 * per_lang).select("lang", "level")
    few = rows.join(F.broadcast(levels), ["lang", "level"], "left_semi")
    rank = W.partitionBy("lang").orderBy("h", "doc_id")
    chosen = (few.select(F.col("doc_id").cast("long"), "lang", h.alias("h")).distinct()
              .withColumn("r", F.row_number().over(rank)).filter(F.col("r") <= per_lang).select(F.col("doc_id").alias("l_id")).distinct())
    # both broadcasts are bounded by the number of languages, as the model is: 64 levels, per_lang ids
    return (docs.filter(learn).select(F.col("doc_id").cast("long"), "text", "lang").join(F.broadcast(chosen), F.col("doc_id") == F.col("l_id"))
            .groupBy("doc_id").agg(F.max(F.struct("text", "lang")).alias("x")).select("doc_id", "x.text", "x.lang").collect())


def language_spans(docs: DataFrame, per_lang: int = PER_LANG) -> DataFrame:
    """Per document: doc_id, held_out, lang_pred, score and spans (lang, start, words)."""
    rows = sorted(training_rows(docs, per_lang), key=lambda r: r.doc_id)
    model = Model([r.text for r in rows], [r.lang for r in rows]) if rows else None
    held_out = F.coalesce(crc_fold(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False)).alias("held_out")
    return docs.select(F.col("doc_id").cast("long"), held_out, "text").mapInArrow(
        _label(model), "doc_id long, held_out boolean, lang_pred string, score double, spans array<struct<lang:string,start:int,words:int>>")


def language_digest(docs: DataFrame) -> DataFrame:
    return language_spans(docs).drop("spans")
