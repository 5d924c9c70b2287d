"""License scan by a positional index of rare words; DataFrame functions only.

Templates are short license notices. Each has one mandatory key phrase that must stand word
for word; the rest of the notice may differ. From the key phrases the words with the highest
IDF over all documents become the index: word -> (template, place in the template). A file's
hits on the rarest word of a phrase give candidate starts, the second rarest word must stand
at its own place relative to that start, and only then are the key phrase and the share of
matching template words checked. A phrase that stands in a file holds its own rarest words,
so nothing is lost whatever the IDFs are. Everything happens in the row of the file: no shuffle
but the one partial count that gives the IDFs of the few words of the key phrases.

Defined results
* A null or empty text has no words, no labels ("") and score 0; first_word and last_word are null.
* Repeated rows are scanned each. Other columns are ignored.
* ``score`` is the largest share of template words in place over all places found, 1 for a base phrase.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
# Share of a notice's words that must stand in place, besides its key phrase.
LEAST_SHARE = 0.6

# Words of public license notices, (label, notice, key phrase).
BASE = [
    ("mit", "under the mit license"),
    ("apache-2", "apache license version 2"),
    ("cc-by-nc", "cc by nc"),
]
NOTICES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
            "documentation files the software to deal in the software without restriction",
     "permission is hereby granted free of charge to any person obtaining a copy"),
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license",
     "you may not use this file except in compliance with the license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the "
            "following conditions are met", "redistribution and use in source and binary forms"),
    ("gpl", "under the terms of the gnu general public license as published by the free software foundation",
     "gnu general public license"),
    ("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation",
     "gnu lesser general public license"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
     "for any purpose with or without fee is hereby granted"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "free and unencumbered software"),
    ("cc-by-sa", "licensed under a creative commons attribution sharealike", "creative commons attribution sharealike"),
    ("all-rights-reserved", "all rights reserved", "all rights reserved"),
]


@dataclass(frozen=True)
class Template:
    label: str
    words: tuple[str, ...]
    key: tuple[str, ...]
    base: bool

    @property
    def key_at(self) -> int:
        return next(i for i in range(len(self.words)) if self.words[i:i + len(self.key)] == self.key)


TEMPLATES = [Template(label, tuple(p.split()), tuple(p.split()), True) for label, p in BASE] + [
    Template(label, tuple(n.split()), tuple(k.split()), False) for label, n, k in NOTICES]


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def idf(docs: DataFrame, vocabulary: list[str]) -> dict[str, float]:
    """IDF of the words over all documents; one row per word of ``vocabulary`` comes back."""
    found = F.array_intersect(words_of(F.col("text")), F.array(*map(F.lit, vocabulary)))
    # the empty string counts the documents
    rows = docs.select(F.explode(F.array_append(found, F.lit(""))).alias("w")).groupBy("w").agg(F.count("*").alias("n")).collect()
    n = {r.w: r.n for r in rows}
    return {w: math.log((1 + n.get("", 0)) / (1 + n.get(w, 0))) for w in vocabulary}


def _starts(words: Column, hits: Column, t: Template, weight: dict[str, float]) -> Column:
    """Starts of the template's places in a file."""
    at = t.key_at
    rare = sorted(set(t.key), key=lambda w: (-weight[w], w))[:2]
    first, *others = [(w, at + t.key.index(w)) for w in rare]
    place = F.transform(F.filter(hits, lambda h: h["w"] == first[0]), lambda h: h["pos"] - first[1])

    def agrees(start: Column) -> Column:
        ok = start + at >= 0
        for w, q in others:
            ok = ok & F.coalesce(F.get(words, start + q) == w, F.lit(False))
        ok = ok & (F.slice(words, start + at + 1, len(t.key)) == F.array(*map(F.lit, t.key)))
        return ok if t.base else ok & (_share(words, t, start) >= LEAST_SHARE)

    return F.filter(place, agrees)


def _share(words: Column, t: Template, start: Column) -> Column:
    """Share of the template's words that stand in place from ``start``; a notice may begin before the text."""
    same = [F.when((start + i >= 0) & (F.get(words, F.greatest(start + i, F.lit(0))) == w), 1).otherwise(0) for i, w in enumerate(t.words)]
    return sum(same[1:], same[0]) / len(t.words)


def _place(words: Column, t: Template):
    def place(start: Column) -> Column:
        share = F.lit(1.0) if t.base else _share(words, t, start).cast("double")
        return F.struct(F.lit(t.label).alias("label"), F.lit(t.base).alias("base"), start.cast("long").alias("start"), share.alias("share"))
    return place


def license_scan(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score and
    places, an array of (label, base, start, share)."""
    vocabulary = sorted({w for t in TEMPLATES for w in t.key})
    weight = idf(docs, vocabulary)
    anchors = sorted({min(t.key, key=lambda w: (-weight[w], w)) for t in TEMPLATES})
    anchor = F.array(*map(F.lit, anchors))
    none = F.array().cast("array<struct<pos:int,w:string>>")
    words = docs.select("doc_id", words_of(F.col("text")).alias("words"))
    hits = F.when(F.arrays_overlap("words", anchor), F.filter(
        F.transform("words", lambda w, i: F.struct(i.alias("pos"), w.alias("w"))), lambda h: h["w"].isin(anchors))).otherwise(none)
    indexed = words.select("doc_id", F.size("words").cast("long").alias("n_words"), hits.alias("hits"),
                           F.when(F.arrays_overlap("words", anchor), F.col("words")).otherwise(F.array().cast("array<string>")).alias("words"))
    places = [F.transform(_starts(F.col("words"), F.col("hits"), t, weight), _place(F.col("words"), t)) for t in TEMPLATES]
    found = indexed.select("doc_id", "n_words", F.when(F.size("hits") > 0, F.concat(*places)).otherwise(
        F.array().cast("array<struct<label:string,base:boolean,start:bigint,share:double>>")).alias("places"))
    base = F.filter("places", lambda p: p["base"])
    starts = F.transform(base, lambda p: p["start"])

    def labels(of) -> Column:
        return F.array_join(F.array_sort(F.array_distinct(F.transform(of, lambda p: p["label"]))), ",")

    return found.select("doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"),
                        F.array_max(starts).alias("last_word"), labels(base).alias("base_labels"), labels(F.col("places")).alias("labels"),
                        F.coalesce(F.array_max(F.transform("places", lambda p: p["share"])), F.lit(0.0)).alias("score"), "places")


def license_digest(docs: DataFrame) -> DataFrame:
    return license_scan(docs).drop("places")


def _sql_list(words: tuple[str, ...]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


LICENSE_SQL = rf"""
WITH t(label, base, words, key, key_at) AS (VALUES
  {",\n  ".join(f"('{t.label}', {t.base}, {_sql_list(t.words)}, {_sql_list(t.key)}, {t.key_at})" for t in TEMPLATES)}),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
p AS (SELECT doc_id, w, i, w[i] AS head FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d)),
c AS (
  SELECT doc_id, label, base, i - 1 - key_at AS start,
         len(list_filter(range(len(words)), lambda k: i - key_at + k >= 1 AND coalesce(w[greatest(i - key_at + k, 1)] = words[k + 1], false))) / len(words) AS share
  FROM p JOIN t ON p.head = t.key[1] AND p.w[i:i + len(key) - 1] = t.key),
m AS (SELECT * FROM c WHERE base OR share >= {LEAST_SHARE})
SELECT d.doc_id, any_value(len(w))::BIGINT AS n_words, count(label) FILTER (base)::BIGINT AS n_base,
       min(start) FILTER (base)::BIGINT AS first_word, max(start) FILTER (base)::BIGINT AS last_word,
       coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base), '') AS base_labels,
       coalesce(string_agg(DISTINCT label, ',' ORDER BY label), '') AS labels,
       coalesce(max(CASE WHEN base THEN 1.0 ELSE share END), 0.0)::DOUBLE AS score
FROM d LEFT JOIN m USING (doc_id) GROUP BY d.doc_id
"""
