"""Predicates and keys for matching application rows to catalog vehicles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vocab as v
from .text import strip


def fold(c: Column) -> Column:
    """Comparison form of a model or make; null counts as empty."""
    return strip(F.lower(F.coalesce(c, F.lit(""))))


def extends(longer: Column, shorter: Column) -> Column:
    """Folded name ``longer`` is ``shorter``, or goes on with a space, ``-`` or ``/`` after it."""
    after = F.substr(longer, F.length(shorter) + 1, F.lit(1))
    return longer.startswith(shorter) & after.isin("", " ", "-", "/")


def model_matches(a: Column, b: Column) -> Column:
    """One name extends the other; empty names match nothing."""
    a, b = fold(a), fold(b)
    return (a != "") & (b != "") & (extends(b, a) | extends(a, b))


def first_word(folded: Column) -> Column:
    """Text before the first space, ``-`` or ``/``; null for an empty name. Names that match
    share it: the shorter one ends at a boundary of the longer one, so both have the same
    first boundary."""
    return F.when(folded != "", F.substring_index(F.translate(folded, "-/", "  "), " ", 1))


def engine_tier(row_l: Column, row_ind: Column, row_cyl: Column,
                cat_l: Column, cat_ind: Column, cat_cyl: Column) -> Column:
    """generic without a stated displacement; otherwise medium within the tolerance,
    high with the same induction too, exact with the same cylinder count on top;
    null means the engines disagree."""
    same_ind = F.coalesce((row_ind != "") & (row_ind == cat_ind), F.lit(False))
    same_cyl = F.coalesce((row_cyl != 0) & (row_cyl == cat_cyl), F.lit(False))
    return (F.when(row_l.isNull(), "generic")
            .when(cat_l.isNull() | (F.abs(cat_l - row_l) > F.lit(v.DISPLACEMENT_TOLERANCE)), None)
            .when(same_ind & same_cyl, "exact")
            .when(same_ind, "high")
            .otherwise("medium"))
