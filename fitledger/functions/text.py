"""Text parsing as Column expressions. No Python runs per row.

Case folding uses ``lower``; it differs from full Unicode folding for a handful
of letters such as the German sharp s.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vocab as v
from .bind import let

# White space in the Unicode sense, no-break spaces included: they are common in text taken from PDF files.
_BLANKS = (" \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B)))
           + "\u2028\u2029\u202f\u205f\u3000")
# Java patterns with Unicode classes, and with the line feed as the only line end.
_UNICODE = "(?Ud)"


def strip(c: Column) -> Column:
    """Trim white space on both sides."""
    return F.btrim(c, F.lit(_BLANKS))


def lookup(c: Column, table: dict) -> Column:
    """Value of ``c`` in a small fixed table, null when absent."""
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), c)


def contains_any(c: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [c.contains(w) for w in words])


def starts_with_any(c: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [c.startswith(w) for w in words])


def first_rule(c: Column, rules: list[tuple[str, list[str]]], otherwise: Column) -> Column:
    """First rule any of whose words occurs in ``c``."""
    return F.coalesce(*[F.when(contains_any(c, words), F.lit(value)) for value, words in rules], otherwise)


def _group(c: Column, pattern: str, group: int = 1) -> Column:
    """Regex group, null instead of the empty string when there is no match."""
    return F.nullif(F.regexp_extract(c, pattern, group), F.lit(""))


def normalize_model(c: Column) -> Column:
    """Canonical model name: specs and body or drivetrain words off, then word renames. The suffix rule
    is applied until nothing changes: once for a name on one line, at most twice for each line otherwise."""
    m = strip(c)
    for pattern in (v.MODEL_TRAILING_PARENS, v.MODEL_WEIGHT_SPEC, v.MODEL_DISPLACEMENT_SPEC, v.MODEL_TRAILING_DIGITS):
        m = F.regexp_replace(m, _UNICODE + pattern, "")

    def cut(name: Column) -> Column:
        return strip(F.regexp_replace(name, _UNICODE + v.MODEL_SUFFIX, ""))

    m = F.when(m.contains("\n"), F.aggregate(F.split(m, "\n"), m, lambda name, _: cut(cut(name)))).otherwise(cut(m))
    words = F.split(m, _UNICODE + r"\s+")
    renamed = F.transform(words, lambda w: F.coalesce(lookup(w, v.MODEL_WORDS), w))
    return strip(F.array_join(renamed, " "))


def expand_models(c: Column) -> Column:
    """Array of model names named by a slash list; ``F-150/250`` shares its prefix."""
    parts = F.transform(F.split(c, "/"), strip)
    first = parts[0]
    rest = F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0)))
    prefix = F.regexp_extract(first, r"^(.*?)(\d+)$", 1)
    shared = first.rlike(r"^.*?\d+$") & F.forall(rest, lambda p: p.rlike(r"^\d+$"))
    names = F.when(
        shared, F.concat(F.array(first), F.transform(rest, lambda p: F.concat(prefix, p)))
    ).otherwise(parts)
    return F.when(c.contains("/"), F.transform(names, normalize_model)).otherwise(
        F.array(normalize_model(c)))


def expand_makes(c: Column) -> Column:
    """Array of makes named by a slash list, blanks dropped; no slash passes through."""
    parts = F.filter(F.transform(F.split(c, "/"), strip), lambda p: p != "")
    return F.when(c.contains("/"), parts).otherwise(F.array(strip(c)))


def cid_to_litres(cid: Column) -> Column:
    return F.coalesce(lookup(cid.cast("int"), v.CID_LITRES),
                      F.round(cid.cast("double") * F.lit(v.LITRES_PER_CID), 2))


def parse_displacement(c: Column) -> Column:
    """Litres named in free text; null for open statements such as ``up to``."""
    t = F.lower(c)
    litres = _group(t, v.DISPLACEMENT_LITRES).try_cast("double")
    parens = _group(t, v.DISPLACEMENT_CID_PARENS).try_cast("int")
    plain = _group(t, v.DISPLACEMENT_CID).try_cast("int")
    return (F.when(t.rlike(v.DISPLACEMENT_OPEN), F.lit(None).cast("double"))
            .when(litres.isNotNull(), litres)
            .when(parens.isNotNull(), cid_to_litres(parens))
            .when(plain.isNotNull(), cid_to_litres(plain)))


def parse_induction(c: Column) -> Column:
    rules = [(value, [phrase]) for phrase, value in v.INDUCTION_PHRASES]
    return first_rule(F.lower(c), rules, F.lit(None).cast("string"))


def parse_cylinders(c: Column) -> Column:
    counted = _group(c, v.CYLINDERS_COUNT).try_cast("int")
    layout = _group(c, v.CYLINDERS_LAYOUT).try_cast("int")
    return F.when(F.coalesce(counted, F.lit(0)) != 0, counted).otherwise(F.coalesce(layout, counted))


def parse_engine(c: Column) -> Column:
    return F.struct(parse_displacement(c).alias("displacement_l"),
                    parse_induction(c).alias("induction"),
                    parse_cylinders(c).alias("cylinders"))


def categorize(c: Column) -> Column:
    """Category of a device name by ordered keyword rules."""
    return first_rule(F.lower(c), v.CATEGORY_RULES, F.lit("other"))


def normalize_make(c: Column) -> Column:
    """Lower case with every run of hyphens and spaces as one space."""
    return F.regexp_replace(F.lower(strip(c)), _UNICODE + r"[-\s]+", " ")


def _plain_make(name: str) -> str:
    return " ".join(name.replace("-", " ").split())


def make_alias(c: Column) -> Column:
    """Normalised target of a make's alias, null when it has none."""
    table = {k: _plain_make(t) for k, t in v.MAKE_ALIASES.items()}
    m = normalize_make(c)
    return F.coalesce(lookup(m, table), lookup(F.replace(m, F.lit(" "), F.lit("")), table))


def is_powersports(normalized: Column) -> Column:
    return normalized.isin([_plain_make(m) for m in v.POWERSPORTS_MAKES])


def part_number_ok(c: Column) -> Column:
    """Nearly all part numbers are plain ASCII without blanks, which one look at the text tells; only others are stripped, once each."""
    low, high = v.PART_NUMBER_LENGTH

    def ok(s: Column) -> Column:
        junk = reduce(lambda a, b: a | b, [s.contains(ch) for ch in v.PART_NUMBER_JUNK])
        return F.length(s).between(low, high) & ~junk

    # text that starts and ends with visible ASCII is what stripping would leave of it
    inner = "".join(f"\\x{ord(ch):02x}" for ch in v.PART_NUMBER_JUNK)
    plain = c.rlike(rf"\A[!-~&&[^{inner}]]{{{low},{high}}}\z")
    return F.when(plain, True).otherwise(let(strip(c), ok))


def key_format_ok(c: Column) -> Column:
    return F.coalesce(c, F.lit("")).rlike(v.KEY_FORMAT)


def is_token_cap(error: Column) -> Column:
    return contains_any(F.coalesce(error, F.lit("")), v.TOKEN_CAP_MARKERS)


def classify_failure(error: Column) -> Column:
    """``corrupt_source``, ``transient`` or ``permanent``; unknown text is permanent."""
    e = F.coalesce(error, F.lit(""))
    return (F.when(contains_any(F.lower(e), v.CORRUPT_MARKERS), "corrupt_source")
            .when(starts_with_any(e, v.PERMANENT_PREFIXES) | is_token_cap(e), "permanent")
            .when(starts_with_any(e, v.TRANSIENT_PREFIXES) | contains_any(e, v.TRANSIENT_MARKERS),
                  "transient")
            .otherwise("permanent"))


def version_of(doc_id: Column) -> Column:
    return F.coalesce(_group(doc_id, v.VERSION_SUFFIX).try_cast("int"), F.lit(1))


def split_list(c: Column) -> Column:
    """Comma list to trimmed, non-empty entries."""
    return F.filter(F.transform(F.split(c, ","), strip), lambda p: p != "")


def token_cost(tok_in: Column, tok_out: Column, batch: bool = False,
               price_in: float = v.PRICE_IN_PER_MTOK, price_out: float = v.PRICE_OUT_PER_MTOK) -> Column:
    """US dollars for a call; batch calls cost half."""
    k = 2.0 if batch else 1.0
    return tok_in * F.lit(price_in / k) / F.lit(1e6) + tok_out * F.lit(price_out / k) / F.lit(1e6)
