"""N-gram Jaccard join with adaptive multi-match prefixes, and its components.

Two documents link when their shingle sets have a Jaccard similarity of t or more; a ``Rule`` has t and
the words of a shingle, 0.9 and three unless a caller asks for others. Under any
one order of all shingles, linked sets share at least l of their first (1 - t) n + l
shingles. The order here is: common shingles last, then by hash. Each document chooses l by
what its candidates are expected to cost; a pair needs the smaller l of its two documents.

Steps
1. A set becomes a signature, its size and its *head*, the shingles of smallest hash. Documents
   with one signature are one node from here on.
2. Shingles in more than COMMON heads are found by a partial count; a filter of fixed size tells
   them apart. A false positive only moves a shingle to the end of the order, for all documents alike.
3. A document with enough other shingles in its head is *plain*: these are its prefix. Lists of such
   shingles hold COMMON documents at most, so their pairs are few. The others are *dense*, mostly
   parts of large groups of near copies. Plain meets dense under the same order.
4. Dense nodes among themselves are counted once more, on whole sets: shingles rare there come first, and
   their lists are short again. Nodes whose prefix still reaches common shingles share nothing but
   these with some partners. For them no list is paired up: see ``_leaders``.
5. A histogram of each set over a few buckets bounds the difference of two sets from below; pairs that it leaves
   are verified on whole sets. Components are found by large-star and small-star steps.

Defined results
* Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased, by 64-bit hash. Null, empty and blank texts have
  the empty set: n_shingles 0, linked with nothing. Fewer words than a shingle has are one shingle.
* component_id is the smallest non-null doc_id that links reach. Repeated rows and ids are rows of their own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .bloom import bloom, held
from .common import chunks, stored
from .wordhash import NOT_BLANK, mix, sized_chunks, text_chunks, word_hashes

COMMON, WARM = 64, 8
# Expected candidates beyond which a document lengthens its prefix by one, two and three.
COSTS = (300, 900, 2700)
BUCKETS = 128
# Documents whose heads are Python numbers at once.
HEADS = 1000
SIGNED = np.int64
# Odd factors of the words of a shingle by place.
FACTORS = [np.uint64(f) for f in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63)]


@dataclass(frozen=True)
class Rule:
    """What links: shingles of ``shingle`` words, similarity t = ``percent`` / 100 or more. Linked sets differ by
    (1 - t) of their union at most, which is (1 - t) / (1 + t) (n_a + n_b), and their sizes by the factor t."""
    shingle: int = 3
    percent: int = 90

    def __post_init__(self) -> None:
        # far members of ``_leaders`` are those further than 2 (1 - t), so t is more than a half
        if not (1 <= self.shingle <= len(FACTORS) and 50 < self.percent < 100):
            raise ValueError(f"shingles have 1 to {len(FACTORS)} words, similarities are 51 to 99 percent: {self}")

    @property
    def less(self) -> int:
        """100 (1 - t)."""
        return 100 - self.percent

    @property
    def more(self) -> int:
        """100 (1 + t)."""
        return 100 + self.percent

    @property
    def band(self) -> float:
        """Linked sizes differ by a factor of t at most, so they are in one band or in neighbours."""
        return self.percent / 100 - 0.005

    def prefix_size(self, n):
        """First shingles of which linked sets share one: n - ceil(t n) + 1."""
        return n * self.less // 100 + 1

    def head_size(self, n: int) -> int:
        return min(n, n * 3 * self.less // 200 + 8 + len(COSTS))

    def linked(self, both: int, union: int) -> bool:
        return 100 * both >= self.percent * union

    def similar(self, a: np.ndarray, b: np.ndarray) -> bool:
        common = np.intersect1d(a, b, assume_unique=True).size
        return self.linked(common, len(a) + len(b) - common)

    def sizes_fit(self, a: str, b: str) -> str:
        return f"100L * least({a}, {b}) >= {self.percent}L * greatest({a}, {b})"


CONTRACT = Rule()


def shingle_sets(texts: pa.Array, size: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes (uint64) of each text."""
    words, at = word_hashes(texts, NOT_BLANK)
    grams = mix(sum(words[i:len(words) - size + 1 + i] * f for i, f in enumerate(FACTORS[:size]))) if len(words) >= size else words[:0]
    out = []
    for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if j - i >= size:
            out.append(np.unique(grams[i:j - size + 1]))
        else:
            # one number for the whole sequence; its length keeps short ones apart
            whole = words[i:j] * np.array(FACTORS[:j - i], np.uint64)
            out.append(mix(whole.sum(keepdims=True) + np.uint64(j - i)) if j > i else words[:0])
    return out


def signature(tokens: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(tokens.tobytes()) - 2**63


def histogram(tokens: np.ndarray) -> bytes:
    """Shingles in each bucket, 255 at most; capping only makes differences smaller."""
    return np.minimum(np.bincount((tokens & np.uint64(BUCKETS - 1)).astype(SIGNED), minlength=BUCKETS), 255).astype(np.uint8).tobytes()


def matches_needed(warm: int, n: int) -> int:
    """l of a document whose prefix has ``n`` shingles, ``warm`` of them in more than WARM heads."""
    cost = 2 * (n - warm) + (COMMON + WARM) // 2 * warm
    return 1 + sum(cost > c for c in COSTS)


def _arrow(fn, names: str, types: list):
    """A mapInArrow function from ``fn``, which yields the columns of one batch."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in fn(batches):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names.split())
    return run


LONGS = pa.list_(pa.int64())


def _sets(b: pa.RecordBatch, name: str) -> Iterator[np.ndarray]:
    """The sets of a binary column one after the other, as views on the batch."""
    return (np.frombuffer(x.as_buffer(), np.uint64) for x in b.column(name))


def heads(docs: DataFrame, rule: Rule = CONTRACT) -> DataFrame:
    """doc_id, sig (null for the empty set), n, head and hist of every document."""
    def fn(batches):
        for b in text_chunks(batches):
            sets = shingle_sets(b.column("text"), rule.shingle)
            yield [b.column("doc_id"), [signature(s) if len(s) else None for s in sets], list(map(len, sets)),
                   [s[:rule.head_size(len(s))].view(SIGNED) for s in sets], list(map(histogram, sets))]

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        _arrow(fn, "doc_id sig n head hist", [pa.int64(), pa.int64(), pa.int32(), LONGS, pa.binary()]),
        "doc_id long, sig long, n int, head array<long>, hist binary")


def node_sets(docs: DataFrame, nodes: DataFrame, rule: Rule) -> DataFrame:
    """(sig, n, tokens) of ``nodes`` (sig, rep), whole sets read from their representatives' texts.

    A filter of fixed size over sig xor (rep rotated) picks the texts in the scan, so texts are not
    shuffled; what it lets through by mistake is a set too, and does no harm."""
    rep = F.coalesce("rep", F.lit(-1).cast("long"))
    turned = F.shiftleft(rep, 23).bitwiseOR(F.shiftrightunsigned(rep, 41))
    wanted = docs.sparkSession.sparkContext.broadcast(bloom(nodes.select(F.col("sig").bitwiseXOR(turned).alias("h")), "h"))

    def fn(batches):
        for b in text_chunks(batches):
            found = shingle_sets(b.column("text"), rule.shingle)
            sigs = np.array([signature(s) if len(s) else 0 for s in found], SIGNED).view(np.uint64)
            ids = b.column("doc_id").fill_null(-1).to_numpy(zero_copy_only=False).view(np.uint64)
            h = sigs ^ ((ids << np.uint64(23)) | (ids >> np.uint64(41)))
            keep = [i for i in np.flatnonzero(held(wanted.value, h)).tolist() if len(found[i])]
            yield [sigs.view(SIGNED)[keep], [len(found[i]) for i in keep], [found[i].tobytes() for i in keep]]

    found = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        _arrow(fn, "sig n tokens", [pa.int64(), pa.int32(), pa.binary()]), "sig long, n int, tokens binary")
    return stored(found.dropDuplicates(["sig"]), "sets")


def _counted(tokens: DataFrame, least: int) -> DataFrame:
    return tokens.groupBy("token").agg(F.count("*").alias("df")).filter(F.col("df") > least)


ENTRY = "token long, sig long, n int, l int"
ENTRY_TYPES = [pa.int64(), pa.int64(), pa.int32(), pa.int32()]


def _plain(common, warm, rule: Rule):
    """Prefix entries of plain documents; a dense one gives a single row without token."""
    def fn(batches):
        for b in chunks(batches, HEADS):
            tokens, sigs, ns, ls = [], [], [], []
            heads_ = [np.array(h, SIGNED).view(np.uint64) for h in b.column("head").to_pylist()]
            flat = np.concatenate([np.empty(0, np.uint64), *heads_])
            is_common, is_warm, at = held(common.value, flat), held(warm.value, flat), 0
            for h, sig, n in zip(heads_, b.column("sig").to_pylist(), b.column("n").to_pylist(), strict=True):
                free = h[~is_common[at:at + len(h)]]
                warmth = is_warm[at:at + len(h)][~is_common[at:at + len(h)]]
                at += len(h)
                p = rule.prefix_size(n)
                if len(free) < p:
                    tokens.append([None])
                    l = 0
                else:
                    l = min(matches_needed(int(warmth[:p].sum()), p), len(free) - p + 1)
                    tokens.append(free[:p + l - 1].view(SIGNED).tolist())
                for column, value in ((sigs, sig), (ns, n), (ls, l)):
                    column += [value] * len(tokens[-1])
            yield [[t for own in tokens for t in own], sigs, ns, ls]
    return _arrow(fn, "token sig n l", ENTRY_TYPES)


DENSE = "kind int, token long, sig long, n int, l int, rare int"
DENSE_TYPES = [pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()]


def _dense(common, local, rule: Rule):
    """Entries of dense nodes. kind 1: prefix under the plain order; 2: rare shingles under the dense
    order; 3: common shingles of that prefix, for nodes that reach them."""
    def fn(batches):
        for b in sized_chunks(batches, ("tokens",)):
            out = [[] for _ in range(6)]
            for sig, n, tokens in zip(b.column("sig").to_pylist(), b.column("n").to_pylist(), _sets(b, "tokens"), strict=True):
                p = rule.prefix_size(n)
                is_common, is_local = held(common.value, tokens), held(local.value, tokens)
                rare = tokens[~is_local]
                l = 1 if len(rare) < p + 1 else 2
                kinds = [(1, tokens[~is_common][:p], 1), (2, rare[:p + l - 1], l)]
                if len(rare) < p:
                    kinds.append((3, tokens[is_local][:p - len(rare)], 1))
                for kind, some, need in kinds:
                    for column, value in zip(out, ([kind] * len(some), some.view(SIGNED).tolist(), [sig] * len(some), [n] * len(some),
                                                   [need] * len(some), [len(rare)] * len(some)), strict=True):
                        column += value
            yield out
    return _arrow(fn, "kind token sig n l rare", DENSE_TYPES)


def _pairs(left: DataFrame, right: DataFrame, ordered: bool, rule: Rule) -> DataFrame:
    """Candidates (a, b), a < b, that share as many prefix shingles as the less demanding of the two asks for."""
    a = left.select("token", F.col("sig").alias("a"), F.col("n").alias("n_a"), F.col("l").alias("l_a"))
    b = right.select("token", F.col("sig").alias("b"), F.col("n").alias("n_b"), F.col("l").alias("l_b"))
    fits = F.expr(rule.sizes_fit("n_a", "n_b")) & ((F.col("a") < F.col("b")) if ordered else (F.col("a") != F.col("b")))
    pairs = a.join(b, "token").filter(fits).groupBy("a", "b").agg(F.count("*").alias("shared"), F.first(F.least("l_a", "l_b")).alias("need"))
    return pairs.filter("shared >= need").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _check(rule: Rule):
    def fn(batches):
        for b in batches:
            ok = pa.array(list(map(rule.similar, _sets(b, "tokens_a"), _sets(b, "tokens_b"))), pa.bool_())
            yield [b.column("a").filter(ok), b.column("b").filter(ok)]
    return fn


def _possible(rule: Rule):
    def fn(batches):
        for b in batches:
            a, other = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint8).reshape(-1, BUCKETS).astype(np.int16) for c in ("hist_a", "hist_b"))
            sizes = b.column("n_a").to_numpy().astype(SIGNED) + b.column("n_b").to_numpy()
            ok = pa.array(rule.more * np.abs(a - other).sum(1, dtype=SIGNED) <= rule.less * sizes)
            yield [b.column("a").filter(ok), b.column("b").filter(ok)]
    return fn


def possible(pairs: DataFrame, reps: DataFrame, rule: Rule) -> DataFrame:
    """The pairs (a, b) whose histograms allow a link."""
    a = reps.select(F.col("sig").alias("a"), F.col("hist").alias("hist_a"), F.col("n").alias("n_a"))
    b = reps.select(F.col("sig").alias("b"), F.col("hist").alias("hist_b"), F.col("n").alias("n_b"))
    return pairs.join(a, "a").join(b, "b").select("a", "b", "hist_a", "hist_b", "n_a", "n_b").mapInArrow(
        _arrow(_possible(rule), "a b", [pa.int64(), pa.int64()]), "a long, b long")


def verified(pairs: DataFrame, sets: DataFrame, rule: Rule) -> DataFrame:
    """The pairs (a, b) whose whole sets are similar."""
    a = sets.select(F.col("sig").alias("a"), F.col("tokens").alias("tokens_a"))
    b = sets.select(F.col("sig").alias("b"), F.col("tokens").alias("tokens_b"))
    return pairs.join(a, "a").join(b, "b").select("a", "b", "tokens_a", "tokens_b").mapInArrow(
        _arrow(_check(rule), "a b", [pa.int64(), pa.int64()]), "a long, b long")


def _against_leader(local, rule: Rule):
    """Each member beside one leader: linked or not, far or not, its weight, and the prefixes of the
    difference of their common shingles (see ``_leaders``)."""
    def fn(batches):
        for b in sized_chunks(batches, ("tokens_c", "tokens")):
            out = [[] for _ in range(7)]
            for c, sig, leader, own in zip(b.column("c").to_pylist(), b.column("sig").to_pylist(), _sets(b, "tokens_c"), _sets(b, "tokens"), strict=True):
                both = np.intersect1d(leader, own, assume_unique=True).size
                union = len(leader) + len(own) - both
                linked = rule.linked(both, union)
                centre, mine = leader[held(local.value, leader)], own[held(local.value, own)]
                differ, r = np.setxor1d(centre, mine, assume_unique=True), len(own) - len(mine)
                spare = rule.more * (len(differ) + r - (len(leader) - len(centre))) + rule.less * (len(leader) - len(own))
                as_partner = max(0, len(differ) - max(0, spare // (2 * rule.more)))
                as_grey = 0 if linked else max(0, min(len(differ), rule.less * len(own) // rule.percent - r + 1))
                row = (c, sig, linked, 100 * both < (100 - 2 * rule.less) * union, rule.more * (len(differ) + r) - rule.less * len(own),
                       differ[:as_partner].view(SIGNED), differ[:as_grey].view(SIGNED))
                for column, value in zip(out, row, strict=True):
                    column.append(value)
            yield out
    return _arrow(fn, "c sig linked far weight partner grey",
                  [pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.int64(), LONGS, LONGS])


AGAINST = "c long, sig long, linked boolean, far boolean, weight long, partner array<long>, grey array<long>"


def _fitting(entries: DataFrame, rule: Rule) -> DataFrame:
    """Entries that can still link inside their block: some partner's size and rare shingles allow it."""
    block = entries.groupBy("block").agg(F.min("rare").alias("r_min"), F.max("n").alias("n_max"), F.max("far").alias("any_far"),
                                         F.min(rule.more * F.col("rare") - rule.less * F.col("n")).alias("lightest"), F.count("*").alias("m"))
    block = block.filter((F.col("m") > 1) & F.col("any_far") & (F.col("lightest") <= 0)).withColumnRenamed("block", "f_block")
    return entries.join(block, F.col("block") == F.col("f_block")).filter(
        rule.more * (F.col("rare") + F.col("r_min")) <= rule.less * (F.col("n") + F.col("n_max"))).select(*entries.columns)


def _leaders(entries: DataFrame, sets: DataFrame, reps: DataFrame, local, rule: Rule) -> list[DataFrame]:
    """Links between nodes that share none but common shingles of their prefixes.

    ``entries`` (token, sig, n, rare) are the common shingles of those prefixes. Whoever links shares one and is of like
    size, so all links lie inside blocks of equal token and neighbouring size bands. With r the number of rare shingles,
    linked nodes, which share no rare one here, differ by r_x + r_y at least, and by T = q (n_x + n_y) at most, q = (1 - t) / (1 + t). So one of the two is
    *light*, r <= q n, and nodes too heavy for every partner in their block leave it. Blocks of at most COMMON nodes are paired up.
    A larger one has leaders, the light nodes with the fewest rare shingles: one in the first round and twice as many in
    every further one. Every member is compared with the leaders only. Jaccard distance d is a metric, so
    * members within 1 - t of a leader are linked through it, and no pair of theirs is left for another round;
    * a member further than 2 (1 - t) (far) cannot link with those. The next round sees who is linked to no leader, as long
      as a block has far members: two nodes that are near one leader are settled in its round;
    * what is left are pairs with a y that is near but not linked (grey). With E the difference to the leader's common
      shingles, D = |E| + r, such a pair differs by D_x + D_y - 2 |E_x and E_y| <= T, T at most n_y (1 - t) / t. As y is not linked,
      D_y + r_c > q (n_y + n_c), so |E_x and E_y| > (D_x - r_c + q (n_c - n_x)) / 2 and at least D_y - T:
      sorted alike, prefixes of E of that length must share a shingle, and candidates come from an equi-join on those.
      Copies that only replace words have |E| = r or less: their prefix is short or empty;
    * two E may have nothing in common only if D_x + D_y <= T. Such nodes are linked, and so is each of them with
      the node of smallest weight D - q n: links to that one node stand for all of these.
    """
    links = []
    band = F.floor(F.log(F.col("n").cast("double")) / F.lit(-float(np.log(rule.band))))
    blocks = F.array(F.xxhash64("token", band), F.xxhash64("token", band + 1))
    entries = entries.select(F.explode(blocks).alias("block"), "sig", F.col("n").cast("long").alias("n"), F.col("rare").cast("long").alias("rare"), F.lit(True).alias("far"))
    entries, leaders = stored(_fitting(entries.distinct(), rule), "block-nodes"), 1
    while True:
        # leaving makes others too heavy for what stays
        entries = _fitting(entries, rule)
        size = entries.groupBy("block").agg(F.count("*").alias("k")).withColumnRenamed("block", "s_block")
        joined = stored(entries.join(size, F.col("block") == F.col("s_block")).drop("s_block").filter("k > 1"), "block-members")
        if joined.isEmpty():
            return links
        few, many = joined.filter(F.col("k") <= COMMON), joined.filter(F.col("k") > COMMON)
        a = few.select("block", F.col("sig").alias("a"), F.col("n").alias("n_a"), F.col("rare").alias("r_a"))
        b = few.select("block", F.col("sig").alias("b"), F.col("n").alias("n_b"), F.col("rare").alias("r_b"))
        mates = a.join(b, "block").filter(
            f"a < b and {rule.sizes_fit('n_a', 'n_b')} and {rule.more} * (r_a + r_b) <= {rule.less} * (n_a + n_b)")
        pairs = mates.select("a", "b")
        rank = F.row_number().over(W.partitionBy("block").orderBy("rare", "sig"))
        first = many.filter(f"{rule.more} * rare <= {rule.less} * n").withColumn("i", rank).filter(F.col("i") <= leaders)
        first = first.select(F.col("block").alias("l_block"), F.col("sig").alias("c"))
        members = many.join(first, F.col("block") == F.col("l_block")).select("block", "c", "sig", "n", "rare")
        leader = sets.select(F.col("sig").alias("c"), F.col("tokens").alias("tokens_c"))
        seen = stored(members.select("c", "sig").distinct().join(sets.select("sig", "tokens"), "sig").join(leader, "c")
                      .select("c", "sig", "tokens_c", "tokens").mapInArrow(_against_leader(local, rule), AGAINST), "against-leader")
        near = seen.filter(~F.col("far"))
        least = near.groupBy("c").agg(F.min(F.struct("weight", "sig")).alias("m"))
        inner = near.join(least, "c").filter(F.col("weight") + F.col("m.weight") <= 0)
        x = near.select("c", F.col("sig").alias("x"), F.explode("partner").alias("e"))
        y = near.filter(~F.col("linked")).select("c", F.col("sig").alias("y"), F.explode("grey").alias("e"))
        pairs = pairs.unionByName(x.join(y, ["c", "e"]).filter("x != y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")))
        links += [seen.filter("linked").select(F.col("c").alias("a"), F.col("sig").alias("b")),
                  inner.select(F.col("m.sig").alias("a"), F.col("sig").alias("b")),
                  stored(verified(possible(pairs.distinct(), reps, rule), sets, rule), "block-links")]
        # a leader is linked to itself
        state = members.join(seen.select("c", "sig", "linked", "far"), ["c", "sig"]).groupBy("block", "sig").agg(
            F.first("n").alias("n"), F.first("rare").alias("rare"), F.max("far").alias("far"), F.max("linked").alias("linked"))
        entries = stored(state.filter(~F.col("linked")).drop("linked"), "block-rest")
        leaders *= 2


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of ``edges`` (a, b); root is the smallest node of its component."""
    edges = stored(edges.filter("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    while True:
        before = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        # every larger neighbour points to the smallest one, then every smaller one does
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), F.least("a", "m").alias("m"))
        large = stored(both.filter("b > a").join(least, F.col("a") == F.col("k")).select(F.col("m").alias("a"), "b").filter("a != b").distinct(), "large-star")
        down = large.groupBy("b").agg(F.min("a").alias("m")).select(F.col("b").alias("k"), "m")
        small = large.join(down, F.col("b") == F.col("k"))
        edges = stored(small.select(F.col("m").alias("a"), F.explode(F.array("a", "b")).alias("b")).filter("a != b").distinct(), "small-star")
        if edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first() == before:
            return edges.select(F.col("b").alias("node"), F.col("a").alias("root")).unionByName(
                edges.select(F.col("a").alias("node"), F.col("a").alias("root"))).distinct()


def links(docs: DataFrame, head: DataFrame, rule: Rule = CONTRACT) -> DataFrame:
    """Edges (a, b) between signatures that connect what is linked; ``head`` is the stored table of ``heads``."""
    sc = docs.sparkSession.sparkContext
    full = head.filter(F.col("sig").isNotNull())
    reps = stored(full.groupBy("sig").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("hist").alias("hist")), "reps")
    counts = stored(_counted(full.select(F.explode("head").alias("token")), WARM), "head-counts")
    common = sc.broadcast(bloom(counts.filter(F.col("df") > COMMON), "token"))
    warm = sc.broadcast(bloom(counts, "token"))
    entries = full.select("sig", "n", "head").mapInArrow(_plain(common, warm, rule), ENTRY)
    # copies repeat entries; a list has COMMON rows at most, so one shuffle by token serves all that follows
    plain = entries.filter(F.col("token").isNotNull()).repartition("token").dropDuplicates(["token", "sig"])
    dense = stored(entries.filter(F.col("token").isNull()).select("sig").distinct().join(reps.select("sig", "rep"), "sig"), "dense")
    dense_sets = node_sets(docs, dense, rule)
    tokens = dense_sets.mapInArrow(_arrow(lambda bs: ([np.concatenate([*_sets(b, "tokens")]).view(SIGNED)] for b in sized_chunks(bs, ("tokens",))),
                                          "token", [pa.int64()]), "token long")
    local = sc.broadcast(bloom(_counted(tokens, COMMON), "token"))
    rows = stored(dense_sets.mapInArrow(_dense(common, local, rule), DENSE), "dense-entries")
    rare = rows.filter("kind = 2")
    pairs = (_pairs(plain, plain, True, rule).unionByName(_pairs(plain, rows.filter("kind = 1"), False, rule)).unionByName(_pairs(rare, rare, True, rule)))
    pairs = stored(possible(stored(pairs.distinct(), "pairs"), reps, rule), "possible")
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("sig")).distinct().join(reps.select("sig", "rep"), "sig")
    edges = [verified(pairs, node_sets(docs, stored(nodes, "nodes"), rule), rule)]
    edges += _leaders(rows.filter("kind = 3").select("token", "sig", "n", "rare"), dense_sets, reps, local, rule)
    out = edges[0]
    for e in edges[1:]:
        out = out.unionByName(e)
    return out


def jaccard_components(docs: DataFrame, shingle: int = CONTRACT.shingle, percent: int = CONTRACT.percent) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id. Sets of ``shingle`` words a shingle link from ``percent`` hundredths of similarity."""
    rule = Rule(shingle, percent)
    head = stored(heads(docs, rule), "heads")
    roots = components(links(docs, head, rule))
    classes = head.filter(F.col("sig").isNotNull()).groupBy("sig").agg(F.min("doc_id").alias("first"), F.count("*").alias("k"))
    known = classes.join(roots, F.col("sig") == F.col("node"), "left").filter((F.col("k") > 1) | F.col("root").isNotNull()).select(
        F.col("sig"), "first", F.coalesce("root", "sig").alias("root"))
    known = stored(known, "known")
    least = known.groupBy("root").agg(F.min("first").alias("component_id"))
    ids = stored(known.select("sig", "root").join(least, "root").select(F.col("sig").alias("i_sig"), "component_id"), "component-ids")
    return head.join(ids, F.col("sig") == F.col("i_sig"), "left").select(
        "doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
