"""Near-duplicate removal: SimHash links, verified on word shingles, then an exact search by shingles; one document of each group stays.

A text is a node. SimHash joins most copies with little work: each node of a linked set is compared with the set's middle.
The exact search then compares all texts whose groups are still apart and that can be similar enough: two such texts share
one of the first shingles, in an order that all texts have in common, of either.
"""

from __future__ import annotations

import math

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch, hot_join, map_rows
from .components import components
from .simhash import link_fingerprints, majority_bits, signed, words_of

#: Fingerprints that differ in so many bits are compared by their shingles.
RADIUS = 8
AGREE = 2
SHINGLE_WORDS = 5
#: Words of the shingles of a fingerprint: shorter ones leave similar texts nearer to each other.
PRINT_WORDS = 3
SIMILARITY = 0.8
#: One text in so many is looked at for common shingles.
SAMPLE = 32
HOT_SHINGLES = 1 << 16
#: Rows of one key that go to one task: beyond it the key is dealt over several.
SALTED = 1000
#: Tables of ids up to this many rows are broadcast; larger ones are joined by a shuffle.
BROADCAST_ROWS = 200_000
#: Bits of a text's parities, a multiple of 64, and of those of a text with more shingles than PARITIES, which only pairs of texts are held against.
PARITIES, WIDE = 256, 2048
_EPS = 1e-9


class Shingler:
    """Hashes of word shingles: words are hashed once each, runs of words by a polynomial in those hashes, all at once."""

    #: Words that are kept.
    WORDS = 1 << 17

    def __init__(self):
        self.known: dict[bytes, int] = {}

    def words(self, text: str | None) -> np.ndarray:
        known, words = self.known, words_of(text)
        if len(known) > self.WORDS:
            known.clear()
        for w in set(words):
            if w not in known:
                known[w] = xxhash.xxh64_intdigest(w)
        return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))

    @staticmethod
    def runs(words: np.ndarray, size: int) -> np.ndarray:
        """A hash for each run of ``size`` words, repeats included; fewer words give one of the whole sequence, none give none."""
        size = min(size, len(words))
        if not size:
            return words
        n = len(words) - size + 1
        h = np.full(n, size, np.uint64)
        for i in range(size):
            h = (h ^ words[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        return h ^ h >> np.uint64(32)


def _set_of(words: np.ndarray) -> np.ndarray:
    """The distinct shingles of a text, ascending."""
    return np.unique(Shingler.runs(words, SHINGLE_WORDS).view(np.int64))


def _parities(hashes: np.ndarray, buckets: int = PARITIES) -> list[int]:
    """Whether each of so many buckets holds an odd number of the distinct ``hashes``, as longs. Two texts' bits differ in no more places
    than shingles are in one of the texts only."""
    odd = np.bincount((hashes.view(np.uint64) % np.uint64(buckets)).astype(np.int64), minlength=buckets).astype(np.uint8) & 1
    return np.packbits(odd).view(np.int64).tolist()


def _shingled():
    shingler = Shingler()
    return lambda node, text: (node, _set_of(shingler.words(text)).tolist())


class Order:
    """An order that all texts share: shingles by hash, but those of ``hot`` last, in its order."""

    def __init__(self, hot: np.ndarray):
        self.rank = np.argsort(hot, kind="stable")
        self.hot = hot[self.rank]

    def prefix(self, hashes: np.ndarray) -> np.ndarray:
        """The first of distinct sorted ``hashes``. Texts similar enough share one of these at least, as two that share none
        lack too many of each other's."""
        n = len(hashes)
        if not n:
            return hashes
        if len(self.hot):
            at = np.minimum(np.searchsorted(self.hot, hashes), len(self.hot) - 1)
            rank = np.where(self.hot[at] == hashes, self.rank[at], -1)
            hashes = hashes[np.argsort(rank, kind="stable")]
        return hashes[: n - math.ceil(SIMILARITY * n - _EPS) + 1]


def _hot_shingles(texts: DataFrame) -> np.ndarray:
    """Shingles that several texts of a sample hold, the commonest last, HOT_SHINGLES at most. They only order the search."""
    sample = texts.filter(F.pmod("k1", F.lit(SAMPLE)) == 0).select("k1", "text")
    held = map_rows(sample, _shingled, "k1 long, shingles array<long>").dropDuplicates(["k1"])
    counts = held.select(F.explode("shingles").alias("s")).groupBy("s").count().filter("count > 1")
    rows = counts.orderBy(F.desc("count"), "s").limit(HOT_SHINGLES).collect()
    return np.array([r["s"] for r in reversed(rows)], np.int64)


def _prints(texts: DataFrame, hot: np.ndarray) -> DataFrame:
    """node, first_id, fp, c1 and c2 (equal for equal sets of shingles), n (shingles), bits (parities), wide (more of them, for long texts), prefix for rows with node, doc_id, text."""

    def make():
        shingler, order = Shingler(), Order(hot)

        def one(node, doc_id, text):
            words = shingler.words(text)
            hashes = _set_of(words)
            digest = xxhash.xxh3_128_intdigest(hashes.tobytes())
            return node, doc_id, signed(majority_bits(Shingler.runs(words, PRINT_WORDS))), signed(digest >> 64), signed(digest & (1 << 64) - 1), len(hashes), _parities(hashes), _parities(hashes, WIDE) if len(hashes) > PARITIES else None, order.prefix(hashes).tolist()

        return one

    return map_rows(texts.select("node", "doc_id", "text"), make, "node long, first_id long, fp long, c1 long, c2 long, n long, bits array<long>, wide array<long>, prefix array<long>")


def _middles(members: DataFrame, keep: Scratch) -> DataFrame:
    """(a, b): each member of a set (root, fp, node, first_id) and its set's middle, the member nearest to the majority of
    the set's fingerprint bits (ties: the least id)."""
    ones = members.groupBy("root").agg(F.count("*").alias("n"), *(F.sum(F.shiftrightunsigned("fp", i).bitwiseAND(F.lit(1))).alias(f"b{i}") for i in range(64)))
    bits = [F.when(F.col(f"b{i}") * 2 > F.col("n"), F.lit(1 << i if i < 63 else -(1 << 63))).otherwise(F.lit(0)) for i in range(64)]
    major = bits[0].cast("long")
    for b in bits[1:]:
        major = major.bitwiseOR(b.cast("long"))
    ones = keep(ones.select("root", major.alias("major")), "dedup-majorities")
    far = F.bit_count(F.col("fp").bitwiseXOR(F.col("major")))
    middles = keep(hot_join(members, ones, ["root"], "node").groupBy("root").agg(F.min(F.struct(far.alias("far"), "first_id", "node")).alias("m")).select("root", F.col("m.node").alias("b")), "dedup-middles")
    return hot_join(members, middles, ["root"], "node").filter("node <> b").select(F.col("node").alias("a"), "b")


def _posts(shown: DataFrame, parts: DataFrame) -> DataFrame:
    """s, node, part, n, reach for each shingle s of the prefixes: a similar text whose first common shingle is s has ``reach`` shingles
    at most, since it shares none of those before s."""
    posts = shown.select(F.posexplode("prefix").alias("at", "s"), "node", "n").withColumn("reach", (F.col("n") - F.col("at")) * ((1 + SIMILARITY) / SIMILARITY) - F.col("n") + _EPS * 1000)
    return posts.join(parts, "node", "left").select("s", "node", F.coalesce("root", "node").alias("part"), "n", "reach")


def _within(bits: str, other: str, sizes: Column, buckets: int = PARITIES) -> Column:
    """Whether so many bits of two texts' parities agree as those of similar texts with ``sizes`` shingles in all; nulls are let through."""
    differ = sum((F.bit_count(F.col(bits)[i].bitwiseXOR(F.col(other)[i])) for i in range(buckets // 64)), F.lit(0))
    return F.coalesce(differ <= sizes * ((1 - SIMILARITY) / (1 + SIMILARITY)) + _EPS * 1000, F.lit(True))


def _candidates(posts: DataFrame, bits: DataFrame, keep: Scratch) -> DataFrame:
    """(a, b, part, other) distinct pairs of texts of different groups (part, other) that could be similar enough by their sizes,
    by what is left of both from a shared shingle on and by their parities, for rows of s, node, part, n, reach and (node, bits). b is the smaller
    text, so only shingles that reach texts of its own size count there. Groups meet before their texts, so that the texts of one group are
    never paired; a shingle with many groups is dealt over several keys."""
    of_s = Window.partitionBy("s")
    several = posts.withColumns({"low": F.min("part").over(of_s), "high": F.max("part").over(of_s), "met": F.max(F.col("reach") >= F.col("n")).over(of_s)}).filter("low < high and met")
    posts = keep(several.drop("low", "high", "met").join(bits, "node"), "dedup-posts")

    def groups(rows: DataFrame, of: str, name: str) -> DataFrame:
        """The groups with their texts' range of sizes and farthest reach, and the parities of those that are one text."""
        one = F.when(F.count("*") == 1, F.first("bits"))
        return rows.groupBy("s", F.col("part").alias(name)).agg(F.min("n").alias(f"low_{of}"), F.max("n").alias(f"high_{of}"), F.max("reach").alias(f"far_{of}"), one.alias(f"one_{of}"))

    right = groups(posts.filter("reach >= n"), "b", "other")
    many = right.groupBy("s").agg(F.ceil(F.count("*") / SALTED).alias("k"))
    left = groups(posts, "a", "part").join(many, "s").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("k") - 1))).drop("k")
    right = right.join(many, "s").withColumn("salt", F.pmod(F.xxhash64("other"), F.col("k"))).drop("k")
    meet = (F.col("low_b") <= F.least("high_a", "far_a")) & (F.col("low_a") <= F.col("far_b")) & (F.col("high_b") >= F.col("low_a") * SIMILARITY - _EPS)
    apart = F.col("part") != F.col("other")
    ways = left.join(right, ["s", "salt"]).filter(apart & meet & _within("one_a", "one_b", F.col("high_a") + F.col("high_b")))
    ways = ways.select("s", "part", "other", "low_b", "high_b", "far_b", "one_b")
    x = posts.select("s", "part", F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("reach").alias("reach_a"), F.col("bits").alias("bits_a"))
    y = posts.filter("reach >= n").select("s", F.col("part").alias("other"), F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("reach").alias("reach_b"), F.col("bits").alias("bits_b"))
    meet = (F.col("low_b") <= F.least("n_a", "reach_a")) & (F.col("n_a") <= F.col("far_b")) & (F.col("high_b") >= F.col("n_a") * SIMILARITY - _EPS)
    x = x.join(ways, ["s", "part"]).filter(meet & _within("bits_a", "one_b", F.col("n_a") + F.col("high_b"))).drop("low_b", "high_b", "far_b", "one_b")
    smaller = F.struct("n_b", "b") < F.struct(F.col("n_a").alias("n_b"), F.col("a").alias("b"))
    meet = (F.col("n_b") <= F.col("reach_a")) & (F.col("n_a") <= F.col("reach_b")) & (F.col("n_b") >= F.col("n_a") * SIMILARITY - _EPS)
    shared = x.join(y, ["s", "other"]).filter(smaller & meet & _within("bits_a", "bits_b", F.col("n_a") + F.col("n_b")))
    return shared.select("a", "b", "part", "other").distinct()


def _alike() -> Column:
    """Whether columns x_shingles and y_shingles, both distinct, are similar enough; two texts without shingles are."""
    both = F.size(F.array_intersect("x_shingles", "y_shingles"))
    return both >= SIMILARITY * (F.size("x_shingles") + F.size("y_shingles") - both) - _EPS


def _at_ends(pairs: DataFrame, held: DataFrame, keep: Scratch) -> DataFrame:
    """The ``pairs`` with what is ``held`` of both texts, whose columns get x_ and y_. A text in many pairs is dealt over several keys."""
    for end, other, name in (("a", "b", "x"), ("b", "a", "y")):
        many = keep(pairs.groupBy(end).agg(F.ceil(F.count("*") / SALTED).alias("k")).filter("k > 1"), "dedup-degrees")
        salted = held.withColumnsRenamed({c: end if c == "node" else f"{name}_{c}" for c in held.columns}).join(many, end, "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("k", F.lit(1)) - 1)))
        dealt = pairs.join(many, end, "left").withColumn("salt", F.pmod(F.xxhash64(other), F.coalesce("k", F.lit(1)))).drop("k")
        pairs = dealt.join(salted.drop("k"), [end, "salt"]).drop("salt")
    return pairs


def _similar(pairs: DataFrame, prints: DataFrame, nodes: DataFrame, texts: DataFrame, repeated: bool, keep: Scratch) -> DataFrame:
    """(a, b) of the ``pairs`` whose texts are similar enough. Only the shingles of those whose sizes and wide parities let them be are brought together."""
    with Scratch(pairs.sparkSession) as own:
        pairs = own(pairs.select("a", "b"), "dedup-asked")
        fits = (F.least("x_n", "y_n") >= F.greatest("x_n", "y_n") * SIMILARITY - _EPS) & _within("x_bits", "y_bits", F.col("x_n") + F.col("y_n")) & _within("x_wide", "y_wide", F.col("x_n") + F.col("y_n"), WIDE)
        pairs = own(_at_ends(pairs, prints.select("node", "n", "bits", "wide"), own).filter(fits).select("a", "b"), "dedup-possible")
        ends = own(pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct().join(nodes, "node"), "dedup-ends")
        small = ends.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
        held = texts.join(F.broadcast(ends) if small else ends, ["doc_id", "k1", "k2"]).select("node", "text")
        held = map_rows(held, _shingled, "node long, shingles array<long>")
        held = own(held.dropDuplicates(["node"]) if repeated else held, "dedup-shingles")
        return keep(_at_ends(pairs, held, own).filter(_alike()).select("a", "b"), "dedup-similar")


def _all_links(prints: DataFrame, near: DataFrame, nodes: DataFrame, texts: DataFrame, repeated: bool, keep: Scratch) -> DataFrame:
    """(a, b) links that join all groups of similar texts, given those of ``near``: one from every text to the least of its
    class, then one pair of any two groups is compared, then all pairs whose groups are still apart."""
    least = keep(prints.groupBy("c1", "c2").agg(F.min("node").alias("b")), "dedup-classes")
    same = keep(hot_join(prints.select("c1", "c2", "node"), least, ["c1", "c2"], "node").filter("node <> b").select(F.col("node").alias("a"), "b"), "dedup-same")
    links = near.unionByName(same)
    shown = prints.join(same.select(F.col("a").alias("node")), "node", "left_anti")
    parts = components(links)
    with Scratch(prints.sparkSession) as own:
        pairs = keep(_candidates(_posts(shown, parts), shown.select("node", "bits"), own), "dedup-pairs")
    first = keep(pairs.groupBy(F.least("part", "other"), F.greatest("part", "other")).agg(F.min(F.struct("a", "b")).alias("p")).select("p.a", "p.b"), "dedup-first-pairs")
    found = _similar(first, prints, nodes, texts, repeated, keep)
    roots = components(found.join(pairs, ["a", "b"]).select(F.col("part").alias("a"), F.col("other").alias("b")))
    apart = pairs.join(first, ["a", "b"], "left_anti").join(roots.select(F.col("node").alias("part"), F.col("root").alias("r")), "part", "left").join(roots.select(F.col("node").alias("other"), F.col("root").alias("q")), "other", "left")
    apart = keep(apart.filter(F.coalesce("r", "part") != F.coalesce("q", "other")).select("a", "b"), "dedup-apart")
    return links.unionByName(found).unionByName(_similar(apart, prints, nodes, texts, repeated, keep))


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` (doc_id, text and any others), less all near-duplicates but the one of least doc_id.

    Equal texts (by 128 bits of hash) are one group, and so are texts with equal sets of shingles. Texts whose fingerprints
    link (also over others) within RADIUS bits form a set, in which every member is compared with the set's middle; a Jaccard
    similarity of SIMILARITY or more joins their groups. Then an exact search by shingles compares all texts of different
    groups that can be so similar. Rows with a null doc_id are kept. Of repeated rows (equal id and text) one is kept, any of
    them if other columns differ. Null texts count as empty, and all empty texts are equal. An empty table stays empty.
    """
    text = F.coalesce("text", F.lit(""))
    hashed = docs.withColumn("factgraph_k1", F.xxhash64(text)).withColumn("factgraph_k2", F.xxhash64(F.lit(1), text))
    own = {"k1": "factgraph_k1", "k2": "factgraph_k2"}
    texts = hashed.filter("doc_id is not null").select("doc_id", "text", *(F.col(c).alias(k) for k, c in own.items()))
    last = Scratch(docs.sparkSession)
    with Scratch(docs.sparkSession) as keep:
        counted = last(texts.groupBy("doc_id", "k1", "k2").agg(F.count("*").alias("rows")), "dedup-rows")
        equal = counted.groupBy("k1", "k2").agg(F.min("doc_id").alias("doc_id"))
        nodes = keep(equal.select("doc_id", "k1", "k2", F.monotonically_increasing_id().alias("node")), "dedup-nodes")
        first = texts.join(nodes, ["doc_id", "k1", "k2"])
        repeated = not counted.filter("rows > 1").isEmpty()
        prints = _prints(first, _hot_shingles(texts))
        prints = keep(prints.dropDuplicates(["node"]) if repeated else prints, "dedup-prints")
        distinct = keep(prints.select("fp").distinct(), "dedup-fingerprints")
        roots = components(link_fingerprints(distinct, RADIUS, AGREE).distinct())
        narrow = prints.select("fp", "node", "first_id")
        rooted = hot_join(narrow, roots.withColumnRenamed("node", "fp"), ["fp"], "node", "left").withColumn("root", F.coalesce("root", "fp"))
        several = keep(rooted.groupBy("root").agg(F.count("*").alias("n")).filter("n > 1").select("root"), "dedup-sets")
        members = keep(hot_join(rooted, several, ["root"], "node"), "dedup-members")
        near = _similar(_middles(members, keep), prints, nodes, texts, repeated, keep)
        groups = components(_all_links(prints, near, nodes, texts, repeated, keep))
        grouped = nodes.join(groups, "node", "left").withColumn("root", F.coalesce("root", "node"))
        kept = keep(grouped.groupBy("root").agg(F.min("doc_id").alias("kept_id")), "dedup-kept")
        dropped = last(hot_join(grouped, kept, ["root"], "node").filter("doc_id <> kept_id").select("k1", "k2"), "dedup-dropped")
        copies = last(counted.join(nodes, ["doc_id", "k1", "k2"], "left_anti").select("doc_id", "k1", "k2"), "dedup-copies")
    gone = [F.col(k).alias(c) for k, c in own.items()]
    out = _without(hashed.filter("doc_id is not null"), dropped.select(*gone), list(own.values()))
    out = _without(out, copies.select("doc_id", *gone), ["doc_id", *own.values()])
    if repeated:
        several = counted.filter("rows > 1").select("doc_id", *gone)
        more = out.join(several, ["doc_id", *own.values()], "left_semi").dropDuplicates(["doc_id", *own.values()])
        out = _without(out, several, ["doc_id", *own.values()]).unionByName(more)
    return out.unionByName(hashed.filter("doc_id is null")).select(docs.columns)


def _without(rows: DataFrame, gone: DataFrame, key: list[str]) -> DataFrame:
    """The rows whose key isn't in ``gone``, which is broadcast where it has few rows."""
    small = gone.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return rows.join(F.broadcast(gone) if small else gone, key, "left_anti")
