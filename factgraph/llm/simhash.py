"""SimHash near-duplicates: fingerprints linked through a Gray-order hierarchical index.

Fingerprints within ``radius`` bits agree in at least one of radius + 1 blocks (or in ``agree`` of radius + agree), so each is
dealt to the groups named by its blocks: these are the pattern which a group's top node holds in common. In a group the fingerprints are
sorted by Gray rank, so that neighbours share many bits; runs of them form the nodes of a tree, each of which keeps the bits
that all below it share and that its parent doesn't. A search adds up its differences on the way down and leaves a whole
node as soon as they pass the radius. It also leaves nodes whose fingerprints are all linked to it already, so a large group
of copies costs no pairs: what leaves a group is one link per fingerprint at most.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_rows, stage_table
from .components import components

RADIUS = 3
SHINGLE_WORDS = 3
SEED = 42
#: Children of an index node.
FANOUT = 8

_hash = partial(xxhash.xxh64_intdigest, seed=SEED)
_ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def shingles(words: list[bytes], size: int) -> list[bytes]:
    """Space-joined runs of ``size`` words, repeats included; fewer words give the whole sequence, none give none."""
    if len(words) < size:
        return [b" ".join(words)] if words else []
    return list(map(b" ".join, zip(*(words[i:] for i in range(size)))))


def fingerprint(words: list[bytes], size: int = SHINGLE_WORDS) -> int:
    """The 64-bit SimHash of a word sequence, unsigned: a bit is 1 if set in over half the shingles' hashes."""
    parts = shingles(words, size)
    return majority_bits(np.fromiter(map(_hash, parts), np.uint64, len(parts)))


def majority_bits(h: np.ndarray) -> int:
    """The bits that over half of the 64-bit hashes have set; zero for none."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 16):
        ones += np.unpackbits(h[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view(np.uint64)[0])


def words_of(text: str | None) -> list[bytes]:
    """Words between ASCII white space, A-Z lower-cased."""
    return (text or "").encode().lower().split()


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame, size: int = SHINGLE_WORDS) -> DataFrame:
    """doc_id, fp (signed 64-bit) of every row; a null text has no words and the fingerprint 0."""
    return map_rows(docs.select("doc_id", "text"), lambda: lambda doc_id, text: (doc_id, signed(fingerprint(words_of(text), size))), "doc_id long, fp long")


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """The rank of each code in Gray order."""
    out = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        out ^= out >> np.uint64(shift)
    return out


class GrayIndex:
    """The hierarchical index of one partition. ``codes`` are sorted by (group, Gray rank); ``group`` numbers the groups
    from 0. A node's children are up to FANOUT consecutive nodes of the level below, in the same group; the last level has
    one node per group."""

    def __init__(self, codes: np.ndarray, group: np.ndarray):
        self.codes, self.group = codes, group
        common, value, owner = np.full(len(codes), _ALL), codes.copy(), group
        self.levels = []  # (first child, children, bits that all below share, their values, group)
        while True:
            first_of_group = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            sizes = np.diff(np.r_[first_of_group, len(owner)])
            rank = np.arange(len(owner)) - np.repeat(first_of_group, sizes)
            starts = np.flatnonzero(rank % FANOUT == 0)
            children = np.diff(np.r_[starts, len(owner)])
            low, high = np.bitwise_and.reduceat(value & common, starts), np.bitwise_and.reduceat(~value & common, starts)
            common, value, owner = low | high, low, owner[starts]
            self.levels.append((starts, children, common, value, owner))
            if len(starts) == len(first_of_group):
                break

    def link(self, radius: int = RADIUS) -> np.ndarray:
        """For each code the position of the first code of its linked set, sets closed under transitivity."""
        n, codes = len(self.codes), self.codes
        label = np.arange(n)
        for step in range(1, FANOUT + 1):  # neighbours in Gray order first: most copies meet there
            near = np.flatnonzero((self.group[step:] == self.group[:-step]) & (np.bitwise_count(codes[step:] ^ codes[:-step]) <= radius))
            label = _joined(label, near, near + step)
        at, chunk = 0, 256
        while at < n:
            query = np.arange(at, min(n, at + chunk))
            a, b = self._search(query, label, radius)
            label = _joined(label, a, b)
            at, chunk = at + len(query), min(chunk * 2, 1 << 14)
        return label

    def _search(self, query: np.ndarray, label: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        lows, highs = [label], [label]
        for starts, *_ in self.levels:
            lows.append(np.minimum.reduceat(lows[-1], starts))
            highs.append(np.maximum.reduceat(highs[-1], starts))
        top = self.levels[-1]
        node = np.searchsorted(top[4], self.group[query])
        seen, differences = np.zeros(len(query), np.uint64), np.zeros(len(query), np.int64)
        for level in range(len(self.levels) - 1, -1, -1):
            starts, children, common, value, _ = self.levels[level]
            fresh = common[node] & ~seen
            differences = differences + np.bitwise_count((self.codes[query] ^ value[node]) & fresh)
            own = (lows[level + 1][node] == label[query]) & (highs[level + 1][node] == label[query])
            keep = (differences <= radius) & ~own
            query, node, differences, seen = query[keep], node[keep], differences[keep], common[node][keep]
            each = children[node]
            offset = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
            query, differences, seen, node = np.repeat(query, each), np.repeat(differences, each), np.repeat(seen, each), np.repeat(starts[node], each) + offset
        found = (differences + np.bitwise_count((self.codes[query] ^ self.codes[node]) & ~seen) <= radius) & (label[query] != label[node])
        return query[found], node[found]


def _joined(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``label`` after joining the sets of a[i] and b[i]; a set's label is its smallest position."""
    while len(a):
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            break
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        root = np.arange(len(label))
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
        label = root[label]
    return label


def block_masks(radius: int, agree: int) -> list[int]:
    """Bit masks of all choices of ``agree`` out of radius + agree blocks of the 64 bits: fingerprints that differ in
    ``radius`` bits or fewer are equal under one of them at least."""
    edges = np.linspace(0, 64, radius + agree + 1).astype(int)
    blocks = [(1 << int(high)) - (1 << int(low)) for low, high in zip(edges[:-1], edges[1:], strict=True)]
    return [sum(c) for c in combinations(blocks, agree)]


def _linker(radius: int):
    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(choice, key, fp) rows of whole groups to (a, b) links."""
        got = [tuple(b.column(i).to_numpy() for i in range(3)) for b in batches]
        if not got:
            return
        choice, key, code = (np.concatenate([g[i] for g in got]) for i in range(3))
        code = code.view(np.uint64)
        order = np.lexsort((gray_rank(code), key, choice))
        choice, key, code = choice[order], key[order], code[order]
        group = np.cumsum(np.r_[False, (choice[1:] != choice[:-1]) | (key[1:] != key[:-1])])
        several = np.bincount(group)[group] > 1
        code, group = code[several], np.unique(group[several], return_inverse=True)[1]
        if not len(code):
            return
        label = GrayIndex(code, group).link(radius)
        moved = np.flatnonzero(label != np.arange(len(label)))
        for at in range(0, len(moved), 1 << 16):
            part = moved[at : at + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(code[part].view(np.int64)), pa.array(code[label[part]].view(np.int64))], names=["a", "b"])

    return links


def link_fingerprints(fps: DataFrame, radius: int = RADIUS, agree: int = 1) -> DataFrame:
    """(a, b) links of distinct fingerprints (column fp) that differ in ``radius`` bits or fewer; enough of them that the
    components are those of all links. ``agree`` only changes the number and size of the groups. A task holds the
    fingerprints of its groups, 8 bytes each."""
    masks = [signed(m) for m in block_masks(radius, agree)]
    dealt = fps.select("fp", F.posexplode(F.array(*(F.col("fp").bitwiseAND(F.lit(m)) for m in masks))).alias("choice", "key"))
    return dealt.repartition("choice", "key").select("choice", "key", "fp").mapInArrow(_linker(radius), "a long, b long")


def near_duplicate_components(docs: DataFrame, size: int = SHINGLE_WORDS) -> DataFrame:
    """doc_id, fingerprint, component_id for every row of ``docs``.

    Equal fingerprints link too (also the zero of empty and null texts). component_id is the smallest doc_id of the
    component, null only where it has none. Repeated rows give repeated results; other columns are not read.
    """
    fps = stage_table(fingerprints(docs, size), "fingerprints")
    first = stage_table(fps.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct-fingerprints")
    roots = components(link_fingerprints(first))
    rooted = first.join(roots, first.fp == roots.node, "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    classes = rooted.join(smallest, "root").select("fp", "component_id")
    return fps.join(classes, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every row of ``documents``."""
    return near_duplicate_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
