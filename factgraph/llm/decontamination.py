"""Benchmark decontamination: a BM25 index of the test items, searched with block-max WAND by every training passage.

An item is a leak where a document repeats enough shingles of its question and of its answer, however far apart. So the
longer of the two is indexed, which must lie in one passage, and both are verified over the whole document. An item's own
threshold is the least score that a passage can have which repeats ``SIMILARITY`` of the indexed part's shingles, so the search
loses none of those; weights are divided by it, and 1 is the threshold of all. Passages are searched a batch at a time with
WAND's two tests: terms whose upper bounds add up to less than the threshold can't lift an item alone, so a passage that has no
other term is left at once; then the block maxima of its terms are added up, and postings are scored only in blocks that can
still reach the threshold. ``Index.skipped`` counts what either test saves.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import append_columns, slices

SHINGLE_WORDS = 5
SIMILARITY = 0.8
K1, B = 1.2, 0.75
#: Items in a block of the index.
BLOCK_ITEMS = 8
#: Words of a passage; it grows with the longest item, so that any copy of an item lies in one passage.
PASSAGE_WORDS = 256
#: Characters of item text in one index, which is broadcast; larger sets of items are searched index by index.
INDEX_CHARS = 8_000_000
_WORD = re.compile(r"\w+")
_EPS = 1e-9
#: Tables of up to so many cells are kept dense.
_DENSE = 1 << 24


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def split_item(text: str) -> tuple[list[str], list[str]]:
    """Words of question and answer: the answer follows the first question mark, else the last line break; an item
    without either is a question alone."""
    head, mark, tail = text.partition("?")
    if not mark:
        head, mark, tail = text.rstrip().rpartition("\n")
        if not mark:
            head, tail = tail, ""
    question, answer = words_of(head), words_of(tail)
    return (question, answer) if question else (answer, [])


def shingles(words: list[str], size: int = SHINGLE_WORDS) -> set[tuple[str, ...]]:
    """Runs of ``size`` words; fewer words give the whole sequence."""
    return {tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


@dataclass
class Index:
    """Postings and block maxima by term, both in CSR form. ``essential`` marks terms outside WAND's non-essential set."""

    items: list[int]
    parts: list[tuple[list[str], list[str]]]
    terms: dict[str, int] = field(default_factory=dict)

    def __post_init__(self):
        indexed = [a if len(a) > len(q) else q for q, a in self.parts]
        self.longest = max(map(len, indexed), default=0)
        self.skipped = Counter()
        bags = [Counter(p) for p in indexed]
        held = Counter(t for b in bags for t in b)
        self.terms = {t: i for i, t in enumerate(sorted(held))}
        mean = sum(sum(b.values()) for b in bags) / max(1, len(bags))
        rows = []
        for item, (part, bag) in enumerate(zip(indexed, bags, strict=True)):
            n = sum(bag.values())
            weight = {t: math.log(1 + (len(bags) - held[t] + 0.5) / (held[t] + 0.5)) * f * (K1 + 1) / (f + K1 * (1 - B + B * n / mean)) for t, f in bag.items()}
            # a passage that repeats enough of the shingles lacks at most so many words of the part
            lacking = math.floor((1 - SIMILARITY) * len(shingles(part)) + _EPS) if len(part) > SHINGLE_WORDS else 0
            heaviest = sorted(weight.values(), reverse=True)[:lacking]
            least = max(sum(weight.values()) - sum(heaviest), 1e-6)
            rows += [(self.terms[t], item, w / least) for t, w in weight.items()]
        rows.sort()
        term = np.array([r[0] for r in rows], np.int64)
        self.item = np.array([r[1] for r in rows], np.int64)
        self.weight = np.array([r[2] for r in rows], float)
        self.start = np.searchsorted(term, np.arange(len(self.terms) + 1))
        self.n_blocks = len(self.items) // BLOCK_ITEMS + 1
        cell, first = np.unique(term * self.n_blocks + self.item // BLOCK_ITEMS, return_index=True)
        self.block = cell % self.n_blocks
        self.block_max = np.maximum.reduceat(self.weight, first) if len(rows) else np.zeros(0)
        self.block_start = np.searchsorted(cell // self.n_blocks, np.arange(len(self.terms) + 1))
        bound = np.maximum.reduceat(self.weight, self.start[:-1]) if len(rows) else np.zeros(0)
        order = np.argsort(bound, kind="stable")
        self.essential = np.zeros(len(bound), bool)
        self.essential[order[np.cumsum(bound[order]) >= 1 - _EPS]] = True

    def search(self, passage: np.ndarray, term: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(passage, item, score) of all scores of at least 1 among ``n`` passages, given distinct (passage, term) rows."""
        alive = np.zeros(n, bool)
        alive[passage[self.essential[term]]] = True
        keep = alive[passage]
        self.skipped.update(passages=n, left_at_once=n - int(alive.sum()))
        passage, term = passage[keep], term[keep]
        p, at = _expand(passage, self.block_start, term)
        cells = _sums(p * self.n_blocks + self.block[at], self.block_max[at], n * self.n_blocks)[0]
        if not len(cells):
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        keep = np.isin(passage, cells // self.n_blocks)
        p, at = _expand(passage[keep], self.start, term[keep])
        inside = np.isin(p * self.n_blocks + self.item[at] // BLOCK_ITEMS, cells)
        self.skipped.update(postings=len(inside), not_scored=len(inside) - int(inside.sum()))
        pairs, score = _sums(p[inside] * len(self.items) + self.item[at[inside]], self.weight[at[inside]], n * len(self.items))
        return pairs // len(self.items), pairs % len(self.items), score


def _expand(passage: np.ndarray, start: np.ndarray, term: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every row all positions of its term's list."""
    size = start[term + 1] - start[term]
    offset = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    return np.repeat(passage, size), np.repeat(start[term], size) + offset


def _sums(key: np.ndarray, weight: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The keys below ``n`` whose weights add up to the threshold, ascending, and their sums."""
    if n <= _DENSE:
        sums = np.bincount(key, weight, n)
        keys = np.flatnonzero(sums >= 1 - _EPS)
        return keys, sums[keys]
    keys, at = np.unique(key, return_inverse=True)
    sums = np.bincount(at, weight, len(keys))
    return keys[sums >= 1 - _EPS], sums[sums >= 1 - _EPS]


def _distinct(keys: list[np.ndarray], n: int) -> np.ndarray:
    """The distinct numbers below ``n`` in ``keys``, ascending."""
    if n <= _DENSE:
        seen = np.zeros(n, bool)
        for k in keys:
            seen[k] = True
        return np.flatnonzero(seen)
    return np.unique(np.concatenate(keys)) if keys else np.zeros(0, np.int64)


class Matcher:
    """Finds the items of one index in texts."""

    def __init__(self, index: Index):
        self.index, self.get = index, index.terms.get
        self.size = max(PASSAGE_WORDS, 4 * index.longest)
        self.step = self.size - math.ceil(index.longest / SIMILARITY)
        self.shingles: dict[int, tuple[set, set]] = {}

    def find(self, texts: list[str | None]) -> Iterator[tuple[int, int, float, float, float]]:
        """(text, item_id, best score of a passage, question overlap, answer overlap) of the verified items of each text."""
        n_terms = len(self.index.terms)
        if not n_terms:
            return
        docs = [words_of(t) for t in texts]
        keys, owner, first, n = [], [], [], 0
        for d, words in enumerate(docs):
            ids = np.array(list(map(self.get, words, repeat(-1))), np.int64)
            for at in range(0, max(1, len(words) - self.size + self.step), self.step):
                part = ids[at : at + self.size]
                keys.append(part[part >= 0] + n * n_terms)
                owner.append(d)
                first.append(at)
                n += 1
        distinct = _distinct(keys, n * n_terms)
        best: dict[tuple[int, int], float] = {}
        for p, i, score in zip(*(x.tolist() for x in self.index.search(distinct // n_terms, distinct % n_terms, n)), strict=True):
            best[owner[p], i] = max(score, best.get((owner[p], i), 0.0))
        last, runs = -1, {}
        for (d, i), score in sorted(best.items()):
            if d != last:
                last, runs = d, {}
            question, answer = self.overlaps(docs[d], i, runs)
            if question >= SIMILARITY - _EPS and answer >= SIMILARITY - _EPS:
                yield d, self.index.items[i], score, question, answer

    def overlaps(self, words: list[str], item: int, runs: dict[int, set]) -> tuple[float, float]:
        """Shares of the item's question and answer shingles that the text repeats; 1 for a part without words. ``runs``
        keeps the text's shingles by size."""
        if item not in self.shingles:
            self.shingles[item] = tuple(shingles(p) for p in self.index.parts[item])
        out = []
        for wanted in self.shingles[item]:
            size = len(next(iter(wanted))) if wanted else 0
            if size and size not in runs:
                runs[size] = set(zip(*(words[k:] for k in range(size)))) if len(words) >= size else set()
            out.append(len(wanted & runs[size]) / len(wanted) if wanted else 1.0)
        return out[0], out[1]


def build_indexes(benchmark: DataFrame, chars: int = INDEX_CHARS) -> list[Index]:
    """Indexes of the items (item_id, text), each of a bounded size. Null ids and items without words are left out;
    of repeated (item_id, text) rows one is kept."""
    items = benchmark.select("item_id", "text").filter("item_id is not null and text is not null").distinct()
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = math.ceil(total / chars)
    out = []
    for k in range(n):
        rows = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).orderBy("item_id", "text").collect()  # about ``chars``
        parts = [(r["item_id"], split_item(r["text"])) for r in rows]
        parts = [x for x in parts if x[1][0]]
        out.append(Index([i for i, _ in parts], [p for _, p in parts]))
    return out


def find_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, score, question_overlap, answer_overlap of every item that a document repeats.

    Whole texts are searched, a null text has no words. The score is BM25 as a multiple of the item's threshold. Rows with
    equal doc_id are judged one by one. Without documents or items the result is empty. Other columns are not read.
    """
    schema = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double"
    out = docs.sparkSession.createDataFrame([], schema)
    for index in build_indexes(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(shared.value)
            for b in slices(batches):
                ids = b.column(0).to_pylist()
                rows = [(ids[d], *x) for d, *x in matcher.find(b.column(1).to_pylist())]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [pa.int64()] * 2 + [pa.float64()] * 3, strict=True)], names=["doc_id", "item_id", "score", "question_overlap", "answer_overlap"])

        out = out.unionByName(docs.select("doc_id", "text").mapInArrow(run, schema))
    return out


def drop_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs``, with all their columns, that repeat no item. Null and empty texts repeat none; repeated rows stay
    or go together; without items all rows stay."""
    name = "factgraph_leaked_items"
    for index in build_indexes(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def make(shared=shared):
            matcher = Matcher(shared.value)
            return lambda text: (sum(1 for _ in matcher.find([text])),)

        docs = append_columns(docs, ["text"], make, f"{name} long").filter(F.col(name) == 0).drop(name)
    return docs


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every (document, benchmark item) leak in ``documents``."""
    return find_leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
