"""Toxicity: every maximum-scoring segment of a text over token log-odds, aggregated by extreme-value calibration.

A token's log-odds of being in toxic rather than clean text come from document counts with Dirichlet priors: a word's prior
is the posterior of its longest prefix, that prefix's prior the posterior of the next shorter one, and so on to even odds.
Less a drift, which makes the expected score negative, they are the scores of a sequence, in which one linear scan finds all
maximal segments. Maximal scores of clean texts of n words follow an extreme-value law, P(S >= s) = 1 - exp(-K n exp(-L s));
L and K are fitted to the clean training texts. A segment is significant if fewer than one as good is expected by chance. The
best segment's calibrated score and the sum over all significant ones go into a logistic function, fitted likewise.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import append_columns, map_rows, slices, stage_table

#: Labelled rows, least hashes of doc_id first, on which the model is fitted; texts that repeat count once.
TRAIN_ROWS = 20_000
#: Training texts that must hold a word or prefix before it gets a weight of its own. All of these are in the model, so its
#: size is bounded by the training rows.
LEAST_TEXTS = 3
PREFIXES = (2, 3, 4, 5, 6)
#: Texts with which a word counts for its prefixes at most, so that one frequent word doesn't speak for all like it.
WORD_TEXTS = 3.0
#: Pseudo-counts of a prior.
PRIOR = 10.0
#: Taken from every token's log-odds, which are cut to [LOW, HIGH] before.
DRIFT, LOW, HIGH = 0.6, -2.0, 5.0
THRESHOLD = 0.3
_WORD = re.compile(r"[^\W\d_]+")
_CACHE = 100_000
_FLUSH = 200_000


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def features(word: str) -> list[str]:
    """A word's prefixes (marked by a star), shortest first, then the word."""
    return [f"{word[:k]}*" for k in PREFIXES if k < len(word)] + [word]


def posterior_log_odds(counts: dict[str, tuple[float, float]]) -> dict[str, float]:
    """Log-odds of each feature of ``counts`` (balanced clean and toxic counts); a feature's prior is its longest prefix
    that has counts, or even odds."""
    out: dict[str, float] = {}
    for feature in sorted(counts, key=lambda f: (len(f.rstrip("*")), not f.endswith("*"))):
        stem = feature.rstrip("*")
        parent = next((out[p] for k in reversed(PREFIXES) if k < len(stem) and (p := f"{stem[:k]}*") in out), 0.0)
        share = 1 / (1 + math.exp(-parent))
        clean, toxic = counts[feature]
        out[feature] = math.log((toxic + PRIOR * share) / (clean + PRIOR * (1 - share)))
    return out


class _Scores(dict):
    """Word to score, filled as words come."""

    def __init__(self, weights: dict[str, float]):
        super().__init__()
        self.weights = weights

    def __missing__(self, word: str) -> float:
        get = self.weights.get
        found = next((w for f in reversed(features(word)) if (w := get(f)) is not None), 0.0)
        self[word] = score = min(HIGH, max(LOW, found)) - DRIFT
        return score


def maximal_segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """(start, end, score) of all maximal segments, in order, in linear time. Only positive scores start a step; ``left``
    links a candidate to the nearest earlier one with a smaller sum before it."""
    total = np.concatenate([[0.0], np.cumsum(scores)])
    at = np.flatnonzero(scores > 0)
    kept: list[tuple[int, int, float, float, int]] = []  # start, end, sum before, sum at the end, left
    for i, low, high in zip(at.tolist(), total[at].tolist(), total[at + 1].tolist(), strict=True):
        start, k = i, len(kept) - 1
        while True:
            while k >= 0 and kept[k][2] >= low:
                k = kept[k][4]
            if k < 0 or kept[k][3] >= high:
                kept.append((start, i + 1, low, high, k))
                break
            start, _, low, _, k_left = kept[k]
            del kept[k:]
            k = k_left
    return [(s, e, high - low) for s, e, low, high, _ in kept]


@dataclass
class Model:
    weights: dict[str, float]
    rate: float = 1.0  # L of the extreme-value law
    log_k: float = 0.0
    coefficients: tuple[float, float, float] = (-20.0, 0.0, 0.0)  # of 1, the best segment, the sum of the significant

    def scorer(self) -> Scorer:
        return Scorer(self)


class Scorer:
    def __init__(self, model: Model):
        self.model, self.known = model, _Scores(model.weights)

    def segments(self, words: list[str]) -> list[tuple[int, int, float]]:
        if len(self.known) > _CACHE:
            self.known = _Scores(self.model.weights)
        return maximal_segments(np.array(list(map(self.known.__getitem__, words)), float)) if words else []

    def calibrated(self, segments: Iterable[tuple[int, int, float]], n: int) -> list[float]:
        """Minus the logarithm of how many as good segments are expected by chance in n words."""
        m = self.model
        return [m.rate * s - m.log_k - math.log(max(n, 1)) for _, _, s in segments]

    def evidence(self, text: str | None) -> tuple[float, float]:
        """Calibrated score of the best segment (at least -5) and the sum over the significant ones, both damped."""
        words = words_of(text)
        got = self.calibrated(self.segments(words), len(words))
        return max([-5.0, *got]), math.log1p(sum(x for x in got if x > 0))

    def score(self, text: str | None) -> float:
        best, total = self.evidence(text)
        a, b, c = self.model.coefficients
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, a + b * best + c * total))))

    def passages(self, text: str | None) -> list[tuple[int, int, float]]:
        """(start, end, calibrated score) in code points of every significant segment."""
        text = text or ""
        spans = [m.span() for m in _WORD.finditer(text)]
        words = [text[s:e].lower() for s, e in spans]
        segments = self.segments(words)
        return [(spans[s][0], spans[e - 1][1], x) for (s, e, _), x in zip(segments, self.calibrated(segments, len(words)), strict=True) if x > 0]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, toxic) rows to (word, clean texts, toxic texts), summed over parts of the partition."""
    sums: tuple[Counter, Counter] = (Counter(), Counter())

    def flush() -> pa.RecordBatch:
        names = list(sums[0].keys() | sums[1].keys())
        out = pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([sums[0][n] for n in names], pa.int64()), pa.array([sums[1][n] for n in names], pa.int64())], names=["word", "clean", "toxic"])
        sums[0].clear()
        sums[1].clear()
        return out

    for b in slices(batches):
        for text, toxic in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            sums[toxic].update(set(words_of(text)))
            if len(sums[0]) + len(sums[1]) > _FLUSH:
                yield flush()
    yield flush()


def held_out(doc_id="doc_id"):
    """crc32 of doc_id as text, mod 4, is 2; false for a null doc_id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """(text, toxic) of up to ``rows`` labelled documents that aren't held out, each text once per label."""
    chosen = labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    got = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")  # bounded by ``rows``
    return stage_table(got.groupBy("text", "toxic").agg(F.min("doc_id").alias("doc_id")).select("text", "toxic"), "toxicity-training")


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """The model of the labelled ``docs`` that aren't held out. Without rows of both labels it scores every text alike:
    near 0, or near 1 where all labels are toxic."""
    train = training_rows(docs, labels, rows)
    n = {r["toxic"]: r["n"] for r in train.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(n) < 2:
        return Model({}, coefficients=(20.0 if 1 in n else -20.0, 0.0, 0.0))
    scale = {y: sum(n.values()) / 2 / n[y] for y in n}
    words = train.mapInArrow(_count, "word string, clean long, toxic long").groupBy("word").agg(*((F.sum(c) * scale[y]).alias(c) for y, c in enumerate(("clean", "toxic"))), F.sum(F.col("clean") + F.col("toxic")).alias("n"))
    part = F.least(F.lit(1.0), F.lit(WORD_TEXTS) / F.col("n"))
    stems = F.explode(F.expr(f"transform(filter(array{PREFIXES}, k -> k < length(word)), k -> concat(substring(word, 1, k), '*'))"))
    prefixes = words.select(stems.alias("feature"), *((F.col(c) * part).alias(c) for c in ("clean", "toxic", "n"))).groupBy("feature").agg(*(F.sum(c).alias(c) for c in ("clean", "toxic", "n")))
    counts = prefixes.unionByName(words.withColumnRenamed("word", "feature"))
    held = counts.filter(F.col("n") >= LEAST_TEXTS).select("feature", "clean", "toxic").toArrow()  # bounded by the words of ``rows`` texts
    model = Model(posterior_log_odds(dict(zip(held["feature"].to_pylist(), zip(held["clean"].to_pylist(), held["toxic"].to_pylist(), strict=True), strict=True))))

    def measure():
        scorer = model.scorer()

        def one(text, toxic):
            words = words_of(text)
            return toxic, len(words), max((s for _, _, s in scorer.segments(words)), default=0.0)

        return one

    seen = map_rows(train, measure, "toxic int, n int, best double").collect()  # bounded by ``rows``
    clean = [(r["n"], r["best"]) for r in seen if not r["toxic"] and r["best"] > 0]
    model.rate, model.log_k = extreme_value(np.array([c[0] for c in clean], float), np.array([c[1] for c in clean], float))

    def weigh():
        scorer = model.scorer()
        return lambda text, toxic: (toxic, *scorer.evidence(text))

    got = map_rows(train, weigh, "toxic int, best double, total double").collect()
    model.coefficients = logistic(np.array([[1.0, r["best"], r["total"]] for r in got]), np.array([r["toxic"] for r in got], float))
    return model


def extreme_value(n: np.ndarray, best: np.ndarray) -> tuple[float, float]:
    """L and ln K that make the best scores of texts of n words likeliest; (1, 0) for fewer than 20 texts."""
    if len(n) < 20:
        return 1.0, 0.0
    fits = []
    for rate in np.geomspace(0.02, 5, 120):
        k = len(n) / (n * np.exp(-rate * best)).sum()
        x = np.log(k * n) - rate * best
        fits.append(((np.log(rate) + x - np.exp(x)).sum(), rate, np.log(k)))
    return float(max(fits)[1]), float(max(fits)[2])


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.5, steps: int = 50) -> tuple[float, float, float]:
    """Coefficients of a ridge logistic regression by Newton steps (damped so that separable data can't diverge)."""
    w = np.zeros(x.shape[1])
    penalty = np.diag([1e-6, *[ridge] * (x.shape[1] - 1)])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty + 1e-9 * np.eye(len(w)), x.T @ (y - p) - penalty @ w)
        w += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(v) for v in w)


def _score_maker(spark: SparkSession, model: Model):
    shared = spark.sparkContext.broadcast(model)  # bounded by the training rows

    def make():
        scorer = shared.value.scorer()
        return lambda text: (scorer.score(text),)

    return make


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``; null and empty texts have no segment and get the
    score of that. Repeated rows give repeated results; other columns are not read."""
    scored = append_columns(docs.select("doc_id", "text"), ["text"], _score_maker(docs.sparkSession, model), "score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def toxic_passages(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, start, end (code points), strength of every significant passage; none for null and empty texts. Repeated rows
    give repeated passages; other columns are not read."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        scorer = shared.value.scorer()
        return lambda doc_id, text: (doc_id, [{"start": s, "end": e, "strength": x} for s, e, x in scorer.passages(text)])

    return map_rows(docs.select("doc_id", "text"), make, "doc_id long, found array<struct<start:int,end:int,strength:double>>").selectExpr("doc_id", "inline(found)")


def drop_toxic(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose score is under ``threshold``. Null and empty texts have the score of
    a text without segments; repeated rows stay or go together; an empty table stays empty."""
    name = "factgraph_toxicity_score"
    return append_columns(docs, ["text"], _score_maker(docs.sparkSession, model), f"{name} double").filter(F.col(name) < threshold).drop(name)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of ``documents`` scored."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score_documents(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
