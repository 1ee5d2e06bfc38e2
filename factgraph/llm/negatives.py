"""Hard-negative mining: the different-label rows whose scores come next under a share of a positive's score.

Rows are product-quantised: each stretch of two components is replaced by a centroid of integers, and the norm of what remains is stored
for each stretch. An anchor's lookup tables hold its products with all centroids, so a row's table sum, plus or minus the
products of the anchor's and the remainders' norms, bounds its score. Rows whose bounds show that they can't be among those
asked for are left out without a look at their vectors; exact integer products of the others complete each window.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import stage_table

SCALE, EVERY, MOVED, LABELS = 256, 100, 7, 10
POSITIVES, NEGATIVES = 5, 10
#: A negative's score is from LOW to HIGH hundredths of the positive's.
LOW, HIGH = 30, 90
#: Components of a stretch, centroids of a stretch, rows (least hashes first) on which they are fitted, and rounds of that.
STRETCH, CENTROIDS, SAMPLE, ROUNDS = 2, 256, 8192, 8
#: Rows and anchors of one task's group, on average (both are dealt by hash), and anchors that it compares at a time.
BLOCK_ROWS, CHUNK_ROWS, AT_ONCE = 16_384, 1024, 64
#: Products of whole numbers are exact in doubles below this.
_EXACT = 2.0**53


@dataclass
class Quantiser:
    """Integer centroids, stretches x CENTROIDS x STRETCH (the last stretch is padded with zeros)."""

    centroids: np.ndarray

    def __post_init__(self):
        self.reach = math.sqrt((self.centroids**2).sum(axis=2).max(axis=1).sum())

    @staticmethod
    def fit(rows: np.ndarray, seed: int = 12) -> Quantiser:
        parts, draw = _stretches(rows), np.random.default_rng(seed)
        out = []
        for x in parts.transpose(1, 0, 2):
            c = np.unique(x, axis=0)
            c = c[draw.permutation(len(c))[:CENTROIDS]]
            for _ in range(ROUNDS):
                near = _nearest(x, c)
                n = np.bincount(near, minlength=len(c))
                sums = np.stack([np.bincount(near, x[:, d], len(c)) for d in range(x.shape[1])], axis=1)
                c = np.where(n[:, None] > 0, np.rint(sums / np.maximum(n, 1)[:, None]), c)
            out.append(np.concatenate([c, np.repeat(c[:1], CENTROIDS - len(c), axis=0)]))
        return Quantiser(np.array(out))

    def encode(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rows x stretches of codes; of the remainders' norms, rounded up)."""
        parts = _stretches(rows)
        codes = np.stack([_nearest(parts[:, m], self.centroids[m]) for m in range(parts.shape[1])], axis=1)
        rest = parts - self.centroids[np.arange(parts.shape[1])[None, :], codes]
        norms = np.sqrt((rest * rest).sum(axis=2))
        return codes.astype(np.uint8), np.nextafter(norms.astype(np.float32), np.float32(np.inf))

    def bounds(self, anchors: np.ndarray, codes: np.ndarray, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(least, greatest) scores that are possible, anchors x rows."""
        parts = _stretches(anchors)
        table = np.einsum("amd,mcd->mac", parts, self.centroids)
        middle = np.zeros((len(anchors), len(codes)))
        for m in range(len(table)):
            middle += table[m].take(codes[:, m], axis=1)
        spread = np.sqrt((parts * parts).sum(axis=2)) @ rest.T.astype(float)
        spread += 1e-6 + 1e-9 * spread + 1e-11 * self.reach * np.sqrt((parts * parts).sum(axis=(1, 2)))[:, None]  # sums of doubles are rounded by less
        return middle - spread, middle + spread


def _stretches(rows: np.ndarray) -> np.ndarray:
    n = -(-rows.shape[1] // STRETCH)
    return np.pad(rows, ((0, 0), (0, n * STRETCH - rows.shape[1]))).reshape(len(rows), n, STRETCH).astype(float)


def _nearest(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    out = np.zeros(len(x), np.int64)
    for at in range(0, len(x), 4096):
        own = x[at : at + 4096]
        out[at : at + 4096] = ((centroids * centroids).sum(axis=1) - 2 * own @ centroids.T).argmin(axis=1)
    return out


def exact_scores(anchor: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Integer inner products. Rows are admitted only if no product of two of them leaves 64 bits."""
    a = anchor.astype(float)
    if len(rows) and math.sqrt(a @ a) * math.sqrt((rows.astype(float) ** 2).sum(axis=1).max()) < _EXACT / 4:
        return (rows.astype(float) @ a).astype(np.int64)
    return rows @ anchor


@dataclass
class Block:
    """Rows in the order of their ids, with codes and remainders' norms."""

    ids: np.ndarray
    labels: np.ndarray
    vectors: np.ndarray
    codes: np.ndarray
    rest: np.ndarray

    def best(self, anchor: np.ndarray, may: np.ndarray, most: np.ndarray, least: np.ndarray, low: float, high: float, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of the first ``n`` rows, best scores first, of those that ``may`` be taken and score from ``low`` to ``high``. ``least`` and ``most`` bound the scores."""
        open_ = may & (most >= low) & (least <= high)
        sure = least[open_ & (least >= low) & (most <= high)]
        if len(sure) > n:
            open_ &= most >= np.partition(sure, len(sure) - n)[len(sure) - n]
        at = np.flatnonzero(open_)
        scores = exact_scores(anchor, self.vectors[at])
        fit = (scores >= low) & (scores <= high)
        at, scores = at[fit], scores[fit]
        first = np.lexsort((at, -scores))[:n]
        return self.ids[at[first]], scores[first]


def _block(rows: pa.Table) -> Block:
    order = np.argsort(rows["vec_id"].to_numpy(), kind="stable")
    take = lambda c, kind: np.frombuffer(b"".join(rows[c].to_pylist()), kind).reshape(rows.num_rows, -1)[order]
    return Block(rows["vec_id"].to_numpy()[order], rows["label"].to_numpy()[order], take("vector", "<i8"), take("codes", np.uint8), take("rest", "<f4"))


_FOUND = T.StructType().add("tag", "long").add("nth", "integer").add("vec_id", "long").add("score", "long")


def _search(quantiser, window: bool):
    """Of a block the rows asked for by each anchor: its first positives or, if ``window``, the first negatives of each of its positives."""

    def run(_key, asked: pa.Table, rows: pa.Table) -> pa.Table:
        tags, nths, ids, scores = [], [], [], []
        if asked.num_rows and rows.num_rows:
            block = _block(rows)
            anchors = np.frombuffer(b"".join(asked["vector"].to_pylist()), "<i8").reshape(asked.num_rows, -1)
            part = quantiser.value[asked["n"][0].as_py()]
            wanted = asked["wanted"].to_pylist() if window else None
            tag, own_id, own_label = (asked[c].to_numpy() for c in ("tag", "vec_id", "label"))
            for at in range(0, len(anchors), AT_ONCE):
                least, most = part.bounds(anchors[at : at + AT_ONCE].astype(float), block.codes, block.rest)
                for i in range(len(least)):
                    a = at + i
                    same = block.labels == own_label[a]
                    tasks = [(0, same & (block.ids != own_id[a]), -np.inf, np.inf, POSITIVES)]
                    if window:
                        tasks = [(nth, ~same, -(-LOW * s // 100), HIGH * s // 100, NEGATIVES) for nth, s in enumerate(wanted[a]) if HIGH * s // 100 >= -(-LOW * s // 100)]
                    for nth, may, low, high, n in tasks:
                        found, value = block.best(anchors[a], may, most[i], least[i], low, high, n)
                        tags.append(np.full(len(found), tag[a]))
                        nths.append(np.full(len(found), nth))
                        ids.append(found)
                        scores.append(value)
        join = lambda x: np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64)
        return pa.table({"tag": join(tags), "nth": pa.array(join(nths), pa.int32()), "vec_id": join(ids), "score": join(scores)})

    return run


def whole_rows(vectors: DataFrame) -> DataFrame:
    """tag, vec_id, label, vector (binary, little-endian 64-bit numbers), n (components) of the rows that take part."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select("vec_id", F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    rows = rows.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull()).filter(finite)
    square = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + F.pow(F.floor(x * SCALE).cast("double"), 2))
    rows = rows.filter(F.forall("embedding", lambda x: F.abs(x) < 2.0**22) & (square < 2.0**62))
    moved = F.when(F.col("vec_id") % MOVED == 0, (F.col("label") + 1) % LABELS).otherwise(F.col("label"))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lengths = [len(x) for x in b.column(3)]
            # an empty vector is stored as one zero
            packed = [np.floor(SCALE * np.array(x.as_py() or [0.0], float)).astype("<i8").tobytes() for x in b.column(3)]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(packed, pa.binary()), pa.array(lengths, pa.int32())], names=["tag", "vec_id", "label", "vector", "n"])

    rows = rows.select(F.monotonically_increasing_id().alias("tag"), F.col("vec_id").cast("long").alias("vec_id"), moved.alias("label"), "embedding")
    return rows.mapInArrow(whole, "tag long, vec_id long, label long, vector binary, n int")


def hard_negatives(vectors: DataFrame, every: int = EVERY) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for every anchor (vec_id divisible by ``every``) and positive: see the module's constants.

    ``vectors`` has vec_id, embedding and label; other columns are not read. Rows take no part if id, label or vector is null
    or a component is null or not finite; nor do those whose whole-number vector has a squared length of 2 ** 62 or more or a component of 2 ** 30, since products with them may not
    fit 64 bits. Vectors of another length than the anchor's are not compared with it; empty and zero vectors score 0. Repeated ids are rows of their own, each an anchor of its own, but a row with the anchor's id
    isn't its positive. Positives without negatives give no rows, as do labels of one row and empty tables.
    """
    spark = vectors.sparkSession
    rows = stage_table(whole_rows(vectors), "negatives-rows")
    asked = rows.filter(F.col("vec_id") % every == 0)
    sizes = rows.groupBy("n").agg(F.count("*").alias("rows"), F.count_if(F.col("vec_id") % every == 0).alias("anchors")).collect()  # one row for each length of vectors
    fitted = {}
    for n in (r["n"] for r in sizes):
        drawn = rows.filter(F.col("n") == n).orderBy(F.xxhash64("vec_id"), "vec_id", "tag").limit(SAMPLE).select("vector").collect()  # bounded
        fitted[n] = Quantiser.fit(np.frombuffer(b"".join(bytes(r["vector"]) for r in drawn), "<i8").reshape(len(drawn), -1).astype(float))
    quantiser = spark.sparkContext.broadcast(fitted)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lengths, packed = np.array(b.column(4)), b.column(3).to_pylist()
            codes, rest = [b""] * len(packed), [b""] * len(packed)
            for n in np.unique(lengths):
                at = np.flatnonzero(lengths == n)
                c, r = quantiser.value[n].encode(np.frombuffer(b"".join([packed[i] for i in at]), "<i8").reshape(len(at), -1).astype(float))
                for i, own, left in zip(at, c, r, strict=True):
                    codes[i], rest[i] = own.tobytes(), left.tobytes()
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(codes, pa.binary()), pa.array(rest, pa.binary())], names=[*b.schema.names, "codes", "rest"])

    coded = rows.mapInArrow(encode, T.StructType([*rows.schema.fields]).add("codes", "binary").add("rest", "binary"))
    parts = [(r["n"], math.ceil(r["rows"] / BLOCK_ROWS), max(1, math.ceil(r["anchors"] / CHUNK_ROWS))) for r in sizes]
    parts = F.broadcast(spark.createDataFrame(parts, "n int, blocks int, chunks int"))
    key = ["n", "block", "chunk"]

    def dealt(df: DataFrame, own: str, other: str) -> DataFrame:
        """Each row in the part ``own`` that its tag's hash names, and a copy for each part of ``other``."""
        mine, theirs = F.pmod(F.xxhash64("tag"), F.col(f"{own}s")).cast("int"), F.explode(F.sequence(F.lit(0), F.col(f"{other}s") - 1))
        return df.join(parts, "n").withColumn(own, mine).withColumn(other, theirs).drop("blocks", "chunks")

    blocks = stage_table(dealt(coded, "block", "chunk"), "negatives-blocks")

    def visit(anchors: DataFrame, window: bool) -> DataFrame:
        sent = dealt(anchors, "chunk", "block")
        found = sent.groupBy(key).cogroup(blocks.groupBy(key)).applyInArrow(_search(quantiser, window), _FOUND)
        best = Window.partitionBy("tag", "nth").orderBy(F.desc("score"), "vec_id")
        ranked = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= (NEGATIVES if window else POSITIVES))
        return stage_table(ranked, "negatives-window" if window else "negatives-positives")

    positives = visit(asked, False).select("tag", (F.col("rank") - 1).cast("int").alias("nth"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    wanted = positives.groupBy("tag").agg(F.array_sort(F.collect_list(F.struct("nth", "positive_score"))).getField("positive_score").alias("wanted"))  # POSITIVES at most
    negatives = visit(asked.join(wanted, "tag"), True).select("tag", "nth", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    out = negatives.join(positives, ["tag", "nth"]).join(asked.select("tag", F.col("vec_id").alias("anchor_id")), "tag")
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op12_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of the ``embeddings`` rows whose vec_id is divisible by 100."""
    return hard_negatives(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP12_SQL = """
WITH ok AS (
  SELECT row_number() OVER () AS tag, vec_id::BIGINT AS vec_id, CASE WHEN vec_id % 7 = 0 THEN (label::BIGINT + 1) % 10 ELSE label::BIGINT END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.tag, a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, list_dot_product(a.v, b.v)::BIGINT AS score
  FROM ok a JOIN ok b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE a.vec_id % 100 = 0),
positives AS (
  SELECT tag, anchor_id, other_id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY tag ORDER BY score DESC, other_id) AS nth
  FROM scored WHERE same QUALIFY nth <= 5),
negatives AS (
  SELECT p.anchor_id, p.positive_id, row_number() OVER (PARTITION BY p.tag, p.nth ORDER BY s.score DESC, s.other_id)::INTEGER AS rank,
    s.other_id AS negative_id, p.positive_score, s.score AS negative_score
  FROM positives p JOIN scored s ON s.tag = p.tag AND NOT s.same AND 30 * p.positive_score <= 100 * s.score AND 100 * s.score <= 90 * p.positive_score)
SELECT * FROM negatives WHERE rank <= 10
"""
