"""Approximate nearest neighbours by largest inner product: stable projections in a kd-tree, with a chi-square stop.

Largest inner product becomes least distance once every vector gets one more component, sqrt(M^2 - |x|^2) with M the
largest norm (queries get 0). A 2-stable (Gaussian) projection to PROJECTED dimensions turns a distance d into d^2 times a
chi-square variable. So a neighbour nearer than the k-th distance found so far, d_k, has with probability CONFIDENCE a
projected distance r with r^2 / d_k^2 under the chi-square quantile: projected neighbours are taken by kd-tree boxes, nearest
first, and verified on the original vectors until that test holds for the next box.

On Spark the upper kd-tree levels, whose splits are fitted on a bounded sample, deal all vectors to cells, and each cell is
cut into blocks of bounded size that carry the lower levels. A query first searches its own cell, which gives d_k, then
visits just those cells whose box can still pass the test.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import hot_join, stage_table

PROJECTED = 8
CONFIDENCE = 0.95
K = 20
SEED = 20
#: Vectors, least hashes first, on which the splits of the upper levels are fitted.
SAMPLE = 8192
#: Vectors that a cell is meant to hold; the upper levels have SAMPLE / 8 cells at most.
CELL_ROWS = 8192
#: Bytes of vectors and number of queries of one task's group, on average (they are dealt by hash).
BLOCK_BYTES, CHUNK_ROWS = 16 << 20, 2048
LEAF = 256
#: Products of matrices, which screen, may differ from the exact scores by less than this share of M^2.
_SLACK = 1e-9
#: Salts over which equal vectors are spread before they are counted.
SALTS = 64


def chi_square_quantile(p: float, degrees: int = PROJECTED) -> float:
    """The ``p`` quantile for an even number of degrees of freedom."""
    half = degrees // 2
    low, high = 0.0, 1000.0
    for _ in range(100):
        x = (low + high) / 2
        below = 1 - math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(half))
        low, high = (x, high) if below < p else (low, x)
    return high


def projection(dimension: int, seed: int = SEED) -> np.ndarray:
    """Gaussian directions for vectors with the extra component."""
    return np.random.default_rng(seed).standard_normal((dimension + 1, PROJECTED))


def project(x: np.ndarray, norm: float, directions: np.ndarray) -> np.ndarray:
    """Projections of data vectors (rows of ``x``) with the extra component."""
    rest = np.sqrt(np.maximum(norm * norm - np.einsum("ij,ij->i", x, x), 0))
    return x @ directions[:-1] + rest[:, None] * directions[-1]


class KdTree:
    """A kd-tree over points: median splits along the widest side down to ``leaf`` points, and its leaves' boxes."""

    def __init__(self, points: np.ndarray, leaf: int):
        self.splits: list[tuple[int, float, int, int]] = []  # axis, value, left, right; a leaf is minus its number plus 1
        self.members: list[np.ndarray] = []
        self.root = self._build(points, np.arange(len(points)), leaf)
        self.low = np.array([points[m].min(axis=0) for m in self.members])
        self.high = np.array([points[m].max(axis=0) for m in self.members])

    def _build(self, points: np.ndarray, at: np.ndarray, leaf: int) -> int:
        if len(at) > leaf:
            own = points[at]
            axis = int(np.argmax(own.max(axis=0) - own.min(axis=0)))
            value = float(np.median(own[:, axis]))
            left = own[:, axis] < value
            if left.any() and not left.all():
                node = len(self.splits)
                self.splits.append((axis, value, 0, 0))
                self.splits[node] = (axis, value, self._build(points, at[left], leaf), self._build(points, at[~left], leaf))
                return node
        self.members.append(at)
        return -len(self.members)

    def leaf_of(self, points: np.ndarray) -> np.ndarray:
        out = np.zeros(len(points), np.int64)
        work = [(self.root, np.arange(len(points)))]
        while work:
            node, at = work.pop()
            if node < 0:
                out[at] = -node - 1
                continue
            axis, value, left, right = self.splits[node]
            side = points[at, axis] < value
            work += [(left, at[side]), (right, at[~side])]
        return out


def box_gaps(points: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared distances from points to boxes, points x boxes."""
    out = np.zeros((len(points), len(low)))
    for d in range(points.shape[1]):
        p = points[:, d, None]
        out += np.maximum(np.maximum(low[None, :, d] - p, p - high[None, :, d]), 0) ** 2
    return out


def scores_of(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Inner products in double precision, row by row: equal vectors get equal scores wherever they stand."""
    return (vectors * queries).sum(axis=1)


@dataclass
class Space:
    """What every task needs to know: the largest norm, the directions, the quantile, the cells."""

    norm: float
    directions: np.ndarray
    limit: float
    tree: KdTree


def search_block(space: Space, ids: np.ndarray, vectors: np.ndarray, queries: np.ndarray, known: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each query the (ids, scores) of its k best among ``vectors``, as far as they can enter its k best; ``known`` has
    k-th best scores found elsewhere (minus infinity: none). In each round every query that is still searching takes its
    next nearest box; the queries at one box verify its points together. A query ends when the chi-square test holds for
    its next box. ``ids`` are ascending."""
    tree, at = KdTree(project(vectors, space.norm, space.directions), LEAF), queries @ space.directions[:-1]
    members = [vectors[m] for m in tree.members]
    gaps = box_gaps(at, tree.low, tree.high)
    order = np.argsort(gaps, axis=1, kind="stable")
    reach = np.einsum("ij,ij->i", queries, queries) + space.norm**2
    best = np.full((len(queries), k), -np.inf)  # scores only
    slack = _SLACK * space.norm**2
    worst, active = known.astype(float), np.arange(len(queries))
    seen_q, seen_v, seen_s = [], [], []
    for turn in range(order.shape[1]):
        leaf = order[active, turn]
        within = gaps[active, leaf] <= space.limit * np.maximum(reach[active] - 2 * worst[active], 0) * (1 + 1e-9) + 1e-12
        active, leaf = active[within], leaf[within]
        if not len(active):
            break
        by_leaf = np.argsort(leaf, kind="stable")
        for group in np.split(by_leaf, np.flatnonzero(np.diff(leaf[by_leaf])) + 1):
            q, x = active[group], leaf[group[0]]
            s = queries[q] @ members[x].T
            joined = np.concatenate([best[q], s], axis=1)
            best[q] = np.partition(joined, joined.shape[1] - k, axis=1)[:, -k:]
            worst[q] = np.maximum(worst[q], best[q].min(axis=1))
            i, j = np.nonzero(s >= worst[q][:, None] - slack)
            seen_q.append(q[i])
            seen_v.append(tree.members[x][j])
            seen_s.append(s[i, j])
    q, v, s = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (seen_q, seen_v, seen_s))
    keep = s >= worst[q] - slack
    q, v = q[keep], v[keep]
    exact = scores_of(queries[q], vectors[v])
    rank = np.lexsort((ids[v], -exact, q))
    q, v, exact = q[rank], v[rank], exact[rank]
    first = np.searchsorted(q, np.arange(len(queries) + 1))
    return [(ids[v[a : min(b, a + k)]], exact[a : min(b, a + k)]) for a, b in zip(first[:-1], first[1:], strict=True)]


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    values = pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column
    flat = values.flatten().to_numpy(zero_copy_only=False).astype(float)
    return flat.reshape(len(values), -1)


_FOUND = "query_key long, vec_ids array<long>, scores array<double>"


def _search(space, k: int):
    def run(_key, left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            found = []
        else:
            order = np.argsort(right["vec_id"].to_numpy(), kind="stable")
            known = left["known"].to_numpy(zero_copy_only=False)
            found = search_block(space.value, right["vec_id"].to_numpy()[order], _matrix(right["embedding"])[order], _matrix(left["embedding"]), np.where(np.isnan(known), -np.inf, known), k)
        rows = [(q, i, s) for q, (i, s) in zip(left["query_key"].to_pylist(), found, strict=False) if len(i)]
        return pa.table({"query_key": pa.array([r[0] for r in rows], pa.int64()), "vec_ids": pa.array([r[1] for r in rows], pa.list_(pa.int64())), "scores": pa.array([r[2] for r in rows], pa.list_(pa.float64()))})

    return run


def _valid(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding) rows that take part; components are doubles, or floats if they come as such."""
    kind = "float" if vectors.schema["embedding"].dataType.elementType.simpleString() == "float" else "double"
    ok = "vec_id is not null and embedding is not null and size(embedding) > 0 and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(embedding, x -> x <> 0)"
    return vectors.select("vec_id", F.col("embedding").cast(f"array<{kind}>").alias("embedding")).filter(ok)


def _salted_first(rows: DataFrame, n: int, by: str) -> DataFrame:
    """Up to ``n`` rows with the least vec_id of each value of ``by``; a hot value is cut down in SALTS parts first."""
    salt = F.pmod(F.xxhash64("vec_id"), F.lit(SALTS))
    part, whole = Window.partitionBy(by, "salt").orderBy("vec_id"), Window.partitionBy(by).orderBy("vec_id")
    cut = rows.withColumn("salt", salt).withColumn("at", F.row_number().over(part)).filter(F.col("at") <= n)
    return cut.withColumn("at", F.row_number().over(whole)).filter(F.col("at") <= n).drop("salt", "at")


def nearest(vectors: DataFrame, every: int = 20, k: int = K, confidence: float = CONFIDENCE) -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose vec_id is divisible by ``every`` the k other rows with the largest
    inner products found (all others, if fewer), ties to the smaller vec_id.

    ``vectors`` has vec_id and embedding; other columns are not read. Rows whose id or vector is null, or whose vector is
    empty, zero or holds null or non-finite components take no part; vectors of different lengths aren't compared, so each length is searched apart. Ids are unique; repeated ids count as rows of their own. Of equal vectors only the k + 1 least ids can be
    among k neighbours, so the others are left out of the candidates before the search, and equal queries are searched once.
    Without rows the result is empty.
    """
    spark = vectors.sparkSession
    rows = stage_table(_valid(vectors), "ann-valid")
    lengths = rows.groupBy(F.size("embedding").alias("n")).agg(F.count("*").alias("rows"), F.max(F.expr("sqrt(aggregate(embedding, 0d, (s, x) -> s + double(x) * double(x)))")).alias("norm"))
    found = [_nearest_of(rows.filter(F.size("embedding") == r["n"]), r["n"], r["norm"], every, k, confidence) for r in lengths.orderBy("n").collect()]  # one row for each length
    return reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")


def _nearest_of(rows: DataFrame, length: int, largest: float, every: int, k: int, confidence: float) -> DataFrame:
    """``nearest`` of valid vectors of one length with norms up to ``largest``."""
    spark = rows.sparkSession
    rows = stage_table(rows, "ann-rows")
    candidates = stage_table(_salted_first(rows, k + 1, "embedding").select("vec_id", "embedding"), "ann-candidates")
    asked = rows.filter(F.pmod("vec_id", F.lit(every)) == 0)
    salted = asked.groupBy("embedding", F.pmod(F.xxhash64("vec_id"), F.lit(SALTS)).alias("salt")).agg(F.min("vec_id").alias("query_key"))
    queries = stage_table(salted.groupBy("embedding").agg(F.min("query_key").alias("query_key")), "ann-queries")

    sample = candidates.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("embedding").collect()  # bounded
    n = candidates.count()
    norm, directions = float(largest) * (1 + 1e-12), projection(length)
    drawn = project(np.array([r["embedding"] for r in sample], float), norm, directions)
    tree = KdTree(drawn, max(8, math.ceil(len(drawn) * CELL_ROWS / n)))
    space = spark.sparkContext.broadcast(Space(norm, directions, chi_square_quantile(confidence), tree))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = space.value
        for b in batches:
            x = _matrix(b.column(1))
            p = project(x, s.norm, s.directions)
            cell = s.tree.leaf_of(p)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell), pa.array(list(p), pa.list_(pa.float64()))], names=[*b.schema.names, "cell", "projected"])

    kind = rows.schema["embedding"].dataType.simpleString()
    dealt = stage_table(candidates.mapInArrow(place, f"vec_id long, embedding {kind}, cell long, projected array<double>"), "ann-cells")
    axes = [F.get("projected", F.lit(d)).alias(f"p{d}") for d in range(PROJECTED)]
    cells = dealt.select("cell", *axes).groupBy("cell").agg(F.count("*").alias("n"), *(f(f"p{d}").alias(f"{f.__name__}{d}") for f in (F.min, F.max) for d in range(PROJECTED))).orderBy("cell").collect()  # at most SAMPLE / 8 cells
    number = np.array([c["cell"] for c in cells])
    low, high = (np.array([[c[f"{f}{d}"] for d in range(PROJECTED)] for c in cells]) for f in ("min", "max"))
    boxes = spark.sparkContext.broadcast((number, low, high))
    parts = {c["cell"]: math.ceil(c["n"] * 8 * length / BLOCK_BYTES) for c in cells}

    def route(first: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            s, (number, low, high) = space.value, boxes.value
            for b in batches:
                x = _matrix(b.column(1))
                gap = box_gaps(x @ s.directions[:-1], low, high)
                home = np.argmin(gap, axis=1)
                if first:
                    q, c = np.arange(len(x)), home
                else:
                    known = np.array(b.column(2).to_pylist(), float)
                    reach = np.einsum("ij,ij->i", x, x) + s.norm**2 - 2 * np.where(np.isnan(known), -np.inf, known)
                    wanted = gap <= s.limit * np.maximum(reach, 0)[:, None] * (1 + 1e-9) + 1e-12
                    wanted[np.arange(len(x)), home] = False
                    q, c = np.nonzero(wanted)
                for at in range(0, len(q), 4096):
                    yield pa.RecordBatch.from_arrays([pa.array(number[c[at : at + 4096]]), *(b.column(i).take(pa.array(q[at : at + 4096])) for i in range(3))], names=["cell", "query_key", "embedding", "known"])

        return run

    block_of = spark.createDataFrame([(int(c), int(p)) for c, p in parts.items()], "cell long, parts int")
    dealt = dealt.join(F.broadcast(block_of), "cell").select("cell", F.pmod(F.xxhash64("vec_id"), F.col("parts")).alias("part"), "vec_id", "embedding")

    def visit(asked: DataFrame, first: bool, name: str) -> DataFrame:
        sent = stage_table(asked.select("query_key", "embedding", "known").mapInArrow(route(first), f"cell long, query_key long, embedding {kind}, known double"), f"{name}-visits")
        counts = sent.groupBy("cell").agg(F.ceil(F.count("*") / CHUNK_ROWS).cast("int").alias("chunks"))  # at most one row per cell
        left = sent.join(F.broadcast(counts), "cell").join(F.broadcast(block_of), "cell").select("cell", F.explode(F.expr("sequence(0L, parts - 1L)")).alias("part"), F.pmod(F.xxhash64("query_key"), F.col("chunks")).alias("chunk"), "query_key", "embedding", "known")
        right = dealt.join(F.broadcast(counts), "cell").select("cell", "part", F.explode(F.expr("sequence(0L, chunks - 1L)")).alias("chunk"), "vec_id", "embedding")
        key = ["cell", "part", "chunk"]
        return stage_table(left.groupBy(key).cogroup(right.groupBy(key)).applyInArrow(_search(space, k + 1), _FOUND), f"{name}-found")

    def merged(found: DataFrame) -> DataFrame:
        """The k + 1 best of each query."""
        flat = found.select("query_key", F.explode(F.arrays_zip("vec_ids", "scores")).alias("x")).select("query_key", F.col("x.vec_ids").alias("vec_id"), F.col("x.scores").alias("score"))
        best = Window.partitionBy("query_key").orderBy(F.desc("score"), "vec_id")
        return flat.withColumn("at", F.row_number().over(best)).filter(F.col("at") <= k + 1)

    near = visit(queries.withColumn("known", F.lit(None).cast("double")), True, "ann-near")
    known = merged(near).groupBy("query_key").agg(F.min(F.when(F.col("at") == k + 1, F.col("score"))).alias("known"))
    far = visit(queries.join(known, "query_key", "left"), False, "ann-far")
    best = merged(near.unionByName(far)).groupBy("query_key").agg(F.sort_array(F.collect_list(F.struct("at", "vec_id", "score"))).alias("best"))
    whole = queries.join(best, "query_key").select("embedding", "best")
    others = F.slice(F.filter("best", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    flat = hot_join(asked.select(F.col("vec_id").alias("query_id"), "embedding"), whole, "embedding", "query_id").select("query_id", F.posexplode(others).alias("at", "x"))
    return flat.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), "x.vec_id", "x.score")


def op4_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every ``embeddings`` row whose vec_id is divisible by 20."""
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
