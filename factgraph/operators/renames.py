"""Renamed files between two snapshots: similarity by chunks of content and a best one-to-one assignment.

Files of equal content are one class, so many copies make no pairs. Candidates share a chunk among their rarest: of each content only so many chunks, those that make the fewest pairs first, are
looked up that what is left couldn't make it similar enough by itself. Chunks that only one snapshot has are counted but go no further. Groups that no candidate joins are
assigned apart: a group's pairs pass one after the other, the most similar first, since of equally similar ones only the first can be taken at a time. A group's pairs are sorted by Spark and pass
through one task as a stream, so it holds no more than a number for each content of the group.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from factgraph.sources.storage import written

#: Two files are a rename from this similarity on. A fixed value.
LEAST = 0.5
#: A chunk is a line with its end, or 64 characters of a longer one. A fixed value.
CHUNK = r"[^\n]{0,63}\n|[^\n]{1,64}"


def _classes(files: DataFrame) -> DataFrame:
    """hash, n, name (the least path), size of each different content but the empty one."""
    return files.filter("content <> ''").groupBy(F.md5(F.col("content").cast("binary")).alias("hash")).agg(F.count("*").alias("n"), F.min("path").alias("name"), F.max(F.length("content")).alias("size"))


def similarities(gone: DataFrame, come: DataFrame, least: float = LEAST) -> DataFrame:
    """s, d, score of the different contents (hash, name, size) of ``gone`` and ``come`` (path, content) whose chunks in common make up ``least`` of the larger or more; 1 for equal ones."""
    sides = gone.select("path", "content", F.lit(1).alias("old")).unionByName(come.select("path", "content", F.lit(0).alias("old"))).filter("content <> ''")
    named = sides.groupBy(F.md5(F.col("content").cast("binary")).alias("hash")).agg(F.min("path").alias("path"), F.max(F.length("content")).cast("long").alias("size"), F.max("old").alias("old"), F.max(1 - F.col("old")).alias("new"))
    classes = written(named.withColumn("id", F.monotonically_increasing_id()), "rename-classes")
    texts = sides.select("path", "content").join(classes.select("id", "path", "old", "new"), "path").dropDuplicates(["id"])
    chunks = texts.select("id", "old", "new", F.explode(F.regexp_extract_all("content", F.lit(CHUNK), F.lit(0))).alias("chunk"))
    counted = chunks.groupBy("id", "old", "new", F.unhex(F.md5(F.col("chunk").cast("binary"))).alias("chunk")).agg((F.count("*") * F.max(F.length("chunk"))).alias("weight"))
    counted = written(counted, "rename-chunks")
    # chunks that only one side holds come first in the order and pair nothing, so that they can go
    ways = counted.groupBy("chunk").agg((F.sum("old") * F.sum("new")).alias("ways")).filter("ways > 0")
    turn = Window.partitionBy("id").orderBy("ways", "chunk").rowsBetween(0, Window.unboundedFollowing)
    held = written(counted.join(ways, "chunk").withColumn("rest", F.sum("weight").over(turn)).select("id", "old", "new", "chunk", "weight", "rest"), "rename-shared")
    ahead = held.join(classes.select("id", "size"), "id").filter(F.col("rest") >= F.lit(least) * F.col("size"))

    def side(flag: str, name: str) -> DataFrame:
        return ahead.filter(F.col(flag) == 1).select("chunk", F.col("id").alias(name), F.col("size").alias(f"{name}_size"), F.col("rest").alias(f"{name}_rest"))

    # where two contents first share a chunk, what is left of each holds all that they share
    larger = F.greatest("s_size", "d_size")
    fits = F.least("s_rest", "d_rest") >= F.lit(least) * larger
    pairs = written(side("old", "s").join(side("new", "d"), "chunk").filter(fits & (F.col("s") != F.col("d"))).select("s", "d", "s_size", "d_size").distinct(), "rename-pairs")
    own, other = held.filter("old = 1").select(F.col("id").alias("s"), "chunk", "weight"), held.filter("new = 1").select(F.col("id").alias("d"), "chunk", F.col("weight").alias("_weight"))
    common = pairs.join(own, "s").join(other, ["d", "chunk"]).groupBy("s", "d", "s_size", "d_size").agg(F.sum(F.least("weight", "_weight")).alias("common"))
    scored = common.withColumn("score", F.col("common") / larger).filter(F.col("score") >= least).select("s", "d", "score")
    for x in ("s", "d"):
        scored = scored.join(classes.select(F.col("id").alias(x), F.col("hash").alias(f"_{x}")), x)
    scored = scored.select(F.col("_s").alias("s"), F.col("_d").alias("d"), "score")
    return scored.unionByName(classes.filter("old = 1 and new = 1").select(F.col("hash").alias("s"), F.col("hash").alias("d"), F.lit(1.0).alias("score")))


def _grouped(edges: DataFrame) -> DataFrame:
    """node, root: the least of all nodes that the edges (s, d) join it with, for all but the least, by alternating steps that join neighbours with the least of them."""
    pairs = written(edges.select(F.greatest("s", "d").alias("a"), F.least("s", "d").alias("b")).filter("a <> b").distinct(), "rename-groups")

    def mark(rows: DataFrame) -> tuple:
        return tuple(rows.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    now, before = mark(pairs), None
    while now[0] and now != before:
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = both.join(least, "a").filter("b > a and b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        pairs = written(small.unionByName(low.select("a", F.col("m").alias("b"))).distinct(), "rename-groups")
        now, before = mark(pairs), now
    return pairs.select(F.col("a").alias("node"), F.col("b").alias("root"))


def _taken(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What is taken of edges (root, s, d, score, s_n, d_n) that come sorted, group by group; the copies that a group's contents have left are all that is held."""
    at, turn, left = None, 0, {}
    for batch in batches:
        out = []
        for root, s, d, score, s_n, d_n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if root != at:
                at, turn, left = root, 0, {}
            m = min(left.get(("s", s), s_n), left.get(("d", d), d_n))
            if m > 0:
                left["s", s], left["d", d] = left.get(("s", s), s_n) - m, left.get(("d", d), d_n) - m
                out.append((turn, s, d, m, score))
                turn += 1
        columns = list(zip(*out, strict=True)) or [()] * len(_TAKEN)
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, _TAKEN.types, strict=True)], schema=_TAKEN)


_TAKEN = pa.schema([("round", pa.int64()), ("s", pa.string()), ("d", pa.string()), ("m", pa.int64()), ("score", pa.float64())])


def assigned(edges: DataFrame) -> DataFrame:
    """round, s, d, m, score for edges (s, d, score, s_name, d_name, s_n, d_n): the pairs that are taken from the highest score down (ties: names), each ``m`` times, as often as both have copies left;
    rounds count the pairs of a group in that order."""
    edges = written(edges, "rename-edges")
    rooted = edges.join(_grouped(edges).withColumnRenamed("node", "s"), "s", "left").withColumn("root", F.coalesce("root", "s"))
    ordered = rooted.repartition("root").sortWithinPartitions("root", F.desc("score"), "s_name", "d_name")
    return ordered.select("root", "s", "d", "score", "s_n", "d_n").mapInArrow(_taken, "round long, s string, d string, m long, score double")


def detected_renames(base: DataFrame, head: DataFrame, least: float = LEAST) -> DataFrame:
    """from, to, similarity of the files (path, content; distinct paths) that only ``base`` has and those that only ``head`` has: one to one, the most similar first, ties by
    the least paths of equal contents, whose files are taken by path. Empty and null contents are never renames. Similarities are compared as fractions of characters."""
    gone, come = base.join(head.select("path"), "path", "left_anti").select("path", "content"), head.join(base.select("path"), "path", "left_anti").select("path", "content")
    gone, come = written(gone, "rename-gone"), written(come, "rename-come")
    old, new = (_classes(f).select(F.col("hash").alias(x), F.col("name").alias(f"{x}_name"), F.col("n").alias(f"{x}_n")) for f, x in ((gone, "s"), (come, "d")))
    taken = written(assigned(similarities(gone, come, least).join(old, "s").join(new, "d")), "rename-picks")
    each = taken.select("*", *(F.coalesce(F.sum("m").over(Window.partitionBy(x).orderBy("round").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(f"{x}_first") for x in ("s", "d")))
    each = each.select("s", "d", "score", "s_first", "d_first", F.explode(F.sequence(F.lit(1).cast("long"), F.col("m"))).alias("k"))

    def ranked(files: DataFrame, x: str, name: str) -> DataFrame:
        hashed = files.filter("content <> ''").select(F.md5(F.col("content").cast("binary")).alias(x), F.col("path").alias(name))
        return hashed.withColumn(f"{x}_at", F.row_number().over(Window.partitionBy(x).orderBy(name)).cast("long"))

    pairs = each.select("s", "d", "score", (F.col("s_first") + F.col("k")).alias("s_at"), (F.col("d_first") + F.col("k")).alias("d_at"))
    return pairs.join(ranked(gone, "s", "from"), ["s", "s_at"]).join(ranked(come, "d", "to"), ["d", "d_at"]).select("from", "to", F.col("score").alias("similarity"))
