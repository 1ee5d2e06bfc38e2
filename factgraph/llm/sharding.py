"""Sharding: vector bin packing that balances bytes, tokens and rows jointly.

Every group (equal texts) goes whole to the shard where the dot product of its (bytes, tokens, rows) with the shard's
residual capacity is highest, heaviest groups first. Only a group of more than CUT_SHARE of a shard is cut, evenly over all:
whole, many short copies would fill a shard's rows long before its bytes. Groups above a fixed share of a shard are few at any size of the table (see HEAVY_SHARE) and are packed
together; all others are dealt by hash to tasks, each of which packs its groups into its part of the capacity that the
heavy ones left. A task's shards end about one small group apart, and so does their sum.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import stage_table

#: Groups above this share of a shard in any dimension are packed first, all together: at most 3 x n_shards / HEAVY_SHARE.
HEAVY_SHARE = 1 / 1024
#: Groups above this share of a shard in any dimension are cut, if they have several rows.
CUT_SHARE = 1 / 4
#: Rows of other groups that one task packs, on average.
TASK_ROWS = 20_000
#: Rows among which a task numbers slots, on average.
SLOT_ROWS = 10_000
_GROUP = ["key", "size", "text_crc32"]


def pack(loads: np.ndarray, residual: np.ndarray) -> np.ndarray:
    """The bin of each row of ``loads`` (items x dimensions). Items go heaviest first to the bin with the highest dot
    product of the item's vector and the bin's residual capacity (bins x dimensions), both as shares of a bin; ties go to
    the lower bin. What the bins get is taken from ``residual``."""
    out = np.zeros(len(loads), dtype=int)
    for i in np.lexsort((np.arange(len(loads)), -loads.max(axis=1))) if len(loads) else ():
        out[i] = b = int(np.argmax(residual @ loads[i]))
        residual[b] -= loads[i]
    return out


def _pack_part(capacity: np.ndarray, residual: np.ndarray, light: np.ndarray) -> Callable[[pa.Table], pa.Table]:
    """Packs the rows of one task, group by group, into its part of ``residual``: its share of all ``light`` loads."""

    def run(table: pa.Table) -> pa.Table:
        at: dict[tuple, int] = {}
        group = np.array([at.setdefault(g, len(at)) for g in zip(*(table[c].to_pylist() for c in _GROUP), strict=True)], int)
        size, tokens = (table[c].to_numpy().astype(float) for c in ("size", "tokens"))
        loads = np.column_stack([np.bincount(group, size, len(at)), np.bincount(group, tokens, len(at)), np.bincount(group, minlength=len(at))])
        bins = pack(loads / capacity, residual * (loads.sum(axis=0) / np.maximum(light, 1e-12)))
        return table.select(["doc_id", "size", "text_crc32", "tag"]).append_column("shard", pa.array(bins[group].astype(np.int32)))

    return run


def shard_documents(docs: DataFrame, n_shards: int = 8, heavy_share: float = HEAVY_SHARE, task_rows: int = TASK_ROWS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row of ``docs``; the law is ``bytes``.

    Size is the text's UTF-8 bytes plus 1; a null text counts as empty. Equal texts stay together unless they outweigh
    CUT_SHARE of a shard: then their rows are dealt evenly over n_shards parts (a single row is never cut). Slots count from 0
    in each shard without a gap. Repeated rows, also with null ids, are rows of their own. An empty table gives an empty
    result. Other columns of ``docs`` are not read.
    """
    spark, text = docs.sparkSession, F.coalesce(F.col("text"), F.lit(""))
    rows = stage_table(
        docs.select(
            "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
            F.regexp_count(text, F.lit(r"\S+")).cast("long").alias("tokens"), F.xxhash64(text).alias("key"), F.monotonically_increasing_id().alias("tag"),
        ),
        "shard-rows",
    )
    dims = {"bytes": F.sum("size"), "tokens": F.sum("tokens"), "rows": F.count("*")}
    sums = [f.alias(d) for d, f in dims.items()]
    total = np.array([x or 0 for x in rows.agg(*sums).first()], float)
    capacity = np.maximum(total / n_shards, 1e-12)
    worst = F.greatest(*(F.col(d) / F.lit(float(c)) for d, c in zip(dims, capacity, strict=True)))
    groups = rows.groupBy(*_GROUP).agg(*sums).select(*_GROUP, "rows", worst.alias("worst"))
    heavy = stage_table(groups.filter(F.col("worst") > heavy_share).select(*_GROUP, F.when(F.col("worst") > CUT_SHARE, F.least(F.lit(n_shards), F.col("rows"))).otherwise(1).cast("long").alias("parts")), "shard-heavy")
    # F.broadcast: at most 3 * n_shards / heavy_share rows
    marked = rows.join(F.broadcast(heavy), _GROUP, "left").withColumn("part", F.pmod(F.xxhash64("tag"), F.col("parts")))
    large = marked.filter("parts is not null")
    loads = large.groupBy(*_GROUP, "part").agg(*sums).orderBy(*_GROUP, "part").collect()  # bounded likewise
    residual = np.ones((n_shards, 3))
    bins = pack(np.array([[r[d] for d in dims] for r in loads], float).reshape(-1, 3) / capacity, residual)
    placed = spark.createDataFrame([(*(r[c] for c in _GROUP), r["part"], int(b)) for r, b in zip(loads, bins, strict=True)], "key long, size long, text_crc32 long, part long, shard int")
    columns = ["doc_id", "size", "text_crc32", "tag", "shard"]
    first = large.join(F.broadcast(placed), [*_GROUP, "part"]).select(columns)

    small = marked.filter("parts is null")
    light = total - np.array([[r[d] for d in dims] for r in loads], float).reshape(-1, 3).sum(axis=0)
    tasks = max(1, math.ceil(light[2] / task_rows))
    dealt = small.select("doc_id", *_GROUP, "tokens", "tag", F.pmod("key", F.lit(tasks)).alias("task"))
    rest = dealt.groupBy("task").applyInArrow(_pack_part(capacity, residual, light), "doc_id long, size long, text_crc32 long, tag long, shard int")
    return _with_slots(stage_table(first.unionByName(rest), "shard-placed"), int(total[2]))


def _with_slots(placed: DataFrame, n: int) -> DataFrame:
    """Slots are numbered in parts of a shard, by a hash of the row; a part's first slot follows the parts before it."""
    dealt = placed.withColumn("part", F.pmod(F.xxhash64("tag"), F.lit(max(1, math.ceil(n / SLOT_ROWS)))))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy("shard", "part").agg(F.count("*").alias("n")).select("shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    order = Window.partitionBy("shard", "part").orderBy("doc_id", "tag")
    numbered = dealt.withColumn("at", F.row_number().over(order)).join(starts, ["shard", "part"])
    return numbered.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("start") + F.col("at") - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` in shards 0 to 7."""
    return shard_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
