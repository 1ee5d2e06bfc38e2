"""Lineage of ids through merges: where an id ends after all merges that followed it.

A merge is a pointer from an old id to a new one. Pointers are composed by pointer jumping: in each round every pointer takes over that of what
it points to, so a chain of n merges takes log2(n) rounds, each a join and a written table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from factgraph.sources.storage import written

#: Keys with more rows than this share of a table are dealt over several tasks in joins.
HOT_SHARE = 1 / 1024


def dealt_join(left: DataFrame, right: DataFrame, key: str, by: str, how: str = "inner") -> DataFrame:
    """``left`` joined with ``right``, which has distinct keys. A hot key's rows are dealt by a hash of ``by``; its row of ``right`` is repeated for each part."""
    most = max(1.0, left.count() * HOT_SHARE)
    hot = left.groupBy(key).agg(F.count("*").alias("_n")).filter(F.col("_n") > most).select(key, F.ceil(F.col("_n") / most).alias("_parts"))
    hot, parts = F.broadcast(hot), F.coalesce("_parts", F.lit(1))  # fewer than 1 / HOT_SHARE rows
    x = left.join(hot, key, "left").withColumn("_part", F.pmod(F.xxhash64(by), parts)).drop("_parts")
    y = right.join(hot, key, "left").withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1))).drop("_parts")
    return x.join(y.hint("merge"), [key, "_part"], how).drop("_part")  # a broadcast would send the table through the driver in each round


def key_remap(before: DataFrame, after: DataFrame) -> DataFrame:
    """id, final: of the third parties (id, type, key) of ``before`` those whose key one of ``after`` (id, type, key, seq) has too, with that one's id (of equal keys the latest)."""
    final = after.filter("type = 'third_party' and key is not null").groupBy("key").agg(F.max_by("id", F.struct("seq", "id")).alias("final"))
    return dealt_join(before.filter("type = 'third_party' and key is not null").select("id", "key"), final, "key", "id").select("id", "final")


def remapped(rows: DataFrame, remap: DataFrame, column: str = "target") -> DataFrame:
    """``rows`` whose ``column`` follows the remap (id, final; distinct ids); ids that it doesn't name stay."""
    rows = rows.withColumn("_row", F.monotonically_increasing_id())
    return dealt_join(rows, remap.select(F.col("id").alias(column), F.col("final").alias("_final")), column, "_row", "left").withColumn(column, F.coalesce("_final", column)).select(*rows.columns).drop("_row")


def _jumped(pointers: DataFrame) -> DataFrame:
    """One round over pointers (node, to, hops, open): an open one takes over what its target points to."""
    ahead = pointers.select(F.col("node").alias("to"), F.col("to").alias("_to"), F.col("hops").alias("_hops"), F.col("open").alias("_open"))
    moved = dealt_join(pointers.filter("open"), ahead, "to", "node", "left")
    moved = moved.select("node", F.coalesce("_to", "to").alias("to"), (F.col("hops") + F.coalesce("_hops", F.lit(0))).alias("hops"), F.coalesce("_open", F.lit(False)).alias("open"))
    return written(pointers.filter("not open").unionByName(moved), "lineage")


def final_ids(merges: DataFrame) -> DataFrame:
    """old, final, hops, cyclic for merges (old, new) without an order. Of several merges of one id the one with the greatest ``new`` holds. Ids that lead
    into a cycle are ``cyclic``: their final id is the cycle's least, and hops are null. A merge of an id with itself is none; nulls are ignored."""
    edges = merges.filter("old is not null and new is not null and old <> new").groupBy("old").agg(F.max("new").alias("new"))
    pointers = edges.select(F.col("old").alias("node"), F.col("new").alias("to"), F.lit(1).cast("long").alias("hops"))
    starts = pointers.select(F.col("node").alias("to"), F.lit(True).alias("_more"))
    pointers = written(dealt_join(pointers, starts, "to", "node", "left").select("node", "to", "hops", F.coalesce("_more", F.lit(False)).alias("open")), "lineage")
    left = pointers.filter("open").count()
    while left:
        pointers = _jumped(pointers)
        left, before = pointers.filter("open").count(), left
        if left == before:  # in each round some id that can end does: those that are left lead into cycles
            break
    ended = pointers.filter("not open").select(F.col("node").alias("old"), F.col("to").alias("final"), "hops", F.lit(False).alias("cyclic"))
    if not left:
        return ended
    rest, held, before = written(pointers.filter("open").select("node", "to"), "lineage-rest"), left, None
    while held != before:  # once a round leaves as many targets as before, all of them lie on cycles
        ahead = rest.select(F.col("node").alias("to"), F.col("to").alias("_to"))
        rest = written(dealt_join(rest, ahead, "to", "node").select("node", F.col("_to").alias("to")), "lineage-rest")
        held, before = rest.select("to").distinct().count(), held
    ring = rest.select(F.col("to").alias("node")).distinct()
    least = written(edges.withColumnsRenamed({"old": "node", "new": "to"}).join(ring, "node", "left_semi").withColumn("least", F.least("node", "to")), "lineage-ring")
    moved = True
    while moved:  # a ring's pointers are one to one: no key is hot; once a round lowers none, each has its ring's least
        ahead = least.select(F.col("node").alias("to"), F.col("to").alias("_to"), F.col("least").alias("_least"))
        least = written(least.join(ahead.hint("merge"), "to").select("node", F.col("_to").alias("to"), F.least("least", "_least").alias("least"), (F.col("_least") < F.col("least")).alias("moved")), "lineage-ring")
        moved = not least.filter("moved").isEmpty()
    looped = dealt_join(rest, least.select(F.col("node").alias("to"), "least"), "to", "node").select(F.col("node").alias("old"), F.col("least").alias("final"), F.lit(None).cast("long").alias("hops"), F.lit(True).alias("cyclic"))
    return ended.unionByName(looped)


def lineage(merges: DataFrame) -> DataFrame:
    """id, step, final, hops for merges (step, old, new): where an id that a merge renames at ``step`` ends after that and all later steps. All merges of a step
    apply at once, so two ids may change places. Of several merges of one id in a step the one with the greatest ``new`` holds; nulls are
    ignored. An id that comes back at a later step is followed from there on: by steps there are no cycles."""
    once = merges.filter("step is not null and old is not null and new is not null").groupBy("step", "old").agg(F.max("new").alias("new"))
    # the next merge of an id after a step: both kinds of rows are distinct, so an id has at most two for each step
    asked = once.select(F.col("new").alias("id"), "step").distinct().withColumn("at", F.lit(None).cast("long"))
    moves = once.select(F.col("old").alias("id"), "step", F.col("step").cast("long").alias("at"))
    later = Window.partitionBy("id").orderBy("step").rangeBetween(1, Window.unboundedFollowing)
    following = asked.unionByName(moves).withColumn("next", F.min("at").over(later)).filter("at is null").select(F.col("id").alias("new"), "step", "next")
    once, following = written(once, "lineage-merges"), written(following, "lineage-following")
    pair = dealt_join(once.withColumn("_k", F.struct("new", "step")), following.select(F.struct("new", "step").alias("_k"), "next"), "_k", "old")
    node = F.struct(F.col("old").alias("id"), F.col("step").cast("long").alias("step"))
    to = F.struct(F.col("new").alias("id"), F.col("next").alias("step"))
    pointers = written(pair.select(node.alias("node"), to.alias("to"), F.lit(1).cast("long").alias("hops"), F.col("next").isNotNull().alias("open")), "lineage")
    while pointers.filter("open").limit(1).count():
        pointers = _jumped(pointers)
    return pointers.select("node.id", "node.step", F.col("to.id").alias("final"), "hops")
