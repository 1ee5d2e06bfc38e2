"""Flows into managed resources routed through their providers, provider by provider, each seeing what the ones before it changed."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BooleanType, DataType, DoubleType, LongType, StringType, StructType

from factgraph.sources.storage import written

from .graph import at_hand, best_per_key
from .rewrites import section_key

#: A task takes so many pairs of provider and target, which are work rather than bytes.
PAIRS_PER_TASK = 1 << 15
#: Types of flows that start at the provider afterwards. Fixed values.
REWIRED = ("database_query", "api_call")
#: Confidence of flows to managed resources; floors of flows to providers and of rewired ones. Fixed values.
RESOURCE_FLOW, PROVIDER_FLOOR, REWIRED_FLOOR = 0.75, 0.72, 0.75


def _fits(a: Column, b: Column) -> Column:
    """Whether two section keys may be joined: one is none, or both are the same."""
    return (a == "") | (b == "") | (a == b)


def _chained(plan: DataFrame, turn: DataType, moves: bool, link: float, floor: float, rewired_floor: float) -> DataFrame:
    """What a target's links and rewired flows do from their places on, for rows of target, turns, entered (place, seq, confidence of the first flow that got there) and linked (providers that had a flow at first):
    for each place (from 1) the provider where a flow ends that starts there, whether that is another one, and whether a link is made there; and the hops, each from the first of those that make it.

    All that starts at a provider goes the same way, so that a target's hops are no more than its providers if links move (``moves``)."""
    out = StructType().add("target", StringType()).add("place", LongType()).add("provider", StringType()).add("end", StringType()).add("moved", BooleanType()).add("fresh", BooleanType())
    out = out.add("hop", StructType().add("source", StringType()).add("target", StringType()).add("confidence", DoubleType()).add("turn", turn).add("made", LongType()).add("seq", StringType()))
    arrow = to_arrow_schema(out)

    def chain(row: dict) -> Iterator[dict]:
        turns, linked, first = row["turns"], set(row["linked"] or ()), {e["place"] - 1: (0, e["seq"], e["confidence"]) for e in row["entered"] or ()}
        following, waiting = [None] * len(turns), []

        def fits(k: int, j: int) -> bool:
            a, b = turns[k], turns[j]
            return a["provider"] != b["provider"] and (not a["key"] or not b["key"] or a["key"] == b["key"])

        def hop(k: int, j: int, made: int, seq: str, confidence: float | None) -> dict:
            source = turns[k]["api"] if turns[j]["third"] and turns[k]["api"] is not None else turns[k]["provider"]
            return {"source": source, "target": turns[j]["provider"], "confidence": max(floor, floor if confidence is None else confidence), "turn": turns[j]["turn"], "made": made, "seq": seq}

        for j, t in enumerate(turns):
            if not t["direct"]:
                for k in [k for k in waiting if fits(k, j)]:
                    following[k] = j
                waiting = [k for k in waiting if following[k] is None]
            if t["open"]:
                waiting.append(j)
        end, fresh, seen = list(range(len(turns))), [], set()
        for k in reversed(range(len(turns))):
            end[k] = k if following[k] is None else end[following[k]]
        for t in turns:
            fresh.append(t["provider"] not in linked and t["provider"] not in seen)
            seen.add(t["provider"])
        for k, t in enumerate(turns):
            now, j = first.get(k), following[k]
            if fresh[k] and moves:
                now = min((x for x in (now, (k + 1, "", link)) if x), key=lambda x: x[:2])
            if now and j is not None:
                then = (*now[:2], max(rewired_floor, rewired_floor if now[2] is None else now[2]))
                first[j] = min((x for x in (first.get(j), then) if x), key=lambda x: x[:2])
            yield {"target": row["target"], "place": k + 1, "provider": t["provider"], "end": turns[end[k]]["provider"], "moved": end[k] != k, "fresh": fresh[k], "hop": hop(k, j, *now) if now and j is not None else None}
            if fresh[k] and not moves and t["open"]:
                for j in range(k + 1, len(turns)):
                    if not turns[j]["direct"] and fits(k, j):
                        yield {"target": row["target"], "hop": hop(k, j, k + 1, "", link)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: list[dict] = []
        for b in batches:
            for at in range(0, b.num_rows, 16):
                for row in b.slice(at, 16).to_pylist():
                    for x in chain(row):
                        made.append(x)
                        if len(made) == 4096:
                            yield pa.RecordBatch.from_pylist(made, schema=arrow)
                            made = []
        if made:
            yield pa.RecordBatch.from_pylist(made, schema=arrow)

    return plan.mapInArrow(run, out)


def route_in_order(flows: DataFrame, nodes: DataFrame, pairs: DataFrame, rewired: tuple[str, ...] = REWIRED, link: float = RESOURCE_FLOW, floor: float = PROVIDER_FLOOR, rewired_floor: float = REWIRED_FLOOR) -> DataFrame:
    """source, target, type, confidence, how of the flows (id, seq, source, target, type, confidence) after the pairs (turn, provider, target, direct) are taken in the order of ``turn`` (unique, as seq is).

    Nodes have id, seq, type, sub_type, section, address, main. A pair links the provider to its target, unless the two had a flow at first. Unless the target is accessed by a ``direct`` client, each flow into it
    from another known source, which isn't infrastructure code and fits the sections, adds an api_call to the provider from its source, or from the first api asset of that section if the source is a main asset, unless
    these two had a flow at first or got one before; its confidence is that of the flow then or ``floor``. Flows of ``rewired`` types start at the provider from then on, with a confidence of
    ``rewired_floor`` or more, and so the next provider sees them. Flows meet the array of their target's providers once; those into other targets are only read.
    """
    section, address = F.coalesce("section", F.lit("")), F.coalesce(F.trim("address"), F.lit(""))
    at = written(nodes.select("id", "seq", "type", "sub_type", section.alias("section"), section_key(section).alias("key"), (address == "").alias("open"), F.coalesce("main", F.lit(False)).alias("main")), "routing-nodes")
    api = best_per_key(at.filter("type = 'asset' and sub_type = 'api'"), [F.col("section")], [F.col("seq")]).select("section", F.col("id").alias("api"))
    second = at.filter("type = 'asset' and sub_type = 'api'").join(api, "section").filter("id <> api")
    second = best_per_key(second, [F.col("section")], [F.col("seq")]).select("section", F.col("id").alias("next_api"))  # an api asset doesn't stand for itself
    stand_in = F.when(F.col("main") & (F.col("type") == "asset"), F.when(F.col("api") == F.col("id"), F.col("next_api")).otherwise(F.col("api")))
    sources = written(at.join(at_hand(api), "section", "left").join(at_hand(second), "section", "left").select("id", "key", "open", F.coalesce(F.col("type") == "third_party", F.lit(False)).alias("third"), stand_in.alias("api")), "routing-sources")
    plan = pairs.join(sources.withColumnRenamed("id", "provider"), "provider").join(sources.select(F.col("id").alias("target"), F.col("key").alias("_to")), "target").filter(_fits(F.col("key"), F.col("_to")))
    turn = F.struct("turn", "provider", F.coalesce("direct", F.lit(True)).alias("direct"), "key", "open", "third", "api")
    plan = written(plan.groupBy("target").agg(F.array_sort(F.collect_list(turn)).alias("turns")), "routing-plan")

    now = written(flows.select(F.col("seq").cast("string").alias("seq"), "source", "target", "type", F.col("confidence").cast("double").alias("confidence")), "routing-flows")
    targets = plan.select("target")
    rest = now.join(at_hand(targets), "target", "left_anti").select("source", "target", "type", "confidence", F.lit("kept").alias("how"))
    own = now.join(at_hand(targets), "target", "left_semi").join(sources.select(F.col("id").alias("source"), "key", "open", "api").hint("shuffle_hash"), "source", "left")

    def routed(p: Column) -> Column:
        return F.coalesce(~p["direct"] & F.col("open") & (F.col("source") != p["provider"]) & _fits(F.col("key"), p["key"]), F.lit(False))

    def hop(p: Column) -> Column:
        return F.struct(F.coalesce(F.when(p["third"], F.col("api")), "source").alias("source"), p["provider"].alias("target"), F.greatest("confidence", F.lit(floor)).alias("confidence"), p["turn"].alias("turn"))

    # the providers of a target are many: flows meet them last, and what is written holds only the hops. A rewired flow makes one itself, and goes on as all do that start where it is then
    moves = F.col("type").isin(*rewired)
    tasks = plan.agg(F.coalesce(F.sum(F.size("turns")), F.lit(0))).first()[0] // PAIRS_PER_TASK + 1
    plan = plan.repartition(tasks, "target")
    own = own.repartition(tasks, "target").join(plan, "target").withColumn("hits", F.filter("turns", routed))
    own = own.withColumn("hits", F.when(moves, F.slice("hits", 1, 1)).otherwise(F.col("hits")))
    place = F.when(moves & (F.size("hits") > 0), F.array_position(F.transform("turns", lambda p: p["turn"]), F.col("hits")[0]["turn"]))
    linked = F.when(F.exists("turns", lambda p: p["provider"] == F.col("source")), F.col("source"))
    own = written(own.select("seq", "source", "target", "type", "confidence", place.alias("place"), linked.alias("linked"), F.transform("hits", hop).alias("hops")), "routing-met")

    moved = F.greatest("confidence", F.lit(rewired_floor))
    entered = own.filter("place is not null").groupBy("target", "place").agg(F.min_by(F.struct("seq", moved.alias("confidence")), "seq").alias("e"))
    entered = entered.groupBy("target").agg(F.collect_list(F.struct("place", "e.seq", "e.confidence")).alias("entered"))
    had = own.filter("linked is not null").groupBy("target").agg(F.collect_set("linked").alias("linked"))
    steps = written(_chained(plan.join(entered, "target", "left").join(had, "target", "left"), pairs.schema["turn"].dataType, "database_query" in rewired, link, floor, rewired_floor), "routing-steps")

    kept = own.filter("place is null").select("source", "target", "type", "confidence", F.lit("kept").alias("how"))
    went = own.filter("place is not null").select("target", "place", "type", moved.alias("confidence")).join(steps.select("target", "place", "end"), ["target", "place"]).select(F.col("end").alias("source"), "target", "type", "confidence", F.lit("rewired").alias("how"))
    # a link stands behind all flows that were there before it, and only later providers see it
    stays = ~F.col("moved") | F.lit("database_query" not in rewired)
    links = steps.filter("fresh").select(
        F.when(stays, F.col("provider")).otherwise(F.col("end")).alias("source"), "target", F.lit("database_query").alias("type"), F.when(stays, F.lit(link)).otherwise(F.lit(max(link, rewired_floor))).cast("double").alias("confidence"),
        F.when(stays, "provider_link").otherwise("rewired").alias("how"))
    hops = own.select("seq", F.explode("hops").alias("h")).select("h.source", "h.target", "h.confidence", F.struct("h.turn", F.lit(0).cast("long").alias("made"), "seq").alias("order"))
    hops = hops.unionByName(steps.filter("hop is not null").select("hop.source", "hop.target", "hop.confidence", F.struct("hop.turn", "hop.made", "hop.seq").alias("order")))
    providers = plan.select(F.explode("turns.provider").alias("target")).distinct()
    known = now.select("source", "target").join(at_hand(providers), "target", "left_semi")
    first = best_per_key(hops, [F.col("source"), F.col("target")], [F.col("order")]).join(known, ["source", "target"], "left_anti")
    out = rest.unionByName(kept).unionByName(went).unionByName(links)
    return out.unionByName(first.select("source", "target", F.lit("api_call").alias("type"), "confidence", F.lit("source_hop").alias("how")))
