"""Operators on directed graphs of components (id, type, sub_type, section) and flows (source, target, type, confidence)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def first_per_key(rows: DataFrame, keys: list, order: list[Column]) -> DataFrame:
    """The first row of each key in a total order."""
    return rows.withColumn("_at", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_at = 1").drop("_at")


#: Flows that an earlier pass made up have ids that begin so. A fixed value.
MADE_UP = "flow_fallback_"


def best_per_key(rows: DataFrame, keys: list[Column], order: list[Column]) -> DataFrame:
    """The least row of each key in a total order of ascending columns. Rows are reduced before they are shuffled."""
    best = rows.groupBy(*(k.alias(f"_k{i}") for i, k in enumerate(keys))).agg(F.min(F.struct(*(o.alias(f"_o{i}") for i, o in enumerate(order)), F.struct(*rows.columns).alias("_row"))).alias("_m"))
    return best.select("_m._row.*")


#: Mappings up to this many rows are broadcast to the flows; a task takes so many flows where they are brought together by their ends.
FEW, PER_TASK = 500_000, 1 << 20


def at_hand(rows: DataFrame) -> DataFrame:
    """``rows`` as the right side of a join with many more: broadcast if they are few, else a hash table per task; neither side is sorted."""
    return F.broadcast(rows) if rows.limit(FEW + 1).count() <= FEW else rows.hint("shuffle_hash")


def tasks_for(rows: DataFrame) -> int:
    """The tasks that ``rows`` need so that each can sort its share in memory."""
    return -(-rows.count() // PER_TASK)


def earliest_per_key(rows: DataFrame, keys: list[str], seq: list[str], tasks: int = 1) -> DataFrame:
    """The row of each key that is first by ``seq``. With several ``tasks`` rows are moved to so many and each is sorted once there."""
    rest = [c for c in rows.columns if c not in (*keys, *seq)]
    dealt = rows.repartition(tasks, *keys) if tasks > 1 else rows
    return dealt.groupBy(*keys).agg(F.min(F.struct(*seq, *rest)).alias("_m")).select(*keys, "_m.*").select(rows.columns)


def _preference(flows: DataFrame, seq: list[str]) -> list[Column]:
    """Detected flows before made-up ones, then the more confident, then the earlier."""
    made_up = F.col("id").startswith(MADE_UP) if "id" in flows.columns else F.lit(False)
    return [made_up, -F.col("confidence"), *map(F.col, seq)]


def dedupe_directed(flows: DataFrame, seq: list[str]) -> DataFrame:
    """One flow per (source, target), whatever its type: detected before made up, higher confidence first, then the earlier."""
    return best_per_key(flows, [F.col("source"), F.col("target")], _preference(flows, seq))


def dedupe_undirected(flows: DataFrame, seq: list[str]) -> DataFrame:
    """One flow per unordered pair, with the same preference."""
    return best_per_key(flows, [F.least("source", "target"), F.greatest("source", "target")], _preference(flows, seq))


def dedupe_typed(flows: DataFrame, seq: list[str]) -> DataFrame:
    """The earliest flow per (source, target, type), without self-loops."""
    return earliest_per_key(flows.filter("source <> target"), ["source", "target", "type"], seq, tasks_for(flows))


def with_ends(flows: DataFrame, components: DataFrame, more: tuple[str, ...] = ()) -> DataFrame:
    """Flows whose ends both exist, with type and section of source and target, and what ``more`` names of their columns."""
    def end(name: str) -> DataFrame:
        own = components.select(F.col("id").alias(name), F.col("type").alias(f"{name}_type"), F.col("section").alias(f"{name}_section"), *(F.col(c).alias(f"{name}_{c}") for c in more))
        return own.hint("shuffle_hash")  # the flows aren't sorted, so nothing of them spills

    return flows.join(end("source"), "source").join(end("target"), "target")


def reverse_to_actors(flows: DataFrame, components: DataFrame, floor: float = 0.8) -> DataFrame:
    """Flows from assets to actors turned round, their confidence raised to ``floor``."""
    turned = (F.col("source_type") == "asset") & (F.col("target_type") == "actor")
    return with_ends(flows, components).select(
        "id", F.when(turned, F.col("target")).otherwise(F.col("source")).alias("source"), F.when(turned, F.col("source")).otherwise(F.col("target")).alias("target"),
        "type", F.when(turned, F.greatest("confidence", F.lit(floor))).otherwise(F.col("confidence")).alias("confidence"),
    )


def classify(flows: DataFrame, components: DataFrame, more: tuple[str, ...] = ()) -> DataFrame:
    """Flows with their crossing: outbound_third_party (not from a third party), from_actor or internal."""
    crossing = F.when((F.col("target_type") == "third_party") & (F.col("source_type") != "third_party"), "outbound_third_party").when(F.col("source_type") == "actor", "from_actor").otherwise("internal")
    return with_ends(flows, components, more).withColumn("crossing", crossing)


def cross_section(flows: DataFrame, components: DataFrame) -> DataFrame:
    """Flows without an actor whose ends are in different sections."""
    return with_ends(flows, components).filter("source_type <> 'actor' and target_type <> 'actor' and source_section <> '' and target_section <> '' and source_section <> target_section")


def hubs(components: DataFrame) -> DataFrame:
    return components.filter("type = 'asset' and sub_type = 'application'")


def sections_without_hub(components: DataFrame) -> DataFrame:
    """Sections of which no component is a hub."""
    return components.select("section").distinct().join(hubs(components).select("section"), "section", "left_anti")


def insert_hubs(components: DataFrame) -> DataFrame:
    """id, section, how: the first eligible asset of each section without a hub is promoted, else a hub is made up."""
    missing = sections_without_hub(components)
    eligible = first_per_key(components.filter("type = 'asset' and sub_type in ('application', 'service', 'api', '')"), ["section"], [F.col("id")]).select("section", "id")
    return missing.join(eligible, "section", "left").select(F.coalesce("id", F.concat(F.lit("hub:"), "section")).alias("id"), "section", F.when(F.col("id").isNull(), "inserted").otherwise("promoted").alias("how"))


def orphans(components: DataFrame, flows: DataFrame) -> DataFrame:
    """Third parties into which no flow comes from their own section."""
    own = with_ends(flows, components).filter("target_type = 'third_party' and source_section = target_section").select(F.col("target").alias("id"))
    return components.filter("type = 'third_party'").join(own, "id", "left_anti")


def attach_orphans(components: DataFrame, flows: DataFrame, confidence: float = 0.6) -> DataFrame:
    """source, target, confidence: new flows from a section's first hub to its orphans."""
    hub = first_per_key(hubs(components), ["section"], [F.col("id")]).select("section", F.col("id").alias("source"))
    new = orphans(components, flows).join(hub, "section").select("source", F.col("id").alias("target"), F.lit(confidence).alias("confidence"))
    return new.join(flows.select("source", "target"), ["source", "target"], "left_anti")


def red_flags(components: DataFrame, flows: DataFrame) -> DataFrame:
    """code, subject: components without flows, sections without a hub, third parties without a flow from their section. The
    flows are reduced to distinct pairs once; one join per end then gives every component its flags."""
    pairs = flows.select("source", "target").distinct()
    section = components.select(F.col("id").alias("source"), F.col("section").alias("from_section"))
    ends = pairs.join(section, "source", "left").select(F.explode(F.array(F.struct(F.col("source").alias("id"), F.lit(None).cast("string").alias("from_section")), F.struct(F.col("target").alias("id"), "from_section"))).alias("e")).select("e.*").distinct()
    seen = components.join(ends, "id", "left")
    touched = ends.select("id").distinct()
    alone = components.join(touched, "id", "left_anti").select(F.lit("isolated_component").alias("code"), F.col("id").alias("subject"))
    fed = seen.filter("type = 'third_party'").groupBy("id").agg(F.coalesce(F.bool_or(F.col("from_section") == F.col("section")), F.lit(False)).alias("fed"))
    no_hub = sections_without_hub(components).select(F.lit("section_without_hub").alias("code"), F.col("section").alias("subject"))
    return alone.unionByName(no_hub).unionByName(fed.filter("not fed").select(F.lit("orphan_third_party").alias("code"), F.col("id").alias("subject")))


def neighbourhood(flows: DataFrame, seeds: DataFrame) -> DataFrame:
    """seed, id: the vertices one step from each seed, either way, and the seed itself."""
    ways = flows.select(F.col("source").alias("seed"), F.col("target").alias("id")).unionByName(flows.select(F.col("target").alias("seed"), F.col("source").alias("id")))
    return ways.join(seeds, "seed", "left_semi").unionByName(seeds.select("seed", F.col("seed").alias("id"))).distinct()


def neighbourhood_edges(flows: DataFrame, seeds: DataFrame) -> DataFrame:
    """seed, id: the flows that touch each seed or a vertex one step from it."""
    near = neighbourhood(flows, seeds).withColumnRenamed("id", "end")
    ends = flows.select("id", F.explode(F.array("source", "target")).alias("end"))
    return ends.join(near, "end").select("seed", "id").distinct()


def drop_and_rewire(flows: DataFrame, components: DataFrame, gone: DataFrame, seq: list[str]) -> DataFrame:
    """Flows after the vertices ``gone`` (id) are removed: flows into them go, flows out of them start at the hub of their
    section instead, or at the first hub of all where it has none (without any hub they go too); self-loops go and the earliest
    of equal flows stays."""
    hub = first_per_key(hubs(components), ["section"], [F.col("id")]).select("section", F.col("id").alias("hub"))
    any_hub = hubs(components).agg(F.min("id")).first()[0]
    moved = components.join(gone, "id", "left_semi").join(hub, "section", "left").select(F.col("id").alias("source"), F.coalesce("hub", F.lit(any_hub)).alias("hub"), F.lit(True).alias("moved"))
    kept = flows.join(at_hand(gone.select(F.col("id").alias("target"))), "target", "left_anti").join(at_hand(moved), "source", "left").filter("moved is null or hub is not null")
    kept = kept.withColumn("source", F.coalesce("hub", "source")).drop("hub", "moved").filter("source <> target")
    return earliest_per_key(kept, ["source", "target", "type"], seq, tasks_for(flows))


def contract(flows: DataFrame, mapping: DataFrame, seq: list[str]) -> DataFrame:
    """Flows after vertices are merged by ``mapping`` (id, into); self-loops go and the earliest of equal flows stays."""
    out = flows
    for end in ("source", "target"):
        out = out.join(at_hand(mapping.select(F.col("id").alias(end), F.col("into").alias("_into"))), end, "left").withColumn(end, F.coalesce("_into", end)).drop("_into")
    return earliest_per_key(out.filter("source <> target"), ["source", "target", "type"], seq, tasks_for(flows))
