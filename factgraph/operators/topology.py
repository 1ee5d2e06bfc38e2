"""Operators on paths and topology: sections, containers, fuzzy path matches, closures, managed nodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factgraph.functions import scalars
from factgraph.sources.storage import written

from .graph import first_per_key, hubs


def sections(files: DataFrame, manifests: DataFrame) -> DataFrame:
    """path, section: the nearest folder above each file that holds a manifest (path), else ``root``. Folders are matched by
    equality on each of a path's ancestors, so no pair of a file and a foreign folder is made."""
    folders = manifests.select(scalars.dirname(F.col("path")).alias("section")).filter("section <> ''").distinct()
    up = files.select("path", F.explode(scalars.ancestors(F.col("path"))).alias("section"))
    found = up.join(folders, "section").groupBy("path").agg(F.max(F.struct(F.length("section").alias("n"), "section")).getField("section").alias("section"))
    return files.select("path").join(found, "path", "left").select("path", F.coalesce("section", F.lit("root")).alias("section"))


def containers(assets: DataFrame, most: int = 2) -> DataFrame:
    """id, container of assets (id, path, sub_type): the path's folder at one depth for all, which is a level deeper, at most
    twice, while all assets lie deeper and share the segment there; the subtype where there is no folder. Hidden, dist and
    node_modules folders at the start don't count. The depth is found
    by one aggregation of counts."""
    path = F.regexp_replace(scalars.posix_path(F.coalesce("path", F.lit(""))), r"^/?((\.[^/]*|node_modules|dist)/)+", "")
    clean = F.filter(F.split(path, "/"), lambda s: s != "")
    folders = F.when(F.size(clean) > 1, F.slice(clean, F.lit(1), F.greatest(F.size(clean) - 1, F.lit(1)))).otherwise(F.array().cast("array<string>"))
    rows = assets.withColumn("_parts", folders)
    seen = rows.agg(*(F.min(F.size("_parts") > d + 1).alias(f"deep{d}") for d in range(most)), *(F.min(F.get("_parts", F.lit(d))).alias(f"low{d}") for d in range(most)), *(F.max(F.get("_parts", F.lit(d))).alias(f"high{d}") for d in range(most))).first()
    depth = 0
    while depth < most and seen[f"deep{depth}"] and seen[f"low{depth}"] == seen[f"high{depth}"]:
        depth += 1
    segment = F.get("_parts", F.least(F.lit(depth), F.size("_parts") - 1))
    kind = F.coalesce(F.nullif("sub_type", F.lit("")), F.lit("asset"))
    key = F.when(F.size("_parts") > 0, F.concat(F.lit("ctn_"), scalars.container_key(segment))).otherwise(F.concat(F.lit("ctn_kind_"), scalars.container_key(kind)))
    return rows.select("id", key.alias("container"))


def match_paths(wanted: DataFrame, paths: DataFrame) -> DataFrame:
    """wanted, tier, path, n: what each wanted path may mean. Tier 1 are equal paths, 2 those of which one ends in the other
    after a slash, 3 equal base names; the best tier counts, with its least path and the number of paths. Each tier is an
    equality join on keys that are aggregated first, so a common name makes one row."""
    want, have = wanted.select("wanted").distinct(), paths.select("path").distinct()

    def keyed(key: Column, tier: int) -> DataFrame:
        return have.select(F.explode(key).alias("key"), "path").groupBy("key").agg(F.min("path").alias("path"), F.count("*").alias("n")).withColumn("tier", F.lit(tier))

    def tail(path: str) -> Column:
        suffixes = scalars.path_suffixes(F.col(path))
        return F.slice(suffixes, F.lit(2), F.size(suffixes))

    def own(key: Column) -> DataFrame:
        return want.select("wanted", F.explode(key).alias("key"))

    itself = F.array
    found = (
        own(itself("wanted")).join(keyed(itself("path"), 1), "key")
        .unionByName(own(itself("wanted")).join(keyed(tail("path"), 2), "key"))
        .unionByName(own(tail("wanted")).join(keyed(itself("path"), 2), "key"))
        .unionByName(own(itself(scalars.basename(F.col("wanted")))).join(keyed(itself(scalars.basename(F.col("path"))), 3), "key"))
    )
    best = found.groupBy("wanted", "tier").agg(F.min("path").alias("path"), F.sum("n").alias("n"))
    return first_per_key(best, ["wanted"], [F.col("tier")]).select("wanted", "tier", "path", "n")


def closure(links: DataFrame, seeds: DataFrame, rounds: int) -> DataFrame:
    """id, depth: what the seeds (id) reach over links (source, target) in at most ``rounds`` steps, with the least number of
    steps. A round expands only what the last one found, and is written, so that the plan doesn't grow; an empty one is the last."""
    ways = links.select("source", "target")
    if rounds > 2:  # else reading the links again costs less than writing them
        ways = written(ways.distinct(), "closure-links")
    front = seeds.select("id", F.lit(0).alias("depth")).distinct()
    reached = front
    for depth in range(1, rounds + 1):
        found = ways.join(front.select(F.col("id").alias("source")), "source", "left_semi").select(F.col("target").alias("id")).distinct()
        front = written(found.join(reached.select("id"), "id", "left_anti").withColumn("depth", F.lit(depth)), "closure-round")
        if front.isEmpty():
            break
        reached = reached.unionByName(front)
    return reached


def managed_nodes(components: DataFrame, corpus: DataFrame, rules: list[tuple[str, str | None, bool]], prefix: str = "managed:") -> DataFrame:
    """source, target, action for each provider (a section's first hub) and rule (key, signal, always) that holds there: always,
    or if a word of the section's corpus (section, word) is the rule's signal. The section's first component whose name holds the
    key is adopted, else a node is created. Rules are a short list and become columns, so they aren't joined."""
    def keys_where(hits: list[Column]) -> Column:
        return F.explode(F.array_compact(F.array(*hits))).alias("key") if hits else F.explode(F.array().cast("array<string>")).alias("key")

    provider = first_per_key(hubs(components), ["section"], [F.col("id")]).select("section", F.col("id").alias("source"))
    signalled = corpus.select("section", keys_where([F.when(F.lower("word") == s, F.lit(k)) for k, s, _ in rules if s is not None]))
    always = provider.select("section", keys_where([F.lit(k) for k, _, a in rules if a]))
    wanted = signalled.unionByName(always).distinct().join(provider, "section")
    named = components.select("section", "id", keys_where([F.when(F.contains(F.lower("name"), F.lit(k)), F.lit(k)) for k, *_ in rules])).groupBy("section", "key").agg(F.min("id").alias("adopted"))
    made = F.concat(F.lit(prefix), F.col("section"), F.lit(":"), F.col("key"))
    return wanted.join(named, ["section", "key"], "left").select("source", F.coalesce("adopted", made).alias("target"), F.when(F.col("adopted").isNull(), "create").otherwise("adopt").alias("action"))


def prefer_source(flows: DataFrame, components: DataFrame, sub_type: str, floor: float = 0.75) -> DataFrame:
    """Flows from hubs to third parties that start at the first asset of the subtype in the hub's section, if there is one,
    their confidence raised to ``floor``."""
    api = first_per_key(components.filter((F.col("type") == "asset") & (F.col("sub_type") == sub_type)), ["section"], [F.col("id")]).select("section", F.col("id").alias("_api"))
    moved = hubs(components).join(api, "section").select(F.col("id").alias("source"), "_api")
    third = components.filter("type = 'third_party'").select(F.col("id").alias("target"), F.lit(True).alias("_third"))
    both = flows.join(moved, "source", "left").join(third, "target", "left")
    here = F.col("_api").isNotNull() & F.coalesce("_third", F.lit(False))
    return both.select("id", F.when(here, F.col("_api")).otherwise(F.col("source")).alias("source"), "target", "type", F.when(here, F.greatest("confidence", F.lit(floor))).otherwise(F.col("confidence")).alias("confidence"))


def symbol_context(lines: DataFrame, symbol: str, reach: int = 4) -> DataFrame:
    """path, line_no, line around the first line of each file that holds the symbol."""
    first = lines.filter(F.contains("line", F.lit(symbol))).groupBy("path").agg(F.min("line_no").alias("_at"))
    return lines.join(first, "path").filter(F.abs(F.col("line_no") - F.col("_at")) <= reach).select("path", "line_no", "line")


def folder_totals(files: DataFrame) -> DataFrame:
    """folder, files, bytes of every folder with all that lies below it. Files are summed by their own folder first; only those
    sums are passed up."""
    own = files.select(scalars.dirname(F.col("path")).alias("own"), "size").groupBy("own").agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))
    up = own.filter("own <> ''").select(F.explode(F.concat(scalars.ancestors(F.col("own")), F.array("own"))).alias("folder"), "files", "bytes")
    return up.groupBy("folder").agg(F.sum("files").alias("files"), F.sum("bytes").alias("bytes"))


def footprint(files: DataFrame, most_files: int, most_bytes: int) -> DataFrame:
    """One row: files (1 at least), bytes, and whether that is a large tree."""
    total = files.agg(F.greatest(F.count("*"), F.lit(1)).alias("files"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))
    return total.withColumn("large", (F.col("files") > most_files) | (F.col("bytes") > most_bytes))
