"""Predicates on nodes and rewrites of flows around providers and what they manage.

Nodes have id, name, type, sub_type, section, client, service, managed_by, managed_key and address (of infrastructure code),
all but id and type may be null; flows have id, source, target, type and confidence.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factgraph.functions.scalars import is_public_url

from .graph import best_per_key

#: Sections that are none. Fixed values.
NO_SECTION = ("", "root", "<unsectioned>", "global")


def section_key(section: Column) -> Column:
    """A section trimmed and lower-cased, empty for those that are none."""
    low = F.lower(F.trim(F.coalesce(section, F.lit(""))))
    return F.when(low.isin(*NO_SECTION), "").otherwise(low)


def compatible(*sections: Column) -> Column:
    """Whether all sections that are one are the same."""
    named = F.array_distinct(F.filter(F.array(*map(section_key, sections)), lambda s: s != ""))
    return F.size(named) <= 1


def matches_provider(name: Column, service: Column, keys: list[str]) -> Column:
    """The name or service is a key of the provider, or the name holds one."""
    low, own = F.lower(F.trim(F.coalesce(name, F.lit("")))), F.lower(F.coalesce(service, F.lit("")))
    return low.isin(keys) | own.isin(keys) | F.greatest(F.lit(False), F.lit(False), *(F.contains(low, F.lit(k)) for k in keys))


def is_product(service: Column, keys: list[str]) -> Column:
    """A product of a provider has a service of its own, which is not a key."""
    return (F.coalesce(service, F.lit("")) != "") & ~F.lower(F.coalesce(service, F.lit(""))).isin(keys)


def holds_any(columns: list[Column], hints: list[str]) -> Column:
    """Any of the texts holds any of the hints, without case."""
    text = F.lower(F.concat_ws("\n", *columns))
    return F.greatest(F.lit(False), F.lit(False), *(F.contains(text, F.lit(h)) for h in hints))


def is_managed_resource(hints: list[str]) -> Column:
    """Databases whose client, type or name holds a hint."""
    return (F.col("type") == "asset") & (F.col("sub_type") == "database") & holds_any([F.col("client"), F.col("name")], hints)


#: Names of HTTP transports, compact. Fixed values.
TRANSPORTS = ("axios", "fetch", "got", "ky", "httpclient", "httpclientfactory", "restsharp", "flurl", "undici", "nodefetch", "crossfetch")


def compact_name(text: Column) -> Column:
    """Trimmed, lower-case, without blanks, underscores and hyphens; empty if null."""
    return F.regexp_replace(F.lower(F.trim(F.coalesce(text, F.lit("")))), r"[\s_-]+", "")


def has_public_url() -> Column:
    """One of the URLs (``urls``, an array), the name if it's a URL, or the host is a public URL."""
    host = F.when(F.coalesce("host", F.lit("")) != "", F.concat(F.lit("https://"), "host"))
    named = F.when(F.col("name").rlike("(?i)^https?://"), F.col("name"))
    every = F.array_compact(F.concat(F.coalesce("urls", F.array().cast("array<string>")), F.array(named, host)))
    return F.exists(every, is_public_url)


def is_bare_client() -> Column:
    """A component (name, service, client, host, urls, source_context) that is only a transport: not from a dependency manifest, without a public URL and a service of its own, whose client or service is
    a transport, or whose name is one followed by "call"."""
    service, client, name = compact_name(F.col("service")), compact_name(F.col("client")), compact_name(F.col("name"))
    called = F.coalesce(F.trim("name").rlike(r"(?i)\bcall$"), F.lit(False)) & F.regexp_replace(name, "call$", "").isin(*TRANSPORTS)
    own = (service != "") & ~service.isin(*TRANSPORTS)
    manifest = F.coalesce(F.col("source_context") == "dependency_manifest", F.lit(False))
    return ~manifest & ~has_public_url() & ~own & (client.isin(*TRANSPORTS) | service.isin(*TRANSPORTS) | called)


def signal_text(*columns: Column) -> Column:
    """One lower-case text of what infrastructure code says of a resource."""
    return F.lower(F.concat_ws(" ", *columns))


def owner_of(resource: Column, prefixes: dict[str, str]) -> Column:
    """The provider whose prefix the resource type has; null for none."""
    return F.coalesce(*(F.when(F.startswith(resource, F.lit(p)), F.lit(o)) for p, o in prefixes.items()))


def matches_resource(resource: Column, exact: list[str], prefixes: list[str]) -> Column:
    """The resource type is in the list or begins with one of the prefixes."""
    return resource.isin(exact) | F.greatest(F.lit(False), F.lit(False), *(F.startswith(resource, F.lit(p)) for p in prefixes))


def service_classes(assets: DataFrame, locations: DataFrame, detections: DataFrame, lines: DataFrame, reach: int = 4) -> DataFrame:
    """id of assets (id, type, sub_type) that are only a service's class: of subtype service, found by the pattern auth_middleware alone (detections: id, pattern), and with a location (id, path, start_line, code) in a folder of
    services that exports a class called so, in its snippet or within ``reach`` lines (path, line_no, line) from its start. Those of which such a location extends ItemsService are exempt. A start that is null or below 1 is the first line."""
    kind = assets.filter("type = 'asset' and sub_type = 'service'").select("id")
    only = detections.groupBy("id").agg(F.bool_and(F.coalesce(F.col("pattern") == "auth_middleware", F.lit(False))).alias("only")).filter("only").select("id")
    places = locations.withColumn("_path", F.replace("path", F.lit("\\"), F.lit("/"))).filter(F.col("_path").rlike(r"(?i)(?:^|/)services/.+\.tsx?$"))
    wanted = places.join(kind, "id", "left_semi").join(only, "id", "left_semi").withColumn("_first", F.greatest(F.coalesce("start_line", F.lit(1)), F.lit(1)))
    # declarations may run over lines, so a location's window is one text, as long as ``reach`` lines
    spots = wanted.select("path", "_first").distinct()
    near = spots.withColumn("line_no", F.explode(F.sequence(F.col("_first"), F.col("_first") + reach - 1))).join(lines.select("path", F.col("line_no").cast("int").alias("line_no"), "line"), ["path", "line_no"])
    windows = near.groupBy("path", "_first").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n").alias("window"))
    seen = wanted.join(windows, ["path", "_first"], "left").select("id", F.explode(F.array(F.coalesce("code", F.lit("")), F.coalesce("window", F.lit("")))).alias("text"))
    found = seen.groupBy("id").agg(F.bool_or(F.col("text").rlike(r"export\s+class\s+\w+Service\b")).alias("service"), F.bool_or(F.col("text").rlike(r"extends\s+(?:\w+\.)?ItemsService\b")).alias("exempt"))
    return found.filter("service and not exempt").select("id")


def preferred_hub(wanted: DataFrame, hubs: DataFrame) -> DataFrame:
    """id, hub for rows (id, section): the first hub (id, section, seq) of the same section, else the first of all."""
    first = hubs.agg(F.min_by("id", "seq")).first()[0]
    own = best_per_key(hubs, [F.col("section")], [F.col("seq")]).select("section", F.col("id").alias("_own"))
    return wanted.join(own, "section", "left").select("id", F.coalesce("_own", F.lit(first)).alias("hub"))


def distinct_locations(locations: DataFrame) -> DataFrame:
    """The first of a component's equal locations (id, file, start, end, seq)."""
    return best_per_key(locations, [F.col(c) for c in ("id", "file", "start", "end")], [F.col("seq")])


def shared_files(left: DataFrame, right: DataFrame) -> DataFrame:
    """left_id, right_id of nodes (id, file) that have a file in common."""
    a, b = left.select(F.col("id").alias("left_id"), "file").distinct(), right.select(F.col("id").alias("right_id"), "file").distinct()
    return a.join(b, "file").select("left_id", "right_id").distinct()


def usage_corpus(nodes: DataFrame, flows: DataFrame, columns: list[str]) -> DataFrame:
    """id, word: what is said of each node in its own columns and in the types of its flows, lower-cased, once each."""
    own = nodes.select("id", F.explode(F.array(*(F.lower(F.col(c).cast("string")) for c in columns))).alias("word"))
    said = flows.select(F.explode(F.array("source", "target")).alias("id"), F.lower("type").alias("word")).distinct().join(nodes.select("id"), "id", "left_semi")
    return own.unionByName(said).filter("word is not null and word <> ''").distinct()


def rolled_up(corpus: DataFrame, nodes: DataFrame) -> DataFrame:
    """id, word: the corpus of each node with those of all nodes in sections below its own (a path of segments). A section is
    joined by equality on each of its ancestors."""
    at = nodes.select("id", section_key(F.col("section")).alias("section"))
    parts = F.split("section", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    below = at.filter("section <> '' and contains(section, '/')").select(F.col("id").alias("other"), F.explode(above).alias("section"))
    passed = below.join(at.filter("section <> ''"), "section").select("id", "other").join(corpus.select(F.col("id").alias("other"), "word"), "other").select("id", "word")
    return corpus.select("id", "word").unionByName(passed).distinct()


def referenced_paths(queued: DataFrame, flows: DataFrame, locations: DataFrame) -> DataFrame:
    """path of queued nodes and of the ends of queued flows (id), from their locations (id, file)."""
    ends = flows.join(queued, "id", "left_semi").select(F.explode(F.array("source", "target")).alias("id"))
    return locations.join(queued.select("id").unionByName(ends).distinct(), "id", "left_semi").select(F.col("file").alias("path")).distinct()


def managed_edges_only(flows: DataFrame, nodes: DataFrame, key: str = "postgres") -> DataFrame:
    """Flows without those into a managed node of the key that don't come from its provider."""
    managed = nodes.filter((F.col("managed_key") == key) & F.col("managed_by").isNotNull() & (F.col("managed_by") != "")).select(F.col("id").alias("target"), F.col("managed_by").alias("_by"))
    return flows.join(managed, "target", "left").filter("_by is null or _by = source").select(flows.columns)


def provider_targets(nodes: DataFrame, keys: list[str], hints: list[str], via: list[str], outermost: bool = False) -> DataFrame:
    """provider, target of the same named section: a provider and a managed resource that is used through it, as its client says. If ``outermost``, only the least and the greatest
    provider of a section count, so that rows don't grow with the providers of a section; no query does so."""
    provider = nodes.filter((F.col("type") == "third_party") & matches_provider(F.col("name"), F.col("service"), keys) & ~is_product(F.col("service"), keys)).select(F.col("id").alias("provider"), section_key(F.col("section")).alias("_s"))
    target = nodes.filter(is_managed_resource(hints) & holds_any([F.col("client")], via)).select(F.col("id").alias("target"), section_key(F.col("section")).alias("_s"))
    provider = provider.filter("_s <> ''")
    if outermost:
        provider = provider.groupBy("_s").agg(F.explode(F.array_distinct(F.array(F.min("provider"), F.max("provider")))).alias("provider"))
    return provider.join(target, "_s").select("provider", "target")


def collapse_generic(nodes: DataFrame, generic: Column, key: str = "postgres") -> DataFrame:
    """id, action, by for the generic nodes of named sections: removed where their section has a managed node of the key (by: the
    least), promoted under the section's least provider that manages something where not, else kept. A promoted node is the
    first of its section; the others are removed, as the section has a managed node then."""
    at = nodes.withColumn("_s", section_key(F.col("section"))).filter("_s <> ''")
    managed = at.filter((F.col("managed_key") == key) & F.col("managed_by").isNotNull()).groupBy("_s").agg(F.min("id").alias("_managed"))
    busy = nodes.filter("managed_by is not null").select(F.col("managed_by").alias("id")).distinct()
    provider = at.filter("type = 'third_party'").join(busy, "id", "left_semi").groupBy("_s").agg(F.min("id").alias("_provider"))
    plain = at.filter(generic & F.col("managed_by").isNull())
    first = plain.groupBy("_s").agg(F.min("id").alias("_first"))
    out = plain.join(managed, "_s", "left").join(provider, "_s", "left").join(first, "_s")
    action = F.when(F.col("_managed").isNotNull(), "remove").when(F.col("_provider").isNull(), "keep").when(F.col("id") == F.col("_first"), "promote").otherwise("remove")
    by = F.when(F.col("_managed").isNotNull(), F.col("_managed")).when(F.col("_provider").isNull(), None).when(F.col("id") == F.col("_first"), F.col("_provider")).otherwise(F.col("_first"))
    return out.select("id", action.alias("action"), by.alias("by"))


def after_collapse(flows: DataFrame, actions: DataFrame) -> DataFrame:
    """source, target, type: flows without those that touch a removed node, self-loops, and those of a promoted node but the one
    from its provider, which is added where it's missing."""
    gone = actions.filter("action = 'remove'").select("id")
    up = actions.filter("action = 'promote'").select("id", "by")
    kept = flows.filter("source <> target").join(gone.select(F.col("id").alias("source")), "source", "left_anti").join(gone.select(F.col("id").alias("target")), "target", "left_anti")
    kept = kept.join(up.select(F.col("id").alias("source")), "source", "left_anti").join(up.select(F.col("id").alias("target"), "by"), "target", "left").filter("by is null or by = source").select("source", "target", "type")
    links = up.select(F.col("by").alias("source"), F.col("id").alias("target"), F.lit("database_query").alias("type")).join(kept.select("source", "target"), ["source", "target"], "left_anti")
    return kept.unionByName(links)
