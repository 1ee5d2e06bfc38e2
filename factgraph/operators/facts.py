"""Operators on facts: identities, relations, answers, proposals, budgets, snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .graph import first_per_key


def stable_ids(rows: DataFrame, parts: list[str], order: list[str], prefix: str) -> DataFrame:
    """``rows`` with key (the parts joined by |; repeats numbered from #2) and stable_id (prefix and 12 hex digits)."""
    n = F.row_number().over(Window.partitionBy(*parts).orderBy(*order))
    base = F.concat_ws("|", *parts)
    key = F.when(n > 1, F.concat(base, F.lit(" #"), n.cast("string"))).otherwise(base)
    return rows.withColumn("key", key).withColumn("stable_id", F.concat(F.lit(prefix), F.substring(F.sha2("key", 256), 1, 12)))


def dedupe_relations(links: DataFrame, structural: list[str]) -> DataFrame:
    """The first link per (type, source, target), without structural types."""
    return first_per_key(links.filter(~F.col("type").isin(structural)), ["type", "source", "target"], [F.col("seq")])


def mode_by(rows: DataFrame, key: str, value: str) -> DataFrame:
    """key, value: the most common non-blank value of each key, ties to the smallest."""
    counts = rows.filter(F.trim(F.coalesce(F.col(value), F.lit(""))) != "").groupBy(key, value).agg(F.count("*").alias("n"))
    return first_per_key(counts, [key], [F.desc("n"), F.col(value)]).select(key, value, "n")


def unpivot_slots(rows: DataFrame, key: str, slots: list[str]) -> DataFrame:
    """key, slot, value: one row per filled slot; blank values are left out."""
    pairs = F.explode(F.array(*(F.struct(F.lit(s).alias("slot"), F.col(s).cast("string").alias("value")) for s in slots)))
    return rows.select(key, pairs.alias("x")).select(key, "x.slot", "x.value").filter("value is not null and value <> ''")


def apply_answers(answers: DataFrame) -> DataFrame:
    """Last writer wins: the newest set of each (fact, property) before the fact's first remove."""
    gone = answers.filter("action = 'remove'").groupBy("fact_id").agg(F.min(F.struct("ts", "seq")).alias("gone"))
    live = answers.filter("action = 'set'").join(gone, "fact_id", "left").filter("gone is null").drop("gone")
    return first_per_key(live, ["fact_id", "property"], [F.desc("ts"), F.desc("seq")]).select("fact_id", "property", "value", "seq")


def answer_status(answers: DataFrame) -> DataFrame:
    """seq, fact_id, status: applied, removes (the fact's first remove) or ignored (anything after it)."""
    gone = answers.filter("action = 'remove'").groupBy("fact_id").agg(F.min(F.struct("ts", "seq")).alias("gone"))
    here = F.struct("ts", "seq")
    status = F.when(F.col("gone").isNull() | (here < F.col("gone")), "applied").when(here == F.col("gone"), "removes").otherwise("ignored")
    return answers.join(gone, "fact_id", "left").select("seq", "fact_id", status.alias("status"))


def supersedes(answers: DataFrame) -> DataFrame:
    """seq, previous: the answer that each one replaces."""
    return answers.filter("action = 'set'").select("seq", F.lag("seq").over(Window.partitionBy("fact_id", "property").orderBy("ts", "seq")).alias("previous"))


def rank_proposals(proposals: DataFrame, seq: list[str]) -> DataFrame:
    """The best proposal per target: score + evidence / 100 - 0.02 for inserts + 0.25 for providers."""
    rank = F.round(F.col("score") + F.col("evidence") / 100 - F.when(F.col("insert_if_missing"), 0.02).otherwise(0.0) + F.when(F.col("kind") == "provider", 0.25).otherwise(0.0), 4)
    return first_per_key(proposals.withColumn("rank", rank), ["target"], [F.desc("rank"), *map(F.col, seq)])


def gate_proposals(proposals: DataFrame, seq: list[str]) -> DataFrame:
    """id, outcome: low_score, missing_evidence, applied (best of its target) or target_taken."""
    gated = proposals.withColumn("reason", F.when(F.col("score") < 0.72, "low_score").when(F.col("evidence") < 2, "missing_evidence"))
    best = rank_proposals(gated.filter("reason is null"), seq).select("target", F.col("id").alias("best"))
    return gated.join(best, "target", "left").select("id", "kind", F.coalesce("reason", F.when(F.col("id") == F.col("best"), "applied").otherwise("target_taken")).alias("outcome"))


def queue_plan(counts: DataFrame, total: int) -> DataFrame:
    """agent, n, share: ``total`` places split evenly over the agents by name, the remainder to the first."""
    everyone = F.count("*").over(Window.partitionBy())
    at = F.row_number().over(Window.orderBy("agent"))  # agents are a small dimension
    share = F.floor(F.lit(total) / everyone) + F.when(at <= F.lit(total) % everyone, 1).otherwise(0)
    return counts.select("agent", "n", share.cast("long").alias("share"))


def budget_prefix(rows: DataFrame, key: str, order: list[Column], cost: str, budget: float, least: int = 0) -> DataFrame:
    """Rows of each key, in order, while their running cost stays within the budget; the first ``least`` are kept anyway."""
    running = F.sum(cost).over(Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    at = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return rows.withColumns({"running": running, "_at": at}).filter((F.col("running") <= budget) | (F.col("_at") <= least)).drop("_at")


def unique_aliases(aliases: DataFrame) -> DataFrame:
    """alias, id of aliases that name exactly one id."""
    return aliases.filter("alias is not null and alias <> ''").groupBy("alias").agg(F.countDistinct("id").alias("n"), F.min("id").alias("id")).filter("n = 1").select("alias", "id")


#: Catalogs up to this many rules become one column expression; larger ones are joined.
EXPRESSION_RULES = 2000


def longest_match(rows: DataFrame, text: str, catalog: DataFrame, expression_rules: int = EXPRESSION_RULES) -> DataFrame:
    """``rows`` with the value of the catalog entry (key, value, seq) whose key their text contains, without case: the longest
    key, then the earliest. Keys of fewer than three characters or that begin with @ don't count. Every row stays, also
    repeated ones. Rules of a large catalog are joined by their first three characters, so that no row meets all of them."""
    usable = catalog.select(F.lower("key").alias("key"), "value", "seq").filter("length(key) >= 3 and not startswith(key, '@')")
    rules = usable.orderBy(F.length("key").desc(), "seq").limit(expression_rules + 1).collect()
    low = F.lower(F.col(text))
    if len(rules) <= expression_rules:
        found = [F.when(F.contains(low, F.lit(r["key"])), F.lit(r["value"])) for r in rules]
        return rows.withColumn("value", F.coalesce(*found) if found else F.lit(None).cast("string"))
    keyed = usable.withColumn("start", F.substring("key", 1, 3))
    texts = rows.select(low.alias("_low")).distinct()
    starts = texts.select("_low", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length("_low") - 2, F.lit(1))), lambda i: F.substring(F.col("_low"), i, F.lit(3))))).alias("start"))
    hits = starts.join(keyed, "start").filter(F.contains("_low", F.col("key")))
    best = hits.groupBy("_low").agg(F.min(F.struct((-F.length("key")).alias("long"), "seq", "value")).alias("m")).select("_low", F.col("m.value").alias("value"))
    return rows.withColumn("_low", low).join(best, "_low", "left").drop("_low")


def snapshot_diff(base: DataFrame, head: DataFrame, key: str, value: str) -> DataFrame:
    """key, change of added, removed and changed identities."""
    both = base.select(key, F.col(value).alias("old"), F.lit(1).alias("in_base")).join(head.select(key, F.col(value).alias("new"), F.lit(1).alias("in_head")), key, "full")
    change = F.when(F.col("in_base").isNull(), "added").when(F.col("in_head").isNull(), "removed").when(~F.col("old").eqNullSafe(F.col("new")), "changed")
    return both.select(key, change.alias("change")).filter("change is not null")


def contained(inner: DataFrame, outer: DataFrame, block: int = 64) -> DataFrame:
    """inner_id, outer_id: spans (path, first, last) that lie within others of the same path. Outer spans are filed under every block of
    lines they touch, inner ones under that of their first line, so a long path makes no pairs of spans far apart."""
    i = inner.select("path", F.col("id").alias("inner_id"), F.col("first").alias("f"), F.col("last").alias("l"), F.floor(F.col("first") / block).alias("b"))
    o = outer.select("path", F.col("id").alias("outer_id"), "first", "last", F.explode(F.sequence(F.floor(F.col("first") / block), F.floor(F.col("last") / block))).alias("b"))
    return i.join(o, ["path", "b"]).filter("f >= first and l <= last").select("inner_id", "outer_id").distinct()


def token_cost(usage: DataFrame, prices: DataFrame) -> DataFrame:
    """agent, tokens, cost: cost is null if any call has no price."""
    priced = usage.join(prices, "model", "left").withColumn("cost", F.col("tokens") * F.col("price") / 1e6)
    return priced.groupBy("agent").agg(F.sum("tokens").alias("tokens"), F.when(F.count("*") == F.count("cost"), F.round(F.sum("cost"), 6)).alias("cost"))


def cascade(removed: DataFrame, flows: DataFrame, links: DataFrame) -> DataFrame:
    """kind, id of all that goes with the removed components (id): themselves, their flows and the links that touch them."""
    ends = removed.select("id").distinct()

    def touching(rows: DataFrame, kind: str, key: str) -> DataFrame:
        both = rows.select(F.col(key).cast("string").alias("own"), F.explode(F.array("source", "target")).alias("id"))
        return both.join(ends, "id", "left_semi").select(F.lit(kind).alias("kind"), F.col("own").alias("id")).distinct()

    return ends.select(F.lit("component").alias("kind"), "id").unionByName(touching(flows, "flow", "id")).unionByName(touching(links, "link", "seq"))


def identity_key(rows: DataFrame) -> Column:
    """The identity of a component (section, type, sub_type, file, name, address, provider_key, service): its address in infrastructure
    code, else what manages it, else section, type, subtype, file and name. The prefixes are fixed values."""
    def text(c: str) -> Column:
        return F.coalesce(F.col(c), F.lit(""))

    app = F.concat(F.lit("app:"), F.concat_ws("|", text("section"), text("type"), text("sub_type"), text("file"), F.regexp_replace(F.lower(F.trim(text("name"))), r"\s+", " ")))
    managed = F.concat(F.lit("managed:{"), F.col("provider_key"), F.lit("}|"), text("service"), F.lit("|"), text("section"))
    return F.when(text("address") != "", F.concat(F.lit("tf:"), "address")).when(text("provider_key") != "", managed).otherwise(app)


def flow_key() -> Column:
    """The identity of a flow (source, target, type, method, endpoint, file) as a JSON list; the version is a fixed value."""
    return F.to_json(F.array(F.lit("flow/v1"), "source", "target", "type", F.upper(F.coalesce("method", F.lit(""))), F.coalesce("endpoint", F.lit("")), F.coalesce("file", F.lit(""))))


def aliases_of(components: DataFrame) -> DataFrame:
    """id, alias of components (id, name, path): id, name, path, the path without its index file, and that one's folder, in lower case."""
    from factgraph.functions import scalars

    path = scalars.posix_path(F.lower("path"))
    bare = scalars.without_index(path)
    return components.select("id", F.explode(F.array_distinct(F.array_compact(F.array(F.lower("id"), F.lower("name"), path, bare, scalars.dirname(bare))))).alias("alias")).filter("alias <> ''")


def status_counts(statuses: DataFrame) -> DataFrame:
    """status, n."""
    return statuses.groupBy("status").agg(F.count("*").alias("n"))
