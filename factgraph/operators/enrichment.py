"""Operators that complete a graph's facts: candidates, inference rules, evidence checks, merges of proposals, questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .graph import at_hand, cross_section, first_per_key, with_ends


def candidates(components: DataFrame, flows: DataFrame) -> DataFrame:
    """candidate_type, subject, priority, missing (comma-joined): third parties without a subtype (95), components but
    actors with empty properties (85), flows of actors that look turned round (90) or are uncertain (80), and one row (88)
    if there are several sections and no flow between them. ``components`` has properties map<string, string>."""
    third = components.filter("type = 'third_party' and trim(coalesce(sub_type, '')) = ''").select(
        F.lit("third_party").alias("candidate_type"), F.col("id").alias("subject"), F.lit(95).alias("priority"), F.lit("sub_type").alias("missing"))
    empty = F.map_keys(F.map_filter("properties", lambda _, v: F.trim(F.coalesce(v, F.lit(""))) == ""))
    sparse = components.filter(F.col("type") != "actor").select(F.lit("node_property").alias("candidate_type"), F.col("id").alias("subject"), F.lit(85).alias("priority"), F.array_join(F.array_sort(empty), ",").alias("missing")).filter("missing <> ''")
    turned = (F.col("source_type") != "actor") & (F.col("target_type") == "actor")
    actor = (F.col("source_type") == "actor") | (F.col("target_type") == "actor")
    unsure = with_ends(flows, components).filter(actor & (turned | (F.col("confidence") < 0.8))).select(
        F.lit("flow_direction").alias("candidate_type"), F.col("id").alias("subject"), F.when(turned, 90).otherwise(80).alias("priority"), F.lit("").alias("missing"))
    sections = components.filter("section <> ''").select("section").distinct().limit(2).agg((F.count("*") == 2).alias("several"))
    none = cross_section(flows, components).limit(1).agg((F.count("*") == 0).alias("none"))
    gap = sections.join(none, sections.several & F.col("none")).select(F.lit("missing_interaction").alias("candidate_type"), F.lit("cross_section").alias("subject"), F.lit(88).alias("priority"), F.lit("").alias("missing"))  # one row a side
    return third.unionByName(sparse).unionByName(unsure).unionByName(gap)


def capped(rows: DataFrame, agent: str, key: str, order: list[Column], cap: int) -> DataFrame:
    """key, agent, status: the first ``cap`` rows of each agent are queued, the rest over capacity; 0 queues all. ``key``
    is unique. The ranks are cut before the shuffle, so that an agent with most rows doesn't fill one task."""
    if cap == 0:
        return rows.select(key, agent, F.lit("queued").alias("status"))
    first = rows.withColumn("_at", F.row_number().over(Window.partitionBy(agent).orderBy(*order))).filter(F.col("_at") <= cap).select(key, F.lit("queued").alias("_status"))
    return rows.select(key, agent).join(first, key, "left").select(key, agent, F.coalesce("_status", F.lit("agent_queue_capacity_exceeded")).alias("status"))


def infer(rows: DataFrame, rules: list[tuple[str, Column, Column]]) -> DataFrame:
    """``rows`` after the rules (column, when, value) in order; later rules see what earlier ones set."""
    for name, when, value in rules:
        rows = rows.withColumn(name, F.when(when, value).otherwise(F.col(name)))
    return rows


def check_evidence(proposals: DataFrame, evidence: DataFrame, files: DataFrame) -> DataFrame:
    """id, outcome of proposals (id, confidence): no_evidence, bad_confidence, unknown_path (any path of their evidence (id, path)
    isn't one of files) or valid."""
    unknown = evidence.join(files.select("path"), "path", "left_anti").select("id", F.lit(True).alias("unknown")).distinct()
    some = evidence.select("id", F.lit(True).alias("some")).distinct()
    outcome = (
        F.when(F.col("some").isNull(), "no_evidence").when(F.coalesce(~F.col("confidence").between(0, 1), F.lit(True)), "bad_confidence")
        .when(F.col("unknown"), "unknown_path").otherwise("valid")
    )
    return proposals.join(some, "id", "left").join(unknown, "id", "left").select("id", outcome.alias("outcome"))


def merge_properties(current: DataFrame, patches: DataFrame, rank: list[Column]) -> DataFrame:
    """id, property, value, patch: what ranked patches fill in. current and patches have id and property; a property is
    filled only where its current value is missing or blank, by the first patch (columns patch, value) in rank order whose
    own value isn't blank. Patches that fill nothing don't block others, so a winner per property is the whole merge."""
    blank = F.trim(F.coalesce(F.col("value"), F.lit(""))) == ""
    filled = current.filter(~blank).select("id", "property")
    known = current.select("id").distinct()
    open_ = patches.filter(~blank).join(filled, ["id", "property"], "left_anti").join(known, "id", "left_semi")
    return first_per_key(open_, ["id", "property"], rank).select("id", "property", "value", "patch")


def with_status(questions: DataFrame, answered: DataFrame) -> DataFrame:
    """The questions with status: answered where there's an answer to (subject, slot), else unknown."""
    known = answered.select("subject", "slot").distinct().withColumn("_known", F.lit(True)).hint("shuffle_hash")  # the questions aren't sorted
    return questions.join(known, ["subject", "slot"], "left").withColumn("status", F.when(F.col("_known"), "answered").otherwise("unknown")).drop("_known")


def questions(components: DataFrame, flows: DataFrame) -> DataFrame:
    """subject, slot, about: the scope of the system, two questions on each flow out to a third party, one on each actor."""
    scope = components.sparkSession.createDataFrame([("system", "in_scope", "Which system is this, and where does it end?")], "subject string, slot string, about string")
    # flows meet the third parties first, so that others aren't moved to their sources
    third = components.filter("type = 'third_party'").select(F.col("id").alias("target"), F.col("name").alias("to"))
    other = components.filter("type <> 'third_party'").select(F.col("id").alias("source"), F.col("name").alias("from")).hint("shuffle_hash")
    out = flows.select("id", "source", "target").join(at_hand(third), "target").join(other, "source").select("id", "from", "to")
    asked = F.explode(F.array(
        F.struct(F.lit("data_categories").alias("slot"), F.concat(F.lit("Which kinds of data does "), "from", F.lit(" pass to "), "to", F.lit("?")).alias("about")),
        F.struct(F.lit("purpose").alias("slot"), F.concat(F.lit("What for does "), "to", F.lit(" get data of "), "from", F.lit("?")).alias("about")),
    ))
    of_flows = out.select(F.col("id").alias("subject"), asked.alias("q")).select("subject", "q.slot", "q.about")
    of_actors = components.filter("type = 'actor'").select(F.col("id").alias("subject"), F.lit("actor_kind").alias("slot"), F.concat(F.lit("Does "), "name", F.lit(" stand for one person, for a role or for a kind of user?")).alias("about"))
    return scope.unionByName(of_flows).unionByName(of_actors)


def new_records(existing: DataFrame, incoming: DataFrame, parts: list[str]) -> DataFrame:
    """``incoming`` with record_id, a hash of ``parts``, less those whose id ``existing`` (same columns) has; repeats count once."""
    def with_id(rows: DataFrame) -> DataFrame:
        return rows.withColumn("record_id", F.substring(F.sha2(F.concat_ws("|", *(F.col(p).cast("string") for p in parts)), 256), 1, 16))

    return with_id(incoming).join(with_id(existing).select("record_id"), "record_id", "left_anti").dropDuplicates(["record_id"])


def overlay(static: DataFrame, dynamic: DataFrame, keys: list[str]) -> DataFrame:
    """keys, origin: static rows, and dynamic ones that static lacks; each once."""
    base = static.select(*keys).distinct()
    more = dynamic.select(*keys).distinct().join(base, keys, "left_anti")
    return base.withColumn("origin", F.lit("static")).unionByName(more.withColumn("origin", F.lit("overlay")))


def slugs(names: DataFrame, base: Column) -> DataFrame:
    """name, slug for each distinct name (``base`` is its plain slug): names that share a slug get 6 digits of their own hash."""
    each = names.select("name").distinct().withColumn("slug", base)
    shared = each.groupBy("slug").agg(F.count("*").alias("n")).filter("n > 1").select("slug", F.lit(True).alias("shared"))
    own = F.concat("slug", F.lit("-"), F.substring(F.sha2("name", 256), 1, 6))
    return each.join(shared, "slug", "left").select("name", F.when(F.col("shared"), own).otherwise(F.col("slug")).alias("slug"))


def digest(rows: DataFrame, key: str, order: str, message: str) -> DataFrame:
    """key, digest: the first message of each key and how many more there are, at most 300 characters."""
    got = rows.groupBy(key).agg(F.min(F.struct(order, message)).getField(message).alias("m"), F.count("*").alias("n"))
    return got.select(key, F.substring(F.concat("m", F.when(F.col("n") > 1, F.concat(F.lit(" (+"), (F.col("n") - 1).cast("string"), F.lit(" more)"))).otherwise("")), 1, 300).alias("digest"))


def normalised(values: Column, known: list[str], other: str | None = "other") -> Column:
    """Distinct values, sorted; unknown ones become ``other``, or go if that is None."""
    mapped = F.transform(values, lambda v: F.when(v.isin(known), v).otherwise(F.lit(other)))
    return F.array_sort(F.array_distinct(F.array_compact(mapped)))


def first_reason(rules: list[tuple[str, Column]]) -> Column:
    """The name of the first rule that holds; null if none does."""
    return F.coalesce(*(F.when(when, F.lit(name)) for name, when in rules))


def evidence_score(base: float, parts: list[tuple[Column, float]], low: float, high: float) -> Column:
    """The base and the weight of each condition that holds, within [low, high], to two decimals."""
    total = F.lit(base)
    for holds, weight in parts:
        total = total + F.when(holds, weight).otherwise(0.0)
    return F.round(F.least(F.lit(high), F.greatest(F.lit(low), total)), 2)


def usage_totals(calls: DataFrame, key: str) -> DataFrame:
    """key, total of calls (input, output, total tokens): the larger of what inputs and outputs add up to and the reported
    totals; negative and missing counts are 0."""
    clean = calls.select(key, *(F.greatest(F.coalesce(c, F.lit(0)), F.lit(0)).alias(c) for c in ("input", "output", "total")))
    return clean.groupBy(key).agg(F.greatest(F.sum("input") + F.sum("output"), F.sum("total")).alias("total"))
