"""Scores and summaries of a scan: components (id, type, sub_type, section, properties as a map of text), flows, proposals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Properties that every component should have. Fixed values.
FIRST_TIER = ("encryption_at_rest", "authentication_methods", "gdpr_role")


def is_filled(value: Column) -> Column:
    """Neither null nor blank nor false."""
    return F.coalesce(~value.isin("", "false"), F.lit(False))


def component_scores(components: DataFrame) -> DataFrame:
    """One row: fill_rate (filled of all properties; 0 without any), completeness (mean share of FIRST_TIER that is filled; 0 without
    components), third_party (share of third parties with a subtype and a vendor or else client; 1 without any)."""
    values = F.map_values("properties")
    tier = sum((is_filled(F.try_element_at("properties", F.lit(p))).cast("int") for p in FIRST_TIER), F.lit(0)) / len(FIRST_TIER)
    named = F.coalesce(F.try_element_at("properties", F.lit("vendor")), F.try_element_at("properties", F.lit("client")))
    whole = (F.coalesce("sub_type", F.lit("")) != "") & is_filled(named)
    return components.agg(
        F.coalesce(F.try_divide(F.sum(F.size(F.filter(values, is_filled))), F.sum(F.size(values))), F.lit(0.0)).alias("fill_rate"), F.coalesce(F.avg(tier), F.lit(0.0)).alias("completeness"),
        F.coalesce(F.avg(F.when(F.col("type") == "third_party", whole.cast("double"))), F.lit(1.0)).alias("third_party"),
    )


def flow_scores(flows: DataFrame, least: float = 0.5) -> DataFrame:
    """One row: guardrail (1 less the share of flows under ``least``) and direction_accuracy, which is 1 by definition: flows from
    actors to assets over themselves."""
    return flows.agg(F.greatest(F.lit(0.0), 1 - F.count_if(F.col("confidence") < least) / F.greatest(F.count("*"), F.lit(1))).alias("guardrail"), F.lit(1.0).alias("direction_accuracy"))


def interaction_recall(flows: DataFrame, components: DataFrame, expected: DataFrame) -> DataFrame:
    """One row: recall, the share of expected links of sections (source_section, target_section) that some flow makes; 1 for none."""
    section = components.select("id", F.coalesce("section", F.lit("")).alias("section"))

    def end(name: str) -> DataFrame:
        """Components of sections that an expected link has at this end; flows of others can't make one."""
        own = section.withColumnsRenamed({"id": name, "section": f"{name}_section"})
        return own.join(expected.select(f"{name}_section").distinct(), f"{name}_section", "left_semi").hint("shuffle_hash")

    # the flows themselves aren't made distinct: nearly all are, and only their sections count
    made = flows.select("source", "target").join(end("target"), "target").join(end("source"), "source").select("source_section", "target_section").distinct()
    hit = expected.join(made.withColumn("hit", F.lit(1.0)), ["source_section", "target_section"], "left")
    return hit.agg(F.coalesce(F.avg(F.coalesce("hit", F.lit(0.0))), F.lit(1.0)).alias("recall"))


def property_coverage(proposals: DataFrame, outcomes: DataFrame, after: DataFrame) -> DataFrame:
    """property, autofilled, suggested, unknown: how often proposals (id, keys) for third parties were applied, how often they were
    rejected for a low score only, and how many third parties still lack the property (component, property, value)."""
    each = proposals.join(outcomes, "id", "left").select(F.explode("keys").alias("property"), F.coalesce("outcome", F.lit("")).alias("outcome"))
    counted = each.select("property", (F.col("outcome") == "applied").cast("int").alias("a"), F.startswith("outcome", F.lit("confidence_below_threshold")).cast("int").alias("s"), F.lit(0).alias("u"))
    lacking = after.filter(F.coalesce(F.trim("value"), F.lit("")) == "").select("property", F.lit(0).alias("a"), F.lit(0).alias("s"), F.lit(1).alias("u"))
    totals = counted.unionByName(lacking).groupBy("property").agg(F.sum("a").alias("autofilled"), F.sum("s").alias("suggested"), F.sum("u").alias("unknown"))
    return totals.filter("autofilled + suggested + unknown > 0")


def store_kinds(databases: DataFrame) -> DataFrame:
    """client, kind, n of databases; ``database`` and ``SQL`` where they say none."""
    return databases.groupBy(F.coalesce("client", F.lit("database")).alias("client"), F.coalesce("kind", F.lit("SQL")).alias("kind")).agg(F.count("*").alias("n"))


def all_https(urls: DataFrame, key: str) -> DataFrame:
    """key, https_enforced: whether every URL of the key is https."""
    return urls.groupBy(key).agg(F.every(F.startswith("url", F.lit("https://"))).alias("https_enforced"))


def mean_score(low: float = 0.65, high: float = 0.96, column: str = "score") -> Column:
    """The mean of scores between the bounds, to two places."""
    return F.round(F.least(F.lit(high), F.greatest(F.lit(low), F.avg(column))), 2)


def type_summary(components: DataFrame) -> DataFrame:
    """type, n, sections (distinct, sorted)."""
    return components.groupBy("type").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("section")), ",").alias("sections"))


def catalog_hash(files: DataFrame, key: str) -> DataFrame:
    """key, hash: one hash of the paths and contents of each catalog's files, in the order of paths. A file counts by its own hash, so
    contents aren't gathered."""
    each = files.select(key, F.struct("path", F.sha2("content", 256).alias("sha")).alias("f"))
    listed = F.array_join(F.transform(F.array_sort(F.collect_list("f")), lambda f: F.concat(f["path"], F.lit(":"), f["sha"])), "\n")
    return each.groupBy(key).agg(F.sha2(listed, 256).alias("hash"))


def recounted(groups: DataFrame, occurrences: DataFrame) -> DataFrame:
    """item, group_id, n: occurrences (group_id) of each group (item, group_id) that are left; groups without any count 0."""
    left = occurrences.groupBy("group_id").agg(F.count("*").alias("n"))
    return groups.join(left, "group_id", "left").select("item", "group_id", F.coalesce("n", F.lit(0)).alias("n"))


def price_of(model: Column, prices: dict[str, float]) -> Column:
    """The price of a model's name, also with a date after it; 0 for local and mock ones; null if unknown."""
    dated = [F.when(model.rlike(f"^{name.replace('.', '[.]')}(-[0-9]{{4}}-?[0-9]{{2}}-?[0-9]{{2}})?$"), F.lit(p)) for name, p in prices.items()]
    return F.coalesce(F.when(model.rlike("^(local|mock)"), F.lit(0.0)), *dated)
