"""Queries on scores and summaries, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factgraph.operators import merge, metrics
from factgraph.sources import tables
from factgraph.sources.tables import with_relations

from .merge import _COMPONENT_PATCHES, _component_patches
from .registry import query

_PROPS = """props AS (SELECT 's' || s_suppkey AS id, 'third_party' AS type, CASE WHEN s_suppkey % 9 > 0 THEN 'vendor' ELSE '' END AS sub_type, unnest(['vendor', 'client', 'gdpr_role', 'encryption_at_rest']) AS k,
  unnest([CASE WHEN s_suppkey % 3 > 0 THEN s_name END, CASE WHEN s_suppkey % 2 = 0 THEN 'rest' ELSE '' END, CASE WHEN s_acctbal > 0 THEN 'processor' END, CASE WHEN s_suppkey % 5 = 0 THEN 'false' ELSE 'true' END]) AS v FROM supplier
  UNION ALL SELECT 'p' || p_partkey, 'asset', 'database', unnest(['authentication_methods', 'gdpr_role']), unnest([CASE WHEN p_size > 20 THEN 'password' END, '']) FROM part)"""


def _with_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    supplier, part = tables.table(spark, sf_dir, "supplier"), tables.table(spark, sf_dir, "part")
    k = F.col("s_suppkey")
    own = supplier.select(
        F.concat(F.lit("s"), k.cast("string")).alias("id"), F.lit("third_party").alias("type"), F.when(k % 9 > 0, "vendor").otherwise("").alias("sub_type"),
        F.create_map(F.lit("vendor"), F.when(k % 3 > 0, F.col("s_name")), F.lit("client"), F.when(k % 2 == 0, "rest").otherwise(""), F.lit("gdpr_role"), F.when(F.col("s_acctbal") > 0, "processor"), F.lit("encryption_at_rest"), F.when(k % 5 == 0, "false").otherwise("true")).alias("properties"))
    return own.union(part.select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")), F.lit("asset"), F.lit("database"), F.create_map(F.lit("authentication_methods"), F.when(F.col("p_size") > 20, "password"), F.lit("gdpr_role"), F.lit(""))))


_FILLED = "(v IS NOT NULL AND v NOT IN ('', 'false'))"


@query(f"""WITH {_PROPS}, c AS (SELECT id, any_value(type) AS type, any_value(sub_type) AS sub_type, sum({_FILLED}::INT) AS filled, count(*) AS n, sum(({_FILLED} AND k IN ('encryption_at_rest', 'authentication_methods', 'gdpr_role'))::INT) / 3 AS tier,
  coalesce(max(v) FILTER (k = 'vendor'), max(v) FILTER (k = 'client')) AS named FROM props GROUP BY id)
SELECT round(sum(filled) / sum(n), 9) AS fill_rate, round(avg(tier), 9) AS completeness, round(avg((sub_type <> '' AND named IS NOT NULL AND named NOT IN ('', 'false'))::INT) FILTER (type = 'third_party'), 9) AS third_party FROM c""")
def component_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fill rate and completeness of suppliers and parts."""
    scores = metrics.component_scores(_with_properties(spark, sf_dir))
    return scores.select(*(F.round(c, 9).alias(c) for c in scores.columns))


@query(with_relations("components", "flows") + """, ends AS (SELECT DISTINCT s.section AS a, t.section AS b FROM flows f JOIN components s ON f.source = s.id JOIN components t ON f.target = t.id), expected AS (SELECT a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON b.n_nationkey = (a.n_nationkey * 3 + 1) % 25 UNION ALL SELECT n_name, 'NOWHERE' FROM nation WHERE n_nationkey < 3)
SELECT round(avg((e.a IS NOT NULL)::INT), 9) AS recall, (SELECT round(greatest(0, 1 - count(*) FILTER (confidence < 0.6) / count(*)), 9) FROM flows) AS guardrail, 1.0::DOUBLE AS direction_accuracy FROM expected x LEFT JOIN ends e ON x.a = e.a AND x.b = e.b""")
def interaction_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall of expected links of sections, and the flows' scores."""
    nation = tables.table(spark, sf_dir, "nation")
    other = nation.select(F.col("n_nationkey").alias("_k"), F.col("n_name").alias("target_section"))
    expected = nation.withColumn("_k", (F.col("n_nationkey") * 3 + 1) % 25).join(other, "_k").select(F.col("n_name").alias("source_section"), "target_section")
    expected = expected.unionByName(nation.filter("n_nationkey < 3").select(F.col("n_name").alias("source_section"), F.lit("NOWHERE").alias("target_section")))
    flows = tables.flows(spark, sf_dir)
    scores = metrics.flow_scores(flows, 0.6).first()
    recall = metrics.interaction_recall(flows, tables.components(spark, sf_dir), expected)
    return recall.select(F.round("recall", 9).alias("recall"), F.round(F.lit(scores["guardrail"]), 9).alias("guardrail"), F.lit(scores["direction_accuracy"]).alias("direction_accuracy"))


@query(f"""WITH RECURSIVE {_COMPONENT_PATCHES}, each AS (SELECT unnest(keys) AS property, outcome FROM cp JOIN outcomes USING (id)), lacking AS (SELECT p_partkey, unnest(['vendor', 'plan']) AS property FROM part)
SELECT property, sum(a)::BIGINT AS autofilled, sum(s)::BIGINT AS suggested, sum(u)::BIGINT AS unknown FROM (SELECT property, (outcome = 'applied')::INT AS a, starts_with(outcome, 'confidence_below_threshold')::INT AS s, 0 AS u FROM each
  UNION ALL SELECT property, 0, 0, 1 FROM lacking WHERE CASE property WHEN 'vendor' THEN p_partkey % 2 <> 0 ELSE p_partkey % 3 <> 0 END) GROUP BY property""")
def property_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What patches filled, could fill and left open."""
    components, patches = _component_patches(spark, sf_dir)
    outcomes, _ = merge.merge_components(components, patches)
    wanted = F.explode(F.array(F.lit("vendor"), F.lit("plan"))).alias("property")
    filled = components.select(F.col("id").alias("component"), F.explode("properties").alias("property", "value"))
    after = components.select(F.col("id").alias("component"), wanted).join(filled, ["component", "property"], "left")
    return metrics.property_coverage(patches.select("id", F.map_keys("properties").alias("keys")), outcomes.select(F.col("patch").alias("id"), "outcome"), after)


@query("SELECT coalesce(CASE WHEN p_size % 3 > 0 THEN p_type END, 'database') AS client, coalesce(CASE WHEN p_size % 2 = 0 THEN p_brand END, 'SQL') AS kind, count(*) AS n FROM part GROUP BY ALL")
def store_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as databases by client and kind."""
    return metrics.store_kinds(tables.table(spark, sf_dir, "part").select(F.when(F.col("p_size") % 3 > 0, F.col("p_type")).alias("client"), F.when(F.col("p_size") % 2 == 0, F.col("p_brand")).alias("kind")))


_PAGE_URLS = "SELECT regexp_extract(url, '[.]([a-z]+)/', 1) || page_id % 30 AS site, CASE WHEN page_id % 7 > 0 THEN replace(url, 'http://', 'https://') ELSE url END AS url FROM pages WHERE url IS NOT NULL"


@query(f"SELECT site, bool_and(starts_with(url, 'https://')) AS https_enforced FROM ({_PAGE_URLS}) GROUP BY site")
def https_enforced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sites of which every page is https."""
    pages = tables.table(spark, sf_dir, "pages").filter("url is not null")
    url = F.when(F.col("page_id") % 7 > 0, F.replace("url", F.lit("http://"), F.lit("https://"))).otherwise(F.col("url"))
    return metrics.all_https(pages.select(F.concat(F.regexp_extract("url", "[.]([a-z]+)/", 1), (F.col("page_id") % 30).cast("string")).alias("site"), url.alias("url")), "site")


@query(with_relations("components") + "SELECT type, count(*) AS n, array_to_string(list_sort(list_distinct(list(section))), ',') AS sections FROM components GROUP BY type")
def trace_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components and sections by type."""
    return metrics.type_summary(tables.components(spark, sf_dir))


@query(with_relations("files") + "SELECT language, sha256(string_agg(path || ':' || sha256(content), chr(10) ORDER BY path)) AS hash FROM files WHERE language IS NOT NULL GROUP BY language")
def catalog_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One hash of each language's files."""
    return metrics.catalog_hash(tables.files(spark, sf_dir).filter("language is not null"), "language")


@query("SELECT event_type AS item, user_id AS group_id, count(*) FILTER (value <= 90) AS n FROM events GROUP BY ALL")
def group_recount(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events left of each user and type after those of high value are gone."""
    events = tables.table(spark, sf_dir, "events").select(F.col("event_type").alias("item"), F.col("user_id"), F.struct("user_id", "event_type").alias("group_id"), "value")
    left = metrics.recounted(events.select("item", "group_id").distinct(), events.filter("value <= 90"))
    return left.select("item", "group_id.user_id", "n").withColumnRenamed("user_id", "group_id")


@query("SELECT user_id, round(least(0.96, greatest(0.65, avg(round(value / 100, 3)))), 2) AS score FROM events GROUP BY user_id")
def mean_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clamped mean scores of users."""
    return tables.table(spark, sf_dir, "events").withColumn("score", F.round(F.col("value") / 100, 3)).groupBy("user_id").agg(metrics.mean_score().alias("score"))


@query("""SELECT model, count(*) AS n, CASE WHEN model LIKE 'local%' THEN 0.0 WHEN regexp_matches(model, '^small-1(-[0-9]{4}-?[0-9]{2}-?[0-9]{2})?$') THEN 0.5 WHEN regexp_matches(model, '^large(-[0-9]{4}-?[0-9]{2}-?[0-9]{2})?$') THEN 4.0 END::DOUBLE AS price
FROM (SELECT CASE event_id % 6 WHEN 0 THEN 'small-1' WHEN 1 THEN 'small-1-2024-05-01' WHEN 2 THEN 'large-20240501' WHEN 3 THEN 'large-x' WHEN 4 THEN 'local-llama' ELSE 'small-12' END AS model FROM events) GROUP BY model""")
def model_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices of models by name, also with a date after it."""
    names = F.array(*map(F.lit, ["small-1", "small-1-2024-05-01", "large-20240501", "large-x", "local-llama", "small-12"]))
    models = tables.table(spark, sf_dir, "events").select(F.get(names, (F.col("event_id") % 6).cast("int")).alias("model")).groupBy("model").agg(F.count("*").alias("n"))
    return models.withColumn("price", metrics.price_of(F.col("model"), {"small-1": 0.5, "large": 4.0}))
