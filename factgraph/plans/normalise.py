"""Queries on vocabularies and sentences, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factgraph.operators import normalise
from factgraph.sources import tables

from .registry import query

_WORDS = "[" + ", ".join(f"'{w}'" for w in normalise.CATEGORIES) + "]"
_ALIASES = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in normalise.CATEGORY_ALIASES.items())


@query(f"""WITH raw AS (SELECT p_partkey AS id, list_filter(list_transform(string_split(CASE p_size % 5 WHEN 0 THEN 'PII, ' || p_name WHEN 1 THEN 'Health Data,' || p_type WHEN 2 THEN 'payment-data,Email Address, pii' WHEN 3 THEN p_brand ELSE ' , ' END, ','), lambda v: regexp_replace(regexp_replace(lower(trim(v)), '[\\s-]+', '_', 'g'), '[^a-z0-9_]', '', 'g')), lambda v: v <> '') AS t FROM part),
mapped AS (SELECT id, generate_subscripts(t, 1) AS k, unnest(list_transform(t, lambda v: CASE WHEN list_contains({_WORDS}, v) THEN v ELSE coalesce(CASE v {_ALIASES} END, 'other') END)) AS w FROM raw)
SELECT id, string_agg(w, ',' ORDER BY k) AS categories FROM (SELECT id, w, min(k) AS k FROM mapped GROUP BY id, w) GROUP BY id""")
def category_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms said of parts as categories of data; parts without any are left out."""
    size = F.col("p_size") % 5
    raw = F.when(size == 0, F.concat(F.lit("PII, "), "p_name")).when(size == 1, F.concat(F.lit("Health Data,"), "p_type")).when(size == 2, "payment-data,Email Address, pii").when(size == 3, F.col("p_brand")).otherwise(" , ")
    terms = normalise.to_vocabulary(normalise.listed(raw), normalise.CATEGORIES, normalise.CATEGORY_ALIASES)
    return tables.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.array_join(terms, ",").alias("categories")).filter("categories is not null")


@query("""WITH f AS (SELECT *, p_size % 3 AS kind FROM part), r AS (SELECT upper(left(n, 1)) || substr(n, 2) AS name, count(*) AS n FROM (SELECT CASE WHEN p_size % 2 = 0 THEN 'Express' ELSE p_name END AS n FROM f WHERE kind = 0 AND p_partkey % 10 <> 0) GROUP BY 1),
s AS (SELECT CASE WHEN p_size % 4 = 0 THEN 'Postgres' ELSE 'SQL' END AS d, p_brand AS c, min(p_partkey) AS seq FROM f WHERE kind = 1 GROUP BY ALL),
v AS (SELECT DISTINCT lower(s_name) AS v FROM supplier UNION SELECT 'aws' FROM f WHERE kind = 2), w AS (SELECT v, CASE WHEN v = 'aws' THEN 'AWS' ELSE upper(left(v, 1)) || substr(v, 2) END AS name, row_number() OVER (ORDER BY v) AS k, count(*) OVER () AS n FROM v)
SELECT 'routes' AS part, row_number() OVER (ORDER BY name)::INTEGER AS "at", CASE WHEN n = 1 THEN 'Found 1 ' || name || ' route' ELSE 'Found ' || n || ' ' || name || ' routes' END AS line FROM r
UNION ALL SELECT 'stores', row_number() OVER (ORDER BY seq)::INTEGER, 'Talks to ' || d || ' (' || c || ')' FROM s
UNION ALL SELECT 'outbound', 1, 'Calls out to ' || string_agg(name, ', ' ORDER BY k) FILTER (k < n) || ', and ' || string_agg(name, '') FILTER (k = n) FROM w""")
def told_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as findings and suppliers as third parties, told in sentences."""
    kind, key = F.col("p_size") % 3, F.col("p_partkey")
    findings = tables.table(spark, sf_dir, "part").select(
        key.alias("seq"), F.when(kind == 0, "express_route").when(kind == 1, "database_connection").otherwise("external_api_call").alias("pattern"), F.when(F.col("p_size") % 2 == 0, "express").otherwise(F.col("p_name")).alias("framework"), F.col("p_brand").alias("client"),
        F.when(F.col("p_size") % 4 == 0, "postgres").alias("database"), F.lit("AWS").alias("service"), F.when(key % 10 == 0, "dependency_manifest").alias("source_context"))
    components = tables.table(spark, sf_dir, "supplier").select(F.lit("third_party").alias("type"), F.col("s_name").alias("service"))
    return normalise.sentences(findings, components)
