"""Queries on services that providers manage, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factgraph.operators import managed
from factgraph.sources import tables
from factgraph.sources.tables import with_relations

from .registry import query

RULES = [
    ("aws", 1, "lambda", "Lambda", "asset", "compute_service", "api_call", ["lambda"], False, ["aws_lambda_function"], []), ("aws", 2, "s3", "S3", "asset", "storage", "file_transfer", ["s3"], False, [], ["aws_s3_", "aws_backup"]),
    ("aws", 3, "postgres", "RDS", "asset", "database", "database_query", ["rds", "postgres"], False, [], []), ("azure", 1, "blob", "Blob", "asset", "storage", "api_call", ["blob"], False, [], ["azurerm_"]), ("azure", 2, "portal", "Portal", "asset", "service", "api_call", [], True, [], []),
]

#: Parts as assets, every second one of infrastructure code; suppliers as providers.
_MANAGED = with_relations("flows").rstrip() + """, nodes AS (SELECT 'p' || p_partkey AS id, p_partkey AS seq, CASE WHEN p_partkey % 5 = 1 THEN 'database' ELSE 'service' END AS sub_type, CASE WHEN p_partkey % 5 = 1 AND p_size % 4 = 0 THEN 'PG ' || p_name ELSE p_name END AS name, CASE WHEN p_partkey % 13 = 0 THEN 'Root' ELSE p_brand END AS section,
    CASE WHEN p_partkey % 2 = 0 THEN CASE p_size % 6 WHEN 0 THEN 'aws_lambda_function' WHEN 1 THEN 'AWS_S3_bucket' WHEN 2 THEN 'aws_rds_cluster' WHEN 3 THEN 'azurerm_blob' WHEN 4 THEN 'aws_iam_lambda' END END AS resource_type, CASE WHEN p_partkey % 2 = 0 THEN p_name END AS block_name, CASE WHEN p_partkey % 2 = 0 THEN 'mod.x' || p_partkey END AS address,
    CASE p_partkey % 7 WHEN 0 THEN 'aws' WHEN 1 THEN 'azure' END AS cloud, CASE WHEN p_partkey % 17 = 0 THEN 's' || p_partkey % 50 END AS managed_by, CASE WHEN p_partkey % 17 = 0 THEN 's3' END AS managed_key FROM part),
prov AS (SELECT 's' || s_suppkey AS id, s_suppkey AS seq, CASE s_suppkey % 3 WHEN 0 THEN 'aws' WHEN 1 THEN 'azure' ELSE 'vercel' END AS provider, s_suppkey % 3 AS provider_seq, CASE WHEN s_suppkey % 9 = 0 THEN NULL ELSE 'Brand#' || (1 + s_suppkey % 25) END AS section, CASE s_suppkey % 4 WHEN 0 THEN 'uses S3' WHEN 1 THEN 'postgres://x' ELSE 'none' END AS word FROM supplier),
rule(provider, rseq, key, label, to_type, to_sub, flow_type, signals, always) AS (VALUES ('aws', 1, 'lambda', 'Lambda', 'asset', 'compute_service', 'api_call', ['lambda'], false), ('aws', 2, 's3', 'S3', 'asset', 'storage', 'file_transfer', ['s3'], false), ('aws', 3, 'postgres', 'RDS', 'asset', 'database', 'database_query', ['rds', 'postgres'], false),
  ('azure', 1, 'blob', 'Blob', 'asset', 'storage', 'api_call', ['blob'], false), ('azure', 2, 'portal', 'Portal', 'asset', 'service', 'api_call', []::VARCHAR[], true)),
keyed AS (SELECT *, CASE WHEN lower(trim(coalesce(section, ''))) IN ('', 'root', '<unsectioned>', 'global') THEN '' ELSE lower(trim(section)) END AS s, lower(coalesce(resource_type, '')) AS rt FROM nodes),
turns AS (SELECT p.id AS pid, p.provider, CASE WHEN section IS NULL THEN '' ELSE lower(section) END AS s, r.* EXCLUDE (provider), row_number() OVER (ORDER BY provider_seq, p.seq, rseq) AS turn, list_bool_or(list_transform(r.signals, lambda x: contains(lower(p.word), x))) AS coded FROM prov p JOIN rule r USING (provider)),
m AS (SELECT k.id, k.s, k.managed_by IS NULL AS free, k.block_name, r.provider, r.key FROM keyed k JOIN rule r ON (r.provider = 'aws' AND (starts_with(rt, 'aws_') OR coalesce(cloud, '') = 'aws')) OR (r.provider = 'azure' AND (starts_with(rt, 'azurerm_') OR starts_with(rt, 'azapi_') OR coalesce(cloud, '') = 'azure'))
  WHERE address IS NOT NULL AND CASE r.key WHEN 'lambda' THEN rt = 'aws_lambda_function' WHEN 's3' THEN starts_with(rt, 'aws_s3_') OR starts_with(rt, 'aws_backup') WHEN 'blob' THEN starts_with(rt, 'azurerm_')
    WHEN 'postgres' THEN (contains(concat_ws(' ', rt, lower(block_name), address), 'rds') OR contains(concat_ws(' ', rt, lower(block_name), address), 'postgres')) AND (rt = '' OR contains(rt, 'rds') OR contains(rt, 'postgres')) ELSE false END),
adopted AS (SELECT m.id, min(t.turn) AS turn, any_value(m.block_name) AS block FROM m JOIN turns t ON t.provider = m.provider AND t.key = m.key AND (t.s = '' OR m.s = '' OR t.s = m.s) WHERE m.free GROUP BY m.id),
many AS (SELECT turn, count(*) AS n FROM adopted GROUP BY turn),
dbs AS (SELECT *, coalesce(cloud, '') AS hint FROM keyed WHERE sub_type = 'database' AND address IS NULL AND (contains(lower(name), 'pg') OR contains(lower(name), 'postgres'))),
rest AS (SELECT t.*, EXISTS (SELECT 1 FROM m WHERE m.provider = t.provider AND m.key = t.key AND (t.s = '' OR m.s = '' OR t.s = m.s)) AS seen,
  CASE WHEN t.key = 'postgres' THEN (SELECT arg_min(d.id, d.seq) FROM dbs d WHERE (t.s = '' OR d.s = '' OR t.s = d.s) AND (t.coded OR contains(d.hint, t.provider))) END AS stands, (SELECT arg_min(k.id, k.seq) FROM keyed k WHERE k.managed_by = t.pid AND k.managed_key = t.key) AS held FROM turns t WHERE t.turn NOT IN (SELECT turn FROM many)),
plan AS (SELECT t.pid AS provider_id, t.key, a.id AS node, 'adopt' AS action, CASE WHEN n > 1 THEN label || ' · ' || coalesce(nullif(trim(a.block), ''), a.id) ELSE label END AS name, t.to_sub AS sub_type, t.flow_type FROM adopted a JOIN many USING (turn) JOIN turns t USING (turn)
  UNION ALL SELECT pid, key, coalesce(stands, held, 'cmp_managed_' || provider || '_' || key || '_' || pid), CASE WHEN stands IS NOT NULL THEN 'rename' WHEN held IS NOT NULL THEN 'keep' ELSE 'create' END, CASE WHEN stands IS NOT NULL OR held IS NULL THEN label END, CASE WHEN stands IS NULL AND held IS NULL THEN to_sub END, flow_type
  FROM rest WHERE stands IS NOT NULL OR seen OR always OR coalesce(coded, false))"""


def _plan(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    part, k, size, none = tables.table(spark, sf_dir, "part"), F.col("p_partkey"), F.col("p_size"), F.lit(None).cast("string")
    code = F.when(size % 6 == 0, "aws_lambda_function").when(size % 6 == 1, "AWS_S3_bucket").when(size % 6 == 2, "aws_rds_cluster").when(size % 6 == 3, "azurerm_blob").when(size % 6 == 4, "aws_iam_lambda")
    nodes = part.select(
        F.concat(F.lit("p"), k.cast("string")).alias("id"), k.alias("seq"), F.lit("asset").alias("type"), F.when(k % 5 == 1, "database").otherwise("service").alias("sub_type"), F.when((k % 5 == 1) & (size % 4 == 0), F.concat(F.lit("PG "), "p_name")).otherwise(F.col("p_name")).alias("name"), none.alias("client"),
        F.when(k % 13 == 0, "Root").otherwise(F.col("p_brand")).alias("section"), F.when(k % 2 == 0, code).alias("resource_type"), F.when(k % 2 == 0, F.col("p_name")).alias("block_name"), F.when(k % 2 == 0, F.concat(F.lit("mod.x"), k.cast("string"))).alias("address"),
        F.when(k % 7 == 0, "aws").when(k % 7 == 1, "azure").alias("cloud_provider"), none.alias("service"), none.alias("vendor"), F.when(k % 17 == 0, F.concat(F.lit("s"), (k % 50).cast("string"))).alias("managed_by"), F.when(k % 17 == 0, "s3").alias("managed_key"))
    s = F.col("s_suppkey")
    supplier = tables.table(spark, sf_dir, "supplier").withColumn("id", F.concat(F.lit("s"), s.cast("string")))
    providers = supplier.select("id", s.alias("seq"), F.when(s % 3 == 0, "aws").when(s % 3 == 1, "azure").otherwise("vercel").alias("provider"), (s % 3).alias("provider_seq"), F.when(s % 9 != 0, F.concat(F.lit("Brand#"), (1 + s % 25).cast("string"))).alias("section"))
    corpus = supplier.select("id", F.when(s % 4 == 0, "uses S3").when(s % 4 == 1, "postgres://x").otherwise("none").alias("word"))
    rules = spark.createDataFrame(RULES, "provider string, seq int, key string, label string, type string, sub_type string, flow_type string, signals array<string>, always boolean, exact array<string>, prefixes array<string>")
    return managed.managed_plan(providers, nodes, rules, corpus, tables.flows(spark, sf_dir))


@query(_MANAGED + " SELECT provider_id, key, node, action, name, sub_type FROM plan")
def managed_services(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What becomes of the services of suppliers as providers: adopted, renamed, kept or created."""
    return _plan(spark, sf_dir)[0].select("provider_id", "key", "node", "action", "name", "sub_type")


@query(_MANAGED + " SELECT provider_id AS source, node AS target, arg_min(flow_type, key) AS type, 0.78::DOUBLE AS confidence FROM plan p WHERE NOT EXISTS (SELECT 1 FROM flows f WHERE f.source = p.provider_id AND f.target = p.node) GROUP BY ALL")
def managed_service_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New flows from suppliers as providers to their services."""
    return _plan(spark, sf_dir)[1]
