"""Queries on handlers that are absorbed by their section's service, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factgraph.operators import absorb, graph
from factgraph.sources import tables
from factgraph.sources.tables import SEQ, with_relations

from .registry import _first, query

#: Parts are assets of their brand: some are handlers by type, name or pattern, a few services or main applications. Suppliers are spread over the brands, every third is AWS.
_ABSORB = with_relations("flows").rstrip() + f""", comps AS (
  SELECT 'cmp_' || p_partkey AS id, p_partkey AS seq, CASE WHEN p_partkey % 97 = 0 THEN 'My Lambda' WHEN p_size % 8 = 0 THEN p_name || ' Handler' ELSE p_name END AS name, 'asset' AS type, CASE WHEN p_partkey % 97 = 0 THEN 'compute_service' WHEN p_size % 4 = 0 THEN 'function' END AS sub_type,
    CASE WHEN p_partkey % 31 = 0 THEN 'Root' ELSE ' ' || p_brand END AS section, round(0.5 + p_size / 100.0, 2)::DOUBLE AS confidence, NULL AS service, NULL AS managed_key, NULL AS managed_by, CASE WHEN p_partkey % 11 = 0 THEN 'serverless_handler' WHEN p_partkey % 13 = 0 THEN 'cron' END AS handler_type, p_partkey % 53 = 0 AS main FROM part
  UNION ALL SELECT 's' || s_suppkey, 1000000000 + s_suppkey, s_name, 'third_party', 'vendor', 'Brand#' || (1 + s_suppkey % 25), 0.9, CASE WHEN s_suppkey % 3 = 0 THEN 'AWS' END, NULL, NULL, NULL, false FROM supplier),
det AS (SELECT 'cmp_' || l_partkey AS id, CASE l_linenumber % 7 WHEN 3 THEN 'AWS_Lambda' ELSE 'express_route' END AS pattern, 'f' || (l_suppkey % 5) AS file, l_linenumber AS start FROM lineitem WHERE l_quantity > 45),
once AS (SELECT id, source, target, type, min(confidence) FILTER (type = low) AS confidence FROM (SELECT *, min(type) OVER (PARTITION BY id) AS low FROM flows WHERE hop = 1) GROUP BY ALL HAVING type = min(low)),
edges AS (SELECT source, replace(target, 'p', 'cmp_') AS target, type, confidence, string_split(id, '-') AS parts FROM once),
named AS (SELECT *, trim(coalesce(section, '')) AS s FROM comps),
handlers AS (SELECT id, name, confidence, s FROM named WHERE s <> '' AND lower(s) NOT IN ('root', '<unsectioned>', 'global') AND type = 'asset' AND managed_key IS NULL AND coalesce(sub_type, '') <> 'compute_service'
  AND (coalesce(handler_type, '') = 'serverless_handler' OR id IN (SELECT id FROM det WHERE lower(pattern) IN ('lambda_handler', 'aws_lambda', 'aws_lambda_go', 'serverless_handler')) OR (sub_type = 'function' AND regexp_matches(lower(name), 'lambda|handler')))),
sections AS (SELECT s, arg_min(confidence, id) AS c FROM handlers GROUP BY s),
plan AS (SELECT s, c, (SELECT arg_min(id, seq) FROM named n WHERE n.s = x.s AND (managed_key = 'lambda' OR (sub_type = 'compute_service' AND name ILIKE '%lambda%'))) AS have,
  (SELECT arg_min(id, seq) FROM named n WHERE n.s = x.s AND type = 'third_party' AND (lower(service) = 'aws' OR lower(name) = 'aws' OR lower(name) LIKE '%amazon%')) AS aws, (SELECT arg_min(id, seq) FROM named n WHERE n.s = x.s AND type = 'asset' AND main) AS hub FROM sections x),
num AS (SELECT *, coalesce(have, 'cmp_' || ((SELECT max(p_partkey) FROM part) + sum((have IS NULL)::INT) OVER (ORDER BY s))) AS into_id, CASE WHEN have IS NULL THEN aws END AS by_id FROM plan),
gone AS (SELECT h.id, h.name, n.into_id FROM handlers h JOIN num n USING (s)),
moved AS (SELECT coalesce(a.into_id, e.source) AS source, coalesce(b.into_id, e.target) AS target, type, confidence, CASE WHEN a.id IS NOT NULL OR b.id IS NOT NULL THEN 'handler_absorbed_into_lambda' END AS note, parts
  FROM edges e LEFT JOIN gone a ON a.id = e.source LEFT JOIN gone b ON b.id = e.target),
first AS (SELECT * FROM moved WHERE source <> target QUALIFY row_number() OVER (PARTITION BY source, target, type ORDER BY parts[1]::BIGINT, parts[2]::BIGINT, parts[3]::BIGINT, parts[4]::BIGINT) = 1),
links AS (SELECT hub AS source, into_id AS target, 0.6::DOUBLE AS confidence, 'section_hub_to_managed_lambda' AS note FROM num WHERE hub IS NOT NULL AND hub <> into_id UNION ALL SELECT by_id, into_id, 0.78, 'provider_to_managed_lambda' FROM num WHERE by_id IS NOT NULL)"""


def _absorbed(spark: SparkSession, sf_dir: str) -> absorb.Absorbed:
    part, key, none = tables.table(spark, sf_dir, "part"), F.col("p_partkey"), F.lit(None).cast("string")
    assets = part.select(
        F.concat(F.lit("cmp_"), key.cast("string")).alias("id"), key.alias("seq"), F.when(key % 97 == 0, "My Lambda").when(F.col("p_size") % 8 == 0, F.concat("p_name", F.lit(" Handler"))).otherwise(F.col("p_name")).alias("name"), F.lit("asset").alias("type"),
        F.when(key % 97 == 0, "compute_service").when(F.col("p_size") % 4 == 0, "function").alias("sub_type"), F.when(key % 31 == 0, "Root").otherwise(F.concat(F.lit(" "), "p_brand")).alias("section"), F.round(0.5 + F.col("p_size") / 100, 2).alias("confidence"),
        none.alias("service"), none.alias("managed_key"), none.alias("managed_by"), F.when(key % 11 == 0, "serverless_handler").when(key % 13 == 0, "cron").alias("handler_type"), (key % 53 == 0).alias("main"),
    )
    s = F.col("s_suppkey")
    vendors = tables.table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("s"), s.cast("string")).alias("id"), (s + 10**9).alias("seq"), F.col("s_name").alias("name"), F.lit("third_party").alias("type"), F.lit("vendor").alias("sub_type"), F.concat(F.lit("Brand#"), (1 + s % 25).cast("string")).alias("section"), F.lit(0.9).alias("confidence"),
        F.when(s % 3 == 0, "AWS").alias("service"), none.alias("managed_key"), none.alias("managed_by"), none.alias("handler_type"), F.lit(False).alias("main"),
    )
    # an id's columns begin with the order, by which the lines lie already
    flows = graph.earliest_per_key(tables.flows(spark, sf_dir).filter("hop = 1").drop("id"), [*SEQ, "source", "target"], ["type", "confidence"])
    flows = flows.select(tables.flow_id().alias("id"), F.struct(*SEQ).alias("seq"), "source", F.regexp_replace("target", "^p", "cmp_").alias("target"), "type", "confidence")
    lines = tables.table(spark, sf_dir, "lineitem").select(F.concat(F.lit("cmp_"), F.col("l_partkey").cast("string")).alias("id"), F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("seq"), F.concat(F.lit("f"), (F.col("l_suppkey") % 5).cast("string")).alias("file"), F.col("l_linenumber").alias("start"), "l_quantity")
    detections = lines.filter("l_quantity > 45").select("id", "seq", F.when(F.col("start") % 7 == 3, "AWS_Lambda").otherwise("express_route").alias("pattern"), "file", "start")
    return absorb.absorb_handlers(assets.unionByName(vendors), flows, lines.select("id", "seq", "file", "start", (F.col("start") + 1).alias("end")), detections)


@query(_ABSORB + " SELECT source, target, type, confidence, note FROM first UNION ALL SELECT source, target, 'api_call', confidence, note FROM links l WHERE NOT EXISTS (SELECT 1 FROM first f WHERE f.source = l.source AND f.target = l.target)")
def absorbed_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flows after handlers are merged into their section's service, with those from its hub and provider."""
    return _absorbed(spark, sf_dir).flows.select("source", "target", "type", "confidence", "note")


@query(_ABSORB + """, loc AS (SELECT coalesce(g.into_id, 'cmp_' || l_partkey) AS id, 'f' || (l_suppkey % 5) AS file, l_linenumber AS start FROM lineitem LEFT JOIN gone g ON g.id = 'cmp_' || l_partkey),
ev AS (SELECT coalesce(g.into_id, det.id) AS id, pattern, file, start FROM det LEFT JOIN gone g ON g.id = det.id)
SELECT n.into_id AS id, n.s AS section, n.have IS NULL AS made, CASE WHEN n.have IS NULL THEN greatest(0.78, c) ELSE (SELECT confidence FROM comps WHERE comps.id = n.have) END AS confidence, n.by_id AS managed_by, (SELECT count(*) FROM gone g WHERE g.into_id = n.into_id) AS handlers,
  (SELECT count(*) FROM (SELECT DISTINCT file, start FROM loc WHERE loc.id = n.into_id)) AS locations, (SELECT count(*) FROM (SELECT DISTINCT pattern, file, start FROM ev WHERE ev.id = n.into_id)) AS detections FROM num n""")
def absorbed_services(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The services that took handlers in, with the evidence that they hold then."""
    x = _absorbed(spark, sf_dir)
    out = x.components.select("id", F.trim("section").alias("section"), F.coalesce(F.col("managed_key") == "lambda", F.lit(False)).alias("made"), "confidence", "managed_by").join(x.absorbed.groupBy(F.col("into").alias("id")).agg(F.count("*").alias("handlers")), "id")
    for name, rows in (("locations", x.locations), ("detections", x.detections)):
        out = out.join(rows.groupBy("id").agg(F.count("*").alias(name)), "id", "left").fillna(0, [name])
    return out
