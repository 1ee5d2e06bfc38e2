"""Queries on identities, aliases, excerpts and statuses, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factgraph.operators import enrichment, facts, graph, text
from factgraph.sources import tables
from factgraph.sources.tables import SEQ, with_relations

from .registry import _rel, _SEQ4, query


@query("""SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN 'tf:aws.' || p_partkey WHEN p_partkey % 7 = 0 THEN 'managed:{acme}|' || p_type || '|' || p_brand ELSE 'app:' || p_brand || '|asset||f' || p_size || '.ts|' || p_name END AS key FROM part""")
def identity_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identities of parts: by address, by what manages them, or by where they are."""
    k = F.col("p_partkey")
    rows = tables.table(spark, sf_dir, "part").select(
        "p_partkey", F.col("p_brand").alias("section"), F.lit("asset").alias("type"), F.lit(None).cast("string").alias("sub_type"), F.concat(F.lit("f"), F.col("p_size").cast("string"), F.lit(".ts")).alias("file"), F.concat(F.lit(" "), F.initcap(F.replace("p_name", F.lit(" "), F.lit("  ")))).alias("name"),
        F.when(k % 5 == 0, F.concat(F.lit("aws."), k.cast("string"))).alias("address"), F.when(k % 7 == 0, "acme").alias("provider_key"), F.col("p_type").alias("service"))
    return rows.select("p_partkey", facts.identity_key(rows).alias("key"))


@query(with_relations("flows") + """SELECT id, '["flow/v1","' || source || '","' || target || '","' || type || '","' || CASE WHEN l_linenumber > 2 THEN 'GET' ELSE '' END || '","","f' || l_linenumber || '"]' AS key, 'flow_' || substr(sha256('["flow/v1","' || source || '","' || target || '","' || type || '","' || CASE WHEN l_linenumber > 2 THEN 'GET' ELSE '' END || '","","f' || l_linenumber || '"]'), 1, 12) AS stable_id FROM flows""")
def flow_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identities of flows."""
    rows = tables.flows(spark, sf_dir).withColumns({"method": F.when(F.col("l_linenumber") > 2, "get"), "endpoint": F.lit(None).cast("string"), "file": F.concat(F.lit("f"), F.col("l_linenumber").cast("string"))})
    return rows.select("id", facts.flow_key().alias("key")).withColumn("stable_id", F.concat(F.lit("flow_"), F.substring(F.sha2("key", 256), 1, 12)))


@query("""WITH a AS (SELECT 's' || s_suppkey AS id, unnest(['s' || s_suppkey, lower(s_name), 'src/m' || s_suppkey % 30 || CASE WHEN s_suppkey % 2 = 0 THEN '/index.ts' ELSE '/a.ts' END, CASE WHEN s_suppkey % 2 = 0 THEN 'src/m' || s_suppkey % 30 ELSE 'src/m' || s_suppkey % 30 || '/a.ts' END, CASE WHEN s_suppkey % 2 = 0 THEN 'src' ELSE 'src/m' || s_suppkey % 30 END]) AS alias FROM supplier)
SELECT alias, min(id) AS id FROM a GROUP BY alias HAVING count(DISTINCT id) = 1""")
def path_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Aliases of suppliers, also by paths, that name one of them."""
    k = F.col("s_suppkey")
    path = F.concat(F.lit("Src/m"), (k % 30).cast("string"), F.when(k % 2 == 0, "/index.ts").otherwise("/a.ts"))
    rows = tables.table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), k.cast("string")).alias("id"), F.col("s_name").alias("name"), path.alias("path"))
    return facts.unique_aliases(facts.aliases_of(rows))


@query(with_relations("files") + """, f AS (SELECT language, path, CASE WHEN length(content) > 500 THEN substr(content, 1, 500) || chr(10) || '...[truncated]' ELSE content END AS excerpt, row_number() OVER (PARTITION BY language ORDER BY path) AS k FROM files)
SELECT language, path, md5(excerpt) AS digest FROM (SELECT *, sum(length(excerpt)) OVER (PARTITION BY language ORDER BY path) AS running FROM f WHERE k <= 28) WHERE running <= 10000""")
def prompt_excerpts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Excerpts of each language's first files."""
    return text.excerpts(tables.files(spark, sf_dir), "language", 28, 500, 10_000).select("language", "path", F.md5(F.col("excerpt").cast("binary")).alias("digest"))


@query(with_relations("answers") + """, gone AS (SELECT fact_id, min((ts, seq)) AS g FROM answers WHERE action = 'remove' GROUP BY fact_id)
SELECT CASE WHEN g IS NULL OR (ts, seq) < g THEN 'applied' WHEN (ts, seq) = g THEN 'removes' ELSE 'ignored' END AS status, count(*) AS n FROM answers LEFT JOIN gone USING (fact_id) GROUP BY 1""")
def binding_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers by status."""
    return facts.status_counts(facts.answer_status(tables.answers(spark, sf_dir)))


@query(with_relations("components", "flows") + """, q AS (SELECT 'actor_kind' AS slot, id AS subject FROM components WHERE type = 'actor' UNION ALL SELECT s, f.id FROM flows f JOIN components a ON a.id = f.source JOIN components b ON b.id = f.target, (VALUES ('purpose'), ('data_categories')) v(s) WHERE b.type = 'third_party' AND a.type <> 'third_party' UNION ALL SELECT 'in_scope', 'system')
SELECT slot, CASE WHEN slot = 'in_scope' OR (slot = 'actor_kind' AND subject LIKE '%7') OR (slot = 'purpose' AND subject LIKE '1%') THEN 'answered' ELSE 'unknown' END AS status, count(*) AS n FROM q GROUP BY ALL""")
def question_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions by slot and whether they are answered."""
    components, flows = _rel(spark, sf_dir, "components", "flows")
    asked = enrichment.questions(components, flows)
    answered = asked.filter("slot = 'in_scope' or (slot = 'actor_kind' and subject like '%7') or (slot = 'purpose' and subject like '1%')")
    return enrichment.with_status(asked, answered).groupBy("slot", "status").agg(F.count("*").alias("n"))


@query(with_relations("flows").rstrip() + """, near AS (SELECT source AS id FROM flows WHERE target = 's3' UNION SELECT target FROM flows WHERE source = 's3' UNION SELECT 's3') SELECT DISTINCT 's3' AS seed, id FROM flows WHERE source IN (FROM near) OR target IN (FROM near)""")
def one_hop_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flows that touch a supplier or its neighbours."""
    return graph.neighbourhood_edges(tables.flows(spark, sf_dir), spark.createDataFrame([("s3",)], "seed string"))


@query(f"SELECT {_SEQ4}, running FROM (SELECT *, sum(l_quantity) OVER w AS running, row_number() OVER w AS k FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey ROWS UNBOUNDED PRECEDING)) WHERE running <= 30 OR k = 1")
def budget_at_least_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of each order within a budget, the first in any case."""
    return facts.budget_prefix(tables.table(spark, sf_dir, "lineitem"), "l_orderkey", [F.col(c) for c in SEQ[1:-1]], "l_quantity", 30, 1).select(*SEQ[:-1], "running")
