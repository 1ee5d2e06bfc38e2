"""Queries on the lineage of ids, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factgraph.operators import lineage
from factgraph.sources import tables

from .registry import query

#: Parts are merged into parts of a later size class or, by their retail price, into one of few hubs.
_MERGES = """merges AS (SELECT (p_size % 9)::BIGINT AS step, 'p' || p_partkey AS old, 'p' || CASE WHEN p_size % 5 = 0 THEN 1 + p_partkey % 7 ELSE 1 + (p_partkey * 31 + p_size) % n END AS new
  FROM part, (SELECT count(*) AS n FROM part))"""


def _merges(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = tables.table(spark, sf_dir, "part")
    n = part.count()
    new = F.when(F.col("p_size") % 5 == 0, 1 + F.col("p_partkey") % 7).otherwise(1 + (F.col("p_partkey") * 31 + F.col("p_size")) % n)
    return part.select((F.col("p_size") % 9).cast("long").alias("step"), F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("old"), F.concat(F.lit("p"), new.cast("string")).alias("new"))


@query(f"""WITH RECURSIVE {_MERGES}, walk AS (
  SELECT old AS id, step, new AS here, step AS done, 1::BIGINT AS hops FROM merges
  UNION ALL SELECT w.id, w.step, m.new, m.step, w.hops + 1 FROM walk w JOIN merges m ON m.old = w.here AND m.step > w.done)
SELECT id, step, max_by(here, hops) AS final, max(hops) AS hops FROM walk GROUP BY id, step""")
def id_lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where every merged part ends after the later merges."""
    return lineage.lineage(_merges(spark, sf_dir))


@query(f"""WITH RECURSIVE {_MERGES}, edges AS (SELECT old, new FROM merges WHERE old <> new), walk AS (
  SELECT old AS id, new AS here, 1::BIGINT AS hops, [new] AS seen, false AS looped FROM edges
  UNION ALL SELECT w.id, e.new, w.hops + 1, list_append(w.seen, e.new), list_contains(w.seen, e.new) FROM walk w JOIN edges e ON e.old = w.here WHERE NOT w.looped),
last AS (SELECT id, max_by(here, hops) AS here, max(hops) AS hops, max_by(seen, hops) AS seen, bool_or(looped) AS looped FROM walk GROUP BY id)
SELECT id AS old, CASE WHEN looped THEN list_min(list_slice(seen, list_position(seen, here), len(seen))) ELSE here END AS final, CASE WHEN NOT looped THEN hops END AS hops, looped AS cyclic FROM last""")
def id_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where every merged part ends if merges have no order; cycles end at their least id."""
    return lineage.final_ids(_merges(spark, sf_dir))


@query("""WITH before AS (SELECT 's' || s_suppkey AS id, s_nationkey || '|' || (s_acctbal > 0) AS key FROM supplier WHERE s_suppkey % 10 <> 0),
final AS (SELECT s_nationkey || '|' || (s_acctbal > 0) AS key, max_by('s' || s_suppkey, s_suppkey) AS final FROM supplier WHERE s_acctbal < 9000 AND s_suppkey % 10 <> 0 GROUP BY 1)
SELECT 's' || l_suppkey AS was, coalesce(final, 's' || l_suppkey) AS target, count(*) AS n FROM lineitem LEFT JOIN (SELECT id, final FROM before JOIN final USING (key)) ON id = 's' || l_suppkey GROUP BY ALL""")
def proposal_remap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proposals by the supplier that they name and the one that has its key after a merge by nation and balance; every tenth isn't a third party."""
    supplier = tables.table(spark, sf_dir, "supplier")
    key = F.concat_ws("|", F.col("s_nationkey").cast("string"), (F.col("s_acctbal") > 0).cast("string"))
    kind = F.when(F.col("s_suppkey") % 10 == 0, "asset").otherwise("third_party")
    rows = supplier.select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("id"), kind.alias("type"), key.alias("key"), F.col("s_suppkey").alias("seq"), "s_acctbal")
    remap = lineage.key_remap(rows, rows.filter("s_acctbal < 9000"))
    proposals = tables.proposals(spark, sf_dir).groupBy("target").agg(F.count("*").alias("n")).withColumn("was", F.col("target"))
    return lineage.remapped(proposals, remap).select("was", "target", "n")
