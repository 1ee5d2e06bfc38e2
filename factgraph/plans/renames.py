"""Queries on renamed files, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factgraph.operators import renames, third_party
from factgraph.sources import tables

from .registry import query

#: The snapshots: documents with even ids, and all others with the even ones of three sources, so that copies of the rest look like renames.
_RENAMES = r"""docs AS (SELECT 'docs/' || source || '/' || doc_id || '.txt' AS path, coalesce(text, '') AS content, doc_id % 2 = 0 AS even, source IN ('src1', 'src2', 'src3') AS kept FROM documents),
gone AS (SELECT path, content, md5(content) AS hash FROM docs WHERE even AND NOT kept AND content <> ''), come AS (SELECT path, content, md5(content) AS hash FROM docs WHERE NOT even AND content <> ''),
olds AS (SELECT hash AS s, min(path) AS s_name, count(*) AS s_n, max(length(content)) AS s_size FROM gone GROUP BY hash), news AS (SELECT hash AS d, min(path) AS d_name, count(*) AS d_n, max(length(content)) AS d_size FROM come GROUP BY hash),
chunks AS (SELECT hash, chunk, count(*) AS n, max(length(chunk)) AS len FROM (SELECT hash, unnest(regexp_extract_all(content, '[^\n]{0,63}\n|[^\n]{1,64}')) AS chunk FROM (SELECT hash, any_value(content) AS content FROM (FROM gone UNION ALL FROM come) GROUP BY hash)) GROUP BY hash, chunk),
common AS (SELECT a.hash AS s, b.hash AS d, sum(least(a.n, b.n) * a.len) AS common FROM (FROM chunks SEMI JOIN gone USING (hash)) a JOIN (FROM chunks SEMI JOIN come USING (hash)) b USING (chunk) WHERE a.hash <> b.hash GROUP BY ALL),
edges AS (SELECT s, d, s_name, d_name, s_n, d_n, score FROM (SELECT *, common / greatest(s_size, d_size) AS score FROM common JOIN olds USING (s) JOIN news USING (d)) WHERE score >= 0.5 UNION ALL SELECT s, d, s_name, d_name, s_n, d_n, 1 FROM olds JOIN news ON s = d),
picks AS (
  SELECT 0 AS turn, [{'s': '', 'd': '', 'm': 0::BIGINT, 'score': 1::DOUBLE, 's0': 0::BIGINT, 'd0': 0::BIGINT}] AS taken
  UNION ALL
  SELECT turn + 1, list_append(taken, pick) FROM (
    SELECT turn, taken, arg_min({'s': s, 'd': d, 'm': least(s_n - s_used, d_n - d_used)::BIGINT, 'score': score, 's0': s_used, 'd0': d_used}, (-score, s_name, d_name)) AS pick FROM (
      SELECT p.turn, p.taken, e.*, coalesce(list_sum(list_transform(list_filter(p.taken, lambda x: x.s = e.s), lambda x: x.m)), 0)::BIGINT AS s_used, coalesce(list_sum(list_transform(list_filter(p.taken, lambda x: x.d = e.d), lambda x: x.m)), 0)::BIGINT AS d_used
      FROM picks p, edges e)
    WHERE s_used < s_n AND d_used < d_n GROUP BY turn, taken) WHERE pick IS NOT NULL),
each AS (SELECT x.s, x.d, x.score, x.s0 + k AS s_at, x.d0 + k AS d_at FROM (SELECT unnest(taken) AS x FROM (SELECT arg_max(taken, turn) AS taken FROM picks)), LATERAL (SELECT unnest(range(1, x.m + 1)) AS k)),
renamed AS (SELECT g.path AS "from", c.path AS "to", score AS similarity FROM each JOIN (SELECT *, row_number() OVER (PARTITION BY hash ORDER BY path) AS s_at FROM gone) g ON g.hash = each.s AND g.s_at = each.s_at
  JOIN (SELECT *, row_number() OVER (PARTITION BY hash ORDER BY path) AS d_at FROM come) c ON c.hash = each.d AND c.d_at = each.d_at)"""


def _snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs = tables.table(spark, sf_dir, "documents").select(F.concat(F.lit("docs/"), "source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), F.coalesce("text", F.lit("")).alias("content"), (F.col("doc_id") % 2 == 0).alias("even"), F.col("source").isin("src1", "src2", "src3").alias("kept"))
    return docs.filter("even").select("path", "content"), docs.filter("not even or kept").select("path", "content")


@query(f'WITH RECURSIVE {_RENAMES} SELECT "from", "to", round(similarity, 9) AS similarity FROM renamed')
def detected_renames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with odd ids as renames of those with even ones."""
    return renames.detected_renames(*_snapshots(spark, sf_dir)).withColumn("similarity", F.round("similarity", 9))


@query(f"""WITH RECURSIVE {_RENAMES}, base AS (SELECT path, content FROM docs WHERE even), head AS (SELECT path, content FROM docs WHERE NOT even OR kept),
moved AS (SELECT coalesce("to", path) AS path, CASE WHEN "to" IS NOT NULL THEN path END AS previous, content AS old FROM base LEFT JOIN renamed ON "from" = path)
SELECT change, count(*) AS n, count(previous) AS renamed FROM (SELECT CASE WHEN m.path IS NULL THEN 'added' WHEN h.path IS NULL THEN 'removed' WHEN m.old <> h.content THEN 'changed' WHEN m.previous IS NOT NULL THEN 'renamed' END AS change, m.previous
  FROM moved m FULL JOIN head h ON h.path = m.path) WHERE change IS NOT NULL GROUP BY change""")
def snapshot_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What became of the documents of one snapshot in the other, through the renames that were found."""
    base, head = _snapshots(spark, sf_dir)
    found = renames.detected_renames(base, head).select("from", "to")
    base, head = (x.select(F.col("path").alias("key"), F.sha2(F.col("content").cast("binary"), 256).alias("digest")) for x in (base, head))
    changes = third_party.renamed_diff(base, head, found, "digest")
    return changes.groupBy("change").agg(F.count("*").alias("n"), F.count("previous").alias("renamed"))
