"""Queries on rules that are data, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factgraph.operators import rules
from factgraph.sources import tables
from factgraph.sources.tables import with_relations

from .registry import query


@query(with_relations("files", "lines").rstrip() + r""", words AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[a-z]{5,}')) AS word FROM benchmark),
seen AS (SELECT path, line_no, unnest(list_distinct(regexp_extract_all(line, '[A-Za-z0-9_]+'))) AS word FROM lines),
ends AS (SELECT path, line_no, unnest(list_distinct(list_transform(regexp_extract_all(line, '[A-Za-z0-9_]+[.,]'), lambda w: lower(left(w, -1))))) AS word FROM lines)
SELECT 'whole:' || word AS rule, count(*) AS lines, count(DISTINCT path) AS files FROM seen JOIN words USING (word) GROUP BY ALL
UNION ALL SELECT 'end:' || word, count(*), count(DISTINCT path) FROM ends JOIN words USING (word) GROUP BY ALL""")
def pattern_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines and files that hold a benchmark's words, or end a clause with them in any case: two rules a word, over a thousand in all."""
    words = tables.table(spark, sf_dir, "benchmark").select(F.explode(F.regexp_extract_all("text", F.lit("[a-z]{5,}"), F.lit(0))).alias("word")).distinct()
    own = F.explode(F.array(
        F.struct(F.concat(F.lit("whole:"), "word").alias("rule"), F.concat(F.lit(r"\b"), "word", F.lit(r"\b")).alias("pattern")),
        F.struct(F.concat(F.lit("end:"), "word").alias("rule"), F.concat(F.lit(r"(?i)\b"), "word", F.lit("[.,]")).alias("pattern")),
    )).alias("r")
    found = rules.pattern_findings(tables.lines(spark, sf_dir), words.select(own).select("r.*"), ["path", "line_no"])
    return found.groupBy("rule").agg(F.count("*").alias("lines"), F.countDistinct("path").alias("files"))


REGEXES = {"colour": "(?i)red|blue|green", "round": "ring|bolt|nut"}
LOOKUPS = {"makers": {"brand#2": "Northern", "brand#4": "Southern", "brand#17": "Eastern"}}
#: By pattern, here a part's type: conditions and what they set, in order.
RULES = {
    "ECONOMY": [
        {"when": {"regex": {"input": "name", "regex": "colour"}}, "set": {"coloured": True, "finish": {"fromInput": "name"}}},
        {"when": {"allOf": [{"notSet": "coloured"}, {"exists": "brand"}]}, "set": {"finish": "plain"}},
        {"when": {"always": True}, "set": {"maker": {"lookup": {"map": "makers", "keyInput": "brand", "transform": "lowercase", "onMissing": "skip"}}}},
        {"when": {"allOf": [{"notSet": "maker"}, {"not": {"regex": {"input": "name", "regex": "round"}}}]}, "set": {"maker": {"preferInputOrConstant": {"input": "brand", "fallback": "none"}}}},
    ],
    "SMALL": [
        {"when": {"anyOf": [{"equals": {"input": "size", "value": 5}}, {"regex": {"input": "name", "regex": "round"}}]}, "set": {"coloured": False, "finish": "small"}},
        {"when": {"not": {"notSet": "finish"}}, "set": {"maker": None}},
    ],
}


@query("""WITH base AS (SELECT *, regexp_matches(p_name, '(?i)red|blue|green') AS colour, regexp_matches(p_name, 'ring|bolt|nut') AS round,
  CASE lower(p_brand) WHEN 'brand#2' THEN '"Northern"' WHEN 'brand#4' THEN '"Southern"' WHEN 'brand#17' THEN '"Eastern"' END AS known FROM part)
SELECT p_partkey AS id,
  CASE p_type WHEN 'ECONOMY' THEN CASE WHEN colour THEN 'true' END WHEN 'SMALL' THEN CASE WHEN p_size = 5 OR round THEN 'false' END END AS coloured,
  CASE p_type WHEN 'ECONOMY' THEN CASE WHEN colour THEN '"' || p_name || '"' WHEN p_brand <> '' THEN '"plain"' END WHEN 'SMALL' THEN CASE WHEN p_size = 5 OR round THEN '"small"' END END AS finish,
  CASE p_type WHEN 'ECONOMY' THEN coalesce(known, CASE WHEN NOT round THEN '"' || p_brand || '"' END) WHEN 'SMALL' THEN CASE WHEN p_size = 5 OR round THEN 'null' END END AS maker
FROM base""")
def inferred_by_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Properties of parts by ordered rules for their type."""
    found = tables.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_type").alias("pattern"), F.col("p_name").alias("name"), F.col("p_brand").alias("brand"), F.col("p_size").alias("size"))
    return rules.infer_by_rules(found, RULES, REGEXES, LOOKUPS).select("id", "coloured", "finish", "maker")
