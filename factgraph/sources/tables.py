"""Input tables and the relations derived from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, language, size (characters), content of every document."""
    content = F.coalesce(F.col("text"), F.lit(""))
    return table(spark, sf_dir, "documents").select(
        F.concat(F.lit("docs/"), "source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"),
        F.col("lang").alias("language"), F.length(content).cast("long").alias("size"), content.alias("content"),
    )


def lines(spark: SparkSession, sf_dir: str, holding: list[str] | None = None) -> DataFrame:
    """path, language, line_no (from 1), line; with ``holding``, only of files of which some line matches one of the patterns, so that others aren't cut into lines."""
    own = files(spark, sf_dir)
    if holding:
        own = own.filter(F.col("content").rlike("(?m)" + "|".join(f"(?:{p})" for p in holding)))
    return own.select("path", "language", F.posexplode(F.split("content", "\r?\n")).alias("at", "line")).select("path", "language", (F.col("at") + 1).cast("long").alias("line_no"), "line")


def components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, name, type, sub_type, section: actors, third parties, databases and application hubs."""
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    def kind(df: DataFrame, prefix: str, key: str, name: str, type_: str, sub_type: str, section) -> DataFrame:
        return df.select(F.concat(F.lit(prefix), F.col(key).cast("string")).alias("id"), F.col(name).alias("name"), F.lit(type_).alias("type"), F.lit(sub_type).alias("sub_type"), section.alias("section"))

    section = F.col("n_name")
    return (
        kind(table(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")), "c", "c_custkey", "c_name", "actor", "user", section)
        .unionByName(kind(table(spark, sf_dir, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")), "s", "s_suppkey", "s_name", "third_party", "vendor", section))
        .unionByName(kind(table(spark, sf_dir, "part"), "p", "p_partkey", "p_name", "asset", "database", F.col("p_brand")))
        .unionByName(kind(nation.filter(F.col("n_nationkey") % 3 != 0), "h", "n_nationkey", "n_name", "asset", "application", section))
    )


def flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, seq columns, source, target, type, confidence: customers to suppliers and suppliers to parts."""
    # a hash table of the orders spares the sorts of all lines
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders").hint("shuffle_hash"), F.col("l_orderkey") == F.col("o_orderkey"))
    seq = [F.col(c) for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")]
    ends = F.array(
        F.struct(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("source"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("target"), F.lit(0).alias("hop")),
        F.struct(F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("source"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("target"), F.lit(1).alias("hop")),
    )
    out = rows.select(*seq, flow_type().alias("type"), flow_confidence().alias("confidence"), F.explode(ends).alias("e")).select(*SEQ[:-1], "e.hop", "e.source", "e.target", "type", "confidence")
    return out.withColumn("id", flow_id())


def flow_type() -> Column:
    """The type of a line's flows."""
    return F.when(F.col("l_returnflag") == "A", "api_call").when(F.col("l_returnflag") == "N", "webhook").otherwise("rpc")


def flow_confidence() -> Column:
    """The confidence of a line's flows."""
    return F.round(1 - F.col("l_discount") * 5, 2)


#: The order of flows, unique.
SEQ = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "hop"]


def flow_id() -> Column:
    """The id of a flow, from its SEQ columns."""
    return F.concat_ws("-", *(F.col(c).cast("string") for c in SEQ))


def kg_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """seq, type, source, target, basis: nations in regions, suppliers handled by nations, and one link per customer's
    nation, so that links repeat."""
    nation, supplier, customer = (table(spark, sf_dir, t) for t in ("nation", "supplier", "customer"))

    def link(df: DataFrame, rank: int, key: str, type_: str, source, target, basis) -> DataFrame:
        return df.select((F.lit(rank * 10**9) + F.col(key)).cast("long").alias("seq"), F.lit(type_).alias("type"), source.alias("source"), target.alias("target"), basis.alias("basis"))

    def n(prefix: str, key: str):
        return F.concat(F.lit(prefix), F.col(key).cast("string"))

    return (
        link(nation, 0, "n_nationkey", "part_of", n("n", "n_nationkey"), n("r", "n_regionkey"), F.lit("schema"))
        .unionByName(link(supplier, 1, "s_suppkey", "handled_by", n("s", "s_suppkey"), n("n", "s_nationkey"), F.when(F.col("s_acctbal") < 0, "debt").otherwise("credit")))
        .unionByName(link(customer, 2, "c_custkey", "located_in", n("m", "c_mktsegment"), n("n", "c_nationkey"), F.when(F.col("c_acctbal") < 0, "debt").otherwise("credit")))
    )


def answers(spark: SparkSession, sf_dir: str, cut_off: float = 95.0) -> DataFrame:
    """seq, fact_id, ts, action (set or remove), property, value."""
    return as_answers(table(spark, sf_dir, "events"), cut_off)


def as_answers(events: DataFrame, cut_off: float = 95.0) -> DataFrame:
    """Events, of a table or a stream, as answers."""
    remove = (F.col("event_type") == "error") & (F.col("value") > cut_off)
    return events.select(F.col("event_id").alias("seq"), F.col("user_id").alias("fact_id"), "ts", F.when(remove, "remove").otherwise("set").alias("action"), F.col("event_type").alias("property"), "value")


def proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, seq columns, target, score, evidence, kind, insert_if_missing."""
    return table(spark, sf_dir, "lineitem").select(
        F.concat_ws("-", *(F.col(c).cast("string") for c in SEQ[:-1])).alias("id"), *SEQ[:-1], F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("target"),
        F.round(1 - F.col("l_tax") * 4, 2).alias("score"), F.col("l_linenumber").alias("evidence"), F.when(F.col("l_linestatus") == "O", "heuristic").otherwise("provider").alias("kind"), (F.col("l_quantity") > 40).alias("insert_if_missing"),
    )


#: The derived relations as DuckDB common table expressions.
CTE = {
    "files": "files AS (SELECT 'docs/' || source || '/' || doc_id || '.txt' AS path, lang AS language, length(coalesce(text, ''))::BIGINT AS size, coalesce(text, '') AS content FROM documents)",
    "lines": "lines AS (SELECT path, language, generate_subscripts(p, 1)::BIGINT AS line_no, unnest(p) AS line FROM (SELECT path, language, string_split_regex(content, '\\r?\\n') AS p FROM files))",
    "components": """components AS (
  SELECT 'c' || c_custkey AS id, c_name AS name, 'actor' AS type, 'user' AS sub_type, n_name AS section FROM customer JOIN nation ON c_nationkey = n_nationkey
  UNION ALL SELECT 's' || s_suppkey, s_name, 'third_party', 'vendor', n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey
  UNION ALL SELECT 'p' || p_partkey, p_name, 'asset', 'database', p_brand FROM part
  UNION ALL SELECT 'h' || n_nationkey, n_name, 'asset', 'application', n_name FROM nation WHERE n_nationkey % 3 <> 0)""",
    "flows": """flows AS (SELECT *, l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey || '-' || hop AS id FROM (
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, hop, CASE hop WHEN 0 THEN 'c' || o_custkey ELSE 's' || l_suppkey END AS source, CASE hop WHEN 0 THEN 's' || l_suppkey ELSE 'p' || l_partkey END AS target,
    CASE l_returnflag WHEN 'A' THEN 'api_call' WHEN 'N' THEN 'webhook' ELSE 'rpc' END AS type, round(1 - l_discount * 5, 2) AS confidence
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey, (VALUES (0), (1)) h(hop)))""",
    "kg_links": """kg_links AS (
  SELECT n_nationkey::BIGINT AS seq, 'part_of' AS type, 'n' || n_nationkey AS source, 'r' || n_regionkey AS target, 'schema' AS basis FROM nation
  UNION ALL SELECT 1000000000 + s_suppkey, 'handled_by', 's' || s_suppkey, 'n' || s_nationkey, CASE WHEN s_acctbal < 0 THEN 'debt' ELSE 'credit' END FROM supplier
  UNION ALL SELECT 2000000000 + c_custkey, 'located_in', 'm' || c_mktsegment, 'n' || c_nationkey, CASE WHEN c_acctbal < 0 THEN 'debt' ELSE 'credit' END FROM customer)""",
    "answers": "answers AS (SELECT event_id AS seq, user_id AS fact_id, ts, CASE WHEN event_type = 'error' AND value > 95 THEN 'remove' ELSE 'set' END AS action, event_type AS property, value FROM events)",
    "proposals": "proposals AS (SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS id, l_orderkey, l_linenumber, l_partkey, l_suppkey, 's' || l_suppkey AS target, round(1 - l_tax * 4, 2) AS score, l_linenumber AS evidence, CASE l_linestatus WHEN 'O' THEN 'heuristic' ELSE 'provider' END AS kind, l_quantity > 40 AS insert_if_missing FROM lineitem)",
}


def with_relations(*names: str) -> str:
    """WITH clause of the named relations; ``lines`` needs ``files`` before it."""
    return "WITH " + ", ".join(CTE[n] for n in names) + "\n"
