"""Queries on providers and rewrites of flows, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factgraph.operators import absorb, rewrites, routing
from factgraph.sources import tables
from factgraph.sources.tables import with_relations

from .registry import query

KEYS, HINTS, VIA = ["acme", "supplier#000000005"], ["gear", "widget"], ["econ", "standard"]

_NODES = """nodes AS (
  SELECT 's' || s_suppkey AS id, s_name AS name, 'third_party' AS type, 'vendor' AS sub_type, n_name || CASE WHEN s_suppkey % 4 = 0 THEN '/sub' || s_suppkey % 3 ELSE '' END AS section, NULL::VARCHAR AS client, CASE s_suppkey % 10 WHEN 1 THEN 'Acme' WHEN 2 THEN 'acme docs' END AS service,
    NULL::VARCHAR AS managed_by, NULL::VARCHAR AS managed_key, NULL::VARCHAR AS address FROM supplier JOIN nation ON s_nationkey = n_nationkey
  UNION ALL SELECT 'p' || p_partkey, p_name, 'asset', 'database', CASE WHEN p_partkey % 11 = 0 THEN 'Root' ELSE n_name END, lower(p_type), NULL, CASE WHEN p_partkey % 40 = 0 THEN 's' || (1 + p_partkey % 100) END,
    CASE WHEN p_partkey % 40 = 0 THEN CASE WHEN p_partkey % 80 = 0 THEN 'postgres' ELSE 'cache' END END, NULL FROM part JOIN nation ON p_partkey % 25 = n_nationkey
  UNION ALL SELECT 'c' || c_custkey, c_name, 'asset', 'service', n_name, NULL, NULL, NULL, NULL, CASE WHEN c_custkey % 7 = 0 THEN 'aws.' || c_custkey END FROM customer JOIN nation ON c_nationkey = n_nationkey)"""
_LINKS = """links AS (SELECT DISTINCT 'c' || o_custkey AS source, 'p' || l_partkey AS target, CASE l_returnflag WHEN 'A' THEN 'database_query' WHEN 'N' THEN 'api_call' ELSE 'rpc' END AS type, 0.5 + l_linenumber / 20 AS confidence FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  UNION SELECT 's' || l_suppkey, 'p' || l_partkey, 'database_query', 0.9 FROM lineitem WHERE l_linenumber = 1), flows AS (SELECT source || '>' || target || ':' || type || ':' || round(confidence * 100)::INT AS id, * FROM links)"""
_BOTH = f"WITH {_NODES}, {_LINKS}, keyed AS (SELECT *, CASE WHEN lower(trim(coalesce(section, ''))) IN ('', 'root', '<unsectioned>', 'global') THEN '' ELSE lower(trim(section)) END AS s FROM nodes)"


def _nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = tables.table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    none = F.lit(None).cast("string")

    def name(prefix: str, key: str):
        return F.concat(F.lit(prefix), F.col(key).cast("string"))

    k = F.col("s_suppkey")
    sub = F.when(k % 4 == 0, F.concat(F.lit("/sub"), (k % 3).cast("string"))).otherwise("")
    supplier = tables.table(spark, sf_dir, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(
        name("s", "s_suppkey").alias("id"), F.col("s_name").alias("name"), F.lit("third_party").alias("type"), F.lit("vendor").alias("sub_type"), F.concat("n_name", sub).alias("section"), none.alias("client"), F.when(k % 10 == 1, "Acme").when(k % 10 == 2, "acme docs").alias("service"), none.alias("managed_by"), none.alias("managed_key"), none.alias("address"))
    k = F.col("p_partkey")
    part = tables.table(spark, sf_dir, "part").join(nation, k % 25 == F.col("n_nationkey")).select(
        name("p", "p_partkey"), "p_name", F.lit("asset"), F.lit("database"), F.when(k % 11 == 0, "Root").otherwise(F.col("n_name")), F.lower("p_type"), none, F.when(k % 40 == 0, F.concat(F.lit("s"), (1 + k % 100).cast("string"))), F.when(k % 80 == 0, "postgres").when(k % 40 == 0, "cache"), none)
    k = F.col("c_custkey")
    customer = tables.table(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        name("c", "c_custkey"), "c_name", F.lit("asset"), F.lit("service"), "n_name", none, none, none, none, F.when(k % 7 == 0, F.concat(F.lit("aws."), k.cast("string"))))
    return supplier.union(part).union(customer)


def _flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    line, orders = tables.table(spark, sf_dir, "lineitem"), tables.table(spark, sf_dir, "orders")
    type_ = F.when(F.col("l_returnflag") == "A", "database_query").when(F.col("l_returnflag") == "N", "api_call").otherwise("rpc")
    part = F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("target")
    own = line.join(orders.hint("shuffle_hash"), F.col("l_orderkey") == F.col("o_orderkey")).select(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("source"), part, type_.alias("type"), (0.5 + F.col("l_linenumber") / 20).alias("confidence"))
    links = own.unionByName(line.filter("l_linenumber = 1").select(F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("source"), part, F.lit("database_query").alias("type"), F.lit(0.9).alias("confidence"))).distinct()
    return links.withColumn("id", F.concat("source", F.lit(">"), "target", F.lit(":"), "type", F.lit(":"), F.round(F.col("confidence") * 100).cast("int").cast("string")))


_IS_PROVIDER = "(lower(trim(name)) IN ('acme', 'supplier#000000005') OR lower(coalesce(service, '')) IN ('acme', 'supplier#000000005') OR contains(lower(name), 'acme') OR contains(lower(name), 'supplier#000000005'))"
_IS_PRODUCT = "(coalesce(service, '') <> '' AND lower(coalesce(service, '')) NOT IN ('acme', 'supplier#000000005'))"
_IS_MANAGED = "(type = 'asset' AND sub_type = 'database' AND (contains(lower(concat_ws(chr(10), client, name)), 'gear') OR contains(lower(concat_ws(chr(10), client, name)), 'widget')))"


@query(f"{_BOTH} SELECT id, {_IS_PROVIDER} AS provider, {_IS_PRODUCT} AS product, {_IS_MANAGED} AS managed, s AS section FROM keyed")
def provider_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes that are a provider, a product of one, or a resource that one manages."""
    return _nodes(spark, sf_dir).select("id", rewrites.matches_provider(F.col("name"), F.col("service"), KEYS).alias("provider"), rewrites.is_product(F.col("service"), KEYS).alias("product"), rewrites.is_managed_resource(HINTS).alias("managed"), rewrites.section_key(F.col("section")).alias("section"))


@query(f"{_BOTH} SELECT f.id FROM flows f LEFT JOIN nodes t ON t.id = f.target AND t.managed_key = 'postgres' AND t.managed_by IS NOT NULL WHERE t.id IS NULL OR t.managed_by = f.source")
def managed_edge_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flows less those that bypass a managed database's provider."""
    return rewrites.managed_edges_only(_flows(spark, sf_dir), _nodes(spark, sf_dir)).select("id")


#: The providers of each target in order; of a target's flows, each provider sees what the ones before it left.
_ROUTED = f"""target_of AS (SELECT t.id AS target, p.id AS provider, p.id || '|' || t.id AS turn, row_number() OVER (PARTITION BY t.id ORDER BY p.id || '|' || t.id) AS n, t.id LIKE '%5' AS direct FROM (SELECT * FROM keyed WHERE type = 'third_party' AND {_IS_PROVIDER} AND NOT {_IS_PRODUCT} AND s <> '') p
  JOIN (SELECT * FROM keyed WHERE {_IS_MANAGED} AND (contains(coalesce(client, ''), 'econ') OR contains(coalesce(client, ''), 'standard'))) t ON p.s = t.s),
turns AS (SELECT target, max(n) AS last FROM target_of GROUP BY target),
asset AS (SELECT id, coalesce(section, '') AS section, s, coalesce(trim(address), '') AS address, starts_with(id, 'c') AND substr(id, 2)::INT % 3 = 0 AS main, starts_with(id, 'c') AND substr(id, 2)::INT % 11 = 0 AS api FROM keyed),
apis AS (SELECT section, list(id ORDER BY id) AS ids FROM asset WHERE api GROUP BY section),
place AS (SELECT a.id, a.s, a.address, CASE WHEN main THEN list_filter(ids, lambda x: x <> a.id)[1] END AS stand_in FROM asset a LEFT JOIN apis USING (section)),
known AS (SELECT DISTINCT source, target FROM flows),
walk AS (SELECT f.id, 0::BIGINT AS made, 0::BIGINT AS n, f.source, f.target, f.type, f.confidence::DOUBLE AS confidence, 'kept' AS how, NULL::VARCHAR AS turn, NULL::VARCHAR AS hop, NULL::VARCHAR AS provider, NULL::DOUBLE AS hop_confidence FROM flows f WHERE f.target IN (SELECT target FROM turns)
  UNION ALL SELECT '', n, n, provider, target, 'database_query', 0.75::DOUBLE, 'provider_link', NULL, NULL, NULL, NULL FROM target_of t WHERE NOT EXISTS (SELECT 1 FROM known k WHERE k.source = t.provider AND k.target = t.target)
  UNION ALL SELECT id, made, n + 1, CASE WHEN routed AND type IN ('database_query', 'api_call') THEN p ELSE source END, target, type, CASE WHEN routed AND type IN ('database_query', 'api_call') THEN greatest(confidence, 0.75::DOUBLE) ELSE confidence END, CASE WHEN routed AND type IN ('database_query', 'api_call') THEN 'rewired' ELSE how END,
    CASE WHEN routed THEN next_turn END, CASE WHEN routed THEN coalesce(stand_in, source) END, CASE WHEN routed THEN p END, CASE WHEN routed THEN greatest(confidence, 0.72::DOUBLE) END
  FROM (SELECT w.*, t.provider AS p, t.turn AS next_turn, coalesce(t.provider <> w.source AND NOT t.direct AND a.address = '' AND (a.s = '' OR v.s = '' OR a.s = v.s), false) AS routed, a.stand_in
    FROM walk w JOIN target_of t ON t.target = w.target AND t.n = w.n + 1 LEFT JOIN place a ON a.id = w.source LEFT JOIN place v ON v.id = t.provider))"""


@query(f"""{_BOTH.replace('WITH', 'WITH RECURSIVE', 1)}, {_ROUTED} SELECT how, source, target, type, round(confidence, 4) AS confidence FROM (SELECT how, source, target, type, confidence FROM walk JOIN turns USING (target) WHERE n = last
  UNION ALL SELECT 'kept', source, target, type, confidence::DOUBLE FROM flows WHERE target NOT IN (SELECT target FROM turns)
  UNION ALL SELECT 'source_hop', hop, provider, 'api_call', hop_confidence FROM (SELECT *, row_number() OVER (PARTITION BY hop, provider ORDER BY turn, made, id) AS k FROM walk WHERE hop IS NOT NULL) h WHERE k = 1 AND NOT EXISTS (SELECT 1 FROM known x WHERE x.source = h.hop AND x.target = h.provider))""")
def route_through_provider(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flows into managed databases routed through their providers, one after the other."""
    nodes = _nodes(spark, sf_dir)
    number, customer = F.regexp_extract("id", "([0-9]+)", 1).cast("int"), F.startswith("id", F.lit("c"))
    placed = nodes.withColumns({"seq": F.col("id"), "main": customer & (number % 3 == 0), "sub_type": F.when(customer & (number % 11 == 0), "api").otherwise(F.col("sub_type"))})
    pairs = rewrites.provider_targets(nodes, KEYS, HINTS, VIA).select(F.concat_ws("|", "provider", "target").alias("turn"), "provider", "target", F.endswith("target", F.lit("5")).alias("direct"))
    out = routing.route_in_order(_flows(spark, sf_dir).withColumn("seq", F.col("id")), placed, pairs)
    return out.withColumn("confidence", F.round("confidence", 4))


_COLLAPSE = """plain AS (SELECT * FROM keyed WHERE s <> '' AND managed_by IS NULL AND sub_type = 'database' AND client = 'small'), m AS (SELECT s, min(id) AS managed FROM keyed WHERE s <> '' AND managed_key = 'postgres' AND managed_by IS NOT NULL GROUP BY s),
pr AS (SELECT s, min(id) AS provider FROM keyed WHERE s <> '' AND type = 'third_party' AND id IN (SELECT managed_by FROM nodes WHERE managed_by IS NOT NULL) GROUP BY s), fi AS (SELECT s, min(id) AS first FROM plain GROUP BY s),
actions AS (SELECT id, CASE WHEN managed IS NOT NULL THEN 'remove' WHEN provider IS NULL THEN 'keep' WHEN id = first THEN 'promote' ELSE 'remove' END AS action, CASE WHEN managed IS NOT NULL THEN managed WHEN provider IS NULL THEN NULL WHEN id = first THEN provider ELSE first END AS "by"
  FROM plain LEFT JOIN m USING (s) LEFT JOIN pr USING (s) JOIN fi USING (s))"""


def _actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rewrites.collapse_generic(_nodes(spark, sf_dir), (F.col("sub_type") == "database") & (F.col("client") == "small"))


@query(f"{_BOTH}, {_COLLAPSE} SELECT * FROM actions")
def collapse_generic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What becomes of generic databases."""
    return _actions(spark, sf_dir)


@query(f"""{_BOTH}, {_COLLAPSE}, kept AS (SELECT source, target, type FROM flows f LEFT JOIN (SELECT id, "by" FROM actions WHERE action = 'promote') u ON u.id = f.target WHERE source <> target AND source NOT IN (SELECT id FROM actions WHERE action <> 'keep') AND target NOT IN (SELECT id FROM actions WHERE action = 'remove') AND (u.id IS NULL OR u."by" = source))
SELECT source, target, type FROM kept UNION ALL SELECT "by", id, 'database_query' FROM actions WHERE action = 'promote' AND ("by", id) NOT IN (SELECT (source, target) FROM kept)""")
def collapsed_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flows after generic databases are collapsed."""
    return rewrites.after_collapse(_flows(spark, sf_dir), _actions(spark, sf_dir))


_LOCATIONS = "locations AS (SELECT 's' || l_suppkey AS id, 'f' || l_partkey % 50 AS file, l_linenumber::BIGINT AS start, (l_linenumber + l_partkey % 3)::BIGINT AS \"end\", l_orderkey AS seq FROM lineitem UNION ALL SELECT 'c' || o_custkey, 'f' || o_orderkey % 60, 1, 1, o_orderkey FROM orders)"


def _locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = tables.table(spark, sf_dir, "lineitem").select(F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("id"), F.concat(F.lit("f"), (F.col("l_partkey") % 50).cast("string")).alias("file"), F.col("l_linenumber").cast("long").alias("start"), (F.col("l_linenumber") + F.col("l_partkey") % 3).cast("long").alias("end"), F.col("l_orderkey").alias("seq"))
    return line.union(tables.table(spark, sf_dir, "orders").select(F.concat(F.lit("c"), F.col("o_custkey").cast("string")), F.concat(F.lit("f"), (F.col("o_orderkey") % 60).cast("string")), F.lit(1).cast("long"), F.lit(1).cast("long"), "o_orderkey"))


@query(f"WITH {_LOCATIONS} SELECT id, file, start, \"end\", min(seq) AS seq FROM locations GROUP BY ALL")
def location_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Locations without repeats."""
    return rewrites.distinct_locations(_locations(spark, sf_dir))


@query("SELECT DISTINCT 's' || l_suppkey AS left_id, 'c' || o_custkey AS right_id FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def shared_file_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers and customers with an order's file in common."""
    file = F.concat(F.lit("orders/"), F.col("l_orderkey").cast("string"))
    left = tables.table(spark, sf_dir, "lineitem").select(F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("id"), file.alias("file"))
    right = tables.table(spark, sf_dir, "orders").select(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("id"), F.concat(F.lit("orders/"), F.col("o_orderkey").cast("string")).alias("file"))
    return rewrites.shared_files(left, right)


@query(f"{_BOTH}, {_LOCATIONS}, queued AS (SELECT id FROM nodes WHERE id LIKE 's%77' UNION ALL SELECT id FROM flows WHERE confidence > 0.84 AND target LIKE 'p%99') SELECT DISTINCT file AS path FROM locations WHERE id IN (SELECT id FROM queued UNION ALL SELECT unnest([source, target]) FROM flows WHERE id IN (SELECT id FROM queued))")
def referenced_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of some nodes and of the ends of some flows."""
    flows = _flows(spark, sf_dir)
    queued = _nodes(spark, sf_dir).filter("id like 's%77'").select("id").unionByName(flows.filter("confidence > 0.84 and target like 'p%99'").select("id"))
    return rewrites.referenced_paths(queued, flows, _locations(spark, sf_dir))


_CORPUS = """third AS (SELECT * FROM keyed WHERE type = 'third_party'), corpus AS (SELECT id, lower(w) AS word FROM (SELECT id, unnest([name, service, section]) AS w FROM third UNION SELECT e, type FROM (SELECT unnest([source, target]) AS e, type FROM flows) WHERE e IN (SELECT id FROM third)) WHERE w IS NOT NULL AND w <> '' GROUP BY ALL)"""


@query(f"{_BOTH}, {_CORPUS} SELECT * FROM corpus")
def usage_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is said of each supplier."""
    return rewrites.usage_corpus(_nodes(spark, sf_dir).filter("type = 'third_party'"), _flows(spark, sf_dir), ["name", "service", "section"])


@query(f"{_BOTH}, {_CORPUS} SELECT id, word FROM corpus UNION SELECT a.id, c.word FROM third a JOIN third b ON a.s <> '' AND starts_with(b.s, a.s || '/') JOIN corpus c ON c.id = b.id")
def section_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with what is said in the sections below."""
    third = _nodes(spark, sf_dir).filter("type = 'third_party'")
    return rewrites.rolled_up(rewrites.usage_corpus(third, _flows(spark, sf_dir), ["name", "service", "section"]), third)


@query(with_relations("components") + """, hubs AS (SELECT id, section, id AS seq FROM components WHERE type = 'asset' AND sub_type = 'application')
SELECT c.id, coalesce((SELECT min(h.id) FROM hubs h WHERE h.section = c.section), (SELECT min(id) FROM hubs)) AS hub FROM components c WHERE c.type = 'third_party'""")
def preferred_hubs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hub of each supplier's section, else the first of all."""
    rows = tables.components(spark, sf_dir)
    hubs = rows.filter("type = 'asset' and sub_type = 'application'").select("id", "section", F.col("id").alias("seq"))
    return rewrites.preferred_hub(rows.filter("type = 'third_party'").select("id", "section"), hubs)


_RESOURCE = "CASE p_partkey % 4 WHEN 0 THEN 'aws_db_' WHEN 1 THEN 'google_sql_' WHEN 2 THEN 'azurerm_' ELSE 'other_' END || lower(p_type)"


@query(f"""SELECT p_partkey, resource, CASE WHEN starts_with(resource, 'aws_') THEN 'aws' WHEN starts_with(resource, 'google_') THEN 'gcp' WHEN starts_with(resource, 'azurerm_') THEN 'azure' END AS owner,
  resource = 'aws_db_small' OR starts_with(resource, 'google_sql_') AS fits, contains(lower(concat_ws(' ', resource, p_brand, p_name)), 'red') AS signalled FROM (SELECT *, {_RESOURCE} AS resource FROM part)""")
def resource_owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Providers that own a resource type, whether a rule names it, and whether its text holds a signal."""
    k = F.col("p_partkey") % 4
    rows = tables.table(spark, sf_dir, "part").withColumn("resource", F.concat(F.when(k == 0, "aws_db_").when(k == 1, "google_sql_").when(k == 2, "azurerm_").otherwise("other_"), F.lower("p_type")))
    r = F.col("resource")
    return rows.select("p_partkey", "resource", rewrites.owner_of(r, {"aws_": "aws", "google_": "gcp", "azurerm_": "azure"}).alias("owner"), rewrites.matches_resource(r, ["aws_db_small"], ["google_sql_"]).alias("fits"), F.contains(rewrites.signal_text(r, F.col("p_brand"), F.col("p_name")), F.lit("red")).alias("signalled"))


@query("""WITH a AS (SELECT event_id, user_id % 5 = 0 AS managed, event_type = 'signup' AS compute, CASE WHEN value > 90 THEN 'serverless_handler' WHEN value > 80 THEN 'http' END AS handler, event_type, CASE WHEN event_id % 4 = 0 THEN 'function' END AS sub_type, CASE WHEN event_id % 3 = 0 THEN 'My_Handler' ELSE 'run ' || user_id END AS name FROM events)
SELECT event_id FROM a WHERE NOT managed AND NOT compute AND (coalesce(handler, '') = 'serverless_handler' OR event_type = 'click' OR (sub_type = 'function' AND contains(lower(name), 'handler')))""")
def serverless_handlers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as assets that look like handlers."""
    e = F.col("event_id")
    rows = tables.table(spark, sf_dir, "events").select(
        "event_id", F.lit("asset").alias("type"), F.when(F.col("event_type") == "signup", "compute_service").when(e % 4 == 0, "function").alias("sub_type"), F.when(F.col("user_id") % 5 == 0, "queue").alias("managed_key"),
        F.when(F.col("value") > 90, "serverless_handler").when(F.col("value") > 80, "http").alias("handler_type"), F.array(F.lit("env_variable"), F.when(F.col("event_type") == "click", "AWS_Lambda").otherwise(F.col("event_type"))).alias("patterns"),
        F.when(e % 3 == 0, "My_Handler").otherwise(F.concat(F.lit("run "), F.col("user_id").cast("string"))).alias("name"))
    return rows.filter(absorb.is_handler(F.col("patterns"))).select("event_id")


@query("""WITH r AS (SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN 'Ax-ios' WHEN 1 THEN 'node_fetch' ELSE 'Stripe' END AS client, CASE s_suppkey % 5 WHEN 0 THEN 'Stripe' WHEN 1 THEN ' Axios ' END AS service, CASE WHEN s_acctbal < 0 THEN 'https://api.x.com' WHEN s_acctbal < 3000 THEN 'http://localhost:80/' END AS url,
  CASE WHEN s_suppkey % 7 = 0 THEN 'Http Client call' WHEN s_suppkey % 7 = 1 THEN 'Axios' ELSE s_name END AS name, s_nationkey % 6 = 0 AS manifest FROM supplier)
SELECT s_suppkey FROM r WHERE NOT manifest AND coalesce(url, '') <> 'https://api.x.com' AND coalesce(service, '') <> 'Stripe' AND (client <> 'Stripe' OR service IS NOT NULL OR name = 'Http Client call')""")
def bare_clients(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers that are only a transport."""
    k = F.col("s_suppkey")
    rows = tables.table(spark, sf_dir, "supplier").select(
        "s_suppkey", F.when(F.col("s_acctbal") < 0, F.array(F.lit("https://api.x.com"))).when(F.col("s_acctbal") < 3000, F.array(F.lit("http://localhost:80/"))).alias("urls"), F.when(k % 5 == 0, "Stripe").when(k % 5 == 1, " Axios ").alias("service"),
        F.when(k % 4 == 0, "Ax-ios").when(k % 4 == 1, "node_fetch").otherwise("Stripe").alias("client"), F.when(k % 7 == 0, "Http Client call").when(k % 7 == 1, "Axios").otherwise(F.col("s_name")).alias("name"), F.lit(None).cast("string").alias("host"), F.when(F.col("s_nationkey") % 6 == 0, "dependency_manifest").alias("source_context"))
    return rows.filter(rewrites.is_bare_client()).select("s_suppkey")


#: Events as assets of a service's file; the file declares its class on the line that its user's number says.
_SERVICES = """a AS (SELECT event_id AS id, user_id, 'src/' || CASE WHEN user_id % 3 = 0 THEN 'app/' ELSE '' END || 'services/' || CASE WHEN user_id % 4 = 0 THEN 'deep/' ELSE '' END || 'f' || user_id || CASE WHEN user_id % 5 = 0 THEN '.tsx' WHEN user_id % 5 = 1 THEN '.js' ELSE '.ts' END AS path, event_id % 9 AS start, event_id % 2 = 0 AS service, value < 60 AS alone FROM events),
l AS (SELECT DISTINCT path, 1 + user_id % 10 AS line_no, 'export  class U' || user_id || CASE WHEN user_id % 7 = 0 THEN 'Service extends ItemsService {' WHEN user_id % 7 = 1 THEN 'Service extends x.ItemsService {' WHEN user_id % 7 = 2 THEN 'Controller {' ELSE 'Service {' END AS line FROM a)"""


@query(f"""WITH {_SERVICES} SELECT DISTINCT id FROM a JOIN l USING (path) WHERE service AND alone AND path NOT LIKE '%.js' AND line_no BETWEEN greatest(start, 1) AND greatest(start, 1) + 3 AND line LIKE '%Service {{'  AND line NOT LIKE '%ItemsService%'""")
def service_class_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as assets that are only a service's class."""
    u, e = F.col("user_id"), F.col("event_id")
    path = F.concat(F.lit("src/"), F.when(u % 3 == 0, "app/").otherwise(""), F.lit("services/"), F.when(u % 4 == 0, "deep/").otherwise(""), F.lit("f"), u.cast("string"), F.when(u % 5 == 0, ".tsx").when(u % 5 == 1, ".js").otherwise(".ts"))
    events = tables.table(spark, sf_dir, "events").withColumn("path", path)
    tail = F.when(u % 7 == 0, "Service extends ItemsService {").when(u % 7 == 1, "Service extends x.ItemsService {").when(u % 7 == 2, "Controller {").otherwise("Service {")
    lines = events.select("path", (1 + u % 10).alias("line_no"), F.concat(F.lit("export  class U"), u.cast("string"), tail).alias("line")).distinct()
    assets = events.select(e.alias("id"), F.lit("asset").alias("type"), F.when(e % 2 == 0, "service").otherwise("api").alias("sub_type"))
    found = events.select(e.alias("id"), F.explode(F.array(F.lit("auth_middleware"), F.when(F.col("value") < 60, "auth_middleware").otherwise("env_variable"))).alias("pattern"))
    places = events.select(e.alias("id"), "path", (e % 9).cast("int").alias("start_line"), F.lit(None).cast("string").alias("code"))
    return rewrites.service_classes(assets, places, found, lines)
