"""Queries on facts and the knowledge base, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factgraph.operators import knowledge
from factgraph.sources import storage, tables
from factgraph.sources.tables import with_relations

from .registry import RULES, query

ROOT = "/srv/scan"
_S = "CAST({} AS VARCHAR)"

_CODE_LINKS = """raw AS (SELECT l_orderkey * 10 + l_linenumber AS seq, CASE l_linenumber % 5 WHEN 0 THEN 'occurs_in' WHEN 1 THEN 'handled_by' WHEN 2 THEN 'part_of' WHEN 3 THEN 'uses' ELSE 'defined_in' END AS relation, 'dp::/srv/scan/s' || l_suppkey AS source, '/srv/scan/p' || l_partkey % 40 AS target, l_returnflag AS basis,
  '/srv/scan/src/f' || l_partkey % 20 || '.ts' AS file, l_linenumber::BIGINT AS line FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey * 10 + l_linenumber ORDER BY l_partkey, l_suppkey, l_returnflag) = 1),
links AS (SELECT seq, relation, replace(regexp_replace(source, '^dp::', ''), '/srv/scan/', '') AS source, replace(target, '/srv/scan/', '') AS target, basis, replace(file, '/srv/scan/', '') AS file, line FROM raw)"""


def _code_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    from factgraph.operators.graph import best_per_key

    kinds = F.array(*map(F.lit, ["occurs_in", "handled_by", "part_of", "uses", "defined_in"]))
    rows = tables.table(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"), F.get(kinds, F.col("l_linenumber") % 5).alias("relation"), F.concat(F.lit("dp::/srv/scan/s"), F.col("l_suppkey").cast("string")).alias("source"), F.concat(F.lit("/srv/scan/p"), (F.col("l_partkey") % 40).cast("string")).alias("target"),
        F.col("l_returnflag").alias("basis"), F.concat(F.lit("/srv/scan/src/f"), (F.col("l_partkey") % 20).cast("string"), F.lit(".ts")).alias("file"), F.col("l_linenumber").cast("long").alias("line"), "l_partkey", "l_suppkey")
    return best_per_key(rows, [F.col("seq")], [F.col("l_partkey"), F.col("l_suppkey"), F.col("basis")]).drop("l_partkey", "l_suppkey")


@query(f"WITH {_CODE_LINKS} SELECT relation AS type, source, target, basis FROM links WHERE relation NOT IN ('occurrence_of', 'part_of', 'declared_by', 'occurs_in', 'defined_in', 'observed_in') QUALIFY row_number() OVER (PARTITION BY relation, source, target ORDER BY seq) = 1")
def fact_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relations of a graph, with clean ids."""
    return knowledge.fact_links(_code_links(spark, sf_dir), ROOT)[2]


@query(f"WITH {_CODE_LINKS} SELECT source AS id, array_to_string(list_sort(list(file || ':' || line)), ',') AS refs FROM links WHERE relation IN ('occurs_in', 'defined_in', 'observed_in') GROUP BY source")
def code_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where facts are in the code."""
    refs = knowledge.fact_links(_code_links(spark, sf_dir), ROOT)[0]
    return refs.select("id", F.array_join(F.array_sort(F.transform("refs", lambda r: F.concat(r["file"], F.lit(":"), r["line"].cast("string")))), ",").alias("refs"))


@query(f"""WITH {_CODE_LINKS}, refs AS (SELECT source AS id, count(*) AS n FROM links WHERE relation IN ('occurs_in', 'defined_in', 'observed_in') GROUP BY source), h AS (SELECT source AS id, array_to_string(list_sort(list_distinct(list(target))), ',') AS h FROM links WHERE relation = 'handled_by' GROUP BY source)
SELECT 's' || s_suppkey AS id, s_name AS name, 'third_party' AS type, CASE WHEN s_suppkey % 2 = 0 THEN 'vendor' ELSE '' END AS sub_type, coalesce(refs.n, 0)::INT AS n_refs, coalesce(h.h, '') AS handled_by FROM supplier LEFT JOIN refs ON refs.id = 's' || s_suppkey LEFT JOIN h ON h.id = 's' || s_suppkey""")
def facts_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as facts with what the graph says of them."""
    refs, handlers, _ = knowledge.fact_links(_code_links(spark, sf_dir), ROOT)
    rows = tables.table(spark, sf_dir, "supplier").select(F.concat(F.lit("/srv/scan/s"), F.col("s_suppkey").cast("string")).alias("id"), F.col("s_name").alias("name"), F.lit("third_party").alias("type"), F.when(F.col("s_suppkey") % 2 == 0, "vendor").alias("sub_type"))
    return knowledge.facts_of(rows, refs, handlers, ROOT).withColumn("handled_by", F.array_join("handled_by", ","))


@query("""WITH o AS (SELECT event_type AS item, user_id % 50 AS group_id, CASE event_id % 4 WHEN 0 THEN '' WHEN 1 THEN 'name' ELSE 'schema' || user_id % 3 END AS basis, (event_id % 97)::BIGINT AS line, event_id AS id FROM events), g AS (SELECT item, group_id, count(*) AS occurrences, min((line, id)) AS first FROM o GROUP BY ALL),
b AS (SELECT item, group_id, basis FROM o WHERE basis <> '' GROUP BY item, group_id, basis QUALIFY row_number() OVER (PARTITION BY item, group_id ORDER BY count(*) DESC, basis) = 1)
SELECT item, group_id, occurrences, basis, row_number() OVER (PARTITION BY item ORDER BY first, group_id) AS number FROM g LEFT JOIN b USING (item, group_id)""")
def item_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of events with their basis and number."""
    k = F.col("event_id") % 4
    basis = F.when(k == 0, "").when(k == 1, "name").otherwise(F.concat(F.lit("schema"), (F.col("user_id") % 3).cast("string")))
    rows = tables.table(spark, sf_dir, "events").select(F.col("event_type").alias("item"), (F.col("user_id") % 50).alias("group_id"), basis.alias("basis"), (F.col("event_id") % 97).alias("line"), F.col("event_id").alias("id"))
    return knowledge.item_groups(rows)


_LANDING = """a AS (SELECT event_id AS id, 't' || user_id % 40 AS target, CASE event_type WHEN 'click' THEN 'purpose' WHEN 'view' THEN 'in_scope' WHEN 'signup' THEN 'data_categories' WHEN 'error' THEN 'name' ELSE 'actor_kind' END AS slot, CASE event_id % 9 WHEN 0 THEN 'GPT-x@y' WHEN 1 THEN 'nobody' ELSE 'a@b.c' END AS reviewer,
  CASE WHEN event_id % 11 = 0 THEN 'short' ELSE sha1(event_id::VARCHAR) END AS skill, CASE event_id % 13 WHEN 0 THEN 'gone.txt' WHEN 1 THEN 'x/eval/t.txt' ELSE 'notes.txt' END AS evidence, ' B, a ,b,' || event_type AS value FROM events), asked AS (SELECT DISTINCT target, slot FROM a WHERE target <> 't7'),
done AS (SELECT *, CASE WHEN slot = 'name' THEN 'SLOT_NOT_LANDABLE' WHEN target = 't7' THEN 'NOT_ASKABLE' WHEN reviewer <> 'a@b.c' THEN 'REVIEWER_NOT_HUMAN' WHEN skill = 'short' THEN 'BAD_SKILL_SHA' WHEN evidence = 'gone.txt' THEN 'NO_EVIDENCE' WHEN evidence LIKE '%/eval/%' THEN 'EVIDENCE_NOT_LANDABLE' ELSE 'landed' END AS outcome FROM a)"""


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, t = F.col("event_id"), F.col("event_type")
    return tables.table(spark, sf_dir, "events").select(
        e.alias("id"), F.concat(F.lit("t"), (F.col("user_id") % 40).cast("string")).alias("target"), F.when(t == "click", "purpose").when(t == "view", "in_scope").when(t == "signup", "data_categories").when(t == "error", "name").otherwise("actor_kind").alias("slot"),
        F.when(e % 9 == 0, "GPT-x@y").when(e % 9 == 1, "nobody").otherwise("a@b.c").alias("reviewer"), F.when(e % 11 == 0, "short").otherwise(F.sha1(e.cast("string").cast("binary"))).alias("skill"), F.when(e % 13 == 0, "gone.txt").when(e % 13 == 1, "x/eval/t.txt").otherwise("notes.txt").alias("evidence"), F.concat(F.lit(" B, a ,b,"), t).alias("value"))


def _landing(spark: SparkSession, sf_dir: str) -> DataFrame:
    answers = _answers(spark, sf_dir)
    return knowledge.landing(answers, answers.filter("target <> 't7'").select("target", "slot"), spark.createDataFrame([("x/eval/t.txt",), ("notes.txt",)], "path string"))


@query(f"WITH {_LANDING} SELECT outcome, count(*) AS n, min(id) AS first FROM done GROUP BY outcome")
def landing_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers by what keeps them from landing."""
    return _landing(spark, sf_dir).groupBy("outcome").agg(F.count("*").alias("n"), F.min("id").alias("first"))


@query(f"""WITH {_LANDING}, r AS (SELECT done.id, target, slot, CASE user_id % 6 WHEN 0 THEN ' marketing' WHEN 1 THEN 'contact, health,contact' WHEN 2 THEN '["location", "contact"]' WHEN 3 THEN 'unspecified' WHEN 4 THEN 'Persona' ELSE 'person ' END AS raw FROM done JOIN events ON done.id = event_id WHERE outcome = 'landed')
SELECT id, target, slot, CASE slot WHEN 'in_scope' THEN 'text' WHEN 'data_categories' THEN 'list' ELSE 'enum' END AS shape,
  CASE WHEN slot = 'in_scope' THEN trim(raw) WHEN slot = 'actor_kind' THEN CASE WHEN trim(raw) = 'person' THEN 'person' END WHEN slot = 'purpose' THEN CASE WHEN trim(raw) IN ('marketing', 'unspecified') THEN trim(raw) END
    WHEN starts_with(raw, '[') THEN '["contact","location"]' WHEN raw LIKE '%,%' THEN '["contact","health"]' END AS value,
  CASE WHEN slot = 'actor_kind' AND trim(raw) <> 'person' THEN 'unknown_actor_kind' WHEN slot = 'purpose' AND trim(raw) NOT IN ('marketing', 'unspecified') THEN 'unknown_purpose' WHEN slot = 'data_categories' AND raw = 'unspecified' THEN 'unspecified_category' WHEN slot = 'data_categories' AND raw NOT LIKE '%,%' THEN 'unknown_category' END AS error FROM r""")
def interview_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of the answers that landed, their values by the vocabularies of slots."""
    landed, m = _landing(spark, sf_dir).filter("outcome = 'landed'"), F.col("user_id") % 6
    raw = F.when(m == 0, " marketing").when(m == 1, "contact, health,contact").when(m == 2, '["location", "contact"]').when(m == 3, "unspecified").when(m == 4, "Persona").otherwise("person ")
    said = tables.table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), raw.alias("value"))
    return knowledge.interview_records(_answers(spark, sf_dir).drop("value").join(landed, "id", "left_semi").join(said, "id"))


@query("""WITH s AS (SELECT o_orderkey AS scan, 'v' || o_custkey % 5 AS cli, o_orderpriority AS catalog, o_orderstatus = 'P' AS inference, o_totalprice > 300000 AS dirty FROM orders)
SELECT h.scan, b.cli = h.cli AND b.catalog = h.catalog AND NOT (b.inference OR h.inference OR b.dirty OR h.dirty) AS comparable FROM s b JOIN (SELECT scan - 1 AS scan, cli, catalog, inference, dirty FROM s) h ON b.scan = h.scan""")
def comparability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as scans that can be compared with the next one."""
    scans = tables.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("scan"), F.concat(F.lit("v"), (F.col("o_custkey") % 5).cast("string")).alias("cli"), F.col("o_orderpriority").alias("catalog"), (F.col("o_orderstatus") == "P").alias("inference"), (F.col("o_totalprice") > 300000).alias("dirty"))
    return knowledge.comparable(scans, scans.withColumn("scan", F.col("scan") - 1), "scan", ["cli", "catalog"])


@query("SELECT CASE WHEN doc_id % 6 = 0 THEN 'x' ELSE '' END || sha1(coalesce(text, '')) AS name FROM documents WHERE doc_id % 6 = 0")
def brief_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored texts that aren't what their name says."""
    docs = tables.table(spark, sf_dir, "documents").withColumn("text", F.coalesce("text", F.lit("")))
    return knowledge.tampered(docs.select(F.concat(F.when(F.col("doc_id") % 6 == 0, "x").otherwise(""), F.sha1(F.col("text").cast("binary"))).alias("name"), "text"))


@query("""WITH a AS (SELECT event_id AS id, CASE WHEN event_id % 50 = 0 THEN 'dp:a0/system' ELSE 'f' || user_id END AS fact, 'b' || event_id % 3 AS brief, CASE WHEN event_id % 20 = 0 THEN 'own' END AS key FROM events),
briefs AS (SELECT DISTINCT 'b' || user_id % 3 AS brief, 'f' || user_id AS fact, CASE WHEN user_id % 10 = 0 THEN 'app:old' ELSE 'k' || user_id END AS key FROM events), facts AS (SELECT DISTINCT 'f' || user_id AS fact, 'k' || user_id AS key FROM events WHERE user_id % 4 > 0)
SELECT id, CASE WHEN a.key IS NOT NULL THEN a.key WHEN a.fact = 'dp:a0/system' THEN a.fact WHEN b.key = 'app:old' THEN 'app:root' ELSE coalesce(b.key, f.key) END AS key,
  CASE WHEN a.key IS NOT NULL THEN 'already_keyed' WHEN a.fact = 'dp:a0/system' THEN 'system' WHEN b.key = 'app:old' THEN 'root' WHEN b.key IS NOT NULL THEN 'brief' WHEN f.key IS NOT NULL THEN 'scan' ELSE 'unresolved' END AS outcome
FROM a LEFT JOIN briefs b ON a.brief = b.brief AND a.fact = b.fact LEFT JOIN facts f ON a.fact = f.fact""")
def answer_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What old answers are about."""
    events, e, u = tables.table(spark, sf_dir, "events"), F.col("event_id"), F.col("user_id")
    fact, key = F.concat(F.lit("f"), u.cast("string")), F.concat(F.lit("k"), u.cast("string"))
    answers = events.select(e.alias("id"), F.when(e % 50 == 0, "dp:a0/system").otherwise(fact).alias("fact"), F.concat(F.lit("b"), (e % 3).cast("string")).alias("brief"), F.when(e % 20 == 0, "own").alias("key"))
    briefs = events.select(F.concat(F.lit("b"), (u % 3).cast("string")).alias("brief"), fact.alias("fact"), F.when(u % 10 == 0, "app:old").otherwise(key).alias("key")).distinct()
    return knowledge.answer_elements(answers, briefs, events.filter("user_id % 4 > 0").select(fact.alias("fact"), key.alias("key")).distinct(), "app:root")


@query(with_relations("components") + "SELECT id, type, CASE WHEN type = 'actor' AND id LIKE '%3' THEN name || ' (?)' ELSE name END AS label, CASE WHEN type = 'actor' THEN CASE WHEN id LIKE '%3' THEN 'unknown' ELSE 'known' END END AS status FROM components")
def diagram_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components as nodes of a diagram."""
    return knowledge.diagram_nodes(tables.components(spark, sf_dir).withColumn("actor_kind", F.when(~F.col("id").endswith("3"), "customer")))


@query(with_relations("flows") + "SELECT id, source, target, replace(type, '_', ' ') AS label, CASE WHEN l_orderkey % 3 > 0 AND l_linenumber > 2 THEN 'known' WHEN l_orderkey % 3 = 0 AND l_linenumber <= 2 THEN 'unknown' ELSE 'partial' END AS status FROM flows WHERE source <> target")
def diagram_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flows as edges of a diagram."""
    return knowledge.diagram_edges(tables.flows(spark, sf_dir).withColumns({"categories": F.when(F.col("l_orderkey") % 3 > 0, "x"), "purpose": F.when(F.col("l_linenumber") > 2, "y")}))


@query("""SELECT 's' || s_suppkey AS id, s_name AS name, coalesce((SELECT array_to_string(list_sort(list_distinct(list(p_brand))), ',') FROM part WHERE p_partkey % 50 = s_suppkey % 50 AND p_size > 30), '') AS items FROM supplier""")
def document_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers with the brands that they handle."""
    supplier = tables.table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("id"), F.col("s_name").alias("name"), (F.col("s_suppkey") % 50).alias("m"))
    of = supplier.groupBy("m").agg(F.collect_list("id").alias("handled_by"))
    items = tables.table(spark, sf_dir, "part").filter("p_size > 30").select(F.col("p_brand").alias("item"), (F.col("p_partkey") % 50).alias("m")).distinct().join(of, "m").select("item", "handled_by")
    return knowledge.document_components(supplier, items)


@query("""SELECT event_id, CASE event_id % 4 WHEN 0 THEN '' WHEN 1 THEN 'a,b' WHEN 2 THEN 'plain' ELSE '[broken' END AS categories FROM events""")
def flow_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Categories out of JSON or plain text."""
    texts = F.array(F.lit(None).cast("string"), F.lit('["a", "b"]'), F.lit("plain"), F.lit("[broken"))
    return tables.table(spark, sf_dir, "events").select("event_id", F.array_join(knowledge.parsed_categories(F.get(texts, (F.col("event_id") % 4).cast("int"))), ",").alias("categories"))


@query("SELECT s_suppkey, 'cmp_' || (row_number() OVER (ORDER BY s_suppkey) + (SELECT max(p_partkey) FROM part)) AS new_id FROM supplier")
def next_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of suppliers after those of parts."""
    existing = tables.table(spark, sf_dir, "part").select(F.concat(F.lit("cmp_"), F.col("p_partkey").cast("string")).alias("id"))
    return knowledge.numbered_from(tables.table(spark, sf_dir, "supplier").select("s_suppkey"), existing, "cmp_", ["s_suppkey"])


@query(with_relations("files", "lines") + "SELECT 'r' || path AS id, line_no, line FROM lines WHERE line_no BETWEEN 2 AND 4 AND path LIKE '%5.txt'")
def line_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines 2 to 4 of some files."""
    wanted = tables.files(spark, sf_dir).filter("path like '%5.txt'").select(F.concat(F.lit("r"), "path").alias("id"), "path", F.lit(2).alias("start"), F.lit(4).alias("end"))
    return knowledge.line_ranges(tables.lines(spark, sf_dir), wanted)


@query("""SELECT user_id, array_to_string(list_transform(list_sort(list_distinct(list((CASE WHEN event_type IN ('view', 'signup') THEN 0 ELSE 1 END, event_type))))[1:3], lambda x: x[2]), ',') AS missing FROM events WHERE value > 80 GROUP BY user_id""")
def top_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three types that a user has with high values, important ones first."""
    rows = tables.table(spark, sf_dir, "events").filter("value > 80").groupBy("user_id").agg(F.collect_set("event_type").alias("m"))
    return rows.select("user_id", F.array_join(knowledge.top_missing(F.col("m"), ["view", "signup"], 3), ",").alias("missing"))


@query("""WITH h AS (SELECT event_type AS k, 'u' || user_id AS path, min(event_id) AS seq FROM events GROUP BY ALL)
SELECT k, path FROM h QUALIFY row_number() OVER (PARTITION BY k ORDER BY (path IN (SELECT 'u' || user_id FROM events WHERE value > 99))::INT, seq, path) <= 20""")
def unseen_files_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty users of each type, those without very high values first."""
    events = tables.table(spark, sf_dir, "events").withColumn("path", F.concat(F.lit("u"), F.col("user_id").cast("string")))
    return knowledge.unseen_first(events.select(F.col("event_type").alias("k"), "path", F.col("event_id").alias("seq")), events.filter("value > 99").select("path"), "k", 20)


@query(with_relations("files", "lines").rstrip() + f""", hits AS (SELECT path, line_no, r.name AS rule FROM lines, (VALUES {", ".join(f"('{n}', '{p}')" for n, p in RULES)}) r(name, pattern) WHERE regexp_matches(line, r.pattern))
SELECT path AS file, line_no AS line, rule FROM hits QUALIFY row_number() OVER (PARTITION BY rule ORDER BY path, line_no, rule) <= 20""")
def capped_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first twenty hits of each rule."""
    from factgraph.operators import text

    hits = text.signal_hits(tables.lines(spark, sf_dir, [p for _, p in RULES]), RULES).select(F.col("path").alias("file"), F.col("line_no").alias("line"), "rule")
    return knowledge.capped_evidence(hits, "rule", 20).drop("at")


@query(with_relations("files") + ", seeds AS (SELECT * FROM (VALUES ('docs/src1'), ('docs/src2/1'), ('docs/src3/33.txt/inside'), ('web/')) v(seed)) SELECT DISTINCT seed, path FROM files, seeds WHERE starts_with(path, seed) OR starts_with(seed, path)")
def near_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files below or above some paths."""
    seeds = spark.createDataFrame([("docs/src1",), ("docs/src2/1",), ("docs/src3/33.txt/inside",), ("web/",)], "seed string")
    return knowledge.near_paths(tables.files(spark, sf_dir), seeds)


@query("SELECT DISTINCT user_id AS id FROM events WHERE value > 97 AND user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'click' AND value > 96)")
def unknown_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users of high values that have no click of a high value."""
    events = tables.table(spark, sf_dir, "events").withColumnRenamed("user_id", "id")
    return knowledge.unknown_ids(events.filter("value > 97"), events.filter("event_type = 'click' and value > 96"))


@query("""SELECT p_partkey, array_to_string(list_transform(list_sort(list_filter([['brand', p_brand], ['name', CASE WHEN p_size > 10 THEN p_name ELSE '' END], ['type', CASE WHEN p_size > 25 THEN p_type END]], lambda e: coalesce(trim(e[2]), '') <> ''))[1:2], lambda e: e[1] || '=' || substr(e[2], 1, 5)), ',') AS filled,
  array_to_string(list_filter(['name', 'type'], lambda k: (k = 'name' AND p_size <= 10) OR (k = 'type' AND p_size <= 25)), ',') AS sparse FROM part""")
def slim_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts' properties, shortened, and the names of those that lack."""
    properties = F.create_map(F.lit("type"), F.when(F.col("p_size") > 25, F.col("p_type")), F.lit("name"), F.when(F.col("p_size") > 10, F.col("p_name")).otherwise(""), F.lit("brand"), F.col("p_brand"))
    filled, sparse = knowledge.slim(properties, 2, 12, 5)
    return tables.table(spark, sf_dir, "part").select("p_partkey", F.array_join(F.transform(F.map_entries(filled), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",").alias("filled"), F.array_join(sparse, ",").alias("sparse"))


@query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN true WHEN 1 THEN true ELSE false END AS sensitive FROM events")
def sensitive_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths of environment files."""
    paths = F.array(F.lit("a/.env"), F.lit(".env.local"), F.lit("a/env.ts"), F.lit("x.env"))
    return tables.table(spark, sf_dir, "events").select("event_id", knowledge.is_sensitive_path(F.get(paths, (F.col("event_id") % 4).cast("int"))).alias("sensitive"))


@query(with_relations("files") + "SELECT path, strlen(content)::BIGINT AS size FROM files WHERE NOT regexp_matches(path, '/1[0-9]*[.]txt$|src3/') AND strlen(content) <= 3000")
def scannable_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that a scan for secrets reads."""
    return knowledge.scannable(tables.files(spark, sf_dir), 3000, ["/1[0-9]*[.]txt$", "src3/"])


@query(with_relations("components", "flows") + """SELECT 'component' AS kind, id, NULL AS parent, name FROM components UNION ALL SELECT 'flow', id, source, type FROM flows
UNION ALL SELECT 'item', p_brand, NULL, p_brand FROM part GROUP BY p_brand UNION ALL SELECT DISTINCT 'group', p_brand || ':' || p_type, p_brand, p_brand || ':' || p_type FROM part""")
def state_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All entities of a state in one table."""
    items = tables.table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("item")).agg(F.collect_set(F.concat("p_brand", F.lit(":"), "p_type")).alias("group_ids"))
    return knowledge.state_rows(tables.components(spark, sf_dir), tables.flows(spark, sf_dir), items)


@query("SELECT CASE WHEN event_type = 'view' THEN 0 ELSE 1 END AS rank, event_type || '/' || event_id || '.json' AS path FROM events WHERE event_type IN ('view', 'click') AND event_id % 3 = 0")
def sidecar_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as files of which the JSON objects of two kinds are collected."""
    content = F.when(F.col("event_id") % 3 == 0, F.col("props")).when(F.col("event_id") % 3 == 1, "[1]").otherwise("{broken")
    files = tables.table(spark, sf_dir, "events").select(F.concat("event_type", F.lit("/"), F.col("event_id").cast("string"), F.lit(".json")).alias("path"), content.alias("content"))
    return knowledge.sidecars(files, [("facts", "^view/"), ("items", "^click/")])


_SCAN = """f AS (SELECT 'repo/' || CASE WHEN doc_id % 17 = 0 THEN 'third_party/' WHEN doc_id % 5 = 0 THEN source || '/' ELSE source || '-x/' END || doc_id || CASE WHEN doc_id % 13 = 0 THEN '.min.js' WHEN doc_id % 11 = 0 THEN '.LOCK' ELSE '.txt' END AS path, coalesce(text, '') AS text FROM documents),
sized AS (SELECT path, strlen(text) AS size, replace(path, '/', chr(1)) AS ord FROM f WHERE path NOT LIKE '%/third_party/%' AND NOT regexp_matches(path, '(?i)([.]min[.]js|[.]lock)$')),
counted AS (SELECT *, sum(size) OVER (ORDER BY ord) AS running FROM sized WHERE size <= 20000)"""


def _scan(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    d = F.col("doc_id")
    folder = F.when(d % 17 == 0, "third_party/").when(d % 5 == 0, F.concat("source", F.lit("/"))).otherwise(F.concat("source", F.lit("-x/")))
    path = F.concat(F.lit("repo/"), folder, d.cast("string"), F.when(d % 13 == 0, ".min.js").when(d % 11 == 0, ".LOCK").otherwise(".txt"))
    files = tables.table(spark, sf_dir, "documents").select(path.alias("path"), F.coalesce("text", F.lit("")).cast("binary").alias("content"))
    return knowledge.scan_records(files, 20_000, 200_000)


@query(f"WITH {_SCAN} SELECT path AS id, size FROM counted WHERE running <= 200000")
def scan_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that a scan reads until its budget is spent."""
    return _scan(spark, sf_dir)[0].select("id", "size")


@query(f"WITH {_SCAN} SELECT (SELECT count(*) FROM counted WHERE running <= 200000) AS scanned, (SELECT count(*) FROM sized WHERE size > 20000 AND ord < coalesce((SELECT min(ord) FROM counted WHERE running > 200000), chr(255))) AS over_size, EXISTS (SELECT 1 FROM counted WHERE running > 200000) AS limit_reached")
def scan_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far that scan came."""
    return _scan(spark, sf_dir)[1]


@query("""WITH nodes AS (SELECT 'p' || (p_partkey // CASE WHEN p_partkey % 50 = 0 THEN 2 ELSE 1 END) AS id, CASE WHEN p_size % 25 = 0 THEN ' ' ELSE p_type END AS type FROM part), edges AS (SELECT 'e' || l_orderkey || '-' || l_linenumber AS id, 'p' || l_partkey AS source, 'p' || (l_partkey + l_suppkey) AS target FROM lineitem)
SELECT fault, count(*) AS n, min(id) AS first FROM (SELECT 'repeated_node' AS fault, id FROM nodes GROUP BY id HAVING count(*) > 1 UNION ALL SELECT 'repeated_edge', id FROM edges GROUP BY id HAVING count(*) > 1 UNION ALL SELECT 'node_without_type', id FROM nodes WHERE trim(type) = ''
  UNION ALL SELECT DISTINCT 'edge_without_end', id FROM edges WHERE source NOT IN (SELECT id FROM nodes) OR target NOT IN (SELECT id FROM nodes)) GROUP BY fault""")
def graph_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What keeps parts and line items from being written as a graph."""
    k = F.col("p_partkey")
    nodes = tables.table(spark, sf_dir, "part").select(F.concat(F.lit("p"), F.when(k % 50 == 0, F.floor(k / 2)).otherwise(k).cast("string")).alias("id"), F.when(F.col("p_size") % 25 == 0, " ").otherwise(F.col("p_type")).alias("type"))
    edges = tables.table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("e"), F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"))).alias("id"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("source"), F.concat(F.lit("p"), (F.col("l_partkey") + F.col("l_suppkey")).cast("string")).alias("target"))
    return storage.graph_faults(nodes, edges).groupBy("fault").agg(F.count("*").alias("n"), F.min("id").alias("first"))
