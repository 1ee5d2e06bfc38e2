"""Queries on enrichment, paths, topology and streams, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factgraph.functions import scalars
from factgraph.operators import enrichment, text, topology
from factgraph.sources import tables
from factgraph.sources.tables import SEQ, with_relations
from factgraph.streaming.answers import answer_stream, keep_newest
from factgraph.streaming.state import keep_facts

from .registry import _ENDS, _SEQ4, _TURNED, _WITH_HITS, CATALOG, GLOBS, RULES, _rel, _turned, query

MANIFEST = "77.txt"
MANAGED = [("cache", "furniture", False), ("queue", "machinery", False), ("supplier", "building", False), ("auth", None, True)]
CAP = 100


def _with_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components with properties: parts have three, some of them empty; suppliers whose id ends in 7 lack their subtype."""
    part = tables.table(spark, sf_dir, "part").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("id"), F.create_map(
        F.lit("brand"), F.col("p_brand"), F.lit("kind"), F.when(F.col("p_size") % 3 == 0, "").otherwise(F.col("p_type")), F.lit("size"), F.when(F.col("p_size") % 5 != 0, F.col("p_size").cast("string"))).alias("properties"))
    rows = tables.components(spark, sf_dir).join(part, "id", "left")
    return rows.withColumns({"properties": F.coalesce("properties", F.expr("cast(map() as map<string, string>)")), "sub_type": F.when((F.col("type") == "third_party") & F.col("id").endswith("7"), "").otherwise(F.col("sub_type"))})


@query(with_relations("components", "flows").rstrip().replace("flows AS (", "flows0 AS (") + ", " + _TURNED + ", " + _ENDS + """
SELECT 'third_party' AS candidate_type, id AS subject, 95 AS priority, 'sub_type' AS missing FROM components WHERE type = 'third_party' AND id LIKE '%7'
UNION ALL SELECT 'node_property', 'p' || p_partkey, 85, CASE WHEN p_size % 15 = 0 THEN 'kind,size' WHEN p_size % 3 = 0 THEN 'kind' ELSE 'size' END FROM part WHERE p_size % 3 = 0 OR p_size % 5 = 0
UNION ALL SELECT 'flow_direction', id, CASE WHEN source_type <> 'actor' AND target_type = 'actor' THEN 90 ELSE 80 END, '' FROM ends
  WHERE (source_type = 'actor' OR target_type = 'actor') AND (confidence < 0.8 OR source_type <> 'actor' AND target_type = 'actor')
UNION ALL SELECT 'missing_interaction', 'cross_section', 88, '' WHERE NOT EXISTS (SELECT 1 FROM ends WHERE source_type <> 'actor' AND target_type <> 'actor' AND source_section <> target_section)""")
def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an inference should look at, by priority."""
    return enrichment.candidates(_with_properties(spark, sf_dir), _turned(spark, sf_dir))


@query(f"SELECT event_id, event_type, CASE WHEN row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) <= {CAP} THEN 'queued' ELSE 'agent_queue_capacity_exceeded' END AS status FROM events")
def agent_capacity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events within and over the capacity of their type."""
    return enrichment.capped(tables.table(spark, sf_dir, "events"), "event_type", "event_id", [F.desc("value"), F.col("event_id")], CAP)


@query("""SELECT p_partkey, tier, CASE WHEN tier = 'large' AND p_type LIKE 'E%' THEN 'economy' ELSE class END AS class FROM (
  SELECT *, CASE WHEN p_brand = 'Brand#11' THEN 'house' ELSE 'other' END AS class FROM (SELECT *, CASE WHEN p_size > 25 THEN 'large' ELSE 'unset' END AS tier FROM part))""")
def property_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Properties of parts after ordered rules, of which the last sees what the first set."""
    rows = tables.table(spark, sf_dir, "part").withColumns({"tier": F.lit("unset"), "class": F.lit("other")})
    rules = [
        ("tier", F.col("p_size") > 25, F.lit("large")),
        ("class", F.col("p_brand") == "Brand#11", F.lit("house")),
        ("class", (F.col("tier") == "large") & F.col("p_type").startswith("E"), F.lit("economy")),
    ]
    return enrichment.infer(rows, rules).select("p_partkey", "tier", "class")


@query("""SELECT doc_id AS id, CASE WHEN quality IS NULL THEN 'no_evidence' WHEN toxic * 2 > 1 THEN 'bad_confidence' WHEN coalesce(lang, '') <> 'en' THEN 'unknown_path' ELSE 'valid' END AS outcome
FROM labels LEFT JOIN documents USING (doc_id)""")
def evidence_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels as proposals: their documents must be among the English ones."""
    labels = tables.table(spark, sf_dir, "labels")
    path = F.concat(F.lit("docs/"), F.col("doc_id").cast("string"))
    files = tables.table(spark, sf_dir, "documents").filter("lang = 'en'").select(path.alias("path"))
    return enrichment.check_evidence(labels.select(F.col("doc_id").alias("id"), (F.col("toxic") * 2.0).alias("confidence")), labels.filter("quality is not null").select(F.col("doc_id").alias("id"), path.alias("path")), files)


_PATCHES = f"""patches AS (SELECT *, round(1 - l_tax * 4, 2) AS score FROM lineitem, (VALUES ('kind'), ('size')) x(property)),
open AS (SELECT p.*, 'p' || l_partkey AS id, CASE WHEN property = 'kind' THEN l_returnflag WHEN l_linenumber % 2 = 0 THEN '' ELSE (l_quantity::INT)::VARCHAR END AS value FROM patches p JOIN part ON l_partkey = p_partkey
  WHERE score >= 0.72 AND CASE WHEN property = 'kind' THEN p_size % 3 = 0 ELSE p_size % 5 = 0 END)
SELECT id, property, value, l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS patch FROM (SELECT *, row_number() OVER (PARTITION BY id, property ORDER BY score DESC, {_SEQ4}) AS k FROM open WHERE value <> '') WHERE k = 1"""


@query("WITH " + _PATCHES)
def proposal_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Empty properties of parts, filled by the best proposal for each."""
    current = _with_properties(spark, sf_dir).select("id", F.explode("properties").alias("property", "value"))
    score = F.round(1 - F.col("l_tax") * 4, 2)
    both = F.explode(F.array(
        F.struct(F.lit("kind").alias("property"), F.col("l_returnflag").alias("value")),
        F.struct(F.lit("size").alias("property"), F.when(F.col("l_linenumber") % 2 == 0, "").otherwise(F.col("l_quantity").cast("int").cast("string")).alias("value")),
    ))
    own = [F.col(c) for c in SEQ[:-1]]
    lines = tables.table(spark, sf_dir, "lineitem").withColumn("score", score).filter("score >= 0.72")
    patches = lines.select(F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("id"), F.concat_ws("-", *(c.cast("string") for c in own)).alias("patch"), "score", *own, both.alias("x")).select("*", "x.property", "x.value").drop("x")
    return enrichment.merge_properties(current, patches, [F.desc("score"), *own])


@query(with_relations("components", "flows") + """SELECT 'system' AS subject, 'in_scope' AS slot, 'Which system is this, and where does it end?' AS about
UNION ALL SELECT id, 'actor_kind', 'Does ' || name || ' stand for one person, for a role or for a kind of user?' FROM components WHERE type = 'actor'
UNION ALL SELECT f.id, slot, CASE slot WHEN 'purpose' THEN 'What for does ' || t.name || ' get data of ' || s.name || '?' ELSE 'Which kinds of data does ' || s.name || ' pass to ' || t.name || '?' END
FROM flows f JOIN components s ON s.id = f.source JOIN components t ON t.id = f.target, (VALUES ('purpose'), ('data_categories')) q(slot) WHERE t.type = 'third_party' AND s.type <> 'third_party'""")
def brief_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an interview should ask."""
    return enrichment.questions(*_rel(spark, sf_dir, "components", "flows"))


@query("""SELECT DISTINCT substr(sha256(user_id || '|' || event_type), 1, 16) AS record_id FROM events WHERE event_id % 2 = 1
EXCEPT SELECT substr(sha256(user_id || '|' || event_type), 1, 16) FROM events WHERE event_id % 2 = 0""")
def idempotent_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of odd events that even ones don't have."""
    events = tables.table(spark, sf_dir, "events")
    return enrichment.new_records(events.filter("event_id % 2 = 0"), events.filter("event_id % 2 = 1"), ["user_id", "event_type"]).select("record_id")


@query("""WITH r AS (SELECT user_id, event_type, json_extract_string(props, '$.k')::INT AS k FROM events),
s AS (SELECT DISTINCT user_id, k FROM r WHERE event_type = 'view' AND k IS NOT NULL)
SELECT *, 'static' AS origin FROM s UNION ALL SELECT *, 'overlay' FROM (SELECT user_id, k FROM r WHERE event_type = 'purchase' AND k IS NOT NULL EXCEPT SELECT * FROM s)""")
def json_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys in the JSON of views, and those that only purchases have."""
    rows = tables.table(spark, sf_dir, "events").select("user_id", "event_type", F.from_json("props", "k int")["k"].alias("k")).filter("k is not null")
    return enrichment.overlay(rows.filter("event_type = 'view'"), rows.filter("event_type = 'purchase'"), ["user_id", "k"])


@query("""SELECT event_id, CASE WHEN event_id % 4 <> 3 THEN props END AS found FROM events""")
def balanced_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The JSON of events out of fences, other words, or texts that are cut off."""
    kind, props = F.col("event_id") % 4, F.col("props")
    text = F.when(kind == 0, props).when(kind == 1, F.concat(F.lit("```json\n"), props, F.lit("\n```"))).when(kind == 2, F.concat(F.lit("Here: "), props, F.lit(" - done}"))).otherwise(F.concat(F.lit("Here: "), F.regexp_replace(props, "\\}$", "")))
    return tables.table(spark, sf_dir, "events").select("event_id", scalars.first_json_object(text).alias("found"))


@query("""WITH n AS (SELECT DISTINCT regexp_extract(html, '<title>(.*?)</title>', 1) AS name FROM pages), b AS (
  SELECT name, regexp_replace(regexp_replace(substr(regexp_replace(regexp_replace(regexp_replace(lower(strip_accents(name)), '[^a-z0-9._-]+', '-', 'g'), '^[-.]+|[-.]+$', '', 'g'), '-{2,}', '-', 'g'), 1, 80), '[-.]+$', ''), '^$', 'item') AS base FROM n)
SELECT name, CASE WHEN count(*) OVER (PARTITION BY base) = 1 THEN base ELSE base || '-' || substr(sha256(name), 1, 6) END AS slug FROM b""")
def slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File-safe names of the pages' titles."""
    names = tables.table(spark, sf_dir, "pages").select(F.regexp_extract(F.coalesce("html", F.lit("")), "<title>(.*?)</title>", 1).alias("name")).distinct()
    return enrichment.slugs(names, scalars.slug_base("name"))


@query("""SELECT user_id, substr(m || CASE WHEN n > 1 THEN ' (+' || (n - 1) || ' more)' ELSE '' END, 1, 300) AS digest FROM (
  SELECT user_id, arg_min(props, event_id) AS m, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY 1)""")
def error_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first error of each user and how many more there are."""
    return enrichment.digest(tables.table(spark, sf_dir, "events").filter("event_type = 'error'"), "user_id", "event_id", "props")


@query("""SELECT n_name, CASE len(s) WHEN 1 THEN s[1] WHEN 2 THEN s[1] || ' and ' || s[2] ELSE array_to_string(s[:-2], ', ') || ', and ' || s[-1] END AS segments FROM (
  SELECT n_name, list_sort(list_distinct(list(c_mktsegment))) AS s FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal > 5000 GROUP BY 1)""")
def segment_enumeration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each nation's segments as a phrase."""
    rich = tables.table(spark, sf_dir, "customer").filter("c_acctbal > 5000").join(tables.table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return rich.groupBy("n_name").agg(F.sort_array(F.collect_set("c_mktsegment")).alias("s")).select("n_name", scalars.joined_names(F.col("s")).alias("segments"))


@query(with_relations("files") + f"""SELECT path, coalesce(section, 'root') AS section FROM files LEFT JOIN (
  SELECT path, arg_max(section, length(section)) AS section FROM files JOIN (SELECT DISTINCT regexp_extract(path, '^(.*)/[^/]*$', 1) AS section FROM files WHERE path LIKE '%{MANIFEST}') ON starts_with(path, section || '/') GROUP BY 1) USING (path)""")
def file_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The section of each file, by the nearest manifest above it."""
    files = tables.files(spark, sf_dir).select("path")
    return topology.sections(files, files.filter(F.col("path").endswith(MANIFEST)))


@query(with_relations("files") + "SELECT path AS id, 'ctn_' || regexp_replace(string_split(path, '/')[2], '[^A-Za-z0-9_-]', '_', 'g') AS container FROM files")
def c4_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers of files: all lie below one folder, so the next level counts."""
    return topology.containers(tables.files(spark, sf_dir).select(F.col("path").alias("id"), "path", F.lit("file").alias("sub_type")))


#: What links may say of a page's path: all of it, more, or only its last part.
_WANTED = "CASE page_id % 3 WHEN 0 THEN path WHEN 1 THEN 'q/' || path ELSE 'zz/' || regexp_extract(path, '([^/]*)$', 1) END"
_PAGE_PATHS = r"p AS (SELECT DISTINCT regexp_extract(url, '://[^/?#]*/([^?#]*)', 1) AS path FROM pages WHERE url LIKE '%://%/%')"
_HREFS = rf"""w AS (SELECT DISTINCT {_WANTED} AS wanted FROM (SELECT page_id, regexp_extract(url, '://[^/?#]*/([^?#]*)', 1) AS path FROM pages WHERE url LIKE '%://%/%'))"""


@query(f"""WITH {_PAGE_PATHS}, {_HREFS}, t AS (SELECT wanted, path, CASE WHEN wanted = path THEN 1 WHEN ends_with(path, '/' || wanted) OR ends_with(wanted, '/' || path) THEN 2
  WHEN regexp_extract(wanted, '([^/]*)$', 1) = regexp_extract(path, '([^/]*)$', 1) THEN 3 END AS tier FROM w, p WHERE wanted <> '' AND path <> '')
SELECT wanted, tier, min(path) AS path, count(*) AS n FROM t WHERE tier IS NOT NULL GROUP BY 1, 2 QUALIFY tier = min(tier) OVER (PARTITION BY wanted)""")
def href_basename_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the pages' links may mean among the paths of all pages."""
    pages = tables.table(spark, sf_dir, "pages")
    paths = pages.filter("url like '%://%/%'").select("page_id", F.regexp_extract("url", "://[^/?#]*/([^?#]*)", 1).alias("path")).filter("path <> ''")
    kind = F.col("page_id") % 3
    wanted = paths.select(F.when(kind == 0, F.col("path")).when(kind == 1, F.concat(F.lit("q/"), "path")).otherwise(F.concat(F.lit("zz/"), scalars.basename(F.col("path")))).alias("wanted"))
    return topology.match_paths(wanted, paths)


@query(with_relations("flows").replace("WITH", "WITH RECURSIVE") + """, ways AS (SELECT DISTINCT source, target FROM flows), r(id, depth) AS (SELECT 's1', 0 UNION SELECT target, depth + 1 FROM r JOIN (SELECT source, target FROM ways UNION SELECT target, source FROM ways) w ON w.source = r.id WHERE depth < 2)
SELECT id, min(depth) AS depth FROM r GROUP BY 1""")
def reach_two_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a supplier reaches in two steps, either way."""
    flows = tables.flows(spark, sf_dir).select("source", "target")
    both = flows.unionByName(flows.select(F.col("target").alias("source"), F.col("source").alias("target")))
    return topology.closure(both, spark.createDataFrame([("s1",)], "id string"), 2)


_MANAGED = ", ".join(f"('{k}', {repr(s) if s else 'NULL'}, {str(a).lower()})" for k, s, a in MANAGED)


@query(with_relations("components") + f""", rules AS (SELECT * FROM (VALUES {_MANAGED}) r(key, signal, always)),
provider AS (SELECT section, min(id) AS source FROM components WHERE type = 'asset' AND sub_type = 'application' GROUP BY 1),
wanted AS (SELECT DISTINCT n_name AS section, key FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN rules ON lower(c_mktsegment) = signal UNION SELECT section, key FROM provider, rules WHERE always),
named AS (SELECT section, key, min(id) AS adopted FROM components JOIN rules ON contains(lower(name), key) GROUP BY ALL)
SELECT source, coalesce(adopted, 'managed:' || section || ':' || key) AS target, CASE WHEN adopted IS NULL THEN 'create' ELSE 'adopt' END AS action FROM wanted JOIN provider USING (section) LEFT JOIN named USING (section, key)""")
def managed_node_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Managed nodes that rules ask for in each section."""
    corpus = tables.table(spark, sf_dir, "customer").join(tables.table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("section"), F.col("c_mktsegment").alias("word"))
    return topology.managed_nodes(tables.components(spark, sf_dir), corpus, MANAGED)


@query(with_relations("files", "lines") + """SELECT path, line_no, line FROM lines JOIN (SELECT path, min(line_no) AS first FROM lines WHERE contains(line, '@') GROUP BY 1) USING (path) WHERE abs(line_no - first) <= 4""")
def symbol_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines around the first at sign of each file."""
    return topology.symbol_context(tables.lines(spark, sf_dir, ["@"]), "@")


@query(with_relations("answers") + "SELECT fact_id, property, value, seq FROM (SELECT *, row_number() OVER (PARTITION BY fact_id, property ORDER BY ts DESC, seq DESC) AS k FROM answers WHERE action = 'set') WHERE k = 1")
def answers_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest answers, kept by a stream of events."""
    schema = tables.table(spark, sf_dir, "events").schema
    return keep_newest(tables.as_answers(answer_stream(spark, f"{sf_dir}/event[s].parquet", schema)))


@query(with_relations("answers") + "SELECT fact_id, property, value, seq FROM (SELECT *, row_number() OVER (PARTITION BY fact_id, property ORDER BY ts DESC, seq DESC) AS k FROM answers WHERE action = 'set' AND fact_id NOT IN (SELECT fact_id FROM answers WHERE action = 'remove')) WHERE k = 1")
def facts_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state of facts that stay, kept by a stream of events with tombstones."""
    schema = tables.table(spark, sf_dir, "events").schema
    return keep_facts(tables.as_answers(answer_stream(spark, f"{sf_dir}/event[s].parquet", schema)))


_KNOWN = sorted({k for k, _ in CATALOG})
_KNOWN_SQL = ", ".join(f"'{k}'" for k in _KNOWN)


@query(f"SELECT p_partkey, array_to_string(list_sort(list_distinct(list_transform(string_split(p_name, ' '), lambda x: CASE WHEN x IN ({_KNOWN_SQL}) THEN x ELSE 'other' END))), ',') AS categories FROM part")
def slot_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of parts' names in the vocabulary."""
    return tables.table(spark, sf_dir, "part").select("p_partkey", F.array_join(enrichment.normalised(F.split("p_name", " "), _KNOWN), ",").alias("categories"))


@query("""SELECT reason, count(*) AS n FROM (SELECT CASE WHEN l_quantity > 45 THEN 'too_many' WHEN l_discount > 0.08 THEN 'too_cheap' WHEN l_linestatus = 'O' AND l_linenumber = 1 THEN 'unsupported' END AS reason FROM lineitem) GROUP BY 1""")
def drop_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines by the first reason against them; null for none."""
    rules = [("too_many", F.col("l_quantity") > 45), ("too_cheap", F.col("l_discount") > 0.08), ("unsupported", (F.col("l_linestatus") == "O") & (F.col("l_linenumber") == 1))]
    return tables.table(spark, sf_dir, "lineitem").select(enrichment.first_reason(rules).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


_SCORE = "0.42 + CASE WHEN bool_or(rule = 'email') THEN 0.2 ELSE 0 END + CASE WHEN bool_or(rule = 'card') THEN 0.1 ELSE 0 END + CASE WHEN bool_or(rule = 'license') THEN 0.08 ELSE 0 END + CASE WHEN count(*) > 3 THEN 0.1 ELSE 0 END"


@query(_WITH_HITS + f"""SELECT path, score, CASE WHEN score >= 0.85 THEN 'high' WHEN score >= 0.65 THEN 'medium' ELSE 'low' END AS band FROM (
  SELECT path, round(least(0.95, greatest(0.35, {_SCORE}))::DOUBLE, 2) AS score FROM hits GROUP BY 1)""")
def evidence_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files' scores by what was found in them, and their bands."""
    parts = [(F.bool_or(F.col("rule") == "email"), 0.2), (F.bool_or(F.col("rule") == "card"), 0.1), (F.bool_or(F.col("rule") == "license"), 0.08), (F.count("*") > 3, 0.1)]
    scored = text.signal_hits(tables.lines(spark, sf_dir, [p for _, p in RULES]), RULES).groupBy("path").agg(enrichment.evidence_score(0.42, parts, 0.35, 0.95).alias("score"))
    return scored.withColumn("band", scalars.band(F.col("score")))


@query("""SELECT conv_id, greatest(sum(greatest(coalesce(i, 0), 0)) + sum(greatest(coalesce(o, 0), 0)), sum(greatest(coalesce(t, 0), 0)))::BIGINT AS total FROM (
  SELECT conv_id, CASE WHEN role = 'user' THEN length(text) ELSE -1 END AS i, CASE WHEN role <> 'user' THEN length(text) END AS o, length(text) + turn - 1 AS t FROM conversations) GROUP BY 1""")
def conversation_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Characters used by conversations, as parts or as reported."""
    size, user = F.length("text"), F.col("role") == "user"
    calls = tables.table(spark, sf_dir, "conversations").select("conv_id", F.when(user, size).otherwise(-1).alias("input"), F.when(~user, size).alias("output"), (size + F.col("turn") - 1).alias("total"))
    return enrichment.usage_totals(calls, "conv_id")


@query(with_relations("files") + """SELECT folder, count(*) AS files, sum(size)::BIGINT AS bytes FROM (SELECT unnest([regexp_extract(path, '^[^/]*'), regexp_extract(path, '^(.*)/[^/]*$', 1)]) AS folder, size FROM files) GROUP BY 1""")
def folder_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files and bytes below each folder."""
    return topology.folder_totals(tables.files(spark, sf_dir))


@query(with_relations("files") + "SELECT greatest(count(*), 1) AS files, coalesce(sum(size), 0)::BIGINT AS bytes, count(*) > 20000 OR coalesce(sum(size), 0) > 209715200 AS large FROM files WHERE NOT (path LIKE 'docs/src1/%' OR path LIKE '%7.txt')")
def files_footprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The size of what no exclusion names."""
    return topology.footprint(tables.files(spark, sf_dir).filter(~text.excluded(F.col("path"), GLOBS)), 20_000, 200 << 20)
