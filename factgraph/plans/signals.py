"""Queries on signals of third parties, their evidence and sessions, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factgraph.operators import signals, topology
from factgraph.sources import tables
from factgraph.sources.tables import with_relations

from .registry import EMAIL, query

#: Words that count as operations in documents.
OPERATION = r"(?i)\b(token|license|version|les|die)\b"
#: Rules of the three catalogs on what documents hold.
RULES = [
    ("address", "pii", [EMAIL], "identifiers", ["email"], [], None), ("secret", "pii", [r"(?i)\b(password|secret|token)\b *[:=]"], "credentials", ["user_password"], [], None), ("digits", "pattern", [r"\b[0-9]{4,}\b"], "financial", ["number"], ["payments"], "inbound_from_third_party"),
    ("prompt_content_input", "non_pii", [r"(?i)\blicensed\b", r"\breserved\b"], "content_files", ["license"], ["ai_inference"], "outbound_to_third_party"), ("document", "non_pii", [r"(?i)\bversion\b"], "content_files", ["version"], ["storage"], None),
]

_SIGNALS = with_relations("files", "lines").rstrip() + f""", rule(rule, origin, pattern, category, label, capability, direction) AS (VALUES ('address', 'pii', '{EMAIL}', 'identifiers', 'email', NULL, NULL), ('secret', 'pii', '(?i)\\b(password|secret|token)\\b *[:=]', 'credentials', 'user_password', 'auth', 'outbound_to_third_party'),
  ('digits', 'pattern', '\\b[0-9]{{4,}}\\b', 'financial', 'number', 'payments', 'inbound_from_third_party'), ('prompt_content_input', 'non_pii', '(?i)\\blicensed\\b|\\breserved\\b', 'content_files', 'license', 'ai_inference', 'outbound_to_third_party'), ('document', 'non_pii', '(?i)\\bversion\\b', 'content_files', 'version', 'storage', NULL)),
comp AS (SELECT DISTINCT source AS id, CASE substr(source, 4)::INT % 3 WHEN 0 THEN ['gemini', 'apache'] WHEN 1 THEN ['claude', 'token', 'general'] ELSE ['license'] END AS tokens, substr(source, 4)::INT % 3 < 2 AS ai FROM documents WHERE source IS NOT NULL),
rel AS (SELECT c.id, f.path FROM comp c, files f WHERE list_bool_or(list_transform(tokens, lambda t: contains(lower(path || chr(10) || content), t)))),
shared AS (SELECT path FROM rel JOIN comp USING (id) WHERE ai GROUP BY path HAVING count(DISTINCT id) >= 2),
ops AS (SELECT *, max(regexp_matches(line, '{OPERATION}')::INT) OVER (PARTITION BY path ORDER BY line_no RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS op FROM lines),
hit AS (SELECT path, line_no, line, r.* FROM ops, rule r WHERE op = 1 AND regexp_matches(line, r.pattern)),
mine AS (SELECT h.*, c.id, c.tokens, c.ai FROM hit h JOIN comp c ON c.id = string_split(h.path, '/')[2] JOIN rel ON rel.id = c.id AND rel.path = h.path WHERE coalesce(h.capability, '') <> 'ai_inference' OR c.ai),
tok AS (SELECT l.path, l.line_no, c.id FROM lines l JOIN comp c ON c.id = string_split(l.path, '/')[2] WHERE list_bool_or(list_transform(c.tokens, lambda t: contains(lower(l.line), t)))),
flags AS (SELECT m.*, EXISTS (SELECT 1 FROM tok WHERE tok.path = m.path AND tok.line_no = m.line_no) AS on_line, EXISTS (SELECT 1 FROM tok WHERE tok.path = m.path AND tok.line_no BETWEEN m.line_no - 3 AND m.line_no + 3) AS near_line, m.path IN (FROM shared) AS common FROM mine m),
signal AS (SELECT * FROM flags WHERE category <> 'content_files' OR on_line OR (capability = 'ai_inference' AND near_line) OR (rule = 'prompt_content_input' AND common))"""


def _signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = tables.files(spark, sf_dir)
    number = F.substring("id", 4, 9).cast("int") % 3
    components = tables.table(spark, sf_dir, "documents").filter("source is not null").select(F.col("source").alias("id")).distinct().select(
        "id", F.when(number == 0, "Gemini").when(number == 1, "Claude").otherwise("License").alias("name"), F.lit(None).cast("string").alias("sub_type"), F.when(number == 0, "Apache").when(number == 1, "token").alias("vendor"), F.when(number == 1, "General").otherwise("of").alias("service"), F.lit(None).cast("string").alias("client"))
    rules = spark.createDataFrame(RULES, "rule string, origin string, patterns array<string>, category string, labels array<string>, capabilities array<string>, direction string")
    return signals.vendor_signals(tables.lines(spark, sf_dir), files, files.select(F.split("path", "/")[1].alias("id"), "path"), components, rules, OPERATION)


@query(_SIGNALS + " SELECT id, rule, CASE origin WHEN 'pattern' THEN 'matched ' || category || ' signal' ELSE 'matched ' || origin || ':' || rule || ' signal' || CASE WHEN rule = 'prompt_content_input' AND common AND NOT on_line AND NOT near_line THEN ' (shared_ai_handler)' ELSE '' END END AS reason, count(*) AS n, count(DISTINCT path) AS files FROM signal GROUP BY ALL")
def vendor_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signals for the sources, as if they were third parties, by rule and reason."""
    return _signals(spark, sf_dir).groupBy("id", "rule", "reason").agg(F.count("*").alias("n"), F.countDistinct("path").alias("files"))


@query(_SIGNALS + """ SELECT id, array_to_string(list_sort(list(DISTINCT category || ':' || label)), ',') AS labels, coalesce(array_to_string(list_sort(list(DISTINCT capability) FILTER (capability IS NOT NULL)), ','), '') AS capabilities,
  CASE WHEN bool_or(direction LIKE 'out%') AND bool_or(direction LIKE 'in%') THEN 'bidirectional' WHEN bool_or(direction LIKE 'out%') THEN 'outbound_to_third_party' WHEN bool_or(direction LIKE 'in%') THEN 'inbound_from_third_party' ELSE 'unknown' END AS direction, count(*) AS pieces FROM signal GROUP BY id""")
def vendor_signal_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What flows to the sources by their signals."""
    return signals.signal_summary(_signals(spark, sf_dir)).select("id", F.array_join("labels", ",").alias("labels"), F.array_join("capabilities", ",").alias("capabilities"), "direction", "pieces")


@query("""WITH refs AS (SELECT user_id AS id, unnest(list_concat(['e' || event_id % 5], CASE WHEN event_type IN ('click', 'view') THEN ['e' || event_id % 5, event_type] ELSE [] END)) AS ref FROM events)
SELECT id, ref, count(*) AS n FROM refs GROUP BY ALL""")
def evidence_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as proposals: their evidence with that of their properties, by user."""
    own = F.array(F.concat(F.lit("e"), (F.col("event_id") % 5).cast("string")))
    more = F.when(F.col("event_type").isin("click", "view"), F.map_from_arrays(F.array(F.lit("a"), F.lit("b")), F.array(own, F.array("event_type"))))
    rows = tables.table(spark, sf_dir, "events").select(F.col("user_id").alias("id"), own.alias("evidence"), more.alias("property_evidence"))
    return signals.all_evidence(rows).groupBy("id", "ref").agg(F.count("*").alias("n"))


@query("""SELECT conv_id::VARCHAR AS session, count(*) AS turns, sum(regexp_matches(text, '[0-9]')::INT)::BIGINT AS findings FROM conversations WHERE conv_id % 3 = 1 GROUP BY conv_id HAVING max(TIMESTAMP '2024-01-01' + INTERVAL 1 HOUR * (conv_id % 50 + turn)) >= TIMESTAMP '2024-01-02'""")
def project_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations of one project with a turn on the second day or later, and their turns with digits."""
    c = F.col("conv_id")
    at = F.timestamp_add("HOUR", (c % 50 + F.col("turn")).cast("int"), F.lit("2024-01-01 00:00:00").cast("timestamp"))
    turns = tables.table(spark, sf_dir, "conversations").select(c.cast("string").alias("session"), F.concat(F.lit("project"), (c % 3).cast("string")).alias("project"), at.alias("at"), "text")
    return signals.scoped_sessions(turns, F.col("text").rlike("[0-9]"), F.lit("2024-01-02 00:00:00").cast("timestamp"), project="project1")


@query(with_relations("components", "flows").rstrip() + """, own AS (SELECT id, name, type, CASE WHEN type = 'actor' AND substr(id, 2)::INT % 4 = 0 THEN 'api' WHEN type = 'actor' AND substr(id, 2)::INT % 4 = 1 THEN 'application' ELSE sub_type END AS sub_type, section, type = 'actor' AS app FROM components),
kinds AS (SELECT id, CASE WHEN app THEN 'asset' ELSE type END AS type, sub_type, section FROM own), api AS (SELECT section, min(id) AS api FROM kinds WHERE type = 'asset' AND sub_type = 'api' GROUP BY section)
SELECT coalesce(api, f.source) AS source, f.target, CASE WHEN api IS NULL THEN f.confidence ELSE greatest(f.confidence, 0.75) END AS confidence, count(*) AS n FROM (SELECT * FROM flows WHERE hop = 0) f JOIN kinds t ON t.id = f.target
LEFT JOIN (SELECT id, section FROM kinds WHERE type = 'asset' AND sub_type = 'application') h ON h.id = f.source LEFT JOIN api ON api.section = h.section AND t.type = 'third_party' GROUP BY ALL""")
def preferred_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flows to third parties from main applications that start at the api of their section instead; customers count as assets."""
    app, k = F.col("type") == "actor", F.regexp_extract("id", "([0-9]+)", 1).cast("int") % 4
    components = tables.components(spark, sf_dir).withColumn("sub_type", F.when(app & (k == 0), "api").when(app & (k == 1), "application").otherwise(F.col("sub_type"))).withColumn("type", F.when(app, "asset").otherwise(F.col("type")))
    out = topology.prefer_source(tables.flows(spark, sf_dir).filter("hop = 0"), components, "api")
    return out.groupBy("source", "target", "confidence").agg(F.count("*").alias("n"))
