"""Queries on evidence of third parties and on scalar functions, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factgraph.functions import scalars
from factgraph.operators import facts, merge, third_party
from factgraph.sources import tables
from factgraph.sources.tables import with_relations

from .registry import EMAIL, LICENSE, query

TOKENS = ["licensed", "src3", "team", "contact"]
SIGNALS = [(EMAIL, "identifiers", "email", "contact", True), (LICENSE, "content_files", "license", "storage", False)]

_RELEVANT = with_relations("files") + ", words AS (SELECT DISTINCT path, unnest(string_split_regex(lower(path || ' ' || content), '[^a-z0-9]+')) AS token FROM files) "


@query(_RELEVANT + "SELECT DISTINCT 't' || length(token) AS id, path FROM words WHERE token IN ('licensed', 'src3', 'team', 'contact')")
def relevant_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that hold a token of some third parties."""
    tokens = spark.createDataFrame([(f"t{len(t)}", t) for t in TOKENS], "id string, token string")
    return third_party.relevant_files(tables.files(spark, sf_dir), tokens)


_SCANNED = with_relations("files", "lines").rstrip() + f""", near AS (SELECT *, max(regexp_matches(line, '[0-9]')::INT) OVER (PARTITION BY path ORDER BY line_no RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS op FROM lines),
sig AS (SELECT path, line_no, 'identifiers' AS category, 'email' AS label, 'contact' AS capability, true AS outbound FROM near WHERE op = 1 AND regexp_matches(line, '{EMAIL}') UNION ALL SELECT path, line_no, 'content_files', 'license', 'storage', false FROM near WHERE op = 1 AND regexp_matches(line, '{LICENSE}')),
scanned AS (SELECT string_split(path, '/')[2] AS id, array_to_string(list_sort(list_distinct(list(category || ':' || label))), ',') AS labels, array_to_string(list_sort(list_distinct(list(capability))), ',') AS capabilities, CASE WHEN bool_or(outbound) THEN 'outbound' ELSE 'unknown' END AS direction, count(*) AS pieces FROM sig GROUP BY 1)"""


def _scanned(spark: SparkSession, sf_dir: str) -> DataFrame:
    signals = third_party.rule_signals(tables.lines(spark, sf_dir, [p for p, *_ in SIGNALS]), SIGNALS, F.col("line").rlike("[0-9]"))
    return third_party.summary(signals.withColumn("id", F.split("path", "/")[1]), "id")


@query(_SCANNED + " SELECT * FROM scanned")
def third_party_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the files of each source say, as if it were a third party."""
    return _scanned(spark, sf_dir)


_REASONED = r"""evidence AS (SELECT 'src' || user_id % 12 AS id, CASE event_type WHEN 'click' THEN 'Reads DB_password from env' WHEN 'view' THEN 'Lambda handler found' WHEN 'error' THEN 'connects to host, port' WHEN 'signup' THEN 'an auth token' ELSE 'nothing' END AS reason FROM events WHERE user_id % 12 >= 3 AND event_id % 12 = user_id % 12),
said AS (SELECT id, unnest(list_filter([CASE WHEN regexp_matches(lower(reason), '\b(secret|secrets manager|password|credential|token|api key|auth)\b') THEN ['auth_artifacts:auth_token', 'auth', 'y'] END, CASE WHEN regexp_matches(lower(reason), '\b(db_password|password)\b') THEN ['credentials:user_password', 'auth', 'y'] END,
  CASE WHEN regexp_matches(lower(reason), '\b(rds|database|db_|postgres|connection parameters|host|port)\b') THEN ['identifiers:technical_identifier', 'sdk', 'n'] END, CASE WHEN regexp_matches(lower(reason), '\b(lambda|handler)\b') THEN [NULL, 'api', 'n'] END], lambda x: x IS NOT NULL)) AS h FROM evidence),
reasoned AS (SELECT id, coalesce(array_to_string(list_sort(list_distinct(list(h[1]) FILTER (h[1] IS NOT NULL))), ','), '') AS labels, array_to_string(list_sort(list_distinct(list(h[2]))), ',') AS capabilities, CASE WHEN bool_or(h[3] = 'y') THEN 'outbound' ELSE 'unknown' END AS direction, count(*) AS pieces FROM said GROUP BY id)"""


def _reasoned(spark: SparkSession, sf_dir: str) -> DataFrame:
    events, m = tables.table(spark, sf_dir, "events"), F.col("user_id") % 12
    reason = F.when(F.col("event_type") == "click", "Reads DB_password from env").when(F.col("event_type") == "view", "Lambda handler found").when(F.col("event_type") == "error", "connects to host, port").when(F.col("event_type") == "signup", "an auth token").otherwise("nothing")
    evidence = events.filter((m >= 3) & (F.col("event_id") % 12 == m)).select(F.concat(F.lit("src"), m.cast("string")).alias("id"), reason.alias("reason"))
    return third_party.summary(third_party.reason_signals(evidence), "id")


@query(f"WITH {_REASONED} SELECT * FROM reasoned")
def reason_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What reasons of evidence say."""
    return _reasoned(spark, sf_dir)


@query(_SCANNED + f", {_REASONED}, total AS (" + """SELECT c.id, coalesce(nullif(s.labels, ''), nullif(r.labels, ''), 'unknown:undetermined') AS labels, array_to_string(list_sort(list_distinct(list_filter(string_split(concat_ws(',', s.capabilities, r.capabilities), ','), lambda x: x <> ''))), ',') AS capabilities,
  coalesce(CASE WHEN s.direction <> 'unknown' THEN s.direction END, r.direction, 'unknown') AS direction, round(least(0.95, greatest(0.35, 0.42 + CASE WHEN k % 2 = 0 THEN 0.2 ELSE 0 END + CASE WHEN k % 3 = 0 THEN 0.08 ELSE 0 END + CASE WHEN coalesce(s.labels, '') <> '' THEN 0.1 ELSE 0 END + CASE WHEN coalesce(s.pieces, 0) + coalesce(r.pieces, 0) >= 3 THEN 0.1 ELSE 0 END)), 2)::DOUBLE AS confidence
FROM (SELECT 'src' || (p_partkey % 14) AS id, p_partkey % 14 AS k FROM part GROUP BY ALL) c LEFT JOIN scanned s ON s.id = c.id LEFT JOIN reasoned r ON r.id = c.id) SELECT *, CASE WHEN confidence >= 0.85 THEN 'high' WHEN confidence >= 0.65 THEN 'medium' ELSE 'low' END AS band FROM total""")
def third_party_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What flows to each third party, by its files or else by reasons."""
    k = F.col("p_partkey") % 14
    components = tables.table(spark, sf_dir, "part").select(F.concat(F.lit("src"), k.cast("string")).alias("id"), (k % 2 == 0).alias("provider"), (k % 3 == 0).alias("heuristic")).distinct()
    return third_party.data_flow_summary(components, _scanned(spark, sf_dir), _reasoned(spark, sf_dir))


_INFERRED = """b AS (SELECT s_suppkey AS id, CASE WHEN s_suppkey % 3 > 0 THEN s_name END AS vendor, s_suppkey % 4 AS u, s_suppkey % 5 AS h, s_suppkey % 6 AS a, s_suppkey % 2 AS d, s_suppkey % 7 AS k, s_acctbal > 0 AS m, s_nationkey % 2 = 0 AS c FROM supplier),
v AS (SELECT *, CASE WHEN k <> 0 THEN vendor END AS fresh FROM b),
r AS (SELECT id, k, unnest(['vendor', 'serviceName', 'client', 'integration_method', 'api_type', 'authentication_method', 'api_endpoint', 'https_enforced', 'sdk_available', 'integration_status']) AS property,
  unnest([fresh, fresh, lower(fresh), CASE h WHEN 0 THEN 'api' WHEN 1 THEN 'sdk,webhook' WHEN 2 THEN 'api' END, CASE WHEN h = 2 THEN 'graphql' WHEN h = 1 THEN 'webhook' WHEN u > 0 OR h = 0 THEN 'rest' END, CASE a WHEN 0 THEN 'oauth2' WHEN 1 THEN 'api_key' WHEN 2 THEN 'jwt' END,
    CASE WHEN u = 1 THEN 'https://a' WHEN u >= 2 THEN 'http://b' END, CASE WHEN u = 1 THEN 'true' WHEN u >= 2 THEN 'false' END, CASE WHEN d > 0 THEN 'true' END, CASE WHEN h IN (0, 1, 2) THEN 'active' END]) AS value,
  unnest([0.92, 0.9, 0.86, 0.82, CASE WHEN h = 2 THEN 0.86 ELSE 0.8 END, 0.78, 0.84, CASE WHEN u = 1 THEN 0.9 ELSE 0.7 END, 0.83, 0.8])::DOUBLE AS score, unnest([true, true, true, c, u > 0, true, true, true, m, true]) AS cited FROM v),
held AS (SELECT * FROM r WHERE value IS NOT NULL AND NOT (k = 1 AND property = 'api_type')),
means AS (SELECT id, least(0.96, greatest(0.65, sum(score) / count(*))) AS mean FROM held GROUP BY id),
inferred AS (SELECT id, property, value, score, round(mean, 2)::DOUBLE AS confidence, CASE WHEN mean >= 0.85 THEN 'high' WHEN mean >= 0.65 THEN 'medium' ELSE 'low' END AS band FROM held JOIN means USING (id) WHERE cited)"""


def _inferred(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")

    def texts(*values: str):
        return F.array(*map(F.lit, values)) if values else F.array().cast("array<string>")

    rows = tables.table(spark, sf_dir, "supplier").select(
        k.alias("id"), F.when(k % 3 > 0, F.col("s_name")).alias("vendor"), F.lit(0.92).alias("vendor_score"), F.when(k % 4 == 0, texts()).when(k % 4 == 1, texts("https://a")).otherwise(texts("http://b", "https://c")).alias("urls"),
        F.when(k % 5 == 0, texts("api")).when(k % 5 == 1, texts("webhook", "sdk")).when(k % 5 == 2, texts("graphql", "api")).otherwise(texts()).alias("hints"), F.when(k % 6 == 0, texts("api_key", "oauth2")).when(k % 6 == 1, texts("api_key")).when(k % 6 == 2, texts("basic_auth", "jwt")).otherwise(texts()).alias("auth"),
        (k % 2).alias("dependencies"), (F.col("s_acctbal") > 0).alias("manifest"), (F.col("s_nationkey") % 2 == 0).alias("called"), F.when(k % 7 == 0, texts("vendor")).when(k % 7 == 1, texts("api_type")).otherwise(texts()).alias("known"))
    return third_party.infer_properties(rows)


@query(f"WITH {_INFERRED} SELECT * FROM inferred")
def inferred_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Properties of suppliers that evidence suggests."""
    return _inferred(spark, sf_dir)


@query(f"""WITH {_INFERRED} SELECT CASE WHEN property IN ('vendor', 'serviceName', 'integration_method', 'sdk_available', 'https_enforced', 'documentation_url') THEN 'direct' WHEN property IN ('client', 'api_type', 'authentication_method', 'api_endpoint', 'integration_status') THEN 'heuristic' ELSE 'not_inferable_v1' END AS inferability, count(*) AS n, count(DISTINCT property) AS properties
FROM (SELECT property FROM inferred UNION ALL SELECT CASE WHEN o_orderpriority = '1-URGENT' THEN 'documentation_url' ELSE 'vendor_' || lower(o_orderstatus) END FROM orders) GROUP BY 1""")
def property_inferability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Properties that evidence suggests for suppliers, and those that orders ask for, by how they can be found out."""
    asked = tables.table(spark, sf_dir, "orders").select(F.when(F.col("o_orderpriority") == "1-URGENT", "documentation_url").otherwise(F.concat(F.lit("vendor_"), F.lower("o_orderstatus"))).alias("property"))
    rows = _inferred(spark, sf_dir).select("property").unionByName(asked)
    return rows.groupBy(third_party.inferability(F.col("property")).alias("inferability")).agg(F.count("*").alias("n"), F.countDistinct("property").alias("properties"))


@query("""SELECT p_partkey, coalesce(CASE WHEN p_size < 10 THEN p_type END, CASE WHEN contains(p_name, 'gear') THEN 'machine' WHEN contains(p_name, 'part') THEN 'generic' END, CASE WHEN regexp_matches(p_name, '^red') THEN 'colour' WHEN regexp_matches(p_name, 'o') THEN 'vowel' END, 'saas_service') AS sub_type FROM part""")
def subtype_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subtypes of parts: their own, the catalog's, a pattern's, or the default."""
    catalog = spark.createDataFrame([("gear", "machine", 1), ("part", "generic", 2), ("@o", "never", 3), ("o", "never", 4)], "key string, value string, seq int")
    rows = facts.longest_match(tables.table(spark, sf_dir, "part").select("p_partkey", "p_name", F.when(F.col("p_size") < 10, F.col("p_type")).alias("own")), "p_name", catalog)
    return rows.select("p_partkey", third_party.subtype(F.col("own"), F.col("value"), F.col("p_name"), [("^red", "colour"), ("o", "vowel")]).alias("sub_type"))


@query("SELECT event_id AS id, CASE WHEN event_type = 'click' THEN 'reverse' ELSE 'insert' END AS kind, CASE WHEN event_type = 'click' THEN 0.8 ELSE 0.86 END::DOUBLE AS score FROM events WHERE event_type = 'click' OR (event_type = 'view' AND event_id % 3 = 2)")
def heuristic_patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What candidates propose without a provider."""
    kind = F.when(F.col("event_type") == "click", "flow_direction").when(F.col("event_type") == "view", "missing_interaction").otherwise("node_property")
    return third_party.heuristic_patches(tables.table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), kind.alias("candidate_type"), F.array_repeat(F.lit("hint"), (F.col("event_id") % 3).cast("int")).alias("hints")))


@query(with_relations("files", "flows") + "SELECT f.id FROM flows f WHERE confidence >= 0.8 UNION ALL SELECT path FROM files WHERE language IN ('en', 'de')")
def scan_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confident flows, and files of two languages."""
    flows = third_party.confident(tables.flows(spark, sf_dir), 0.8).select("id")
    return flows.unionByName(tables.files(spark, sf_dir).filter(F.col("language").isin("en", "de")).select(F.col("path").alias("id")))


@query("""WITH b AS (SELECT o_orderkey, 'k' || o_orderkey AS key, o_orderpriority AS v FROM orders WHERE o_orderkey % 3 > 0), h AS (SELECT CASE WHEN o_orderkey % 5 = 0 THEN 'n' || o_orderkey ELSE 'k' || o_orderkey END AS key, CASE WHEN o_orderkey % 7 = 0 THEN 'x' ELSE o_orderpriority END AS v FROM orders WHERE o_orderkey % 4 > 0),
m AS (SELECT CASE WHEN o_orderkey % 5 = 0 THEN 'n' || o_orderkey ELSE key END AS key, CASE WHEN o_orderkey % 5 = 0 THEN key END AS previous, v FROM b)
SELECT key, change, previous FROM (SELECT key, previous, CASE WHEN m.v IS NULL THEN 'added' WHEN h.v IS NULL THEN 'removed' WHEN m.v <> h.v THEN 'changed' WHEN previous IS NOT NULL THEN 'renamed' END AS change FROM m FULL JOIN h USING (key)) WHERE change IS NOT NULL""")
def renamed_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of two snapshots, some of them renamed."""
    orders, k = tables.table(spark, sf_dir, "orders"), F.col("o_orderkey")
    old, new = F.concat(F.lit("k"), k.cast("string")), F.concat(F.lit("n"), k.cast("string"))
    base = orders.filter("o_orderkey % 3 > 0").select(old.alias("key"), F.col("o_orderpriority").alias("v"))
    head = orders.filter("o_orderkey % 4 > 0").select(F.when(k % 5 == 0, new).otherwise(old).alias("key"), F.when(k % 7 == 0, "x").otherwise(F.col("o_orderpriority")).alias("v"))
    return third_party.renamed_diff(base, head, orders.filter("o_orderkey % 5 = 0").select(old.alias("from"), new.alias("to")), "v")


@query("""SELECT event_id, list_sort(CASE WHEN event_id % 2 = 0 THEN ['b' || event_id] WHEN event_id % 3 = 0 THEN ['a' || event_id] ELSE ['a' || event_id, 'b' || event_id] END)[1] AS first FROM (SELECT event_id FROM events)""")
def evidence_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence of allowed patterns, or all of it."""
    e = F.col("event_id").cast("string")

    def ref(pattern, prefix):
        return F.struct(F.lit(pattern).alias("pattern"), F.concat(F.lit(prefix), e).alias("file"))

    refs = F.when(F.col("event_id") % 2 == 0, F.array(ref("other", "a"), ref("database", "b"))).when(F.col("event_id") % 3 == 0, F.array(ref("database", "a"), ref("env", "b"))).otherwise(F.array(ref("env", "a"), ref("other", "b")))
    return tables.table(spark, sf_dir, "events").select("event_id", F.array_min(F.transform(merge.evidence_or_all(refs, ["database"]), lambda r: r["file"])).alias("first"))


@query("""SELECT s_suppkey, 'dp:supplier/' || replace(replace(s_name, '#', '%23'), ' ', '%20') AS uri, s_name AS identity, (s_suppkey * 86400)::BIGINT AS seconds, strftime(to_timestamp(s_suppkey * 86400) AT TIME ZONE 'UTC', '%Y%m%d') AS day, 'Supplier ' || s_suppkey AS title,
  CASE s_suppkey % 3 WHEN 0 THEN 'git.example.com/a/b' WHEN 1 THEN 'host.org/x/y' ELSE 'h.io/p/q' END AS remote, s_suppkey % 2 = 0 AS public, 'a,./b,c' AS imports, 'token=[redacted] and Bearer [redacted]' AS hidden, 'a_b_' || s_suppkey AS token FROM supplier""")
def scalar_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """URIs, dates, titles, remotes, imports and redacted texts of suppliers."""
    k = F.col("s_suppkey")
    uri = scalars.entity_uri(F.lit("supplier"), F.col("s_name"))
    seconds = scalars.epoch_seconds(F.concat(F.date_format(F.timestamp_seconds(k * 86400), "yyyy-MM-dd"), F.lit("T00:00:00Z")))
    remote = F.when(k % 3 == 0, "git@git.example.com:a/b.git").when(k % 3 == 1, "https://user@host.org/x/y.git/").otherwise("ssh://git@h.io:22/p/q")
    source = F.lit("import x from 'a';\nconst y = require(\"./b\"); await import('c'); import 'a'")
    return tables.table(spark, sf_dir, "supplier").select(
        "s_suppkey", uri.alias("uri"), scalars.entity_of(uri)["identity"].alias("identity"), seconds.alias("seconds"), scalars.land_date(seconds).alias("day"), scalars.title_case(F.concat(F.lit("supplier_-"), k.cast("string"))).alias("title"), scalars.git_remote(remote).alias("remote"),
        scalars.is_public_url(F.concat(F.when(k % 2 == 0, "HTTPS://").otherwise("https://${"), F.lower("s_name"))).alias("public"), F.array_join(scalars.imports_of(source), ",").alias("imports"), scalars.redacted(F.concat(F.lit("token="), "s_name", F.lit(" and Bearer abc.def"))).alias("hidden"), scalars.normal_token(F.concat(F.lit(" A-b "), k.cast("string"), F.lit("!"))).alias("token"))
