"""Evidence on third parties: relevant files, hints, inferred properties, subtypes, what data flows to them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factgraph.functions import scalars

from .text import direction

#: How a property of third parties can be found out; any other is not_inferable_v1. Fixed values.
INFERABLE = {
    "vendor": "direct",
    "serviceName": "direct",
    "client": "heuristic",
    "integration_method": "direct",
    "api_type": "heuristic",
    "authentication_method": "heuristic",
    "documentation_url": "direct",
    "sdk_available": "direct",
    "https_enforced": "direct",
    "api_endpoint": "heuristic",
    "integration_status": "heuristic",
}
#: What a reason of evidence says: pattern, category, label, capability, outbound. Fixed values.
REASONS = (
    (r"\b(secret|secrets manager|password|credential|token|api key|auth)\b", "auth_artifacts", "auth_token", "auth", True),
    (r"\b(db_password|password)\b", "credentials", "user_password", "auth", True),
    (r"\b(rds|database|db_|postgres|connection parameters|host|port)\b", "identifiers", "technical_identifier", "sdk", False),
    (r"\b(lambda|handler)\b", None, None, "api", False),
)
#: Methods of authentication, the first that evidence hints at counts. Fixed values.
AUTHENTICATION = ("oauth2", "api_key", "bearer_token", "jwt", "basic_auth")



def relevant_files(files: DataFrame, tokens: DataFrame) -> DataFrame:
    """id, path of files (path, content) whose words or path segments hold a token (id, token) of a third party. Files are split into
    words once, and words are joined by equality."""
    words = F.array_distinct(F.split(F.lower(F.concat_ws(" ", "path", "content")), "[^a-z0-9]+"))
    return files.select("path", F.explode(words).alias("token")).join(tokens.select("id", "token").distinct(), "token").select("id", "path").distinct()


def rule_signals(lines: DataFrame, rules: list[tuple[str, str, str, str, bool]], operation: Column, reach: int = 2) -> DataFrame:
    """path, line_no, category, label, capability, outbound for lines (path, line_no, line) that a rule (pattern, category, label,
    capability, outbound) matches and that have an operation within ``reach`` lines. Rules become columns."""
    from .text import near_context

    any_rule = reduce(lambda a, b: a | b, (F.col("line").rlike(p) for p, *_ in rules))
    near = near_context(lines, any_rule, operation, reach)
    hits = F.array_compact(F.array(*(F.when(F.col("line").rlike(p), F.struct(F.lit(c).alias("category"), F.lit(n).alias("label"), F.lit(a).alias("capability"), F.lit(o).alias("outbound"))) for p, c, n, a, o in rules)))
    return near.select("path", "line_no", F.explode(hits).alias("h")).select("path", "line_no", "h.*")


def summary(signals: DataFrame, key: str) -> DataFrame:
    """key, labels (category:label, sorted), capabilities (sorted), direction, pieces of each third party's signals."""
    label = F.when(F.col("category").isNotNull(), F.concat_ws(":", "category", "label"))
    return signals.groupBy(key).agg(F.array_join(F.array_sort(F.collect_set(label)), ",").alias("labels"), F.array_join(F.array_sort(F.collect_set("capability")), ",").alias("capabilities"), direction(F.col("outbound"), F.lit(False)).alias("direction"), F.count("*").alias("pieces"))


def reason_signals(evidence: DataFrame, reasons=REASONS) -> DataFrame:
    """The columns of ``evidence`` (with reason) and category, label, capability, outbound for what its reason says."""
    low = F.lower("reason")
    hits = F.array_compact(F.array(*(F.when(low.rlike(p), F.struct(F.lit(c).cast("string").alias("category"), F.lit(n).cast("string").alias("label"), F.lit(a).alias("capability"), F.lit(o).alias("outbound"))) for p, c, n, a, o in reasons)))
    return evidence.select("*", F.explode(hits).alias("h")).select(*evidence.columns, "h.*")


def data_flow_summary(components: DataFrame, scanned: DataFrame, reasoned: DataFrame) -> DataFrame:
    """id, labels, capabilities, direction, confidence, band of each third party (id, provider, heuristic): what its files say, else
    what reasons say; ``unknown:undetermined`` where neither does. Capabilities of both count."""
    s = scanned.select("id", *(F.col(c).alias(f"s_{c}") for c in ("labels", "capabilities", "direction", "pieces")))
    r = reasoned.select("id", *(F.col(c).alias(f"r_{c}") for c in ("labels", "capabilities", "direction", "pieces")))
    rows = components.join(s, "id", "left").join(r, "id", "left")
    labels = F.coalesce(F.nullif("s_labels", F.lit("")), F.nullif("r_labels", F.lit("")), F.lit("unknown:undetermined"))
    both = F.array_sort(F.array_distinct(F.filter(F.split(F.concat_ws(",", "s_capabilities", "r_capabilities"), ","), lambda c: c != "")))
    way = F.coalesce(F.when(F.col("s_direction") != "unknown", F.col("s_direction")), F.col("r_direction"), F.lit("unknown"))
    pieces = F.coalesce("s_pieces", F.lit(0)) + F.coalesce("r_pieces", F.lit(0))
    total = F.lit(0.42) + F.when(F.col("provider"), 0.2).otherwise(0.0) + F.when(F.col("heuristic"), 0.08).otherwise(0.0) + F.when(F.coalesce("s_labels", F.lit("")) != "", 0.1).otherwise(0.0) + F.when(pieces >= 3, 0.1).otherwise(0.0)
    confidence = F.round(scalars.clamp(total, 0.35, 0.95), 2)
    return rows.select("id", labels.alias("labels"), F.array_join(both, ",").alias("capabilities"), way.alias("direction"), confidence.alias("confidence"), scalars.band(confidence).alias("band"))


def infer_properties(bundles: DataFrame) -> DataFrame:
    """id, property, value, score, confidence, band of third parties (id, vendor, vendor_score, urls, hints, auth as arrays, dependencies, manifest, called, known as array of properties): a row for each
    property that evidence suggests, that isn't known and that a place can be cited for.

    A vendor found anew names service and client too. Methods are those of api, sdk and webhook that imports hint at; they are cited where the first file has an import or call
    (``called``). The API type is graphql before webhook before rest; it and the endpoint's properties are cited by a URL, SDKs by a dependency ``manifest``. The confidence
    of a third party's proposal is the mean of all scores, also of properties without a citation, from 0.65 to 0.96 and rounded to hundredths.
    """
    hints, auth, n = F.col("hints"), F.col("auth"), F.size("urls")
    methods = F.array_compact(F.array(*(F.when(F.array_contains(hints, h), F.lit(h)) for h in ("api", "sdk", "webhook"))))
    kind = F.when(F.array_contains(hints, "graphql"), "graphql").when(F.array_contains(hints, "webhook"), "webhook").when((n > 0) | F.array_contains(hints, "api"), "rest")
    method = F.coalesce(*(F.when(F.array_contains(auth, a), F.lit(a)) for a in AUTHENTICATION))
    secure = F.when(n > 0, F.forall("urls", lambda u: F.startswith(u, F.lit("https://"))))
    vendor = F.when(~F.array_contains("known", "vendor"), F.col("vendor"))
    active = F.when(F.array_contains(hints, "api") | F.array_contains(hints, "sdk"), "active")
    always = F.lit(True)
    rules = (
        ("vendor", vendor, F.col("vendor_score"), always), ("serviceName", vendor, F.lit(0.9), always), ("client", F.lower(vendor), F.lit(0.86), always), ("integration_method", F.nullif(F.array_join(methods, ","), F.lit("")), F.lit(0.82), F.col("called")),
        ("api_type", kind, F.when(kind == "graphql", 0.86).otherwise(0.8), n > 0), ("authentication_method", method, F.lit(0.78), always), ("api_endpoint", F.get("urls", F.lit(0)), F.lit(0.84), always), ("https_enforced", secure.cast("string"), F.when(secure, 0.9).otherwise(0.7), always),
        ("sdk_available", F.when(F.col("dependencies") > 0, "true"), F.lit(0.83), F.col("manifest")), ("integration_status", active, F.lit(0.8), always),
    )
    found = F.array_compact(F.array(*(F.when(v.isNotNull() & ~F.array_contains("known", p), F.struct(F.lit(p).alias("property"), v.alias("value"), s.cast("double").alias("score"), c.alias("cited"))) for p, v, s, c in rules)))
    mean = F.aggregate("found", F.lit(0.0), lambda a, x: a + x["score"]) / F.size("found")
    whole = scalars.clamp(mean, 0.65, 0.96)
    rows = bundles.select("id", found.alias("found")).filter(F.size("found") > 0).withColumn("whole", whole)
    return rows.select("id", F.explode("found").alias("f"), F.round("whole", 2).alias("confidence"), scalars.band(F.col("whole")).alias("band")).filter("f.cited").select("id", "f.property", "f.value", "f.score", "confidence", "band")


def inferability(prop: Column) -> Column:
    """direct, heuristic or not_inferable_v1."""
    return F.coalesce(*(F.when(prop == p, F.lit(k)) for p, k in INFERABLE.items()), F.lit("not_inferable_v1"))


def subtype(current: Column, catalogued: Column, name: Column, patterns: list[tuple[str, str]], default: str = "saas_service") -> Column:
    """The subtype a component has, else its catalog's, else that of the first pattern its name matches, else the default."""
    return F.coalesce(F.nullif(F.trim(current), F.lit("")), catalogued, *(F.when(F.lower(name).rlike(p), F.lit(s)) for p, s in patterns), F.lit(default))


def heuristic_patches(candidates: DataFrame) -> DataFrame:
    """id, kind, score of what candidates (id, candidate_type, hints) propose without a provider: to turn a flow round, or a new flow
    between sections where two hints or more name it."""
    kind = F.when(F.col("candidate_type") == "flow_direction", "reverse").when((F.col("candidate_type") == "missing_interaction") & (F.size("hints") >= 2), "insert")
    return candidates.select("id", kind.alias("kind"), F.when(kind == "reverse", 0.8).when(kind == "insert", 0.86).alias("score")).filter("kind is not null")


def confident(rows: DataFrame, least: float) -> DataFrame:
    """Rows of at least that confidence: findings, components and flows alike."""
    return rows.filter(F.col("confidence") >= least)


def renamed_diff(base: DataFrame, head: DataFrame, renames: DataFrame, value: str) -> DataFrame:
    """key, change, previous of two snapshots (key, value): base keys are followed through the renames (from, to) first, so a row that
    only moved is ``renamed``; else added, removed or changed."""
    moved = base.join(renames.select(F.col("from").alias("key"), "to"), "key", "left").select(F.coalesce("to", "key").alias("key"), F.when(F.col("to").isNotNull(), F.col("key")).alias("previous"), F.col(value).alias("old"), F.lit(True).alias("_base"))
    both = moved.join(head.select("key", F.col(value).alias("new"), F.lit(True).alias("_head")), "key", "full")
    change = F.when(F.col("_base").isNull(), "added").when(F.col("_head").isNull(), "removed").when(~F.col("old").eqNullSafe(F.col("new")), "changed").when(F.col("previous").isNotNull(), "renamed")
    return both.select("key", change.alias("change"), "previous").filter("change is not null")
