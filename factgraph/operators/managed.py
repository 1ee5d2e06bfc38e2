"""Services that providers manage: which resources of infrastructure code they adopt, which databases they rename, which nodes they get anew."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factgraph.sources.storage import written

from .rewrites import section_key
from .signals import tokens_within

#: Beginnings of the resource types of providers, besides resources that name the provider as their cloud. Fixed values.
RESOURCES = {"aws": ("aws_",), "azure": ("azurerm_", "azapi_"), "kubernetes": ("kubernetes_",), "supabase": ("supabase_",), "vercel": ("vercel_",)}
#: For services without resource types of their own: what a resource type must hold, and must not. Fixed values.
CONSISTENT = {
    "lambda": (("lambda",), ("iam",)),
    "s3": (("s3",), ()),
    "postgres": (("rds", "db_instance", "aurora", "postgres", "redshift", "dynamodb", "neptune", "documentdb"), ()),
}
#: Services that a local database may stand for, and what such a database's name or client holds. Fixed values.
IMPLICIT, POSTGRES = ("postgres",), ("postgres", "pg", "postgresql")
#: Confidence of flows to services. A fixed value.
SERVICE_FLOW = 0.78


def _text(column: str) -> Column:
    return F.lower(F.trim(F.coalesce(F.col(column), F.lit(""))))


def _any(text: Column, words: tuple[str, ...]) -> Column:
    return F.greatest(F.lit(False), F.lit(False), *(F.contains(text, F.lit(w)) for w in words))


def consistent(key: Column, resource: Column) -> Column:
    """A resource type that is empty, or fits the service ``key``; services without a rule take any."""
    fits = [F.when(key == k, _any(resource, has) & ~_any(resource, lacks)) for k, (has, lacks) in CONSISTENT.items()]
    return (resource == "") | F.coalesce(*fits, F.lit(True))


def resource_matches(resources: DataFrame, rules: DataFrame) -> DataFrame:
    """id, provider, key of the resources (id, resource_type, block_name, address, cloud_provider) that belong to a rule's provider and match it: a rule (provider, key, signals, exact, prefixes: arrays) with resource types takes those
    that equal one or begin with a prefix, by equality joins on the type and on all its beginnings; one without takes those whose type, block or address holds a signal and that are consistent."""
    rt = _text("resource_type")
    belongs = [F.when(F.greatest(F.lit(False), *(F.startswith(rt, F.lit(b)) for b in begins)) | (_text("cloud_provider") == p) | (F.contains(rt, F.lit(p)) if p == "supabase" else F.lit(False)), F.lit(p)) for p, begins in RESOURCES.items()]
    own = resources.select("id", rt.alias("rt"), F.concat_ws(" ", rt, _text("block_name"), _text("address")).alias("hay"), F.explode(F.array_compact(F.array(*belongs))).alias("provider"))
    own = written(own, "managed-resources")
    typed = (F.size("exact") > 0) | (F.size("prefixes") > 0)
    names = rules.filter(typed).select("provider", "key", F.explode("exact").alias("rt")).withColumn("rt", F.lower(F.trim("rt")))
    begins = rules.filter(typed).select("provider", "key", F.explode("prefixes").alias("prefix")).withColumn("prefix", F.lower(F.trim("prefix"))).filter("prefix <> ''")
    kinds = own.filter("rt <> ''").select("rt", "provider").distinct()
    longer = kinds.withColumn("prefix", F.explode(F.transform(F.sequence(F.lit(1), F.length("rt")), lambda n: F.substring("rt", F.lit(1), n)))).join(begins, ["provider", "prefix"]).select("provider", "rt", "key")
    named = own.join(kinds.join(names, ["provider", "rt"]).select("provider", "rt", "key").unionByName(longer).distinct(), ["provider", "rt"]).select("id", "provider", "key")
    loose = rules.filter(~typed).select("provider", "key", F.explode("signals").alias("token")).withColumn("token", F.lower(F.trim("token")))
    said = tokens_within(own, ["id", "provider", "rt"], "hay", loose).join(loose, ["provider", "token"]).filter(consistent(F.lower(F.trim("key")), F.col("rt")))
    return named.unionByName(said.select("id", "provider", "key")).distinct()


def managed_plan(providers: DataFrame, nodes: DataFrame, rules: DataFrame, corpus: DataFrame, flows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(provider_id, key, node, action, name, type, sub_type; source, target, type, confidence): what each provider's services become, and the flows to them that are new.

    Providers have id, seq, provider, provider_seq, section; nodes id, seq, type, sub_type, name, client, section, resource_type, block_name, address, cloud_provider, service, vendor, managed_by, managed_key; rules provider, seq, key, label, type, sub_type,
    flow_type, signals, always, exact, prefixes; the corpus is what is said of providers (id, word). Turns are taken by provider_seq, the provider's seq and the rule's seq. A resource of infrastructure code that nobody manages is adopted in the first
    turn whose rule it matches and whose section it fits (two named sections must be equal); in that turn it takes the service's label, with its block if there are several. A turn without any is taken if its rule is ``always``, the corpus
    holds one of its signals, some resource matches it in the section, managed or not, or a database can stand for it (IMPLICIT): the first one like Postgres that names the provider or, if the corpus holds a
    signal, any; such databases aren't resources of infrastructure code. It renames that database, keeps the service that the provider has, or creates one.
    """
    at = nodes.withColumn("_s", section_key(F.col("section")))
    turn = F.struct("provider_seq", "p_seq", F.col("seq").alias("r_seq"), "provider_id", "key")
    turns = providers.select(F.col("id").alias("provider_id"), F.col("seq").alias("p_seq"), "provider", "provider_seq", section_key(F.col("section")).alias("_s")).join(rules.withColumnsRenamed({"type": "to_type", "sub_type": "to_sub_type"}), "provider").withColumn("turn", turn)
    turns = written(turns, "managed-turns")
    code = F.coalesce("address", F.lit(""))
    iac = at.filter((F.col("type") == "asset") & (code != "") & ~F.startswith(code, F.lit("provider.")))
    matched = written(resource_matches(iac, rules).join(iac.select("id", "_s", F.col("managed_by").isNull().alias("free"), "block_name"), "id"), "managed-matches")

    # the first turn of a service for each section, for turns without a section, and of all
    by = ["provider", "key"]
    here = turns.filter("_s <> ''").groupBy(*by, "_s").agg(F.min("turn").alias("here"))
    blank = turns.filter("_s = ''").groupBy(*by).agg(F.min("turn").alias("blank"))
    every = turns.groupBy(*by).agg(F.min("turn").alias("every"))
    first = matched.filter("free").join(here, [*by, "_s"], "left").join(blank, by, "left").join(every, by, "left")
    first = first.withColumn("turn", F.when(F.col("_s") == "", F.col("every")).otherwise(F.least("here", "blank")))
    adopted = written(first.filter("turn is not null").groupBy("id").agg(F.min("turn").alias("turn"), F.first("block_name").alias("block_name")), "managed-adopted")
    many = adopted.groupBy("turn").agg(F.count("*").alias("n"))

    def fitting(found: DataFrame, keys: list[str], value: Column, name: str) -> tuple[DataFrame, DataFrame, DataFrame]:
        """The least value for each section, for those without one, and of all."""
        return (
            found.filter("_s <> ''").groupBy(*keys, "_s").agg(F.min(value).alias(f"{name}_here")), found.filter("_s = ''").groupBy(*keys).agg(F.min(value).alias(f"{name}_blank")), found.groupBy(*keys).agg(F.min(value).alias(f"{name}_every")))

    def with_fitting(rows: DataFrame, found: DataFrame, keys: list[str], value: Column, name: str) -> DataFrame:
        near, none, all_ = fitting(found, keys, value, name)
        rows = rows.join(near, [*keys, "_s"], "left")
        for other in (none, all_):
            rows = rows.join(other, keys, "left")
        return rows.withColumn(name, F.when(F.col("_s") == "", F.col(f"{name}_every")).otherwise(F.least(f"{name}_here", f"{name}_blank"))).drop(f"{name}_here", f"{name}_blank", f"{name}_every")

    signals = rules.select("provider", "key", F.explode("signals").alias("token"))
    said = tokens_within(corpus, ["id"], "word", signals.select(F.lower("token").alias("token"))).distinct().withColumnRenamed("id", "provider_id")
    coded = turns.select("provider_id", "provider", "key").join(signals.withColumn("token", F.lower("token")), by).join(said, ["provider_id", "token"]).select("provider_id", "key").distinct().withColumn("coded", F.lit(True))
    like = F.concat_ws("\n", F.lower("name"), F.lower("client"))
    local = at.filter((F.col("type") == "asset") & (F.col("sub_type") == "database") & (code == "") & _any(like, POSTGRES)).withColumn("_at", F.struct("seq", "id"))
    hints = F.concat_ws("\n", F.lower("cloud_provider"), F.lower("service"), F.lower("vendor"))
    named = tokens_within(local.withColumn("_hints", hints), ["_s", "_at"], "_hints", rules.select(F.lower("provider").alias("token"))).withColumnRenamed("token", "provider")
    rest = turns.join(many.withColumnRenamed("n", "_n"), "turn", "left_anti").join(coded, ["provider_id", "key"], "left").withColumn("coded", F.coalesce("coded", F.lit(False)))
    rest = with_fitting(rest, matched.select(*by, "_s", F.lit(1).alias("one")), by, F.col("one"), "seen")
    rest = with_fitting(rest, named, ["provider"], F.col("_at"), "own_db")
    rest = with_fitting(rest.withColumn("_all", F.lit(1)), local.select("_s", "_at", F.lit(1).alias("_all")), ["_all"], F.col("_at"), "any_db")
    stands = F.when(F.col("key").isin(*IMPLICIT), F.when(F.col("coded"), F.col("any_db")).otherwise(F.col("own_db"))).getField("id")
    rest = rest.withColumn("stands", stands).filter(F.col("stands").isNotNull() | F.col("always") | F.col("coded") | F.col("seen").isNotNull())
    held = at.filter("managed_by is not null").groupBy(F.col("managed_by").alias("provider_id"), F.col("managed_key").alias("key")).agg(F.min(F.struct("seq", "id")).getField("id").alias("held"))
    rest = rest.join(held, ["provider_id", "key"], "left")
    made = F.concat_ws("_", F.lit("cmp_managed"), "provider", "key", "provider_id")
    action = F.when(F.col("stands").isNotNull(), "rename").when(F.col("held").isNotNull(), "keep").otherwise("create")
    services = rest.select("provider_id", "key", F.coalesce("stands", "held", made).alias("node"), action.alias("action"), F.when(action != "keep", F.col("label")).alias("name"), F.when(action == "create", F.col("to_type")).alias("type"), F.when(action == "create", F.col("to_sub_type")).alias("sub_type"), "flow_type")
    label = F.when(F.col("n") > 1, F.concat(F.col("label"), F.lit(" · "), F.coalesce(F.nullif(F.trim("block_name"), F.lit("")), "id"))).otherwise(F.col("label"))
    taken = adopted.join(many, "turn").join(turns.select("turn", "provider_id", "key", "label", "to_type", "to_sub_type", "flow_type"), "turn").select(
        "provider_id", "key", F.col("id").alias("node"), F.lit("adopt").alias("action"), label.alias("name"), F.col("to_type").alias("type"), F.col("to_sub_type").alias("sub_type"), "flow_type")
    plan = written(taken.unionByName(services), "managed-plan")
    known = flows.select("source", "target").distinct()
    links = plan.select(F.col("provider_id").alias("source"), F.col("node").alias("target"), "flow_type", "key").groupBy("source", "target").agg(F.min(F.struct("key", "flow_type")).getField("flow_type").alias("type")).join(known, ["source", "target"], "left_anti")
    return plan.drop("flow_type"), links.withColumn("confidence", F.lit(SERVICE_FLOW))
