"""Serverless handlers absorbed into the function service of their section: nodes, evidence and flows in one contraction."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factgraph.sources.storage import written

from .graph import at_hand, best_per_key, earliest_per_key
from .rewrites import NO_SECTION
from .text import running_total

#: Patterns of handlers. Fixed values.
HANDLER_PATTERNS = ("lambda_handler", "aws_lambda", "aws_lambda_go", "serverless_handler")
#: Confidence of new services, of flows from hubs and of flows from providers. Fixed values.
SERVICE_FLOOR, HUB_FLOW, PROVIDER_FLOW = 0.78, 0.6, 0.78


def is_handler(patterns: Column) -> Column:
    """An asset that isn't managed and no compute service, and has the handler type serverless_handler, one of the handlers' patterns (``patterns``: an array) or is a function called lambda or handler."""
    found = F.exists(F.coalesce(patterns, F.array().cast("array<string>")), lambda p: F.lower(p).isin(*HANDLER_PATTERNS))
    called = (F.coalesce("sub_type", F.lit("")) == "function") & F.coalesce(F.lower("name").rlike("lambda|handler"), F.lit(False))
    return (F.col("type") == "asset") & F.col("managed_key").isNull() & (F.coalesce("sub_type", F.lit("")) != "compute_service") & (F.coalesce(F.col("handler_type") == "serverless_handler", F.lit(False)) | found | called)


@dataclass
class Absorbed:
    """``components`` and ``flows`` afterwards, ``absorbed`` (id, name, into), ``locations`` and ``detections`` with those of handlers moved."""

    components: DataFrame
    flows: DataFrame
    absorbed: DataFrame
    locations: DataFrame
    detections: DataFrame


def absorb_handlers(components: DataFrame, flows: DataFrame, locations: DataFrame, detections: DataFrame) -> Absorbed:
    """Merge the handlers of each section into its function service.

    Components have id, seq, name, type, sub_type, section, confidence, service, managed_key, managed_by, handler_type, main; flows id, seq, source, target, type, confidence; locations id, seq, file, start, end;
    detections id, seq, pattern, file, start. A section that is one (trimmed, not root and the like) and has handlers gets one service: its first component that is managed as lambda, or a
    compute service called so, else a new one with the next free number cmp_N, at least SERVICE_FLOOR and the confidence of its handler of least id, managed by the section's first AWS provider. The
    service takes over its handlers' evidence, its own first; of equal locations (file, start, end) and detections (pattern, file, start) the first stays. Flows follow, with a note; without loops, and of equal source, target and type the first
    stays. The section's first main asset gets a flow to the service, and so does the provider that manages it, where that pair has none.
    Without handlers all stays as it is, repeated flows too. Sections are taken in the order of their bytes.
    """
    section = F.trim(F.coalesce("section", F.lit("")))
    named = components.withColumn("_s", section)
    patterns = detections.groupBy("id").agg(F.collect_set(F.lower("pattern")).alias("_patterns"))
    handlers = written(named.filter((F.col("_s") != "") & ~F.lower("_s").isin(*NO_SECTION)).join(patterns, "id", "left").filter(is_handler(F.col("_patterns"))).select("id", "name", "confidence", "_s"), "absorb-handlers")
    sample = best_per_key(handlers, [F.col("_s")], [F.col("id")]).select("_s", F.col("confidence").alias("_c"))
    if not sample.limit(1).count():
        return Absorbed(components, flows.withColumn("note", F.lit(None).cast("string")), handlers.select("id", "name", F.col("id").alias("into")), locations, detections)

    def first_of(rows: DataFrame, id_: str) -> DataFrame:
        return best_per_key(rows, [F.col("_s")], [F.col("seq")]).select("_s", F.col("id").alias(id_))

    own = (F.coalesce(F.col("managed_key") == "lambda", F.lit(False))) | ((F.coalesce("sub_type", F.lit("")) == "compute_service") & F.coalesce(F.lower("name").contains("lambda"), F.lit(False)))
    service, name = (F.lower(F.coalesce(c, F.lit(""))) for c in ("service", "name"))
    aws = (F.col("type") == "third_party") & ((service == "aws") | (name == "aws") | name.contains("amazon"))
    main = F.coalesce(F.col("main"), F.lit(False))
    top = components.agg(F.coalesce(F.max(F.regexp_extract("id", r"^cmp_(\d{1,18})$", 1).try_cast("long")), F.lit(0))).first()[0]
    plan = sample.join(first_of(named.filter(own), "_have"), "_s", "left").join(first_of(named.filter(aws), "_aws"), "_s", "left").join(first_of(named.filter((F.col("type") == "asset") & main), "_hub"), "_s", "left")
    plan = running_total(written(plan.withColumn("_new", F.col("_have").isNull().cast("long")), "absorb-sections"), "_s", "_new").withColumn("into", F.coalesce("_have", F.concat(F.lit("cmp_"), (F.col("running") + top).cast("string"))))
    kept_by = components.select(F.col("id").alias("_have"), F.col("managed_by").alias("_by"))
    plan = written(plan.join(kept_by, "_have", "left").withColumn("_by", F.when(F.col("_have").isNull(), F.col("_aws")).otherwise(F.col("_by"))), "absorb-plan")

    absorbed = written(handlers.join(plan.select("_s", "into"), "_s").select("id", "name", "into"), "absorbed")
    new = plan.filter("_have is null").select(
        F.col("into").alias("id"), F.lit("Aws Lambda").alias("name"), F.lit("asset").alias("type"), F.lit("compute_service").alias("sub_type"), F.col("_s").alias("section"), F.greatest(F.lit(SERVICE_FLOOR), "_c").alias("confidence"),
        F.lit("lambda").alias("managed_key"), F.col("_by").alias("managed_by"),
    )
    left = components.join(absorbed.select("id"), "id", "left_anti").unionByName(new, allowMissingColumns=True)

    def moved(evidence: DataFrame, key: list[str]) -> DataFrame:
        """Evidence of services: their own, then that of their handlers by id."""
        into = absorbed.select("id", "into")
        rows = evidence.join(into, "id", "left").select(F.coalesce("into", "id").alias("id"), F.when(F.col("into").isNull(), F.lit("")).otherwise(F.col("id")).alias("_from"), *(c for c in evidence.columns if c != "id"))
        changed = rows.join(plan.select(F.col("into").alias("id")), "id", "left_semi")
        once = best_per_key(changed, [F.col("id"), *(F.coalesce(F.col(k).cast("string"), F.lit("")) for k in key)], [F.col("_from"), F.col("seq")])
        return rows.join(plan.select(F.col("into").alias("id")), "id", "left_anti").unionByName(once).withColumnRenamed("_from", "was")

    out = flows
    for end in ("source", "target"):
        out = out.join(at_hand(absorbed.select(F.col("id").alias(end), F.col("into").alias(f"_{end}"))), end, "left")
    note = F.when(F.col("_source").isNotNull() | F.col("_target").isNotNull(), "handler_absorbed_into_lambda")
    out = out.select("id", "seq", F.coalesce("_source", "source").alias("source"), F.coalesce("_target", "target").alias("target"), "type", "confidence", note.alias("note")).filter("source <> target")
    ends = ["source", "target", "type"]
    out = written(earliest_per_key(out.repartition(*ends), ends, ["seq"]), "absorb-flows")  # moved once and sorted once there
    hub = plan.filter("_hub is not null and _hub <> into").select(F.col("_hub").alias("source"), F.col("into").alias("target"), F.lit(HUB_FLOW).alias("confidence"), F.lit("section_hub_to_managed_lambda").alias("note"))
    provider = plan.filter("trim(_by) <> ''").select(F.col("_by").alias("source"), F.col("into").alias("target"), F.lit(PROVIDER_FLOW).alias("confidence"), F.lit("provider_to_managed_lambda").alias("note"))
    links = best_per_key(hub.withColumn("_r", F.lit(0)).unionByName(provider.withColumn("_r", F.lit(1))), [F.col("source"), F.col("target")], [F.col("_r")]).drop("_r")
    links = links.join(out.select("source", "target").distinct(), ["source", "target"], "left_anti").withColumns({"id": F.concat(F.lit("flow_fallback_"), "source", F.lit("_"), "target"), "type": F.lit("api_call")})
    return Absorbed(left, out.unionByName(links, allowMissingColumns=True), absorbed, moved(locations, ["file", "start", "end"]), moved(detections, ["pattern", "file", "start"]))
