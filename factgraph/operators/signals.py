"""What the files of third parties say flows to them: rule catalogs on lines, with gates on operations, AI vendors and the vendor's name nearby."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rules import MOST_CHARACTERS, pattern_findings
from .text import ascii_words, near_context

#: Operations, one of which must stand within two lines of a signal; tokens of AI vendors; rules on prompts that hold for every AI vendor of a file that several share. Fixed values.
OPERATION = r"(?i)\b(fetch|axios|request|invoke|send|post|get|put|patch|delete|upload|download|signIn|signOut|auth|token|storage|bucket|client|generateContent|chat|completions|models)\b"
AI_VENDOR = r"(?i)\b(openai|googleai|gemini|anthropic|claude|mistral|cohere|vertex|vertexai|generativeai|generativelanguage|genai)\b"
SHARED_RULES = ("prompt_content_input", "document_content_input")
#: Words of names that are no vendor's. Fixed values.
NO_VENDOR = ("service", "third", "party")


def vendor_tokens(components: DataFrame) -> DataFrame:
    """id, token of third parties (id, name, vendor, service, client): their words of three letters or digits and more, and their names run together, from five on."""
    each = components.select("id", F.explode(F.array_compact(F.array("name", "vendor", "service", "client"))).alias("raw")).withColumn("raw", F.lower("raw"))
    words = F.filter(F.split("raw", "[^a-z0-9]+"), lambda w: F.length(w) >= 3)
    compact = F.regexp_replace("raw", "[^a-z0-9]+", "")
    both = F.concat(words, F.when(F.length(compact) >= 5, F.array(compact)).otherwise(F.array().cast("array<string>")))
    return each.select("id", F.explode(both).alias("token")).filter(~F.col("token").isin(*NO_VENDOR)).distinct()


def tokens_within(texts: DataFrame, keys: list[str], text: str, tokens: DataFrame) -> DataFrame:
    """The ``keys`` of ``texts`` and token for every token (distinct, lower-case) that the lower-case text holds anywhere. One automaton finds all of them in one pass; the token table is
    configuration and bounded in size."""
    words = tokens.select("token").distinct()
    if (words.agg(F.coalesce(F.sum(F.length("token")), F.lit(0))).first()[0]) > MOST_CHARACTERS:
        raise ValueError(f"the tokens have more than {MOST_CHARACTERS} characters")
    held = sorted(r[0] for r in words.collect() if r[0])
    read = texts.select(F.struct(*keys).alias("_keys"), F.lower(F.coalesce(F.col(text), F.lit(""))).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = ahocorasick.Automaton()
        for w in held:
            automaton.add_word(w, w)
        automaton.make_automaton()
        for b in batches:
            at, found = [], []
            for i, t in enumerate(b.column(1)):
                own = {w for _, w in automaton.iter(t.as_py())} if held else ()
                at += [i] * len(own)
                found += sorted(own)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), pa.array(found, pa.string())], names=["_keys", "token"])

    kind = read.schema["_keys"].dataType.simpleString()
    return read.mapInArrow(run, f"_keys {kind}, token string").select(*(F.col(f"_keys.{k}").alias(k) for k in keys), "token")


def shared_ai_files(relevant: DataFrame, ai: DataFrame) -> DataFrame:
    """path of the files that two AI providers (id) or more are relevant to (id, path)."""
    return relevant.join(ai.select("id").distinct(), "id", "left_semi").groupBy("path").agg(F.countDistinct("id").alias("n")).filter("n >= 2").select("path")


def vendor_signals(lines: DataFrame, files: DataFrame, own: DataFrame, components: DataFrame, rules: DataFrame, operation: str = OPERATION) -> DataFrame:
    """id, path, line_no, rule, category, labels, capabilities, direction, reason of the signals for third parties.

    ``lines`` have path, line_no, line; ``files`` path, content; ``own`` says which files (id, path) are looked at for a third party; components have id, name, sub_type, vendor, service, client; rules have rule (unique), origin (pattern, pii or
    non_pii), patterns (array), category, labels and capabilities (arrays), direction. A file must hold one of the third party's tokens in its path or text. A signal needs an ``operation`` (a pattern, to whose \\b only ASCII letters and digits are words) within two lines. A rule of AI inference
    holds for AI vendors only (by their tokens). Rules of the category content_files that aren't pii's need the vendor's token on the line; or, for AI inference, within three lines; or the file must be one that AI providers share and the
    rule one of SHARED_RULES. Rules of credentials that are pii's mean authentication and an outbound flow.
    """
    tokens = vendor_tokens(components)
    ai = tokens.filter(F.col("token").rlike(AI_VENDOR)).select("id").distinct().withColumn("_ai", F.lit(True))
    providers = ai.select("id").unionByName(components.filter("sub_type = 'ai_provider'").select("id")).distinct()
    in_files = tokens_within(files.withColumn("_text", F.concat_ws("\n", "path", "content")), ["path"], "_text", tokens).join(tokens, "token").select("id", "path").distinct()
    shared = shared_ai_files(in_files, providers).withColumn("_shared", F.lit(True))

    each = rules.select("rule", F.explode("patterns").alias("pattern"))
    hits = pattern_findings(lines, each, ["path", "line_no"]).select("path", "line_no", "rule").distinct()
    works = near_context(lines, F.lit(True), F.col("line").rlike(ascii_words(operation)), 2).select("path", "line_no")
    known = rules.drop("patterns").withColumns({"_infers": F.array_contains("capabilities", "ai_inference"), "_content": (F.col("category") == "content_files") & (F.col("origin") != "pii")})
    hits = hits.join(works, ["path", "line_no"]).join(known, "rule")
    mine = hits.join(own.select("id", "path").distinct().join(in_files, ["id", "path"], "left_semi"), "path").join(ai, "id", "left").filter("not _infers or _ai or origin = 'pii'")

    on_line = tokens_within(lines, ["path", "line_no"], "line", tokens).join(tokens, "token").select("id", "path", "line_no").distinct()
    around = on_line.select("id", "path", F.explode(F.sequence(F.col("line_no") - 3, F.col("line_no") + 3)).alias("line_no")).distinct()
    gated = mine.join(on_line.withColumn("_on", F.lit(True)), ["id", "path", "line_no"], "left").join(around.withColumn("_near", F.lit(True)), ["id", "path", "line_no"], "left").join(shared, "path", "left")
    on, near, ai_, common = (F.coalesce(c, F.lit(False)) for c in ("_on", "_near", "_ai", "_shared"))
    prompt = F.col("rule").isin(*SHARED_RULES) & (F.col("origin") == "non_pii")
    passes = ~F.col("_content") | on | (F.col("_infers") & ai_ & near) | (F.col("_infers") & ai_ & common & prompt)
    secret = (F.col("origin") == "pii") & (F.col("category") == "credentials")
    by_others = prompt & common & ~on & ~near
    reason = F.concat(F.lit("matched "), F.when(F.col("origin") == "pattern", F.col("category")).otherwise(F.concat_ws(":", "origin", "rule")), F.lit(" signal"), F.when(by_others, " (shared_ai_handler)").otherwise(""))
    none = F.array().cast("array<string>")
    return gated.filter(passes).select(
        "id", "path", "line_no", "rule", "category", "labels", F.when(secret, F.array(F.lit("auth"))).when(F.col("origin") == "pii", none).otherwise(F.coalesce("capabilities", none)).alias("capabilities"),
        F.when(secret, "outbound_to_third_party").when(F.col("origin") != "pii", F.col("direction")).alias("direction"), reason.alias("reason"))


def signal_summary(signals: DataFrame) -> DataFrame:
    """id, labels (category:label, sorted), capabilities (sorted), direction, evidence (the first 20 of rule@path:line by path, line and rule), pieces."""
    out, in_ = F.bool_or(F.col("direction") == "outbound_to_third_party"), F.bool_or(F.col("direction") == "inbound_from_third_party")
    way = F.when(out & in_, "bidirectional").when(out, "outbound_to_third_party").when(in_, "inbound_from_third_party").otherwise("unknown")
    flat = signals.groupBy("id").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.transform("labels", lambda x: F.concat_ws(":", "category", x)))))).alias("labels"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("capabilities")))).alias("capabilities"),
        way.alias("direction"), F.count("*").alias("pieces"))
    return flat


def all_evidence(proposals: DataFrame) -> DataFrame:
    """id, ref of proposals (id, evidence: an array, property_evidence: a map of arrays): those of the whole proposal, then those of its properties; repeats stay."""
    none = F.array().cast(proposals.schema["evidence"].dataType)
    by_property = F.flatten(F.map_values(F.coalesce("property_evidence", F.create_map().cast(proposals.schema["property_evidence"].dataType))))
    return proposals.select("id", F.explode(F.concat(F.coalesce("evidence", none), by_property)).alias("ref"))


def scoped_sessions(turns: DataFrame, found: Column, since: Column, project: str | None = None, session: str | None = None) -> DataFrame:
    """session, turns, findings of the sessions (session, project, at) with a turn at ``since`` or later: of one session, else of one project, else of all."""
    rows = turns.filter(F.col("session") == session) if session is not None else turns.filter(F.col("project") == project) if project is not None else turns
    grouped = rows.groupBy("session").agg(F.count("*").alias("turns"), F.count_if(found).alias("findings"), F.max("at").alias("at"))
    return grouped.filter(F.col("at") >= since).select("session", "turns", "findings")
