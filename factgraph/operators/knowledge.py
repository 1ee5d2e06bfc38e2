"""Facts and the knowledge base: normalised facts, answers that may land, integrity, diagrams, records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .graph import best_per_key
from .text import running_total

#: Links that point at code or that items already carry. Fixed values.
STRUCTURAL = ("occurrence_of", "part_of", "declared_by", "occurs_in", "defined_in", "observed_in")
CODE_LINKS = ("occurs_in", "defined_in", "observed_in")
#: Slots of answers and their shapes. Fixed values.
SLOT_SHAPES = {"in_scope": "text", "actor_kind": "enum", "data_categories": "list", "purpose": "enum"}
#: Vocabularies of slots. Fixed values.
DATA_CATEGORIES = ("personal", "identifiers", "contact", "demographic", "credentials", "financial", "health", "location", "communications", "commercial", "other")
PURPOSES = ("service_provision", "analytics", "marketing", "security", "legal_obligation", "research", "debugging", "unspecified")
ACTOR_KINDS = ("person", "role", "persona")
#: Reviewers that are no person, and evidence that never counts, as defaults. Fixed values.
AUTOMATIC = r"(?i)^(gpt|claude|composer|model|agent|auto|rubric|the room|coding agent)"
NO_EVIDENCE = r"(?i)/eval/|fixtures/|mapped-transcript|stakeholder-script|discovery-export-bundle|raw-model-transcript"


def scrubbed(text: Column, root: str) -> Column:
    """The text with / as separator and without the scan's root, wherever it occurs, also where its removal joins one anew: what still has it is treated again until it can't, at most as often as there are
    slashes for."""
    prefix = root.rstrip("/") + "/"
    once = F.replace(F.replace(text, F.lit("\\"), F.lit("/")), F.lit(prefix), F.lit(""))
    slashes = F.length(once) - F.length(F.replace(once, F.lit("/"), F.lit("")))
    rounds = F.sequence(F.lit(1), F.greatest(F.lit(1), F.floor(slashes / prefix.count("/")).cast("int")))
    return F.when(F.contains(once, F.lit(prefix)), F.aggregate(rounds, once, lambda t, _: F.replace(t, F.lit(prefix), F.lit("")))).otherwise(once)


def bare_id(raw: Column) -> Column:
    """An id without ``dp::`` before it."""
    return F.regexp_replace(raw, "^dp::", "")


def item_name(raw: Column) -> Column:
    return F.regexp_replace(raw, "^data_item:", "")


def fact_links(links: DataFrame, root: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(code refs, handlers, relations) of a graph's links (seq, relation, source, target, basis, file, line).

    Code refs: id, refs (sorted structs of file, line). Handlers: id, handled_by (distinct, sorted). Relations: the first link
    of each (type, source, target) that isn't structural.
    """
    clean = links.withColumns({"source": scrubbed(bare_id(F.col("source")), root), "target": scrubbed(bare_id(F.col("target")), root), "file": scrubbed(F.col("file"), root)})
    refs = clean.filter(F.col("relation").isin(*CODE_LINKS)).groupBy(F.col("source").alias("id")).agg(F.array_sort(F.collect_list(F.struct("file", "line"))).alias("refs"))
    handlers = clean.filter("relation = 'handled_by'").groupBy(F.col("source").alias("id")).agg(F.array_sort(F.collect_set("target")).alias("handled_by"))
    relations = best_per_key(clean.filter(~F.col("relation").isin(*STRUCTURAL)), [F.col(c) for c in ("relation", "source", "target")], [F.col("seq")])
    return refs, handlers, relations.select(F.col("relation").alias("type"), "source", "target", "basis")


def facts_of(components: DataFrame, refs: DataFrame, handlers: DataFrame, root: str) -> DataFrame:
    """id, name, type, sub_type ('' where there's none), refs, handled_by (empty where there are none) of components."""
    rows = components.select(scrubbed(F.col("id"), root).alias("id"), "name", "type", F.coalesce("sub_type", F.lit("")).alias("sub_type"))
    none = F.array().cast("array<string>")
    return rows.join(refs, "id", "left").join(handlers, "id", "left").select("id", "name", "type", "sub_type", F.coalesce(F.size("refs"), F.lit(0)).alias("n_refs"), F.coalesce("handled_by", none).alias("handled_by"))


def item_groups(occurrences: DataFrame) -> DataFrame:
    """item, group_id, occurrences, basis, number of the groups of occurrences (item, group_id, basis, line, id): the commonest basis
    (ties: the smallest), and the group's number in its item by its first line, then id."""
    counts = occurrences.groupBy("item", "group_id", "basis").agg(F.count("*").alias("n"), F.min(F.struct("line", "id")).alias("first"))
    known = F.when(F.coalesce(F.trim("basis"), F.lit("")) != "", F.struct((-F.col("n")).alias("n"), "basis"))
    groups = counts.groupBy("item", "group_id").agg(F.sum("n").alias("occurrences"), F.min(known).alias("b"), F.min("first").alias("first"))
    number = F.row_number().over(Window.partitionBy("item").orderBy("first", "group_id"))
    return groups.select("item", "group_id", "occurrences", F.col("b.basis").alias("basis"), number.alias("number"))


def landing(answers: DataFrame, asked: DataFrame, evidence: DataFrame, automatic: str = AUTOMATIC, no_evidence: str = NO_EVIDENCE) -> DataFrame:
    """id, outcome for answers (id, target, slot, value, reviewer, skill, evidence): the first rule that an answer breaks, else landed.
    ``asked`` are the brief's questions (target, slot), ``evidence`` the transcripts there are (path)."""
    rows = answers.join(asked.select("target", "slot").distinct().withColumn("_asked", F.lit(True)), ["target", "slot"], "left").join(evidence.select(F.col("path").alias("evidence")).distinct().withColumn("_there", F.lit(True)), "evidence", "left")
    who = F.trim(F.coalesce("reviewer", F.lit("")))
    outcome = (
        F.when(~F.coalesce(F.col("slot").isin(*SLOT_SHAPES), F.lit(False)), "SLOT_NOT_LANDABLE").when(F.col("_asked").isNull(), "NOT_ASKABLE").when((who == "") | who.rlike(automatic) | ~F.contains(who, F.lit("@")), "REVIEWER_NOT_HUMAN")
        .when(~F.coalesce(F.col("skill").rlike("^[0-9a-f]{40}$"), F.lit(False)), "BAD_SKILL_SHA").when(F.col("_there").isNull(), "NO_EVIDENCE").when(F.col("evidence").rlike(no_evidence), "EVIDENCE_NOT_LANDABLE").otherwise("landed")
    )
    return rows.select("id", outcome.alias("outcome"))


def slot_value(slot: Column, raw: Column) -> Column:
    """A struct of value, as it is stored, and error (null if there is none): a scope is a text that isn't empty, a kind of actor and a purpose one word of their vocabulary, categories a JSON list
    of theirs, distinct and sorted, from a JSON list or words between commas; ``unspecified`` is none of them. Words are trimmed and compared by case."""
    value = F.trim(F.coalesce(raw, F.lit("")))
    listed = F.startswith(value, F.lit("["))
    parsed = F.from_json(value, "array<string>")
    strings = listed & parsed.isNotNull() & value.rlike(r'^\[\s*("([^"\\]|\\.)*"\s*(,\s*"([^"\\]|\\.)*"\s*)*)?\]$')
    words = F.filter(F.transform(F.when(listed, parsed).otherwise(F.split(value, ",")), lambda w: F.trim(w)), lambda w: w != "")
    error = (
        F.when(slot == "in_scope", F.when(value == "", "empty_scope"))
        .when(slot == "actor_kind", F.when(~value.isin(*ACTOR_KINDS), "unknown_actor_kind"))
        .when(slot == "purpose", F.when(~value.isin(*PURPOSES), "unknown_purpose"))
        .when(slot == "data_categories", F.when(listed & ~strings, "no_list_of_categories").when(F.size(words) == 0, "no_category").when(F.array_contains(words, "unspecified"), "unspecified_category").when(F.exists(words, lambda w: ~w.isin(*DATA_CATEGORIES)), "unknown_category"))
        .otherwise("no_slot")
    )
    stored = F.when(slot == "data_categories", F.to_json(F.array_sort(F.array_distinct(words)))).otherwise(value)
    return F.struct(F.when(error.isNull(), stored).alias("value"), error.alias("error"))


def interview_records(landed: DataFrame) -> DataFrame:
    """id, target, slot, shape, value, error of landed answers (id, target, slot, value); see slot_value."""
    shape = F.coalesce(*(F.when(F.col("slot") == s, F.lit(v)) for s, v in SLOT_SHAPES.items()))
    return landed.withColumn("_v", slot_value(F.col("slot"), F.col("value"))).select("id", "target", "slot", shape.alias("shape"), "_v.value", "_v.error")


def comparable(base: DataFrame, head: DataFrame, key: str, tools: list[str]) -> DataFrame:
    """key, comparable: both scans have the same tools, none used inference or a dirty tree."""
    b = base.select(key, *(F.col(c).alias(f"_{c}") for c in [*tools, "inference", "dirty"]))
    same = F.lit(True)
    for t in tools:
        same = same & F.col(t).eqNullSafe(F.col(f"_{t}"))
    clean = ~F.coalesce(F.greatest("inference", "_inference", "dirty", "_dirty"), F.lit(False))
    return head.join(b, key).select(key, (same & clean).alias("comparable"))


def tampered(stored: DataFrame) -> DataFrame:
    """name of the stored texts (name, text) whose hash isn't their name."""
    return stored.filter(F.sha1(F.col("text").cast("binary")) != F.col("name")).select("name")


def answer_elements(answers: DataFrame, briefs: DataFrame, facts: DataFrame, root: str) -> DataFrame:
    """id, key, outcome of answers (id, fact, brief, key): kept where they have a key; else that of the fact in their brief (brief,
    fact, key), else in the scan (fact, key), else the root's where it is an old name of it; else unresolved."""
    known = facts.select(F.col("key").alias("_k"), F.lit(True).alias("_known")).distinct()
    rows = answers.join(briefs.select("brief", "fact", F.col("key").alias("_brief")), ["brief", "fact"], "left").join(facts.select("fact", F.col("key").alias("_scan")), "fact", "left")
    found = F.coalesce("_brief", "_scan")
    rows = rows.withColumn("_k", found).join(known, "_k", "left")
    old_root = found.isNotNull() & F.col("_known").isNull() & F.startswith(found, F.lit("app:"))
    outcome = F.when(F.col("key").isNotNull(), "already_keyed").when(F.col("fact") == "dp:a0/system", "system").when(old_root, "root").when(F.col("_brief").isNotNull(), "brief").when(F.col("_scan").isNotNull(), "scan").otherwise("unresolved")
    key = F.when(F.col("key").isNotNull(), F.col("key")).when(F.col("fact") == "dp:a0/system", F.col("fact")).when(old_root, F.lit(root)).otherwise(found)
    return rows.select("id", key.alias("key"), outcome.alias("outcome"))


def diagram_nodes(components: DataFrame) -> DataFrame:
    """id, type, label, status of a diagram's nodes; an actor of unknown kind (actor_kind) is marked and open."""
    actor, known = F.col("type") == "actor", F.coalesce("actor_kind", F.lit("")) != ""
    return components.select("id", F.when(F.col("type").isin("asset", "actor", "third_party"), F.col("type")).otherwise("asset").alias("type"), F.when(actor & ~known, F.concat("name", F.lit(" (?)"))).otherwise(F.col("name")).alias("label"), F.when(actor, F.when(known, "known").otherwise("unknown")).alias("status"))


def diagram_edges(flows: DataFrame) -> DataFrame:
    """id, source, target, label, status of a diagram's edges, self-loops left out: known where categories and purpose are,
    unknown where neither is, else partial."""
    open_ = F.col("categories").isNull().cast("int") + F.col("purpose").isNull().cast("int")
    label = F.replace("type", F.lit("_"), F.lit(" "))
    return flows.filter("source <> target").select("id", "source", "target", label.alias("label"), F.when(open_ == 0, "known").when(open_ == 2, "unknown").otherwise("partial").alias("status"))


def document_components(facts: DataFrame, items: DataFrame) -> DataFrame:
    """id, name, items: the distinct items (item, handled_by) that each component handles."""
    of = items.select("item", "handled_by").distinct().select("item", F.explode("handled_by").alias("id")).groupBy("id").agg(F.array_join(F.array_sort(F.collect_set("item")), ",").alias("items"))
    return facts.join(of, "id", "left").select("id", "name", F.coalesce("items", F.lit("")).alias("items"))


def parsed_categories(text: Column) -> Column:
    """Categories of a JSON list, or of one plain text; none for null."""
    listed = F.from_json(text, "array<string>")
    return F.when(text.isNull(), F.array().cast("array<string>")).when(F.startswith(F.ltrim(text), F.lit("[")) & listed.isNotNull(), listed).otherwise(F.array(text))


def numbered_from(rows: DataFrame, existing: DataFrame, prefix: str, order: list[str]) -> DataFrame:
    """``rows`` with new_id: the prefix and a number after the greatest that ``existing`` ids (id) have. Numbers follow ``order``, one unique column; ranges of it are counted apart."""
    (key,) = order
    last = existing.agg(F.coalesce(F.max(F.regexp_extract("id", f"^{prefix}([0-9]+)$", 1).try_cast("long")), F.lit(0))).first()[0]
    counted = running_total(rows.withColumn("_one", F.lit(1).cast("long")), key, "_one")
    return counted.withColumn("new_id", F.concat(F.lit(prefix), (F.col("running") + last).cast("string"))).drop("_one", "running")


def line_ranges(lines: DataFrame, wanted: DataFrame) -> DataFrame:
    """id, line_no, line of the lines that ranges (id, path, start, end) name."""
    return lines.join(wanted.select("id", "path", "start", "end"), "path").filter("line_no between start and end").select("id", "line_no", "line")


def top_missing(missing: Column, first: list[str], most: int = 36) -> Column:
    """The names of missing fields, those of ``first`` before others, then by name, at most ``most``."""
    ranked = F.array_sort(F.transform(missing, lambda m: F.struct(F.when(m.isin(first), 0).otherwise(1).alias("r"), m.alias("m"))))
    return F.slice(F.transform(ranked, lambda s: s["m"]), 1, most)


def unseen_first(hits: DataFrame, seen: DataFrame, key: str, n: int) -> DataFrame:
    """key, path: the first n files of each key's hits (path, seq), those that aren't ``seen`` (path) first."""
    files = hits.groupBy(key, "path").agg(F.min("seq").alias("seq")).join(seen.select("path", F.lit(1).alias("_seen")).distinct(), "path", "left")
    at = F.row_number().over(Window.partitionBy(key).orderBy(F.coalesce("_seen", F.lit(0)), "seq", "path"))
    return files.withColumn("at", at).filter(F.col("at") <= n).select(key, "path")


def capped_evidence(evidence: DataFrame, key: str, most: int) -> DataFrame:
    """The first ``most`` pieces of evidence of each key, by file, line and rule."""
    at = F.row_number().over(Window.partitionBy(key).orderBy("file", "line", "rule"))
    return evidence.withColumn("at", at).filter(F.col("at") <= most)


def near_paths(files: DataFrame, seeds: DataFrame) -> DataFrame:
    """seed, path of files whose path begins with a seed or that a seed begins with. Prefixes end at any character, so seeds are
    joined by equality on the prefixes of paths that have a seed's length."""
    lengths = [r[0] for r in seeds.select(F.length("seed")).distinct().collect()]  # as many as there are lengths of seeds
    own = files.select("path", F.explode(F.array_distinct(F.array(*(F.substring("path", 1, n) for n in lengths)))).alias("seed"))
    down = own.join(seeds.select("seed").distinct(), "seed").select("seed", "path")
    sizes = [r[0] for r in files.select(F.length("path")).distinct().collect()]
    up = seeds.select("seed", F.explode(F.array_distinct(F.array(*(F.substring("seed", 1, n) for n in sizes)))).alias("path")).join(files.select("path").distinct(), "path").select("seed", "path")
    return down.unionByName(up).distinct()


def unknown_ids(reported: DataFrame, submitted: DataFrame) -> DataFrame:
    """id of reported findings that were never submitted; a report is valid if there's none."""
    return reported.select("id").distinct().join(submitted.select("id"), "id", "left_anti")


def slim(properties: Column, most_set: int = 14, most_sparse: int = 12, width: int = 4000) -> tuple[Column, Column]:
    """(set, sparse): the first properties by name that have a value, cut to ``width``, and the names of the first that have none."""
    entries = F.array_sort(F.map_entries(properties))
    filled = F.filter(entries, lambda e: F.coalesce(F.trim(e["value"]), F.lit("")) != "")
    empty = F.filter(entries, lambda e: F.coalesce(F.trim(e["value"]), F.lit("")) == "")
    return F.map_from_entries(F.transform(F.slice(filled, 1, most_set), lambda e: F.struct(e["key"], F.substring(e["value"], 1, width)))), F.transform(F.slice(empty, 1, most_sparse), lambda e: e["key"])


def is_sensitive_path(path: Column) -> Column:
    """Environment files."""
    return path.rlike(r"(^|/)\.env(\.[^/]*)?$")


def scannable(files: DataFrame, most_bytes: int, generated: list[str]) -> DataFrame:
    """path, size of files that a scan for secrets reads: no generated or lock files, no NULs, not too large."""
    size = F.octet_length("content")
    return files.filter(~F.col("path").rlike("|".join(generated)) & ~F.contains("content", F.lit("\x00")) & (size <= most_bytes)).select("path", size.cast("long").alias("size"))


#: Names of generated files, folders and files that are never scanned, files of the tool's own project folders, and the caps in bytes of a file and of all. Fixed values.
GENERATED = r"(?i)(?:\.min\.(?:js|mjs|css)|\.map|\.snap|\.lockb?|\.generated\.[^.]+|_pb2(?:_grpc)?\.py|\.pb\.go)$"
SKIPPED_FOLDERS = ("vendored", "third_party", "sand-client-persistence", "__pycache__")
SKIPPED_FILES = (".git", "package-lock.json", "pnpm-lock.yaml", "go.sum", "npm-shrinkwrap.json")
FILE_BYTES, TOTAL_BYTES = 1 << 20, 64 << 20


def scan_records(files: DataFrame, file_bytes: int = FILE_BYTES, total_bytes: int = TOTAL_BYTES) -> tuple[DataFrame, DataFrame]:
    """(id, size, text; scanned, over_size, limit_reached): the files (path, content as binary) that a scan for sensitive data reads, and one row on how far it came.

    Files are taken folder by folder, names in the order of their bytes. Generated and lock files, those in skipped folders, with NULs or without valid UTF-8 are left out; larger ones than ``file_bytes`` too, and they are counted. The scan ends before the
    first file with which all would pass ``total_bytes``; what comes after isn't read, nor counted."""
    low, name = F.col("path"), F.substring_index("path", "/", -1)
    folders = F.slice(F.split("path", "/"), 1, F.size(F.split("path", "/")) - 1)
    wanted = files.filter(~low.rlike(GENERATED) & ~name.isin(*SKIPPED_FILES) & ~F.arrays_overlap(folders, F.array(*map(F.lit, SKIPPED_FOLDERS))) & ~low.rlike("^project/(?:issues|events|\\.cache)/"))
    # a folder's name ends before any sign, so it sorts as a name of its own
    sized = wanted.withColumns({"size": F.octet_length("content").cast("long"), "order": F.translate("path", "/", "\u0001")})
    large = sized.filter(F.col("size") > file_bytes).select("order")
    small = sized.filter(F.col("size") <= file_bytes).filter((F.position(F.lit(b"\x00"), F.col("content")) == 0) & F.is_valid_utf8(F.col("content").cast("string")))
    counted = running_total(small.select("path", "order", "size"), "order", "size")
    read = counted.filter(F.col("running") <= total_bytes)
    end = counted.filter(F.col("running") > total_bytes).agg(F.min("order").alias("end"))
    over = large.join(F.broadcast(end), F.col("end").isNull() | (F.col("order") < F.col("end"))).agg(F.count("*").alias("over_size"))  # one row
    totals = [read.count(), over.first()[0], end.first()[0] is not None]
    coverage = files.sparkSession.createDataFrame([tuple(totals)], "scanned long, over_size long, limit_reached boolean")
    return read.join(files, "path").select(F.col("path").alias("id"), "size", F.col("content").cast("string").alias("text")), coverage


def state_rows(components: DataFrame, flows: DataFrame, items: DataFrame) -> DataFrame:
    """kind, id, parent, name of all entities of a state: components, flows, items and the groups in them (group_ids)."""
    none = F.lit(None).cast("string")
    return (
        components.select(F.lit("component").alias("kind"), "id", none.alias("parent"), "name")
        .unionByName(flows.select(F.lit("flow").alias("kind"), "id", F.col("source").alias("parent"), F.col("type").alias("name")))
        .unionByName(items.select(F.lit("item").alias("kind"), F.col("item").alias("id"), none.alias("parent"), F.col("item").alias("name")))
        .unionByName(items.select(F.explode("group_ids").alias("id"), "item").select(F.lit("group").alias("kind"), "id", F.col("item").alias("parent"), F.col("id").alias("name")))
    )


def sidecars(files: DataFrame, ranks: list[tuple[str, str]]) -> DataFrame:
    """at, path of the JSON objects among files (path, content), by the first pattern of (name, pattern) that a path matches, then by
    path; other files and JSON that is no object are left out."""
    rank = F.coalesce(*(F.when(F.col("path").rlike(p), F.lit(i)) for i, (_, p) in enumerate(ranks)))
    rows = files.withColumn("rank", rank).filter(F.col("rank").isNotNull() & F.startswith(F.ltrim("content"), F.lit("{")) & F.from_json("content", "map<string,string>").isNotNull())
    return rows.select("rank", "path")
