"""Enrichment, topology, scalars, storage and streams on small rows: ties, nulls, empty tables."""

import hashlib
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from factgraph.functions import scalars
from factgraph.operators import enrichment, graph, topology
from factgraph.plans.registry import QUERIES
from factgraph.sources import storage
from factgraph.streaming.answers import answer_stream, keep_newest, newest

SF = "/root/testdata/sf0.001"


def values(spark, column, rows, schema):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(column).collect()]


def test_paths(spark):
    rows = [(r".\a\\b//c/index.ts",), ("x",), (None,), ("",)]
    posix = scalars.posix_path(F.col("p"))
    assert values(spark, posix, rows, "p string") == ["a/b/c/index.ts", "x", None, ""]
    assert values(spark, scalars.dirname(scalars.without_index(posix)), rows, "p string") == ["a/b", "", None, ""]
    assert values(spark, scalars.ancestors(F.col("p")), [("a/b/c",), ("a",)], "p string") == [["a", "a/b"], []]
    assert values(spark, scalars.path_suffixes(F.col("p")), [("a/b/c",), ("a",)], "p string") == [["a/b/c", "b/c", "c"], ["a"]]
    assert values(spark, scalars.resolve_relative(F.lit("a/b"), F.col("p")), [("../c",), ("./c/./d",), ("../../../e",)], "p string") == ["a/c", "a/b/c/d", "e"]


def test_names(spark):
    assert values(spark, scalars.joined_names(F.col("a")), [([],), (["A"],), (["A", "B"],), (["A", "B", "C"],)], "a array<string>") == ["", "A", "A and B", "A, B, and C"]
    assert values(spark, scalars.container_key(F.col("s")), [("a b",), ("1x",), ("",)], "s string") == ["a_b", "n_1x", "element"]
    assert values(spark, scalars.vendor_tokens(F.col("s")), [("Acme-Mail of acme",)], "s string") == [["acme", "mail", "acmemailofacme"]]
    assert values(spark, scalars.http_urls(F.col("s")), [("see https://a.b/c?d=1 or 'http://e.f'",), ("none",)], "s string") == [["https://a.b/c?d=1", "http://e.f"], []]
    assert values(spark, scalars.dependency_names(F.col("s")), [('{"dependencies": {"b": "1"}, "devDependencies": {"a": "2"}}',), ("{",)], "s string") == [["a", "b"], []]
    assert values(spark, scalars.band(F.col("s")), [(0.85,), (0.65,), (0.1,)], "s double") == ["high", "medium", "low"]


def test_json_objects(spark):
    texts = [('{"a": "}"}',), ('```json\n{"a": 1}\n```',), ('so {"a": {"b": "\\"}"}} and {"c": 2}',), ('{"a": ',), (None,), ("no",), ("[1]",)]
    assert values(spark, scalars.first_json_object("s"), texts, "s string") == ['{"a": "}"}', '{"a": 1}', '{"a": {"b": "\\"}"}}', None, None, None, "[1]"]


def test_slugs_against_brute_force(spark):
    def plain(name):
        kept = "".join(c for c in unicodedata.normalize("NFKD", name) if not unicodedata.category(c).startswith("M")).lower()
        return re.sub(r"-+", "-", re.sub(r"^[-.]+|[-.]+$", "", re.sub(r"[^a-z0-9._-]+", "-", kept)))[:80].rstrip("-.") or "item"

    got = {r.name: r.slug for r in QUERIES["slugs"](spark, SF).collect()}
    bases = [plain(n) for n in got]
    assert len(got) > 20
    for name, slug in got.items():
        base = plain(name)
        assert slug == (base if bases.count(base) == 1 else f"{base}-{hashlib.sha256(name.encode()).hexdigest()[:6]}")


def test_sections_and_containers(spark):
    paths = spark.createDataFrame([("a/b/c/x.go",), ("a/y.go",), ("z.go",), ("ab/q.go",)], "path string")
    manifests = spark.createDataFrame([("a/go.mod",), ("a/b/go.mod",), ("go.mod",)], "path string")
    assert {r.path: r.section for r in topology.sections(paths, manifests).collect()} == {"a/b/c/x.go": "a/b", "a/y.go": "a", "z.go": "root", "ab/q.go": "root"}
    deep = spark.createDataFrame([("1", "./src/app/a/x.ts", "api"), ("2", "dist/src/app/b/y.ts", "api"), ("3", "src\\app\\9\\z.ts", "")], "id string, path string, sub_type string")
    assert {r.id: r.container for r in topology.containers(deep).collect()} == {"1": "ctn_a", "2": "ctn_b", "3": "ctn_n_9"}
    mixed = deep.unionByName(spark.createDataFrame([("4", None, "database"), ("5", "x.ts", "")], deep.schema))
    assert {r.id: r.container for r in topology.containers(mixed).collect()} == {"1": "ctn_src", "2": "ctn_src", "3": "ctn_src", "4": "ctn_kind_database", "5": "ctn_kind_asset"}
    assert topology.containers(deep.limit(0)).count() == 0


def test_match_paths_takes_the_best_tier(spark):
    have = spark.createDataFrame([("a/b.ts",), ("c/b.ts",), ("d.ts",), ("a/b.ts",)], "path string")
    want = spark.createDataFrame([("a/b.ts",), ("x/c/b.ts",), ("b.ts",), ("q/b.ts",), ("none",)], "wanted string")
    got = {r.wanted: (r.tier, r.path, r.n) for r in topology.match_paths(want, have).collect()}
    assert got == {"a/b.ts": (1, "a/b.ts", 1), "x/c/b.ts": (2, "c/b.ts", 1), "b.ts": (2, "a/b.ts", 2), "q/b.ts": (3, "a/b.ts", 2)}


def test_closure_ends_in_cycles(spark):
    links = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("x", "y")], "source string, target string")
    seeds = spark.createDataFrame([("a",)], "id string")
    assert sorted(map(tuple, topology.closure(links, seeds, 9).collect())) == [("a", 0), ("b", 1), ("c", 2)]
    assert topology.closure(links, seeds.limit(0), 3).count() == 0


def test_prefer_source(spark):
    components = spark.createDataFrame([("h", "asset", "application", "A"), ("p", "asset", "api", "A"), ("g", "asset", "application", "B"), ("t", "third_party", "", "A")], "id string, type string, sub_type string, section string")
    flows = spark.createDataFrame([("1", "h", "t", "rpc", 0.5), ("2", "g", "t", "rpc", 0.5), ("3", "h", "p", "rpc", 0.5)], "id string, source string, target string, type string, confidence double")
    assert {r.id: (r.source, r.confidence) for r in topology.prefer_source(flows, components, "api").collect()} == {"1": ("p", 0.75), "2": ("g", 0.5), "3": ("h", 0.5)}


def test_merge_fills_only_what_is_empty(spark):
    current = spark.createDataFrame([("a", "x", None), ("a", "y", "old"), ("a", "z", " ")], "id string, property string, value string")
    patches = spark.createDataFrame([("a", "x", "", "p1", 9), ("a", "x", "v2", "p2", 8), ("a", "x", "v3", "p3", 7), ("a", "y", "new", "p2", 8), ("a", "w", "v", "p3", 7), ("b", "x", "v", "p4", 9)], "id string, property string, value string, patch string, rank int")
    got = enrichment.merge_properties(current, patches, [F.desc("rank")])
    assert sorted(map(tuple, got.collect())) == [("a", "w", "v", "p3"), ("a", "x", "v2", "p2")]


def test_evidence_outcomes(spark):
    proposals = spark.createDataFrame([("a", 0.5), ("b", 1.5), ("c", 0.5), ("d", None), ("e", 0.5)], "id string, confidence double")
    evidence = spark.createDataFrame([("a", "f"), ("b", "f"), ("c", "f"), ("c", "?"), ("d", "f")], "id string, path string")
    files = spark.createDataFrame([("f",)], "path string")
    assert {r.id: r.outcome for r in enrichment.check_evidence(proposals, evidence, files).collect()} == {"a": "valid", "b": "bad_confidence", "c": "unknown_path", "d": "bad_confidence", "e": "no_evidence"}


def test_capacity(spark):
    rows = spark.createDataFrame([(i, "a" if i < 8 else "b") for i in range(10)], "k int, agent string")
    got = {r.k: r.status for r in enrichment.capped(rows, "agent", "k", [F.desc("k")], 3).collect()}
    assert sorted(k for k, s in got.items() if s == "queued") == [5, 6, 7, 8, 9] and len(got) == 10
    assert {r.status for r in enrichment.capped(rows, "agent", "k", [F.desc("k")], 0).collect()} == {"queued"}


def test_digest_and_import(spark):
    rows = spark.createDataFrame([("a", 2, "second"), ("a", 1, "first"), ("b", 1, "x" * 400)], "k string, at int, m string")
    assert {r.k: r.digest for r in enrichment.digest(rows, "k", "at", "m").collect()} == {"a": "first (+1 more)", "b": "x" * 300}
    assert enrichment.new_records(rows.limit(0), rows.unionByName(rows), ["k", "at"]).count() == 3
    assert enrichment.new_records(rows, rows, ["k", "at"]).count() == 0


def test_storage(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1), ("b", 2)], "id string, n int")
    path = str(tmp_path / "docs")
    storage.write_json(rows, path)
    storage.write_json(rows.filter("n = 1"), path, append=True)
    assert storage.read_json(spark, path, "id string, n int", "id").count() == 3
    storage.write_json(rows, path)
    assert storage.read_json(spark, path, "id string, n int").count() == 2
    (tmp_path / "bad.json").write_text('{"id": "a", "n": 1}\n{"id": \n{"id": null, "n": 3}\n')
    with pytest.raises(Exception, match="(?i)malformed"):
        storage.read_json(spark, str(tmp_path / "bad.json"), "id string, n int").collect()
    good, bad = storage.split_valid(spark, str(tmp_path / "bad.json"), "id string, n int")
    assert sorted(r.n for r in good.collect()) == [1, 3] and [r.raw for r in bad.collect()] == ['{"id": ']
    storage.write_each(rows, str(tmp_path / "each"), "id")
    assert sorted(p.name for p in (tmp_path / "each").iterdir() if p.is_dir()) == ["_file=a", "_file=b"]
    with pytest.raises(ValueError):
        storage.write_each(rows.unionByName(rows), str(tmp_path / "twice"), "id")


def test_stream_over_several_files(spark, tmp_path):
    schema = "seq int, fact_id int, ts int, action string, property string, value double"
    for i, rows in enumerate(([(1, 1, 1, "set", "p", 1.0), (2, 1, 5, "set", "p", 2.0)], [(3, 1, 5, "set", "p", 3.0), (4, 2, 1, "remove", "p", 0.0), (5, 2, 0, "set", "q", 4.0)], [(6, 1, 2, "set", "p", 9.0)])):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"in{i}"))
    answers = answer_stream(spark, str(tmp_path / "in*"), spark.createDataFrame([], schema).schema)
    want = [(1, "p", 3.0, 3), (2, "q", 4.0, 5)]
    assert sorted(map(tuple, keep_newest(answers, str(tmp_path / "kept")).collect())) == want
    assert sorted(map(tuple, newest(spark.read.parquet(str(tmp_path / "in*"))).collect())) == want
    spark.createDataFrame([(7, 1, 9, "set", "p", 7.0)], schema).write.parquet(str(tmp_path / "in3"))
    assert sorted(map(tuple, keep_newest(answers, str(tmp_path / "kept")).collect())) == [(1, "p", 7.0, 7), (2, "q", 4.0, 5)]


def test_values_reasons_and_totals(spark):
    assert values(spark, enrichment.normalised(F.col("v"), ["a", "b"]), [(["b", "x", "a", "b"],), ([],), (None,)], "v array<string>") == [["a", "b", "other"], [], None]
    assert values(spark, enrichment.normalised(F.col("v"), ["a"], None), [(["x", "a"],)], "v array<string>") == [["a"]]
    assert values(spark, enrichment.first_reason([("big", F.col("n") > 5), ("even", F.col("n") % 2 == 0)]), [(8,), (4,), (3,), (None,)], "n int") == ["big", "even", None, None]
    calls = spark.createDataFrame([("a", 5, None, 9), ("a", -3, 2, 1), ("b", 5, 5, None)], "k string, input int, output int, total int")
    assert {r.k: r.total for r in enrichment.usage_totals(calls, "k").collect()} == {"a": 10, "b": 10}


def test_folder_totals(spark):
    files = spark.createDataFrame([("a/b/x", 1), ("a/y", 2), ("z", 4)], "path string, size long")
    assert {r.folder: (r.files, r.bytes) for r in topology.folder_totals(files).collect()} == {"a": (2, 3), "a/b": (1, 1)}
    assert tuple(topology.footprint(files, 2, 100).first()) == (3, 7, True)
    assert tuple(topology.footprint(files.limit(0), 2, 100).first()) == (1, 0, False)


def test_managed_nodes(spark):
    components = spark.createDataFrame([("h", "main", "asset", "application", "A"), ("c", "My Cache", "asset", "database", "A"), ("d", None, "asset", "database", "A")], "id string, name string, type string, sub_type string, section string")
    corpus = spark.createDataFrame([("A", "Redis"), ("A", "sqs"), ("B", "redis"), ("A", None)], "section string, word string")
    rules = [("cache", "redis", False), ("queue", "sqs", False), ("auth", None, True), ("mail", "smtp", False)]
    got = topology.managed_nodes(components, corpus, rules)
    assert sorted(map(tuple, got.collect())) == [("h", "c", "adopt"), ("h", "managed:A:auth", "create"), ("h", "managed:A:queue", "create")]
    assert topology.managed_nodes(components, corpus, []).count() == 0


def test_questions_look_up_each_end_once(spark):
    components = spark.createDataFrame([("a", "A", "asset", "x"), ("t", "T", "third_party", "y"), ("u", None, "third_party", "y")], "id string, name string, type string, section string")
    flows = spark.createDataFrame([("f", "a", "t"), ("g", "a", "u"), ("h", "a", "lost")], "id string, source string, target string")
    out = enrichment.questions(components, flows)
    assert {(r["subject"], r["slot"], r["about"]) for r in out.collect()} == {
        ("system", "in_scope", "Which system is this, and where does it end?"), ("f", "purpose", "What for does T get data of A?"), ("f", "data_categories", "Which kinds of data does A pass to T?"),
        ("g", "purpose", None), ("g", "data_categories", None)}
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 2


def test_only_flows_into_third_parties_are_moved_to_their_sources(spark):
    kinds = [("a", "actor"), ("s", "third_party"), ("t", "third_party"), ("p", "asset"), ("u", None), (None, "third_party")]
    components = spark.createDataFrame([(i, f"n{i}", t, None, "x") for i, t in kinds], "id string, name string, type string, sub_type string, section string")
    ends = [("a", "s"), ("s", "t"), ("p", "t"), ("u", "s"), ("a", "p"), ("a", "lost"), ("lost", "s"), (None, "s"), ("a", None), ("s", "p")]
    flows = spark.createDataFrame([(f"f{n}", s, t, "rpc", 0.5) for n, (s, t) in enumerate(ends)], "id string, source string, target string, type string, confidence double")
    got = enrichment.questions(components, flows)
    want = graph.classify(flows, components).filter("crossing = 'outbound_third_party'")
    assert sorted(r.subject for r in got.filter("slot = 'purpose'").collect()) == sorted(r.id for r in want.collect()) == ["f0", "f2"]
    text = got._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=broadcast" in text and text.count("strategy=shuffle_hash") == 1
    answered = got.filter("subject = 'f0' or slot = 'in_scope'").select("subject", "slot")
    assert sorted((r.subject, r.slot) for r in enrichment.with_status(got, answered).filter("status = 'answered'").collect()) == [("f0", "data_categories"), ("f0", "purpose"), ("system", "in_scope")]
