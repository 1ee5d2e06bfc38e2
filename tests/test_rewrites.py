"""Merges, rewrites, metrics, knowledge and third parties on small rows: ties, nulls, empty tables, large catalogs."""

import pytest
from pyspark.sql import functions as F

from factgraph.operators import facts, graph, knowledge, merge, metrics, rewrites, text, third_party
from factgraph.sources import storage

NODE = "id string, name string, type string, sub_type string, section string, client string, service string, managed_by string, managed_key string, address string"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_evidence_is_replaced_by_key(spark):
    df = spark.createDataFrame([({"a": [1], "b": [2]}, {"b": [3], "c": [4], "a": []})], "old map<string,array<int>>, new map<string,array<int>>")
    assert df.select(merge.merge_evidence(F.col("old"), F.col("new"))).first()[0] == {"a": [1], "b": [3], "c": [4]}



def test_detected_flows_come_before_made_up_ones(spark):
    flows = spark.createDataFrame([("flow_fallback_1", 1, "a", "b", "x", 0.9), ("f2", 2, "a", "b", "x", 0.5), ("f3", 3, "b", "a", "y", 0.4)], "id string, seq int, source string, target string, type string, confidence double")
    assert {r.id for r in graph.dedupe_directed(flows, ["seq"]).collect()} == {"f2", "f3"}
    assert {r.id for r in graph.dedupe_undirected(flows, ["seq"]).collect()} == {"f2"}


def test_longest_match_keeps_rows_at_any_size(spark):
    texts = spark.createDataFrame([("Big Gears Ltd", {"k": 1}), ("Big Gears Ltd", {"k": 1}), ("none", None), (None, None), ("a@x", None)], "t string, m map<string,int>")
    catalog = spark.createDataFrame([("gear", "g", 1), ("gears", "gs", 3), ("GEARS", "late", 4), ("x", "short", 5), ("@x.", "at", 6), ("big", "b", 2)], "key string, value string, seq int")
    for most in (100, 1):
        got = facts.longest_match(texts, "t", catalog, most)
        assert sorted((r.t or "", r.value or "") for r in got.collect()) == [("", ""), ("Big Gears Ltd", "gs"), ("Big Gears Ltd", "gs"), ("a@x", ""), ("none", "")]
        assert got.columns == ["t", "m", "value"]


def test_uploads_are_halved_and_packed(spark):
    files = spark.createDataFrame([("f", "a", "x" * 100), ("f", "b", "ü" * 20), ("f", "c", '"' * 30), ("g", "d", "")], "folder string, path string, content string")
    parts = text.halved(files, 60)
    got = {(r.path, r.part): r.size for r in parts.collect()}
    assert max(got.values()) <= 60 and sorted(got) == [("a", "00"), ("a", "01"), ("a", "10"), ("a", "11"), ("b", "0"), ("b", "1"), ("c", "0"), ("c", "1"), ("d", "")]
    assert got["b", "0"] == 25 + 20 and got["c", "0"] == 25 + 30
    assert [(r.path, r.part, r.pack) for r in sorted(text.pack(parts, "folder", 110, 2).collect())][:4] == [("a", "00", 0), ("a", "01", 0), ("a", "10", 1), ("a", "11", 1)]
    assert text.pack(text.halved(files.limit(0), 60), "folder", 110, 2).count() == 0


def test_routes_through_a_provider(spark):
    nodes = spark.createDataFrame(
        [("p", "Acme", "third_party", "", "S", None, "acme", None, None, None), ("q", "Acme Docs", "third_party", "", "S", None, "acme docs", None, None, None), ("d", "gear db", "asset", "database", "s ", "econ", None, None, None, None), ("a", "app", "asset", "service", "root", None, None, None, None, None), ("b", "iac", "asset", "service", "s", None, None, None, None, "aws.x"), ("c", "other", "asset", "service", "t", None, None, None, None, None)], NODE)
    targets = rewrites.provider_targets(nodes, ["acme"], ["gear"], ["econ"])
    assert rows(targets) == [("p", "d")]


def test_outermost_providers_do_not_multiply(spark):
    nodes = spark.createDataFrame([(f"p{i:02}", "Acme", "third_party", "", s, None, None, None, None, None) for i, s in enumerate(["s", "S "] * 20 + ["t", "root"])] + [(f"d{i}", "gear", "asset", "database", s, "econ", None, None, None, None) for i, s in enumerate(["s", "s", "t", "u", None])], NODE)
    outer = rewrites.provider_targets(nodes, ["acme"], ["gear"], ["econ"], outermost=True)
    assert rows(outer) == [("p00", "d0"), ("p00", "d1"), ("p39", "d0"), ("p39", "d1"), ("p40", "d2")]
    both = rewrites.provider_targets(nodes, ["acme"], ["gear"], ["econ"]).groupBy("target").agg(F.min("provider").alias("a"), F.max("provider").alias("b"))
    assert rows(both.select(F.explode(F.array_distinct(F.array("a", "b"))).alias("provider"), "target")) == rows(outer)


def test_generic_databases_collapse(spark):
    nodes = spark.createDataFrame(
        [("m", "", "asset", "database", "s", "pg", None, "v", "postgres", None), ("g1", "", "asset", "database", "s", "pg", None, None, None, None), ("g2", "", "asset", "database", "t", "pg", None, None, None, None), ("g3", "", "asset", "database", "t", "pg", None, None, None, None), ("v", "", "third_party", "", "t", None, None, None, None, None), ("g4", "", "asset", "database", "u", "pg", None, None, None, None), ("g5", "", "asset", "database", None, "pg", None, None, None, None)], NODE)
    actions = rewrites.collapse_generic(nodes, F.col("client") == "pg")
    assert rows(actions) == [("g1", "remove", "m"), ("g2", "promote", "v"), ("g3", "remove", "g2"), ("g4", "keep", None)]
    flows = spark.createDataFrame([("x", "g1", "t"), ("g4", "g4", "t"), ("x", "g2", "t"), ("x", "g4", "t"), ("g2", "x", "t")], "source string, target string, type string")
    assert rows(rewrites.after_collapse(flows, actions)) == [("v", "g2", "database_query"), ("x", "g4", "t")]


def test_preferred_hub_and_corpora(spark):
    hubs = spark.createDataFrame([("h1", "s", 2), ("h2", "t", 1)], "id string, section string, seq int")
    wanted = spark.createDataFrame([("a", "s"), ("b", "x"), ("c", None)], "id string, section string")
    assert rows(rewrites.preferred_hub(wanted, hubs)) == [("a", "h1"), ("b", "h2"), ("c", "h2")]
    assert {r.hub for r in rewrites.preferred_hub(wanted, hubs.limit(0)).collect()} == {None}
    nodes = spark.createDataFrame([("a", "app"), ("b", "app/api"), ("c", "application")], "id string, section string")
    corpus = spark.createDataFrame([("a", "x"), ("b", "y"), ("c", "z")], "id string, word string")
    assert rows(rewrites.rolled_up(corpus, nodes)) == [("a", "x"), ("a", "y"), ("b", "y"), ("c", "z")]


def test_scores_of_nothing(spark):
    components = spark.createDataFrame([], "id string, type string, sub_type string, section string, properties map<string,string>")
    flows = spark.createDataFrame([], "source string, target string, confidence double")
    assert tuple(metrics.component_scores(components).first()) == (0.0, 0.0, 1.0)
    assert tuple(metrics.flow_scores(flows).first()) == (1.0, 1.0)
    assert metrics.interaction_recall(flows, components, spark.createDataFrame([], "source_section string, target_section string")).first()[0] == 1.0


def test_landing_gives_the_first_reason(spark):
    good = ("p", "purpose", "a@b.c", "f" * 40, "t.txt")
    cases = [good, ("p", "other", *good[2:]), ("q", *good[1:]), (*good[:2], "Claude@x.y", *good[3:]), (*good[:2], None, *good[3:]), (*good[:3], "F" * 40, good[4]), (*good[:4], "none.txt"), (*good[:4], "a/fixtures/t.txt")]
    answers = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "id int, target string, slot string, reviewer string, skill string, evidence string")
    asked = spark.createDataFrame([("p", "purpose"), ("p", "purpose"), ("p", "other")], "target string, slot string")
    there = spark.createDataFrame([("t.txt",), ("a/fixtures/t.txt",)], "path string")
    assert [o for _, o in rows(knowledge.landing(answers, asked, there))] == ["landed", "SLOT_NOT_LANDABLE", "NOT_ASKABLE", "REVIEWER_NOT_HUMAN", "REVIEWER_NOT_HUMAN", "BAD_SKILL_SHA", "NO_EVIDENCE", "EVIDENCE_NOT_LANDABLE"]


def test_paths_and_ids(spark):
    df = spark.createDataFrame([("dp::/r/a/r/b\\c",), ("x",), (None,)], "p string")
    assert [r[0] for r in df.select(knowledge.scrubbed(knowledge.bare_id(F.col("p")), "/r/")).collect()] == ["ab/c", "x", None]
    files, seeds = spark.createDataFrame([("a/b",), ("a/bc",), ("x",)], "path string"), spark.createDataFrame([("a/b",), ("x/y",), ("a/b",)], "seed string")
    assert rows(knowledge.near_paths(files, seeds)) == [("a/b", "a/b"), ("a/b", "a/bc"), ("x/y", "x")]
    new = knowledge.numbered_from(spark.createDataFrame([("b",), ("a",)], "k string"), spark.createDataFrame([("cmp_9",), ("cmp_x",), ("flow_99",)], "id string"), "cmp_", ["k"])
    assert rows(new) == [("a", "cmp_10"), ("b", "cmp_11")]


def test_third_party_summary_without_signals(spark):
    components = spark.createDataFrame([("a", False, False)], "id string, provider boolean, heuristic boolean")
    none = spark.createDataFrame([], "id string, labels string, capabilities string, direction string, pieces long")
    assert rows(third_party.data_flow_summary(components, none, none)) == [("a", "unknown:undetermined", "", "unknown", 0.42, "low")]


def test_record_files(spark, tmp_path):
    records = spark.createDataFrame([("a/b" + "c" * 300, "p"), ("plain", "q")], "uid string, pin string")
    path = f"file://{tmp_path}/records"
    storage.write_each(records, path, "uid")
    assert storage.read_records(spark, path, "uid string, pin string", ["p"]).count() == 1
    with pytest.raises(ValueError):
        storage.read_records(spark, path, "uid string, pin string", ["none"])
    names = [r[0] for r in records.select(storage.file_name(F.col("uid"))).collect()]
    assert max(map(len, names)) == 200 and "plain" in names
    with pytest.raises(ValueError):
        storage.write_each(records.union(records), f"{path}2", "uid")
    document = storage.wrapper({"records": records}, "1.0")
    assert [r.part for r in document.collect()] == ["version", "records", "records"]
    paths = spark.createDataFrame([("out/x",), ("outer",), ("facts.json",)], "path string")
    assert rows(storage.without_own_output(paths, "out/", [])) == [("facts.json",), ("outer",)] and rows(storage.without_own_output(paths, "", ["facts.json"])) == [("out/x",), ("outer",)]
