"""Operators on small rows: ties, nulls, empty tables."""

from pyspark.sql import functions as F

from factgraph.operators import facts, graph, text


def test_dedupe_prefers_confidence_then_order(spark):
    flows = spark.createDataFrame([(1, "a", "b", "x", 0.5), (2, "a", "b", "y", 0.9), (3, "a", "b", "x", 0.9), (4, "b", "a", "x", 0.9), (5, "c", "c", "x", 1.0)], "seq int, source string, target string, type string, confidence double")
    assert sorted(r.seq for r in graph.dedupe_directed(flows, ["seq"]).collect()) == [2, 4, 5]
    assert sorted(r.seq for r in graph.dedupe_undirected(flows, ["seq"]).collect()) == [2, 5]
    assert sorted(r.seq for r in graph.dedupe_typed(flows, ["seq"]).collect()) == [1, 2, 4]
    assert graph.dedupe_directed(flows.limit(0), ["seq"]).count() == 0


def test_orphans_get_their_sections_hub(spark):
    components = spark.createDataFrame([("h", "asset", "application", "A"), ("v", "third_party", "vendor", "A"), ("w", "third_party", "vendor", "B")], "id string, type string, sub_type string, section string")
    flows = spark.createDataFrame([], "source string, target string, type string, confidence double")
    assert [tuple(r) for r in graph.attach_orphans(components, flows).collect()] == [("h", "v", 0.6)]
    assert {(r.code, r.subject) for r in graph.red_flags(components, flows).collect()} == {("isolated_component", "h"), ("isolated_component", "v"), ("isolated_component", "w"), ("section_without_hub", "B"), ("orphan_third_party", "v"), ("orphan_third_party", "w")}


def test_globs(spark):
    paths = spark.createDataFrame([("a/b.txt",), ("a/c/d.txt",), ("x.txt",), ("ab/x.md",)], "path string")
    hit = {r.path for r in paths.filter(text.excluded(F.col("path"), ["a/**", "**/x.md"])).collect()}
    assert hit == {"a/b.txt", "a/c/d.txt", "ab/x.md"}


def test_running_total_matches_a_plain_sum(spark):
    rows = spark.createDataFrame([(f"k{i:04d}", i % 7) for i in range(1000)], "k string, v int")
    got = {r.k: r.running for r in text.running_total(rows, "k", "v").collect()}
    total = 0
    for i in range(1000):
        total += i % 7
        assert got[f"k{i:04d}"] == total


def test_answers(spark):
    rows = spark.createDataFrame([(1, 1, 1, "set", "p", 1.0), (2, 1, 1, "set", "p", 2.0), (3, 2, 1, "set", "p", 3.0), (4, 2, 2, "remove", "p", 0.0), (5, 2, 3, "set", "p", 4.0)], "seq int, fact_id int, ts int, action string, property string, value double")
    assert [(r.fact_id, r.seq) for r in facts.apply_answers(rows).collect()] == [(1, 2)]
    assert {r.seq: r.status for r in facts.answer_status(rows).collect()} == {1: "applied", 2: "applied", 3: "applied", 4: "removes", 5: "ignored"}


def test_cost_is_null_without_a_price(spark):
    usage = spark.createDataFrame([("a", "m", 10), ("a", "?", 5), ("b", "m", 1)], "agent string, model string, tokens int")
    prices = spark.createDataFrame([("m", 2.0)], "model string, price double")
    assert {r.agent: (r.tokens, r.cost) for r in facts.token_cost(usage, prices).collect()} == {"a": (15, None), "b": (1, 2e-06)}


def test_context_must_be_near(spark):
    lines = spark.createDataFrame([("a", 1, "hit"), ("a", 2, None), ("a", 3, "verb"), ("a", 9, "hit"), ("b", 1, "hit"), ("c", 1, "hit verb")], "path string, line_no int, line string")
    got = text.near_context(lines, F.col("line").contains("hit"), F.col("line").contains("verb"))
    assert sorted((r.path, r.line_no) for r in got.collect()) == [("a", 1), ("c", 1)]


def test_cascade(spark):
    flows = spark.createDataFrame([("f", "a", "b"), ("g", "b", "c"), ("h", "a", "a")], "id string, source string, target string")
    links = spark.createDataFrame([(1, "a", "x"), (2, "y", "c")], "seq long, source string, target string")
    got = facts.cascade(spark.createDataFrame([("a",), ("a",)], "id string"), flows, links)
    assert sorted(map(tuple, got.collect())) == [("component", "a"), ("flow", "f"), ("flow", "h"), ("link", "1")]
