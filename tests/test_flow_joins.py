"""How joins over all flows are done: flows are neither sorted nor moved more often than needed."""

import pytest

from factgraph.operators import graph
from factgraph.plans.registry import QUERIES
from factgraph.sources import tables

SF = "/root/testdata/sf0.001"


@pytest.fixture
def large(spark):
    """Joins as they are on tables too large to be broadcast."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield spark
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def plan(df, capsys):
    capsys.readouterr()
    df.explain()
    return capsys.readouterr().out


@pytest.mark.parametrize("name", ["flow_reverse_actor", "flow_crossing"])
def test_ends_are_met_without_sorting_flows(large, capsys, name):
    text = plan(QUERIES[name](large, SF), capsys)
    assert text.count("ShuffledHashJoin") >= 3
    # what is left are joins of components with the 25 nations
    assert not [x for x in text.splitlines() if "SortMergeJoin" in x and "nationkey" not in x]


def test_earliest_flows_are_moved_once_and_sorted_once(spark, capsys, monkeypatch):
    monkeypatch.setattr(graph, "PER_TASK", 1000)
    flows = tables.flows(spark, SF).drop("id", "confidence")
    once = graph.dedupe_typed(flows, tables.SEQ)
    text = plan(once, capsys).split("Initial Plan")[-1]
    assert "Window" not in text and "REPARTITION_BY_NUM" in text and text.count("Exchange") == 3
    want = graph.first_per_key(flows.filter("source <> target"), ["source", "target", "type"], tables.SEQ)
    assert once.count() == want.count() and once.exceptAll(want.select(once.columns)).isEmpty()


@pytest.mark.parametrize("few", [0, 500_000])
def test_rewired_flows_with_few_or_many_gone(spark, monkeypatch, few):
    monkeypatch.setattr(graph, "FEW", few)
    monkeypatch.setattr(graph, "PER_TASK", 100)
    components = spark.createDataFrame([("a", "third_party", "v", "X"), ("b", "asset", "application", "X"), ("d", "actor", "u", "Y"), ("e", "third_party", "v", "Z")], "id string, type string, sub_type string, section string")
    flows = spark.createDataFrame([(1, "a", "d", "rpc"), (2, "a", "b", "rpc"), (3, "d", "a", "rpc"), (4, "b", "d", "rpc"), (5, "e", "d", "rpc"), (6, "d", "b", "rpc")], "seq long, source string, target string, type string")
    got = graph.drop_and_rewire(flows, components, spark.createDataFrame([("a",), ("e",)], "id string"), ["seq"])
    assert sorted(map(tuple, got.select("seq", "source", "target", "type").collect())) == [(1, "b", "d", "rpc"), (6, "d", "b", "rpc")]
    got = graph.contract(flows, spark.createDataFrame([("a", "x"), ("b", "x")], "id string, into string"), ["seq"])
    assert sorted(map(tuple, got.select("seq", "source", "target", "type").collect())) == [(1, "x", "d", "rpc"), (3, "d", "x", "rpc"), (5, "e", "d", "rpc")]


def test_recall_neither_sorts_nor_groups_flows(large, capsys):
    text = plan(QUERIES["interaction_scores"](large, SF), capsys)
    assert "keys=[source#" not in text and not [x for x in text.splitlines() if "SortMergeJoin" in x and ("[source#" in x or "[target#" in x)]


@pytest.mark.parametrize("name", ["candidates"])
def test_candidates_meet_ends_without_sorting_flows(large, capsys, name):
    text = plan(QUERIES[name](large, SF), capsys)
    assert text.count("ShuffledHashJoin") >= 6 and not [x for x in text.splitlines() if "SortMergeJoin" in x and ("[source" in x or "[target" in x)]


def test_containment_reads_lines_once(spark, capsys):
    text = plan(QUERIES["containment_join"](spark, SF), capsys)
    assert "documents.parquet" not in text and "Generate posexplode" not in text
