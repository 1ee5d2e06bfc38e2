"""Graphs as one JSON document in parts."""

import json

import pytest

from factgraph.sources import storage

EDGE = "id string, source string, target string, confidence double"


def test_parts_join_to_one_document(spark, tmp_path):
    nodes = spark.createDataFrame([(f"n{i:03}", "asset", f'na"me\n{i}', None if i % 2 else "s") for i in range(300)], "id string, type string, name string, section string").repartition(7)
    edges = spark.createDataFrame([(f"e{i}", f"n{i:03}", f"n{i + 1:03}", 0.5) for i in range(50)], EDGE)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    storage.write_document(nodes, edges, {"projectName": "x"}, f"file://{tmp_path}/doc")
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    files = sorted((tmp_path / "doc").glob("part-*"))
    whole = json.loads("".join(f.read_text() for f in files))
    assert len(files) > 1 and whole["schemaVersion"] == "1.0" and whole["metadata"] == {"projectName": "x", "componentsCount": 300, "dataFlowsCount": 50}
    assert [n["id"] for n in whole["graph"]["nodes"]] == [f"n{i:03}" for i in range(300)] and whole["graph"]["nodes"][1] == {"id": "n001", "type": "asset", "name": 'na"me\n1'}
    assert len(whole["graph"]["edges"]) == 50 and whole["graph"]["edges"][0]["confidence"] == 0.5
    storage.write_document(nodes.limit(0), edges.limit(0), {}, f"file://{tmp_path}/empty")
    assert json.loads("".join(f.read_text() for f in sorted((tmp_path / "empty").glob("part-*"))))["graph"] == {"nodes": [], "edges": []}


def test_faults_keep_a_graph_from_being_written(spark, tmp_path):
    nodes = spark.createDataFrame([("a", "asset"), ("a", "asset"), (None, "asset"), ("b", " ")], "id string, type string")
    edges = spark.createDataFrame([("e", "a", "b", 1.0), ("f", "a", "lost", 1.0), (None, "a", None, 1.0)], EDGE)
    got = {tuple(r) for r in storage.graph_faults(nodes, edges).collect()}
    assert got == {("repeated_node", "a"), ("node_without_id", ""), ("node_without_type", "b"), ("edge_without_end", "f"), ("edge_without_end", ""), ("edge_without_id", "")}
    with pytest.raises(ValueError, match="1 node_without_id"):
        storage.write_document(nodes, edges, {}, f"file://{tmp_path}/doc")
    assert not (tmp_path / "doc").exists()


def test_items_that_repeat_are_exploded_once(spark):
    from pyspark.sql import functions as F

    from factgraph.operators import knowledge

    items = spark.range(1000).select(F.lit("x").alias("item"), F.array(F.lit("a"), F.lit("b")).alias("handled_by"))
    facts = spark.createDataFrame([("a", "A"), ("b", "B"), ("c", "C")], "id string, name string")
    out = knowledge.document_components(facts, items)
    assert sorted(map(tuple, out.collect())) == [("a", "A", "x"), ("b", "B", "x"), ("c", "C", "")]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    at = plan.index("Generate explode")
    assert "Aggregate [" in plan[at:]  # repeats go before they are multiplied
