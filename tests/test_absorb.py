"""Absorption of handlers on cases of its rules."""

from factgraph.operators import absorb

COMPONENT = "id string, seq int, name string, type string, sub_type string, section string, confidence double, service string, managed_key string, managed_by string, handler_type string, main boolean"
FLOW = "id string, seq int, source string, target string, type string, confidence double"


def node(id_, seq, name, section, **more):
    given = {"type": "asset", "sub_type": None, "confidence": 0.9, "service": None, "managed_key": None, "managed_by": None, "handler_type": None, "main": False} | more
    return (id_, seq, name, given["type"], given["sub_type"], section, given["confidence"], given["service"], given["managed_key"], given["managed_by"], given["handler_type"], given["main"])


def test_handlers_flows_and_evidence_move_to_the_service(spark):
    components = [
        node("cmp_7", 1, "api", "a", main=True), node("h1", 2, "onUpload", "a", handler_type="serverless_handler", confidence=0.95), node("h2", 3, "signup lambda", "a", sub_type="function"), node("h3", 4, "worker", "a"),
        node("aws", 5, "Amazon Web Services", "a", type="third_party"), node("plain", 6, "lambda notes", "a", sub_type="service"), node("cron", 7, "job", "a", handler_type="cron"),
        node("fn", 8, "Aws Lambda", "b", sub_type="compute_service", managed_by="aws2", confidence=0.5), node("h4", 9, "Handler", "b", sub_type="function"), node("h5", 10, "Handler", " ROOT ", sub_type="function"), node("h6", 11, "x", None, handler_type="serverless_handler"),
        node("m", 12, "managed handler", "a", sub_type="function", managed_key="queue"),
    ]
    flows = [("f1", 1, "h1", "h2", "rpc", 0.5), ("f2", 2, "cmp_7", "h1", "rpc", 0.5), ("f3", 3, "cmp_7", "h3", "rpc", 0.9), ("f4", 4, "h1", "h4", "rpc", 0.7), ("f5", 5, "plain", "cron", "rpc", 0.1), ("f6", 6, "plain", "cron", "rpc", 0.2)]
    locations = [("h1", 1, "x.ts", 1, 2), ("h2", 1, "x.ts", 1, 2), ("h3", 1, "y.ts", 1, 2), ("fn", 1, "z.ts", 3, 4), ("h4", 2, "z.ts", 3, 4), ("plain", 1, "x.ts", 1, 2), ("plain", 2, "x.ts", 1, 2)]
    detections = [("h3", 1, "AWS_LAMBDA", "y.ts", 1), ("h1", 1, "express_route", "x.ts", 1), ("plain", 1, "express_route", "x.ts", 1)]
    x = absorb.absorb_handlers(spark.createDataFrame(components, COMPONENT), spark.createDataFrame(flows, FLOW), spark.createDataFrame(locations, "id string, seq int, file string, start int, end int"), spark.createDataFrame(detections, "id string, seq int, pattern string, file string, start int"))
    assert {(r["id"], r["into"]) for r in x.absorbed.collect()} == {("h1", "cmp_8"), ("h2", "cmp_8"), ("h3", "cmp_8"), ("h4", "fn")}
    left = {r["id"]: r for r in x.components.collect()}
    assert set(left) == {"cmp_7", "aws", "plain", "cron", "fn", "h5", "h6", "m", "cmp_8"}
    assert (left["cmp_8"]["name"], left["cmp_8"]["confidence"], left["cmp_8"]["managed_by"], left["cmp_8"]["section"]) == ("Aws Lambda", 0.95, "aws", "a")
    assert left["fn"]["confidence"] == 0.5 and left["fn"]["managed_by"] == "aws2"
    got = {(r["source"], r["target"], r["type"], r["confidence"], r["note"]) for r in x.flows.collect()}
    moved = "handler_absorbed_into_lambda"
    assert got == {("cmp_7", "cmp_8", "rpc", 0.5, moved), ("cmp_8", "fn", "rpc", 0.7, moved), ("plain", "cron", "rpc", 0.1, None), ("aws", "cmp_8", "api_call", 0.78, "provider_to_managed_lambda"), ("aws2", "fn", "api_call", 0.78, "provider_to_managed_lambda")}
    assert sorted((r["id"], r["file"]) for r in x.locations.collect()) == [("cmp_8", "x.ts"), ("cmp_8", "y.ts"), ("fn", "z.ts"), ("plain", "x.ts"), ("plain", "x.ts")]
    assert sorted((r["id"], r["pattern"]) for r in x.detections.collect()) == [("cmp_8", "AWS_LAMBDA"), ("cmp_8", "express_route"), ("plain", "express_route")]


def test_a_hub_gets_a_flow_where_there_is_none(spark):
    components = spark.createDataFrame([node("hub", 1, "app", "a", main=True), node("h", 2, "x", "a", handler_type="serverless_handler", confidence=0.3)], COMPONENT)
    empty = (spark.createDataFrame([], FLOW), spark.createDataFrame([], "id string, seq int, file string, start int, end int"), spark.createDataFrame([], "id string, seq int, pattern string, file string, start int"))
    x = absorb.absorb_handlers(components, *empty)
    assert [(r["source"], r["target"], r["confidence"]) for r in x.flows.collect()] == [("hub", "cmp_1", 0.6)]
    assert x.components.filter("id = 'cmp_1'").first()["confidence"] == 0.78
    none = absorb.absorb_handlers(components.filter("id = 'hub'"), *empty)
    assert none.components.count() == 1 and none.flows.count() == 0 and none.absorbed.count() == 0
