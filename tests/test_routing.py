"""Routing through providers against a sequential loop."""

import random
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from factgraph.operators import routing
from factgraph.plans.registry import ORACLE_SQL, QUERIES

NODE = "id string, seq int, type string, sub_type string, section string, address string, main boolean"
FLOW = "id string, seq string, source string, target string, type string, confidence double"


def loop(nodes, flows, pairs):
    by_id = {n[0]: n for n in nodes}
    state = [dict(zip(("source", "target", "type", "confidence"), f[2:], strict=True)) | {"how": "kept"} for f in sorted(flows, key=lambda f: f[1])]
    keys = {(f["source"], f["target"]) for f in state}
    norm = lambda s: "" if (s or "").strip().lower() in ("", "root", "<unsectioned>", "global") else s.strip().lower()
    fits = lambda a, b: not norm(a) or not norm(b) or norm(a) == norm(b)
    for _, provider, target, direct in sorted(pairs):
        if provider not in by_id or target not in by_id or not fits(by_id[provider][4], by_id[target][4]):
            continue
        if (provider, target) not in keys:
            keys.add((provider, target))
            state.append({"source": provider, "target": target, "type": "database_query", "confidence": 0.75, "how": "provider_link"})
        if direct:
            continue
        for f in state:
            own = by_id.get(f["source"])
            if f["target"] != target or f["source"] == provider or own is None or not fits(own[4], by_id[provider][4]) or (own[5] or "").strip():
                continue
            used = own[0]
            if own[2] == "asset" and own[6] and by_id[provider][2] == "third_party":
                used = next((n[0] for n in sorted(nodes, key=lambda n: n[1]) if n[0] != own[0] and n[2] == "asset" and n[3] == "api" and (n[4] or "") == (own[4] or "")), used)
            if (used, provider) not in keys:
                keys.add((used, provider))
                state.append({"source": used, "target": provider, "type": "api_call", "confidence": max(0.72, f["confidence"]), "how": "source_hop"})
            if f["type"] in ("database_query", "api_call"):
                f |= {"source": provider, "confidence": max(f["confidence"], 0.75), "how": "rewired"}
    return sorted((f["source"], f["target"], f["type"], f["confidence"], f["how"]) for f in state)


def test_routing_equals_a_loop(spark):
    seen = set()
    for seed in range(4):
        rng = random.Random(seed)
        pick = rng.choice
        sections = ["s", "S ", "t", None, "root"]
        nodes = [(f"a{i}", i, "asset", pick(["api", "service", "api"]), pick(sections), pick([None, None, "aws.x", " "]), rng.random() < 0.5) for i in range(10)]
        nodes += [(f"p{i}", 20 + i, pick(["third_party", "third_party", "asset"]), "vendor", pick(sections), None, False) for i in range(4)] + [(f"d{i}", 30 + i, "asset", "database", pick(sections), None, False) for i in range(5)]
        flows = [(f"f{i:02}", f"{i:02}", pick([f"a{rng.randrange(10)}", f"p{rng.randrange(4)}", "unknown"]), pick([f"d{rng.randrange(5)}", f"d{rng.randrange(5)}", f"p{rng.randrange(4)}"]), pick(["database_query", "api_call", "rpc"]), pick([0.5, 0.73, 0.9])) for i in range(40)]
        every = [(p, d) for p in range(4) for d in range(5)]
        pairs = [(i, f"p{p}", f"d{d}", rng.random() < 0.2) for i, (p, d) in enumerate(sorted(rng.sample(every, 10)))]
        got = routing.route_in_order(spark.createDataFrame(flows, FLOW), spark.createDataFrame(nodes, NODE), spark.createDataFrame(pairs, "turn int, provider string, target string, direct boolean"))
        want = loop(nodes, flows, pairs)
        assert sorted(map(tuple, got.collect())) == want
        seen |= {w[4] for w in want}
    assert seen == {"kept", "provider_link", "source_hop", "rewired"}
    none = routing.route_in_order(spark.createDataFrame(flows, FLOW), spark.createDataFrame(nodes, NODE), spark.createDataFrame([], "turn int, provider string, target string, direct boolean"))
    assert none.count() == 40


def test_later_providers_see_rewired_flows(spark):
    nodes = [("a", 1, "asset", "service", "s", None, False), ("p", 2, "third_party", "", "s", None, False), ("q", 3, "third_party", "", "s", None, False), ("d", 4, "asset", "database", "s", None, False)]
    flows = [("1", "1", "a", "d", "database_query", 0.5), ("2", "2", "a", "d", "rpc", 0.9)]
    got = routing.route_in_order(spark.createDataFrame(flows, FLOW), spark.createDataFrame(nodes, NODE), spark.createDataFrame([(1, "p", "d", False), (2, "q", "d", False)], "turn int, provider string, target string, direct boolean"))
    assert sorted(map(tuple, got.collect())) == [
        ("a", "d", "rpc", 0.9, "kept"), ("a", "p", "api_call", 0.72, "source_hop"), ("a", "q", "api_call", 0.9, "source_hop"), ("p", "q", "api_call", 0.75, "source_hop"), ("q", "d", "database_query", 0.75, "provider_link"),
        ("q", "d", "database_query", 0.75, "rewired"), ("q", "d", "database_query", 0.75, "rewired")]


def test_flows_pass_all_providers_of_a_section(spark, tmp_path):
    source = Path("/root/testdata/sf0.01")
    con = duckdb.connect()
    for t in ("nation", "part", "customer", "orders", "lineitem"):
        (tmp_path / f"{t}.parquet").symlink_to(source / f"{t}.parquet")
    spark.read.parquet(str(source / "supplier.parquet")).withColumn("s_nationkey", F.col("s_suppkey").cast("int") % 3).write.parquet(str(tmp_path / "supplier.parquet"))
    for t in ("nation", "part", "customer", "orders", "lineitem"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet'")
    con.execute(f"CREATE VIEW supplier AS SELECT * FROM '{tmp_path}/supplier.parquet/*.parquet'")
    columns = ["how", "source", "target", "type", "confidence"]
    got = sorted(map(tuple, QUERIES["route_through_provider"](spark, str(tmp_path)).select(columns).collect()))
    assert got == sorted(con.execute(ORACLE_SQL["route_through_provider"]).fetchall())
    linked = {}
    for how, provider, target, _, _ in got:
        if how in ("provider_link", "rewired"):
            linked.setdefault(target, []).append(provider)
    hops = {r[:3] for r in got if r[0] == "source_hop" and r[1].startswith("s")}
    assert max(map(len, linked.values())) > 2 and len({r[2] for r in hops}) > 3


@pytest.mark.parametrize("rewired", [("api_call",), ("database_query",), ()])
def test_links_of_other_types_pass_providers_in_order(spark, rewired):
    nodes = [(f"p{i}", i, "third_party", "", pick, "aws" if i == 3 else None, False) for i, pick in enumerate(["s", "s", None, "s", "t", "s"])] + [("a", 10, "asset", "service", "s", None, False), ("d", 11, "asset", "database", "s", None, False)]
    flows = [("1", "1", "a", "d", "database_query", 0.5), ("2", "2", "a", "d", "api_call", 0.9), ("3", "3", "p1", "d", "api_call", 0.6)]
    pairs = [(i, f"p{i}", "d", i == 2) for i in range(6)]
    got = routing.route_in_order(spark.createDataFrame(flows, FLOW), spark.createDataFrame(nodes, NODE), spark.createDataFrame(pairs, "turn int, provider string, target string, direct boolean"), rewired)
    by_id, open_ = {n[0]: n for n in nodes}, lambda n: not n[5]
    state, known = [[*f[2:], "kept"] for f in flows], {f[2:4] for f in flows}
    for _, p, d, direct in pairs:
        if p == "p4":
            continue  # of another section than its target
        if (p, d) not in known:
            known.add((p, d))
            state.append([p, d, "database_query", 0.75, "provider_link"])
        for f in [] if direct else [f for f in state if f[1] == d and f[0] != p and open_(by_id[f[0]])]:
            if (f[0], p) not in known:
                known.add((f[0], p))
                state.append([f[0], p, "api_call", max(0.72, f[3]), "source_hop"])
            if f[2] in rewired:
                f[0], f[3], f[4] = p, max(f[3], 0.75), "rewired"
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, state))
