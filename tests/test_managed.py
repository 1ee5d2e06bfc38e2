"""Managed services against a sequential loop over providers and rules."""

import random

from factgraph.operators import managed

PROVIDER = "id string, seq int, provider string, provider_seq int, section string"
NODE = "id string, seq int, type string, sub_type string, name string, client string, section string, resource_type string, block_name string, address string, cloud_provider string, service string, vendor string, managed_by string, managed_key string"
RULE = "provider string, seq int, key string, label string, type string, sub_type string, flow_type string, signals array<string>, always boolean, exact array<string>, prefixes array<string>"
RULES = [
    ("aws", 1, "lambda", "Lambda", "asset", "compute_service", "api_call", ["lambda"], False, ["aws_lambda_function"], []), ("aws", 2, "s3", "S3", "asset", "storage", "file_transfer", ["s3"], False, [], ["aws_s3_", "aws_"]),
    ("aws", 3, "postgres", "RDS", "asset", "database", "database_query", ["rds", "postgres"], False, [], []), ("azure", 1, "blob", "Blob", "asset", "storage", "api_call", ["blob"], False, [], ["azurerm_"]), ("azure", 2, "portal", "Portal", "asset", "service", "api_call", [], True, [], []),
]


def loop(providers, nodes, rules, corpus, flows):
    names = NODE.replace(" string", "").replace(" int", "").split(", ")
    state = [dict(zip(names, n, strict=True)) for n in sorted(nodes, key=lambda n: n[1])]
    norm = lambda s: "" if (s or "").strip().lower() in ("", "root", "<unsectioned>", "global") else s.strip().lower()
    fits = lambda a, b: not norm(a) or not norm(b) or norm(a) == norm(b)

    def belongs(n, p):
        rt, cloud = (n["resource_type"] or "").strip().lower(), (n["cloud_provider"] or "").strip().lower()
        return any(rt.startswith(x) for x in managed.RESOURCES[p]) or cloud == p or p == "supabase" and "supabase" in rt

    def match(n, r):
        rt = (n["resource_type"] or "").strip().lower()
        if r[9] or r[10]:
            return rt != "" and (rt in r[9] or any(rt.startswith(x) for x in r[10]))
        hay = " ".join([rt, (n["block_name"] or "").lower(), (n["address"] or "").lower()])
        has, lacks = managed.CONSISTENT.get(r[2], ((), ()))
        return any(s in hay for s in r[7]) and (rt == "" or r[2] not in managed.CONSISTENT or any(x in rt for x in has) and not any(x in rt for x in lacks))

    out = []
    iac = lambda n: n["type"] == "asset" and n["address"] and not n["address"].startswith("provider.")
    for pid, _, provider, _, section in sorted(providers, key=lambda p: (p[3], p[1])):
        words = [w.lower() for i, w in corpus if i == pid]
        for r in [r for r in sorted(rules, key=lambda r: r[1]) if r[0] == provider]:
            code = any(s in w for s in r[7] for w in words)
            like = [n for n in state if r[2] in managed.IMPLICIT and n["type"] == "asset" and n["sub_type"] == "database" and not n["address"] and any(x in v.lower() for x in managed.POSTGRES for v in (n["name"], n["client"] or "")) and fits(section, n["section"])]
            stands = next((n for n in like if code or any(provider in (n[h] or "").lower() for h in ("cloud_provider", "service", "vendor"))), None)
            own = [n for n in state if iac(n) and fits(section, n["section"]) and belongs(n, provider) and match(n, r)]
            free = [n for n in own if n["managed_by"] is None and "taken" not in n]
            if free:
                for n in free:
                    n["taken"] = True
                    out.append((pid, r[2], n["id"], "adopt", r[3] if len(free) == 1 else f"{r[3]} · {(n['block_name'] or '').strip() or n['id']}", r[4], r[5]))
            elif stands or own or r[8] or code:
                held = next((n for n in state if n["managed_by"] == pid and n["managed_key"] == r[2]), None)
                if stands:
                    out.append((pid, r[2], stands["id"], "rename", r[3], None, None))
                elif held:
                    out.append((pid, r[2], held["id"], "keep", None, None, None))
                else:
                    out.append((pid, r[2], f"cmp_managed_{provider}_{r[2]}_{pid}", "create", r[3], r[4], r[5]))
    return sorted(out, key=repr), {(p, n) for p, _, n, *_ in out} - flows


def test_plan_equals_a_loop(spark):
    seen = set()
    for seed in range(4):
        rng = random.Random(seed)
        pick = rng.choice
        sections = ["s", "T ", None, "root", "t"]
        providers = [(f"v{i}", i, pick(["aws", "aws", "azure"]), 0, pick(sections)) for i in range(5)]
        providers = [(i, s, p, 1 if p == "aws" else 2, x) for i, s, p, _, x in providers]
        nodes = []
        for i in range(22):
            iac = rng.random() < 0.6
            nodes.append((f"n{i:02}", i, pick(["asset", "asset", "third_party"]), pick(["database", "service"]), pick(["my pg", "store", "Postgres"]), pick([None, "pg", "redis"]), pick(sections), pick(["aws_lambda_function", "AWS_S3_bucket", "aws_iam_lambda", "azurerm_x", "aws_rds_cluster", "", None]) if iac else None, pick(["rds block", "b", " ", None]) if iac else None,
                          pick(["mod.a", "mod.lambda", "provider.aws"]) if iac else None, pick([None, None, "aws", "azure"]), pick([None, "aws rds"]), None, pick([None, None, None, "v0", "v1"]), pick(["s3", "lambda", "postgres"])))
        corpus = [(pick(["v0", "v1", "v2"]), pick(["uses S3 now", "postgres://", "nothing", "blob store"])) for _ in range(4)]
        flows = {("v0", "n01"), ("v1", "n02")}
        plan, links = managed.managed_plan(spark.createDataFrame(providers, PROVIDER), spark.createDataFrame(nodes, NODE), spark.createDataFrame(RULES, RULE), spark.createDataFrame(corpus, "id string, word string"), spark.createDataFrame(sorted(flows), "source string, target string"))
        want, new = loop(providers, nodes, RULES, corpus, flows)
        assert sorted(map(tuple, plan.select("provider_id", "key", "node", "action", "name", "type", "sub_type").collect()), key=repr) == want
        assert {(r["source"], r["target"]) for r in links.collect()} == new
        seen |= {w[3] for w in want}
    assert seen >= {"adopt", "rename", "create"}
