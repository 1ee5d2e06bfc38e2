"""Rules of predicates, reasons, properties and slots, each on cases that a looser rule would get wrong."""

from pyspark.sql import functions as F

from factgraph.functions import scalars
from factgraph.operators import knowledge, rewrites, third_party


def kept(df):
    return sorted(r[0] for r in df.collect())


def test_only_transports_without_a_destination_are_bare(spark):
    rows = [
        ("axios", "x", None, "axios", None, None, None), ("named", "Axios call", None, None, None, None, None), ("name_only", "Axios", None, None, None, None, None), ("other_service", "x", "stripe", "axios", None, None, None), ("own_service", "x", "Http-Client", None, None, None, None),
        ("manifest", "x", None, "axios", None, None, "dependency_manifest"), ("url", "x", None, "axios", ["http://localhost/", "https://api.stripe.com"], None, None), ("local", "x", None, "axios", ["http://127.0.0.1/"], None, None), ("template", "x", None, "axios", ["https://${HOST}/"], None, None),
        ("host", "x", None, "axios", None, "run.app", None), ("env", "x", None, "axios", ["https://process.env.HOST"], None, None), ("url_name", "https://a.com", None, "axios", None, None, None), ("private", "x", None, "axios", ["http://10.0.0.1/"], None, None),
    ]
    df = spark.createDataFrame(rows, "id string, name string, service string, client string, urls array<string>, host string, source_context string")
    assert kept(df.filter(rewrites.is_bare_client()).select("id")) == ["axios", "env", "local", "named", "own_service", "template"]


def test_service_classes_but_collections(spark):
    assets = spark.createDataFrame([(i, "asset", s) for i, s in (("plain", "service"), ("items", "service"), ("ns", "service"), ("other", "service"), ("far", "service"), ("api", "api"), ("snippet", "service"), ("mixed", "service"), ("late", "service"), ("win", "service"))], "id string, type string, sub_type string")
    places = spark.createDataFrame([("plain", "src/services/deep/a.tsx", 1, None), ("items", "services/b.ts", 1, None), ("ns", "x/services/c.ts", 1, None), ("other", "lib/d.ts", 1, None), ("far", "services/e.ts", 1, None), ("api", "services/f.ts", 1, None), ("snippet", "services/g.ts", None, "export class GService {"), ("mixed", "services/h.ts", 1, None), ("late", "services/e.ts", 3, None), ("win", "src\\services\\w.ts", 1, "export class W2Service")], "id string, path string, start_line int, code string")
    found = spark.createDataFrame([(i, "auth_middleware") for i in ("plain", "items", "ns", "other", "far", "api", "snippet", "mixed", "late", "win")] + [("mixed", "express_route")], "id string, pattern string")
    lines = [("src/services/deep/a.tsx", 4, "export class AService {"), ("services/b.ts", 1, "export class BService"), ("services/b.ts", 2, "  extends ItemsService {"), ("x/services/c.ts", 1, "export class CService extends d.ItemsService {"), ("lib/d.ts", 1, "export class DService {"), ("services/e.ts", 5, "export class EService {"), ("services/f.ts", 1, "export class FService {"), ("services/h.ts", 1, "export class HService {")]
    got = rewrites.service_classes(assets, places, found, spark.createDataFrame(lines, "path string, line_no int, line string"))
    assert kept(got) == ["late", "plain", "snippet", "win"]


def test_public_urls(spark):
    cases = {"https://a.com": True, "HTTP://A.com": True, "http://10.1.2.3/": True, "ftp://a": False, "https://localhost:1": False, "https://${X}": False, "https://process.env.X/": False, "x https://a": False}
    df = spark.createDataFrame([(u,) for u in cases], "u string").select("u", scalars.is_public_url(F.col("u")))
    assert dict(map(tuple, df.collect())) == cases


def test_reasons_need_whole_words(spark):
    reasons = {"name of the author": [], "tokenizer options": [], "auth token": ["auth_token"], "reads DB_PASSWORD": ["user_password"], "a password": ["auth_token", "user_password"], "uses Secrets Manager": ["auth_token"], "secret in secrets manager": ["auth_token"], "connection parameters": ["technical_identifier"], "lambda": [None], "ports": []}
    df = third_party.reason_signals(spark.createDataFrame([(r,) for r in reasons], "reason string"))
    got = {r: [] for r in reasons}
    for row in df.collect():
        got[row["reason"]].append(row["label"])
    assert {r: sorted(x, key=str) for r, x in got.items()} == reasons


def test_inferability(spark):
    df = spark.createDataFrame([(p,) for p in ("client", "api_type", "api_endpoint", "documentation_url", "integration_status", "vendor", "dpa_expiry_date")], "p string").select("p", third_party.inferability(F.col("p")))
    assert dict(map(tuple, df.collect())) == {"client": "heuristic", "api_type": "heuristic", "api_endpoint": "heuristic", "documentation_url": "direct", "integration_status": "heuristic", "vendor": "direct", "dpa_expiry_date": "not_inferable_v1"}


def test_properties_count_before_they_are_cited(spark):
    bundle = "id string, vendor string, vendor_score double, urls array<string>, hints array<string>, auth array<string>, dependencies int, manifest boolean, called boolean, known array<string>"
    rows = [("uncited", None, None, [], ["api"], ["basic_auth", "jwt"], 1, False, False, []), ("known", "Stripe", 0.92, [], [], [], 0, False, False, ["vendor"]), ("found", "Stripe", 0.92, ["https://a"], [], [], 0, False, False, ["client"])]
    got = {(r["id"], r["property"]): (r["value"], r["score"], r["confidence"], r["band"]) for r in third_party.infer_properties(spark.createDataFrame(rows, bundle)).collect()}
    mean = round((0.82 + 0.8 + 0.78 + 0.83 + 0.8) / 5, 2)
    assert {k: v for k, v in got.items() if k[0] == "uncited"} == {("uncited", "authentication_method"): ("jwt", 0.78, mean, "medium"), ("uncited", "integration_status"): ("active", 0.8, mean, "medium")}
    assert not any(k[0] == "known" for k in got)
    assert {k[1] for k in got if k[0] == "found"} == {"vendor", "serviceName", "api_type", "api_endpoint", "https_enforced"}


def test_slot_values(spark):
    cases = [
        ("in_scope", "  x ", "x", None), ("in_scope", " ", None, "empty_scope"), ("actor_kind", " person", "person", None), ("actor_kind", "Person", None, "unknown_actor_kind"), ("purpose", "unspecified", "unspecified", None), ("purpose", "analytics, marketing", None, "unknown_purpose"),
        ("data_categories", "health, contact ,,health", '["contact","health"]', None), ("data_categories", '[" contact ", "other"]', '["contact","other"]', None), ("data_categories", "[]", None, "no_category"), ("data_categories", "[1]", None, "no_list_of_categories"), ("data_categories", "[contact]", None, "no_list_of_categories"),
        ("data_categories", "contact,unspecified", None, "unspecified_category"), ("data_categories", "Contact", None, "unknown_category"), ("data_categories", None, None, "no_category"), ("name", "x", None, "no_slot"),
    ]
    df = spark.createDataFrame([(i, s, r) for i, (s, r, _, _) in enumerate(cases)], "i int, s string, r string").select("i", knowledge.slot_value(F.col("s"), F.col("r")).alias("v")).orderBy("i")
    assert [(r["v"]["value"], r["v"]["error"]) for r in df.collect()] == [(v, e) for _, _, v, e in cases]


def test_roots_go_at_any_depth(spark):
    nested = "r/"
    for _ in range(9):
        nested = "r" + nested + "/"
    texts = [nested + "x", "a r/b r/c", "r\\b", None, "plain/path"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", knowledge.scrubbed(F.col("t"), "r").alias("t")).orderBy("i")
    assert [r["t"] for r in df.collect()] == ["x", "a b c", "b", None, "plain/path"]


def test_scans_end_at_the_budget(spark):
    files = [("b/x.txt", b"12345"), ("a-b.txt", b"12"), ("a/z.txt", b"1"), ("a/big.txt", b"x" * 50), ("c.txt", b"123456"), ("c2.txt", b"1"), ("z/big.txt", b"x" * 50), ("a/third_party/q.txt", b"1"), ("yarn.lock", b"1"), ("a/nul.bin", b"1\x002"), ("a/bad.txt", b"\xff\xfe"), ("go.sum", b"1"), ("project/events/e.txt", b"1"), ("a/empty.txt", b"")]
    df = spark.createDataFrame(files, "path string, content binary")
    read, coverage = knowledge.scan_records(df, 20, 9)
    assert sorted(map(tuple, read.collect())) == [("a-b.txt", 2, "12"), ("a/empty.txt", 0, ""), ("a/z.txt", 1, "1"), ("b/x.txt", 5, "12345")]
    assert tuple(coverage.first()) == (4, 1, True)
    read, coverage = knowledge.scan_records(df, 20, 1000)
    assert read.count() == 6 and tuple(coverage.first()) == (6, 2, False)
    assert knowledge.scan_records(df.limit(0))[1].first()["scanned"] == 0
