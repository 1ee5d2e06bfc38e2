"""Gates of signals, tokens, evidence and the scope of sessions."""

import datetime

from pyspark.sql import functions as F

from factgraph.operators import signals

RULE = "rule string, origin string, patterns array<string>, category string, labels array<string>, capabilities array<string>, direction string"
COMPONENT = "id string, name string, sub_type string, vendor string, service string, client string"


def lines_of(spark, files):
    return spark.createDataFrame([(p, i + 1, x) for p, t in files.items() for i, x in enumerate(t.split("\n"))], "path string, line_no int, line string")


def test_tokens(spark):
    df = spark.createDataFrame([("a", "Google_AI", None, "Third Party Service", None, "ab")], COMPONENT)
    assert sorted(r["token"] for r in signals.vendor_tokens(df).collect()) == ["google", "googleai", "thirdpartyservice"]
    texts = spark.createDataFrame([(1, "xGoogleAIx"), (2, None), (3, "none")], "k int, t string")
    assert sorted(map(tuple, signals.tokens_within(texts, ["k"], "t", spark.createDataFrame([("google",), ("googleai",)], "token string")).collect())) == [(1, "google"), (1, "googleai")]


def test_gates(spark):
    files = {
        "ai.ts": "const client = openai\nx\nconst prompt = body.text\nfar\nfar\nfar\nfar\nfar prompt =\nclient",
        "both.ts": "send(openai)\n" + "\n" * 8 + "prompt = q\nsend(q)\n" + "\n" * 6 + "gemini",
        "stripe.ts": "stripe.post(card)\npassword\nuser_id\n\n\n\nupload stripe file\n\n\n\nupload file",
        "other.ts": "post(card)",
        "quiet.ts": "stripe\n\n\n\ncard",
    }
    rules = [
        ("card", "pattern", [r"(?i)\bcard\b"], "financial", ["financial_data"], ["payments"], None), ("pwd", "pii", ["(?i)password"], "credentials", ["user_password"], [], None), ("uid", "pii", ["user[_-]?id"], "identifiers", ["user_identifier"], [], None),
        ("prompt_content_input", "non_pii", [r"prompt\s*="], "content_files", ["prompt"], ["ai_inference"], "outbound_to_third_party"), ("file", "non_pii", [r"\bfile\b"], "content_files", ["file"], ["storage"], "inbound_from_third_party"),
    ]
    components = [("openai", "OpenAI", None, None, None, None), ("gemini", "Gemini", None, None, None, None), ("stripe", "Stripe", "payment", None, None, None)]
    own = spark.createDataFrame([(c, p) for c in ("openai", "gemini", "stripe") for p in files], "id string, path string")
    got = signals.vendor_signals(lines_of(spark, files), spark.createDataFrame(list(files.items()), "path string, content string"), own, spark.createDataFrame(components, COMPONENT), spark.createDataFrame(rules, RULE))
    found = {(r["id"], r["path"], r["line_no"], r["rule"]): (r["reason"], r["capabilities"], r["direction"]) for r in got.collect()}
    assert set(found) == {
        ("openai", "ai.ts", 3, "prompt_content_input"), ("openai", "both.ts", 10, "prompt_content_input"), ("gemini", "both.ts", 10, "prompt_content_input"),
        ("stripe", "stripe.ts", 1, "card"), ("stripe", "stripe.ts", 2, "pwd"), ("stripe", "stripe.ts", 3, "uid"), ("stripe", "stripe.ts", 7, "file"),
    }
    assert found["openai", "ai.ts", 3, "prompt_content_input"][0] == "matched non_pii:prompt_content_input signal"
    assert found["gemini", "both.ts", 10, "prompt_content_input"][0].endswith("(shared_ai_handler)")
    assert found["stripe", "stripe.ts", 2, "pwd"] == ("matched pii:pwd signal", ["auth"], "outbound_to_third_party") and found["stripe", "stripe.ts", 3, "uid"][1:] == ([], None)
    assert found["stripe", "stripe.ts", 1, "card"][0] == "matched financial signal"
    summary = {r["id"]: r for r in signals.signal_summary(got).collect()}
    assert summary["stripe"]["direction"] == "bidirectional" and summary["stripe"]["labels"] == ["content_files:file", "credentials:user_password", "financial:financial_data", "identifiers:user_identifier"] and summary["stripe"]["pieces"] == 4


def test_evidence_and_sessions(spark):
    df = spark.createDataFrame([("p", ["a", "b"], {"x": ["b", "c"], "y": []}), ("q", None, None)], "id string, evidence array<string>, property_evidence map<string,array<string>>")
    assert [tuple(r) for r in signals.all_evidence(df).collect()] == [("p", "a"), ("p", "b"), ("p", "b"), ("p", "c")]
    day = lambda d: datetime.datetime(2024, 1, d)
    turns = spark.createDataFrame([("s1", "x", day(1), "1"), ("s1", "x", day(9), "a"), ("s2", "x", day(2), "2"), ("s3", "y", day(9), "3")], "session string, project string, at timestamp, text string")
    since, found = F.lit(day(8)), F.col("text").rlike("[0-9]")
    assert {tuple(r) for r in signals.scoped_sessions(turns, found, since).collect()} == {("s1", 2, 1), ("s3", 1, 1)}
    assert {tuple(r) for r in signals.scoped_sessions(turns, found, since, project="y").collect()} == {("s3", 1, 1)}
    assert {tuple(r) for r in signals.scoped_sessions(turns, found, since, project="y", session="s1").collect()} == {("s1", 2, 1)}


def test_words_of_operations_end_at_accents(spark):
    files = {"a": "stripe éupload card", "b": "stripe xupload card", "c": "stripe uploadé card", "d": "stripe upload_ card"}
    rules = spark.createDataFrame([("card", "pattern", ["card"], "financial", ["financial_data"], [], None)], RULE)
    components = spark.createDataFrame([("stripe", "Stripe", None, None, None, None)], COMPONENT)
    own = spark.createDataFrame([("stripe", p) for p in files], "id string, path string")
    got = signals.vendor_signals(lines_of(spark, files), spark.createDataFrame(list(files.items()), "path string, content string"), own, components, rules, r"(?i)\bupload\b")
    assert sorted(r["path"] for r in got.collect()) == ["a", "c"]
