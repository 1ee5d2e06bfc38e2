"""Rules as data against plain interpreters."""

import json
import random
import re

from factgraph.operators import rules


def test_every_match_holds_a_required_literal():
    rng = random.Random(1)
    for pattern in [r"password", r"\bapi_?key\b", r"(?i)Token|secret", r"(abc|abd)e+", r"foo(bar)*baz", r"x{3}", r"[ab]cd", r"(?:ab|cde)+", r"(abc)?", r"a.c", r"abc(?=def)", r"(?i:HeLLo) w", r"(?P<n>word)(?P=n)", r"wor(?:d|k)s?"]:
        literals = rules.required_literals(pattern)
        for _ in range(3000):
            text = "".join(rng.choice(["abc", "abd", "e", "cd", "foo", "bar", "baz", "x", "Token", "SECRET", "password", "api", "_", "key", "word", "wor", "ks", "hello w", "HELLO w", " ", "cde", "def"]) for _ in range(4))
            if literals is not None and re.search(pattern, text, re.ASCII):
                assert any(lit in text.lower() for lit in literals), (pattern, text, literals)
    assert rules.required_literals(r"[0-9]{16}") is None and rules.required_literals("ab") is None
    assert rules.required_literals(r"\bfoo(barbar|quxqux)") == {"barbar", "quxqux"}


def test_cost_of_a_line_does_not_follow_the_number_of_rules():
    tried = []
    for n in (100, 10_000):
        m = rules.Matcher([(f"r{i}", rf"\bvendor{i:05d}\b", "line", None) for i in range(n)])
        assert m.find("import vendor00042 from 'vendor00007'", "line", None) == [("r7", 26, 36), ("r42", 8, 18)]
        tried.append(m.tried)
    assert tried == [2, 2]


def test_findings_match_a_loop_over_all_rules(spark):
    rng = random.Random(3)
    words = ["import", "axios", "fetch(", "stripe.charge(", "'stripe'", "password", "=", "// fetch(", "x", "Axios", "é", "1234", "# token", "/* axios */"]
    rows = [(f"f{i % 7}", i, rng.choice(["ts", "py", None]), " ".join(rng.choice(words) for _ in range(6))) for i in range(300)] + [("f", 1, "ts", None), ("f", 2, "ts", "")]
    table = [("http", r"\b(axios|fetch)\b", "line", None), ("code", r"fetch\(", "code", "ts"), ("imp", r"^strip", "imports", None), ("call", r"charge$", "calls", None), ("digits", r"\d{4}", "line", "py"), ("any", r"(?i)AXIOS|token", "line", None)]
    lines = rules.line_contexts(spark.createDataFrame(rows, "path string, line_no int, language string, line string"))
    got = sorted(map(tuple, rules.pattern_findings(lines, spark.createDataFrame(table, "rule string, pattern string, context string, language string"), ["path", "line_no"]).collect()))
    want = []
    for r in lines.collect():
        for rule, pattern, context, language in table:
            if r[context] and language in (None, r["language"]) and (m := re.search(pattern, r[context], re.ASCII)):
                want.append((r["path"], r["line_no"], rule, m.start() + 1, m.end(), m[0]))
    assert got == sorted(want) and len({w[2] for w in want}) == 6
    assert rules.pattern_findings(lines, spark.createDataFrame([], "rule string, pattern string"), ["path"]).collect() == []


def interpret(row, own, regexes, lookups):
    out = {}

    def truth(x):
        return x not in (None, "", False, 0) and x != []

    def when(tree):
        (kind, arg), = tree.items()
        if kind == "always":
            return arg
        if kind == "notSet":
            return arg not in out
        if kind == "exists":
            return truth(row[arg])
        if kind == "regex":
            return row[arg["input"]] is not None and re.search(regexes[arg["regex"]], row[arg["input"]]) is not None
        if kind == "equals":
            x = row[arg["input"]]
            return ("undefined" if x is None else ",".join(x) if isinstance(x, list) else str(x).lower() if isinstance(x, bool) else str(x)) == str(arg["value"])
        return not when(arg) if kind == "not" else (any if kind == "anyOf" else all)(when(t) for t in arg)

    for rule in own:
        if when(rule["when"]):
            for p, a in rule["set"].items():
                if not isinstance(a, dict):
                    out[p] = a
                elif "fromInput" in a:
                    if row[a["fromInput"]] is not None:
                        out[p] = row[a["fromInput"]]
                elif "preferInputOrConstant" in a:
                    x = row[a["preferInputOrConstant"]["input"]]
                    out[p] = x if truth(x) else a["preferInputOrConstant"]["fallback"]
                else:
                    key = row[a["lookup"]["keyInput"]]
                    key = key.lower() if key is not None and a["lookup"].get("transform") else key
                    if key in lookups[a["lookup"]["map"]]:
                        out[p] = lookups[a["lookup"]["map"]][key]
    return out


def test_compiled_rules_equal_an_interpreter(spark):
    rng = random.Random(4)
    texts = ["", "Alpha", "beta gamma", 'quo"te\n', None, "x,y"]
    rows = [{"pattern": rng.choice("pq"), "a": rng.choice(texts), "b": rng.choice(texts), "n": rng.choice([0, 5, None]), "l": rng.choice([[], ["x", "y"], None]), "f": rng.choice([True, False, None])} for _ in range(60)]
    df = spark.createDataFrame([tuple(r.values()) for r in rows], "pattern string, a string, b string, n int, l array<string>, f boolean")
    regexes, lookups = {"greek": "(?i)alpha|beta", "any": "."}, {"m": {"alpha": "A", "beta gamma": 2, "Alpha": None}, "none": {}}

    def tree(depth):
        kind = rng.choice(["always", "notSet", "exists", "regex", "equals"] + (["anyOf", "allOf", "not"] if depth else []))
        return {kind: {"always": lambda: rng.random() < 0.8, "notSet": lambda: rng.choice("uvw"), "exists": lambda: rng.choice("abnlf"), "regex": lambda: {"input": rng.choice("ab"), "regex": rng.choice(["greek", "any"])},
                       "equals": lambda: rng.choice([{"input": "a", "value": "x,y"}, {"input": "l", "value": "x,y"}, {"input": "n", "value": 5}, {"input": "f", "value": "true"}, {"input": "b", "value": "undefined"}]),
                       "anyOf": lambda: [tree(depth - 1) for _ in range(rng.randint(1, 3))], "allOf": lambda: [tree(depth - 1) for _ in range(rng.randint(1, 3))], "not": lambda: tree(depth - 1)}[kind]()}

    def assignment():
        return rng.choice([True, None, "c", 7, {"fromInput": rng.choice("abnlf")}, {"preferInputOrConstant": {"input": rng.choice("abl"), "fallback": "z"}}, {"lookup": {"map": "m", "keyInput": rng.choice("ab"), "transform": "lowercase"}}, {"lookup": {"map": rng.choice(["m", "none"]), "keyInput": "a"}}])

    for _ in range(4):
        own = {p: [{"when": tree(2), "set": {rng.choice("uvw"): assignment() for _ in range(2)}} for _ in range(8)] for p in "pq"}
        names = sorted({p for r in own.values() for x in r for p in x["set"]})
        got = [{p: json.loads(r[p]) for p in names if r[p] is not None} for r in rules.infer_by_rules(df, own, regexes, lookups).collect()]
        assert got == [interpret(r, own[r["pattern"]], regexes, lookups) for r in rows]


def test_long_rule_lists_stay_linear(spark):
    own = {"p": [{"when": {"allOf": [{"notSet": f"v{i % 5}"}, {"exists": "a"}]}, "set": {f"v{i % 5}": i, f"w{i}": {"fromInput": "a"}}} for i in range(60)]}
    df = spark.createDataFrame([("p", "x"), ("p", ""), ("q", "x")], "pattern string, a string")
    rows = rules.infer_by_rules(df, own, {}, {}).collect()
    assert [rows[0][f"v{i}"] for i in range(5)] == ["0", "1", "2", "3", "4"] and rows[0]["w59"] is None and rows[1]["v0"] is None and rows[2]["v0"] is None
