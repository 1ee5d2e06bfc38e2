"""Rename detection against pairwise similarity and greedy assignment."""

import random
import re
from collections import Counter, defaultdict

from factgraph.operators import renames


def greedy(base, head, least=0.5):
    gone, come = [{p: c for p, c in x.items() if p not in y and c} for x, y in ((base, head), (head, base))]
    sides = []
    for own in (gone, come):
        by = defaultdict(list)
        for p in sorted(own):
            by[own[p]].append(p)
        sides.append({ps[0]: (c, ps) for c, ps in by.items()})
    chunks = lambda t: Counter(re.findall(renames.CHUNK, t))
    edges = []
    for s, (a, _) in sides[0].items():
        for d, (b, _) in sides[1].items():
            x, y = chunks(a), chunks(b)
            score = sum(min(n, y[k]) * len(k) for k, n in x.items()) / max(len(a), len(b))
            if score >= least:
                edges.append((-score, s, d))
    left, out = [{n: list(ps) for n, (_, ps) in side.items()} for side in sides], []
    for score, s, d in sorted(edges):
        while left[0][s] and left[1][d]:
            out.append((left[0][s].pop(0), left[1][d].pop(0), round(-score, 9)))
    return sorted(out)


def test_renames_equal_a_greedy_loop(spark):
    for seed in range(3):
        rng = random.Random(seed)
        line = lambda: " ".join(rng.choice("alpha beta gamma delta eps".split()) for _ in range(rng.choice([1, 3, 30])))
        pool = [[line() for _ in range(rng.randint(1, 12))] for _ in range(8)]

        def variant(pool=pool, line=line, rng=rng):
            own = [x for x in rng.choice(pool) if rng.random() < 0.9]
            return "\n".join(own + [line() for _ in range(rng.randint(0, 3))]) + rng.choice(["", "\n"])

        same = ["copy\n" * 5, "", "license\n" * 3 + "x"]
        base = {f"a/{i}": rng.choice([variant(), rng.choice(same)]) for i in range(40)}
        head = {f"b/{i}": rng.choice([variant(), rng.choice(same), rng.choice(list(base.values()))]) for i in range(40)} | {f"a/{i}": "stays" for i in range(5)}
        frames = [spark.createDataFrame(list(x.items()), "path string, content string") for x in (base, head)]
        got = sorted((a, b, round(s, 9)) for a, b, s in renames.detected_renames(*frames).collect())
        want = greedy(base, head)
        assert got == want and len(want) > 10
    assert renames.detected_renames(frames[0], frames[0]).collect() == []
    assert renames.detected_renames(frames[0].limit(0), frames[1]).collect() == []


def test_equal_scores_take_no_round_each(spark, monkeypatch):
    """All of 30 old and 30 new contents are equally similar, so the names decide of every pair; tables aren't written for each."""
    tables = []
    monkeypatch.setattr(renames, "written", lambda rows, name, written=renames.written: (tables.append(name), written(rows, name))[1])
    common = "".join(f"common line {k}\n" for k in range(10))
    frames = [spark.createDataFrame([(f"{x}/{i:02}", common + f"own line {x} {i:02}\n") for i in range(30)], "path string, content string") for x in "ab"]
    got = sorted((a, b) for a, b, _ in renames.detected_renames(*frames).collect())
    assert got == [(f"a/{i:02}", f"b/{i:02}") for i in range(30)]
    assert len(tables) < 20
