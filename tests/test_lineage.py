"""Lineage of ids against plain loops."""

import random

from pyspark.sql import functions as F

from factgraph.operators import lineage


def test_steps_follow_later_merges(spark):
    rng = random.Random(1)
    for rows in ([(s, f"i{i}", f"i{rng.randrange(40)}") for s in range(6) for i in rng.sample(range(40), 25)], [(1, "a", "b"), (1, "b", "a"), (2, "a", "c"), (3, "c", "a"), (4, "x", "x"), (5, "x", "y"), (2, None, "z"), (None, "q", "r")], [(s, f"n{s}", f"n{s + 1}") for s in range(70)]):
        own = [r for r in rows if None not in r]
        want = set()
        for step, old, new in own:
            at, hops = old, 0
            for s in sorted({r[0] for r in own if r[0] >= step}):
                named = {r[1]: r[2] for r in own if r[0] == s}
                if at in named:
                    at, hops = named[at], hops + 1
            want.add((old, step, at, hops))
        got = {(r["id"], r["step"], r["final"], r["hops"]) for r in lineage.lineage(spark.createDataFrame(rows, "step long, old string, new string")).collect()}
        assert got == want
    assert lineage.lineage(spark.createDataFrame([], "step long, old string, new string")).collect() == []


def test_cycles_end_at_their_least_id(spark):
    rng = random.Random(2)
    rows = [(f"i{i}", f"i{rng.randrange(300)}") for i in range(200)] + [(f"c{i}", f"c{i + 1}") for i in range(90)] + [("c90", "c40"), ("self", "self"), (None, "a"), ("a", None)]
    to = {o: n for o, n in rows if o and n and o != n}
    want = set()
    for old in to:
        seen, at = [], old
        while at in to and at not in seen:
            seen.append(at)
            at = to[at]
        want.add((old, min(seen[seen.index(at):]), None, True) if at in seen else (old, at, len(seen), False))
    got = {tuple(r) for r in lineage.final_ids(spark.createDataFrame(rows, "old string, new string")).collect()}
    assert got == want and any(w[3] for w in want) and any(not w[3] for w in want)
    assert lineage.final_ids(spark.createDataFrame([], "old string, new string")).collect() == []


def test_remap_by_key_takes_third_parties_only(spark):
    before = spark.createDataFrame([("a", "third_party", "k1"), ("b", "third_party", "k2"), ("c", "asset", "k1"), ("d", "third_party", None)], "id string, type string, key string")
    after = spark.createDataFrame([("x", "third_party", "k1", 1), ("y", "third_party", "k1", 2), ("z", "asset", "k2", 3)], "id string, type string, key string, seq int")
    remap = lineage.key_remap(before, after)
    assert {tuple(r) for r in remap.collect()} == {("a", "y")}
    rows = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, None)], "n int, target string")
    assert {tuple(r) for r in lineage.remapped(rows, remap).collect()} == {(1, "y"), (2, "y"), (3, "b"), (4, None)}


def test_rounds_follow_tails_and_rings_not_rows(spark, monkeypatch):
    """4,000 rings of two take a few rounds, and none is one more for each doubling of the rows."""
    tables = []
    monkeypatch.setattr(lineage, "written", lambda rows, name, written=lineage.written: (tables.append(name), written(rows, name))[1])
    k = F.col("id")
    merges = spark.range(8000).select(F.format_string("n%05d", k).alias("old"), F.format_string("n%05d", k + F.when(k % 2 == 0, 1).otherwise(-1)).alias("new"))
    got = lineage.final_ids(merges).collect()
    assert {(r.old, r.final, r.cyclic) for r in got} == {(f"n{i:05}", f"n{i // 2 * 2:05}", True) for i in range(8000)}
    assert len(tables) < 10
