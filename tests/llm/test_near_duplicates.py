"""What the near-duplicate stage compares: unlike texts on one template are told apart before they are paired."""

import time
from pathlib import Path

import numpy as np
import pytest

from factgraph.llm import common, components, dedup

from test_llm_operators import docs_of, edited, left_by_all_pairs


def test_unlike_fillings_of_a_template_are_not_compared(spark, monkeypatch):
    rng = np.random.default_rng(21)
    base = [f"w{w}" for w in rng.integers(0, 5000, 150)]
    texts = [" ".join(t) for t in (*(edited(rng, base, 7) for _ in range(120)), *(edited(rng, base, 2) for _ in range(40)))]
    compared, similar = [], dedup._similar

    def counted(pairs, *rest):
        compared.append(pairs.select("a", "b").count())
        return similar(pairs, *rest)

    monkeypatch.setattr(dedup, "_similar", counted)
    got = sorted(r.doc_id for r in dedup.drop_near_duplicates(docs_of(spark, texts)).collect())
    assert got == left_by_all_pairs(texts) and 2 < len(got) < 160
    assert sum(compared) < 6 * len(texts)


@pytest.mark.parametrize("n", [1, 4, 9, 60, 400])
def test_similar_texts_pass_the_bounds(n):
    rng = np.random.default_rng(n)
    bound = (1 - dedup.SIMILARITY) / (1 + dedup.SIMILARITY)
    for _ in range(200):
        a = np.unique(rng.integers(-(1 << 63), 1 << 63, n))
        b = np.unique(np.r_[a[rng.random(len(a)) < 0.95], rng.integers(-(1 << 63), 1 << 63, rng.integers(0, n // 8 + 2))])
        differ = len(np.setxor1d(a, b))
        bits = sum(int(x ^ y).bit_count() if x ^ y >= 0 else ((x ^ y) & (1 << 64) - 1).bit_count() for x, y in zip(dedup._parities(a), dedup._parities(b), strict=True))
        assert bits <= differ
        if differ <= bound * (len(a) + len(b)):
            order = dedup.Order(np.intersect1d(a, b)[:3])
            p, q = order.prefix(a).tolist(), order.prefix(b).tolist()
            s = next(x for x in p if x in set(q))
            reach = [(len(t) - r.index(s)) * (1 + dedup.SIMILARITY) / dedup.SIMILARITY - len(t) + 1e-6 for t, r in ((a, p), (b, q))]
            assert len(b) <= reach[0] and len(a) <= reach[1]


def _shuffle_files(spark):
    folders = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    return {str(f) for d in folders for f in Path(d).rglob("shuffle_*")}


def test_a_written_table_leaves_no_shuffle_files(spark):
    before, key = _shuffle_files(spark), "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = spark.conf.get(key, None)
    table = common.stage_table(spark.range(5000).selectExpr("id % 700 as k").groupBy("k").count(), "grouped")
    until = time.time() + 10
    while (left := _shuffle_files(spark) - before) and time.time() < until:
        time.sleep(0.2)
    assert not left and table.count() == 700 and spark.conf.get(key, None) == was


def test_components_leave_one_table(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(common, "shared_dir", lambda spark: str(tmp_path))
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)], "a long, b long")
    assert {r.root for r in components.components(edges).collect()} == {0}
    assert len(list(tmp_path.iterdir())) == 1


def test_unlike_long_texts_do_not_bring_their_shingles(spark, monkeypatch):
    rng = np.random.default_rng(5)
    base = [f"w{w}" for w in rng.integers(0, 5000, 1200)]
    texts = [" ".join(t) for t in (*(edited(rng, base, 90) for _ in range(20)), *(edited(rng, base, 6) for _ in range(6)))]
    shown, shingled = [], dedup._shingled

    def counted(rows, make, schema):
        if make is shingled and "node" in schema:
            shown.append(rows.count())
        return map_rows(rows, make, schema)

    map_rows = dedup.map_rows
    monkeypatch.setattr(dedup, "map_rows", counted)
    got = sorted(r.doc_id for r in dedup.drop_near_duplicates(docs_of(spark, texts)).collect())
    assert got == left_by_all_pairs(texts) and 2 < len(got) < 26
    assert sum(shown) < len(texts)
