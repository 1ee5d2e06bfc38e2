"""The pipeline's stages on a small table: what goes, what stays, and the columns."""

import hashlib

import public_tokenizers
import tiktoken

import corpus_pipeline
from factgraph.llm import bpe, secrets, toxicity

from test_llm_operators import leaks, left_by_all_pairs

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    bench = spark.read.parquet(f"{SF}/benchmark.parquet").first().text
    more = [(90_001, f"Zuvor {bench} danach"), (90_002, 'zzz qqq xxx password = "hunter2hunter2" end'), (90_003, 'zzz qqq xxx password = "hunter2hunter2" end'), (90_004, None)]
    docs = docs.unionByName(spark.createDataFrame(more, "doc_id long, text string"), allowMissingColumns=True)
    seen = [{r.doc_id for r in docs.collect()}]
    for _, stage in corpus_pipeline.STAGES:
        last, docs = docs, stage(spark, docs, SF)
        seen.append({r.doc_id for r in docs.collect()})
        assert seen[-1] <= seen[-2]
        if stage is not corpus_pipeline.STAGES[-1][1]:
            assert docs.columns == last.columns
    assert 90_003 in seen[1] and 90_003 not in seen[2] and 90_002 in seen[2]
    assert 90_001 in seen[2] and 90_001 not in seen[3]
    assert seen[3] == seen[4] == seen[5] and {90_002, 90_004} <= seen[5]
    masked = {r.doc_id: r.text for r in last.collect()}
    assert masked[90_002] == "zzz qqq xxx [secret] end" or "hunter2" not in masked[90_002]
    for r in docs.collect():
        assert r.decoded_sha256 == hashlib.sha256((masked[r.doc_id] or "").encode()).hexdigest()


def test_run_matches_brute_force(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    scorer = toxicity.fit(docs, labels).scorer()
    rows = [(r.doc_id, r.text) for r in docs.orderBy("doc_id").collect() if scorer.score(r.text) < toxicity.THRESHOLD]
    rows = [rows[i] for i in left_by_all_pairs([t for _, t in rows])]
    gone = {d for d, _ in leaks(rows, items)}
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(public_tokenizers.path(bpe.VOCABULARY)), special_tokens={})
    want = []
    for d, text in rows:
        if d not in gone:
            masked = secrets.redact(text) or ""
            ids = encoding.encode_ordinary(masked)
            want.append((d, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(masked.encode()).hexdigest()))
    got = corpus_pipeline.run(spark, SF)
    assert sorted(tuple(r[c] for c in ("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")) for r in got.collect()) == want


def test_stages_on_odd_tables(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, node long, k1 string, score double, root int, fp long"
    odd = spark.createDataFrame([(1, None, None, None, None, 1, "a", 0.1, 1, 1), (2, "", None, "s", 0, 2, "b", 0.2, 2, 2), (3, "so long " * 100_000, "en", "s", 1, 3, "c", 0.3, 3, 3), (3, "so long " * 100_000, "en", "s", 1, 3, "c", 0.3, 3, 3), (None, "no id", "en", "s", 5, 4, "d", 0.4, 4, 4)], schema)
    for docs, left in ((odd, [-1, 1, 3]), (odd.limit(0), [])):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, SF)
            assert docs.columns == odd.columns
        assert sorted(r.doc_id or -1 for r in docs.collect()) == left
        assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == len(left)
