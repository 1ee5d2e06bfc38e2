"""Facts kept as keyed state: any split into batches, restarts, late answers and tombstones."""

import datetime
import random

from factgraph.operators import facts
from factgraph.streaming.answers import answer_stream
from factgraph.streaming.state import keep_facts

SCHEMA = "seq long, fact_id long, ts timestamp, action string, property string, value double"


def test_any_split_gives_the_same_state(spark, tmp_path):
    rng = random.Random(1)
    day = datetime.datetime(2024, 1, 1)
    rows = [(i, rng.randrange(12), day + datetime.timedelta(minutes=rng.randrange(200)), "remove" if rng.random() < 0.03 else "set", rng.choice("abc"), float(rng.randrange(100))) for i in range(300)]
    want = sorted(map(tuple, facts.apply_answers(spark.createDataFrame(rows, SCHEMA)).collect()))
    assert 0 < len({w[0] for w in want}) < 12
    for name, cuts in (("two", [150]), ("many", [20, 90, 200])):
        source, folder = tmp_path / name / "in", f"file://{tmp_path}/{name}/out"
        rng.shuffle(rows)
        parts = [rows[a:b] for a, b in zip([0, *cuts], [*cuts, 300], strict=True)]
        for i, part in enumerate(parts):  # each run goes on where the one before ended
            spark.createDataFrame(part, SCHEMA).coalesce(1).write.parquet(f"{source}/{i}")
            got = keep_facts(answer_stream(spark, f"{source}/*", spark.createDataFrame([], SCHEMA).schema), folder)
        assert sorted(map(tuple, got.collect())) == want
