"""The state of facts kept by a stream: last writer wins for each property, and a removed fact stays removed, in whatever order answers come."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BooleanType, DoubleType, LongType, StringType, StructType

from factgraph.sources.storage import shared_path

_PROVIDER, _ROCKS = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_OUT = StructType().add("fact_id", LongType()).add("property", StringType()).add("value", DoubleType()).add("ts", LongType()).add("seq", LongType()).add("gone", BooleanType())
_KEY = StructType().add("property", StringType())
_HELD = StructType().add("value", DoubleType()).add("ts", LongType()).add("seq", LongType())
_GONE = StructType().add("gone", BooleanType())


class FactState(StatefulProcessor):
    """One fact's properties with their newest answers, and whether it was removed. A removed fact keeps only its tombstone, so answers that come late can't bring it back."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getMapState("held", _KEY, _HELD)
        self.gone = handle.getValueState("gone", _GONE)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        (fact,) = key
        if self.gone.exists():
            return
        newest: dict[str, Row] = {}
        removed = False
        for r in rows:
            removed |= r["action"] == "remove"
            if r["action"] == "set" and (r["property"] not in newest or (r["ts"], r["seq"]) > (newest[r["property"]]["ts"], newest[r["property"]]["seq"])):
                newest[r["property"]] = r
        if removed:
            self.gone.update((True,))
            self.held.clear()
            yield Row(fact_id=fact, property=None, value=None, ts=None, seq=None, gone=True)
            return
        for name, r in newest.items():
            before = self.held.getValue((name,)) if self.held.containsKey((name,)) else None
            if before is None or (r["ts"], r["seq"]) > (before[1], before[2]):
                self.held.updateValue((name,), (r["value"], r["ts"], r["seq"]))
                yield Row(fact_id=fact, property=name, value=r["value"], ts=r["ts"], seq=r["seq"], gone=False)

    def close(self) -> None:
        pass


def keep_facts(answers: DataFrame, folder: str | None = None) -> DataFrame:
    """fact_id, property, value, seq after a stream of answers (seq, fact_id, ts, action, property, value) has run to its end: the newest set of each property, by time and then seq, of the facts that nothing removed.

    Each fact is keyed state in the checkpoint; a batch writes only what it changed, under its own number, so a repeated batch replaces itself. State and output lie in ``folder``, on shared storage: a later run with it goes on where the last one
    ended, with its tombstones. Without one, a new folder is taken. The result is the same however the answers are split into batches."""
    spark = answers.sparkSession
    folder = folder or shared_path(spark, "facts")
    changes = answers.select(F.col("fact_id").cast("long").alias("fact_id"), "action", "property", F.col("value").cast("double").alias("value"), F.unix_micros(F.col("ts").cast("timestamp")).alias("ts"), F.col("seq").cast("long").alias("seq"))
    changes = changes.groupBy("fact_id").transformWithState(FactState(), _OUT, "Update", "None")

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/rows/batch={number}")

    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKS)  # this kind of state needs it
    try:
        changes.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.unset(_PROVIDER) if before is None else spark.conf.set(_PROVIDER, before)
    done = spark.read.schema(_OUT).parquet(f"{folder}/rows")
    gone = done.filter("gone").select("fact_id").distinct()
    newest = done.filter("not gone").groupBy("fact_id", "property").agg(F.max(F.struct("ts", "seq", "value")).alias("m"))
    return newest.join(gone, "fact_id", "left_anti").select("fact_id", "property", "m.value", "m.seq")
