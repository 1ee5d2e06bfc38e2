"""The newest answer of each fact's property, kept up to date by a stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from factgraph.sources.storage import shared_path


def _last() -> Column:
    return F.max(F.struct("ts", "seq", "value")).alias("m")


def newest(answers: DataFrame) -> DataFrame:
    """fact_id, property, value, seq of the newest set in a batch of answers."""
    return answers.filter("action = 'set'").groupBy("fact_id", "property").agg(_last()).select("fact_id", "property", "m.value", "m.seq")


def answer_stream(spark: SparkSession, paths: str, schema: StructType, files_a_batch: int = 1) -> DataFrame:
    """New parquet files as a stream; ``paths`` is a folder or a glob (a plain file isn't taken)."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(paths)


def keep_newest(answers: DataFrame, folder: str | None = None) -> DataFrame:
    """Run a stream of answers to its end and return the rows of ``newest``.

    A batch writes only the facts that it changed, under its own number, so a repeated batch replaces itself; of a fact's rows the
    one with the newest answer holds. State and output lie in ``folder``, on shared storage: a later run with the same folder goes
    on where the last one ended. Without one, a new folder is taken."""
    spark = answers.sparkSession
    folder = folder or shared_path(spark, "answers")
    keyed = answers.filter("action = 'set'").groupBy("fact_id", "property").agg(_last())

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/rows/batch={number}")

    keyed.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    done = spark.read.schema(keyed.schema).parquet(f"{folder}/rows")
    return done.groupBy("fact_id", "property").agg(F.max("m").alias("m")).select("fact_id", "property", "m.value", "m.seq")
