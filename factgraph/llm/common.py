"""Shared helpers: tables in the cluster's shared folder, row-wise Arrow operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows that a Python worker holds as objects. Spark bounds an Arrow batch in bytes; the objects made of it are bounded by
#: taking it in slices.
BATCH_ROWS = 256


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset and all runs on this machine, as
    in tests, a temporary one is set; on a cluster that is an error, since a folder of the driver's is no shared one."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="factgraph-")
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


#: With it Spark removes the shuffle files of a query that has ended, instead of waiting for the driver's garbage collection.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def write_table(df: DataFrame, path: str) -> None:
    """Write ``df``; its shuffle files go with the end of the write, as nothing else reads them."""
    conf = df.sparkSession.conf
    before = conf.get(_CLEANUP, None)
    conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        conf.unset(_CLEANUP) if before is None else conf.set(_CLEANUP, before)


def stage_table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage is cut and the table outlives lost executors."""
    path = shared_path(df.sparkSession, name)
    write_table(df, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Scratch:
    """Stage tables that are removed together once what follows from them is written: ``with Scratch(spark) as keep``, or ``clear``."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def __call__(self, df: DataFrame, name: str) -> DataFrame:
        path = shared_path(self.spark, name)
        write_table(df, path)
        self.paths.append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        self.clear()

    def clear(self) -> None:
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        for p in self.paths:
            path = jvm.org.apache.hadoop.fs.Path(p)
            path.getFileSystem(conf).delete(path, True)
        self.paths.clear()


#: Keys with more than this share of the rows are dealt over several tasks.
HOT_SHARE = 1 / 1024


def hot_join(left: DataFrame, right: DataFrame, key: str | list[str], by: str, how: str = "inner") -> DataFrame:
    """``left`` joined with ``right``, which has distinct keys. The rows of a key that is more than HOT_SHARE of ``left`` are
    dealt by their column ``by`` over so many tasks, and the key's row of ``right`` is repeated for each."""
    keys = [key] if isinstance(key, str) else key
    most = max(1.0, left.count() * HOT_SHARE)
    hot = left.groupBy(*keys).agg(F.count("*").alias("n")).filter(F.col("n") > most).select(*keys, F.ceil(F.col("n") / most).alias("factgraph_parts"))
    hot = F.broadcast(hot)  # fewer than 1 / HOT_SHARE rows
    one = F.coalesce("factgraph_parts", F.lit(1))
    x = left.join(hot, keys, "left").withColumn("factgraph_part", F.pmod(F.xxhash64(by), one)).drop("factgraph_parts")
    y = right.join(hot, keys, "left").withColumn("factgraph_part", F.explode(F.sequence(F.lit(0).cast("long"), one - 1))).drop("factgraph_parts")
    return x.join(y, [*keys, "factgraph_part"], how).drop("factgraph_part")


def ascii_lower(col: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in slices of BATCH_ROWS rows."""
    for b in batches:
        for at in range(0, b.num_rows, BATCH_ROWS):
            yield b.slice(at, BATCH_ROWS)


def map_rows(df: DataFrame, make: Callable[[], Callable[..., tuple]], schema: str) -> DataFrame:
    """Apply a row function over Arrow batches. ``make`` builds the function once for a task, so that tables and caches
    that it needs are built there; it gets a row's values in column order and returns the output values."""
    names = list(df.sparkSession.createDataFrame([], schema).schema.names)
    arrow = _arrow_schema(df.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = make()
        for b in slices(batches):
            rows = [fn(*r) for r in zip(*(c.to_pylist() for c in b.columns), strict=True)]
            cols = list(zip(*rows, strict=True)) if rows else [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, arrow.types, strict=True)], schema=arrow)

    return df.mapInArrow(run, schema)


def append_columns(df: DataFrame, inputs: list[str], make: Callable[[], Callable[..., tuple]], schema: str) -> DataFrame:
    """All columns of ``df`` and those of ``schema``, which a row function (see map_rows) gives for the ``inputs``."""
    more = _arrow_schema(df.sparkSession, schema)
    at = [df.columns.index(c) for c in inputs]
    out_type = T.StructType([*df.schema.fields, *df.sparkSession.createDataFrame([], schema).schema.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = make()
        for b in slices(batches):
            rows = [fn(*r) for r in zip(*(b.column(i).to_pylist() for i in at), strict=True)]
            cols = list(zip(*rows, strict=True)) if rows else [()] * len(more)
            made = [pa.array(list(c), t) for c, t in zip(cols, more.types, strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, *made], names=[*b.schema.names, *more.names])

    return df.mapInArrow(run, out_type)


def _arrow_schema(spark: SparkSession, ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(spark.createDataFrame([], ddl).schema)
