"""JSON documents on shared storage: validated reads, overwriting and appending sinks, one folder per record."""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share, spark.checkpoint.dir. Where it's unset and all runs on this
    machine, as in tests, a temporary one is set; on a cluster that is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="factgraph-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


#: With it Spark removes the shuffle files of a query that has ended, instead of waiting for the driver's garbage collection.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` after a round trip through the shared folder: lineage is cut, and lost executors cost nothing done before. The shuffle
    files of the write go with its end, as nothing else reads them."""
    return _write(rows, shared_path(rows.sparkSession, name))


@contextmanager
def written_meanwhile(rows: DataFrame, name: str) -> Iterator[DataFrame]:
    """``rows`` as by ``written``, until what follows from them is written: then they are removed."""
    path, context = shared_path(rows.sparkSession, name), rows.sparkSession.sparkContext
    yield _write(rows, path)
    at = context._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(context._jsc.hadoopConfiguration()).delete(at, True)


def _write(rows: DataFrame, path: str) -> DataFrame:
    conf = rows.sparkSession.conf
    before = conf.get(_CLEANUP, None)
    conf.set(_CLEANUP, "true")
    try:
        rows.write.parquet(path)
    finally:
        conf.unset(_CLEANUP) if before is None else conf.set(_CLEANUP, before)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def read_json(spark: SparkSession, path: str, schema: str, key: str | None = None) -> DataFrame:
    """The documents of a file or folder. A document that doesn't fit the schema, or whose key is null, fails the job that
    reads it."""
    rows = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    if key is None:
        return rows
    checked = F.when(F.col(key).isNull(), F.raise_error(F.lit(f"a document has no {key}"))).otherwise(F.col(key))
    return rows.withColumn(key, checked)


def split_valid(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(documents, malformed lines as column ``raw``): syntax errors are kept as warnings."""
    raw = spark.read.text(path).withColumn("_doc", F.from_json("value", f"{schema}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    bad = F.col("_doc").isNull() | F.col("_doc._bad").isNotNull()
    return raw.filter(~bad).select("_doc.*").drop("_bad"), raw.filter(bad).select(F.col("value").alias("raw"))


def write_json(rows: DataFrame, path: str, append: bool = False) -> None:
    """Replace the documents of a folder, or add to them."""
    rows.write.mode("append" if append else "overwrite").json(path)


def write_each(rows: DataFrame, path: str, key: str) -> None:
    """One folder per record, named by ``key``, which must be unique and filled: else nothing is written and it fails."""
    if not rows.groupBy(key).count().filter((F.col("count") > 1) | F.col(key).isNull()).isEmpty():
        raise ValueError(f"{key} is not unique or has nulls")
    rows.withColumn("_file", file_name(F.col(key))).repartition("_file").write.mode("errorifexists").partitionBy("_file").json(path)


def read_records(spark: SparkSession, folder: str, schema: str, pins: list[str] | None = None, pin: str = "pin") -> DataFrame:
    """The records of a folder's JSON files, in order of file names as far as they are sorted by ``_file``; only those of the ``pins``,
    if any are given. A folder without any records is an error."""
    rows = read_json(spark, folder, schema).withColumn("_file", F.input_file_name())
    rows = rows.filter(F.col(pin).isin(pins)) if pins else rows
    if rows.isEmpty():
        raise ValueError(f"no records in {folder}")
    return rows


def file_name(uid: Column, most: int = 200) -> Column:
    """A file-safe name of an id: other characters than letters, digits, dots, _ and - become _; names of more than ``most``
    characters are cut and end in 16 digits of the id's hash."""
    safe = F.regexp_replace(uid, "[^A-Za-z0-9._-]+", "_")
    short = F.concat(F.substring(safe, 1, most - 17), F.lit("-"), F.substring(F.sha2(uid, 256), 1, 16))
    return F.when(F.length(safe) > most, short).otherwise(safe)


def wrapper(parts: dict[str, DataFrame], version: str) -> DataFrame:
    """part, at, json: a document in rows, the version first and then every row of the parts as JSON in order of its own text, so that
    a writer can stream it and nothing is gathered."""
    rows = [df.select(F.lit(name).alias("part"), F.to_json(F.struct(*df.columns)).alias("json")) for name, df in parts.items()]
    head = next(iter(parts.values())).sparkSession.createDataFrame([("version", f'{{"schemaVersion":"{version}"}}')], "part string, json string")
    for r in rows:
        head = head.unionByName(r)
    return head


def graph_faults(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """fault, id of what keeps a graph from being written: nodes (id, type) and edges (id, source, target) without an id or a node without a type, ids that repeat, and ends that are no node."""
    def named(rows: DataFrame, part: str) -> DataFrame:
        lost = rows.filter("id is null or trim(id) = ''").select(F.lit(f"{part}_without_id").alias("fault"), F.lit("").alias("id"))
        return lost.unionByName(rows.filter("id is not null").groupBy("id").agg(F.count("*").alias("n")).filter("n > 1").select(F.lit(f"repeated_{part}").alias("fault"), "id"))

    bare = nodes.filter("type is null or trim(type) = ''").select(F.lit("node_without_type").alias("fault"), F.coalesce("id", F.lit("")).alias("id"))
    ends = edges.select("id", F.explode(F.array("source", "target")).alias("end"))
    loose = ends.join(nodes.select(F.col("id").alias("end")).distinct(), "end", "left_anti").select(F.lit("edge_without_end").alias("fault"), F.coalesce("id", F.lit("")).alias("id")).distinct()
    return named(nodes, "node").unionByName(named(edges, "edge")).unionByName(bare).unionByName(loose)


def write_document(nodes: DataFrame, edges: DataFrame, metadata: dict, folder: str, version: str = "1.0") -> None:
    """Write a graph as one JSON document, {"schemaVersion", "graph": {"nodes", "edges"}, "metadata"}, cut into the text files of ``folder``: joined in the order of their names they are the document. Nodes and edges have their columns as keys, nulls left out, and are
    sorted by id; metadata gets their counts. Raises ValueError if the graph has faults (see graph_faults). No file, and no task, needs more than its share of rows."""
    faults = graph_faults(nodes, edges).groupBy("fault").agg(F.count("*").alias("n")).orderBy("fault").collect()  # one row for each kind
    if faults:
        raise ValueError("the graph isn't valid: " + ", ".join(f"{f['n']} {f['fault']}" for f in faults))
    spark = nodes.sparkSession
    parts = [df.select(F.lit(at).alias("at"), F.col("id").cast("string").alias("id"), F.to_json(F.struct(*df.columns)).alias("json")) for at, df in ((1, nodes), (3, edges))]
    firsts = {at: p.agg(F.min("id")).first()[0] for at, p in zip((1, 3), parts, strict=True)}
    # every row but a part's first begins with a comma, so that nobody has to know which is the last
    rows = [p.withColumn("json", F.when(F.col("id") == firsts[at], F.col("json")).otherwise(F.concat(F.lit(","), "json"))) for at, p in zip((1, 3), parts, strict=True) if firsts[at] is not None]
    counts = {"componentsCount": nodes.count(), "dataFlowsCount": edges.count()}
    said = json.dumps(metadata | counts)
    frame = [(0, "", f'{{"schemaVersion":{json.dumps(version)},"graph":{{"nodes":['), (2, "", '],"edges":['), (4, "", f']}},"metadata":{said}}}')]
    whole = spark.createDataFrame(frame, "at int, id string, json string")
    for r in rows:
        whole = whole.unionByName(r)
    whole.repartitionByRange("at", "id").sortWithinPartitions("at", "id").select("json").write.text(folder)


def without_own_output(paths: DataFrame, output: str, own: list[str]) -> DataFrame:
    """Paths (path) that aren't in the output folder of an earlier run; where that is the root (``""``), only the files ``own``
    names are left out."""
    folder = output.strip("/")
    return paths.filter(~F.startswith("path", F.lit(folder + "/"))) if folder else paths.filter(~F.col("path").isin(own))
