"""Operators on files and lines: signals, context windows, searches, packing."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .graph import first_per_key


def host_of(url: Column) -> Column:
    """The host of an absolute URL, lower-cased, without user and port; null if there's none."""
    return F.lower(F.nullif(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1), F.lit("")))


def vendor_of(host: Column) -> Column:
    """The host without leading api., www. or m."""
    return F.regexp_replace(host, r"^(api|www|m)\.", "")


def excluded(path: Column, globs: list[str]) -> Column:
    """Whether a path matches one of the globs: ``x/**`` is everything below x, ``**`` any path, ``*`` one segment's part."""
    def pattern(glob: str) -> str:
        out = ""
        i = 0
        while i < len(glob):
            if glob.startswith("**/", i):
                out, i = out + "(?:.*/)?", i + 3
            elif glob.startswith("**", i):
                out, i = out + ".*", i + 2
            elif glob[i] == "*":
                out, i = out + "[^/]*", i + 1
            else:
                out, i = out + ("\\" if not glob[i].isalnum() and glob[i] not in "/_-" else "") + glob[i], i + 1
        return out

    return path.rlike("^(?:" + "|".join(map(pattern, globs)) + ")$")


def signal_hits(lines: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """path, language, line_no, line, rule for every line that a rule (name, pattern) matches; a rule is one column expression,
    so lines are read once and nothing is joined."""
    hits = F.array(*(F.when(F.col("line").rlike(p), F.lit(n)) for n, p in rules))
    return lines.select("path", "language", "line_no", "line", F.explode(F.array_compact(hits)).alias("rule"))


#: What \\b is where only ASCII letters, digits and _ make words. A fixed value.
_ASCII_BOUNDARY = "(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"


def ascii_words(pattern: str) -> str:
    """A pattern for rlike whose \\b knows ASCII only, as in SQL and in Python's patterns here: up to Java 18 letters with accents are parts of words to \\b."""
    return re.sub(r"\\(.)", lambda m: _ASCII_BOUNDARY if m[1] == "b" else m[0], pattern, flags=re.DOTALL)


def near_context(lines: DataFrame, hit: Column, context: Column, distance: int = 2) -> DataFrame:
    """Lines with a hit that have the context within ``distance`` lines in the same file."""
    window = Window.partitionBy("path").orderBy("line_no").rangeBetween(-distance, distance)
    return lines.withColumn("_near", F.max(context.cast("int")).over(window)).filter(hit & (F.col("_near") == 1)).drop("_near")


def first_match(lines: DataFrame, pattern: str, width: int = 160) -> DataFrame:
    """path, line_no, snippet of each file's first matching line."""
    hit = lines.filter(F.col("line").rlike(pattern)).groupBy("path").agg(F.min(F.struct("line_no", "line")).alias("m"))
    return hit.select("path", "m.line_no", F.substring("m.line", 1, width).alias("snippet"))


def search(lines: DataFrame, pattern: str, limit: int = 50) -> DataFrame:
    """The first ``limit`` matching lines by path and line."""
    return lines.filter(F.col("line").rlike(pattern)).orderBy("path", "line_no").limit(limit).select("path", "line_no")


def direction(outbound: Column, inbound: Column) -> Column:
    """The lattice of directions of a group."""
    return F.when(F.bool_or(outbound) & F.bool_or(inbound), "bidirectional").when(F.bool_or(outbound), "outbound").when(F.bool_or(inbound), "inbound").otherwise("unknown")


def running_total(rows: DataFrame, order: str, value: str, buckets: int = 64) -> DataFrame:
    """``rows`` with running, the sum of ``value`` up to each row in the order of ``order`` (unique). Rows are cut into
    ranges at keys of a sample; ranges are summed apart and their totals, one row each, are added."""
    sample = sorted(r[0] for r in rows.select(order).filter(F.col(order).isNotNull()).orderBy(F.xxhash64(order)).limit(buckets * 8).collect())
    cuts = sorted(set(sample[8::8]))
    bucket = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c <= F.col(order))) if cuts else F.lit(0)
    cut = rows.withColumn("_bucket", bucket)
    totals = cut.groupBy("_bucket").agg(F.sum(value).alias("_sum"))
    before = totals.select("_bucket", F.coalesce(F.sum("_sum").over(Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    inside = F.sum(value).over(Window.partitionBy("_bucket").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return cut.join(F.broadcast(before), "_bucket").withColumn("running", F.col("_before") + inside).drop("_bucket", "_before")


def json_bytes(path: Column, content: Column) -> Column:
    """Bytes of ``{"path":...,"content":...}`` in UTF-8. (A path holds nothing that JSON escapes.)"""
    return F.octet_length(F.to_json(F.struct(path.alias("path"), content.alias("content"))))


def halved(files: DataFrame, max_size: int) -> DataFrame:
    """folder, path, part, size: the files (folder, path, content), of which those whose JSON is larger than ``max_size`` are cut
    in halves by code points until each part fits; ``part`` spells the halves taken (0 or 1 each). What a single code point
    makes too large is left out. The longest text bounds the number of rounds, which only grows with its logarithm."""
    size = json_bytes(F.col("path"), F.col("content"))
    parts = files.withColumn("part", F.lit("")).withColumn("size", size)
    longest = parts.agg(F.max("size")).first()[0] or 0
    large = (F.col("size") > max_size) & (F.length("content") > 1)
    while longest > max_size:
        middle = F.ceil(F.length("content") / 2).cast("int")
        first = F.struct(F.concat("part", F.lit("0")).alias("part"), F.substring(F.col("content"), F.lit(1), middle).alias("content"))
        second = F.struct(F.concat("part", F.lit("1")).alias("part"), F.substring(F.col("content"), middle + 1, F.length("content")).alias("content"))
        cut = parts.select("folder", "path", F.explode(F.when(large, F.array(first, second)).otherwise(F.array(F.struct("part", "content")))).alias("x"))
        parts = cut.select("folder", "path", "x.part", "x.content").withColumn("size", size)
        longest = (longest + 1) // 2 + 64
        if longest <= max_size + 64 * 2:
            longest = parts.filter(large).agg(F.max("size")).first()[0] or 0
    return parts.filter(F.col("size") <= max_size).select("folder", "path", "part", "size")


def pack(files: DataFrame, key: str, max_size: int, max_files: int) -> DataFrame:
    """path, part, pack: next-fit packing of each key's files in order of path and part. A pack is closed by the first file
    that doesn't fit; so the law is sequential, and one key's sizes go through one task, in sorted batches (without contents)."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, number, used, count = object(), 0, 0, 0
        for b in batches:
            out = []
            for k, size in zip(b["k"], b["size"], strict=True):
                if k != now:
                    now, number, used, count = k, 0, 0, 0
                elif used + size > max_size or count >= max_files:
                    number, used, count = number + 1, 0, 0
                used, count = used + size, count + 1
                out.append(number)
            yield pd.DataFrame({"path": b["path"], "part": b["part"], "k": b["k"], "pack": pd.Series(out, dtype="int64")})

    slim = files.select("path", "part", F.col(key).alias("k"), "size").repartition("k").sortWithinPartitions("k", "path", "part")
    return slim.mapInPandas(run, "path string, part string, k string, pack long").withColumnRenamed("k", key)


def sessions(turns: DataFrame, found: Column, scope: Column) -> DataFrame:
    """conv_id, turns, findings of the conversations in ``scope``."""
    return turns.filter(scope).groupBy("conv_id").agg(F.count("*").alias("turns"), F.count_if(found).alias("findings"))


def top_folders(files: DataFrame, n: int = 3) -> DataFrame:
    """folder, files, bytes of the n folders (first segments below the root) with most files."""
    return files.select(F.split("path", "/")[1].alias("folder"), "size").groupBy("folder").agg(F.count("*").alias("files"), F.sum("size").alias("bytes")).orderBy(F.desc("files"), "folder").limit(n)


def best_vendor(hosts: DataFrame, known: list[str]) -> DataFrame:
    """The best vendor of each key: known .92, names of three letters or more .78, else .62; ties to the smaller name."""
    score = F.when(F.col("vendor").isin(known), 0.92).when(F.length("vendor") >= 3, 0.78).otherwise(0.62)
    return first_per_key(hosts.withColumn("score", score), ["key"], [F.desc("score"), F.col("vendor")])


#: What follows a text that was cut. A fixed value.
CUT = "\n...[truncated]"


def excerpts(files: DataFrame, key: str, most_files: int, width: int, budget: int) -> DataFrame:
    """key, path, excerpt: the first files of each key by path, at most ``most_files``, their contents cut to ``width`` characters and
    marked so, up to the first that passes the budget of all characters of the key (marks count)."""
    cut = F.when(F.length("content") > width, F.concat(F.substring("content", 1, width), F.lit(CUT))).otherwise(F.col("content"))
    order = Window.partitionBy(key).orderBy("path")
    rows = files.select(key, "path", F.substring("content", 1, width + 1).alias("content")).withColumn("at", F.row_number().over(order)).filter(F.col("at") <= most_files).withColumn("excerpt", cut)
    running = F.sum(F.length("excerpt")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("running", running).filter(F.col("running") <= budget).select(key, "path", "excerpt")
