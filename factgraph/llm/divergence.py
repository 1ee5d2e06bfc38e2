"""Source divergence audit: how the term shares of each source differ from those of the other sources of its language.

Terms are counted by language and source where they are read. Of the terms that enough documents of a language hold, each chunk keeps
a sorted array; searchsorted turns terms into ids, bincount turns the counts of each source into a dense vector over the
chunk. Ids keep the terms' UTF-8 order, so sources are compared vector by vector and ties fall to the lesser id.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import hot_join, stage_table

MIN_DOCUMENTS = 30
SMOOTHING = 5
#: Shares are whole billionths.
SCALE = 10**9
TOP = 50
#: Numbers in the vectors of a chunk, on average: its terms times the sources of its language.
CELLS = 1 << 16
#: Different (group, term) that a task counts before it hands them on, and bytes of a text that it splits at a time.
HELD, WINDOW = 400_000, 1 << 22

#: Bytes outside terms become blanks, A-Z become a-z. Bytes above 127 are part of terms, as all other code points are.
_BYTES = bytes(b if b > 127 or chr(b).islower() else b + 32 if chr(b).isupper() else 32 for b in range(256))


def terms_of(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a UTF-8 text in lists: maximal runs of A-Z, a-z and code points above 127, only A-Z lowered."""
    at = 0
    while at < len(text):
        clean = text[at : at + WINDOW].translate(_BYTES)
        if at + WINDOW < len(text) and clean.rfind(b" ") < 0:
            return (yield text[at:].translate(_BYTES).split())  # a run longer than a window: no more windows
        end = len(clean) if at + WINDOW >= len(text) else clean.rfind(b" ") + 1
        yield clean[:end].split()
        at += end


def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, n, docs): a task's counts of occurrences and of documents, handed on whenever HELD are held."""
    occurrences: dict[tuple, Counter] = {}
    documents: dict[tuple, Counter] = {}
    held = 0

    def handed() -> Iterator[pa.RecordBatch]:
        for group, counts in occurrences.items():
            terms, n, docs = list(counts), list(counts.values()), documents[group]
            for at in range(0, len(terms), 1 << 16):
                own = terms[at : at + (1 << 16)]
                names = [pa.DictionaryArray.from_arrays(pa.array([0] * len(own), pa.int32()), pa.array([x])).cast(pa.string()) for x in group]
                yield pa.RecordBatch.from_arrays([*names, pa.array(own, pa.binary()).cast(pa.string()), pa.array(n[at : at + (1 << 16)], pa.int64()), pa.array([docs[t] for t in own], pa.int64())], names=["lang", "source", "term", "n", "docs"])
        occurrences.clear()
        documents.clear()

    for b in batches:
        for lang, source, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).cast(pa.binary()), strict=True):
            seen: set[bytes] = set()
            held += (lang, source) not in occurrences  # a group without terms counts too
            total = occurrences.setdefault((lang, source), Counter())
            held -= len(total)
            for terms in terms_of(text.as_py()):
                total.update(terms)
                seen.update(terms)
            documents.setdefault((lang, source), Counter()).update(seen)
            held += len(total)
            if held > HELD:
                yield from handed()
                held = 0
    yield from handed()


def shares(counts: np.ndarray, total: np.ndarray, kept: int) -> np.ndarray:
    """1 + floor(SCALE * (count + SMOOTHING) / (total + SMOOTHING * kept)), exact for totals below 2 ** 53: the quotient is built in three steps
    of 1000, so that no product passes 2 ** 63."""
    below = total + SMOOTHING * kept
    rest, quotient = counts + SMOOTHING, np.zeros_like(counts)
    for _ in range(3):
        more, rest = np.divmod(rest * 1000, below)
        quotient = quotient * 1000 + more
    return quotient + 1


def compare_chunk(terms: np.ndarray, vectors: np.ndarray, totals: np.ndarray, kept: int, top: int = TOP) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """(sources x sources, sums of differences; for each source the ids and values of its ``top`` terms over the language's share) of one chunk."""
    own = shares(vectors, totals[:, None], kept)
    whole = shares(vectors.sum(axis=0), totals.sum(), kept)
    sums = np.zeros((len(own), len(own)), np.int64)
    for i in range(len(own) - 1):
        sums[i, i + 1 :] = np.abs(own[i + 1 :] - own[i]).sum(axis=1)
    best = []
    for counts, p in zip(vectors, own, strict=True):
        ids = np.flatnonzero((counts > 0) & (p > whole))
        value = (p - whole)[ids]
        first = np.lexsort((ids, -value))[:top]
        best.append((ids[first], value[first]))
    return sums, best


def _compare(top: int):
    def run(_key, rows: pa.Table, info: pa.Table) -> pa.Table:
        lang, sources = info["lang"][0].as_py(), info["sources"][0].as_py()
        totals, kept = np.array(info["totals"][0].as_py(), np.int64), info["kept"][0].as_py()
        written = np.array(rows["term"].cast(pa.binary()).to_pylist(), object)
        terms = np.array(sorted(set(written)), object)
        width = len(terms)
        names = np.array([s.encode() for s in sources], object)
        place = np.searchsorted(names, np.array(rows["source"].cast(pa.binary()).to_pylist(), object)) * width + np.searchsorted(terms, written)
        vectors = np.bincount(place.astype(np.int64), weights=rows["n"].to_numpy().astype(float), minlength=len(sources) * width) if width else np.zeros(0)
        sums, best = compare_chunk(terms, vectors.astype(np.int64).reshape(len(sources), width), totals, kept, top)  # counts below 2 ** 53 are exact
        out = [(sources[i], "pair", sources[j], int(sums[i, j])) for i in range(len(sources)) for j in range(i + 1, len(sources))]
        out += [(s, "term", terms[i].decode(), int(v)) for s, (ids, values) in zip(sources, best, strict=True) for i, v in zip(ids, values, strict=True)]
        cols = list(zip(*out, strict=True)) or [(), (), (), ()]
        return pa.table({"lang": pa.array([lang] * len(out), pa.string()), "source": pa.array(cols[0], pa.string()), "part": pa.array(cols[1], pa.string()), "item": pa.array(cols[2], pa.string()), "value": pa.array(cols[3], pa.int64())})

    return run


def source_divergence(docs: DataFrame, min_documents: int = MIN_DOCUMENTS, top: int = TOP, cells: int = CELLS) -> DataFrame:
    """lang, source, part, item, value, rank for every (lang, source) of ``docs`` (text, lang, source; other columns are not read).

    Null text, lang and source count as empty. A language keeps the terms that at least ``min_documents`` of its rows hold;
    repeated rows are rows of their own. Part ``pair`` has a row for each other source of the language with the sum of differences of all kept terms' shares (0 without kept
    terms); part ``term`` the ``top`` terms by how far the source's share exceeds the language's. Equal values are ranked by
    the item's UTF-8 bytes. A source alone in its language has no pairs. An empty table gives an empty result. Counts of up to 2 ** 53 are exact.
    """
    spark = docs.sparkSession
    plain = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    counted = plain.mapInArrow(_count_terms, "lang string, source string, term string, n long, docs long")
    by_term = counted.repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    same = Window.partitionBy("lang", "term")
    wide = by_term.withColumn("docs", F.sum("docs").over(same)).withColumn("first", F.row_number().over(same.orderBy("source")) == 1)
    kept = stage_table(wide.filter(F.col("docs") >= min_documents).drop("docs"), "divergence-kept")

    totals = plain.groupBy("lang", "source").agg(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("kept"))
    totals = totals.unionByName(kept.groupBy("lang", "source").agg(F.sum("n").alias("n"), F.count_if("first").alias("kept")))
    totals = totals.groupBy("lang", "source").agg(F.sum("n").alias("n"), F.sum("kept").alias("kept"))
    # one row for each language; its arrays are as long as the rows that each of its sources has in the result
    held = F.sort_array(F.collect_list(F.struct("source", "n")))
    info = totals.groupBy("lang").agg(held.alias("held"), F.sum("kept").alias("kept"))
    parts = F.greatest(F.lit(1), F.ceil(F.col("kept") * F.size("held") / cells)).cast("int")
    info = stage_table(info.select("lang", F.col("held.source").alias("sources"), F.col("held.n").alias("totals"), "kept", parts.alias("parts")), "divergence-info")

    rows = hot_join(kept.drop("first"), info.select("lang", "parts"), "lang", "term")
    rows = rows.select("lang", "source", "term", "n", F.pmod(F.xxhash64("term"), "parts").cast("int").alias("chunk"))
    chunks = info.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    key = ["lang", "chunk"]
    found = rows.groupBy(key).cogroup(chunks.groupBy(key)).applyInArrow(_compare(top), "lang string, source string, part string, item string, value long")
    found = stage_table(found, "divergence-found")

    pairs = found.filter("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    both = F.explode(F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item"))))
    pairs = pairs.select("lang", both.alias("x"), "value").select("lang", "x.source", F.lit("pair").alias("part"), "x.item", "value")
    ranked = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    out = pairs.unionByName(found.filter("part = 'term'").select(pairs.columns)).withColumn("rank", F.row_number().over(ranked))
    return out.filter((F.col("part") == "pair") | (F.col("rank") <= top))


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the sources of ``documents`` differ in their languages."""
    return source_divergence(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP13_SQL = r"""
WITH docs AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
words AS (SELECT r, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs),
kept AS (SELECT lang, term FROM words GROUP BY lang, term HAVING count(DISTINCT r) >= 30),
grps AS (SELECT DISTINCT lang, source FROM docs),
size_of AS (SELECT g.lang, count(k.term) AS v FROM (SELECT DISTINCT lang FROM grps) g LEFT JOIN kept k USING (lang) GROUP BY g.lang),
seen AS (SELECT lang, source, term, count(*) AS n FROM words JOIN kept USING (lang, term) GROUP BY lang, source, term),
totals AS (SELECT g.lang, g.source, coalesce(sum(s.n), 0) AS total FROM grps g LEFT JOIN seen s USING (lang, source) GROUP BY g.lang, g.source),
cells AS (SELECT t.lang, t.source, k.term, coalesce(s.n, 0) AS n,
    (1 + (1000000000::HUGEINT * (coalesce(s.n, 0) + 5)) // (t.total + 5 * z.v))::BIGINT AS p
  FROM totals t JOIN kept k USING (lang) JOIN size_of z USING (lang) LEFT JOIN seen s ON s.lang = t.lang AND s.source = t.source AND s.term = k.term),
whole AS (SELECT c.lang, c.term, (1 + (1000000000::HUGEINT * (sum(c.n) + 5)) // (any_value(x.total) + 5 * any_value(x.v)))::BIGINT AS q
  FROM cells c JOIN (SELECT lang, sum(total) AS total, any_value(v) AS v FROM totals JOIN size_of USING (lang) GROUP BY lang) x USING (lang) GROUP BY c.lang, c.term),
sums AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM cells a JOIN cells b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source),
parts AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0)::BIGINT AS value
  FROM grps a JOIN grps b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL
  SELECT c.lang, c.source, 'term', c.term, (c.p - w.q)::BIGINT FROM cells c JOIN whole w USING (lang, term) WHERE c.n > 0 AND c.p > w.q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM parts)
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 50
"""
