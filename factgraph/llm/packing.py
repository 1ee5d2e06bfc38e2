"""Best-fit packing of token sequences by linear grouping.

Lengths are at most the capacity, so a histogram of them (one count for each length) holds all that a packing depends on,
whatever the number of documents. On the histogram the driver makes a plan: large lengths, sorted, are cut into groups of equal
cardinality and rounded up to the longest of their group; for these few sizes a linear program over configurations (which
sizes share a sequence) is solved by column generation, and its whole parts are kept; actual lengths take the places of rounded
ones; what is left and all small lengths go, longest first, to the sequence with the least room that holds them. Equal
sequences of the plan are one row with a multiplicity, so the plan stays bounded too. On Spark every piece gets its rank
among the pieces of its length; rank and length give its place in the plan.
"""

from __future__ import annotations

import math
import os
import re
import struct
import unicodedata
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import slices, stage_table

CAPACITY = 2048
VOCABULARY = "word_bpe_49k.json"
#: The id that ends every document.
END = 0
#: Lengths above a share of the capacity are large; the plan of the share that needs the fewest sequences is taken.
LARGE_SHARES = (1 / 8, 1 / 4, 1 / 3, 1 / 2)
#: Groups of large lengths, so sizes of the linear program.
GROUPS = 64
#: Words that a worker keeps with their ids, and the characters of those that it keeps.
CACHE, CACHED_CHARS = 400_000, 48
#: Characters of a text that are split into words at a time, and bytes of ids in an output batch.
WINDOW, BATCH_BYTES = 1 << 20, 8 << 20


def _byte_letters() -> list[str]:
    """The character that stands for each byte in the vocabulary: itself if it's printable Latin-1, else the next of those from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(others)) for b in range(256)]


#: Letters, then ASCII signs but no apostrophe: the vocabulary's pattern always parts the two.
_PLAIN = re.compile(r"([^\W\d_]+)([!-&(-/:-@\[-`{-~]*)")


def encoder(path: str) -> Callable[[str], bytes]:
    """A function from a text to its ids, as little-endian unsigned 32-bit numbers. The vocabulary's pattern never matches white space, and
    its normal forms never join over a blank, so a text's ids are those of its blank-separated words in turn; words' ids are kept. What the library's
    normal forms and pattern would leave alone goes straight to its merges."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer, letters = Tokenizer.from_file(path), _byte_letters()
    model, cache, parts = tokenizer.model, {"": b""}, {"": b""}

    def pack(ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}I", *ids)

    def whole(word: str) -> bytes:
        return pack(tokenizer.encode(word, add_special_tokens=False).ids)

    def part(run: str, alpha: bool) -> bytes:
        if (ids := parts.get(run)) is None:
            if not alpha or run.isascii():
                ids = pack([t.id for t in model.tokenize(run)])
            elif run == run.lower() and unicodedata.is_normalized("NFC", run):
                ids = pack([t.id for t in model.tokenize("".join([letters[b] for b in run.encode()]))])
            else:
                ids = whole(run)
            if len(run) <= CACHED_CHARS:
                parts[run] = ids
        return ids

    def encode(text: str) -> bytes:
        out, at = [], 0
        if "<|" not in text:  # no special token: A-Z may be lowered at once
            text = text.encode().lower().decode()
        while at < len(text):
            end = text.find(" ", at + WINDOW)
            end = len(text) if end < 0 else end
            words = text[at:end].replace("\n", " ").split(" ")
            fresh = [w for w in set(words) if w not in cache]
            for w in fresh:
                plain = _PLAIN.fullmatch(w) if w.islower() else None
                cache[w] = part(plain[1], True) + part(plain[2], False) if plain and plain[1].isalpha() else whole(w)
            out.append(b"".join([cache[w] for w in words]))
            for w in fresh:
                if len(w) > CACHED_CHARS:
                    del cache[w]
            if len(cache) > CACHE:
                cache.clear()
                cache[""] = b""
            if len(parts) > CACHE:
                parts.clear()
                parts[""] = b""
            at = end
        return b"".join(out)

    return encode


def token_pieces(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids (binary, little-endian unsigned 32-bit), ids_crc32 and, for ranks, the task's number ``part`` and the
    piece's number ``nth`` among those of its length there. A document's ids are its text's and END; longer ones than
    ``capacity`` are cut. A null text is empty, so its only id is END. Repeated rows are rows of their own. The result must be written before
    it is read twice, since ``part`` and ``nth`` depend on how the table is read."""
    path = vocabulary or public_tokenizers.path(VOCABULARY)
    doc_id = docs.schema["doc_id"].dataType
    schema = T.StructType().add("doc_id", doc_id).add("piece", "integer").add("start", "long").add("length", "long").add("ids", "binary").add("ids_crc32", "long").add("part", "integer").add("nth", "long")
    width = 4 * capacity
    end = np.array([END], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, seen = encoder(path), TaskContext.get().partitionId(), [0] * (capacity + 1)
        kind, rows, held = None, [], 0

        def batch() -> pa.RecordBatch:
            cols = list(zip(*rows, strict=True))
            types = (kind, pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int32(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=schema.names)

        for b in slices(batches):
            kind = b.schema.field(0).type
            for doc, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                ids = encode(text.as_py() or "") + end
                for piece, at in enumerate(range(0, len(ids), width)):
                    own = ids[at : at + width]
                    n = len(own) // 4
                    rows.append((doc, piece, at // 4, n, own, zlib.crc32(own), part, seen[n]))
                    seen[n] += 1
                    held += len(own)
                    if held > BATCH_BYTES or len(rows) >= 4096:
                        yield batch()
                        rows, held = [], 0
        if rows:
            yield batch()

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def _best_configuration(sizes: np.ndarray, worth: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The most valuable multiset of sizes that fits, by dynamic programming over how many it has and their sum."""
    room = np.arange(capacity + 1)
    rest = room[None, :] - sizes[:, None]
    fits = rest >= 0
    value, picks = np.zeros(capacity + 1), []
    for _ in range(capacity // int(sizes.min())):
        offer = np.where(fits, value[np.maximum(rest, 0)] + worth[:, None], -np.inf)
        pick = offer.argmax(axis=0)
        best = offer[pick, room]
        better = best > value + 1e-12
        if not better.any():
            break
        picks.append(np.where(better, pick, -1))
        value = np.where(better, best, value)
    counts, at = np.zeros(len(sizes), np.int64), capacity
    for pick in reversed(picks):
        if (i := int(pick[at])) >= 0:
            counts[i] += 1
            at -= int(sizes[i])
    return float(value[capacity]), counts


def configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int, rounds: int = 2000) -> tuple[np.ndarray, np.ndarray]:
    """(configurations as columns, how often each is used, as fractions): a least number of sequences that hold ``demand`` items of each of the distinct
    ``sizes``. A revised simplex method; each step lets in the configuration that pays most at the present prices."""
    basis = np.diag(capacity // sizes).astype(float)
    for _ in range(rounds):
        inverse = np.linalg.inv(basis)
        use, price = inverse @ demand, inverse.sum(axis=0)
        value, column = _best_configuration(sizes, price, capacity)
        if value <= 1 + 1e-9:
            break
        step = inverse @ column
        leaves = np.where(step > 1e-9, use / np.where(step > 1e-9, step, 1), np.inf)
        basis[:, int(np.argmin(leaves))] = column
    return basis.round().astype(np.int64), np.maximum(np.linalg.solve(basis, demand), 0)


@dataclass
class Kind:
    """Equal sequences: how many, and how many pieces of which length each holds."""

    times: int
    holds: dict[int, int]

    def with_more(self, times: int, length: int, n: int) -> Kind:
        return Kind(times, {**self.holds, length: self.holds.get(length, 0) + n})


def group_lengths(counts: np.ndarray, above: int, groups: int) -> list[tuple[int, list[list[int]]]]:
    """(rounded size, runs of [length, number], longest first) of ``groups`` groups of equal cardinality of the lengths greater than ``above``. Groups of one rounded size are joined."""
    lengths = [n for n in range(len(counts) - 1, above, -1) if counts[n]]
    each = max(1, math.ceil(sum(int(counts[n]) for n in lengths) / groups))
    out: list[tuple[int, list[list[int]]]] = []
    room = 0
    for length in lengths:
        left = int(counts[length])
        while left:
            if not room:
                if not out or out[-1][0] != length:
                    out.append((length, []))
                room = each
            take = min(left, room)
            out[-1][1].append([length, take])
            left, room = left - take, room - take
    return out


def _substitute(times: int, slots: list[int], runs: list[list[list[int]]]) -> Iterator[Kind]:
    """``times`` sequences of one configuration with actual lengths: each slot takes the next ``times`` of its group."""
    taken = []
    for g in slots:
        own, need = [], times
        while need:
            length, n = runs[g][0]
            take = min(n, need)
            own.append([length, take])
            need -= take
            runs[g][0][1] -= take
            if not runs[g][0][1]:
                runs[g].pop(0)
        taken.append(own)
    while taken[0]:
        n = min(own[0][1] for own in taken)
        holds: dict[int, int] = {}
        for own in taken:
            holds[own[0][0]] = holds.get(own[0][0], 0) + 1
            own[0][1] -= n
            if not own[0][1]:
                own.pop(0)
        yield Kind(n, holds)


def best_fit(kinds: list[Kind], counts: dict[int, int], capacity: int) -> list[Kind]:
    """``kinds`` with ``counts`` pieces of each length added, longest first, each to the sequence with the least room that holds it. Equal sequences are
    filled together: the tightest stays the tightest while it has room for one more."""
    rooms: list[list[Kind]] = [[] for _ in range(capacity + 1)]

    def put(kind: Kind, room: int) -> None:
        if kind.times:
            rooms[room].append(kind)

    for k in kinds:
        put(k, capacity - sum(length * n for length, n in k.holds.items()))
    for length in sorted(counts, reverse=True):
        left, room = counts[length], length
        while left:
            while room <= capacity and not rooms[room]:
                room += 1
            fresh = room > capacity
            kind = Kind(left, {}) if fresh else rooms[room].pop()
            space = capacity if fresh else room
            each = space // length
            full = min(kind.times, left // each)
            put(kind.with_more(full, length, each), space - each * length)
            left -= full * each
            rest = kind.times - full
            if rest and left and left < each:
                put(kind.with_more(1, length, left), space - left * length)
                left, rest = 0, rest - 1
            if not fresh:
                put(Kind(rest, kind.holds), space)
    return [k for own in rooms for k in own]


def plan_packing(counts: np.ndarray, capacity: int = CAPACITY, groups: int = GROUPS, large_shares: tuple[float, ...] = LARGE_SHARES) -> list[Kind]:
    """Sequences of at most ``capacity`` for ``counts[n]`` pieces of each length n (from 1). More large lengths mean that the program decides
    more, but rounding leaves more room than small ones may fill, so every share is tried."""
    plans = [_plan(counts, capacity, groups, int(capacity * s)) for s in large_shares]
    return min(plans, key=lambda kinds: sum(k.times for k in kinds))


def _plan(counts: np.ndarray, capacity: int, groups: int, above: int) -> list[Kind]:
    grouped = group_lengths(counts, above, groups)
    kinds: list[Kind] = []
    runs = [r for _, r in grouped]
    if grouped:
        sizes = np.array([s for s, _ in grouped], np.int64)
        demand = np.array([sum(n for _, n in r) for r in runs], np.int64)
        columns, use = configurations(sizes, demand.astype(float), capacity)
        left = demand.copy()
        for j in np.argsort(-use, kind="stable"):
            own = columns[:, j]
            times = min([math.floor(use[j] + 1e-6), *(left[own > 0] // own[own > 0])])
            if times > 0:
                left -= times * own
                kinds += _substitute(int(times), [g for g, n in enumerate(own) for _ in range(n)], runs)
    rest: dict[int, int] = {n: int(counts[n]) for n in range(1, min(above, capacity) + 1) if counts[n]}
    for r in runs:
        for length, n in r:
            rest[length] = rest.get(length, 0) + n
    return best_fit(kinds, rest, capacity)


@dataclass
class Places:
    """Where the pieces of a length go, by their rank: sorted keys (length, first rank), and for each a sequence, how many go to one sequence, an offset."""

    keys: np.ndarray
    copies: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray

    @staticmethod
    def of(kinds: list[Kind]) -> Places:
        rows, rank, base = [], {}, 0
        for k in kinds:
            offset = 0
            for length, n in k.holds.items():
                first = rank.get(length, 0)
                rows.append((length << _RANK_BITS | first, n, base, offset))
                rank[length] = first + n * k.times
                offset += n * length
            base += k.times
        return Places(*np.array(sorted(rows), np.int64).reshape(-1, 4).T)

    def find(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = (length << _RANK_BITS) | rank
        at = np.searchsorted(self.keys, key, side="right") - 1
        turn, nth = np.divmod(key - self.keys[at], self.copies[at])
        return self.sequence[at] + turn, self.offset[at] + nth * length


#: Ranks are below two to this power.
_RANK_BITS = 48


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str | None = None, groups: int = GROUPS) -> DataFrame:
    """doc_id, piece, start, length, ids, ids_crc32, sequence_id, offset for every piece of ``docs`` (doc_id, text; other columns are not read):
    see token_pieces, plan_packing. Pieces of a sequence follow each other from offset 0 without a gap. Which of several pieces of one length takes which
    of their places follows the order in which the table was read. An empty table gives an empty result."""
    spark = docs.sparkSession
    pieces = stage_table(token_pieces(docs, capacity, vocabulary), "packing-pieces")
    counts = pieces.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = stage_table(counts.select("length", "part", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first")), "packing-starts")
    histogram = np.zeros(capacity + 1, np.int64)
    for length, n in starts.groupBy("length").agg(F.sum("n")).collect():  # at most `capacity` rows
        histogram[length] = n
    places = spark.sparkContext.broadcast(Places.of(plan_packing(histogram, capacity, groups)))  # bounded by the lengths and groups
    ranked = pieces.join(starts.drop("n"), ["part", "length"]).withColumn("rank", F.col("first") + F.col("nth"))
    kept = ["doc_id", "piece", "start", "length", "ids", "ids_crc32"]

    @F.pandas_udf("struct<sequence_id: long, offset: long>")
    def place(length, rank):
        import pandas as pd

        sequence, offset = places.value.find(length.to_numpy(), rank.to_numpy())
        return pd.DataFrame({"sequence_id": sequence, "offset": offset})

    return ranked.withColumn("place", place("length", "rank")).select(*kept, "place.sequence_id", "place.offset")


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, n_tokens, ids (binary) of every sequence: its pieces' ids by offset. A sequence is bounded by the capacity."""
    pieces = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    ids = F.aggregate(pieces, F.unhex(F.lit("")), lambda a, x: F.concat(a, x["ids"]))
    return packed.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), ids.alias("ids"))


def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` in sequences of at most 2048 tokens."""
    packed = pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
