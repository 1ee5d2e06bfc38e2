"""Byte-level BPE with a hierarchical-bitmap rank queue.

Candidate merges wait in one bucket per merge rank; a two-level bitmap of non-empty buckets gives the lowest rank by
find-first-set. Buckets hold positions of a linked list of parts. Entries whose pair has changed since are stale and are
skipped. A pre-token of n bytes takes O(n log n) steps at most, however long it is.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable
from heapq import heappop, heappush
from itertools import chain

import public_tokenizers
import regex
from pyspark.sql import DataFrame, SparkSession

from .common import map_rows

#: A word of the lower bitmap level has 2 ** SHIFT bits.
SHIFT = 8
MASK = (1 << SHIFT) - 1
#: Encoded pre-tokens in one of the two generations that a worker keeps, and the characters of those that it keeps at all.
CACHE, CACHED_CHARS = 400_000, 48
VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank of a vocabulary file: a base64 token and its rank in each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


def merge(piece: bytes, ranks: dict[bytes, int]) -> tuple[int, ...]:
    """Token ids of one pre-token: the lowest-ranked adjacent pair merges first, the leftmost of equals.

    ``buckets`` holds positions by rank (one number, or a heap of several), ``words`` a bit per non-empty bucket and
    ``top`` a bit per non-zero word.
    """
    if (whole := ranks.get(piece)) is not None:
        return (whole,)
    n, get = len(piece), ranks.get
    if n == 1:
        raise KeyError(piece)
    ends, before = list(range(1, n + 1)), list(range(-1, n - 1))  # ends[i]: where the part at i ends and the next begins
    alive = bytearray(b"\x01") * n
    top, words, buckets = 0, {}, {}
    fresh = [(r, i) for i in range(n - 1) if (r := get(piece[i : i + 2])) is not None]
    while True:
        for rank, i in fresh:
            if (bucket := buckets.get(rank)) is None:
                buckets[rank] = i
                word = rank >> SHIFT
                words[word] = words.get(word, 0) | 1 << (rank & MASK)
                top |= 1 << word
            elif type(bucket) is int:
                buckets[rank] = [bucket, i] if bucket <= i else [i, bucket]
            else:
                heappush(bucket, i)
        if not top:
            break
        word = (top & -top).bit_length() - 1  # find-first-set, twice
        bits = words[word]
        low = bits & -bits
        rank = (word << SHIFT) + low.bit_length() - 1
        bucket = buckets[rank]
        if type(bucket) is int:
            i, bucket = bucket, None
        else:
            i = heappop(bucket)
        if not bucket:
            del buckets[rank]
            words[word] = bits = bits ^ low
            if not bits:
                top ^= 1 << word
        fresh = []
        if not alive[i] or (j := ends[i]) >= n or get(piece[i : (k := ends[j])]) != rank:
            continue  # stale
        alive[j] = 0
        ends[i] = k
        if k < n:
            before[k] = i
            if (r := get(piece[i : ends[k]])) is not None:
                fresh.append((r, i))
        if (p := before[i]) >= 0 and (r := get(piece[p:k])) is not None:
            fresh.append((r, p))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : ends[i]]])
        i = ends[i]
    return tuple(out)


class _Known(dict):
    """Encoded pre-tokens; a missing one is taken from the older generation or encoded."""

    def __init__(self, ranks: dict[bytes, int], older: dict):
        super().__init__()
        self.ranks, self.older = ranks, older

    def __missing__(self, piece: str) -> tuple[int, ...]:
        ids = self.older[piece] if piece in self.older else merge(piece.encode(), self.ranks)
        if len(piece) <= CACHED_CHARS:
            self[piece] = ids
        return ids


class Codec:
    """Encoder and decoder for one vocabulary. Encoded pre-tokens are kept in two generations: a full younger one becomes
    the older one, so that frequent pre-tokens stay and memory is bounded."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, cache: int = CACHE):
        self.ranks, self.bytes_of, self.split, self.cache = ranks, {r: b for b, r in ranks.items()}, regex.compile(pattern).findall, cache
        self.known = _Known(ranks, {})

    def encode(self, text: str) -> list[int]:
        if len(self.known) >= self.cache:
            older = self.known
            older.older = {}
            self.known = _Known(self.ranks, older)
        return list(chain.from_iterable(map(self.known.__getitem__, self.split(text))))

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


def _codec_maker(spark: SparkSession, vocabulary: str, pattern: str):
    """A function that makes the codec in a task. The vocabulary has a fixed size (about 1 MB) and is broadcast."""
    ranks = spark.sparkContext.broadcast(load_ranks(vocabulary))
    return lambda: _codec(vocabulary, ranks, pattern)


#: The codec of this Python worker, which serves many tasks.
_CODECS: dict[tuple, Codec] = {}


def _codec(vocabulary: str, ranks, pattern: str) -> Codec:
    key = (vocabulary, pattern)
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = Codec(ranks.value, pattern)
    return _CODECS[key]


def encode_documents(docs: DataFrame, vocabulary: str | None = None, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """doc_id, ids (array of int), n_tokens for every row; a null text counts as empty and gives no ids. Rows are
    independent; other columns are not read."""
    make = _codec_maker(docs.sparkSession, vocabulary or public_tokenizers.path(VOCABULARY), pattern)

    def rows():
        codec = make()

        def one(doc_id, text):
            ids = codec.encode(text or "")
            return doc_id, ids, len(ids)

        return one

    return map_rows(docs.select("doc_id", "text"), rows, "doc_id long, ids array<int>, n_tokens long")


def decode_documents(encoded: DataFrame, vocabulary: str | None = None, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """doc_id and decoded (binary) of rows with doc_id and ids; null ids decode to nothing."""
    make = _codec_maker(encoded.sparkSession, vocabulary or public_tokenizers.path(VOCABULARY), pattern)

    def rows():
        codec = make()
        return lambda doc_id, ids: (doc_id, codec.decode(ids or ()))

    return map_rows(encoded.select("doc_id", "ids"), rows, "doc_id long, decoded binary")


def round_trip(docs: DataFrame, vocabulary: str | None = None, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: ids of every whole text and their decoding, as digests.

    A null text counts as empty, with no ids and the digests of nothing. Rows are independent: repeated rows give repeated
    results, a null doc_id stays null, an empty table gives none. Other columns are not read.
    """
    make = _codec_maker(docs.sparkSession, vocabulary or public_tokenizers.path(VOCABULARY), pattern)

    def rows():
        codec = make()
        names = {i: str(i) for i in codec.bytes_of}

        def one(doc_id, text):
            ids = codec.encode(text or "")
            listed = ",".join(map(names.__getitem__, ids))
            return doc_id, len(ids), hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(codec.decode(ids)).hexdigest()

        return one

    return map_rows(docs.select("doc_id", "text"), rows, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of ``documents`` encoded and decoded."""
    return round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet"))
