"""Byte-level BPE encoding and decoding with a two-tier lookup.

A pre-token that is in the vocabulary is resolved by a minimal perfect hash; any other is merged
with a heap over linked bytes, lowest rank first and leftmost among equals. The hash is built
once on the driver and broadcast with the vocabulary, whose size doesn't depend on the data.

Defined results: a null text counts as empty, which has no ids; repeated rows are encoded each;
an empty table gives an empty result; columns other than id and text are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
from array import array
from heapq import heapify, heappop, heappush
from itertools import islice

import numpy as np
import pandas as pd
import public_tokenizers
import regex
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import Kept, made_once, table


#: Where white space other than one space between two other characters touches a space.
_LOOSE = re.compile(r"^ |\s \s*| \s| $")
_AT = (1 << 40) - 1
_PRIME, _LOW = (1 << 61) - 1, (1 << 64) - 1


class PerfectHash:
    """A minimal perfect hash of byte strings by displacement: n keys fill n slots.

    Buckets are placed from the largest to the smallest; one of several keys gets the first
    displacement at which all its keys fall on free slots, one of a single key the free slot
    itself, stored as a negative number.
    """

    def __init__(self, keys: list[bytes]) -> None:
        n = self.n = len(keys)
        self.buckets = max(1, n // 3)
        shift = array("q", [0]) * self.buckets
        self.slots = array("i", [-1]) * n
        members: dict[int, list[tuple[int, int, int]]] = {}
        for k, key in enumerate(keys):
            bucket, a, b = self._hashes(key)
            members.setdefault(bucket, []).append((k, a, b))
        taken = bytearray(n)
        free = 0
        for bucket, found in sorted(members.items(), key=lambda x: -len(x[1])):
            if len(found) == 1:
                while taken[free]:
                    free += 1
                at, d = [free], -free - 1
            else:
                d = 0
                while len(set(at := [(a + d * b) % _PRIME % n for _, a, b in found])) < len(at) or any(taken[x] for x in at):
                    d += 1
                    if d > 1 << 24:
                        raise ValueError("two keys have equal hashes")
            shift[bucket] = d
            for (k, _, _), x in zip(found, at, strict=True):
                taken[x], self.slots[x] = 1, k
        self.shift = shift

    def _hashes(self, key: bytes) -> tuple[int, int, int]:
        h = xxhash.xxh3_128_intdigest(key)
        return h % self.buckets, h >> 64, h & _LOW

    def index(self, key: bytes) -> int:
        """The index of key if it is one of the keys; of some other key if not."""
        bucket, a, b = self._hashes(key)
        d = self.shift[bucket]
        return self.slots[-d - 1 if d < 0 else (a + d * b) % _PRIME % self.n]


class Vocabulary:
    """Tokens with ranks, and the pattern that splits text into pre-tokens."""

    def __init__(self, tokens: dict[bytes, int], pattern: str) -> None:
        self.pattern = pattern
        self.keys = list(tokens)
        self.ids = [tokens[k] for k in self.keys]
        self.hash = PerfectHash(self.keys)

    @classmethod
    def read(cls, path: str, pattern: str = public_tokenizers.PATTERN) -> Vocabulary:
        with open(path, "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in (x.split() for x in f if x.strip())}, pattern)


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of piece: pairs are joined by rank, from a heap; neighbours are linked by position.

    An entry of the heap is a rank and, in its low bits, where the pair begins; it is stale if
    the pair that begins there now has another rank.
    """
    n = len(piece)
    get = ranks.get
    after = list(range(1, n + 2))  # where the part that begins here ends; 0 once it is joined
    before = list(range(-1, n))  # where the part before begins
    heap = [rank << 40 | at for at in range(n - 1) if (rank := get(piece[at : at + 2])) is not None]
    heapify(heap)
    while heap:
        entry = heappop(heap)
        at = entry & _AT
        middle = after[at]
        if not middle or middle >= n:
            continue
        end = after[middle]
        if get(piece[at:end]) != entry >> 40:
            continue
        after[at], after[middle] = end, 0
        if end < n:
            before[end] = at
            if (rank := get(piece[at : after[end]])) is not None:
                heappush(heap, rank << 40 | at)
        left = before[at]
        if left >= 0 and (rank := get(piece[left:end])) is not None:
            heappush(heap, rank << 40 | left)
    out, at = [], 0
    while at < n:
        end = after[at]
        out.append(ranks[piece[at:end]])
        at = end
    return out


class Codec:
    """Encodes and decodes; it keeps what it has resolved, up to a number of pre-tokens and words.

    A single space between two characters that aren't white space always begins a pre-token, so
    texts without longer runs of white space at their spaces are cut there and the words between
    resolved one by one.
    """

    def __init__(self, vocabulary: Vocabulary, most: int = 250_000) -> None:
        self.keys, self.ids, self.hash = vocabulary.keys, vocabulary.ids, vocabulary.hash
        self.ranks = dict(zip(self.keys, self.ids, strict=True))
        self.pattern = regex.compile(vocabulary.pattern)
        self.by_word = vocabulary.pattern == public_tokenizers.PATTERN
        self.pretokens, self.words = Kept(self._pretoken, most), Kept(self._word, 2 * most)
        by_id = sorted(zip(self.ids, self.keys, strict=True))
        size = by_id[-1][0] + 1 if by_id else 0
        self.lengths = np.zeros(size, np.int64)
        for k, token in by_id:
            self.lengths[k] = len(token)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(x for _, x in by_id), np.uint8)

    def _pretoken(self, pretoken: str) -> bytes:
        piece = pretoken.encode()
        k = self.hash.index(piece)
        ids = [self.ids[k]] if self.keys[k] == piece else merge(piece, self.ranks)
        return array("I", ids).tobytes()

    def _word(self, word: str) -> bytes:
        return b"".join(map(self.pretokens.__getitem__, self.pattern.findall(" " + word)))

    def encode(self, text: str) -> bytes:
        """The ids of text as little-endian unsigned 32-bit integers."""
        if self.by_word and not _LOOSE.search(text):
            first, *words = text.split(" ")
            return self._long(first) + b"".join(map(self.words.__getitem__, words))
        return self._long(text)

    def _long(self, text: str) -> bytes:
        if len(text) < 1 << 22:
            return b"".join(map(self.pretokens.__getitem__, self.pattern.findall(text)))
        found = (m[0] for m in self.pattern.finditer(text))
        parts = []
        while part := list(islice(found, 1 << 18)):
            parts.append(b"".join(map(self.pretokens.__getitem__, part)))
        return b"".join(parts)

    def decode(self, ids: bytes) -> bytes:
        found = np.frombuffer(ids, "<u4")
        return b"".join(self._decoded(found[k : k + (1 << 20)]) for k in range(0, len(found), 1 << 20))

    def _decoded(self, ids: np.ndarray) -> bytes:
        lengths = self.lengths[ids]
        ends = np.cumsum(lengths)
        at = np.repeat(self.starts[ids] - ends + lengths, lengths)
        at += np.arange(len(at))
        return self.bytes[at].tobytes()


class _Shipped:
    """A vocabulary that is broadcast once and becomes a codec once in each worker."""

    def __init__(self, spark: SparkSession, vocabulary: Vocabulary) -> None:
        self.value = spark.sparkContext.broadcast(vocabulary)

    def __call__(self) -> Codec:
        return made_once(self.value.value, Codec)


def encode(spark: SparkSession, text: Column, vocabulary: Vocabulary) -> Column:
    """The ids of text as array<int>; null for a null text."""
    codec = _Shipped(spark, vocabulary)

    @F.pandas_udf("array<int>")
    def ids(texts: pd.Series) -> pd.Series:
        c = codec()
        return pd.Series([None if t is None else np.frombuffer(c.encode(t), "<i4") for t in texts], dtype=object)

    return ids(text)


def decode(spark: SparkSession, ids: Column, vocabulary: Vocabulary) -> Column:
    """The bytes that ids stand for; null for null."""
    codec = _Shipped(spark, vocabulary)

    @F.pandas_udf("binary")
    def text(lists: pd.Series) -> pd.Series:
        c = codec()
        return pd.Series([None if x is None else c.decode(np.asarray(x, "<u4").tobytes()) for x in lists], dtype=object)

    return text(ids)


def round_trip(docs: DataFrame, vocabulary: Vocabulary, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: doc_id, n_tokens, ids_sha256 and decoded_sha256, the ids decoded again."""
    codec = _Shipped(docs.sparkSession, vocabulary)

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def digests(texts: pd.Series) -> pd.DataFrame:
        c, rows = codec(), []
        for t in texts:
            ids = c.encode(t or "")
            rows.append((len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(c.decode(ids)).hexdigest()))
        return pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    found = docs.select(F.col(id_col).alias("doc_id"), digests(F.col(text_col)).alias("d"))
    return found.select("doc_id", "d.n_tokens", "d.ids_sha256", "d.decoded_sha256")


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = Vocabulary.read(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return round_trip(table(spark, sf_dir, "documents"), vocabulary)
