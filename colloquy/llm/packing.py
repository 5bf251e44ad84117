"""Best-fit packing of documents into sequences by exact-complement hashing.

A document's tokens, with an end token, are cut into pieces only if they are longer than a
sequence. The lengths of all pieces form a histogram, whose size is bounded by the sequence
length whatever the number of documents; the plan is made on it. A sequence begins with the
longest piece left; single, pair and triple length sums are indexed, and a combination that
exactly fills the gap is consumed as often as the counts allow; where there is none, the best
fitting piece goes in and the new gap is looked up. Pieces then get their places by their rank
among those of equal length, in parallel.

Defined results: a null text counts as empty and has the end token alone; repeated rows are
packed each; an empty table gives an empty result; columns other than id and text are ignored.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Iterator
from unicodedata import is_normalized

import numpy as np
import pandas as pd
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .shared import Kept, drop_made, made_once, stored, table, text_batches

#: Pieces of one length that are ranked together, about; a common length has as many parts as it takes.
TOGETHER = 1_000


class WordIds:
    """Ids by the tokenizer's model, kept by pre-token; where a text needs more than plain lower
    case and the pattern below, or the tokenizer has another pattern, by the whole tokenizer."""

    #: Fixed value: the pattern of the tokenizer file's pre-tokeniser.
    PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

    def __init__(self, tokenizer_json: str, most: int = 300_000) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        self.tokenizer.encode_special_tokens = True
        self.by_word = self.PATTERN in tokenizer_json.replace("\\\\", "\\")
        self.kept = Kept(self._encoded, most)

    def __call__(self, text: str) -> bytes:
        """The ids of text as little-endian unsigned 32-bit integers."""
        if not (self.by_word and _PLAIN(text) and is_normalized("NFC", text)):
            return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        words = _SPLIT_PLAIN(text.lower())
        return b"".join(map(self.kept.__getitem__, words))

    def _encoded(self, word: str) -> bytes:
        """Of a pre-token; byte-level, so the model gets a character for each of its bytes."""
        found = self.tokenizer.model.tokenize(word.encode().decode("latin-1").translate(_BYTE_CHARS))
        return array("I", [t.id for t in found]).tobytes()


def _byte_chars() -> dict[int, int]:
    """Characters that stand for bytes: printable ones for themselves, the others from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    return {b: b for b in shown} | {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in shown)}


_BYTE_CHARS = _byte_chars()
#: Texts whose lower case depends on no rule of the tokenizer's own.
_PLAIN = re.compile("[\x00-\u012f]*").fullmatch
#: The pattern of WordIds for these, with their letters, numbers and white space spelled out.
_LETTERS, _NUMBERS, _WHITE = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u02c1", "0-9\xb2\xb3\xb9\xbc-\xbe", "\t-\r \x85\xa0"
_SPLIT_PLAIN = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_NUMBERS}]|[^{_WHITE}{_LETTERS}{_NUMBERS}]+").findall


def pieces(docs: DataFrame, tokenizer_json: str, length: int = 4096, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32."""
    text_batches(docs.sparkSession)
    shipped = docs.sparkSession.sparkContext.broadcast(tokenizer_json)
    end = array("I", [end_id]).tobytes()

    @F.pandas_udf("array<struct<piece:int,start:long,length:long,ids_crc32:long>>")
    def cut(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        ids_of = made_once(shipped.value, WordIds)
        for texts in batches:
            yield pd.Series([pieces_of((ids_of(t) if t else b"") + end) for t in texts], dtype=object)
        drop_made()

    def pieces_of(ids: bytes) -> list[dict]:
        step = 4 * length
        return [{"piece": k, "start": k * length, "length": min(step, len(ids) - k * step) // 4, "ids_crc32": zlib.crc32(ids[k * step : (k + 1) * step])} for k in range(-(-len(ids) // step))]

    return docs.select(F.col(id_col).alias("doc_id"), F.explode(cut(F.col(text_col))).alias("p")).select("doc_id", "p.*")


class Gaps:
    """The lengths still available, with an index of the pairs by their sum."""

    def __init__(self, counts: np.ndarray) -> None:
        self.counts = counts
        self.full = len(counts) - 1
        self.there = counts > 0
        self.pairs = np.zeros(2 * len(counts), np.int64)  # different lengths, or one length twice
        for a in np.flatnonzero(self.there):
            self._pairs_with(int(a), 1, self.there[: a + 1])

    def _pairs_with(self, a: int, by: int, others: np.ndarray) -> None:
        at = np.flatnonzero(others)
        self.pairs[a + at] += by

    def take(self, length: int, n: int) -> None:
        self.counts[length] -= n
        if n and not self.counts[length]:
            self._pairs_with(length, -1, self.there)
            self.there[length] = False

    def largest(self) -> int:
        at = np.flatnonzero(self.there)
        return int(at[-1]) if len(at) else 0

    def enough(self, used: dict[int, int]) -> bool:
        return all(self.counts[x] >= n for x, n in used.items())

    def exact(self, gap: int, used: dict[int, int]) -> list[int] | None:
        """One, two or three lengths that sum to gap, the longest first, besides those used."""
        if gap <= self.full and self.there[gap] and self.enough(_plus(used, [gap])):
            return [gap]
        if gap < len(self.pairs) and self.pairs[gap]:
            for pair in self._pairs(gap):
                if self.enough(_plus(used, pair)):
                    return pair
        low = max(1, gap - 2 * self.full)
        thirds = np.flatnonzero(self.there[low : max(low, min(gap, self.full + 1))])[::-1] + low
        for c in thirds[self.pairs[gap - thirds] > 0]:
            for pair in self._pairs(gap - int(c)):
                if self.enough(_plus(used, [int(c), *pair])):
                    return [int(c), *pair]
        return None

    def _pairs(self, total: int) -> Iterator[list[int]]:
        low, high = max(1, total - self.full), total // 2
        if high >= low:
            a = np.arange(low, high + 1)
            for x in a[self.there[a] & self.there[total - a]]:
                yield [int(total - x), int(x)]

    def best(self, gap: int, used: dict[int, int]) -> int:
        """The longest that fits, besides those used; 0 if none."""
        at = np.flatnonzero(self.there[: min(gap, self.full) + 1])[::-1]
        return next((int(x) for x in at if self.counts[x] > used.get(int(x), 0)), 0)


def _plus(used: dict[int, int], more: list[int]) -> dict[int, int]:
    out = dict(used)
    for x in more:
        out[x] = out.get(x, 0) + 1
    return out


def plan(counts: np.ndarray) -> list[tuple[int, dict[int, int]]]:
    """How often which lengths share a sequence; counts[x] pieces have x tokens, the last the most.

    Each entry uses up the pieces of one length at least, so there are at most as many entries
    as different lengths.
    """
    left = Gaps(counts.astype(np.int64).copy())
    out = []
    while top := left.largest():
        used, gap = {top: 1}, left.full - top
        while gap:
            if fit := left.exact(gap, used):
                used, gap = _plus(used, fit), 0
            elif fit := left.best(gap, used):
                used, gap = _plus(used, [fit]), gap - fit
            else:
                break
        times = min(int(left.counts[x]) // n for x, n in used.items())
        for x, n in used.items():
            left.take(x, times * n)
        out.append((times, used))
    return out


def _ranges(entries: list[tuple[int, dict[int, int]]]) -> list[np.ndarray]:
    """By length and rank, sorted: the key, the first sequence, pieces a sequence, the offset."""
    rows, rank, sequence = [], {}, 0
    for times, used in entries:
        offset = 0
        for x, n in sorted(used.items(), reverse=True):
            rows.append((x << 44 | rank.get(x, 0), sequence, n, offset))
            rank[x] = rank.get(x, 0) + times * n
            offset += x * n
        sequence += times
    return list(np.array(sorted(rows), np.int64).reshape(-1, 4).T)


def pack(found: DataFrame, length: int = 4096) -> DataFrame:
    """The pieces with sequence_id and offset. `found` must give the same rows each time it is read."""
    spark = found.sparkSession
    counts = np.zeros(length + 1, np.int64)
    for row in found.groupBy("length").agg(F.count("*").alias("n")).collect():
        counts[row.length] = row.n  # at most `length` rows
    parts = F.get(F.lit((-(-counts // TOGETHER)).tolist()).cast("array<long>"), F.col("length").cast("int"))
    found = found.withColumn("__part", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), parts))
    by_part = found.groupBy("length", "__part").agg(F.count("*").alias("n"))
    shipped = spark.sparkContext.broadcast(_ranges(plan(counts)))
    before = by_part.withColumn("__before", F.sum("n").over(Window.partitionBy("length").orderBy("__part")) - F.col("n")).drop("n")
    within = Window.partitionBy("length", "__part").orderBy("doc_id", "piece", "ids_crc32")
    ranked = found.withColumn("__rank", F.row_number().over(within) - 1).join(before, ["length", "__part"])

    @F.pandas_udf("sequence_id long, offset long")
    def place(lengths: pd.Series, ranks: pd.Series) -> pd.DataFrame:
        keys, sequences, n, offsets = shipped.value
        key = lengths.to_numpy(np.int64) << 44 | ranks.to_numpy(np.int64)
        at = np.searchsorted(keys, key, side="right") - 1
        turn = key - keys[at]
        return pd.DataFrame({"sequence_id": sequences[at] + turn // n[at], "offset": offsets[at] + turn % n[at] * lengths.to_numpy(np.int64)})

    placed = ranked.withColumn("__at", place("length", (F.col("__rank") + F.col("__before")).cast("long")))
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", "__at.sequence_id", "__at.offset")


def pack_documents(docs: DataFrame, tokenizer_path: str | None = None, length: int = 4096, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    with open(tokenizer_path or public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        found = pieces(docs, f.read(), length, end_id, id_col, text_col)
    return pack(stored(found, "pieces"), length)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
