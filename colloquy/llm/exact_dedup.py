"""Exact deduplication by a Grace hash.

Texts are equal when identical after each run of ASCII white space became one space. The
records (digest, text, smallest id, count) are first collapsed where they are read, so that a
hot text leaves a map task about once; then an exchange deals them out by digest, and each
task partitions what it gets recursively to spill files until a bucket fits an open-addressing
table, which compares complete texts.

Defined results: a null text counts as empty; a null id never becomes keep_id unless the whole
group has null ids; rows that repeat an id and its text all count in group_size and all carry
kept = true; an empty table gives an empty result. Columns other than id and text are ignored,
whatever their names.
"""

from __future__ import annotations

import os
import pickle
import shutil
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import table

_SCHEMA = "digest binary, content binary, keep_id long, group_size long"
_ARROW = pa.schema([("digest", pa.binary()), ("content", pa.binary()), ("keep_id", pa.int64()), ("group_size", pa.int64())])
#: A record: digest, content, smallest id or None, count.
Record = tuple[bytes, bytes, int | None, int]


class OpenTable:
    """Open addressing with linear probing over (digest, content)."""

    def __init__(self) -> None:
        self.slots = [-1] * 1024
        self.entries: list[list] = []
        self.bytes = 0

    def _slot(self, digest: bytes, content: bytes) -> int:
        mask = len(self.slots) - 1
        at = int.from_bytes(digest[-8:], "little") & mask
        while (k := self.slots[at]) >= 0:
            entry = self.entries[k]
            if entry[0] == digest and entry[1] == content:
                return at
            at = (at + 1) & mask
        return at

    def add(self, record: Record) -> None:
        digest, content, keep, n = record
        at = self._slot(digest, content)
        if self.slots[at] >= 0:
            entry = self.entries[self.slots[at]]
            entry[3] += n
            if keep is not None and (entry[2] is None or keep < entry[2]):
                entry[2] = keep
            return
        self.slots[at] = len(self.entries)
        self.entries.append([digest, content, keep, n])
        self.bytes += len(content) + 200
        if 2 * len(self.entries) > len(self.slots):
            self.slots = [-1] * (2 * len(self.slots))
            mask = len(self.slots) - 1
            for k, entry in enumerate(self.entries):
                at = int.from_bytes(entry[0][-8:], "little") & mask
                while self.slots[at] >= 0:
                    at = (at + 1) & mask
                self.slots[at] = k


def grace(records: Iterator[Record], budget: int, fan_out: int = 16, depth: int = 0, folder: str | None = None) -> Iterator[list]:
    """The groups of the records, with at most about `budget` bytes of content in memory.

    Records go to one table until it outgrows the budget; from then on, its entries and the
    rest go to `fan_out` spill files by the next bits of the digest, and each file is treated
    the same way. Equal contents collapse in the table, so a bucket that can't be split any
    further (depth 14 of a 256-bit digest) holds a single text.
    """
    held = OpenTable()
    for record in records:
        held.add(record)
        if held.bytes > budget and depth < 14 and len(held.entries) > 1:
            break
    else:
        yield from held.entries
        return
    top = tempfile.mkdtemp(prefix="grace-", dir=folder)
    try:
        paths = [os.path.join(top, f"{k}") for k in range(fan_out)]
        files = [open(p, "wb", buffering=1 << 16) for p in paths]  # noqa: SIM115
        try:
            put = lambda r: pickle.dump(tuple(r), files[r[0][depth] % fan_out], protocol=5)
            for entry in held.entries:
                put(entry)
            del held
            for record in records:
                put(record)
        finally:
            for f in files:
                f.close()
        for p in paths:
            yield from grace(_unspilled(p), budget, fan_out, depth + 1, top)
            os.unlink(p)
    finally:
        shutil.rmtree(top, ignore_errors=True)


def _unspilled(path: str) -> Iterator[Record]:
    with open(path, "rb") as f:
        while True:
            try:
                yield pickle.load(f)
            except EOFError:
                return


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[Record]:
    for b in batches:
        yield from zip(*(b.column(k).to_pylist() for k in range(4)), strict=True)


def _batches(entries: Iterator[list], with_content: bool, most: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    rows, size = [], 0
    for e in entries:
        rows.append(e)
        size += len(e[1]) + 100
        if size > most:
            yield _batch(rows, with_content)
            rows, size = [], 0
    if rows:
        yield _batch(rows, with_content)


def _batch(rows: list[list], with_content: bool) -> pa.RecordBatch:
    cols = [[r[0] for r in rows], [r[1] if with_content else None for r in rows], [r[2] for r in rows], [r[3] for r in rows]]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _ARROW, strict=True)], schema=_ARROW)


def collapse(batches: Iterator[pa.RecordBatch], budget: int = 32 << 20) -> Iterator[pa.RecordBatch]:
    """Collapses equal contents as far as the budget reaches, before the exchange."""
    held = OpenTable()
    for record in _records(batches):
        held.add(record)
        if held.bytes > budget:
            yield from _batches(iter(held.entries), True)
            held = OpenTable()
    yield from _batches(iter(held.entries), True)


def text_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", budget_mb: int = 128) -> DataFrame:
    """One row per different text: digest, keep_id, group_size."""
    records = _normalised(docs, id_col, text_col).select("digest", F.col("content").cast("binary").alias("content"), F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"))
    dealt = records.mapInArrow(collapse, _SCHEMA).repartition(F.xxhash64("digest"))
    budget = budget_mb << 20

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batches(grace(_records(batches), budget), False)

    return dealt.mapInArrow(groups, _SCHEMA).select("digest", "keep_id", "group_size")


def _normalised(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    content = F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), r"[\x20\x09-\x0D]+", " ")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), content.alias("content")).withColumn("digest", F.unhex(F.sha2("content", 256)))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", budget_mb: int = 128) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256."""
    groups = text_groups(docs, id_col, text_col, budget_mb).filter("group_size > 1")
    rows = _normalised(docs, id_col, text_col).select("doc_id", "digest")
    return rows.join(groups, "digest", "left").select(
        "doc_id",
        F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        F.coalesce(F.col("doc_id").eqNullSafe(F.col("keep_id")) | F.col("group_size").isNull(), F.lit(True)).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


OP7_SQL = r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS x FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept, sha256(x) AS text_sha256
FROM t WINDOW w AS (PARTITION BY x)
"""
