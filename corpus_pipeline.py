"""A corpus pipeline: five stages over documents, each written as Parquet and read by the next.

Toxic documents go, then texts without a language, then lines that are near copies of earlier
ones, then all but one document of each group of near copies; what is left is packed into
sequences. The first four return the columns of documents, whatever others there are beside them.

What holds for every stage: a null text has no words, lines or tokens, so it isn't toxic, goes as
text without a language, and is packed as an end token alone; rows that repeat id and text are
judged alike, and a near copy with its own id goes while both rows of the one that stays do; an
empty table gives an empty result; names that begin with `__` are the stages' own.

Each stage reads what the one before has written, so it begins by removing the tables that the
one before had stored on its way, and by giving back memory that the driver no longer needs.
"""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.llm import langid, line_dedup, packing, simhash, toxicity
from colloquy.llm.shared import forget, shared_dir, stored_since, table, trim_driver

#: A text is kept if words of its main language, likely ones in its scripts, have this share of its letters at least.
LANGUAGE_SHARE = 0.3


_LEFT: list[str] = []


def stage(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """A stage that removes first what the stage before it left in the shared folder."""

    @functools.wraps(f)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        forget(spark, list(_LEFT))
        trim_driver(spark)
        mark = len(stored_since())
        out = f(spark, docs, sf_dir)
        _LEFT[:] = stored_since(mark)
        return out

    return run_stage


@stage
def _toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that score 0.5 or more."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return docs.withColumn("__toxic", toxicity.toxicity(spark, F.col("text"), model)).filter("__toxic < 0.5").drop("__toxic")


@stage
def _language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts without letters and those of which no language has a fair share."""
    model = langid.train(docs)
    found = docs.withColumn("__lang", langid.language(spark, F.col("text"), model, own=True))
    return found.filter((F.col("__lang.lang_pred") != "und") & (F.col("__lang.score") >= LANGUAGE_SHARE)).drop("__lang")


@stage
def _lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops near copies of earlier lines; a document that has no line left goes; n_chars is counted anew."""
    found = line_dedup.dedup_lines(docs, short=True)
    found = found.filter((F.col("__line_dropped") == 0) | (F.length(F.trim("text")) > 0)).drop("__line_dropped")
    return found.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else found


@stage
def _near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group, by fingerprints and the pigeonring first, then by prefixes for what these can't find."""
    return simhash.without_near_duplicates(docs)


@stage
def _packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece, with its sequence and place there."""
    return packing.pack_documents(docs)


STAGES = [("toxicity", _toxicity), ("language", _language), ("line_dedup", _lines), ("near_copies", _near_copies), ("packing", _packing)]

#: No stage but the last two steps of line dedup can be said in SQL; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, apply) in enumerate(STAGES):
        docs = apply(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            path = f"{shared_dir(spark)}/pipeline-{k}-{name}-{uuid.uuid4().hex}"
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
