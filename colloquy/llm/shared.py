"""Helpers shared by the operators: table access, shared storage, labelled samples, words and their grams."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import unicodedata
import uuid
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _ranges(categories: str) -> str:
    """The characters whose category begins with one of these letters, as ranges of a character class."""
    there = [unicodedata.category(chr(k))[0] in categories for k in range(0x110000)]
    starts = [k for k in range(0x110000) if there[k] and not (k and there[k - 1])]
    ends = [k for k in range(0x110000) if there[k] and not (k + 1 < 0x110000 and there[k + 1])]
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in zip(starts, ends, strict=True))


@cache
def _words():
    return re.compile(f"[{_ranges('L')}][{_ranges('LM')}]*").findall


def words(text: str | None) -> list[str]:
    """The words of a text in lower case: a letter, then letters and combining marks."""
    return _words()((text or "").lower())


def word_lists(text: Column) -> Column:
    """array<string>: the words of a text."""

    @F.pandas_udf("array<string>")
    def found(texts: pd.Series) -> pd.Series:
        return pd.Series([words(t) for t in texts], dtype=object)

    return found(text)


class Spelled:
    """The characters of words between a start and an end mark: a hash, the word and the place in it."""

    def __init__(self, found: list[str]) -> None:
        sizes = np.fromiter(map(len, found), np.int64, len(found)) + 2
        codes = np.frombuffer("".join(f"\x02{w}\x03" for w in found).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
        self.word = np.repeat(np.arange(len(found), dtype=np.int32), sizes)
        self.place = (np.arange(len(codes)) - np.repeat(np.cumsum(sizes) - sizes, sizes)).astype(np.int32)
        codes = (codes + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
        codes = (codes ^ (codes >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
        self.codes = codes ^ (codes >> np.uint64(29))

    def grams(self, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For 1 to `most` characters: hashes of the grams of one fewer and of so many that end at each place."""
        now = np.zeros(len(self.codes), np.uint64)
        for _ in range(most):
            longer = self.codes.copy()
            longer[1:] += now[:-1] * np.uint64(0x9E3779B97F4A7C15)
            yield now, longer
            now = longer


def found_in(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The value of each wanted key among sorted ones, and whether it is there."""
    if not len(keys):
        return np.zeros((len(wanted), *values.shape[1:])), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return values[at], keys[at] == wanted


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share. Where the session names none, a session on one machine
    (tests) gets a temporary one; others raise an error, as executors couldn't see it."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='colloquy-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(found)
    return found


_STORED: list[str] = []
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, label: str) -> DataFrame:
    """Writes df as a table in the shared folder and reads it back, which cuts its lineage.

    The exchanges of the write go with it, as nothing reads them again. The table must stay until
    the results that read it are written; `forget` then removes it.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    _STORED.append(path)
    trim_driver(spark)
    return spark.read.schema(df.schema).parquet(path)


def trim_driver(spark: SparkSession) -> bool:
    """Gives native memory that the driver's JVM has freed back to the system; whether this JVM can.

    Each plan's code is compiled on the driver. What the compilers free stays with the C library,
    outside the heap, and adds up over plans.
    """
    jvm = spark._jvm
    try:
        # by reflection, as the server's own class isn't open to py4j
        invoke = next(m for m in jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethods() if m.getName() == "invoke")
        args = spark.sparkContext._gateway.new_array(jvm.java.lang.Object, 4)
        args[0], args[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        invoke.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), args)
    except Py4JJavaError:  # another JVM or C library
        return False
    return True


def stored_since(mark: int = 0) -> list[str]:
    """The paths of tables that this process stored and hasn't removed, from a number of them on."""
    return _STORED[mark:]


def forget(spark: SparkSession, paths: list[str] | None = None) -> int:
    """Removes stored tables, all of this process without `paths`; their number. For after the results are written."""
    paths = list(_STORED) if paths is None else paths
    for path in paths:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
        if path in _STORED:
            _STORED.remove(path)
    return len(paths)


#: Rows of texts that a worker gets at once; the session's own setting counts where it is another than Spark's.
TEXTS = 2000


def text_batches(spark: SparkSession) -> None:
    """Has workers get fewer rows at once than Spark's 10,000, as rows with whole texts are wide."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(TEXTS))


def let_go() -> None:
    """Gives memory that a task has freed back to the system, as a worker waits for the next task for long."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


_MADE: list[tuple] = []


def made_once(value, make):
    """make(value), once in a worker while tasks use the same broadcast value. The value is kept
    beside what was made of it, so that no other object can be taken for it; only the last is kept,
    as workers outlive the stages that they serve."""
    if not (_MADE and _MADE[0][0] is value and _MADE[0][1] is make):
        _MADE.clear()
        _MADE.append((value, make, make(value)))
    return _MADE[0][2]


#: Rows, of about a hundred bytes each at most, up to which a table is broadcast.
BROADCAST_ROWS = 500_000


def sized(df: DataFrame, rows: int | None = None) -> DataFrame:
    """To be broadcast if it has few rows. `rows` is its count; without it df is counted."""
    return F.broadcast(df) if (df.count() if rows is None else rows) <= BROADCAST_ROWS else df


def drop_made() -> None:
    """Forgets what `made_once` keeps, at the end of a task whose cache no other needs."""
    _MADE.clear()
    let_go()


def remainder(id_col: str, n: int) -> Column:
    """crc32 of the id as text, modulo n; null for a null id."""
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(n))


def bounded_sample(df: DataFrame, by: list[str], key: str, at_most: int) -> DataFrame:
    """At most `at_most` rows of each combination of `by`, those with the smallest hash of `key`.

    A threshold on the hash, from the counts of the classes, leaves about twice as many rows for
    the ranks, so no task gathers a class.
    """
    from pyspark.sql import Window

    h = F.xxhash64(F.lit("sample"), F.col(key))
    sizes = df.groupBy(*by).agg(F.count("*").alias("__n"))  # a row for each class
    few = df.join(F.broadcast(sizes), by).filter(F.pmod(h, F.lit(1 << 40)) * F.col("__n") <= 2 * at_most * float(1 << 40))
    order = Window.partitionBy(*by).orderBy(h, F.col(key))
    return few.withColumn("__rank", F.row_number().over(order)).filter(F.col("__rank") <= at_most).drop("__rank", "__n")


class Kept(dict):
    """Results by key; long keys aren't kept, and all go when there are too many."""

    def __init__(self, made_by, most: int) -> None:
        super().__init__()
        self.made_by, self.most = made_by, most

    def __missing__(self, key: str) -> bytes:
        value = self.made_by(key)
        if len(key) <= 40:
            if len(self) >= self.most:
                self.clear()
            self[key] = value
        return value
