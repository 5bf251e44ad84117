"""Readers of transcripts into the canonical turns.

Each is one scan with an explicit schema; nothing is inferred and nothing is read on the driver.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text
from ..operators.turns import REQUIRED, canonical, role_of

TURN_SCHEMA = "session_id string, student string, role string, turn int, content string, discipline string, phase string, timestamp string, model string, rubric_version string, provenance string"
#: The speaker labels that a transcript is cut at.
SPEAKERS = "user|human|student|you|me|prompt|assistant|ai|bot|model|chatgpt|claude|gpt|response|system"
LABEL = rf"(?imdU)^\s*(?:\[|\*\*|##\s*)?\s*({SPEAKERS})\s*(?:\]|\*\*)?\s*:"
_MARK = "\x01\x02"


def _fail(condition: Column, message: Column, value: Column) -> Column:
    return F.when(condition, F.raise_error(message).cast("string")).otherwise(value)


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, number (from 1), value of every line.

    A file's blocks are counted first; a line's number is its place in its block after the
    sizes of the blocks before, of which there is a row each.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value", F.monotonically_increasing_id().alias("at"))
    blocks = lines.groupBy("file", "block").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = blocks.select("file", "block", "first", before.alias("before"))
    return lines.join(blocks, ["file", "block"]).select("file", (F.col("at") - F.col("first") + F.col("before") + 1).alias("number"), "value")


def read_jsonl(spark: SparkSession, path: str, model: str | None = None, numbers: bool = True) -> DataFrame:
    """Turns, a JSON object a line. Blank lines are skipped; a line that isn't an object, or lacks
    one of the required keys (null is a value), is an error that names the file and the line; no
    line at all is one too. Without `numbers`, which cost a pass of their own, the line is quoted."""
    lines = numbered_lines(spark, path) if numbers else spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"))
    lines = require_rows(lines.filter(F.length(text.strip(F.col("value"))) > 0), path)
    keys = F.json_object_keys("value")
    missing = F.array_except(F.array(*map(F.lit, REQUIRED)), F.coalesce(keys, F.array().cast("array<string>")))
    where = F.concat("file", F.lit(":"), F.col("number").cast("string") if numbers else F.substring("value", 1, 200))
    checked = _fail(keys.isNull(), F.concat(where, F.lit(": not a JSON object")), _fail(F.size(missing) > 0, F.concat(where, F.lit(": missing "), F.array_join(missing, ", ")), F.col("value")))
    found = lines.select(F.from_json(checked, TURN_SCHEMA).alias("t")).select("t.*")
    return found.withColumn("model", F.coalesce("model", F.lit(model))) if model else found


def require_rows(df: DataFrame, path: str) -> DataFrame:
    """The frame itself, or an error if it has no row."""
    if df.isEmpty():
        raise ValueError(f"{path}: no records")
    return df


_MESSAGE = "struct<author:struct<role:string>,create_time:double,content:struct<parts:array<string>>,metadata:struct<model_slug:string>>"
_NODE_EXPORT = f"conversation_id string, id string, title string, mapping map<string,struct<message:{_MESSAGE}>>"
_FLAT_EXPORT = "uuid string, name string, chat_messages array<struct<text:string,content:array<struct<text:string>>,sender:string,role:string,created_at:string>>"


def _documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Conversations of files that hold a list of them, or one."""
    whole = spark.read.text(path, wholetext=True)
    is_list = F.substring(F.ltrim(text.strip(F.col("value"))), 1, 1) == "["
    many = F.from_json("value", f"array<struct<{', '.join(c.replace(' ', ':', 1) for c in _split_fields(schema))}>>")
    one = F.array(F.from_json("value", schema))
    return whole.select(F.explode(F.when(is_list, many).otherwise(one)).alias("c")).select("c.*")


def _split_fields(schema: str) -> list[str]:
    out, depth, start = [], 0, 0
    for k, ch in enumerate(schema):
        depth += (ch == "<") - (ch == ">")
        if ch == "," and depth == 0:
            out.append(schema[start:k].strip())
            start = k + 1
    return [*out, schema[start:].strip()]


def _truthy(*cols: str) -> Column:
    """The first that is neither null nor empty; the text None where there is none."""
    return F.coalesce(*(F.when(F.length(c) > 0, F.col(c)) for c in cols), F.lit("None"))


def read_node_export(spark: SparkSession, path: str, model: str | None = None) -> DataFrame:
    """Exports with a map of message nodes; turns are dense after a stable sort by time."""
    conv = _documents(spark, path, _NODE_EXPORT).select(_truthy("conversation_id", "id", "title").alias("session_id"), "mapping").withColumn("conv", F.monotonically_increasing_id())
    nodes = conv.select("conv", "session_id", F.posexplode(F.map_entries("mapping")).alias("pos", "node")).select("conv", "session_id", "pos", F.col("node.value.message").alias("m")).filter("m IS NOT NULL")
    # parts that aren't text are JSON objects once read as strings
    parts = F.filter(F.coalesce("m.content.parts", F.array().cast("array<string>")), lambda p: p.isNotNull() & ~p.rlike(r"^\s*[{\[]\s*\""))
    rows = nodes.withColumn("content", text.strip(F.array_join(parts, "\n"))).filter(F.length("content") > 0).withColumn("at", F.coalesce("m.create_time", F.lit(0.0)))
    turn = F.row_number().over(Window.partitionBy("conv").orderBy("at", "pos")) - 1
    return canonical(rows.select("session_id", turn.alias("turn"), role_of(F.col("m.author.role")).alias("role"), F.col("at").cast("string").alias("timestamp"), F.col("m.metadata.model_slug").alias("model"), "content"), model)


def read_flat_export(spark: SparkSession, path: str, model: str | None = None) -> DataFrame:
    """Exports with a list of messages; turns are positions there, so empty messages leave gaps."""
    conv = _documents(spark, path, _FLAT_EXPORT).select(_truthy("uuid", "name").alias("session_id"), F.posexplode("chat_messages").alias("turn", "m"))
    joined = text.strip(F.array_join(F.transform("m.content", lambda c: F.coalesce(c["text"], F.lit(""))), "\n"))
    content = F.when(F.length("m.text") > 0, F.col("m.text")).otherwise(F.coalesce(joined, F.lit("")))
    sender = F.when(F.length("m.sender") > 0, F.col("m.sender")).otherwise(F.col("m.role"))
    rows = conv.withColumn("content", content).filter(F.length("content") > 0)
    return canonical(rows.select("session_id", "turn", role_of(sender).alias("role"), F.col("m.created_at").alias("timestamp"), "content"), model)


def split_transcript(raw: Column) -> Column:
    """array<struct<turn, role, content>>: labels in order; bodies that are empty leave gaps."""
    marked = F.split(F.regexp_replace(raw, LABEL, f"{_MARK}$1{_MARK}"), _MARK, -1)
    pairs = F.floor((F.size(marked) - 1) / 2).cast("int")
    turns = F.transform(F.sequence(F.lit(1), F.greatest(pairs, F.lit(1))), lambda k: F.struct((k - 1).alias("turn"), F.get(marked, 2 * k - 1).alias("role"), text.strip(F.get(marked, 2 * k)).alias("content")))
    return F.filter(F.when(pairs > 0, turns).otherwise(F.filter(turns, lambda t: F.lit(False))), lambda t: F.length(t["content"]) > 0)


def _transcripts(spark: SparkSession, path: str) -> DataFrame:
    """file stem and text; bytes that aren't UTF-8 become replacement characters."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    stem = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]*$", "")
    return files.select(stem.alias("stem"), F.regexp_replace(F.make_valid_utf8(F.col("content").cast("string")), "\r\n?", "\n").alias("raw"))


def read_transcripts(spark: SparkSession, path: str, model: str | None = None, session_id: str | None = None, student_from_name: bool = False) -> DataFrame:
    """Text files with speaker labels, one session each; what precedes the first label is dropped."""
    found = _transcripts(spark, path).select("stem", F.explode(split_transcript(F.col("raw"))).alias("t"))
    student = F.nullif(F.regexp_extract("stem", r"^(\d+)", 1), F.lit("")).cast("long").cast("string") if student_from_name else F.lit(None).cast("string")
    return canonical(found.select((F.lit(session_id) if session_id else F.col("stem")).alias("session_id"), student.alias("student"), F.col("t.turn").alias("turn"), role_of(F.col("t.role")).alias("role"), F.col("t.content").alias("content")), model)


def read_directory(spark: SparkSession, path: str, pattern: str = "*.txt", model: str | None = None) -> DataFrame:
    """Every transcript of a folder; leading digits of a name are the student. None is an error."""
    try:
        return read_transcripts(spark, f"{path}/{pattern}", model, student_from_name=True)
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            raise FileNotFoundError(f"{path}/{pattern}") from e
        raise


def read_csv(spark: SparkSession, path: str, model: str | None = None, **columns: str) -> DataFrame:
    """A CSV file with a header; columns: target=source. Without `turn`, rows count up in file order."""
    df = spark.read.csv(path, header=True, multiLine=True, escape='"')
    for target, source in columns.items():
        df = df.withColumnRenamed(source, target)
    df = df.withColumn("role", role_of(F.col("role")))
    if "turn" not in df.columns:
        df = df.withColumn("__row", F.monotonically_increasing_id())
        df = df.withColumn("turn", F.row_number().over(Window.partitionBy("session_id").orderBy("__row")) - 1)
    return canonical(df, model)


def read_item_scores(spark: SparkSession, path: str) -> DataFrame:
    """Human scores: student, 25 items; NA is null."""
    from ..operators.features import ITEMS

    df = spark.read.csv(path, header=True, nullValue="NA")
    return df.select(*(F.col(c).cast("int").alias(c) if c in ITEMS else F.col(c) for c in df.columns))


def read_cutpoints(path: str) -> dict[str, dict]:
    """Cutpoints as `writers.write_json` puts them: item, then feature, direction, cuts and band."""
    with open(path, encoding="utf-8") as f:
        return json.load(f)


def read_roster(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True).select("session_id", "student")


#: Names of the readers.
READERS = {"jsonl": read_jsonl, "openai": read_node_export, "anthropic": read_flat_export, "text": read_transcripts, "csv": read_csv, "dir": read_directory}


def read(spark: SparkSession, kind: str, path: str, model: str | None = None, **options) -> DataFrame:
    if kind not in READERS:
        raise ValueError(f"unknown source {kind!r}; there are {sorted(READERS)}")
    return READERS[kind](spark, path, model=model, **options)

