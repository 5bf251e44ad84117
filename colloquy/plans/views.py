"""The driver's tables as turn logs and item matrices, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.features import DIMENSIONS, ITEMS

#: Phrases with markers, one of which is added to each turn, as the tables' words are invented.
PHRASES = [
    "Can you write a summary in under 200 words?", "That's wrong, the source contradicts my notes.", "Are you sure? Please verify that.", "First the outline, then the draft, and finally a check.",
    "I care about privacy and consent here.", "Why does that follow? Walk me through it.", "Just the first section for now.", "I disagree, and i still think my reading is better.",
    "According to the textbook, who is affected?", "I'll write that myself so that i can learn.", "Try again, but shorter instead.", "Our draft needs a citation; i'll rewrite it in my own words.",
    "Now check it and confirm the fix.", "Is this representative, or is it biased?", "On the other hand, my professor disagrees with that.", "good stuff and nice things in general",
    "Two things:\n1. outline\n- draft\nfor (2) see (a) there, and: 1) go (b) now f(1) x (3) y", "for (i=0;i<n;i++) {\n  a[i] = b[i];\n}\nCall 1 (555) 123-4567 or 555-123-4567 555-123-4567, 123-45-6789.",
    "Take this:\n```int x = 0;\ny();``` MRN: 99, born 03/14/1991, a.b@c.example", "x = foo(bar[1], baz[2]) * {qux} + (1 << 3); // so\n\nplain words",
]
#: Event types, a dimension each.
TYPES = ["click", "error", "purchase", "signup", "view"]
TURNS_SQL = f"""turns AS (
  SELECT CAST(conv_id AS VARCHAR) AS session_id, CAST(conv_id % 20 AS VARCHAR) AS student, CAST(conv_id % 3 AS VARCHAR) AS discipline,
         role, CAST(turn AS INTEGER) AS turn,
         coalesce(text, '') || chr(10) || list_extract([{", ".join("'" + p.replace("'", "''") + "'" for p in PHRASES)}], CAST((conv_id * 7 + turn * 3) % {len(PHRASES)} AS INTEGER) + 1) AS content
  FROM conversations
), live AS (SELECT * FROM turns WHERE role IS DISTINCT FROM 'system')"""


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    phrase = F.element_at(F.array(*map(F.lit, PHRASES)), (F.pmod(F.col("conv_id") * 7 + F.col("turn") * 3, F.lit(len(PHRASES))) + 1).cast("int"))
    return c.select(
        F.col("conv_id").cast("string").alias("session_id"), (F.col("conv_id") % 20).cast("string").alias("student"), (F.col("conv_id") % 3).cast("string").alias("discipline"),
        "role", F.col("turn").cast("int").alias("turn"), F.concat(F.coalesce("text", F.lit("")), F.lit("\n"), phrase).alias("content"),
    )


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users as students: an event type is a dimension, of a 6-day block its item."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").filter(F.col("value").isNotNull() & F.col("user_id").isNotNull() & F.col("event_type").isin(TYPES))
    day = F.floor(F.datediff(F.to_date("ts"), F.lit("1970-01-01").cast("date")) / 6)
    cell = F.concat(F.element_at(F.array(*map(F.lit, DIMENSIONS)), F.array_position(F.array(*map(F.lit, TYPES)), F.col("event_type")).cast("int")), F.lit("_i"), (F.pmod(day, F.lit(5)) + 1).cast("string"))
    cells = e.withColumn("cell", cell).groupBy("user_id").pivot("cell", ITEMS).agg(F.avg(F.pmod(F.floor(F.col("value")), F.lit(5)) + 1))
    score = lambda c: F.greatest(F.lit(1), F.least(F.lit(5), F.coalesce(F.floor(F.col(c) + 0.5), F.lit(3)))).cast("int").alias(c)
    return cells.select(F.col("user_id").cast("string").alias("student"), (F.col("user_id") % 3).cast("string").alias("discipline"), *(score(c) for c in ITEMS))


def _cell_sql() -> str:
    names = ", ".join(f"'{d}'" for d in DIMENSIONS)
    return f"list_extract([{names}], list_position([{', '.join(repr(t) for t in TYPES)}], event_type)) || '_i' || CAST(CAST(floor(date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) / 6) AS BIGINT) % 5 + 1 AS VARCHAR)"


ITEMS_SQL = f"""cells AS (
  SELECT user_id, {_cell_sql()} AS cell, avg(((CAST(floor(value) AS BIGINT) % 5) + 5) % 5 + 1) AS v
  FROM events WHERE value IS NOT NULL AND user_id IS NOT NULL AND event_type IN ({', '.join(repr(t) for t in TYPES)}) GROUP BY 1, 2
), items AS (
  SELECT CAST(user_id AS VARCHAR) AS student, CAST(user_id % 3 AS VARCHAR) AS discipline,
         {", ".join(f"CAST(greatest(1, least(5, coalesce(floor(max(v) FILTER (WHERE cell = '{i}') + 0.5), 3))) AS INTEGER) AS {i}" for i in ITEMS)}
  FROM cells GROUP BY user_id
)"""
