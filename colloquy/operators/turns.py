"""Operators on turn logs: canonical form, validation, screening, reports, rosters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from .features import in_order

REQUIRED = ["session_id", "student", "role", "turn", "content"]
CANONICAL = ["session_id", "student", "discipline", "phase", "turn", "role", "timestamp", "model", "content"]
ROLES = ["user", "assistant", "system"]
#: Names of roles, by role.
ALIASES = {
    "user": ["user", "human", "student", "you", "me", "prompt", "q"],
    "assistant": ["assistant", "ai", "bot", "model", "chatgpt", "claude", "gpt", "response", "a"],
    "system": ["system", "tool"],
}


def role_of(raw: Column) -> Column:
    """The role that a name stands for; an unknown name is an error."""
    key = F.lower(F.regexp_replace(text.strip(raw), "^:+|:+$", ""))
    found = F.lit(None).cast("string")
    for role, names in ALIASES.items():
        found = F.when(key.isin(names), role).otherwise(found)
    return F.when(found.isNull(), F.raise_error(F.concat(F.lit("unknown role: "), F.coalesce(raw, F.lit("null"))))).otherwise(found)


def canonical(turns: DataFrame, model: str | None = None) -> DataFrame:
    """The nine columns in order, absent ones null; `model` where a turn names none."""
    have = set(turns.columns)
    types = {"turn": "int"}
    cols = [F.col(c).cast(types.get(c, "string")).alias(c) if c in have else F.lit(None).cast(types.get(c, "string")).alias(c) for c in CANONICAL]
    out = turns.select(*cols)
    return out.withColumn("model", F.coalesce("model", F.lit(model))) if model else out


def validate(turns: DataFrame) -> DataFrame:
    """Problems of a log: session_id (null for the whole log), problem. No rows: it is usable."""
    spark = turns.sparkSession
    schema = "session_id string, problem string"
    missing = [c for c in REQUIRED if c not in turns.columns]
    if missing:
        return spark.createDataFrame([(None, f"missing column: {c}") for c in missing], schema)
    whole = turns.agg(
        F.array_sort(F.collect_set(F.when(~F.coalesce(F.col("role").isin(ROLES), F.lit(False)), F.coalesce("role", F.lit("null"))))).alias("roles"),
        F.count(F.when(F.col("content").isNull(), 1)).alias("empty"),
    )
    whole = whole.select(
        F.lit(None).cast("string").alias("session_id"),
        F.array_compact(F.array(
            F.when(F.size("roles") > 0, F.concat(F.lit("unexpected role values: "), F.array_join("roles", ", "))),
            F.when(F.col("empty") > 0, F.concat(F.col("empty").cast("string"), F.lit(" turns with null content"))),
        )).alias("p"),
    )
    each = turns.groupBy("session_id").agg(
        F.array_compact(F.array(
            F.when(F.count("*") != F.count_distinct("turn"), F.lit("duplicate turn indices")),
            F.when(F.count_distinct("student") > 1, F.lit("more than one student")),
            F.when(~F.coalesce(F.min_by("role", "turn").isin("user", "system"), F.lit(False)), F.lit("does not open with a student turn")),
            F.when(F.count_if(F.col("role") == "user") == 0, F.lit("no student turns")),
        )).alias("p"))
    found = whole.union(each.select(F.col("session_id").cast("string"), "p")).select("session_id", F.explode("p").alias("problem"))
    if "model" not in turns.columns:
        found = found.union(spark.createDataFrame([(None, "no model column")], schema))
    return found


def screen_pii(turns: DataFrame, key: str = "session_id") -> DataFrame:
    """Per session: hits of each kind of identifier and in all, the most first."""
    counts = text.pii_counts(F.col("content"), F.col("low"))
    rows = in_order(turns).withColumn("low", text.folded(F.col("content"))).select(key, "student", "turn", *(c.alias(k) for k, c in counts.items()))
    found = rows.groupBy(key).agg(F.min_by("student", "turn").alias("student"), *(F.sum(k).alias(k) for k in counts))
    return found.select(key, "student", sum(map(F.col, counts), F.lit(0)).alias("total_hits"), *counts).orderBy(F.desc("total_hits"), key)


def differences(parsed: DataFrame, shipped: DataFrame) -> DataFrame:
    """session_id, turn, problem: turns that one of two logs lacks, or whose role or content isn't the same."""
    keys = ["session_id", "turn"]
    a, b = (x.select(*keys, F.struct("role", "content").alias(name)) for x, name in ((parsed, "a"), (shipped, "b")))
    both = a.join(b, keys, "full")
    what = F.when(F.col("a").isNull(), "only in the second").when(F.col("b").isNull(), "only in the first").when(~F.col("a.role").eqNullSafe(F.col("b.role")), "another role").when(~F.col("a.content").eqNullSafe(F.col("b.content")), "another content")
    return both.select(*keys, what.alias("problem")).filter("problem IS NOT NULL")


def ingest_report(turns: DataFrame) -> DataFrame:
    """One row: counts of sessions, students, turns a session, roles, known models, empty content."""
    each = turns.groupBy("session_id").agg(F.count("*").alias("n"))
    sizes = each.agg(F.count("*").alias("sessions"), F.min("n").alias("min_turns"), F.median("n").alias("median_turns"), F.max("n").alias("max_turns"))
    model = F.col("model") if "model" in turns.columns else F.lit(None)
    rest = turns.agg(
        F.count("*").alias("turns"),
        F.count_distinct("student").alias("students"),
        *(F.count_if(F.col("role") == r).alias(f"{r}_turns") for r in ROLES),
        F.count(model).alias("model_known"),
        F.count_if(F.length(text.strip(text.text_of(F.col("content")))) == 0).alias("empty_content"),
    )
    ratio = F.col("user_turns") / F.when(F.col("assistant_turns") > 0, F.col("assistant_turns"))
    return sizes.crossJoin(rest).select("*", ratio.alias("user_assistant_ratio"), (~F.coalesce(ratio.between(0.5, 2.0), F.lit(False))).alias("ratio_flag"))  # one row by one row


def pseudonyms(turns: DataFrame, roster: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Turns with pseudonyms for students, and the crosswalk session_id, student, pseudonym.

    Without a roster each session is a student of its own. Codes are dense from 1 in the order
    of the names. Sessions that the roster lacks, or gives no student, are an error that names
    the first five.
    """
    who = turns.select("session_id").distinct()
    if roster is None:
        who = who.withColumn("student", F.col("session_id").cast("string"))
    else:
        who = who.join(roster.select("session_id", F.col("student").cast("string").alias("student")), "session_id", "left")
        if missing := [r.session_id for r in who.filter("student IS NULL").select("session_id").orderBy("session_id").limit(5).collect()]:
            raise ValueError(f"the roster has no student for sessions {missing}")
    codes = dense_codes(who.select("student").distinct(), "student")
    cross = who.join(codes, "student").select("session_id", "student", F.col("code").cast("int").alias("pseudonym"))
    out = turns.drop("student").join(cross.select("session_id", F.col("pseudonym").alias("student")), "session_id")
    return out, cross


def dense_codes(names: DataFrame, col: str, parts: int | None = None) -> DataFrame:
    """Different values with codes from 1 in their order.

    The values are dealt to ranges of about equal size, whatever they begin with; a value's code is
    its rank in its range after the sizes of the ranges before, of which there is a row each.
    """
    ranged = names.repartitionByRange(parts or names.sparkSession.sparkContext.defaultParallelism, col).sortWithinPartitions(col)
    ranged = ranged.select(col, F.monotonically_increasing_id().alias("__at"))  # the range above, the place in it below
    ranged = ranged.select(col, F.shiftright("__at", 33).alias("__part"), F.col("__at").bitwiseAND((1 << 33) - 1).alias("__place"))
    sizes = ranged.groupBy("__part").agg(F.count("*").alias("n"))
    before = sizes.withColumn("__before", F.sum("n").over(Window.orderBy("__part")) - F.col("n")).select("__part", "__before")
    return ranged.join(F.broadcast(before), "__part").select(col, (F.col("__place") + F.col("__before") + 1).cast("long").alias("code"))
