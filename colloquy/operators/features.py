"""Session and student features of a turn log.

One exchange by session serves the windows and the session's aggregate; another, of sessions,
serves the students. Each family is counted once a turn.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicon, text

DIMENSION_FEATURES = {
    "PromptEngineering": ["constraint_marker_density", "context_ratio", "refinement_ratio", "specificity_index", "framing_clarity"],
    "ProblemDecomposition": ["subtask_count", "sequence_marker_density", "scope_qualifier_density", "limitation_reference_count", "allocation_marker_count"],
    "OutputValidation": ["external_source_count", "error_assertion_count", "provenance_request_count", "scrutiny_rate", "recheck_rate"],
    "EthicalIntegration": ["unprompted_ethics_rate", "privacy_handling", "bias_marker_count", "stakeholder_marker_count", "attribution_marker_count"],
    "CollaborativeSensemaking": ["reconcile_count", "paraphrase_overlap", "why_how_rate", "disagreement_count", "shared_artifact_markers"],
}
DIMENSIONS = list(DIMENSION_FEATURES)
FEATURES = [f for fs in DIMENSION_FEATURES.values() for f in fs]
ITEMS = [f"{d}_i{k}" for d in DIMENSIONS for k in range(1, 6)]
NEAR = 0.40

#: Features that are sums of one family, with or without a denominator of student turns.
SUMS = {
    "subtask_count": "enumeration", "limitation_reference_count": "limitation", "allocation_marker_count": "allocation", "external_source_count": "external_source",
    "error_assertion_count": "error_assert", "provenance_request_count": "provenance", "bias_marker_count": "bias", "stakeholder_marker_count": "stakeholder",
    "attribution_marker_count": "attribution", "reconcile_count": "reconcile", "disagreement_count": "disagreement", "shared_artifact_markers": "shared_artifact",
}
RATES = {"constraint_marker_density": "constraint", "sequence_marker_density": "sequence", "scope_qualifier_density": "scope", "why_how_rate": "why_how"}


def in_order(turns: DataFrame) -> DataFrame:
    """Turns without those of the system; a null role stays."""
    return turns.filter(~F.col("role").eqNullSafe("system"))


def turn_features(turns: DataFrame, profile: str = "general", re2: bool = False) -> DataFrame:
    """Per turn: the counts of all families and what the session's windows need.

    With `re2`, patterns take words, digits and spaces as RE2 does (`functions/text.py`).
    """
    families = list(lexicon.profile(profile))
    user = F.col("role") == "user"
    rows = in_order(turns).withColumn("content", text.text_of(F.col("content")))
    # families that only student turns are asked for are counted there alone; ethics of both roles
    rows = rows.withColumn("low", text.folded(F.col("content")))
    half = len(families) // 2
    for part in (families[:half], families[half:]):  # two projections keep generated methods small
        rows = rows.select("*", *(F.when(user | F.lit(f == "ethics"), text.family(F.col("content"), profile, f, F.col("low"), re2)).otherwise(0).alias(f"c_{f}") for f in part))
    rows = rows.withColumn("pii", F.when(user, sum(text.pii_counts(F.col("content"), F.col("low"), re2).values(), F.lit(0))).otherwise(0))
    rows = rows.withColumn("raw", text.raw_tokens(F.col("content"))).withColumn("toks", F.transform("raw", F.lower)).drop("low")
    return rows.select(
        "*",
        F.size("toks").cast("long").alias("n_tok"),
        text.bigrams(F.col("toks")).alias("bi"),
        F.when(user, text.content_set(F.col("toks"))).alias("words"),
        F.when(user, text.context_chars(F.col("content"), re2)).otherwise(0).alias("ctx"),
    )


def near_earlier(rows: DataFrame) -> DataFrame:
    """session_id, turn, near (true): user turns that are near an earlier one of the session.

    Two sets of which one has n words share one of the first n - ceil(NEAR n) + 1 of it in an order
    that holds for all, here that of the words' hashes. So turns meet by session and word, which
    splits long sessions, and the sets' similarity is computed only for those that meet.
    """
    order = F.array_sort(F.transform("words", lambda w: F.struct(F.xxhash64(w).alias("h"), w.alias("w"))))
    size = F.size("words")
    users = rows.filter((F.col("role") == "user") & (size > 0)).select("session_id", "turn", "words", F.slice(order, 1, (size - F.ceil(size * NEAR) + 1).cast("int")).alias("first"))
    keyed = users.select("session_id", "turn", "words", F.explode("first.h").alias("key"))
    a, b = keyed.alias("a"), keyed.alias("b")
    meet = (F.col("a.session_id") == F.col("b.session_id")) & (F.col("a.key") == F.col("b.key")) & (F.col("b.turn") < F.col("a.turn"))
    found = a.join(b, meet & (text.jaccard(F.col("a.words"), F.col("b.words")) > NEAR), "left_semi")
    return found.select("session_id", "turn").distinct().withColumn("near", F.lit(True))


def windows(rows: DataFrame) -> DataFrame:
    """Adds what a turn takes from the turns around it."""
    w = Window.partitionBy("session_id").orderBy("turn")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    user, assistant = F.col("role") == "user", F.col("role") == "assistant"
    recheck = user & ((F.col("c_recheck") > 0) | (F.col("c_hedge") > 0))
    previous = F.lag(F.struct("role", "bi"), 1).over(w)
    eligible = user & (previous["role"] == "assistant") & (F.col("n_tok") >= 8)
    return rows.select(
        "*",
        F.when(user, F.coalesce(F.max(F.coalesce(recheck, F.lit(False))).over(w.rowsBetween(1, 4)), F.lit(False))).alias("rechecked"),
        F.coalesce(F.last(F.when(assistant, F.col("c_ethics") > 0), ignorenulls=True).over(before), F.lit(False)).alias("primed"),
        F.when(eligible, text.bigram_overlap(F.col("bi"), previous["bi"])).alias("overlap"),
        (F.count(F.when(user, 1)).over(before) > 0).alias("later_user"),
    ).join(near_earlier(rows), ["session_id", "turn"], "left")


def session_features(turns: DataFrame, profile: str = "general", re2: bool = False) -> DataFrame:
    """One row per session: ids, n_student_turns, nlp_backend, lexicon_profile, the 25 features.

    Empty sessions, those of system turns alone, have no row. Null content counts as empty.
    """
    if "discipline" not in turns.columns:
        turns = turns.withColumn("discipline", F.lit(None).cast("string"))
    rows = windows(turn_features(turns, profile, re2))
    user = F.col("role") == "user"
    of_user = lambda x: F.coalesce(F.sum(F.when(user, x)), F.lit(0))
    stop, vague = (F.array(*map(F.lit, x)) for x in (lexicon.STOPWORDS, lexicon.VAGUE))
    telling = F.size(F.filter("toks", lambda t: (F.length(t) > 3) & ~F.array_contains(stop, t)))
    refined = F.col("later_user") & (F.coalesce("near", F.lit(False)) | (F.col("c_revision") > 0))
    framing = F.when(F.col("c_request_head") == 1, 1.0).when(F.col("c_request_head") > 1, 0.5).otherwise(0.0) + F.when(F.col("c_success_cond") > 0, 0.5).otherwise(0.0)
    sums = rows.groupBy("session_id").agg(
        F.min_by(F.struct("student", "discipline"), "turn").alias("who"),
        F.count(F.when(user, 1)).alias("users"),
        F.count(F.when(F.col("role") == "assistant", 1)).alias("assistants"),
        *(of_user(F.col(f"c_{f}")).alias(f"s_{f}") for f in lexicon.profile(profile)),
        of_user(F.length("content")).alias("chars"),
        of_user(F.col("ctx")).alias("ctx"),
        of_user(refined.cast("int")).alias("refined"),
        of_user(F.col("n_tok")).alias("n_tok"),
        of_user(telling).alias("telling"),
        of_user(F.size(F.filter("toks", lambda t: F.array_contains(vague, t)))).alias("vague"),
        of_user(F.size(F.filter("raw", lambda t: t.rlike("^[A-Z]")))).alias("caps"),
        F.min_by(F.get("raw", F.lit(0)).rlike("^[A-Z]"), F.when(user & (F.col("n_tok") > 0), F.col("turn"))).alias("first_cap"),
        of_user(text.digits(F.col("content"), re2)).alias("digits"),
        of_user(framing).alias("framing"),
        F.count(F.when(user & (F.col("c_error_assert") > 0), 1)).alias("errors"),
        F.count(F.when(user & (F.col("c_error_assert") > 0) & F.col("rechecked"), 1)).alias("rechecks"),
        F.count(F.when(user & (F.col("c_ethics") > 0) & ~F.col("primed"), 1)).alias("unprompted"),
        of_user(F.col("pii")).alias("leaks"),
        F.avg("overlap").alias("overlap"),
    )
    n_stu, n_ast, n_tok = F.greatest("users", F.lit(1)), F.greatest("assistants", F.lit(1)), F.greatest("n_tok", F.lit(1))
    entity = F.when(F.col("n_tok") == 0, 0.0).otherwise((F.col("caps") - F.coalesce(F.col("first_cap").cast("int"), F.lit(0)) + F.least("digits", "n_tok")) / n_tok)
    joined = F.greatest(F.col("chars") + F.greatest(F.col("users") - 1, F.lit(0)), F.lit(1))
    made: dict[str, Column] = {name: F.col(f"s_{f}") for name, f in SUMS.items()} | {name: F.col(f"s_{f}") / n_stu for name, f in RATES.items()}
    made |= {
        "context_ratio": F.col("ctx") / joined,
        "refinement_ratio": F.col("refined") / n_stu,
        "specificity_index": F.col("telling") / n_tok - 2.0 * (F.col("vague") / n_tok) + 0.5 * entity,
        "framing_clarity": F.least(F.col("framing") / n_stu, F.lit(1.5)),
        "scrutiny_rate": (F.col("s_provenance") + F.col("s_hedge") + F.col("s_error_assert") + F.col("s_external_source")) / n_ast,
        "recheck_rate": F.when(F.col("errors") > 0, F.col("rechecks") / F.greatest("errors", F.lit(1))).otherwise(0.0),
        "unprompted_ethics_rate": F.col("unprompted") / n_stu,
        "privacy_handling": F.col("s_privacy") - 2.0 * F.col("leaks"),
        "paraphrase_overlap": F.coalesce("overlap", F.lit(0.0)),
    }
    return sums.select(
        "session_id", "who.student", "who.discipline", F.col("users").alias("n_student_turns"), F.lit("regex").alias("nlp_backend"), F.lit(profile).alias("lexicon_profile"),
        *(made[f].cast("double").alias(f) for f in FEATURES),
    )


def student_features(sessions: DataFrame) -> DataFrame:
    """One row per student that isn't null: means of the features over sessions."""
    known = sessions.filter(F.col("student").isNotNull())
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("session_id"))).alias(c)
    found = known.groupBy("student").agg(
        F.count("*").alias("n_sessions"), *(F.avg(f).alias(f) for f in FEATURES), first("discipline"), F.sum("n_student_turns").alias("n_student_turns"), first("nlp_backend"), first("lexicon_profile")
    )
    return found


def extract(turns: DataFrame, level: str = "student", profile: str = "general", re2: bool = False) -> DataFrame:
    if level not in ("session", "student"):
        raise ValueError("level must be 'session' or 'student'")
    found = session_features(turns, profile, re2)
    return found if level == "session" else student_features(found)
