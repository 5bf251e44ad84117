from __future__ import annotations

import re

import pytest

from colloquy.functions import lexicon
from colloquy.operators import features, scoring, turns

LOG = "session_id string, student string, role string, turn int, content string"
TURNS = [
    ("s1", "a", "user", 0, "Write a table in under 200 words. First, then why? Just for now.\n1. one\n2. two\n```int x;```"),
    ("s1", "a", "assistant", 1, "Here the table shows one two three four five six words about privacy"),
    ("s1", "a", "user", 2, "That's wrong, the table shows one two three four five six words; my email is bob@example.com"),
    ("s1", "a", "assistant", 3, None),
    ("s1", "a", "user", 4, "are you sure? rewrite the table. consent matters"),
    ("s1", "a", "system", 5, "ignored"),
    ("s2", "b", "assistant", 0, "hi"),
    ("s2", "b", "user", 3, "for (i=0;i<n;i++) {\n  a[i] = b[i];\n}\nok"),
    ("s3", None, "user", 0, "plain"),
]


def frame(spark, rows=TURNS):
    return spark.createDataFrame(rows, LOG)


def test_features_by_hand(spark):
    got = {r.session_id: r for r in features.session_features(frame(spark)).collect()}
    r = got["s1"]
    assert (r.n_student_turns, r.nlp_backend, r.lexicon_profile) == (3, "regex", "general")
    assert r.constraint_marker_density == pytest.approx(1 / 3)
    assert r.context_ratio == pytest.approx(len("```int x;```") / len("\n".join(t[4] for t in TURNS[:5] if t[2] == "user")))
    assert r.refinement_ratio == pytest.approx(1 / 3)  # "rewrite" in the third
    assert r.framing_clarity == pytest.approx(1 / 3)
    assert (r.subtask_count, r.error_assertion_count, r.privacy_handling) == (2, 1, -2)
    assert r.recheck_rate == 1 and r.scrutiny_rate == 1
    assert r.unprompted_ethics_rate == pytest.approx(1 / 3)  # the assistant before it said nothing
    student = re.findall("[a-z'-]+", TURNS[2][4].lower())
    assistant = re.findall("[a-z'-]+", TURNS[1][4].lower())
    pairs = list(zip(student, student[1:]))
    assert r.paraphrase_overlap == pytest.approx(sum(p in set(zip(assistant, assistant[1:])) for p in pairs) / len(pairs) / 2)  # the last turn answers an empty one
    assert got["s2"].context_ratio == pytest.approx((len("for (i=0;i<n;i++) {") + len("  a[i] = b[i];") + 1) / len(TURNS[7][4]))


def test_families_equal_python(spark):
    texts = ["sleep(1) and f(a): 1) no, see (2) later", "Plan: (1) read (2) write; (a) x (b) y", "first we go; secondly we stop", "• dot\r- dash", "ébias bias BIAS", "for (2) the docs, step 1 of it", "I’m trying to", "ſource source", None]
    df = spark.createDataFrame([(t,) for t in texts], "content string")
    from pyspark.sql import functions as F

    from colloquy.functions import text

    for name in lexicon.PROFILES:
        found = df.select("content", *(text.family(F.col("content"), name, f).alias(f) for f in lexicon.profile(name))).collect()
        for r in found:
            for f, pats in lexicon.profile(name).items():
                assert r[f] == (len(re.findall("|".join(pats), r.content, re.I | re.M)) if r.content else 0), (name, f, r.content)


def test_coverage_counts_every_alternative():
    assert lexicon.coverage("general")["success_cond"] == 8 and lexicon.coverage("hpc")["revision"] == 13


def test_near_duplicate_turns_and_levels(spark):
    rows = [("s", "a", "user", k, t) for k, t in enumerate(["alpha beta gamma delta", "unrelated words entirely", "alpha beta gamma epsilon"])]
    assert features.session_features(frame(spark, rows)).first().refinement_ratio == pytest.approx(1 / 3)
    students = features.extract(frame(spark), "student").collect()
    assert {r.student for r in students} == {"a", "b"}  # a null student has no row
    with pytest.raises(ValueError):
        features.extract(frame(spark), "class")
    with pytest.raises(ValueError):
        features.session_features(frame(spark), "law")


def test_validation_and_screening(spark):
    faulty = frame(spark, [("s1", "a", "assistant", 0, "x"), ("s1", "b", "assistant", 0, None), ("s2", "a", "narrator", 0, "y"), ("s2", "a", "user", 1, "call 555-123-4567, 123-45-6789, MRN: 99, 03/14/1991, https://x.y")])
    got = {(r.session_id, r.problem) for r in turns.validate(faulty).collect()}
    assert got == {(None, "unexpected role values: narrator"), (None, "1 turns with null content"), (None, "no model column"), ("s1", "duplicate turn indices"), ("s1", "more than one student"), ("s1", "does not open with a student turn"), ("s1", "no student turns"), ("s2", "does not open with a student turn")}
    assert turns.validate(faulty.drop("student")).first().problem == "missing column: student"
    r = turns.screen_pii(faulty).first()
    assert (r.session_id, r.total_hits, r.phone, r.ssn_like, r.record_id, r.dob_like, r.url) == ("s2", 5, 1, 1, 1, 1, 1)


def test_scores_and_cutpoints(spark):
    from pyspark.sql import functions as F

    base = spark.range(40).select(F.col("id").cast("string").alias("student"), F.lit("d").alias("discipline"), *((F.col("id") * (k + 1) / 40.0).alias(f) for k, f in enumerate(features.FEATURES)))
    scored = scoring.score_items(base)
    assert scored.columns[0] == "SCORING_SOURCE" and len(scored.columns) == 3 + 25 + 5
    nan = base.withColumn("constraint_marker_density", F.lit(float("nan")))
    assert {r.PromptEngineering_i1 for r in scoring.score_items(nan).collect()} == {1}
    human = scored.select("student", *features.ITEMS)
    cuts, report, n = scoring.calibrate(base, human)
    assert n == 40 and len(report) == 25
    again = scoring.agreement(scoring.score_items(base, cuts), human)
    kappas = {r.item: r.weighted_kappa for r in again.collect()}
    assert all(k != k or k > 0.9 for i, k in kappas.items() if i not in scoring._BANDS)
    same = scoring.agreement(scored, human)
    assert all(r.weighted_kappa != r.weighted_kappa or r.weighted_kappa == 1 for r in same.collect())
    ts = scoring.derive(base, corpus="c")
    assert scoring.ThresholdSet.from_json(ts.to_json()) == ts and "40 cases" in ts.summary()
    worst = scoring.worst_items(again).collect()
    assert [(r.weighted_kappa, r["item"]) for r in worst] == sorted((k, i) for i, k in kappas.items() if k == k)[:3]
    holes = human.withColumn("PromptEngineering_i2", F.when(F.col("student") != "3", F.col("PromptEngineering_i2")))
    with pytest.raises(Exception, match="no human score for PromptEngineering_i2"):
        scoring.agreement(scored, holes).collect()
    with pytest.raises(KeyError):
        scoring.calibrate(base, human.drop("PromptEngineering_i1"))
