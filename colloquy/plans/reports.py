"""The stages of a scoring run and the text report of a set of item scores."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import features, psychometrics, scoring, stats, turns
from ..operators.features import DIMENSIONS
from ..sources import writers


@dataclass
class Run:
    """What a scoring run found."""

    features: DataFrame
    scored: DataFrame
    thresholds: scoring.ThresholdSet
    problems: list[str]
    flat: list[str]


def score_log(log: DataFrame, human: DataFrame | None = None, level: str = "student", profile: str = "hpc", corpus: str = "", out: str | None = None, most: int = 1000) -> Run:
    """Validation, screening, features, cutpoints and scores; reports and a manifest go to `out`.

    Problems are told, not fatal, the first `most` of them. With human scores the cuts are calibrated on them, else they
    are the corpus's own quantiles.
    """
    problems = [f"session {r.session_id}: {r.problem}" if r.session_id else r.problem for r in turns.validate(log).limit(most).collect()]
    found = features.extract(log, level, profile).cache()
    ts = scoring.derive(found, human, corpus, key="student" if level == "student" else "session_id", profile=profile)
    scored = scoring.score_items(found, ts.cutpoints, ts.provenance)
    if out:
        put = lambda value, name: writers.put(log.sparkSession, json.dumps(value, indent=2, default=str), f"{out}/{name}")
        writers.write_report(turns.screen_pii(log), f"{out}/pii")
        writers.write_report(found, f"{out}/features")
        writers.write_report(scored, f"{out}/scores")
        writers.write_report(scoring.degeneracy_report(scored), f"{out}/degeneracy")
        put(scoring.compare_to_prior(ts.cutpoints), "shift.json")
        put(ts.cutpoints, "cutpoints.json")
        if human is not None:
            agreed = scoring.agreement(scored, human).cache()
            writers.write_report(agreed, f"{out}/agreement")
            writers.write_report(scoring.worst_items(agreed), f"{out}/worst")
            put(scoring.length_baseline(found, human), "length.json")
        put({"corpus": corpus, "level": level, "lexicon_profile": profile, "provenance": ts.provenance, "n_cases": ts.n_cases, "problems": problems[:8]}, "manifest.json")
    return Run(found, scored, ts, problems, ts.flat_features)


def report(students: DataFrame, ratings: DataFrame, think_aloud: DataFrame | None = None) -> str:
    """Eight sections; students: discipline, gpa, ai_task_grade, dimensions and retests, items."""
    lines: list[str] = []
    section = lambda n, title: lines.append(f"\n{n}. {title}\n" + "-" * 78)
    section(1, "Group differences (MANOVA)")
    m = stats.manova(students)
    lines.append(f"   Wilks' lambda = {m['wilks']:.3f}   F({m['df1']}, {m['df2']:.0f}) = {m['f']:.2f}   p = {m['p']:.4g}")
    section(2, "Each dimension (ANOVA, Tukey)")
    tukey = stats.tukey(students)
    for r in stats.anova(students).orderBy("dimension").collect():
        lines.append(f"   {r.dimension:<26} F({r.df_between}, {r.df_within}) = {r.f:.2f}   p = {stats.f_sf(r.f, r.df_between, r.df_within):.4g}   partial eta2 = {r.eta_squared:.3f}")
        lines += [f"      {t['a']} - {t['b']}: {t['difference']:+.2f}   p = {t['p']:.4g}" for t in tukey if t["dimension"] == r.dimension and t["p"] < 0.05]
    section(3, "Internal consistency (Cronbach alpha)")
    lines += [f"   {r.dimension:<26} alpha = {r.alpha:.3f}" for r in stats.cronbach(students).collect()]
    section(4, "Raters (weighted kappa, Krippendorff alpha)")
    wide = stats.wide_ratings(ratings, [1, 2, 3])
    kappas = {r.dimension: (r.a + r.b + r.c) / 3 for r in wide.groupBy("dimension").agg(scoring.kappa("1", "2").alias("a"), scoring.kappa("1", "3").alias("b"), scoring.kappa("2", "3").alias("c")).collect()}
    lines += [f"   {r.dimension:<26} weighted kappa = {kappas[r.dimension]:.3f}   Krippendorff alpha = {r.alpha:.3f}" for r in stats.krippendorff(ratings).orderBy("dimension").collect()]
    section(5, "Five-factor model")
    fit = psychometrics.cfa_of(students)
    lines.append(f"   N = {students.count()}   CFI = {fit['cfi']:.3f}   RMSEA = {fit['rmsea']:.3f}")
    section(6, "Criterion validity")
    for c in ("gpa", "ai_task_grade"):
        found = stats.criterion(students, c).first()
        lines.append(f"   total with {c:<14} r = {found.r:+.3f}   p = {stats.pearson_p(found.r, found.n):.4g}")
    section(7, "Test-retest (ICC(2,1))")
    lines += [f"   {d:<26} ICC(2,1) = {stats.icc(students, d, f'{d}_retest').first().icc:.3f}" for d in DIMENSIONS]
    if think_aloud is not None:
        section(8, "Think-aloud codes")
        for r in stats.think_aloud(think_aloud).orderBy("discipline", F.desc("percent"), "code").collect():
            lines.append(f"   {r.discipline:<16} {r.code:<16} {r.percent:.0f}%")
    return "\n".join(lines)
