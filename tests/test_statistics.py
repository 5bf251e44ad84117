from __future__ import annotations

import math
import re

import numpy as np
import pytest

from colloquy.functions import lexicon
from colloquy.operators import controls, psychometrics, simulate, stats
from colloquy.operators.features import DIMENSIONS, ITEMS
from colloquy.plans import reports


@pytest.fixture(scope="module")
def thirty(spark):
    df, ratings, codes = simulate.simulate(10)
    return spark.createDataFrame(df).cache(), spark.createDataFrame(ratings).cache(), spark.createDataFrame(codes)


def test_published_values(spark, thirty):
    students, ratings, codes = thirty
    m = stats.manova(students)
    assert (round(m["wilks"], 3), m["df1"], m["df2"], round(m["f"], 2)) == (0.108, 10, 46, 9.39) and m["p"] == pytest.approx(3.016e-08, rel=1e-3)
    anova = {r.dimension: r for r in stats.anova(students).collect()}
    assert [(round(anova[d].f, 2), round(anova[d].eta_squared, 3)) for d in DIMENSIONS] == [(10.61, 0.440), (1.81, 0.118), (9.15, 0.404), (4.72, 0.259), (11.23, 0.454)]
    alpha = {r.dimension: round(r.alpha, 3) for r in stats.cronbach(students).collect()}
    assert [alpha[d] for d in DIMENSIONS] == [0.777, 0.870, 0.790, 0.853, 0.855]
    agreed = {r.dimension: round(r.alpha, 3) for r in stats.krippendorff(ratings).collect()}
    assert [agreed[d] for d in DIMENSIONS] == [0.881, 0.818, 0.807, 0.879, 0.859]
    assert [round(stats.icc(students, d, f"{d}_retest").first().icc, 3) for d in DIMENSIONS] == [0.779, 0.681, 0.896, 0.701, 0.717]
    fit = psychometrics.cfa_of(students)
    assert (round(fit["cfi"], 3), round(fit["rmsea"], 3), fit["dof"]) == (0.477, 0.192, 265)
    big = controls.fit(simulate.simulate(80, 99)[0], psychometrics.FIVE)
    assert (round(big["cfi"], 3), round(big["rmsea"], 3)) == (0.991, 0.018)
    text = reports.report(students, ratings, codes)
    for part in ("weighted kappa = 0.878", "weighted kappa = 0.819", "weighted kappa = 0.806", "r = +0.383   p = 0.03695", "r = +0.495   p = 0.005417", "PROMPT_REFINE    43%"):
        assert part in text


def test_constant_ratings_have_no_alpha(spark):
    df = spark.createDataFrame([("d", s, r, 3) for s in "ab" for r in (1, 2)], "dimension string, student string, rater int, score int")
    assert math.isnan(stats.krippendorff(df).first().alpha)


def test_figures_are_well_formed(spark, thirty):
    from xml.etree import ElementTree

    from colloquy.sources import figures

    students = thirty[0]
    for text in (figures.group_bars(stats.group_means(students)), figures.correlation_map(stats.correlations(students)), figures.sweep_curves(controls.fit_sweep_summary(controls.fit_sweep(spark, (30, 60), 2)))):
        root = ElementTree.fromstring(text)
        assert root.tag.endswith("svg") and len(root) > 10 and "nan" not in text


def test_tukey_and_distributions(thirty):
    found = {(t["dimension"], t["a"], t["b"]): t for t in stats.tukey(thirty[0])}
    assert len(found) == 15 and all(0 <= t["p"] <= 1 for t in found.values())
    assert stats.studentized_range_sf(3.506, 3, 27) == pytest.approx(0.05, abs=2e-3)
    assert stats.f_sf(4.0, 1, 10**7) == pytest.approx(2 * (1 - stats.norm_cdf(2.0)), abs=1e-5)
    assert stats.chi2_sf(18.307, 10) == pytest.approx(0.05, abs=1e-4) and stats.chi2_sf(1.0, 1) == pytest.approx(2 * (1 - stats.norm_cdf(1.0)))
    low, high = stats.wilson(5, 100)
    assert low < 0.05 < high and math.isnan(stats.wilson(0, 0)[0])


def test_polychoric(spark):
    rng = np.random.default_rng(1)
    z = rng.multivariate_normal([0, 0], [[1, 0.6], [0.6, 1]], 4000)
    x = np.digitize(z, [-1, -0.2, 0.5, 1.2]) + 1
    table = np.zeros((5, 5))
    np.add.at(table, (x[:, 0] - 1, x[:, 1] - 1), 1)
    assert psychometrics.polychoric(table) == pytest.approx(0.6, abs=0.04)
    assert math.isnan(psychometrics.polychoric(np.diag([5, 0, 0, 0, 0])))
    assert psychometrics.bvn(np.array([0.0]), np.array([0.0]), 0.5)[0, 0] == pytest.approx(0.25 + math.asin(0.5) / (2 * math.pi))
    df = spark.createDataFrame([(int(a), int(b), 3) for a, b in x[:500]], "a int, b int, c int")
    r = psychometrics.polychoric_matrix(df, ["a", "b", "c"])
    assert r[0, 1] == pytest.approx(0.6, abs=0.1) and r[0, 2] == 0
    assert 0 < psychometrics.ordinal_alpha(r[:2, :2]) < 1 and 0 < psychometrics.ordinal_omega(r[:2, :2]) <= 1


def test_controls(spark):
    assert controls.seeds(2) == controls.seeds(3)[:2]
    null = controls.null_control(spark, 25)
    assert null["n"] == 30 and null["calibrated"]
    coder = controls.contaminated_coder_control(spark, 6)
    assert coder["kappa_clean"] > 0.75 > coder["kappa_contaminated"]
    single = controls.single_factor_control(spark, 3)
    assert single["sensitivity"] == 1 and abs(single["cfi_five"] - single["cfi_one"]) < 0.05
    curve = controls.power_curve(spark, (8, 20), (0.5, 1.0), 5)
    assert len(curve) == 4 and curve[3]["power"] >= curve[0]["power"]
    summary = {r.N: r for r in controls.fit_sweep_summary(controls.fit_sweep(spark, (30, 240), 2)).collect()}
    assert summary[240].cfi_median > summary[30].cfi_median and summary[30].reading == "not estimable"


def test_generated_logs_and_coders(spark):
    levels = simulate.latents(spark, 4)
    log = simulate.logs(levels, 2)
    assert log.select("student").distinct().count() == 12
    for families in simulate.MOVES.values():
        for family, sentences in families.items():
            for x in sentences:
                assert re.search("|".join(lexicon.GENERAL[family]), x, re.I | re.M), (family, x)
    items = simulate.human_items(levels.toPandas())
    assert items[ITEMS].to_numpy().min() >= 1 and items[ITEMS].to_numpy().max() <= 5
    out = reports.score_log(log.withColumn("student", log.student.cast("string")), profile="general")
    assert out.problems == [] and out.scored.count() == 12
