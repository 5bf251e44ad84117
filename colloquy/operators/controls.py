"""Design-time controls by replication. Replicates run in parallel; their seeds are drawn in order."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .features import DIMENSIONS, ITEMS
from .psychometrics import FIVE, ONE, cfa
from .simulate import DISCIPLINES, one_factor, shrunk_means, simulate
from .stats import chi2_sf, wilks, wilson

SEED = 20260915


def seeds(n: int, seed: int = SEED) -> list[int]:
    rng = np.random.default_rng(seed)
    return [int(rng.integers(1, 2**31)) for _ in range(n)]


def manova_p(df: pd.DataFrame) -> float:
    x, within, between = df[DIMENSIONS].to_numpy(), 0, 0
    for d in DISCIPLINES:
        own = x[(df.discipline == d).to_numpy()]
        within = within + (own - own.mean(axis=0)).T @ (own - own.mean(axis=0))
        between = between + len(own) * np.outer(own.mean(axis=0) - x.mean(axis=0), own.mean(axis=0) - x.mean(axis=0))
    return wilks(within, between, len(DISCIPLINES) - 1, len(x))["p"]


def fit(df: pd.DataFrame, factor: np.ndarray) -> dict:
    x = df[ITEMS].to_numpy(float)
    found = cfa(len(x), np.cov(x.T, bias=True), factor)
    return found | {"cfi": min(max(found["cfi"], 0.0), 1.0) if not math.isnan(found["cfi"]) else math.nan}


def compare(df: pd.DataFrame) -> dict:
    """Five factors against one: CFI, and whether AIC, BIC and the difference test prefer five."""
    five, one = fit(df, FIVE), fit(df, ONE)
    return {"cfi5": five["cfi"], "cfi1": one["cfi"], "aic5": float(five["aic"] < one["aic"]), "bic5": float(five["bic"] < one["bic"]), "p": chi2_sf(one["chi2"] - five["chi2"], one["dof"] - five["dof"])}


def mean_kappa(ratings: np.ndarray) -> float:
    """Of units by raters: the mean of all pairs' weighted kappas."""
    out = []
    for i in range(ratings.shape[1]):
        for j in range(i):
            a, b = ratings[:, i].astype(float), ratings[:, j].astype(float)
            expected = a.var() + b.var() + (a.mean() - b.mean()) ** 2
            out.append(1 - ((a - b) ** 2).mean() / expected if expected else math.nan)
    return float(np.mean(out))


def _kappas(ratings: pd.DataFrame) -> float:
    wide = [g.pivot(index="student", columns="rater", values="score").to_numpy() for _, g in ratings.groupby("dimension")]
    return float(np.mean([mean_kappa(w) for w in wide]))


def replicate(kind: str, seed: int, n: int, spread: float) -> dict:
    if kind == "manova":
        return {"p": manova_p(simulate(n, seed, shrunk_means(spread))[0])}
    if kind == "one_factor":
        return compare(one_factor(n * len(DISCIPLINES), seed))
    if kind == "five_factor":
        return compare(simulate(n, seed)[0])
    if kind == "sweep":
        found = fit(simulate(n, seed)[0], FIVE)
        return {"cfi": found["cfi"], "rmsea": found["rmsea"]}
    if kind == "coder":
        ratings = simulate(n, seed)[1]
        dirty = ratings.copy()
        third = dirty.rater == 3
        dirty.loc[third, "score"] = np.random.default_rng(seed).integers(1, 6, int(third.sum()))
        return {"clean": _kappas(ratings), "dirty": _kappas(dirty)}
    raise ValueError(f"unknown control {kind!r}")


VALUES = ["p", "cfi5", "cfi1", "aic5", "bic5", "cfi", "rmsea", "clean", "dirty"]


def run(spark: SparkSession, plan: list[tuple[str, int, int, float]]) -> DataFrame:
    """plan: kind, seed, n a group, spread. A row of values for each; null where there is none."""
    rows = spark.createDataFrame([(k, *p) for k, p in enumerate(plan)], "rep int, kind string, seed long, n int, spread double").repartition(min(len(plan), 4 * spark.sparkContext.defaultParallelism) or 1, "rep")

    def made(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [replicate(r.kind, int(r.seed), int(r.n), float(r.spread)) for r in b.itertuples()]
            yield b.assign(**{v: [None if f.get(v) is None or math.isnan(f[v]) else f[v] for f in found] for v in VALUES}).astype({v: float for v in VALUES})

    out = rows.mapInPandas(made, "rep int, kind string, seed long, n int, spread double, " + ", ".join(f"{v} double" for v in VALUES))
    return out.select("rep", "kind", "seed", "n", "spread", *(F.when(~F.isnan(v), F.col(v)).alias(v) for v in VALUES))


def null_control(spark: SparkSession, reps: int = 200, n: int = 10, alpha: float = 0.05, seed: int = SEED) -> dict:
    k = run(spark, [("manova", s, n, 0.0) for s in seeds(reps, seed)]).filter(F.col("p") < alpha).count()
    low, high = wilson(k, reps)
    return {"condition": "Null group structure", "reps": reps, "n": 3 * n, "observed": f"{k / reps:.3f} [{low:.3f}, {high:.3f}]", "nominal": alpha, "calibrated": low <= alpha <= high}


def power_curve(spark: SparkSession, sizes=(8, 10, 15, 20, 30, 40), spreads=(0.5, 1.0), reps: int = 100, alpha: float = 0.05, seed: int = SEED) -> list[dict]:
    cells = [(spread, n) for spread in spreads for n in sizes]
    drawn = iter(seeds(reps * len(cells), seed))
    found = run(spark, [("manova", next(drawn), n, spread) for spread, n in cells for _ in range(reps)])
    hits = {(r.spread, r.n): r.k for r in found.groupBy("spread", "n").agg(F.count_if(F.col("p") < alpha).alias("k")).collect()}
    out = []
    for spread, n in cells:
        low, high = wilson(hits[spread, n], reps)
        out.append({"spread": spread, "n_per_group": n, "N": 3 * n, "power": round(hits[spread, n] / reps, 3), "ci": f"[{low:.3f}, {high:.3f}]"})
    return out


def single_factor_control(spark: SparkSession, reps: int = 20, n: int = 40, alpha: float = 0.05, seed: int = SEED) -> dict:
    drawn = seeds(2 * reps, seed)
    found = run(spark, [("one_factor" if k % 2 == 0 else "five_factor", s, n, 1.0) for k, s in enumerate(drawn)])
    good = found.filter(" AND ".join(f"{v} IS NOT NULL" for v in ("p", "cfi5", "cfi1")))
    rows = {r.kind: r for r in good.groupBy("kind").agg(F.count("*").alias("reps"), F.avg("cfi5").alias("cfi5"), F.avg("cfi1").alias("cfi1"), F.avg("aic5").alias("aic5"), F.avg("bic5").alias("bic5"), F.count_if(F.col("p") < alpha).alias("k")).collect()}
    null, alt = rows["one_factor"], rows["five_factor"]
    tail = sum(math.comb(null.reps, k) * alpha**k * (1 - alpha) ** (null.reps - k) for k in range(null.k, null.reps + 1))
    sensitivity = alt.k / alt.reps
    return {"condition": "Single-factor truth", "reps": null.reps, "n": 3 * n, "cfi_five": null.cfi5, "cfi_one": null.cfi1, "aic_prefers_five": null.aic5, "bic_prefers_five": null.bic5, "false_rejections": null.k / null.reps, "sensitivity": sensitivity, "over_rejects": tail < 0.05, "usable": tail >= 0.05 and sensitivity >= 0.80}


def contaminated_coder_control(spark: SparkSession, reps: int = 100, n: int = 10, seed: int = SEED) -> dict:
    row = run(spark, [("coder", s, n, 1.0) for s in seeds(reps, seed)]).agg(F.avg("clean").alias("c"), F.avg("dirty").alias("d"), F.avg((F.col("dirty") < 0.80).cast("double")).alias("below")).first()
    return {"condition": "Contaminated coder", "reps": reps, "n": 3 * n, "kappa_clean": row.c, "kappa_contaminated": row.d, "below_080": row.below, "detected": row.below >= 0.90}


def fit_sweep(spark: SparkSession, sizes=(30, 60, 90, 120, 180, 240, 360, 480), reps: int = 10, seed: int = SEED) -> DataFrame:
    groups = [max(size // 3, 1) for size in sizes for _ in range(reps)]
    return run(spark, [("sweep", s, n, 1.0) for s, n in zip(seeds(len(groups), seed), groups, strict=True)]).select((F.col("n") * 3).alias("N"), "rep", "cfi", "rmsea")


def fit_sweep_summary(sweep: DataFrame) -> DataFrame:
    q = lambda c, p, name: F.bround(F.percentile(c, F.lit(p)), 3).alias(name)
    found = sweep.groupBy("N").agg(F.count("*").alias("reps"), F.count("cfi").alias("converged"), *(q(c, p, f"{c}_{name}") for c in ("cfi", "rmsea") for p, name in ((0.5, "median"), (0.25, "q25"), (0.75, "q75"))))
    return found.withColumn("reading", F.when(F.col("cfi_median") >= 0.95, "clean").when(F.col("cfi_median") >= 0.90, "acceptable").otherwise("not estimable")).orderBy("N")


def run_all(spark: SparkSession, fast: int = 200, slow: int = 20, n: int = 10, seed: int = SEED) -> tuple[list[dict], list[dict]]:
    curve = power_curve(spark, reps=max(fast // 2, 50), seed=seed)
    at = next(r for r in curve if r["n_per_group"] == n and r["spread"] == 1.0)
    table = [null_control(spark, fast, n, seed=seed), single_factor_control(spark, slow, 40, seed=seed), contaminated_coder_control(spark, max(fast // 2, 20), n, seed=seed)]
    return [*table, {"condition": "Power at designed separation", "reps": max(fast // 2, 50), "n": 3 * n, "observed": f"{at['power']:.3f} {at['ci']}"}], curve
