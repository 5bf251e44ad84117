"""From features to items: scores, cutpoints, calibration, agreement, reports."""

from __future__ import annotations

import json
import math
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .features import DIMENSION_FEATURES, DIMENSIONS, FEATURES, ITEMS

# --- Fixed values: a-priori cutpoints -----------------------------------------------------------
_D = [0.2, 0.5, 1.0, 1.8]
_C = [0.5, 1.5, 3.5, 6.5]
_B = [-0.25, -0.15, -0.06, -0.001]
_Q = [0.5, 1.5, 2.5, 4.0]
_CUTS = {
    "PromptEngineering": [[0.15, 0.45, 0.9, 1.6], [0.05, 0.15, 0.35, 0.6], [0.1, 0.25, 0.4, 0.6], [0.3, 0.38, 0.46, 0.54], [0.3, 0.6, 0.85, 1.1]],
    "ProblemDecomposition": [_C, _D, _D, _Q, _Q],
    "OutputValidation": [_C, _Q, _C, _B, [0.01, 0.25, 0.5, 0.75]],
    "EthicalIntegration": [[0.02, 0.08, 0.18, 0.3], [-0.5, 0.5, 1.5, 3.0], _Q, _C, _Q],
    "CollaborativeSensemaking": [_Q, _B, _D, _Q, _Q],
}
_BANDS = {"OutputValidation_i4": [0.25, 0.75], "CollaborativeSensemaking_i2": [0.12, 0.45]}
PROPORTIONS = (0.1, 0.3, 0.7, 0.9)
SUSPECT = ["limitation_reference_count", "allocation_marker_count", "external_source_count", "provenance_request_count", "bias_marker_count", "stakeholder_marker_count", "attribution_marker_count", "shared_artifact_markers"]
# --- End of the fixed values --------------------------------------------------------------------

A_PRIORI = {
    f"{d}_i{k + 1}": {"feature": f, "direction": "band" if f"{d}_i{k + 1}" in _BANDS else "up", "cuts": _CUTS[d][k]} | ({"band": _BANDS[f"{d}_i{k + 1}"]} if f"{d}_i{k + 1}" in _BANDS else {})
    for d, fs in DIMENSION_FEATURES.items()
    for k, f in enumerate(fs)
}
Cutpoints = dict[str, dict]


def transformed(spec: dict) -> Column:
    """The feature itself, or less its distance from a band: 0 within."""
    x = F.col(spec["feature"]).cast("double")
    if spec["direction"] != "band":
        return x
    low, high = spec["band"]
    return F.when((x >= low) & (x <= high), F.lit(0.0)).otherwise(-F.least(F.abs(x - low), F.abs(x - high)))


def item(spec: dict) -> Column:
    """1 and a point for each cut that is exceeded; NaN and null score 1."""
    x = transformed(spec)
    points = sum((F.when(~F.isnan(x) & (x > c), 1).otherwise(0) for c in spec["cuts"]), F.lit(1))
    return points.cast("int")


def score_items(features: DataFrame, cutpoints: Cutpoints | None = None, tag: str = "AUTOMATED_APRIORI", ids: list[str] | None = None) -> DataFrame:
    """SCORING_SOURCE, the ids, 25 items of 1 to 5, 5 means of a dimension's items."""
    cutpoints = cutpoints or A_PRIORI
    ids = ids or [c for c in ("session_id", "student", "discipline") if c in features.columns]
    scored = features.select(*ids, *(item(cutpoints[i]).alias(i) for i in ITEMS))
    mean = lambda d: F.bround(sum((F.col(f"{d}_i{k}") for k in range(2, 6)), F.col(f"{d}_i1")) / 5, 3)
    return scored.select(F.lit(tag).alias("SCORING_SOURCE"), *ids, *ITEMS, *(mean(d).alias(d) for d in DIMENSIONS))


def _fitted(cutpoints: Cutpoints, cuts: dict[str, list[float]]) -> Cutpoints:
    """With new cuts, each at least the one before."""
    out = {}
    for i, spec in cutpoints.items():
        rising: list[float] = []
        for c in cuts[i]:
            rising.append(max([float(c), *rising[-1:]]))
        out[i] = {**spec, "cuts": rising}
    return out


def value_counts(df: DataFrame, cols: dict[str, Column]) -> DataFrame:
    """name, v, n: how often each column has each value; nulls don't count."""
    cells = F.array(*(F.struct(F.lit(name).alias("name"), c.cast("double").alias("v")) for name, c in cols.items()))
    return df.select(F.explode(cells).alias("u")).select("u.*").filter("v IS NOT NULL").groupBy("name", "v").agg(F.count("*").alias("n"))


def quantiles(counts: DataFrame, wanted: dict[str, list[float]]) -> dict[str, list[float]]:
    """Exact quantiles by linear interpolation between ranks; None for a name without values.

    The values are dealt to sorted ranges, whose totals give each range's first rank; only the
    values at the wanted ranks, two for each quantile, come back. So no task holds a column.
    """
    parts = counts.sparkSession.sparkContext.defaultParallelism
    ranged = counts.repartitionByRange(parts, "name", "v").select("name", "v", "n", F.spark_partition_id().alias("part"))
    ranged = ranged.cache()
    try:
        sizes = ranged.groupBy("name", "part").agg(F.sum("n").alias("n")).collect()  # a row for each name and range
        total: dict[str, int] = {}
        first = []
        for r in sorted(sizes, key=lambda r: (r.name, r.part)):
            first.append((r.name, r.part, total.get(r.name, 0)))
            total[r.name] = total.get(r.name, 0) + r.n
        at = lambda name, p: p * (total[name] - 1)
        ranks = sorted({(name, k) for name, ps in wanted.items() if name in total for p in ps for k in (math.floor(at(name, p)), math.ceil(at(name, p)))})
        spark = counts.sparkSession
        found = {}
        if ranks:
            within = F.sum("n").over(Window.partitionBy("name", "part").orderBy("v"))
            placed = ranged.withColumn("end", within).join(F.broadcast(spark.createDataFrame(first, "name string, part int, first long")), ["name", "part"])
            asked = F.broadcast(spark.createDataFrame(ranks, "name string, rank long"))
            hit = (placed["name"] == asked["name"]) & (F.col("rank") < F.col("first") + F.col("end")) & (F.col("rank") >= F.col("first") + F.col("end") - F.col("n"))
            found = {(r.name, r["rank"]): r.v for r in placed.join(asked, hit).select(placed["name"], "rank", "v").collect()}
    finally:
        ranged.unpersist()

    def one(name: str, p: float) -> float:
        x = at(name, p)
        low, high = found[name, math.floor(x)], found[name, math.ceil(x)]
        return low if low == high else low + (x - math.floor(x)) * (high - low)

    return {name: [one(name, p) for p in ps] if name in total else None for name, ps in wanted.items()}


def quantile_cutpoints(features: DataFrame, proportions=PROPORTIONS, cutpoints: Cutpoints | None = None) -> Cutpoints:
    """Norm-referenced: exact quantiles of each transformed feature."""
    cutpoints = cutpoints or A_PRIORI
    counts = value_counts(features, {i: transformed(cutpoints[i]) for i in ITEMS})
    return _fitted(cutpoints, quantiles(counts, {i: list(proportions) for i in ITEMS}))


def calibrate(features: DataFrame, human: DataFrame, key: str = "student", cutpoints: Cutpoints | None = None) -> tuple[Cutpoints, list[dict], int]:
    """Cuts at the quantiles of the human marginals; the report; the number of cases."""
    cutpoints = cutpoints or A_PRIORI
    if missing := [i for i in ITEMS if i not in human.columns]:
        raise KeyError(missing[0])
    both = features.alias("f").join(human.select(key, *(F.col(i).alias(f"__{i}") for i in ITEMS)), key).cache()
    try:
        shares = both.agg(F.count("*").alias("n"), *(F.avg((F.col(f"__{i}") <= k).cast("double")).alias(f"{i}_{k}") for i in ITEMS for k in range(1, 5))).first()
        if not shares.n:
            raise ValueError("no case has both features and human scores")
        counts = value_counts(both, {i: transformed(cutpoints[i]) for i in ITEMS}).cache()
        distinct = {r.name: r.n for r in counts.groupBy("name").agg(F.count("*").alias("n")).collect()}
        cuts = quantiles(counts, {i: [shares[f"{i}_{k}"] for k in range(1, 5)] for i in ITEMS})
        counts.unpersist()
    finally:
        both.unpersist()
    fitted = _fitted(cutpoints, cuts)
    report = [
        {"item": i, "feature": fitted[i]["feature"], "distinct_values": distinct[i], "low_resolution": distinct[i] < 5, "prior_cuts": [round(c, 4) for c in cutpoints[i]["cuts"]], "fitted_cuts": [round(c, 4) for c in fitted[i]["cuts"]]}
        for i in ITEMS
    ]
    return fitted, report, shares.n


def unpivoted(df: DataFrame, ids: list[str], cols: list[str], name: str, value: str) -> DataFrame:
    return df.select(*ids, F.explode(F.array(*(F.struct(F.lit(c).alias(name), F.col(c).cast("double").alias(value)) for c in cols))).alias("__u")).select(*ids, f"__u.{name}", f"__u.{value}")


def kappa(a: str, b: str) -> Column:
    """Quadratic-weighted, in closed form from moments; NaN if no disagreement is expected."""
    x, y = F.col(a).cast("double"), F.col(b).cast("double")
    seen = F.avg((x - y) * (x - y))
    expected = F.var_pop(x) + F.var_pop(y) + (F.avg(x) - F.avg(y)) * (F.avg(x) - F.avg(y))
    return F.when(expected > 0, 1 - seen / F.when(expected > 0, expected)).otherwise(F.lit(float("nan")))


def agreement(machine: DataFrame, human: DataFrame, key: str = "student") -> DataFrame:
    """Per item: n, weighted kappa, exact agreement, mean absolute difference, means, meets_080.

    A human score that is null or NaN is an error when its row is read.
    """
    a = unpivoted(machine, [key], ITEMS, "item", "auto")
    b = unpivoted(human, [key], ITEMS, "item", "human")
    missing = F.raise_error(F.concat(F.lit("no human score for "), F.col("item"))).cast("double")
    b = b.withColumn("human", F.when(F.col("human").isNull() | F.isnan("human"), missing).otherwise(F.col("human")))
    both = a.join(b, [key, "item"])
    out = both.groupBy("item").agg(
        F.count("*").alias("n"),
        F.bround(kappa("auto", "human"), 3).alias("weighted_kappa"),
        F.bround(F.avg((F.col("auto") == F.col("human")).cast("double")), 3).alias("exact_agreement"),
        F.bround(F.avg(F.abs(F.col("auto") - F.col("human"))), 3).alias("mean_abs_diff"),
        F.bround(F.avg("auto"), 3).alias("auto_mean"),
        F.bround(F.avg("human"), 3).alias("human_mean"),
    )
    return out.withColumn("meets_080", ~F.isnan("weighted_kappa") & (F.col("weighted_kappa") >= 0.80))


def worst_items(found: DataFrame, n: int = 3) -> DataFrame:
    """The items of an agreement table with the smallest kappas; those without a kappa don't count."""
    return found.filter(~F.isnan("weighted_kappa")).orderBy("weighted_kappa", "item").limit(n)


def distribution_report(features: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Per feature: n, distinct values, the share of zeros, extremes, quartiles, their distance."""
    cols = cols or FEATURES
    counts = value_counts(features, {c: F.col(c) for c in cols}).cache()
    q = quantiles(counts, {c: [0.25, 0.5, 0.75] for c in cols})
    found = counts.groupBy("name").agg(F.sum("n").alias("n"), F.count("*").alias("distinct"), (F.sum(F.when(F.col("v") == 0, F.col("n")).otherwise(0)) / F.sum("n")).alias("zero"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    quarters = counts.sparkSession.createDataFrame([(c, *map(float, v)) for c, v in q.items() if v], "feature string, q1 double, q2 double, q3 double")
    r = lambda c: F.bround(c, 4)
    out = found.join(F.broadcast(quarters), F.col("name") == F.col("feature"))
    return out.select("feature", "n", "distinct", F.bround("zero", 3).alias("zero_share"), r("lo").alias("min"), r("q1").alias("q25"), r("q2").alias("median"), r("q3").alias("q75"), r("hi").alias("max"), r(F.col("q3") - F.col("q1")).alias("iqr"))


def flat_features(report: DataFrame) -> DataFrame:
    """Features that can't carry five levels, by the rounded share of zeros or the distinct values."""
    flat = report.filter((F.col("zero_share") >= 0.90) | (F.col("distinct") < 3))
    return flat.select("feature", "distinct", "zero_share", F.col("feature").isin(SUSPECT).alias("lexicon_suspect"))


def degeneracy_report(scored: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Per item: the commonest score (the smallest of ties), its share, distinct scores, degenerate."""
    counts = unpivoted(scored, [], cols or ITEMS, "item", "score").groupBy("item", "score").agg(F.count("*").alias("n"))
    found = counts.groupBy("item").agg(F.max(F.struct("n", (-F.col("score")).alias("s"))).alias("m"), F.sum("n").alias("all"), F.count("*").alias("distinct_scores"))
    share = F.col("m.n") / F.col("all")
    return found.select("item", (-F.col("m.s")).cast("int").alias("modal_score"), F.bround(share, 3).alias("modal_share"), F.col("distinct_scores"), (share >= 0.80).alias("degenerate")).orderBy(F.desc("modal_share"), "item")


@dataclass
class ThresholdSet:
    """Cutpoints and where they come from."""

    cutpoints: Cutpoints
    provenance: str
    n_cases: int
    corpus: str
    lexicon_profile: str = "general"
    nlp_backend: str = "regex"
    derived_on: str = ""
    n_human_coded: int = 0
    flat_features: list[str] = field(default_factory=list)
    degenerate_items: list[str] = field(default_factory=list)
    notes: list[str] = field(default_factory=list)

    def to_json(self) -> str:
        return json.dumps(asdict(self), indent=2)

    @classmethod
    def from_json(cls, text: str) -> ThresholdSet:
        return cls(**json.loads(text))

    def summary(self) -> str:
        names = ", ".join(self.flat_features[:6])
        lines = [f"thresholds: {self.provenance}, {self.n_cases} cases of {self.corpus}, {self.lexicon_profile} lexicon, {self.nlp_backend} tokens", f"human-coded cases: {self.n_human_coded}", f"flat features: {len(self.flat_features)}" + (f" ({names})" if names else ""), f"degenerate items: {len(self.degenerate_items)}"]
        return "\n".join(lines + [f"note: {n}" for n in self.notes])


def derive(features: DataFrame, human: DataFrame | None = None, corpus: str = "", proportions=PROPORTIONS, key: str = "student", profile: str = "general", on: str = "") -> ThresholdSet:
    """Cutpoints from human scores where there are any, else from the corpus's own quantiles."""
    notes = []
    if human is None:
        cuts, n, coded, tag = quantile_cutpoints(features, proportions), features.count(), 0, "AUTOMATED_NORM_REFERENCED"
        notes.append("norm-referenced: scores say where a case stands in this corpus, not what it has reached")
    else:
        cuts, _, n = calibrate(features, human, key)
        coded, tag = n, "AUTOMATED_CALIBRATED"
        if n < 20:
            notes.append(f"{n} human-coded cases are too few for stable marginals (20)")
        if n < 60:
            notes.append(f"{n} human-coded cases leave none for a holdout (60)")
    flat = [r.feature for r in flat_features(distribution_report(features)).orderBy("feature").collect()]
    degenerate = [r["item"] for r in degeneracy_report(score_items(features, cuts)).filter("degenerate").collect()]
    return ThresholdSet(cuts, tag, n, corpus, profile, "regex", on, coded, flat, degenerate, notes)


def compare_to_prior(fitted: Cutpoints, prior: Cutpoints | None = None) -> list[dict]:
    """Per item the largest relative move of a cut, the largest first."""
    prior = prior or A_PRIORI
    rows = []
    for i in ITEMS:
        moves = [abs(b - a) / (abs(a) if abs(a) > 1e-9 else 1.0) for a, b in zip(prior[i]["cuts"], fitted[i]["cuts"], strict=True)]
        rows.append({"item": i, "feature": prior[i]["feature"], "prior": [round(c, 4) for c in prior[i]["cuts"]], "derived": [round(c, 4) for c in fitted[i]["cuts"]], "max_relative_shift": round(max(moves), 3)})
    return sorted(rows, key=lambda r: (-r["max_relative_shift"], r["item"]))


def length_baseline(features: DataFrame, human: DataFrame, key: str = "student") -> list[dict]:
    """Kappas of calibrated scores from the features, and from the number of turns in their place."""
    only_length = features.select(*(c for c in features.columns if c not in FEATURES), *(F.col("n_student_turns").cast("double").alias(f) for f in FEATURES))
    rows = []
    for name, frame in (("features", features), ("length", only_length)):
        cuts, _, _ = calibrate(frame, human, key)
        table = agreement(score_items(frame, cuts), human, key).filter(~F.isnan("weighted_kappa"))
        s = table.agg(F.median("weighted_kappa").alias("m"), F.count_if(F.col("weighted_kappa") >= 0.80).alias("a"), F.count_if(F.col("weighted_kappa") < 0.40).alias("b")).first()
        rows.append({"model": name, "median_kappa": s.m, "at_least_080": s.a, "below_040": s.b})
    return rows
