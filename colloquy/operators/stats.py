"""Statistics whose data part is one aggregate: reliability, groups, raters, correlation.

What is left after the aggregate (a few sums) is finished on the driver or in the same plan.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .features import DIMENSIONS
from .scoring import unpivoted


def dimension_items(d: str) -> list[str]:
    return [f"{d}_i{k}" for k in range(1, 6)]


def cronbach(items: DataFrame, dimensions: list[str] | None = None) -> DataFrame:
    """dimension, alpha; NaN if the total doesn't vary."""
    dimensions = dimensions or DIMENSIONS
    one = items.agg(*(F.struct(sum((F.var_samp(i) for i in dimension_items(d)), F.lit(0.0)).alias("each"), F.var_samp(sum(map(F.col, dimension_items(d)), F.lit(0))).alias("total")).alias(d) for d in dimensions))
    alpha = lambda d: F.when(F.col(f"{d}.total") > 0, 1.25 * (1 - F.col(f"{d}.each") / F.when(F.col(f"{d}.total") > 0, F.col(f"{d}.total")))).otherwise(F.lit(float("nan")))
    return one.select(F.explode(F.array(*(F.struct(F.lit(d).alias("dimension"), alpha(d).alias("alpha")) for d in dimensions))).alias("r")).select("r.*")


def dimension_means(items: DataFrame) -> DataFrame:
    ids = [c for c in ("student", "discipline") if c in items.columns]
    return items.select(*ids, *((sum((F.col(i) for i in dimension_items(d)), F.lit(0)) / 5.0).alias(d) for d in DIMENSIONS))


def anova(scores: DataFrame, group: str = "discipline", cols: list[str] | None = None) -> DataFrame:
    """dimension, df_between, df_within, f, eta_squared; with p from `f_sf` on the driver."""
    long = unpivoted(scores.filter(F.col(group).isNotNull()), [group], cols or DIMENSIONS, "dimension", "x").filter(F.col("x").isNotNull())
    by = long.groupBy("dimension", group).agg(F.count("*").alias("n"), F.avg("x").alias("m"), F.var_pop("x").alias("v"))
    found = by.groupBy("dimension").agg(F.sum("n").alias("n"), F.count("*").alias("g"), F.sum(F.col("n") * F.col("m")).alias("s"), F.sum(F.col("n") * F.col("m") * F.col("m")).alias("q"), F.sum(F.col("n") * F.col("v")).alias("within"))
    between = F.col("q") - F.col("s") * F.col("s") / F.col("n")
    df1, df2 = F.col("g") - 1, F.col("n") - F.col("g")
    return found.select("dimension", df1.alias("df_between"), df2.alias("df_within"), F.try_divide(between / df1, F.try_divide("within", df2)).alias("f"), F.try_divide(between, between + F.col("within")).alias("eta_squared"))


def icc(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """ICC(2,1) of two occasions, in one row."""
    x, y = F.col(a).cast("double"), F.col(b).cast("double")
    s = pairs.agg(F.count("*").alias("n"), F.avg(x).alias("ma"), F.avg(y).alias("mb"), F.var_pop(x).alias("va"), F.var_pop(y).alias("vb"), F.covar_pop(x, y).alias("c"))
    n = F.col("n")
    ss_rows = n * (F.col("va") + F.col("vb") + 2 * F.col("c")) / 2
    ss_cols = n * (F.col("ma") - F.col("mb")) * (F.col("ma") - F.col("mb")) / 2
    ss_all = n * (F.col("va") + F.col("vb")) + ss_cols
    ms_r, ms_c, ms_e = ss_rows / (n - 1), ss_cols, (ss_all - ss_rows - ss_cols) / (n - 1)
    return s.select(((ms_r - ms_e) / (ms_r + ms_e + 2 * (ms_c - ms_e) / n)).alias("icc"))


def krippendorff(ratings: DataFrame, unit: str = "student", value: str = "score", by: str = "dimension") -> DataFrame:
    """Interval alpha of complete ratings, by `by`: 1 less observed over expected disagreement; NaN if none is expected."""
    x = F.col(value).cast("double")
    units = ratings.groupBy(by, unit).agg(F.count("*").alias("m"), F.sum(x).alias("s"), F.sum(x * x).alias("q"))
    # squared differences of all ordered pairs of values: 2 (m q - s s)
    sums = units.groupBy(by).agg(F.sum(2 * (F.col("m") * F.col("q") - F.col("s") * F.col("s")) / (F.col("m") - 1)).alias("o"), F.sum("m").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"))
    observed = F.col("o") / F.col("n")
    expected = 2 * (F.col("n") * F.col("q") - F.col("s") * F.col("s")) / (F.col("n") * (F.col("n") - 1))
    return sums.select(by, F.when(expected > 0, 1 - observed / F.when(expected > 0, expected)).otherwise(F.lit(float("nan"))).alias("alpha"))


def wide_ratings(ratings: DataFrame, raters: list[int]) -> DataFrame:
    """A column for each rater; two scores of a rater for one unit are an error."""
    once = F.when(F.count("score") <= 1, F.first("score")).otherwise(F.raise_error(F.lit("two scores in one cell")).cast("int"))
    return ratings.groupBy("dimension", "student").pivot("rater", raters).agg(once)


def think_aloud(codes: DataFrame) -> DataFrame:
    """discipline, code, count, percent within the discipline."""
    sums = codes.groupBy("discipline", "code").agg(F.sum("count").alias("count"))
    share = 100.0 * F.col("count") / F.sum("count").over(Window.partitionBy("discipline"))
    return sums.select("discipline", "code", "count", share.alias("percent"))


def group_means(scores: DataFrame, group: str = "discipline") -> DataFrame:
    long = unpivoted(scores, [group], DIMENSIONS, "dimension", "x")
    return long.groupBy(group, "dimension").agg(F.avg("x").alias("mean"), (F.stddev_samp("x") / F.sqrt(F.count("x"))).alias("sem"))


def correlations(scores: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """a, b, r for all pairs of columns, from one aggregate."""
    cols = cols or DIMENSIONS
    pairs = [(a, b) for k, a in enumerate(cols) for b in cols[k + 1 :]]
    one = scores.agg(*(F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b)).alias(f"r{k}") for k, (a, b) in enumerate(pairs)))
    return one.select(F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"r{k}").alias("r")) for k, (a, b) in enumerate(pairs)))).alias("x")).select("x.*")


def criterion(scores: DataFrame, col: str) -> DataFrame:
    """n, r: the mean of the dimensions with a column; p is `pearson_p` of these."""
    total = sum(map(F.col, DIMENSIONS), F.lit(0)) / 5
    return scores.agg(F.count("*").alias("n"), F.corr(total, F.col(col)).alias("r"))


def contingency(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("n"))


def moments(df: DataFrame, cols: list[str]) -> tuple[int, np.ndarray, np.ndarray]:
    """n, means and covariances (by n) of the columns from one aggregate; their number bounds its width."""
    pairs = [(i, j) for i in range(len(cols)) for j in range(i, len(cols))]
    row = df.agg(F.count("*").alias("n"), *(F.avg(c).alias(f"m{i}") for i, c in enumerate(cols)), *(F.covar_pop(cols[i], cols[j]).alias(f"c{i}_{j}") for i, j in pairs)).first()
    cov = np.zeros((len(cols), len(cols)))
    for i, j in pairs:
        cov[i, j] = cov[j, i] = row[f"c{i}_{j}"]
    return row.n, np.array([row[f"m{i}"] for i in range(len(cols))]), cov


def manova(scores: DataFrame, group: str = "discipline", cols: list[str] | None = None) -> dict:
    """Wilks' lambda of the groups, with Rao's F and its p."""
    cols = cols or DIMENSIONS
    pairs = [(i, j) for i in range(len(cols)) for j in range(i, len(cols))]
    rows = scores.groupBy(group).agg(F.count("*").alias("n"), *(F.avg(c).alias(f"m{i}") for i, c in enumerate(cols)), *(F.covar_pop(cols[i], cols[j]).alias(f"c{i}_{j}") for i, j in pairs)).collect()  # a row a group
    n = np.array([r.n for r in rows], float)
    means = np.array([[r[f"m{i}"] for i in range(len(cols))] for r in rows])
    within = np.zeros((len(cols), len(cols)))
    for r in rows:
        for i, j in pairs:
            within[i, j] += r.n * r[f"c{i}_{j}"]
    within = np.triu(within) + np.triu(within, 1).T
    centred = means - (n @ means) / n.sum()
    return wilks(within, (centred * n[:, None]).T @ centred, len(rows) - 1, int(n.sum()))


def wilks(within: np.ndarray, between: np.ndarray, q: int, n: int) -> dict:
    p = len(within)
    lam = float(np.linalg.det(within) / np.linalg.det(within + between))
    t = math.sqrt((p * p * q * q - 4) / (p * p + q * q - 5)) if p * p + q * q > 5 else 1.0
    df1, df2 = p * q, t * (n - 1 - (p + q + 1) / 2) - (p * q - 2) / 2
    root = lam ** (1 / t)
    f = (1 - root) / root * df2 / df1
    return {"wilks": lam, "f": f, "df1": df1, "df2": df2, "p": f_sf(f, df1, df2)}


# --- distribution functions ---------------------------------------------------------------------


def beta_inc(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function, by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_inc(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, c, d = 1e-300, 1.0, 1 / max(1e-300, 1 - (a + b) * x / (a + 1))
    out = d
    for m in range(1, 500):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            c = 1 + num / c
            d, c = 1 / (d if abs(d) > tiny else tiny), c if abs(c) > tiny else tiny
            out *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * out


def f_sf(f: float, df1: float, df2: float) -> float:
    return beta_inc(df2 / 2, df1 / 2, df2 / (df2 + df1 * f)) if f > 0 else 1.0


def t_two_sided(t: float, df: float) -> float:
    return beta_inc(df / 2, 0.5, df / (df + t * t))


def pearson_p(r: float, n: int) -> float:
    return t_two_sided(r * math.sqrt((n - 2) / max(1e-300, 1 - r * r)), n - 2)


def chi2_sf(x: float, df: float) -> float:
    """The upper tail, by the series or the continued fraction of the incomplete gamma function."""
    a, x = df / 2, x / 2
    if x <= 0:
        return 1.0
    front = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        k = a
        while abs(term) > total * 1e-16:
            k += 1
            term *= x / k
            total += term
        return max(0.0, 1 - front * total)
    b = x + 1 - a
    c, d = 1e300, 1 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b)
        c = b + an / c
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h


def norm_cdf(x: float) -> float:
    return 0.5 * math.erfc(-x / math.sqrt(2))


def studentized_range_sf(q: float, k: int, df: float) -> float:
    """The upper tail for k groups, by numeric integration over the scale and the least value."""
    if q <= 0 or math.isinf(q):
        return float(q <= 0)
    z = np.linspace(-8, 8, 801)
    phi = np.exp(-z * z / 2) / math.sqrt(2 * math.pi)
    cdf = np.array([norm_cdf(v) for v in np.linspace(-60, 60, 24001)])
    at = lambda v: np.interp(v, np.linspace(-60, 60, 24001), cdf)
    s = np.linspace(1e-4, 4, 801)
    log_density = math.log(2) + (df / 2) * math.log(df / 2) - math.lgamma(df / 2) + (df - 1) * np.log(s) - df * s * s / 2
    inner = np.array([np.trapezoid(k * phi * (at(z) - at(z - q * v)) ** (k - 1), z) for v in s])
    return float(np.clip(1 - np.trapezoid(np.exp(log_density) * inner, s), 0, 1))


def tukey(scores: DataFrame, group: str = "discipline", cols: list[str] | None = None) -> list[dict]:
    """All pairs of groups in each dimension: mean difference, studentised range and adjusted p."""
    long = unpivoted(scores, [group], cols or DIMENSIONS, "dimension", "x")
    rows = long.groupBy("dimension", group).agg(F.count("*").alias("n"), F.avg("x").alias("m"), F.var_pop("x").alias("v")).collect()  # a row a dimension and group
    out = []
    for d in cols or DIMENSIONS:
        own = sorted((r for r in rows if r.dimension == d), key=lambda r: r[group])
        df = sum(r.n for r in own) - len(own)
        ms = sum(r.n * r.v for r in own) / df
        for i, a in enumerate(own):
            for b in own[i + 1 :]:
                q = abs(a.m - b.m) / math.sqrt(ms / 2 * (1 / a.n + 1 / b.n)) if ms else math.inf
                out.append({"dimension": d, "a": a[group], "b": b[group], "difference": b.m - a.m, "q": q, "p": studentized_range_sf(q, len(own), df)})
    return out


def wilson(k: int, n: int, z: float = 1.959963984540054) -> tuple[float, float]:
    if not n:
        return math.nan, math.nan
    p, d = k / n, 1 + z * z / n
    half = z * math.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    return (p + z * z / (2 * n) - half) / d, (p + z * z / (2 * n) + half) / d
