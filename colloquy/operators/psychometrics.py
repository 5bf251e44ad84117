"""Factor models and ordinal correlations: Spark gives covariances and tables, NumPy fits them."""

from __future__ import annotations

import math
from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .features import DIMENSIONS, ITEMS
from .stats import cronbach, moments

FIVE = np.repeat(np.arange(5), 5)
ONE = np.zeros(25, int)


def cfa(n: int, s: np.ndarray, factor: np.ndarray = FIVE, steps: int = 200) -> dict:
    """Maximum likelihood of a simple-structure model with unit factor variances, by Fisher scoring.

    chi2 is n times the discrepancy, RMSEA takes n - 1, AIC and BIC come from chi2.
    """
    p, m = len(s), int(factor.max()) + 1
    pairs = [(a, b) for a in range(m) for b in range(a)]
    nan = {k: math.nan for k in ("cfi", "rmsea", "chi2", "dof", "aic", "bic")}
    sign, log_s = np.linalg.slogdet(s)
    if sign <= 0:
        return nan
    d = np.sqrt(np.diag(s))
    theta = np.concatenate([0.7 * d, 0.5 * d * d, np.full(len(pairs), 0.3)])
    at = np.arange(p)

    def parts(t: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        lam = np.zeros((p, m))
        lam[at, factor] = t[:p]
        phi = np.eye(m)
        for (a, b), r in zip(pairs, t[2 * p :], strict=True):
            phi[a, b] = phi[b, a] = r
        return lam, phi, lam @ phi @ lam.T + np.diag(t[p : 2 * p])

    def loss(t: np.ndarray) -> float:
        if (t[p : 2 * p] <= 1e-6).any() or (np.abs(t[2 * p :]) >= 1).any():
            return math.inf
        sigma = parts(t)[2]
        sign, log = np.linalg.slogdet(sigma)
        return math.inf if sign <= 0 else float(log + np.trace(np.linalg.solve(sigma, s)) - log_s - p)

    now = loss(theta)
    for _ in range(steps):
        lam, phi, sigma = parts(theta)
        inv = np.linalg.inv(sigma)
        grads = np.zeros((len(theta), p, p))
        side = lam @ phi
        for k in range(p):
            grads[k, k] += side[:, factor[k]]
            grads[k, :, k] += side[:, factor[k]]
            grads[p + k, k, k] = 1
        for k, (a, b) in enumerate(pairs):
            outer = np.outer(lam[:, a], lam[:, b])
            grads[2 * p + k] = outer + outer.T
        w = inv @ grads
        gradient = np.einsum("kij,ji->k", w, np.eye(p) - inv @ s)
        info = np.einsum("kij,lji->kl", w, w)
        try:
            step = np.linalg.solve(info + 1e-9 * np.eye(len(theta)), gradient)
        except np.linalg.LinAlgError:
            return nan
        size = 1.0
        while size > 1e-6 and not loss(theta - size * step) < now:
            size /= 2
        if size <= 1e-6:
            break
        theta = theta - size * step
        before, now = now, loss(theta)
        if before - now < 1e-10:
            break
    chi2, dof = n * now, p * (p + 1) / 2 - len(theta)
    null, null_dof = n * (float(np.log(np.diag(s)).sum()) - log_s), p * (p - 1) / 2
    free = len(theta)
    return {
        "cfi": 1 - (chi2 - dof) / (null - null_dof),
        "rmsea": math.sqrt(max(chi2 / dof - 1, 0) / (n - 1)),
        "chi2": chi2,
        "dof": dof,
        "aic": chi2 + 2 * free,
        "bic": chi2 + free * math.log(n),
    }


def cfa_of(items: DataFrame, factor: np.ndarray = FIVE) -> dict:
    n, _, cov = moments(items, ITEMS)
    return cfa(n, cov, factor)


# --- ordinal correlations -------------------------------------------------------------------------

_NODES, _WEIGHTS = np.polynomial.legendre.leggauss(48)
_CDF = np.vectorize(NormalDist().cdf)


def bvn(h: np.ndarray, k: np.ndarray, r: float | np.ndarray) -> np.ndarray:
    """P(X < h, Y < k) for all of h by all of k (their last axes), by an integral over the angle of
    the correlation; further axes, of r too, go side by side."""
    h, k = np.clip(h, -9, 9), np.clip(k, -9, 9)
    return _CDF(h)[..., :, None] * _CDF(k)[..., None, :] + _beyond_independence(h, k, np.asarray(r, float))


def _beyond_independence(h: np.ndarray, k: np.ndarray, r: np.ndarray) -> np.ndarray:
    top = np.arcsin(r)[..., None]
    angle = top * (_NODES + 1) / 2
    h, k = h[..., None, :, None], k[..., None, None, :]
    sine, cosine = np.sin(angle)[..., None, None], np.cos(angle)[..., None, None]
    each = np.exp(-(h * h + k * k - 2 * h * k * sine) / (2 * cosine**2))
    return ((_WEIGHTS * top / (4 * math.pi))[..., None, None] * each).sum(axis=-3)


def thresholds(counts: np.ndarray) -> np.ndarray:
    shares = np.clip(np.cumsum(counts / counts.sum())[:-1], 1e-6, 1 - 1e-6)
    return np.array([NormalDist().inv_cdf(float(x)) for x in shares])


def polychoric(table: np.ndarray) -> float:
    """The latent correlation of a table of counts, thresholds held at the margins; NaN if one is constant."""
    return float(polychoric_all(table[None])[0])


def polychoric_all(tables: np.ndarray) -> np.ndarray:
    """Of many tables; the searches for the likeliest correlations go side by side."""
    out = np.full(len(tables), math.nan)
    fit = np.flatnonzero([((t.sum(axis=1) > 0).sum() > 1) and ((t.sum(axis=0) > 0).sum() > 1) for t in tables])
    if not len(fit):
        return out
    tables = tables[fit]
    a, b = (np.stack([np.concatenate([[-9], thresholds(t.sum(axis=x)), [9]]) for t in tables]) for x in (1, 0))
    apart = _CDF(a)[:, :, None] * _CDF(b)[:, None, :]

    def loss(r: np.ndarray) -> np.ndarray:
        grid = apart + _beyond_independence(a, b, r)
        cells = np.diff(np.diff(grid, axis=1), axis=2)
        return -(tables * np.log(np.clip(cells, 1e-12, 1.0))).sum(axis=(1, 2))

    golden = (math.sqrt(5) - 1) / 2
    low, high = np.full(len(tables), -0.999), np.full(len(tables), 0.999)
    c, d = high - golden * (high - low), low + golden * (high - low)
    fc, fd = loss(c), loss(d)
    while (high - low).max() > 1e-5:
        left = fc < fd
        low, high = np.where(left, low, c), np.where(left, d, high)
        new = np.where(left, high - golden * (high - low), low + golden * (high - low))
        found = loss(new)
        c, d = np.where(left, new, d), np.where(left, c, new)
        fc, fd = np.where(left, found, fd), np.where(left, fc, found)
    out[fit] = (low + high) / 2
    return out


def pair_counts(items: DataFrame, cols: list[str], n_cat: int = 5) -> DataFrame:
    """i, j, x, y, n: how often columns i > j have the values x and y. A task sends on the cells of
    its own table, of which there are at most as many as pairs and values, whatever its rows."""

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = np.zeros((len(cols) * n_cat,) * 2)
        for batch in batches:
            marks = (batch[cols].to_numpy(float)[:, :, None] == np.arange(1, n_cat + 1)).reshape(len(batch), -1).astype(np.float32)
            sums += marks.T @ marks
        at = np.indices(sums.shape)
        keep = (sums > 0) & (at[0] // n_cat > at[1] // n_cat)
        yield pd.DataFrame({"i": at[0][keep] // n_cat, "j": at[1][keep] // n_cat, "x": at[0][keep] % n_cat, "y": at[1][keep] % n_cat, "n": sums[keep]})

    parts = items.select(*cols).mapInPandas(counted, "i int, j int, x int, y int, n long")
    return parts.groupBy("i", "j", "x", "y").agg(F.sum("n").alias("n"))


def polychoric_pairs(items: DataFrame, cols: list[str], n_cat: int = 5) -> DataFrame:
    """a, b, r of all pairs of columns; r is NaN where one is constant."""
    tables = pair_counts(items, cols, n_cat).groupBy("i", "j").agg(F.collect_list(F.struct("x", "y", "n")).alias("cells"))

    def fitted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            table = np.zeros((len(batch), n_cat, n_cat))
            for k, cells in enumerate(batch.cells):
                for cell in cells:
                    table[k, cell["x"], cell["y"]] = cell["n"]
            yield pd.DataFrame({"a": [cols[i] for i in batch.i], "b": [cols[j] for j in batch.j], "r": polychoric_all(table)})

    return tables.mapInPandas(fitted, "a string, b string, r double")


def polychoric_matrix(items: DataFrame, cols: list[str]) -> np.ndarray:
    """With 0 where a column is constant."""
    out = np.eye(len(cols))
    for row in polychoric_pairs(items, cols).collect():  # a row for each pair of columns
        i, j = cols.index(row.a), cols.index(row.b)
        out[i, j] = out[j, i] = 0.0 if row.r is None or math.isnan(row.r) else row.r
    return out


def ordinal_alpha(r: np.ndarray) -> float:
    """Of a correlation matrix: what its variances lack of the variance of the sum; NaN for one item."""
    items = len(r)
    return float(items / (items - 1) * (1 - np.trace(r) / r.sum())) if items > 1 else math.nan


def ordinal_omega(r: np.ndarray) -> float:
    """The share of the sum's variance that the first principal factor has, unique parts not negative."""
    roots, axes = np.linalg.eigh(r)
    common = max(roots[-1], 0.0) * np.outer(axes[:, -1], axes[:, -1])
    whole = common.sum() + np.maximum(1 - np.diag(common), 0).sum()
    return float(common.sum() / whole) if whole > 0 else math.nan


def reliability(items: DataFrame) -> list[dict]:
    """Per dimension Cronbach's alpha, ordinal alpha and omega."""
    plain = {r.dimension: r.alpha for r in cronbach(items).collect()}
    every = polychoric_matrix(items, ITEMS)
    out = []
    for k, d in enumerate(DIMENSIONS):
        r = every[5 * k : 5 * k + 5, 5 * k : 5 * k + 5]
        out.append({"dimension": d, "cronbach_alpha": round(plain[d], 3), "ordinal_alpha": round(float(ordinal_alpha(r)), 3), "ordinal_omega": round(float(ordinal_omega(r)), 3)})
    return out
