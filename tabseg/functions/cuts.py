"""Where numeric columns are cut, and into how many bins: uniform, quantile, density valleys, adaptive."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabseg.functions.profile import number
from tabseg.functions.quantiles import exact_quantiles


def sturges(n: int) -> int:
    return math.ceil(math.log2(n)) + 1 if n > 0 and float(math.log2(n)).is_integer() else math.ceil(math.log2(max(n, 1)) + 1)


def resolve_bins(k: int | str, n: int, low: int = 2, high: int = 10) -> int:
    return int(np.clip(sturges(n), low, high)) if k == "auto" else int(k)


def resolve_features(m: int | float | str, d: int) -> int:
    if m == "sqrt":
        m = math.ceil(math.sqrt(d))
    elif m == "log2":
        m = math.ceil(math.log2(d)) if d > 1 else 1
    elif isinstance(m, float):
        m = math.ceil(m * d)
    return int(min(max(m, 1), d))


def adaptive_bins(stats: dict, n: int, low: int = 2, high: int = 10, categorical: bool = False) -> int:
    """Bins of one column, more for widely spread and many-valued ones."""
    cap = max(min(high, sturges(n)), low)
    u = stats["n_unique"]
    if categorical:
        return int(np.clip(u, low, cap))
    if u <= 1:
        return low
    if 2 <= u <= math.isqrt(n) + 1:
        return int(np.clip(u, low, cap))
    span = stats["max"] - stats["min"]
    spread = min(2 * (stats["q75"] - stats["q25"]) / span, 1.0) if span > 0 else 0.0
    richness = min(u / (2 * math.sqrt(n)), 1.0)
    return int(np.clip(round(low + (cap - low) * (0.5 * spread + 0.5 * richness)), low, cap))


def categorical_cap(n_unique: int, n: int, low: int = 2, high: int = 10) -> int:
    return max(min(n_unique, min(high, sturges(n))), low)


def uniform_cuts(stats: dict, u: np.ndarray) -> list[float]:
    lo, hi = stats["min"] or 0.0, stats["max"] or 0.0
    return sorted(float(lo + x * (hi - lo)) for x in u)


def quantile_cuts(df: DataFrame, probs: dict[str, list[float]]) -> dict[str, list[float]]:
    return {c: sorted(x or 0.0 for x in q) for c, q in exact_quantiles(df.select(*[number(c).alias(c) for c in probs]), probs).items()}


#: Rows that the rules of thumb for bandwidths count at most, so that large tables are not cut along noise.
BANDWIDTH_ROWS = 5000


def bandwidth(x: np.ndarray, rule: str = "silverman", n: np.ndarray | None = None) -> float:
    """Of sorted values x that occur n times each. n^(-1/5) counts at most BANDWIDTH_ROWS rows."""
    n = np.ones(len(x)) if n is None else n
    rows = n.sum()
    mean = (n * x).sum() / rows
    s = float(np.sqrt((n * (x - mean) ** 2).sum() / (rows - 1))) if rows > 1 else 0.0
    q25, q75 = _quantiles(x, n, (0.25, 0.75))
    shrink = min(rows, BANDWIDTH_ROWS) ** -0.2
    if rule == "silverman":
        h = 0.9 * (min(s, (q75 - q25) / 1.34) if q75 > q25 else s) * shrink
    else:
        h = s * shrink
    return max(h, (x.max() - x.min()) * 1e-4)


def _quantiles(x: np.ndarray, n: np.ndarray, probs: tuple[float, ...]) -> list[float]:
    """Linearly interpolated quantiles of sorted values that occur n times each."""
    ends, out = np.cumsum(n), []
    for p in probs:
        h = (ends[-1] - 1) * p
        lo, hi = (x[min(np.searchsorted(ends, k, "right"), len(x) - 1)] for k in (np.floor(h), np.ceil(h)))
        out.append(float(lo + (hi - lo) * (h - np.floor(h))))
    return out


def _peaks(y: np.ndarray, least: float) -> list[int]:
    """Local maxima whose height above the higher of their side minima (up to a higher point) is at least `least`."""
    out = []
    for i in range(1, len(y) - 1):
        if not (y[i] > y[i - 1] and y[i] >= y[i + 1]):
            continue
        left = right = y[i]
        for j in range(i - 1, -1, -1):
            if y[j] > y[i]:
                break
            left = min(left, y[j])
        for j in range(i + 1, len(y)):
            if y[j] > y[i]:
                break
            right = min(right, y[j])
        if y[i] - max(left, right) >= least:
            out.append(i)
    return out


def density_cuts(x: np.ndarray, n_cuts: int, rng: np.random.Generator, rule: str = "silverman", n: np.ndarray | None = None) -> tuple[list[float], str]:
    """Cuts in the valleys of a Gaussian density estimate, and how they came about: kde, kde+uniform, uniform or quantile.

    x: values, or (with n, how often each occurs) the weighted points of a column. Too few distinct values: evenly chosen midpoints; a
    constant or flat distribution: uniform cuts. Surplus valleys are ranked by depth (0.7) and balance (0.3).
    """
    x = np.asarray(x, float)
    n = np.ones(len(x)) if n is None else np.asarray(n, float)
    use = np.isfinite(x)
    x, at = np.unique(x[use], return_inverse=True)
    n = np.bincount(at, n[use], len(x)) if len(x) else np.zeros(0)
    rows = n.sum()
    if len(x) <= 1:
        return [float(x[0]) if len(x) else 0.0] * n_cuts, "uniform"
    if rows <= 5 or len(x) <= n_cuts + 1:
        mid = (x[1:] + x[:-1]) / 2
        return [float(mid[i]) for i in np.linspace(0, len(mid) - 1, n_cuts).round().astype(int)], "quantile"

    def uniform(k: int) -> list[float]:
        return sorted(float(v) for v in x[0] + rng.random(k) * (x[-1] - x[0]))

    h = bandwidth(x, rule, n)
    grid = np.linspace(x[0] - 3 * h, x[-1] + 3 * h, int(np.clip(rows, 256, 2048)))
    y = np.zeros(len(grid))
    for part in np.array_split(np.arange(len(x)), max(len(x) // 512, 1)):
        y += np.exp(-0.5 * ((grid[:, None] - x[part]) / h) ** 2) @ n[part]
    y /= rows * h * math.sqrt(2 * math.pi)
    if y.max() / y.mean() < 1 + 2 * min(rows, BANDWIDTH_ROWS) ** -0.2:
        return uniform(n_cuts), "uniform"
    tops = _peaks(y, 0.02 * y.max())
    tops = sorted(sorted(tops, key=lambda i: -y[i])[:50])
    if len(tops) < 2:
        return uniform(n_cuts), "uniform"
    valleys = [a + int(np.argmin(y[a : b + 1])) for a, b in zip(tops, tops[1:])]
    inner = [v for v in valleys if x[0] + h < grid[v] < x[-1] - h]
    valleys = inner or valleys
    if len(valleys) > n_cuts:
        def score(v: int) -> float:
            left, right = max(y[t] for t in tops if t < v), max(y[t] for t in tops if t > v)
            share = n[: np.searchsorted(x, grid[v])].sum() / rows
            return 0.7 * (1 - y[v] / min(left, right)) + 0.3 * 2 * min(share, 1 - share)

        valleys = sorted(valleys, key=score, reverse=True)[:n_cuts]
    cuts = sorted(float(grid[v]) for v in valleys)
    return (cuts, "kde") if len(cuts) == n_cuts else (sorted(cuts + uniform(n_cuts - len(cuts))), "kde+uniform")


#: Parts of the range of a column into which its values are summed up for a density.
POINTS = 4096


def weighted_points(df: DataFrame, col: str) -> tuple[np.ndarray, np.ndarray]:
    """The finite values of a column as at most POINTS + 1 points (means of equal parts of the range) and their counts: all rows, one aggregation."""
    x = df.select(number(col).alias("x")).where(F.col("x").isNotNull())
    r = x.agg(F.min("x").alias("a"), F.max("x").alias("b")).first()
    if r["a"] is None:
        return np.zeros(0), np.zeros(0)
    width = (r["b"] / 2 - r["a"] / 2) / POINTS or 1.0
    got = x.groupBy(F.floor((F.col("x") / 2 - F.lit(r["a"] / 2)) / F.lit(width)).alias("part")).agg(F.avg("x").alias("v"), F.count("*").alias("n")).toPandas()
    return got["v"].to_numpy(float), got["n"].to_numpy(float)
