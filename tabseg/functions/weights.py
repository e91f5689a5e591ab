"""Weights of features and of iterations: correlation groups, weighted picks, entropy and Gini weights."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tabseg.functions.profile import number
from tabseg.functions.quantiles import exact_quantiles
from tabseg.session import broadcast_if_small


def pearson(df: DataFrame, cols: list[str], impute: bool = True) -> dict[tuple[str, str], float]:
    """Correlations of all pairs of columns in one pass (missing values by the median); constants: 0."""
    x = df.select(*[number(c).alias(c) for c in cols])
    if impute:
        m = exact_quantiles(x, {c: [0.5] for c in cols})
        x = x.select(*[F.coalesce(F.col(c), F.lit(m[c][0] if m[c][0] is not None else 0.0)).alias(c) for c in cols])
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1 :]]
    if not pairs:
        return {}
    r = x.agg(*[F.corr(a, b).alias(f"r{i}") for i, (a, b) in enumerate(pairs)]).first()
    return {p: 0.0 if r[f"r{i}"] is None or np.isnan(r[f"r{i}"]) else float(r[f"r{i}"]) for i, p in enumerate(pairs)}


#: Distinct values of a span of `average_ranks`.
SPAN_VALUES = 20_000


def average_ranks(df: DataFrame, col: str) -> DataFrame:
    """(v, rank) of every distinct finite value: ranks from 1, equal values share the mean of theirs.

    Ranks are running sums over distinct values inside spans, plus what lies in the spans before. The spans' ends are
    approximate quantiles of the distinct values, as many as keep a span small; so no task sees the whole column.
    """
    per = df.select(number(col).alias("v")).where(F.col("v").isNotNull()).groupBy("v").agg(F.count("*").alias("n"))
    parts = int(min(max(per.count() // SPAN_VALUES, 1), 4096))
    ends = sorted(set(per.agg(F.percentile_approx("v", [i / parts for i in range(1, parts)], 10_000).alias("e")).first()["e"] or [])) if parts > 1 else []
    part = F.size(F.filter(F.array(*[F.lit(float(e)) for e in ends]), lambda e: e <= F.col("v"))) if ends else F.lit(0)
    cut = per.withColumn("part", part)
    before = cut.groupBy("part").agg(F.sum("n").alias("in_part"))
    start = before.select("part", F.coalesce(F.sum("in_part").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"))
    inner = F.sum("n").over(Window.partitionBy("part").orderBy("v"))
    return cut.withColumn("upto", inner).join(F.broadcast(start), "part").select("v", (F.col("start") + F.col("upto") - (F.col("n") - 1) / 2).alias("rank"))


def spearman(df: DataFrame, cols: list[str], sample: float | None = None, seed: int = 0) -> dict[tuple[str, str], float]:
    """Rank correlations over all rows, or over a share of them."""
    x = df.select(*[number(c).alias(c) for c in cols])
    if sample is not None:  # by a hash of the values, so that partitions don't matter
        x = x.where(F.pmod(F.xxhash64(*cols, F.lit(seed)), F.lit(1_000_000)) < int(1e6 * sample))
    for c in cols:
        ranks = average_ranks(x, c).withColumnRenamed("v", "__v").withColumnRenamed("rank", "__rank")
        x = x.join(broadcast_if_small(ranks), x[c] == F.col("__v"), "left").drop("__v").withColumn(c, F.col("__rank")).drop("__rank")
    return pearson(x, cols, impute=False)


def groups_of(cols: list[str], corr: dict[tuple[str, str], float], threshold: float) -> list[list[str]]:
    """Connected components of the columns whose absolute correlation exceeds the threshold, in order of columns."""
    label = {c: i for i, c in enumerate(cols)}
    for (a, b), r in corr.items():
        if abs(r) > threshold and label[a] != label[b]:
            old, new = max(label[a], label[b]), min(label[a], label[b])
            label = {c: new if v == old else v for c, v in label.items()}
    out: dict[int, list[str]] = {}
    for c in cols:
        out.setdefault(label[c], []).append(c)
    return [sorted(v) for v in out.values()]


def group_weights(cols: list[str], corr: dict[tuple[str, str], float], threshold: float = 0.9) -> dict[str, float]:
    """1 / size of the column's correlation group."""
    return {c: 1.0 / len(g) for g in groups_of(cols, corr, threshold) for c in g}


def weighted_pick(weights: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """k of the items without replacement, in proportion to weight (Gumbel top-k); items without weight last."""
    noise = rng.gumbel(size=len(weights))
    with np.errstate(divide="ignore"):
        return np.sort(np.argsort(-(np.log(np.maximum(weights, 0)) + noise), kind="stable")[: min(k, len(weights))])


def pick_across_groups(cols: list[str], groups: list[list[str]], weights: dict[str, float], k: int, rng: np.random.Generator) -> list[str]:
    """At most one column (the heaviest) per correlation group, groups drawn by weight; the rest is filled by weight."""
    heads = [max(g, key=lambda c: weights[c]) for g in groups]
    mass = np.array([max(weights[c] for c in g) for g in groups])
    chosen = [heads[i] for i in weighted_pick(mass, k, rng)]
    left = [c for c in cols if c not in chosen]
    if len(chosen) < k and left:
        chosen += [left[i] for i in weighted_pick(np.array([weights[c] for c in left]), k - len(chosen), rng)]
    return sorted(chosen, key=cols.index)


def cell_histogram(cells: DataFrame) -> DataFrame:
    """(l, cell, n) from long cells (id, l, cell)."""
    return cells.groupBy("l", "cell").agg(F.count("*").alias("n"))


def raw_iteration_weights(cells: DataFrame, kind: str = "entropy") -> DataFrame:
    """(l, n_cells, raw): normalised entropy or Gini impurity of each iteration's cells, 0 where there is one cell."""
    h = cell_histogram(cells).withColumn("total", F.sum("n").over(Window.partitionBy("l"))).withColumn("p", F.col("n") / F.col("total"))
    per = h.groupBy("l").agg(F.count("*").alias("n_cells"), F.first("total").alias("total"), F.sum(-F.col("p") * F.ln("p")).alias("entropy"), F.sum(F.col("p") * F.col("p")).alias("same"))
    if kind == "uniform":
        raw = F.lit(1.0)
    elif kind == "entropy":
        raw = F.when(F.col("n_cells") > 1, F.col("entropy") / F.ln(F.col("n_cells"))).when(F.col("total") == 1, 1.0).otherwise(0.0)
    else:
        raw = F.when((F.col("n_cells") > 1) & (F.col("total") > 1), (1 - F.col("same")) / (1 - 1 / F.least("total", "n_cells"))).when(F.col("total") == 1, 1.0).otherwise(0.0)
    return per.select("l", "n_cells", (F.greatest(raw, F.lit(0.0)) + 0.0).alias("raw"))


def tempered(raw: np.ndarray, temperature: float | None = None) -> np.ndarray:
    """Weights of mean 1: raw^(1/T), blended towards 1 for T > 1 (T is kept within 0.1..10). All zero: ones if T is given, else zeros."""
    raw = np.asarray(raw, float)
    if temperature is not None and not temperature > 0:
        raise ValueError("temperature must be positive")
    t = float(np.clip(1.0 if temperature is None else temperature, 0.1, 10.0))
    w = raw ** (1 / t)
    if t > 1:
        w = w / t + (1 - 1 / t)
    if w.mean() > 0:
        return w / w.mean()
    return np.ones(len(raw)) if temperature is not None else np.zeros(len(raw))


def iteration_weights(cells: DataFrame, n_iterations: int, kind: str = "entropy", temperature: float | None = None) -> np.ndarray:
    out = np.zeros(n_iterations)
    for r in raw_iteration_weights(cells, kind).collect():
        out[r["l"]] = r["raw"]
    return np.ones(n_iterations) if kind == "uniform" else tempered(out, temperature)
