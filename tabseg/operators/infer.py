"""Significance of clusterings: permutation and bootstrap tests, corrections for many tests, effect sizes."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tabseg.operators import metrics
from tabseg.session import broadcast_if_small, hash32, materialise, poisson, positions


def ari_effect(x: Column) -> Column:
    return F.when(x <= 0, "none").when(x <= 0.1, "small").when(x <= 0.25, "medium").otherwise("large")


def silhouette_effect(x: Column) -> Column:
    return F.when(x < 0, "poor").when(x < 0.25, "weak").when(x < 0.5, "moderate").when(x < 0.7, "strong").otherwise("very strong")


def _p(null: np.ndarray, observed: float, alternative: str) -> float:
    if alternative == "less":
        hits = (null <= observed + 1e-12).sum()
    elif alternative == "two-sided":
        hits = (np.abs(null - null.mean()) >= abs(observed - null.mean()) - 1e-12).sum() if len(null) else 0
    else:
        hits = (null >= observed - 1e-12).sum()
    return (1 + int(hits)) / (len(null) + 1)


def permuted_ari(df: DataFrame, id_col: str, a: str, b: str, rounds: int, seed: int = 0) -> DataFrame:
    """(round, ari): round 0 as it is, the others with column b dealt anew in the order of a hash.

    Only the counts of b matter, so each round hands the sorted b values to the rows in hash order: two
    positions and a range lookup, one job for all rounds.
    """
    x = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.col(id_col).alias("id"), F.col(a).alias("a"), F.col(b).alias("b"))
    x = materialise(x)
    # the rows in order of b, numbered: what stands at a position of the hash order gets the b at the same position
    number = F.row_number().over(Window.orderBy("b"))
    codes = materialise(x.groupBy("b").agg(F.count("*").alias("n")).withColumn("code", number))
    order = codes.withColumn("to", F.sum("n").over(Window.orderBy("code").rowsBetween(Window.unboundedPreceding, 0)))
    # spans of b are joined by blocks of positions, of which each span lists those that it reaches
    total = x.count()
    step = max(total // 1024, 1)
    spans = order.select("b", (F.col("to") - F.col("n")).alias("from"), "to").withColumn("block", F.explode(F.sequence(F.floor(F.col("from") / step), F.floor((F.col("to") - 1) / step))))
    each = x.select("id", "a", F.explode(F.sequence(F.lit(1), F.lit(rounds))).alias("round"))
    placed = positions(each.withColumn("h", hash32(F.concat_ws(":", "id", "round"), f"perm:{seed}")), ["round"], "h", "id").withColumn("block", F.floor(F.col("position") / step))
    dealt = placed.join(broadcast_if_small(spans), "block").where((F.col("position") >= F.col("from")) & (F.col("position") < F.col("to"))).select("round", "a", "b")
    table = dealt.groupBy("round", "a", "b").agg(F.count("*").alias("n"))
    real = x.groupBy("a", "b").agg(F.count("*").alias("n")).select(F.lit(0).alias("round"), "a", "b", "n")
    return metrics.ari(real.unionByName(table), ["round"]).select("round", "ari")


def permutation_test(df: DataFrame, id_col: str, a: str, b: str, rounds: int = 200, alternative: str = "greater", seed: int = 0) -> dict:
    """Observed ARI, its p-value under independence, and the mean, deviation and 95 % interval of the null distribution."""
    rows = {r["round"]: r["ari"] for r in permuted_ari(df, id_col, a, b, rounds, seed).collect()}
    observed = rows.pop(0, 1.0)
    null = np.array([rows[k] for k in sorted(rows)])
    lo, hi = np.percentile(null, [2.5, 97.5]) if len(null) else (0.0, 0.0)
    return {"ari": observed, "p_value": _p(null, observed, alternative), "null_mean": float(null.mean()) if len(null) else 0.0, "null_std": float(null.std()) if len(null) else 0.0, "null_low": float(lo), "null_high": float(hi)}


def paired_test(df: DataFrame, id_col: str, truth: str, a: str, b: str, rounds: int = 200, seed: int = 0) -> dict:
    """Whether labeling a agrees with the truth better than b: labels are swapped per row with probability one half."""
    x = df.select(F.col(id_col).alias("id"), F.col(truth).alias("t"), F.col(a).cast("string").alias("x"), F.col(b).cast("string").alias("y")).where(F.col("t").isNotNull() & F.col("x").isNotNull() & F.col("y").isNotNull())
    each = materialise(x).select("*", F.explode(F.sequence(F.lit(0), F.lit(rounds))).alias("round"))
    swap = (F.col("round") > 0) & (F.pmod(hash32(F.concat_ws(":", "id", "round"), f"swap:{seed}"), F.lit(2)) == 0)
    each = each.select("round", "t", F.when(swap, F.col("y")).otherwise(F.col("x")).alias("x"), F.when(swap, F.col("x")).otherwise(F.col("y")).alias("y"))
    first = metrics.ari(metrics.contingency(each, "t", "x", ["round"]), ["round"]).select("round", F.col("ari").alias("ax"))
    second = metrics.ari(metrics.contingency(each, "t", "y", ["round"]), ["round"]).select("round", F.col("ari").alias("ay"))
    rows = {r["round"]: r["ax"] - r["ay"] for r in first.join(second, "round").collect()}
    observed = rows.pop(0, 0.0)
    return {"difference": observed, "p_value": _p(np.abs(np.array(list(rows.values()))), abs(observed), "greater")}


def bootstrap_ari(df: DataFrame, id_col: str, truth: str, label: str, rounds: int = 200, level: float = 0.95, seed: int = 0, refit: Callable[[DataFrame], DataFrame] | None = None) -> dict:
    """ARI with a bootstrap interval. Rows get Poisson(1) counts by hash, so a resample is one aggregation; refit (id, label) recomputes labels per resample."""
    if refit is not None:
        values = []
        for r in range(rounds):
            # a row that is drawn n times enters n times
            part = df.withColumn("__times", poisson(F.col(id_col), f"boot:{seed}:{r}")).where("__times > 0").withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__times")))).drop("__times", "__copy")
            got = refit(part).select("id", F.col("label").alias("__label")).dropDuplicates(["id"])
            values.append(metrics.ari(metrics.contingency(part.join(got, part[id_col] == got["id"]), truth, "__label")).first()["ari"])
        null, observed = np.array(values), metrics.ari(metrics.contingency(df, truth, label)).first()["ari"]
    else:
        x = df.select(F.col(id_col).alias("id"), F.col(truth).alias("a"), F.col(label).alias("b")).where("a IS NOT NULL AND b IS NOT NULL")
        each = x.select("*", F.explode(F.sequence(F.lit(0), F.lit(rounds))).alias("round"))
        count = poisson(F.concat_ws(":", "id", "round"), f"boot:{seed}")
        n = F.when(F.col("round") == 0, 1).otherwise(count)
        table = each.withColumn("n", n).groupBy("round", "a", "b").agg(F.sum("n").alias("n")).where("n > 0")
        rows = {r["round"]: r["ari"] for r in metrics.ari(table, ["round"]).collect()}
        observed = rows.pop(0, 1.0)
        null = np.array(list(rows.values()))
    lo, hi = np.percentile(null, [50 * (1 - level), 50 * (1 + level)]) if len(null) else (observed, observed)
    return {"ari": observed, "low": float(lo), "high": float(hi)}


def cluster_significance(silhouettes: DataFrame, rounds: int = 200, correction: str = "fdr_bh", alpha: float = 0.05, seed: int = 0) -> DataFrame:
    """(label, n, mean, p_value, adjusted, significant): bootstrap of each cluster's mean silhouette above 0; under 3 rows it can't be tested.

    silhouettes: id, label, silhouette. Poisson bootstrap: one aggregation over rows x rounds, n stays per cluster.
    """
    each = silhouettes.select("id", "label", "silhouette", F.explode(F.sequence(F.lit(1), F.lit(rounds))).alias("round"))
    count = poisson(F.concat_ws(":", "id", "round"), f"sig:{seed}")
    means = each.groupBy("label", "round").agg((F.sum(count * F.col("silhouette")) / F.sum(count)).alias("m"))
    p = means.groupBy("label").agg(((1 + F.count_if(F.coalesce("m", F.lit(0.0)) <= 0)) / (rounds + 1)).alias("p"))
    per = silhouettes.groupBy("label").agg(F.count("*").alias("n"), F.avg("silhouette").alias("mean")).join(p, "label")
    per = per.withColumn("p_value", F.when(F.col("n") >= 3, F.col("p")))
    tested = adjust(per.where("p_value IS NOT NULL").select("label", "p_value"), correction, alpha)
    return per.join(tested.drop("p_value"), "label", "left").select("label", "n", "mean", "p_value", "adjusted", F.coalesce("reject", F.lit(False)).alias("significant"))


def adjust(tests: DataFrame, method: str = "fdr_bh", alpha: float = 0.05) -> DataFrame:
    """tests with `adjusted` and `reject`; tests: p_value and any keys, one row per test (a small table). bonferroni, sidak or fdr_bh."""
    n = tests.agg(F.count("*").alias("m"))
    x = tests.crossJoin(F.broadcast(n))
    if method == "bonferroni":
        adjusted = F.least(F.col("p_value") * F.col("m"), F.lit(1.0))
    elif method == "sidak":
        adjusted = 1 - F.pow(1 - F.col("p_value"), F.col("m"))
    elif method == "fdr_bh":
        keys = [c for c in tests.columns if c != "p_value"]
        x = x.withColumn("rank", F.row_number().over(Window.orderBy("p_value", *keys)))
        raw = F.col("p_value") * F.col("m") / F.col("rank")
        adjusted = F.least(F.min(raw).over(Window.orderBy(F.desc("rank")).rowsBetween(Window.unboundedPreceding, 0)), F.lit(1.0))
    else:
        raise ValueError(f"unknown correction {method!r}")
    return x.withColumn("adjusted", adjusted).withColumn("reject", F.col("adjusted") <= alpha).drop("m", "rank")
