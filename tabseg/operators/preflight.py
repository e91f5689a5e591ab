"""Is there anything to cluster? Hopkins statistic, gap statistic, and the verdict from both."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabseg.session import hash32, materialise, uniform


def _gap2(cols: list[str], other: list[str]) -> Column:
    return sum(((F.col(a) - F.col(b)) ** 2 for a, b in zip(cols, other)), F.lit(0.0))


def hopkins(points: DataFrame, cols: list[str], m: int | None = None, seed: int = 44) -> float:
    """sum u / (sum u + sum w): distances of m random places and of m random rows to their nearest row.

    0.5 for fewer than two rows or identical ones. The m probes (a bounded set) are sent to all rows, and only
    the minimum per probe is shuffled.
    """
    x = materialise(points.select("id", *cols))
    r = x.agg(F.count("*").alias("n"), *[f(c).alias(f"{k}{i}") for i, c in enumerate(cols) for k, f in (("a", F.min), ("b", F.max))]).first()
    n = r["n"]
    if n < 2 or all(r[f"a{i}"] == r[f"b{i}"] for i in range(len(cols))):
        return 0.5
    m = m or max(2, min(100, n // 10))
    spark = points.sparkSession
    draws = spark.range(m).select(F.col("id").alias("probe"), *[(F.lit(r[f"a{i}"]) + uniform(F.col("id"), f"hopkins:{seed}:{i}") * F.lit(r[f"b{i}"] - r[f"a{i}"])).alias(f"p{i}") for i in range(len(cols))], F.lit(None).cast("bigint").alias("self"))
    rows = x.orderBy(hash32(F.col("id"), f"hopkins:{seed}"), "id").limit(m).select(F.col("id").alias("probe"), *[F.col(c).cast("double").alias(f"p{i}") for i, c in enumerate(cols)], F.col("id").alias("self"))
    probes = draws.withColumn("kind", F.lit("u")).unionByName(rows.withColumn("kind", F.lit("w")))
    near = x.join(F.broadcast(probes), ~F.col("id").eqNullSafe(F.col("self"))).groupBy("kind", "probe").agg(F.min(F.sqrt(_gap2(cols, [f"p{i}" for i in range(len(cols))]))).alias("d"))
    sums = {s["kind"]: s["d"] for s in near.groupBy("kind").agg(F.sum("d").alias("d")).collect()}
    u, w = sums.get("u", 0.0), sums.get("w", 0.0)
    return u / (u + w) if u + w > 0 else 0.5


def _within(points: DataFrame, cols: list[str], k: int, seed: int) -> float:
    """Sum of squares within k clusters over n: by moments for k = 1."""
    r = points.agg(F.count("*").alias("n"), sum((F.sum(F.col(c) * F.col(c)) - F.sum(c) * F.sum(c) / F.count("*") for c in cols), F.lit(0.0)).alias("sse")).first()
    if k == 1:
        return max(r["sse"], 0.0) / r["n"]
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler

    x = VectorAssembler(inputCols=cols, outputCol="features").transform(points.select(*cols))
    return KMeans(k=k, seed=seed, maxIter=15).fit(x).summary.trainingCost / r["n"]


def gap_statistic(points: DataFrame, cols: list[str], k_max: int = 4, draws: int = 3, seed: int = 44) -> dict:
    """gap and s per k from 1, and best_k: the first k whose gap is at least the next one less its s. Reference sets are uniform in the box."""
    x = materialise(points.select("id", *[F.col(c).cast("double").alias(c) for c in cols]))
    r = x.agg(F.count("*").alias("n"), *[f(c).alias(f"{k}{i}") for i, c in enumerate(cols) for k, f in (("a", F.min), ("b", F.max))]).first()
    if not r["n"] or all(r[f"a{i}"] == r[f"b{i}"] for i in range(len(cols))):
        return {"gap": [0.0], "s": [0.0], "best_k": 1}
    k_max = min(k_max, r["n"])
    boxes = [materialise(x.select("id", *[(F.lit(r[f"a{i}"]) + uniform(F.col("id"), f"gap:{seed}:{b}:{i}") * F.lit(r[f"b{i}"] - r[f"a{i}"])).alias(c) for i, c in enumerate(cols)])) for b in range(draws)]
    gap, s = [], []
    for k in range(1, k_max + 1):
        own = math.log(max(_within(x, cols, k, seed), 1e-300))
        null = np.array([math.log(max(_within(b, cols, k, seed), 1e-300)) for b in boxes])
        gap.append(float(null.mean() - own))
        s.append(float(null.std() * math.sqrt(1 + 1 / draws)))
    best = next((k for k in range(1, k_max) if gap[k - 1] >= gap[k] - s[k]), k_max)
    return {"gap": gap, "s": s, "best_k": best}


def clusterable(points: DataFrame, cols: list[str], k_max: int = 4, seed: int = 44) -> dict:
    """Both tests and the verdict: clusterable only if both say so."""
    h = hopkins(points, cols, seed=seed)
    g = gap_statistic(points, cols, k_max, seed=seed)
    n = points.count()
    by_h, by_g = h > (0.55 if n >= 10 else 0.5), g["best_k"] > 1
    text = "both tests find clusters" if by_h and by_g else "no clusters" if not by_h and not by_g else "the tests disagree; treated as not clusterable"
    return {"hopkins": h, "best_k": g["best_k"], "clusterable": by_h and by_g, "text": text}
