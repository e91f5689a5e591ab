"""Diagnostics of a clustering: summary, health checks, uncertain rows, stability, comparison of clusterings."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabseg.operators import metrics, pairs
from tabseg.session import broadcast_if_small, forget, materialise, normal, uniform


def affinities(cells: DataFrame, labels: DataFrame, id_col: str, weights: list[float] | None = None) -> DataFrame:
    """(id, label, own_affinity, second_label, second_affinity, margin): mean similarity to the own cluster (itself included) and to the best other (null: it shares no cell with any)."""
    s = pairs.overlaps(cells, labels, id_col, weights)
    own = F.col("own") == F.col("cluster")
    x = s.groupBy("id", F.col("own").alias("label")).agg(F.max(F.when(own, F.col("similarity"))).alias("own_affinity"), F.min(F.when(~own, F.struct((-F.col("similarity")).alias("less"), "cluster"))).alias("b"))
    return x.select("id", "label", "own_affinity", F.col("b.cluster").alias("second_label"), (-F.col("b.less")).alias("second_affinity"), (F.col("own_affinity") + F.coalesce(F.col("b.less"), F.lit(0.0))).alias("margin"))


def uncertain(cells: DataFrame, labels: DataFrame, id_col: str, n: int = 20, weights: list[float] | None = None) -> DataFrame:
    """The n rows with the lowest silhouette, then the smallest margin."""
    sil = metrics.hamming_silhouette(cells, labels, id_col, weights).select("id", "silhouette")
    # to nine decimals, so that what is equal but for the order of additions is a tie
    return affinities(cells, labels, id_col, weights).join(sil, "id").orderBy(F.round("silhouette", 9), F.round("margin", 9), "id").limit(n)


def summary(cells: DataFrame, labels: DataFrame, id_col: str, weights: list[float] | None = None) -> dict:
    """Sizes, silhouette, similarity within and between clusters. Label -1 is noise: no cluster, but counted in shares."""
    sil = materialise(metrics.hamming_silhouette(cells, labels, id_col, weights))
    per = {r["label"]: r for r in sil.groupBy("label").agg(F.count("*").alias("n"), F.avg("silhouette").alias("s"), F.avg((F.col("silhouette") < 0).cast("double")).alias("negative")).collect()}
    n = sum(r["n"] for r in per.values())
    real = {k: r for k, r in per.items() if k != -1}
    # mean over rows and clusters: of the rows with company for the inside, of all pairs of a row and another cluster for the outside
    blocks = pairs.block_means(cells, labels, id_col, weights).join(labels.groupBy(F.col("label").alias("own")).agg(F.count("*").alias("rows")), "own")
    sims = {r["inside"]: r["s"] for r in blocks.where("similarity IS NOT NULL").groupBy((F.col("own") == F.col("cluster")).alias("inside")).agg((F.sum(F.col("similarity") * F.col("rows")) / F.sum("rows")).alias("s")).collect()}
    return {
        "n": n, "n_clusters": len(real), "min_size": min((r["n"] for r in real.values()), default=0), "max_share": max((r["n"] for r in per.values()), default=0) / max(n, 1),
        "noise_share": (per[-1]["n"] if -1 in per else 0) / max(n, 1), "silhouette": sum(r["n"] * r["s"] for r in per.values()) / max(n, 1), "negative_share": sum(r["n"] * r["negative"] for r in per.values()) / max(n, 1),
        "within": sims.get(True) or 0.0, "between": sims.get(False) or 0.0,
    }


#: Where a health check begins to warn.
DOMINANT, SMALL, NEGATIVE, SEPARATION = 0.80, 5, 0.20, 1.20


def health_checks(s: dict) -> list[tuple[str, str, str]]:
    """(check, status, message)."""
    ratio = s["within"] / s["between"] if s["between"] > 0 else float("inf")
    return [
        ("clusters", "error" if s["n_clusters"] < 2 else "ok", f"{s['n_clusters']} clusters"),
        ("dominant cluster", "warning" if s["max_share"] >= DOMINANT else "ok", f"largest share {s['max_share']:.3f}"),
        ("small cluster", "warning" if s["min_size"] < SMALL else "ok", f"smallest cluster {s['min_size']} rows"),
        ("misplaced rows", "warning" if s["negative_share"] >= NEGATIVE else "ok", f"{s['negative_share']:.3f} of the rows with negative silhouette"),
        ("separation", "warning" if ratio < SEPARATION else "ok", f"within/between similarity {ratio:.3f}"),
    ]


def stability(df: DataFrame, id_col: str, cluster: Callable[[DataFrame, int], DataFrame], runs: int = 3, fraction: float = 0.8, seed: int = 0) -> DataFrame:
    """(run_a, run_b, n, ari, nmi) of pairs of runs on resampled rows, over their common rows. cluster(rows, seed) -> (id, label)."""
    got = [materialise(cluster(df.where(uniform(F.col(id_col), f"stability:{seed + r}") < fraction) if fraction < 1 else df, seed + r).select("id", "label")) for r in range(runs)]
    rows = []
    for i in range(runs):
        for j in range(i + 1, runs):
            t = materialise(metrics.contingency(got[i].withColumnRenamed("label", "x").join(got[j].withColumnRenamed("label", "y"), "id"), "x", "y"))
            a = metrics.ari(t).first()
            rows.append((i, j, a["n"], float(a["ari"]), float(metrics.nmi(t).first()["nmi"])))
    return df.sparkSession.createDataFrame(rows, "run_a int, run_b int, n bigint, ari double, nmi double")


def compare(labelings: dict[str, DataFrame], cells: DataFrame, id_col: str) -> tuple[DataFrame, DataFrame]:
    """(ranking: name, n_clusters, silhouette, rank; agreement: a, b, ari) of several clusterings (id, label) of the same rows."""
    spark = cells.sparkSession
    rows = []
    for name, labels in labelings.items():
        renamed = labels.withColumnRenamed("id", id_col) if id_col != "id" else labels
        s = summary(cells, renamed, id_col)
        rows.append((name, s["n_clusters"], s["silhouette"]))
    order = sorted(rows, key=lambda r: (-r[2], r[0]))
    agree = []
    names = list(labelings)
    for i, a in enumerate(names):
        for b in names[i + 1 :]:
            t = labelings[a].withColumnRenamed("label", "x").join(labelings[b].withColumnRenamed("label", "y"), "id")
            agree.append((a, b, float(metrics.ari(metrics.contingency(t, "x", "y")).first()["ari"])))
    return spark.createDataFrame([(*r, i + 1) for i, r in enumerate(order)], "name string, n_clusters int, silhouette double, rank int"), spark.createDataFrame(agree, "a string, b string, ari double")


def plane(points: DataFrame, cols: list[str]) -> DataFrame:
    """(id, x, y): the first two principal components, for plots."""
    from pyspark.ml.feature import PCA, VectorAssembler
    from pyspark.ml.functions import vector_to_array

    mean = points.agg(*[F.avg(c).alias(c) for c in cols]).first()
    centred = points.select("id", *[(F.col(c) - F.lit(mean[c] or 0.0)).alias(c) for c in cols])
    v = VectorAssembler(inputCols=cols, outputCol="v").transform(centred)
    p = PCA(k=min(2, len(cols)), inputCol="v", outputCol="p").fit(v).transform(v).select("id", vector_to_array("p").alias("p"))
    return p.select("id", F.get("p", F.lit(0)).alias("x"), F.get("p", F.lit(1)).alias("y"))


def sparse_plane(cells: DataFrame, id_col: str, weights: np.ndarray | None = None, steps: int = 12, seed: int = 42) -> DataFrame:
    """(id, x, y): the two leading singular directions of the one-hot cells, without making them dense or centring them (truncated SVD).

    Orthogonal iteration: each step multiplies all rows with two directions and adds the rows up by those scores, two aggregations over cells.
    """
    from tabseg.operators import embed

    long = materialise(embed.long_cells(cells, id_col))
    keys = long.groupBy("l", "cell").agg(F.count("*").alias("n"))
    length = int((cells.select(F.size("cells")).first() or [1])[0])
    scale = embed.scaled(np.ones(length) if weights is None else weights)
    at = F.element_at(F.array(*[F.lit(float(v)) for v in scale]), F.col("l") + 1)
    v = materialise(keys.select("l", "cell", *[normal(F.concat_ws(":", "l", "cell"), f"plane:{seed}:{i}").alias(f"v{i}") for i in range(2)]))
    for step in range(steps + 1):
        rows = long.join(broadcast_if_small(v), ["l", "cell"]).groupBy("id").agg(*[F.sum(at * F.col(f"v{i}")).alias(f"u{i}") for i in range(2)])
        if step == steps:
            return rows.select("id", F.col("u0").alias("x"), F.col("u1").alias("y"))
        back = long.join(rows, "id").groupBy("l", "cell").agg(*[(F.first(at) * F.sum(f"u{i}")).alias(f"v{i}") for i in range(2)])
        back = materialise(back)
        g = back.agg(F.sum(F.col("v0") ** 2).alias("a"), F.sum(F.col("v0") * F.col("v1")).alias("c"), F.sum(F.col("v1") ** 2).alias("b")).first()
        a, c = max(g["a"] or 0.0, 1e-300), g["c"] or 0.0
        rest = max((g["b"] or 0.0) - c * c / a, 1e-300)
        new = materialise(back.select("l", "cell", (F.col("v0") / a**0.5).alias("v0"), ((F.col("v1") - F.col("v0") * (c / a)) / rest**0.5).alias("v1")))
        forget(back, v)
        v = new


def diagnostics(df: DataFrame, cells: DataFrame, labels: DataFrame, id_col: str, numeric: list[str], categorical: list[str], weights: list[float] | None = None, uncertain_rows: int = 20) -> dict[str, object]:
    """The whole report: summary (dict) and checks (list), and the tables behind its plots: sizes, silhouettes, blocks (similarity heat map),
    numeric_profile, category_profile, cards, uncertain, plane. labels: id_col, label."""
    from tabseg.operators import explain

    said = summary(cells, labels, id_col, weights)
    x = df.join(labels.select(id_col, F.col("label").alias("__label")), id_col)
    return {
        "summary": said, "checks": health_checks(said), "sizes": explain.cluster_sizes(labels.select("label")), "silhouettes": metrics.hamming_silhouette(cells, labels, id_col, weights),
        "blocks": pairs.block_means(cells, labels, id_col, weights), "numeric_profile": explain.numeric_profile(x, "__label", numeric) if numeric else None,
        "category_profile": explain.category_profile(x, "__label", categorical) if categorical else None, "cards": explain.cards(x, "__label", numeric, categorical),
        "uncertain": uncertain(cells, labels, id_col, uncertain_rows, weights), "plane": sparse_plane(cells, id_col, None if weights is None else np.asarray(weights)),
    }


def histogram(df: DataFrame, col: str, bins: int = 20, by: str | None = None) -> DataFrame:
    """(by, bin, low, high, n): equal-width counts of a numeric column, the data of a bar plot; a value at the upper end falls into the last bin."""
    r = df.agg(F.min(col).cast("double").alias("a"), F.max(col).cast("double").alias("b")).first()
    lo, width = (r["a"] or 0.0), (((r["b"] or 0.0) - (r["a"] or 0.0)) / bins or 1.0)
    keys = [F.col(by).alias("by")] if by else []
    x = df.where(F.col(col).isNotNull()).select(*keys, F.least(F.floor((F.col(col) - lo) / width), F.lit(bins - 1)).cast("int").alias("bin"))
    return x.groupBy(*(["by"] if by else []), "bin").agg(F.count("*").alias("n")).select(*(["by"] if by else []), "bin", (lo + F.col("bin") * width).alias("low"), (lo + (F.col("bin") + 1) * width).alias("high"), "n")
