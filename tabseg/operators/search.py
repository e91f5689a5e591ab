"""Model selection: algorithms x parameters x number of clusters x restarts, scored, ranked, and the best kept."""

from __future__ import annotations

import itertools
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabseg.operators import metrics
from tabseg.session import materialise

#: What a score can be, and the names of the algorithms that are built in.
SCORES = ("silhouette", "calinski_harabasz", "davies_bouldin", "stability")
BUILT_IN = ("forest", "urf", "extratrees", "binary_tree", "kmeans")


def _built_in(name: str) -> Callable[..., DataFrame]:
    """fit(points, k, seed, **params) -> (id, label)."""
    from tabseg.operators import forests, ruletree, segment

    def run(points: DataFrame, k: int, seed: int, **params) -> DataFrame:
        cols = [c for c in points.columns if c != "id"]
        if name == "forest":
            return segment.ForestSegmenter(n_clusters=k, seed=seed, **params).fit(points, "id").labels_
        if name in ("urf", "extratrees"):
            return forests.ForestClusters("random" if name == "urf" else "extra", k, seed=seed, **({"trees": 10, "depth": 6} | params)).fit(points, "id").labels_
        prep = _prepared(points, cols)
        names = [c for c in prep.columns if c != "id"]
        if name == "binary_tree":
            return prep.select("id", ruletree.fit_tree(prep, names, k, **params).label().alias("label"))
        return segment.kmeans_points(prep, names, k, seed)[0]

    return run


def _prepared(points: DataFrame, cols: list[str]) -> DataFrame:
    """id and standardised, one-hot columns: the space in which everything is scored."""
    from tabseg.functions.encode import Preprocessor
    from tabseg.functions.profile import kind_of

    numeric = [c for c in cols if kind_of(points.schema[c].dataType) in ("int", "float")]
    p = Preprocessor(numeric, [c for c in cols if c not in numeric]).fit(points)
    return materialise(p.transform(points, ["id"]).toDF("id", *[f"f{i}" for i in range(len(p.names()))]))


@dataclass
class Search:
    """algorithms: names of BUILT_IN, or name -> (fit(points, k, seed, **params) -> labels (id, label), grid of params).

    All labelings are scored in one space, so scores compare: the standardised columns (space 'columns'), or the one-hot cells of one forest
    embedding (space 'cells'), where the silhouette is that of the Hamming distance. Scores are taken over all rows in one pass: the silhouette
    of 'columns' is that of squared Euclidean distances. Groups are ranked by `scoring` (silhouette: less a penalty for instability), then
    Calinski-Harabasz, Davies-Bouldin, stability, and larger k.
    """

    algorithms: dict[str, tuple[Callable[..., DataFrame], dict[str, list]]] | list[str]
    k_range: range
    restarts: int = 2
    stability_weight: float = 0.25
    scoring: str = "silhouette"
    space: str = "columns"
    seed: int = 42
    results: list[dict] = field(default_factory=list)

    def fit(self, points: DataFrame, cols: list[str]) -> Search:
        if self.scoring not in SCORES or self.space not in ("columns", "cells") or not len(self.k_range) or min(self.k_range) < 2:
            raise ValueError("unknown scoring or space, or no k of at least 2")
        algorithms = {a: (_built_in(a), {}) for a in self.algorithms} if isinstance(self.algorithms, list) else self.algorithms
        if isinstance(self.algorithms, list) and set(self.algorithms) - set(BUILT_IN):
            raise ValueError(f"unknown algorithms: {sorted(set(self.algorithms) - set(BUILT_IN))}")
        points = materialise(points.select("id", *cols))
        space = _prepared(points, cols)
        names = [c for c in space.columns if c != "id"]
        cells = None
        if self.space == "cells":
            from tabseg.operators.segment import ForestTransformer

            cells = ForestTransformer(seed=self.seed).fit(points, "id", cols).embedding_
        self.results, group = [], 0
        self.labels: dict[int, DataFrame] = {}
        for name, (run, grid) in algorithms.items():
            for params in [dict(zip(grid, v)) for v in itertools.product(*grid.values())] or [{}]:
                for k in self.k_range:
                    got = []
                    for r in range(self.restarts):
                        labels = materialise(run(points, k, self.seed + 1009 * group + r, **params).select("id", F.col("label").cast("bigint").alias("label")))
                        x = space.join(labels, "id")
                        sil = metrics.hamming_silhouette(cells, labels, "id") if cells is not None else metrics.squared_silhouette(x, names)
                        got.append((labels, sil.agg({"silhouette": "avg"}).first()[0] or 0.0, metrics.separation(x, names).first()))
                    aris = [float(metrics.ari(metrics.contingency(a[0].withColumnRenamed("label", "x").join(b[0].withColumnRenamed("label", "y"), "id"), "x", "y")).first()["ari"]) for a, b in itertools.combinations(got, 2)]
                    best = max(range(len(got)), key=lambda i: got[i][1])
                    one = got[best][2]
                    row = {
                        "algorithm": name, "params": str(params), "k": k, "group": group, "silhouette": float(np.mean([g[1] for g in got])), "calinski_harabasz": one["calinski_harabasz"] or 0.0, "davies_bouldin": one["davies_bouldin"] or 0.0,
                        "stability": float(np.mean(aris)) if aris else 1.0,
                    }
                    score = {"silhouette": row["silhouette"] - self.stability_weight * (1 - row["stability"]), "davies_bouldin": -row["davies_bouldin"]}.get(self.scoring, row[self.scoring])
                    self.results.append(row | {"score": float("-inf") if one["k"] < 2 else score})
                    self.labels[group] = got[best][0]
                    group += 1
        self.results.sort(key=lambda r: (-r["score"], -r["calinski_harabasz"], r["davies_bouldin"], -r["stability"], -r["k"], r["algorithm"]))
        for i, r in enumerate(self.results):
            r["rank"] = i + 1
        self.best_ = self.results[0]
        self.labels_ = self.labels[self.best_["group"]]
        return self

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([tuple(r[c] for c in ("rank", "algorithm", "params", "k", "silhouette", "calinski_harabasz", "davies_bouldin", "stability", "score")) for r in self.results],
                                     "rank int, algorithm string, params string, k int, silhouette double, calinski_harabasz double, davies_bouldin double, stability double, score double")
