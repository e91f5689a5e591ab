"""Clusterers over cells or points, and the façade that goes from a mixed table to segments."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabseg.functions import weights as weighting
from tabseg.functions.encode import Normaliser
from tabseg.functions.profile import Detection, detect_types
from tabseg.operators import community, embed, pairs
from tabseg.plans import spec
from tabseg.session import broadcast_if_small, materialise

#: Distinct rows up to which average linkage is computed.
LINKAGE_ROWS = 5000
#: Starts of k-means on cells, of which the one with the least cost counts; rounds of a start; distinct rows that are clustered in one place;
#: numbers of the centres of the starts that go on at once.
STARTS, TURNS, ONE_PLACE, CENTRE_NUMBERS = 10, 20, 20_000, 4_000_000


@dataclass
class CellMeans:
    """Centres of k-means on one-hot cells: per iteration the values that occur, and each centre's share of every value."""

    values: list[np.ndarray]  # sorted, per iteration; the columns of an iteration follow those of the one before
    scale: np.ndarray  # of squared distances, per column
    shares: np.ndarray  # (columns, centres)
    cost: float = 0.0

    def columns(self, cells: pd.Series) -> np.ndarray:
        x = np.stack(cells.to_numpy())
        at = np.cumsum([0, *map(len, self.values)])
        return np.stack([at[l] + np.searchsorted(v, x[:, l]) for l, v in enumerate(self.values)], 1) if len(self.values) else np.zeros((len(x), 0), int)

    def squares(self, at: np.ndarray) -> np.ndarray:
        """Squared distances of rows, given as columns, to all centres."""
        table = self.scale[:, None] * self.shares
        first = np.cumsum([0, *map(len, self.values)])[:-1]
        out = np.tile(self.scale[first].sum() + (table * self.shares).sum(0), (len(at), 1))
        for l in range(at.shape[1]):
            out -= 2 * table[at[:, l]]
        return np.maximum(out, 0)


def _draw(at: np.ndarray, salt: int) -> np.ndarray:
    """A number in (0, 1) for each row of columns, from the row and the salt alone."""
    with np.errstate(over="ignore"):
        h = np.full(len(at), salt, np.uint64)
        for c in at.T:
            h = (h ^ c.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            h ^= h >> np.uint64(32)
    return ((h >> np.uint64(12)).astype(float) + 0.5) / 2.0**52


def _starts(points: DataFrame, place: pd.DataFrame | None, empty: CellMeans, k: int, salts: list[int]) -> list[CellMeans]:
    """The centres that each salt leads to. All starts share every pass over the points (cells, w); place: the points, if they are few."""
    d, n = len(empty.scale), len(salts)
    rank = np.repeat(np.arange(len(empty.values)), [len(v) for v in empty.values])

    def over(run: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: str) -> pd.DataFrame:
        return pd.concat(list(run(iter([place])))) if place is not None else points.mapInPandas(run, schema).groupBy("j", "c").agg(F.sum("v").alias("v")).toPandas()

    def nearest(batches: Iterator[pd.DataFrame], now: CellMeans, held: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        for b in batches:
            if len(b):
                at = now.columns(b["cells"])
                yield at, b["w"].to_numpy(float), now.squares(at).reshape(len(at), n, held)

    # first centres: rows drawn by weight times squared distance from the centres before
    shares = np.zeros((d, n, 0))
    for held in range(k):
        now = CellMeans(empty.values, empty.scale, shares.reshape(d, -1))

        def pick(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            best: list[tuple[float, list[int]]] = [(np.inf, [])] * n
            for at, w, far in nearest(batches, now, held):
                mass = w[:, None] * (far.min(2) if held else np.ones((len(at), n)))
                for s in range(n):
                    key = np.where(mass[:, s] > 1e-12, -np.log(_draw(at, salts[s] + 7919 * held)) / np.maximum(mass[:, s], 1e-12), np.inf)
                    if key.min() < best[s][0]:
                        best[s] = (float(key.min()), at[key.argmin()].tolist())
            yield pd.DataFrame([(s, *x) for s, x in enumerate(best) if x[1]], columns=["s", "key", "at"])

        got = pick(iter([place])) if place is not None else [points.mapInPandas(pick, "s int, key double, at array<bigint>").toPandas()]
        found = pd.concat(list(got)).sort_values("key", kind="stable").groupby("s")["at"].first()
        more = np.zeros((d, n, 1))
        for s in range(n):
            more[list(found.get(s, found.iloc[0])), s, 0] = 1.0
        shares = np.concatenate((shares, more), 2)

    before = None
    for turn in range(TURNS + 1):
        now = CellMeans(empty.values, empty.scale, shares.reshape(d, -1))

        def move(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            sums, cost = np.zeros((n, k * d)), np.zeros(n)
            for at, w, far in nearest(batches, now, k):
                label = far.argmin(2)
                cost += (w[:, None] * far.min(2)).sum(0)
                for s in range(n):
                    sums[s] += np.bincount((label[:, s, None] * d + at).ravel(), np.repeat(w, at.shape[1]), k * d)
            at = np.flatnonzero(sums)
            yield pd.DataFrame({"j": np.concatenate((at // d, np.arange(n))), "c": np.concatenate((at % d, np.full(n, -1))), "v": np.concatenate((sums.ravel()[at], cost))})

        got = over(move, "j bigint, c bigint, v double")
        costs = got[got["c"] < 0].sort_values("j")["v"].to_numpy()
        if turn == TURNS or before is not None and np.allclose(costs, before, rtol=1e-12, atol=0):
            break
        before, got = costs, got[got["c"] >= 0]
        sums = np.zeros((d, n * k))
        sums[got["c"].to_numpy(int), got["j"].to_numpy(int)] = got["v"].to_numpy()
        size = sums[rank == 0].sum(0)
        shares = np.where(size > 0, sums / np.maximum(size, 1e-300), shares.reshape(d, -1)).reshape(d, n, k)
    return [CellMeans(empty.values, empty.scale, shares[:, s], float(costs[s])) for s in range(n)]


def kmeans_cells(cells: DataFrame, id_col: str, k: int, weights: np.ndarray | None, seed: int = 42, weight_col: str | None = None):
    """(labels (id, label), model): k-means on one-hot cells, whose squared distances are Hamming distances. k <= 1: one cluster.

    Cells of different groups are hardly farther apart than cells of one loose group, so a single start often takes two centres from one group
    and merges two others. Hence several starts over all rows: the least sum of squared distances wins, the first of equal ones. Rows with equal
    cells are one weighted point, and the starts share every pass over the points; few points are clustered in one place.
    """
    rows = cells.select(F.col(id_col).alias("id"), "cells", (F.col(weight_col) if weight_col else F.lit(1.0)).cast("double").alias("w"))
    points = materialise(rows.groupBy("cells").agg(F.sum("w").alias("w")))
    m = points.count()
    k = min(k, m)
    if k <= 1:
        return rows.select("id", F.lit(0).alias("label")), None
    known = points.select(F.posexplode("cells").alias("l", "cell")).distinct().limit(embed.DICTIONARY + 1).toPandas()
    if len(known) > embed.DICTIONARY:
        raise ValueError("too many distinct cells for k-means; use fewer bins or features per iteration")
    values = [np.sort(known["cell"][known["l"] == l].to_numpy(np.int64)) for l in range(known["l"].max() + 1)]
    scale = np.ones(len(values)) if weights is None else embed.scaled(weights) ** 2
    empty = CellMeans(values, np.repeat(scale, [len(v) for v in values]), np.zeros((len(known), 0)))
    place = points.toPandas().sort_values("cells", key=lambda c: c.map(tuple)) if m <= ONE_PLACE else None
    salts, at_once = [seed, *(spec.hash32_int(f"{seed}:{i}") for i in range(1, STARTS))], max(CENTRE_NUMBERS // (len(known) * k), 1)
    found = [x for i in range(0, STARTS, at_once) for x in _starts(points, place, empty, k, salts[i : i + at_once])]
    model = min(found, key=lambda x: float(f"{x.cost:.9g}"))

    def label(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"id": b["id"], "label": model.squares(model.columns(b["cells"])).argmin(1).astype("int32") if len(b) else np.zeros(0, "int32")})

    return rows.select("id", "cells").mapInPandas(label, f"id {rows.schema['id'].dataType.simpleString()}, label int"), model


def kmeans_points(points: DataFrame, cols: list[str], k: int, seed: int = 42):
    """(labels, model) over numeric columns; points: id and cols."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler

    x = VectorAssembler(inputCols=cols, outputCol="features").transform(points.select("id", *cols))
    model = KMeans(k=k, seed=seed, maxIter=20, predictionCol="label").fit(x)
    return model.transform(x).select("id", F.col("label").cast("int").alias("label")), model


def average_linkage(dist: np.ndarray, k: int, rows: np.ndarray | None = None) -> np.ndarray:
    """Labels of k clusters by average linkage (nearest-neighbour chain) of a symmetric matrix; rows: how many rows each item stands for."""
    n = len(dist)
    if n == 0:
        return np.zeros(0, int)
    d = dist.astype(float).copy()
    np.fill_diagonal(d, np.inf)
    size, alive = (np.ones(n) if rows is None else rows.astype(float).copy()), np.ones(n, bool)
    merges: list[tuple[float, int, int]] = []
    chain: list[int] = []
    for _ in range(n - 1):
        if not chain:
            chain = [int(np.flatnonzero(alive)[0])]
        while True:
            a = chain[-1]
            row = np.where(alive, d[a], np.inf)
            b = int(row.argmin())
            if len(chain) > 1 and row[chain[-2]] <= row[b]:
                b = chain[-2]
                break
            chain.append(b)
        chain = chain[:-2]
        lo, hi = min(a, b), max(a, b)
        merges.append((d[lo, hi], lo, hi))
        new = (d[lo] * size[lo] + d[hi] * size[hi]) / (size[lo] + size[hi])
        d[lo], d[:, lo] = new, new
        d[lo, lo] = np.inf
        size[lo] += size[hi]
        alive[hi] = False
    label = np.arange(n)
    for _, lo, hi in sorted(merges, key=lambda m: m[0])[: n - min(k, n)]:
        a, b = label[lo], label[hi]
        label[label == b] = a
    _, first, inverse = np.unique(label, return_index=True, return_inverse=True)
    return np.argsort(np.argsort(first))[inverse]


def agglomerate(cells: DataFrame, id_col: str, k: int = 3, max_rows: int = LINKAGE_ROWS) -> DataFrame:
    """(id, label): average linkage of the Hamming distances. Rows with equal cells merge first, at distance 0, so the matrix has a row per
    distinct cell array; beyond max_rows of these it raises (compress to prototypes first: `agglomerate_compressed`)."""
    rows = cells.select(F.col(id_col).cast("bigint").alias("id"), "cells")
    groups = materialise(rows.groupBy("cells").agg(F.min("id").alias("first"), F.count("*").alias("n")))
    m = groups.count()
    if m > max_rows:
        raise ValueError(f"{m} distinct rows exceed max_rows={max_rows}; use agglomerate_compressed")
    if k >= m:  # more clusters than distinct rows: copies part by id, as the last merges are undone
        local = rows.orderBy("id").limit(max_rows + 1).toPandas()
        if len(local) <= max_rows and k > m:
            return _link(cells, local, np.ones(len(local)), k)
    local = groups.select(F.col("first").alias("id"), "cells", "n").orderBy("id").toPandas()
    labels = _link(cells, local, local["n"].to_numpy(float), k).select(F.col("id").alias("first"), "label")
    of = rows.join(groups.select("cells", "first"), "cells").select("id", "first")
    return of.join(broadcast_if_small(labels), "first").select("id", "label")


def _link(cells: DataFrame, local: pd.DataFrame, n: np.ndarray, k: int) -> DataFrame:
    codes = np.array(local["cells"].tolist(), np.int64) if len(local) else np.zeros((0, 1), np.int64)
    dist = np.zeros((len(local), len(local)), np.float32)
    for c in range(codes.shape[1]):
        dist += codes[:, c, None] != codes[None, :, c]
    labels = average_linkage(dist / max(codes.shape[1], 1), k, n)
    return cells.sparkSession.createDataFrame([(int(i), int(x)) for i, x in zip(local["id"], labels)], "id bigint, label int")


def agglomerate_compressed(cells: DataFrame, id_col: str, k: int = 3, max_rows: int = LINKAGE_ROWS) -> DataFrame:
    """(id, label): average linkage of the medoids of as many buckets as fit into max_rows, weighted by their rows; all rows get their bucket's label."""
    from tabseg.operators import compress

    first = cells.select(F.size("cells")).first()
    depth = compress.choose_depth(cells, first[0] if first else 1, max_rows)
    protos, assignment = compress.compress(cells, id_col, depth)
    local = protos.select(F.col("proto").cast("bigint").alias("id"), "cells", "weight").orderBy("id").limit(max_rows + 1).toPandas()
    if len(local) > max_rows:
        raise ValueError("more buckets than max_rows even at depth 1; use fewer bins")
    return compress.expand(assignment, _link(cells, local, local["weight"].to_numpy(float), k))


def dbscan(nodes: DataFrame, near: DataFrame, min_samples: int = 5) -> DataFrame:
    """(id, label): near holds all pairs (src, dst) within eps, both directions, without loops; -1 is noise.

    A core has at least min_samples rows within eps, itself included; border rows join the cluster of their
    smallest core.
    """
    near = materialise(near.select("src", "dst").distinct())
    core = materialise(near.groupBy("src").agg((F.count("*") + 1).alias("n")).where(F.col("n") >= min_samples).select(F.col("src").alias("id")))
    if min_samples <= 1:
        core = nodes.select("id")
    links = near.join(core.select(F.col("id").alias("src")), "src", "left_semi").join(core.select(F.col("id").alias("dst")), "dst", "left_semi")
    parts = materialise(community.components(core, links))
    border = near.join(parts.select(F.col("id").alias("dst"), "component"), "dst").join(core.select(F.col("id").alias("src")), "src", "left_anti")
    border = border.groupBy(F.col("src").alias("id")).agg(F.min_by("component", "dst").alias("component"))
    labels = nodes.select("id").join(parts.unionByName(border), "id", "left").select("id", F.coalesce("component", F.lit(-1)).alias("label"))
    return community.renumber(labels)


def hamming_within(cells: DataFrame, id_col: str, eps: float) -> DataFrame:
    """(src, dst) in both directions of all pairs at most eps apart; only those leave the tasks that compare blocks of rows."""
    d = pairs.hamming_pairs(cells, id_col, within=eps)
    return d.select(F.col("i").alias("src"), F.col("j").alias("dst")).unionByName(d.select(F.col("j").alias("src"), F.col("i").alias("dst")))


def dbscan_retry(cells: DataFrame, id_col: str, min_samples: int = 5, eps: tuple[float, ...] = (0.3, 0.2, 0.1)) -> DataFrame:
    """The first eps that gives at least two clusters, else the last."""
    out = None
    for e in eps:
        out = materialise(dbscan(cells.select(F.col(id_col).alias("id")), hamming_within(cells, id_col, e), min_samples))
        if out.where("label >= 0").agg(F.count_distinct("label")).first()[0] >= 2:
            break
    return out


#: Rows of one step of BIRCH: features are looked for all of them at once, and what is near none begins new ones.
BIRCH_ROWS = 4096


class Features:
    """Clustering features (centre and size) of at most `threshold` radius, in arrays that grow by doubling."""

    def __init__(self, width: int, threshold: float) -> None:
        self.centres, self.sizes, self.n, self.reach = np.zeros((64, width)), np.zeros(64), 0, threshold

    def add(self, x: np.ndarray, sizes: np.ndarray) -> None:
        for lo in range(0, len(x), BIRCH_ROWS):
            y, m = x[lo : lo + BIRCH_ROWS], sizes[lo : lo + BIRCH_ROWS]
            while len(y):
                if self.n:
                    c = self.centres[: self.n]
                    d = np.maximum((y * y).sum(1)[:, None] - 2 * y @ c.T + (c * c).sum(1), 0)
                    j = d.argmin(1)
                    near = d[np.arange(len(y)), j] <= self.reach**2
                    gain = np.bincount(j[near], m[near], self.n)
                    held = gain > 0
                    for i in range(y.shape[1]):
                        sums = np.bincount(j[near], m[near] * y[near, i], self.n)
                        c[held, i] += (sums[held] - gain[held] * c[held, i]) / (self.sizes[: self.n][held] + gain[held])
                    self.sizes[: self.n] += gain
                    y, m = y[~near], m[~near]
                if len(y):
                    # a row begins a feature, with every later row within reach of it; the rest is looked at again
                    if self.n == len(self.sizes):
                        self.centres, self.sizes = np.concatenate((self.centres, np.zeros_like(self.centres))), np.concatenate((self.sizes, np.zeros_like(self.sizes)))
                    taken = ((y - y[0]) ** 2).sum(1) <= self.reach**2
                    self.sizes[self.n] = m[taken].sum()
                    self.centres[self.n] = (y[taken] * m[taken, None]).sum(0) / m[taken].sum()
                    self.n += 1
                    y, m = y[~taken], m[~taken]

    def condense(self, most: int) -> None:
        while self.n > most:
            centres, sizes, self.reach = self.centres[: self.n].copy(), self.sizes[: self.n].copy(), self.reach * 1.5
            self.n = 0
            self.add(centres, sizes)


def birch(points: DataFrame, cols: list[str], threshold: float, k: int | None = None, most: int = LINKAGE_ROWS) -> DataFrame:
    """(id, label): clustering features of at most `threshold` radius per partition, merged, then (k) average linkage of their centres.

    A partition and the merged set keep at most `most` features: beyond, the threshold grows and they are condensed, as in the
    original algorithm. The driver holds the features only, at most `most` of each partition.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = Features(len(cols), threshold)
        for b in batches:
            x = b[cols].to_numpy(float)
            held.add(x, np.ones(len(x)))
            held.condense(most)
        if held.n:
            yield pd.DataFrame({"x": list(held.centres[: held.n]), "n": held.sizes[: held.n]})

    got = points.select(*cols).mapInPandas(run, "x array<double>, n double").toPandas()
    x = np.array(got["x"].tolist()).reshape(-1, len(cols))
    order = np.lexsort((*x.T, -got["n"].to_numpy())) if len(x) else np.zeros(0, int)
    whole = Features(len(cols), threshold)
    whole.add(x[order], got["n"].to_numpy()[order])
    whole.condense(most)
    centres = whole.centres[: whole.n].copy()
    groups = np.arange(len(centres))
    if k is not None and k < len(centres):
        d = (centres * centres).sum(1)
        groups = average_linkage(np.sqrt(np.maximum(d[:, None] + d[None] - 2 * centres @ centres.T, 0)), k, whole.sizes[: whole.n])
    sent = points.sparkSession.sparkContext.broadcast((centres, groups))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c, g = sent.value
        for b in batches:
            y = b[cols].to_numpy(float)
            j = ((c * c).sum(1) / 2 - y @ c.T).argmin(1) if len(y) and len(c) else np.zeros(len(y), int)
            yield pd.DataFrame({"id": b["id"], "label": g[j].astype("int32") if len(c) else j.astype("int32")})

    return points.select("id", *cols).mapInPandas(place, "id bigint, label int")


@dataclass
class ForestSegmenter:
    """From a mixed table to segments: types, partitions, cells, weights, clusters.

    clusterer: 'kmeans', 'agglomerative', 'dbscan', 'birch', a graph shortcut such as 'louvain:k=20', or a function of (rows: id, and what
    cluster_input names) that returns id, label. Give n_clusters for k-means, linkage and BIRCH only.
    cluster_input: 'auto', 'onehot' (column features), 'embedding' (cells), 'distance' or 'similarity' (pairs i, j and the value). auto: what the
    clusterer takes; a function gets the cells.
    """

    n_iterations: int = 32
    n_features: int | float | str = "sqrt"
    n_bins: int | str = 3
    cut: str = "uniform"
    n_clusters: int | None = None
    clusterer: str | Callable[[DataFrame], DataFrame] = "kmeans"
    cluster_input: str = "auto"
    weighting: str = "uniform"
    temperature: float | None = None
    correlation_threshold: float | None = None  # features of a group of correlated columns weigh 1 / its size
    correlation_aware: bool = False  # an iteration takes at most one column of a group
    group_threshold: float = 0.7
    adaptive: bool = False
    low_bins: int = 2
    high_bins: int = 10
    contrastive: bool = False
    dbscan_eps: tuple[float, ...] = (0.3, 0.2, 0.1)
    missing_indicators: bool = False
    rare_min_count: int = 1
    rare_min_share: float = 0.0
    compute_importance: bool = False
    importance_repeats: int = 5
    density_rule: str = "silverman"
    detection: Detection = field(default_factory=Detection)
    seed: int = 42
    kinds: dict[str, str] = field(default_factory=dict)
    spec: spec.Spec | None = None
    weights: np.ndarray | None = None
    model: object = None

    def fit(self, df: DataFrame, id_col: str, columns: list[str] | None = None) -> ForestSegmenter:
        if self.n_clusters is not None and self.clusterer not in ("kmeans", "agglomerative", "birch"):
            raise ValueError("n_clusters goes with kmeans, agglomerative or birch only")
        if self.cluster_input not in ("auto", "onehot", "embedding", "distance", "similarity"):
            raise ValueError(f"unknown cluster_input {self.cluster_input!r}")
        cols = columns or [c for c in df.columns if c != id_col]
        self.columns_ = list(cols)
        self.kinds = self.kinds or detect_types(df, cols, self.detection)
        self.normaliser = None
        if self.missing_indicators or self.rare_min_count > 1 or self.rare_min_share > 0:
            self.normaliser = Normaliser(self.kinds, self.missing_indicators, self.rare_min_count, self.rare_min_share).fit(df)
            df = self.normaliser.transform(df, [id_col])
            self.used_ = self.normaliser.kinds_out()
        else:
            self.used_ = dict(self.kinds)
        kinds = self.used_
        bins = spec.bins_per_column(df, kinds, "adaptive", self.low_bins, self.high_bins) if self.adaptive or self.n_bins == "auto" else self.n_bins
        groups = w = None
        numeric = [c for c in kinds if kinds[c] == "numerical"]
        if self.correlation_threshold is not None and len(numeric) > 1:
            w = {c: 1.0 for c in kinds} | weighting.group_weights(numeric, weighting.spearman(df, numeric), self.correlation_threshold)
        if self.correlation_aware and len(numeric) > 1:
            groups = weighting.groups_of(numeric, weighting.pearson(df, numeric), self.group_threshold) + [[c] for c in kinds if c not in numeric]
        self.feature_weights_ = w or {c: 1.0 for c in kinds}
        self.id_col = id_col
        if self.contrastive:
            from tabseg.operators import contrast

            self.trees_ = contrast.ContrastiveTrees([c for c in kinds if kinds[c] == "numerical"], [c for c in kinds if kinds[c] != "numerical"], self.n_iterations, seed=self.seed).fit(df, id_col)
            self.spec = spec.Spec(spec.Sketch([[] for _ in range(self.n_iterations)]))
            self.cells_ = materialise(self.trees_.transform(df, id_col))
        else:
            self.trees_ = None
            sketch = spec.draw(kinds, self.n_iterations, self.n_features, bins, self.seed, w, groups, self.cut)
            self.spec = spec.fit(df, sketch, id_col, rule=self.density_rule)
            self.cells_ = materialise(embed.embed(df, self.spec, [id_col]))
        self.weights = weighting.iteration_weights(embed.long_cells(self.cells_, id_col), self.n_iterations, self.weighting, self.temperature)
        self.labels_ = materialise(self._cluster())
        if self.compute_importance:
            self.importance_ = self.importances(df)
        return self

    def _cluster(self) -> DataFrame:
        c, given = self.clusterer, self.cluster_input
        if callable(c):
            if given == "onehot":
                return c(materialise(embed.phi(self.cells_, self.id_col, self.weights)))
            if given in ("distance", "similarity"):
                return c(self.distances() if given == "distance" else self.similarities())
            return c(self.cells_.select(F.col(self.id_col).alias("id"), "cells"))
        if c == "kmeans":
            labels, self.model = kmeans_cells(self.cells_, self.id_col, self.n_clusters or 3, self.weights, self.seed)
            return labels
        if c == "agglomerative":
            return agglomerate(self.cells_, self.id_col, self.n_clusters or 3)
        if c == "birch":  # on the rows' two leading directions
            from tabseg.operators import report

            flat = materialise(report.sparse_plane(self.cells_, self.id_col, self.weights))
            return birch(flat, ["x", "y"], 0.1, self.n_clusters)
        if c == "dbscan":
            return dbscan_retry(self.cells_, self.id_col, eps=self.dbscan_eps)
        return community.graph_clusters(self.cells_, self.id_col, seed=self.seed, **community.parse_graph(c))

    def embed(self, df: DataFrame, id_col: str) -> DataFrame:
        """Cells of new rows under the fitted specification; unknown categories fall into the last bin."""
        missing = [c for c in self.kinds if c not in df.columns]
        if missing:
            raise ValueError(f"missing columns: {missing}")
        if self.normaliser is not None:
            df = self.normaliser.transform(df, [id_col])
        return self.trees_.transform(df, id_col) if self.trees_ is not None else embed.embed(df, self.spec, [id_col])

    def predict(self, df: DataFrame, id_col: str) -> DataFrame:
        """Segments of new rows by mean similarity to the fitted segments' rows: no pairs."""
        new = embed.long_cells(self.embed(df, id_col), id_col)
        hist = embed.long_cells(self.cells_, self.id_col).join(self.labels_.select("id", "label"), "id").groupBy("l", "cell", "label").agg(F.count("*").alias("n"))
        size = self.labels_.groupBy("label").agg(F.count("*").alias("size"))
        w = self.weights / self.weights.sum() if self.weights.sum() > 0 else np.full(len(self.weights), 1 / len(self.weights))
        at: Column = F.element_at(F.array(*[F.lit(float(x)) for x in w]), F.col("l") + 1)
        share = hist.join(broadcast_if_small(size), "label").select("l", "cell", "label", (at * F.col("n") / F.col("size")).alias("part"))
        sims = new.join(broadcast_if_small(share), ["l", "cell"]).groupBy("id", "label").agg(F.sum("part").alias("s")).groupBy("id").agg(F.min_by("label", F.struct(-F.col("s"), F.col("label"))).alias("label"))
        first = size.orderBy(F.desc("size"), "label").first()
        return df.select(F.col(id_col).alias("id")).join(sims, "id", "left").select("id", F.coalesce("label", F.lit(first["label"] if first else 0)).alias("label"))

    def importances(self, df: DataFrame) -> list[dict]:
        """Permutation importance of the columns for the fitted labels, embedded as the model embeds (trees included)."""
        from tabseg.operators import importance

        labels = self.labels_.select(F.col("id").alias(self.id_col), "label")
        uniform_ = np.allclose(self.weights, 1.0) or self.weights.sum() <= 0
        cols = list(self.used_) if self.normaliser is not None else self.columns_
        run = (lambda x, id_col: self.trees_.transform(x, id_col)) if self.trees_ is not None else (lambda x, id_col: embed.embed(x, self.spec, [id_col]))
        return importance.permutation_importance(df, self.id_col, run, labels, cols, None if uniform_ else list(map(float, self.weights)), self.importance_repeats, self.seed)

    def distances(self) -> DataFrame:
        """(i, j, dist) of all pairs of fitted rows, weighted unless the weights are all alike; quadratic by definition."""
        alike = np.allclose(self.weights, 1.0) or self.weights.sum() <= 0
        return pairs.hamming_pairs(self.cells_, self.id_col, None if alike else list(map(float, self.weights)))

    def similarities(self) -> DataFrame:
        return self.distances().select("i", "j", (1 - F.col("dist")).alias("similarity"))

    def save(self, spark: SparkSession, path: str) -> None:
        """The fitted model as tables: settings and specification (one row), cells and labels of the fitted rows. Contrastive trees and normalisers aren't kept."""
        if self.trees_ is not None or self.normaliser is not None:
            raise ValueError("models with contrastive trees or a normaliser can't be saved")
        self.cells_.write.mode("overwrite").parquet(f"{path}/cells")
        self.labels_.write.mode("overwrite").parquet(f"{path}/labels")
        spark.createDataFrame([(self.to_json(),)], "model string").coalesce(1).write.mode("overwrite").parquet(f"{path}/model")

    def restore(self, spark: SparkSession, path: str, id_col: str) -> ForestSegmenter:
        said = json.loads(spark.read.parquet(f"{path}/model").first()["model"])
        self.kinds, self.used_, self.spec, self.weights = said["kinds"], said["used"], spec.Spec.from_json(said["spec"]), np.array(said["weights"])
        self.columns_, self.id_col, self.trees_, self.normaliser = list(self.kinds), id_col, None, None
        self.cells_, self.labels_ = spark.read.parquet(f"{path}/cells"), spark.read.parquet(f"{path}/labels")
        return self

    def to_json(self) -> str:
        return json.dumps({"kinds": self.kinds, "used": self.used_, "spec": self.spec.to_json(), "weights": list(map(float, self.weights)), "clusterer": self.clusterer if isinstance(self.clusterer, str) else None, "n_clusters": self.n_clusters})


@dataclass
class ForestTransformer:
    """The embedding alone, without clustering: fit, transform (new rows to cells), get_embedding (cells of the fitted rows).

    Bins of categories are not capped by their number of values, unlike in the segmenter's automatic mode.
    """

    n_iterations: int = 32
    n_features: int | float | str = "sqrt"
    n_bins: int = 3
    cut: str = "uniform"
    correlation_threshold: float | None = None
    detection: Detection = field(default_factory=Detection)
    seed: int = 42
    spec: spec.Spec | None = None

    def fit(self, df: DataFrame, id_col: str, columns: list[str] | None = None) -> ForestTransformer:
        cols = columns or [c for c in df.columns if c != id_col]
        self.kinds = detect_types(df, cols, self.detection)
        numeric = [c for c in cols if self.kinds[c] == "numerical"]
        w = None
        if self.correlation_threshold is not None and len(numeric) > 1:
            w = {c: 1.0 for c in cols} | weighting.group_weights(numeric, weighting.spearman(df, numeric), self.correlation_threshold)
        self.spec = spec.fit(df, spec.draw(self.kinds, self.n_iterations, self.n_features, self.n_bins, self.seed, w, None, self.cut), id_col)
        self.embedding_ = materialise(self.transform(df, id_col))
        return self

    def transform(self, df: DataFrame, id_col: str) -> DataFrame:
        if self.spec is None:
            raise ValueError("fit first")
        return embed.embed(df, self.spec, [id_col])

    def fit_transform(self, df: DataFrame, id_col: str) -> DataFrame:
        return self.fit(df, id_col).embedding_

    def get_embedding(self) -> DataFrame:
        return self.embedding_
