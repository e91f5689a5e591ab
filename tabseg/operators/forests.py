"""Leaves of forests that tell real rows from synthetic ones: unsupervised random forest and extremely randomised trees."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabseg.functions.encode import Preprocessor, category_codes
from tabseg.functions.profile import kind_of
from tabseg.operators.embed import phi
from tabseg.operators.importance import shuffle_column
from tabseg.plans.spec import hash32_int
from tabseg.session import broadcast_if_small, forget, materialise, uniform


def synthetic(df: DataFrame, id_col: str, numeric: list[str], categorical: list[str], kind: str = "permute_marginals", seed: int = 42) -> DataFrame:
    """As many rows without the columns' dependence. permute_marginals: every column shuffled on its own; uniform_box: uniform numbers and observed categories with equal chance."""
    x = df.select(id_col, *numeric, *categorical)
    if kind == "permute_marginals":
        for c in [*numeric, *categorical]:
            y = materialise(shuffle_column(x, id_col, c, f"{seed}:{c}"))
            forget(x)
            x = y
        return x
    r = x.agg(*[f(c).alias(f"{k}{i}") for i, c in enumerate(numeric) for k, f in (("a", F.min), ("b", F.max))]).first() if numeric else {}
    cols: list[Column] = [(F.lit(r[f"a{i}"]) + uniform(F.col(id_col), f"{seed}:{c}") * F.lit((r[f"b{i}"] or 0) - (r[f"a{i}"] or 0))).alias(c) for i, c in enumerate(numeric)]
    out = x.select(id_col, *cols, *[uniform(F.col(id_col), f"{seed}:{c}").alias(f"__u{i}") for i, c in enumerate(categorical)])
    for i, c in enumerate(categorical):
        # the drawn value is looked up by its number in the table of values, of which there may be any number
        codes = category_codes(x, c)
        n = codes.count()
        at = codes.select(F.col("code").cast("bigint").alias("__code"), F.col("value").alias(c))
        out = out.withColumn("__code", F.floor(F.col(f"__u{i}") * n).cast("bigint")).join(broadcast_if_small(at), "__code", "left").drop("__code", f"__u{i}")
    return out.select(id_col, *numeric, *categorical)


#: Column that tells real (1) from synthetic (0) rows; no feature may be called so.
REAL = "__real"


@dataclass
class RandomForestLeaves:
    """Leaves of an unsupervised random forest: a classifier of real (1) against synthetic (0) rows; similar rows share leaves."""

    numeric: list[str]
    categorical: list[str]
    trees: int = 30
    depth: int = 10
    min_leaf: int = 5
    kind: str = "permute_marginals"
    seed: int = 42

    def fit(self, df: DataFrame, id_col: str) -> RandomForestLeaves:
        from pyspark.ml.classification import RandomForestClassifier

        real = df.select(id_col, *self.numeric, *self.categorical)
        both = materialise(real.withColumn(REAL, F.lit(1.0)).unionByName(synthetic(real, id_col, self.numeric, self.categorical, self.kind, self.seed).withColumn(REAL, F.lit(0.0))))
        self.prep = Preprocessor(self.numeric, self.categorical).fit(both)
        self.model = RandomForestClassifier(numTrees=self.trees, maxDepth=min(self.depth, 30), minInstancesPerNode=self.min_leaf, seed=self.seed, labelCol=REAL, featuresCol="features", leafCol="leaf").fit(self._vectors(both, [F.col(REAL)]))
        return self

    def _vectors(self, df: DataFrame, keep: list[Column]) -> DataFrame:
        from pyspark.ml.feature import VectorAssembler

        x = df.select(*keep, *[c.alias(f"__f{i}") for i, c in enumerate(self.prep.columns())])
        return VectorAssembler(inputCols=[f"__f{i}" for i in range(len(self.prep.names()))], outputCol="features").transform(x)

    def leaves(self, df: DataFrame, id_col: str) -> DataFrame:
        """(id column, cells): the leaf of every tree."""
        from pyspark.ml.functions import vector_to_array

        x = self.model.transform(self._vectors(df, [F.col(id_col)]))
        return x.select(id_col, F.transform(vector_to_array("leaf"), lambda v: v.cast("bigint")).alias("cells"))


@dataclass
class ExtraTrees:
    """Extremely randomised trees, grown level by level over all trees at once.

    For every open node a few features are drawn by hash; each gets a uniformly random threshold between the
    node's minimum and maximum, and the one with the best Gini gain splits it. A level is two passes, whose tasks give
    sums by node and feature; the driver holds the nodes only.
    """

    numeric: list[str]
    categorical: list[str]
    trees: int = 10
    depth: int = 5
    min_leaf: int = 5
    kind: str = "permute_marginals"
    seed: int = 42
    splits: dict[tuple[int, int], tuple[int, float]] = field(default_factory=dict)

    def fit(self, df: DataFrame, id_col: str) -> ExtraTrees:
        real = df.select(id_col, *self.numeric, *self.categorical)
        both = materialise(real.withColumn(REAL, F.lit(1.0)).unionByName(synthetic(real, id_col, self.numeric, self.categorical, self.kind, self.seed).withColumn(REAL, F.lit(0.0))))
        self.prep = Preprocessor(self.numeric, self.categorical).fit(both)
        names = self.prep.names()
        d = len(names)
        x = materialise(both.select(F.col(REAL).alias("y"), *[c.cast("double").alias(f"x{i}") for i, c in enumerate(self.prep.columns())]))
        m = max(int(d**0.5), 1)
        self.splits = {}
        for level in range(self.depth):
            open_ = sorted((t, 2 * node + s) for t, node in best for s in (0, 1)) if level else [(t, 1) for t in range(self.trees)]
            # a slot is a node with one of its m features, those with the smallest hash
            slots = [(t, node, i) for t, node in open_ for i in sorted(range(d), key=lambda i: (hash32_int(f"{t}:{node}:{self.seed}:{i}"), i))[:m]]
            span = self._per_slot(x, slots, d, level, None)
            span = span[(span["lo"] < span["hi"]) & (span["n"] >= 2 * self.min_leaf)]
            draws = np.array([(hash32_int(f"{t}:{node}:{i}:cut:{self.seed}") + 0.5) / 4294967296.0 for t, node, i in (slots[j] for j in span["slot"])])
            span["cut"] = span["lo"].to_numpy() + draws * (span["hi"] - span["lo"]).to_numpy()
            if span.empty:
                break
            side = self._per_slot(x, [slots[j] for j in span["slot"]], d, level, span["cut"].to_numpy())
            side = side[(side["nl"] >= self.min_leaf) & (side["nr"] >= self.min_leaf)]
            gini = lambda y, n: 2 * y * (n - y) / n
            best: dict[tuple[int, int], tuple[float, int, float]] = {}
            for j, left in zip(side["slot"], gini(side["yl"], side["nl"]) + gini(side["yr"], side["nr"])):
                t, node, i = slots[span["slot"].iloc[j]]
                best[t, node] = min(best.get((t, node), (np.inf, d, 0.0)), (left, i, float(span["cut"].iloc[j])))
            if not best:
                break
            self.splits |= {at: (i, cut) for at, (_, i, cut) in best.items()}
        return self

    def _per_slot(self, x: DataFrame, slots: list[tuple[int, int, int]], d: int, level: int, cuts: np.ndarray | None) -> pd.DataFrame:
        """What the rows of each slot's node have in its feature: range and rows (lo, hi, n), or rows and real rows on both sides of its cut (nl, nr, yl, yr).

        Summed up inside the tasks, so that a row leaves them in no tree.
        """
        walk, names = self._walk(), ["lo", "hi", "n"] if cuts is None else ["nl", "nr", "yl", "yr"]
        by_tree: dict[int, list[np.ndarray]] = {}  # per tree and place among a node's slots: the slot of every node of the level, or -1
        used: dict[tuple[int, int], int] = {}
        for j, (t, node, _) in enumerate(slots):
            r = used[t, node] = used.get((t, node), -1) + 1
            tables = by_tree.setdefault(t, [])
            if r == len(tables):
                tables.append(np.full(2**level, -1))
            tables[r][node - 2**level] = j
        feature = np.array([i for *_, i in slots], int)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            k = len(slots)
            lo, hi, sums = np.full(k, np.inf), np.full(k, -np.inf), np.zeros((4, k))
            for b in batches:
                if not len(b):
                    continue
                v, y = b[[f"x{i}" for i in range(d)]].to_numpy(float), b["y"].to_numpy(float)
                nodes = walk(v)
                for t, tables in by_tree.items():
                    rows = np.flatnonzero(nodes[:, t] >= 2**level)
                    for table in tables:
                        slot = table[nodes[rows, t] - 2**level]
                        at, slot = rows[slot >= 0], slot[slot >= 0]
                        if not len(at):
                            continue
                        z = v[at, feature[slot]]
                        if cuts is None:
                            order = np.argsort(slot, kind="stable")
                            slot, z = slot[order], z[order]
                            first = np.flatnonzero(np.diff(slot, prepend=-1))
                            lo[slot[first]] = np.fmin(lo[slot[first]], np.fmin.reduceat(z, first))
                            hi[slot[first]] = np.fmax(hi[slot[first]], np.fmax.reduceat(z, first))
                            sums[0] += np.bincount(slot, minlength=k)
                        else:
                            for side, here in enumerate((z <= cuts[slot], z > cuts[slot])):
                                sums[side] += np.bincount(slot[here], minlength=k)
                                sums[2 + side] += np.bincount(slot[here], y[at[here]], k)
            out = [lo, hi, sums[0]] if cuts is None else list(sums)
            held = np.flatnonzero(sums.sum(0))
            yield pd.DataFrame({"slot": held} | {c: o[held] for c, o in zip(names, out)})

        got = x.mapInPandas(run, "slot bigint, " + ", ".join(f"{c} double" for c in names))
        return got.groupBy("slot").agg(*[(F.min if c == "lo" else F.max if c == "hi" else F.sum)(c).alias(c) for c in names]).orderBy("slot").toPandas()

    def _walk(self) -> Callable[[np.ndarray], np.ndarray]:
        """The node that rows of feature values have reached in every tree, looked up level by level in arrays of the splits."""
        deep = 2 ** (max((node.bit_length() for _, node in self.splits), default=0) + 1)
        feature, cut = np.full((self.trees, deep), -1), np.zeros((self.trees, deep))
        for (t, node), (i, c) in self.splits.items():
            feature[t, node], cut[t, node] = i, c
        trees, depth = np.arange(self.trees)[None], deep.bit_length() - 2

        def walk(v: np.ndarray) -> np.ndarray:
            rows, node = np.arange(len(v))[:, None], np.ones((len(v), trees.shape[1]), np.int64)
            for _ in range(depth):
                f = feature[trees, node]
                node = np.where(f >= 0, 2 * node + (v[rows, np.maximum(f, 0)] > cut[trees, node]), node)
            return node

        return walk

    def _nodes(self, df: DataFrame, keep: list[str], x: str) -> DataFrame:
        """keep and cells: the node that each row has reached in every tree."""
        walk = self._walk()
        columns = list(dict.fromkeys([*keep, x]))
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keep).schema) + ", cells array<bigint>"

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                if len(b):
                    yield b[keep].assign(cells=list(walk(np.stack(b[x].to_numpy()).astype(float))))

        return df.select(*columns).mapInPandas(run, schema)

    def leaves(self, df: DataFrame, id_col: str) -> DataFrame:
        return self._nodes(df.select(id_col, F.array(*self.prep.columns()).alias("__x")), [id_col], "__x")


@dataclass
class ForestClusters:
    """Clusters by the proximity of leaves: a forest tells real from synthetic rows, and rows that share many leaves form clusters.

    forest: 'random' or 'extra'. clusterer: 'kmeans' (on one-hot leaves), 'agglomerative' (average linkage of 1 - proximity) or a graph shortcut
    such as 'louvain:k=15'. Numeric columns are those with a numeric type, whatever their number of values.
    """

    forest: str = "random"
    n_clusters: int | None = None
    clusterer: str = "agglomerative"
    trees: int = 30
    depth: int = 10
    min_leaf: int = 5
    kind: str = "permute_marginals"
    seed: int = 42

    def fit(self, df: DataFrame, id_col: str, columns: list[str] | None = None) -> ForestClusters:
        from tabseg.operators import community, segment

        cols = columns or [c for c in df.columns if c != id_col]
        numeric = [c for c in cols if kind_of(df.schema[c].dataType) in ("int", "float")]
        of = RandomForestLeaves if self.forest == "random" else ExtraTrees
        self.model = of(numeric, [c for c in cols if c not in numeric], self.trees, self.depth, self.min_leaf, self.kind, self.seed).fit(df, id_col)
        self.id_col, self.leaves_ = id_col, materialise(self.model.leaves(df, id_col))
        if self.clusterer == "kmeans":
            labels = segment.kmeans_cells(self.leaves_, id_col, self.n_clusters or 3, None, self.seed)[0]
        elif self.clusterer == "agglomerative":
            labels = segment.agglomerate(self.leaves_, id_col, self.n_clusters or 3)
        else:
            labels = community.graph_clusters(self.leaves_, id_col, seed=self.seed, **community.parse_graph(self.clusterer))
        self.labels_ = materialise(labels)
        return self

    def proximities(self) -> DataFrame:
        from tabseg.operators import pairs

        return pairs.proximity(self.leaves_, self.id_col)

    def features(self) -> DataFrame:
        """One-hot leaves (id, features), the space in which model search scores these clusters."""
        return phi(self.leaves_, self.id_col, None)
