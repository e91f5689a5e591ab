"""An unsupervised binary tree: axis-parallel splits that reduce the sum of squares most, grown best first to k leaves."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Thresholds that are tried per feature and leaf: all midpoints up to so many, else so many quantiles.
THRESHOLDS = 32


@dataclass
class Node:
    n: int
    sse: float
    feature: str | None = None
    threshold: float | None = None
    left: Node | None = None
    right: Node | None = None
    leaf: int = -1


def _moments(df: DataFrame, cols: list[str], by: list[Column]) -> DataFrame:
    square = sum((F.col(c) * F.col(c) for c in cols), F.lit(0.0))
    return df.groupBy(*by).agg(F.count("*").alias("n"), F.sum(square).alias("q"), *[F.sum(c).alias(f"s{i}") for i, c in enumerate(cols)])


def few_valued(df: DataFrame, cols: list[str]) -> set[str]:
    """Columns with so few distinct values that all their midpoints are tried, here and in every part of the rows."""
    r = df.agg(*[F.approx_count_distinct(c, 0.02).alias(f"n{i}") for i, c in enumerate(cols)]).first()
    return {c for i, c in enumerate(cols) if r[f"n{i}"] <= 2 * THRESHOLDS}


def candidate_thresholds(df: DataFrame, cols: list[str], leaf: str, few: set[str]) -> dict[int, dict[str, list[float]]]:
    """Per leaf and column: midpoints of neighbouring distinct values, or of quantiles where there are many."""
    quantiles = [(i + 0.5) / (THRESHOLDS + 1) for i in range(THRESHOLDS + 1)]
    aggs = [(F.sort_array(F.collect_set(c)) if c in few else F.percentile_approx(c, quantiles, 10_000)).alias(f"v{i}") for i, c in enumerate(cols)]
    out: dict[int, dict[str, list[float]]] = {}
    for r in df.groupBy(leaf).agg(*aggs).collect():  # one row per open leaf
        out[r[leaf]] = {}
        for i, c in enumerate(cols):
            v = np.unique(np.array(r[f"v{i}"] or [], float))
            mid = (v[1:] + v[:-1]) / 2
            out[r[leaf]][c] = [float(x) for x in mid[np.linspace(0, len(mid) - 1, THRESHOLDS).round().astype(int)]] if len(mid) > THRESHOLDS else [float(x) for x in mid]
    return out


Split = tuple[float, str, float, tuple[int, float], tuple[int, float]]


def best_splits(df: DataFrame, cols: list[str], leaf: str, few: set[str], min_leaf: int = 1) -> dict[int, Split]:
    """Per leaf: (gain, feature, threshold, (n, sse) left, (n, sse) right). Equal gains: the earlier feature, the smaller threshold.

    Each row falls into one bin per feature; bins are summed in the cluster, and the driver accumulates at
    most columns x THRESHOLDS of them per open leaf.
    """
    cuts = candidate_thresholds(df, cols, leaf, few)

    def bin_of(edges: Column, c: str) -> Column:
        # x <= t goes left, so the bin is the number of thresholds below x
        return F.size(F.filter(edges, lambda t: t < F.col(c)))

    def edges_of(c: str) -> Column:
        e = F.lit(None).cast("array<double>")
        for k, per in cuts.items():
            e = F.when(F.col(leaf) == k, F.array(*[F.lit(t) for t in per[c]]).cast("array<double>")).otherwise(e)
        return e

    bins = F.explode(F.array(*[F.struct(F.lit(i).alias("f"), bin_of(edges_of(c), c).alias("b")) for i, c in enumerate(cols)]))
    rows = _moments(df.select(leaf, *cols, bins.alias("__x")), cols, [F.col(leaf).alias("leaf"), F.col("__x.f").alias("f"), F.col("__x.b").alias("b")]).toPandas()
    out: dict[int, Split] = {}

    def sse(m: np.ndarray) -> np.ndarray:
        return m[..., 1] - (m[..., 2:] ** 2).sum(-1) / np.maximum(m[..., 0], 1)

    for k, per in cuts.items():
        best = None
        for i, c in enumerate(cols):
            if not per[c]:
                continue
            part = rows[(rows["f"] == i) & (rows["leaf"] == k)]
            table = np.zeros((len(per[c]) + 1, len(cols) + 2))
            table[part["b"].to_numpy(int)] = part[["n", "q", *[f"s{j}" for j in range(len(cols))]]].to_numpy(float)
            left, total = np.cumsum(table, 0)[:-1], table.sum(0)
            right = total - left
            gain = sse(total) - sse(left) - sse(right)
            gain[(left[:, 0] < min_leaf) | (right[:, 0] < min_leaf)] = -np.inf
            j = int(np.argmax(gain))
            if gain[j] > 1e-12 and (best is None or gain[j] > best[0] + 1e-9):
                best = (float(gain[j]), c, per[c][j], (int(left[j, 0]), float(sse(left)[j])), (int(right[j, 0]), float(sse(right)[j])))
        if best:
            out[k] = best
    return out


def best_split(df: DataFrame, cols: list[str], min_leaf: int = 1) -> Split | None:
    return best_splits(df.withColumn("__leaf", F.lit(0)), cols, "__leaf", few_valued(df, cols), min_leaf).get(0)


@dataclass
class RuleTree:
    """A fitted tree; labels are leaves from left to right."""

    cols: list[str]
    root: Node
    k: int

    def label(self) -> Column:
        def walk(node: Node) -> Column:
            if node.feature is None:
                return F.lit(node.leaf)
            return F.when(F.col(node.feature) <= F.lit(node.threshold), walk(node.left)).otherwise(walk(node.right))

        return walk(self.root)

    def rules(self) -> list[tuple[int, int, str]]:
        """(label, rows, rule) of every leaf."""
        out = []

        def walk(node: Node, path: list[str]) -> None:
            if node.feature is None:
                out.append((node.leaf, node.n, " and ".join(path) or "all"))
                return
            walk(node.left, [*path, f"{node.feature} <= {node.threshold:.6g}"])
            walk(node.right, [*path, f"{node.feature} > {node.threshold:.6g}"])

        walk(self.root, [])
        return out


def fit_tree(df: DataFrame, cols: list[str], k: int, min_leaf: int = 1) -> RuleTree:
    """df: numeric columns without nulls (preprocessed, stored). Stops early where no split gains anything."""
    m = _moments(df, cols, []).first()
    n = m["n"]
    root = Node(n, (m["q"] or 0.0) - sum((m[f"s{i}"] or 0.0) ** 2 for i in range(len(cols))) / max(n, 1))
    few = few_valued(df, cols) if n else set()
    first = best_splits(df.withColumn("__leaf", F.lit(0)), cols, "__leaf", few, min_leaf).get(0) if n else None
    open_: list[tuple[Node, Column, Split | None]] = [(root, F.lit(True), first)]
    leaves = 1
    while leaves < k:
        usable = [(s[0], -i) for i, (_, _, s) in enumerate(open_) if s]
        if not usable:
            break
        node, where, split = open_.pop(-max(usable)[1])
        _, node.feature, node.threshold, left, right = split
        node.left, node.right = Node(*left), Node(*right)
        leaves += 1
        test = F.col(node.feature) <= F.lit(node.threshold)
        # both children in one pass; none is needed once the tree is full
        found = best_splits(df.where(where).withColumn("__leaf", F.when(test, 0).otherwise(1)), cols, "__leaf", few, min_leaf) if leaves < k else {}
        open_ += [(node.left, where & test, found.get(0)), (node.right, where & ~test, found.get(1))]
    count = 0

    def number(node: Node) -> None:
        nonlocal count
        if node.feature is None:
            node.leaf, count = count, count + 1
        else:
            number(node.left)
            number(node.right)

    number(root)
    return RuleTree(list(cols), root, count)
