"""Evaluation of labelings: contingency, ARI, NMI, silhouettes, Calinski-Harabasz, Davies-Bouldin, classification scores."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabseg.operators.pairs import by_blocks, overlaps, parts_of
from tabseg.session import broadcast_if_small


def contingency(df: DataFrame, a: str, b: str, by: list[str] | None = None) -> DataFrame:
    """(by..., a, b, n); rows with a null label are left out."""
    return df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(*(by or []), F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("n"))


def _two(x):
    return x * (x - 1) / 2


def ari(table: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by..., n, ari): adjusted Rand index of contingency tables. 1 where both labelings are trivial alike."""
    by = by or []
    table = table.withColumn("n", F.col("n").cast("double"))
    cells = table.groupBy(*by).agg(F.sum(_two(F.col("n"))).alias("cells"), F.sum("n").alias("total"))
    rows = table.groupBy(*by, "a").agg(F.sum("n").alias("n")).groupBy(*by).agg(F.sum(_two(F.col("n"))).alias("rows"))
    cols = table.groupBy(*by, "b").agg(F.sum("n").alias("n")).groupBy(*by).agg(F.sum(_two(F.col("n"))).alias("cols"))
    x = cells.join(rows, by).join(cols, by) if by else cells.crossJoin(rows).crossJoin(cols)
    expected = F.col("rows") * F.col("cols") / _two(F.col("total"))
    top, bottom = F.col("cells") - expected, (F.col("rows") + F.col("cols")) / 2 - expected
    value = F.when((F.col("total") < 2) | (bottom == 0), F.lit(1.0)).otherwise(top / bottom)
    return x.select(*by, F.col("total").cast("bigint").alias("n"), value.alias("ari"))


def nmi(table: DataFrame) -> DataFrame:
    """(nmi): mutual information over the mean of the two entropies. 1 if both labelings are trivial."""
    t = table.withColumn("n", F.col("n").cast("double"))
    total = t.agg(F.sum("n").alias("total"))
    a = t.groupBy("a").agg(F.sum("n").alias("na"))
    b = t.groupBy("b").agg(F.sum("n").alias("nb"))
    x = t.join(a, "a").join(b, "b").crossJoin(total)
    mi = x.agg(F.sum(F.col("n") / F.col("total") * F.ln(F.col("n") * F.col("total") / (F.col("na") * F.col("nb")))).alias("mi"))

    def entropy(y: DataFrame, c: str, name: str) -> DataFrame:
        return y.crossJoin(total).agg(F.sum(-F.col(c) / F.col("total") * F.ln(F.col(c) / F.col("total"))).alias(name))

    h = mi.crossJoin(entropy(a, "na", "ha")).crossJoin(entropy(b, "nb", "hb"))
    return h.select(F.when(F.col("ha") + F.col("hb") == 0, 1.0).otherwise(F.col("mi") / ((F.col("ha") + F.col("hb")) / 2)).alias("nmi"))


def hamming_silhouette(cells: DataFrame, labels: DataFrame, id_col: str, weights: list[float] | None = None) -> DataFrame:
    """(id, label, silhouette) under the (weighted) Hamming distance, from cell counts per cluster; singletons: 0.

    Clusters that a row shares no cell with lie at distance 1 and need no row of their own: only one of them matters, if no other is nearer.
    """
    s = overlaps(cells, labels, id_col, weights)
    k = labels.groupBy("label").agg(F.lit(1).alias("one")).agg(F.count("*").alias("k"))
    own = F.col("own") == F.col("cluster")
    # the mean over the own cluster leaves the row itself (similarity 1) out
    inner = F.when(own & (F.col("size") > 1), 1 - (F.col("similarity") * F.col("size") - 1) / (F.col("size") - 1))
    outer = F.when(~own, 1 - F.col("similarity"))
    per = s.groupBy("id", F.col("own").alias("label")).agg(F.max(inner).alias("a"), F.min(outer).alias("b")).crossJoin(F.broadcast(k))  # one row
    b = F.when(F.col("k") > 1, F.coalesce("b", F.lit(1.0)))
    top = F.greatest(F.col("a"), b)
    value = F.when(F.col("a").isNull() | b.isNull() | (top == 0), 0.0).otherwise((b - F.col("a")) / top)
    return per.select("id", "label", value.alias("silhouette"))


def euclid_silhouette(points: DataFrame, cols: list[str], block: int = 1024) -> DataFrame:
    """(id, label, silhouette) under the Euclidean distance; points: id (unique), label, cols. All rows against all, block by block, in quadratic time.

    `squared_silhouette` takes one pass instead.
    """
    x = points.select(F.col("id").cast("bigint").alias("id"), "label", F.array(*[F.col(c).cast("double") for c in cols]).alias("cells"))
    kind = points.schema["label"].dataType.simpleString()

    def kernel(a: pd.DataFrame, b: pd.DataFrame, same: bool) -> pd.DataFrame:
        u, v = np.stack(a["cells"].to_numpy()), np.stack(b["cells"].to_numpy())
        names, of = np.unique(b["label"].to_numpy(), return_inverse=True)
        out = []
        for lo in range(0, len(u), 256):
            d = np.zeros((len(u[lo : lo + 256]), len(v)))
            for c in range(u.shape[1]):
                d += (u[lo : lo + 256, c, None] - v[None, :, c]) ** 2
            d = np.sqrt(d)
            ids = a["id"].to_numpy()[lo : lo + 256]
            other = ids[:, None] != b["id"].to_numpy()[None]
            for j, name in enumerate(names):
                use = other & (of == j)[None]
                out.append(pd.DataFrame({"i": ids, "la": a["label"].to_numpy()[lo : lo + 256], "lb": name, "s": (d * use).sum(1), "n": use.sum(1)}))
        return pd.concat(out)

    parts = F.lit(parts_of(x.count(), block))
    sums = by_blocks(x, x, parts, parts, [], kernel, f"i bigint, la {kind}, lb {kind}, s double, n bigint")
    per = sums.groupBy("i", "la", "lb").agg((F.sum("s") / F.sum("n")).alias("d")).where("d IS NOT NULL")
    two = per.groupBy("i", "la").agg(F.max(F.when(F.col("la") == F.col("lb"), F.col("d"))).alias("a"), F.min(F.when(F.col("la") != F.col("lb"), F.col("d"))).alias("b"))
    top = F.greatest("a", "b")
    got = two.select(F.col("i").alias("id"), F.when(F.col("a").isNull() | F.col("b").isNull() | (top == 0), 0.0).otherwise((F.col("b") - F.col("a")) / top).alias("silhouette"))
    return points.select(F.col("id").cast("bigint").alias("id"), "label").join(got, "id", "left").select("id", "label", F.coalesce("silhouette", F.lit(0.0)).alias("silhouette"))


def squared_silhouette(points: DataFrame, cols: list[str]) -> DataFrame:
    """(id, label, silhouette) under the squared Euclidean distance, over all rows in one pass: the mean squared distance to a cluster
    follows from the cluster's moments. points: id, label, cols. The driver holds one row per cluster."""
    m = cluster_moments(points, cols).toPandas()
    kind = points.schema["label"].dataType.simpleString()
    n, mean = m["n"].to_numpy(float), m[[f"m{i}" for i in range(len(cols))]].to_numpy(float)
    inner, order = np.maximum(m["sse"].to_numpy(float), 0.0), {v: i for i, v in enumerate(m["label"])}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if not len(b):
                continue
            x, at = b[cols].to_numpy(float), b["label"].map(order).to_numpy(int)
            d = ((x[:, None] - mean[None]) ** 2).sum(2) * n + inner  # sum over the cluster's rows
            rows = np.arange(len(x))
            a = np.where(n[at] > 1, d[rows, at] / np.maximum(n[at] - 1, 1), np.nan)
            d = d / n
            d[rows, at] = np.inf
            other = d.min(1) if d.shape[1] > 1 else np.full(len(x), np.nan)
            top = np.maximum(a, other)
            s = np.where(np.isnan(a) | np.isnan(other) | ~(top > 0), 0.0, (other - a) / np.where(top > 0, top, 1.0))
            yield pd.DataFrame({"id": b["id"], "label": b["label"], "silhouette": s})

    return points.select("id", "label", *cols).mapInPandas(run, f"id {points.schema['id'].dataType.simpleString()}, label {kind}, silhouette double")


def cluster_moments(points: DataFrame, cols: list[str]) -> DataFrame:
    """Per label: n, mean of each column (m0..) and the sum of squared distances to it."""
    sse = sum((F.sum(F.col(c) * F.col(c)) - F.sum(c) * F.sum(c) / F.count("*") for c in cols), F.lit(0.0))
    return points.groupBy("label").agg(F.count("*").alias("n"), *[F.avg(c).alias(f"m{i}") for i, c in enumerate(cols)], sse.alias("sse"))


def separation(points: DataFrame, cols: list[str]) -> DataFrame:
    """(n, k, calinski_harabasz, davies_bouldin, sse) from moments per cluster and one pass of distances to centroids."""
    m = cluster_moments(points, cols)
    away = points.join(broadcast_if_small(m.select("label", *[f"m{i}" for i in range(len(cols))])), "label")
    d = F.sqrt(sum(((F.col(c) - F.col(f"m{i}")) ** 2 for i, c in enumerate(cols)), F.lit(0.0)))
    spread = away.groupBy("label").agg(F.avg(d).alias("spread"))
    local = m.join(spread, "label").toPandas()  # one row per cluster; two clusters are compared a block at a time
    c, n, sp = local[[f"m{i}" for i in range(len(cols))]].to_numpy(float), local["n"].to_numpy(float), local["spread"].to_numpy(float)
    total, k = n.sum(), len(local)
    within = float(np.maximum(local["sse"].to_numpy(float), 0.0).sum())
    mean = (n[:, None] * c).sum(0) / max(total, 1)
    between = float((n * ((c - mean) ** 2).sum(1)).sum())
    ch = None if k < 2 or total <= k else (1.0 if within == 0 else float(between / within * (total - k) / (k - 1)))
    db = None
    if k >= 2:
        worst = np.zeros(k)
        for lo in range(0, k, 256):
            gap = np.sqrt(((c[lo : lo + 256, None] - c[None]) ** 2).sum(2))
            with np.errstate(divide="ignore", invalid="ignore"):
                r = np.where(gap > 0, (sp[lo : lo + 256, None] + sp[None]) / gap, 0.0)
            worst[lo : lo + 256] = r.max(1)
        db = float(worst.mean())
    return points.sparkSession.createDataFrame([(int(total), k, ch, db, within)], "n bigint, k int, calinski_harabasz double, davies_bouldin double, sse double")


def fidelity(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """(n, accuracy, balanced_accuracy, macro_f1); classes are those of either column, scores without support count 0."""
    t = contingency(df, truth, predicted)
    hit = t.where(F.col("a").cast("string") == F.col("b").cast("string")).groupBy(F.col("a").cast("string").alias("c")).agg(F.sum("n").alias("hit"))
    true = t.groupBy(F.col("a").cast("string").alias("c")).agg(F.sum("n").alias("true"))
    said = t.groupBy(F.col("b").cast("string").alias("c")).agg(F.sum("n").alias("said"))
    per = true.join(said, "c", "full").join(hit, "c", "left").fillna(0)
    f1 = F.when(F.col("true") + F.col("said") == 0, 0.0).otherwise(2 * F.col("hit") / (F.col("true") + F.col("said")))
    recall = F.when(F.col("true") > 0, F.col("hit") / F.col("true"))
    return per.agg(F.sum("true").alias("n"), (F.sum("hit") / F.sum("true")).alias("accuracy"), F.avg(recall).alias("balanced_accuracy"), F.avg(f1).alias("macro_f1"))
