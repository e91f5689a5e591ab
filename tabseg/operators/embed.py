"""Rows as arrays of nominal cell ids, one per random partition."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabseg.functions.profile import number
from tabseg.plans.spec import Feature, Sketch, Spec

#: Iterations up to which the embedding is one expression; beyond, generated code would grow too long.
EXPRESSION_ITERATIONS = 64


def bin_expression(f: Feature, spec: Spec) -> Column:
    """Bin of a feature: edges not above the value (missing: 0), or the category's bin (missing and unknown: the last)."""
    if f.kind == "numerical":
        x = number(f.name)
        total = F.lit(0)
        for e in spec.edges[f.seed]:
            total = total + (x >= F.lit(e)).cast("int")
        return F.coalesce(total, F.lit(0))
    bins = spec.bins[f.seed]
    if not bins:
        return F.lit(0)
    known = F.create_map(*[F.lit(v) for kv in bins.items() for v in kv])
    return F.coalesce(F.element_at(known, F.coalesce(F.col(f.name).cast("string"), F.lit(""))), F.lit(f.bins - 1)) if "" not in bins else F.when(F.col(f.name).isNull(), F.lit(f.bins - 1)).otherwise(F.coalesce(F.element_at(known, F.col(f.name).cast("string")), F.lit(f.bins - 1)))


def cell_expression(iteration: list[Feature], spec: Spec) -> Column:
    """Mixed radix number of the bins, or their hash where it could overflow."""
    size = 1
    for f in iteration:
        size *= f.bins
    if size >= 2**62:
        return F.xxhash64(*[bin_expression(f, spec) for f in iteration])
    out = F.lit(0).cast("bigint")
    for f in iteration:
        out = out * F.lit(f.bins) + bin_expression(f, spec)
    return out


def embed(df: DataFrame, spec: Spec, keep: list[str]) -> DataFrame:
    """keep and cells (array<bigint>): a narrow projection. Columns are read by name; their order doesn't matter."""
    its = spec.sketch.iterations
    if len(its) <= EXPRESSION_ITERATIONS:
        return df.select(*keep, F.array(*[cell_expression(it, spec) for it in its]).alias("cells"))
    return embed_arrow(df, spec, keep)


def embed_arrow(df: DataFrame, spec: Spec, keep: list[str]) -> DataFrame:
    """The same by array arithmetic over batches, for many iterations."""
    names = list(dict.fromkeys(f.name for it in spec.sketch.iterations for f in it))
    kinds = {f.name: f.kind for it in spec.sketch.iterations for f in it}
    x = df.select(*keep, *[(number(c) if kinds[c] == "numerical" else F.col(c).cast("string")).alias(f"__{c}") for c in names])
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keep).schema) + ", cells array<bigint>"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                yield b[keep].assign(cells=list(cells_of(b, spec)))

    return x.mapInPandas(run, schema)


def cells_of(b: pd.DataFrame, spec: Spec) -> np.ndarray:
    out = np.zeros((len(b), len(spec.sketch.iterations)), np.int64)
    for i, it in enumerate(spec.sketch.iterations):
        for f in it:
            v = b[f"__{f.name}"]
            if f.kind == "numerical":
                x = v.to_numpy(float)
                k = np.where(np.isnan(x), 0, np.searchsorted(np.array(spec.edges[f.seed]), x, "right"))
            else:
                k = v.map(spec.bins[f.seed]).fillna(f.bins - 1 if spec.bins[f.seed] else 0).to_numpy(np.int64)
            out[:, i] = out[:, i] * f.bins + k
    return out


def long_cells(cells: DataFrame, id_col: str) -> DataFrame:
    """(id, l, cell)."""
    return cells.select(F.col(id_col).alias("id"), F.posexplode("cells").alias("l", "cell"))


#: Distinct (iteration, cell) pairs up to which one-hot columns are given: each is a column of every k-means centre.
DICTIONARY = 2_000_000


def sparse_capable(clusterer: str) -> bool:
    """Whether a clusterer of that name works on one-hot cells; the others get the cells or distances."""
    return clusterer.lower() in ("kmeans", "minibatchkmeans", "birch")


def scaled(weights: np.ndarray) -> np.ndarray:
    """sqrt(w/2) of the normalised weights; unusable ones (not finite, all zero) count as uniform."""
    w = np.asarray(weights, float)
    return np.sqrt((w / w.sum() if np.isfinite(w).all() and w.sum() > 0 else np.full(len(w), 1 / max(len(w), 1))) / 2)


def phi(cells: DataFrame, id_col: str, weights: np.ndarray | None, keep: list[str] | None = None) -> DataFrame:
    """id, keep, features (sparse vector): one-hot cells scaled by sqrt(w/2), whose squared distance is the weighted Hamming distance.

    weights None: the bare one-hot cells (value 1), as for leaves. The vectors are made in the JVM, from the dictionary of the cells that occur, which
    has the size of the cell histogram; beyond DICTIONARY of them it raises, for every centre of k-means would be as wide.
    """
    from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct
    from pyspark.ml.linalg import Vectors

    keep = keep or []
    words = cells.select(F.col(id_col).alias("id"), *keep, F.transform("cells", lambda c, l: F.concat_ws(":", l, c)).alias("__words"))
    known = [r[0] for r in words.select(F.explode("__words").alias("w")).distinct().limit(DICTIONARY + 1).collect()]
    if len(known) > DICTIONARY:
        raise ValueError("too many distinct cells for one-hot features; use fewer bins or features per iteration")
    known = sorted(known, key=lambda w: tuple(map(int, w.split(":")))) or [""]
    v = CountVectorizerModel.from_vocabulary(known, inputCol="__words", outputCol="__features").transform(words)
    if weights is None:
        return v.select("id", *keep, F.col("__features").alias("features"))
    scale = scaled(weights)
    return ElementwiseProduct(scalingVec=Vectors.dense([scale[int(w.split(":")[0])] if w else 0.0 for w in known]), inputCol="__features", outputCol="features").transform(v).select("id", *keep, "features")


def embed_sql(table: str, id_col: str, sketch: Sketch) -> str:
    """SQL (DuckDB) that computes (id, l, cell) from the raw table for a sketch with uniform cuts, independently of the engine."""
    numeric = list(dict.fromkeys(f.name for it in sketch.iterations for f in it if f.kind == "numerical"))
    cats = [f for it in sketch.iterations for f in it if f.kind == "categorical"]
    parts = []
    if numeric:
        parts.append("st AS (SELECT " + ", ".join(f"min({c})::DOUBLE AS lo_{c}, max({c})::DOUBLE AS hi_{c}" for c in numeric) + f" FROM {table})")
    for i, f in enumerate(cats):
        h = f"('0x' || substr(md5({f.name}::VARCHAR || ':{f.seed}'), 1, 8))::BIGINT"
        parts.append(f"m{i} AS (SELECT v, ((row_number() OVER (ORDER BY h, v)) - 1) % {f.bins} AS b FROM (SELECT DISTINCT {f.name}::VARCHAR AS v, {h} AS h FROM {table} WHERE {f.name} IS NOT NULL))")
    selects = []
    k = 0
    for i, it in enumerate(sketch.iterations):
        expr, joins = "0::BIGINT", []
        for f in it:
            if f.kind == "numerical":
                b = " + ".join(f"CASE WHEN t.{f.name} >= lo_{f.name} + {u!r} * (hi_{f.name} - lo_{f.name}) THEN 1 ELSE 0 END" for u in f.draws)
            else:
                joins.append(f"LEFT JOIN m{k} ON t.{f.name}::VARCHAR = m{k}.v")
                b = f"coalesce(m{k}.b, {f.bins - 1})"
                k += 1
            expr = f"({expr}) * {f.bins} + ({b})"
        selects.append(f"SELECT t.{id_col} AS id, {i} AS l, ({expr})::BIGINT AS cell FROM {table} t {'CROSS JOIN st ' if numeric else ''}{' '.join(joins)}")
    parts.append("cells AS (" + " UNION ALL ".join(selects) + ")")
    return ", ".join(parts)
