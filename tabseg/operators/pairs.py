"""Distances between rows in cells, and neighbour graphs.

What has to compare all rows with all rows does so block by block: rows are dealt into blocks by a hash of their
id, each pair of blocks is one task, and only what is asked for leaves it. There is no cross join and no limit on
rows; the time grows with the square. The mean similarity of rows to clusters needs no pairs at all: it follows
from how often each cell occurs in each cluster.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tabseg.session import broadcast_if_small, materialise

#: Most and fewest rows of a block when all rows are compared block by block.
BLOCK_ROWS, LEAST_BLOCK = 2048, 64
#: Band widths that are tried.
BANDS = (2, 3, 4, 6, 8, 10, 12, 16, 20, 24, 32)


def mismatches(a: Column | str, b: Column | str, weights: list[float] | None = None) -> Column:
    """Number (or weight) of the positions in which two cell arrays differ."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    if weights is None:
        return F.aggregate(F.zip_with(a, b, lambda x, y: F.when(x == y, 0).otherwise(1)), F.lit(0), lambda s, x: s + x)
    w = F.array(*[F.lit(float(x)) for x in weights])
    each = F.zip_with(F.zip_with(a, b, lambda x, y: x != y), w, lambda d, v: F.when(d, v).otherwise(0.0))
    return F.aggregate(each, F.lit(0.0), lambda s, x: s + x)


def check_weights(weights, length: int) -> list[float]:
    w = np.asarray(weights, float)
    if w.shape != (length,) or not np.isfinite(w).all() or (w < 0).any():
        raise ValueError("weights must be finite, not negative, one per iteration")
    if w.sum() == 0:
        raise ValueError("at least one weight must be positive")
    return w.tolist()


def usable_weights(weights, length: int) -> list[float]:
    """As check_weights, but weights that are all zero, not finite or of another length become uniform ones (the lenient form)."""
    try:
        return check_weights(weights, length)
    except ValueError:
        return [1.0] * length


def parts_of(n: int, block: int = BLOCK_ROWS) -> int:
    """Blocks for n rows: at least four once blocks are not tiny, so that several tasks share a small table."""
    return max(-(-n // min(block, max(-(-n // 4), LEAST_BLOCK))), 1) if n else 1


Kernel = Callable[[pd.DataFrame, pd.DataFrame, bool], pd.DataFrame]


def by_blocks(x: DataFrame, y: DataFrame, parts_x: Column, parts_y: Column, by: list[str], kernel: Kernel, schema: str) -> DataFrame:
    """kernel(rows of x, rows of y, False) for every pair of a block of x with a block of y. x and y have the same columns, among them id and by."""
    cols = [c for c in x.columns if c not in by]
    mine = F.pmod(F.xxhash64("id"), parts_x)
    left = x.select(*by, mine.alias("__s"), F.explode(F.sequence(F.lit(0).cast("bigint"), parts_y.cast("bigint") - 1)).alias("__t"), *cols, F.lit(True).alias("__left"))
    theirs = F.pmod(F.xxhash64("id"), parts_y)
    right = y.select(*by, F.explode(F.sequence(F.lit(0).cast("bigint"), parts_x.cast("bigint") - 1)).alias("__s"), theirs.alias("__t"), *cols, F.lit(False).alias("__left"))
    empty = [f.split()[0] for f in schema.split(", ")]

    def run(both: pd.DataFrame) -> pd.DataFrame:
        a, b = both[both["__left"]], both[~both["__left"]]
        return kernel(a, b, False) if len(a) and len(b) else pd.DataFrame(columns=empty)

    return left.unionByName(right).groupBy(*by, "__s", "__t").applyInPandas(run, schema)


def within_blocks(x: DataFrame, parts: Column, by: list[str], kernel: Kernel, schema: str) -> DataFrame:
    """kernel(rows, other rows, same block?) for every unordered pair of blocks of x, a block with itself among them."""
    cols = [c for c in x.columns if c not in by]
    own = F.pmod(F.xxhash64("id"), parts).cast("bigint")
    one = x.select(*by, own.alias("__own"), F.explode(F.sequence(F.lit(0).cast("bigint"), parts.cast("bigint") - 1)).alias("__other"), *cols)
    one = one.select(*by, F.least("__own", "__other").alias("__s"), F.greatest("__own", "__other").alias("__t"), "__own", *cols)
    empty = [f.split()[0] for f in schema.split(", ")]

    def run(both: pd.DataFrame) -> pd.DataFrame:
        first = both["__own"] == both["__s"]
        if (both["__s"].iloc[0] == both["__t"].iloc[0]):
            return kernel(both, both, True)
        a, b = both[first], both[~first]
        return kernel(a, b, False) if len(a) and len(b) else pd.DataFrame(columns=empty)

    return one.groupBy(*by, "__s", "__t").applyInPandas(run, schema)


def _codes(x: pd.DataFrame) -> np.ndarray:
    return np.stack(x["cells"].to_numpy()).astype(np.int64, copy=False)


def _apart(a: np.ndarray, b: np.ndarray, weights: list[float] | None) -> np.ndarray:
    """Mismatches (or their weight) of every row of a with every row of b; without weights compared and counted in the narrowest type that holds them."""
    if weights is None:
        a, b = _narrow(a, b)
        out = np.zeros((len(a), len(b)), np.uint8 if a.shape[1] < 256 else np.uint16 if a.shape[1] < 65536 else np.int32)
        for c in range(a.shape[1]):
            out += a[:, c, None] != b[None, :, c]
        return out.astype(np.int32)
    out = np.zeros((len(a), len(b)))
    for c in range(a.shape[1]):
        out += (a[:, c, None] != b[None, :, c]) * weights[c]
    return out


def _narrow(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both renumbered per column, in columns that lie together, if they hold wide numbers."""
    if a.dtype.itemsize <= 2:
        return a, b
    codes = np.zeros((len(a) + len(b), a.shape[1]), np.int64, "F")
    for c in range(a.shape[1]):
        codes[:, c] = np.unique(np.concatenate((a[:, c], b[:, c])), return_inverse=True)[1]
    most = int(codes.max(initial=0))
    codes = codes.astype(np.uint8 if most < 256 else np.uint16 if most < 65536 else np.int64, order="F")
    return codes[: len(a)], codes[len(a) :]


def _total(cells: DataFrame, weights: list[float] | None) -> tuple[int, float]:
    r = cells.agg(F.count("*").alias("n"), F.max(F.size("cells")).alias("l")).first()
    return r["n"], float(np.sum(weights)) if weights is not None else float(r["l"] or 1)


def hamming_pairs(cells: DataFrame, id_col: str, weights: list[float] | None = None, within: float | None = None, block: int = BLOCK_ROWS) -> DataFrame:
    """(i, j, dist) of all pairs i < j: share (or weight share) of differing cells; with `within` only pairs at most so far apart.

    Repeated ids are no pair with themselves. The result of the plain form is quadratic: it is the operator's purpose.
    """
    n, total = _total(cells, weights)

    def kernel(a: pd.DataFrame, b: pd.DataFrame, same: bool) -> pd.DataFrame:
        ia, ib, xa, xb = a["id"].to_numpy(), b["id"].to_numpy(), _codes(a), _codes(b)
        out = []
        for lo in range(0, len(ia), 256):
            d = _apart(xa[lo : lo + 256], xb, weights) / total
            use = ia[lo : lo + 256, None] < ib[None] if same else ia[lo : lo + 256, None] != ib[None]
            if within is not None:
                use &= d <= within
            p, q = np.nonzero(use)
            i, j = ia[lo + p], ib[q]
            out.append(pd.DataFrame({"i": np.minimum(i, j), "j": np.maximum(i, j), "dist": d[p, q]}))
        return pd.concat(out)

    rows = cells.select(F.col(id_col).cast("bigint").alias("id"), "cells")
    return within_blocks(rows, F.lit(parts_of(n, block)), [], kernel, "i bigint, j bigint, dist double")


def cross_hamming(x: DataFrame, y: DataFrame, x_id: str, y_id: str, weights: list[float] | None = None, block: int = BLOCK_ROWS) -> DataFrame:
    """(i, j, dist) of every row of x with every row of y."""
    n, _ = _total(x, weights)
    m, total = _total(y, weights)

    def kernel(a: pd.DataFrame, b: pd.DataFrame, same: bool) -> pd.DataFrame:
        d = _apart(_codes(a), _codes(b), weights) / total
        return pd.DataFrame({"i": np.repeat(a["id"].to_numpy(), len(b)), "j": np.tile(b["id"].to_numpy(), len(a)), "dist": d.ravel()})

    left, right = x.select(F.col(x_id).cast("bigint").alias("id"), "cells"), y.select(F.col(y_id).cast("bigint").alias("id"), "cells")
    return by_blocks(left, right, F.lit(parts_of(n, block)), F.lit(parts_of(m, block)), [], kernel, "i bigint, j bigint, dist double")


def proximity(leaves: DataFrame, id_col: str) -> DataFrame:
    """(i, j, proximity): share of trees in which two rows share a leaf."""
    return hamming_pairs(leaves, id_col).select("i", "j", (1 - F.col("dist")).alias("proximity"))


def cross_proximity(x: DataFrame, y: DataFrame, x_id: str, y_id: str) -> DataFrame:
    return cross_hamming(x, y, x_id, y_id).select("i", "j", (1 - F.col("dist")).alias("proximity"))


def label_proximity(labels: DataFrame) -> DataFrame:
    """(i, j) of the pairs i < j in one segment, whose proximity under a single tree is 1 (that of all other pairs is 0). labels: id, label."""
    cells = labels.select(F.col("id").alias("id"), F.array(F.col("label").cast("bigint")).alias("cells"))
    return hamming_pairs(cells, "id", within=0.0).select("i", "j")


def pack_bits(cells: DataFrame, id_col: str) -> DataFrame:
    """(id, words array<bigint>): cells of 0 and 1 packed 63 to a word, for `bit_mismatches`."""
    word = lambda w: F.aggregate(F.slice("cells", w * 63 + 1, F.lit(63)), F.lit(0).cast("bigint"), lambda s, x: F.shiftleft(s, 1).bitwiseOR(x.cast("bigint")))
    words = F.transform(F.sequence(F.lit(0), F.floor((F.size("cells") - 1) / 63).cast("int")), word)
    return cells.select(F.col(id_col).alias("id"), F.when(F.size("cells") > 0, words).otherwise(F.array().cast("array<bigint>")).alias("words"))


def bit_mismatches(a: Column | str, b: Column | str) -> Column:
    """Number of differing bits of two packed rows: the popcount of their exclusive or."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


def compact_codes(cells: DataFrame, id_col: str) -> DataFrame:
    """(id, l, code): cells renumbered 0.. per iteration in order of value; the numbering runs over distinct cells."""
    long = cells.select(F.col(id_col).alias("id"), F.posexplode("cells").alias("l", "cell"))
    code = long.groupBy("l", "cell").agg(F.lit(1).alias("x")).select("l", "cell", (F.row_number().over(Window.partitionBy("l").orderBy("cell")) - 1).alias("code"))
    return long.join(broadcast_if_small(code), ["l", "cell"]).select("id", "l", "code")


def overlaps(cells: DataFrame, labels: DataFrame, id_col: str, weights: list[float] | None = None) -> DataFrame:
    """(id, own, cluster, size, similarity): mean similarity of each row to the rows of each cluster, itself included, where it is above 0.

    labels: id, label. sim(i, C) = sum over l of w_l x count of the row's cell in C / |C|: one histogram and one
    equi-join on (l, cell), no pairs. The own cluster is always among them unless all weights of the row's cells are 0.
    """
    rows = cells.select(F.col(id_col).alias("id"), "cells").join(labels.select(F.col(id_col).alias("id"), F.col("label").alias("own")), "id")
    long = rows.select("id", "own", F.posexplode("cells").alias("l", "cell"))
    first = cells.select(F.size("cells")).first()
    length = first[0] if first else 1
    w = np.full(length, 1 / length) if weights is None else np.asarray(weights, float) / np.sum(weights)
    sizes = labels.groupBy(F.col("label").alias("cluster")).agg(F.count("*").alias("size"))
    hist = long.groupBy("l", "cell", F.col("own").alias("cluster")).agg(F.count("*").alias("n"))
    at = F.element_at(F.array(*[F.lit(float(x)) for x in w]), F.col("l") + 1)
    share = hist.join(broadcast_if_small(sizes), "cluster").select("l", "cell", "cluster", "size", (at * F.col("n") / F.col("size")).alias("part"))
    return long.join(broadcast_if_small(share), ["l", "cell"]).groupBy("id", "own", "cluster", "size").agg(F.sum("part").alias("similarity")).select("id", "own", "cluster", "size", "similarity")


def mean_similarity(cells: DataFrame, labels: DataFrame, id_col: str, weights: list[float] | None = None) -> DataFrame:
    """As `overlaps`, for every row and every cluster, with 0 where nothing overlaps: rows x clusters rows by definition.

    What only needs sums or extremes over the clusters (silhouettes, affinities, blocks) goes by `overlaps`.
    """
    some = overlaps(cells, labels, id_col, weights)
    every = labels.groupBy("label").agg(F.count("*").alias("size")).agg(F.collect_list(F.struct(F.col("label").alias("cluster"), "size")).alias("all"))
    held = some.groupBy("id", "own").agg(F.map_from_entries(F.collect_list(F.struct("cluster", "similarity"))).alias("held"))
    wide = held.crossJoin(F.broadcast(every)).select("id", "own", "held", F.explode("all").alias("c"))  # one row of all clusters
    return wide.select("id", "own", "c.cluster", "c.size", F.coalesce(F.element_at("held", F.col("c.cluster")), F.lit(0.0)).alias("similarity"))


def block_means(cells: DataFrame, labels: DataFrame, id_col: str, weights: list[float] | None = None) -> DataFrame:
    """(own, cluster, similarity): mean similarity between the rows of two clusters; within a cluster without the rows themselves (null for one row)."""
    some = overlaps(cells, labels, id_col, weights).groupBy("own", "cluster").agg(F.sum("similarity").alias("s"), F.max("size").alias("size"))
    sizes = labels.groupBy(F.col("label").alias("own")).agg(F.count("*").alias("rows"))
    every = sizes.select("own", "rows").crossJoin(F.broadcast(sizes.agg(F.collect_list("own").alias("all")))).select("own", "rows", F.explode("all").alias("cluster"))
    x = every.join(some, ["own", "cluster"], "left")
    mean = F.coalesce(F.col("s"), F.lit(0.0)) / F.col("rows")
    return x.select("own", "cluster", F.when(F.col("own") != F.col("cluster"), mean).when(F.col("rows") > 1, (mean * F.col("rows") - 1) / (F.col("rows") - 1)).alias("similarity"))


def knn(cells: DataFrame, id_col: str, k: int, block: int = BLOCK_ROWS) -> DataFrame:
    """(src, dst, dist): exact k nearest rows by number of differing cells; equal distances by smaller id. Every block is compared with every block."""
    n = cells.count()
    rows = cells.select(F.col(id_col).cast("bigint").alias("id"), "cells")
    return top_k(within_blocks(rows, F.lit(parts_of(n, block)), [], _nearest(k), "src bigint, dst bigint, dist int"), k)


def nearest_other(x: DataFrame, y: DataFrame, x_id: str, y_id: str, block: int = BLOCK_ROWS) -> DataFrame:
    """(id, other, dist): for every row of x the row of y with the fewest differing cells (equal ones: the smallest id), block by block."""

    def kernel(a: pd.DataFrame, b: pd.DataFrame, same: bool) -> pd.DataFrame:
        b = b.sort_values("id", kind="stable")
        ia, ib, xa, xb = a["id"].to_numpy(), b["id"].to_numpy(), _codes(a), _codes(b)
        out = []
        for lo in range(0, len(ia), 256):
            d = _apart(xa[lo : lo + 256], xb, None)
            at = d.argmin(1)
            out.append(pd.DataFrame({"id": ia[lo : lo + 256], "other": ib[at], "dist": d[np.arange(len(at)), at]}))
        return pd.concat(out)

    left, right = x.select(F.col(x_id).cast("bigint").alias("id"), "cells"), y.select(F.col(y_id).cast("bigint").alias("id"), "cells")
    got = by_blocks(left, right, F.lit(parts_of(x.count(), block)), F.lit(parts_of(y.count(), block)), [], kernel, "id bigint, other bigint, dist int")
    return got.groupBy("id").agg(F.min(F.struct("dist", "other")).alias("m")).select("id", "m.other", "m.dist")


def _nearest(k: int) -> Kernel:
    """The k nearest in the other block of every row of either block."""

    def best(src: np.ndarray, others: np.ndarray, dist: np.ndarray) -> pd.DataFrame:
        # distance and place in one number: the k least of a row are its neighbours, equal distances by smaller id
        m, far = len(others), np.iinfo(np.int64).max
        key = dist.astype(np.int64) * m + np.arange(m)
        key[src[:, None] == others[None, :]] = far
        key = np.sort(np.partition(key, k - 1, axis=1)[:, :k] if k < m else key, axis=1)
        near = key.ravel()
        held = near < far
        return pd.DataFrame({"src": np.repeat(src, key.shape[1])[held], "dst": others[near[held] % m], "dist": (near[held] // m).astype(np.int32)})

    def kernel(a: pd.DataFrame, b: pd.DataFrame, same: bool) -> pd.DataFrame:
        a, b = a.sort_values("id", kind="stable"), b.sort_values("id", kind="stable")
        ia, ib = a["id"].to_numpy(), b["id"].to_numpy()
        xa, xb = _narrow(_codes(a), _codes(b))
        out = []
        for lo in range(0, len(ia), 256):
            out.append(best(ia[lo : lo + 256], ib, _apart(xa[lo : lo + 256], xb, None)))
        for lo in range(0, 0 if same else len(ib), 256):
            out.append(best(ib[lo : lo + 256], ia, _apart(xb[lo : lo + 256], xa, None)))
        return pd.concat(out)

    return kernel


def bands(cells: DataFrame, id_col: str, width: int) -> DataFrame:
    """(id, band, key): consecutive runs of `width` cells."""
    each = F.transform(F.sequence(F.lit(0), F.greatest(F.floor(F.size("cells") / width).cast("int") - 1, F.lit(0))), lambda b: F.struct(b.alias("band"), F.array_join(F.slice("cells", b * width + 1, F.lit(width)), ",").alias("key")))
    return cells.select(F.col(id_col).alias("id"), "cells", F.explode(each).alias("b")).select("id", "cells", "b.band", "b.key")


def bucket_loads(cells: DataFrame, id_col: str, length: int, widths: tuple[int, ...] = BANDS) -> DataFrame:
    """Per band width: mean bucket size seen by a row, and the share of rows with company."""
    out = None
    for w in [x for x in widths if x <= length]:
        size = bands(cells, id_col, w).groupBy("band", "key").agg(F.count("*").alias("n"))
        one = size.agg((F.sum(F.col("n") * F.col("n")) / F.sum("n")).alias("load"), (F.sum(F.when(F.col("n") > 1, F.col("n")).otherwise(0)) / F.sum("n")).alias("coverage")).select(F.lit(w).alias("width"), "load", "coverage")
        out = one if out is None else out.unionByName(one)
    return out


def choose_band(cells: DataFrame, id_col: str, length: int, k: int) -> int:
    """The narrowest width whose load and coverage suit k neighbours (load at most 8k, coverage at least 0.7), else the best compromise. Counted over all rows."""
    rows = bucket_loads(cells, id_col, length).collect()  # one row per width
    best, score = min(BANDS[-1], length), -np.inf
    for r in sorted(rows, key=lambda r: r["width"]):
        if r["load"] is None:
            continue
        if r["load"] <= 8 * k and r["coverage"] >= 0.7:
            return r["width"]
        s = min(r["coverage"], 8 * k / max(r["load"], 1e-9))
        if s > score:
            best, score = r["width"], s
    return best


def lsh_knn(cells: DataFrame, id_col: str, k: int, width: int, max_bucket: int = 150, block: int = BLOCK_ROWS) -> DataFrame:
    """(src, dst, dist): k nearest among all rows that share a band, by exact number of differing cells.

    A bucket above max_bucket is compared block by block and keeps k candidates a row and block, so a hot bucket
    takes time by its square, and no row of it is left out. Rows that share no band are never compared; use knn for those.
    """
    b = bands(cells, id_col, width)
    size = b.groupBy("band", "key").agg(F.count("*").alias("n")).where("n > 1")
    sized = b.select(F.col("id").cast("bigint").alias("id"), "cells", "band", "key").join(size, ["band", "key"])
    small = sized.where(F.col("n") <= max_bucket)
    left = small.select("band", "key", F.col("id").alias("src"), F.col("cells").alias("a"))
    right = small.select("band", "key", F.col("id").alias("dst"), F.col("cells").alias("b"))
    near = left.join(right, ["band", "key"]).where(F.col("src") != F.col("dst")).select("src", "dst", mismatches("a", "b").alias("dist"))
    hot = sized.where(F.col("n") > max_bucket)
    big = within_blocks(hot, F.ceil(F.col("n") / block), ["band", "key"], _nearest(k), "src bigint, dst bigint, dist int")
    return top_k(near.unionByName(big).dropDuplicates(["src", "dst"]), k)


def sparse_graph(cells: DataFrame, id_col: str, k: int, banding: bool = False) -> DataFrame:
    """(src, dst, dist) in both directions: exact neighbours, or banded ones with as good a band width as a sample shows.

    Should banding find fewer edges than rows, the exact neighbours are taken instead.
    """
    if banding:
        r = cells.agg(F.count("*").alias("n"), F.max(F.size("cells")).alias("l")).first()
        near = materialise(lsh_knn(cells, id_col, k, choose_band(cells, id_col, r["l"] or 1, k)))
        if near.count() >= r["n"]:
            return symmetrise(near)
    return symmetrise(knn(cells, id_col, k))


def top_k(edges: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("src").orderBy("dist", "dst")
    return edges.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("src", "dst", "dist")


def symmetrise(edges: DataFrame) -> DataFrame:
    """Union of both directions, the larger distance where they differ."""
    return edges.select("src", "dst", "dist").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "dist")).groupBy("src", "dst").agg(F.max("dist").alias("dist"))


def mutual(edges: DataFrame) -> DataFrame:
    """Edges present in both directions."""
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("dist").alias("back"))
    return edges.join(back, ["src", "dst"]).select("src", "dst", F.least("dist", "back").alias("dist"))


def edge_similarity(edges: DataFrame, kind: str = "linear") -> DataFrame:
    """(src, dst, w). exp: Gaussian of the median positive distance; linear: 1 - d/max; inverse: 1/(d + tiny). Distance 0 stays an edge."""
    if kind == "exp":
        s = edges.where("dist > 0").agg(F.percentile("dist", F.lit(0.5)).alias("s"))
        w = F.exp(-(F.col("dist") ** 2) / (2 * (F.coalesce("s", F.lit(1.0)) + 1e-10) ** 2))
    elif kind == "linear":
        s = edges.agg(F.max("dist").alias("s"))
        w = F.greatest(F.when(F.col("s") > 0, 1 - F.col("dist") / F.col("s")).otherwise(1.0), F.lit(0.0))
    else:
        return edges.select("src", "dst", (1 / (F.col("dist") + 1e-10)).alias("w"))
    return edges.crossJoin(F.broadcast(s)).select("src", "dst", w.alias("w"))
