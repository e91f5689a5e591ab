"""The k nearest vectors of every query vector (problem 5), by an adaptive dimension scan over inverted lists.

The vectors are turned by a random rotation and put into the lists of their nearest centres (k-means on a
bounded sample; every vector is indexed). Within a list distances grow by column blocks; after each block a
hypothesis test on the partial distance abandons candidates that are unlikely to be among the nearest. A
query first scans its nearest list like that, which bounds the distance of its k-th neighbour. The check that
follows scans every list which that bound cannot rule out and abandons only candidates whose partial
distance alone exceeds it: the result is exact, however many lists were probed first. Without the check
(`exact=False`) the test decides there too, at an error that its margin controls.

Lists are cut into blocks of bounded size and so are the queries of a list, so a list that holds a third of all
vectors or queries is scanned by many tasks; each task returns its best k per query.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window

from tabseg.session import broadcast_if_small, materialise

#: Vectors on which the centres of the lists are fitted.
SAMPLE = 60_000
#: Vectors that a list should hold, and the largest number of lists.
LIST_SIZE, MOST_LISTS = 4000, SAMPLE // 8
#: Vectors and queries of one block.
BLOCK, QUERIES = 16_000, 20_000
#: Tasks over which the queries of one group are spread.
SALTS = 24


def _rotation(d: int, seed: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(d, d)))
    return q * np.sign(np.diag(r))


def _fit_lists(sample: np.ndarray, k: int, seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    sample = np.unique(sample, axis=0)
    if len(sample) <= k:
        return sample
    centres = sample[rng.choice(len(sample), k, replace=False)]
    for _ in range(6):
        j = _closest(sample, centres)[0]
        n = np.bincount(j, minlength=k)
        held = n > 0
        sums = np.stack([np.bincount(j, sample[:, i], k) for i in range(sample.shape[1])], 1)
        centres = sums[held] / n[held, None]
        k = len(centres)
    return centres


def _closest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    half = (centres * centres).sum(1) / 2
    best = np.empty(len(x), np.int64)
    for i in range(0, len(x), 4096):
        best[i : i + 4096] = (half - x[i : i + 4096] @ centres.T).argmin(1)
    gap = np.sqrt(((x - centres[best]) ** 2).sum(1)) if len(x) else np.zeros(0)
    return best, gap


def _best(a: np.ndarray, b: np.ndarray, dist: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """The k first of each query a by distance and id, and their rank from 0."""
    order = np.lexsort((b, dist, a))
    a, b, dist = a[order], b[order], dist[order]
    starts = np.flatnonzero(np.append(True, a[1:] != a[:-1])) if len(a) else np.zeros(0, np.int64)
    rank = np.arange(len(a)) - np.repeat(starts, np.diff(np.append(starts, len(a))))
    top = rank < k
    return a[top], b[top], dist[top], rank[top]


def scan(q: np.ndarray, bound: np.ndarray, own: np.ndarray, x: np.ndarray, ids: np.ndarray, turn: np.ndarray, k: int, width: int, margin: float | None) -> tuple[np.ndarray, ...]:
    """Best k of the rows x for each query within its bound (squared): query, id, squared distance.

    turn: the rotation; width: columns per block; own: the queries' ids, which are not their own
    neighbours. What the scan of the rotated columns leaves is measured again in the given coordinates.
    """
    d = x.shape[1]
    qt, xt = q @ turn, x @ turn
    out: list[tuple[np.ndarray, ...]] = []
    for at in range(0, len(q), 256):
        some = slice(at, at + 256)
        limit = bound[some].copy()
        for lo in range(0, len(x), 4096):
            y, name = xt[lo : lo + 4096], ids[lo : lo + 4096]
            part = np.zeros((len(limit), len(y)))
            for c in range(min(width, d)):
                part += (qt[some, c, None] - y[None, :, c]) ** 2
            loose = limit * (1 + 1e-9) + 1e-12
            a, b = np.nonzero(_may_be_near(part, loose[:, None], min(width, d), d, margin))
            dist = part[a, b]
            for c in range(width, d, width):
                e = qt[at + a, c : c + width] - y[b, c : c + width]
                dist = dist + np.einsum("ij,ij->i", e, e)
                held = _may_be_near(dist, loose[a], min(c + width, d), d, margin)
                a, b, dist = a[held], b[held], dist[held]
            exact = np.zeros(len(a))
            for c in range(d):
                exact += (q[at + a, c] - x[lo + b, c]) ** 2
            held = (exact <= limit[a]) & (name[b] != own[at + a])
            a, near, dist, rank = _best(a[held], name[b[held]], exact[held], k)
            out.append((at + a, near, dist))
            full = rank == k - 1
            limit[a[full]] = np.minimum(limit[a[full]], dist[full])
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    return _best(*(np.concatenate(z) for z in zip(*out)), k)[:3]


def _may_be_near(part: np.ndarray, limit: np.ndarray, seen: int, d: int, margin: float | None) -> np.ndarray:
    """Whether the whole distance may still be within the limit, given the partial distance over `seen` of d columns.

    Under a random rotation the partial distance estimates seen/d of the whole; the hypothesis that the whole
    is within the limit is rejected when the estimate exceeds it by a relative error of margin/sqrt(seen).
    """
    if seen == d or margin is None:
        return part <= limit
    return np.sqrt(part * d / seen) <= np.sqrt(limit) * (1 + margin / np.sqrt(seen))


def _matrix(column: pa.ChunkedArray | pa.Array, d: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, d)


def nearest_rows(vectors: DataFrame, queries: DataFrame, k: int = 5, margin: float = 2.0, width: int = 1, exact: bool = True, seed: int = 5) -> DataFrame:
    """Columns qid, id, dist (Euclidean), rank: the k nearest vectors of each query within its group.

    vectors: id, grp, x (array<double> of one length, finite), ids unique; queries: likewise, with their own
    id, which is not its own neighbour. Equal distances: smaller id first. A query in a group of fewer than
    k others gets them all. Null groups and non-finite vectors are left out by the caller. Without
    vectors or queries the result is empty.
    """
    n = vectors.agg(F.count("*").alias("n"), F.max(F.size("x")).alias("d")).first()
    d = n["d"] or 1
    turn = _rotation(d, seed)
    share = min(1.0, SAMPLE / max(n["n"], 1))
    sample = vectors.where(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1_000_000)) < int(1_000_000 * share) + 1).select("x").limit(2 * SAMPLE)
    known = np.array([r[0] for r in sample.collect()], float).reshape(-1, d)
    centres = _fit_lists(known, int(min(max(n["n"] // LIST_SIZE, 1), MOST_LISTS)), seed)
    kind = vectors.schema["grp"].dataType.simpleString()

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                j, gap = _closest(_matrix(b.column(2), d), centres)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(j.astype(np.int32)), pa.array(gap)], names=["id", "grp", "x", "list", "gap"])

    indexed = vectors.select(F.col("id").cast("bigint"), "grp", "x").mapInArrow(place, f"id bigint, grp {kind}, x array<double>, list int, gap double")
    indexed = materialise(indexed)
    lists = materialise(indexed.groupBy("grp", "list").agg(F.count("*").alias("size"), F.max("gap").alias("radius"), F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")))
    blocks = broadcast_if_small(lists.select("grp", "list", "blocks"))
    # a group's queries are spread over SALTS tasks, each of which gets the group's lists (at most MOST_LISTS)
    salted = lists.select("grp", "list", "size", "radius", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    asked = materialise(queries.select(F.col("id").cast("bigint"), "grp", "x").withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")))
    group_type = pa.schema([("grp", to_arrow_type(vectors.schema["grp"].dataType))]).field("grp").type
    kinds = {"id": pa.int64(), "grp": group_type, "x": pa.list_(pa.float64()), "list": pa.int32(), "bound": pa.float64()}

    def probes(some: DataFrame, first: bool) -> DataFrame:
        """The lists that each query has to scan: the nearest that hold enough vectors, or (then) those which the bound leaves."""

        def one(left: pa.Table, right: pa.Table) -> pa.Table:
            out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            if left.num_rows and right.num_rows:
                at = right["list"].to_numpy()
                order = np.argsort(at)
                at, size, radius = at[order], right["size"].to_numpy()[order], right["radius"].to_numpy()[order]
                x = _matrix(left["x"], d)
                bound = np.full(len(x), np.inf) if first else left["bound"].to_numpy()
                for lo in range(0, len(x), 256):
                    away = np.sqrt(((x[lo : lo + 256, None] - centres[at][None]) ** 2).sum(2))
                    near = np.argsort(away, axis=1, kind="stable")
                    held = size[near]
                    begun = np.zeros(away.shape, bool)
                    np.put_along_axis(begun, near, np.cumsum(held, 1) - held < k + 1, 1)
                    # what the triangle inequality cannot rule out
                    use = begun if first else (np.maximum(away - radius, 0) <= np.sqrt(bound[lo : lo + 256, None]) * (1 + 1e-9) + 1e-12)
                    q, j = np.nonzero(use)
                    out.append((lo + q, at[j], bound[lo + q]))
            q, j, bound = (np.concatenate(z) for z in zip(*out)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0))
            got = left.select(["id", "grp", "x"]).take(pa.array(q, pa.int64()))
            return pa.table([got["id"].cast(kinds["id"]), got["grp"].cast(kinds["grp"]), got["x"].cast(kinds["x"]), pa.array(j, pa.int32()), pa.array(bound, pa.float64())], names=list(kinds))

        return some.groupBy("grp", "salt").cogroup(salted.groupBy("grp", "salt")).applyInArrow(one, f"id bigint, grp {kind}, x array<double>, list int, bound double")

    def search(asks: DataFrame, test: float | None) -> DataFrame:
        """Best k of each query in each block of the lists it probes."""
        by = ["grp", "list", "block", "part"]
        # a list's queries are dealt into parts, each of which meets every block; lists that no query probes are left out
        asks = materialise(asks)
        many = broadcast_if_small(asks.groupBy("grp", "list").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("parts")))
        part = F.pmod(F.xxhash64("id", F.lit("part")), F.col("parts")).cast("int")
        spread = asks.join(blocks, ["grp", "list"]).join(many, ["grp", "list"]).withColumn("part", part).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks", "parts")
        split = indexed.join(blocks, ["grp", "list"]).join(many, ["grp", "list"])
        split = split.select("id", "grp", "list", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "x")

        def one(left: pa.Table, right: pa.Table) -> pa.Table:
            if left.num_rows and right.num_rows:
                own = left["id"].to_numpy()
                a, b, dist = scan(_matrix(left["x"], d), left["bound"].to_numpy(), own, _matrix(right["x"], d), right["id"].to_numpy(), turn, k, width, test)
            else:
                own, a, b, dist = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
            return pa.table({"qid": pa.array(own[a], pa.int64()), "id": pa.array(b, pa.int64()), "d2": pa.array(dist, pa.float64())})

        return spread.groupBy(*by).cogroup(split.groupBy(*by)).applyInArrow(one, "qid bigint, id bigint, d2 double")

    begun = materialise(search(probes(asked, True), margin))
    kth = Window.partitionBy("qid").orderBy("d2", "id")
    bound = begun.withColumn("rank", F.row_number().over(kth)).where(F.col("rank") == k).select(F.col("qid").alias("id"), F.col("d2").alias("bound"))
    again = asked.join(bound, "id", "left").withColumn("bound", F.coalesce("bound", F.lit(float("inf"))))
    found = search(probes(again, False), None if exact else margin)
    found = found.withColumn("rank", F.row_number().over(kth)).where(F.col("rank") <= k)
    return found.select("qid", "id", F.sqrt("d2").alias("dist"), "rank")


def vector(cols: list[str]) -> Column:
    return F.array(*[F.col(c).cast("double") for c in cols])
