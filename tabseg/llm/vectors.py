"""Vectors of records shared by the clustering, subset and neighbour operators, and k-means over them.

Records become vectors of standardised numbers and of hashed, weighted categories. For k-means they are first
summarised without loss of mass: rows of one fine grid cell and one category bucket become one weighted point,
their mean. Every pass then runs over the weighted points of all rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabseg.functions.quantiles import exact_quantiles
from tabseg.session import finite, materialise

#: Buckets into which categories are hashed.
BUCKETS = 16
#: Quantiles from which centre, scale and extent of a column are taken.
PROBS = (0.001, 0.25, 0.5, 0.75, 0.999)
#: Grid cell of the summary, in units of scale.
CELL = 0.03


@dataclass(frozen=True)
class Space:
    """Numeric columns (with their expressions), the categorical one, and how they are scaled."""

    numbers: list[str]
    centre: list[float] = field(default_factory=list)
    scale: list[float] = field(default_factory=list)
    weight: float = 0.25  # length of a category's hashed feature, in units of scale
    extent: list[float] = field(default_factory=list)  # from the lowest to the highest of PROBS, in units of scale

    @property
    def width(self) -> int:
        return len(self.numbers) + BUCKETS

    def features(self, numbers: np.ndarray, bucket: np.ndarray) -> np.ndarray:
        """Standardised numbers, then the weighted hashed category (no feature for bucket -1)."""
        out = np.zeros((len(numbers), self.width))
        out[:, : len(self.numbers)] = numbers
        held = np.flatnonzero(bucket >= 0)
        out[held, len(self.numbers) + bucket[held]] = self.weight
        return out


def fit_space(df: DataFrame, numbers: list[str], weight: float = 0.25) -> Space:
    """Median and interquartile range (over 1.349, so that it is a standard deviation under a normal) of the finite numbers, over all rows and exact, so that
    no outlier stretches the scale; where half of the values are equal, the standard deviation. Constant columns get scale 1."""
    q = exact_quantiles(df.select(*numbers), {c: list(PROBS) for c in numbers})
    centre = [q[c][2] or 0.0 for c in numbers]
    scale = [((q[c][3] or 0.0) - (q[c][1] or 0.0)) / 1.349 for c in numbers]
    if not all(scale):
        r = df.agg(*[F.stddev_pop(F.when(finite(F.col(c)), F.col(c))).alias(f"s{i}") for i, c in enumerate(numbers)]).first()
        scale = [x or r[f"s{i}"] or 1.0 for i, x in enumerate(scale)]
    extent = [((q[c][4] or 0.0) - (q[c][0] or 0.0)) / x for c, x in zip(numbers, scale)]
    return Space(list(numbers), centre, scale, weight, extent)


def bucket_of(category: Column) -> Column:
    """Hash bucket of a category, -1 for null."""
    return F.when(category.isNull(), -1).otherwise(F.pmod(F.crc32(category.cast("binary")), F.lit(BUCKETS))).cast("int")


def bucket_number(category: str) -> int:
    return zlib.crc32(category.encode()) % BUCKETS


def standardised(space: Space) -> list[Column]:
    return [((F.col(c) - F.lit(m)) / F.lit(s)).alias(f"z{i}") for i, (c, m, s) in enumerate(zip(space.numbers, space.centre, space.scale))]


def summarise(df: DataFrame, space: Space, category: Column, keep: list[Column] | None = None, cell: float = CELL) -> DataFrame:
    """Weighted points (n, z0.., bucket, and the columns keep, by which they are kept apart), stored.

    Numbers must be finite. The number of points is bounded by the occupied cells, not by the rows.
    """
    keep = keep or []
    z = df.select(*standardised(space), bucket_of(category).alias("bucket"), *keep)
    names = [f"z{i}" for i in range(len(space.numbers))]
    by = [F.floor(F.col(n) / cell).alias(f"g{i}") for i, n in enumerate(names)]
    kept = [c for c in z.columns if c not in names]
    out = z.groupBy(*by, *kept).agg(F.count("*").cast("double").alias("n"), *[F.avg(n).alias(n) for n in names])
    return materialise(out.select("n", *names, *kept))


def _block(space: Space, b: pd.DataFrame) -> np.ndarray:
    return space.features(b[[f"z{i}" for i in range(len(space.numbers))]].to_numpy(float), b["bucket"].to_numpy(int))


def nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centre and the squared distance to it."""
    half = (centres * centres).sum(1) / 2
    best, dist = np.empty(len(x), np.int64), np.empty(len(x))
    for i in range(0, len(x), 8192):
        s = half - x[i : i + 8192] @ centres.T
        j = s.argmin(1)
        best[i : i + 8192] = j
        dist[i : i + 8192] = 2 * s[np.arange(len(j)), j] + (x[i : i + 8192] ** 2).sum(1)
    return best, np.maximum(dist, 0)


def _draws(b: pd.DataFrame, seed: int) -> np.ndarray:
    """Reproducible uniforms that depend on the points alone, not on partitions or their order."""
    h = pd.util.hash_pandas_object(b[[c for c in b.columns if c[0] == "z" or c == "bucket"]], index=False).to_numpy()
    h = (h ^ np.uint64((seed * 0x9E3779B97F4A7C15) & (2**64 - 1))) * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(31)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(29)
    return (h >> np.uint64(11)).astype(float) / 2.0**53


def seed_centres(points: DataFrame, space: Space, k: int, rounds: int = 4, seed: int = 2) -> np.ndarray:
    """Parallel oversampled seeding (k-means||): each round draws about 2k points in proportion to their cost."""
    first = points.agg(F.sum("n").alias("n"), *[(F.sum(F.col(f"z{i}") * F.col("n")) / F.sum("n")).alias(f"z{i}") for i in range(len(space.numbers))]).first()
    if not first["n"]:
        return np.zeros((0, space.width))
    centres = np.zeros((1, space.width))
    centres[0, : len(space.numbers)] = [first[f"z{i}"] for i in range(len(space.numbers))]
    d = space.width
    cost = None
    for turn in range(rounds + 1):
        now, held = centres, cost

        def run(batches: Iterator[pd.DataFrame], now: np.ndarray = now, held: float | None = held, turn: int = turn) -> Iterator[pd.DataFrame]:
            total = 0.0
            for b in batches:
                if not len(b):
                    continue
                x, n = _block(space, b), b["n"].to_numpy(float)
                mass = n * nearest(x, now)[1]
                total += mass.sum()
                if held:
                    chosen = _draws(b, seed + turn) < 2 * k * mass / held
                    if chosen.any():
                        yield pd.DataFrame({"x": list(x[chosen]), "cost": 0.0})
            yield pd.DataFrame({"x": [np.zeros(0)], "cost": [total]})

        got = points.mapInPandas(run, "x array<double>, cost double").toPandas()
        cost = got["cost"].sum()
        new = [x for x in got["x"] if len(x) == d]
        if new:
            new = np.array(new)
            centres = np.concatenate((centres, new[np.lexsort(new.T)]))
        if cost <= 0:
            break
    if len(centres) <= k:
        return centres
    # weigh the candidates by the mass nearest to them, then reduce them to k
    weights = _sums(points, space, centres)[0]
    rng = np.random.default_rng(seed)
    chosen = [int(weights.argmax())]
    dist = ((centres - centres[chosen[0]]) ** 2).sum(1)
    while len(chosen) < k and (mass := weights * dist).sum() > 0:
        i = int(rng.choice(len(centres), p=mass / mass.sum()))
        chosen.append(i)
        dist = np.minimum(dist, ((centres - centres[i]) ** 2).sum(1))
    return centres[chosen]


def _sums(points: DataFrame, space: Space, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mass, sum of vectors and cost of each centre; partitions send one row per centre."""
    k, d = centres.shape

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        mass, sums, cost = np.zeros(k), np.zeros((k, d)), np.zeros(k)
        for b in batches:
            if not len(b):
                continue
            x, n = _block(space, b), b["n"].to_numpy(float)
            j, dist = nearest(x, centres)
            mass += np.bincount(j, n, k)
            cost += np.bincount(j, n * dist, k)
            for i in range(d):
                sums[:, i] += np.bincount(j, n * x[:, i], k)
        at = np.flatnonzero(mass)
        if len(at):
            yield pd.DataFrame({"j": at, "mass": mass[at], "cost": cost[at], "sums": list(sums[at])})

    got = points.mapInPandas(run, "j bigint, mass double, cost double, sums array<double>")
    # added up in the cluster, in the order of the partitions' totals, so that the driver gets k rows
    got = got.groupBy("j").agg(F.sum("mass").alias("mass"), F.sum("cost").alias("cost"), *[F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(d)]).toPandas()
    mass, sums, cost = np.zeros(k), np.zeros((k, d)), np.zeros(k)
    at = got["j"].to_numpy(int)
    mass[at], cost[at] = got["mass"], got["cost"]
    sums[at] = got[[f"s{i}" for i in range(d)]].to_numpy(float)
    return mass, sums, cost


def kmeans(points: DataFrame, space: Space, k: int, steps: int = 6, seed: int = 2) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Centres, their mass and their mean squared distance, by k-means|| seeding and full passes. Empty centres are dropped."""
    centres = seed_centres(points, space, k, seed=seed)
    if not len(centres):
        return centres, np.zeros(0), np.zeros(0)
    for _ in range(steps):
        mass, sums, cost = _sums(points, space, centres)
        held = mass > 0
        moved = sums[held] / mass[held, None]
        still = len(moved) == len(centres) and np.abs(moved - centres).max() < 1e-4
        centres = moved
        if still:
            break
    mass, _, cost = _sums(points, space, centres)
    held = mass > 0
    return centres[held], mass[held], cost[held] / mass[held]


def minibatch_kmeans(points: DataFrame, space: Space, k: int, batches: int = 8, passes: int = 2, seed: int = 2) -> np.ndarray:
    """Centres by mini-batch k-means: batches are disjoint random parts of all points, each centre moves by
    the share that the batch has of all the mass it has seen, so every point is used once per pass."""
    centres = seed_centres(points, space, k, rounds=2, seed=seed)
    if not len(centres):
        return centres
    seen = np.zeros(len(centres))
    for p in range(passes):
        for b in range(batches):
            part = points.where(F.pmod(F.xxhash64(*[f"z{i}" for i in range(len(space.numbers))], "bucket", F.lit(seed + p)), F.lit(batches)) == b)
            mass, sums, _ = _sums(part, space, centres)
            seen += mass
            held = mass > 0
            centres[held] += (sums[held] - mass[held, None] * centres[held]) / seen[held, None]
    return centres
