"""Segments of mutually similar records, with strays left out (problem 2).

k-means with parallel oversampled seeding places many centres over the weighted points of all rows; centres
of sparse regions are dropped and the centres are fitted again on what is left. Neighbouring centres between
which the density does not fall off form one component; a component in which several categories hold a
substantial share is one segment per such category, for members of a segment agree in it apart from a few.
A row belongs to the segment of its nearest centre unless it lies farther from it than the rows around that
centre do.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabseg.llm.vectors import BUCKETS, CELL, Space, _sums, bucket_of, fit_space, kmeans, nearest, standardised, summarise
from tabseg.session import materialise

#: Edge of the coarse cells that are counted to choose the number of centres (in units of scale), centres per coarse cell that is dense, and the fewest and most centres.
COARSE, PER_CELL, FEWEST, MOST = 0.5, 3, 64, 1024
#: A centre is dense if the density around it is so many times the mean density over the occupied box.
DENSE = 2.0
#: Least density half way between two centres, as a share of the smaller of theirs, that joins them.
VALLEY = 0.2
#: Least share of a component that makes a category a segment of its own.
SHARE = 0.08
#: A component needs so many rows to count as a segment, however large the table is.
LEAST_ROWS = 10
#: A row farther from its centre than so many root mean square distances is a stray.
REACH = 3.0


@dataclass(frozen=True)
class Segments:
    space: Space
    centres: np.ndarray  # numeric part, standardised
    radius: np.ndarray
    mass: np.ndarray
    segment: np.ndarray  # by centre and bucket + 1

    def place(self, z: np.ndarray, bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Segment (-1: stray), nearest centre and distance to it."""
        if not len(self.centres):
            return np.full(len(z), -1), np.full(len(z), -1), np.zeros(len(z))
        j, d2 = nearest(z, self.centres)
        d = np.sqrt(d2)
        return np.where(d <= REACH * self.radius[j], self.segment[j, bucket + 1], -1), j, d


def _density(mass: np.ndarray, square: np.ndarray, width: int) -> np.ndarray:
    """Mass over the volume of a ball whose mean squared distance is `square` (uniform ball: d/(d+2) of its squared radius)."""
    radius = np.sqrt(np.maximum(square, 1e-8) * (width + 2) / width)
    return mass / (math.pi ** (width / 2) / math.gamma(width / 2 + 1) * radius**width)


def mean_density(points: DataFrame, space: Space) -> float:
    """Rows per unit of volume over the extent of the data."""
    return (points.agg(F.sum("n")).first()[0] or 0.0) / float(np.prod([max(x, 4 * CELL) for x in space.extent]))


def centres_for(points: DataFrame, space: Space) -> int:
    """How many centres the data ask for: PER_CELL for every coarse cell of more than DENSE times the mean density, whatever the number of rows."""
    names = [f"z{i}" for i in range(len(space.numbers))]
    by = [F.floor(F.col(c) / COARSE).alias(f"g{i}") for i, c in enumerate(names)]
    full = points.groupBy(*by).agg(F.sum("n").alias("n")).where(F.col("n") > DENSE * mean_density(points, space) * COARSE ** len(names)).count()
    return min(max(PER_CELL * full, FEWEST), MOST)


def _mass_near(points: DataFrame, names: list[str], probes: np.ndarray, reach: np.ndarray) -> np.ndarray:
    """Mass within `reach` of each probe."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = np.zeros(len(probes))
        half = (probes * probes).sum(1)
        for b in batches:
            x, n = b[names].to_numpy(float), b["n"].to_numpy(float)
            for i in range(0, len(x), 4096):
                y = x[i : i + 4096]
                out += n[i : i + 4096] @ (half + (y * y).sum(1)[:, None] - 2 * (y @ probes.T) <= reach**2)
        at = np.flatnonzero(out)
        yield pd.DataFrame({"j": at, "mass": out[at]})

    got = points.mapInPandas(run, "j bigint, mass double").groupBy("j").agg(F.sum("mass").alias("mass")).toPandas()
    out = np.zeros(len(probes))
    out[got["j"].to_numpy(int)] = got["mass"]
    return out


def _components(centres: np.ndarray, radius: np.ndarray, points: DataFrame, names: list[str]) -> np.ndarray:
    """Number of the component of each centre (the centres are bounded, so this is done on the driver)."""
    gap = np.sqrt(((centres[:, None] - centres[None]) ** 2).sum(2))
    a, b = np.nonzero((gap <= 2.0 * (radius[:, None] + radius[None])) & (np.arange(len(centres))[:, None] < np.arange(len(centres))))
    reach = (radius[a] + radius[b]) / 2
    probes = np.concatenate(((centres[a] + centres[b]) / 2, centres[a], centres[b]))
    mass = _mass_near(points, names, probes, np.tile(reach, 3)).reshape(3, -1) if len(a) else np.zeros((3, 0))
    label = np.arange(len(centres))
    for i, j in zip(a[mass[0] >= VALLEY * np.minimum(mass[1], mass[2])], b[mass[0] >= VALLEY * np.minimum(mass[1], mass[2])]):
        label[label == label[j]] = label[i]
    return np.unique(label, return_inverse=True)[1]


def _near(points: DataFrame, space: Space, centres: np.ndarray, dense: np.ndarray, radius: np.ndarray) -> DataFrame:
    """The points whose nearest centre is a dense one, within reach of it."""
    names = [f"z{i}" for i in range(len(space.numbers))]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            j, d2 = nearest(b[names].to_numpy(float), centres)
            yield b[dense[j] & (d2 <= (REACH * radius[j]) ** 2)]

    return materialise(points.mapInPandas(run, points.schema))


def fit_segments(df: DataFrame, numbers: list[str], category: Column, k: int | None = None, seed: int = 2, least_rows: int = LEAST_ROWS) -> Segments:
    """df: rows with finite numbers. An empty table gives no segments; equal rows form one. k: centres of k-means, chosen from the data if None."""
    space = fit_space(df, numbers)
    d = len(numbers)
    names = [f"z{i}" for i in range(d)]
    points = summarise(df, space, category)
    mean = mean_density(points, space)
    nothing = Segments(space, np.zeros((0, d)), np.zeros(0), np.zeros(0), np.zeros((0, BUCKETS + 1), int))
    if not mean:
        return nothing
    k = k or centres_for(points, space)
    bare = replace(space, weight=0.0)

    def numeric(points: DataFrame, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        full = np.zeros((len(centres), space.width))
        full[:, :d] = centres
        mass, _, cost = _sums(points, bare, full)
        held = mass > 0
        return centres[held], mass[held], np.maximum(cost[held] / mass[held], 1e-6)

    near = points
    for turn in range(2):
        centres, _, _ = kmeans(near, space, k, seed=seed + turn)
        centres, mass, square = numeric(near, centres[:, :d])
        dense = _density(mass, square, d) >= DENSE * mean
        if not dense.any():
            return nothing
        near = _near(near, space, centres, dense, np.sqrt(square))
    centres, mass, square = numeric(near, centres[dense])
    radius = np.sqrt(square)
    part = _components(centres, radius, near, names)
    whole = np.bincount(part, mass)[part]
    large = whole >= least_rows
    if not large.any():
        return nothing
    centres, mass, square, radius = centres[large], mass[large], square[large], radius[large]
    part = np.unique(part[large], return_inverse=True)[1]
    # inside a component no centre reaches less far than the component's rows do on average
    usual = np.sqrt(np.bincount(part, mass * square) / np.bincount(part, mass))
    radius = np.maximum(radius, usual[part])

    def shares(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            j = nearest(b[names].to_numpy(float), centres)[0]
            yield pd.DataFrame({"part": part[j], "bucket": b["bucket"], "n": b["n"]}).groupby(["part", "bucket"], as_index=False).sum()

    held = near.mapInPandas(shares, "part bigint, bucket int, n double").groupBy("part", "bucket").agg(F.sum("n").alias("n")).toPandas()
    table = np.zeros((part.max() + 1, BUCKETS + 1))
    table[held["part"].to_numpy(int), held["bucket"].to_numpy(int) + 1] = held["n"]
    number = np.zeros((len(table), BUCKETS + 1), int)
    count = 0
    for p, row in enumerate(table):
        own = [b for b in np.argsort(-row[1:], kind="stable") + 1 if row[b] >= SHARE * row.sum()] or [0]
        number[p] = count
        for i, b in enumerate(own):
            number[p, b] = count + i
        count += len(own)
    return Segments(space, centres, radius, mass, number[part])


def assign(df: DataFrame, model: Segments, category: Column, keep: list[str]) -> DataFrame:
    """keep, segment (null: stray), centre and distance of every row of df. No shuffle."""
    names = [f"z{i}" for i in range(len(model.space.numbers))]
    x = df.select(*keep, *standardised(model.space), bucket_of(category).alias("bucket"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keep).schema) + ", segment int, centre int, distance double"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            s, j, d = model.place(b[names].to_numpy(float), b["bucket"].to_numpy(int))
            yield b[keep].assign(segment=pd.Series(s, b.index).where(s >= 0).astype("Int32"), centre=j.astype("int32"), distance=d)

    return x.mapInPandas(run, schema)


def describe(members: DataFrame, model: Segments, id_col: str, top: int = 5) -> DataFrame:
    """Per segment: size and its `top` most typical members, those nearest to the segment's heaviest centre."""
    heaviest: dict[int, int] = {}
    for c in np.argsort(-model.mass, kind="stable"):
        for s in set(model.segment[c]):
            heaviest.setdefault(int(s), int(c))
    core = F.create_map(*[F.lit(x) for kv in heaviest.items() for x in kv]) if heaviest else F.lit(None).cast("map<int,int>")
    inside = members.where(F.col("segment").isNotNull())
    sizes = inside.groupBy("segment").agg(F.count("*").alias("size"))
    near = inside.where(F.col("centre") == core[F.col("segment")])

    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for b in batches:
            held = b if held is None else pd.concat((held, b))
            held = held.sort_values(["segment", "distance", id_col]).groupby("segment").head(top)
        if held is not None:
            yield held

    few = near.select("segment", "distance", id_col).mapInPandas(best, near.select("segment", "distance", id_col).schema)
    typical = few.groupBy("segment").agg(F.slice(F.array_sort(F.collect_list(F.struct("distance", id_col))), 1, top)[id_col].alias("typical"))
    return sizes.join(typical, "segment")
