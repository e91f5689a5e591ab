"""Compression to prototypes: buckets of like rows, one representative each with its weight, and expansion of results."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tabseg.operators import pairs
from tabseg.session import broadcast_if_small, materialise


def prefix_sizes(cells: DataFrame, length: int) -> DataFrame:
    """(depth, buckets): distinct prefixes of the cell arrays at depths 1, 2, 4, ... and the whole length."""
    depths = sorted({min(2**i, length) for i in range(length.bit_length() + 1)} | {length})
    r = cells.agg(*[F.count_distinct(F.slice("cells", 1, n)).alias(f"d{n}") for n in depths]).first()
    return cells.sparkSession.createDataFrame([(n, r[f"d{n}"]) for n in depths], "depth int, buckets bigint")


def choose_depth(cells: DataFrame, length: int, budget: int) -> int:
    """The deepest prefix that leaves at most `budget` buckets (1 if none does)."""
    fit = [r["depth"] for r in prefix_sizes(cells, length).collect() if r["buckets"] <= budget]
    return max(fit, default=1)


def medoids(members: DataFrame) -> DataFrame:
    """(proto, id): the member of each bucket with the fewest mismatches to the others; equal ones: the smallest id.

    members: proto, id, cells. Sum of mismatches = sum over l of (size - count of the own cell): counts, no pairs.
    """
    long = members.select("proto", "id", F.posexplode("cells").alias("l", "cell"))
    n = long.groupBy("proto", "l", "cell").agg(F.count("*").alias("n"))
    score = long.join(n, ["proto", "l", "cell"]).groupBy("proto", "id").agg(F.sum("n").alias("alike"))
    return score.groupBy("proto").agg(F.min_by("id", F.struct(-F.col("alike"), F.col("id"))).alias("id"))


def nearest_to_mean(members: DataFrame, cols: list[str]) -> DataFrame:
    """(proto, id): the member nearest to its bucket's mean in numeric columns (ties: smallest id). members: proto, id, cols."""
    mean = members.groupBy("proto").agg(*[F.avg(c).alias(f"__m{i}") for i, c in enumerate(cols)])
    gap = sum((F.coalesce((F.col(c) - F.col(f"__m{i}")) ** 2, F.lit(0.0)) for i, c in enumerate(cols)), F.lit(0.0))
    return members.join(broadcast_if_small(mean), "proto").groupBy("proto").agg(F.min_by("id", F.struct(gap.alias("gap"), F.col("id"))).alias("id"))


def compress(cells: DataFrame, id_col: str, depth: int, preserve_rare: int = 0, representative: str = "medoid") -> tuple[DataFrame, DataFrame]:
    """(prototypes: proto, id, cells, weight, rare; assignment: id, proto).

    Buckets share the first `depth` cells; members of buckets below preserve_rare rows stay on their own.
    """
    rows = cells.select(F.col(id_col).alias("id"), "cells", F.xxhash64(F.slice("cells", 1, depth)).alias("bucket"))
    size = broadcast_if_small(rows.groupBy("bucket").agg(F.count("*").alias("n"), F.min("id").alias("first")))
    x = rows.join(size, "bucket").withColumn("rare", F.col("n") < preserve_rare)
    members = materialise(x.select("id", "cells", "rare", F.when(F.col("rare"), F.col("id")).otherwise(F.col("first")).alias("proto")))
    chosen = medoids(members) if representative == "medoid" else members.groupBy("proto").agg(F.min("id").alias("id"))
    weight = members.groupBy("proto").agg(F.count("*").alias("weight"), F.max("rare").alias("rare"))
    protos = chosen.join(members.select("id", "cells"), "id").join(weight, "proto").select("proto", "id", "cells", "weight", "rare")
    return materialise(protos), members.select("id", "proto")


def assign(new: DataFrame, id_col: str, protos: DataFrame) -> DataFrame:
    """(id, proto, dist): the prototype with the same cells, else the one with the fewest mismatches (ties: smallest), compared block by block."""
    rows = new.select(F.col(id_col).cast("bigint").alias("id"), "cells")
    exact = broadcast_if_small(protos.groupBy(F.col("cells").alias("pc")).agg(F.min("proto").alias("proto")))
    held = materialise(rows.join(exact, F.col("cells") == F.col("pc"), "left").drop("pc"))
    far = pairs.nearest_other(held.where("proto IS NULL").select("id", "cells"), protos, "id", "proto")
    return held.where("proto IS NOT NULL").select("id", "proto", F.lit(0).alias("dist")).unionByName(far.select("id", F.col("other").alias("proto"), "dist"))


def assign_points(points: DataFrame, cols: list[str], protos: DataFrame) -> DataFrame:
    """(id, proto, dist): the prototype (proto, cols) nearest by Euclidean distance, for features instead of cells; ties: the smallest."""
    n, m = points.count(), protos.count()
    vec = F.array(*[F.col(c).cast("double") for c in cols]).alias("cells")

    def kernel(a: pd.DataFrame, b: pd.DataFrame, same: bool) -> pd.DataFrame:
        b = b.sort_values("id", kind="stable")
        x, y = np.stack(a["cells"].to_numpy()), np.stack(b["cells"].to_numpy())
        out = []
        for lo in range(0, len(x), 256):
            d = ((x[lo : lo + 256, None] - y[None]) ** 2).sum(2)
            at = d.argmin(1)
            out.append(pd.DataFrame({"id": a["id"].to_numpy()[lo : lo + 256], "proto": b["id"].to_numpy()[at], "dist": np.sqrt(d[np.arange(len(at)), at])}))
        return pd.concat(out)

    got = pairs.by_blocks(points.select(F.col("id").cast("bigint").alias("id"), vec), protos.select(F.col("proto").cast("bigint").alias("id"), vec), F.lit(pairs.parts_of(n)), F.lit(pairs.parts_of(m)), [], kernel, "id bigint, proto bigint, dist double")
    return got.groupBy("id").agg(F.min(F.struct("dist", "proto")).alias("m")).select("id", "m.proto", "m.dist")


def report(protos: DataFrame, assignment: DataFrame, cells: DataFrame, id_col: str) -> DataFrame:
    """One row: sizes, ratio, weights, rare buckets and the mismatches between rows and their prototypes (as shares)."""
    a = protos.agg(F.count("*").alias("n_prototypes"), F.sum("weight").alias("n_samples"), F.min("weight").alias("min_weight"), F.max("weight").alias("max_weight"), F.avg("weight").alias("mean_weight"), F.count_if("rare").alias("rare_bucket_count"))
    each = assignment.join(cells.select(F.col(id_col).alias("id"), "cells"), "id").join(protos.select("proto", F.col("cells").alias("pc")), "proto").select((pairs.mismatches("cells", "pc") / F.size("cells")).alias("e"))
    e = each.agg(F.avg("e").alias("reconstruction_error_mean"), F.max("e").alias("reconstruction_error_max"))
    return a.crossJoin(e).select("n_samples", "n_prototypes", (F.col("n_prototypes") / F.col("n_samples")).alias("compression_ratio"), "min_weight", "max_weight", "mean_weight", "rare_bucket_count", "reconstruction_error_mean", "reconstruction_error_max")


def expand(assignment: DataFrame, labels: DataFrame) -> DataFrame:
    """(id, label) of all rows from the labels (id = prototype's bucket) of the prototypes."""
    return assignment.join(labels.select(F.col("id").alias("proto"), "label"), "proto").select("id", "label")


def cluster_compressed(cells: DataFrame, id_col: str, depth: int, cluster: Callable[[DataFrame], DataFrame], preserve_rare: int = 0) -> tuple[DataFrame, DataFrame]:
    """Labels of all rows by clustering the prototypes only; `cluster` gets proto, cells, weight and returns (id, label) by proto."""
    protos, assignment = compress(cells, id_col, depth, preserve_rare)
    return expand(assignment, cluster(protos.select("proto", "cells", F.col("weight").cast("double").alias("weight")))), protos


def farthest_first(points: DataFrame, cols: list[str], k: int, start: int | None = None) -> list[int]:
    """Ids of k rows, each the farthest from those before (ties: smallest id); one pass per row chosen."""
    x = materialise(points.select("id", *cols))
    first = x.where(F.col("id") == start).first() if start is not None else x.orderBy("id").first()
    chosen = [first]
    while first is not None and len(chosen) < k:
        d = F.least(*[sum(((F.col(c) - F.lit(float(r[c]))) ** 2 for c in cols), F.lit(0.0)) for r in chosen], F.lit(float("inf")))
        r = x.select("*", d.alias("d")).agg(F.max(F.struct("d", (-F.col("id")).alias("less"), *cols)).alias("m")).first()["m"]
        if r["d"] <= 0:
            break
        chosen.append({"id": -r["less"], **{c: r[c] for c in cols}})
    return [int(r["id"]) for r in chosen if r is not None]


def top_of_bucket(members: DataFrame, n: int) -> DataFrame:
    """The n smallest ids of each bucket."""
    w = Window.partitionBy("proto").orderBy("id")
    return members.withColumn("r", F.row_number().over(w)).where(F.col("r") <= n).drop("r")
