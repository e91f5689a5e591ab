"""A varied subset of given size (problem 6): mini-batch k-means, square-root or equal quotas, redistribution.

Records of one scope (here: the origin) fall into strata: a combination of categories that occurs in few
records is a stratum of its own, all others are the clusters of mini-batch k-means over the records' vectors.
Strata of rare combinations are kept whole. What is left of the wanted size is shared among the clusters in
proportion to the square root of their sizes (or equally); a cluster smaller than its quota gives the unused
slots back, and they are shared again among the others. Within a stratum records are taken in the order of a hash
of their id, so that the choice does not depend on partitions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabseg.llm.cluster import centres_for
from tabseg.llm.percentiles import ranked_values
from tabseg.llm.vectors import bucket_of, fit_space, minibatch_kmeans, nearest, standardised, summarise
from tabseg.session import broadcast_if_small, hash32, materialise

#: Most clusters; how many are asked for follows from the data (cluster.centres_for). Every scope has its own counts of them.
CLUSTERS = 256
#: Records below which a combination is rare and kept whole.
RARE = 3


def strata(df: DataFrame, id_col: str, record: str, scope: Column, period: Column, combination: list[Column], numbers: list[str], category: Column, k: int | None = None, seed: int = 6) -> DataFrame:
    """id, scope, stratum, rare: one row per record and combination (the smallest id), stored.

    combination: its parts; where one is null the record has no combination and only belongs to a cluster.
    Rows whose numbers are not all finite are placed by their standardised mean for those numbers. Rows without a
    record stand for themselves. rare: the combination occurs in fewer than RARE records of the period.
    """
    space = fit_space(df, numbers)
    complete = F.lit(True)
    for c in combination:
        complete = complete & c.isNotNull()
    combo = F.when(complete, F.concat_ws("\x1f", *[c.cast("string") for c in combination]))
    own = F.coalesce(F.col(record).cast("string"), F.concat(F.lit("row "), F.col(id_col).cast("string")))
    filled = [F.when(F.isnan(z) | (F.abs(z) == float("inf")), None).otherwise(z) for z in standardised(space)]
    names = [f"z{i}" for i in range(len(numbers))]
    z = df.select(F.col(id_col).alias("id"), own.alias("record"), scope.alias("scope"), period.alias("period"), combo.alias("combo"), bucket_of(category).alias("bucket"), *[F.coalesce(f, F.lit(0.0)).alias(n) for f, n in zip(filled, names)])
    # one row per record, scope, period and combination
    # values of fixed width, so that hashing aggregates them, not sorting
    one = materialise(z.groupBy("record", "scope", "period", "combo").agg(F.min("id").alias("id"), *[F.min_by(c, "id").alias(c) for c in ("bucket", *names)]))
    few = one.where(F.col("combo").isNotNull()).groupBy("period", "combo", "record").agg(F.min("id").alias("id")).groupBy("period", "combo").agg(F.count("*").alias("records"))
    few = broadcast_if_small(materialise(few.where(F.col("records") < RARE).select("period", "combo", F.lit(True).alias("rare"))))
    points = _points(one, names)
    centres = minibatch_kmeans(points, space, k or min(centres_for(points, space), CLUSTERS), seed=seed)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x = space.features(b[names].to_numpy(float), b["bucket"].to_numpy(int))
            yield b[["id", "record", "scope", "period", "combo"]].assign(cluster=nearest(x, centres)[0].astype("int32") if len(b) else b["bucket"])

    kinds = {f.name: f.dataType.simpleString() for f in one.schema}
    placed = one.mapInPandas(place, ", ".join(f"{c} {kinds[c]}" for c in ("id", "record", "scope", "period", "combo")) + ", cluster int")
    placed = placed.join(few, ["period", "combo"], "left").withColumn("rare", F.coalesce("rare", F.lit(False)))
    name = F.when(F.col("rare"), F.concat(F.lit("rare "), "combo")).otherwise(F.concat(F.lit("cluster "), F.col("cluster").cast("string")))
    return materialise(placed.select("id", "record", "scope", "period", "rare", name.alias("stratum")))


def _points(one: DataFrame, names: list[str]) -> DataFrame:
    """Weighted points of already standardised rows."""
    by = [F.floor(F.col(n) / 0.03).alias(f"g{i}") for i, n in enumerate(names)]
    return materialise(one.groupBy(*by, "bucket").agg(F.count("*").cast("double").alias("n"), *[F.avg(n).alias(n) for n in names]).select("n", *names, "bucket"))


def quotas(sizes: pd.DataFrame, wanted: int, equal: bool = False) -> np.ndarray:
    """Slots per cluster: by square root of size (or equal), at most the size, unused slots shared again; sums to min(wanted, all)."""
    size = sizes["size"].to_numpy(float)
    share = np.ones(len(size)) if equal else np.sqrt(size)
    quota = np.zeros(len(size))
    open_ = size > 0
    left = float(min(max(wanted, 0), size.sum()))
    while left > 1e-9 and open_.any():
        give = left * share * open_ / (share * open_).sum()
        quota = np.minimum(quota + give, size)
        left = min(max(wanted, 0), size.sum()) - quota.sum()
        open_ = quota < size - 1e-9
    whole = np.floor(quota + 1e-9)
    rest = int(round(min(max(wanted, 0), size.sum()) - whole.sum()))
    order = np.lexsort((np.arange(len(size)), -(quota - whole)))
    order = order[whole[order] < size[order]][:rest]
    whole[order] += 1
    return whole.astype(np.int64)


def choose(placed: DataFrame, wanted: DataFrame, equal: bool = False, seed: int = 6) -> DataFrame:
    """id, scope, stratum, rare of the chosen records. wanted: scope, wanted.

    Rare strata are kept whole even beyond the wanted size; scopes that are not in `wanted` keep only them.
    """
    sizes = placed.where(~F.col("rare")).groupBy("scope", "stratum").agg(F.count("*").alias("size"))
    kept = placed.where("rare").groupBy("scope").agg(F.count("*").alias("kept"))
    asked = sizes.join(broadcast_if_small(wanted), "scope").join(broadcast_if_small(kept), "scope", "left").fillna(0, ["kept"])

    def share(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("stratum")
        return part[["scope", "stratum", "size"]].assign(quota=quotas(part, int(part["wanted"].iloc[0] - part["kept"].iloc[0]), equal))

    kind = placed.schema["scope"].dataType.simpleString()
    # a scope has at most CLUSTERS rows here
    slots = materialise(asked.groupBy("scope").applyInPandas(share, f"scope {kind}, stratum string, size bigint, quota bigint").where("quota > 0"))
    whole = broadcast_if_small(slots.where("quota = size").select("scope", "stratum", F.lit(-1.0).alias("upto_all")))
    part = slots.where("quota < size")
    draw = placed.where(~F.col("rare")).withColumn("order", hash32(F.col("id"), f"varied:{seed}").cast("double"))
    key = F.concat_ws("\x1f", F.col("scope").cast("string"), "stratum")
    counts = materialise(draw.join(broadcast_if_small(part.select("scope", "stratum")), ["scope", "stratum"]).groupBy(key.alias("grp"), F.col("order").alias("v")).agg(F.count("*").alias("c")))
    cut = ranked_values(counts, part.select(key.alias("grp"), F.lit(0).alias("name"), F.col("quota").alias("rank")))
    cut = cut.select("grp", F.col("v").alias("upto"))
    all_ = draw.join(whole, ["scope", "stratum"]).select("id", "scope", "stratum", "rare")
    some = draw.withColumn("grp", key).join(broadcast_if_small(cut), "grp").where(F.col("order") <= F.col("upto")).select("id", "scope", "stratum", "rare")
    return placed.where("rare").select("id", "scope", "stratum", "rare").unionByName(all_).unionByName(some)
