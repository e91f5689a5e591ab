"""Percentiles per group over very many values (problem 4), by exact bisection.

The rows of each partition or day are reduced to counts per (group, value), which can be added up with
those of others. For every group and percentile an interval of values is kept that holds the target rank;
each pass counts rows below evenly spread midpoints of all open intervals at once and keeps the part with
the rank, cut to the values that occur in it, until one value is left. Passes take turns between midpoints
on a linear and on a logarithmic scale, so that widely spread values need few passes too. The result is
exact, its error zero.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tabseg.session import broadcast_if_small, finite, materialise

#: Parts into which a pass divides each open interval.
PARTS = 64


def value_counts(df: DataFrame, grp: Column, value: Column) -> DataFrame:
    """(grp, v, c): a mergeable summary. Rows without a group or without a finite value are left out."""
    x = df.select(grp.alias("grp"), (value.cast("double") + F.lit(0.0)).alias("v"))
    return x.where(F.col("grp").isNotNull() & finite(F.col("v"))).groupBy("grp", "v").agg(F.count("*").alias("c"))


def combine(*summaries: DataFrame) -> DataFrame:
    """The summary of all rows of several summaries (of days, partitions, ...)."""
    first, *rest = summaries
    for s in rest:
        first = first.unionByName(s)
    return first.groupBy("grp", "v").agg(F.sum("c").alias("c"))


def _place(v: Column, log: bool) -> Column:
    """A non-decreasing scale: the value halved (so that differences do not overflow) or its signed logarithm."""
    if not log:
        return v / 2
    return F.signum(v) * F.when(v == 0, 0.0).otherwise(F.ln(F.abs(v)) + 746.0)


def ranked_values(counts: DataFrame, targets: DataFrame) -> DataFrame:
    """targets: grp, name, rank (from 1). Adds `v`, the value of that rank, and `below`, the count below it.

    counts: grp, v, c (c above 0); it should be a stored table, since every pass reads it. Ranks above the
    group's count give the largest value, ranks below 1 the smallest; groups without rows do not appear.
    """
    ends = counts.groupBy("grp").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    state = materialise(targets.join(ends, "grp").select("grp", "name", "rank", F.lit(0).cast("bigint").alias("below"), "lo", "hi"))
    done, turn = state.where("lo = hi"), 0
    while not (left := state.where("lo < hi")).isEmpty():
        log = turn % 2 == 1
        spans = left.select("grp", "lo", "hi").distinct()
        lo, hi = _place(F.col("lo"), log), _place(F.col("hi"), log)
        part = F.when(F.col("v") == F.col("hi"), PARTS - 1).when(lo < hi, F.least(F.floor((_place(F.col("v"), log) - lo) / (hi - lo) * PARTS), F.lit(PARTS - 1))).otherwise(0)
        held = (
            counts.join(broadcast_if_small(spans), "grp").where(F.col("v").between(F.col("lo"), F.col("hi")))
            .groupBy("grp", "lo", "hi", part.cast("int").alias("part")).agg(F.sum("c").alias("c"), F.min("v").alias("from"), F.max("v").alias("to"))
        )
        w = Window.partitionBy("grp", "lo", "hi").orderBy("part")
        held = held.withColumn("upto", F.sum("c").over(w)).withColumn("last", F.lead("part").over(w).isNull()).withColumn("before", F.col("upto") - F.col("c"))
        reach = F.col("rank") - F.col("below")
        here = (reach <= F.col("upto")) | F.col("last")
        next_ = (
            left.join(held, ["grp", "lo", "hi"]).where(here & ((reach > F.col("before")) | (F.col("before") == 0)))
            .select("grp", "name", "rank", (F.col("below") + F.col("before")).alias("below"), F.col("from").alias("lo"), F.col("to").alias("hi"))
        )
        state = materialise(next_)
        done, turn = done.unionByName(state.where("lo = hi")), turn + 1
    return done.select("grp", "name", "rank", "below", F.col("lo").alias("v"))


def percentiles(counts: DataFrame, pcts: list[int]) -> DataFrame:
    """(grp, pct, n, value): the value of rank ceil(pct/100 x n) of each group."""
    n = counts.groupBy("grp").agg(F.sum("c").alias("n"))
    wanted = n.select("grp", "n", F.explode(F.array(*[F.lit(p) for p in pcts])).alias("pct"))
    targets = wanted.select("grp", F.col("pct").alias("name"), F.expr("(pct * n + 99) div 100").alias("rank"))
    return ranked_values(counts, targets).select("grp", F.col("name").alias("pct"), F.col("rank"), F.col("v").alias("value"))


def place_in_edges(values: DataFrame, specs: DataFrame) -> DataFrame:
    """values: table_name, col_name, value ...; adds bin_no, the number of the column's edges that are not above value."""
    edges = specs.where(F.col("edges").isNotNull()).select("table_name", "col_name", "edges")
    return values.join(F.broadcast(edges), ["table_name", "col_name"]).withColumn("bin_no", F.size(F.filter("edges", lambda e: e <= F.col("value"))))
