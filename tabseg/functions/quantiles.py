"""Exact quantiles of whole columns by narrowing histograms: no sort, no shuffle of values."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabseg.session import finite

#: Parts into which an open interval is divided in one pass.
PARTS = 256


def exact_quantiles(df: DataFrame, probs: dict[str, list[float]]) -> dict[str, list[float | None]]:
    """Linearly interpolated quantiles of the finite values of each column (null for a column without any).

    Every pass counts all columns at once into the parts of the intervals that still hold a wanted rank and
    keeps the parts with it, cut to the values found there. State on the driver: columns x ranks.
    """
    cols = list(probs)
    value = {c: F.when(finite(F.col(c).cast("double")), F.col(c).cast("double")) for c in cols}
    head = df.agg(*[f(value[c]).alias(f"{n}{i}") for i, c in enumerate(cols) for n, f in (("n", F.count), ("a", F.min), ("b", F.max))]).first()
    spans: dict[tuple[int, int], list[float]] = {}  # (column, rank): low, high, count below low
    for i, c in enumerate(cols):
        for p in probs[c]:
            if n := head[f"n{i}"]:
                h = (n - 1) * p
                for k in (int(np.floor(h)), int(np.ceil(h))):
                    spans[i, k] = [head[f"a{i}"], head[f"b{i}"], 0]
    while open_ := {(i, s[0], s[1]) for (i, _), s in spans.items() if s[0] < s[1]}:
        rows = []
        for i, lo, hi in sorted(open_):
            x = value[cols[i]]
            part = F.when(x == hi, PARTS - 1).otherwise(F.least(F.floor((x / 2 - lo / 2) / (hi / 2 - lo / 2) * PARTS), F.lit(PARTS - 1)).cast("int"))
            rows.append(F.when((x >= lo) & (x <= hi), F.struct(F.lit(i).alias("i"), F.lit(float(lo)).alias("lo"), part.alias("part"), x.alias("x"))))
        held = df.select(F.explode(F.array(*rows)).alias("r")).where(F.col("r").isNotNull()).groupBy("r.i", "r.lo", "r.part").agg(F.count("*").alias("n"), F.min("r.x").alias("a"), F.max("r.x").alias("b"))
        parts: dict[tuple[int, float], list] = {}
        for r in held.collect():
            parts.setdefault((r["i"], r["lo"]), []).append((r["part"], r["n"], r["a"], r["b"]))
        for (i, k), s in spans.items():
            if s[0] < s[1]:
                below = s[2]
                for _, n, a, b in sorted(parts[i, s[0]]):
                    if k < below + n:
                        s[:] = [a, b, below]
                        break
                    below += n
    out: dict[str, list[float | None]] = {}
    for i, c in enumerate(cols):
        n, got = head[f"n{i}"], []
        for p in probs[c]:
            h = (n - 1) * p if n else 0
            lo, hi = int(np.floor(h)), int(np.ceil(h))
            got.append(spans[i, lo][0] + (spans[i, hi][0] - spans[i, lo][0]) * (h - lo) if n else None)
        out[c] = got
    return out
