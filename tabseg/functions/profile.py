"""Column profiles and type detection."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabseg.functions.quantiles import exact_quantiles
from tabseg.session import finite

#: Parts of a name that mark an integer column as an identifier.
ID_PARTS = ("_id", "id_", "userid", "user_id", "itemid", "item_id", "code_", "_code", "idx", "index")


def number(c: str) -> Column:
    """A column as a double: null where it is no finite number (text is parsed, timestamps count in microseconds)."""
    parsed = F.expr(f"try_cast(`{c}` AS DOUBLE)")
    return F.when(finite(parsed), parsed)


def numeric_stats(df: DataFrame, cols: list[str], quartiles: bool = True) -> dict[str, dict]:
    """min, max, n_unique, mean, std (population), count, m2 and quartiles of the finite values, in one pass plus the quantiles' passes."""
    x = df.select(*[number(c).alias(c) for c in cols])
    aggs = []
    for i, c in enumerate(cols):
        v = F.col(c)
        aggs += [F.min(v).alias(f"min{i}"), F.max(v).alias(f"max{i}"), F.avg(v).alias(f"mean{i}"), F.stddev_pop(v).alias(f"std{i}"), F.count(v).alias(f"count{i}"), F.var_pop(v).alias(f"var{i}")]
    r = x.agg(*aggs).first()
    distinct = x.agg(*[F.count_distinct(F.col(c)).alias(f"n{i}") for i, c in enumerate(cols)]).first()
    q = exact_quantiles(x, {c: [0.25, 0.75] for c in cols}) if quartiles else {c: [None, None] for c in cols}
    return {
        c: {"min": r[f"min{i}"], "max": r[f"max{i}"], "n_unique": distinct[f"n{i}"], "q25": q[c][0], "q75": q[c][1], "mean": r[f"mean{i}"], "std": r[f"std{i}"], "count": r[f"count{i}"], "m2": (r[f"var{i}"] or 0.0) * r[f"count{i}"]}
        for i, c in enumerate(cols)
    }


def profile_frame(df: DataFrame, cols: list[str]) -> DataFrame:
    rows = [(c, s["min"], s["max"], s["n_unique"], s["q25"], s["q75"], s["mean"], s["std"], s["count"], s["m2"]) for c, s in numeric_stats(df, cols).items()]
    return df.sparkSession.createDataFrame(rows, "col string, min double, max double, n_unique bigint, q25 double, q75 double, mean double, std double, count bigint, m2 double")


def value_counts(df: DataFrame, cols: list[str]) -> DataFrame:
    """(col, value, n) of every value of categorical columns; null values are left out."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("col"), F.col(c).cast("string").alias("value")) for c in cols]))
    return df.select(pairs.alias("x")).where(F.col("x.value").isNotNull()).groupBy("x.col", "x.value").agg(F.count("*").alias("n"))


def categorical_profile(df: DataFrame, cols: list[str]) -> DataFrame:
    """Distinct values, stated rows, and the most frequent value (ties: first by text) per column."""
    return value_counts(df, cols).groupBy("col").agg(F.count("*").alias("n_unique"), F.sum("n").alias("n_stated"), F.min_by("value", F.struct(-F.col("n"), F.col("value"))).alias("top"), F.max("n").alias("top_n"))


def numeric_fraction(df: DataFrame, cols: list[str]) -> DataFrame:
    """Share of the stated texts that parse as finite numbers, and their distinct parsed values."""
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("col"), F.col(c).cast("string").alias("v"), number(c).alias("x")) for c in cols]))
    held = df.select(rows.alias("r")).where(F.col("r.v").isNotNull())
    return held.groupBy("r.col").agg(F.avg(F.col("r.x").isNotNull().cast("double")).alias("fraction"), F.count_distinct("r.x").alias("n_unique"))


@dataclass(frozen=True)
class Detection:
    mode: str = "smart"  # or "naive"
    coerce: bool = True
    min_fraction: float = 0.9
    cat_threshold: int | None = None  # numeric columns with so few values become categorical


def classify(name: str, kind: str, n: int, n_unique: int, integral: bool, fraction: float, d: Detection) -> str:
    """'numerical' or 'categorical' by the detection rules. kind: 'int', 'float', 'bool', 'time', 'text'."""
    if n_unique <= 2 or kind == "bool":
        return "categorical"
    if kind == "text":
        return "numerical" if d.coerce and fraction >= d.min_fraction else "categorical"
    if kind == "time":
        return "numerical" if d.mode == "smart" else "categorical"
    if d.cat_threshold is not None and n_unique <= d.cat_threshold:
        return "categorical"
    if d.mode == "naive":
        return "numerical"
    root = math.isqrt(n)
    if kind == "int":
        if any(p in name.lower() for p in ID_PARTS) and n_unique > max(5, n // 20):
            return "numerical"
        if n_unique <= max(10, root):
            return "categorical"
        return "numerical" if n_unique / max(n, 1) > 0.5 else "categorical"
    if integral and n_unique <= max(10, root):
        return "categorical"
    return "categorical" if n_unique <= max(5, root // 2) else "numerical"


def kind_of(t: T.DataType) -> str:
    if isinstance(t, T.BooleanType):
        return "bool"
    if isinstance(t, T.IntegralType):
        return "int"
    if isinstance(t, T.FractionalType):
        return "float"
    if isinstance(t, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "time"
    if isinstance(t, (T.StringType, T.CharType, T.VarcharType)):
        return "text"
    raise TypeError(f"columns of type {t.simpleString()} are not supported; explode them first")


def detect_types(df: DataFrame, cols: list[str], d: Detection = Detection()) -> dict[str, str]:
    """Type of each column, from one aggregation over all of them."""
    kinds = {c: kind_of(df.schema[c].dataType) for c in cols}
    aggs = []
    for i, c in enumerate(cols):
        v = F.when(finite(F.col(c)), F.col(c)) if kinds[c] == "float" else F.col(c)
        aggs += [F.count(v).alias(f"n{i}"), F.count_distinct(v).alias(f"u{i}")]
        if kinds[c] == "float":
            aggs.append(F.min(v == F.floor(v)).alias(f"w{i}"))
        if kinds[c] == "text":
            aggs.append(F.avg(F.when(v.isNotNull(), number(c).isNotNull().cast("double"))).alias(f"f{i}"))
    r = df.agg(*aggs).first()
    return {c: classify(re.sub(r"\s+", "_", c), kinds[c], r[f"n{i}"], r[f"u{i}"], kinds[c] == "float" and bool(r[f"w{i}"]), (r[f"f{i}"] or 0.0) if kinds[c] == "text" else 0.0, d) for i, c in enumerate(cols)}
