"""Encoding of mixed columns: categories, rare values, missing values, scaling, one-hot levels."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabseg.functions.profile import number, value_counts
from tabseg.functions.quantiles import exact_quantiles
from tabseg.session import broadcast_if_small, materialise

#: Names of the bucket of rare values and of missing categories.
RARE, MISSING = "__rare__", "__missing__"


#: Distinct values of a span of `category_codes`.
SPAN_VALUES = 50_000


def category_codes(df: DataFrame, col: str) -> DataFrame:
    """(value, code): codes 0.. by order of text. The dictionary is a table, so it may be large: it is numbered within spans of
    the order (a range partitioning), plus what lies in the spans before."""
    from pyspark.sql.window import Window

    values = df.where(F.col(col).isNotNull()).groupBy(F.col(col).cast("string").alias("value")).agg(F.lit(1).alias("x"))
    parts = int(min(max(values.count() // SPAN_VALUES, 1), 4096))
    if parts == 1:
        return values.select("value", (F.row_number().over(Window.orderBy("value")) - 1).alias("code"))
    ranged = materialise(values.repartitionByRange(parts, "value").withColumn("part", F.spark_partition_id()))
    size = ranged.groupBy("part").agg(F.count("*").alias("n"))
    start = size.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"))
    inner = F.row_number().over(Window.partitionBy("part").orderBy("value")) - 1
    return ranged.withColumn("inner", inner).join(F.broadcast(start), "part").select("value", (F.col("start") + F.col("inner")).cast("int").alias("code"))  # one row per span


def encode_category(df: DataFrame, col: str, codes: DataFrame, name: str | None = None) -> DataFrame:
    """Adds `name`, the code of the value; -1 for missing and for unknown values."""
    name = name or f"{col}__code"
    known = broadcast_if_small(codes.select(F.col("value").alias("__value"), F.col("code").alias(name)))
    return df.join(known, df[col].cast("string") == F.col("__value"), "left").drop("__value").withColumn(name, F.coalesce(name, F.lit(-1)))


def kept_values(df: DataFrame, col: str, min_count: int = 1, min_share: float = 0.0) -> DataFrame:
    """(value, n, kept): a value is kept if it is frequent enough by count and by share of the stated rows."""
    counts = value_counts(df, [col]).select("value", "n")
    total = counts.agg(F.sum("n").alias("total"))
    return counts.crossJoin(F.broadcast(total)).select("value", "n", ((F.col("n") >= min_count) & (F.col("n") / F.col("total") >= min_share)).alias("kept"))


def group_rare(df: DataFrame, col: str, kept: DataFrame, rare: str = RARE) -> DataFrame:
    """`col` with dropped and unseen values replaced by `rare`, if any value was dropped; missing stays missing.

    Should a value itself be called like the bucket, the bucket's name gets a number.
    """
    names = {r[0] for r in kept.where(F.col("value").startswith(rare)).select("value").limit(1000).collect()}
    bucket, k = rare, 0
    while bucket in names:
        k += 1
        bucket = f"{rare}_{k}"
    if kept.where(~F.col("kept")).isEmpty():
        return df
    known = broadcast_if_small(kept.where("kept").select(F.col("value").alias("__value")))
    joined = df.join(known, df[col].cast("string") == F.col("__value"), "left")
    return joined.withColumn(col, F.when(F.col(col).isNull(), F.lit(None)).when(F.col("__value").isNull(), F.lit(bucket)).otherwise(F.col(col).cast("string"))).drop("__value")


def missing_indicator(col: str) -> Column:
    return F.col(col).isNull().cast("double").alias(f"{col}__missing")


def impute_median(df: DataFrame, cols: list[str]) -> DataFrame:
    """Nulls (and non-finite numbers) become the column's median; 0 for a column without any value."""
    medians = exact_quantiles(df.select(*[number(c).alias(c) for c in cols]), {c: [0.5] for c in cols})
    return df.withColumns({c: F.coalesce(number(c), F.lit(medians[c][0] if medians[c][0] is not None else 0.0)) for c in cols})


def impute_constant(df: DataFrame, cols: list[str], value: str = MISSING) -> DataFrame:
    return df.withColumns({c: F.coalesce(F.col(c).cast("string"), F.lit(value)) for c in cols})


def standardise(df: DataFrame, cols: list[str]) -> DataFrame:
    """(x - mean) / population standard deviation; a constant column is only centred."""
    r = df.agg(*[f(number(c)).alias(f"{n}{i}") for i, c in enumerate(cols) for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    return df.withColumns({c: (number(c) - F.lit(r[f"m{i}"] or 0.0)) / F.lit(r[f"s{i}"] or 1.0) for i, c in enumerate(cols)})


def onehot_columns(df: DataFrame, col: str, limit: int = 1000) -> list[Column]:
    """One 0/1 column per level, in order of text; unknown and missing values are 0 everywhere."""
    levels = [r[0] for r in category_codes(df, col).orderBy("code").select("value").limit(limit + 1).collect()]
    if len(levels) > limit:
        raise ValueError(f"{col} has more than {limit} levels; group rare ones first")
    return [F.coalesce((F.col(col).cast("string") == v).cast("double"), F.lit(0.0)).alias(f"{col}={v}") for v in levels]


@dataclass
class Normaliser:
    """One transformer for mixed tables: numeric texts become numbers, rare and unseen categories one bucket, and missing values indicators.

    kinds: column -> numerical or categorical. Indicators ({col}__missing, categorical) only for columns that had missing values when fitted.
    """

    kinds: dict[str, str]
    missing_indicators: bool = False
    rare_min_count: int = 1
    rare_min_share: float = 0.0
    had_missing: list[str] = field(default_factory=list)
    kept: dict[str, DataFrame] = field(default_factory=dict)

    def fit(self, df: DataFrame) -> Normaliser:
        cols = list(self.kinds)
        r = df.agg(*[F.count_if((number(c) if self.kinds[c] == "numerical" else F.col(c)).isNull()).alias(f"n{i}") for i, c in enumerate(cols)]).first()
        self.had_missing = [c for i, c in enumerate(cols) if r[f"n{i}"]] if self.missing_indicators else []
        if self.rare_min_count > 1 or self.rare_min_share > 0:
            self.kept = {c: materialise(kept_values(df, c, self.rare_min_count, self.rare_min_share)) for c in cols if self.kinds[c] == "categorical"}
        return self

    def transform(self, df: DataFrame, keep: list[str]) -> DataFrame:
        x = df.select(*keep, *[number(c).alias(c) if k == "numerical" else F.col(c).cast("string").alias(c) for c, k in self.kinds.items()])
        x = x.withColumns({f"{c}__missing": F.col(c).isNull().cast("int").cast("string") for c in self.had_missing}) if self.had_missing else x
        for c, kept in self.kept.items():
            x = group_rare(x, c, kept)
        return x.select(*keep, *self.kinds_out())

    def kinds_out(self) -> dict[str, str]:
        return self.kinds | {f"{c}__missing": "categorical" for c in self.had_missing}


@dataclass
class Preprocessor:
    """Numbers imputed by the median and standardised, categories imputed and one-hot encoded: numbers first."""

    numeric: list[str]
    categorical: list[str]
    missing_indicators: bool = False
    rare_min_count: int = 1
    rare_min_share: float = 0.0
    medians: dict[str, float] = field(default_factory=dict)
    centre: dict[str, tuple[float, float]] = field(default_factory=dict)
    levels: dict[str, list[str]] = field(default_factory=dict)
    rare: set[str] = field(default_factory=set)
    had_missing: set[str] = field(default_factory=set)

    def fit(self, df: DataFrame, level_limit: int = 1000) -> Preprocessor:
        n = self.numeric
        x = df.select(*[number(c).alias(c) for c in n])
        q = exact_quantiles(x, {c: [0.5] for c in n}) if n else {}
        self.medians = {c: q[c][0] if q[c][0] is not None else 0.0 for c in n}
        filled = {c: F.coalesce(F.col(c), F.lit(self.medians[c])) for c in n}
        if n:
            r = x.agg(*[f(filled[c]).alias(f"{k}{i}") for i, c in enumerate(n) for k, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
            self.centre = {c: (r[f"m{i}"] or 0.0, r[f"s{i}"] or 1.0) for i, c in enumerate(n)}
        nulls = df.agg(*[F.count_if((number(c) if c in n else F.col(c)).isNull()).alias(f"c{i}") for i, c in enumerate(n + self.categorical)]).first()
        self.had_missing = {c for i, c in enumerate(n + self.categorical) if nulls[f"c{i}"]}
        for c in self.categorical:
            kept = kept_values(df, c, self.rare_min_count, self.rare_min_share)
            rows = kept.where("kept").orderBy("value").select("value").limit(level_limit + 1).collect()
            if len(rows) > level_limit:
                raise ValueError(f"{c} has more than {level_limit} levels; raise rare_min_count")
            self.levels[c] = [r[0] for r in rows]
            if not kept.where(~F.col("kept")).isEmpty():
                self.rare.add(c)
                self.levels[c].append(RARE)
            if c in self.had_missing:
                self.levels[c].append(MISSING)
        return self

    def columns(self) -> list[Column]:
        out = [((F.coalesce(number(c), F.lit(self.medians[c])) - F.lit(self.centre[c][0])) / F.lit(self.centre[c][1])).alias(c) for c in self.numeric]
        for c in self.categorical:
            v = F.coalesce(F.col(c).cast("string"), F.lit(MISSING))
            if c in self.rare:
                kept = [x for x in self.levels[c] if x not in (RARE, MISSING)]
                v = F.when(v.isin([*kept, MISSING]), v).otherwise(F.lit(RARE))
            out += [(v == level).cast("double").alias(f"{c}={level}") for level in self.levels[c]]
        if self.missing_indicators:
            out += [F.col(c).isNull().cast("double").alias(f"{c}__missing") for c in [*self.numeric, *self.categorical] if c in self.had_missing]
        return out

    def transform(self, df: DataFrame, keep: list[str]) -> DataFrame:
        return df.select(*keep, *self.columns())

    def names(self) -> list[str]:
        out = [*self.numeric, *[f"{c}={v}" for c in self.categorical for v in self.levels[c]]]
        return out + ([f"{c}__missing" for c in [*self.numeric, *self.categorical] if c in self.had_missing] if self.missing_indicators else [])
