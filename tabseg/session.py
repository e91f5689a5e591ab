"""Helpers every operator shares: reading tables, cutting lineage, bounded broadcasts, portable randomness."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes up to which a table may be broadcast. Larger ones are joined by shuffle.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 64 << 20
#: Bytes (as Catalyst estimates them) of a span of `positions`, and the fewest and most spans.
SPAN_BYTES, LEAST_SPANS, MOST_SPANS = 16 << 20, 256, 1 << 16


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or (unset, as in tests) one of our own."""
    sc = spark.sparkContext
    known = sc._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return known.get()
    named = sc.getConf().get("spark.checkpoint.dir", None)
    if not named:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="tabseg-")
        atexit.register(shutil.rmtree, named, ignore_errors=True)
    sc.setCheckpointDir(named)
    return sc._jsc.sc().getCheckpointDir().get()


def materialise(df: DataFrame) -> DataFrame:
    """Write df as a table into the shared folder and read it back.

    Cuts lineage like checkpoint(), survives the loss of executors, stays columnar and compressed. The
    files belong to the session's checkpoint folder and go with `forget` or when that folder is cleaned.
    """
    path = f"{shared_dir(df.sparkSession)}/tabseg-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


#: Bytes (as Catalyst estimates them) up to which a stored table is read as one partition.
ONE_PARTITION = 4 << 20


def gathered(df: DataFrame) -> DataFrame:
    """df in one partition if it is tiny, so that passes over it need no exchange; the rows are the same either way."""
    out = df.coalesce(1) if int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) <= ONE_PARTITION else df
    out._stored_at = getattr(df, "_stored_at", None)
    return out


def forget(*tables: DataFrame | None) -> None:
    """Delete stored tables that nothing reads any more: the states before the last of an iteration."""
    for df in tables:
        if path := getattr(df, "_stored_at", None):
            jvm = df.sparkSession._jvm
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def _width(df: DataFrame) -> Column:
    """Bytes of a row: what texts, arrays and maps really hold, and the usual size of everything else."""
    out = F.lit(0).cast("bigint")
    for f in df.schema:
        c, kind = F.col(f"`{f.name}`"), f.dataType.typeName()
        if kind in ("string", "binary"):
            each = F.octet_length(c) + 20
        elif kind in ("array", "map"):
            each = F.octet_length(F.to_json(F.struct(c))) if "string" in f.dataType.simpleString() or "array<array" in f.dataType.simpleString() else F.size(c) * 16 + 24
        else:
            each = F.lit(24 if kind == "struct" else 8)
        out = out + F.coalesce(each, F.lit(8))
    return out


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """df with a broadcast hint when it has at most `rows` rows of together at most `size` bytes (both measured, on rows + 1 rows at most)."""
    r = df.limit(rows + 1).agg(F.count("*").alias("n"), F.sum(_width(df)).alias("b")).first()
    return F.broadcast(df) if r["n"] <= rows and (r["b"] or 0) <= size else df


def join_nulls(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi-join in which null keys match; the keys come out once."""
    other = right.select(*[F.col(k).alias(f"__{k}") for k in keys], *[c for c in right.columns if c not in keys])
    on = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    return left.join(other, on, how).drop(*[f"__{k}" for k in keys])


def hash32(key: Column, seed: object) -> Column:
    """A 32-bit hash that other engines compute alike: the first 8 hex digits of md5('key:seed')."""
    return F.conv(F.substring(F.md5(F.concat(key.cast("string"), F.lit(f":{seed}"))), 1, 8), 16, 10).cast("bigint")


def spans_of(df: DataFrame) -> int:
    """Spans for `positions`: more for larger inputs, so that a span stays small. The positions don't depend on them."""
    estimate = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return min(max(estimate // SPAN_BYTES, LEAST_SPANS), MOST_SPANS)


def positions(df: DataFrame, by: list[str], order: str, tie: str, spans: int | None = None) -> DataFrame:
    """Adds `position`, the row's place (from 0) within `by` in the order of a 32-bit hash column, then of `tie`.

    Rows are numbered inside spans of the hash, and the counts of the spans before are added: no task sees
    a whole group.
    """
    from pyspark.sql.window import Window

    spans = spans or spans_of(df)
    x = df.withColumn("__span", F.floor(F.col(order) / F.lit(4294967296.0 / spans)).cast("int"))
    n = x.groupBy(*by, "__span").agg(F.count("*").alias("__n"))
    w = Window.partitionBy(*by).orderBy("__span").rowsBetween(Window.unboundedPreceding, -1)
    start = n.select(*by, "__span", F.coalesce(F.sum("__n").over(w), F.lit(0)).alias("__start"))
    inner = F.row_number().over(Window.partitionBy(*by, "__span").orderBy(order, tie)) - 1
    return join_nulls(x.withColumn("__inner", inner), broadcast_if_small(start), [*by, "__span"]).withColumn("position", F.col("__inner") + F.col("__start")).drop("__span", "__inner", "__start")


def poisson(key: Column, seed: object) -> Column:
    """A reproducible Poisson(1) count per key (at most 8), by inversion of `uniform`: how often a row enters a bootstrap resample."""
    out, at, total = F.lit(0), 0.36787944117144233, 0.0
    for k in range(8):
        total += at
        out = out + (uniform(key, seed) >= F.lit(total)).cast("int")
        at /= k + 1
    return out


def normal(key: Column, seed: object) -> Column:
    """A reproducible standard normal draw per key (Box and Muller)."""
    return F.sqrt(-2 * F.ln(uniform(key, f"{seed}:r"))) * F.cos(F.lit(6.283185307179586) * uniform(key, f"{seed}:a"))


def uniform(key: Column, seed: object) -> Column:
    """A reproducible draw from (0, 1) per key."""
    return (hash32(key, seed) + F.lit(0.5)) / F.lit(4294967296.0)


def finite(c: Column) -> Column:
    """True where a number is neither null, NaN nor infinite."""
    return F.coalesce(~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), F.lit(False))


def letters_key(c: Column) -> Column:
    """Lower case without blanks and punctuation: the form in which codes and names are compared."""
    return F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]", "")


def trimmed_key(c: Column) -> Column:
    """Lower case without outer blanks and punctuation; null unless a letter remains."""
    key = F.regexp_replace(F.lower(c), r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")
    return F.when(key.rlike(r"\p{L}"), key)
