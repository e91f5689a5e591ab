"""Reading and writing tables: files, in-memory frames, arrays of vectors; results and model tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_table(spark: SparkSession, path: str, fmt: str = "parquet", schema: T.StructType | str | None = None, missing: str = "?") -> DataFrame:
    """parquet, orc, json or csv. csv: header, `missing` and blanks read as null; give a schema for large files, else one pass infers it."""
    r = spark.read if schema is None else spark.read.schema(schema)
    if fmt == "csv":
        r = r.options(header=True, nullValue=missing, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True, inferSchema=schema is None)
    return r.format(fmt).load(path)


def from_pandas(spark: SparkSession, frame, id_col: str = "row_id") -> DataFrame:
    """An in-memory frame, with its position as row id unless it has one. One- and two-dimensional arrays get columns f0, f1, ..."""
    import numpy as np
    import pandas as pd

    if not isinstance(frame, pd.DataFrame):
        a = np.asarray(frame)
        if a.ndim == 1:
            a = a[:, None]
        if a.ndim != 2:
            raise ValueError("expected one or two dimensions")
        frame = pd.DataFrame(a, columns=[f"f{i}" for i in range(a.shape[1])])
    frame = frame.astype(object).where(frame.notna(), None) if len(frame.columns) and frame.dtypes.eq(object).any() else frame
    if id_col not in frame:
        frame = frame.reset_index(drop=True).rename_axis(id_col).reset_index()
    return spark.createDataFrame(frame)


def spread_vector(df: DataFrame, column: str, width: int, prefix: str = "x") -> DataFrame:
    """An array column as `width` double columns prefix0, prefix1, ...; missing places are null."""
    return df.select("*", *[F.get(F.col(column), F.lit(i)).cast("double").alias(f"{prefix}{i}") for i in range(width)]).drop(column)


def add_row_id(df: DataFrame, keys: list[str], name: str = "row_id") -> DataFrame:
    """A reproducible 64-bit id from key columns (equal keys share it); never depends on order or partitioning."""
    return df.withColumn(name, F.xxhash64(*keys))


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by: list[str] | None = None, mode: str = "error") -> None:
    w = df.write.mode(mode).format(fmt)
    (w.partitionBy(*partition_by) if partition_by else w).save(path)
