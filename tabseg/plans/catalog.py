"""All queries of the core, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tabseg.plans import q_embed, q_model, q_more, training


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return q_embed.Q | q_model.Q | q_more.Q | training.queries()


def oracle_sql() -> dict[str, str]:
    return q_embed.SQL | q_model.SQL | q_more.SQL | training.oracle_sql()


def entry(spark: SparkSession) -> DataFrame:
    """The flagship: a mixed table as cells of random partitions."""
    return q_embed.embed_mixed(spark, "/root/testdata/sf0.001")
