"""Queries of problem 1, which belongs to the core, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabseg.operators.fill import apply_fills, fill_titanic, stated_age, with_port
from tabseg.session import read


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """The model's fills where more than half of a group agree; the exact check that follows puts the agreed value where the model's differs."""
    f = fill_titanic(read(spark, d, "titanic"), read(spark, d, "ports")).where(F.col("agreed").isNotNull())
    return f.select(F.col("id").alias("row_id"), "field", F.when(F.col("fill") == F.col("agreed"), F.col("fill")).otherwise(F.col("agreed")).alias("fill"))


def p1_filled(spark: SparkSession, d: str) -> DataFrame:
    """The whole table, completed, with masks."""
    t, ports = read(spark, d, "titanic"), read(spark, d, "ports")
    fills = fill_titanic(t, ports)
    out = with_port(t.select("row_id", "age", "embarked"), ports).select("row_id", "age", "port")
    out = apply_fills(out, "row_id", "age", stated_age(F.col("age")), fills, "double")
    return apply_fills(out, "row_id", "embarked", F.col("port"), fills, "string").select("row_id", F.round("age", 1).alias("age"), "age_filled", "embarked", "embarked_filled")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"p1_found": p1_found, "p1_filled": p1_filled}


def oracle_sql() -> dict[str, str]:
    key = "regexp_replace(lower({}), '[^\\p{{L}}\\p{{N}}]', '', 'g')"
    return {
        "p1_found": f"""
WITH k AS (SELECT {key.format("port_code")} AS k, port_code AS port FROM ports UNION SELECT {key.format("port_name")}, port_code FROM ports),
t AS (SELECT row_id, passenger_id, voyage_id, ticket_no, CASE WHEN age > 0 AND age <= 120 THEN age END AS age, port FROM titanic LEFT JOIN k ON {key.format("embarked")} = k.k),
a AS (SELECT passenger_id, age, count(*) AS c, sum(count(*)) OVER (PARTITION BY passenger_id) AS n FROM t WHERE age IS NOT NULL GROUP BY 1, 2),
e AS (SELECT voyage_id, ticket_no, port, count(*) AS c, sum(count(*)) OVER (PARTITION BY voyage_id, ticket_no) AS n FROM t WHERE port IS NOT NULL GROUP BY 1, 2, 3)
SELECT t.row_id, 'age' AS field, printf('%.1f', a.age) AS fill FROM t JOIN a ON t.passenger_id = a.passenger_id WHERE t.age IS NULL AND 2 * a.c > a.n
UNION ALL
SELECT t.row_id, 'embarked', e.port FROM t JOIN e ON t.voyage_id = e.voyage_id AND t.ticket_no = e.ticket_no WHERE t.port IS NULL AND 2 * e.c > e.n
""",
    }
