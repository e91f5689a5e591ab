"""Queries of problems 2 to 9 and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabseg.llm import cluster, frequency, mix, neighbours, percentiles, residue, varied
from tabseg.llm.tokens import encode_corpus
from tabseg.operators.fill import stated_age, with_port
from tabseg.session import finite, materialise, read, trimmed_key


def _categories(spark: SparkSession, d: str) -> DataFrame:
    """col, val, record of the columns with limits, as read by the rules of the data."""
    t = with_port(read(spark, d, "titanic").select("passenger_id", "embarked", "city"), read(spark, d, "ports")).select(
        F.col("passenger_id").alias("record"), F.explode(F.array(_pair("titanic.embarked", F.col("port")), _pair("titanic.city", trimmed_key(F.col("city"))))).alias("x")
    )
    m = read(spark, d, "mixed_rows").select(
        F.col("record_no").cast("string").alias("record"), F.explode(F.array(_pair("mixed_rows.cat_1", F.upper(trimmed_key(F.col("cat_1")))), _pair("mixed_rows.cat_2", trimmed_key(F.col("cat_2"))))).alias("x")
    )
    return t.unionByName(m).select("x.col", "x.val", "record").where(F.col("val").isNotNull())


def _pair(col: str, val: Column) -> Column:
    return F.struct(F.lit(col).alias("col"), val.alias("val"))


def _limits(spark: SparkSession, d: str) -> DataFrame:
    m = read(spark, d, "column_meta").where(F.col("min_records").isNotNull() | F.col("max_share").isNotNull())
    return m.select(F.concat_ws(".", "table_name", "col_name").alias("col"), "min_records", "max_share")


def p3_marked(spark: SparkSession, d: str) -> DataFrame:
    rows = _categories(spark, d)
    return frequency.mark_values(frequency.count_values(rows), frequency.stated_records(rows), _limits(spark, d))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return p3_marked(spark, d).where(F.col("mark").isNotNull()).select("col", "val", "mark")


def p3_columns(spark: SparkSession, d: str) -> DataFrame:
    """New n_categories per column: kept values, plus one for rare_value if any value is replaced by it."""
    rare = F.coalesce(F.col("mark") == "rare", F.lit(False))
    per = p3_marked(spark, d).groupBy("col").agg(F.count_distinct("val").alias("n_values"), F.count_distinct(F.when(rare, F.col("val"))).alias("n_rare"))
    return per.select("col", "n_values", "n_rare", (F.col("n_values") - F.col("n_rare") + (F.col("n_rare") > 0).cast("bigint")).alias("n_categories"))


def _titanic_numbers(df: DataFrame) -> tuple[DataFrame, Column]:
    """Rows with stated age and positive finite fare; fares are compared by ratio, so their logarithm is used."""
    rows = df.withColumn("log_fare", F.ln(F.when(finite(F.col("fare")) & (F.col("fare") > 0), F.col("fare")))).withColumn("age", stated_age(F.col("age")))
    return rows.where(F.col("age").isNotNull() & F.col("log_fare").isNotNull()), F.substring(trimmed_key(F.col("sex")), 1, 1)


def _mixed_numbers(df: DataFrame) -> tuple[DataFrame, Column]:
    category = F.upper(trimmed_key(F.col("cat_1")))
    return df.where(finite(F.col("cont_1")) & finite(F.col("cont_2")) & finite(F.col("cont_3")) & category.isNotNull()), category


def _segments(spark: SparkSession, d: str, table: str) -> tuple[DataFrame, cluster.Segments, DataFrame]:
    """Members of every segment of a table, the model, and the exemplars' segments."""
    numbers, of = (["age", "log_fare"], _titanic_numbers) if table == "titanic" else (["cont_1", "cont_2", "cont_3"], _mixed_numbers)
    rows, category = of(read(spark, d, table))
    model = cluster.fit_segments(rows, numbers, category)
    shown, category = of(read(spark, d, "exemplars").where(F.col("table_name") == table))
    known = cluster.assign(shown, model, category, ["exemplar_id"]).where(F.col("segment").isNotNull()).groupBy("segment").agg(F.min("exemplar_id").alias("exemplar_id"))
    return cluster.assign(rows, model, category, ["row_id"]), model, known


def _both_tables(run: Callable[[str], DataFrame]) -> DataFrame:
    """The tables are fitted side by side, for neither keeps all cores busy with its passes over summaries."""
    with ThreadPoolExecutor(2) as pool:
        first, second = pool.map(run, ("titanic", "mixed_rows"))
    return first.unionByName(second)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    def one(table: str) -> DataFrame:
        members, _, known = _segments(spark, d, table)
        return members.join(F.broadcast(known), "segment").select(F.lit(table).alias("table_name"), "row_id", "exemplar_id")

    return _both_tables(one)


def p2_segments(spark: SparkSession, d: str) -> DataFrame:
    """Size and most typical members of each segment."""

    def one(table: str) -> DataFrame:
        members, model, known = _segments(spark, d, table)
        return cluster.describe(members, model, "row_id").join(F.broadcast(known), "segment", "left").select(F.lit(table).alias("table_name"), "segment", "exemplar_id", "size", "typical")

    return _both_tables(one)


PCTS = [5, 25, 50, 75, 95, 99]


def p4_percentiles(spark: SparkSession, d: str) -> DataFrame:
    t, m = read(spark, d, "titanic"), read(spark, d, "mixed_rows")
    month = F.when(F.col("origin").isNotNull() & F.col("obs_at").isNotNull(), F.concat_ws("|", "origin", F.date_format("obs_at", "yyyy-MM")))
    fares = percentiles.value_counts(t.where(F.col("fare") >= 0), F.concat(F.lit("t"), F.col("voyage_id")), F.col("fare"))
    conts = percentiles.value_counts(m, F.concat(F.lit("m"), month), F.col("cont_2"))
    got = percentiles.percentiles(materialise(fares.unionByName(conts)), PCTS)
    of_t = F.substring("grp", 1, 1) == "t"
    got = got.select(F.when(of_t, "titanic").otherwise("mixed_rows").alias("table_name"), F.when(of_t, "fare").otherwise("cont_2").alias("col_name"), F.expr("substring(grp, 2)").alias("grp"), "pct", "value")
    return percentiles.place_in_edges(got, read(spark, d, "bin_specs")).select("table_name", "grp", "pct", "value", "bin_no")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return p4_percentiles(spark, d).select("table_name", "grp", "pct", "bin_no")


def _collection(spark: SparkSession, d: str) -> DataFrame:
    """id, grp (month), x and is_probe of the searchable rows: finite, one per record_no (smallest row_id) and month.

    Rows without a record_no stand for themselves; rows without obs_at are left out.
    """
    c = ["cont_1", "cont_2", "cont_3"]
    m = read(spark, d, "mixed_rows").where(finite(F.col(c[0])) & finite(F.col(c[1])) & finite(F.col(c[2])) & F.col("obs_at").isNotNull())
    record = F.coalesce(F.col("record_no"), -F.col("row_id") - 1)
    # values of fixed width, so that hashing aggregates them, not sorting
    m = m.groupBy(record.alias("record"), F.date_format("obs_at", "yyyy-MM").alias("grp")).agg(F.min("row_id").alias("id"), *[F.min_by(x, "row_id").alias(x) for x in (*c, "is_probe")])
    return m.select("id", "grp", neighbours.vector(c).alias("x"), "is_probe")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    rows = materialise(_collection(spark, d))
    got = neighbours.nearest_rows(rows.select("id", "grp", "x"), rows.where("is_probe").select("id", "grp", "x"), k=5)
    return got.select(F.least("qid", "id").alias("row_id_a"), F.greatest("qid", "id").alias("row_id_b")).distinct()


def p5_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """The five nearest of every row whose row_id is divisible by 50, against all rows."""
    rows = materialise(_collection(spark, d))
    got = neighbours.nearest_rows(rows.select("id", "grp", "x"), rows.where("id % 50 = 0").select("id", "grp", "x"), k=5)
    return got.select(F.col("qid").alias("row_id"), F.col("id").alias("neighbour"), F.round("dist", 6).alias("dist"), "rank")


def p6_select(spark: SparkSession, d: str) -> DataFrame:
    """The rows chosen for each origin, with their stratum; `rare` marks those that any choice must keep."""
    m = read(spark, d, "mixed_rows")
    usable = (F.col("n_prototypes") > 0) & F.col("origin").isNotNull() & (F.col("n_samples").isNull() | (F.col("n_prototypes") <= F.col("n_samples")))
    reports = read(spark, d, "compression_reports").where(usable)
    latest = reports.groupBy(F.col("origin").alias("scope")).agg(F.max_by("n_prototypes", F.struct("run_at", "report_id")).alias("wanted"))
    cats = [trimmed_key(F.col("cat_1")), trimmed_key(F.col("cat_2")), F.col("binary_1"), F.col("binary_2")]
    placed = varied.strata(m, "row_id", "record_no", F.col("origin"), F.date_format("obs_at", "yyyy-MM"), cats, ["cont_1", "cont_2", "cont_3"], F.upper(cats[0]))
    return varied.choose(placed, latest).select(F.col("id").alias("row_id"), F.col("scope").alias("origin"), "stratum", "rare")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return p6_select(spark, d).where("rare").select("row_id")


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode_corpus(read(spark, d, "documents"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    targets = read(spark, d, "source_targets")
    return mix.allocate(mix.sized_documents(read(spark, d, "documents"), targets), targets).where("short").select("source")


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    """How often each document enters the mixture."""
    targets = read(spark, d, "source_targets")
    sized = mix.sized_documents(read(spark, d, "documents"), targets)
    return mix.draw(sized, mix.allocate(sized, targets)).select("doc_id", F.col("key").alias("source"), "tokens", "copies")


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    targets = read(spark, d, "source_targets")
    sized = mix.sized_documents(read(spark, d, "documents"), targets)
    allocation = mix.allocate(sized, targets)
    return mix.shares(allocation, mix.draw(sized, allocation))


def p9_residue(spark: SparkSession, d: str) -> DataFrame:
    """Documents with residue, its kind and the sentence that shows it."""
    return residue.find_residue(read(spark, d, "documents"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return p9_residue(spark, d).select("doc_id").distinct()


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p2_found, p2_segments, p3_found, p3_columns, p4_found, p4_percentiles, p5_found, p5_neighbours, p6_found, p6_select, p7_ids, p8_found, p8_mix, p8_shares, p9_found, p9_residue)}


_TRIM = "regexp_replace(lower({}), '^[^\\p{{L}}\\p{{N}}]+|[^\\p{{L}}\\p{{N}}]+$', '', 'g')"
_KEY = "regexp_replace(lower({}), '[^\\p{{L}}\\p{{N}}]', '', 'g')"
_MARKED = f"""
WITH k AS (SELECT {_KEY.format("port_code")} AS k, port_code AS port FROM ports UNION SELECT {_KEY.format("port_name")}, port_code FROM ports),
x AS (SELECT 'titanic.embarked' AS col, k.port AS val, passenger_id AS rec FROM titanic JOIN k ON {_KEY.format("embarked")} = k.k
UNION ALL SELECT 'titanic.city', {_TRIM.format("city")}, passenger_id FROM titanic WHERE regexp_matches(city, '\\p{{L}}')
UNION ALL SELECT 'mixed_rows.cat_1', upper({_TRIM.format("cat_1")}), CAST(record_no AS VARCHAR) FROM mixed_rows WHERE regexp_matches(cat_1, '\\p{{L}}')
UNION ALL SELECT 'mixed_rows.cat_2', {_TRIM.format("cat_2")}, CAST(record_no AS VARCHAR) FROM mixed_rows WHERE regexp_matches(cat_2, '\\p{{L}}')),
n AS (SELECT col, val, count(DISTINCT rec) AS r FROM x GROUP BY 1, 2), t AS (SELECT col, count(DISTINCT rec) AS total FROM x GROUP BY 1),
l AS (SELECT concat(table_name, '.', col_name) AS col, min_records, max_share FROM column_meta WHERE min_records IS NOT NULL OR max_share IS NOT NULL),
b AS (SELECT n.col, val, r, r < min_records AS rare, r > max_share * total AS common FROM n JOIN t ON n.col = t.col JOIN l ON n.col = l.col)
"""
_PCT = """
WITH x AS (SELECT 'titanic' AS table_name, 'fare' AS col_name, voyage_id AS grp, fare AS v FROM titanic WHERE isfinite(fare) AND fare >= 0
UNION ALL SELECT 'mixed_rows', 'cont_2', concat(origin, '|', strftime(obs_at, '%Y-%m')), cont_2 FROM mixed_rows WHERE isfinite(cont_2)),
r AS (SELECT table_name, col_name, grp, v, row_number() OVER (PARTITION BY table_name, grp ORDER BY v) AS k, count(*) OVER (PARTITION BY table_name, grp) AS n FROM x),
p AS (SELECT unnest([5, 25, 50, 75, 95, 99]) AS pct),
q AS (SELECT table_name, col_name, grp, CAST(pct AS INTEGER) AS pct, v AS value FROM r, p WHERE k = (pct * n + 99) // 100)
"""


_NEAR = """
WITH c AS (SELECT row_id, coalesce(record_no, -row_id - 1) AS rec, strftime(obs_at, '%Y-%m') AS grp, cont_1, cont_2, cont_3, is_probe FROM mixed_rows WHERE isfinite(cont_1) AND isfinite(cont_2) AND isfinite(cont_3) AND obs_at IS NOT NULL),
v AS (SELECT c.* FROM c JOIN (SELECT rec, grp, min(row_id) AS row_id FROM c GROUP BY 1, 2) f USING (rec, grp, row_id)),
g AS (SELECT q.row_id AS qid, v.row_id AS id, 0 + (q.cont_1 - v.cont_1) * (q.cont_1 - v.cont_1) + (q.cont_2 - v.cont_2) * (q.cont_2 - v.cont_2) + (q.cont_3 - v.cont_3) * (q.cont_3 - v.cont_3) AS d2 FROM (SELECT * FROM v WHERE {}) q JOIN v ON q.grp = v.grp AND q.row_id <> v.row_id),
k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY d2, id) AS rank FROM g) WHERE rank <= 5)
"""


def oracle_sql() -> dict[str, str]:
    bins = "CAST(len(list_filter(b.edges, lambda e: e <= value)) AS INTEGER) AS bin_no FROM q JOIN bin_specs b ON q.table_name = b.table_name AND q.col_name = b.col_name"
    return {
        "p3_found": _MARKED + "SELECT col, val, 'rare' AS mark FROM b WHERE rare UNION ALL SELECT col, val, 'common' FROM b WHERE common",
        "p3_columns": _MARKED + ", c AS (SELECT col, count(DISTINCT val) AS n_values, count(DISTINCT CASE WHEN rare THEN val END) AS n_rare FROM b GROUP BY 1) SELECT col, n_values, n_rare, n_values - n_rare + CASE WHEN n_rare > 0 THEN 1 ELSE 0 END AS n_categories FROM c",
        "p6_found": rf"""
WITH x AS (SELECT row_id, record_no, strftime(obs_at, '%Y-%m') AS mo, {_TRIM.format("cat_1")} AS a, {_TRIM.format("cat_2")} AS b, binary_1 AS c, binary_2 AS e FROM mixed_rows
WHERE regexp_matches(cat_1, '\p{{L}}') AND regexp_matches(cat_2, '\p{{L}}') AND binary_1 IS NOT NULL AND binary_2 IS NOT NULL),
r AS (SELECT mo, a, b, c, e FROM x GROUP BY 1, 2, 3, 4, 5 HAVING count(DISTINCT record_no) < 3)
SELECT min(x.row_id) AS row_id FROM x JOIN r ON x.mo = r.mo AND x.a = r.a AND x.b = r.b AND x.c = r.c AND x.e = r.e GROUP BY x.mo, x.a, x.b, x.c, x.e, x.record_no
""",
        "p5_found": _NEAR.format("is_probe") + "SELECT DISTINCT least(qid, id) AS row_id_a, greatest(qid, id) AS row_id_b FROM k",
        "p5_neighbours": _NEAR.format("row_id % 50 = 0") + "SELECT qid AS row_id, id AS neighbour, round(sqrt(d2), 6) AS dist, rank::INTEGER AS rank FROM k",
        "p4_found": _PCT + f"SELECT q.table_name, grp, pct, {bins}",
        "p4_percentiles": _PCT + f"SELECT q.table_name, grp, pct, value, {bins}",
    }
