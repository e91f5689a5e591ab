"""Queries over profiles, encodings, cuts, embeddings, weights, pairs and neighbour graphs, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tabseg.functions import cuts, encode, profile, weights
from tabseg.functions.quantiles import exact_quantiles
from tabseg.operators import embed, metrics, pairs
from tabseg.plans import spec
from tabseg.session import materialise, read

#: The embeddings that several queries share.
PART = spec.draw({"p_size": "numerical", "p_retailprice": "numerical", "p_brand": "categorical", "p_type": "categorical"}, 8, 2, 3, seed=42)
CUSTOMER = spec.draw({"c_acctbal": "numerical", "c_nationkey": "categorical", "c_mktsegment": "categorical"}, 12, 2, 3, seed=7)
SUPPLIER = spec.draw({"s_acctbal": "numerical", "s_nationkey": "numerical"}, 10, 1, 4, seed=3)
LINEITEM = spec.draw({"l_quantity": "numerical", "l_extendedprice": "numerical", "l_returnflag": "categorical", "l_linestatus": "categorical"}, 6, 2, 3, seed=11)
CUSTOMER_SQL = embed.embed_sql("customer", "c_custkey", CUSTOMER)
SUPPLIER_SQL = embed.embed_sql("supplier", "s_suppkey", SUPPLIER)
PART_SQL = embed.embed_sql("part", "p_partkey", PART)

Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def customer_cells(spark: SparkSession, d: str) -> DataFrame:
    c = read(spark, d, "customer")
    return embed.embed(c, spec.fit(c, CUSTOMER), ["c_custkey"])


def supplier_cells(spark: SparkSession, d: str) -> DataFrame:
    s = read(spark, d, "supplier")
    return embed.embed(s, spec.fit(s, SUPPLIER), ["s_suppkey"])


def part_cells(spark: SparkSession, d: str) -> DataFrame:
    p = read(spark, d, "part")
    return embed.embed(p, spec.fit(p, PART), ["p_partkey"])


def customer_labels(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "customer").select("c_custkey", F.col("c_mktsegment").alias("label"))


# profiles

_NUM = ["l_quantity", "l_extendedprice", "l_discount"]


@query(" UNION ALL ".join(
    f"SELECT '{c}' AS col, min({c})::DOUBLE AS min, max({c})::DOUBLE AS max, count(DISTINCT {c}) AS n_unique, round(quantile_cont({c}, 0.25), 6)::DOUBLE AS q25, round(quantile_cont({c}, 0.75), 6)::DOUBLE AS q75, round(avg({c}), 4) AS mean, round(stddev_pop({c}), 4) AS std, count({c}) AS count, round(var_pop({c}) * count({c}) / 1e6, 2) AS m2_mio FROM lineitem"
    for c in _NUM
))
def profile_numeric(spark: SparkSession, d: str) -> DataFrame:
    p = profile.profile_frame(read(spark, d, "lineitem"), _NUM)
    return p.select("col", "min", "max", "n_unique", F.round("q25", 6).alias("q25"), F.round("q75", 6).alias("q75"), F.round("mean", 4).alias("mean"), F.round("std", 4).alias("std"), "count", F.round(F.col("m2") / 1e6, 2).alias("m2_mio"))


@query(" UNION ALL ".join(
    f"SELECT '{c}' AS col, count(*) AS n_unique, sum(n)::BIGINT AS n_stated, arg_min(v, (-n, v)) AS top, max(n) AS top_n FROM (SELECT {c} AS v, count(*) AS n FROM part WHERE {c} IS NOT NULL GROUP BY 1)" for c in ("p_brand", "p_type")
))
def profile_categorical(spark: SparkSession, d: str) -> DataFrame:
    return profile.categorical_profile(read(spark, d, "part"), ["p_brand", "p_type"])


def _kind_sql(table: str, col: str, kind: str) -> str:
    u, n = f"count(DISTINCT {col})", f"count({col})"
    if kind == "text":
        return f"SELECT '{col}' AS col, 'categorical' AS kind"
    elif kind == "int":
        named = any(p in col.lower() for p in profile.ID_PARTS)
        rule = f"CASE WHEN {u} <= 2 THEN 'categorical' " + (f"WHEN {u} > greatest(5, {n} // 20) THEN 'numerical' " if named else "") + f"WHEN {u} <= greatest(10, floor(sqrt({n}))) THEN 'categorical' WHEN {u}::DOUBLE / {n} > 0.5 THEN 'numerical' ELSE 'categorical' END"
    else:
        rule = f"CASE WHEN {u} <= 2 THEN 'categorical' WHEN bool_and({col} = floor({col})) AND {u} <= greatest(10, floor(sqrt({n}))) THEN 'categorical' WHEN {u} <= greatest(5, floor(sqrt({n})) // 2) THEN 'categorical' ELSE 'numerical' END"
    return f"SELECT '{col}' AS col, {rule} AS kind FROM {table}"


_DETECT = [("customer", "c_custkey", "int"), ("customer", "c_nationkey", "int"), ("customer", "c_acctbal", "float"), ("customer", "c_mktsegment", "text"), ("events", "user_id", "int"), ("events", "value", "float"), ("events", "event_type", "text"), ("lineitem", "l_quantity", "float"), ("lineitem", "l_linenumber", "int"), ("lineitem", "l_tax", "float")]


@query(" UNION ALL ".join(_kind_sql(*x) for x in _DETECT))
def detect_types(spark: SparkSession, d: str) -> DataFrame:
    rows: list[tuple[str, str]] = []
    for t in ("customer", "events", "lineitem"):
        rows += profile.detect_types(read(spark, d, t), [c for u, c, _ in _DETECT if u == t]).items()
    return spark.createDataFrame(rows, "col string, kind string")


@query("""SELECT 'k' AS col, round(avg(CASE WHEN x IS NOT NULL THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS fraction, count(DISTINCT x) AS n_unique FROM (SELECT try_cast(json_extract_string(props, '$.k') AS DOUBLE) AS x FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL)
UNION ALL SELECT 'event_type', round(avg(CASE WHEN try_cast(event_type AS DOUBLE) IS NOT NULL THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6), count(DISTINCT try_cast(event_type AS DOUBLE)) FROM events WHERE event_type IS NOT NULL""")
def numeric_string_fraction(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events").select("event_type", F.get_json_object("props", "$.k").alias("k"))
    return profile.numeric_fraction(e, ["k", "event_type"]).select("col", F.round("fraction", 6).alias("fraction"), "n_unique")


# encoding


@query("SELECT p_partkey, (c - 1)::INTEGER AS code FROM part JOIN (SELECT v, row_number() OVER (ORDER BY v) AS c FROM (SELECT DISTINCT p_brand AS v FROM part)) ON p_brand = v")
def category_codes(spark: SparkSession, d: str) -> DataFrame:
    p = read(spark, d, "part")
    return encode.encode_category(p, "p_brand", encode.category_codes(p, "p_brand"), "code").select("p_partkey", "code")


@query("""WITH c AS (SELECT source AS v, count(*) AS n, count(*) >= 20 AND count(*)::DOUBLE / sum(count(*)) OVER () >= 0.02 AS kept FROM documents WHERE source IS NOT NULL GROUP BY 1)
SELECT CASE WHEN source IS NULL THEN NULL WHEN kept THEN source ELSE '__rare__' END AS source, count(*) AS n FROM documents LEFT JOIN c ON source = v GROUP BY 1""")
def rare_grouping(spark: SparkSession, d: str) -> DataFrame:
    x = read(spark, d, "documents").select("source")
    return encode.group_rare(x, "source", encode.kept_values(x, "source", 20, 0.02)).groupBy("source").agg(F.count("*").alias("n"))


@query("""WITH m AS (SELECT quantile_cont(age, 0.5) AS a FROM titanic WHERE isfinite(age))
SELECT row_id, coalesce(CASE WHEN isfinite(age) THEN age END, a) AS age, coalesce(city, '__missing__') AS city, CASE WHEN city IS NULL THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS city__missing FROM titanic CROSS JOIN m""")
def impute_missing(spark: SparkSession, d: str) -> DataFrame:
    t = read(spark, d, "titanic").select("row_id", "age", "city", encode.missing_indicator("city"))
    return encode.impute_constant(encode.impute_median(t, ["age"]), ["city"])


@query("SELECT c_custkey, round((c_acctbal - avg(c_acctbal) OVER ()) / stddev_pop(c_acctbal) OVER (), 6) + 0.0 AS z FROM customer")
def standardize(spark: SparkSession, d: str) -> DataFrame:
    return encode.standardise(read(spark, d, "customer"), ["c_acctbal"]).select("c_custkey", (F.round("c_acctbal", 6) + 0.0).alias("z"))


@query("SELECT o_orderstatus AS status, o_orderpriority AS priority, count(*)::DOUBLE AS n FROM orders GROUP BY 1, 2")
def onehot_levels(spark: SparkSession, d: str) -> DataFrame:
    o = read(spark, d, "orders")
    cols = encode.onehot_columns(o, "o_orderpriority")
    names = [c._jc.toString().rpartition(" AS ")[2].strip("`") for c in cols]
    x = o.select("o_orderstatus", *cols).groupBy("o_orderstatus").agg(*[F.sum(F.col(f"`{n}`")).alias(n) for n in names])
    each = F.explode(F.array(*[F.struct(F.lit(n.partition("=")[2]).alias("priority"), F.col(f"`{n}`").alias("n")) for n in names]))
    return x.select(F.col("o_orderstatus").alias("status"), each.alias("e")).select("status", "e.priority", "e.n").where("n > 0")


# cuts

_U = [0.11, 0.37, 0.62, 0.93]


@query("SELECT i::INTEGER AS i, round(lo + u * (hi - lo), 6) AS cut FROM (SELECT min(p_retailprice) AS lo, max(p_retailprice) AS hi FROM part) CROSS JOIN (VALUES " + ", ".join(f"({i}, {u}::DOUBLE)" for i, u in enumerate(_U)) + ") v(i, u)")
def cuts_uniform(spark: SparkSession, d: str) -> DataFrame:
    s = spec.numeric_stats_light(read(spark, d, "part"), ["p_retailprice"])["p_retailprice"]
    return spark.createDataFrame([(i, round(x, 6)) for i, x in enumerate(cuts.uniform_cuts(s, _U))], "i int, cut double")


@query(" UNION ALL ".join(f"SELECT {i}::INTEGER AS i, round(quantile_cont(value, {u}), 6) AS cut FROM events" for i, u in enumerate(_U)))
def cuts_quantile(spark: SparkSession, d: str) -> DataFrame:
    q = cuts.quantile_cuts(read(spark, d, "events"), {"value": _U})["value"]
    return spark.createDataFrame([(i, round(x, 6)) for i, x in enumerate(q)], "i int, cut double")


@query()
def cuts_density(spark: SparkSession, d: str) -> DataFrame:
    """Valleys of the densities of three columns (rows only: a density estimate)."""
    import numpy as np

    m, rows = read(spark, d, "mixed_rows"), []
    for c in ("cont_1", "cont_2", "cont_3"):
        x, n = cuts.weighted_points(m, c)
        got, how = cuts.density_cuts(x, 3, np.random.default_rng(1), n=n)
        rows += [(c, i, float(x), how) for i, x in enumerate(got)]
    return spark.createDataFrame(rows, "col string, i int, cut double, how string")


def _adaptive_sql(c: str) -> str:
    cap = "greatest(least(10, ceil(log2(n) + 1)), 2)"
    return f"""SELECT '{c}' AS col, (CASE WHEN u <= 1 THEN 2 WHEN u <= floor(sqrt(n)) + 1 THEN least(greatest(u, 2), {cap})
ELSE least(greatest(round_even(2 + ({cap} - 2) * (0.5 * least(2 * (q75 - q25) / (hi - lo), 1.0) + 0.5 * least(u / (2 * sqrt(n)), 1.0)), 0), 2), {cap}) END)::INTEGER AS bins
FROM (SELECT count(*) AS n, count(DISTINCT {c}) AS u, min({c}) AS lo, max({c}) AS hi, quantile_cont({c}, 0.25) AS q25, quantile_cont({c}, 0.75) AS q75 FROM lineitem)"""


@query(" UNION ALL ".join(_adaptive_sql(c) for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")) + " UNION ALL SELECT 'l_returnflag', least(greatest(count(DISTINCT l_returnflag), 2), greatest(least(10, ceil(log2(count(*)) + 1)), 2))::INTEGER FROM lineitem")
def adaptive_bins(spark: SparkSession, d: str) -> DataFrame:
    kinds = {"l_quantity": "numerical", "l_extendedprice": "numerical", "l_discount": "numerical", "l_tax": "numerical", "l_returnflag": "categorical"}
    return spark.createDataFrame(list(spec.bins_per_column(read(spark, d, "lineitem"), kinds).items()), "col string, bins int")


@query(" UNION ALL ".join(f"SELECT '{c}' AS col, greatest(least(count(DISTINCT {c}), least(10, ceil(log2(count(*)) + 1))), 2)::INTEGER AS bins FROM {t}" for t, c in (("customer", "c_nationkey"), ("customer", "c_mktsegment"))))
def categorical_cap(spark: SparkSession, d: str) -> DataFrame:
    kinds = {"c_nationkey": "categorical", "c_mktsegment": "categorical"}
    return spark.createDataFrame(list(spec.bins_per_column(read(spark, d, "customer"), kinds, "cap").items()), "col string, bins int")


# embeddings


@query(f"WITH {PART_SQL} SELECT id AS p_partkey, l::INTEGER AS l, cell FROM cells")
def embed_mixed(spark: SparkSession, d: str) -> DataFrame:
    return embed.long_cells(part_cells(spark, d), "p_partkey").withColumnRenamed("id", "p_partkey")


_NEW = spec.Sketch([[f] for it in PART.iterations for f in it][:12])


@query("WITH n AS (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_acctbal END AS p_size, 900 + c_custkey % 100 AS p_retailprice, CASE WHEN c_custkey % 2 = 0 THEN 'Brand#11' ELSE c_mktsegment END AS p_brand, NULL::VARCHAR AS p_type FROM customer), "
       + embed.embed_sql("part", "p_partkey", _NEW).replace("FROM part t", "FROM n t").replace("t.p_partkey AS id", "t.c_custkey AS id") + " SELECT id AS c_custkey, l::INTEGER AS l, cell FROM cells")
def embed_unseen(spark: SparkSession, d: str) -> DataFrame:
    """A specification fitted on one table, applied to rows with unknown categories and missing values."""
    c = read(spark, d, "customer")
    new = c.select("c_custkey", F.when(F.col("c_custkey") % 3 == 0, None).otherwise(F.col("c_acctbal")).alias("p_size"), (900 + F.col("c_custkey") % 100).alias("p_retailprice"), F.when(F.col("c_custkey") % 2 == 0, "Brand#11").otherwise(F.col("c_mktsegment")).alias("p_brand"), F.lit(None).cast("string").alias("p_type"))
    return embed.long_cells(embed.embed(new, spec.fit(read(spark, d, "part"), _NEW), ["c_custkey"]), "c_custkey").withColumnRenamed("id", "c_custkey")


# weights

_CORR = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query(" UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, round(corr(ra, rb), 4) AS rho FROM (SELECT rank() OVER (ORDER BY {a}) + (count(*) OVER (PARTITION BY {a}) - 1) / 2.0 AS ra, rank() OVER (ORDER BY {b}) + (count(*) OVER (PARTITION BY {b}) - 1) / 2.0 AS rb FROM lineitem)"
    for i, a in enumerate(_CORR) for b in _CORR[i + 1 :]
))
def spearman_weights(spark: SparkSession, d: str) -> DataFrame:
    rho = weights.spearman(read(spark, d, "lineitem"), _CORR)
    return spark.createDataFrame([(a, b, round(r, 4)) for (a, b), r in rho.items()], "a string, b string, rho double")


@query("""WITH x AS (SELECT l_quantity AS q, l_extendedprice AS e, l_quantity * 2 + l_discount AS q2, -l_extendedprice + l_tax AS e2, l_tax AS t FROM lineitem),
c AS (SELECT abs(corr(q, q2)) > 0.9 AS qq, abs(corr(e, e2)) > 0.9 AS ee, abs(corr(q, e)) > 0.9 AS qe, abs(corr(t, q)) > 0.9 AS tq, abs(corr(t, e)) > 0.9 AS te FROM x)
SELECT v.col, CASE WHEN v.col = 't' THEN (CASE WHEN tq OR te THEN 0.5 ELSE 1.0 END)::DOUBLE WHEN qe THEN 0.25::DOUBLE WHEN v.col IN ('q', 'q2') THEN (CASE WHEN qq THEN 0.5 ELSE 1.0 END)::DOUBLE ELSE (CASE WHEN ee THEN 0.5 ELSE 1.0 END)::DOUBLE END AS weight
FROM c CROSS JOIN (VALUES ('q'), ('q2'), ('e'), ('e2'), ('t')) v(col)""")
def correlation_groups(spark: SparkSession, d: str) -> DataFrame:
    x = read(spark, d, "lineitem").select(F.col("l_quantity").alias("q"), (F.col("l_quantity") * 2 + F.col("l_discount")).alias("q2"), F.col("l_extendedprice").alias("e"), (F.col("l_tax") - F.col("l_extendedprice")).alias("e2"), F.col("l_tax").alias("t"))
    w = weights.group_weights(x.columns, weights.pearson(x, x.columns), 0.9)
    return spark.createDataFrame(list(w.items()), "col string, weight double")


@query(f"WITH {embed.embed_sql('lineitem', 'l_orderkey', LINEITEM)} SELECT l::INTEGER AS l, cell, count(*) AS n FROM cells GROUP BY 1, 2")
def cell_histogram(spark: SparkSession, d: str) -> DataFrame:
    x = read(spark, d, "lineitem")
    return weights.cell_histogram(embed.long_cells(embed.embed(x, spec.fit(x, LINEITEM), ["l_orderkey"]), "l_orderkey"))


_RAW = f"WITH {CUSTOMER_SQL}, h AS (SELECT l, cell, count(*)::DOUBLE AS n, sum(count(*)) OVER (PARTITION BY l)::DOUBLE AS t FROM cells GROUP BY 1, 2), p AS (SELECT l, count(*) AS k, max(t) AS t, sum(-n / t * ln(n / t)) AS h, sum(n / t * n / t) AS s FROM h GROUP BY 1)"


@query(_RAW + ", r AS (SELECT l, CASE WHEN k > 1 THEN h / ln(k) ELSE 0 END AS raw FROM p) SELECT l::INTEGER AS l, round(raw / avg(raw) OVER (), 6) AS weight FROM r")
def iteration_weights_entropy(spark: SparkSession, d: str) -> DataFrame:
    w = weights.iteration_weights(embed.long_cells(customer_cells(spark, d), "c_custkey"), len(CUSTOMER.iterations))
    return spark.createDataFrame([(i, round(float(x), 6)) for i, x in enumerate(w)], "l int, weight double")


@query(_RAW + ", r AS (SELECT l, sqrt(CASE WHEN k > 1 THEN (1 - s) / (1 - 1 / least(t, k)) ELSE 0 END) / 2 + 0.5 AS raw FROM p) SELECT l::INTEGER AS l, round(raw / avg(raw) OVER (), 6) AS weight FROM r")
def iteration_weights_gini(spark: SparkSession, d: str) -> DataFrame:
    w = weights.iteration_weights(embed.long_cells(customer_cells(spark, d), "c_custkey"), len(CUSTOMER.iterations), "inverse_gini", 2.0)
    return spark.createDataFrame([(i, round(float(x), 6)) for i, x in enumerate(w)], "l int, weight double")


# pairs

_WEIGHTS = [1.0, 2.0, 0.5, 1.0, 3.0, 1.0, 0.25, 1.0, 2.0, 1.5]
_W_SQL = "(VALUES " + ", ".join(f"({i}, {w}::DOUBLE)" for i, w in enumerate(_WEIGHTS)) + ") w(l, w)"


@query(f"WITH {SUPPLIER_SQL} SELECT a.id AS i, b.id AS j, round(avg(CASE WHEN a.cell <> b.cell THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS dist FROM cells a JOIN cells b ON a.l = b.l AND a.id < b.id GROUP BY 1, 2")
def hamming_pairs(spark: SparkSession, d: str) -> DataFrame:
    return pairs.hamming_pairs(supplier_cells(spark, d), "s_suppkey").withColumn("dist", F.round("dist", 6))


@query(f"WITH {SUPPLIER_SQL} SELECT a.id AS i, b.id AS j, round(sum(CASE WHEN a.cell <> b.cell THEN w.w ELSE 0.0::DOUBLE END) / sum(w.w), 6) AS dist FROM cells a JOIN cells b ON a.l = b.l AND a.id < b.id JOIN {_W_SQL} ON a.l = w.l GROUP BY 1, 2")
def weighted_hamming_pairs(spark: SparkSession, d: str) -> DataFrame:
    return pairs.hamming_pairs(supplier_cells(spark, d), "s_suppkey", pairs.check_weights(_WEIGHTS, 10)).withColumn("dist", F.round("dist", 6))


_CROSS = spec.Sketch([[spec.Feature("bal", "numerical", 4, [0.2, 0.5, 0.8], f"cross:{i}")] if i % 2 else [spec.Feature("nation", "numerical", 5, [0.1 + 0.05 * i, 0.4, 0.6, 0.7 + 0.02 * i], f"cross:{i}")] for i in range(8)])
_CROSS_SQL = embed.embed_sql("both_", "id", _CROSS)


@query(f"WITH both_ AS (SELECT s_suppkey AS id, s_acctbal AS bal, s_nationkey AS nation FROM supplier UNION ALL SELECT -r_regionkey - 1, r_regionkey * 1500.0, r_regionkey * 5 FROM region), {_CROSS_SQL} SELECT a.id AS i, b.id AS j, round(avg(CASE WHEN a.cell <> b.cell THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS dist FROM cells a JOIN cells b ON a.l = b.l WHERE a.id >= 0 AND b.id < 0 GROUP BY 1, 2")
def cross_hamming(spark: SparkSession, d: str) -> DataFrame:
    s = read(spark, d, "supplier").select(F.col("s_suppkey").cast("bigint").alias("id"), F.col("s_acctbal").alias("bal"), F.col("s_nationkey").cast("double").alias("nation"))
    r = read(spark, d, "region").select((-F.col("r_regionkey") - 1).cast("bigint").alias("id"), (F.col("r_regionkey") * 1500.0).alias("bal"), (F.col("r_regionkey") * 5).cast("double").alias("nation"))
    fitted = spec.fit(s.unionByName(r), _CROSS)
    return pairs.cross_hamming(embed.embed(s, fitted, ["id"]), embed.embed(r, fitted, ["id"]), "id", "id").withColumn("dist", F.round("dist", 6))


_SIM = f"""WITH {CUSTOMER_SQL}, y AS (SELECT c_custkey AS id, c_mktsegment AS label FROM customer), s AS (SELECT label, count(*)::DOUBLE AS size FROM y GROUP BY 1),
h AS (SELECT l, cell, label, count(*)::DOUBLE AS n FROM cells JOIN y ON cells.id = y.id GROUP BY 1, 2, 3),
m AS (SELECT c.id, y.label AS own, s.label AS cluster, s.size::BIGINT AS size, sum(coalesce(h.n, 0) / s.size) / {len(CUSTOMER.iterations)} AS similarity FROM cells c JOIN y ON c.id = y.id CROSS JOIN s LEFT JOIN h ON h.l = c.l AND h.cell = c.cell AND h.label = s.label GROUP BY 1, 2, 3, 4)"""


@query(_SIM + " SELECT id, own, cluster, size, round(similarity, 6) AS similarity FROM m")
def mean_similarity_to_clusters(spark: SparkSession, d: str) -> DataFrame:
    return pairs.mean_similarity(customer_cells(spark, d), customer_labels(spark, d), "c_custkey").withColumn("similarity", F.round("similarity", 6))


@query(_SIM + " SELECT own, cluster, round(avg(CASE WHEN own = cluster THEN (similarity * size - 1) / (size - 1) ELSE similarity END), 6) AS similarity FROM m GROUP BY 1, 2")
def proximity_blocks(spark: SparkSession, d: str) -> DataFrame:
    s = pairs.mean_similarity(customer_cells(spark, d), customer_labels(spark, d), "c_custkey")
    off = F.when(F.col("own") == F.col("cluster"), (F.col("similarity") * F.col("size") - 1) / (F.col("size") - 1)).otherwise(F.col("similarity"))
    return s.groupBy("own", "cluster").agg(F.round(F.avg(off), 6).alias("similarity"))


@query(_SIM + ", ab AS (SELECT id, own AS label, max(CASE WHEN own = cluster THEN 1 - (similarity * size - 1) / (size - 1) END) AS a, min(CASE WHEN own <> cluster THEN 1 - similarity END) AS b FROM m GROUP BY 1, 2) SELECT id, label, round((b - a) / greatest(a, b), 6) + 0.0 AS silhouette FROM ab")
def hamming_silhouette(spark: SparkSession, d: str) -> DataFrame:
    return metrics.hamming_silhouette(customer_cells(spark, d), customer_labels(spark, d), "c_custkey").withColumn("silhouette", F.round("silhouette", 6) + 0.0)


#: Components of the vectors of `embeddings`, all of which the queries below use.
WIDTH = 64


def _points(spark: SparkSession, d: str) -> DataFrame:
    from tabseg.sources.tables import spread_vector

    e = read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label", "embedding")
    return spread_vector(e, "embedding", WIDTH)


_P = [f"x{i}" for i in range(WIDTH)]
_POINTS = "p AS (SELECT vec_id AS id, label, " + ", ".join(f"embedding[{i + 1}]::DOUBLE AS x{i}" for i in range(WIDTH)) + " FROM embeddings)"
_DIST = "sqrt(" + " + ".join(f"(a.x{i} - b.x{i}) * (a.x{i} - b.x{i})" for i in range(WIDTH)) + ")"


@query(f"WITH {_POINTS}, d AS (SELECT a.id, a.label AS la, b.label AS lb, avg({_DIST}) AS d FROM p a JOIN p b ON a.id <> b.id GROUP BY 1, 2, 3), t AS (SELECT id, la, max(CASE WHEN la = lb THEN d END) AS a, min(CASE WHEN la <> lb THEN d END) AS b FROM d GROUP BY 1, 2) SELECT id, la AS label, round(CASE WHEN a IS NULL OR b IS NULL THEN 0.0 ELSE (b - a) / greatest(a, b) END, 6) + 0.0 AS silhouette FROM t")
def euclid_silhouette(spark: SparkSession, d: str) -> DataFrame:
    return metrics.euclid_silhouette(_points(spark, d), _P).withColumn("silhouette", F.round("silhouette", 6) + 0.0)


_M = ", ".join(f"avg(x{i}) AS m{i}" for i in range(WIDTH))
_SSE = " + ".join(f"sum(x{i} * x{i}) - sum(x{i}) * sum(x{i}) / count(*)" for i in range(WIDTH))


@query(f"""WITH {_POINTS}, c AS (SELECT label, count(*)::DOUBLE AS n, {_M}, {_SSE} AS sse FROM p GROUP BY 1), g AS (SELECT {_M}, count(*)::DOUBLE AS n FROM p),
t AS (SELECT sum(c.sse) AS w, sum(c.n * ({" + ".join(f"(c.m{i} - g.m{i}) ** 2" for i in range(WIDTH))})) AS b, max(g.n) AS n, count(*)::DOUBLE AS k FROM c CROSS JOIN g),
s AS (SELECT p.label, avg(sqrt({" + ".join(f"(p.x{i} - c.m{i}) ** 2" for i in range(WIDTH))})) AS s FROM p JOIN c ON p.label = c.label GROUP BY 1),
r AS (SELECT a.label, max((sa.s + sb.s) / sqrt({" + ".join(f"(a.m{i} - b.m{i}) ** 2" for i in range(WIDTH))})) AS r FROM c a JOIN c b ON a.label <> b.label JOIN s sa ON sa.label = a.label JOIN s sb ON sb.label = b.label GROUP BY 1)
SELECT t.n::BIGINT AS n, t.k::INTEGER AS k, round(t.b / t.w * (t.n - t.k) / (t.k - 1), 4) AS calinski_harabasz, round((SELECT avg(r) FROM r), 4) AS davies_bouldin, round(t.w, 3) AS sse FROM t""")
def separation_scores(spark: SparkSession, d: str) -> DataFrame:
    s = metrics.separation(_points(spark, d), _P)
    return s.select("n", "k", F.round("calinski_harabasz", 4).alias("calinski_harabasz"), F.round("davies_bouldin", 4).alias("davies_bouldin"), F.round("sse", 3).alias("sse"))


_ARI = "WITH t AS (SELECT {a} AS a, {b} AS b, count(*)::DOUBLE AS n FROM {t} WHERE {a} IS NOT NULL AND {b} IS NOT NULL GROUP BY 1, 2), c AS (SELECT sum(n * (n - 1) / 2) AS c, sum(n) AS t FROM t), r AS (SELECT sum(n * (n - 1) / 2) AS r FROM (SELECT a, sum(n) AS n FROM t GROUP BY 1)), s AS (SELECT sum(n * (n - 1) / 2) AS s FROM (SELECT b, sum(n) AS n FROM t GROUP BY 1))"


@query(_ARI.format(a="cat_1", b="binary_1", t="mixed_rows") + " SELECT t::BIGINT AS n, round((c - r * s / (t * (t - 1) / 2)) / ((r + s) / 2 - r * s / (t * (t - 1) / 2)), 6) AS ari FROM c, r, s")
def ari_contingency(spark: SparkSession, d: str) -> DataFrame:
    return metrics.ari(metrics.contingency(read(spark, d, "mixed_rows"), "cat_1", "binary_1")).withColumn("ari", F.round("ari", 6))


@query("WITH t AS (SELECT cat_1 AS a, cat_2 AS b, count(*)::DOUBLE AS n FROM mixed_rows WHERE cat_1 IS NOT NULL AND cat_2 IS NOT NULL GROUP BY 1, 2), x AS (SELECT a, b, n, sum(n) OVER (PARTITION BY a) AS na, sum(n) OVER (PARTITION BY b) AS nb, sum(n) OVER () AS t FROM t), m AS (SELECT sum(n / t * ln(n * t / (na * nb))) AS mi FROM x), ha AS (SELECT sum(-na / t * ln(na / t)) AS h FROM (SELECT DISTINCT a, na, t FROM x)), hb AS (SELECT sum(-nb / t * ln(nb / t)) AS h FROM (SELECT DISTINCT b, nb, t FROM x)) SELECT round(mi / ((ha.h + hb.h) / 2), 6) AS nmi FROM m, ha, hb")
def nmi(spark: SparkSession, d: str) -> DataFrame:
    return metrics.nmi(metrics.contingency(read(spark, d, "mixed_rows"), "cat_1", "cat_2")).withColumn("nmi", F.round("nmi", 6))


# neighbour graphs

_KNN = f"WITH {SUPPLIER_SQL}, d AS (SELECT a.id AS src, b.id AS dst, sum(CASE WHEN a.cell <> b.cell THEN 1 ELSE 0 END)::INTEGER AS dist FROM cells a JOIN cells b ON a.l = b.l AND a.id <> b.id GROUP BY 1, 2), k AS (SELECT src, dst, dist FROM (SELECT src, dst, dist, row_number() OVER (PARTITION BY src ORDER BY dist, dst) AS r FROM d) WHERE r <= 5)"


@query(_KNN + " SELECT src, dst, dist FROM k")
def knn_exact(spark: SparkSession, d: str) -> DataFrame:
    return pairs.knn(supplier_cells(spark, d), "s_suppkey", 5)


@query(" UNION ALL ".join(f"SELECT {w}::INTEGER AS width, round(sum(n * n)::DOUBLE / sum(n), 4) AS load, round(sum(CASE WHEN n > 1 THEN n ELSE 0 END)::DOUBLE / sum(n), 4) AS coverage FROM (SELECT band, k, count(*) AS n FROM (SELECT id, l // {w} AS band, string_agg(cell::VARCHAR, ',' ORDER BY l) AS k FROM cells WHERE l // {w} < {12 // w} GROUP BY 1, 2) GROUP BY 1, 2)" for w in (2, 3, 4, 6)).join([f"WITH {CUSTOMER_SQL} ", ""]))
def lsh_bucket_loads(spark: SparkSession, d: str) -> DataFrame:
    b = pairs.bucket_loads(customer_cells(spark, d), "c_custkey", 12, (2, 3, 4, 6))
    return b.select("width", F.round("load", 4).alias("load"), F.round("coverage", 4).alias("coverage"))


@query(f"WITH {SUPPLIER_SQL}, b AS (SELECT id, l // 5 AS band, string_agg(cell::VARCHAR, ',' ORDER BY l) AS k FROM cells GROUP BY 1, 2), e AS (SELECT DISTINCT a.id AS src, c.id AS dst FROM b a JOIN b c ON a.band = c.band AND a.k = c.k AND a.id <> c.id), d AS (SELECT src, dst, sum(CASE WHEN x.cell <> y.cell THEN 1 ELSE 0 END)::INTEGER AS dist FROM e JOIN cells x ON x.id = src JOIN cells y ON y.id = dst AND y.l = x.l GROUP BY 1, 2) SELECT src, dst, dist FROM (SELECT src, dst, dist, row_number() OVER (PARTITION BY src ORDER BY dist, dst) AS r FROM d) WHERE r <= 5")
def lsh_knn(spark: SparkSession, d: str) -> DataFrame:
    return pairs.lsh_knn(supplier_cells(spark, d), "s_suppkey", 5, 5)


@query(_KNN + " SELECT src, dst, max(dist)::INTEGER AS dist FROM (SELECT src, dst, dist FROM k UNION ALL SELECT dst, src, dist FROM k) GROUP BY 1, 2")
def knn_symmetric(spark: SparkSession, d: str) -> DataFrame:
    return pairs.symmetrise(pairs.knn(supplier_cells(spark, d), "s_suppkey", 5))


@query(_KNN + " SELECT a.src, a.dst, least(a.dist, b.dist)::INTEGER AS dist FROM k a JOIN k b ON a.src = b.dst AND a.dst = b.src")
def knn_mutual(spark: SparkSession, d: str) -> DataFrame:
    return pairs.mutual(pairs.knn(supplier_cells(spark, d), "s_suppkey", 5))


@query(_KNN + ", s AS (SELECT max(dist)::DOUBLE AS m, quantile_cont(CASE WHEN dist > 0 THEN dist END, 0.5) AS med FROM k) SELECT src, dst, round(CASE WHEN m > 0 THEN 1 - dist / m ELSE 1 END, 6) AS linear, round(exp(-(dist * dist) / (2 * (med + 1e-10) ** 2)), 6) AS gauss, round(CASE WHEN dist > 0 THEN 1 / (dist + 1e-10) ELSE 1e10 END, 4) AS inverse FROM k CROSS JOIN s")
def edge_similarity(spark: SparkSession, d: str) -> DataFrame:
    e = materialise(pairs.knn(supplier_cells(spark, d), "s_suppkey", 5))
    lin, exp = pairs.edge_similarity(e, "linear"), pairs.edge_similarity(e, "exp")
    inv = pairs.edge_similarity(e, "inverse")
    return lin.select("src", "dst", F.round("w", 6).alias("linear")).join(exp.select("src", "dst", F.round("w", 6).alias("gauss")), ["src", "dst"]).join(inv.select("src", "dst", F.round("w", 4).alias("inverse")), ["src", "dst"])


__all__ = ["Q", "SQL", "Window", "exact_quantiles", "query"]
