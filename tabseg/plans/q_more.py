"""Queries over sources, normalisers, contrastive pairs, bit kernels, synthetic rows, and small parts of the façade, and their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabseg.functions import cuts, encode, weights
from tabseg.operators import community, compress, contrast, embed, explain, forests, infer, metrics, pairs, report, segment
from tabseg.plans import spec
from tabseg.plans.q_embed import _KNN, _P, CUSTOMER_SQL, PART, PART_SQL, SUPPLIER_SQL, WIDTH, _points, customer_cells, customer_labels, part_cells, supplier_cells
from tabseg.session import materialise, read, shared_dir
from tabseg.sources import tables

Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def hashed(key: str) -> str:
    """SQL of hash32."""
    return f"('0x' || substr(md5({key}), 1, 8))::BIGINT"


def drawn(key: str) -> str:
    """SQL of uniform."""
    return f"(({hashed(key)} + 0.5) / 4294967296.0)"


# sources and sinks


@query("SELECT n_nationkey::BIGINT AS row_id, n_name AS name, n_regionkey::BIGINT AS region FROM nation")
def frame_ingest(spark: SparkSession, d: str) -> DataFrame:
    """An in-memory frame (a fixed table of 25 rows) as a table with row ids."""
    frame = read(spark, d, "nation").orderBy("n_nationkey").toPandas()
    return tables.from_pandas(spark, frame).select(F.col("row_id").cast("bigint").alias("row_id"), F.col("n_name").alias("name"), F.col("n_regionkey").cast("bigint").alias("region"))


@query(" UNION ALL ".join(f"SELECT '{f}' AS fmt, count(*) AS n, sum(s_nationkey)::BIGINT AS nations, round(sum(s_acctbal), 2) AS balance FROM supplier" for f in ("csv", "json", "orc", "parquet")))
def file_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """A table written in every format and read back."""
    s, out = read(spark, d, "supplier").select("s_suppkey", "s_name", "s_nationkey", "s_acctbal"), None
    for fmt in ("csv", "json", "orc", "parquet"):
        path = f"{shared_dir(spark)}/format-{uuid.uuid4().hex}"
        w = s.write.option("header", True) if fmt == "csv" else s.write
        w.format(fmt).save(path) if fmt == "csv" else tables.write_table(s, path, fmt)
        one = tables.read_table(spark, path, fmt, s.schema).agg(F.lit(fmt).alias("fmt"), F.count("*").alias("n"), F.sum("s_nationkey").alias("nations"), F.round(F.sum("s_acctbal"), 2).alias("balance"))
        out = one if out is None else out.unionByName(one)
    return out


@query("SELECT xxhash, count(*) AS n FROM (SELECT count(*) AS xxhash FROM orders GROUP BY o_orderstatus, o_orderpriority) GROUP BY 1")
def row_ids(spark: SparkSession, d: str) -> DataFrame:
    """Reproducible ids from key columns: equal keys share one, so group sizes are those of the keys."""
    o = tables.add_row_id(read(spark, d, "orders"), ["o_orderstatus", "o_orderpriority"])
    return o.groupBy("row_id").agg(F.count("*").alias("xxhash")).groupBy("xxhash").agg(F.count("*").alias("n"))


# normalisers and small rules


@query("""WITH c AS (SELECT source AS v, count(*) AS n, count(*) >= 20 AND count(*)::DOUBLE / sum(count(*)) OVER () >= 0.02 AS kept FROM documents WHERE source IS NOT NULL GROUP BY 1)
SELECT CASE WHEN source IS NULL THEN NULL WHEN kept THEN source ELSE '__rare__' END AS source, count(*) AS n, sum(n_cells)::DOUBLE AS cells, sum(CASE WHEN lang IS NULL THEN 1 ELSE 0 END)::BIGINT AS without_lang FROM documents LEFT JOIN c ON source = v GROUP BY 1""")
def normalised_table(spark: SparkSession, d: str) -> DataFrame:
    """Numeric texts, rare categories and missing values in one transformer (n_cells comes in as text)."""
    x = read(spark, d, "documents").select("doc_id", F.col("n_cells").cast("string").alias("n_cells"), "source", F.col("lang").alias("lang"))
    rare = encode.Normaliser({"n_cells": "numerical", "source": "categorical"}, True, 20, 0.02).fit(x).transform(x, ["doc_id", "lang"])
    both = encode.Normaliser({"lang": "categorical"}, True).fit(x).transform(x, ["doc_id"])
    gone = F.coalesce(F.col("lang__missing").cast("bigint"), F.lit(0)) if "lang__missing" in both.columns else F.lit(0).cast("bigint")
    return rare.join(both.select("doc_id", gone.alias("gone")), "doc_id").groupBy("source").agg(F.count("*").alias("n"), F.sum("n_cells").alias("cells"), F.sum("gone").alias("without_lang"))


@query("SELECT d::INTEGER AS d, ceil(sqrt(d))::INTEGER AS root, greatest(ceil(log2(d)), 1)::INTEGER AS log, least(greatest(ceil(0.3 * d), 1), d)::INTEGER AS part, least(4, d)::INTEGER AS fixed FROM (SELECT n_nationkey + 1 AS d FROM nation)")
def feature_counts(spark: SparkSession, d: str) -> DataFrame:
    rows = [(k + 1, *[cuts.resolve_features(m, k + 1) for m in ("sqrt", "log2", 0.3, 4)]) for k in range(25)]
    return spark.createDataFrame(rows, "d int, root int, log int, part int, fixed int")


@query(f"""SELECT s_suppkey AS id, round(CASE WHEN {drawn("concat(s_suppkey, ':drop:5:s_acctbal')")} < 0.1 THEN 0.0 ELSE s_acctbal + 0.1 * sqrt(-2 * ln({drawn("concat(s_suppkey, ':noise:5:s_acctbal:r')")})) * cos(6.283185307179586 * {drawn("concat(s_suppkey, ':noise:5:s_acctbal:a')")}) END, 4) + 0.0 AS x FROM supplier""")
def augmented(spark: SparkSession, d: str) -> DataFrame:
    x = contrast.augment(read(spark, d, "supplier"), "s_suppkey", ["s_acctbal"], seed=5)
    return x.select(F.col("s_suppkey").alias("id"), (F.round("s_acctbal", 4) + 0.0).alias("x"))


@query("SELECT round(0.9 * least(stddev_samp(p_size), (quantile_cont(p_size, 0.75) - quantile_cont(p_size, 0.25)) / 1.34) * least(count(*), 5000) ** -0.2, 6) AS silverman, round(stddev_samp(p_size) * least(count(*), 5000) ** -0.2, 6) AS scott FROM part")
def bandwidths(spark: SparkSession, d: str) -> DataFrame:
    x, n = cuts.weighted_points(read(spark, d, "part"), "p_size")
    order = np.argsort(x)
    return spark.createDataFrame([tuple(round(float(cuts.bandwidth(x[order], r, n[order])), 6) for r in ("silverman", "scott"))], "silverman double, scott double")


@query("SELECT col, 40::BIGINT AS draws FROM (VALUES ('l_quantity or l_extendedprice'), ('l_discount'), ('l_tax')) v(col)")
def group_picks(spark: SparkSession, d: str) -> DataFrame:
    """Forty draws of three columns, at most one of each correlation group: each group is drawn every time, the correlated pair once."""
    x = read(spark, d, "lineitem").select("l_quantity", "l_extendedprice", "l_discount", "l_tax")
    corr = weights.pearson(x, x.columns)
    groups = weights.groups_of(x.columns, {p: (1.0 if p == ("l_quantity", "l_extendedprice") else r) for p, r in corr.items()}, 0.5)
    w, rng, seen = weights.group_weights(x.columns, {("l_quantity", "l_extendedprice"): 1.0}, 0.5), np.random.default_rng(3), {}
    for _ in range(40):
        for c in weights.pick_across_groups(x.columns, groups, w, 3, rng):
            name = "l_quantity or l_extendedprice" if c in ("l_quantity", "l_extendedprice") else c
            seen[name] = seen.get(name, 0) + 1
    return spark.createDataFrame(list(seen.items()), "col string, draws bigint")


# embeddings

_WIDE = spec.draw({"p_size": "numerical", "p_retailprice": "numerical", "p_brand": "categorical"}, 70, 1, 3, seed=9)


@query(f"WITH {embed.embed_sql('part', 'p_partkey', _WIDE)} SELECT l::INTEGER AS l, cell, count(*) AS n, sum(id)::BIGINT AS ids FROM cells GROUP BY 1, 2")
def embed_wide(spark: SparkSession, d: str) -> DataFrame:
    """Seventy iterations, which are embedded by batches of arrays instead of one expression."""
    p = read(spark, d, "part")
    return embed.long_cells(embed.embed(p, spec.fit(p, _WIDE), ["p_partkey"]), "p_partkey").groupBy("l", "cell").agg(F.count("*").alias("n"), F.sum("id").alias("ids"))


_MODEL = spec.draw({"c_nationkey": "categorical", "c_acctbal": "numerical", "c_mktsegment": "categorical"}, 8, "sqrt", 3, 42)


@query(f"WITH {embed.embed_sql('customer', 'c_custkey', _MODEL)} SELECT id, l::INTEGER AS l, cell FROM cells")
def transformer(spark: SparkSession, d: str) -> DataFrame:
    """fit, then the fitted rows' cells for odd ids and transform for even ones."""
    c = read(spark, d, "customer").drop("c_name")
    t = segment.ForestTransformer(8).fit(c, "c_custkey")
    return embed.long_cells(t.get_embedding().where("c_custkey % 2 = 1").unionByName(t.transform(c.where("c_custkey % 2 = 0"), "c_custkey")), "c_custkey")


_RING = f"""x AS (SELECT s_suppkey AS id, s_nationkey % 3 AS label, {hashed("concat(s_suppkey, ':ring:0')")} AS h FROM supplier), n AS (SELECT label, count(*) AS n FROM x GROUP BY 1), t AS (SELECT count(*) AS n FROM x),
s AS (SELECT id, label, row_number() OVER (PARTITION BY label ORDER BY h, id) - 1 AS pos FROM x), w AS (SELECT id, label, row_number() OVER (ORDER BY h, id) - 1 AS pos FROM x),
pos AS (SELECT DISTINCT a.id AS anchor, b.id AS other FROM s a JOIN n ON a.label = n.label CROSS JOIN (SELECT unnest([1, 2, 3]) AS k) JOIN s b ON b.label = a.label AND b.pos = (a.pos + k) % n.n WHERE a.id <> b.id),
neg AS (SELECT DISTINCT a.id AS anchor, b.id AS other FROM w a CROSS JOIN t CROSS JOIN (SELECT unnest([1, 2, 3, 4, 5, 6]) AS k) JOIN w b ON b.pos = (a.pos + k) % t.n WHERE a.label <> b.label),
pr AS (SELECT anchor, other, true AS positive FROM pos UNION ALL SELECT anchor, other, false FROM neg)"""


def _ring(spark: SparkSession, d: str) -> DataFrame:
    return contrast.pairs_by_label(read(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), (F.col("s_nationkey") % 3).alias("label")))


@query(f"WITH {_RING} SELECT anchor, other, positive FROM pr")
def label_pairs(spark: SparkSession, d: str) -> DataFrame:
    return _ring(spark, d)


@query(f"""WITH {_RING}, {SUPPLIER_SQL}, m AS (SELECT anchor, other, positive, exp(avg(CASE WHEN a.cell = b.cell THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) / 0.5) AS e FROM pr JOIN cells a ON a.id = anchor JOIN cells b ON b.id = other AND b.l = a.l GROUP BY 1, 2, 3),
g AS (SELECT anchor, sum(e) AS neg FROM m WHERE NOT positive GROUP BY 1) SELECT round(avg(-ln(e / (e + neg))), 6) AS loss, count(*) AS n FROM m JOIN g USING (anchor) WHERE positive""")
def contrastive_loss(spark: SparkSession, d: str) -> DataFrame:
    c = materialise(supplier_cells(spark, d))
    p = _ring(spark, d).join(c.select(F.col("s_suppkey").alias("anchor"), F.col("cells").alias("a")), "anchor").join(c.select(F.col("s_suppkey").alias("other"), F.col("cells").alias("b")), "other")
    return contrast.nt_xent(p.select("anchor", "other", "positive", (1 - pairs.mismatches("a", "b") / F.size("a")).alias("similarity"))).select(F.round("loss", 6).alias("loss"), "n")


@query("WITH x AS (SELECT c_mktsegment AS c, c_acctbal < 2000 AS s FROM customer), n AS (SELECT c, s, count(*)::DOUBLE AS n FROM x GROUP BY 1, 2), t AS (SELECT sum(n) AS t FROM n), w AS (SELECT sum(-n / t * log2(n / t)) AS h FROM (SELECT c, sum(n) AS n FROM n GROUP BY 1), t), h AS (SELECT s, sum(n) AS m, sum(-n / m0 * log2(n / m0)) AS h FROM (SELECT c, s, n, sum(n) OVER (PARTITION BY s) AS m0 FROM n) GROUP BY 1) SELECT round(max(w.h) - sum(h.m / t.t * h.h), 8) + 0.0 AS gain FROM h, w, t")
def information_gain(spark: SparkSession, d: str) -> DataFrame:
    return contrast.split_gain(read(spark, d, "customer"), "c_mktsegment", F.col("c_acctbal") < 2000).select((F.round("gain", 8) + 0.0).alias("gain"))


_WEIGHTS = [1.0, 2.0, 0.5, 1.0, 3.0, 1.0, 0.25, 1.0, 2.0, 1.5]
_W_SQL = "(VALUES " + ", ".join(f"({i}, {w}::DOUBLE)" for i, w in enumerate(_WEIGHTS)) + ") w(l, w)"


@query(f"WITH {SUPPLIER_SQL} SELECT a.id AS i, round(sum(CASE WHEN a.cell <> b.cell THEN w.w ELSE 0.0::DOUBLE END) / sum(w.w), 6) AS squared, sum(CASE WHEN a.cell = b.cell THEN 1 ELSE 0 END)::DOUBLE AS shared FROM cells a JOIN cells b ON a.l = b.l AND b.id = a.id + 1 JOIN {_W_SQL} ON a.l = w.l GROUP BY 1")
def feature_distances(spark: SparkSession, d: str) -> DataFrame:
    """Squared distances of the weighted one-hot features, and inner products of the bare ones, of rows with neighbouring ids."""
    from pyspark.ml.functions import vector_to_array

    c, out = materialise(supplier_cells(spark, d)), []
    for w, value in ((np.array(_WEIGHTS), lambda p, q: (p - q) * (p - q)), (None, lambda p, q: p * q)):
        v = materialise(embed.phi(c, "s_suppkey", w).select("id", vector_to_array("features").alias("v")))
        both = v.select(F.col("id").alias("i"), F.col("v").alias("a")).join(v.select((F.col("id") - 1).alias("i"), F.col("v").alias("b")), "i")
        out.append(both.select("i", F.aggregate(F.zip_with("a", "b", value), F.lit(0.0), lambda s, x: s + x).alias("s")))
    return out[0].select("i", F.round("s", 6).alias("squared")).join(out[1].select("i", F.col("s").alias("shared")), "i")


@query("SELECT name, name IN ('KMeans', 'MiniBatchKMeans', 'Birch') AS sparse FROM (VALUES ('KMeans'), ('MiniBatchKMeans'), ('Birch'), ('AgglomerativeClustering'), ('DBSCAN'), ('SpectralClustering')) v(name)")
def sparse_capable(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([(n, embed.sparse_capable(n)) for n in ("KMeans", "MiniBatchKMeans", "Birch", "AgglomerativeClustering", "DBSCAN", "SpectralClustering")], "name string, sparse boolean")


# distances


@query(f"WITH {SUPPLIER_SQL} SELECT a.id AS i, b.id AS j, round(avg(CASE WHEN a.cell <> b.cell THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS dist FROM cells a JOIN cells b ON a.l = b.l AND a.id < b.id GROUP BY 1, 2")
def lenient_weights(spark: SparkSession, d: str) -> DataFrame:
    """Weights that are all zero count as uniform ones."""
    return pairs.hamming_pairs(supplier_cells(spark, d), "s_suppkey", pairs.usable_weights([0.0] * 10, 10)).withColumn("dist", F.round("dist", 6))


_FITTED = spec.draw({"s_nationkey": "categorical", "s_acctbal": "numerical"}, 12, 1, 3, 42)


@query(f"WITH {embed.embed_sql('supplier', 's_suppkey', _FITTED)} SELECT a.id AS i, b.id AS j, round(avg(CASE WHEN a.cell = b.cell THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS similarity FROM cells a JOIN cells b ON a.l = b.l AND a.id < b.id GROUP BY 1, 2")
def fitted_similarities(spark: SparkSession, d: str) -> DataFrame:
    m = segment.ForestSegmenter(n_iterations=12, n_features=1, n_clusters=2).fit(read(spark, d, "supplier").drop("s_name"), "s_suppkey")
    return m.similarities().withColumn("similarity", F.round("similarity", 6))


@query(f"WITH {SUPPLIER_SQL} SELECT a.id AS i, b.id AS j, round(avg(CASE WHEN a.cell = b.cell THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS proximity FROM cells a JOIN cells b ON a.l = b.l AND a.id < b.id GROUP BY 1, 2")
def leaf_proximity(spark: SparkSession, d: str) -> DataFrame:
    return pairs.proximity(supplier_cells(spark, d), "s_suppkey").withColumn("proximity", F.round("proximity", 6))


@query(f"WITH {SUPPLIER_SQL} SELECT a.id AS i, b.id AS j, round(avg(CASE WHEN a.cell = b.cell THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS proximity FROM cells a JOIN cells b ON a.l = b.l WHERE a.id % 5 = 0 AND b.id % 5 <> 0 GROUP BY 1, 2")
def cross_proximity(spark: SparkSession, d: str) -> DataFrame:
    c = materialise(supplier_cells(spark, d))
    return pairs.cross_proximity(c.where("s_suppkey % 5 = 0"), c.where("s_suppkey % 5 <> 0"), "s_suppkey", "s_suppkey").withColumn("proximity", F.round("proximity", 6))


@query("SELECT a.s_suppkey AS i, b.s_suppkey AS j FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey")
def tree_proximity(spark: SparkSession, d: str) -> DataFrame:
    return pairs.label_proximity(read(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("label")))


@query(f"WITH {PART_SQL} SELECT a.id AS i, sum(CASE WHEN a.cell % 2 <> b.cell % 2 THEN 1 ELSE 0 END)::INTEGER AS bits FROM cells a JOIN cells b ON a.l = b.l AND b.id = a.id + 1 GROUP BY 1")
def bit_distances(spark: SparkSession, d: str) -> DataFrame:
    """Differing bits of packed rows with neighbouring ids."""
    words = pairs.pack_bits(part_cells(spark, d).select("p_partkey", F.transform("cells", lambda c: c % 2).alias("cells")), "p_partkey")
    both = words.select(F.col("id").alias("i"), F.col("words").alias("a")).join(words.select((F.col("id") - 1).alias("i"), F.col("words").alias("b")), "i")
    return both.select("i", pairs.bit_mismatches("a", "b").cast("int").alias("bits"))


_KNN2 = _KNN.replace("a.cell <> b.cell", "a.cell % 2 <> b.cell % 2")


@query(_KNN2 + " SELECT src, dst, dist FROM k")
def knn_binary(spark: SparkSession, d: str) -> DataFrame:
    """Exact neighbours of binary rows."""
    return pairs.knn(supplier_cells(spark, d).select("s_suppkey", F.transform("cells", lambda c: c % 2).alias("cells")), "s_suppkey", 5)


@query(f"WITH {CUSTOMER_SQL} SELECT id, l::INTEGER AS l, (dense_rank() OVER (PARTITION BY l ORDER BY cell) - 1)::INTEGER AS code FROM cells")
def compact_codes(spark: SparkSession, d: str) -> DataFrame:
    return pairs.compact_codes(customer_cells(spark, d), "c_custkey")


@query(f"WITH {CUSTOMER_SQL}, r AS (" + " UNION ALL ".join(f"SELECT {w} AS width, sum(n * n)::DOUBLE / sum(n) AS load, sum(CASE WHEN n > 1 THEN n ELSE 0 END)::DOUBLE / sum(n) AS coverage FROM (SELECT band, k, count(*) AS n FROM (SELECT id, l // {w} AS band, string_agg(cell::VARCHAR, ',' ORDER BY l) AS k FROM cells WHERE l // {w} < {12 // w} GROUP BY 1, 2) GROUP BY 1, 2)" for w in (2, 3, 4, 6, 8, 10, 12))
       + "), f AS (SELECT min(width) AS w FROM r WHERE load <= 40 AND coverage >= 0.7) SELECT coalesce(f.w, (SELECT arg_min(width, (-least(coverage, 40 / load), width)) FROM r))::INTEGER AS width FROM f")
def auto_band(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([(pairs.choose_band(customer_cells(spark, d), "c_custkey", 12, 5),)], "width int")


@query(_KNN + " SELECT src, dst, max(dist)::INTEGER AS dist FROM (SELECT src, dst, dist FROM k UNION ALL SELECT dst, src, dist FROM k) GROUP BY 1, 2")
def sparse_graph(spark: SparkSession, d: str) -> DataFrame:
    return pairs.sparse_graph(supplier_cells(spark, d), "s_suppkey", 5)


@query("SELECT * FROM (VALUES ('louvain', 'louvain', NULL::INTEGER, NULL::DOUBLE), ('leiden:k=20,resolution=1.5', 'leiden', 20, 1.5), (' louvain : gamma = 0.5', 'louvain', NULL, 0.5)) v(text, algorithm, k, resolution)")
def graph_shortcuts(spark: SparkSession, d: str) -> DataFrame:
    said = [(t, community.parse_graph(t.replace(" : ", ":"))) for t in ("louvain", "leiden:k=20,resolution=1.5", " louvain : gamma = 0.5")]
    return spark.createDataFrame([(t, s["algorithm"], s.get("k"), s.get("resolution")) for t, s in said], "text string, algorithm string, k int, resolution double")


_NOISE = """x AS (SELECT s_suppkey AS id, CASE WHEN s_suppkey % 7 = 0 THEN 1000000 + s_suppkey ELSE s_suppkey // 3 END AS label, [s_suppkey // 3, s_suppkey // 9, s_suppkey // 27, s_suppkey % 2] AS c FROM supplier), n AS (SELECT label, count(*) AS n FROM x GROUP BY 1)"""


@query(f"""WITH {_NOISE}, lone AS (SELECT x.* FROM x JOIN n USING (label) WHERE n = 1), crowd AS (SELECT x.* FROM x JOIN n USING (label) WHERE n > 1),
near AS (SELECT id, label FROM (SELECT a.id, b.label, row_number() OVER (PARTITION BY a.id ORDER BY (a.c[1] <> b.c[1])::INTEGER + (a.c[2] <> b.c[2])::INTEGER + (a.c[3] <> b.c[3])::INTEGER + (a.c[4] <> b.c[4])::INTEGER, b.id) AS r FROM lone a CROSS JOIN crowd b) WHERE r = 1),
o AS (SELECT 'merge' AS strategy, id, label FROM near UNION ALL SELECT 'merge', id, label FROM crowd UNION ALL SELECT 'singleton', id, label FROM x UNION ALL SELECT 'mark', id, label FROM crowd),
k AS (SELECT strategy, label, row_number() OVER (PARTITION BY strategy ORDER BY count(*) DESC, min(id)) - 1 AS number FROM o GROUP BY 1, 2)
SELECT o.strategy, o.id, k.number::INTEGER AS label FROM o JOIN k ON o.strategy = k.strategy AND o.label = k.label UNION ALL SELECT 'mark', id, -1 FROM lone""")
def noise_strategies(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("s_suppkey")
    x = read(spark, d, "supplier").select(s.alias("id"), F.when(s % 7 == 0, 1000000 + s).otherwise(F.floor(s / 3)).cast("bigint").alias("label"), F.array(F.floor(s / 3), F.floor(s / 9), F.floor(s / 27), (s % 2).cast("bigint")).alias("cells"))
    out = None
    for how in ("mark", "merge", "singleton"):
        one = community.handle_noise(x.select("id", "label"), how, x.select("id", "cells")).select(F.lit(how).alias("strategy"), "id", "label")
        out = one if out is None else out.unionByName(one)
    return out


@query("WITH n AS (SELECT s_nationkey AS g, row_number() OVER (ORDER BY count(*) DESC, min(s_suppkey)) - 1 AS label FROM supplier GROUP BY 1) SELECT s_suppkey AS id, label::INTEGER AS label FROM supplier JOIN n ON s_nationkey = g")
def renumbered(spark: SparkSession, d: str) -> DataFrame:
    return community.renumber(read(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("label")))


# synthetic rows


def _dealt(c: str) -> str:
    return f"""(SELECT a.id, b.v FROM (SELECT s_suppkey AS id, row_number() OVER (ORDER BY {hashed(f"concat(s_suppkey, ':to:42:{c}')")}, s_suppkey) AS p FROM supplier) a JOIN (SELECT {c} AS v, row_number() OVER (ORDER BY {hashed(f"concat(s_suppkey, ':from:42:{c}')")}, s_suppkey) AS p FROM supplier) b USING (p))"""


@query(f"SELECT a.id, a.v AS s_acctbal, b.v AS s_nationkey FROM {_dealt('s_acctbal')} a JOIN {_dealt('s_nationkey')} b USING (id)")
def permuted_marginals(spark: SparkSession, d: str) -> DataFrame:
    x = forests.synthetic(read(spark, d, "supplier"), "s_suppkey", ["s_acctbal"], ["s_nationkey"])
    return x.select(F.col("s_suppkey").alias("id"), "s_acctbal", "s_nationkey")


@query(f"""WITH e AS (SELECT min(c_acctbal) AS a, max(c_acctbal) AS b FROM customer), v AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT c_mktsegment AS v FROM customer)), k AS (SELECT count(*) AS n FROM v)
SELECT c_custkey AS id, round(a + {drawn("concat(c_custkey, ':42:c_acctbal')")} * (b - a), 6) AS x, v.v AS c FROM customer CROSS JOIN e CROSS JOIN k JOIN v ON v.i = floor({drawn("concat(c_custkey, ':42:c_mktsegment')")} * k.n)""")
def uniform_box(spark: SparkSession, d: str) -> DataFrame:
    x = forests.synthetic(read(spark, d, "customer"), "c_custkey", ["c_acctbal"], ["c_mktsegment"], "uniform_box")
    return x.select(F.col("c_custkey").alias("id"), F.round("c_acctbal", 6).alias("x"), F.col("c_mktsegment").alias("c"))


# compression, diagnostics, significance


@query(f"WITH {PART_SQL}, p AS (SELECT id, " + ", ".join(f"string_agg(CASE WHEN l < {k} THEN cell::VARCHAR END, ',' ORDER BY l) AS d{k}" for k in (1, 2, 4, 8)) + " FROM cells GROUP BY 1) SELECT * FROM (" + " UNION ALL ".join(f"SELECT {k} AS depth, count(DISTINCT d{k}) AS buckets FROM p" for k in (1, 2, 4, 8)) + ")")
def prefix_sizes(spark: SparkSession, d: str) -> DataFrame:
    return compress.prefix_sizes(part_cells(spark, d), len(PART.iterations))


@query(SQL["prefix_sizes"].replace("SELECT * FROM (", "SELECT coalesce(max(CASE WHEN buckets <= 40 THEN depth END), 1)::INTEGER AS depth FROM ("))
def chosen_depth(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([(compress.choose_depth(part_cells(spark, d), len(PART.iterations), 40),)], "depth int")


@query(f"WITH {PART_SQL}, b AS (SELECT id, string_agg(cell::VARCHAR, ',' ORDER BY l) AS sig FROM cells WHERE l < 3 GROUP BY 1) SELECT id, (min(id) OVER (PARTITION BY sig) % 4)::INTEGER AS label FROM b")
def label_expansion(spark: SparkSession, d: str) -> DataFrame:
    """Labels of prototypes (here: the bucket's number modulo four) handed on to all rows."""
    protos, of = compress.compress(part_cells(spark, d), "p_partkey", 3, representative="first")
    return compress.expand(of, protos.select(F.col("proto").alias("id"), (F.col("proto") % 4).cast("int").alias("label")))


_VEC = ", ".join(f"embedding[{i + 1}]::DOUBLE AS x{i}" for i in range(WIDTH))


@query(f"WITH p AS (SELECT vec_id AS id, {_VEC} FROM embeddings), d AS (SELECT a.id, b.id AS proto, sqrt({' + '.join(f'(a.x{i} - b.x{i}) ** 2' for i in range(WIDTH))}) AS dist FROM p a JOIN p b ON b.id % 50 = 0) SELECT id, proto, round(dist, 6) AS dist FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY dist, proto) AS r FROM d) WHERE r = 1")
def assign_points(spark: SparkSession, d: str) -> DataFrame:
    """The prototype (every fiftieth vector) nearest to each vector."""
    p = _points(spark, d)
    return compress.assign_points(p, _P, p.where("id % 50 = 0").withColumn("proto", F.col("id"))).withColumn("dist", F.round("dist", 6))


@query("SELECT c_mktsegment AS label, count(*) AS size, round(count(*)::DOUBLE / sum(count(*)) OVER (), 6) AS share FROM customer GROUP BY 1")
def cluster_sizes(spark: SparkSession, d: str) -> DataFrame:
    return explain.cluster_sizes(customer_labels(spark, d).select("label")).withColumn("share", F.round("share", 6))


@query("WITH e AS (SELECT min(p_retailprice) AS lo, (max(p_retailprice) - min(p_retailprice)) / 20 AS w FROM part) SELECT p_type AS by, least(floor((p_retailprice - lo) / w), 19)::INTEGER AS bin, count(*) AS n FROM part CROSS JOIN e GROUP BY 1, 2")
def histogram(spark: SparkSession, d: str) -> DataFrame:
    return report.histogram(read(spark, d, "part"), "p_retailprice", 20, "p_type").select("by", "bin", "n")


@query("SELECT 'sizes' AS name, count(DISTINCT c_mktsegment) AS rows FROM customer UNION ALL SELECT 'silhouettes', count(*) FROM customer UNION ALL SELECT 'blocks', count(DISTINCT c_mktsegment) * count(DISTINCT c_mktsegment) FROM customer UNION ALL SELECT 'numeric_profile', count(DISTINCT c_mktsegment) FROM customer UNION ALL SELECT 'cards', count(DISTINCT c_mktsegment) FROM customer UNION ALL SELECT 'uncertain', least(20, count(*)) FROM customer UNION ALL SELECT 'plane', count(*) FROM customer UNION ALL SELECT 'checks', 5")
def diagnostics_report(spark: SparkSession, d: str) -> DataFrame:
    """Sizes of the tables of the whole report."""
    r = report.diagnostics(read(spark, d, "customer"), materialise(customer_cells(spark, d)), customer_labels(spark, d), "c_custkey", ["c_acctbal"], ["c_nationkey"])
    return spark.createDataFrame([(n, len(r[n]) if n == "checks" else r[n].count()) for n in ("sizes", "silhouettes", "blocks", "numeric_profile", "cards", "uncertain", "plane", "checks")], "name string, rows bigint")


_MEAN = ", ".join(f"avg(x{i}) AS m{i}" for i in range(WIDTH))
_GAP2 = " + ".join(f"(p.x{i} - c.m{i}) ** 2" for i in range(WIDTH))


@query(f"""WITH p AS (SELECT vec_id AS id, label, {_VEC} FROM embeddings), c AS (SELECT label, count(*)::DOUBLE AS n, {_MEAN}, {" + ".join(f"var_pop(x{i})" for i in range(WIDTH))} AS v FROM p GROUP BY 1),
d AS (SELECT p.id, p.label, c.label AS cl, c.n, {_GAP2} + c.v AS d FROM p CROSS JOIN c), t AS (SELECT id, label, max(CASE WHEN label = cl AND n > 1 THEN d * n / (n - 1) END) AS a, min(CASE WHEN label <> cl THEN d END) AS b FROM d GROUP BY 1, 2)
SELECT id, label, round(CASE WHEN a IS NULL OR b IS NULL THEN 0.0 ELSE (b - a) / greatest(a, b) END, 6) + 0.0 AS silhouette FROM t""")
def squared_silhouette(spark: SparkSession, d: str) -> DataFrame:
    return metrics.squared_silhouette(_points(spark, d), _P).withColumn("silhouette", F.round("silhouette", 6) + 0.0)


@query("WITH v AS (SELECT s_suppkey AS id, sin(s_suppkey) AS x FROM supplier) SELECT id, CASE WHEN x <= 0 THEN 'none' WHEN x <= 0.1 THEN 'small' WHEN x <= 0.25 THEN 'medium' ELSE 'large' END AS ari, CASE WHEN x < 0 THEN 'poor' WHEN x < 0.25 THEN 'weak' WHEN x < 0.5 THEN 'moderate' WHEN x < 0.7 THEN 'strong' ELSE 'very strong' END AS silhouette FROM v")
def effect_labels(spark: SparkSession, d: str) -> DataFrame:
    x = F.sin(F.col("s_suppkey"))
    return read(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), infer.ari_effect(x).alias("ari"), infer.silhouette_effect(x).alias("silhouette"))
