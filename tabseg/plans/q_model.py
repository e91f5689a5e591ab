"""Queries over clusterers, trees, compression, explanation, diagnostics, significance and streams, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabseg.functions.encode import Preprocessor
from tabseg.operators import community, compress, contrast, embed, explain, forests, importance, infer, metrics, pairs, preflight, report, ruletree, search, segment
from tabseg.plans import spec
from tabseg.plans.q_embed import _KNN, _P, _POINTS, _SIM, CUSTOMER, CUSTOMER_SQL, PART, PART_SQL, SUPPLIER_SQL, _points, customer_cells, customer_labels, part_cells, supplier_cells
from tabseg.session import materialise, read, shared_dir
from tabseg.streaming import online

Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


#: Rows that fall into known groups: what a clusterer finds there is compared with the groups, numbered by falling size and then by smallest id.
PLANTED = "t AS (SELECT c_custkey AS id, (c_custkey % 3)::INTEGER AS g, (c_custkey % 3) * 100 + c_nationkey / 5.0 AS x, ((c_custkey % 3) * 2 % 3) * 80 + c_nationkey % 7 AS y, chr(97 + (c_custkey % 3)::INTEGER) AS c FROM customer)"
RANKED = "r AS (SELECT g, row_number() OVER (ORDER BY count(*) DESC, min(id)) - 1 AS label FROM t GROUP BY 1)"
GROUPS = f"WITH {PLANTED}, {RANKED} SELECT id, label::INTEGER AS label FROM t JOIN r USING (g)"


def planted(spark: SparkSession, d: str) -> DataFrame:
    """id, g, x, y, c of the customers: three groups, far apart in both numbers and with a category each."""
    k, n = F.col("c_custkey") % 3, F.col("c_nationkey")
    return read(spark, d, "customer").select(
        F.col("c_custkey").alias("id"), k.cast("int").alias("g"), (k * 100 + n / 5.0).cast("double").alias("x"), (k * 2 % 3 * 80 + n % 7).cast("double").alias("y"), F.element_at(F.array(F.lit("a"), F.lit("b"), F.lit("c")), (k + 1).cast("int")).alias("c")
    )


def planted_cells(spark: SparkSession, d: str, table: str = "supplier", key: str = "s_suppkey", size: int = 8) -> DataFrame:
    """Rows in groups of `size` ids, that share all cells but the last."""
    g = F.floor(F.col(key) / size).cast("bigint")
    return read(spark, d, table).select(F.col(key).alias("id"), F.array(g, g, g, g, F.col(key).cast("bigint")).alias("cells"))


def cliques(table: str, key: str, size: int = 8) -> str:
    return f"WITH t AS (SELECT {key} AS id, {key} // {size} AS g FROM {table}), n AS (SELECT g, count(*) AS n FROM t GROUP BY 1), r AS (SELECT g, row_number() OVER (ORDER BY count(*) DESC, min(id)) - 1 AS label FROM t JOIN n USING (g) WHERE n > 1 GROUP BY 1) SELECT id, coalesce(label, -1)::INTEGER AS label FROM t LEFT JOIN r USING (g)"


def said(spark: SparkSession, rows: list[tuple[str, bool]]) -> DataFrame:
    """What a randomised operator is held to: (floor, reached)."""
    return spark.createDataFrame([(a, bool(b)) for a, b in rows], "floor string, reached boolean")


def floors(*names: str) -> str:
    return " UNION ALL ".join(f"SELECT '{n}' AS floor, true AS reached" for n in names)


def agreement(labels: DataFrame, truth: DataFrame) -> float:
    """ARI of labels (id, label) with truth (id, g)."""
    return float(metrics.ari(metrics.contingency(labels.select("id", "label").join(truth.select("id", "g"), "id"), "label", "g")).first()["ari"])


# graphs


@query(_KNN + ", e AS (SELECT src, dst FROM k WHERE dist <= 2 UNION SELECT dst, src FROM k WHERE dist <= 2), r AS (WITH RECURSIVE w(id, c) AS (SELECT s_suppkey, s_suppkey FROM supplier UNION SELECT e.dst, w.c FROM w JOIN e ON e.src = w.id WHERE w.c < e.dst) SELECT id, min(c) AS component FROM w GROUP BY 1) SELECT id, component FROM r")
def graph_components(spark: SparkSession, d: str) -> DataFrame:
    e = pairs.knn(supplier_cells(spark, d), "s_suppkey", 5).where("dist <= 2")
    return community.components(read(spark, d, "supplier").select(F.col("s_suppkey").alias("id")), e)


@query(cliques("supplier", "s_suppkey"))
def segment_louvain(spark: SparkSession, d: str) -> DataFrame:
    """Communities of the exact neighbour graph of rows in cliques of eight: the cliques; rows alone are noise."""
    return community.graph_clusters(planted_cells(spark, d), "id", **community.parse_graph("louvain:k=7,resolution=1.0"))


@query(cliques("customer", "c_custkey"))
def segment_leiden(spark: SparkSession, d: str) -> DataFrame:
    """The same by Leiden, over banded neighbours."""
    return community.graph_clusters(planted_cells(spark, d, "customer", "c_custkey"), "id", banding=True, weight="exp", **community.parse_graph("leiden:k=7"))


@query(floors("louvain: modularity of at least 0.99 of the best known", "leiden: modularity of at least 0.99 of the best known", "leiden: communities are connected", "banding: recall of at least 0.9"))
def community_quality(spark: SparkSession, d: str) -> DataFrame:
    """Noisy cells in groups: communities against the groups, and banded neighbours with default settings against the exact ones."""
    c = read(spark, d, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_custkey") % 6).cast("int").alias("g"))
    noise = lambda l: F.pmod(F.xxhash64("id", F.lit(l)), F.lit(100))
    cells = materialise(c.select("id", "g", F.array(*[F.when(noise(l) < 15, noise(l) % 3).otherwise(F.pmod(F.xxhash64("g", F.lit(l)), F.lit(3))).cast("bigint") for l in range(48)]).alias("cells")))
    near = materialise(pairs.knn(cells, "id", 8))
    e = materialise(pairs.edge_similarity(pairs.symmetrise(near)))
    best = community.modularity(e, c.select("id", F.col("g").alias("label")))
    nodes, out = c.select("id"), []
    for name, find in (("louvain", community.louvain), ("leiden", community.leiden)):
        labels = materialise(find(nodes, e))
        out.append((f"{name}: modularity of at least 0.99 of the best known", community.modularity(e, labels) >= 0.99 * best))
    a, b = labels.select(F.col("id").alias("src"), F.col("label").alias("a")), labels.select(F.col("id").alias("dst"), F.col("label").alias("b"))
    parts = community.components(nodes, e.join(a, "src").join(b, "dst").where("a = b"))
    out.append(("leiden: communities are connected", parts.agg(F.count_distinct("component")).first()[0] == labels.agg(F.count_distinct("label")).first()[0]))
    kth = near.groupBy("src").agg(F.max("dist").alias("kth"))
    banded = pairs.lsh_knn(cells.select("id", "cells"), "id", 8, pairs.choose_band(cells, "id", 48, 8))
    out.append(("banding: recall of at least 0.9", banded.join(kth, "src").where("dist <= kth").count() >= 0.9 * near.count()))
    return said(spark, out)


# clusterers


@query(GROUPS)
def segment_kmeans(spark: SparkSession, d: str) -> DataFrame:
    s = segment.ForestSegmenter(n_iterations=24, n_clusters=3, weighting="entropy", cut="quantile")
    return community.renumber(s.fit(planted(spark, d).drop("g"), "id").labels_)


@query(f"WITH t AS (SELECT c_custkey AS id, (c_custkey % 3)::INTEGER AS g FROM customer WHERE c_custkey % 2 = 0), {RANKED} SELECT id, label::INTEGER AS label FROM t JOIN r USING (g)")
def segment_predict(spark: SparkSession, d: str) -> DataFrame:
    """Segments of rows with even ids by a model fitted on those with odd ids."""
    t = planted(spark, d).drop("g")
    return community.renumber(segment.ForestSegmenter(n_iterations=16, n_clusters=3, clusterer="agglomerative", cut="quantile").fit(t.where("id % 2 = 1"), "id").predict(t.where("id % 2 = 0"), "id"))


@query(" UNION ALL ".join(f"SELECT '{how}' AS how, g.* FROM ({GROUPS}) g" for how in ("contrastive", "correlation aware", "distances", "normalised", "onehot")))
def segmenter_settings(spark: SparkSession, d: str) -> DataFrame:
    """The façade's other ways: contrastive trees, correlation groups and weights, own clusterers on distances and features, rare and missing values."""
    t = materialise(planted(spark, d))
    x, out = t.drop("g"), None
    link = lambda p: segment.dbscan(x.select("id"), _both(p.where("dist <= 0.2")), 3)
    ways = {
        "contrastive": dict(contrastive=True, n_iterations=8, n_clusters=3, clusterer="agglomerative"), "correlation aware": dict(correlation_aware=True, correlation_threshold=0.9, n_iterations=16, n_clusters=3, cut="quantile"),
        "distances": dict(cluster_input="distance", clusterer=link, n_iterations=24), "normalised": dict(missing_indicators=True, rare_min_share=0.05, n_iterations=16, n_clusters=3, cut="quantile"),
        "onehot": dict(cluster_input="onehot", clusterer=_vectors_kmeans, n_iterations=16),
    }
    for how, settings in ways.items():
        one = community.renumber(segment.ForestSegmenter(**settings, kinds={"x": "numerical", "y": "numerical", "c": "categorical"}).fit(x, "id").labels_).select(F.lit(how).alias("how"), "id", "label")
        out = one if out is None else out.unionByName(one)
    return out


def _both(p: DataFrame) -> DataFrame:
    return p.select(F.col("i").alias("src"), F.col("j").alias("dst")).unionByName(p.select(F.col("j").alias("src"), F.col("i").alias("dst")))


def _vectors_kmeans(v: DataFrame) -> DataFrame:
    from pyspark.ml.clustering import KMeans

    return KMeans(k=3, seed=1, initSteps=5, predictionCol="label").fit(v).transform(v).select("id", "label")


@query("WITH t AS (SELECT s_suppkey AS id, s_suppkey % 4 AS g FROM supplier), r AS (SELECT g, row_number() OVER (ORDER BY min(id)) - 1 AS label FROM t GROUP BY 1) SELECT id, label::INTEGER AS label FROM t JOIN r USING (g)")
def agglomerative(spark: SparkSession, d: str) -> DataFrame:
    g, k = (F.col("s_suppkey") % 4).cast("bigint"), F.col("s_suppkey")
    return segment.agglomerate(read(spark, d, "supplier").select("s_suppkey", F.array(g, g, g, g, g, g, (k % 5).cast("bigint"), (k % 3).cast("bigint")).alias("cells")), "s_suppkey", 4)


@query(f"""WITH {SUPPLIER_SQL}, d AS (SELECT a.id AS src, b.id AS dst FROM cells a JOIN cells b ON a.l = b.l AND a.id <> b.id GROUP BY 1, 2 HAVING avg(CASE WHEN a.cell <> b.cell THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) <= 0.2),
c AS (SELECT src AS id FROM d GROUP BY 1 HAVING count(*) + 1 >= 4) SELECT s_suppkey AS id, s_suppkey IN (SELECT id FROM c) AS core, s_suppkey IN (SELECT id FROM c) OR s_suppkey IN (SELECT src FROM d WHERE dst IN (SELECT id FROM c)) AS clustered FROM supplier""")
def dbscan_roles(spark: SparkSession, d: str) -> DataFrame:
    cells = materialise(supplier_cells(spark, d))
    near = materialise(segment.hamming_within(cells, "s_suppkey", 0.2))
    labels = segment.dbscan(cells.select(F.col("s_suppkey").alias("id")), near, 4)
    core = near.groupBy(F.col("src").alias("id")).agg((F.count("*") + 1 >= 4).alias("core"))
    return labels.join(core, "id", "left").select("id", F.coalesce("core", F.lit(False)).alias("core"), (F.col("label") >= 0).alias("clustered"))


@query(GROUPS)
def birch(spark: SparkSession, d: str) -> DataFrame:
    return community.renumber(segment.birch(planted(spark, d), ["x", "y"], 8.0, 3))


def _customer_features(spark: SparkSession, d: str) -> tuple[DataFrame, list[str]]:
    c = read(spark, d, "customer")
    p = Preprocessor(["c_nationkey"], ["c_mktsegment"]).fit(c)
    names = [f"x{i}" for i in range(len(p.names()))]
    return materialise(p.transform(c, ["c_custkey"]).toDF("id", *names)), names


_TREE = """WITH z AS (SELECT c_custkey AS id, (c_nationkey - avg(c_nationkey) OVER ()) / stddev_pop(c_nationkey) OVER () AS x0, c_nationkey AS raw, c_mktsegment AS seg FROM customer),
lv AS (SELECT seg, row_number() OVER (ORDER BY seg) AS i FROM (SELECT DISTINCT seg FROM z)),
tot AS (SELECT count(*)::DOUBLE AS n, sum(x0) AS s, sum(x0 * x0) AS q FROM z),
segs AS (SELECT seg, count(*)::DOUBLE AS n FROM z GROUP BY 1),
sq AS (SELECT sum(n * n) AS s2 FROM segs), base AS (SELECT tot.q - tot.s * tot.s / tot.n + tot.n - sq.s2 / tot.n AS sse FROM tot CROSS JOIN sq),
th AS (SELECT 0 AS f, (a + b) / 2 AS t, NULL AS seg FROM (SELECT x0 AS a, lead(x0) OVER (ORDER BY x0) AS b FROM (SELECT DISTINCT x0 FROM z)) WHERE b IS NOT NULL UNION ALL SELECT lv.i, 0.5, seg FROM lv),
side AS (SELECT th.f, th.t, CASE WHEN th.f = 0 THEN z.x0 <= th.t ELSE z.seg <> th.seg END AS lft, z.x0, z.seg AS s FROM z CROSS JOIN th),
m AS (SELECT f, t, lft, count(*)::DOUBLE AS n, sum(x0 * x0) - sum(x0) * sum(x0) / count(*) AS e FROM side GROUP BY 1, 2, 3),
g AS (SELECT f, t, lft, sum(n) - sum(n * n) / sum(n) AS e FROM (SELECT f, t, lft, s, count(*)::DOUBLE AS n FROM side GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3)
SELECT m.f::INTEGER AS f, round(m.t, 6) AS threshold, round(max(base.sse) - sum(m.e + g.e), 4) AS gain, sum(CASE WHEN m.lft THEN m.n ELSE 0 END)::BIGINT AS n_left FROM m JOIN g ON m.f = g.f AND m.t = g.t AND m.lft = g.lft CROSS JOIN base GROUP BY 1, 2 ORDER BY gain DESC, f, threshold LIMIT 1"""


@query(_TREE)
def tree_best_split(spark: SparkSession, d: str) -> DataFrame:
    x, names = _customer_features(spark, d)
    gain, feature, threshold, left, _ = ruletree.best_split(x, names)
    return spark.createDataFrame([(names.index(feature), round(threshold, 6), round(gain, 4), left[0])], "f int, threshold double, gain double, n_left bigint")


_FIVE = "t AS (SELECT c_custkey AS id, c_nationkey % 5 AS g, c_nationkey + (c_nationkey % 5) * (c_nationkey % 5) * 40 AS x, c_nationkey // 5 AS y FROM customer)"


def _five(spark: SparkSession, d: str) -> DataFrame:
    """Five groups along x, at ever larger distances."""
    n = F.col("c_nationkey")
    return materialise(read(spark, d, "customer").select(F.col("c_custkey").alias("id"), (n + (n % 5) * (n % 5) * 40).cast("double").alias("x"), F.floor(n / 5).cast("double").alias("y")))


@query(f"WITH {_FIVE} SELECT id, (dense_rank() OVER (ORDER BY g) - 1)::INTEGER AS label FROM t")
def tree_labels(spark: SparkSession, d: str) -> DataFrame:
    x = _five(spark, d)
    return x.select("id", ruletree.fit_tree(x, ["x", "y"], 5, 2).label().alias("label"))


@query(f"""WITH {_FIVE}, e AS (SELECT g, count(*) AS n, min(x) AS lo, max(x) AS hi FROM t GROUP BY 1), c AS (SELECT g, n, (lag(hi) OVER (ORDER BY g) + lo) / 2.0 AS a, (hi + lead(lo) OVER (ORDER BY g)) / 2.0 AS b FROM e)
SELECT (row_number() OVER (ORDER BY g) - 1)::INTEGER AS label, n, round(coalesce(a, -1), 4)::DOUBLE AS low, round(coalesce(b, -1), 4)::DOUBLE AS high FROM c""")
def tree_rules(spark: SparkSession, d: str) -> DataFrame:
    """Rows of every leaf, and the ends of x that its rule states (-1: open)."""
    import re

    out = []
    for label, n, rule in ruletree.fit_tree(_five(spark, d), ["x", "y"], 5, 2).rules():
        low, high = (float(m[-1]) if (m := re.findall(rf"x {op} (\S+)", rule)) else -1.0 for op in (">", "<="))
        out.append((label, n, low, high))
    return spark.createDataFrame(out, "label int, n bigint, low double, high double")


@query(floors("random: one leaf per tree and row", "random: clusters agree with the groups", "random: proximity within above between", "extra: one leaf per tree and row", "extra: clusters agree with the groups", "extra: proximity within above between"))
def forest_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Leaves of forests of real against synthetic rows, and their clusters, against known groups."""
    t, out = materialise(planted(spark, d)), []
    for name in ("random", "extra"):
        f = forests.ForestClusters(name, 3, "kmeans", trees=20, depth=10, min_leaf=2).fit(t.drop("g"), "id")
        out.append((f"{name}: one leaf per tree and row", f.leaves_.where(F.size("cells") == 20).count() == t.count()))
        out.append((f"{name}: clusters agree with the groups", agreement(f.labels_, t) > 0.9))
        m = {r["own"] == r["cluster"]: r["similarity"] for r in pairs.block_means(f.leaves_, t.select("id", F.col("g").alias("label")), "id").orderBy(F.desc("similarity")).collect()}
        out.append((f"{name}: proximity within above between", m[True] > m[False] + 0.2))
    return said(spark, out)


@query(GROUPS)
def forest_graph(spark: SparkSession, d: str) -> DataFrame:
    """The groups again, by linkage of the proximity of extremely randomised trees against a uniform box."""
    return community.renumber(forests.ForestClusters("extra", 3, "agglomerative", trees=12, depth=5, kind="uniform_box").fit(planted(spark, d).drop("g"), "id").labels_)


@query(floors("one leaf per tree and row", "similarity within above between", "trees split the groups"))
def contrastive_embed(spark: SparkSession, d: str) -> DataFrame:
    t = materialise(planted(spark, d))
    cells = materialise(contrast.contrastive_embed(t, "id", ["x", "y"], 6))
    labels = t.select("id", F.col("g").alias("label"))
    m = {(r["own"] == r["cluster"]): r["s"] for r in pairs.block_means(cells, labels, "id").groupBy("own", "cluster").agg(F.min("similarity").alias("s")).orderBy(F.desc("s")).collect()}
    return said(spark, [("one leaf per tree and row", cells.where(F.size("cells") == 6).count() == t.count()), ("similarity within above between", m[True] > m[False] + 0.2), ("trees split the groups", cells.agg(F.count_distinct("cells")).first()[0] >= 3)])


@query(GROUPS)
def auto_search(spark: SparkSession, d: str) -> DataFrame:
    """The labels of the best of several algorithms and numbers of clusters: the three groups."""
    return community.renumber(search.Search(["kmeans", "binary_tree"], range(2, 5), restarts=1).fit(planted(spark, d), ["x", "y"]).labels_)


@query("SELECT (row_number() OVER (ORDER BY a, k))::INTEGER AS line, a AS algorithm, k::INTEGER AS k FROM (VALUES ('binary_tree'), ('forest')) v(a) CROSS JOIN (VALUES (2), (3)) w(k)")
def search_table(spark: SparkSession, d: str) -> DataFrame:
    """Every combination that a search with one forest's cells as its space has tried."""
    got = search.Search({"forest": (search._built_in("forest"), {"n_iterations": [16], "cut": ["quantile"]}), "binary_tree": (search._built_in("binary_tree"), {})}, range(2, 4), restarts=1, space="cells").fit(planted(spark, d), ["x", "y", "c"])
    return spark.createDataFrame([(i + 1, a, k) for i, (a, k) in enumerate(sorted((r["algorithm"], r["k"]) for r in got.results))], "line int, algorithm string, k int")


# compression

_DEPTH = 3
_SIG = "(SELECT id, string_agg(cell::VARCHAR, ',' ORDER BY l) AS sig FROM cells WHERE l < 3 GROUP BY 1)"
_BUCKETS = f"WITH {PART_SQL}, b AS {_SIG}, f AS (SELECT id, sig, min(id) OVER (PARTITION BY sig) AS proto, count(*) OVER (PARTITION BY sig) AS n FROM b)"


@query(_BUCKETS + " SELECT proto, count(*) AS weight FROM f GROUP BY 1")
def prototype_buckets(spark: SparkSession, d: str) -> DataFrame:
    return compress.compress(part_cells(spark, d), "p_partkey", _DEPTH, representative="first")[0].select("proto", "weight")


_MEDOID = ", j AS (SELECT f.proto, f.n, c.id, c.l, c.cell FROM f JOIN cells c ON c.id = f.id), h AS (SELECT proto, l, cell, count(*) AS k FROM j GROUP BY 1, 2, 3), s AS (SELECT j.proto, j.id, sum(h.k) AS alike FROM j JOIN h ON j.proto = h.proto AND j.l = h.l AND j.cell = h.cell GROUP BY 1, 2), q AS (SELECT proto, id FROM (SELECT proto, id, row_number() OVER (PARTITION BY proto ORDER BY alike DESC, id) AS r FROM s) WHERE r = 1)"


@query(_BUCKETS + _MEDOID + " SELECT proto, id FROM q")
def hamming_medoid(spark: SparkSession, d: str) -> DataFrame:
    return compress.compress(part_cells(spark, d), "p_partkey", _DEPTH)[0].select("proto", "id")


@query(_BUCKETS + _MEDOID + """, a AS (SELECT c.id, c.l, c.cell FROM cells c WHERE c.id % 1 = 0), x AS (SELECT a.id, q.proto, sum(CASE WHEN a.cell <> p.cell THEN 1 ELSE 0 END)::INTEGER AS dist FROM a CROSS JOIN q JOIN cells p ON p.id = q.id AND p.l = a.l GROUP BY 1, 2)
SELECT id, proto, dist FROM (SELECT id, proto, dist, row_number() OVER (PARTITION BY id ORDER BY dist, proto) AS r FROM x) WHERE r = 1""".replace(" WHERE c.id % 1 = 0", ""))
def prototype_assign(spark: SparkSession, d: str) -> DataFrame:
    cells = materialise(part_cells(spark, d))
    return compress.assign(cells, "p_partkey", compress.compress(cells, "p_partkey", _DEPTH)[0])


@query(_BUCKETS + _MEDOID + """, e AS (SELECT f.id, sum(CASE WHEN c.cell <> p.cell THEN 1 ELSE 0 END)::DOUBLE / count(*) AS e FROM f JOIN q ON q.proto = f.proto JOIN cells c ON c.id = f.id JOIN cells p ON p.id = q.id AND p.l = c.l GROUP BY 1), w AS (SELECT proto, count(*) AS w FROM f GROUP BY 1)
SELECT (SELECT sum(w)::BIGINT FROM w) AS n_samples, (SELECT count(*) FROM w) AS n_prototypes, (SELECT min(w) FROM w) AS min_weight, (SELECT max(w) FROM w) AS max_weight, round(avg(e), 6) AS error_mean, round(max(e), 6) AS error_max FROM e""")
def compression_report(spark: SparkSession, d: str) -> DataFrame:
    cells = materialise(part_cells(spark, d))
    r = compress.report(*compress.compress(cells, "p_partkey", _DEPTH), cells, "p_partkey")
    return r.select("n_samples", "n_prototypes", "min_weight", "max_weight", F.round("reconstruction_error_mean", 6).alias("error_mean"), F.round("reconstruction_error_max", 6).alias("error_max"))


@query("WITH t AS (SELECT p_partkey AS id, (p_partkey % 3)::INTEGER AS g FROM part), r AS (SELECT g, row_number() OVER (ORDER BY count(*) DESC, min(id)) - 1 AS label FROM t GROUP BY 1) SELECT id, label::INTEGER AS label FROM t JOIN r USING (g)")
def cluster_prototypes(spark: SparkSession, d: str) -> DataFrame:
    """Labels of all rows from clustering weighted prototypes."""
    import numpy as np

    g, k = (F.col("p_partkey") % 3).cast("bigint"), F.col("p_partkey")
    cells = materialise(read(spark, d, "part").select("p_partkey", F.array(g, (k % 5).cast("bigint"), g, g, g, g, (k % 7).cast("bigint"), g).alias("cells")))
    return community.renumber(compress.cluster_compressed(cells, "p_partkey", 3, lambda p: segment.kmeans_cells(p, "proto", 3, np.ones(8), weight_col="weight")[0])[0])


def _farthest(k: int) -> str:
    gap = lambda a: " + ".join(f"(p.x{i} - {a}.x{i}) ** 2" for i in range(len(_P)))
    parts = [_POINTS, "c0 AS (SELECT * FROM p ORDER BY id LIMIT 1)"]
    for i in range(1, k):
        least = f"least({', '.join(gap(f'c{j}') for j in range(i))})" if i > 1 else gap("c0")
        parts.append(f"c{i} AS (SELECT p.* FROM p, {', '.join(f'c{j}' for j in range(i))} ORDER BY {least} DESC, p.id LIMIT 1)")
    return "WITH " + ", ".join(parts) + " " + " UNION ALL ".join(f"SELECT {i}::INTEGER AS i, id FROM c{i}" for i in range(k))


@query(_farthest(6))
def farthest_points(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame(list(enumerate(compress.farthest_first(_points(spark, d), _P, 6))), "i int, id bigint")


# explanation and diagnostics


@query("WITH g AS (SELECT avg(c_acctbal) AS a, stddev_samp(c_acctbal) AS sa, avg(c_nationkey) AS n, stddev_samp(c_nationkey) AS sn FROM customer), p AS (SELECT c_mktsegment AS label, avg(c_acctbal) AS a, avg(c_nationkey) AS n FROM customer GROUP BY 1) SELECT label, 'c_acctbal' AS feature, round(p.a, 4) AS mean, round(p.a - g.a, 4) AS difference, round((p.a - g.a) / sa, 6) AS effect FROM p CROSS JOIN g UNION ALL SELECT label, 'c_nationkey', round(p.n, 4), round(p.n - g.n, 4), round((p.n - g.n) / sn, 6) FROM p CROSS JOIN g")
def cluster_profile(spark: SparkSession, d: str) -> DataFrame:
    p = explain.numeric_profile(read(spark, d, "customer"), "c_mktsegment", ["c_acctbal", "c_nationkey"])
    return p.select("label", "feature", F.round("mean", 4).alias("mean"), F.round("difference", 4).alias("difference"), F.round("effect", 6).alias("effect"))


@query("WITH n AS (SELECT o_orderstatus AS label, o_orderpriority AS value, count(*) AS n FROM orders GROUP BY 1, 2), s AS (SELECT label, value, n, n::DOUBLE / sum(n) OVER (PARTITION BY label) AS share, sum(n) OVER (PARTITION BY value)::DOUBLE / sum(n) OVER () AS whole, row_number() OVER (PARTITION BY label ORDER BY n DESC, value) AS r FROM n) SELECT label, value, n, round(share, 6) AS share, round(share / whole, 6) AS lift, r::INTEGER AS rank FROM s WHERE r <= 3")
def category_lift(spark: SparkSession, d: str) -> DataFrame:
    p = explain.category_profile(read(spark, d, "orders"), "o_orderstatus", ["o_orderpriority"])
    return p.select("label", "value", "n", F.round("share", 6).alias("share"), F.round("lift", 6).alias("lift"), "rank")


@query("""WITH g AS (SELECT avg(c_acctbal) AS a, stddev_samp(c_acctbal) AS sa, avg(c_nationkey) AS n, stddev_samp(c_nationkey) AS sn, count(*) AS k FROM customer), p AS (SELECT c_mktsegment AS label, count(*) AS size, avg(c_acctbal) AS a, avg(c_nationkey) AS n FROM customer GROUP BY 1),
f AS (SELECT label, 'c_acctbal' AS f, p.a AS m, g.a AS w, (p.a - g.a) / sa AS e FROM p CROSS JOIN g UNION ALL SELECT label, 'c_nationkey', p.n, g.n, (p.n - g.n) / sn FROM p CROSS JOIN g),
s AS (SELECT label, string_agg(printf('%s %s (%.2f against %.2f)', CASE WHEN e >= 0 THEN 'high' ELSE 'low' END, f, m, w), '; ' ORDER BY abs(e) DESC, f) AS t FROM f GROUP BY 1)
SELECT p.label, size, printf('%d rows (%.1f %%)', size, size * 100.0::DOUBLE / k) || '; ' || t AS text FROM p JOIN s ON p.label = s.label CROSS JOIN g""")
def cluster_cards(spark: SparkSession, d: str) -> DataFrame:
    return explain.cards(read(spark, d, "customer"), "c_mktsegment", ["c_acctbal", "c_nationkey"], [])


@query(_SIM + ", o AS (SELECT id, own, max(CASE WHEN own = cluster THEN similarity END) AS a, max(CASE WHEN own <> cluster THEN similarity END) AS b FROM m GROUP BY 1, 2) SELECT id, own AS label, round(a, 6) AS own_affinity, round(b, 6) AS second_affinity, round(a - b, 6) + 0.0 AS margin FROM o")
def cluster_affinity(spark: SparkSession, d: str) -> DataFrame:
    a = report.affinities(customer_cells(spark, d), customer_labels(spark, d), "c_custkey")
    return a.select("id", "label", F.round("own_affinity", 6).alias("own_affinity"), F.round("second_affinity", 6).alias("second_affinity"), (F.round("margin", 6) + 0.0).alias("margin"))


@query(_SIM + """, o AS (SELECT id, own, max(CASE WHEN own = cluster THEN similarity END) AS a, max(CASE WHEN own <> cluster THEN similarity END) AS b, max(CASE WHEN own = cluster THEN 1 - (similarity * size - 1) / (size - 1) END) AS i, min(CASE WHEN own <> cluster THEN 1 - similarity END) AS x FROM m GROUP BY 1, 2)
SELECT id, own AS label, round(s, 6) + 0.0 AS silhouette, round(g, 6) + 0.0 AS margin FROM (SELECT id, own, (x - i) / greatest(i, x) AS s, a - b AS g FROM o) ORDER BY round(s, 9), round(g, 9), id LIMIT 20""")
def uncertain_samples(spark: SparkSession, d: str) -> DataFrame:
    u = report.uncertain(customer_cells(spark, d), customer_labels(spark, d), "c_custkey", 20)
    return u.select("id", "label", (F.round("silhouette", 6) + 0.0).alias("silhouette"), (F.round("margin", 6) + 0.0).alias("margin"))


@query(_SIM + """, o AS (SELECT id, own, max(CASE WHEN own = cluster THEN 1 - (similarity * size - 1) / (size - 1) END) AS i, min(CASE WHEN own <> cluster THEN 1 - similarity END) AS x, max(CASE WHEN own = cluster THEN size END) AS size FROM m GROUP BY 1, 2), q AS (SELECT count(*) AS n, count(DISTINCT own) AS k, min(size) AS least, max(size)::DOUBLE / count(*) AS share, avg(CASE WHEN (x - i) / greatest(i, x) < -1e-12 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS neg FROM o),
w AS (SELECT avg(CASE WHEN own = cluster THEN (similarity * size - 1) / (size - 1) END) AS a, avg(CASE WHEN own <> cluster THEN similarity END) AS b FROM m)
SELECT 'clusters' AS "check", CASE WHEN k < 2 THEN 'error' ELSE 'ok' END AS status, printf('%d clusters', k) AS message FROM q UNION ALL SELECT 'dominant cluster', CASE WHEN share >= 0.8 THEN 'warning' ELSE 'ok' END, printf('largest share %.3f', share) FROM q
UNION ALL SELECT 'small cluster', CASE WHEN least < 5 THEN 'warning' ELSE 'ok' END, printf('smallest cluster %d rows', least) FROM q UNION ALL SELECT 'misplaced rows', CASE WHEN neg >= 0.2 THEN 'warning' ELSE 'ok' END, printf('%.3f of the rows with negative silhouette', neg) FROM q
UNION ALL SELECT 'separation', CASE WHEN a / b < 1.2 THEN 'warning' ELSE 'ok' END, printf('within/between similarity %.3f', a / b) FROM w""")
def health_checks(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame(report.health_checks(report.summary(customer_cells(spark, d), customer_labels(spark, d), "c_custkey")), "check string, status string, message string")


@query("WITH x AS (SELECT c_mktsegment AS a, CASE WHEN c_acctbal < 0 THEN 'BUILDING' WHEN c_nationkey < 12 THEN 'MACHINERY' ELSE 'FURNITURE' END AS b FROM customer), t AS (SELECT a AS c, count(*)::DOUBLE AS n, sum(CASE WHEN a = b THEN 1 ELSE 0 END)::DOUBLE AS hit FROM x GROUP BY 1), s AS (SELECT b AS c, count(*)::DOUBLE AS m FROM x GROUP BY 1), j AS (SELECT coalesce(t.c, s.c) AS c, coalesce(n, 0) AS n, coalesce(hit, 0) AS hit, coalesce(m, 0) AS m FROM t FULL JOIN s ON t.c = s.c) SELECT sum(n)::BIGINT AS n, round(sum(hit) / sum(n), 6) AS accuracy, round(avg(CASE WHEN n > 0 THEN hit / n END), 6) AS balanced_accuracy, round(avg(2 * hit / (n + m)), 6) AS macro_f1 FROM j")
def fidelity_metrics(spark: SparkSession, d: str) -> DataFrame:
    c = read(spark, d, "customer").select(F.col("c_mktsegment").alias("a"), F.when(F.col("c_acctbal") < 0, "BUILDING").when(F.col("c_nationkey") < 12, "MACHINERY").otherwise("FURNITURE").alias("b"))
    f = metrics.fidelity(c, "a", "b")
    return f.select("n", *[F.round(x, 6).alias(x) for x in ("accuracy", "balanced_accuracy", "macro_f1")])


def _labelled(spark: SparkSession, d: str) -> DataFrame:
    c = read(spark, d, "customer")
    return materialise(c.withColumn("label", F.when(F.col("c_acctbal") < 2000, 0).when(F.col("c_nationkey") < 12, 1).otherwise(2)))


@query(floors("accuracy of at least 0.95", "balanced accuracy of at least 0.9", "calibrated: accuracy of at least 0.95", "what is uncertain is rejected"))
def label_classifier(spark: SparkSession, d: str) -> DataFrame:
    x, of = _labelled(spark, d), (["c_acctbal", "c_nationkey"], ["c_mktsegment"])
    f = explain.LabelClassifier(*of, trees=10, depth=6).cross_validate(x, "c_custkey", "label").first()
    c = explain.LabelClassifier(*of, trees=10, depth=6, calibrate=True).fit(x, "label").predict(x, "c_custkey")
    c = metrics.fidelity(c.join(x.select(F.col("c_custkey").alias("id"), F.col("label").alias("truth")), "id"), "truth", "label").first()
    none = explain.LabelClassifier(*of, trees=3, depth=2, reject_below=1.01).fit(x, "label").predict(x, "c_custkey")
    return said(spark, [("accuracy of at least 0.95", f["accuracy"] >= 0.95), ("balanced accuracy of at least 0.9", f["balanced_accuracy"] >= 0.9), ("calibrated: accuracy of at least 0.95", c["accuracy"] >= 0.95), ("what is uncertain is rejected", none.where("label <> -1").isEmpty())])


@query("SELECT count(*) AS n, 3::BIGINT AS labels, true AS faithful, true AS pure FROM customer")
def surrogate_rules(spark: SparkSession, d: str) -> DataFrame:
    """Rows and labels that the rules of the shallow tree cover, whether it agrees with at least 95 % of them, and whether its leaves are pure."""
    t = explain.SurrogateTree(["c_acctbal", "c_nationkey"], ["c_mktsegment"]).fit(_labelled(spark, d), "label")
    rules = t.rules()
    return spark.createDataFrame([(sum(r[2] for r in rules), len({r[0] for r in rules}), t.fidelity_.first()["accuracy"] >= 0.95, sum(r[1] * r[2] for r in rules) >= 0.95 * sum(r[2] for r in rules))], "n bigint, labels bigint, faithful boolean, pure boolean")


_DRAWN = lambda r: f"(('0x' || substr(md5(concat(c_custkey, ':stability:{r}')), 1, 8))::BIGINT + 0.5) / 4294967296.0 < 0.8"


@query(f"SELECT 0 AS run_a, 1 AS run_b, count(*) AS n, 1.0::DOUBLE AS ari, 1.0::DOUBLE AS nmi FROM customer WHERE {_DRAWN(0)} AND {_DRAWN(1)}")
def stability_runs(spark: SparkSession, d: str) -> DataFrame:
    """Two runs of k-means on four fifths of the rows each agree on the rows they share."""
    got = report.stability(planted(spark, d), "id", lambda p, seed: segment.kmeans_points(p, ["x", "y"], 3, seed)[0], runs=2)
    return got.select("run_a", "run_b", "n", F.round("ari", 6).alias("ari"), F.round("nmi", 6).alias("nmi"))


_BY = lambda label: _SIM.replace("c_mktsegment AS label", f"{label} AS label").replace("WITH ", "", 1)
_SCORE = "SELECT avg(CASE WHEN greatest(i, x) = 0 THEN 0 ELSE (x - i) / greatest(i, x) END) AS s, count(DISTINCT own) AS k FROM (SELECT id, own, max(CASE WHEN own = cluster THEN 1 - (similarity * size - 1) / (size - 1) END) AS i, min(CASE WHEN own <> cluster THEN 1 - similarity END) AS x FROM m GROUP BY 1, 2)"


@query(f"WITH a AS (WITH {_BY('c_mktsegment')} {_SCORE}), b AS (WITH {_BY('c_nationkey % 4')} {_SCORE}), u AS (SELECT 'segment' AS name, k::INTEGER AS n_clusters, s FROM a UNION ALL SELECT 'nation', k::INTEGER, s FROM b) SELECT name, n_clusters, round(s, 6) AS silhouette, (row_number() OVER (ORDER BY s DESC, name))::INTEGER AS rank FROM u")
def compare_clusterings(spark: SparkSession, d: str) -> DataFrame:
    cells, c = materialise(customer_cells(spark, d)), read(spark, d, "customer")
    labels = {"segment": c.select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("label")), "nation": c.select(F.col("c_custkey").alias("id"), (F.col("c_nationkey") % 4).alias("label"))}
    return report.compare(labels, cells, "c_custkey")[0].withColumn("silhouette", F.round("silhouette", 6))


@query("WITH x AS (SELECT c_mktsegment AS a, c_nationkey % 4 AS b FROM customer), t AS (SELECT a, b, count(*)::DOUBLE AS n FROM x GROUP BY 1, 2), c AS (SELECT sum(n * (n - 1) / 2) AS c, sum(n) AS t FROM t), r AS (SELECT sum(n * (n - 1) / 2) AS r FROM (SELECT a, sum(n) AS n FROM t GROUP BY 1)), s AS (SELECT sum(n * (n - 1) / 2) AS s FROM (SELECT b, sum(n) AS n FROM t GROUP BY 1)) SELECT 'segment' AS a, 'nation' AS b, round((c - r * s / (t * (t - 1) / 2)) / ((r + s) / 2 - r * s / (t * (t - 1) / 2)), 6) AS ari FROM c, r, s")
def clustering_agreement(spark: SparkSession, d: str) -> DataFrame:
    cells, c = materialise(customer_cells(spark, d)), read(spark, d, "customer")
    labels = {"segment": c.select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("label")), "nation": c.select(F.col("c_custkey").alias("id"), (F.col("c_nationkey") % 4).alias("label"))}
    return report.compare(labels, cells, "c_custkey")[1].withColumn("ari", F.round("ari", 6))


@query(f"WITH {PLANTED}, m AS (SELECT var_samp(x) AS a, var_samp(y) AS b, covar_samp(x, y) AS c FROM t) SELECT round((a + b) / 2 + sqrt((a - b) ** 2 / 4 + c * c), 4) AS first, round((a + b) / 2 - sqrt((a - b) ** 2 / 4 + c * c), 4) AS second FROM m")
def principal_plane(spark: SparkSession, d: str) -> DataFrame:
    """Variances along the two principal directions."""
    p = report.plane(planted(spark, d), ["x", "y"])
    return p.agg(F.round(F.var_samp("x"), 4).alias("first"), F.round(F.var_samp("y"), 4).alias("second"))


@query(floors("directions are orthogonal", "the first holds more", "groups part"))
def sparse_plane(spark: SparkSession, d: str) -> DataFrame:
    """Two singular directions of one-hot cells."""
    t = materialise(planted(spark, d).withColumn("cells", F.array(F.col("g").cast("bigint"), F.col("g").cast("bigint"), (F.col("id") % 2).cast("bigint"))))
    p = materialise(report.sparse_plane(t, "id", steps=25).join(t.select("id", "g"), "id"))
    r = p.agg(F.sum(F.col("x") * F.col("x")).alias("a"), F.sum(F.col("x") * F.col("y")).alias("c"), F.sum(F.col("y") * F.col("y")).alias("b")).first()
    spread = metrics.separation(p.select("id", F.col("g").alias("label"), "x", "y"), ["x", "y"]).first()
    return said(spark, [("directions are orthogonal", abs(r["c"]) < 1e-3 * r["a"]), ("the first holds more", r["a"] >= r["b"] > 0), ("groups part", spread["sse"] < 0.9 * (r["a"] + r["b"]))])


# significance and preflight

_H = "('0x' || substr(md5({}), 1, 8))::BIGINT"
_U01 = "((" + _H + " + 0.5) / 4294967296.0)"


@query(f"""WITH x AS (SELECT c_custkey AS id, c_mktsegment AS a, c_nationkey AS b FROM customer), s AS (SELECT b, sum(n) OVER (ORDER BY b) - n AS f, sum(n) OVER (ORDER BY b) AS t FROM (SELECT b, count(*) AS n FROM x GROUP BY 1)),
r AS (SELECT unnest(range(1, 21)) AS round), p AS (SELECT round, a, row_number() OVER (PARTITION BY round ORDER BY {_H.format("concat(id, ':', round, ':perm:0')")}, id) - 1 AS pos FROM x CROSS JOIN r),
d AS (SELECT round, a, b FROM p JOIN s ON pos >= f AND pos < t UNION ALL SELECT 0, a, b FROM x), n AS (SELECT round, a, b, count(*)::DOUBLE AS n FROM d GROUP BY 1, 2, 3),
c AS (SELECT round, sum(n * (n - 1) / 2) AS c, sum(n) AS t FROM n GROUP BY 1), u AS (SELECT round, sum(n * (n - 1) / 2) AS r FROM (SELECT round, a, sum(n) AS n FROM n GROUP BY 1, 2) GROUP BY 1), v AS (SELECT round, sum(n * (n - 1) / 2) AS s FROM (SELECT round, b, sum(n) AS n FROM n GROUP BY 1, 2) GROUP BY 1)
SELECT c.round::INTEGER AS round, round((c - r * s / (t * (t - 1) / 2)) / ((r + s) / 2 - r * s / (t * (t - 1) / 2)), 6) + 0.0 AS ari FROM c JOIN u ON c.round = u.round JOIN v ON c.round = v.round""")
def permutation_aris(spark: SparkSession, d: str) -> DataFrame:
    return infer.permuted_ari(read(spark, d, "customer"), "c_custkey", "c_mktsegment", "c_nationkey", 20).select("round", (F.round("ari", 6) + 0.0).alias("ari"))


_TESTED = "x AS (SELECT c_custkey AS id, CASE WHEN c_acctbal < 2000 THEN 0 WHEN c_nationkey < 12 THEN 1 ELSE 2 END AS a, CASE WHEN c_acctbal < 3000 THEN 0 ELSE 1 END AS b, c_mktsegment AS c FROM customer)"


def _aris(name: str, n: str) -> str:
    """SQL: name(round, ari) of the contingency table n(round, a, b, n)."""
    return f"""{name}_c AS (SELECT round, sum(n * (n - 1) / 2) AS c, sum(n) AS t FROM {n} GROUP BY 1), {name}_u AS (SELECT round, sum(n * (n - 1) / 2) AS r FROM (SELECT round, a, sum(n) AS n FROM {n} GROUP BY 1, 2) GROUP BY 1), {name}_v AS (SELECT round, sum(n * (n - 1) / 2) AS s FROM (SELECT round, b, sum(n) AS n FROM {n} GROUP BY 1, 2) GROUP BY 1),
{name} AS (SELECT {name}_c.round, (c - r * s / (t * (t - 1) / 2)) / ((r + s) / 2 - r * s / (t * (t - 1) / 2)) AS ari FROM {name}_c JOIN {name}_u USING (round) JOIN {name}_v USING (round))"""


def _poisson(key: str) -> str:
    """SQL of the Poisson(1) count of a key."""
    out, at, total = [], 0.36787944117144233, 0.0
    for k in range(8):
        total += at
        out.append(f"({_U01.format(key)} >= {total!r})::INTEGER")
        at /= k + 1
    return "(" + " + ".join(out) + ")"


@query(f"""WITH {_TESTED}, r AS (SELECT unnest(range(1, 21)) AS round), s AS (SELECT b, sum(n) OVER (ORDER BY b) - n AS f, sum(n) OVER (ORDER BY b) AS t FROM (SELECT b, count(*) AS n FROM x GROUP BY 1)),
p AS (SELECT round, a, row_number() OVER (PARTITION BY round ORDER BY {_H.format("concat(id, ':', round, ':perm:0')")}, id) - 1 AS pos FROM x CROSS JOIN r), pn AS (SELECT round, a, b, count(*)::DOUBLE AS n FROM (SELECT round, a, b FROM p JOIN s ON pos >= f AND pos < t UNION ALL SELECT 0, a, b FROM x) GROUP BY 1, 2, 3), {_aris("pa", "pn")},
bn AS (SELECT round, a, b, sum(k)::DOUBLE AS n FROM (SELECT round, a, b, {_poisson("concat(id, ':', round, ':boot:0')")} AS k FROM x CROSS JOIN r) GROUP BY 1, 2, 3 HAVING sum(k) > 0), {_aris("ba", "bn")},
w AS (SELECT round, a, CASE WHEN round > 0 AND {_H.format("concat(id, ':', round, ':swap:0')")} % 2 = 0 THEN c ELSE b::VARCHAR END AS l, CASE WHEN round > 0 AND {_H.format("concat(id, ':', round, ':swap:0')")} % 2 = 0 THEN b::VARCHAR ELSE c END AS m FROM x CROSS JOIN (SELECT unnest(range(0, 21)) AS round)),
wl AS (SELECT round, a, l AS b, count(*)::DOUBLE AS n FROM w GROUP BY 1, 2, 3), wm AS (SELECT round, a, m AS b, count(*)::DOUBLE AS n FROM w GROUP BY 1, 2, 3), {_aris("la", "wl")}, {_aris("ma", "wm")}, d AS (SELECT la.round, la.ari - ma.ari AS d FROM la JOIN ma USING (round))
SELECT 'permutation' AS test, round(max(CASE WHEN round = 0 THEN ari END), 6) AS value, round((1 + sum(CASE WHEN round > 0 AND ari >= (SELECT ari FROM pa WHERE round = 0) - 1e-12 THEN 1 ELSE 0 END)) / 21.0::DOUBLE, 6) AS p_value FROM pa
UNION ALL SELECT 'bootstrap low', round(quantile_cont(ari, 0.025), 6), NULL FROM ba UNION ALL SELECT 'bootstrap high', round(quantile_cont(ari, 0.975), 6), NULL FROM ba
UNION ALL SELECT 'paired', round(max(CASE WHEN round = 0 THEN d END), 6), round((1 + sum(CASE WHEN round > 0 AND abs(d) >= abs((SELECT d FROM d WHERE round = 0)) - 1e-12 THEN 1 ELSE 0 END)) / 21.0::DOUBLE, 6) FROM d""")
def significance_tests(spark: SparkSession, d: str) -> DataFrame:
    c = _labelled(spark, d).withColumn("other", F.when(F.col("c_acctbal") < 3000, 0).otherwise(1))
    p = infer.permutation_test(c, "c_custkey", "label", "other", 20)
    b = infer.bootstrap_ari(c, "c_custkey", "label", "other", 20)
    t = infer.paired_test(c, "c_custkey", "label", "other", "c_mktsegment", 20)
    rows = [("permutation", p["ari"], p["p_value"]), ("bootstrap low", b["low"], None), ("bootstrap high", b["high"], None), ("paired", t["difference"], t["p_value"])]
    return spark.createDataFrame([(n, round(v, 6), None if q is None else round(q, 6)) for n, v, q in rows], "test string, value double, p_value double")


@query(_SIM + f""", o AS (SELECT id, own, max(CASE WHEN own = cluster THEN 1 - (similarity * size - 1) / (size - 1) END) AS i, min(CASE WHEN own <> cluster THEN 1 - similarity END) AS x FROM m GROUP BY 1, 2), z AS (SELECT id, own AS label, (x - i) / greatest(i, x) AS s FROM o),
e AS (SELECT label, round, sum(k * s) / sum(k) AS m FROM (SELECT label, s, round, {_poisson("concat(id, ':', round, ':sig:0')")} AS k FROM z CROSS JOIN (SELECT unnest(range(1, 21)) AS round)) GROUP BY 1, 2),
p AS (SELECT label, (1 + sum(CASE WHEN coalesce(m, 0) <= 0 THEN 1 ELSE 0 END)) / 21.0::DOUBLE AS p FROM e GROUP BY 1), k AS (SELECT label, p, row_number() OVER (ORDER BY p, label) AS r, count(*) OVER () AS c FROM p),
q AS (SELECT label, p, least(min(p * c / r) OVER (ORDER BY r DESC ROWS UNBOUNDED PRECEDING), 1.0) AS adjusted FROM k), n AS (SELECT label, count(*) AS n, avg(s) AS mean FROM z GROUP BY 1)
SELECT n.label, n, round(mean, 6) AS mean, round(p, 6) AS p_value, round(adjusted, 6) AS adjusted, adjusted <= 0.05 AS significant FROM n JOIN q USING (label)""")
def cluster_significance(spark: SparkSession, d: str) -> DataFrame:
    got = infer.cluster_significance(metrics.hamming_silhouette(customer_cells(spark, d), customer_labels(spark, d), "c_custkey"), 20)
    return got.select("label", "n", F.round("mean", 6).alias("mean"), F.round("p_value", 6).alias("p_value"), F.round("adjusted", 6).alias("adjusted"), "significant")


_PV = "p AS (SELECT o_orderpriority || o_orderstatus AS test, abs(sin(count(*) * 0.001)) * 0.08 AS p FROM orders GROUP BY 1), r AS (SELECT test, p, count(*) OVER () AS m, row_number() OVER (ORDER BY p, test) AS k FROM p)"


@query(f"WITH {_PV} SELECT test, round(least(p * m, 1.0), 6) AS bonferroni, round(1 - (1 - p) ** m, 6) AS sidak, round(least(min(p * m / k) OVER (ORDER BY k DESC ROWS UNBOUNDED PRECEDING), 1.0), 6) AS fdr_bh FROM r")
def multiple_testing(spark: SparkSession, d: str) -> DataFrame:
    p = read(spark, d, "orders").groupBy(F.concat("o_orderpriority", "o_orderstatus").alias("test")).agg((F.abs(F.sin(F.count("*") * 0.001)) * 0.08).alias("p_value"))
    out = None
    for m in ("bonferroni", "sidak", "fdr_bh"):
        one = infer.adjust(p, m).select("test", F.round("adjusted", 6).alias(m))
        out = one if out is None else out.join(one, "test")
    return out


_W = range(len(_P))


@query(f"""WITH {_POINTS}, m AS (SELECT greatest(2, least(100, count(*) // 10)) AS m FROM p), b AS (SELECT {", ".join(f"min(x{i}) AS a{i}, max(x{i}) AS b{i}" for i in _W)} FROM p),
u AS (SELECT k AS probe, {", ".join(f"a{i} + {_U01.format(f"concat(k, ':hopkins:44:{i}')")} * (b{i} - a{i}) AS p{i}" for i in _W)} FROM (SELECT unnest(range(0, m)) AS k FROM m) CROSS JOIN b),
w AS (SELECT * EXCLUDE (r, m) FROM (SELECT *, row_number() OVER (ORDER BY {_H.format("concat(id, ':hopkins:44')")}, id) AS r FROM p) CROSS JOIN m WHERE r <= m),
du AS (SELECT probe, min(sqrt({" + ".join(f"(x{i} - p{i}) ** 2" for i in _W)})) AS d FROM p CROSS JOIN u GROUP BY 1), dw AS (SELECT w.id, min(sqrt({" + ".join(f"(p.x{i} - w.x{i}) ** 2" for i in _W)})) AS d FROM p JOIN w ON p.id <> w.id GROUP BY 1)
SELECT round((SELECT sum(d) FROM du) / ((SELECT sum(d) FROM du) + (SELECT sum(d) FROM dw)), 6) AS hopkins""")
def hopkins(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([(round(preflight.hopkins(_points(spark, d), _P), 6),)], "hopkins double")


@query(floors("three clusters", "the gap rises up to three", "both tests find clusters", "equal rows are no clusters"))
def gap_statistic(spark: SparkSession, d: str) -> DataFrame:
    t = materialise(planted(spark, d).select("id", "x", "y"))
    g, v = preflight.gap_statistic(t, ["x", "y"], 4, 2), preflight.clusterable(t, ["x", "y"], 3)
    same = preflight.clusterable(t.select("id", F.lit(1.0).alias("x"), F.lit(2.0).alias("y")), ["x", "y"], 2)
    return said(spark, [("three clusters", g["best_k"] == 3), ("the gap rises up to three", g["gap"][0] < g["gap"][2] and g["gap"][1] < g["gap"][2]), ("both tests find clusters", v["clusterable"]), ("equal rows are no clusters", not same["clusterable"])])


@query("SELECT * FROM (VALUES (1, 'noise', false), (2, 'x', true), (3, 'y', true)) v(line, feature, matters)")
def permutation_importance(spark: SparkSession, d: str) -> DataFrame:
    """Which columns the groups rest on: more than a tenth of the largest loss of silhouette."""
    t = materialise(planted(spark, d).withColumn("noise", F.sin(F.col("id") * 7.3)))
    labels = t.select("id", F.col("g").alias("label"))
    fitted = spec.fit(t, spec.draw({"x": "numerical", "y": "numerical", "noise": "numerical"}, 18, 1, 4, seed=5))
    got = {g["feature"]: g["normalised"] for g in importance.permutation_importance(t, "id", fitted, labels, ["x", "y", "noise"], repeats=1)}
    return spark.createDataFrame([(i + 1, c, got[c] > 0.1) for i, c in enumerate(sorted(got))], "line int, feature string, matters boolean")


# incremental


@query("WITH p AS (SELECT date_trunc('day', ts) AS batch, count(*) AS n, avg(value) AS mean, stddev_pop(value) AS std FROM events GROUP BY 1), f AS (SELECT arg_min(mean, batch) AS m0, arg_min(std, batch) AS s0 FROM p) SELECT strftime(batch, '%Y-%m-%d') AS batch, n, round(mean, 6) AS mean, round(std, 6) AS std, round(CASE WHEN s0 > 0 THEN greatest(abs(mean - m0), abs(std - s0)) / s0 ELSE 0 END, 6) AS drift FROM p CROSS JOIN f")
def drift_by_batch(spark: SparkSession, d: str) -> DataFrame:
    x = online.drift_by_batch(read(spark, d, "events"), "ts", "value")
    return x.select(F.date_format("batch", "yyyy-MM-dd").alias("batch"), "n", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), F.round("drift", 6).alias("drift"))


@query("SELECT count(value) AS n, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, min(value) AS low, max(value) AS high FROM events")
def running_moments_merge(spark: SparkSession, d: str) -> DataFrame:
    """Moments of thirty batches, merged one after the other, against those of all rows."""
    x = read(spark, d, "events").select(F.col("ts").cast("date").alias("day"), "value")
    per = x.groupBy("day").agg(F.count("value").alias("n"), F.avg("value").alias("m"), F.var_pop("value").alias("v"), F.min("value").alias("a"), F.max("value").alias("b")).orderBy("day").collect()  # one row per day
    total = online.Moments()
    for r in per:
        total = total.merge(online.Moments(r["n"], r["m"], r["v"] * r["n"], r["a"], r["b"]))
    return spark.createDataFrame([(total.count, round(total.mean, 6), round(total.std, 6), total.low, total.high)], "n bigint, mean double, std double, low double, high double")


@query("SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, count(value) AS n, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std FROM events GROUP BY 1")
def stream_windows(spark: SparkSession, d: str) -> DataFrame:
    """Event-time windows over the events read as a stream, run to its end."""
    path = f"{d}/events.parquet"
    schema = spark.read.parquet(path).schema
    import os
    import uuid

    folder = path if os.path.isdir(path) else d
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet" if folder == path else "events.parquet").parquet(folder)
    out = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    online.windowed_moments(stream, "ts", "value").writeStream.outputMode("complete").foreachBatch(lambda x, i: x.write.mode("overwrite").parquet(f"{out}/rows")).option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start().awaitTermination()
    got = spark.read.parquet(f"{out}/rows")
    return got.select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "n", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


@query(GROUPS)
def online_segments(spark: SparkSession, d: str) -> DataFrame:
    """Three batches through partial_fit, the second one delivered twice and the third one after a restart, then the segments of all rows."""
    import uuid

    t, path = materialise(planted(spark, d).drop("g")), f"{shared_dir(spark)}/online-{uuid.uuid4().hex}"
    make = lambda: online.OnlineSegmenter(segment.ForestSegmenter(n_iterations=16, n_clusters=3, clusterer="agglomerative", cut="quantile"), "id", path=path)
    o = make()
    for i in (0, 1, 1):
        o.partial_fit(t.where(F.floor(F.col("id") / 3) % 3 == i), i)
    o = make()
    o.partial_fit(t.where(F.floor(F.col("id") / 3) % 3 == 2), 2)
    return community.renumber(o.labels(spark))


@query("SELECT 'rows counted once' AS what, count(*)::DOUBLE AS value FROM customer UNION ALL SELECT 'mean of x', round(avg((c_custkey % 3) * 100 + c_nationkey / 5.0), 6) FROM customer UNION ALL SELECT 'rebuilds by drift', 1 UNION ALL SELECT 'rebuilds by rows', 1 UNION ALL SELECT 'rebuilds never', 0 UNION ALL SELECT 'rows kept', 10")
def online_strategies(spark: SparkSession, d: str) -> DataFrame:
    """Moments over repeated batches, rebuilds of each strategy when the last batch has moved, and the cap on stored rows."""
    t, out = materialise(planted(spark, d).drop("g")), []
    for how, settings in (("drift", {}), ("rows", {"strategy": "periodic", "max_rows": 2}), ("never", {"strategy": "never", "keep_rows": 10})):
        o = online.OnlineSegmenter(segment.ForestSegmenter(n_iterations=4, n_clusters=2), "id", **({"strategy": how} | settings if how != "rows" else settings))
        for i in (0, 0, 1):
            part = t.where(F.col("id") % 2 == i)
            o.partial_fit(part.withColumn("x", F.col("x") + 500.0).withColumn("y", F.col("y") + 500.0) if i and how != "never" else part, i)
        out.append((f"rebuilds {'' if how == 'never' else 'by '}{how}", float(o.rebuilds)))
    out += [("rows counted once", float(o.running["x"].count)), ("mean of x", round(o.running["x"].mean, 6)), ("rows kept", float(o.stored(spark).count()))]
    return spark.createDataFrame(out, "what string, value double")


__all__ = ["Q", "SQL", "CUSTOMER_SQL", "embed"]
