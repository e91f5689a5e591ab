import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabseg.operators import community, compress, contrast, embed, explain, forests, importance, infer, metrics, pairs, preflight, report, ruletree, search, segment
from tabseg.plans import spec

F2 = [[0, 1, 2, 3], [0, 1, 0, 1], [1, 0, 2, 3], [1, 1, 0, 1], [0, 0, 2, 3]]


def cells(spark, rows):
    return spark.createDataFrame([(i, [int(c) for c in r]) for i, r in enumerate(rows)], "id bigint, cells array<bigint>")


def blobs(n, centres, std, seed=0):
    rng = np.random.default_rng(seed)
    y = np.arange(n) % len(centres)
    return np.array(centres)[y] + rng.normal(size=(n, len(centres[0]))) * std, y


def points(spark, x, y):
    return spark.createDataFrame([(i, int(b), *map(float, a)) for i, (a, b) in enumerate(zip(x, y))], "id bigint, truth int, x double, y double")


def agreement(labels, truth):
    return metrics.ari(metrics.contingency(labels.join(truth, "id"), "label", "truth")).first()["ari"]


def test_hamming_golden(spark):
    got = {(r["i"], r["j"]): r["dist"] for r in pairs.hamming_pairs(cells(spark, F2), "id").collect()}
    assert got == {(0, 1): 0.5, (0, 2): 0.5, (0, 3): 0.75, (0, 4): 0.25, (1, 2): 1.0, (1, 3): 0.25, (1, 4): 0.75, (2, 3): 0.75, (2, 4): 0.25, (3, 4): 1.0}
    w = {(r["i"], r["j"]): round(r["dist"], 6) for r in pairs.hamming_pairs(cells(spark, F2), "id", [1.0, 2, 3, 4]).collect()}
    assert [w[0, j] for j in (1, 2, 3, 4)] == [0.7, 0.3, 0.8, 0.2] and w[2, 3] == 0.9
    with pytest.raises(ValueError):
        pairs.check_weights([0, 0, 0, 0], 4)
    near = pairs.hamming_pairs(cells(spark, F2), "id", within=0.25, block=2)
    assert {(r["i"], r["j"]) for r in near.collect()} == {(0, 4), (1, 3), (2, 4)}
    assert pairs.usable_weights([0, 0, 0, 0], 4) == [1.0] * 4 == pairs.usable_weights([1, float("nan"), 1, 1], 4) and pairs.usable_weights([1, 0, 0, 2], 4) == [1, 0, 0, 2]


def test_phi_squares_to_weighted_hamming(spark):
    w = np.array([1.0, 2, 3, 4])
    v = {r["id"]: r["features"].toArray() for r in embed.phi(cells(spark, F2), "id", w).collect()}
    assert abs(((v[0] - v[1]) ** 2).sum() - 0.7) < 1e-12 and abs(((v[0] - v[3]) ** 2).sum() - 0.8) < 1e-12


def test_bins_edges_missing_unseen(spark):
    f = spec.Feature("x", "numerical", 3, [0.0, 0.0], "s")
    s = spec.Spec(spec.Sketch([[f]]), {"s": [1.0, 2.0]})
    df = spark.createDataFrame([(0.5,), (1.0,), (1.5,), (2.0,), (9.0,), (float("nan"),), (None,)], "x double")
    assert [r["cells"][0] for r in embed.embed(df, s, []).collect()] == [0, 1, 1, 2, 2, 0, 0]
    g = spec.Feature("c", "categorical", 3, [], "k")
    s = spec.Spec(spec.Sketch([[g]]), {}, {"k": {"a": 0, "b": 1}})
    df = spark.createDataFrame([("a",), ("b",), ("zz",), (None,)], "c string")
    assert [r["cells"][0] for r in embed.embed(df, s, []).collect()] == [0, 1, 2, 2]


def test_expression_and_batches_agree(spark):
    rng = np.random.default_rng(0)
    df = spark.createDataFrame([(i, float(x) if i % 9 else None, str(c) if i % 11 else None) for i, (x, c) in enumerate(zip(rng.normal(size=200), rng.integers(0, 6, 200)))], "id bigint, x double, c string")
    s = spec.fit(df, spec.draw({"x": "numerical", "c": "categorical"}, 10, 2, 4, seed=1))
    a = {r["id"]: r["cells"] for r in embed.embed(df, s, ["id"]).collect()}
    assert a == {r["id"]: r["cells"] for r in embed.embed_arrow(df, s, ["id"]).collect()}
    assert spec.Spec.from_json(s.to_json()) == s and max(max(v) for v in a.values()) < 16
    for cut in ("quantile", "density"):
        assert embed.embed(df, spec.fit(df, spec.draw({"x": "numerical"}, 3, 1, 3, cut=cut), "id"), ["id"]).count() == 200


def test_knn_equals_brute_force_and_lsh_recall(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 3, (4, 120))
    rows = [np.where(rng.random(120) < 0.12, rng.integers(0, 3, 120), base[i % 4]) for i in range(160)]
    e = cells(spark, rows)
    x = np.array(rows)
    d = (x[:, None] != x[None]).sum(2)
    np.fill_diagonal(d, 999)
    truth = {(i, int(j)) for i in range(160) for j in np.lexsort((np.arange(160), d[i]))[:5]}
    got = {(r["src"], r["dst"]) for r in pairs.knn(e, "id", 5).collect()}
    assert got == truth
    near = pairs.lsh_knn(e, "id", 5, pairs.choose_band(e, "id", 120, 5)).collect()
    kth = {i: np.sort(d[i])[4] for i in range(160)}
    assert sum(r["dist"] <= kth[r["src"]] for r in near) / (5 * 160) >= 0.9


def test_hot_band_keeps_candidates(spark):
    e = cells(spark, [[1, 1, 1, 1]] * 500 + [[1, 1, 2, i] for i in range(20)])
    got = pairs.lsh_knn(e, "id", 3, 2, max_bucket=50)
    assert got.select("src").distinct().count() == 520


def test_mean_similarity_and_silhouette_match_pairs(spark):
    rng = np.random.default_rng(5)
    x = rng.integers(0, 3, (40, 6))
    y = np.arange(40) % 3
    labels = spark.createDataFrame([(i, int(v)) for i, v in enumerate(y)], "id bigint, label int")
    d = (x[:, None] != x[None]).mean(2)
    for r in pairs.mean_similarity(cells(spark, x), labels, "id").collect():
        assert abs(r["similarity"] - (1 - d[r["id"], y == r["cluster"]].mean())) < 1e-9
    for r in metrics.hamming_silhouette(cells(spark, x), labels, "id").collect():
        i = r["id"]
        a = d[i, (y == y[i]) & (np.arange(40) != i)].mean()
        b = min(d[i, y == c].mean() for c in range(3) if c != y[i])
        assert abs(r["silhouette"] - (b - a) / max(a, b)) < 1e-9


def test_ari_golden(spark):
    y = [0, 0, 0, 0, 1, 1, 1, 1, 2, 2, 2, 2]
    same = spark.createDataFrame([(a, a) for a in y], "a int, b int")
    assert metrics.ari(metrics.contingency(same, "a", "b")).first()["ari"] == 1.0 and abs(metrics.nmi(metrics.contingency(same, "a", "b")).first()["nmi"] - 1) < 1e-12
    one = spark.createDataFrame([(0, 0), (0, 0)], "a int, b int")
    assert metrics.ari(metrics.contingency(one, "a", "b")).first()["ari"] == 1.0


def test_corrections(spark):
    t = spark.createDataFrame(list(enumerate([0.011, 0.03, 0.02, 0.005, 0.2])), "test int, p_value double")
    bh = {r["test"]: r for r in infer.adjust(t, "fdr_bh").collect()}
    assert np.allclose([bh[i]["adjusted"] for i in range(5)], [0.0275, 0.0375, 1 / 30, 0.025, 0.2]) and [bh[i]["reject"] for i in range(5)] == [True] * 4 + [False]
    bonf = {r["test"]: r for r in infer.adjust(t, "bonferroni").collect()}
    assert np.allclose([bonf[i]["adjusted"] for i in range(5)], [0.055, 0.15, 0.1, 0.025, 1]) and [bonf[i]["reject"] for i in range(5)] == [False] * 3 + [True, False]


def test_medoid_of_nominal_cells(spark):
    rows = [[10**15, 2, 3, 4, 5], [10**15, 2, 9, 4, 5], [10**15, 2, 3, 4, 5], [7, 2, 3, 4, 5]]
    e = cells(spark, rows)
    protos, assignment = compress.compress(e.withColumn("cells", F.col("cells")), "id", 5)
    assert protos.count() == 3 and assignment.count() == 4
    got = compress.medoids(e.select(F.lit(0).alias("proto"), "id", "cells")).first()
    assert got["id"] == 0
    new = compress.assign(cells(spark, [[7, 2, 3, 4, 5], [7, 2, 3, 4, 6]]), "id", protos).collect()
    assert sorted((r["id"], r["dist"]) for r in new) == [(0, 0), (1, 1)]


def test_blobs_are_found(spark):
    x, y = blobs(300, [(-6, 0), (0, 6), (6, 0)], 0.8)
    df = points(spark, x, y)
    s = segment.ForestSegmenter(n_iterations=64, n_features=1, n_bins=4, n_clusters=3, cut="quantile").fit(df.drop("truth"), "id")
    assert agreement(s.labels_, df.select("id", "truth")) > 0.7
    again = s.predict(df.drop("truth"), "id")
    assert agreement(again, df.select("id", "truth")) > 0.7
    with pytest.raises(ValueError):
        segment.ForestSegmenter(n_clusters=3, clusterer="louvain").fit(df, "id")


def test_louvain_linkage_dbscan_components(spark):
    base = np.random.default_rng(0).integers(0, 4, (3, 20))
    rows = [np.where(np.random.default_rng(i).random(20) < 0.1, 9, base[i % 3]) for i in range(45)]
    e = cells(spark, rows)
    truth = spark.createDataFrame([(i, i % 3) for i in range(45)], "id bigint, truth int")
    for labels in (community.graph_clusters(e, "id", k=6), community.graph_clusters(e, "id", k=6, algorithm="leiden"), segment.agglomerate(e, "id", 3), segment.dbscan_retry(e, "id", 4)):
        assert agreement(labels, truth) > 0.9
    edges = spark.createDataFrame([(1, 2), (2, 3), (7, 8)], "src bigint, dst bigint")
    nodes = spark.createDataFrame([(i,) for i in (1, 2, 3, 7, 8, 9)], "id bigint")
    assert {r["id"]: r["component"] for r in community.components(nodes, edges).collect()} == {1: 1, 2: 1, 3: 1, 7: 7, 8: 7, 9: 9}
    lone = community.handle_noise(spark.createDataFrame([(1, 5), (2, 5), (3, 8)], "id bigint, label bigint"), "mark")
    assert {r["id"]: r["label"] for r in lone.collect()} == {1: 0, 2: 0, 3: -1}
    assert community.parse_graph(" leiden: k=20, resolution=1.5") == {"algorithm": "leiden", "k": 20, "resolution": 1.5}


def test_communities_of_noisy_cliques(spark):
    rng = np.random.default_rng(0)
    rows = [(a, b, 1.0) for c in range(30) for a in range(c * 10, c * 10 + 10) for b in range(c * 10, c * 10 + 10) if a != b]
    rows += [(int(a), int(b), 0.05) for a, b in rng.integers(0, 300, (200, 2)) if a != b]
    rows += [(b, a, w) for a, b, w in rows]
    e = spark.createDataFrame(rows, "src bigint, dst bigint, w double").groupBy("src", "dst").agg(F.max("w").alias("w"))
    truth = spark.createDataFrame([(i, i // 10) for i in range(300)], "id bigint, truth int")
    for find in (community.louvain, community.leiden):
        labels = find(spark.range(301), e)
        assert agreement(labels, truth) > 0.95 and labels.count() == 301
    planted = community.modularity(e, truth.select("id", F.col("truth").alias("label")))
    assert community.modularity(e, labels) > planted - 0.01
    assert community.louvain(spark.range(3), e.limit(0)).where("id <> label").count() == 0


def test_modularity_of_a_ring_of_small_cliques(spark):
    # a known graph: five triangles in a ring; the best partition is the triangles (modularity 0.55)
    edges = [(3 * c + i, 3 * c + j) for c in range(5) for i, j in ((0, 1), (1, 2), (0, 2))] + [(3 * c + 2, (3 * c + 3) % 15) for c in range(5)]
    e = spark.createDataFrame([(a, b, 1.0) for a, b in edges] + [(b, a, 1.0) for a, b in edges], "src bigint, dst bigint, w double")
    for find in (community.louvain, community.leiden):
        assert community.modularity(e, find(spark.range(15), e)) > 0.549


def test_components_equal_union_find(spark):
    rng = np.random.default_rng(1)
    chain = [(i, i + 1) for i in range(400)]
    star = [(1000, 1001 + i) for i in range(300)]
    loose = [(int(a), int(b)) for a, b in rng.integers(2000, 2600, (280, 2))]
    nodes = [*range(401), *range(1000, 1301), *range(2000, 2600), 9999]
    up = {v: v for v in nodes}

    def root(v):
        while up[v] != v:
            v = up[v]
        return v

    for a, b in chain + star + loose:
        a, b = sorted((root(a), root(b)))
        up[b] = a
    e = spark.createDataFrame([(b, a) if a % 2 else (a, b) for a, b in chain + star + loose + [(5, 5)]], "src bigint, dst bigint")
    got = {r["id"]: r["component"] for r in community.components(spark.createDataFrame([(v,) for v in nodes], "id bigint"), e).collect()}
    assert got == {v: root(v) for v in nodes}


def test_noise_joins_the_nearest_of_all_rows(spark):
    e = cells(spark, [[1, 1, 1], [1, 1, 1], [2, 2, 2], [2, 2, 2], [2, 2, 9], [1, 8, 7]])
    labels = spark.createDataFrame([(0, 0), (1, 0), (2, 2), (3, 2), (4, 4), (5, 5)], "id bigint, label bigint")
    assert {r["id"]: r["label"] for r in community.handle_noise(labels, "merge", e).collect()} == {0: 0, 1: 0, 5: 0, 2: 1, 3: 1, 4: 1}
    assert {r["id"]: r["label"] for r in community.handle_noise(labels, "singleton").collect()} == {0: 0, 1: 0, 2: 1, 3: 1, 4: 2, 5: 3}


def test_rule_tree(spark):
    x, y = blobs(90, [(-6, 0), (0, 6), (6, 0)], 0.45)
    df = points(spark, x, y)
    t = ruletree.fit_tree(df, ["x", "y"], 3)
    assert agreement(df.select("id", t.label().alias("label")), df.select("id", "truth")) > 0.95
    assert len(t.rules()) == 3 and sum(n for _, n, _ in t.rules()) == 90
    flat = spark.createDataFrame([(1, 0, 1.0, 1.0)] * 5, df.schema)
    assert ruletree.fit_tree(flat, ["x", "y"], 3).k == 1
    # three groups of three with matching categories: the first split separates six from three
    v = np.array([0, 0.1, 0.2, 4.8, 5, 5.2, 9.8, 10, 10.1])
    z = (v - v.mean()) / v.std()
    rows = [(i, float(a), float(i // 3 == 0), float(i // 3 == 1), float(i // 3 == 2)) for i, a in enumerate(z)]
    gain, feature, threshold, left, _ = ruletree.best_split(spark.createDataFrame(rows, "id int, x double, a double, b double, c double"), ["x", "a", "b", "c"], 2)
    assert abs(gain - 9.773533) < 1e-5 and feature == "x" and abs(threshold - 0.614818) < 1e-5 and left[0] == 6


def test_search_chooses_three(spark):
    x, y = blobs(90, [(-6, 0), (0, 6), (6, 0)], 0.45)
    df = points(spark, x, y)
    s = search.Search({"kmeans": (lambda p, k, seed: segment.kmeans_points(p, ["x", "y"], k, seed)[0], {})}, range(2, 5), restarts=1).fit(df, ["x", "y"])
    assert s.best_["k"] == 3 and agreement(s.labels_, df.select("id", "truth")) > 0.95


def test_forests(spark):
    rng = np.random.default_rng(0)
    rows = [(i, float(rng.normal(25 if i % 2 else 60, 2)), float(rng.normal(20 if i % 2 else 90, 3)), "female" if i % 2 else "male") for i in range(80)]
    df = spark.createDataFrame(rows, "id bigint, age double, fare double, sex string")
    truth = {i: i % 2 for i in range(80)}
    for f in (forests.RandomForestLeaves(["age", "fare"], ["sex"], trees=8, depth=5, min_leaf=2), forests.ExtraTrees(["age", "fare"], ["sex"], trees=6, depth=4, min_leaf=2)):
        leaves = f.fit(df, "id").leaves(df, "id")
        p = pairs.proximity(leaves, "id").collect()
        same = np.mean([r["proximity"] for r in p if truth[r["i"]] == truth[r["j"]]])
        assert same > np.mean([r["proximity"] for r in p if truth[r["i"]] != truth[r["j"]]]) + 0.2
    # a feature may have any name, that of the label among them
    named = df.withColumnRenamed("age", "y").withColumnRenamed("fare", "x")
    own = forests.RandomForestLeaves(["y", "x"], ["sex"], trees=4, depth=4, min_leaf=2).fit(named, "id")
    assert abs(own.prep.centre["y"][0] - 42.5) < 1.5
    box = forests.synthetic(df, "id", ["age"], ["sex"], "uniform_box")
    assert box.count() == 80 and {r[0] for r in box.select("sex").distinct().collect()} <= {"female", "male"}


def test_neighbours_are_compared_in_narrow_types():
    """Wide cells are renumbered before they are compared; neighbours and ties are those of all pairs."""
    rng = np.random.default_rng(3)
    x, ids = rng.integers(0, 3, (90, 6)) * 10**15, rng.permutation(90)
    assert pairs._narrow(x, x)[0].dtype == np.uint8
    d = (x[:, None] != x[None]).sum(2)
    assert (pairs._apart(x, x, None) == d).all() and (pairs._apart(x[:, :1].repeat(300, 1), x[:, :1].repeat(300, 1), None).max() == 300)
    frame = pd.DataFrame({"id": ids, "cells": list(x)})
    for k in (4, 200):
        got = pairs._nearest(k)(frame, frame, True)
        want = {(int(ids[i]), *(int(v) for v in p)) for i in range(90) for p in sorted((d[i, j], ids[j]) for j in range(90) if j != i)[:k]}
        assert len(got) == len(want) and {(r.src, r.dist, r.dst) for r in got.itertuples()} == want


def test_deep_trees_of_few_rows(spark):
    """Passes and arrays of the trees follow the splits there are, not the depth that is allowed."""
    df = spark.createDataFrame([(i, float(i % 2) * 50 + i % 7, "ab"[i % 2]) for i in range(60)], "id bigint, x double, c string")
    f = forests.ExtraTrees(["x"], ["c"], trees=3, depth=30, min_leaf=8).fit(df, "id")
    nodes = [r["cells"] for r in f.leaves(df, "id").collect()]
    assert len(nodes) == 60 and f.splits and all((t, n) not in f.splits and (n == 1 or (t, n // 2) in f.splits) for r in nodes for t, n in enumerate(r))


def test_kmeans_of_loose_groups(spark):
    """Loose groups without common cells are found, also from seeds with which a single start merges two of them."""
    rng = np.random.default_rng(0)
    rows = [[i % 3 * 100 + (0 if rng.random() < 0.6 else 1 + rng.integers(12)) for _ in range(20)] for i in range(300)]
    x = cells(spark, rows).coalesce(1)
    for seed in (0, 1):
        got = segment.kmeans_cells(x, "id", 3, None, seed)[0].collect()
        assert len({(r["id"] % 3, r["label"]) for r in got}) == 3


def test_kmeans_starts_share_their_passes(spark, monkeypatch):
    """Ten starts over many copies of few points take few jobs; passes in the cluster end at the same groups."""
    x = cells(spark, [[i % 3, i % 3, i % 3, i % 3, i % 4] for i in range(600)])
    spark.sparkContext.setJobGroup("starts", "starts")
    one = segment.kmeans_cells(x, "id", 3, np.arange(1.0, 6.0))
    spark.sparkContext.setJobGroup("others", "others")
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("starts")) < 20
    monkeypatch.setattr(segment, "ONE_PLACE", 0)
    monkeypatch.setattr(segment, "CENTRE_NUMBERS", 200)  # some starts after the others
    spread = segment.kmeans_cells(x, "id", 3, np.arange(1.0, 6.0))
    assert len({(r["id"] % 3, r["label"]) for r in one[0].collect()}) == len({(r["id"] % 3, r["label"]) for r in spread[0].collect()}) == 3
    assert abs(one[1].cost - spread[1].cost) < 1e-9


def test_shuffle_keeps_values(spark):
    df = spark.createDataFrame([(i, float(i) if i % 5 else None, i) for i in range(100)], "id bigint, x double, y int")
    got = importance.shuffle_column(df, "id", "x", "s").collect()
    assert sorted(r["x"] or 0.0 for r in got) == sorted(r["x"] or 0.0 for r in df.collect()) and any(r["x"] != (float(r["id"]) if r["id"] % 5 else None) for r in got) and all(r["y"] == r["id"] for r in got)


def test_preflight(spark):
    x, y = blobs(300, [(-6, 0), (0, 6), (6, 0)], 0.3)
    df = points(spark, x, y)
    assert preflight.hopkins(df, ["x", "y"]) > 0.75
    assert preflight.gap_statistic(df, ["x", "y"], 4, 2)["best_k"] >= 2
    same = spark.createDataFrame([(i, 0, 1.0, 1.0) for i in range(20)], df.schema)
    assert preflight.hopkins(same, ["x", "y"]) == 0.5 and preflight.clusterable(same, ["x", "y"])["clusterable"] is False


def test_significance(spark):
    df = spark.createDataFrame([(i, i % 3, i % 3 if i % 10 else 0, (i // 3) % 3) for i in range(120)], "id bigint, a int, b int, c int")
    p = infer.permutation_test(df, "id", "a", "b", 50)
    assert p["ari"] > 0.7 and abs(p["p_value"] - 1 / 51) < 1e-12 and abs(p["null_mean"]) < 0.05
    b = infer.bootstrap_ari(df, "id", "a", "b", 40)
    assert b["low"] <= b["ari"] <= b["high"] + 0.1
    assert infer.paired_test(df, "id", "a", "b", "c", 40)["difference"] > 0.3


def test_explain_and_report(spark):
    x, y = blobs(120, [(-6, 0), (6, 0)], 0.5)
    df = points(spark, x, y).withColumn("c", F.when(F.col("truth") == 0, "l").otherwise("r"))
    t = explain.SurrogateTree(["x", "y"], ["c"]).fit(df, "truth")
    assert t.fidelity_.first()["accuracy"] == 1.0 and len(t.rules()) == 2
    m = explain.LabelClassifier(["x", "y"], ["c"], trees=5, depth=3, reject_below=1.01).fit(df, "truth")
    assert {r["label"] for r in m.predict(df, "id").collect()} == {-1}
    assert explain.cards(df, "truth", ["x", "y"], ["c"]).count() == 2
    s = spec.fit(df, spec.draw({"x": "numerical", "c": "categorical"}, 8, 1, 3))
    e = embed.embed(df, s, ["id"])
    labels = df.select("id", F.col("truth").alias("label"))
    assert {c[1] for c in report.health_checks(report.summary(e, labels, "id"))} <= {"ok", "warning"}
    assert report.uncertain(e, labels, "id", 5).count() == 5
    assert report.stability(df, "id", lambda d, seed: d.select("id", F.col("truth").alias("label")), 2).first()["ari"] == 1.0


def test_contrast(spark):
    labels = spark.createDataFrame([(i, i % 3) for i in range(30)], "id bigint, label int")
    got = {(r["anchor"], r["other"]): r["positive"] for r in contrast.pairs_by_label(labels).collect()}
    assert got and all(p == (a % 3 == b % 3) and a != b for (a, b), p in got.items())
    p = spark.createDataFrame([(0, 1, True, 1.0), (0, 2, False, 0.0), (3, 4, True, 1.0)], "anchor int, other int, positive boolean, similarity double")
    r = contrast.nt_xent(p, 1.0).first()
    assert r["n"] == 1 and abs(r["loss"] + np.log(np.e / (np.e + 1))) < 1e-12
    assert contrast.information_gain(np.array([0, 0, 1, 1]), np.array([True, True, False, False])) == 1.0


def test_farthest_and_birch(spark):
    x, y = blobs(60, [(-6, 0), (0, 6), (6, 0)], 0.2)
    df = points(spark, x, y)
    assert len({i % 3 for i in compress.farthest_first(df, ["x", "y"], 3)}) == 3
    assert agreement(segment.birch(df, ["x", "y"], 1.0, 3), df.select("id", "truth")) == 1.0


def test_neighbours_in_hot_bands_are_exact(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate((np.ones((300, 2), int), rng.integers(0, 4, (300, 6))), axis=1)
    e = cells(spark, x)
    d = (x[:, None] != x[None]).sum(2)
    np.fill_diagonal(d, 999)
    truth = {(i, int(j), int(d[i, j])) for i in range(300) for j in np.lexsort((np.arange(300), d[i]))[:4]}
    for got in (pairs.lsh_knn(e, "id", 4, 2, max_bucket=40, block=64), pairs.lsh_knn(e, "id", 4, 2), pairs.knn(e, "id", 4, block=70), pairs.knn(e, "id", 4)):
        assert {tuple(r) for r in got.select("src", "dst", "dist").collect()} == truth
