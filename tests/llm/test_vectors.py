import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tabseg.llm import cluster, neighbours, varied, vectors


def test_nearest_rows_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "LIST_SIZE", 60)
    monkeypatch.setattr(neighbours, "BLOCK", 100)
    rng = np.random.default_rng(0)
    for d in (3, 5):
        x = np.concatenate((rng.normal(size=(600, d)).round(1), np.ones((300, d)), rng.normal(size=(60, d)) * 50))
        grp = np.where(np.arange(len(x)) % 10 == 0, "b", "a")
        grp[5] = "lonely"
        df = spark.createDataFrame([(i, g, [float(v) for v in r]) for i, (g, r) in enumerate(zip(grp, x))], "id bigint, grp string, x array<double>")
        q = df.where("id % 7 = 0 OR id = 5")
        got = {}
        for r in neighbours.nearest_rows(df, q, 5).collect():
            got.setdefault(r["qid"], {})[r["rank"]] = r["id"]
        for i in range(len(x)):
            if i % 7 and i != 5:
                continue
            same = np.flatnonzero((grp == grp[i]) & (np.arange(len(x)) != i))
            dist = np.zeros(len(same))
            for c in range(d):
                dist += (x[same, c] - x[i, c]) ** 2
            want = same[np.lexsort((same, dist))[:5]].tolist()
            assert [got.get(i, {})[k] for k in sorted(got.get(i, {}))] == want
    assert neighbours.nearest_rows(df.limit(0), q.limit(0), 5).count() == 0 and neighbours.nearest_rows(df, q.limit(0), 5).count() == 0


def test_margin_abandons_but_recalls(spark):
    rng = np.random.default_rng(1)
    df = spark.createDataFrame([(i, "g", [float(v) for v in r]) for i, r in enumerate(rng.normal(size=(500, 16)))], "id bigint, grp string, x array<double>")
    q = df.where("id % 10 = 0")
    exact = {(r["qid"], r["id"]) for r in neighbours.nearest_rows(df, q, 5).collect()}
    fast = {(r["qid"], r["id"]) for r in neighbours.nearest_rows(df, q, 5, margin=2.0, width=4, exact=False).collect()}
    assert len(exact & fast) / len(exact) >= 0.9


def test_segments_with_strays_and_categories(spark):
    rng = np.random.default_rng(2)
    rows = []
    for k, (centre, cat) in enumerate([((0, 0), "A"), ((0, 0), "B"), ((10, 10), "A"), ((-12, 6), "C")]):
        for p in rng.normal(size=(700 if k != 1 else 300, 2)) * 0.4 + centre:
            rows.append((len(rows), float(p[0]), float(p[1]), cat if rng.random() > 0.02 else None, k))
    for p in rng.uniform(-20, 20, (80, 2)):
        rows.append((len(rows), float(p[0]), float(p[1]), "A", -1))
    df = spark.createDataFrame(rows, "id bigint, x double, y double, c string, truth int")
    model = cluster.fit_segments(df, ["x", "y"], F.col("c"), k=32)
    got = cluster.assign(df, model, F.col("c"), ["id", "truth"])
    t = got.toPandas()
    real = t[t.truth >= 0]
    assert real.segment.isna().mean() < 0.02 and t[t.truth < 0].segment.isna().mean() > 0.85
    purity = real.dropna().groupby("truth").segment.agg(lambda s: s.value_counts().iloc[0] / len(s))
    assert (purity > 0.93).all() and real.segment.nunique() == 4
    told = cluster.describe(got, model, "id").collect()
    assert len(told) == 4 and all(len(r["typical"]) == 5 for r in told)
    none = cluster.fit_segments(df.limit(0), ["x", "y"], F.col("c"))
    assert cluster.assign(df, none, F.col("c"), ["id"]).where("segment IS NOT NULL").count() == 0
    same = spark.createDataFrame([(i, 1.0, 1.0, "A") for i in range(50)], "id bigint, x double, y double, c string")
    assert cluster.assign(same, cluster.fit_segments(same, ["x", "y"], F.col("c")), F.col("c"), ["id"]).where("segment IS NOT NULL").count() == 50


def test_quotas():
    def q(sizes, wanted, equal=False):
        return varied.quotas(pd.DataFrame({"size": sizes}), wanted, equal).tolist()

    assert q([100, 100], 10) == [5, 5] and q([10000, 100], 110) in ([100, 10], [99, 11]) and q([2, 1000], 100, True) == [2, 98]
    assert sum(q([3, 4, 5], 100)) == 12 and q([3, 4], 0) == [0, 0] and q([], 5) == [] and sum(q([7, 9, 1000, 1], 55)) == 55


def test_subset_covers_and_keeps_rare(spark):
    rng = np.random.default_rng(4)
    rows = [(i, i // 2, "o1" if i % 3 else "o2", "2016-01", "a" if i < 1990 else f"r{i // 4}", float(rng.normal() + (i % 4) * 20), 1.0 if i % 50 else None) for i in range(2000)]
    df = spark.createDataFrame(rows, "row_id bigint, rec bigint, origin string, mo string, c string, x double, y double")
    placed = varied.strata(df, "row_id", "rec", F.col("origin"), F.col("mo"), [F.col("c")], ["x", "y"], F.col("c"), k=8)
    wanted = spark.createDataFrame([("o1", 40), ("o2", 10)], "scope string, wanted bigint")
    got = varied.choose(placed, wanted).toPandas()
    assert got[got.scope == "o1"].shape[0] == max(40, got[(got.scope == "o1") & got.rare].shape[0]) and not got.id.duplicated().any()
    records = df.where("c <> 'a'").groupBy("c").agg(F.count_distinct("rec").alias("n")).where("n < 3")
    must = df.join(records, "c").groupBy("c", "rec", "origin").agg(F.min("row_id").alias("id"))
    assert {r["id"] for r in must.collect()} == set(got[got.rare].id)
    sizes = placed.where("scope = 'o1' AND NOT rare").groupBy("stratum").count().toPandas()
    assert got[(got.scope == "o1") & ~got.rare].stratum.nunique() == min(len(sizes), len(got[(got.scope == "o1") & ~got.rare]))


def test_seeding_is_reproducible(spark):
    rng = np.random.default_rng(5)
    df = spark.createDataFrame([(float(a), float(b), "c") for a, b in rng.normal(size=(500, 2))], "x double, y double, c string")
    space = vectors.fit_space(df, ["x", "y"])
    a = vectors.seed_centres(vectors.summarise(df, space, F.col("c")), space, 10)
    b = vectors.seed_centres(vectors.summarise(df.repartition(5), space, F.col("c")), space, 10)
    assert a.shape == b.shape == (10, space.width) and np.allclose(a, b, atol=1e-6)
