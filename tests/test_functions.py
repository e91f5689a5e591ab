import numpy as np
import pytest
from pyspark.sql import functions as F

from tabseg.functions import cuts, encode, profile, weights
from tabseg.functions.quantiles import exact_quantiles


def test_exact_quantiles_match_numpy(spark):
    rng = np.random.default_rng(0)
    a = np.concatenate((rng.normal(size=500), rng.choice([1.5, -2.0], 200), [1e12, -1e-9]))
    df = spark.createDataFrame([(float(x), float(x * x)) for x in a] + [(float("nan"), None), (float("inf"), 1.0)], "a double, b double")
    p = [0.0, 0.01, 0.25, 0.5, 0.9, 1.0]
    got = exact_quantiles(df, {"a": p, "b": p})
    assert np.allclose(got["a"], np.quantile(a, p)) and np.allclose(got["b"], np.quantile(np.append(a * a, 1.0), p))
    assert exact_quantiles(df.limit(0), {"a": [0.5]}) == {"a": [None]}


@pytest.mark.parametrize("n, k", [(2, 2), (8, 4), (60, 7), (100, 8), (1000, 11), (2000, 12), (60000, 17)])
def test_sturges(n, k):
    assert cuts.sturges(n) == k


@pytest.mark.parametrize("n, u, span, iqr, k", [(1000, 900, 10, 4, 9), (1000, 900, 100, 1, 6), (1000, 20, 10, 4, 10), (16, 2, 1, 1, 2)])
def test_adaptive_bins(n, u, span, iqr, k):
    assert cuts.adaptive_bins({"n_unique": u, "min": 0, "max": span, "q25": 0, "q75": iqr}, n) == k


def test_categorical_cap():
    assert cuts.categorical_cap(6, 8) == 4


def test_density_valleys():
    rng = np.random.default_rng(0)
    two = np.concatenate((rng.normal(-3, 0.5, 1000), rng.normal(3, 0.5, 1000)))
    got, how = cuts.density_cuts(two, 1, rng)
    assert how == "kde" and -1 < got[0] < 1
    three = np.concatenate([rng.normal(m, 0.5, 1000) for m in (-5, 0, 5)])
    got, how = cuts.density_cuts(three, 2, rng)
    assert how == "kde" and -4 < got[0] < -1 and 1 < got[1] < 4
    assert cuts.density_cuts(np.ones(20), 2, rng)[1] == "uniform" and cuts.density_cuts(np.array([1.0, 2, 3]), 2, rng)[1] == "quantile"


def test_entropy_and_gini_weights(spark):
    rows = [[0, 0, 0], [1, 1, 0], [2, 1, 0], [3, 2, 0], [4, 2, 0]]
    cells = spark.createDataFrame([(i, l, c) for i, r in enumerate(rows) for l, c in enumerate(r)], "id int, l int, cell bigint")
    assert np.allclose(weights.iteration_weights(cells, 3), [1.530433, 1.469567, 0], atol=1e-6)
    assert np.allclose(weights.iteration_weights(cells, 3, "entropy", 0.5), [1.560841, 1.439159, 0], atol=1e-6)
    assert np.allclose(weights.iteration_weights(cells, 3, "entropy", 2.0), [1.20484, 1.19274, 0.60242], atol=1e-5)
    assert np.allclose(weights.iteration_weights(cells, 3, "inverse_gini"), [1.530612, 1.469388, 0], atol=1e-6)
    assert np.allclose(weights.iteration_weights(cells, 3, "inverse_gini", 2.0), [1.204869, 1.192697, 0.602434], atol=1e-6)
    assert weights.tempered(np.zeros(3)).tolist() == [0, 0, 0] and weights.tempered(np.zeros(3), 1.0).tolist() == [1, 1, 1]


def test_correlation_groups():
    corr = {("a", "b"): 0.99, ("a", "c"): 0.1, ("b", "c"): -0.2}
    assert weights.groups_of(["a", "b", "c"], corr, 0.9) == [["a", "b"], ["c"]]
    assert weights.group_weights(["a", "b", "c"], corr, 0.9) == {"a": 0.5, "b": 0.5, "c": 1.0}
    pick = weights.pick_across_groups(["a", "b", "c"], [["a", "b"], ["c"]], {"a": 0.5, "b": 0.5, "c": 1.0}, 2, np.random.default_rng(0))
    assert pick == ["a", "c"]


def test_spearman_is_rank_correlation(spark):
    rng = np.random.default_rng(1)
    x = rng.integers(0, 20, 200).astype(float)
    y = np.exp(x / 5) + rng.normal(size=200)
    got = weights.spearman(spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y)], "x double, y double"), ["x", "y"])

    def ranks(v):
        return np.array([(v < a).sum() + ((v == a).sum() + 1) / 2 for a in v])

    assert abs(got["x", "y"] - np.corrcoef(ranks(x), ranks(y))[0, 1]) < 1e-9


def test_detection(spark):
    rows = [(i, i % 7, float(i) + 0.5, bool(i % 2), "1.5" if i % 3 else "2.5", "k", str(i * 1.1)) for i in range(200)]
    df = spark.createDataFrame(rows, "user_id int, code int, temp double, flag boolean, two string, const string, amount string")
    got = profile.detect_types(df, df.columns)
    assert got == {"user_id": "numerical", "code": "categorical", "temp": "numerical", "flag": "categorical", "two": "categorical", "const": "categorical", "amount": "numerical"}
    with pytest.raises(TypeError):
        profile.detect_types(df.select(F.array("code").alias("a")), ["a"])


def test_rare_unseen_and_missing(spark):
    df = spark.createDataFrame([("Austin",)] * 5 + [("Paris",), ("Rome",), (None,)], "city string")
    kept = encode.kept_values(df, "city", 2)
    new = spark.createDataFrame([("Berlin",), ("Austin",), (None,)], "city string")
    assert [r[0] for r in encode.group_rare(new, "city", kept).collect()] in [[encode.RARE, "Austin", None], [encode.RARE, None, "Austin"], ["Austin", encode.RARE, None]] or {r[0] for r in encode.group_rare(new, "city", kept).collect()} == {encode.RARE, "Austin", None}
    codes = encode.category_codes(spark.createDataFrame([("a",), ("b",), ("c",), ("a",)], "c string"), "c")
    got = {r["c"]: r["c__code"] for r in encode.encode_category(spark.createDataFrame([("a",), ("z",), (None,)], "c string"), "c", codes).collect()}
    assert got == {"a": 0, "z": -1, None: -1}


def test_preprocessor(spark):
    df = spark.createDataFrame([(1, 1.0, "a"), (2, None, "b"), (3, 3.0, None)], "id int, x double, c string")
    p = encode.Preprocessor(["x"], ["c"], missing_indicators=True).fit(df)
    assert p.names() == ["x", "c=a", "c=b", "c=__missing__", "x__missing", "c__missing"]
    rows = {r["id"]: r for r in p.transform(df, ["id"]).collect()}
    assert rows[2]["x"] == 0.0 and rows[3]["c=__missing__"] == 1.0 and rows[2]["x__missing"] == 1.0


def test_identifiers_by_name(spark):
    rows = [(i, i, i % 40) for i in range(200)]
    got = profile.detect_types(spark.createDataFrame(rows, "userid int, itemidx int, level int"), ["userid", "itemidx", "level"])
    assert got["userid"] == got["itemidx"] == "numerical" and profile.classify("ItemID", "int", 200, 60, True, 0.0, profile.Detection()) == "numerical"


def test_density_of_weighted_points(spark):
    rng = np.random.default_rng(0)
    x = np.concatenate((rng.normal(-3, 0.5, 3000), rng.normal(3, 0.5, 3000)))
    v, n = cuts.weighted_points(spark.createDataFrame([(float(a),) for a in x], "x double"), "x")
    assert n.sum() == 6000 and abs((v * n).sum() / 6000 - x.mean()) < 1e-9
    got, how = cuts.density_cuts(v, 1, rng, n=n)
    assert how == "kde" and -1 < got[0] < 1 and cuts.weighted_points(spark.createDataFrame([(None,)], "x double"), "x")[0].size == 0


def test_codes_and_ranks_over_spans(spark, monkeypatch):
    monkeypatch.setattr(encode, "SPAN_VALUES", 7)
    monkeypatch.setattr(weights, "SPAN_VALUES", 7)
    df = spark.createDataFrame([(f"v{i % 50:02d}", float((i * 37) % 90) ** 3) for i in range(300)], "c string, x double")
    assert {r["value"]: r["code"] for r in encode.category_codes(df, "c").collect()} == {f"v{i:02d}": i for i in range(50)}
    x = np.array([r["x"] for r in df.collect()])
    got = {r["v"]: r["rank"] for r in weights.average_ranks(df, "x").collect()}
    assert got == {v: (x < v).sum() + ((x == v).sum() + 1) / 2 for v in set(x)}


def test_normaliser(spark):
    df = spark.createDataFrame([(i, str(i) if i % 4 else None, "a" if i < 8 else f"r{i}") for i in range(12)], "id int, n string, c string")
    t = encode.Normaliser({"n": "numerical", "c": "categorical"}, True, 3).fit(df)
    got = {r["id"]: r for r in t.transform(df, ["id"]).collect()}
    assert got[5]["n"] == 5.0 and got[0]["n"] is None and got[0]["n__missing"] == "1" and got[1]["n__missing"] == "0" and got[9]["c"] == encode.RARE and got[1]["c"] == "a" and "c__missing" not in got[0].asDict()
