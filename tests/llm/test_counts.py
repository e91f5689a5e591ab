from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from tabseg.llm import frequency, mix, percentiles
from tabseg.session import materialise


def test_trie_bursts_and_keeps_counts():
    rng = np.random.default_rng(0)
    words = ["".join(rng.choice(list("ab"), rng.integers(0, 12))) for _ in range(5000)]
    t = frequency.BurstTrie(8)
    for w in words:
        t.add(w, 2, 1)
    got = {p + s: c for p, held in t.subtrees() for s, c in held.items()}
    assert {k: v[1] for k, v in got.items()} == dict(Counter(words)) and t.terms == len(got) and isinstance(t.root, frequency.Node)


def test_subtrees_merge_to_the_same_counts():
    rng = np.random.default_rng(7)
    words = ["".join(rng.choice(list("abc"), rng.integers(0, 9))) for _ in range(6000)]
    whole = frequency.BurstTrie(16)
    for i, size in enumerate((4, 64, 16)):  # tries of other depths
        part = frequency.BurstTrie(size)
        for w in words[i::3]:
            part.add(w, 2, 1)
        for prefix, counts in part.subtrees():
            whole.graft(prefix, counts)
    got = {p + s: c for p, held in whole.subtrees() for s, c in held.items()}
    assert {k: v[1] for k, v in got.items()} == dict(Counter(words)) and whole.terms == len(got)


def test_counts_equal_brute_force_over_routes(spark):
    rng = np.random.default_rng(1)
    rows = [("c" if i % 3 else "d", "hot" if i % 3 == 1 else f"common-prefix-{rng.integers(0, 300)}", str(rng.integers(0, 200))) for i in range(6000)] + [("c", None, "1"), ("c", "alone", None), ("c", "", "1")]
    df = spark.createDataFrame(rows, "col string, val string, record string")
    occ, rec = Counter(), defaultdict(set)
    for c, v, r in rows:
        if v is not None:
            occ[c, v] += 1
            rec[c, v] |= {r} - {None}
    for limit in (200_000, 40):
        got = frequency.count_values(df, limit).collect()
        assert len(got) == len(occ) and all((r["occurrences"], r["records"]) == (occ[r["col"], r["val"]], len(rec[r["col"], r["val"]])) for r in got)
    assert frequency.count_values(df.limit(0)).count() == 0
    assert {r["col"]: r["total"] for r in frequency.stated_records(df).collect()} == {c: len(set().union(*[v for (d, _), v in rec.items() if d == c])) for c in "cd"}


def test_marks(spark):
    counts = spark.createDataFrame([("c", "a", 9, 9), ("c", "b", 1, 1), ("c", "m", 4, 4)], "col string, val string, occurrences bigint, records bigint")
    totals, limits = spark.createDataFrame([("c", 10)], "col string, total bigint"), spark.createDataFrame([("c", 2, 0.5)], "col string, min_records int, max_share double")
    assert {(r["val"], r["mark"]) for r in frequency.mark_values(counts, totals, limits).collect()} == {("a", "common"), ("b", "rare"), ("m", None)}


def test_percentiles_equal_sorting_and_combine(spark):
    rng = np.random.default_rng(2)
    groups = {"normal": rng.normal(size=1500), "wide": np.exp(rng.normal(size=400) * 100), "ties": np.repeat([1.0, 2.0], [100, 1]), "one": np.array([3.0]), "huge": np.array([-1.7e308, 1.7e308, 0.0]), "tiny": np.array([5e-324, -5e-324, 0.0])}
    rows = [(g, float(v), i % 3) for g, x in groups.items() for i, v in enumerate(x)]
    df = spark.createDataFrame(rows + [(None, 1.0, 0), ("ties", float("nan"), 0), ("ties", float("inf"), 1), ("none", None, 1)], "grp string, v double, day int")
    parts = [percentiles.value_counts(df.where(F.col("day") == k), F.col("grp"), F.col("v")) for k in range(3)]
    pcts = [1, 5, 25, 50, 75, 95, 99, 100]
    got = {(r["grp"], r["pct"]): r["value"] for r in percentiles.percentiles(materialise(percentiles.combine(*parts)), pcts).collect()}
    assert set(got) == {(g, p) for g in groups for p in pcts}
    for (g, p), v in got.items():
        x = np.sort(groups[g])
        assert v == x[-(-p * len(x) // 100) - 1], (g, p)
    assert percentiles.percentiles(percentiles.value_counts(df.limit(0), F.col("grp"), F.col("v")), pcts).count() == 0


def test_edges_not_above(spark):
    specs = spark.createDataFrame([("t", "c", [1.0, 2.0, 3.0]), ("t", "x", None)], "table_name string, col_name string, edges array<double>")
    values = spark.createDataFrame([("t", "c", v) for v in (0.5, 1.0, 2.5, 9.0)], "table_name string, col_name string, value double")
    assert sorted((r["value"], r["bin_no"]) for r in percentiles.place_in_edges(values, specs).collect()) == [(0.5, 0), (1.0, 1), (2.5, 2), (9.0, 3)]


def test_mixture_reaches_shares(spark):
    rng = np.random.default_rng(3)
    sized = materialise(spark.createDataFrame([(i, "abc"[i % 3 if i % 2 else 0], int(rng.integers(1, 100))) for i in range(900)], "doc_id bigint, key string, tokens bigint"))
    targets = spark.createDataFrame([("A ", 0.3, 3), ("b", 0.3, 5), ("c", 0.4, 1), ("none", 0.0, 2)], "source string, target_share double, max_repeats int")
    a = materialise(mix.allocate(sized, targets))
    own = {r["key"]: r["t"] for r in sized.groupBy("key").agg(F.sum("tokens").alias("t")).collect()}
    total = sum(own.values())
    rows = {r["key"]: r for r in a.collect()}
    assert rows["c"]["short"] == (own["c"] < 0.4 * total) and rows["none"]["own_tokens"] == 0 and not rows["none"]["short"]
    d = materialise(mix.draw(sized, a))
    got = {r["key"]: r["t"] for r in d.groupBy("key").agg(F.sum(F.col("copies") * F.col("tokens")).alias("t")).collect()}
    for key, share, most in (("a", 0.3, 3), ("b", 0.3, 5), ("c", 0.4, 1)):
        assert abs(got[key] - min(share * total, most * own[key])) <= 60
        assert d.where(F.col("key") == key).agg(F.max("copies")).first()[0] <= most
    assert d.count() == 900 and abs(sum(r["actual_share"] for r in mix.shares(a, d).collect()) - 1) < 1e-9
    again = {r["doc_id"]: r["copies"] for r in mix.draw(sized.repartition(7), a).collect()}
    assert again == {r["doc_id"]: r["copies"] for r in d.collect()}
