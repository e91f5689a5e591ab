import math

from tabseg.operators.segment import ForestSegmenter
from tabseg.streaming import online


def test_chan_merge_and_drift(spark):
    a = online.moments(spark.createDataFrame([(0.0,), (0.0,), (100.0,)], "x double"), ["x"])["x"]
    b = online.moments(spark.createDataFrame([(20.0,), (40.0,)], "x double"), ["x"])["x"]
    m = a.merge(b)
    assert m.count == 5 and math.isclose(m.mean, 32) and math.isclose(m.m2, 6880) and math.isclose(m.std, 37.094474, rel_tol=1e-6)
    rows = spark.createDataFrame([(float(i),) for i in range(1, 9)], "x double")
    ref = online.moments(rows, ["x"])["x"]
    far = online.moments(rows.selectExpr("x + 100 AS x"), ["x"])["x"]
    assert math.isclose(online.drift(ref, far), 43.643578, rel_tol=1e-6) and online.drift(ref, ref) == 0 and online.drift(online.Moments(), ref) == 0


def test_partial_fit_rebuilds_on_drift_only(spark):
    def batch(lo, shift):
        return spark.createDataFrame([(lo + i, float(i % 17) + shift, "ab"[i % 2]) for i in range(60)], "id bigint, x double, c string")

    o = online.OnlineSegmenter(ForestSegmenter(n_iterations=6, n_clusters=2), "id")
    assert not o.partial_fit(batch(0, 0.0))["rebuilt"] and not o.partial_fit(batch(100, 0.0))["rebuilt"]
    assert o.partial_fit(batch(200, 50.0))["rebuilt"] and o.rebuilds == 1
    assert o.labels(spark).count() == 180 and o.running["x"].count == 180


def test_numbers_of_few_values_have_moments_and_drift(spark):
    """Five values among 200 rows count as categories for the partitions; their mean still moves."""

    def batch(lo, shift):
        return spark.createDataFrame([(lo + i, float(i % 5) + shift, "ab"[i % 2]) for i in range(200)], "id bigint, x double, c string")

    o = online.OnlineSegmenter(ForestSegmenter(n_iterations=4, n_clusters=2, clusterer="agglomerative"), "id")
    assert not o.partial_fit(batch(0, 0.0))["rebuilt"] and o.segmenter.kinds["x"] == "categorical"
    assert not o.partial_fit(batch(200, 0.0))["rebuilt"] and o.partial_fit(batch(400, 50.0))["rebuilt"]
    assert o.running["x"].count == 600 and math.isclose(o.running["x"].mean, 2 + 50 / 3) and o.running.keys() == {"x"}


def test_stream(spark, tmp_path):
    spark.createDataFrame([(i, float(i % 5)) for i in range(30)], "id bigint, x double").write.parquet(str(tmp_path / "in"))
    o = online.OnlineSegmenter(ForestSegmenter(n_iterations=4, n_clusters=2), "id", "never")
    stream = spark.readStream.schema("id bigint, x double").parquet(str(tmp_path / "in"))
    online.start(stream, o, str(tmp_path / "state")).awaitTermination()
    assert o.stored(spark).count() == 30 and len(o.reports) == 1


def test_repeat_and_restart(spark, tmp_path):
    """A batch that is delivered twice counts once; a stopped stream goes on with the model it had."""

    def write(k):
        spark.createDataFrame([(k * 100 + i, float(i % 5) + 40 * (i % 2)) for i in range(30)], "id bigint, x double").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    def run():
        o = online.OnlineSegmenter(ForestSegmenter(n_iterations=4, n_clusters=2, clusterer="agglomerative"), "id", "never", path=str(tmp_path / "online"))
        stream = spark.readStream.schema("id bigint, x double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        online.start(stream, o, str(tmp_path / "state")).awaitTermination()
        return o

    write(0)
    first = run()
    edges = first.segmenter.spec.edges
    write(1)
    second = run()
    assert sorted(second.batches) == [0, 1] and second.segmenter.spec.edges == edges and second.running["x"].count == 60
    again = spark.createDataFrame([(100 + i, float(i % 5) + 40 * (i % 2)) for i in range(30)], "id bigint, x double")
    assert second.partial_fit(again, 1)["rows"] == 30 and second.running["x"].count == 60 and second.stored(spark).count() == 60
    assert {r["id"] % 2: r["label"] for r in second.labels(spark).collect()}.keys() == {0, 1} and second.labels(spark).select("label").distinct().count() == 2
