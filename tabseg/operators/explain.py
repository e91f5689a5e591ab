"""Explaining clusters: profiles, lifts, a label classifier with rejection, a surrogate tree and its rules."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tabseg.functions.encode import Preprocessor
from tabseg.functions.profile import number
from tabseg.operators import metrics
from tabseg.session import broadcast_if_small, hash32


def cluster_sizes(labels: DataFrame) -> DataFrame:
    n = labels.groupBy("label").agg(F.count("*").alias("size"))
    return n.crossJoin(F.broadcast(labels.agg(F.count("*").alias("total")))).select("label", "size", (F.col("size") / F.col("total")).alias("share"))


def numeric_profile(df: DataFrame, label: str, cols: list[str]) -> DataFrame:
    """(label, feature, mean, global_mean, difference, effect): effect is the difference over the sample deviation (0 if constant)."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), number(c).alias("x")) for c in cols]))
    x = df.select(F.col(label).alias("label"), pairs.alias("p")).where(F.col("p.x").isNotNull()).select("label", "p.feature", "p.x")
    per = x.groupBy("label", "feature").agg(F.avg("x").alias("mean"))
    whole = x.groupBy("feature").agg(F.avg("x").alias("global_mean"), F.stddev_samp("x").alias("s"))
    d = F.col("mean") - F.col("global_mean")
    return per.join(broadcast_if_small(whole), "feature").select("label", "feature", "mean", "global_mean", d.alias("difference"), F.when(F.col("s") > 0, d / F.col("s")).otherwise(0.0).alias("effect"))


def category_profile(df: DataFrame, label: str, cols: list[str], top: int = 3) -> DataFrame:
    """(label, feature, value, n, share, lift, rank): the most frequent values of each cluster, with lift over the whole."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("string").alias("v")) for c in cols]))
    x = df.select(F.col(label).alias("label"), pairs.alias("p")).where(F.col("p.v").isNotNull()).groupBy("label", "p.feature", F.col("p.v").alias("value")).agg(F.count("*").alias("n"))
    x = x.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("label", "feature")))
    whole = x.groupBy("feature", "value").agg(F.sum("n").alias("all")).withColumn("all_share", F.col("all") / F.sum("all").over(Window.partitionBy("feature")))
    w = Window.partitionBy("label", "feature").orderBy(F.desc("n"), "value")
    y = x.join(whole, ["feature", "value"]).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)
    return y.select("label", "feature", "value", "n", "share", (F.col("share") / F.col("all_share")).alias("lift"), "rank")


def cards(df: DataFrame, label: str, numeric: list[str], categorical: list[str], top: int = 3) -> DataFrame:
    """(label, size, text): what sets each cluster apart, in words."""
    sizes = cluster_sizes(df.select(F.col(label).alias("label")))
    n = numeric_profile(df, label, numeric)
    w = Window.partitionBy("label").orderBy(F.desc(F.abs("effect")), "feature")
    n = n.withColumn("r", F.row_number().over(w)).where(F.col("r") <= top)
    told = F.format_string("%s %s (%.2f against %.2f)", F.when(F.col("effect") >= 0, "high").otherwise("low"), "feature", "mean", "global_mean")
    a = n.groupBy("label").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", told.alias("t")))), lambda s: s["t"]), "; ").alias("numbers"))
    c = category_profile(df, label, categorical, 1) if categorical else None
    out = sizes.join(a, "label", "left")
    if c is not None:
        b = c.groupBy("label").agg(F.array_join(F.array_sort(F.collect_list(F.format_string("%s=%s (%.0f %%)", "feature", "value", F.col("share") * 100))), "; ").alias("values"))
        out = out.join(b, "label", "left")
    else:
        out = out.withColumn("values", F.lit(None).cast("string"))
    return out.select("label", "size", F.concat_ws("; ", F.format_string("%d rows (%.1f %%)", "size", F.col("share") * 100), "numbers", "values").alias("text"))


def _vectors(df: DataFrame, prep: Preprocessor, keep: list[Column]) -> DataFrame:
    from pyspark.ml.feature import VectorAssembler

    x = df.select(*keep, *[c.alias(f"__f{i}") for i, c in enumerate(_unaliased(prep))])
    return VectorAssembler(inputCols=[f"__f{i}" for i in range(len(prep.names()))], outputCol="features").transform(x)


def _unaliased(prep: Preprocessor) -> list[Column]:
    return prep.columns()


def balanced(labelled: DataFrame) -> DataFrame:
    """Adds `weight`, rows / (classes x rows of the class)."""
    n = labelled.groupBy("label").agg(F.count("*").alias("n_class"))
    whole = n.agg(F.sum("n_class").alias("n_all"), F.count("*").alias("k"))
    w = n.crossJoin(F.broadcast(whole)).select("label", (F.col("n_all") / (F.col("k") * F.col("n_class"))).alias("weight"))
    return labelled.join(broadcast_if_small(w), "label")


@dataclass
class LabelClassifier:
    """A random forest that predicts cluster labels for new rows; uncertain ones get -1."""

    numeric: list[str]
    categorical: list[str]
    trees: int = 50
    depth: int = 10
    seed: int = 42
    reject_below: float = 0.0
    calibrate: bool = False  # logistic calibration of the forest's probabilities, on rows the forest has not seen

    def _forest(self):
        from pyspark.ml.classification import RandomForestClassifier

        return RandomForestClassifier(numTrees=self.trees, maxDepth=self.depth, seed=self.seed, labelCol="label", weightCol="weight", featuresCol="features")

    def fit(self, df: DataFrame, label: str) -> LabelClassifier:
        self.prep = Preprocessor(self.numeric, self.categorical).fit(df)
        x = balanced(_vectors(df, self.prep, [F.col(label).cast("double").alias("label")]).where(F.col("label") >= 0))
        if self.calibrate:
            from pyspark.ml.classification import LogisticRegression
            from pyspark.ml.functions import vector_to_array

            held = F.pmod(F.xxhash64(vector_to_array("features"), F.lit(self.seed)), F.lit(3)) == 0
            scored = self._forest().fit(x.where(~held)).transform(x.where(held)).select("label", F.col("probability").alias("features"))
            self.calibrator = LogisticRegression(featuresCol="features", labelCol="label", regParam=1e-3, probabilityCol="calibrated", rawPredictionCol="calibrated_raw", predictionCol="calibrated_label").fit(scored)
        self.model = self._forest().fit(x)
        return self

    def predict(self, df: DataFrame, id_col: str) -> DataFrame:
        """(id, label, confidence)."""
        from pyspark.ml.functions import vector_to_array

        p = self.model.transform(_vectors(df, self.prep, [F.col(id_col).alias("id")]))
        if self.calibrate:
            p = self.calibrator.transform(p.select("id", F.col("probability").alias("features"))).select("id", F.col("calibrated").alias("probability"), F.col("calibrated_label").alias("prediction"))
        p = p.withColumn("confidence", F.array_max(vector_to_array("probability")))
        return p.select("id", F.when(F.col("confidence") >= self.reject_below, F.col("prediction").cast("int")).otherwise(-1).alias("label"), "confidence")

    def cross_validate(self, df: DataFrame, id_col: str, label: str, folds: int = 3) -> DataFrame:
        """Fidelity on held-out folds; folds are dealt by hash order within the label, at most as many as the smallest cluster has rows."""
        smallest = df.groupBy(label).agg(F.count("*").alias("n")).agg(F.min("n")).first()[0] or 0
        folds = min(folds, smallest)
        x = df.withColumn("__fold", F.pmod(hash32(F.col(id_col), f"fold:{self.seed}"), F.lit(max(folds, 1))))
        if folds < 2:
            got = self.fit(df, label).predict(df, id_col).withColumnRenamed("label", "said")
        else:
            got = None
            for f in range(folds):
                part = LabelClassifier(self.numeric, self.categorical, self.trees, self.depth, self.seed).fit(x.where(F.col("__fold") != f), label).predict(x.where(F.col("__fold") == f), id_col)
                got = part if got is None else got.unionByName(part)
            got = got.withColumnRenamed("label", "said")
        joined = df.select(F.col(id_col).alias("id"), F.col(label).cast("int").alias("truth")).join(got, "id")
        return metrics.fidelity(joined, "truth", "said")

    def importances(self) -> list[tuple[str, float]]:
        return sorted(zip(self.prep.names(), map(float, self.model.featureImportances.toArray())), key=lambda x: (-x[1], x[0]))


@dataclass
class SurrogateTree:
    """A shallow tree that imitates the labels, and its leaves as rules."""

    numeric: list[str]
    categorical: list[str]
    depth: int = 4
    min_leaf: int = 10
    seed: int = 42

    def fit(self, df: DataFrame, label: str) -> SurrogateTree:
        from pyspark.ml.classification import DecisionTreeClassifier

        self.prep = Preprocessor(self.numeric, self.categorical).fit(df)
        x = balanced(_vectors(df, self.prep, [F.col(label).cast("double").alias("label")]))
        self.model = DecisionTreeClassifier(maxDepth=self.depth, minInstancesPerNode=self.min_leaf, seed=self.seed, labelCol="label", weightCol="weight", featuresCol="features").fit(x)
        self.fidelity_ = metrics.fidelity(self.model.transform(x).select(F.col("label").cast("int").alias("a"), F.col("prediction").cast("int").alias("b")), "a", "b")
        return self

    def rules(self) -> list[tuple[int, float, int, str]]:
        """(label, purity by class-weighted counts, rows, rule) of every leaf; thresholds are given in the features' own units."""
        out = []
        names = self.prep.names()

        def own(i: int, t: float) -> float:
            if i < len(self.numeric):
                m, s = self.prep.centre[self.numeric[i]]
                return t * s + m
            return t

        def walk(node, path: list[str]) -> None:
            if node.subtreeDepth() == 0:
                stats = list(node.impurityStats().stats())
                total = sum(stats)
                out.append((int(node.prediction()), max(stats) / total if total else 0.0, int(node.impurityStats().rawCount()), " and ".join(path) or "all"))
                return
            s = node.split()
            i = s.featureIndex()
            t = own(i, s.threshold())
            if i < len(self.numeric):
                a, b = f"{names[i]} <= {t:.6g}", f"{names[i]} > {t:.6g}"
            else:
                col, _, v = names[i].partition("=")
                a, b = f"{col} != {v}", f"{col} = {v}"
            walk(node.leftChild(), [*path, a])
            walk(node.rightChild(), [*path, b])

        walk(self.model._call_java("rootNode"), [])
        return out
