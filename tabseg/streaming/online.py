"""Incremental fitting over micro-batches: running moments, drift tests, re-embedding, relabelling."""

from __future__ import annotations

import json
import math
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tabseg.functions.profile import kind_of, number
from tabseg.operators.segment import ForestSegmenter
from tabseg.session import shared_dir


@dataclass(frozen=True)
class Moments:
    """count, mean, sum of squared deviations and range of one column; merges with those of another batch."""

    count: int = 0
    mean: float = 0.0
    m2: float = 0.0
    low: float = math.inf
    high: float = -math.inf

    def merge(self, o: Moments) -> Moments:
        n = self.count + o.count
        if not o.count or not self.count:
            return o if o.count else self
        gap = o.mean - self.mean
        return Moments(n, self.mean + gap * o.count / n, self.m2 + o.m2 + gap * gap * self.count * o.count / n, min(self.low, o.low), max(self.high, o.high))

    @property
    def std(self) -> float:
        return math.sqrt(self.m2 / self.count) if self.count else 0.0


def moments(df: DataFrame, cols: list[str]) -> dict[str, Moments]:
    r = df.agg(*[f(number(c)).alias(f"{k}{i}") for i, c in enumerate(cols) for k, f in (("n", F.count), ("m", F.avg), ("v", F.var_pop), ("a", F.min), ("b", F.max))]).first()
    return {c: Moments(r[f"n{i}"], r[f"m{i}"], (r[f"v{i}"] or 0.0) * r[f"n{i}"], r[f"a{i}"], r[f"b{i}"]) if r[f"n{i}"] else Moments() for i, c in enumerate(cols)}


def drift(ref: Moments, new: Moments) -> float:
    """max(|change of mean|, |change of deviation|) over the reference deviation; 0 where the reference is constant or a side is empty."""
    if not ref.count or not new.count or ref.std == 0:
        return 0.0
    return max(abs(new.mean - ref.mean), abs(new.std - ref.std)) / ref.std


@dataclass
class OnlineSegmenter:
    """partial_fit: the first batch fits, later ones are embedded and appended; a rebuild draws new partitions.

    Moments and drift are those of all columns of numbers, also of those that the segmenter bins as categories (few values among many rows).

    strategy: 'drift' (rebuild when enough columns drifted), 'periodic' (after max_rows new rows) or 'never'. All state lies in
    `path` (a folder that outlives the session; by default one of the shared folder), by batch id: rows/batch=i, state/batch=i (the batch's
    moments and report) and model/i (specification, cells and labels). A batch that is repeated after a failure writes its own state again and is
    counted once; a new OnlineSegmenter over the same path goes on where the last one stopped. keep_rows: rebuilds and labels see only that many of
    the latest rows (None: all).
    """

    segmenter: ForestSegmenter
    id_col: str
    strategy: str = "drift"
    threshold: float = 0.3
    fraction: float = 0.3
    max_rows: int = 100_000
    keep_rows: int | None = None
    path: str | None = None
    batches: dict[int, dict] = field(default_factory=dict)  # by batch id: moments and report
    model_of: int | None = None  # the batch that fitted the model

    def partial_fit(self, batch: DataFrame, batch_id: int | None = None) -> dict:
        spark = batch.sparkSession
        self.path = self.path or f"{shared_dir(spark)}/tabseg-online-{uuid.uuid4().hex}"
        self._load(spark)
        batch_id = max(self.batches, default=-1) + 1 if batch_id is None else batch_id
        where = f"{self.path}/rows/batch={batch_id}"
        batch.write.mode("overwrite").parquet(where)
        batch = spark.read.parquet(where)
        done = self.batches.pop(batch_id, None)  # a repeated batch is judged as it was the first time
        first = self.model_of is None or self.model_of == batch_id and not self.batches
        if first:
            self._fit(spark, batch, batch_id)
        numeric = [c for c, k in self.segmenter.kinds.items() if k == "numerical" or kind_of(batch.schema[c].dataType) in ("int", "float")]
        now = moments(batch, numeric) if numeric else {}
        reference = self._merged(numeric, self.batches[self.model_of]["seen"] if not first and self.model_of in self.batches else [])
        found = {c: 0.0 if first else drift(reference[c], now[c]) for c in numeric}
        drifted = [c for c, x in found.items() if x > self.threshold]
        n = batch.count()
        since = 0 if first else n + sum(b["report"]["rows"] for i, b in self.batches.items() if i > self.model_of)
        rebuild = not first and ((self.strategy == "drift" and numeric and len(drifted) / len(numeric) >= self.fraction) or (self.strategy == "periodic" and since >= self.max_rows))
        rebuild = bool(rebuild) if done is None else done["report"]["rebuilt"]
        report = {"batch": batch_id, "rows": n, "drift": found, "drifted": drifted, "rebuilt": rebuild}
        state = {"moments": {c: [m.count, m.mean, m.m2, m.low, m.high] for c, m in now.items()}, "report": report, "seen": sorted({*self.batches, batch_id})}
        if rebuild:
            self.batches[batch_id] = state
            self.segmenter.seed = self.seed_ + self.rebuilds
            self.segmenter.spec = None
            self._fit(spark, self.stored(spark), batch_id)
        self.batches[batch_id] = state
        spark.createDataFrame([(json.dumps(state),)], "state string").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/state/batch={batch_id}")
        return report

    @property
    def reports(self) -> list[dict]:
        return [self.batches[i]["report"] for i in sorted(self.batches)]

    @property
    def rebuilds(self) -> int:
        return sum(b["report"]["rebuilt"] for b in self.batches.values())

    @property
    def running(self) -> dict[str, Moments]:
        """Moments of all batches, each counted once."""
        return self._merged(list(dict.fromkeys(c for i in sorted(self.batches) for c in self.batches[i]["moments"])), sorted(self.batches))

    def _merged(self, cols: list[str], batches: list[int]) -> dict[str, Moments]:
        out = {c: Moments() for c in cols}
        for i in batches:
            for c in cols:
                if i in self.batches and c in self.batches[i]["moments"]:
                    out[c] = out[c].merge(Moments(*self.batches[i]["moments"][c]))
        return out

    def _load(self, spark: SparkSession) -> None:
        """Take over what an earlier session left in the folder."""
        if self.batches or self.model_of is not None:
            return
        self.seed_ = self.segmenter.seed
        if not _exists(spark, f"{self.path}/state"):
            return
        for r in spark.read.option("basePath", f"{self.path}/state").parquet(f"{self.path}/state").collect():  # one row per batch
            self.batches[int(r["batch"])] = json.loads(r["state"])
        fitted = [i for i, b in self.batches.items() if b["report"]["rebuilt"] or i == min(self.batches)]
        if fitted:
            self.model_of = max(fitted)
            self.segmenter.restore(spark, f"{self.path}/model/{self.model_of}", self.id_col)

    def _fit(self, spark: SparkSession, df: DataFrame, batch_id: int) -> None:
        self.segmenter.fit(df, self.id_col, list(self.segmenter.kinds) or [c for c in df.columns if c not in (self.id_col, "batch")])
        self.segmenter.save(spark, f"{self.path}/model/{batch_id}")
        self.model_of = batch_id

    def stored(self, spark: SparkSession) -> DataFrame:
        """The rows seen so far, or the latest keep_rows of them: whole batches, and of the oldest one those with the largest ids."""
        rows = spark.read.option("basePath", f"{self.path}/rows").parquet(f"{self.path}/rows")
        if self.keep_rows is None:
            return rows.drop("batch")
        size = {int(r["batch"]): r["count"] for r in rows.groupBy("batch").count().collect()}  # one row per batch
        left, out = self.keep_rows, None
        for i in sorted(size, reverse=True):
            part = rows.where(F.col("batch") == i)
            part = part if size[i] <= left else part.orderBy(F.desc(self.id_col)).limit(left)
            out = part if out is None else out.unionByName(part)
            left -= min(size[i], left)
            if not left:
                break
        return out.drop("batch")

    def labels(self, spark: SparkSession) -> DataFrame:
        """Segments of all rows seen so far."""
        return self.segmenter.predict(self.stored(spark), self.id_col)

    def cells(self, spark: SparkSession) -> DataFrame:
        return self.segmenter.embed(self.stored(spark), self.id_col)


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def start(stream: DataFrame, online: OnlineSegmenter, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Feed a stream to partial_fit, batch by batch; a batch that is repeated after a failure overwrites its own rows."""
    w = stream.writeStream.foreachBatch(lambda df, i: None if df.isEmpty() else online.partial_fit(df, i)).option("checkpointLocation", checkpoint)
    return w.trigger(**(trigger or {"availableNow": True})).start()


def drift_by_batch(df: DataFrame, time: str, value: str, period: str = "day") -> DataFrame:
    """(batch, n, mean, std, drift): each period against the first one, as one plan."""
    x = df.select(F.date_trunc(period, F.col(time)).alias("batch"), number(value).alias("v")).where("batch IS NOT NULL AND v IS NOT NULL")
    per = x.groupBy("batch").agg(F.count("*").alias("n"), F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"))
    first = per.agg(F.min_by(F.struct("mean", "std"), "batch").alias("f")).select("f.mean", "f.std").toDF("m0", "s0")
    d = F.when(F.col("s0") > 0, F.greatest(F.abs(F.col("mean") - F.col("m0")), F.abs(F.col("std") - F.col("s0"))) / F.col("s0")).otherwise(0.0)
    return per.crossJoin(F.broadcast(first)).select("batch", "n", "mean", "std", d.alias("drift"))


def windowed_moments(stream: DataFrame, time: str, value: str, window: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Count, mean and deviation per event-time window; rows later than `late` are left out."""
    x = stream.select(F.col(time).cast("timestamp").alias("ts"), number(value).alias("v")).withWatermark("ts", late)
    return x.groupBy(F.window("ts", window)).agg(F.count("v").alias("n"), F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"))
