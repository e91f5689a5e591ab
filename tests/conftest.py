import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"
os.environ.setdefault("PYSPARK_PYTHON", sys.executable)

DATA = Path("/root/testdata")


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]").appName("tests")
        .config("spark.sql.shuffle.partitions", "4").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.driver.memory", "4g").config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def edges(spark, tmp_path_factory):
    """Two copies of the smallest tables: without rows, and with nulls, repeated rows and extra columns whose names clash with inner ones."""
    from pyspark.sql import functions as F

    empty, odd = tmp_path_factory.mktemp("empty"), tmp_path_factory.mktemp("odd")
    fixed = {"ports", "column_meta", "bin_specs", "exemplars", "source_targets"}
    keep = {"row_id", "doc_id", "report_id"}
    for p in sorted((DATA / "sf0.001").glob("*.parquet")):
        t = spark.read.parquet(str(p))
        (t if p.stem in fixed else t.limit(0)).write.parquet(str(empty / p.name))
        if p.stem in ("titanic", "mixed_rows", "documents", "compression_reports"):
            some = t.limit(60)
            out = some.unionByName(some.limit(10))
            key = next(c for c in t.columns if c in keep)
            for i, c in enumerate(t.columns):
                if c not in keep and c != "is_probe":
                    out = out.withColumn(c, F.when((F.col(key) + i) % 7 == 0, None).otherwise(F.col(c)))
            for c in ("id", "v", "g", "key", "tokens", "label", "n", "port", "__key", "grp", "combo", "bucket", "z0", "__text"):
                out = out.withColumn(c, F.lit("clash"))
            out.coalesce(2).write.parquet(str(odd / p.name))
        else:
            t.write.parquet(str(odd / p.name))
    return {"empty": str(empty), "odd": str(odd)}
