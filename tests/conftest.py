import os
import sys
import tempfile

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    work = tempfile.mkdtemp(prefix="run-")
    session = (
        SparkSession.builder.master("local[8]")
        .appName("tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "6g")
        .config("spark.sql.warehouse.dir", f"{work}/warehouse")
        .config("spark.checkpoint.dir", f"{work}/shared")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture()
def scratch():
    return tempfile.mkdtemp(prefix="run-")


@pytest.fixture(scope="session")
def segment_frame(spark):
    """Builds ``seg, no, x, y`` rows from lists of values, in shuffled order."""

    def build(*segments, y=None):
        rows = [
            (s, i + 1, float(v), float(y[s][i]) if y else float(len(values) - i))
            for s, values in enumerate(segments)
            for i, v in enumerate(values)
        ]
        rows = sorted(rows, key=lambda r: hash((r[1] * 7919 + r[0]) % 101))
        return spark.createDataFrame(rows, "seg long, no long, x double, y double").repartition(5)

    return build


@pytest.fixture(scope="session")
def plan_text():
    def text(df):
        return df._jdf.queryExecution().executedPlan().toString()

    return text
