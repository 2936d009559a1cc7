"""User-defined segment features that read a segment batch by batch: a table function over an ordered segment.

``eval`` gets the next rows of the running segment, ``terminate`` puts out one row for it.  What is held is the state of
the features, whatever the length of the segment.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.functions import arrow_udtf

# Workers get this module with the job and need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


class RunningFeature(Protocol):
    def add(self, values: np.ndarray) -> None: ...

    def result(self) -> float | None: ...


class Energy:
    def __init__(self):
        self.total = 0.0

    def add(self, values: np.ndarray) -> None:
        self.total += float((values * values).sum())

    def result(self) -> float:
        return self.total


class Peak:
    def __init__(self):
        self.top: float | None = None

    def add(self, values: np.ndarray) -> None:
        top = float(np.abs(values).max())
        self.top = top if self.top is None else max(self.top, top)

    def result(self) -> float | None:
        return self.top


class Crossings:
    """How often the signal changes its sign; zeros take the sign before them."""

    def __init__(self):
        self.sign, self.count = 0.0, 0

    def add(self, values: np.ndarray) -> None:
        signs = np.sign(values)
        signs = np.concatenate([[self.sign], signs[signs != 0]]) if self.sign else signs[signs != 0]
        self.count += int((signs[1:] != signs[:-1]).sum())
        self.sign = float(signs[-1]) if len(signs) else self.sign

    def result(self) -> float:
        return float(self.count)


class Travel:
    """Sum of the absolute steps from row to row."""

    def __init__(self):
        self.last: float | None = None
        self.total = 0.0

    def add(self, values: np.ndarray) -> None:
        steps = values if self.last is None else np.concatenate([[self.last], values])
        self.total += float(np.abs(np.diff(steps)).sum())
        self.last = float(values[-1])

    def result(self) -> float:
        return self.total


FEATURES: dict[str, Callable[[], RunningFeature]] = {"energy": Energy, "peak": Peak, "crossings": Crossings, "travel": Travel}


def feature_function(features: dict[str, Callable[[], RunningFeature]] | None = None, key: str = "long"):
    """The table function ``(table of key, no, x) -> key, n, target, features``; ``x`` without NULLs is given to the features."""
    made = dict(features or FEATURES)
    names = list(made)
    key_type = {"long": pa.int64(), "bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[key]

    @arrow_udtf(returnType=f"seg {key}, n long, " + ", ".join(f"`{n}` double" for n in names))
    class SegmentFeatures:
        def __init__(self):
            self.seg, self.n, self.features = None, 0, {n: f() for n, f in made.items()}

        def eval(self, rows: pa.RecordBatch) -> Iterator[pa.Table]:
            if rows.num_rows:
                self.seg = rows.column(0)[0].as_py()
                self.n += rows.num_rows
                values = rows.column(2).drop_null().to_numpy(zero_copy_only=False).astype(float)
                if len(values):
                    for feature in self.features.values():
                        feature.add(values)
            return iter(())

        def terminate(self) -> Iterator[pa.Table]:
            if self.n:
                yield pa.table(
                    [pa.array([self.seg], key_type), pa.array([self.n], pa.int64()),
                     *(pa.array([f.result()], pa.float64()) for f in self.features.values())],
                    names=["seg", "n", *names],
                )

    return SegmentFeatures


def register_features(spark: SparkSession, name: str = "segment_features", features=None, key: str = "long") -> None:
    """For SQL: ``SELECT * FROM segment_features(TABLE(SELECT seg, no, x FROM t) PARTITION BY seg ORDER BY no)``."""
    spark.udtf.register(name, feature_function(features, key))


def running_features(df: DataFrame, features=None, key: str = "seg", value: str = "x", no: str = "no") -> DataFrame:
    """``seg, n`` and the named features of every segment; its rows are read in the order of their position."""
    function = feature_function(features, df.schema[key].dataType.simpleString())
    ordered = df.selectExpr(f"`{key}` AS seg", f"`{no}` AS no", f"CAST(`{value}` AS double) AS x")
    out = function(ordered.asTable().partitionBy("seg").orderBy("no"))
    return out if key == "seg" else out.withColumnRenamed("seg", key)

