"""Statistics of segments that arrive in pieces, over any number of files and micro-batches.

Every task sums up its rows by segment (moments and a quantile sketch), so that one row for a task and segment is
shuffled; the state of a segment is the same summary, merged as pieces arrive.  A segment is put out, and its state
dropped, when all its rows have come; what is still open can be read from the state store.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from wavecut.functions import summaries
from wavecut.functions.summaries import Moments, QuantileSketch
from wavecut.operators.stats import FIVE_POINT

# Workers get these modules with the job and need no copy of the package.
for _module in (summaries, sys.modules[__name__]):
    cloudpickle.register_pickle_by_value(_module)

SUMMARY = "n long, x array<double>, xa array<double>, items array<double>, lengths array<int>, error long"
STATS = [f"{p}_{s}" for p in ("x", "xa") for s in ("avg", "std", "skew", "kurt", "max")]
QUANTILES = [f"{p}_{s}" for p in ("x", "xa") for s in FIVE_POINT]
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class SegmentSummary:
    """What is known of a segment: moments of the signal and of its absolute value, and the sketch."""

    def __init__(self, size: int, x: Moments | None = None, xa: Moments | None = None, sketch: QuantileSketch | None = None):
        self.x, self.xa, self.sketch = x or Moments(), xa or Moments(), sketch or QuantileSketch(size)

    def add(self, values: np.ndarray) -> None:
        self.x, self.xa = self.x.merge(Moments.of(values)), self.xa.merge(Moments.of(np.abs(values)))
        self.sketch.add(values)

    def merge(self, other: SegmentSummary) -> None:
        self.x, self.xa = self.x.merge(other.x), self.xa.merge(other.xa)
        self.sketch.merge(other.sketch)

    def fields(self) -> tuple:
        items, lengths = self.sketch.state()
        return self.x.n, self.x.state(), self.xa.state(), items, lengths, self.sketch.error

    @classmethod
    def restore(cls, size: int, n: int, x, xa, items, lengths, error) -> SegmentSummary:
        return cls(size, Moments(int(n), *x), Moments(int(n), *xa), QuantileSketch.restore(size, items, lengths, error))

    def row(self) -> list:
        fractions = list(FIVE_POINT.values())
        both = [self.sketch.quantiles(fractions, absolute) for absolute in (False, True)]
        return [self.x.n, *self.x.stats(), *self.xa.stats(), *both[0], *both[1], self.sketch.error]


def result_schema(key: T.StructField) -> T.StructType:
    doubles = [T.StructField(c, T.DoubleType()) for c in (*STATS, *QUANTILES)]
    return T.StructType([key, T.StructField("n", T.LongType()), *doubles, T.StructField("rank_error", T.LongType())])


def summed_rows(rows: DataFrame, key: str, value: str, size: int, held: int = 256) -> DataFrame:
    """One summary for each task and segment (or more, beyond ``held`` open segments); NULL values count in no statistic."""
    field = rows.schema[key]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: dict = {}
        names = [field.name, "rows", *(c.split()[0] for c in SUMMARY.split(", "))]

        def flushed() -> pd.DataFrame:
            return pd.DataFrame([(k, count, *s.fields()) for k, (count, s) in found.items()], columns=names)

        for frame in frames:
            for k, values in frame.groupby(field.name, sort=False)[value]:
                if k not in found:
                    if len(found) >= held:
                        yield flushed()
                        found = {}
                    found[k] = [0, SegmentSummary(size)]
                found[k][0] += len(values)
                found[k][1].add(values.dropna().to_numpy(dtype=float))
        if found:
            yield flushed()

    return rows.select(key, F.col(value).cast("double").alias(value)).mapInPandas(run, f"`{key}` {field.dataType.simpleString()}, rows long, {SUMMARY}")


class SegmentProcessor(StatefulProcessor):
    """Merges the summaries of a segment into its state; emits a complete segment and drops its state."""

    def __init__(self, seg_len: int, size: int, columns: list[str]):
        self.seg_len, self.size, self.columns = seg_len, size, columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.open = handle.getValueState("open", f"rows long, {SUMMARY}")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        count, summary = 0, SegmentSummary(self.size)
        if self.open.exists():
            count, *kept = self.open.get()
            summary = SegmentSummary.restore(self.size, *kept)
        for frame in rows:
            for piece in frame.itertuples(index=False):
                count += piece.rows
                summary.merge(SegmentSummary.restore(self.size, piece.n, piece.x, piece.xa, piece.items, piece.lengths, piece.error))
        if count > self.seg_len:
            raise ValueError(f"segment {key[0]} has {count} rows, not {self.seg_len}")
        if count == self.seg_len:
            self.open.clear()
            yield pd.DataFrame([[key[0], *summary.row()]], columns=self.columns)
        else:
            self.open.update((count, *summary.fields()))
            yield pd.DataFrame(columns=self.columns)

    def close(self) -> None:
        pass


def stateful_stats(rows: DataFrame, seg_len: int, key: str = "seg", value: str = "x", size: int = 2048) -> DataFrame:
    """``key, n, 20 statistics, rank_error`` of every segment as soon as its ``seg_len`` rows have come.

    Moments are exact; a quantile's rank is off by ``rank_error`` rows at most (twice that for absolute values), and by
    none while a segment has no more than ``size`` rows.  NULL values are skipped in the statistics and count as rows.
    A micro-batch that takes a segment past its length fails the query with its name; rows that come later still, when the
    state is gone, open the segment anew.
    """
    schema = result_schema(rows.schema[key])
    return summed_rows(rows, key, value, size).groupBy(key).transformWithStateInPandas(
        SegmentProcessor(seg_len, size, schema.names), outputStructType=schema, outputMode="Append", timeMode="None"
    )


def run_stateful(stats: DataFrame, out: str, checkpoint: str) -> None:
    """Processes all files there are and stops; a later call with the same checkpoint goes on with the open segments."""
    conf = stats.sparkSession.conf
    before = conf.get(PROVIDER, None)
    conf.set(PROVIDER, ROCKSDB)
    try:
        query = (
            stats.writeStream.format("parquet").outputMode("append").option("path", out)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        )
        query.awaitTermination()
    finally:
        conf.set(PROVIDER, before) if before else conf.unset(PROVIDER)


def open_state(spark: SparkSession, checkpoint: str, key: str = "seg") -> DataFrame:
    """The state of the segments that are not complete: ``key, rows`` and the summary."""
    state = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", "open").load()
    return state.select(F.col(f"key.{key}").alias(key), "value.*")


def open_segments(spark: SparkSession, checkpoint: str, key: str = "seg", size: int = 2048) -> DataFrame:
    """Statistics of the segments still open, such as the partial last one, in the columns of ``stateful_stats``."""
    state = open_state(spark, checkpoint, key)
    schema = result_schema(state.schema[key])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [
                [getattr(r, key), *SegmentSummary.restore(size, r.n, r.x, r.xa, r.items, r.lengths, r.error).row()]
                for r in frame.itertuples(index=False)
            ]
            yield pd.DataFrame(rows, columns=schema.names)

    return state.mapInPandas(run, schema)
