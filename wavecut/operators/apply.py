"""User-defined per-segment features over Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wavecut.operators.segments import KEYS

FeatureFunction = Callable[[np.ndarray], Mapping[str, float]]


def segment_apply(
    df: DataFrame, features: FeatureFunction, names: Sequence[str], keys: Sequence[str] = KEYS, value: str = "x",
    target: str = "y", chunk_rows: int | None = None, max_len: int = 10_000_000,
) -> DataFrame:
    """One row per segment: keys, chunk, the target on its last row, and the named features.

    ``features`` gets the values of the whole segment in position order.  ``chunk_rows`` asks for
    one row per so many rows of a segment instead (``chunk`` 0, 1, ...).  What is handed to one task
    is bounded: a position past ``max_len`` fails the job if no chunks are asked for.
    """
    key_fields = [df.schema[k] for k in keys]
    schema = T.StructType(
        [*key_fields, T.StructField("chunk", T.LongType()), T.StructField("target", T.DoubleType())]
        + [T.StructField(n, T.DoubleType()) for n in names]
    )

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ordered = pdf.sort_values("no")
        values = features(ordered["_x"].to_numpy(dtype=float))
        row = {k: ordered[k].iloc[0] for k in (*keys, "chunk")}
        row["target"] = ordered["_y"].iloc[-1]
        row.update({n: values[n] for n in names})
        return pd.DataFrame([row])

    if chunk_rows is None:
        said = F.concat(F.lit("position "), F.col("no").cast("string"), F.lit(f" is past max_len={max_len}; give chunk_rows"))
        chunk = F.coalesce(F.when(F.col("no") <= max_len, F.lit(0)), F.raise_error(said).cast("int")).cast("bigint")
    else:
        chunk = F.floor((F.col("no") - 1) / chunk_rows)
    rows = df.select(
        *keys, "no", chunk.alias("chunk"),
        F.col(value).cast("double").alias("_x"), F.col(target).cast("double").alias("_y"),
    )
    return rows.groupBy(*keys, "chunk").applyInPandas(run, schema)
