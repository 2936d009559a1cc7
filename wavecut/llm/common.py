"""Folders, written tables and hashing shared by the operators of this package."""

from __future__ import annotations

import os
import uuid

import numpy as np
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession

from wavecut.sources.storage import shared_folder

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
MASK64 = (1 << 64) - 1


def ship_path(spark: SparkSession) -> None:
    """Lets Python workers import this package when the session was started from elsewhere."""
    env = spark.sparkContext.environment
    paths = env.get("PYTHONPATH", "")
    if ROOT not in paths.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(p for p in (ROOT, paths) if p)


def run_path(spark: SparkSession, name: str) -> str:
    """A folder of its own for one run, below ``spark.checkpoint.dir``."""
    return f"{shared_folder(spark)}/llm/{name}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, path: str) -> DataFrame:
    """Cuts the lineage: the table is written once to the shared folder and read from there."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def open_folder(path: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a folder named by path or URI; made if missing."""
    if path.startswith("file:/") and not path.startswith("file://"):
        path = "file://" + path[len("file:"):]
    fs, inner = pafs.FileSystem.from_uri(path)
    fs.create_dir(inner, recursive=True)
    return fs, inner


def mix64(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """Bijective 64-bit mixing (fixed constants of the public splitmix64 finaliser)."""
    with np.errstate(over="ignore"):
        z = x.astype(np.uint64) + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & MASK64)
        z ^= z >> np.uint64(30)
        z *= np.uint64(0xBF58476D1CE4E5B9)
        z ^= z >> np.uint64(27)
        z *= np.uint64(0x94D049BB133111EB)
        z ^= z >> np.uint64(31)
        return z
