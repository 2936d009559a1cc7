"""Where intermediate tables go: the shared folder named by the session."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BROADCAST_ROWS = 200_000
ROWS_PER_TASK = 5_000_000


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; where it is unset on a local master, a folder of the
    application below the session's own ``spark.local.dir``."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        sc = spark.sparkContext
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder")
        configured = f"{sc.getConf().get('spark.local.dir', '/tmp')}/wavecut-{sc.applicationId}"
    return configured


_scopes: list[str] = []


@contextmanager
def temporary_tables(spark: SparkSession) -> Iterator[str]:
    """Within it, intermediate tables go to one folder, which is removed at the end.

    For results that are written or collected inside; a DataFrame that leaves the block cannot be read any more.
    Blocks can be nested; yields the folder.
    """
    folder = f"{shared_folder(spark)}/scopes/{uuid.uuid4().hex}"
    _scopes.append(folder)
    try:
        yield folder
    finally:
        _scopes.remove(folder)
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def table_root(spark: SparkSession) -> str:
    """Where intermediate tables go: the folder of the innermost ``temporary_tables``, else the shared folder."""
    return _scopes[-1] if _scopes else shared_folder(spark)


def cut_lineage(df: DataFrame, path: str | None = None) -> DataFrame:
    """Writes the table once, as Parquet, and reads it from there afterwards.

    ``path``: a table of the caller's run folder, overwritten by the next run; by default a new one.
    """
    path = path or f"{table_root(df.sparkSession)}/tables/{uuid.uuid4().hex}"
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def run_folder(spark: SparkSession, run: str, source: str = "") -> str:
    """Folder of the intermediate tables of one run over one input.

    A repeated run overwrites its own tables; inputs and other runs are never touched.
    """
    tag = f"-{hashlib.md5(source.encode()).hexdigest()[:8]}" if source else ""
    return f"{table_root(spark)}/runs/{run}{tag}"


def join_small(rows: DataFrame, table: DataFrame, on: Sequence[str], how: str = "inner", largest: int | None = None) -> DataFrame:
    """Joins a written table to raw rows without moving a hot key to one task.

    The table is counted first: up to ``BROADCAST_ROWS`` rows it is broadcast.  Beyond that the largest
    group of the rows is counted, unless ``largest`` says it, the table is repeated so often that a copy meets at most
    ``ROWS_PER_TASK`` rows of it, and the rows are spread over the copies.
    """
    if table.count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(table), list(on), how)
    if largest is None:
        largest = rows.groupBy(*on).agg(F.count(F.lit(1)).alias("_n")).agg(F.max("_n")).first()[0] or 0
    salts = max(1, -(-largest // ROWS_PER_TASK))
    copies = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    salted = rows.withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(salts)).cast("int"))
    return salted.join(copies, [*on, "_salt"], how).drop("_salt")
