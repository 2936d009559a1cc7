"""Readers and writers: signal CSV, one-file-per-segment CSV, Parquet, feature and result tables."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.ml.util import DefaultParamsReader, MLWritable
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wavecut.operators.segments import consecutive_index, file_label, file_order_index, union_sets, with_null_target
from wavecut.sources.storage import cut_lineage, join_small

TRAIN_SCHEMA = T.StructType(
    [T.StructField("x", T.DoubleType(), True), T.StructField("y", T.DoubleType(), True)]
)
TEST_SCHEMA = T.StructType([T.StructField("x", T.DoubleType(), True)])
NARROW_SCHEMA = T.StructType(
    [T.StructField("x", T.ShortType(), True), T.StructField("y", T.DoubleType(), True)]
)


def read_signal_csv(spark: SparkSession, path: str, schema: T.StructType = TRAIN_SCHEMA) -> DataFrame:
    """Header CSV with a declared schema; nothing is inferred."""
    return spark.read.csv(path, header=True, schema=schema, enforceSchema=True)


def with_file_place(raw: DataFrame) -> DataFrame:
    """Adds where each row came from: ``_file``, ``_split`` and ``_id`` (see ``file_order_index``)."""
    return raw.select(
        "*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_split"),
        F.monotonically_increasing_id().alias("_id"),
    )


def read_ordered_csv(spark: SparkSession, path: str, schema: T.StructType = TRAIN_SCHEMA) -> DataFrame:
    """One or many CSV files, ready to be numbered in the order of file name and row."""
    return with_file_place(read_signal_csv(spark, path, schema))


def read_narrow_csv(spark: SparkSession, path: str) -> DataFrame:
    """16-bit integer signal, widened before anyone can overflow it."""
    return read_signal_csv(spark, path, NARROW_SCHEMA).withColumn("x", F.col("x").cast("double"))


def number_file_rows(rows: DataFrame) -> DataFrame:
    """Adds the 1-based position ``no`` of each row in its file ``name``; see ``file_order_index``."""
    return file_order_index(rows, "no", within="name")


def read_segment_files(
    spark: SparkSession, folder: str, key_list: DataFrame | None = None, set_tag: int = 1
) -> DataFrame:
    """All one-segment CSV files of a folder as ``set, seg, no, name, x, y``.

    One multi-file scan; the label is the file-name stem and the target is NULL.
    ``key_list`` (``name, seg``) selects and numbers the segments; without it they
    are numbered in the order of a hash of their name.
    """
    raw = spark.read.csv(folder, header=True, schema=TEST_SCHEMA, enforceSchema=True, pathGlobFilter="*.csv")
    rows = with_file_place(raw).withColumn("name", file_label(F.col("_file")))
    if key_list is None:
        key_list = number_names(file_names(spark, folder))
    numbered = number_file_rows(rows).join(key_list.select("name", "seg"), "name")
    return with_null_target(numbered.withColumn("set", F.lit(set_tag))).select(
        "set", "seg", "no", "name", "x", "y"
    )


def file_names(spark: SparkSession, folder: str, pattern: str = "*.csv") -> DataFrame:
    """``name`` of every file, from the listing alone: the content column is not read."""
    listed = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    return listed.select(file_label(F.col("path")).alias("name"))


def number_names(names: DataFrame) -> DataFrame:
    """``(name, seg)``: distinct names numbered 0, 1, ... in the order of their hash."""
    hashed = cut_lineage(names.select("name", F.xxhash64("name").alias("_h")))
    numbered = consecutive_index(hashed, "_h", block_bits=44, ties=("name",))
    return numbered.select("name", (F.col("idx") - 1).alias("seg"))


def read_key_list(spark: SparkSession, path: str, key: str = "seg_id") -> DataFrame:
    """``(name, seg)``: the segments to score, numbered in the order of file name and row."""
    listed = with_file_place(spark.read.csv(path, header=True)).select(F.col(key).alias("name"), "_file", "_split", "_id")
    return file_order_index(listed).select("name", (F.col("idx") - 1).alias("seg"))


def read_features_csv(spark: SparkSession, path: str, key: str = "seg_id") -> DataFrame:
    """Precomputed feature table: a string key, every other column a double."""
    header = spark.read.csv(path, header=True)
    return header.select(
        *(F.col(f"`{c}`") if c == key else F.col(f"`{c}`").cast("double").alias(c) for c in header.columns)
    )


def read_table(spark: SparkSession, *paths: str) -> DataFrame:
    return spark.read.parquet(*paths)


def register(df: DataFrame, name: str) -> DataFrame:
    """Named view over a table, for use in SQL text."""
    df.createOrReplaceTempView(name)
    return df


def write_signal(
    df: DataFrame, path: str, mode: str = "overwrite", partitions: int | None = None,
    rows_per_file: int = 20_000_000,
) -> None:
    """Segment table as Parquet, clustered and sorted by ``seg, no``.

    Range partitioning on the position as well splits an oversized segment over
    several files, and min/max statistics let a filter on ``seg`` or ``no`` skip
    row groups.
    """
    order = ["set", "seg", "no"]
    ranged = df.repartitionByRange(partitions, *order) if partitions else df.repartitionByRange(*order)
    (
        ranged.sortWithinPartitions(*order)
        .write.mode(mode)
        .option("maxRecordsPerFile", rows_per_file)
        .partitionBy("set")
        .parquet(path)
    )


def write_bucketed(
    df: DataFrame, table: str, buckets: int, keys: Sequence[str] = ("seg",), path: str | None = None,
    mode: str = "overwrite",
) -> DataFrame:
    """Segment table bucketed by segment and sorted by position.

    Statistics, windows, packing and joins on the segment then need no exchange:
    the signal is shuffled once, here.
    """
    writer = (
        df.repartition(buckets, *keys)
        .write.mode(mode)
        .bucketBy(buckets, *keys)
        .sortBy(*keys, "no")
    )
    if path is not None:
        writer = writer.option("path", path)
    writer.saveAsTable(table)
    return df.sparkSession.table(table)


def write_result(df: DataFrame, path: str, mode: str = "overwrite", single_file: bool = False) -> None:
    """Result CSV with a header; ``single_file`` is for small final tables."""
    (df.coalesce(1) if single_file else df).write.mode(mode).csv(path, header=True)


def compact(spark: SparkSession, batches: Sequence[str], path: str, partitions: int | None = None) -> None:
    """Rewrites many batch folders as one clustered table."""
    write_signal(union_sets(*(read_table(spark, b) for b in batches)), path, partitions=partitions)


def append_new_segments(rows: DataFrame, path: str, loaded: str) -> None:
    """Appends only segments that were not loaded before; safe to repeat, also after a failure at any point.

    Rows and names go to folders of this run; a last, single row in ``loaded`` commits the run, and ``read_appended``
    and later appends see committed runs alone.  The signal itself is not read to find out what is there.
    """
    spark, run = rows.sparkSession, uuid.uuid4().hex
    known = loaded_names(spark, loaded, rows.schema["name"].dataType)
    fresh_names = cut_lineage(rows.select("name").distinct().join(known, "name", "left_anti"))
    join_small(rows, fresh_names, ["name"], "left_semi").write.parquet(f"{path}/run={run}")
    fresh_names.write.parquet(f"{loaded}/names/run={run}")
    spark.createDataFrame([(run,)], "committed string").coalesce(1).write.mode("append").parquet(f"{loaded}/runs")


def committed_runs(spark: SparkSession, loaded: str) -> list[str]:
    """The runs that reached their end, one for each append."""
    runs = _read_if_there(spark, f"{loaded}/runs", T.StructType([T.StructField("committed", T.StringType())]))
    return sorted(r.committed for r in runs.distinct().collect())


def loaded_names(spark: SparkSession, loaded: str, kind: T.DataType | None = None) -> DataFrame:
    """``name`` of every segment of a committed run."""
    paths = [f"{loaded}/names/run={r}" for r in committed_runs(spark, loaded)]
    schema = T.StructType([T.StructField("name", kind or T.StringType())])
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def read_appended(spark: SparkSession, path: str, loaded: str) -> DataFrame:
    """The rows of all committed runs; what a failed run left behind is not read."""
    runs = committed_runs(spark, loaded)
    if not runs:
        raise FileNotFoundError(f"nothing was appended to {path}")
    return spark.read.parquet(*(f"{path}/run={r}" for r in runs))


def _read_if_there(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)
    return spark.read.schema(schema).parquet(path) if there else spark.createDataFrame([], schema)


def save_model(model: MLWritable, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(spark: SparkSession, path: str):
    """Whatever model or pipeline was saved: the class is read from its metadata."""
    return DefaultParamsReader.loadParamsInstance(path, spark)
