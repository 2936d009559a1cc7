"""File streams: incremental ingest of segment files and statistics as they arrive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wavecut.operators.segments import file_label, with_null_target
from wavecut.operators.stats import stats20
from wavecut.sources.storage import cut_lineage, join_small
from wavecut.sources.tables import TEST_SCHEMA, number_file_rows, number_names

FILES_PER_TRIGGER = 20


def stream_csv(spark: SparkSession, folder: str, max_files: int = FILES_PER_TRIGGER) -> DataFrame:
    """One-segment CSV files as a stream of ``name, _file, _split, x``."""
    return (
        spark.readStream.schema(TEST_SCHEMA)
        .option("header", True)
        .option("enforceSchema", True)
        .option("maxFilesPerTrigger", max_files)
        .option("pathGlobFilter", "*.csv")
        .csv(folder)
        .select(
            file_label(F.col("_metadata.file_name")).alias("name"),
            F.col("_metadata.file_path").alias("_file"),
            F.col("_metadata.file_block_start").alias("_split"),
            "x",
        )
    )


def stream_parquet(
    spark: SparkSession, folder: str, schema: T.StructType, max_files: int = FILES_PER_TRIGGER
) -> DataFrame:
    """A folder of segment tables as a stream; a file holds whole segments."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(folder)


def run_available(
    stream: DataFrame, batch: Callable[[DataFrame], DataFrame], out: str, checkpoint: str
) -> None:
    """Processes every file not seen before and stops.

    The checkpoint remembers finished files, so a restart skips them.  Each micro-batch
    overwrites its own sub-folder: a batch repeated after a failure leaves no duplicates.
    """
    def write(rows: DataFrame, batch_id: int) -> None:
        batch(rows).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    query = (
        stream.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def numbered_batch(rows: DataFrame) -> DataFrame:
    """Positions within each file of a micro-batch."""
    return number_file_rows(rows.withColumn("_id", F.monotonically_increasing_id()))


def ingest_segment_files(
    spark: SparkSession, folder: str, out: str, checkpoint: str, max_files: int = FILES_PER_TRIGGER
) -> DataFrame:
    """Incremental load of segment files into ``out``; returns ``set, seg, no, name, x, y, batch``.

    The same columns as ``read_segment_files`` gives, with the segments numbered by the names loaded so far.
    """
    run_available(stream_csv(spark, folder, max_files), numbered_batch, out, checkpoint)
    loaded = spark.read.parquet(out)
    return as_test_set(loaded, number_names(loaded.select("name").distinct()))


def as_test_set(rows: DataFrame, key_list: DataFrame, set_tag: int = 1) -> DataFrame:
    """Loaded rows as a set without a target; ``key_list`` (``name, seg``) numbers the segments."""
    numbered = join_small(rows, cut_lineage(key_list.select("name", "seg")), ["name"])
    return with_null_target(numbered.withColumn("set", F.lit(set_tag))).select("set", "seg", "no", "name", "x", "y", "batch")


def segment_file_stats(
    spark: SparkSession, folder: str, out: str, checkpoint: str, max_files: int = FILES_PER_TRIGGER
) -> DataFrame:
    """Statistics per segment file as files arrive.

    A file is never split between micro-batches, so a batch holds whole segments and
    no state is kept between batches.
    """
    run_available(stream_csv(spark, folder, max_files), lambda rows: stats20(rows, ("name",)), out, checkpoint)
    return spark.read.parquet(out).drop("batch")
