"""``spark.read.format("segments")``: folders of one-segment CSV files as a batch, stream and write source.

Partitions are planned from the listing alone: small files are packed together, large ones are cut into byte ranges.
Filters on the file name (``=``, ``IN``) reach the planning, so that files outside a key list are never opened.  Rows
come as Arrow batches, with the file, the range and the row in the range they were read from, which is what
``file_order_index`` numbers them by.  The writer gives every segment a file of its own, put in place on commit.

Paths are read with Arrow's file systems, on the driver (listing) and in tasks: local or mounted folders, HDFS and
object stores.
"""

from __future__ import annotations

import io
import json
import sys
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.csv as pc
import pyarrow.fs as pafs
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    DataSourceStreamReader,
    EqualTo,
    In,
    InputPartition,
    WriterCommitMessage,
)
from pyspark.sql.types import StructType

from wavecut.operators.segments import file_order_index, with_null_target
from wavecut.sources.storage import BROADCAST_ROWS, cut_lineage, join_small

# Workers get this module with the job and need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

FORMAT = "segments"
SCHEMA = "name string, file string, split long, row long, x double"
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"
BLOCK = 8 << 20
#: Tasks of one read; beyond that a task takes several bundles of ranges.
MOST_TASKS = 1 << 10


@dataclass(frozen=True)
class FileRange:
    path: str
    name: str
    start: int
    end: int


@dataclass
class Ranges(InputPartition):
    ranges: list[FileRange]


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str]]


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    if path.startswith("file:/") and not path.startswith("file://"):
        path = "file://" + path[len("file:"):]
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


def stem(path: str) -> str:
    return path.rsplit("/", 1)[-1].split(".", 1)[0]


def list_files(path: str) -> list[pafs.FileInfo]:
    fs, inner = file_system(path)
    found = fs.get_file_info(pafs.FileSelector(inner, recursive=True))
    hidden = lambda f: any(part.startswith(("_", ".")) for part in f.path[len(inner):].split("/"))
    return sorted((f for f in found if f.is_file and f.extension == "csv" and not hidden(f)), key=lambda f: f.path)


def plan_ranges(files: Sequence[pafs.FileInfo], bytes_per_task: int, file_cost: int) -> list[Ranges]:
    """Files in tasks of about ``bytes_per_task``; opening one counts as ``file_cost`` bytes, larger ones are cut.

    Beyond ``MOST_TASKS`` tasks neighbouring ones are put together; the ranges stay as they are.
    """
    tasks, held, size = [], [], 0
    for f in files:
        for start in range(0, max(f.size, 1), bytes_per_task):
            end = min(f.size, start + bytes_per_task)
            if held and size + end - start + file_cost > bytes_per_task:
                tasks.append(Ranges(held))
                held, size = [], 0
            held.append(FileRange(f.path, stem(f.path), start, end))
            size += end - start + file_cost
    if held:
        tasks.append(Ranges(held))
    step = -(-len(tasks) // MOST_TASKS)
    return tasks if step <= 1 else [Ranges([r for t in tasks[k:k + step] for r in t.ranges]) for k in range(0, len(tasks), step)]


def lines_between(file: pa.NativeFile, start: int, end: int) -> Iterator[bytes]:
    """Blocks of whole lines: those that begin in ``[start, end)``, without the header in the first line of the file."""
    at = max(0, start - 1)
    file.seek(at)
    rest, skip = b"", True  # the line that runs into the range belongs to the one before; in the first it is the header
    while True:
        block = file.read(BLOCK)
        if not block:
            if rest and not skip:
                yield rest
            return
        rest += block
        if skip:
            first = rest.find(b"\n")
            if first < 0:
                at, rest = at + len(rest), b""
                continue
            at, rest, skip = at + first + 1, rest[first + 1:], False
        if at >= end:
            return
        if at + len(rest) >= end:
            # up to the end of the line that holds byte end - 1
            last = rest.find(b"\n", max(0, end - at - 1))
            if last >= 0:
                yield rest[:last + 1]
                return
            whole = rest.rfind(b"\n", 0, max(0, end - at - 1)) + 1
        else:
            whole = rest.rfind(b"\n") + 1
        if whole:
            yield rest[:whole]
            at, rest = at + whole, rest[whole:]


def read_range(fs: pafs.FileSystem, r: FileRange) -> Iterator[pa.RecordBatch]:
    row = 0
    with fs.open_input_file(r.path) as file:
        for block in lines_between(file, r.start, r.end):
            table = pc.read_csv(
                io.BytesIO(block), read_options=pc.ReadOptions(column_names=["x"]),
                parse_options=pc.ParseOptions(ignore_empty_lines=False),
                convert_options=pc.ConvertOptions(column_types={"x": pa.float64()}, null_values=[""], strings_can_be_null=True),
            )
            for batch in table.to_batches(max_chunksize=10_000):
                n = batch.num_rows
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r.name] * n), pa.array([r.path] * n), pa.array([r.start] * n, pa.int64()),
                     pa.array(range(row, row + n), pa.int64()), batch.column(0)],
                    names=["name", "file", "split", "row", "x"],
                )
                row += n


class RangeReader:
    """What batch and stream readers share."""

    def __init__(self, options: dict):
        self.path = options["path"]
        self.bytes_per_task = int(options.get("bytespertask", 64 << 20))
        self.file_cost = int(options.get("filecost", 1 << 20))

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        fs, _ = file_system(self.path)
        for r in partition.ranges:
            yield from read_range(fs, r)


class SegmentReader(RangeReader, DataSourceReader):
    def __init__(self, options: dict):
        super().__init__(options)
        self.names: set[str] | None = None

    def pushFilters(self, filters):
        """Filters on ``name`` choose the files; all others are left to Spark."""
        for f in filters:
            wanted = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            if wanted is None or f.attribute != ("name",):
                yield f
            else:
                self.names = wanted if self.names is None else self.names & wanted

    def partitions(self) -> Sequence[Ranges]:
        files = [f for f in list_files(self.path) if self.names is None or stem(f.path) in self.names]
        return plan_ranges(files, self.bytes_per_task, self.file_cost) or [Ranges([])]


class SegmentStream(RangeReader, DataSourceStreamReader):
    """Offsets are the time and path of the newest file taken; at most ``maxFiles`` files are taken at a time.

    A file that appears with an older time than one taken already is not seen, as with any listing by time.
    """

    def __init__(self, options: dict):
        super().__init__(options)
        self.most = int(options.get("maxfiles", 20))
        self.taken: dict | None = None

    def initialOffset(self) -> dict:
        return {"time": 0, "path": ""}

    def _after(self, offset: dict) -> list[tuple[tuple[int, str], pafs.FileInfo]]:
        dated = sorted((((f.mtime_ns or 0, f.path), f) for f in list_files(self.path)), key=lambda x: x[0])
        return [x for x in dated if x[0] > (offset["time"], offset["path"])]

    def latestOffset(self) -> dict:
        start = self.taken or self.initialOffset()
        new = self._after(start)[: self.most]
        self.taken = {"time": new[-1][0][0], "path": new[-1][0][1]} if new else start
        return self.taken

    def partitions(self, start: dict, end: dict) -> Sequence[Ranges]:
        self.taken = max(self.taken or end, end, key=lambda o: (o["time"], o["path"]))
        files = [f for at, f in self._after(start) if at <= (end["time"], end["path"])]
        return plan_ranges(files, self.bytes_per_task, self.file_cost)


class SegmentWriter(DataSourceArrowWriter):
    """One file for each ``name``; all rows of a name must come to one task, in order.

    Files lie below ``_writing`` until the job commits, and are moved in place then.  A name that comes to two tasks,
    or again after another one, fails the job.
    """

    def __init__(self, options: dict, overwrite: bool):
        self.path, self.overwrite = options["path"], overwrite
        self.header = options.get("header", "x")
        self.run = f"{self.path.rstrip('/')}/_writing/{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, folder = file_system(self.run)
        folder = f"{folder}/{TaskContext.get().taskAttemptId()}"
        fs.create_dir(folder, recursive=True)
        written, seen, out, name = [], set(), None, None
        try:
            for batch in iterator:
                names, values = (batch.column(batch.schema.get_field_index(c)) for c in ("name", "x"))
                start, labels = 0, names.to_pylist()
                while start < len(labels):
                    end = start
                    while end < len(labels) and labels[end] == labels[start]:
                        end += 1
                    if out is None or labels[start] != name:
                        if out is not None:
                            out.close()
                        name = labels[start]
                        if not name or "/" in name or "." in name:
                            raise ValueError(f"{name!r} cannot name a file")
                        if name in seen:
                            raise ValueError(f"segment {name} does not lie together")
                        seen.add(name)
                        written.append((name, f"{folder}/{name}.csv"))
                        out = fs.open_output_stream(written[-1][1])
                        out.write(f"{self.header}\n".encode())
                    out.write("".join("\n" if v is None else f"{v!r}\n" for v in values[start:end].to_pylist()).encode())
                    start = end
        finally:
            if out is not None:
                out.close()
        return Written(written)

    def commit(self, messages: list[Written | None]) -> None:
        fs, folder = file_system(self.path)
        files = [f for m in messages if m is not None for f in m.files]
        names = [n for n, _ in files]
        if len(set(names)) < len(names):
            self.abort(messages)
            raise ValueError("a segment was written by two tasks: repartition by name first")
        there = {f.path: f for f in list_files(self.path)}
        if self.overwrite:
            for old in there:
                fs.delete_file(old)
        for name, file in files:
            fs.move(file, f"{folder}/{name}.csv")
        self._clean()

    def abort(self, messages: list[Written | None]) -> None:
        self._clean()

    def _clean(self) -> None:
        fs, run = file_system(self.run)
        if fs.get_file_info(run).type == pafs.FileType.Directory:
            fs.delete_dir(run)


class SegmentSource(DataSource):
    """Options: ``path``, ``bytesPerTask``, ``fileCost``; stream: ``maxFiles``; write: ``header``."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> SegmentReader:
        return SegmentReader(_options(self.options))

    def streamReader(self, schema: StructType) -> SegmentStream:
        return SegmentStream(_options(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> SegmentWriter:
        return SegmentWriter(_options(self.options), overwrite)


def _options(given) -> dict:
    options = {k.lower(): v for k, v in dict(given).items()}
    if "path" not in options and "paths" in options:
        options["path"] = json.loads(options["paths"])[0]
    return options


def register_segments(spark: SparkSession) -> None:
    spark.dataSource.register(SegmentSource)


def read_segments(
    spark: SparkSession, folder: str, key_list: DataFrame | None = None, set_tag: int = 1, **options: object
) -> DataFrame:
    """All segment files of a folder as ``set, seg, no, name, x, y``, like ``read_segment_files``.

    With a ``key_list`` (``name, seg``) only its files are opened while it has no more than ``BROADCAST_ROWS`` names;
    beyond that all are read and joined.  Without one the segments are numbered in the order of a hash of their name.
    """
    from wavecut.sources.tables import file_names, number_names

    register_segments(spark)
    keys = cut_lineage(key_list.select("name", "seg") if key_list is not None else number_names(file_names(spark, folder)))
    wanted = [r.name for r in keys.select("name").limit(BROADCAST_ROWS + 1).collect()] if key_list is not None else None
    before = spark.conf.get(PUSHDOWN, "false")
    spark.conf.set(PUSHDOWN, "true")
    try:
        rows = spark.read.format(FORMAT).options(**{k: str(v) for k, v in options.items()}).load(folder)
        if wanted is not None and len(wanted) <= BROADCAST_ROWS:
            rows = rows.where(F.col("name").isin(wanted))
        placed = rows.select("name", "x", F.col("file").alias("_file"), F.col("split").alias("_split"), F.col("row").alias("_id"))
        numbered = join_small(file_order_index(placed, "no", within="name"), keys, ["name"])
    finally:
        spark.conf.set(PUSHDOWN, before)
    return with_null_target(numbered.withColumn("set", F.lit(set_tag))).select("set", "seg", "no", "name", "x", "y")


def stream_segments(spark: SparkSession, folder: str, **options: object) -> DataFrame:
    """The folder as a stream of ``name, _file, _split, _id, x``, for ``number_file_rows`` in each batch."""
    register_segments(spark)
    rows = spark.readStream.format(FORMAT).options(**{k: str(v) for k, v in options.items()}).load(folder)
    return rows.select("name", F.col("file").alias("_file"), F.col("split").alias("_split"), F.col("row").alias("_id"), "x")


def write_segments(df: DataFrame, folder: str, mode: str = "append", header: str = "x", value: str = "x") -> None:
    """One CSV file for each ``name``, its rows in the order of ``no``."""
    register_segments(df.sparkSession)
    rows = df.select("name", F.col(value).cast("double").alias("x"), "no").repartition("name").sortWithinPartitions("name", "no")
    rows.select("name", "x").write.format(FORMAT).mode(mode).option("header", header).save(folder)
