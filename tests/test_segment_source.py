import os

import pyarrow.fs as pafs
import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, In

from wavecut.sources import segment_source as G
from wavecut.sources import tables

CONTENTS = {f"seg_{i:02x}": [i * 10 + j + 0.25 for j in range(6 + i % 3)] for i in range(25)}


def write_files(folder, contents, end="\n"):
    os.makedirs(folder, exist_ok=True)
    for name, values in contents.items():
        with open(f"{folder}/{name}.csv", "w") as f:
            f.write("acoustic\n" + "\n".join(str(v) for v in values) + end)


@pytest.mark.parametrize("options", [{}, {"bytesPerTask": 40, "fileCost": 5}, {"bytesPerTask": 7, "fileCost": 0}])
@pytest.mark.parametrize("end", ["\n", ""])
def test_equals_the_csv_reader(spark, scratch, options, end):
    write_files(scratch, CONTENTS, end)
    want = tables.read_segment_files(spark, scratch)
    got = G.read_segments(spark, scratch, **options)
    assert got.columns == want.columns and got.dtypes == want.dtypes
    assert got.count() == sum(map(len, CONTENTS.values()))
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_files_outside_the_key_list_are_not_opened(spark, scratch):
    write_files(scratch, CONTENTS)
    for k in range(20):
        write_files(scratch, {f"broken_{k}": ["not a number"]})
    keys = spark.createDataFrame([("seg_03", 7), ("seg_11", 8), ("nowhere", 9)], "name string, seg long")
    rows = G.read_segments(spark, scratch, keys).collect()
    assert {(r.name, r.seg) for r in rows} == {("seg_03", 7), ("seg_11", 8)}
    assert len(rows) == len(CONTENTS["seg_03"]) + len(CONTENTS["seg_11"])
    with pytest.raises(Exception, match="not a number"):
        G.read_segments(spark, scratch).collect()
    reader = G.SegmentReader({"path": scratch})
    left = list(reader.pushFilters([In(("name",), ("seg_01", "seg_02", "x")), GreaterThan(("x",), 1.0), EqualTo(("name",), "seg_02")]))
    assert left == [GreaterThan(("x",), 1.0)]
    assert [r.name for p in reader.partitions() for r in p.ranges] == ["seg_02"]


def test_ranges_cover_every_byte_once(scratch):
    write_files(scratch, {"a": range(100), "b": [], "c": range(1000)})
    files = G.list_files(scratch)
    tasks = G.plan_ranges(files, 300, 50)
    assert len(tasks) > 5
    for f in files:
        mine = sorted((r.start, r.end) for t in tasks for r in t.ranges if r.path == f.path)
        assert mine[0][0] == 0 and mine[-1][1] == f.size and all(a[1] == b[0] for a, b in zip(mine, mine[1:]))
    assert all(sum(r.end - r.start for r in t.ranges) <= 300 for t in tasks)
    fs, _ = G.file_system(scratch)
    for block in (3, 16, 8 << 20):
        old, G.BLOCK = G.BLOCK, block
        try:
            rows = [b.column(4).to_pylist() for t in tasks for r in t.ranges if r.name == "c" for b in G.read_range(fs, r)]
        finally:
            G.BLOCK = old
        assert [v for part in rows for v in part] == list(range(1000))


def test_missing_samples_keep_their_place(spark, scratch):
    with open(f"{scratch}/gap.csv", "w") as f:
        f.write("x\n1.5\n\n2.5\n")
    assert [(r.no, r.x) for r in G.read_segments(spark, scratch).orderBy("no").collect()] == [(1, 1.5), (2, None), (3, 2.5)]


def test_stream_takes_each_file_once(spark, scratch):
    folder = f"{scratch}/in"
    names = list(CONTENTS)

    def run():
        query = (
            G.stream_segments(spark, folder, maxFiles=4).writeStream
            .foreachBatch(lambda rows, k: tables.number_file_rows(rows).write.mode("overwrite").parquet(f"{scratch}/out/batch={k}"))
            .option("checkpointLocation", f"{scratch}/state").start()
        )
        query.processAllAvailable()
        query.stop()
        return spark.read.parquet(f"{scratch}/out")

    write_files(folder, {n: CONTENTS[n] for n in names[:10]})
    assert run().select("batch").distinct().count() == 3
    write_files(folder, {n: CONTENTS[n] for n in names[10:]})
    loaded = run()
    got = {}
    for r in loaded.orderBy("name", "no").collect():
        got.setdefault(r.name, []).append(r.x)
    assert got == CONTENTS


def test_writer_commits_whole_segments(spark, scratch):
    rows = spark.createDataFrame([(n, k + 1, v) for n, values in CONTENTS.items() for k, v in enumerate(values)], "name string, no long, x double")
    folder = f"{scratch}/out"
    os.makedirs(folder)
    G.write_segments(rows.repartition(7), folder, header="acoustic")
    assert sorted(os.listdir(folder)) == sorted([f"{n}.csv" for n in CONTENTS] + ["_writing"])
    with open(f"{folder}/seg_04.csv") as f:
        assert f.read() == "acoustic\n" + "".join(f"{v}\n" for v in CONTENTS["seg_04"])
    G.write_segments(rows.where("name = 'seg_04'").withColumn("x", -F.col("x")), folder, mode="overwrite")
    assert [f for f in os.listdir(folder) if f.endswith(".csv")] == ["seg_04.csv"]
    G.register_segments(spark)
    with pytest.raises(Exception, match="two tasks"):
        rows.select("name", "x").repartition(7).sortWithinPartitions("name").write.format("segments").mode("append").save(folder)
    assert [f for f in os.listdir(folder) if f.endswith(".csv")] == ["seg_04.csv"]


def test_tasks_stay_few_and_ranges_small(monkeypatch):
    files = [pafs.FileInfo(f"/f{i}.csv", pafs.FileType.File, size=250) for i in range(1000)]
    alone = G.plan_ranges(files, 100, 10)
    monkeypatch.setattr(G, "MOST_TASKS", 64)
    few = G.plan_ranges(files, 100, 10)
    flat = lambda tasks: [r for t in tasks for r in t.ranges]
    assert len(alone) > 64 >= len(few) and flat(alone) == flat(few) and max(len(t.ranges) for t in few) < 64
