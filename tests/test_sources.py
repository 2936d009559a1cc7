import os

import pytest
from pyspark.ml import Pipeline
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F

from wavecut.operators import rolling as R
from wavecut.operators import segments as S
from wavecut.operators import spectral as V
from wavecut.operators import stats as A
from wavecut.sources import storage, tables
from wavecut.streaming import ingest


def write_files(folder, contents):
    os.makedirs(folder, exist_ok=True)
    for name, values in contents.items():
        with open(f"{folder}/{name}.csv", "w") as f:
            f.write("acoustic\n" + "".join(f"{v}\n" for v in values))


CONTENTS = {f"seg_{i:02x}": [i * 10 + j for j in range(6 + i % 3)] for i in range(45)}


def test_signal_csv(spark, scratch):
    with open(f"{scratch}/train.csv", "w") as f:
        f.write("a,b\n12,1.5\n-7,1.25\n,\n")
    df = tables.read_signal_csv(spark, f"{scratch}/train.csv")
    assert df.dtypes == [("x", "double"), ("y", "double")]
    assert [tuple(r) for r in df.collect()] == [(12.0, 1.5), (-7.0, 1.25), (None, None)]


def test_narrow_integers_do_not_overflow(spark, scratch):
    with open(f"{scratch}/t.csv", "w") as f:
        f.write("a,b\n200,1\n-300,2\n")
    df = tables.read_narrow_csv(spark, f"{scratch}/t.csv")
    assert [r[0] for r in df.select(F.col("x") * F.col("x")).collect()] == [40000.0, 90000.0]


def test_segment_files_in_one_scan(spark, scratch):
    write_files(f"{scratch}/in", CONTENTS)
    with open(f"{scratch}/keys.csv", "w") as f:
        f.write("seg_id,time_to_failure\n" + "".join(f"{n},0\n" for n in reversed(list(CONTENTS)[:30])))
    keys = tables.read_key_list(spark, f"{scratch}/keys.csv")
    assert {r.name: r.seg for r in keys.collect()}["seg_1d"] == 0
    df = tables.read_segment_files(spark, f"{scratch}/in", keys)
    assert df.columns == ["set", "seg", "no", "name", "x", "y"]
    got = {}
    for r in df.orderBy("name", "no").collect():
        got.setdefault(r.name, []).append(int(r.x))
    assert got == {n: CONTENTS[n] for n in list(CONTENTS)[:30]}
    every = tables.read_segment_files(spark, f"{scratch}/in")
    assert sorted(r.seg for r in every.select("seg").distinct().collect()) == list(range(45))


def test_large_file_is_numbered_over_its_splits(spark, scratch):
    write_files(f"{scratch}/in", {"big": range(5000), "small": range(3)})
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000b")
    try:
        df = tables.read_segment_files(spark, f"{scratch}/in").where("name = 'big'")
        assert df.count() == 5000 and df.where("x <> no - 1").count() == 0
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_parquet_table_is_clustered_and_filters_reach_the_scan(spark, scratch, segment_frame, plan_text):
    df = segment_frame(list(range(100)), list(range(100))).withColumn("set", F.lit(0))
    tables.write_signal(df, f"{scratch}/t", partitions=4, rows_per_file=40)
    back = tables.read_table(spark, f"{scratch}/t")
    assert back.count() == 200
    plan = plan_text(S.point_target(back, 100))
    assert "PushedFilters: [IsNotNull(no), EqualTo(no,100)]" in plan and "ReadSchema: struct<seg:bigint,no:bigint,y:double>" in plan
    tables.write_signal(df.withColumn("seg", F.col("seg") + 2), f"{scratch}/t2", partitions=2)
    tables.compact(spark, [f"{scratch}/t", f"{scratch}/t2"], f"{scratch}/all", partitions=2)
    assert tables.read_table(spark, f"{scratch}/all").select("seg").distinct().count() == 4


def test_bucketed_table_needs_no_exchange(spark, scratch, segment_frame, plan_text):
    df = segment_frame(*[list(range(50))] * 6)
    table = tables.write_bucketed(df, "signal_buckets", 4, path=f"{scratch}/b")
    for query in (A.stats14(table), R.roll_extrema(table, (2, 5), seg_len=50), A.pack_segments(table)):
        assert "Exchange" not in plan_text(query)
    # two passes joined on the segment: no shuffle either, also where the join is not a broadcast
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = plan_text(A.stats20(table))
        assert "SortMergeJoin" in plan and "Exchange" not in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert A.segment_counts(table).where("n = 50").count() == 6


def test_append_is_idempotent(spark, scratch, segment_frame):
    rows = segment_frame([1, 2], [3]).withColumn("name", S.segment_label(F.col("seg")))
    out, loaded = f"{scratch}/t", f"{scratch}/loaded"
    tables.append_new_segments(rows.where("seg = 0"), out, loaded)
    for _ in range(2):
        tables.append_new_segments(rows, out, loaded)
    assert tables.read_appended(spark, out, loaded).count() == 3 and tables.loaded_names(spark, loaded).count() == 2


@pytest.mark.parametrize("fails_at", [1, 2, 3])
def test_append_that_fails_is_repeated(spark, scratch, segment_frame, fails_at, monkeypatch):
    """The rows, the names or the commit are written, the next step fails: readers and the repeated run see none of it."""
    rows = segment_frame([1, 2], [3], [4, 5]).withColumn("name", S.segment_label(F.col("seg")))
    out, loaded = f"{scratch}/t", f"{scratch}/loaded"
    tables.append_new_segments(rows.where("seg = 0"), out, loaded)
    write, calls = DataFrameWriter.parquet, []

    def failing(self, path, *args, **kwargs):
        if str(path).startswith(scratch):  # not the intermediate tables
            calls.append(path)
            if len(calls) == fails_at:
                raise OSError("lost")
        return write(self, path, *args, **kwargs)

    monkeypatch.setattr(DataFrameWriter, "parquet", failing)
    with pytest.raises(OSError, match="lost"):
        tables.append_new_segments(rows, out, loaded)
    monkeypatch.undo()
    assert sorted(r.x for r in tables.read_appended(spark, out, loaded).collect()) == [1.0, 2.0]
    tables.append_new_segments(rows, out, loaded)
    assert sorted(r.x for r in tables.read_appended(spark, out, loaded).collect()) == [1.0, 2.0, 3.0, 4.0, 5.0]
    assert len(tables.committed_runs(spark, loaded)) == 2
    with pytest.raises(FileNotFoundError):
        tables.read_appended(spark, out, f"{scratch}/nothing")


def test_key_list_over_several_files(spark, scratch):
    os.makedirs(f"{scratch}/keys")
    for file, names in (("a", ["a0", "a1", "a2"]), ("b", [f"b{k}" for k in range(400)])):
        with open(f"{scratch}/keys/{file}.csv", "w") as f:
            f.write("seg_id,time_to_failure\n" + "".join(f"{n},0\n" for n in names))
    listed = [r.name for r in tables.read_key_list(spark, f"{scratch}/keys").orderBy("seg").collect()]
    assert listed == ["a0", "a1", "a2"] + [f"b{k}" for k in range(400)]


def test_temporary_tables_go_with_their_block(spark, segment_frame):
    def there(path):
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)

    df = segment_frame([1, 2, 3])
    with storage.temporary_tables(spark) as outer:
        cut = storage.cut_lineage(df)
        with storage.temporary_tables(spark) as inner:
            assert storage.cut_lineage(cut).count() == 3 and there(inner)
            assert storage.run_folder(spark, "r").startswith(inner)
        assert not there(inner) and cut.count() == 3 and there(outer)
    assert not there(outer)
    assert storage.table_root(spark) == storage.shared_folder(spark)


def test_views_features_and_results(spark, scratch, segment_frame):
    df = tables.register(segment_frame([1, 2, 3]), "data")
    assert spark.sql("SELECT count(*) AS n FROM data").first().n == 3
    df.printSchema()
    tables.write_result(A.moment_stats(df).withColumnRenamed("seg", "seg_id"), f"{scratch}/f", single_file=True)
    back = tables.read_features_csv(spark, f"{scratch}/f")
    assert dict(back.dtypes)["x_avg"] == "double" and back.first().x_avg == 2.0
    assert len([f for f in os.listdir(f"{scratch}/f") if f.endswith(".csv")]) == 1


def test_model_round_trip(spark, scratch):
    df = spark.createDataFrame([(1.0,), (2.0,)], "a double")
    model = Pipeline(stages=[VectorAssembler(inputCols=["a"], outputCol="v")]).fit(df)
    for _ in range(2):
        tables.save_model(model, f"{scratch}/m")
    assert tables.load_model(spark, f"{scratch}/m").transform(df).count() == 2


@pytest.mark.parametrize("estimator", [
    lambda: RandomForestRegressor(numTrees=3), lambda: GBTRegressor(maxIter=2), lambda: LinearRegression(regParam=0.1),
])
def test_any_model_is_loaded_by_its_class(spark, scratch, estimator):
    df = VectorAssembler(inputCols=["a"], outputCol="features").transform(
        spark.range(30).selectExpr("cast(id as double) a", "cast(id % 7 as double) label")
    )
    model = estimator().fit(df)
    tables.save_model(model, f"{scratch}/m")
    again = tables.load_model(spark, f"{scratch}/m")
    assert type(again) is type(model)
    assert [r.prediction for r in again.transform(df).collect()] == [r.prediction for r in model.transform(df).collect()]


def test_scalers_are_saved(spark, scratch):
    df = spark.createDataFrame([(1.0, [1.0, 5.0]), (3.0, [2.0, 9.0]), (8.0, [4.0, 1.0])], "a double, v array<double>")
    columns, unit = V.fit_column_scaler(df, ["a"]), V.fit_unit_scaler(df, ["v"], [2])
    columns.save(f"{scratch}/c")
    unit.save(f"{scratch}/u")
    assert V.ColumnScaler.load(spark, f"{scratch}/c") == columns
    again = V.UnitScaler.load(spark, f"{scratch}/u")
    assert again.transform(df).collect() == unit.transform(df).collect()


def test_csv_files_are_numbered_in_name_order(spark, scratch, plan_text):
    sizes, rows = {"a": 700, "b": 40, "c": 460}, []
    for name, n in sizes.items():
        values = [len(rows) + i for i in range(n)]
        with open(f"{scratch}/{name}.csv", "w") as f:
            f.write("acoustic_data,time_to_failure\n" + "".join(f"{v},{v / 2}\n" for v in values))
        rows += values
    numbered = S.number_signal(tables.read_ordered_csv(spark, scratch), 300)
    got = sorted((r.uid, r.seg, r.no, r.x) for r in numbered.collect())
    assert got == [(i + 1, i // 300, i % 300 + 1, float(i)) for i in range(1200)]
    plan = plan_text(S.file_order_index(tables.read_ordered_csv(spark, scratch)))
    assert "Exchange hashpartitioning" not in plan and "Window" not in plan


def test_null_ids_are_refused(spark):
    df = spark.createDataFrame([(1,), (None,)], "uid long")
    with pytest.raises(Exception, match="no place in the order"):
        S.consecutive_index(df).collect()


def test_shared_folder_comes_from_the_session(spark):
    assert storage.shared_folder(spark) == spark.conf.get("spark.checkpoint.dir")
    df = storage.cut_lineage(spark.range(5))
    assert df.count() == 5 and "Range" not in df._jdf.queryExecution().executedPlan().toString()


def test_incremental_ingest_equals_one_scan(spark, scratch):
    files = list(CONTENTS)
    src, out, state = f"{scratch}/in", f"{scratch}/out", f"{scratch}/state"
    write_files(src, {n: CONTENTS[n] for n in files[:30]})
    first = ingest.ingest_segment_files(spark, src, out, state)
    assert first.select("batch").distinct().count() == 2  # 30 files, 20 per batch
    write_files(src, {n: CONTENTS[n] for n in files[30:]})
    loaded = ingest.ingest_segment_files(spark, src, out, state)
    want = tables.read_segment_files(spark, src)
    pick = lambda df: sorted(tuple(r) for r in df.select("name", "no", "x").collect())
    assert pick(loaded) == pick(want)


def test_streamed_statistics_equal_batch(spark, scratch):
    write_files(f"{scratch}/in", CONTENTS)
    streamed = ingest.segment_file_stats(spark, f"{scratch}/in", f"{scratch}/out", f"{scratch}/state")
    batch = A.stats20(tables.read_segment_files(spark, f"{scratch}/in"), ("name",))
    a, b = (df.toPandas().set_index("name").sort_index() for df in (streamed, batch))
    assert list(a.index) == list(b.index)
    assert (a[b.columns] - b).abs().max().max() == pytest.approx(0)


def test_a_repeated_run_overwrites_only_its_own_tables(spark):
    one, two = (storage.run_folder(spark, r) for r in ("run-a", "run-b"))
    for _ in range(2):
        for folder in (one, two):
            spark.range(4).write.mode("overwrite").parquet(f"{folder}/t")
    assert spark.read.parquet(f"{one}/t").count() == spark.read.parquet(f"{two}/t").count() == 4
