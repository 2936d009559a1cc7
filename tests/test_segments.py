import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from wavecut.operators import segments as S


def test_consecutive_index_equals_global_order(spark):
    ids = [(i << 33) + j for i in range(5) for j in range(0, 37 * (i + 1))] + [-5, -1, 1 << 50]
    df = spark.createDataFrame([(i,) for i in ids], "uid long").repartition(7)
    got = {r.uid: r.idx for r in S.consecutive_index(df, "uid", block_bits=3).collect()}
    assert got == {u: k + 1 for k, u in enumerate(sorted(ids))}


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(ids=st.sets(st.integers(-(2**40), 2**40), min_size=1, max_size=60), bits=st.integers(1, 30))
def test_consecutive_index_property(spark, ids, bits):
    df = spark.createDataFrame([(i,) for i in ids], "uid long")
    got = [r.uid for r in S.consecutive_index(df, "uid", block_bits=bits).orderBy("idx").collect()]
    assert got == sorted(ids)


def test_consecutive_index_never_plans_one_big_partition(spark, plan_text):
    plan = plan_text(S.consecutive_index(spark.range(1000).toDF("uid"), "uid"))
    # the one single-partition step runs over block totals, not over rows
    single = [line for line in plan.splitlines() if "SinglePartition" in line]
    assert len(single) == 1
    below = plan.splitlines()[plan.splitlines().index(single[0]) + 1]
    assert "HashAggregate" in below and "_parent" in below


def test_segments_partition_the_signal(spark):
    df = S.with_segments(spark.range(1, 1051).toDF("idx"), 100)
    counts = {r.seg: r.n for r in S.segment_counts(df).collect()}
    assert counts == {**{i: 100 for i in range(10)}, 10: 50}
    assert df.agg(F.min("no"), F.max("no")).first()[:] == (1, 100)
    assert [r.seg for r in S.incomplete_segments(df, 100).collect()] == [10]
    assert S.drop_partial(df, 100).select("seg").distinct().count() == 10
    rows = df.agg(F.count(F.lit(1)).alias("n"))
    assert S.drop_partial_tail(df, 100, rows).count() == 1000


def test_number_signal_has_the_segment_table_schema(spark):
    raw = S.with_row_id(spark.range(250).select(F.col("id").cast("double").alias("x")), start=10)
    out = S.number_signal(raw, 100, set_tag=1)
    assert out.columns == ["uid", "set", "seg", "no", "name", "x", "y"]
    assert dict(out.dtypes)["y"] == "double" and out.where("y is not null").count() == 0
    rows = out.orderBy("seg", "no").collect()
    assert [r.x for r in rows] == [float(i) for i in range(250)]
    assert rows[-1].name == "raw_0002" and rows[-1].no == 50 and rows[0].set == 1
    assert S.max_row_id(out).first().m == out.agg(F.max("uid")).first()[0]


def test_labels_keep_long_numbers(spark):
    df = spark.createDataFrame([(7,), (123456,)], "seg long")
    assert [r[0] for r in df.select(S.segment_label(F.col("seg"))).collect()] == ["raw_0007", "raw_123456"]
    names = spark.createDataFrame([("a/b/seg_12ab.csv",)], "f string")
    assert names.select(S.file_label(F.col("f"))).first()[0] == "seg_12ab"


def test_targets(segment_frame):
    df = segment_frame([1, 2, 3, 4], [5, 6, 7], y=[[9, 8, 7, 6], [5, 4, 3]])
    assert {r.seg: r.y for r in S.point_target(df, 4).collect()} == {0: 6.0}
    wide = S.multi_point_targets(df, (2, 4)).collect()
    assert [(r.seg, r.y0, r.y1) for r in wide] == [(0, 8.0, 6.0)]
    last = {r.seg: (r.n, r.y) for r in S.last_values(df).collect()}
    assert last == {0: (4, 6.0), 1: (3, 3.0)}


def test_multi_point_targets_scan_once(segment_frame, plan_text):
    plan = plan_text(S.multi_point_targets(segment_frame([1, 2, 3]), (1, 2, 3)))
    assert plan.count("Join") == 0


def test_filters_and_unions(spark):
    df = S.with_segments(spark.range(1, 401).toDF("idx"), 100).withColumn("y", F.lit(1.0))
    train, held = S.holdout_split(df, 3)
    assert (train.count(), held.count()) == (300, 100)
    both = S.union_sets(train, S.with_null_target(held).select("y", "no", "seg", "idx"))
    assert both.count() == 400 and both.where("y is null").count() == 100
    assert S.systematic_sample(df, 50).orderBy("idx").first().idx == 1
    assert S.systematic_sample(df, 50).count() == 8
    assert S.position_range(df, 10, 20).count() == 44
    keys = spark.createDataFrame([(1,), (3,)], "seg long")
    kept = S.restrict_to_keys(df, keys, "seg")
    assert kept.count() == 200 and set(kept.columns) == set(df.columns)
    assert S.suffixed(df, "_d", keep=("seg",)).columns == ["idx_d", "seg", "no_d", "y_d"]
    by_rank = S.with_position(df.withColumnRenamed("no", "known"), order_by="idx")
    assert by_rank.where("no <> known").count() == 0
    ordered = [r.idx for r in S.in_signal_order(df, ("seg", "no")).collect()]
    assert ordered == sorted(ordered)


def test_segment_length_must_be_positive(spark):
    with pytest.raises(ValueError):
        S.with_segments(spark.range(3).toDF("idx"), 0)


def test_consecutive_index_splits_blocks_that_hold_too_much(spark, monkeypatch):
    """Ids of one block lie in many partitions all the same, with the ranks of the global order."""
    monkeypatch.setattr(S, "SAFE_BITS", 4)
    monkeypatch.setattr(S, "BLOCK_ROWS", 50)
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df = spark.range(0, 3000, 3).select((F.col("id") + F.lit(1 << 33)).alias("uid"))
        rows = S.consecutive_index(df, "uid", block_bits=40).withColumn("part", F.spark_partition_id()).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    assert sorted((r.uid - (1 << 33)) // 3 + 1 == r.idx for r in rows) == [True] * 1000
    assert len({r.part for r in rows}) > 1
