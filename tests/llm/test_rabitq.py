import numpy as np
from pyspark.sql import functions as F

from wavecut.llm import queries, rabitq

SF = "/root/testdata/sf0.001"


def brute(rows, every, k):
    good = [(i, np.array(v, dtype=np.float32).astype(float)) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    out = []
    for q, x in good:
        if q % every == 0:
            scores = {}
            for i, v in good:
                if i != q and len(v) == len(x):
                    scores[i] = max(scores.get(i, -np.inf), float(v @ x))
            best = sorted(scores.items(), key=lambda s: (-s[1], s[0]))[:k]
            out += [(q, r + 1, i, s) for r, (i, s) in enumerate(best)]
    return sorted(out)


def recall(got, want):
    a, b = {(r.query_id, r.vec_id) for r in got}, {(q, i) for q, _, i, _ in want}
    return len(a & b) / len(b)


def test_op8_query(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    got = queries.op8_one_bit_codes(spark, SF).collect()
    want = brute(rows, 20, 20)
    assert recall(got, want) >= 0.999 and len(got) == len(want)
    for r, w in zip(sorted(got), want):
        assert tuple(r)[:3] == w[:3] and abs(r.score - w[3]) < 1e-12


def test_blocks_and_chunks(spark):
    rng = np.random.default_rng(5)
    rows = [(i, rng.standard_normal(48).astype(np.float32).tolist()) for i in range(3000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(5)
    got = rabitq.nearest(df, F.col("vec_id") % 20 == 0, block_rows=400, query_rows=32).collect()
    assert recall(got, brute(rows, 20, 20)) >= 0.995


def test_bounds_hold():
    rng = np.random.default_rng(7)
    x, q = rng.standard_normal((4000, 64)), rng.standard_normal((50, 64))
    code, length, cosine = rabitq.encode(x, 11)
    assert code.shape == (4000, 8)
    estimate, half = rabitq.estimates(code, length, cosine, q, 11, 2.5)
    error = np.abs(estimate - q @ x.T)
    assert (error <= half).mean() > 0.98
    assert abs((estimate - q @ x.T).mean()) < 0.05


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, None), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, []), (7, [1.0, None]),
            (8, [1.0, 0.0]), (9, [1.0, 0.0]), (9, [1.0, 0.0]), (20, [1.0, 0.0]), (40, [1.0, 2.0, 3.0]), (41, [1.0, 1.0, 1.0]), (None, [9.0, 9.0]), (60, [-1.0, -1.0])]
    df = spark.createDataFrame([(*r, 1, "q") for r in rows], "vec_id long, embedding array<float>, rank int, score string")
    got = sorted(tuple(r) for r in rabitq.nearest(df, F.col("vec_id") % 20 == 0, k=3).collect())
    assert got == brute(rows, 20, 3)
    assert rabitq.nearest(df.where("false"), F.col("vec_id") % 20 == 0).count() == 0


def test_most_rows_equal(spark):
    same = [1.0] * 8
    rows = [(i, same if i % 3 else np.random.default_rng(i).standard_normal(8).astype(np.float32).tolist()) for i in range(2000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4)
    got = sorted(tuple(r)[:3] for r in rabitq.nearest(df, F.col("vec_id") % 100 == 0, block_rows=500).collect())
    assert got == [w[:3] for w in brute(rows, 100, 20)]
