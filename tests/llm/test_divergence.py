import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from wavecut.llm import divergence
from wavecut.llm.queries import op13_source_divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
FIELDS = ("lang", "source", "part", "item", "value", "rank")


def brute(rows, least_docs=10):
    """By definition, from ``(text, lang, source)``."""
    n, docs, groups = defaultdict(Counter), defaultdict(Counter), set()
    for t, l, s in rows:
        l, s = l or "", s or ""
        lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
        words = TERM.findall(lowered)
        groups.add((l, s))
        n[l, s].update(words)
        docs[l].update(set(words))
    out = []
    for l in {g[0] for g in groups}:
        kept = [w for w in docs[l] if docs[l][w] >= least_docs]
        mine = [s for k, s in groups if k == l]

        def share(count):
            size = sum(count[w] for w in kept) + 2 * len(kept)
            return {w: 1 + 10**9 * (count[w] + 2) // size for w in kept}

        q = share(sum((n[l, s] for s in mine), Counter()))
        p = {s: share(n[l, s]) for s in mine}
        for s in mine:
            pairs = [(-sum((p[s][w] - p[o][w]) ** 2 // (p[s][w] + p[o][w]) for w in kept), o) for o in mine if o != s]
            terms = [(-((p[s][w] - q[w]) ** 2 // (p[s][w] + q[w])), w) for w in kept if n[l, s][w] and p[s][w] > q[w]]
            for part, found in (("pair", pairs), ("term", sorted(terms, key=lambda x: (x[0], x[1].encode()))[:10])):
                found.sort(key=lambda x: (x[0], x[1].encode()))
                out += [(l, s, part, item, -v, k + 1) for k, (v, item) in enumerate(found)]
    return sorted(out)


def got(df):
    return sorted(tuple(r[f] for f in FIELDS) for r in df.collect())


def test_query_by_definition(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text", "lang", "source").collect()
    assert got(op13_source_divergence(spark, "/root/testdata/sf0.001")) == brute([tuple(r) for r in rows])


@pytest.mark.parametrize("block, chunk", [(1024, 48), (3, 48), (4, 2), (1, 1)])
def test_blocks_and_chunks_do_not_change_it(spark, block, chunk):
    rng = np.random.default_rng(block * 50 + chunk)
    words = [f"w{chr(97 + i)}" for i in range(20)] + ["É", "éa", "Z"]
    rows = [
        (" ".join(rng.choice(words, int(rng.integers(0, 12)))), f"l{rng.integers(2)}", f"s{min(rng.integers(9), 5)}")
        for _ in range(200)
    ]
    docs = spark.createDataFrame(rows, "text string, lang string, source string").repartition(5)
    assert got(divergence.source_divergence(docs, least_docs=4, block=block, chunk=chunk)) == brute(rows, 4)


def test_odd_rows(spark):
    rows = [
        (None, None, None), ("", "en", ""), ("One one, TWO-two_three\x00four", "en", None), ("x" * 300_000 + " one", "en", "a"),
        ("one", "en", "a"), ("one", "en", "a"), ("ÀÉ àé 12 34", "en", "b"), ("àé one", "en", "b"), ("only", "fr", "z"), ("1 2 3", "de", "p"), (None, "de", "q"),
    ]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "text string, lang string, source string, term string, rank int")
    assert got(divergence.source_divergence(docs, least_docs=2)) == brute(rows, 2)
    tied = [("aa bb cc", "en", "s"), ("aa bb cc", "en", "s"), ("dd", "en", "t"), ("dd", "en", "u"), ("dd", "en", "v")]
    found = got(divergence.source_divergence(spark.createDataFrame(tied, "text string, lang string, source string"), least_docs=2))
    assert found == brute(tied, 2)
    assert [r[3] for r in found if r[1] == "s" and r[2] == "term"] == ["aa", "bb", "cc"]
    assert divergence.source_divergence(docs.where("false")).count() == 0


def test_equal_subtrees_are_one_node():
    counts = np.array([[1, 0, 1, 0, 0, 0, 0, -1], [1, 0, 0, 0, 1, 0, 0, -1], [0, 0, 1, 0, 0, 0, 0, -1]])
    forest = divergence.Forest(counts)
    assert list(forest.values) == [-1, 0, 1]
    assert [len(left) for left, _ in forest.children] == [3, 5, 3]  # (0 -1) (0 0) (1 0); then pairs of them; then roots
    sizes = np.array([20, 30, 40])
    for a in range(3):
        want = [
            sum(int(divergence.gaps(divergence.weights(counts[a, k:k + 1], sizes[a]), divergence.weights(counts[b, k:k + 1], sizes[b]))[0]) for k in range(7))
            for b in range(3)
        ]
        assert forest.prices(a, np.arange(3), sizes).tolist() == want


def test_large_counts_stay_exact():
    counts = np.array([4_000_000_000, 5_000_000_000, 9_100_000_000, 2**60])
    totals = np.array([10**18, 10**13, 10**17, 2**61])
    assert divergence.weights(counts, totals).tolist() == [1 + 10**9 * (int(c) + 2) // int(t) for c, t in zip(counts, totals)]
    for c in counts:
        assert divergence.weights(np.array([c]), np.array([2**61])).tolist() == [1 + 10**9 * (int(c) + 2) // 2**61]
