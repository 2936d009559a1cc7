import random
import re

import numpy as np
import pytest

from wavecut.llm import minhash as M
from wavecut.llm.queries import op12_minhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def grams(text):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(tuple(w[i:i + 4]) for i in range(max(1, len(w) - 3))) if w else frozenset()


def brute(rows):
    """By definition, over all pairs of rows."""
    sets, group = [grams(t) for _, t in rows], list(range(len(rows)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and group[i] != group[j] and 100 * len(a & b) >= 80 * len(a | b):
                group = [group[j] if g == group[i] else g for g in group]
    first = {}
    for (k, _), g in zip(rows, group):
        if k is not None:
            first[g] = min(first.get(g, k), k)
    return sorted(((k, len(s), first.get(g), k == first.get(g)) for (k, _), s, g in zip(rows, sets, group)), key=str)


def got(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in df.collect()), key=str)


def test_query_by_definition(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    assert got(op12_minhash(spark, "/root/testdata/sf0.001")) == brute(rows)


def test_similar_pairs_are_linked(spark):
    rng, rows, k = random.Random(3), [], 0
    for words, changes in ((100, 1), (200, 2), (100, 2), (200, 5), (100, 5), (1000, 27), (8, 0), (60, 4), (1000, 24)):
        for _ in range(25):
            text = [f"w{rng.randrange(5000)}" for _ in range(words)]
            other = list(text)
            for at in rng.sample(range(words), changes):
                other[at] = f"x{rng.randrange(10**6)}"
            rows += [(k, " ".join(text)), (k + 1, " ".join(other))]
            k += 2
    found = got(M.near_copies(spark.createDataFrame(rows, "doc_id long, text string")))
    want = sorted((r for i in range(0, len(rows), 2) for r in brute(rows[i:i + 2])), key=str)
    assert found == want and 0.5 < sum(r[3] for r in want) / len(rows) < 0.9


@pytest.mark.parametrize("chunk_rows, chunk_bytes", [(2000, 1 << 25), (7, 1 << 25), (2000, 4000)])
def test_groups_whose_first_member_is_no_copy(spark, chunk_rows, chunk_bytes):
    rng = random.Random(6)
    common, rows = [f"w{rng.randrange(5000)}" for _ in range(60)], []
    for k in range(60):  # all share 60 words; every third one is a copy of the one before it
        own = [f"w{rng.randrange(5000)}" for _ in range(40)] if k % 3 != 2 else [*own[:-1], "changed"]
        rows.append((k, " ".join(common + own)))
    rows += [(100 + k, " ".join(common[:-1] + [f"end{k}"])) for k in range(40)]
    base = [f"b{i}" for i in range(120)]  # a family whose members are copies of the base, not always of one another
    for k in range(80):
        t = list(base)
        for at in rng.sample(range(120), rng.randrange(1, 5)):
            t[at] = f"y{rng.randrange(9)}"
        rows.append((200 + k, " ".join(t)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert got(M.near_copies(docs, chunk_rows=chunk_rows, chunk_bytes=chunk_bytes)) == brute(rows)


def test_odd_rows(spark):
    a, b = "one two three four five six", "One TWO three  four\tfive\x0bsix"
    rows = [
        (1, None), (2, ""), (2, " \n"), (5, a), (None, b), (3, b), (3, b), (9, "x"), (None, "X"), (None, "alone in the world it is"), (11, "x y"),
        (12, "É à b c d"), (13, "é à b c d"), (14, "x\xa0y"), (15, "long " * 200_000), (16, "long long long long"), (4, None),
    ]
    docs = spark.createDataFrame([(k, t, "z", 1) for k, t in rows], "doc_id long, text string, whole string, n int")
    found = got(M.near_copies(docs))
    # a row without an id keeps its place only where nothing names it
    want = brute(rows)
    assert found == want
    assert M.near_copies(docs.where("false")).count() == 0


def test_pruning_keeps_what_may_be_similar():
    least = M.least_agreements(0.8, 1e-7)
    assert list(least) == sorted(least) and 0 <= least[0] <= 4 and 50 <= least[-1] <= 65
    rng = np.random.default_rng(1)
    a = rng.integers(0, 2**32, (4000, M.HASHES), dtype=np.uint32)
    for s, kept in ((0.8, 4000), (0.3, 0)):
        b = np.where(rng.random(a.shape) < s, a, a + np.uint32(1))
        assert abs(len(M.survivors(a, b, 0.8, 1e-7)) - kept) <= 2
    # the bound by numerical integration of the posterior
    x = np.linspace(0, 1, 200_001)
    for h, m in zip(range(16, 97, 16), least):
        for agreed, above in ((m, True), (m - 1, False)):
            if agreed >= 0:
                density = x**agreed * (1 - x) ** (h - agreed)
                assert (density[x >= 0.8].sum() / density.sum() >= 1e-7) == above


def test_minima_estimate_the_similarity():
    known = M.word_hashes()
    words = [f"w{i}" for i in range(2000)]
    a, b = " ".join(words), " ".join(words[:1800] + [f"v{i}" for i in range(200)])
    sets = [M.shingle_set(t, known) for t in (a, b)]
    true = len(np.intersect1d(*sets)) / len(np.union1d(*sets))
    sig = M.signatures(sets)
    assert abs((sig[0] == sig[1]).mean() - true) < 0.15
    assert M.similar(sets[0], sets[1], (80, 100)) == (true >= 0.8)
