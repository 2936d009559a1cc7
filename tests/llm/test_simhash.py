import random
import re

import numpy as np
import pytest
import xxhash

from wavecut.llm import components, queries, simhash

SF = "/root/testdata/sf0.001"


def plain_fingerprint(text, width=4):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    grams = [" ".join(words[i:i + width]) for i in range(len(words) - width + 1)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def plain_components(prints, max_bits=4):
    """Smallest id reachable, by brute force over all pairs of distinct fingerprints."""
    distinct = np.array(sorted({f for _, f in prints}), dtype=np.uint64)
    parent = list(range(len(distinct)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(distinct)):
        for j in np.flatnonzero(np.bitwise_count(distinct[i + 1:] ^ distinct[i]) <= max_bits) + i + 1:
            parent[root(i)] = root(int(j))
    where = {int(f): i for i, f in enumerate(distinct)}
    least = {}
    for k, f in prints:
        if k is not None:
            r = root(where[f])
            least[r] = min(least.get(r, k), k)
    return sorted(((k, f, least.get(root(where[f]))) for k, f in prints), key=str)


@pytest.mark.parametrize("text", [
    None, "", " \n\t", "One", "a b c", "A b\x0bC d", "x y z w v", "É à Ô \x85 nb\xa0sp", "the " * 3000, "Ab cD " * 700 + "tail",
])
def test_fingerprint(text):
    assert simhash.fingerprint(text) == plain_fingerprint(text)


def test_op7_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    want = plain_components([(d.doc_id, plain_fingerprint(d.text)) for d in docs])
    got = sorted(((r.doc_id, int(r.fingerprint, 16), r.component_id) for r in queries.op7_simhash(spark, SF).collect()), key=str)
    assert got == want
    assert all(len(r.fingerprint) == 16 for r in queries.op7_simhash(spark, SF).limit(5).collect())


def clustered(rng, n):
    """Fingerprints with chains and dense groups of near ones, and correlated bits."""
    out = []
    for _ in range(n // 40):
        base = rng.getrandbits(64)
        base = base & ~0xFF | (0xFF if rng.random() < 0.7 else 0)
        x = base
        for k in range(40):
            x = (base if k % 2 else x) ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(6)))
            out.append(x & (2**64 - 1))
    return out


@pytest.mark.parametrize("limit", [20_000, 7])
def test_links_equal_brute_force(spark, limit):
    fps = clustered(random.Random(5), 1200) + [0, 1, 2**64 - 1]
    rows = [(i, int(np.uint64(f).astype(np.int64))) for i, f in enumerate(fps)]
    prints = spark.createDataFrame(rows, "doc_id long, fp long").distinct()
    links = simhash.near_links(prints.select("fp").distinct(), group_limit=limit)
    comp = {r.node: r.root for r in components.connected_components(links).collect()}
    want = plain_components([(i, f) for i, f in enumerate(fps)])
    groups, brute = {}, {}
    for i, f in rows:
        groups.setdefault(comp.get(f, f), set()).add(i)
    for k, _, c in want:
        brute.setdefault(c, set()).add(k)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, brute.values()))


@pytest.mark.parametrize("total", [100, 10**6, 10**9, 10**12])
def test_every_plan_is_complete(total):
    rng = np.random.default_rng(2)
    bits = (rng.random((500, 64)) < rng.random(64)).astype(float)
    plan = simhash.allocate(total, bits.T @ bits / 500 * total, 4)
    assert sum(e + 1 for _, e in plan.parts) == 5
    probes = plan.probes()
    r = random.Random(1)
    for _ in range(2000):
        a = r.getrandbits(64)
        b = a ^ sum(1 << k for k in r.sample(range(64), r.randrange(5)))
        met = False
        for mask, flips, e in probes:
            va, vb = {(a & mask) ^ int(f) for f in flips}, {(b & mask) ^ int(f) for f in flips}
            met |= bool(va & vb) if e != 1 else (a & mask) in vb or (b & mask) in va
        assert met


def test_plans_change_with_size():
    even = np.full((64, 64), 0.25) + np.eye(64) * 0.25
    assert len({len(simhash.allocate(n, even * n, 4).parts) for n in (10**4, 10**10)}) == 2


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (5, "one two three four five"), (None, "one two three four five"), (3, "One TWO three four five"),
            (3, "One TWO three four five"), (9, "x"), (None, "alone in the world it is")]
    docs = spark.createDataFrame([(k, t, "z") for k, t in rows], "doc_id long, text string, fp string")
    got = sorted(((r.doc_id, r.component_id) for r in simhash.near_duplicates(docs).collect()), key=str)
    assert got == sorted([(1, 1), (2, 1), (5, 3), (None, 3), (3, 3), (3, 3), (9, 9), (None, None)], key=str)
    kept = sorted((str(r.doc_id) for r in simhash.keep_one_of_each(docs).collect()))
    assert kept == sorted(["1", "3", "3", "9", "None", "None"])
    assert simhash.near_duplicates(docs.where("false")).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, 101), (101, 100), (7, 7), (300, 200), (200, 250), (400, 400)]
    got = {r.node: r.root for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(51)}, 100: 100, 101: 100, 200: 200, 250: 200, 300: 200}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
