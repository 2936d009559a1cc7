import random

import numpy as np
import pyarrow as pa
import pytest

from wavecut.llm import compact_windows as cw
from wavecut.llm import queries

SF = "/root/testdata/sf0.001"


def words(rng, n, vocabulary=5000):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def test_windows_are_those_of_the_definition():
    rng = np.random.default_rng(3)
    tokens = rng.integers(0, 60, 300, dtype=np.uint64)
    doc = np.repeat([0, 1, 2, 3], [150, 90, 5, 55])
    c, l, r = cw.compact_windows(tokens, doc, 10, 7)
    got = sorted(zip(c.tolist(), l.tolist(), r.tolist()))
    packed = (cw.mix64(tokens, 7) & np.uint64(0xFFFFFFFF00000000)) | np.arange(300, dtype=np.uint64)
    want = []
    for i in range(300):
        a = b = i
        while a > 0 and doc[a - 1] == doc[i] and packed[a - 1] > packed[i]:
            a -= 1
        while b < 299 and doc[b + 1] == doc[i] and packed[b + 1] > packed[i]:
            b += 1
        if b - a + 1 >= 10:
            want.append((i, a, b))
    assert got == want
    # every sequence of ten tokens lies in exactly one window
    for s in range(291):
        if doc[s] == doc[s + 9]:
            assert sum(a <= s <= i <= s + 9 <= b for i, a, b in got) == 1


def test_sliding_min():
    x = np.random.default_rng(1).integers(0, 1000, 100)
    for width in (1, 2, 3, 7, 46, 100, 101):
        assert cw.sliding_min(x, width).tolist() == [x[i:i + width].min() for i in range(101 - width)]


def planted(rng):
    passage, other = words(rng, 60), words(rng, 200)
    edited = passage[:30] + ["changed"] + passage[31:]
    inserted = passage[:20] + ["one", *passage[20:]]
    short = words(rng, 40)
    texts = {
        1: words(rng, 100) + passage + words(rng, 100), 2: words(rng, 30) + passage, 3: edited + words(rng, 80),
        4: words(rng, 70) + inserted + words(rng, 20), 5: other, 6: other, 7: words(rng, 20) + other + words(rng, 5),
        8: short + words(rng, 100), 9: words(rng, 60) + short, 10: words(rng, 300), 11: words(rng, 70) * 2,
        12: [w.upper() for w in passage] + words(rng, 10),
    }
    return {k: " ".join(v) for k, v in texts.items()}


def test_planted_passages(spark):
    texts = planted(random.Random(8))
    docs = spark.createDataFrame([(k, t, 0) for k, t in texts.items()], "doc_id long, text string, key int")
    got = cw.repeated_passages(docs).collect()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
        assert r.source_doc_id < r.doc_id and r.similarity >= 0.8 and r.word_end - r.word_start >= 50
        assert texts[r.doc_id][r.char_start:r.char_end].split() == texts[r.doc_id].split()[r.word_start:r.word_end]
    assert set(by) == {2, 3, 4, 6, 7, 12}
    assert any((r.word_start, r.word_end) == (30, 90) for r in by[2])
    assert any((r.word_start, r.word_end) == (0, 200) for r in by[6])
    cut = {r.doc_id: r for r in cw.without_repeats(docs.withColumn("n_chars", docs.key + 5)).collect()}
    assert set(cut) == set(texts) - {6}
    assert cut[2].text.split() == texts[2].split()[:30] and cut[2].n_chars == len(cut[2].text)
    assert cut[1].text == texts[1] and cut[1].n_chars == 5
    assert cut[7].text.split() == texts[7].split()[:20] + texts[7].split()[-5:]


def exact_repeats(docs, n=50):
    """(doc, word position) of every 50-word run that an earlier document holds."""
    first, out = {}, {}
    for k, t in sorted(docs):
        w = t.lower().split()
        for i in range(len(w) - n + 1):
            run = tuple(w[i:i + n])
            if first.setdefault(run, k) != k:
                out.setdefault(k, set()).update(range(i, i + n))
    return out


def test_op3_covers_all_exact_repeats(spark):
    docs = [(d.doc_id, d.text) for d in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    want = exact_repeats(docs)
    got = {}
    for r in queries.op3_repeated_passages(spark, SF).collect():
        got.setdefault(r.doc_id, set()).update(range(r.word_start, r.word_end))
    assert set(want) <= set(got)
    for k, v in want.items():
        assert v <= got[k]


def test_hot_line_with_repeats_behind_it(spark):
    rng = random.Random(4)
    line = words(rng, 12)
    texts = [words(rng, 80) + line + words(rng, 80) for _ in range(150)]
    passage = words(rng, 30) + line + words(rng, 30)
    for i in (40, 90, 130):
        texts[i] = words(rng, 50) + passage + words(rng, 50)
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string").repartition(6)
    assert {r.doc_id for r in cw.repeated_passages(docs).collect()} == {90, 130}


def around(rng, line, extra, changed=0, before=30):
    """Two texts with the same ``extra`` words around a line, ``changed`` of them in one text only."""
    left = words(rng, extra // 2, 10**6)
    right = words(rng, extra - extra // 2, 10**6)
    passage = left + line + right
    other = list(passage)
    for k in range(changed):
        other[k * 5] = f"x{k}"
    return [words(rng, before, 10**6) + p + words(rng, before, 10**6) for p in (passage, other)]


@pytest.mark.parametrize("line_words, extra, changed, copies", [(48, 8, 0, 40), (40, 20, 1, 40), (48, 8, 0, 150), (20, 40, 1, 150)])
def test_pairs_around_a_common_line(spark, line_words, extra, changed, copies):
    rng, rows, pairs = random.Random(line_words), [], set()
    for group in range(25):
        line = words(rng, line_words, 10**6)
        texts = [words(rng, 40, 10**6) + line + words(rng, 40, 10**6) for _ in range(copies - 2)] + around(rng, line, extra, changed)
        rng.shuffle(texts)
        first = len(rows)
        rows += [(first + k, " ".join(t)) for k, t in enumerate(texts)]
    found = {(r.source_doc_id, r.doc_id) for r in cw.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(8)).collect()}
    assert len(found) >= 25 - (changed > 0) and len({b // copies for _, b in found}) >= 25 - (changed > 0)
    assert all(a // copies == b // copies for a, b in found)


def test_stretches_of_hot_tokens_alone(spark):
    """Two hot lines in a row are a passage: equal ones are found, whatever else follows the lines."""
    rng = random.Random(12)
    lines = [words(rng, 30, 10**6) for _ in range(5)]
    texts = [words(rng, 60, 10**6) + lines[k % 5] + words(rng, 60, 10**6) for k in range(500)]
    for a, b in ((0, 1), (2, 3), (0, 4), (3, 1)):
        for _ in range(2):
            texts.append(words(rng, 40, 10**6) + lines[a] + lines[b] + words(rng, 40, 10**6))
    rows = [(k, " ".join(t)) for k, t in enumerate(texts)]
    found = {(r.source_doc_id, r.doc_id) for r in cw.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(8)).collect()}
    assert {(500, 501), (502, 503), (504, 505), (506, 507)} <= found


def test_every_place_of_a_passage_in_a_text(spark):
    rng = random.Random(3)
    passage = words(rng, 70)
    texts = [passage + words(rng, 30), words(rng, 100) + passage + words(rng, 60) + passage + words(rng, 9)]
    found = cw.repeated_passages(spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "doc_id long, text string")).collect()
    assert {(100, 170), (230, 300)} <= {(r.word_start, r.word_end) for r in found}


def test_clashing_columns(spark):
    rng = random.Random(9)
    text = " ".join(words(rng, 80))
    schema = "_id long, doc_id long, text string, _h string, _cuts int, c0 string, cls string, t int, id int, token int"
    docs = spark.createDataFrame([(9, 1, text, "h", 1, "a", "b", 2, 3, 4), (8, 2, text + " more words", "h", 1, "a", "b", 2, 3, 4)], schema)
    kept = {r.doc_id: r for r in cw.without_repeats(docs).collect()}
    assert kept[1].text == text and kept[2].text == "more words" and kept[2]["_id"] == 8 and kept[2]["_cuts"] == 1
    assert cw.without_repeats(docs).columns == docs.columns


def test_words_have_one_hash_wherever_they_are(monkeypatch):
    texts = ["One two\xa0THREE  one", "", "two", "x" * 300 + " éÉ one", " three\u3000two \n", "ab ba a b"]
    for block in (1 << 21, 16, 64):
        monkeypatch.setattr(cw, "BLOCK", block)
        got, counts = cw.word_tokens(texts)
        flat = [w for t in texts for w in t.lower().split()]
        assert counts.tolist() == [len(t.split()) for t in texts] and len(got) == len(flat)
        assert len(set(zip(flat, got.tolist()))) == len(set(flat)) == len(set(got.tolist()))
    tokens, sizes = cw.text_shingles(["a b c d e f", "b c", "z b c d e f y"])
    assert sizes.tolist() == [2, 0, 3] and tokens[1] == tokens[3] and len(set(tokens.tolist())) == 4
    assert [len(x) for x in cw.text_shingles(["", "a"])] == [0, 2]


def test_windows_with_equal_surroundings_come_once():
    rng = random.Random(5)
    phrase = words(rng, 7)
    b = cw.Batch([" ".join(words(rng, 60) + phrase * 60 + words(rng, 60)), " ".join(phrase * 60)])
    all_ = len(cw.compact_windows(b.tokens, b.doc, 46, 0)[0])
    kept = b.windows(46, 0, None)[0]
    assert len(kept) < all_ / 2 and {0, 1} == set(b.doc[kept].tolist())
    hot = np.zeros(cw.HOT_BITS // 64, dtype=np.uint64)
    slot = int(b.tokens[100] & np.uint64(cw.HOT_BITS - 1))
    hot[slot >> 6] |= np.uint64(1 << (slot & 63))
    order = cw.demote(cw.mix64(b.tokens, 0), b.tokens, hot)
    assert ((order >> np.uint64(63) > 0) == (b.tokens == b.tokens[100])).all()


def test_functions_must_agree_on_a_stretch():
    def agree(need, *rows):
        return cw.agreeing(*(np.array(x) for x in zip(*((*r, 0)[:4] for r in rows))), need, 46, 10)

    # diagonal, function, first and last token
    assert agree(2, (0, 0, 0, 60), (0, 1, 10, 80))
    assert not agree(2, (0, 0, 0, 60), (0, 0, 10, 80))
    assert not agree(2, (0, 0, 0, 60), (0, 1, 30, 90))
    assert not agree(2, (0, 0, 0, 60), (11, 1, 0, 60))
    assert agree(3, (0, 0, 0, 60), (0, 1, 0, 60), (8, 3, 14, 99)) and not agree(3, (0, 0, 0, 60), (0, 1, 0, 60), (8, 3, 40, 99))
    assert agree(2, (0, cw.SURE, 0, 60)) and agree(1, (0, 2, 0, 60))
    many = [(k, 0, 0, 100) for k in range(0, 30_000, 20)]
    assert not agree(2, *many) and agree(2, *many, (29_981, 1, 50, 120))


def test_many_copies_make_few_rows(spark):
    rng = random.Random(6)
    text = " ".join(words(rng, 120))
    docs = spark.createDataFrame([(i, text) for i in range(400)], "doc_id long, text string")
    got = cw.repeated_passages(docs).collect()
    assert {r.doc_id for r in got} == set(range(1, 400)) and len(got) <= 2 * 400


def test_odd_rows(spark):
    rng = random.Random(2)
    text, long = " ".join(words(rng, 80)), " ".join(words(rng, 30000, 10**6))
    rows = [(1, text), (1, text), (2, None), (3, ""), (None, text), (4, text), (5, "short one"), (6, long), (7, long), (8, "same " * 200), (9, "same " * 200)]
    docs = spark.createDataFrame([(k, t, "x") for k, t in rows], "doc_id long, text string, b string")
    got = cw.repeated_passages(docs).collect()
    assert {(r.doc_id, r.source_doc_id) for r in got} == {(4, 1), (7, 6), (9, 8)}
    assert cw.repeated_passages(docs.where("false")).count() == 0
    kept = [r.doc_id for r in cw.without_repeats(docs).collect()]
    assert sorted(map(str, kept)) == sorted(map(str, [1, 1, 2, 3, None, 5, 6, 8]))
    with pytest.raises(ValueError):
        cw.repeated_passages(docs, need=9)


def test_all_pairs_of_a_group_meet_whatever_its_size(spark):
    """Windows under one token are paired in full in groups of few and of many, alike or not around it."""
    for copies in (4, 14):
        rng = random.Random(copies)
        line = words(rng, 30)
        texts = [" ".join([*words(rng, 40), *line, *words(rng, 40)]) for _ in range(copies)]
        rows = spark.createDataFrame([(i, t, i) for i, t in enumerate(texts)], "cls long, t string, id long")
        windows = cw.window_rows(rows, 3, 46)
        place = lambda w: (w.at & ((1 << 36) - 1)) >> 3
        groups, want = {}, 0
        for w in windows.collect():
            groups.setdefault(w.key, []).append((w.cls, place(w) - (w.lr >> 32), (w.lr & 0xFFFFFFFF) - place(w)))
        for g in groups.values():
            want += sum(x[0] != y[0] and min(x[1], y[1]) + min(x[2], y[2]) + 1 >= 46 for k, x in enumerate(g) for y in g[:k])
        assert want > 0 and cw.group_pairs(windows, 46, 64, False).count() == want


def test_texts_are_sent_once_to_a_block_of_pairs(spark, scratch, monkeypatch):
    """Every pair is compared, whatever block it lies in, and a family's texts are not sent once for each of its pairs."""
    rng, n = random.Random(13), 24
    passage = words(rng, 70)
    texts = [words(rng, 20) + passage[:k] + ["changed"] + passage[k + 1:] + words(rng, 20) for k in range(n)]
    tokens = [cw.text_shingles([" ".join(t)])[0].astype(np.uint32) for t in texts]
    grams = spark.createDataFrame([(k + 100, bytearray(x.tobytes())) for k, x in enumerate(tokens)], "cls long, grams binary")
    rows = [(b + 100, a + 100, b, a, [0]) for b in range(n) for a in range(b)]
    pairs = spark.createDataFrame(rows, "hb long, ha long, b long, a long, diags array<long>").repartition(5)
    want = set()
    for _, _, b, a, diags in rows:
        for i0, i1, j0, j1, jaccard in cw.matching_spans(tokens[b], tokens[a], diags, 46, 0.8, 10, 12):
            want.add((b, b + 100, i0, i1 + cw.WIDTH, a, j0, j1 + cw.WIDTH, jaccard))
    assert len({(x[0], x[4]) for x in want}) > n
    for block in (256, 5):
        monkeypatch.setattr(cw, "BLOCK_TEXTS", block)
        found = cw.verified(pairs, grams, 46, 0.8, 10, 12, f"{scratch}/{block}")
        assert {tuple(r) for r in found.collect()} == want
        dealt = spark.read.parquet(f"{scratch}/{block}/dealt").collect()
        assert len(dealt) == n - 1 and {r.home for r in dealt} == {100} and (len({r.block for r in dealt}) > 1) == (block == 5)


def test_all_pairs_of_a_large_group_meet_in_blocks(spark, scratch, monkeypatch):
    rng = random.Random(21)
    monkeypatch.setattr(cw, "BLOCK_WINDOWS", 40)
    rows = []
    for key, n in ((5, 300), (6, 41), (7, 3)):
        for k in range(n):
            c = rng.randrange(100, 200)
            rows.append((key, rng.randrange(n), c << 3 | 2, (c - rng.randrange(60)) << 32 | (c + rng.randrange(60))))
    windows = spark.createDataFrame(rows + rows[:90], cw.WINDOWS).repartition(4)
    want, rows = set(), sorted(set(rows))
    for i, x in enumerate(rows):
        for y in rows[:i]:
            if x[0] != y[0] or x[1] == y[1]:
                continue
            b, a = (x, y) if x[1] > y[1] else (y, x)
            cb, ca = b[2] >> 3, a[2] >> 3
            before = min(cb - (b[3] >> 32), ca - (a[3] >> 32))
            behind = min((b[3] & 0xFFFFFFFF) - cb, (a[3] & 0xFFFFFFFF) - ca)
            if before + behind + 1 >= 46:
                want.add((b[1], a[1], cb - ca, 2, cb - before, cb + behind))
    got = [tuple(r) for r in cw.block_pairs(windows, 46, scratch).collect()]
    assert set(got) == want and len(want) > 1000


def test_no_partner_is_lost_in_a_group_that_stays_large(spark):
    """A changed passage lies far behind its only likes, with others in the groups of all its tokens first and in between."""
    rng = random.Random(31)
    passage = words(rng, 60, 10**6)
    changed, other = passage[:30] + ["changed"] + passage[31:], words(rng, 120, 10**6)
    halves = [passage[:30] + other[:60], other[60:] + passage[30:]]
    lines = halves * 70 + [passage] * 70 + halves * 70 + [changed] * 70
    rows = [(k, " ".join(words(rng, 20, 10**6) + line + words(rng, 20, 10**6))) for k, line in enumerate(lines)]
    found = cw.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(8)).collect()
    first = [r for r in found if r.doc_id == 350]
    assert any(140 <= r.source_doc_id < 210 and r.word_start <= 20 and r.word_end >= 80 for r in first)
    assert {r.doc_id for r in found} == set(range(2, 140)) | set(range(141, 420))


def test_words_are_found_in_the_bytes(monkeypatch):
    rng = random.Random(41)
    letters = "aAbBzZ \t\n\v\f\r\x1c\x1d\x1e\x1f._\x00\x7f"
    texts = ["".join(rng.choice(letters + wide) for _ in range(rng.randrange(50))) for wide in ("", "\x85\xa0\u2003\u2028\u3000\u201c\xe9\u20ac\u0130\u03a3\U0001f600") for _ in range(400)]
    texts += ["", " ", "\n" * 300 + "a", "x" * 70 + "\ty"]
    flat = [w for t in texts for w in t.lower().split()]
    for piece in (1 << 16, 64):
        monkeypatch.setattr(cw, "PIECE", piece)
        got, counts = cw.word_tokens(texts)
        assert counts.tolist() == [len(t.lower().split()) for t in texts] and len(got) == len(flat)
        assert len(set(zip(flat, got.tolist()))) == len(set(flat)) == len(set(got.tolist()))


def test_nearest_smaller_value():
    rng = np.random.default_rng(42)
    for values in (np.arange(200), np.arange(200)[::-1], rng.permutation(200)):
        values = np.concatenate([[-1], values])
        near = np.maximum(np.arange(201) - 1, 0)
        want = [max((j for j in range(i) if values[j] < values[i]), default=0) for i in range(201)]
        assert cw.nearest_smaller(values, near).tolist() == want


def evidence(rng, groups):
    rows = []
    for g in range(groups):
        n, fns = rng.choice((1, 2, 3, 8, 70)), rng.choice((1, 2, 5))
        for _ in range(n):
            low = rng.randrange(200)
            rows.append((g // 3, g, rng.randrange(-40, 41), cw.SURE if rng.random() < 0.01 else rng.randrange(fns), low, low + rng.randrange(45, 70)))
    return rows


@pytest.mark.parametrize("need", [1, 2, 3])
def test_pairs_are_agreed_on_together_as_alone(need):
    rng = random.Random(need)
    for _ in range(20):
        cols = [np.array(x, dtype=np.int8 if k == 3 else np.int64) for k, x in enumerate(zip(*evidence(rng, 30)))]
        got = {(r["b"], r["a"]): r["diags"] for r in cw.agreed(*cols, need, 46, 10).to_pylist()}
        want = {}
        for g in range(30):
            mine = cols[1] == g
            if cw.agreeing(*(c[mine] for c in cols[2:]), need, 46, 10):
                want[g // 3, g] = np.unique(cols[2][mine]).tolist()
        assert got == want


def test_evidence_is_not_gathered_in_lists(spark, scratch, plan_text):
    rng = random.Random(43)
    passage = words(rng, 70)
    source = spark.createDataFrame([(k, " ".join(words(rng, 30) + passage + words(rng, 30)), k) for k in range(30)], "cls long, t string, id long")
    pairs = cw.candidate_pairs(source, 5, 2, 46, 10, 64, scratch)
    assert "collect_list" not in plan_text(pairs)
    assert {(r.b, r.a) for r in pairs.collect()} == {(b, a) for b in range(30) for a in range(b)}


class Handed:
    """Stands for a table whose rows are given to the function itself."""

    def repartition(self, *_):
        return self

    sortWithinPartitions = select = repartition

    def mapInArrow(self, function, _):
        return function


def test_pairs_come_in_few_batches():
    rng = np.random.default_rng(44)
    key = np.sort(rng.integers(0, 400, 10_000))
    at = rng.integers(100, 200, 10_000)
    cols = [key, np.arange(10_000), at << 3 | 1, (at - 60) << 32 | (at + 60)]
    batches = [pa.RecordBatch.from_arrays([pa.array(c[k:k + 5000]) for c in cols], names=["key", "cls", "at", "lr"]) for k in (0, 5000)]
    got = list(cw.group_pairs(Handed(), 46, 64, False)(iter(batches)))
    sizes = np.unique(key, return_counts=True)[1]
    assert sum(x.num_rows for x in got) == (sizes * (sizes - 1) // 2).sum() and len(got) <= 6


def plain_spans(b, a, diag, shortest, similarity, slack, gap):
    """Runs near one diagonal, cut one by one."""
    where = {i: min((abs(i - j - diag), -j) for j in near) for i in range(len(b)) if (near := [j for j in range(len(a)) if b[i] == a[j] and abs(i - j - diag) <= slack])}
    out, stack = set(), [sorted((i, -x[1]) for i, x in where.items())]
    while stack:
        run = stack.pop()
        if len(run) < similarity * shortest:
            continue
        steps = [y[0] - x[0] for x, y in zip(run, run[1:])]
        across = [y[1] - x[1] for x, y in zip(run, run[1:])]
        other = {j for _, j in run}
        common = len(run) if min(across) > 0 else min(len(run), len(other))
        length = run[-1][0] - run[0][0] + 1
        jaccard = common / (length + max(other) - min(other) + 1 - common)
        if jaccard < similarity or max(steps) > gap:
            jumps = steps if max(steps) > 1 else [abs(x - 1) for x in across]
            cut = jumps.index(max(jumps)) + 1
            stack += [run[:cut], run[cut:]]
        elif length >= shortest:
            out.add((run[0][0], run[-1][0], min(other), max(other), jaccard))
    return out


def test_spans_are_those_cut_one_by_one():
    rng, found = random.Random(45), 0
    for _ in range(200):
        a = [rng.randrange(10**6) for _ in range(200)]
        b = a[40:160]
        for _ in range(rng.randrange(10)):
            k = rng.randrange(len(b))
            b[k:k + rng.randrange(3)] = [rng.randrange(10**6) for _ in range(rng.randrange(3))]
        b = [rng.randrange(10**6) for _ in range(40)] + b
        got = cw.matching_spans(np.array(b, dtype=np.uint32), np.array(a, dtype=np.uint32), [], 46, 0.8, 40, 12)
        want = plain_spans(b, a, 0, 46, 0.8, 100, 12)
        assert {x[:4] for x in got} == {x[:4] for x in want}
        found += len(want)
    assert found > 100
