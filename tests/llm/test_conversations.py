import hashlib
import heapq
import random
import re
import zlib
from collections import Counter

import pytest

from wavecut.llm import conversations as C
from wavecut.llm.queries import op11_conversation_repair

FIELDS = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
SCHEMA = "conv_id long, turn long, role string, text string"
WELL_FORMED = re.compile(r"(s?(ua)+)?")


def broken(rows):
    """The damage, row by row."""
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


def cheapest(turns):
    """Uniform-cost search over all edit sequences: ``(cost, audit, repaired)``; turns are ``(role, text, fault)``."""
    heap = [(0, "", 0, "", ())]
    bound = 3 * len(turns)  # deleting all
    while heap:
        cost, audit, i, initials, said = heapq.heappop(heap)
        if i == len(turns) and WELL_FORMED.fullmatch(initials):
            return cost, audit, said

        def push(more, op, at, new):
            initials_ = initials + "".join(r[:1] or "-" for r, _ in new)
            if cost + more <= bound and re.fullmatch(r"s?(ua)*u?", initials_):
                heapq.heappush(heap, (cost + more, audit + op, at, initials_, said + tuple(f"{r}:{t}" for r, t in new)))

        for role in ("user", "assistant"):
            push(2, "I", i, [(role, "")])
        if i < len(turns):
            role, text, fault = turns[i]
            push(3, "D", i + 1, [])
            if fault not in ("blank", "duplicate"):
                extra = int(fault == "truncated")
                push(extra, "K", i + 1, [(role, text)])
                for other in ("user", "assistant"):
                    push(2 + extra, "R", i + 1, [(other, text)])


def brute(rows):
    out = []
    for conv in {r[0] for r in rows}:
        mine = sorted((r for r in broken(rows) if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
        seen, turns, faults, illegal = set(), [], Counter(), 0
        for _, _, role, text in mine:
            end = text.rstrip(" \t\n\v\f\r")
            fault = "blank" if not end else "duplicate" if (role, text) in seen else "" if end[-1] in ".!?" else "truncated"
            seen.add((role, text))
            illegal += bool(turns) and turns[-1][0][:1] + role[:1] not in ("su", "ua", "au")
            turns.append((role, text, fault))
            faults[fault] += 1
        numbers = [r[1] for r in mine if r[1] is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        cost, audit, said = cheapest(turns)
        digest = hashlib.sha256("\n".join(said).encode()).hexdigest()
        out.append((conv, gaps, faults["blank"], faults["duplicate"], faults["truncated"], illegal, cost, audit, digest))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r[f] for f in FIELDS) for r in df.collect()), key=str)


def random_rows(rng, conversations=150):
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", None, "sys", "u"]
    texts = ["Yes.", "No!", "no end", " ", "", None, "Why?  ", "tail \n", "x"]
    rows = []
    for conv in range(conversations):
        for turn in range(rng.randrange(1, 7)):
            number = rng.choice([turn, turn, turn, turn + 3, None])
            rows.append((conv, number, rng.choice(roles), rng.choice(texts)))
    return rows


def test_query_by_definition(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert got(op11_conversation_repair(spark, "/root/testdata/sf0.001")) == brute(rows)


@pytest.mark.parametrize("chunk_rows, chunk_bytes", [(4096, 1 << 24), (2, 1 << 24), (1, 1 << 24), (100, 9)])
def test_chunks_do_not_change_it(spark, chunk_rows, chunk_bytes):
    rows = random_rows(random.Random(chunk_rows))
    turns = spark.createDataFrame(rows, SCHEMA).repartition(7)
    edited = C.with_edits(C.damaged(turns), chunk_rows=chunk_rows, chunk_bytes=chunk_bytes)
    want = brute(rows)
    assert got(C.reports(turns, edited)) == want
    said = {}
    for r in sorted(C.repaired_turns(edited).collect(), key=lambda r: (r.chunk, r.at, r.k)):
        said.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
    for conv, *_, digest in want:
        assert hashlib.sha256("\n".join(said.get(conv, [])).encode()).hexdigest() == digest


def test_crossings_equal_the_search():
    rng = random.Random(5)
    for _ in range(300):
        codes = "".join(rng.choice("uauauasxDUAS") for _ in range(rng.randrange(1, 8)))
        names = {"s": "system", "u": "user", "a": "assistant", "x": "other"}
        turns = [("user", "t", "blank") if c == "D" else (names[c.lower()], "t", "truncated" if c.isupper() else "") for c in codes]
        found = C.repair(codes)
        state = C.run_edits(found[-1][0], codes[-1], found[-1][1])
        assert "".join(e for _, e in found) + C.CLOSING[state] == cheapest(turns)[1]
        cut = rng.randrange(len(codes) + 1)
        steps = [C.summary(part) for part in (codes[:cut], codes[cut:]) if part]
        after = C.crossings(steps, 0, C.CLOSE)
        if 0 < cut < len(codes):
            assert after[0] == found[cut][0]
        assert after[-1] == state


def test_long_conversation(spark):
    rows = [(7, k, "user" if k % 2 == 0 or k % 11 == 0 else "assistant", f"turn {k}." if k % 13 else "same.") for k in range(3000)]
    rows += [(None, None, "user", "again.")] * 500 + [(8, 1, "assistant", "word " * 200_000 + "end.")]
    turns = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA + ", state string").repartition(6)
    whole = got(C.reports(turns, C.with_edits(turns)))
    parts = got(C.reports(turns, C.with_edits(turns, chunk_rows=64, chunk_bytes=5000)))
    assert whole == parts and len(whole) == 3
    by_id = {r[0]: r for r in whole}
    assert by_id[8][6:8] == (2, "IK")
    assert by_id[None][3] == 499 and by_id[None][6:8] == (499 * 3 + 2, "K" + "D" * 499 + "I")


def test_empty_and_all_dropped(spark):
    turns = spark.createDataFrame(random_rows(random.Random(1), 5), SCHEMA)
    assert got(C.reports(turns.where("false"), C.with_edits(turns.where("false")))) == []
    dropped = next((c, t) for c in range(50) for t in range(50) if zlib.crc32(f"{c}:{t}".encode()) % 20 == 0)
    gone = spark.createDataFrame([(*dropped, "user", "Hi.")], SCHEMA)
    assert got(C.reports(gone, C.with_edits(C.damaged(gone)))) == [(dropped[0], 0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())]
