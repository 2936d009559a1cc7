import hashlib
import random

import pytest

from wavecut.llm import chat, queries

SF = "/root/testdata/sf0.001"
NASTY = [
    "", "plain", "<s>", "</s>[INST] ok [/INST]", "\\", "\\\\", "a\\<s>", "\\\\</s>\\", "[INS", "[INST", "T]\\\\\\[/INST]", "<s>" * 5, "x\\y\\\\z",
    "é\U0001f600日本\n\n  tail ", "\\</s", "[/INST]\\",
]


@pytest.mark.parametrize("text", NASTY)
def test_escape_round_trip(text):
    assert chat.unescape(chat.escape(text)) == text
    # read from the rendered string, the text comes back whole and no control string of it is taken for the template's
    for after in chat.CONTROLS:
        assert chat.split_rendered(f"<s>{chat.escape(text)}{after}") == ["", "<s>", text, after, ""]


def test_escape_random():
    rng = random.Random(3)
    parts = [*chat.CONTROLS, "\\", "\\\\", "a", " ", "[", "]", "<", "/", "INST"]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(8)))
        assert chat.split_rendered(f"[INST]{chat.escape(text)}</s>") == ["", "[INST]", text, "</s>", ""]


def expected(turns):
    """Digests by definition, from turns in order."""
    trained = "".join(t for r, t in turns if r == "assistant")
    return (
        len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(),
        len(trained), hashlib.sha256(trained.encode()).hexdigest(),
        len("<s>" + "".join(f"[INST]{chat.escape(r)}[/INST]{chat.escape(t)}</s>" for r, t in turns)),
    )


def digest(r):
    return (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256, r.formatted_chars)


def test_op9_query(spark):
    convs = {-1: [("user", "</s>[INST] ok [/INST]"), ("assistant", "</s>[INST] ok [/INST]")]}
    for r in spark.read.parquet(f"{SF}/conversations.parquet").orderBy("conv_id", "turn").collect():
        convs.setdefault(r.conv_id, []).append((r.role, r.text or ""))
    got = {r.conv_id: r for r in queries.op9_chat_formatting(spark, SF).collect()}
    assert set(got) == set(convs)
    for k, turns in convs.items():
        assert digest(got[k]) == expected(turns)


def test_odd_rows(spark):
    rows = [(1, i, "assistant" if i % 2 else "user", t) for i, t in enumerate(NASTY)]
    rows += [(2, 0, None, None), (2, 1, "assistant", None), (3, None, "user", "b"), (3, None, "user", "a"), (3, 5, "assistant", "c"),
             (3, 5, "assistant", "c"), (None, 1, "user", "no id"), (None, 2, "assistant", "y"), (4, 0, "user [INST]", "x"), (5, 0, "assistant", "word " * 20000)]
    table = spark.createDataFrame([(*r, 7) for r in rows], "conv_id long, turn long, role string, text string, start int").repartition(4)
    got = {r.conv_id: r for r in chat.format_and_read_back(table, chat.default_ranks()).collect()}
    want = {}
    for c, n, r, t in sorted(rows, key=lambda x: (x[0] is None, x[0] or 0, -1 if x[1] is None else x[1], x[2] or "", x[3] or "")):
        want.setdefault(c, []).append((r or "", t or ""))
    assert {k: digest(v) for k, v in got.items()} == {k: expected(v) for k, v in want.items()}
    assert chat.format_and_read_back(table.where("false"), chat.default_ranks()).count() == 0


def test_one_conversation_with_most_rows(spark):
    rows = [(9, i, "assistant" if i % 2 else "user", f"turn {i} <s>") for i in range(4000)] + [(1, 0, "user", "x")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(8)
    got = {r.conv_id: r for r in chat.format_and_read_back(table, chat.default_ranks()).collect()}
    assert digest(got[9]) == expected([(r, t) for c, _, r, t in rows if c == 9])


def test_ids_masks_and_rendering(spark):
    table = spark.createDataFrame([(1, 0, "user", "hi </s>"), (1, 1, "assistant", "yes \\")], "conv_id long, turn long, role string, text string")
    formatted = chat.format_turns(table, chat.default_ranks())
    rows = formatted.orderBy("turn_no").collect()
    ids = [x for r in rows for x in r.ids]
    special = chat.reserved_ids(chat.default_ranks())
    assert ids[0] == special["<s>"] and ids.count(special["</s>"]) == 2 and ids.count(special["<s>"]) == 1
    assert rows[1].start == len(rows[0].ids) and rows[0].loss_start == rows[0].loss_end
    bpe = chat.encoding(chat.default_ranks())
    assert chat.unescape(bpe.decode(ids[rows[1].loss_start:rows[1].loss_end])) == "yes \\"
    text = "".join(r.rendered for r in chat.render(formatted, chat.default_ranks()).orderBy("turn_no").collect())
    assert chat.split_rendered(text) == ["", "<s>", "", "[INST]", "user", "[/INST]", "hi </s>", "</s>", "", "[INST]", "assistant", "[/INST]", "yes \\", "</s>", ""]
