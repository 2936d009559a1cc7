import random

import pytest

from wavecut.llm import queries, templates

SF = "/root/testdata/sf0.001"
ITEM = "A train leaves for Boston at 60 km per hour while Alice walks 3 km and Bob drives 75 miles to meet Alice near the old mill."
FILL = "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua"


@pytest.fixture(scope="module")
def items(spark):
    rows = [(1, ITEM), (2, "what is the sum of these"), (3, None), (4, ""), (5, "1 2 3 4 5 6 7"), (6, "alpha beta gamma delta epsilon zeta eta theta iota kappa")]
    return spark.createDataFrame(rows, "item_id long, text string")


def found(spark, items, texts, **options):
    docs = spark.createDataFrame([(i, t, "k") for i, t in enumerate(texts)], "doc_id long, text string, kind string")
    return {(r.doc_id, r.item_id): r for r in templates.contaminated(docs, items, **options).collect()}


def test_kinds_of_copies(spark, items):
    changed = ITEM.replace("60", "95").replace("Alice", "Carol").replace("Boston", "Denver").replace("75", "12.5")
    inconsistent = ITEM.replace("Alice", "Carol", 1).replace("Boston", "Denver").replace("60", "1").replace("Bob", "Xavier").replace("75", "8").replace("3 km", "9 km")
    got = found(spark, items, [
        f"{FILL}. {ITEM} {FILL}", f"{FILL} {changed}", ITEM.upper().lower(), inconsistent, FILL,
        ITEM.replace("old mill", "new mill"), " ".join(ITEM.split()[:12]), f"{FILL} {ITEM.replace('walks', 'slowly walks')}", None, "",
        f"{ITEM} {FILL} {changed}", "9 8 7 6 5 4 3 2 1",
    ])
    assert got[0, 1].kind == "verbatim" and got[0, 1].similarity == 1.0
    assert got[1, 1].kind == "reparameterised" and got[1, 1].n_slots > 4
    assert (3, 1) not in got
    assert (4, 1) not in got and (6, 1) not in got and (8, 1) not in got and (9, 1) not in got
    assert got[10, 1].kind == "verbatim" and (11, 5) not in got
    assert {k for _, k in got} == {1}


def test_one_changed_word_and_one_more_word(spark, items):
    long = "every one of these fourteen plain words stands here to be found again after a single small change in the middle of it all"
    more = spark.createDataFrame([(9, long)], "item_id long, text string")
    words = long.split()
    got = found(spark, more, [long, " ".join([*words[:12], "extra", *words[12:]]), long.replace("it all", "it now"), " ".join(words[::-1])])
    assert {k[0] for k in got} == {0, 1, 2}
    assert got[1, 9].similarity >= 0.8


def test_brute_force_containment(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    bench = spark.read.parquet(f"{SF}/benchmark.parquet").collect()
    got = {(r.doc_id, r.item_id) for r in queries.op6_template_decontamination(spark, SF).collect()}

    def grams(t):
        w = t.lower().split()
        return {tuple(w[i:i + 5]) for i in range(len(w) - 4)}

    item_grams = {b.item_id: grams(b.text) for b in bench}
    want = {(d.doc_id, k) for d in docs for g in [grams(d.text or "")] for k, x in item_grams.items() if x and len(x & g) / len(x) >= 0.9}
    any_overlap = {(d.doc_id, k) for d in docs for g in [grams(d.text or "")] for k, x in item_grams.items() if x and len(x & g) / len(x) >= 0.5}
    assert want <= got <= any_overlap


def test_odd_tables(spark, items):
    docs = spark.createDataFrame([(None, ITEM), (1, ITEM), (1, ITEM), (2, "word " * 30000), (3, FILL)], "doc_id long, text string")
    got = templates.contaminated(docs, items).collect()
    assert sorted((str(r.doc_id), r.item_id) for r in got) == [("1", 1), ("None", 1)]
    kept = templates.without_contaminated(docs, items).collect()
    assert sorted(str(r.doc_id) for r in kept) == ["2", "3", "None"]
    assert templates.contaminated(docs.where("false"), items).count() == 0
    assert templates.contaminated(docs, items.where("false")).count() == 0


def test_small_filter_changes_nothing(spark, items):
    a = found(spark, items, [f"{FILL} {ITEM}", FILL], filter_bits=7)
    assert set(a) == {(0, 1)}


def test_repeated_template_in_one_item(spark):
    text = "In the big yard while Alice has 3 red apples, Bob has 5 red apples and they want to share all of them with every child in town today"
    more = spark.createDataFrame([(1, text)], "item_id long, text string")
    changed = text.replace("Alice", "Carol").replace("Bob", "Dave").replace("3", "8").replace("5", "11")
    extra = changed.replace("yard", "open yard")
    mixed = text.replace("Alice", "Carol").replace("Bob", "Carol").replace("3", "8").replace("5", "11")
    got = found(spark, more, [f"{FILL} {changed} {FILL}", text, extra, mixed])
    assert {k[0]: r.kind for k, r in got.items()} == {0: "reparameterised", 1: "verbatim", 2: "reparameterised"}
    assert got[0, 1].similarity == 1.0


def test_items_dense_in_numbers(spark):
    rows = [(1, "Compute 12 + 34 * 56 - 78"), (2, "3 km 4 km 5 km 6 km 7 km"), (3, ITEM), (4, "2 4 8 16 32 64 128 256")]
    more = spark.createDataFrame(rows, "item_id long, text string")
    changed = ITEM.replace("60", "95").replace("3 km", "9 km").replace("75", "12.5")
    got = found(spark, more, [f"{FILL} {t} {FILL}" for _, t in rows] + [changed, "3 4 8 17 32 65 128 257", "Compute 13 + 34 * 57 - 79"])
    assert {k: r.kind for k, r in got.items()} == {(0, 1): "verbatim", (1, 2): "verbatim", (2, 3): "verbatim", (3, 4): "verbatim", (4, 3): "reparameterised"}


def test_names_that_open_a_sentence(spark):
    rows = [(1, "Alice has 3 apples. Bob gives her 5 more. How many apples does Alice have?"),
            (2, "They went to see Alice's new house and Alice's old garden before Bob's mother came home to cook.")]
    more = spark.createDataFrame(rows, "item_id long, text string")
    new = [t.replace("Alice", "Carol").replace("Bob", "Dave").replace("3", "8").replace("5", "11") for _, t in rows]
    wrong = new[1].replace("Carol's old", "Erin's old")
    got = found(spark, more, [f"{FILL}. {t} {FILL}" for t in new] + [t for _, t in rows] + [wrong, f"{FILL} {rows[0][1]}", FILL.title()])
    kinds = {k: r.kind for k, r in got.items()}
    assert kinds == {(0, 1): "reparameterised", (1, 2): "reparameterised", (2, 1): "verbatim", (3, 2): "verbatim", (5, 1): kinds[5, 1]}


def test_case_number_words_and_longer_names(spark):
    rows = [
        (1, "Alice has 12 red marbles and gives 5 of them to Bob before they both walk home"),
        (2, "A farmer fills three baskets with ripe pears and five apples for the market near his house"),
        (3, "Name two gases."), (4, "x + 2"), (5, "a b"),
    ]
    items = spark.createDataFrame(rows, "item_id long, text string")
    one, two = rows[0][1], rows[1][1]
    got = found(spark, items, [
        f"{FILL} {one.lower()}", f"{FILL} {one.upper()}", f"{FILL}. {one.replace('Alice', 'Mary Ann')}", two.replace("three", "seven").replace("five", "nine"),
        f"Please name two gases {FILL}", one.replace("12", "40").replace("Bob", "Tom Lee").lower(), "say x + 2 now", "a b a b a b", FILL,
    ])
    assert set(got) == {(0, 1), (1, 1), (2, 1), (3, 2), (4, 3)}
    assert got[0, 1].kind == got[1, 1].kind == got[4, 3].kind == "verbatim"
    assert got[2, 1].kind == got[3, 2].kind == "reparameterised"


def test_recall_by_kind_of_change(spark):
    """Against the changes made: case, numbers in figures and words, names of one and two words."""
    rng = random.Random(4)
    nouns = [f"{a}{b}" for a in ("bra", "tel", "mor", "kin", "sop") for b in ("dle", "vin", "ker", "pos", "tam")]
    people, texts, want = ["Alice", "Bob", "Carla", "Dmitri", "Erin"], [], set()
    items = []
    for k in range(60):
        a, b = rng.sample(people, 2)
        n = rng.sample(range(2, 99), 2)  # one value of the item may not stand for two
        words = rng.sample(nouns, 12)
        make = lambda a, b, n, w=words: f"when {a} takes {n[0]} {' '.join(w[:4])} from {b} and {' '.join(w[4:8])} leaves {n[1]} {' '.join(w[8:])}"
        items.append((k, make(a, b, n)))
        changes = [make(a, b, n).lower(), make(a, b, n).upper(), make(b, a, n), make(a, b, [7, 8]), make(a, b, ["seven", "forty"]), make("Mary Ann", b, n), make("Jo", "Ann Lee", [3, "six"])]
        for c in changes:
            want.add((len(texts), k))
            texts.append(f"{FILL} {c} {FILL}")
    got = found(spark, spark.createDataFrame(items, "item_id long, text string"), texts)
    assert set(got) == want


def test_contaminated_documents_go_without_moving_the_others(spark, items):
    """The few ids are broadcast: no text is shuffled; rows without an id stay, repeated ids go together."""
    rows = [(1, ITEM), (1, FILL), (2, FILL), (None, ITEM), (3, None), (2, FILL)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    kept = templates.without_contaminated(docs, items)
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    assert sorted(map(str, (tuple(r) for r in kept.collect()))) == sorted(map(str, rows[2:]))


def test_word_table_starts_anew(spark):
    """A table that is made longer in steps, or was full, gives the same tokens."""
    texts = [f"{ITEM} {FILL} w{k} {k} km" for k in range(40)]
    whole, steps = templates.WordKinds().tokens(texts), templates.WordKinds(limit=20)
    for k, t in enumerate(texts):
        one = steps.tokens([t])
        inside = whole.doc == k
        assert one.hash.tolist() == whole.hash[inside].tolist() and one.type.tolist() == whole.type[inside].tolist()
        assert len(steps.rows) < 100 and len(steps.kind) == len(steps.hash) == len(steps.rows)
