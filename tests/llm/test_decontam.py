import random

from quern.llm import decontam

ITEM = "Maria buys 12 apples and 7 pears for Tom at the market near Leeds. How many fruits does Maria carry home to Tom after 3 days of walking?"


def docs_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, item_id string")


def test_reparameterised_question(spark):
    same = ITEM.replace("Maria", "Anna").replace("12", "45").replace("Tom", "Bob").replace("days", "weeks")
    mixed = same.replace("home to Bob", "home to Carl")
    rng = random.Random(1)
    noise = " ".join("".join(rng.choices("abcdef", k=5)) for _ in range(200))
    rows = [(1, f"{noise} {ITEM} {noise}", "x"), (2, f"{noise}. {same} {noise}", None), (3, mixed, None), (4, noise, None), (None, ITEM, None), (None, noise, None), (6, None, None), (7, "", None), (8, noise * 40 + ITEM, None), (8, noise * 40 + ITEM, None)]
    bench = spark.createDataFrame([(10, ITEM), (11, None), (12, "too short"), (13, "")], "item_id long, text string")
    found = {(r.doc_id, r.item_id, r.reparameterised) for r in decontam.findings(docs_of(spark, rows), bench).collect()}
    assert found == {(1, 10, False), (2, 10, True), (None, 10, False), (8, 10, False)}
    kept = [r.doc_id for r in decontam.clean(docs_of(spark, rows), bench).collect()]
    assert sorted(map(str, kept)) == sorted(map(str, [3, 4, None, 6, 7]))


def test_against_brute_force(spark):
    rng = random.Random(2)
    vocabulary = [f"v{chr(97 + i)}{chr(97 + j)}" for i in range(6) for j in range(6)]
    items = [(i, " ".join(rng.choices(vocabulary, k=25))) for i in range(8)]
    rows = []
    for d in range(80):
        words = rng.choices(vocabulary, k=60)
        if d % 2:
            part = items[rng.randrange(8)][1].split()[rng.randrange(0, 7) :]
            words[10:10] = part
        rows.append((d, " ".join(words), None))
    want = set()
    for d, text, _ in rows:
        w = text.split()
        for i, item in items:
            v = item.split()
            shifts = {}
            for p in range(len(v) - 4):
                for q in range(len(w) - 4):
                    if v[p : p + 5] == w[q : q + 5]:
                        shifts.setdefault(p, q)
            if len(shifts) >= 0.8 * (len(v) - 4):
                want.add((d, i))
    got = decontam.findings(docs_of(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want and want


def test_empty_tables(spark):
    bench = spark.createDataFrame([(10, ITEM)], "item_id long, text string")
    assert decontam.findings(docs_of(spark, []), bench).count() == 0
    assert decontam.findings(docs_of(spark, [(1, ITEM, None)]), bench.where("false")).count() == 0


def test_short_items_after_any_word(spark):
    items = {1: "Maria sells five green pears daily", 2: "Minutes pass before anyone notices that", 3: "tiny item", 4: "12 15 18 21 24 27 30 33 36 39", 5: "Where did Paul Meet Anna", 6: "1 2 3 4 5"}
    bench = spark.createDataFrame(list(items.items()), "item_id long, text string")
    rows = [(10 * i + k, f"{before} {text} and more of it follows here", None) for i, text in items.items() for k, before in enumerate(("", "Heading", "Question 5", "An end."))]
    rows.append((100, "pears Maria sells daily, tiny as an item", None))
    got = {(r.doc_id, r.item_id, r.reparameterised) for r in decontam.findings(docs_of(spark, rows), bench).collect()}
    assert got == {(10 * i + k, i, False) for i in items for k in range(4)}


def test_two_values_for_one(spark):
    item = "the box holds 3 apples and 5 pears which the old farmer picked early and then sold to a friend for 9 coins"
    same = item.replace("3", "4").replace("5", "4")
    once = item + " while it was raining all over the wide green valley and 3 crows sat on the fence near the barn until a boy with a long stick came out of the house and sent them away"
    rows = [(1, same, None), (2, once.replace("3 crows", "8 crows"), None)]
    bench = spark.createDataFrame([(1, item), (2, once)], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontam.findings(docs_of(spark, rows), bench).collect()}
    assert {(1, 1), (2, 1), (2, 2)} <= got


def test_a_block_of_words_is_small():
    """What a worker holds for its texts at once goes with this: 70 MB at 2**19 words, 22 at 2**15."""
    assert decontam._WORDS_AT_ONCE <= 1 << 16
