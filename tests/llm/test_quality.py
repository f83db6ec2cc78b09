import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm import quality

WORDS = " ".join(f"w{k}" for k in range(60))
TEXTS = {
    1: None,
    2: "",
    3: " \n\t ",
    4: WORDS,
    5: "one two three " * 40,
    6: WORDS + " one two three four" * 12,
    7: WORDS.upper().replace("W", "WORD"),
    8: WORDS + "!" * 40,
    9: WORDS + " #*$%&|<>" * 5,
    10: "\n".join([WORDS, *["same line here"] * 9]),
    11: " ".join("x" * 30 + str(k) for k in range(60)),
    12: " ".join(f"word{k % 4000}" for k in range(30_000)),
    13: "a " * 49 + "ä",
    14: "x" * 200_000,
}


def brute(text):
    t = text or ""
    words = [w for w in __import__("re").split("[\x20\t\n\x0b\x0c\r]+", t) if w]
    lines = [x for x in t.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    windows = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    count = {}
    for w in windows:
        count[w] = count.get(w, 0) + 1
    covered = {k + j for k, w in enumerate(windows) if count[w] > 1 for j in range(3)}
    return {
        "n_words": len(words),
        "word_chars": sum(map(len, words)),
        "n_symbols": sum(c in "#*$%&|<>" for c in t),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len(covered),
        "n_same_windows": len(windows) - len(set(windows)),
        "n_capitals": sum("A" <= c <= "Z" for c in t),
        "n_exclamations": t.count("!"),
        "n_lines": len(lines),
    }


def failed(text):
    m = brute(text)
    hold = {
        "few_words": m["n_words"] < 50,
        "repeats": 2 * m["n_repeat_words"] > m["n_words"],
        "symbols": 2 * m["n_symbols"] > m["n_words"],
        "shouting": 2 * m["n_capitals"] > m["word_chars"],
        "exclamations": 2 * m["n_exclamations"] > m["n_words"],
        "duplicate_lines": m["n_dup_lines"] >= 3 and 2 * m["n_dup_lines"] > m["n_lines"],
        "word_length": m["word_chars"] < 2 * m["n_words"] or m["word_chars"] > 15 * m["n_words"],
    }
    return {name for name, holds in hold.items() if holds}


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(k, t, "x") for k, t in TEXTS.items()], "doc_id int, text string, failed_rule string")


def test_measures(spark, docs):
    t = F.coalesce("text", F.lit(""))
    names = list(brute(""))
    for row in docs.select("doc_id", *(quality.measure(x, t).alias(x) for x in names)).collect():
        assert {x: row[x] for x in names} == brute(TEXTS[row.doc_id]), row.doc_id


@pytest.mark.parametrize("keep", [(), ("n_words", "n_repeat_words", "n_dup_lines")])
def test_cascade(docs, keep):
    out = quality.cascade(docs, keep_measures=keep)
    assert out.columns == ["doc_id", "text", "failed_rule", *keep]
    for row in out.collect():
        own = failed(TEXTS[row.doc_id])
        assert row.failed_rule in own if own else row.failed_rule is None, row.doc_id
        assert [row[x] for x in keep] == [brute(TEXTS[row.doc_id])[x] for x in keep]


def test_guard_never_hides_its_rule():
    for text in TEXTS.values():
        m = brute(text)
        if 2 * m["n_repeat_words"] > m["n_words"]:
            assert 12 * m["n_same_windows"] >= m["n_words"]


def test_stops_at_the_first_rule_that_holds(spark):
    """A rule after one that holds isn't evaluated: it would raise."""
    docs = spark.createDataFrame([(1, "a b")], "doc_id int, text string")
    rules = (
        quality.Rule("first", ("n_words",), lambda m: m["n_words"] < 50),
        quality.Rule("never", ("n_symbols",), lambda m: F.raise_error(F.lit("evaluated")).cast("boolean")),
    )
    t = F.col("text")
    verdict = F.when(quality.rejects(rules[0], t), "first").when(quality.rejects(rules[1], t), "never")
    assert docs.select(verdict.alias("v")).first().v == "first"
    # in the chain, too, where measures of the first serve the second
    assert docs.select(quality._verdict(rules, t, {}).alias("v")).first().v == "first"


def test_repeated_windows_few_and_many(spark):
    """On both sides of the number of repeated hashes up to which they are looked for one by one."""
    several = [" ".join(f"a{k} b{k} c{k} x{k}" for k in [*range(n), *range(n // 2)]) for n in (0, 1, 2, 6, 8, 10, 12, 40, 400)]
    texts = [*several, "a a", "a a a", "a a a a", "a b a b a b", " \x0b a\tb\r\nc  a b c ", "a\u00a0b a\u00a0b a\u00a0b a\u00a0b", *(("q " * n).strip() for n in (2, 3, 17, 18, 200))]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    t = F.col("text")
    for row in rows.select("text", *(quality.measure(x, t).alias(x) for x in ("n_words", "n_repeat_words", "n_same_windows", "word_chars"))).collect():
        want = brute(row.text)
        assert all(row[x] == want[x] for x in ("n_words", "n_repeat_words", "n_same_windows", "word_chars")), row.text[:60]


def test_edges(spark, docs):
    assert quality.cascade(docs.where("false")).collect() == []
    twice = quality.cascade(docs.union(docs))
    assert twice.count() == 2 * len(TEXTS)
    odd = spark.createDataFrame([(None, None)], T.StructType([T.StructField("doc_id", T.IntegerType()), T.StructField("text", T.StringType())]))
    assert quality.cascade(odd).first().failed_rule == "few_words"


def test_order_is_by_rejections_per_cost(docs):
    found = quality.order_rules(docs)
    assert {r.name for r, _, _ in found} == {r.name for r in quality.RULES}
    gain = [share / seconds for _, seconds, share in found]
    assert gain == sorted(gain, reverse=True)
