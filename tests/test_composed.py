import pytest
from pyspark.sql import functions as F

from quern.functions import scalars, tokenizer
from quern.operators import datasets, measures, mixing, rows


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_tokenizer_plug_ins(spark):
    own = tokenizer.Tokenizer("own", 300, lambda: lambda t: [256, *t.encode(), 257], ("<s>", 256), ("</s>", 257))
    assert own.adds() == (True, True) and not own.metadata()["append_bos"]
    plain = tokenizer.tokenizer("bytes")
    assert plain.adds() == (False, False) and plain.metadata() == {"tokenizer": "bytes", "vocab_size": 258, "append_bos": True, "append_eos": True}
    df = spark.createDataFrame([(1, "ab"), (2, None), (3, "")], "k int, text string")
    for tok in (own, plain):
        assert [r.ids for r in tokenizer.encode(df, tok).orderBy("k").collect()] == [[256, 97, 98, 257], [256, 257], [256, 257]]
    with pytest.raises(ValueError, match="unknown tokenizer"):
        tokenizer.tokenizer("none")


def test_long_texts_are_cut_at_white_space(spark):
    def brute(text, limit):
        out = []
        while len(text) > limit:
            cut = next((i for i in range(limit, len(text)) if text[i].isspace()), None)
            if cut is None:
                break
            out.append(text[:cut])
            text = text[cut:]
        return [*out, text]

    texts = ["", "abc", "a" * 30, "ab cd " * 9, "word " * 2 + "x" * 25 + " y", "ä\nö " * 12, "1234567890", "1234567890 ", "1234567890 a"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r.p for r in df.select(tokenizer.split_long(F.col("t"), 10).alias("p")).collect()] == [brute(t, 10) for t in texts]


def test_formats_and_packs(spark):
    assert datasets.format_of({"type": "supervised", "prompt": "q"}) == datasets.SupervisedFormat(prompt="q")
    with pytest.raises(ValueError, match="unknown format"):
        datasets.format_of({"type": "other"})
    with pytest.raises(ValueError, match="generations"):
        datasets.ChatFormat(template="{{ messages }}")
    chat = spark.createDataFrame([(0, [1, 2, 3], [0, 1, 1]), (1, [4, 5], [0, 1]), (2, list(range(10, 20)), [0] * 2 + [1] * 8)], "idx long, ids array<int>, mask array<int>")
    got = {r.pack: r for r in datasets.chat_dataset(chat, 6).collect()}
    assert got[0].tokens == [1, 2, 3, 4, 5, 0] and got[0].mask == [1, 1, 0, 1, 0, 0] and got[0].segments == [0, 0, 0, 1, 1, -1]
    assert got[1].tokens == [10, 11, 12, 13, 14, 15] and got[1].mask == [0, 1, 1, 1, 1, 0]
    pairs = chat.select("idx", "ids", F.lit(2).alias("sources_len"))
    got = {r.pack: r for r in datasets.supervised_dataset(pairs, 6).collect()}
    assert got[0].mask == [0, 0, 1, 0, 0, 0] and got[1].tokens == [14, 15, 16, 17, 18, 19] and got[1].mask == [1] * 6


def test_configurations(spark):
    with pytest.raises(NotImplementedError):
        datasets.Mixture((), stop="first_exhausted")
    with pytest.raises(ValueError):
        datasets.Mixture((), experiment=1.0)
    df = spark.range(10).withColumnRenamed("id", "idx")
    with pytest.raises(ValueError, match="asked for"):
        datasets.Single(max_train_batches=3, batch=5).train(df, 10)
    for single in (datasets.Single(seed=3), datasets.Single(seed=3, era=4)):
        rows_ = single.train(df.withColumn("v", F.col("idx")), 10).collect()
        assert sorted(r.v for r in rows_) == list(range(10)) == sorted(r.idx for r in rows_)
    assert [r.idx for r in datasets.Single(hold_out=2).validation(df, 10).orderBy("idx").collect()] == [0, 1]
    schedule = mixing.Schedule(((0, 8), (10, 16)))
    mix = datasets.Mixture((mixing.Stage(0, {"a": 1.0}), mixing.Stage(20, {"b": 1.0}), mixing.Stage(-1, {"a": 1.0})), block=8).rescaled(schedule)
    assert [s.start for s in mix.stages] == [0, 240]
    with pytest.raises(ValueError, match="last"):
        datasets.Mixture((mixing.Stage(-1, {}), mixing.Stage(0, {}))).rescaled(schedule)
    assert mixing.distinct_sizes(mixing.Schedule(((0, 8), (5, 16), (9, 8)))) == [8, 16]
    with pytest.raises(ValueError, match="devices"):
        mixing.check_divides(schedule, 3)
    mixing.check_divides(schedule, 3, allow=True)


def test_coverage_and_rows(spark):
    asked, answered = spark.range(0, 6), spark.range(0, 6)
    assert datasets.checked_coverage(asked, answered, "id").count() == 6
    with pytest.raises(ValueError, match="1 missing and 2 extra"):
        datasets.checked_coverage(spark.range(0, 6), spark.range(1, 8), "id")
    keys = rows.row_keys(spark.range(8).withColumnRenamed("id", "idx"), 3)
    assert {tuple(r) for r in keys.collect()} == {tuple(r) for r in rows.row_keys(spark.range(8).withColumnRenamed("id", "idx").repartition(3), 3).collect()}
    with pytest.raises(Exception, match="unequal"):
        rows.to_rows(spark.createDataFrame([([1], [1, 2])], "a array<int>, b array<int>"), "a", "b").collect()
    assert [tuple(r) for r in rows.list_table(spark, ["x", "y"], "string").orderBy("idx").collect()] == [(0, "x"), (1, "y")]


def test_scalars(spark):
    seconds = lambda t: one(spark, scalars.duration_seconds(F.lit(t)))
    assert seconds("1w3d2h32m") == 604800 + 3 * 86400 + 2 * 3600 + 32 * 60 and seconds("4:13:02.266") == pytest.approx(15182.266) and seconds("soon") is None and seconds("") is None
    with pytest.raises(Exception, match="negative"):
        seconds("-1h")
    assert one(spark, scalars.duration_text(F.lit(604800 + 61))) == "1w1m1s" and one(spark, scalars.duration_text(F.lit(0))) == "0s"
    nested = spark.createDataFrame([((1, (2,)), 3)], "a struct<b int, c struct<d int>>, e int")
    assert nested.select(*scalars.flat_columns(nested.schema)).first().asDict() == {"a/b": 1, "a/c/d": 2, "e": 3}
    assert one(spark, scalars.visible(F.lit("a  b\tc\nd e"))) == "a␣␣b⇥c⏎\nd e"
    assert one(spark, scalars.escaped_html(F.lit("<a & \"b\">"))) == "&lt;a &amp; &quot;b&quot;&gt;"
    logits = F.array(*(F.lit(x) for x in (0.0, 2.0, 1.0)))
    assert one(spark, scalars.sampled(logits, 0.0, F.lit(1))).choice == 1
    picks = [r.c for r in spark.range(3000).select(scalars.sampled(logits, 1.0, F.col("id")).choice.alias("c")).collect()]
    assert [picks.count(k) / 3000 for k in range(3)] == pytest.approx([0.09, 0.665, 0.245], abs=0.03)


def test_measures(spark):
    assert measures.total_tokens(4, 5) == 20 and measures.epoch_progress(15, 10, 3) == 0.5
    df = spark.createDataFrame([(["a", "b", "a"], 2.0, 1), (["a"], 4.0, 1), ([], 1.0, 2)], "tags array<string>, loss double, n int")
    assert {r.tag: (r.micro, r.tokens) for r in measures.losses_of_tags(df, "tags", "loss", "n").collect()} == {"a": (3.0, 2), "b": (2.0, 1), None: (1.75, 4)}
