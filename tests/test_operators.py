import pytest
from pyspark.sql import functions as F

from quern.functions import arrays, tokens
from quern.operators import formats, indexing, measures, mixing, packing, sequences, shuffling


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_causal_and_prompt_masks(spark):
    df = spark.createDataFrame([([1, 2, 9, 3, 9, 4], 3)], "t array<int>, p int")
    r = df.select(
        arrays.causal_loss_mask(F.col("t")).alias("m"),
        arrays.ignore_mask(F.col("t"), arrays.causal_loss_mask(F.col("t")), 9).alias("i"),
        arrays.end_segments(F.col("t"), 9).alias("s"),
        arrays.n_end_segments(F.col("t"), 9).alias("n"),
        arrays.prompt_mask(F.col("t"), F.col("p")).alias("q"),
    ).first()
    assert r.m == [1, 1, 1, 1, 1, 0] and r.i == [1, 0, 1, 0, 1, 0] and r.s == [0, 0, 0, 1, 1, 2] and r.n == 3 and r.q == [0, 0, 1, 1, 1, 0]


@pytest.mark.parametrize("segments, sources, mask", [([0, 0, 1, 1, 1], [1, 2], [0, 1, 0, 0, 1]), ([0, 0, 1, 1], [2, 2], [0, 0, 0, 0]), ([0, 0, 1, 1], [0, 0], [1, 1, 1, 1]), ([0, 0, 0, 1, 1, 1], [2, 1], [0, 0, 1, 0, 1, 1]), ([0, 0, 0, 0], [2], [0, 0, 1, 1])])
def test_supervised_mask(spark, segments, sources, mask):
    df = spark.createDataFrame([(p, s, sources[s]) for p, s in enumerate(segments)], "pos int, seg int, source int")
    assert [m for _, m in rows(packing.segment_mask(df, "source", ["seg"]), "pos", "mask")] == mask


def test_chunks_do_not_depend_on_partitions(spark):
    data = [(i, list(range(10 * i, 10 * i + i % 4))) for i in range(50)]
    flat = [t for _, ids in data for t in ids]
    for n in (1, 7):
        df = spark.createDataFrame(data, "idx long, ids array<int>").repartition(n)
        got = rows(sequences.concat_and_chunk(df, 8), "seq", "tokens")
        assert got == [(k, flat[8 * k : 8 * k + 8]) for k in range(len(flat) // 8)]


def test_greedy_packs(spark):
    df = spark.createDataFrame([(0, i, n) for i, n in enumerate([100, 200, 150, 150])], "g int, idx long, n long")
    pack = lambda **k: [p for _, p in rows(packing.greedy_packs(df, {"n": 300}, k.get("segments", 64), "g"), "idx", "pack")]
    assert pack() == [0, 0, 1, 1] and pack(segments=1) == [0, 1, 2, 3]
    with pytest.raises(Exception, match="length 200 in 'n', which exceeds 150"):
        packing.greedy_packs(df, {"n": 150}, 64, "g").collect()
    assert [p for _, p in rows(packing.greedy_packs(df, {"n": 150}, 64, "g", on_long="alone"), "idx", "pack")] == [0, 1, 2, 3]


def test_packed_rows(spark):
    df = spark.createDataFrame([(0, 0, [1, 2, 3]), (0, 1, [4, 5]), (0, 2, [6, 7, 8])], "g int, idx long, ids array<int>").withColumn("n", F.size("ids").cast("long"))
    packs = packing.greedy_packs(df, {"n": 10}, 2, "g")
    got = rows(packing.packed(df, packs, 10, "g"), "pack", "tokens", "segments")
    assert got == [(0, [1, 2, 3, 4, 5, 0, 0, 0, 0, 0], [0, 0, 0, 1, 1, -1, -1, -1, -1, -1]), (1, [6, 7, 8, 0, 0, 0, 0, 0, 0, 0], [2, 2, 2, -1, -1, -1, -1, -1, -1, -1])]
    cut = packing.packed(df, packing.greedy_packs(df, {"n": 2}, 1, "g", on_long="alone"), 2, "g", side="right")
    assert [t for _, t in rows(cut, "pack", "tokens")] == [[2, 3], [4, 5], [7, 8]]


def test_first_fit(spark):
    df = spark.createDataFrame([(0, i, n) for i, n in enumerate([6, 6, 4, 4, 3])], "g int, idx long, n long")
    assert [p for _, p in rows(packing.first_fit_packs(df, 10, 2, 4, "g", n="n"), "idx", "pack")] == [0, 1, 0, 1, 2]
    # empty rows go nowhere, the pool is kept at its bound, and a row over the length is an error
    sizes = [6, 6, 6, 0, 6, 6, 6, 4, 4, 4]
    df = spark.createDataFrame([(0, i, n) for i, n in enumerate(sizes)], "g int, idx long, n long")
    assert [p for _, p in rows(packing.first_fit_packs(df, 10, 8, 3, "g", n="n"), "idx", "pack")] == [0, 1, 2, 3, 4, 5, 3, 4, 5]
    with pytest.raises(Exception, match="exceeds 5"):
        packing.first_fit_packs(df, 5, 2, 4, "g", n="n").collect()


@pytest.mark.parametrize("block", [4, 16, 1000])
def test_greedy_over_the_whole_table(spark, block):
    import random

    rng = random.Random(block)
    sizes = [rng.choice([0, 1, 2, 3, 5, 8, 10]) for _ in range(150)]
    packs, pack, used, n = [], -1, 0, 0
    for x in sizes:
        if pack < 0 or n == 4 or used + x > 10:
            pack, used, n = pack + 1, 0, 0
        used, n = used + x, n + 1
        packs.append(pack)
    df = spark.createDataFrame(list(enumerate(sizes)), "idx long, n long").repartition(7)
    assert rows(packing.greedy_packs_global(df, {"n": 10}, 4, rows=block), "idx", "pack") == list(enumerate(packs))
    with pytest.raises(Exception, match="exceeds 9"):
        packing.greedy_packs_global(df, {"n": 9}, 4, rows=block).collect()
    assert packing.greedy_packs_global(df.where("false"), {"n": 10}, 4).count() == 0


def test_prompts(spark):
    df = spark.createDataFrame([(0, [1, 2, 3, 4], 2), (1, [5, 6], 1), (2, list(range(10, 22)), 5)], "idx long, ids array<int>, prompt_length int")
    got = rows(packing.packed_prompts(df, 8, 4, pad=0), "pack", "tokens", "segments", "mask")
    assert got == [(0, [1, 2, 3, 4, 5, 6, 0, 0], [0, 0, 0, 0, 1, 1, -1, -1], [0, 1, 1, 0, 1, 0, 0, 0]), (1, list(range(14, 22)), [2] * 8, [1] * 7 + [0])]
    with pytest.raises(Exception, match="longer than its prompt"):
        packing.checked_prompts(spark.createDataFrame([([1, 2], 2)], "ids array<int>, prompt_length int")).collect()


def test_index_rows(spark):
    df = indexing.dense_index(spark.createDataFrame([(7 * i, i) for i in range(100)], "key long, v int").repartition(5), "key")
    assert rows(df, "idx", "v") == [(i, i) for i in range(100)]
    assert rows(indexing.slice_rows(df, 98, 200), "idx", "v") == [(0, 98), (1, 99)]
    assert rows(indexing.get_batch(df, [7, 2, 5, 7]), "pos", "v") == [(0, 7), (1, 2), (2, 5), (3, 7)]
    assert rows(indexing.get_batch(df, []), "pos") == []
    with pytest.raises(Exception, match="no row of index 100"):
        indexing.get_batch(df, [1, 100]).collect()
    with pytest.raises(ValueError):
        indexing.slice_rows(df, 3, 2)
    sums = indexing.exclusive_sums(df, "v", "before", rows=16)
    assert rows(sums, "idx", "before") == [(i, i * (i - 1) // 2) for i in range(100)]


@pytest.mark.parametrize("n", [1, 2, 97, 1000])
def test_permutations_are_bijections(spark, n):
    x = spark.range(n).withColumnRenamed("id", "idx")
    a, b = shuffling.lcg_parameters(n, 5)
    columns = [shuffling.lcg(F.col("idx"), n, a, b).alias("l"), shuffling.feistel(F.col("idx"), n, [1, 22, 333, 4444, 5]).alias("f")]
    got = x.select("idx", *columns).collect()
    for name in "lf":
        assert sorted(r[name] for r in got) == list(range(n))
    eras = shuffling.era_permuted(x, n, 10, shuffling.era_parameters(spark, n, 10, 3)).collect()
    assert sorted(r.source_idx for r in eras) == list(range(n)) and all(r.source_idx // 10 == r.idx // 10 for r in eras)


def test_lcg_beyond_63_bits(spark):
    n, a, b = 1 << 34, (1 << 33) + 1, 12345
    x = (1 << 32) + 17
    assert spark.range(1).select(shuffling.lcg(F.lit(x), n, a, b)).first()[0] == (a * x + b) % n


def test_schedule():
    s = mixing.Schedule(((0, 32), (1000, 64), (100000, 128)))
    table = {0: (32, 0), 500: (32, 16000), 999: (32, 31968), 1000: (64, 32000), 50000: (64, 3168000), 100000: (128, 6368000), 150000: (128, 12768000)}
    for step, (size, offset) in table.items():
        assert (s.size_at(step), s.offset_at(step), s.step_of(offset)) == (size, offset, step)
    with pytest.raises(ValueError):
        mixing.Schedule(((1, 8),))


def test_padded_and_dropped_batches(spark):
    s = mixing.Schedule(((0, 8), (10, 16), (20, 32)))
    df = spark.range(1007).withColumnRenamed("id", "idx")
    out = mixing.batches(df, s, 1007, True).groupBy("step").agg(F.count("*").alias("n"), F.count_if("padding").alias("p"))
    assert rows(out, "step", "n", "p")[-1] == (43, 32, 1)
    assert max(r.step for r in mixing.batches(df, s, 1007, False).collect()) == 42


def test_mixture_counts(spark):
    assert mixing.block_counts({"a": 0.5, "b": 0.3, "c": 0.2, "d": 0}, 10) == {"a": 5, "b": 3, "c": 2}
    assert mixing.block_counts({"a": 1, "b": 1, "c": 1}, 10) == {"a": 4, "b": 3, "c": 3}
    stages = [mixing.Stage(0, {"a": 1.0}), mixing.Stage(20, {"b": 1.0}), mixing.Stage(40, {"a": 0.5, "b": 0.5})]
    got = mixing.mixture_index(spark, stages, 10, 60, {"a": 7, "b": 50}).collect()
    assert sorted(r.idx for r in got) == list(range(60))
    assert {r.source for r in got if r.idx < 20} == {"a"} and {r.source for r in got if 20 <= r.idx < 40} == {"b"}
    assert sorted(r.source_idx for r in got if r.source == "b") == list(range(30))
    assert sorted(r.source_idx for r in got if r.source == "a") == sorted(k % 7 for k in range(30))
    for bad in ([mixing.Stage(5, {"a": 1})], [mixing.Stage(0, {"a": 1}), mixing.Stage(15, {"a": 1})]):
        with pytest.raises(ValueError):
            mixing.check_stages(bad, 10)
    for weights in ({"a": -1.0}, {"a": 0.0}):
        with pytest.raises(ValueError):
            mixing.normalised(weights)


def test_histogram_and_runs(spark):
    df = spark.createDataFrame([(float(x),) for x in (0, 1, 1, 2, 4, 4)], "v double")
    assert [r[3] for r in rows(measures.histogram(df, "v", 4), "bin", "low", "high", "count")] == [1, 2, 1, 2]
    df = spark.createDataFrame(list(enumerate("aabba")), "t int, v string").withColumn("k", F.lit(1))
    assert rows(measures.run_positions(df, "k", "t", "v"), "t", "run_pos") == [(0, 0), (1, 1), (2, 0), (3, 1), (4, 0)]


def test_tag_hierarchy(spark):
    df = spark.createDataFrame([("a/x", 10, 10), ("a/y", 90, 30), ("b", 5, 5)], "tag string, loss long, tokens long")
    got = {r.tag: (r.micro, r.macro) for r in measures.tagged_losses(df, "tag", "loss", "tokens").collect()}
    assert got == {"a/x": (1.0, 1.0), "a/y": (3.0, 3.0), "a": (2.5, 2.0), "b": (1.0, 1.0)}


def test_chats(spark):
    turns = [(1, 0, "user", "hi there"), (1, 1, "assistant", "good day sir"), (2, 0, "user", "alone")]
    chats = formats.messages(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"))
    got = formats.chat_tokens(chats, 1000, "drop").collect()
    assert [(r.conv_id, r["mask"]) for r in got] == [(1, [0, 0, 0, 0, 1, 1, 1])]
    with pytest.raises(Exception, match="no assistant token"):
        formats.chat_tokens(chats, 1000).collect()
    assert rows(formats.single_turn(chats), "conv_id", "prompt", "response") == [(1, "hi there", "good day sir")]


def test_text_functions(spark):
    df = spark.createDataFrame([("<0x0A>",), ("né",)], "p string")
    assert [r[0] for r in df.select(tokens.byte_length(F.col("p"))).collect()] == [1, 3]
    r = spark.createDataFrame([([3.0, 1.0, 2.5],)], "x array<double>").select(arrays.top2_gap(F.col("x")), arrays.segments_of_lengths(F.array(F.lit(2), F.lit(0), F.lit(1)))).first()
    assert r[0] == 0.5 and r[1] == [0, 0, 2]
