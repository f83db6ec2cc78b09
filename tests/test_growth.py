"""What the work of an operator grows with."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.functions import arrays, tokenizer
from quern.operators import attention, packing, reports, sequences
from quern.plans import scored


def counted(spark, df, column, kind):
    """df with a column that counts how often it is computed."""
    calls = spark.sparkContext.accumulator(0)

    @F.udf(kind)
    def seen(x):
        calls.add(1)
        return x

    return df.withColumn(column, seen(column)), calls


def test_chunks_make_ids_once(spark):
    data = [(i, list(range(10 * i, 10 * i + i % 4))) for i in range(50)] + [(50, None)]
    df, calls = counted(spark, spark.createDataFrame(data, "idx long, ids array<int>").repartition(3), "ids", T.ArrayType(T.IntegerType()))
    got = sorted((r.seq, r.tokens) for r in sequences.concat_and_chunk(df, 8, rows=7).collect())
    flat = [t for _, ids in data for t in ids or ()]
    assert got == [(k, flat[8 * k : 8 * k + 8]) for k in range(len(flat) // 8)]
    assert calls.value == len(data)


def test_chunks_are_cut_without_an_object_a_row(spark):
    data = [(i, list(range(i % 9))) for i in range(40)] + [(40, []), (41, None)]
    seqs = sequences.concat_and_chunk(spark.createDataFrame(data, "idx long, ids array<int>"), 8, rows=7)
    flat = [t for _, ids in data for t in ids or ()]
    assert sorted((r.seq, r.tokens) for r in seqs.collect()) == [(k, flat[8 * k : 8 * k + 8]) for k in range(len(flat) // 8)]
    plan = seqs._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapGroupsInArrow" in plan and "FlatMapGroupsInPandas" not in plan


def test_segments_of_sequences_with_and_without_ends(spark):
    rows = [[], [9], [1, 2, 3], [9, 9], [1, 9, 2, 9], [1, 9, 2, 3], [9, 1], None]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, t array<int>").select("i", arrays.end_segments(F.col("t"), 9).alias("s"))
    want = [None if r is None else [r[:k].count(9) for k in range(len(r))] for r in rows]
    assert [r.s for r in df.orderBy("i").collect()] == want


@pytest.mark.parametrize("mask", [dict(), dict(offset=2), dict(offset=-2), dict(window=4), dict(window=3, offset=-1), dict(window=5, causal=False), dict(causal=False, segments=False), dict(window=1), dict(window=2, offset=-4), dict(window=40, offset=-1)])
def test_attention_of_whole_sequences_equals_that_of_positions_and_shuffles_none(spark, mask):
    segs = {0: [0, 0, 0, 1, 1, 2, 2, 2, 2, 2, 2], 1: [0] * 9, 2: [], 3: [4]}
    seqs = spark.createDataFrame(list(segs.items()), "seq long, segments array<int>")
    table = spark.createDataFrame([(s, p, g) for s, own in segs.items() for p, g in enumerate(own)], "seq long, pos int, segment int")
    allowed = spark.createDataFrame([(q, k) for q in range(11) for k in range(11) if (q * k) % 3 != 1], "q int, k int")
    every = lambda df: sorted((r.seq, r.q, r.first, r["last"]) for r in df.collect())
    for explicit in (None, allowed, spark.createDataFrame([(s, q, k) for s in range(2) for q, k in ((5, 3), (5, 5), (6, 5), (8, 2), (8, 8)) for _ in range(2)], "seq long, q int, k int")):
        m = attention.Mask(**mask, explicit=explicit)
        assert every(attention.sequence_runs(seqs, m)) == every(attention.runs(attention.pairs(table, m)))
    for window in (None, 3):
        runs = attention.causal_sequence_runs(seqs, window)
        assert every(runs) == every(attention.causal_runs(table, window))
        assert "Exchange" not in runs._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in attention.sequence_runs(seqs, attention.Mask(**mask))._jdf.queryExecution().executedPlan().toString()


def test_attention_queries_shuffle_no_pairs(spark, tmp_path):
    docs = spark.createDataFrame([(i, "a b c d e " * 20, "en", "x", 200) for i in range(30)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("attention_runs", "causal_attention_runs"):
        plan = scored.QUERIES[name](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
        # no position and no pair is dealt and ordered by its sequence
        assert "windowspecdefinition(seq" not in plan


def test_tokens_are_handed_on_before_all_rows_are_read(spark):
    read = []

    def rows():
        for k in range(100):
            read.append(k)
            yield (np.zeros(10, np.int32),)

    portions = tokenizer.in_portions(rows(), 35)
    assert len(next(portions)) == 4 and len(read) == 4
    assert [len(p) for p in portions] == [4] * 24
    # one Arrow batch of several portions, with texts that are null, empty and larger than one
    texts = [None, "", "xy", "a" * (tokenizer.HELD + 5), *("é z" * 9000 for _ in range(20)), "end"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string").coalesce(1)
    got = {r.i: r.ids for r in tokenizer.encode(df, tokenizer.tokenizer("bytes")).collect()}
    assert got == {i: [256, *(t or "").encode(), 257] for i, t in enumerate(texts)}
    marked = df.where("text is not null").withColumn("spans", F.array(F.struct(F.lit(0).alias("begin"), F.lit(1).alias("end"))))
    masked = tokenizer.masked_by_spans(marked, tokenizer.tokenizer("words", vocabulary=99), on_missing="drop")
    assert {r.i: (len(r.ids), sum(r["mask"])) for r in masked.collect()} == {i: (len(t.split()), 1) for i, t in enumerate(texts) if t}


def test_global_packs_make_lengths_once(spark):
    df, calls = counted(spark, spark.createDataFrame([(i, i % 9) for i in range(100)], "idx long, n long").repartition(3), "n", T.LongType())
    got = sorted((r.idx, r.pack) for r in packing.greedy_packs_global(df, {"n": 10}, 4, rows=8, fan=3).collect())
    want, pack, used, segments = [], -1, 99, 0
    for i in range(100):
        pack, used, segments = (pack + 1, i % 9, 1) if used + i % 9 > 10 or segments == 4 else (pack, used + i % 9, segments + 1)
        want.append((i, pack))
    assert got == want and calls.value == 100


def test_compared_tables_meet_by_document(spark):
    data = [(d, p, d + p, -1.0 * p) for d in range(3) for p in range(4)]
    shape = "doc_id int, pos int, token int, log_prob double"
    a, b = spark.createDataFrame(data, shape), spark.createDataFrame(data[::-1], shape).withColumn("log_prob", F.lit(-1.0))
    out = reports.compared(a, b)
    assert sorted(tuple(r) for r in out.collect()) == [(*row, -1.0, row[3] + 1.0) for row in data]
    plan = reports.difference_totals(out)._jdf.queryExecution().executedPlan().toString()
    assert not any("pos#" in x for x in plan.splitlines() if "Exchange hash" in x)
    for wrong, where in ((data[:-1], "document 2, position 3"), (data[1:], "document 0, position 0"), ([*data, (7, 5, 1, 0.0)], "document 7, position 5"), ([*data[:-1], (2, 3, 9, 0.0)], "document 2, position 3")):
        for pair in ((a, spark.createDataFrame(wrong, shape)), (spark.createDataFrame(wrong, shape), a)):
            with pytest.raises(Exception, match=where):
                reports.compared(*pair).collect()
