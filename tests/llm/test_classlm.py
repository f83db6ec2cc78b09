import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from quern.llm import classlm


def rows():
    rng = random.Random(9)
    nouns, verbs = [f"n{i}o" for i in range(12)], [f"v{i}e" for i in range(12)]
    texts = [" ".join(rng.choice(nouns if k % 2 else verbs) for k in range(rng.randrange(2, 40))) for _ in range(150)]
    out = [(i, t, "x") for i, t in enumerate(texts)]
    return out + [(900, None, "x"), (901, "", "x"), (902, "  unseen Words é  ", "x"), (None, "n1o V1E", "x"), (903, "n2o v3e " * 20000, "x"), (3, texts[3], "x"), (904, "n2o v3e " * 20000, "x")]


def out(doc_id):
    return zlib.crc32(str("" if doc_id is None else doc_id).encode()) % 7 == 2


@pytest.mark.parametrize("blocks", [1, 5])
def test_base_scores_against_brute_force(spark, blocks):
    table = rows()
    counts = Counter()
    for d, t, _ in table:
        if not out(d):
            counts.update([*classlm.tokens(t), b""])
    n, v = sum(counts.values()), len(counts)
    got = classlm.score(spark.createDataFrame(table, "doc_id long, text string, score string"), blocks=blocks).collect()
    assert len(got) == len(table)
    text = {d: t for d, t, _ in table}
    for r in got:
        line = [*classlm.tokens(text[r.doc_id]), b""]
        assert r.held_out == out(r.doc_id) and r.train_tokens == n and r.n_tokens == len(line) and r.n_known == sum(counts[w] > 0 for w in line)
        assert math.isclose(r.base_score, sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in line), rel_tol=1e-9)
    held = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 200]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_words_of_blocks_are_counted_without_a_shuffle(spark, capsys):
    table = [(i, f"common word{i % 50} Word{i % 50}") for i in range(400)]
    texts = classlm.stage(classlm._texts(spark.createDataFrame(table, "doc_id long, text string").repartition(4), "text", "doc_id", 2), "texts")
    # a partition's texts are in blocks of its own
    assert texts.withColumn("file", classlm.F.input_file_name()).groupBy("block").agg(classlm.F.count_distinct("file").alias("n")).where("n > 1").count() == 0
    assert 4 < texts.select("block").distinct().count() <= 8
    asked = classlm._block_words(texts)
    asked.explain()
    assert "Exchange" not in capsys.readouterr().out
    counts = Counter(w for d, t in table if not out(d) for w in [*classlm.tokens(t), b""])
    assert {bytes(r.word): r.n for r in asked.groupBy("word").agg(classlm.F.sum("n").alias("n")).where("n > 0").collect()} == counts
    # common words come once a block, not once for each block in each partition
    assert asked.where(asked.word == classlm.F.lit(b"common")).count() <= 8


def test_classes_against_brute_force(spark, monkeypatch):
    """Every frequent word's class is the likeliest by all its contexts; others keep that of the item or group."""
    monkeypatch.setattr(classlm, "ITEMS", 6)
    monkeypatch.setattr(classlm, "CLASSES", 4)
    table = [r for r in rows() if r[0] not in (903, 904)]
    texts = classlm._texts(spark.createDataFrame(table, "doc_id long, text string, x string"), "text", "doc_id", 2)
    known = classlm._block_words(texts).groupBy("word").agg(classlm.F.sum("n").alias("n")).where("n > 0").persist()
    first = classlm.initial_classes(texts, known)
    training = texts.where("not held_out")
    moved = {r.word_hash: r["class"] for r in classlm.exchanged(classlm._contexts(training.repartition(3), known, first), first).collect()}
    label, items, pairs = first["label"], first["items"], first["pairs"]
    end = int(label[-1])
    start = lambda w: int(label[items.get(w, len(items) + classlm.form(w))]) if w else end
    step, mass = np.log(classlm.transitions(pairs)), np.log(pairs.sum(0) + classlm.EMISSION)
    lines = [[b"", *classlm.tokens(t), b""] for d, t, _ in table if not out(d)]
    best = {}
    for w in {w for line in lines for w in line if w and w not in items}:
        spots = [(start(line[i - 1]), start(line[i + 1])) for line in lines for i, x in enumerate(line) if x == w]
        if len(spots) >= classlm.MIN_COUNT:
            gain = [sum(step[b, c] + step[c, a] - mass[c] for b, a in spots) if c != end else -np.inf for c in range(len(pairs))]
            best[w] = gain
    assert len(moved) == len(best) > 5
    for w, gain in best.items():
        c = moved[classlm.xxhash.xxh64_intdigest(w, 42) - (1 << 64) * (classlm.xxhash.xxh64_intdigest(w, 42) >> 63)]
        assert gain[c] >= max(gain) - 1e-6
    classed = classlm._classed(known, spark.createDataFrame(list(moved.items()), "word_hash long, class int"), first).collect()
    total = np.zeros(len(pairs))
    for r in classed:
        w = bytes(r.word)
        if w in best:
            assert best[w][r["class"]] >= max(best[w]) - 1e-6
        else:
            assert r["class"] == start(w)
        total[r["class"]] += r.n
    assert np.allclose(classlm.transitions(pairs).sum(1), 1)
    count = sum(len(line) - 1 for line in lines)
    assert total.sum() == count == pairs.sum()


def likelihood(pairs, label):
    k = int(max(label)) + 1
    joined = np.zeros((k, k))
    np.add.at(joined, (label[:, None], label[None, :]), pairs)
    log = lambda x: float((x * np.log(np.maximum(x, 1e-300))).sum())
    return log(joined) - log(joined.sum(0)) - log(joined.sum(1))


def test_exchange_ends_where_no_move_helps():
    rng = np.random.default_rng(1)
    pairs = rng.poisson(0.3, (14, 14)).astype(float)
    pairs[:6, 6:12] += rng.poisson(9, (6, 6))
    pairs[6:12, :6] += rng.poisson(9, (6, 6))
    start = np.concatenate([np.arange(12) % 3, [3, 4]])
    label = classlm.exchange(pairs, 12, 3, sweeps=50)
    best = likelihood(pairs, label)
    assert best > likelihood(pairs, start) and list(label[12:]) == [3, 4]
    for i in range(12):
        for c in range(3):
            other = label.copy()
            other[i] = c
            if len(set(other)) == len(set(label)):
                assert likelihood(pairs, other) <= best + 1e-6


def test_empty_table(spark):
    assert classlm.score(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_words_are_looked_up_once_a_token():
    place, at = classlm._places([b"", b"b", b"a", b"b", b""])
    assert place == [b"", b"b", b"a"] and at.tolist() == [0, 1, 2, 1, 0]
