import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.llm import vector_codes


def brute(rows):
    """vec_id -> (code, error) and the entries, by plain search."""
    kept = [(i, l, [math.floor(4096 * x) for x in v]) for i, v, l in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    width = len(kept[0][2]) // 8
    kept = [r for r in kept if len(r[2]) == width * 8]
    cut = lambda v, p: v[p * width : (p + 1) * width]
    books = [[cut(r[2], p) for r in kept[:16]] for p in range(8)]
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(book))
    for _ in range(6):
        for p in range(8):
            own = [cut(r[2], p) for r in kept]
            at = [near(x, books[p])[1] for x in own]
            for k in range(len(books[p])):
                mine = [x for x, a in zip(own, at) if a == k]
                if mine:
                    books[p][k] = [sum(c) // len(mine) for c in zip(*mine)]
    found = [[near(cut(r[2], p), books[p]) for p in range(8)] for r in kept]
    return [(r[0], r[1], [k for _, k in f], sum(d for d, _ in f)) for r, f in zip(kept, found)], books


@pytest.mark.parametrize("n", [5, 16, 300])
def test_equals_plain_search(spark, n):
    rng = np.random.default_rng(n)
    rows = [(int(i), [float(np.float32(x)) for x in rng.normal(size=16).round(1 if i % 2 else 3)], int(i % 3) if i % 7 else None) for i in rng.permutation(n)]
    rows += [(None, rows[0][1], None), (rows[1][0], rows[2][1], 1), rows[3], (1000, None, 1), (1001, [1.0] * 15 + [float("nan")], 1), (1002, [None] * 16, 1), (1003, [float("inf")] * 16, 2), (2000, [1.0, 2.0], 3), (2001, [], 3)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, label int, code string").repartition(4)
    codes, books = vector_codes.compress(df)
    want, entries = brute(rows)
    assert books.tolist() == entries
    key = lambda r: (r[0] is None, r[0] or 0, str(r[1:]))
    assert sorted([(r.vec_id, r.label, r.code, r.error) for r in codes.collect()], key=key) == sorted(want, key=key)
    sums = {}
    for _, label, _, error in want:
        sums[label] = sums.get(label, 0) + error
    with_sums = vector_codes.with_label_errors(codes).collect()
    assert len(with_sums) == len(want) and all(r.label_error == sums[r.label] for r in with_sums)
    back = vector_codes.decompress(codes, books).first()
    assert [round(x * 4096) for x in back.vector] == [c for p, k in enumerate(back.code) for c in books[p][k].tolist()]


def test_many_labels_are_joined(spark, monkeypatch):
    monkeypatch.setattr(vector_codes, "BROADCAST_LABELS", 0)
    codes = spark.createDataFrame([(1, None, [0], 3), (2, None, [0], 4), (3, 5, [0], 1)], "vec_id long, label int, code array<int>, error long")
    assert {(r.vec_id, r.label_error) for r in vector_codes.with_label_errors(codes).collect()} == {(1, 7), (2, 7), (3, 1)}


def test_no_vectors_and_large_components(spark):
    none = spark.createDataFrame([(1, None, 2)], "vec_id long, embedding array<float>, label int")
    codes, books = vector_codes.compress(none)
    assert vector_codes.with_label_errors(codes).count() == 0 and vector_codes.digest_of(books) == vector_codes.digest_of(np.zeros(0))
    with pytest.raises(Exception, match="too large"):
        vector_codes.compress(none.withColumn("embedding", F.array_repeat(F.lit(1e30).cast("float"), 8)))


def test_search_with_ties_and_far_points():
    rng = np.random.default_rng(1)
    for _ in range(30):
        book = rng.integers(-5, 5, size=(int(rng.integers(1, 17)), 3))
        points = np.concatenate([rng.integers(-6, 6, size=(200, 3)), rng.integers(-(1 << 24), 1 << 24, size=(50, 3))])
        away = ((points[:, None] - book[None]) ** 2).sum(2)
        at, best = vector_codes.nearest(points, book)
        assert (best == away.min(1)).all() and (at == away.argmin(1)).all()
