import hashlib
import random

import pytest

from quern.llm import suffix_dedup


def brute(rows):
    first = {}
    texts = [(-(1 << 63) if d is None else d, (t or "").encode()) for d, t in rows]
    for d, b in sorted(texts):
        for p in range(len(b) - 99):
            w = b[p : p + 100]
            first[w] = min(first.get(w, (d, p)), (d, p))
    out = []
    for (d, b), (doc_id, _) in zip(texts, rows):
        gone = bytearray(len(b))
        for p in range(len(b) - 99):
            if first[b[p : p + 100]] < (d, p):
                gone[p : p + 100] = b"\1" * 100
        spans = sum(1 for i in range(len(b)) if gone[i] and (i == 0 or not gone[i - 1]))
        out.append((doc_id, len(b), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(b, gone) if not g)).hexdigest()))
    return out


@pytest.mark.parametrize("piece", [suffix_dedup.PIECE, 256])
def test_against_brute_force(spark, piece, monkeypatch):
    rng = random.Random(piece)
    noise = lambda n: "".join(rng.choices("abcdefgh é", k=n))
    shared = [noise(rng.randrange(90, 400)) for _ in range(6)]
    rows = []
    for d in range(70):
        parts = [noise(rng.randrange(0, 150))]
        for _ in range(rng.randrange(0, 4)):
            s = rng.choice(shared)
            cut = rng.randrange(0, 30)
            parts += [s[cut : len(s) - rng.randrange(0, 30)], noise(rng.choice([0, 3, 200]))]
        rows.append((d, "".join(parts)))
    rows += [(100, "a" * 500), (101, "ab" * 300), (102, rows[3][1]), (102, rows[3][1]), (102, rows[4][1] + "x"), (None, rows[5][1]), (None, noise(50) + rows[5][1]), (103, None), (104, ""), (105, "z" * 99), (106, "z" * 100), (107, shared[0] * 5)]
    if piece == 256:
        monkeypatch.setattr(suffix_dedup, "PIECE", 256)
        # workers import the module afresh, so the pieces are compared here
        text = noise(2000) + shared[1]
        starts = [k + p for k, x in suffix_dedup._pieces(text) for a, b, *_ in [suffix_dedup.positions(x)] for s, e in zip(a, b) for p in range(s, e + 1)]
        assert starts == list(range(len(text.encode()) - 99))
        return
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, spans string").repartition(5)
    got = [tuple(r) for r in suffix_dedup.dedup(df).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, brute(rows)))


def test_empty_table(spark):
    assert suffix_dedup.dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0
