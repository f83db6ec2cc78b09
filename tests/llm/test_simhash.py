import itertools
import random

import xxhash

from quern.llm import simhash


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def brute_components(rows):
    marks = [brute_fingerprint(t) for _, t in rows]
    label = list(range(len(rows)))
    for i, j in itertools.combinations(range(len(rows)), 2):
        if (marks[i] ^ marks[j]).bit_count() <= 2 and label[i] != label[j]:
            old, new = label[j], label[i]
            label = [new if x == old else x for x in label]
    low = {k: min((r[0] for r, x in zip(rows, label) if x == k and r[0] is not None), default=None) for k in set(label)}
    return [(r[0], m, low[x]) for r, m, x in zip(rows, marks, label)]


def test_against_brute_force(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(40)]
    base = " ".join(rng.choices(words, k=300))
    rows = [(i, base if i < 5 else " ".join(rng.choices(words, k=rng.randrange(0, 12)))) for i in range(60)]
    for i in range(60, 120):
        w = base.split()
        w[rng.randrange(len(w))] = "X"
        rows.append((i, " ".join(w)))
    rows += [(None, base), (200, None), (201, ""), (202, "  \x0b\n"), (203, "A b"), (204, "a B"), (204, "a B"), (205, " nbsp　Ä")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("component", simhash.F.lit("clash"))
    got = simhash.near_duplicates(df).collect()
    assert sorted(map(repr, [(r.doc_id, r.fingerprint % 2**64, r.component_id) for r in got])) == sorted(map(repr, brute_components(rows)))


def test_blocks_above_the_pair_limit(spark, monkeypatch):
    rng = random.Random(5)
    centre = rng.getrandbits(64)
    marks = {centre}
    while len(marks) < 150:
        x = rng.choice(sorted(marks))
        marks.add(x ^ 1 << rng.randrange(64) ^ (1 << rng.randrange(64) if rng.random() < 0.5 else 0))
    signed = {x - 2**64 if x >> 63 else x for x in marks}
    want = {(u, v) for u, v in itertools.combinations(sorted(signed), 2) if ((u ^ v) % 2**64).bit_count() <= 2}
    monkeypatch.setattr(simhash, "PAIR_LIMIT", 3)
    got = simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long")).collect()
    assert {(r.u, r.v) for r in got} == want and len(got) == len(want)


def test_wider_distances(spark, monkeypatch):
    rng = random.Random(7)
    marks = {rng.getrandbits(64) for _ in range(8)}
    for x in sorted(marks):
        for k in range(1, 7):
            marks.add(x ^ sum(1 << b for b in rng.sample(range(64), k)))
    signed = sorted(x - 2**64 if x >> 63 else x for x in marks)
    table = spark.createDataFrame([(x,) for x in signed], "fp long")
    for limit in (3, 48):
        monkeypatch.setattr(simhash, "PAIR_LIMIT", limit)
        want = {(u, v) for u, v in itertools.combinations(signed, 2) if ((u ^ v) % 2**64).bit_count() <= 4}
        assert {(r.u, r.v) for r in simhash.links(table, 4).collect()} == want


def test_first_of_each_by_five_words(spark):
    rng = random.Random(9)
    base = [f"w{rng.randrange(3000)}" for _ in range(800)]
    near = list(base)
    near[400] = "other"
    other = [f"w{rng.randrange(3000)}" for _ in range(800)]
    rows = [(5, " ".join(base)), (3, " ".join(near)), (None, " ".join(base)), (9, " ".join(other)), (9, " ".join(other)), (10, ""), (11, None)]
    distance = (simhash.fingerprint(rows[0][1], 5) ^ simhash.fingerprint(rows[1][1], 5)).bit_count()
    assert 0 < distance <= 4
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, fingerprint int")
    got = simhash.first_of_each(df)
    assert got.columns == df.columns and sorted(r.doc_id for r in got.collect()) == [3, 9, 10]


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(df).count() == 0


def test_near_copies_down_to_the_similarity_go(spark):
    rng = random.Random(8)
    common = ["the", "of", "and", "to", "in", "a", "is"] * 6
    word = lambda: rng.choice(common) if rng.random() < 0.3 else "".join(rng.choices("abcdefghijklmnop", k=rng.randrange(3, 9)))
    rows, pairs = [], {}
    for k in range(240):
        own = [word() for _ in range(rng.choice((60, 120, 200, 400)))]
        near = list(own)
        changes = max(1, int(len(own) * rng.choice((0.004, 0.01, 0.018, 0.021))))
        for at in rng.sample(range(4, len(own) - 4), changes):
            near[at] = word() + "x"
        a, b = (set(zip(*(w[i:] for i in range(5)))) for w in (own, near))
        if len(a & b) >= 0.8 * len(a | b):
            pairs[1000 + k] = len(a & b) / len(a | b)
        rows += [(k, " ".join(own)), (1000 + k, " ".join(near))]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, wide string").repartition(5)
    kept = [r.doc_id for r in simhash.first_of_each(df).collect()]
    assert len(kept) == len(set(kept)) and set(range(240)) <= set(kept)
    gone = [pairs[d] for d in pairs if d not in kept]
    hard = [s for s in pairs.values() if s < 0.87]
    assert len(hard) > 30 and sum(s < 0.87 for s in gone) >= 0.9 * len(hard)
    assert len(gone) >= 0.95 * len(pairs) and all(1000 + k in kept for k in range(240) if 1000 + k not in pairs)
