import random

import numpy as np

from quern.llm import passages


def test_compact_windows_cover_every_passage_once():
    rng = np.random.default_rng(2)
    for n in (45, 46, 80, 200):
        values = rng.integers(0, 60, n).astype(np.uint64)
        windows = passages.compact_windows(values)
        for i in range(n):
            for j in range(i + passages.SPAN - 1, n):
                own = [(a, c, b) for a, c, b in windows if a <= i <= c <= j <= b]
                assert len(own) == 1 and values[own[0][1]] == values[i : j + 1].min()


def test_planted_passages(spark):
    rng = random.Random(11)
    word = lambda: "".join(rng.choices("abcdefghij", k=rng.randrange(2, 7)))
    text = lambda n: [word() for _ in range(n)]
    passage, near = text(60), text(120)
    rows = [(i, " ".join(text(200))) for i in range(20)]
    for i in range(20, 40):
        rows.append((i, " ".join(text(rng.randrange(0, 90)) + passage + text(rng.randrange(0, 90)))))
    for i in range(40, 46):
        w = list(near)
        w[rng.randrange(10, 110)] = "changed"
        rows.append((i, " ".join(text(30) + w)))
    short = text(40)
    rows += [(50 + k, " ".join(text(60) + short + text(60))) for k in range(4)]
    copy = " ".join(text(70))
    rows += [(60, copy), (61, copy.upper()), (62, copy), (62, copy), (None, copy), (70, None), (71, ""), (72, ""), (73, "tiny text"), (74, "tiny text"), (80, " ".join(text(30000) + passage))]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, node string")
    got = passages.repeated_passages(df).collect()
    classes = {}
    for r in got:
        classes.setdefault(r.class_id, set()).add(r.doc_id)
    assert classes == {20: {*range(20, 40), 80}, 40: set(range(40, 46)), 60: {60, 61, 62, None}}
    where = {d: t.split().index(passage[0]) for d, t in rows if d is not None and 20 <= d < 40}
    for r in got:
        if r.doc_id in where:
            (span,) = r.passages
            assert abs(span.first - where[r.doc_id]) <= 6 and abs(span.end - where[r.doc_id] - 60) <= 6


def test_large_groups_against_all_pairs(spark):
    """Variants of one passage that resemble the original but seldom each other, copies of texts, and a phrase that all share."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choices("abcdefghij", k=rng.randrange(3, 8)))
    text = lambda n: [word() for _ in range(n)]
    phrase = text(12)
    texts = []
    for passage in (text(60), text(75)):
        for k in range(45):
            own = list(passage)
            for at in rng.sample(range(len(own)), 0 if k < 3 else 2):
                own[at] = word()
            texts.append(" ".join(text(rng.randrange(20, 60)) + own + text(rng.randrange(20, 60)) + (phrase if k % 2 else [])))
    texts += [" ".join(text(70) + phrase + text(70)) for _ in range(40)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(1000 + i, t) for i, t in enumerate(texts[::3]) for _ in range(2)]
    label = list(range(len(texts)))
    marks = [passages.shingles(t).astype(np.uint32).view(np.int32) for t in texts]
    for i in range(len(texts)):
        for j in range(i):
            if label[i] != label[j] and (passages.similar_spans(marks[i], marks[j]) or passages.similar_spans(marks[j], marks[i])):
                old, new = label[i], label[j]
                label = [new if x == old else x for x in label]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got = {r.doc_id: r.class_id for r in passages.repeated_passages(df).where("doc_id < 1000").collect()}
    pairs = lambda of: {(i, j) for i in range(len(texts)) for j in range(i) if of(i) is not None and of(i) == of(j)}
    want, found = pairs(lambda i: label[i]), pairs(got.get)
    print(len(found), len(want))
    assert found <= want and len(found) >= 0.9 * len(want) > 500


def test_similar_spans_against_brute_force():
    rng = np.random.default_rng(3)
    for _ in range(30):
        a = rng.integers(0, 1 << 30, 150)
        b = np.concatenate([rng.integers(0, 1 << 30, 20), a[30:110], rng.integers(0, 1 << 30, 20)])
        b[rng.choice(np.arange(20, 100), rng.integers(0, 25), replace=False)] *= -1
        found = passages.similar_spans(a, b)
        inside = {w for p, q in found for w in range(p, q)}
        for p in range(len(a) - passages.SPAN + 1):
            own = set(a[p : p + passages.SPAN].tolist())
            q = p - 10
            other = set(b[q : q + passages.SPAN].tolist()) if 0 <= q <= len(b) - passages.SPAN else set()
            if len(own & other) >= 0.8 * len(own | other):
                assert {p, p + passages.MIN_WORDS - 1} <= inside


def test_empty_table(spark):
    assert passages.repeated_passages(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_large_groups_lose_no_class(spark):
    """Variants of one short passage: those that neither a first nor a neighbour shows are linked as well."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choices("abcdefghij", k=rng.randrange(3, 8)))
    text = lambda n: [word() for _ in range(n)]
    passage, phrase = text(60), text(12)
    texts = []
    for k in range(300):
        own = list(passage)
        for at in rng.sample(range(60), rng.randrange(0, 5)):
            own[at] = word()
        texts.append(" ".join(text(rng.randrange(0, 40)) + own + text(rng.randrange(0, 40)) + (phrase if k % 2 else [])))
    texts += [" ".join(text(60) + phrase + text(60)) for _ in range(60)]
    marks = [passages.shingles(t).astype(np.uint32).view(np.int32) for t in texts]
    label = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if label[i] != label[j] and (passages.similar_spans(marks[i], marks[j]) or passages.similar_spans(marks[j], marks[i])):
                old, new = label[i], label[j]
                label = [new if x == old else x for x in label]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(6)
    got = {r.doc_id: r.class_id for r in passages.repeated_passages(df).collect()}
    want = {i: x for i, x in enumerate(label) if label.count(x) > 1}
    print(len(got), len(want))
    assert len(want) > 100 and len(set(got.items()) & set(want.items())) >= 0.98 * len(want) and set(got) <= set(want)


def test_surroundings_admit_every_pair_that_holds():
    rng = np.random.default_rng(6)
    tried = 0
    for _ in range(200):
        a = rng.integers(0, 1 << 62, 150).astype(np.uint64)
        b = np.concatenate([rng.integers(0, 1 << 62, 30).astype(np.uint64), a[40:100], rng.integers(0, 1 << 62, 60).astype(np.uint64)])
        gone = rng.choice(np.arange(30, 90), rng.integers(0, 16), replace=False)
        b[gone] = rng.integers(0, 1 << 62, len(gone)).astype(np.uint64)
        for p in range(40, 100 - passages.SPAN + 1):
            q = p - 10
            one, two = a[p : p + passages.SPAN], b[q : q + passages.SPAN]
            if len(np.intersect1d(one, two)) < 0.8 * len(np.union1d(one, two)) or one.min() != two.min():
                continue
            tried += 1
            rows = []
            for s, begin in ((a, p), (b, q)):
                least = begin + int(s[begin : begin + passages.SPAN].argmin())
                rows.append(passages._surroundings(s, np.array([begin]), np.array([least]), np.array([begin + passages.SPAN - 1])))
            codes = np.concatenate(rows)
            found = passages._block_pairs(codes, passages._bits(codes), np.array([1, 2]), np.array([0]), np.array([1]))
            assert len(found[0]) == 1
    assert tried > 100


def test_rows_of_a_large_group_meet_by_rare_codes(monkeypatch):
    """Texts that say each word many times, as such groups hold them: no pair that holds is lost, and few of all pairs are tested."""
    rng = np.random.default_rng(8)
    joint = lambda v, w: [40_000 + (v * 400 + w) * 4 % 25_000 + k for k in range(4)]
    texts = []
    for k in range(500):
        if k % 10 == 9:
            before, after = (list(x) for x in texts[k - rng.integers(1, 9)])
            after[rng.integers(12, len(after))] = int(rng.integers(30_000, 39_000))
        else:
            sides = []
            for _ in range(2):
                v, side = 1, []
                while len(side) < 50:
                    w = int(rng.integers(2, 400))
                    side += joint(v, w) + [w] * int(rng.integers(8, 16))
                    v = w
                sides.append(side)
            before, after = sides[0][::-1], [1] * int(rng.integers(3, 12)) + sides[1]
        texts.append((before, after))
    s = [np.array(before + after, np.uint64) for before, after in texts]
    at = [len(before) for before, _ in texts]
    codes = np.concatenate([passages._surroundings(x, np.array([0]), np.array([p]), np.array([len(x) - 1])) for x, p in zip(s, at, strict=True)])
    near, tested = passages._near_each_other, []
    monkeypatch.setattr(passages, "_near_each_other", lambda halves, around, *more: tested.append(np.broadcast_shapes(halves.shape[:-1], around.shape[:-1])) or near(halves, around, *more))
    cut = [x[p - passages.SPAN + 1 : p + passages.SPAN].astype(np.int64) for x, p in zip(s, at, strict=True)]
    rows = np.arange(len(s))
    for mine, theirs in ((rows, rows), (rows[:250], rows[250:])):
        i, j = passages._block_pairs(codes, passages._bits(codes), rows, mine, theirs)
        found = {tuple(sorted(x)) for x in zip(i.tolist(), j.tolist(), strict=True)}
        want = {(x, y) for x in mine.tolist() for y in theirs.tolist() if x < y and (set(cut[x][-30:]) & set(cut[y]) or set(cut[x][:30]) & set(cut[y])) and passages.similar_spans(cut[x], cut[y]) and passages.similar_spans(cut[y], cut[x])}
        assert want <= found
        if mine is rows:
            assert len(want) > 20
    assert sum(int(np.prod(x)) for x in tested) < 0.2 * len(rows) ** 2


def test_shingles_are_of_the_words_hashes():
    import pyarrow as pa
    import xxhash

    rng = random.Random(3)
    texts = ["", " ", "one two three four", "a b c d e", "x" * 40 + " Long " + "é" * 33 + " d e f\n"]
    texts += ["".join(rng.choice("aBé\t\n\x0b  \x85xyz中") for _ in range(rng.randrange(200))) for _ in range(300)]
    texts += [" ".join("Ab" * (k // 2) + "c" * (k % 2) for k in range(1, 36))]
    want = []
    for text in texts:
        h = [xxhash.xxh64_intdigest(w) for w in text.encode().lower().split()]
        own = []
        for k in range(len(h) - passages.SHINGLE + 1):
            x = 0
            for value in h[k : k + passages.SHINGLE]:
                x = (x * int(passages._FACTOR) + value) % (1 << 64)
            own.append(x)
        want.append(passages._mixed(np.array(own, np.uint64)).tolist())
        assert passages.shingles(text).tolist() == want[-1]
    got = list(passages.shingles_of(pa.array(["cut off", *texts])[1:]))
    assert np.concatenate([x[2] for x in got]).tolist() == sum(want, []) and np.concatenate([x[3] for x in got]).tolist() == [len(x) for x in want]


def test_pairs_at_once_give_the_spans_of_each():
    rng = np.random.default_rng(13)
    pairs = []
    for k in range(60):
        a = rng.integers(0, 1 << 31 if k % 3 else 12, rng.integers(1, 300)).astype(np.int32)
        b = np.concatenate([rng.integers(0, 1 << 31, rng.integers(0, 30)).astype(np.int32), a[rng.integers(0, 20) :]])
        gone = rng.choice(len(b), rng.integers(0, 1 + len(b) // 12), replace=False)
        b[gone] = rng.integers(0, 1 << 31, len(gone))
        pairs.append((a, b))
    (a, a_sizes), (b, b_sizes) = ((np.concatenate([p[x] for p in pairs]), np.array([len(p[x]) for p in pairs])) for x in range(2))
    got = [[] for _ in pairs]
    for pair, first, end in zip(*(x.tolist() for x in passages._similar_spans(a, a_sizes, b, b_sizes)), strict=True):
        got[pair].append((first, end))
    assert got == [passages.similar_spans(*p) for p in pairs] and sum(map(bool, got)) > 20
