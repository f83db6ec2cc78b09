from itertools import permutations

from quern.llm import filter_audit

WORDS = {c: i for i, c in enumerate("ABCDE")}


def brute(docs, labels):
    """(part, order, step) -> measures, by applying every order to the documents themselves."""
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, t in labels if t == 1 and d is not None}
    rows = []
    for doc_id, text, lang in docs:
        text = text or ""
        words = [w for w in "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in text).split(" ") if w]
        fails = set()
        if len(words) < 200:
            fails.add("A")
        if 100 * len(set(words)) < 50 * len(words):
            fails.add("B")
        if 100 * sum("A" <= c <= "Z" for c in text) > 3 * len(text):
            fails.add("C")
        if any(c in "#$%&*|" for c in text):
            fails.add("D")
        if doc_id is not None and any(o is not None and o < doc_id and (t or "") == text for o, t, _ in docs):
            fails.add("E")
        rows.append((lang or "", fails, doc_id in good, doc_id in toxic))
    out = {}
    for part in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == part]
        for order in permutations("ABCDE"):
            for step, f in enumerate(order, 1):
                before = set(order[: step - 1])
                gone = [r for r in own if f in r[1] and not r[1] & before]
                out[part, "".join(order), step] = [sum(not r[1] & (before | {f}) for r in own), len(gone), sum(f in r[1] and bool(r[1] & before) for r in own), sum(r[1] == {f} for r in own), sum(r[2] for r in gone), sum(r[3] for r in gone)]
    total = {}
    for (part, order, step), m in out.items():
        key = part, order[step - 1]
        total[key] = total.get(key, 0) + m[1]
    return {k: [*m, total[k[0], k[1][k[2] - 1]]] for k, m in out.items()}


def test_equals_every_order_applied(spark):
    long = " ".join(f"w{i}" for i in range(250))
    docs = [(1, long, "en"), (2, long, "en"), (2, long, "en"), (3, long, None), (None, long, "en"), (None, long, ""), (4, None, "de"), (5, "", "de"), (6, "  \t\n", "de"), (7, "a b a b " * 100, "en"), (8, long + " $", "fr"), (9, long.upper(), "fr"), (10, "ÄÖ A " * 300, "fr"), (11, "x" * 300_000, "de"), (11, "other " * 3, "en"), (12, long + " #", "en")]
    labels = [(1, 1, 0), (2, 1, 1), (2, 0, 0), (4, 1, 1), (5, None, 1), (None, 1, 1), (99, 1, 1), (9, 1, None)]
    df = spark.createDataFrame([(*d, 0, "x") for d in docs], "doc_id long, text string, lang string, n int, failures string").repartition(5)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = filter_audit.audit(filter_audit.failure_counts(df, marks))
    want = brute(docs, labels)
    found = {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] for r in got.collect()}
    assert got.count() == len(want) == 600 * 4
    assert found == want
    assert filter_audit.audit(filter_audit.failure_counts(df.where("false"), marks)).count() == 0
    assert filter_audit.failure_counts(df, marks.where("false")).where("good or toxic").count() == 0


def test_there_are_eighty_edges(spark):
    counts = spark.createDataFrame([("p", 5, False, False, 3)], "part string, failures int, good boolean, toxic boolean, n long")
    assert filter_audit.edges(counts).count() == 80
