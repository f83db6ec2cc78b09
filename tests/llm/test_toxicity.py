import random
import zlib

from quern.llm import queries, toxicity


def test_known_finds_what_features_has():
    text = "worst Worse worsening worst the cat"
    every = toxicity.features(text)
    assert toxicity.Known(every | {"other"}).find(text) == sorted(every) and "wors+3" in every and "wors+5" not in every


def test_counterfactual_keeps_case_free_text():
    swap = lambda t: toxicity.counterfactual(t, toxicity.LISTED)
    assert swap("the Muslim man") == "the jewish woman" and swap("nobody") is None


def test_held_out_accuracy_and_neutral_mentions(spark, tmp_path):
    rng = random.Random(8)
    words = ["".join(rng.choices("abcdefgh", k=4)) for _ in range(300)]
    docs, labels = [], []
    for i in range(900):
        toxic = i % 5 == 0
        text = rng.choices(words, k=40)
        if toxic:
            text[rng.randrange(40)] = rng.choice(["vilest", "grubby"])
        if rng.random() < (0.6 if toxic else 0.05):
            text[rng.randrange(40)] = "muslim"
        docs.append((i, " ".join(text), "clash"))
        labels.append((i, 1, int(toxic)))
    docs += [(1000, None, None), (1001, "", None), (None, "grubby", None), (1002, "word " * 50000, None), (3, docs[3][1], None)]
    labels += [(None, 1, 1), (5000, 1, None), (5001, None, 1)]
    spark.createDataFrame(docs, "doc_id long, text string, score string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = queries.op2_toxicity(spark, str(tmp_path)).collect()
    assert len(got) == len(docs) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got if r.doc_id is not None)
    tested = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 900]
    assert sum(r.predicted == (r.doc_id % 5 == 0) for r in tested) > 0.97 * len(tested)
    model = toxicity.train(spark.read.parquet(f"{tmp_path}/documents.parquet"), spark.read.parquet(f"{tmp_path}/labels.parquet"))
    weights = model["weights"]
    assert weights.get("muslim", 0) < 0.5 * min(weights["vilest"], weights["grubby"])


def test_no_labels(spark):
    docs = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    model = toxicity.train(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert toxicity.classify(docs, model).first().score == 0.5 and toxicity.classify(docs.where("false"), model).count() == 0


def test_features_are_counted_over_all_labelled_rows(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "grubby" if i % 3 == 0 else "plain" if i % 2 else "grubby plain") for i in range(400)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(400)], "doc_id long, quality int, toxic int")
    seen = {}
    monkeypatch.setattr(toxicity, "TRAINING_ROWS", 50)
    select, fit = toxicity.select_features, toxicity._fit
    monkeypatch.setattr(toxicity, "select_features", lambda counts, *n: seen.update({r.feature: (r.toxic, r.other) for r in counts.collect() if "+" not in r.feature}, classes=n) or select(counts, *n))
    monkeypatch.setattr(toxicity, "_fit", lambda pairs, *a: seen.update(fitted=len(pairs)) or fit(pairs, *a))
    toxicity.train(docs, labels)
    kept = [i for i in range(400) if zlib.crc32(str(i).encode()) % 4 != 2]
    toxic = sum(i % 3 == 0 for i in kept)
    grubby = sum(i % 3 != 0 and i % 2 == 0 for i in kept)
    assert seen == {"grubby": (toxic, grubby), "classes": (toxic, len(kept) - toxic), "fitted": 50}


def test_terms_of_the_data_lose_their_weight(spark, monkeypatch):
    """Words that no list holds: in toxic rows by chance, yet met in the same slots as others in all rows."""
    rng = random.Random(5)
    groups = ["vorlan", "mestik", "durgan", "palwit"]
    docs, labels = [], []
    for i in range(1200):
        toxic = i % 4 == 0
        # toxic rows name the first group more often
        group = groups[0] if rng.random() < (0.6 if toxic else 0.2) else rng.choice(groups[1:])
        text = ["people", "from", group, "live", "here", *rng.choices(["aaa", "bbb", "ccc", "ddd"], k=6)]
        if toxic:
            text.insert(rng.randrange(len(text)), rng.choice(["vilest", "grubby"]))
        docs.append((i, " ".join(text)))
        labels.append((i, 1, int(toxic)))
    docs, labels = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    weight = {}
    for penalty in (0.0, toxicity.PENALTY):
        monkeypatch.setattr(toxicity, "PENALTY", penalty)
        model = toxicity.train(docs, labels, identity={})
        assert model["identity"]["vorlan"] in groups and not {"vilest", "grubby"} & set(model["identity"])
        own = lambda w: sum(model["weights"].get(x, 0) for x in toxicity.features(w))
        weight[penalty] = abs(own("vorlan") - own(model["identity"]["vorlan"]))
        assert own("vilest") > 2
    assert weight[max(weight)] < 0.5 * weight[0.0]


def test_marks_join_by_the_same_plan_at_every_size(spark, monkeypatch):
    """A few marks aren't broadcast: what is shuffled grows in proportion to the texts."""
    plans = {}

    def staged(df, name):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return stage(df, name)

    stage = toxicity.stage
    monkeypatch.setattr(toxicity, "stage", staged)
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(8)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 0) for i in range(8)], "doc_id long, toxic int")
    toxicity.train(docs, labels)
    assert "SortMergeJoin" in plans["training"] and "BroadcastHashJoin" not in plans["training"]
