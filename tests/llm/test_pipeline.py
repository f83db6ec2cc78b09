import random

import sentencepiece

import corpus_pipeline
from quern.llm import pieces


def test_pipeline(spark, tmp_path):
    rng = random.Random(6)
    prose = lambda: " ".join("".join(rng.choices("abcdeghilmnorstu", k=rng.randrange(2, 8))) for _ in range(120))
    item = prose()[:180]
    base = prose()
    near = base.split()
    near[40], near[80] = "changed", "again"
    near = " ".join(near)  # 10 of 116 shingles differ on each side: a similarity of 0.84
    secret = prose() + " token=abcdefabcdefabcdef0123 end"
    rows = [(1, base), (2, base), (3, base), (3, base), (13, near), (4, prose() + " " + item + " " + prose()), (5, secret), (6, "too short"), (7, ""), (8, None), (9, "the the the " * 60), (10, prose()), (None, prose()), (12, "### %%% " * 100)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r.doc_id: r.piece_ids for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert set(got) == {1, 5, 10, None}
    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.DEFAULT_MODEL)
    assert got[1] == sp.encode(base) and got[5] == sp.encode(secret.replace("token=abcdefabcdefabcdef0123", "[SECRET]"))


def test_stages_keep_columns_on_empty_tables(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame([], schema)
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for _, function in corpus_pipeline.STAGES[:-1]:
        docs = function(spark, docs, str(tmp_path))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"] and docs.count() == 0


def test_workers_are_handed_few_texts_at_once(spark, tmp_path):
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    sizes = spark.sparkContext.accumulator(0)

    def seen(batches):
        for batch in batches:
            sizes.add(len(batch) > corpus_pipeline.ROWS_AT_ONCE)
            yield batch

    spark.createDataFrame([(1, "x")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.range(3000).selectExpr("id AS doc_id", "'a b' AS text", "'en' AS lang", "'s' AS source", "3L AS n_chars").coalesce(1)
    try:
        for given, held in (("10000", "1000"), ("0", "1000"), ("50", "50")):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", given)
            for _, function in corpus_pipeline.STAGES[2:]:
                function(spark, docs, str(tmp_path))
                assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == held
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
        corpus_pipeline.STAGES[2][1](spark, docs.mapInPandas(seen, docs.schema), str(tmp_path)).collect()
        assert sizes.value == 0
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
