import gzip
import json
import warnings

import pytest
from pyspark.sql import functions as F

from quern.functions import audio, tokens
from quern.operators import shuffling
from quern.sources import readers, store
from quern.streaming import growing


def test_sniff_and_globs():
    assert readers.sniff("a.jsonl.gz") == "jsonl" and readers.sniff("x/a.parquet") == "parquet" and readers.sniff("a.txt.zst") == "text"
    assert readers.sniff("a.json", '[{"a": 1}]') == "json" and readers.sniff("a.json", '{"text": 1}\n{"text": 2}') == "jsonl" and readers.sniff("a.json", '{\n "a": 1}') == "json"
    with pytest.raises(ValueError):
        readers.sniff("a.bin")
    assert readers.expand("d/{01..03}-{a,b}.{1..2}") == [f"d/0{i}-{{a,b}}.{j}" for i in (1, 2, 3) for j in (1, 2)]
    assert readers.shard_names(["d/x/a.0.jsonl", "d/y/a.1.jsonl"]) == {"x/a_0_jsonl": "d/x/a.0.jsonl", "y/a_1_jsonl": "d/y/a.1.jsonl"}
    assert readers.assign_groups(7, 3) == [[0, 1, 2], [3, 4], [5, 6]] and readers.assign_groups(2, None) == [[0], [1]]
    assert readers.split_source({"train": ["a"], "validation": []}, "validation") is None
    with pytest.raises(ValueError):
        readers.split_source({}, "test")


def test_formats(spark, tmp_path):
    lines = [{"text": f"t{i}", "n": i} for i in range(4)]
    (tmp_path / "a.jsonl").write_text("\n".join(map(json.dumps, lines)))
    with gzip.open(tmp_path / "b.jsonl.gz", "wt") as f:
        f.write("\n".join(map(json.dumps, lines)))
    (tmp_path / "c.json").write_text(json.dumps(lines))
    (tmp_path / "d.txt").write_text("one\ntwo\n")
    assert readers.read(spark, f"{tmp_path}/a.jsonl", columns=["text"]).count() == 4
    assert readers.read(spark, f"{tmp_path}/b.jsonl.gz").count() == 4
    assert readers.read(spark, f"{tmp_path}/c.json", "json").count() == 4
    assert sorted(r.text for r in readers.read(spark, f"{tmp_path}/d.txt").collect()) == ["one\n", "two\n"]
    with pytest.raises(Exception, match="missing"):
        readers.read(spark, f"{tmp_path}/a.jsonl", columns=["missing"])
    spark.range(6).coalesce(1).write.parquet(f"{tmp_path}/e.parquet")
    assert readers.from_row(readers.read(spark, f"{tmp_path}/e.parquet"), 2).count() == 4
    named = readers.with_shards(spark.read.json([f"{tmp_path}/a.jsonl", f"{tmp_path}/b.jsonl.gz"]), {"a": f"{tmp_path}/a.jsonl", "b": f"{tmp_path}/b.jsonl.gz"})
    assert {(r.shard, r["count"]) for r in named.groupBy("shard").count().collect()} == {("a", 4), ("b", 4)}


def test_json_by_content_and_equal_base_names(spark, tmp_path):
    (tmp_path / "lines.json").write_text('{"n": 1}\n{"n": 2}\n{"n": 3}\n')
    (tmp_path / "value.json").write_text('[{"n": 1},\n {"n": 2}]')
    assert readers.read(spark, f"{tmp_path}/lines.json").count() == 3 and readers.read(spark, f"{tmp_path}/value.json").count() == 2
    for k in "ab":
        (tmp_path / k).mkdir()
        (tmp_path / k / "part +1.jsonl").write_text(json.dumps({"from": k}) + "\n" + json.dumps({"from": k}))
    found = readers.files(spark, f"{tmp_path}/{{a,b}}/*.jsonl")
    names = readers.shard_names(found)
    table = readers.with_shards(readers.read(spark, f"{tmp_path}/{{a,b}}/*.jsonl"), names)
    assert sorted((r.shard, r["from"], r.shard_idx) for r in table.collect()) == [(f"{k}/part +1_jsonl", k, i) for i, k in enumerate("ab") for _ in range(2)]
    assert readers.restrict_shards(table, ["b/part +1_jsonl"]).count() == 2
    with pytest.raises(Exception, match="not a shard"):
        readers.with_shards(readers.read(spark, f"{tmp_path}/{{a,b}}/*.jsonl"), {"a": found[0]}).collect()
    with pytest.raises(FileNotFoundError):
        readers.files(spark, f"{tmp_path}/none*")


def test_no_row_is_lost_by_long_lines_or_mixed_formats(spark, tmp_path):
    line = lambda n, size=3: json.dumps({"n": n, "text": "x" * size})
    (tmp_path / "long").mkdir()
    (tmp_path / "long" / "a.json").write_text("\n".join([line(0, 200_000), *(line(k) for k in range(1, 10))]))
    assert sorted(r.n for r in readers.read(spark, f"{tmp_path}/long/*.json").collect()) == list(range(10))
    mixed = tmp_path / "mixed"
    mixed.mkdir()
    (mixed / "a.json").write_text(line(0))
    (mixed / "b.json").write_text("\n\n" + "\n".join(line(k) for k in range(1, 6)))
    (mixed / "c.json").write_text("[" + line(6) + ",\n" + line(7) + "]")
    (mixed / "d.json").write_text(json.dumps({"n": 8, "text": "y"}, indent=1))
    (mixed / "e [1].jsonl").write_text(line(9))
    with gzip.open(mixed / "f.json.gz", "wt") as f:
        f.write(line(10, 100_000) + "\n" + line(11))
    (mixed / "empty.json").write_text("")
    spark.createDataFrame([(12, 1.5), (13, None)], "n long, score double").coalesce(1).write.parquet(f"{mixed}/g.parquet")
    got = readers.read(spark, f"{mixed}/*")
    assert sorted(r.n for r in got.collect()) == list(range(14)) and set(got.columns) >= {"n", "text", "score"}
    assert sorted(r.n for r in readers.read(spark, str(mixed), columns=["n"]).collect()) == list(range(14))
    sharded = readers.read_sharded(spark, f"{mixed}/*")
    assert {r.shard: r["count"] for r in sharded.groupBy("shard").count().collect() if r.shard.startswith(("b", "e"))} == {"b_json": 5, "e [1]_jsonl": 1}
    assert sharded.count() == 14 and readers.shard_names([]) == {}
    with pytest.raises(Exception, match="score"):
        readers.read(spark, f"{mixed}/*", columns=["score"])


def test_other_sources(spark, tmp_path):
    import wave

    import numpy as np

    with wave.open(f"{tmp_path}/a.wav", "wb") as w:
        w.setnchannels(2)
        w.setsampwidth(2)
        w.setframerate(8000)
        w.writeframes(np.array([[0, 9], [16384, 9], [-32768, 9]], "<i2").tobytes())
    (tmp_path / "b.wav").write_bytes(b"nothing")
    got = {r.path[-5:]: (r.rate, r.samples) for r in readers.read_audio(spark, f"{tmp_path}/*.wav").collect()}
    assert got == {"a.wav": (8000, [0.0, 0.5, -1.0]), "b.wav": (None, None)}
    assert audio.resampled(np.array([0, 1, 2, 3], np.float32), 2, 4).tolist() == [0, 0.5, 1, 1.5, 2, 2.5, 3, 3]
    (tmp_path / "hub" / "en").mkdir(parents=True)
    (tmp_path / "hub" / "en" / "train-0.jsonl").write_text('{"q": "x", "a": "y"}')
    assert readers.read_hub(spark, f"{tmp_path}/hub", "en").count() == 1 and readers.read_hub(spark, f"{tmp_path}/hub", "en", "validation") is None
    assert readers.read_supervised(spark, f"{tmp_path}/hub/en/*.jsonl", "q", "a").first() == ("x", "y")
    ids = readers.synthetic_tokens(spark, 5, 7, 11).collect()
    assert len(ids) == 5 and all(len(r.ids) == 7 and all(0 <= t < 11 for t in r.ids) for r in ids) and ids == readers.synthetic_tokens(spark, 5, 7, 11).collect()


def test_a_broken_build_goes_on(spark, tmp_path):
    path = f"{tmp_path}/t"
    source = spark.createDataFrame([(f"s{i % 4}", f"a b c{i}") for i in range(12)], "shard string, text string")
    seen = []

    def process(df, stop=None):
        own = sorted(r.shard for r in df.select("shard").distinct().collect())
        if own == stop:
            raise RuntimeError("lost")
        seen.append(own)
        return df.withColumn("ids", tokens.word_hash_ids(F.col("text"), 100)).drop("text")

    with pytest.raises(RuntimeError):
        store.build_or_load(spark, path, source, lambda df: process(df, ["s2"]), {"v": 1}, groups=3, at_once=1)
    half = store.read_ledger(spark, path)
    assert half["groups"] == [0] and not half["finished"] and store.exposed(spark, path).count() == 6
    with pytest.raises(FileNotFoundError):
        store.load(spark, path)
    with pytest.raises(ValueError, match="begun with"):
        store.build_or_load(spark, path, source, process, {"v": 2}, groups=3)
    assert store.build_or_load(spark, path, source, process, {"v": 1}, groups=3, at_once=1).count() == 12
    assert seen == [["s0", "s1"], ["s2"], ["s3"]]
    ledger = store.read_ledger(spark, path)
    assert ledger["rows"] == 12 and store.ledger_metrics(ledger) == {"rows": 12, "shards": 4, "finished": 1, "fields/ids": 36}
    # a commit that was broken off between its renames
    (tmp_path / "t" / "ledger").rename(tmp_path / "t" / ".ledger.bak")
    assert store.read_ledger(spark, path) == ledger
    (tmp_path / "t" / ".ledger.bak").rename(tmp_path / "t" / "ledger")
    (tmp_path / "t" / ".ledger.new").mkdir()
    store.clean_up(spark, path)
    assert not (tmp_path / "t" / ".ledger.new").exists() and store.read_ledger(spark, path) == ledger


def test_append_and_trim(spark, tmp_path):
    path = f"{tmp_path}/rows"
    table = spark.createDataFrame([(i, list(range(i))) for i in range(6)], "idx long, ids array<int>")
    store.append_rows(spark, path, table.where("idx < 4"))
    store.append_rows(spark, path, table.where("idx >= 4"))
    with pytest.raises(ValueError, match="does not fit"):
        store.append_rows(spark, path, table.selectExpr("idx", "array(ids) AS ids"))
    store.trim(spark, path, 5)
    assert sorted((r.idx, r.ids) for r in spark.read.parquet(path).collect()) == [(i, list(range(i))) for i in range(5)]
    shifted = store.in_order(table.select("ids", F.col("idx").alias("at")), ("at",), 10)
    assert sorted((r["at"], r.idx) for r in shifted.collect()) == [(i, 10 + i) for i in range(6)]


def test_store(spark, tmp_path):
    path = f"{tmp_path}/t"
    source = spark.createDataFrame([(f"s{i % 3}", f"a b c{i}") for i in range(9)], "shard string, text string")
    process = lambda df: df.withColumn("ids", tokens.word_hash_ids(F.col("text"), 100)).drop("text")
    with pytest.raises(FileNotFoundError):
        store.load(spark, path)
    built = store.build_or_load(spark, path, source, process, {"v": 1}, groups=4)
    assert built.count() == 9
    ledger = store.read_ledger(spark, path)
    assert ledger["rows"] == 9 and ledger["fields"] == {"ids": 27} and ledger["shards"] == {"s0": 3, "s1": 3, "s2": 3}

    def fail(df):
        raise AssertionError("built again")

    assert store.build_or_load(spark, path, source, fail, {"v": 1}).count() == 9
    with warnings.catch_warnings(record=True) as seen:
        warnings.simplefilter("always")
        store.load(spark, path, {"v": 2})
    assert seen
    with pytest.raises(ValueError):
        store.load(spark, path, {"v": 2}, strict=True)
    with pytest.raises(ValueError, match="shrank"):
        store.commit(spark, path, ledger | {"shards": {"s0": 1}})
    merged = store.merge(ledger, ledger)
    assert merged["rows"] == 18 and merged["fields"] == {"ids": 54}


def test_streams_equal_batches(spark, tmp_path):
    schema = "source string, idx long, ids array<int>"
    flat = []
    for k in range(3):
        rows = [("a", 4 * k + i, list(range(10 * (4 * k + i), 10 * (4 * k + i) + 5))) for i in range(4)]
        flat += [t for r in rows for t in r[2]]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    for name, stream in (("chunks", lambda df: growing.chunk_stream(df, 8)), ("eras", lambda df: growing.era_stream(df, 5, 3))):
        source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        q = stream(source).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", f"{tmp_path}/{name}").trigger(availableNow=True).start()
        q.awaitTermination(100)
    got = sorted((r.seq, r.tokens) for r in spark.table("chunks").collect())
    assert [s for s, _ in got] == list(range(len(flat) // 8)) and sum((t for _, t in got), [])  == flat[: len(flat) // 8 * 8]
    eras = sorted((r.idx, r.source_idx) for r in spark.table("eras").collect())
    by_era = {r.era: (r.a, r.b) for r in shuffling.era_parameters(spark, 12, 5, 3).collect()}
    assert eras == [(5 * k + x, 5 * k + (by_era[k][0] * x + by_era[k][1]) % 5) for k in range(2) for x in range(5)]
