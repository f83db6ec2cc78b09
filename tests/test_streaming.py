import json
import threading
import time

import pytest
from pyspark.sql import functions as F

from quern.functions import tokens
from quern.operators import packing, shuffling
from quern.sources import store
from quern.streaming import building, growing

SCHEMA = "source string, idx long, ids array<int>, last boolean"


def feed(spark, place, batches):
    for rows in batches:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(place)
        time.sleep(0.01)


def run(spark, stream, place, name, out):
    """All that is there, then the query ends; a later call goes on from its checkpoint."""
    source = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(place)
    q = stream(source).writeStream.format("parquet").option("path", out).outputMode("append").option("checkpointLocation", f"{out}-{name}").trigger(availableNow=True).start()
    q.awaitTermination(200)


def rows_of(n):
    sizes = [(7 * i * i + 3 * i) % 11 for i in range(n)]
    return [(s, i, [100 * i + k for k in range(sizes[i])], None) for s in "ab" for i in range(n)]


@pytest.mark.parametrize("cuts", [[5], [1, 2, 11, 20]])
def test_packs_of_a_stream_are_those_of_the_batch_across_restarts(spark, tmp_path, cuts):
    rows = [r[:3] + (r[1] == 22,) for r in rows_of(23)]
    batches = [[r for r in rows if a <= r[1] < b] for a, b in zip([0, *cuts], [*cuts, 23])]
    for k, batch in enumerate(batches):  # a restart before every micro-batch
        feed(spark, f"{tmp_path}/in", [batch])
        run(spark, lambda df: growing.pack_stream(df, 12, 3, 2, end="last"), f"{tmp_path}/in", "p", f"{tmp_path}/out")
    table = spark.createDataFrame(rows, SCHEMA).withColumn("n", F.size("ids").cast("long"))
    packs = packing.first_fit_packs(table, 12, 3, 2, "source", n="n")
    want = {}
    for r in table.join(packs, ["source", "idx"]).orderBy("idx").collect():
        ids, segments = want.setdefault((r.source, r.pack), ([], []))
        ids += r.ids
        segments += [r.idx] * len(r.ids)
    got = spark.read.parquet(f"{tmp_path}/out").collect()
    assert len(got) == len(want)
    for r in got:
        ids, segments = want[r.source, r.pack]
        assert r.tokens == ids + [0] * (12 - len(ids)) and r.segments == segments + [-1] * (12 - len(ids))


def test_eras_with_a_short_last_one(spark, tmp_path):
    rows = [("a", i, None, i == 12) for i in range(13)] + [("b", i, None, i == 9) for i in range(10)]
    for k, (low, high) in enumerate([(0, 4), (4, 11), (11, 13)]):
        feed(spark, f"{tmp_path}/in", [[r for r in rows if low <= r[1] < high]])
        run(spark, lambda df: growing.era_stream(df, 5, 7, end="last"), f"{tmp_path}/in", "e", f"{tmp_path}/out")
    got = spark.read.parquet(f"{tmp_path}/out")
    for source, n in (("a", 13), ("b", 10)):
        table = spark.range(n).withColumnRenamed("id", "idx")
        batch = shuffling.era_permuted(table, n, 5, shuffling.era_parameters(spark, n, 5, 7))
        own = sorted((r.idx, r.source_idx) for r in got.where(F.col("source") == source).collect())
        assert own == sorted((r.idx, r.source_idx) for r in batch.collect()) and sorted(s for _, s in own) == list(range(n))


def test_late_rows_and_rows_after_the_end_raise(spark, tmp_path):
    feed(spark, f"{tmp_path}/in", [[("a", 3, [1], None)], [("a", 2, [1], None)]])
    with pytest.raises(Exception, match="came after row 3"):
        run(spark, lambda df: growing.chunk_stream(df.drop("last"), 4), f"{tmp_path}/in", "c", f"{tmp_path}/out")
    feed(spark, f"{tmp_path}/in2", [[("a", 0, [1], True)], [("a", 1, [1], None)]])
    with pytest.raises(Exception, match="after its end"):
        run(spark, lambda df: growing.pack_stream(df, 4, 2, 2, end="last"), f"{tmp_path}/in2", "p", f"{tmp_path}/out2")


def process(df):
    return df.withColumn("ids", tokens.word_hash_ids(F.col("text"), 100)).drop("text")


def table_of(spark, n, start=0):
    return spark.createDataFrame([(f"s{i % 2}", i // 2, f"a b{i}") for i in range(start, n)], "shard string, row long, text string")


def stored(spark, path):
    return sorted((r.shard, r.row) for r in store.exposed(spark, path).collect())


def test_every_row_once_wherever_a_batch_is_lost(spark, tmp_path, monkeypatch):
    path, meta = f"{tmp_path}/t", {"v": 1}
    add = lambda df, k, run="r": building.add_batch(spark, path, df, k, run, process, meta, row="row")
    assert add(table_of(spark, 4), 0)
    # lost between the data and the ledger
    commit = store.commit
    monkeypatch.setattr(store, "commit", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        add(table_of(spark, 10, 4), 1)
    monkeypatch.setattr(store, "commit", commit)
    assert store.exposed(spark, path).count() == 4 and store.read_ledger(spark, path)["rows"] == 4
    assert add(table_of(spark, 10, 4), 1)
    # lost after the ledger: the stream repeats the batch
    assert not add(table_of(spark, 10, 4), 1)
    assert stored(spark, path) == sorted((f"s{i % 2}", i // 2) for i in range(10))
    # a new checkpoint reads the source from its beginning
    assert add(table_of(spark, 13), 0, "other")
    assert stored(spark, path) == sorted((f"s{i % 2}", i // 2) for i in range(13))
    ledger = store.read_ledger(spark, path)
    assert ledger["rows"] == 13 and ledger["shards"] == {"s0": 7, "s1": 6} and ledger["fields"] == {"ids": 26}
    with pytest.raises(ValueError, match="begun with"):
        building.add_batch(spark, path, table_of(spark, 1), 5, "other", process, {"v": 2})


def test_a_growing_table_is_followed_by_its_commits(spark, tmp_path):
    path, source, seen, finished = f"{tmp_path}/t", f"{tmp_path}/in", [], []
    (tmp_path / "in").mkdir()
    rows = spark.readStream.schema("shard string, row long, text string").option("maxFilesPerTrigger", 1).parquet(source)
    feed_ = building.ProgressFeed(spark, path, f"{tmp_path}/progress")
    spark.streams.addListener(feed_)

    def handle(df, batch, end):
        seen.extend((r.shard, r.row) for r in df.collect())
        finished.append(end)

    try:
        for k in range(3):
            table_of(spark, 4 * k + 4, 4 * k).coalesce(1).write.mode("append").parquet(source)
            building.build_stream(rows, path, process, {"v": 1}, f"{tmp_path}/check").awaitTermination(100)
            # a group that no ledger has yet
            table_of(spark, 2).write.mode("overwrite").parquet(f"{path}/data/group=99")
            building.follow(spark, path, handle, f"{tmp_path}/follow").awaitTermination(100)
            assert sorted(seen) == sorted((f"s{i % 2}", i // 2) for i in range(4 * k + 4))
        assert building.wait_for_rows(spark, path, 12) == 12
        with pytest.raises(TimeoutError):
            building.wait_for_rows(spark, path, 13, timeout=0.5, poll=0.1)
        building.finish(spark, path)
        assert building.wait_for_rows(spark, path, 13) == 12 and not any(finished)
        time.sleep(1)
    finally:
        spark.streams.removeListener(feed_)
    feed_.report(None)
    told = building.progress(spark, f"{tmp_path}/progress").collect()
    assert sum(r.new_rows for r in told) == store.read_ledger(spark, path)["rows"] == 12 and max(r.rows for r in told) == 12
    assert store.load(spark, path, {"v": 1}).count() == 12


def test_one_of_two_builders_builds(spark, tmp_path):
    path, calls, results = f"{tmp_path}/t", [], []
    source = table_of(spark, 8)

    def slow(df):
        calls.append(threading.get_ident())
        time.sleep(2)
        return process(df)

    def build():
        results.append(store.build_or_load(spark, path, source, slow, {"v": 1}, groups=2, poll=0.2).count())

    threads = [threading.Thread(target=build) for _ in range(3)]
    for t in threads:
        t.start()
    for t in threads:
        t.join(120)
    assert results == [8, 8, 8] and len(calls) == 1
    assert not (tmp_path / "t" / ".lease").exists()


def test_a_stale_lease_is_taken_over(spark, tmp_path):
    path = f"{tmp_path}/t"
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / ".lease").write_text("gone")
    with store.lease(spark, path, seconds=100, settle=0) as held:
        assert not held
    time.sleep(1.2)
    with store.lease(spark, path, seconds=1, settle=0) as held:
        assert held
        time.sleep(1.5)  # renewed meanwhile
        with store.lease(spark, path, seconds=1, settle=0) as second:
            assert not second
    assert not (tmp_path / "t" / ".lease").exists()


def test_null_shards_and_groups_in_one_job(spark, tmp_path):
    rows = [(f"s{i % 3}" if i % 4 else None, f"a b{i}") for i in range(20)] + [("empty", "gone")]
    source = spark.createDataFrame(rows, "shard string, text string")
    drop = lambda df: process(df.where("text <> 'gone'"))
    built = store.build_or_load(spark, f"{tmp_path}/t", source, drop, {"v": 1}, groups=10)
    ledger = store.read_ledger(spark, f"{tmp_path}/t")
    assert built.count() == 20 and ledger["shards"][store.NO_SHARD] == 5 and ledger["groups"] == list(range(5)) and ledger["finished"]
    assert len(json.loads(store.get(spark, f"{tmp_path}/t/committed/4.json"))) == 2
