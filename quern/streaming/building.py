"""Tables built from streams, each row once, and tables followed while they grow."""

from __future__ import annotations

import json
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.listener import StreamingQueryListener

from quern.sources import store


def add_batch(spark: SparkSession, path: str, batch: DataFrame, number: int, run: str, process: Callable[[DataFrame], DataFrame], metadata: dict, shard: str = "shard", row: str | None = None, fields: tuple[str, ...] = ("ids",)) -> bool:
    """Adds a micro-batch to the table at path; False if the ledger has it already.

    The batch is a group of the table, written as a whole; its number is committed in the ledger together with its rows. A batch that
    is repeated because the run was lost before the commit writes over what it left; one lost after it is left out. A new run
    (another checkpoint) begins its groups after those there are; with `row`, the number of a row in its shard from zero, it also leaves out
    the rows that the ledger accounts for, so a source that is read from its beginning again adds what is new.
    """
    ledger = store.read_ledger(spark, path) or {"rows": 0, "finished": False, "shards": {}, "fields": {}, "groups": [], "metadata": metadata}
    if ledger["metadata"] != metadata:
        raise ValueError(f"begun with {ledger['metadata']}, asked for {metadata}")
    if ledger["finished"]:
        raise ValueError("the table is finished")
    last = ledger.get("stream") or {}
    if last.get("run") == run:
        first = last["first"]
        if number <= last["batch"]:
            return False
    else:
        first = max(ledger["groups"], default=-1) + 1 - number
    if row is not None and ledger["shards"]:
        # a row a shard of the ledger
        known = spark.createDataFrame([(None if s == store.NO_SHARD else s, n) for s, n in ledger["shards"].items()], "__shard string, __rows long")
        batch = batch.join(F.broadcast(known), F.col(shard).cast("string").eqNullSafe(F.col("__shard")), "left").where(F.col(row) >= F.coalesce("__rows", F.lit(0))).drop("__shard", "__rows")
    group = first + number
    place = f"{path}/data/group={group}"
    process(batch).write.mode("overwrite").parquet(place)
    counts = spark.read.parquet(place).groupBy(shard).agg(F.count("*").alias("n"), *(F.sum(F.size(f)).cast("long").alias(f"n_{f}") for f in fields)).collect()
    more = {"rows": sum(r.n for r in counts), "finished": False, "shards": {store.NO_SHARD if r[shard] is None else str(r[shard]): r.n for r in counts}, "fields": {f: sum(r[f"n_{f}"] or 0 for r in counts) for f in fields}, "metadata": metadata}
    store.commit(spark, path, {**store.merge(ledger, more), "groups": [*ledger["groups"], group], "stream": {"run": run, "batch": number, "first": first}})
    return True


def build_stream(rows: DataFrame, path: str, process: Callable[[DataFrame], DataFrame], metadata: dict, checkpoint: str, **options) -> StreamingQuery:
    """Starts to add a stream's rows to the table at path, with what is there by then; checkpoint names the run."""

    def each(batch: DataFrame, number: int) -> None:
        add_batch(batch.sparkSession, path, batch, number, checkpoint, process, metadata, **options)

    return rows.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def finish(spark: SparkSession, path: str) -> None:
    """Marks a table that streams built as finished."""
    store.commit(spark, path, {**store.read_ledger(spark, path), "finished": True})


def follow(spark: SparkSession, path: str, handle: Callable[[DataFrame, int, bool], None], checkpoint: str, groups_at_once: int = 16, available_now: bool = True) -> StreamingQuery:
    """Calls handle(rows, batch, finished) with the rows of the groups that were committed since, while the table grows.

    The stream is over the files of `committed`, which a group gets once the ledger has it, so rows of a group that is being written,
    or was left by a build that broke off, are never seen; its checkpoint remembers which groups were handled.
    """
    place = f"{path}/committed"
    fs, where = store._fs(spark, place)
    fs.mkdirs(where)
    marks = spark.readStream.schema("group long, finished boolean").option("maxFilesPerTrigger", groups_at_once).option("pathGlobFilter", "*.json").json(place)

    def each(batch: DataFrame, number: int) -> None:
        found = batch.collect()  # groups_at_once short rows at most
        groups = sorted(r["group"] for r in found if r["group"] is not None)
        if groups:
            handle(spark.read.option("basePath", f"{path}/data").parquet(*(f"{path}/data/group={g}" for g in groups)), number, any(r["finished"] for r in found))

    writer = marks.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def wait_for_rows(spark: SparkSession, path: str, rows: int, timeout: float = 600.0, poll: float = 0.5) -> int:
    """Waits until the ledger has `rows` rows or is finished, and gives the rows there are."""
    until = time.monotonic() + timeout
    while True:
        ledger = store.read_ledger(spark, path) or {"rows": 0, "finished": False}
        if ledger["rows"] >= rows or ledger["finished"]:
            return ledger["rows"]
        if time.monotonic() > until:
            raise TimeoutError(f"{ledger['rows']} of {rows} rows after {timeout} s")
        time.sleep(poll)


class ProgressFeed(StreamingQueryListener):
    """After each micro-batch of any query, a row on what the table at path has gained: rows, shards, fields, and whether it is finished.

    Rows go to a folder of JSON lines, one file each; progress() reads them. Their new_rows add up to the ledger's rows.
    """

    def __init__(self, spark: SparkSession, path: str, out: str):
        self.spark, self.path, self.out = spark, path, out
        self.sent, self.rows = 0, 0

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        self.report(event.progress.batchId)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.report(None)

    def report(self, batch: int | None) -> None:
        ledger = store.read_ledger(self.spark, self.path)
        if ledger is None or ledger["rows"] == self.rows and batch is None and not ledger["finished"]:
            return
        now = store.ledger_metrics(ledger)
        line = {"at": time.time(), "batch": batch, "new_rows": ledger["rows"] - self.rows, **now}
        store.put(self.spark, f"{self.out}/{self.sent:09d}.json", json.dumps(line))
        self.sent, self.rows = self.sent + 1, ledger["rows"]


def progress(spark: SparkSession, out: str) -> DataFrame:
    """The rows that a ProgressFeed wrote."""
    return spark.read.json(out)
