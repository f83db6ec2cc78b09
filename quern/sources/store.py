"""Token tables with a ledger: a table counts as built once its ledger says so.

At most one builder writes a table: it holds a lease, a file that is created only where there is none and renewed while the
build runs; others wait and load what it built, or take a lease over that is no longer renewed. Each commit leaves a small
file in `committed` for each group that it accounts for, which growing tables are followed by.
"""

from __future__ import annotations

import json
import threading
import time
import uuid
import warnings
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators.indexing import ordered_index
from quern.sources.readers import assign_groups


def _fs(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def put(spark: SparkSession, path: str, text: str) -> None:
    """Writes a small file as a whole: beside its place first, then renamed."""
    fs, beside = _fs(spark, f"{path}.{uuid.uuid4().hex}.new")
    out = fs.create(beside, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    _, final = _fs(spark, path)
    fs.delete(final, False)
    if not fs.rename(beside, final):
        raise OSError(f"{path} could not be written")


def get(spark: SparkSession, path: str) -> str | None:
    """The text of a small file; None if there is none."""
    fs, where = _fs(spark, path)
    try:
        stream = fs.open(where)
    except Py4JJavaError as e:
        if "FileNotFound" in str(e.java_exception):
            return None
        raise
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def read_ledger(spark: SparkSession, path: str) -> dict | None:
    """The ledger at path; its copy, if a commit was broken off between the two."""
    for name in ("ledger", ".ledger.bak"):
        fs, where = _fs(spark, f"{path}/{name}")
        if fs.exists(where):
            return json.loads(spark.read.text(f"{path}/{name}").first()[0])
    return None


def commit(spark: SparkSession, path: str, ledger: dict) -> None:
    """Publishes a ledger by renames, the old one kept until the new one is there; rows of a shard never shrink."""
    old = read_ledger(spark, path)
    if old:
        shrunk = [s for s, n in old["shards"].items() if ledger["shards"].get(s, 0) < n]
        if shrunk:
            raise ValueError(f"rows of shards shrank: {shrunk}")
    fs, new = _fs(spark, f"{path}/.ledger.new")
    spark.createDataFrame([(json.dumps(ledger, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/.ledger.new")
    _, final = _fs(spark, f"{path}/ledger")
    _, backup = _fs(spark, f"{path}/.ledger.bak")
    if fs.exists(final):
        fs.delete(backup, True)
        fs.rename(final, backup)
    fs.rename(new, final)
    fs.delete(backup, True)
    announce(spark, path, ledger)


def announce(spark: SparkSession, path: str, ledger: dict) -> None:
    """A file in `committed` for each group of the ledger that has none: its number, and whether the table is finished with it.

    A commit that was broken off before this is made up for by the next one.
    """
    fs, where = _fs(spark, f"{path}/committed")
    there = {x.getPath().getName() for x in fs.listStatus(where)} if fs.exists(where) else set()
    groups = [g for g in ledger.get("groups", []) if f"{g}.json" not in there]
    for k, g in enumerate(groups):
        put(spark, f"{path}/committed/{g}.json", json.dumps({"group": g, "finished": bool(ledger["finished"] and k + 1 == len(groups))}))
    if ledger["finished"] and not groups and "finished.json" not in there:
        put(spark, f"{path}/committed/finished.json", json.dumps({"group": None, "finished": True}))


@contextmanager
def lease(spark: SparkSession, path: str, seconds: float = 60.0, settle: float = 0.2) -> Iterator[bool]:
    """Whether the caller is the one builder of the table at path for the time of the block.

    The lease is a file created where there is none. File systems whose create isn't atomic let two writers pass: the name
    inside, read again after `settle` seconds, tells which one holds it. It is renewed every third of `seconds`; one that
    wasn't renewed for that long is taken over, by a rename that succeeds once.
    """
    name, place = uuid.uuid4().hex, f"{path}/.lease"
    fs, where = _fs(spark, place)

    def write(overwrite: bool) -> bool:
        try:
            out = fs.create(where, overwrite)
            out.write(bytearray(name.encode()))
            out.close()
        except Py4JJavaError as e:
            if "AlreadyExists" in str(e.java_exception):
                return False
            raise
        return True

    try:
        age = time.time() - fs.getFileStatus(where).getModificationTime() / 1000
        if age > seconds:
            _, stale = _fs(spark, f"{place}.{name}")
            if fs.rename(where, stale):
                fs.delete(stale, False)
    except Py4JJavaError as e:
        if "FileNotFound" not in str(e.java_exception):
            raise
    held = write(False)
    if held:
        time.sleep(settle)
        held = get(spark, place) == name
    ended = threading.Event()

    def renew() -> None:
        while not ended.wait(seconds / 3):
            if get(spark, place) == name:
                write(True)

    if held:
        threading.Thread(target=renew, daemon=True).start()
    try:
        yield held
    finally:
        ended.set()
        if held and get(spark, place) == name:
            fs.delete(where, False)


def ledger_metrics(ledger: dict) -> dict[str, float]:
    """Rows, finished shards and field counts of a ledger, as flat names."""
    return {"rows": ledger["rows"], "shards": len(ledger["shards"]), "finished": int(ledger["finished"]), **{f"fields/{k}": v for k, v in ledger["fields"].items()}}


def clean_up(spark: SparkSession, path: str) -> None:
    """Deletes what broken-off commits left; a finished table stays."""
    for name in (".ledger.new", ".ledger.bak") if read_ledger(spark, path) else ():
        fs, where = _fs(spark, f"{path}/{name}")
        if name == ".ledger.new" or fs.exists(_fs(spark, f"{path}/ledger")[1]):
            fs.delete(where, True)


def merge(a: dict, b: dict) -> dict:
    """Two groups' ledgers as one: rows and field counts are summed, shards are joined."""
    add = lambda x, y: {k: x.get(k, 0) + y.get(k, 0) for k in [*x, *(k for k in y if k not in x)]}
    return {"rows": a["rows"] + b["rows"], "finished": a["finished"] and b["finished"], "shards": add(a["shards"], b["shards"]), "fields": add(a["fields"], b["fields"]), "metadata": a["metadata"]}


def load(spark: SparkSession, path: str, metadata: dict | None = None, strict: bool = False) -> DataFrame:
    """A finished table; other metadata warn, or raise with strict. Its group column tells the order of its parts."""
    ledger = read_ledger(spark, path)
    if not ledger or not ledger["finished"]:
        raise FileNotFoundError(f"no finished table at {path}")
    if metadata is not None and ledger["metadata"] != metadata:
        if strict:
            raise ValueError(f"built with {ledger['metadata']}, asked for {metadata}")
        warnings.warn(f"built with {ledger['metadata']}, asked for {metadata}", stacklevel=2)
    return exposed(spark, path)


def exposed(spark: SparkSession, path: str) -> DataFrame:
    """The rows that a ledger, finished or not, accounts for: those of its groups."""
    ledger = read_ledger(spark, path) or {"groups": []}
    df = spark.read.option("basePath", f"{path}/data")
    return df.parquet(*(f"{path}/data/group={g}" for g in ledger["groups"]))


#: The name under which a ledger counts rows whose shard is null.
NO_SHARD = "\0"


def build_or_load(spark: SparkSession, path: str, source: DataFrame, process: Callable[[DataFrame], DataFrame], metadata: dict, shard: str = "shard", fields: tuple[str, ...] = ("ids",), groups: int = 128, at_once: int = 16, lease_seconds: float = 60.0, poll: float = 1.0) -> DataFrame:
    """The table at path, built from source (with a shard column, which process keeps) if it isn't finished.

    Shards, in order of their names, null first, are dealt to contiguous groups, a directory each. A job writes `at_once` groups, with
    one pass over the source; then the ledger is committed with them. A build that was broken off goes on with the groups
    that the ledger lacks, over what it left of them. Of several builders one builds, the others wait for it and load.
    """
    while True:
        ledger = read_ledger(spark, path)
        if ledger and not ledger["finished"] and ledger["metadata"] != metadata:
            raise ValueError(f"begun with {ledger['metadata']}, asked for {metadata}")
        if ledger and ledger["finished"]:
            return load(spark, path, metadata)
        with lease(spark, path, lease_seconds) as held:
            if held:
                # another builder may have gone on since
                _build(spark, path, source, process, metadata, shard, fields, groups, at_once, read_ledger(spark, path))
                return load(spark, path, metadata)
        time.sleep(poll)


def _build(spark: SparkSession, path: str, source: DataFrame, process: Callable[[DataFrame], DataFrame], metadata: dict, shard: str, fields: tuple[str, ...], groups: int, at_once: int, ledger: dict | None) -> None:
    if ledger and ledger["finished"]:
        return
    names = sorted((r[0] for r in source.select(shard).distinct().collect()), key=lambda x: (x is not None, x))
    parts = [[names[k] for k in own] for own in assign_groups(len(names), groups)]
    ledger = ledger or {"rows": 0, "finished": False, "shards": {}, "fields": {}, "groups": [], "metadata": metadata}
    missing = [g for g in range(len(parts)) if g not in ledger["groups"]]
    kind = source.schema[shard].dataType.simpleString()
    for k in range(0, len(missing), at_once):
        own = missing[k : k + at_once]
        wanted = [n for g in own for n in parts[g]]
        some = source.where(F.col(shard).isin([n for n in wanted if n is not None]) | (F.col(shard).isNull() if None in wanted else F.lit(False)))
        out = process(some)
        # a row a shard of these groups
        table = spark.createDataFrame([(n, g) for g in own for n in parts[g]], f"__shard {kind}, group int")
        dealt = out.join(F.broadcast(table), F.col(shard).eqNullSafe(F.col("__shard"))).drop("__shard")
        dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("group").parquet(f"{path}/data")
        read = spark.read.schema(dealt.schema).option("basePath", f"{path}/data")
        for g in own:  # groups of which nothing is left have an empty folder
            fs, where = _fs(spark, f"{path}/data/group={g}")
            if not fs.exists(where):
                out.where("false").write.parquet(f"{path}/data/group={g}")
        counts = read.parquet(*(f"{path}/data/group={g}" for g in own)).groupBy(shard).agg(F.count("*").alias("n"), *(F.sum(F.size(f)).cast("long").alias(f"n_{f}") for f in fields)).collect()
        label = lambda name: NO_SHARD if name is None else str(name)
        more = {"rows": sum(r.n for r in counts), "finished": k + at_once >= len(missing), "shards": {label(r[shard]): r.n for r in counts}, "fields": {f: sum(r[f"n_{f}"] or 0 for r in counts) for f in fields}, "metadata": metadata}
        done = [*ledger["groups"], *own]
        ledger = {**merge({**ledger, "finished": True}, more), "groups": done}
        commit(spark, path, ledger)
    if not missing:
        if not parts:
            process(source).write.mode("overwrite").parquet(f"{path}/data/group=0")
            ledger = {**ledger, "groups": [0]}
        commit(spark, path, {**ledger, "finished": True})


def split_by(df: DataFrame, path: str, *by: str) -> DataFrame:
    """df written with a folder for each value of the columns, and read again, so that a filter on them reads its folders only."""
    df.write.partitionBy(*by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def in_order(df: DataFrame, keys: tuple[str, ...], start: int = 0, name: str = "idx") -> DataFrame:
    """A table of groups with a global index in the order of keys, shifted by start."""
    return ordered_index(df, keys, name).withColumn(name, F.col(name) + start)


def append_rows(spark: SparkSession, path: str, df: DataFrame) -> None:
    """Appends to a Parquet table; columns of another type or nesting raise before anything is written."""
    fs, where = _fs(spark, path)
    if fs.exists(where):
        old = {f.name: f.dataType for f in spark.read.parquet(path).schema}
        if old != {f.name: f.dataType for f in df.schema}:
            raise ValueError(f"{df.schema.simpleString()} does not fit {path}")
    df.write.mode("append").parquet(path)


def trim(spark: SparkSession, path: str, n: int, idx: str = "idx") -> None:
    """Keeps the rows with idx < n: they are written beside the table, which is then replaced by renames."""
    fs, where = _fs(spark, path)
    spark.read.parquet(path).where(F.col(idx) < n).write.mode("overwrite").parquet(f"{path}.trimmed")
    _, new = _fs(spark, f"{path}.trimmed")
    _, old = _fs(spark, f"{path}.old")
    fs.delete(old, True)
    fs.rename(where, old)
    fs.rename(new, where)
    fs.delete(old, True)
