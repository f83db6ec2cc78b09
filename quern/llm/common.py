"""Shared pieces: staged tables, text normal forms, connected components."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: ASCII white space, as a literal of characters and as a Java regex class.
SPACE = " \t\n\x0b\x0c\r"
SPACE_CLASS = "[\\x20\\x09-\\x0D]+"

#: Makes a query delete its shuffle files when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where unset and Spark runs on one machine, as in tests, a new temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        context = spark.sparkContext
        if context.getCheckpointDir() is None:
            if not context.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            context.setCheckpointDir(tempfile.mkdtemp(prefix="quern-"))
        found = context.getCheckpointDir()
    return found.rstrip("/")


def stage(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it again, which cuts the lineage.

    What the write shuffled has served its purpose then and is deleted at once.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path).withMetadata(df.columns[0], {"staged": path})


def unstage(df: DataFrame) -> None:
    """Deletes a table that stage() wrote; nothing may read it later."""
    path = df.schema[0].metadata.get("staged")
    if path:
        jvm = df.sparkSession._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


def text_or_empty(text: str) -> Column:
    return F.coalesce(F.col(text).cast("string"), F.lit(""))


def words_of(text: Column) -> Column:
    """Maximal runs of characters other than ASCII white space; an empty array if there are none."""
    trimmed = F.btrim(text, F.lit(SPACE))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE_CLASS))


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges (u, v); component is the smallest node reachable.

    Alternating large-star and small-star steps: each keeps connectivity, sums stay linear in the
    edges, and the number of rounds grows with the logarithm of the nodes. Each round is staged.
    An empty edge table gives an empty result; loops and repeated edges are harmless.
    """
    edges = stage(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    mark = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = stage(large, "large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        small = stage(small.where("u <> v").distinct(), "small")
        unstage(edges)
        unstage(large)
        edges = small
        # a fixed point: no node is both a parent and a child
        now = tuple(edges.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0))).first())
        if now == mark:
            break
        mark = now
    ends = edges.groupBy("u").agg(F.min("v").alias("c"))
    return ends.select(F.col("u").alias("node"), F.col("c").alias("component")).union(ends.select(F.col("c").alias("node"), F.col("c").alias("component")).distinct())


def bit_map(df: DataFrame, hashes: Column, bits: int = 1 << 23):
    """A broadcast of `bits` bits, whatever df's size: those at the low bits of df's hashes are set."""
    bit = hashes.bitwiseAND(bits - 1)
    bytes_ = df.select((bit / 8).cast("int").alias("at"), F.call_function("shiftleft", F.lit(1), (bit % 8).cast("int")).alias("bit")).groupBy("at").agg(F.bit_or("bit").alias("bits"))
    held = np.zeros(bits // 8, np.uint8)
    found = bytes_.toPandas()
    held[found["at"].to_numpy(np.int64)] = found["bits"].to_numpy(np.uint8)
    return df.sparkSession.sparkContext.broadcast(held.tobytes())


def in_bit_map(held: bytes, hashes: np.ndarray) -> np.ndarray:
    at = hashes & (len(held) * 8 - 1)
    return np.frombuffer(held, np.uint8)[at >> 3] >> (at & 7).astype(np.uint8) & 1 == 1


def maybe_among(df: DataFrame, *columns: str, bits: int = 1 << 23):
    """A test, for columns of the same names, that holds for every row whose values df has, and for few others.

    What is broadcast has `bits` bits whatever df's size; where it fills up it only spares fewer rows.
    """
    shared = bit_map(df, F.xxhash64(*columns), bits)

    @F.pandas_udf(T.BooleanType())
    def test(hashes: pd.Series) -> pd.Series:
        return pd.Series(in_bit_map(shared.value, hashes.to_numpy(np.int64)))

    return test(F.xxhash64(*columns))
