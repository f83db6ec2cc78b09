"""Permutations of row indices as column arithmetic: linear congruences, Feistel networks, eras."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def lcg_parameters(n: int, seed: int) -> tuple[int, int]:
    """a, prime to n, and b of x -> (a x + b) mod n, drawn from a seeded generator."""
    if n <= 1:
        return 1, 0
    rng = np.random.Generator(np.random.PCG64(seed))
    while True:
        a = int(rng.integers(1, n))
        if math.gcd(a, n) == 1:
            return a, int(rng.integers(0, n))


def lcg(x: Column, n: int, a: int, b: int) -> Column:
    """(a x + b) mod n; decimal arithmetic where a product could pass 63 bits."""
    if n < 3_000_000_000:
        return (F.lit(a).cast("long") * x + b) % n
    return ((F.lit(a).cast("decimal(19,0)") * x.cast("decimal(19,0)") + b) % F.lit(n).cast("decimal(19,0)")).cast("long")


def feistel(x: Column, n: int, keys: list[int], walk: int = 1000) -> Column:
    """A Feistel network over the even number of bits that hold n - 1, walked until it falls below n."""
    half = max(1, -(-max(1, (n - 1).bit_length()) // 2))
    mask = (1 << half) - 1
    factor = 2654435761 & mask

    def once(v: Column) -> Column:
        left, right = F.shiftright(v, half), v.bitwiseAND(mask)
        for k in keys:
            left, right = right, left.bitwiseXOR((right * factor + (k & mask)).bitwiseAND(mask))
        return F.shiftleft(left, half).bitwiseOR(right)

    out = F.aggregate(F.sequence(F.lit(1), F.lit(walk)), once(x.cast("long")), lambda acc, _: F.when(acc >= n, once(acc)).otherwise(acc))
    return F.when(out >= n, F.raise_error(F.lit("cycle walk too short")).cast("long")).otherwise(out)


def permuted(df: DataFrame, source: Column, idx: str = "idx") -> DataFrame:
    """Row i of the result is row source(i) of df: one join on a computed index."""
    order = df.select(F.col(idx).alias("__out"), source.alias(idx))
    return order.join(df, idx).withColumn("source_idx", F.col(idx)).withColumn(idx, F.col("__out")).drop("__out")


def era_permuted(df: DataFrame, n: int, era: int, parameters: DataFrame, idx: str = "idx") -> DataFrame:
    """Row i of the result is a row of the same era of `era` rows, the last era being shorter: one join with the eras.

    parameters: (era, a, b), a row each; a is prime to the era's size.
    """
    rows = df.select(F.col(idx).alias("__out"), F.floor(F.col(idx) / era).alias("era")).join(parameters, "era")
    size = F.least(F.lit(era).cast("long"), n - F.col("era") * era)
    order = rows.select("__out", (F.col("era") * era + (F.col("a") * F.pmod("__out", F.lit(era)) + F.col("b")) % size).alias(idx))
    return order.join(df, idx).withColumn("source_idx", F.col(idx)).withColumn(idx, F.col("__out")).drop("__out")


def era_parameters(spark: SparkSession, n: int, era: int, seed: int) -> DataFrame:
    """(era, a, b) of every era, drawn by lcg_parameters with the seed and the era."""

    def rows(batches):
        for batch in batches:
            found = [lcg_parameters(min(era, n - k * era), seed + k) for k in batch["id"].tolist()]
            yield batch.assign(a=[x for x, _ in found], b=[x for _, x in found]).rename(columns={"id": "era"})

    return spark.range(-(-n // era)).mapInPandas(rows, "era long, a long, b long")
