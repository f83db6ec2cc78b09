"""Row and batch functions over tables: declared transforms, chains of them, keys for rows, dictionaries of objects."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quern.operators.indexing import ordered_index


def map_rows(df: DataFrame, **columns: Column) -> DataFrame:
    """df with columns made of its own by expressions."""
    return df.withColumns(columns)


def map_batches(df: DataFrame, function: Callable[[pd.DataFrame], pd.DataFrame], schema: StructType | str, size: int = 128) -> DataFrame:
    """The rows that function gives for batches of at most `size` rows; their number may differ."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for k in range(0, len(batch), size):
                yield function(batch.iloc[k : k + size].reset_index(drop=True))

    return df.mapInPandas(rows, schema)


def map_batches_keyed(df: DataFrame, function: Callable[[pd.DataFrame, pd.Series], pd.DataFrame], schema: StructType | str, seed: int, idx: str = "idx", size: int = 128) -> DataFrame:
    """map_batches() with a key for each row, from the seed and its index, so that what function draws doesn't depend on how rows are dealt."""
    keyed = row_keys(df, seed, idx, "__key")
    return map_batches(keyed, lambda batch: function(batch.drop(columns="__key"), batch["__key"]), schema, size)


@dataclass
class Chain:
    """Transforms in order, run as one plan; projections between batch functions are merged by the optimizer."""

    steps: list[Callable[[DataFrame], DataFrame]] = field(default_factory=list)

    def map(self, **columns: Column) -> Chain:
        return Chain([*self.steps, lambda df: map_rows(df, **columns)])

    def map_batches(self, function: Callable[[pd.DataFrame], pd.DataFrame], schema: StructType | str, size: int = 128) -> Chain:
        return Chain([*self.steps, lambda df: map_batches(df, function, schema, size)])

    def identity(self) -> Chain:
        return self

    def run(self, df: DataFrame) -> DataFrame:
        for step in self.steps:
            df = step(df)
        return df


def row_keys(df: DataFrame, seed: int, idx: str = "idx", name: str = "key") -> DataFrame:
    """df with a key for each row, folded from the seed and its index: the same however the table is dealt."""
    return df.withColumn(name, F.xxhash64(F.lit(seed), idx))


def to_rows(df: DataFrame, *columns: str) -> DataFrame:
    """A row for each position of the arrays named, which are of equal length; other columns are repeated."""
    others = [c for c in df.columns if c not in columns]
    lengths = [F.size(c) for c in columns]
    equal = F.lit(True)
    for n in lengths[1:]:
        equal &= n == lengths[0]
    zipped = F.when(equal, F.arrays_zip(*columns)).otherwise(F.raise_error(F.lit("arrays of unequal length")))
    return df.select(*others, F.inline(zipped))


def to_arrays(df: DataFrame, by: str, order: str, *columns: str) -> DataFrame:
    """One row for each `by` with the columns as arrays in the order of `order`."""
    each = df.groupBy(by).agg(F.array_sort(F.collect_list(F.struct(order, *columns))).alias("r"))
    return each.select(by, *(F.col(f"r.{c}").alias(c) for c in columns))


def list_table(spark: SparkSession, values: list, schema: str) -> DataFrame:
    """A table of a list, with its positions as idx."""
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"idx long, value {schema}")


def dictionary(df: DataFrame, value: str, order: str, name: str = "id") -> DataFrame:
    """(value, id): distinct values, numbered by their first appearance in the order of `order`."""
    first = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.min(order).alias("__first"))
    return ordered_index(first.select(value, "__first"), ("__first", value), name).drop("__first")


def flat_leaves(df: DataFrame, key: str, *leaves: str) -> DataFrame:
    """All array leaves of a row in one flat array, with offsets (where each begins, and the end)."""
    sizes = F.array(*(F.size(x) for x in leaves))
    begin = F.transform(F.sequence(F.lit(0), F.lit(len(leaves))), lambda k: F.aggregate(F.slice(sizes, 1, k), F.lit(0), lambda a, x: a + x))
    return df.select(key, F.flatten(F.array(*leaves)).alias("flat"), begin.alias("offsets"))


def unflat_leaves(df: DataFrame, key: str, *leaves: str) -> DataFrame:
    """The arrays that flat_leaves() joined."""
    part = lambda k: F.slice("flat", F.get("offsets", F.lit(k)) + 1, F.get("offsets", F.lit(k + 1)) - F.get("offsets", F.lit(k)))
    return df.select(key, *(part(k).alias(x) for k, x in enumerate(leaves)))
