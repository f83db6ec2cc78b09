"""Index-addressed tables: every dataset carries a dense, 0-based idx."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ordered_index(df: DataFrame, keys: tuple[str, ...], name: str = "idx") -> DataFrame:
    """df with a dense index in the order of keys, ties in any order.

    Rows are sorted by ranges, so tasks grow in number with the table; each task's rows are counted, and a row's index is
    the rows of the tasks before its own and its place in its own. The sort is repeatable as long as keys have no ties.
    """
    spark = df.sparkSession
    ranged = df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("__n", F.monotonically_increasing_id())
    # the upper bits of the number are the task, the lower ones the place in it
    placed = ranged.withColumn("__task", F.shiftrightunsigned("__n", 33)).withColumn("__place", F.col("__n").bitwiseAND((1 << 33) - 1)).persist()
    counts = sorted((r["__task"], r["n"]) for r in placed.groupBy("__task").agg(F.count("*").alias("n")).collect())
    table, before = [], 0
    for task, n in counts:
        table.append((task, before))
        before += n
    offsets = spark.createDataFrame(table, "__task long, __before long")
    # a row a task
    return placed.join(F.broadcast(offsets), "__task").withColumn(name, F.col("__before") + F.col("__place")).drop("__task", "__n", "__place", "__before")


def dense_index(df: DataFrame, key: str, name: str = "idx") -> DataFrame:
    """df with a dense index in the order of a unique key without nulls.

    Keys alone are sorted by ranges and numbered, then joined back, so other columns are shuffled once, by hash.
    """
    return df.join(ordered_index(df.select(key), (key,), name), key)


def _block_sums(df: DataFrame, value: str, at: Column, order: str) -> DataFrame:
    """(block, before): the sum of value over all smaller blocks; by sums of 4096 blocks each while there are more."""
    totals = df.groupBy(at.alias("block")).agg(F.sum(value).alias("t"))
    upper = totals.groupBy(F.floor(F.col("block") / 4096).alias("up")).agg(F.sum("t").alias("u"))
    above = upper.select("up", (F.sum("u").over(Window.orderBy("up")) - F.col("u")).alias("above"))
    inside = F.sum("t").over(Window.partitionBy("up").orderBy("block")) - F.col("t")
    return totals.withColumn("up", F.floor(F.col("block") / 4096)).withColumn("inside", inside).join(above, "up").select("block", (F.col("above") + F.col("inside")).alias("before"))


def exclusive_sums(df: DataFrame, value: str, name: str, idx: str = "idx", rows: int = 4096) -> DataFrame:
    """df with the sum of `value` over all smaller idx: of its block of `rows`, of blocks, and of blocks of blocks.

    One task orders the sums of rows * 4096 rows each, which is a row for every 16 million.
    """
    block = F.floor(F.col(idx) / rows)
    before = _block_sums(df.select(idx, value), value, block, idx).withColumnRenamed("block", "__block").withColumnRenamed("before", "__before")
    inside = F.sum(value).over(Window.partitionBy("__block").orderBy(idx)) - F.col(value)
    return df.withColumn("__block", block).withColumn("__in", inside).join(before, "__block").withColumn(name, (F.col("__before") + F.col("__in")).cast("long")).drop("__block", "__before", "__in")


def slice_rows(df: DataFrame, start: int, end: int | None = None, idx: str = "idx") -> DataFrame:
    """Rows start <= idx < end, counted from zero again."""
    if end is not None and start > end:
        raise ValueError(f"slice from {start} to {end}")
    out = df.where(F.col(idx) >= start)
    return (out if end is None else out.where(F.col(idx) < end)).withColumn(idx, F.col(idx) - start)


def take(df: DataFrame, n: int, idx: str = "idx") -> DataFrame:
    return df.where(F.col(idx) < n)


def epochs(df: DataFrame, n: int, length: int, idx: str = "idx") -> DataFrame:
    """The dataset n times over: idx = epoch * length + idx."""
    return df.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn(idx, F.col("epoch") * F.lit(length).cast("long") + F.col(idx))


def get_batch(df: DataFrame, indices: list[int], idx: str = "idx") -> DataFrame:
    """Rows by index with their position in the request; order and repeats are kept, absent indices raise."""
    wanted = df.sparkSession.createDataFrame([(p, i) for p, i in enumerate(indices)], f"pos long, {idx} long")
    # the request is a literal list of the caller's; only its rows leave the scan
    near = df.where(F.col(idx).isin(sorted(set(indices)))) if len(set(indices)) <= 1000 else df
    out = wanted.join(near.withColumn("__there", F.lit(True)), idx, "left")
    check = F.when(F.col("__there").isNull(), F.raise_error(F.concat(F.lit("no row of index "), F.col(idx).cast("string")))).otherwise(F.col("pos"))
    return out.withColumn("pos", check).drop("__there")


def hold_out(df: DataFrame, n: int, length: int, idx: str = "idx") -> tuple[DataFrame, DataFrame]:
    """Training rows and the last n rows for validation."""
    return df.where(F.col(idx) < length - n), slice_rows(df, length - n, None, idx)


def batched(df: DataFrame, size: int, idx: str = "idx") -> DataFrame:
    """df with batch and the position in it; the last batch may be short."""
    return df.withColumn("batch", F.floor(F.col(idx) / size)).withColumn("pos", F.pmod(F.col(idx), F.lit(size)))


def simulated_epoch(df: DataFrame, length: int, experiment: float, target: float, idx: str = "idx") -> DataFrame:
    """The first int(length * experiment / target) rows."""
    return take(df, int(length * experiment / target), idx)
