"""Fixed-length sequences from token tables (idx, ids)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a block: what one task has in memory at once.
ROWS = 1024


def _placed(df: DataFrame, ids: str, idx: str, rows: int) -> DataFrame:
    """(__block, __i, __ids, __from): rows dealt by block of `rows` neighbours, with the tokens before their block.

    What is counted and what is cut reads dealt rows that are kept, in memory or on disk, so that ids are made and moved once;
    the planner doesn't share their shuffle by itself. Counts read one kept column, no ids.
    """
    dealt = df.select(F.floor(F.col(idx) / rows).alias("__block"), F.col(idx).alias("__i"), F.col(ids).alias("__ids")).repartition("__block")
    dealt = dealt.withColumn("__n", F.greatest(F.size("__ids"), F.lit(0)).cast("long")).persist()
    totals = dealt.groupBy("__block").agg(F.sum("__n").alias("__t")).withColumn("__up", F.floor(F.col("__block") / 4096))
    upper = totals.groupBy("__up").agg(F.sum("__t").alias("u"))
    # a row for every 4096 blocks
    above = upper.select("__up", (F.sum("u").over(Window.orderBy("__up")) - F.col("u")).alias("__above"))
    inside = F.sum("__t").over(Window.partitionBy("__up").orderBy("__block")) - F.col("__t")
    before = totals.withColumn("__inside", inside).join(above, "__up").select("__block", (F.col("__above") + F.col("__inside")).alias("__from"))
    return dealt.drop("__n").join(before, "__block")


def concat_and_chunk(df: DataFrame, length: int, ids: str = "ids", idx: str = "idx", rows: int = ROWS) -> DataFrame:
    """(seq, tokens): sequence i holds tokens [i * length, (i + 1) * length) of all rows in order; the tail goes.

    A block of neighbouring rows gives all the sequences that lie within it; only what it has of the first and of the last one, which
    it shares with its neighbours, is shuffled again and joined.
    """

    def flat(block: pa.Table) -> tuple[int, np.ndarray]:
        own = block.select(["__i", "__ids", "__from"]).sort_by("__i")
        return own["__from"][0].as_py(), own["__ids"].combine_chunks().flatten().to_numpy(zero_copy_only=False)

    def whole(block: pa.Table) -> pa.Table:
        start, tokens = flat(block)
        first = -start % length
        n = max(0, (len(tokens) - first) // length)
        cut = pa.ListArray.from_arrays(np.arange(n + 1, dtype=np.int32) * np.int32(length), pa.array(tokens[first : first + n * length], pa.int32()))
        return pa.table({"seq": (start + first) // length + np.arange(n), "tokens": cut})

    def ends(block: pa.Table) -> pa.Table:
        start, tokens = flat(block)
        first = min(-start % length, len(tokens))
        rest = max(first, len(tokens) - (start + len(tokens)) % length)
        parts = [(at, x) for at, x in ((start, tokens[:first]), (start + rest, tokens[rest:])) if len(x)]
        return pa.table({"seq": pa.array([at // length for at, _ in parts], pa.int64()), "at": pa.array([at for at, _ in parts], pa.int64()), "part": pa.array([x for _, x in parts], pa.list_(pa.int32()))})

    blocks = _placed(df, ids, idx, rows).groupBy("__block")
    shared = blocks.applyInArrow(ends, "seq long, at long, part array<int>")
    joined = shared.groupBy("seq").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("at", "part"))), lambda p: p["part"])).alias("tokens"))
    return blocks.applyInArrow(whole, "seq long, tokens array<int>").union(joined.where(F.size("tokens") == length))
