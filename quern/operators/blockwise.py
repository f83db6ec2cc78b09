"""Cross entropy over logits in blocks: no task needs the logits of a whole vocabulary at once.

A block of logits gives its maximum, the sum of its exponentials scaled by that, and the target's logit if it has it. Two such
answers merge: sums are rescaled to the larger maximum. So blocks answer where they are, and a row is merged from one short
answer a block, whatever the block size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def capped(logits: Column, soft_cap: float | None) -> Column:
    """Logits drawn smoothly below soft_cap in size."""
    return logits if soft_cap is None else F.transform(logits, lambda x: soft_cap * F.tanh(x / soft_cap))


def in_blocks(df: DataFrame, logits: str, size: int, key: str) -> DataFrame:
    """(key, first, values): the logits of each row in blocks of `size`, with the place where a block begins."""
    starts = F.sequence(F.lit(0), F.size(logits) - 1, F.lit(size))
    return df.where(F.size(logits) > 0).select(key, logits, F.explode(starts).alias("first")).select(key, "first", F.slice(logits, F.col("first") + 1, F.lit(size)).alias("values"))


def block_answers(blocks: DataFrame, targets: DataFrame, key: str, target: str = "target", soft_cap: float | None = None) -> DataFrame:
    """(key, top, total, hit) of every block: maximum, scaled sum, and the target's logit or null. targets: (key, target)."""
    values = capped(F.transform("values", lambda x: x.cast("double")), soft_cap)
    each = blocks.select(key, "first", values.alias("values")).join(targets.select(key, target), key)
    top = F.array_max("values")
    return each.select(key, top.alias("top"), F.aggregate(F.transform("values", lambda x: F.exp(x - top)), F.lit(0.0), lambda a, x: a + x).alias("total"), F.when((F.col(target) >= F.col("first")) & (F.col(target) < F.col("first") + F.size("values")), F.get("values", (F.col(target) - F.col("first")).cast("int"))).alias("hit"))


def merged_losses(answers: DataFrame, key: str, z_weight: float = 0.0) -> DataFrame:
    """(key, loss, log_z): log Z minus the target's logit plus z_weight * log_z^2. A target in no block, or in two, raises."""
    highest = F.max("top").over(Window.partitionBy(key))
    scaled = answers.withColumn("scaled", F.col("total") * F.exp(F.col("top") - highest)).withColumn("highest", highest)
    sums = scaled.groupBy(key).agg(F.max("highest").alias("highest"), F.sum("scaled").alias("scaled"), F.sum("hit").alias("hit"), F.count("hit").alias("hits"))
    log_z = F.col("highest") + F.log("scaled")
    checked = F.when(F.col("hits") == 1, log_z - F.col("hit") + z_weight * log_z * log_z).otherwise(F.raise_error(F.concat(F.lit("target found in "), F.col("hits").cast("string"), F.lit(" blocks"))).cast("double"))
    return sums.select(key, checked.alias("loss"), log_z.alias("log_z"))


def blockwise_cross_entropy(df: DataFrame, logits: str, target: str, key: str, size: int, z_weight: float = 0.0, soft_cap: float | None = None) -> DataFrame:
    """(key, loss, log_z) of rows with whole logits, computed in blocks of `size`."""
    return merged_losses(block_answers(in_blocks(df, logits, size, key), df, key, target, soft_cap), key, z_weight)


def loss_of_embeddings(df: DataFrame, head: np.ndarray, embedding: str, target: str, key: str, size: int, z_weight: float = 0.0, soft_cap: float | None = None) -> DataFrame:
    """(key, loss, log_z) of rows of embeddings under a head of (vocabulary, dimension), `size` rows of the head at a time.

    The head is a model's parameter: its size doesn't depend on the table. A batch holds its rows' logits for one block only.
    """
    kind = {f.name: f.dataType.simpleString() for f in df.schema}[key]

    def losses(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            x = np.stack(batch[embedding].to_numpy()).astype(np.float64)
            wanted = batch[target].to_numpy(np.int64)
            if (wanted < 0).any() or (wanted >= len(head)).any():
                raise ValueError("a target is outside of the head")
            top, total, hit = np.full(len(x), -np.inf), np.zeros(len(x)), np.zeros(len(x))
            for first in range(0, len(head), size):
                block = x @ head[first : first + size].T
                if soft_cap is not None:
                    block = soft_cap * np.tanh(block / soft_cap)
                higher = np.maximum(top, block.max(1))
                total = total * np.exp(top - higher) + np.exp(block - higher[:, None]).sum(1)
                top = higher
                own = (wanted >= first) & (wanted < first + block.shape[1])
                hit[own] = block[own, wanted[own] - first]
            log_z = top + np.log(total)
            yield pd.DataFrame({key: batch[key], "loss": log_z - hit + z_weight * log_z**2, "log_z": log_z})

    return df.select(key, embedding, target).mapInPandas(losses, f"{key} {kind}, loss double, log_z double")
