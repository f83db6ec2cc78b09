"""Mixtures of sources by staged weights, and batch schedules. Both are small tables and index arithmetic."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def normalised(weights: dict[str, float]) -> dict[str, float]:
    """Weights that sum to one; zeros are dropped, negative or all-zero weights raise."""
    if any(w < 0 for w in weights.values()):
        raise ValueError("weights must not be negative")
    total = math.fsum(weights.values())
    if not total:
        raise ValueError("one weight at least must be positive")
    return {k: w / total for k, w in weights.items() if w > 0}


def block_counts(weights: dict[str, float], block: int) -> dict[str, int]:
    """Rows of each source in a block: truncated shares, the rest to the largest (the first of equals)."""
    shares = normalised(weights)
    out = {k: int(w * block) for k, w in shares.items()}
    largest = max(out, key=lambda k: (out[k], -list(out).index(k)))
    out[largest] += block - sum(out.values())
    return out


def lookup(values: dict[str, int], key: Column) -> Column:
    """The value of a key by a literal map with an entry for each source."""
    return F.element_at(F.create_map(*(F.lit(x) for pair in values.items() for x in pair)), key)


@dataclass(frozen=True)
class Stage:
    """Weights from mixture position `start` on."""

    start: int
    weights: dict[str, float]


def check_stages(stages: list[Stage], block: int) -> None:
    starts = [s.start for s in stages]
    if not starts or starts[0] != 0 or starts != sorted(set(starts)) or any(s % block for s in starts):
        raise ValueError("stages start at 0, ascend and are multiples of the block")


def mixture_index(spark: SparkSession, stages: list[Stage], block: int, n: int, lengths: dict[str, int], seed: int = 0) -> DataFrame:
    """(idx, source, source_idx) of the first n mixture positions; sources start again at their end.

    Within a block positions are ordered by a keyed MD5, so any engine finds the same order. The layout of a
    block is a literal of `block` rows a stage; positions come from a range and are joined to it.
    """
    check_stages(stages, block)
    layout, used = [], dict.fromkeys(lengths, 0)
    for k, stage in enumerate(stages):
        until = stages[k + 1].start if k + 1 < len(stages) else max(n, stage.start + block)
        counts = {s: c for s, c in block_counts(stage.weights, block).items() if c}
        slot = 0
        for source, count in counts.items():
            for i in range(count):
                layout.append((k, stage.start, until, slot, source, i, count, used[source], lengths[source]))
                slot += 1
        for source, count in counts.items():
            used[source] += count * ((until - stage.start) // block)
    table = spark.createDataFrame(layout, "stage int, start long, until long, slot long, source string, i long, count long, base long, length long")
    blocks = spark.range(0, -(-n // block)).select(F.col("id").alias("block"), (F.col("id") * block).alias("first"))
    rows = blocks.join(F.broadcast(table), (F.col("first") >= F.col("start")) & (F.col("first") < F.col("until")))
    key = F.md5(F.concat_ws("-", F.lit(str(seed)), F.col("block").cast("string"), F.col("slot").cast("string")))
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("block").orderBy(key)) - 1
    turn = F.col("base") + F.col("count") * F.floor((F.col("first") - F.col("start")) / block) + F.col("i")
    out = rows.select((F.col("first") + place).cast("long").alias("idx"), "source", F.pmod(turn, F.col("length")).alias("source_idx"))
    return out.where(F.col("idx") < n)


@dataclass(frozen=True)
class Schedule:
    """Batch sizes by first step: [(0, 32), (1000, 64)]."""

    segments: tuple[tuple[int, int], ...]

    def __post_init__(self):
        starts = [s for s, _ in self.segments]
        if not starts or starts[0] != 0 or starts != sorted(set(starts)):
            raise ValueError("a schedule starts at 0 and ascends")

    def rows(self) -> list[tuple[int, int, int, int]]:
        """(start, until, size, offset of the first row)."""
        out, offset = [], 0
        for k, (start, size) in enumerate(self.segments):
            until = self.segments[k + 1][0] if k + 1 < len(self.segments) else 1 << 62
            out.append((start, until, size, offset))
            offset += (until - start) * size if until < 1 << 62 else 0
        return out

    def size_at(self, step: int) -> int:
        return next(size for start, until, size, _ in self.rows() if start <= step < until)

    def offset_at(self, step: int) -> int:
        return next(offset + (step - start) * size for start, until, size, offset in self.rows() if start <= step < until)

    def step_of(self, row: int) -> int:
        start, _, size, offset = [r for r in self.rows() if r[3] <= row][-1]
        return start + (row - offset) // size

    def table(self, spark: SparkSession) -> DataFrame:
        rows = self.rows()
        ends = [rows[k + 1][3] if k + 1 < len(rows) else 1 << 62 for k in range(len(rows))]
        return spark.createDataFrame([(*r, e) for r, e in zip(rows, ends, strict=True)], "start long, until long, size long, offset long, end long")


def batches(df: DataFrame, schedule: Schedule, length: int, pad_final: bool, idx: str = "idx") -> DataFrame:
    """df with step, pos and padding: a range join with the schedule's few rows.

    The last batch is filled with rows of nulls (pad_final) or dropped if short.
    """
    spark = df.sparkSession
    last = schedule.step_of(length - 1)
    full = schedule.offset_at(last) + schedule.size_at(last)
    rows = df.withColumn("padding", F.lit(False))
    if full > length:
        if pad_final:
            extra = spark.range(length, full).select(F.col("id").alias(idx), F.lit(True).alias("padding"))
            rows = rows.unionByName(extra, allowMissingColumns=True)
        else:
            rows = rows.where(F.col(idx) < schedule.offset_at(last))
    table = F.broadcast(schedule.table(spark).drop("until"))
    joined = rows.join(table, (F.col(idx) >= F.col("offset")) & (F.col(idx) < F.col("end")))
    inside = F.col(idx) - F.col("offset")
    return joined.withColumn("step", F.col("start") + F.floor(inside / F.col("size"))).withColumn("pos", inside % F.col("size")).drop("start", "size", "offset", "end")


def distinct_sizes(schedule: Schedule) -> list[int]:
    """The batch sizes that a schedule has, ascending."""
    return sorted({size for _, size in schedule.segments})


def from_step(df: DataFrame, step: int) -> DataFrame:
    """Batches from a step on, as a loader that goes on there reads them."""
    return df.where(F.col("step") >= step)


def check_divides(schedule: Schedule, devices: int, allow: bool = False) -> None:
    """Each batch size must be a multiple of the devices unless allowed."""
    odd = [n for n in distinct_sizes(schedule) if n % devices]
    if odd and not allow:
        raise ValueError(f"batch sizes {odd} can't be dealt to {devices} devices")


def device_slices(df: DataFrame, schedule: Schedule, devices: int) -> DataFrame:
    """df of batches() with device and the position in its contiguous slice."""
    check_divides(schedule, devices)
    sizes = F.broadcast(schedule.table(df.sparkSession).select("start", F.col("until").alias("stop"), "size"))
    placed = df.join(sizes, (F.col("step") >= F.col("start")) & (F.col("step") < F.col("stop")))
    device = F.floor(F.col("pos") * devices / F.col("size"))
    return placed.withColumn("device", device).withColumn("device_pos", F.col("pos") - device * F.floor(F.col("size") / devices)).drop("start", "stop", "size")


def batchify(df: DataFrame, *columns: str) -> DataFrame:
    """A row a step: the columns of its rows as arrays in the order of pos."""
    each = df.groupBy("step").agg(F.array_sort(F.collect_list(F.struct("pos", *columns))).alias("r"))
    return each.select("step", *(F.col(f"r.{c}").alias(c) for c in columns))


def rows_of_steps(df: DataFrame, schedule: Schedule, steps: list[int], idx: str = "idx") -> DataFrame:
    """The rows of several steps with step and pos, read at once by the union of their ranges."""
    spans = [(s, schedule.offset_at(s), schedule.offset_at(s) + schedule.size_at(s)) for s in sorted(set(steps))]
    wanted = F.lit(False)
    step = F.lit(None).cast("long")
    first = F.lit(None).cast("long")
    for s, a, b in spans:
        inside = (F.col(idx) >= a) & (F.col(idx) < b)
        wanted |= inside
        step, first = F.when(inside, F.lit(s)).otherwise(step), F.when(inside, F.lit(a)).otherwise(first)
    return df.where(wanted).withColumn("step", step.cast("long")).withColumn("pos", F.col(idx) - first)
