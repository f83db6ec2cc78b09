"""Attention masks: which keys a query sees, as pairs or as runs of keys, by joins of positions or within whole sequences."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Windows of up to so many keys are bits of a long.
BITS = 32


@dataclass(frozen=True)
class Mask:
    """A key k is seen by a query q if all that is given holds: k <= q + offset (causal), 0 <= q - k < window, equal segments, an explicit pair.

    explicit: a table of allowed (q, k), or of (seq, q, k) where sequences differ.
    """

    causal: bool = True
    offset: int = 0
    window: int | None = None
    segments: bool = True
    explicit: DataFrame | None = None


def pairs(positions: DataFrame, mask: Mask, seq: str = "seq", pos: str = "pos", segment: str = "segment") -> DataFrame:
    """(seq, q, k) of the positions (seq, pos, segment) of sequences.

    With a window, keys lie in a band of that width, so both sides are cut into bands and a query is joined with the two
    that it reaches: the join is by equality, and a sequence of any length is spread over tasks. Without one, a query
    meets its segment (or sequence), which is as many pairs as there are to give.
    """
    own = positions.select(seq, pos, F.col(segment).alias("__s") if mask.segments else F.lit(0).alias("__s"))
    keys, queries, by = own.withColumnRenamed(pos, "k"), own.withColumnRenamed(pos, "q"), [seq, "__s"]
    highest = F.col("q") + mask.offset if mask.causal else None
    if mask.window is not None:
        lowest = F.col("q") - mask.window + 1
        highest = F.col("q") if highest is None else F.least(F.col("q"), highest)
        queries = queries.where(highest >= lowest).withColumn("__band", F.explode(F.sequence(F.floor(lowest / mask.window), F.floor(highest / mask.window))))
        keys, by = keys.withColumn("__band", F.floor(F.col("k") / mask.window)), [*by, "__band"]
    met = queries.join(keys, by)
    if mask.window is not None:
        met = met.where(F.col("k") >= F.col("q") - mask.window + 1)
    met = met.where(F.col("k") <= highest) if highest is not None else met
    met = met.select(seq, "q", "k")
    if mask.explicit is not None:
        on = [c for c in (seq, "q", "k") if c in mask.explicit.columns]
        met = met.join(mask.explicit.select(*on).distinct(), on, "left_semi").select(seq, "q", "k")
    return met


def runs(met: DataFrame, seq: str = "seq") -> DataFrame:
    """(seq, q, first, last): pairs as maximal runs of neighbouring keys."""
    place = F.row_number().over(Window.partitionBy(seq, "q").orderBy("k"))
    return met.withColumn("__run", F.col("k") - place).groupBy(seq, "q", "__run").agg(F.min("k").alias("first"), F.max("k").alias("last")).drop("__run")


def causal_runs(positions: DataFrame, window: int | None = None, seq: str = "seq", pos: str = "pos", segment: str = "segment") -> DataFrame:
    """(seq, q, first, last) of a causal mask over segments that are stretches of neighbours: one run a query, without any pairs."""
    begin = F.min(pos).over(Window.partitionBy(seq, segment))
    first = begin if window is None else F.greatest(begin, F.col(pos) - (window - 1))
    return positions.select(seq, F.col(pos).alias("q"), first.alias("first"), F.col(pos).alias("last"))


def _runs_of(keys: Column) -> Column:
    """Ascending keys as an array of (first, last) of their maximal runs of neighbours."""
    firsts = F.filter(keys, lambda k, i: (i == 0) | (F.get(keys, i - 1) != k - 1))
    lasts = F.filter(keys, lambda k, i: (i == F.size(keys) - 1) | (F.get(keys, i + 1) != k + 1))
    return F.arrays_zip(firsts.alias("first"), lasts.alias("last"))


def sequence_runs(seqs: DataFrame, mask: Mask, seq: str = "seq", segments: str = "segments") -> DataFrame:
    """(seq, q, first, last) of whole sequences, one a row with the segment of each position: the runs() of the pairs() of their positions.

    A sequence's positions are neighbours in one row, so no pair and no position is shuffled, and the only rows made are the
    runs. A query holds the segments of its window, or of its sequence where there is none. An explicit mask meets queries by
    its keys, gathered for each q, or for each (seq, q). The keys of a window of up to BITS are the bits of a number.
    """
    n = F.size(segments)
    lowest = lambda q: F.greatest(q - mask.window + 1, F.lit(0)) if mask.window is not None else F.lit(0)

    def highest(q: Column) -> Column:
        bounds = [n - 1, *([q + mask.offset] if mask.causal else []), *([q] if mask.window is not None else [])]
        return F.least(*bounds) if len(bounds) > 1 else bounds[0]

    # the segments of the keys that the mask's shape leaves, from the lowest on
    query = lambda s, q: F.struct(q.alias("q"), s.alias("s"), lowest(q).alias("low"), F.slice(segments, lowest(q) + 1, F.greatest(highest(q) - lowest(q) + 1, F.lit(0))).alias("near"))
    each = seqs.select(seq, F.explode(F.transform(segments, query)).alias("__q")).select(seq, "__q.*").where(F.size("near") > 0)
    shaped = mask.explicit
    if shaped is not None:
        # the mask's shape leaves few of a query's keys
        shaped = shaped.where("k >= 0").where(F.col("k") <= F.col("q") + mask.offset if mask.causal else F.lit(True))
        shaped = shaped.where(F.col("k").between(F.col("q") - mask.window + 1, F.col("q")) if mask.window is not None else F.lit(True))
        on = [c for c in (seq, "q") if c in shaped.columns]
    if mask.window is not None and mask.window <= BITS:
        bit = lambda i: F.call_function("shiftleft", F.lit(1).cast("long"), i.cast("int"))
        seen = [F.get("near", F.lit(i)) == F.col("s") if mask.segments else F.size("near") > i for i in range(mask.window)]
        each = each.withColumn("bits", reduce(Column.bitwiseOR, [F.when(x, bit(F.lit(i))).otherwise(0) for i, x in enumerate(seen)], F.lit(0).cast("long"))).drop("near", "s")
        if shaped is not None:
            allowed = shaped.groupBy(*on).agg(F.bit_or(bit(F.col("k") - lowest(F.col("q")))).alias("allowed"))
            each = each.join(allowed, on).withColumn("bits", F.col("bits").bitwiseAND(F.col("allowed"))).drop("allowed")
        begins = F.col("bits").bitwiseAND(F.bitwise_not(F.call_function("shiftleft", F.col("bits"), F.lit(1))))
        at = F.explode(F.array(*(F.when(begins.bitwiseAND(F.lit(1 << i)) != 0, i).otherwise(-1) for i in range(mask.window))))
        each = each.select(seq, "q", "low", "bits", at.alias("at")).where("at >= 0")
        # a run is the ones at the end of its bits, from its first on
        own = F.call_function("shiftrightunsigned", F.col("bits"), F.col("at"))
        length = F.bit_count(own.bitwiseXOR(own + 1)) - 1
        return each.select(seq, "q", (F.col("low") + F.col("at")).alias("first"), (F.col("low") + F.col("at") + length - 1).alias("last"))
    same = (lambda k: F.get("near", k - F.col("low")) == F.col("s")) if mask.segments else lambda k: F.lit(True)
    if shaped is None:
        keys = F.filter(F.transform("near", lambda _, i: i + F.col("low")), same)
    else:
        each = each.join(shaped.groupBy(*on).agg(F.sort_array(F.collect_set(F.col("k").cast("int"))).alias("allowed")), on)
        keys = F.filter("allowed", lambda k: (k < F.col("low") + F.size("near")) & same(k))
    found = each.select(seq, "q", keys.alias("__k"))
    return found.select(seq, "q", F.explode(_runs_of(F.col("__k"))).alias("__r")).select(seq, "q", "__r.first", "__r.last")


def causal_sequence_runs(seqs: DataFrame, window: int | None = None, seq: str = "seq", segments: str = "segments") -> DataFrame:
    """(seq, q, first, last): the causal_runs() of whole sequences, one a row; nothing is shuffled."""
    starts = F.filter(F.transform(segments, lambda s, i: F.when((i == 0) | (F.get(segments, i - 1) != s), i)), lambda i: i.isNotNull())
    starts = F.when(F.array_min(segments) == F.array_max(segments), F.array(F.lit(0))).otherwise(starts)
    stretched = seqs.select(seq, F.size(segments).alias("__n"), starts.alias("__starts"))
    length = lambda b, k: F.coalesce(F.get("__starts", k + 1), F.col("__n")) - b
    begins = F.flatten(F.transform("__starts", lambda b, k: F.array_repeat(b, length(b, k))))
    each = stretched.select(seq, F.posexplode(begins).alias("q", "__b"))
    first = F.col("__b") if window is None else F.greatest(F.col("__b"), F.col("q") - (window - 1))
    return each.select(seq, "q", first.alias("first"), F.col("q").alias("last"))
