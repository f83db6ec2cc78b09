"""Packing of rows into sequences: greedy over neighbours, and first fit with a pool of open packs."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def greedy_packs(df: DataFrame, lengths: dict[str, int], max_segments: int, group: str, idx: str = "idx", on_long: str = "raise") -> DataFrame:
    """(group, idx, pack) for rows of (group, idx, the columns of lengths), in the order of idx within each group.

    A pack is closed where a row would exceed the limit of any of its columns, or max_segments. A row over a
    limit raises, or with on_long="alone" has a pack of its own. Each group is one ordered fold; groups are
    the shards, so tasks see one shard's lengths and no tokens. Packs are numbered within their group.
    """
    names = list(lengths)

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(idx, ignore_index=True)
        packs, pack, used, n = [], -1, None, 0
        for i, row in zip(pdf[idx].tolist(), pdf[names].to_numpy().tolist(), strict=True):
            for name, x in zip(names, row, strict=True):
                if x > lengths[name] and on_long == "raise":
                    raise ValueError(f"Row {i} has length {x} in '{name}', which exceeds {lengths[name]}")
            sums = None if used is None else [a + b for a, b in zip(used, row, strict=True)]
            if sums is None or n >= max_segments or any(s > lengths[name] for s, name in zip(sums, names, strict=True)):
                pack, used, n = pack + 1, row, 1
            else:
                used, n = sums, n + 1
            packs.append(pack)
        return pd.DataFrame({group: pdf[group], idx: pdf[idx], "pack": packs})

    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    return df.select(group, idx, *names).groupBy(group).applyInPandas(fold, f"{group} {kinds[group]}, {idx} {kinds[idx]}, pack long")


def packed(df: DataFrame, packs: DataFrame, length: int, group: str, idx: str = "idx", ids: str = "ids", pad: int = 0, side: str = "left") -> DataFrame:
    """(group, pack, tokens, segments): rows of a pack one after another, padded; a segment is a row's idx, -1 padding.

    A row over the length keeps its first tokens (side="left") or its last ("right").
    """
    part = F.col(ids) if side == "left" else F.when(F.size(ids) > length, F.slice(ids, -length, length)).otherwise(F.col(ids))
    rows = df.select(group, idx, part.alias("__ids")).join(packs, [group, idx])
    each = rows.groupBy(group, "pack").agg(F.array_sort(F.collect_list(F.struct(idx, "__ids"))).alias("r"))
    tokens = F.flatten(F.transform("r", lambda r: r["__ids"]))
    segments = F.flatten(F.transform("r", lambda r: F.array_repeat(r[idx], F.size(r["__ids"]))))
    fill = lambda x, v: F.slice(F.concat(x, F.array_repeat(v, length)), 1, length)
    return each.select(group, "pack", fill(tokens, F.lit(pad).cast("int")).alias("tokens"), fill(segments, F.lit(-1).cast("long")).alias("segments"))


class Pool:
    """The open packs of first fit, oldest first, each as [number, tokens, rows]; what the batch and the stream form share."""

    def __init__(self, length: int, max_segments: int, max_buffered: int, opened: list[list[int]] | None = None, new: int = 0):
        self.length, self.max_segments, self.max_buffered = length, max_segments, max_buffered
        self.opened, self.new = opened or [], new

    def add(self, size: int, row: int) -> tuple[int, list[int]]:
        """The pack of a row of `size` tokens, and the packs that are closed by it, in order."""
        if size > self.length:
            raise ValueError(f"Row {row} has length {size}, which exceeds {self.length}")
        closed = []
        slot = next((p for p in self.opened if p[1] + size <= self.length), None)
        if slot is None:
            while len(self.opened) >= self.max_buffered:
                closed.append(self.opened.pop(0)[0])
            slot = [self.new, 0, 0]
            self.new += 1
            self.opened.append(slot)
        slot[1], slot[2] = slot[1] + size, slot[2] + 1
        if slot[2] >= self.max_segments or slot[1] == self.length:
            self.opened.remove(slot)
            closed.append(slot[0])
        return slot[0], closed


def first_fit_packs(df: DataFrame, length: int, max_segments: int, max_buffered: int, group: str, idx: str = "idx", n: str = "n_tokens") -> DataFrame:
    """(group, idx, pack): each row goes to the first open pack that has room; empty rows go nowhere, a row over the length raises.

    Before a new pack is opened, the oldest are closed while max_buffered are open. A pack that has max_segments
    rows, or is full, is closed. streaming.growing.pack_stream() is the same over a stream.
    """

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(idx, ignore_index=True)
        pool, kept, packs = Pool(length, max_segments, max_buffered), [], []
        for row, (size, i) in enumerate(zip(pdf[n].tolist(), pdf[idx].tolist(), strict=True)):
            if size:
                kept.append(row)
                packs.append(pool.add(size, i)[0])
        return pdf.loc[kept, [group, idx]].assign(pack=packs)

    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    return df.select(group, idx, n).groupBy(group).applyInPandas(fold, f"{group} {kinds[group]}, {idx} {kinds[idx]}, pack long")


#: Blocks whose answers are composed in one step.
_FAN = 512


def greedy_packs_global(df: DataFrame, lengths: dict[str, int], max_segments: int, idx: str = "idx", rows: int = 4096, fan: int = _FAN) -> DataFrame:
    """(idx, pack) of the greedy packing of a whole table with a dense idx, numbered from zero; the result of one ordered scan.

    Rows are cut into blocks of `rows`, of max_segments at least, with the first rows of the next block. Where the last pack
    of a block ends depends only on where its first one starts, at one of max_segments places: every block answers
    for each of them. Answers of neighbouring blocks compose to an answer of both, so they are composed `fan` at a time, level by
    level, until one is left; the start is then handed down the levels again, and the blocks, told theirs, deal out their packs.
    Lengths, which are read several times, are kept, and so are the blocks' answers: whatever they are made of is made once.
    """
    names, rows = list(lengths), max(rows, max_segments)
    own = df.select(F.col(idx).alias("i"), *names).persist()
    placed = own.withColumn("block", F.explode(F.when((F.col("i") % rows < max_segments) & (F.col("i") >= rows), F.array(F.floor(F.col("i") / rows), F.floor(F.col("i") / rows) - 1)).otherwise(F.array(F.floor(F.col("i") / rows)))))

    def ends(pdf: pd.DataFrame) -> tuple[int, list[int]]:
        """For each row the row after the pack that starts there."""
        sizes = pdf[names].to_numpy().tolist()
        limits = [lengths[x] for x in names]
        for i, row in zip(pdf["i"].tolist(), sizes, strict=True):
            for name, x, limit in zip(names, row, limits, strict=True):
                if x > limit:
                    raise ValueError(f"Row {i} has length {x} in '{name}', which exceeds {limit}")
        out, end, used, n = [], 0, [0] * len(names), len(sizes)
        for start in range(n):
            end = max(end, start)
            while end < n and end - start < max_segments and all(u + x <= limit for u, x, limit in zip(used, sizes[end], limits, strict=True)):
                used = [u + x for u, x in zip(used, sizes[end], strict=True)]
                end += 1
            out.append(end)
            used = [u - x for u, x in zip(used, sizes[start], strict=True)]
        return n, out

    def followed(out: list[int], start: int, stop: int) -> list[int]:
        starts = []
        while start < stop:
            starts.append(start)
            start = out[start]
        return [*starts, start]

    def exits(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("i", ignore_index=True)
        n, out = ends(pdf)
        stop = min(rows, n)
        leave, count = [stop] * (n + 1), [0] * (n + 1)
        for start in range(stop - 1, -1, -1):
            after = out[start]
            leave[start], count[start] = (leave[after] if after < stop else after), (count[after] if after < stop else 0) + 1
        for k in range(stop, n + 1):
            leave[k] = k
        # a start past the rows there are stays where it is and packs nothing
        pad = [max(k - rows, 0) for k in range(n + 1, max_segments)]
        block = int(pdf["block"].iloc[0])
        return pd.DataFrame({"block": [block], "leave": [[max(x - rows, 0) for x in leave[:max_segments]] + pad], "packs": [count[:max_segments] + [0] * len(pad)]})

    def compose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("block")
        at, total = np.arange(max_segments), np.zeros(max_segments, np.int64)
        for leave, packs in zip(pdf["leave"], pdf["packs"], strict=True):
            total += np.asarray(packs)[at]
            at = np.asarray(leave)[at]
        return pd.DataFrame({"block": [int(pdf["block"].iloc[0]) // fan], "leave": [at.tolist()], "packs": [total.tolist()]})

    def hand_down(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("block")
        entry, before, found = int(pdf["entry"].iloc[0]), int(pdf["before"].iloc[0]), []
        for block, leave, packs in pdf[["block", "leave", "packs"]].itertuples(index=False):
            found.append((block, entry, before))
            entry, before = int(leave[entry]), before + int(packs[entry])
        return pd.DataFrame(found, columns=["block", "entry", "before"])

    def deal(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("i", ignore_index=True)
        n, out = ends(pdf)
        entry, before = int(pdf["entry"].iloc[0]), int(pdf["before"].iloc[0])
        starts = followed(out, entry, min(rows, n))
        packs = [before + k for k, (a, b) in enumerate(zip(starts, starts[1:], strict=False)) for _ in range(a, b)]
        return pd.DataFrame({idx: pdf["i"].to_numpy()[entry : entry + len(packs)], "pack": packs})

    shape = "block long, leave array<long>, packs array<long>"
    levels = [placed.groupBy("block").applyInPandas(exits, shape).persist()]
    blocks = own.agg(F.max("i").alias("last")).first()["last"]
    blocks = 1 if blocks is None else blocks // rows + 1
    while blocks > fan:
        levels.append(levels[-1].groupBy(F.floor(F.col("block") / fan).alias("__up")).applyInPandas(compose, shape))
        blocks = -(-blocks // fan)
    entries = None
    for level in reversed(levels):
        given = level.withColumn("__up", F.floor(F.col("block") / fan))
        if entries is None:
            given = given.withColumn("entry", F.lit(0).cast("long")).withColumn("before", F.lit(0).cast("long"))
        else:
            given = given.join(entries.withColumnRenamed("block", "__up"), "__up")
        entries = given.groupBy("__up").applyInPandas(hand_down, "block long, entry long, before long")
    return placed.join(entries, "block").groupBy("block").applyInPandas(deal, f"{idx} long, pack long")


def checked_prompts(df: DataFrame, ids: str = "ids", prompt: str = "prompt_length") -> DataFrame:
    """df, where a row without ids, or none after its prompt, raises."""
    bad = F.when(F.size(ids) < 1, F.raise_error(F.lit("a sequence needs a token at least"))).when(F.size(ids) <= F.col(prompt), F.raise_error(F.lit("a sequence must be longer than its prompt")))
    return df.withColumn(prompt, F.coalesce(bad.cast("int"), F.col(prompt)))


def packed_prompts(df: DataFrame, length: int, max_segments: int, pad: int = 0, idx: str = "idx", ids: str = "ids", prompt: str = "prompt_length") -> DataFrame:
    """(pack, tokens, segments, mask) of prompts with completions, packed greedily over the whole table.

    A row over the length keeps its last tokens. The mask is 1 from the last token of the prompt on, but for the last token
    of each row; padding has segment -1.
    """
    cut = F.greatest(F.size(ids) - length, F.lit(0))
    rows = checked_prompts(df, ids, prompt).select(F.col(idx).alias("i"), F.when(cut > 0, F.slice(ids, -length, length)).otherwise(F.col(ids)).alias("t"), F.greatest(F.col(prompt) - cut, F.lit(0)).alias("p"))
    rows = rows.withColumn("m", F.transform("t", lambda _, k: ((k >= F.col("p") - 1) & (k < F.size("t") - 1)).cast("int"))).withColumn("n", F.size("t").cast("long"))
    packs = greedy_packs_global(rows, {"n": length}, max_segments, "i")
    each = rows.join(packs, "i").groupBy("pack").agg(F.array_sort(F.collect_list(F.struct("i", "t", "m"))).alias("r"))
    fill = lambda x, v: F.slice(F.concat(x, F.array_repeat(v, length)), 1, length)
    return each.select(
        "pack",
        fill(F.flatten(F.col("r.t")), F.lit(pad).cast("int")).alias("tokens"),
        fill(F.flatten(F.transform("r", lambda r: F.array_repeat(r["i"], F.size(r["t"])))), F.lit(-1).cast("long")).alias("segments"),
        fill(F.flatten(F.col("r.m")), F.lit(0)).alias("mask"),
    )


def packed_columns(df: DataFrame, packs: DataFrame, columns: dict[str, tuple[int, object]], idx: str = "idx") -> DataFrame:
    """(pack, each of columns, segments of the first): columns: name -> (length, value of padding), read row after row."""
    names = list(columns)
    each = df.select(idx, *names).join(packs, idx).groupBy("pack").agg(F.array_sort(F.collect_list(F.struct(idx, *names))).alias("r"))
    kinds = {f.name: f.dataType.elementType for f in df.schema if f.name in columns}
    filled = [F.slice(F.concat(F.flatten(F.col(f"r.{x}")), F.array_repeat(F.lit(pad).cast(kinds[x]), n)), 1, n).alias(x) for x, (n, pad) in columns.items()]
    first, (n, _) = names[0], columns[names[0]]
    segments = F.flatten(F.transform("r", lambda r: F.array_repeat(r[idx], F.size(r[first]))))
    return each.select("pack", *filled, F.slice(F.concat(segments, F.array_repeat(F.lit(-1).cast("long"), n)), 1, n).alias("segments"))


def unique_segments(segments: Column, size: int, fill: int = -1) -> Column:
    """The sorted distinct segments, cut or filled to `size`."""
    return F.slice(F.concat(F.array_sort(F.array_distinct(segments)), F.array_repeat(F.lit(fill).cast("long"), size)), 1, size)


def segment_mask(positions: DataFrame, source_length: str, by: list[str], pos: str = "pos") -> DataFrame:
    """positions with mask: 1 from the source's length on within each segment."""
    from pyspark.sql import Window

    inside = F.row_number().over(Window.partitionBy(*by).orderBy(pos)) - 1
    return positions.withColumn("mask", (inside >= F.col(source_length)).cast("int"))
