"""Configured datasets: what a format, a single source or a mixture makes of tables of rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions.templates import Template
from quern.functions.tokenizer import Tokenizer, masked_by_spans
from quern.operators import indexing, mixing, packing, sequences, shuffling


@dataclass(frozen=True)
class TextFormat:
    """Texts, joined and cut into sequences."""

    text: str = "text"


@dataclass(frozen=True)
class ChatFormat:
    """Conversations, packed; the loss is on what the assistant says."""

    messages: str = "messages"
    max_segments: int = 64
    slice_side: str = "left"
    template: str | None = None
    mask_user_turns: bool = True

    def __post_init__(self):
        if self.template is not None and self.mask_user_turns and not Template(self.template).marks_generations:
            raise ValueError("a template that masks user turns must mark generations")

    def tokens(self, df: DataFrame, tok: Tokenizer, constants: dict[str, object] | None = None, on_missing: str = "raise") -> DataFrame:
        """df with ids and mask in place of its conversations: rendered by the template, 1 on what it marks as generated.

        Where user turns aren't masked, every token counts.
        """
        if self.template is None:
            raise ValueError("a chat format needs a template")
        out = Template(self.template, tuple((constants or {}).items())).rendered(df, self.messages, "__text", "__spans")
        if not self.mask_user_turns:
            out = out.withColumn("__spans", F.array(F.struct(F.lit(0).alias("begin"), F.char_length("__text").alias("end"))))
        return masked_by_spans(out.drop(self.messages), tok, "__text", "__spans", on_missing)


@dataclass(frozen=True)
class SupervisedFormat:
    """Prompts and responses, packed; the loss is on responses."""

    prompt: str = "prompt"
    response: str = "response"
    separator: str = ""
    max_segments: int = 64
    slice_side: str = "right"


#: Formats by the names that configurations give.
FORMATS: dict[str, type] = {"text": TextFormat, "chat": ChatFormat, "supervised": SupervisedFormat}


def format_of(config: dict) -> TextFormat | ChatFormat | SupervisedFormat:
    """A format from {"type": name, option: value}; unknown names raise."""
    kind = config.get("type", "text")
    if kind not in FORMATS:
        raise ValueError(f"unknown format {kind}; there are {sorted(FORMATS)}")
    return FORMATS[kind](**{k: v for k, v in config.items() if k != "type"})


def _cut(df: DataFrame, length: int, side: str, idx: str) -> DataFrame:
    """(idx, t, m): ids and mask of at most `length` positions, the left or the right ones."""
    part = lambda x: F.when(F.size(x) > length, F.slice(x, 1, length) if side == "left" else F.slice(x, -length, length)).otherwise(F.col(x))
    return df.select(F.col(idx).alias("i"), part("ids").alias("t"), part("mask").alias("m"))


def packed_masked(df: DataFrame, length: int, max_segments: int, side: str, shift: bool, pad: int = 0, idx: str = "idx") -> DataFrame:
    """(pack, tokens, segments, mask) of rows of (idx, ids, mask), packed greedily over the whole table.

    shift: the mask of a position is that of the token after it, in the pack, circularly.
    """
    rows = _cut(df, length, side, idx).withColumn("n", F.size("t").cast("long"))
    packs = packing.greedy_packs_global(rows, {"n": length}, max_segments, "i")
    each = rows.join(packs, "i").groupBy("pack").agg(F.array_sort(F.collect_list(F.struct("i", "t", "m"))).alias("r"))
    fill = lambda x, v: F.slice(F.concat(x, F.array_repeat(v, length)), 1, length)
    out = each.select(
        "pack",
        fill(F.flatten(F.col("r.t")), F.lit(pad).cast("int")).alias("tokens"),
        fill(F.flatten(F.transform("r", lambda r: F.array_repeat(r["i"], F.size(r["t"])))), F.lit(-1).cast("long")).alias("segments"),
        fill(F.flatten(F.col("r.m")), F.lit(0)).alias("mask"),
    )
    return out.withColumn("mask", F.transform("mask", lambda m, i: F.get("mask", F.pmod(i + 1, F.lit(length))))) if shift else out


def supervised_dataset(df: DataFrame, length: int, fmt: SupervisedFormat | None = None, pad: int = 0, idx: str = "idx") -> DataFrame:
    """Packs of (idx, ids, sources_len): the mask is 1 from the source's length on in each row; over-long rows lose it by what is cut on the left."""
    fmt = fmt or SupervisedFormat()
    cut = F.greatest(F.size("ids") - length, F.lit(0)) if fmt.slice_side == "right" else F.lit(0)
    start = F.greatest(F.col("sources_len") - cut, F.lit(0))
    rows = df.withColumn("mask", F.transform("ids", lambda _, i: (i - cut >= start).cast("int")))
    return packed_masked(rows, length, fmt.max_segments, fmt.slice_side, False, pad, idx)


def chat_dataset(df: DataFrame, length: int, fmt: ChatFormat | None = None, pad: int = 0, idx: str = "idx") -> DataFrame:
    """Packs of (idx, ids, mask); the loss at a position is on the token after it."""
    fmt = fmt or ChatFormat()
    return packed_masked(df, length, fmt.max_segments, fmt.slice_side, True, pad, idx)


def dataset_for(fmt: TextFormat | ChatFormat | SupervisedFormat, df: DataFrame, length: int, idx: str = "idx") -> DataFrame:
    """Sequences of a token table by its format."""
    if isinstance(fmt, TextFormat):
        return sequences.concat_and_chunk(df, length, "ids", idx)
    return supervised_dataset(df, length, fmt, 0, idx) if isinstance(fmt, SupervisedFormat) else chat_dataset(df, length, fmt, 0, idx)


def sft_examples(df: DataFrame, length: int, ids: str = "ids", prompt: str = "prompt_length") -> DataFrame:
    """Rows whose prompt leaves room for a completion: the prompt is shorter than `length` and the row, which is cut to `length`."""
    return df.where((F.col(prompt) <= length - 1) & (F.size(ids) > F.col(prompt))).withColumn(ids, F.slice(ids, 1, length))


@dataclass(frozen=True)
class Single:
    """One source: shuffled whole (seed) or within eras, then repeated; the last rows may be held out before."""

    seed: int | None = None
    era: int | None = None
    epochs: int = 1
    hold_out: int = 0
    max_train_batches: int | None = None
    batch: int = 1

    def train(self, df: DataFrame, length: int, idx: str = "idx") -> DataFrame:
        df, length = df.where(F.col(idx) < length - self.hold_out), length - self.hold_out
        if self.max_train_batches is not None:
            wanted = self.max_train_batches * self.batch
            if wanted > length:
                raise ValueError(f"{wanted} rows asked for, there are {length}")
            df, length = indexing.take(df, wanted, idx), wanted
        if self.era:
            df = shuffling.era_permuted(df, length, self.era, shuffling.era_parameters(df.sparkSession, length, self.era, self.seed or 0), idx).drop("source_idx")
        elif self.seed is not None:
            df = shuffling.permuted(df, shuffling.lcg(F.col(idx), length, *shuffling.lcg_parameters(length, self.seed)), idx).drop("source_idx")
        return indexing.epochs(df, self.epochs, length, idx).drop("epoch") if self.epochs > 1 else df

    def validation(self, df: DataFrame, length: int, idx: str = "idx") -> DataFrame | None:
        return indexing.slice_rows(df, length - self.hold_out, None, idx) if self.hold_out else None


@dataclass(frozen=True)
class Mixture:
    """Sources by staged weights. Budgets cut every source to its share of a simulated experiment first."""

    stages: tuple[mixing.Stage, ...]
    block: int = 2048
    seed: int = 0
    stop: str = "restart"
    experiment: float | None = None
    target: float | None = None

    def __post_init__(self):
        if self.stop != "restart":
            raise NotImplementedError(f"stop strategy {self.stop}")
        if (self.experiment is None) != (self.target is None):
            raise ValueError("experiment and target budgets go together")

    def lengths(self, lengths: dict[str, int]) -> dict[str, int]:
        if self.experiment is None:
            return lengths
        return {k: int(n * self.experiment / self.target) for k, n in lengths.items()}

    def table(self, sources: DataFrame, lengths: dict[str, int], n: int) -> DataFrame:
        """(idx, source, source_idx and the other columns) of the first n positions. sources: source, source_idx, ..."""
        index = mixing.mixture_index(sources.sparkSession, list(self.stages), self.block, n, self.lengths(lengths), self.seed)
        return index.join(sources, ["source", "source_idx"])

    def rescaled(self, schedule: mixing.Schedule) -> Mixture:
        """Stages given by steps, as stages by rows: a start of -1 stands for the end and may only come last."""
        starts = [s.start for s in self.stages]
        if -1 in starts[:-1]:
            raise ValueError("only the last stage may start at -1")
        kept = [s for s in self.stages if s.start != -1]
        return replace(self, stages=tuple(mixing.Stage(schedule.offset_at(s.start), s.weights) for s in kept))


def tagged_concat(parts: dict[str, tuple[DataFrame, int, list[str]]], idx: str = "idx") -> tuple[DataFrame, list[str]]:
    """Datasets one after another with a bit for each tag, and the tags in order. parts: name -> (table, length, tags)."""
    tags = list(dict.fromkeys(t for _, _, own in parts.values() for t in own))
    out, offset = None, 0
    for df, length, own in parts.values():
        bits = F.array(*(F.lit(int(t in own)) for t in tags)) if tags else F.array().cast("array<int>")
        placed = df.withColumn(idx, F.col(idx) + offset).withColumn("tag_bits", bits)
        out = placed if out is None else out.unionByName(placed)
        offset += length
    return out, tags


def coverage(asked: DataFrame, answered: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Keys asked for without an answer, and keys answered that nobody asked for."""
    return asked.select(key).join(answered, key, "left_anti"), answered.select(key).join(asked, key, "left_anti")


def checked_coverage(asked: DataFrame, answered: DataFrame, key: str) -> DataFrame:
    missing, extra = (x.count() for x in coverage(asked, answered, key))
    if missing or extra:
        raise ValueError(f"{missing} missing and {extra} extra")
    return answered


def ordered_union(a: DataFrame, b: DataFrame, value: str, order: str) -> DataFrame:
    """(value, order): a's values in their order, then those of b that a lacks in theirs."""
    both = a.groupBy(value).agg(F.min(order).alias(order)).withColumn("part", F.lit(0)).union(b.groupBy(value).agg(F.min(order)).withColumn("part", F.lit(1)))
    first = both.groupBy(value).agg(F.min(F.struct("part", order)).alias("at"))
    return indexing.ordered_index(first.select(value, F.col("at.part").alias("part"), F.col(f"at.{order}").alias("place")), ("part", "place", value), order).select(value, order)


Transform = Callable[[DataFrame], DataFrame]
