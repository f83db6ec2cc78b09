"""Token tables from configurations: source, format, tokenizer and store in one call, and the fine-tuning sets made of them."""

from __future__ import annotations

from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.tokenizer import Tokenizer, encode
from quern.operators.datasets import ChatFormat, SupervisedFormat, TextFormat
from quern.operators.formats import single_turn
from quern.sources import readers, store

Format = TextFormat | ChatFormat | SupervisedFormat


def tokenized(df: DataFrame, fmt: Format, tok: Tokenizer, bos: bool = True, eos: bool = True, constants: dict[str, object] | None = None) -> DataFrame:
    """(shard, ids) of texts, with sources_len of prompts and responses, with mask of conversations."""
    if isinstance(fmt, TextFormat):
        return encode(df.select("shard", fmt.text), tok, fmt.text, bos, eos)
    if isinstance(fmt, SupervisedFormat):
        return prompts_tokenized(df.select("shard", F.concat(fmt.prompt, F.lit(fmt.separator)).alias("source"), F.col(fmt.response).alias("response")), tok)
    return fmt.tokens(df.select("shard", fmt.messages), tok, constants)


def prompts_tokenized(df: DataFrame, tok: Tokenizer, eos: bool = False) -> DataFrame:
    """ids and sources_len in place of source and response; eos: the tokenizer's end closes the response unless it adds one itself.

    The prompt is tokenized by itself for its length, and with the response for the ids.
    """
    ends = eos and tok.eos is not None and not tok.adds()[1]
    whole = encode(df.withColumn("__whole", F.concat("source", "response")).drop("response"), tok, "__whole", False, False)
    whole = whole.withColumn("ids", F.concat("ids", F.array(F.lit(tok.eos[1])))) if ends else whole
    alone = encode(whole.withColumnRenamed("ids", "__ids"), tok, "source", False, False)
    return alone.withColumn("sources_len", F.size("ids")).withColumn("ids", F.col("__ids")).drop("__ids")


def metadata_of(fmt: Format, tok: Tokenizer, bos: bool = True, eos: bool = True) -> dict:
    """What makes a table's rows what they are."""
    return {**tok.metadata(bos, eos), "format": {"type": type(fmt).__name__, **asdict(fmt)}}


def build_table(spark: SparkSession, path: str, pattern: str | None, fmt: Format, tok: Tokenizer, bos: bool = True, eos: bool = True, constants: dict[str, object] | None = None, groups: int = 128, **options) -> DataFrame | None:
    """The token table at path, built from the files of pattern if it isn't there; None where there is neither.

    The rows of each file are a shard, in the order of files; rows keep their file's name.
    """
    meta = metadata_of(fmt, tok, bos, eos)
    try:
        return store.load(spark, path, meta)
    except FileNotFoundError:
        if pattern is None:
            return None
    source = readers.read_sharded(spark, pattern).drop("shard_idx")
    fields = ("ids", "mask") if isinstance(fmt, ChatFormat) else ("ids",)
    return store.build_or_load(spark, path, source, lambda df: tokenized(df, fmt, tok, bos, eos, constants), meta, fields=fields, groups=groups, **options)


def load_table(spark: SparkSession, path: str, fmt: Format, tok: Tokenizer, bos: bool = True, eos: bool = True) -> DataFrame:
    """A table that build_table() finished; one of another tokenizer or format warns."""
    return store.load(spark, path, metadata_of(fmt, tok, bos, eos))


def padded_examples(df: DataFrame, length: int, pad: int) -> DataFrame:
    """tokens and mask of rows of (ids, sources_len): filled up with pad, or the last `length` ids.

    The mask is 1 from the position before sources_len on, where the next token, circularly, isn't pad, but for the last position.
    """
    tokens = F.when(F.size("ids") > length, F.slice("ids", -length, length)).otherwise(F.slice(F.concat("ids", F.array_repeat(F.lit(pad), length)), 1, length))
    out = df.withColumn("tokens", tokens)
    following = lambda i: F.get("tokens", F.pmod(i + 1, F.lit(length)))
    mask = F.transform("tokens", lambda _, i: ((i >= F.col("sources_len") - 1) & (following(i) != pad) & (i < length - 1)).cast("int"))
    return out.withColumn("mask", mask).drop("ids", "sources_len")


def supervised_set(spark: SparkSession, path: str, pattern: str, tok: Tokenizer, length: int, pad: int = 0, prompt: str = "prompt", response: str = "response", **options) -> DataFrame:
    """Padded examples of prompts and responses, from a table that is built if it isn't there."""
    table = build_table(spark, path, pattern, SupervisedFormat(prompt, response), tok, **options)
    return padded_examples(table, length, pad)


def single_turn_table(spark: SparkSession, path: str, pattern: str, tok: Tokenizer, user: str = "user", assistant: str = "assistant", messages: str = "messages", groups: int = 128) -> DataFrame:
    """(shard, ids, sources_len) of the first user and the first assistant message of each conversation, closed by eos."""

    def process(df: DataFrame) -> DataFrame:
        pairs = single_turn(readers.with_roles(df, messages, "role", "content", user, assistant))
        return prompts_tokenized(pairs.select("shard", F.col("prompt").alias("source"), "response"), tok, eos=True)

    meta = {**tok.metadata(), "format": {"type": "single turn", "user": user, "assistant": assistant, "messages": messages}}
    return store.build_or_load(spark, path, readers.read_sharded(spark, pattern).drop("shard_idx"), process, meta, groups=groups)


def single_turn_set(spark: SparkSession, path: str, pattern: str, tok: Tokenizer, length: int, pad: int = 0, **options) -> DataFrame:
    """Padded examples of single turns: the fine-tuning set of conversations without a template."""
    return padded_examples(single_turn_table(spark, path, pattern, tok, **options), length, pad)
