"""Chat and prompt/response records to token rows with loss masks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.tokens import word_hash_ids


def messages(turns: DataFrame, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """(conv, messages): array of (role, content) in the order of turns."""
    rows = F.array_sort(F.collect_list(F.struct(F.col(turn).alias("t"), F.col("role"), F.col("text").alias("content"))))
    return turns.groupBy(conv).agg(F.transform(rows, lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))).alias("messages"))


def first_of(role: str) -> Column:
    return F.get(F.filter("messages", lambda m: m["role"] == role), 0)["content"]


def single_turn(df: DataFrame) -> DataFrame:
    """prompt and response: the first user and the first assistant message; rows lacking either go."""
    return df.withColumn("prompt", first_of("user")).withColumn("response", first_of("assistant")).where("prompt is not null and response is not null").drop("messages")


def chat_tokens(df: DataFrame, vocabulary: int, on_missing: str = "raise") -> DataFrame:
    """ids and mask of a conversation rendered message by message: the role's token, the content; 1 on assistant content.

    Conversations without an assistant token raise, or are dropped with on_missing="drop".
    """
    piece = lambda m: F.concat(word_hash_ids(F.concat(F.lit("<"), m["role"], F.lit(">")), vocabulary), word_hash_ids(m["content"], vocabulary))
    bit = lambda m: F.concat(F.array(F.lit(0)), F.array_repeat((m["role"] == "assistant").cast("int"), F.size(word_hash_ids(m["content"], vocabulary))))
    out = df.withColumn("ids", F.flatten(F.transform("messages", piece))).withColumn("mask", F.flatten(F.transform("messages", bit)))
    some = F.exists("mask", lambda x: x == 1)
    if on_missing == "drop":
        return out.where(some).drop("messages")
    return out.withColumn("mask", F.when(some, F.col("mask")).otherwise(F.raise_error(F.lit("no assistant token")))).drop("messages")


def supervised(df: DataFrame, vocabulary: int, separator: str = "", prompt: str = "prompt", response: str = "response") -> DataFrame:
    """ids of prompt and response, and sources_len, the tokens of the prompt."""
    source = F.concat(F.col(prompt), F.lit(separator))
    return df.withColumn("ids", word_hash_ids(F.concat(source, F.col(response)), vocabulary)).withColumn("sources_len", F.size(word_hash_ids(source, vocabulary)))


def prompt_completion(df: DataFrame, length: int) -> DataFrame:
    """The last `length` ids, the prompt shortened by what is cut, at least zero."""
    cut = F.greatest(F.size("ids") - length, F.lit(0))
    return df.withColumn("sources_len", F.greatest(F.col("sources_len") - cut, F.lit(0))).withColumn("ids", F.when(cut > 0, F.slice("ids", -length, length)).otherwise(F.col("ids")))
