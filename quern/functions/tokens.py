"""Token columns: the word-hash tokenizer, the pass-through tokenizer, text framing and length rules."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are split where every engine agrees on white space.
SPLIT = "[ \\t\\n\\r]+"


def words(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPLIT), lambda x: x != "")


def word_hash_ids(text: Column, vocabulary: int) -> Column:
    """Token ids: the first seven hex digits of a word's MD5, modulo the vocabulary."""
    return F.transform(words(text), lambda x: (F.conv(F.substring(F.md5(x), 1, 7), 16, 10).cast("long") % vocabulary).cast("int"))


def pass_through_ids(text: Column) -> Column:
    """Token ids from space-separated numbers."""
    return F.transform(words(text), lambda x: x.cast("int"))


def framed(text: Column, bos: str | None = None, eos: str | None = None) -> Column:
    """bos and eos joined to the text by a space each."""
    parts = [F.lit(bos)] * (bos is not None) + [text] + [F.lit(eos)] * (eos is not None)
    return F.concat_ws(" ", *parts) if len(parts) > 1 else text


def padded(ids: Column, length: int, pad: int = 0) -> Column:
    """The first `length` ids, filled up with pad."""
    return F.slice(F.concat(ids, F.array_repeat(F.lit(pad).cast("int"), length)), 1, length)


def kept_right(ids: Column, length: int) -> Column:
    """The last `length` ids."""
    return F.when(F.size(ids) > length, F.slice(ids, -length, length)).otherwise(ids)


def byte_length(piece: Column) -> Column:
    """Bytes that a vocabulary entry stands for: one for <0xNN>, else its UTF-8 length."""
    return F.when(piece.rlike("^<0x[0-9A-Fa-f]{2}>$"), 1).otherwise(F.octet_length(piece))


def vocabulary_bytes(spark: SparkSession, path: str) -> DataFrame:
    """(token, entry, bytes) of a tokenizer.json: the bytes that each id stands for.

    Special tokens have none, <0xNN> has one; of others it is what the id adds to a text that goes before it, since many
    tokenizers drop blanks at the beginning.
    """
    from tokenizers import Tokenizer

    loaded = Tokenizer.from_file(path)
    special = {k for k, added in loaded.get_added_tokens_decoder().items() if added.special}
    probe = loaded.encode(".", add_special_tokens=False).ids[0]
    before = len(loaded.decode([probe], skip_special_tokens=False).encode())

    def size(token: int, entry: str) -> int:
        if token in special:
            return 0
        if re.fullmatch("<0x[0-9A-Fa-f]{2}>", entry):
            return 1
        return len(loaded.decode([probe, token], skip_special_tokens=False).encode("utf-8", "surrogatepass")) - before

    rows = [(k, entry, size(k, entry)) for entry, k in loaded.get_vocab().items()]
    return spark.createDataFrame(rows, "token int, entry string, bytes int")


def token_bytes(df: DataFrame, vocabulary: DataFrame, key: str, ids: str = "ids") -> DataFrame:
    """(key, bytes): what each row's ids stand for; an id without an entry raises. The vocabulary, which a tokenizer bounds, is broadcast."""
    each = df.select(key, F.explode(ids).alias("token")).join(F.broadcast(vocabulary.select("token", "bytes")), "token", "left")
    known = F.when(F.col("bytes").isNull(), F.raise_error(F.concat(F.lit("no entry for id "), F.col("token").cast("string"))).cast("int")).otherwise(F.col("bytes"))
    return each.groupBy(key).agg(F.sum(known).cast("long").alias("bytes"))
