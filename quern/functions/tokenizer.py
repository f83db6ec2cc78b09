"""Tokenizers as plug-ins: what a tokenizer adds itself, long texts in pieces, and the identity that a store keeps."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.functions.tokens import word_hash_ids

#: Texts over this many characters are cut at white space before they are encoded.
LONG = 10_000
PROBE = "hi there"
#: Tokens that a task has in memory before it hands them on, besides one text's.
HELD = 250_000


@dataclass(frozen=True)
class Tokenizer:
    """make() gives an encoder, a function of a text to ids, in each task; bos and eos are texts and their ids.

    spans() gives, in the same way, a function of a text to ids and each id's (begin, end) in characters; a tokenizer may lack it.
    """

    name: str
    vocabulary: int
    make: Callable[[], Callable[[str], list[int]]]
    bos: tuple[str, int] | None = None
    eos: tuple[str, int] | None = None
    spans: Callable[[], Callable[[str], tuple[list[int], list[tuple[int, int]]]]] | None = None

    def adds(self) -> tuple[bool, bool]:
        """Whether the encoder itself begins with bos and ends with eos, found by a probe."""
        ids = list(self.make()(PROBE))
        return bool(self.bos and ids[:1] == [self.bos[1]]), bool(self.eos and ids[-1:] == [self.eos[1]])

    def metadata(self, bos: bool = True, eos: bool = True) -> dict:
        """What makes stored ids what they are."""
        own = self.adds()
        return {"tokenizer": self.name, "vocab_size": self.vocabulary, "append_bos": bool(bos and self.bos and not own[0]), "append_eos": bool(eos and self.eos and not own[1])}


_REGISTRY: dict[str, Callable[..., Tokenizer]] = {}


def register(name: str):
    """Makes a factory known by name, as configurations give it."""

    def add(factory: Callable[..., Tokenizer]):
        _REGISTRY[name] = factory
        return factory

    return add


def tokenizer(name: str, **options) -> Tokenizer:
    if name not in _REGISTRY:
        raise ValueError(f"unknown tokenizer {name}; there are {sorted(_REGISTRY)}")
    return _REGISTRY[name](**options)


@register("file")
def from_file(path: str, bos: tuple[str, int] | None = None, eos: tuple[str, int] | None = None) -> Tokenizer:
    """A tokenizer.json, read in each task from a path that tasks can open."""

    def make():
        from tokenizers import Tokenizer as Loaded

        loaded = Loaded.from_file(path)
        return lambda text: loaded.encode(text).ids

    def spans():
        from tokenizers import Tokenizer as Loaded

        loaded = Loaded.from_file(path)

        def both(text):
            found = loaded.encode(text)
            return found.ids, found.offsets

        return both

    from tokenizers import Tokenizer as Loaded

    return Tokenizer(path, Loaded.from_file(path).get_vocab_size(), make, bos, eos, spans)


@register("bytes")
def of_bytes() -> Tokenizer:
    """A text's UTF-8 bytes, with 256 and 257 for its beginning and end."""
    return Tokenizer("bytes", 258, lambda: lambda text: list(text.encode("utf-8", "surrogatepass")), ("<s>", 256), ("</s>", 257))


@register("words")
def of_words(vocabulary: int) -> Tokenizer:
    """The word-hash tokenizer with the places of its words; tokens.word_hash_ids() is its form without Python."""

    def both(text: str) -> tuple[list[int], list[tuple[int, int]]]:
        found = list(re.finditer(r"[^ \t\n\r]+", text))
        return [int(hashlib.md5(m[0].encode("utf-8", "surrogatepass")).hexdigest()[:7], 16) % vocabulary for m in found], [m.span() for m in found]

    return Tokenizer("words", vocabulary, lambda: lambda text: both(text)[0], spans=lambda: both)


def in_portions(rows: Iterator[tuple[np.ndarray, ...]], tokens: int = HELD) -> Iterator[list[tuple[np.ndarray, ...]]]:
    """Rows of arrays, handed on once their first arrays have `tokens` values in all: memory doesn't depend on how many rows come at once."""
    out, held = [], 0
    for row in rows:
        out.append(row)
        held += len(row[0])
        if held >= tokens:
            yield out
            out, held = [], 0
    if out:
        yield out


def masked_by_spans(df: DataFrame, tok: Tokenizer, text: str = "text", spans: str = "spans", on_missing: str = "raise") -> DataFrame:
    """df with ids and mask in place of text and spans: 1 for the tokens that have a character within one of the spans.

    Rows without such a token raise, or are dropped with on_missing="drop".
    """
    if tok.spans is None:
        raise ValueError(f"{tok.name} doesn't tell where its tokens are")

    @F.pandas_udf("ids array<int>, mask array<int>")
    def both(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        encoder = tok.spans()

        def rows(texts: pd.Series, wanted: pd.Series) -> Iterator[tuple[np.ndarray, np.ndarray]]:
            for own, marked in zip(texts, wanted, strict=True):
                found, places = encoder(own or "")
                at = np.array(places, np.int64).reshape(-1, 2)
                change = np.zeros(len(at) + 1, np.int64)
                for span in marked if marked is not None else ():
                    # tokens are in order: the first that ends after the span's begin, up to the first that begins at its end
                    first, stop = np.searchsorted(at[:, 1], span["begin"], side="right"), np.searchsorted(at[:, 0], span["end"], side="left")
                    if stop > first:
                        change[first] += 1
                        change[stop] -= 1
                yield np.array(found, np.int32), (np.cumsum(change)[:-1] > 0).astype(np.int32)

        for texts, wanted in batches:
            for portion in in_portions(rows(texts, wanted)):
                yield pd.DataFrame({"ids": pd.Series([x for x, _ in portion], dtype=object), "mask": pd.Series([m for _, m in portion], dtype=object)})

    others = [c for c in df.columns if c not in (text, spans)]
    out = df.select(*others, both(text, spans).alias("__both")).select(*others, "__both.ids", "__both.mask")
    some = F.exists("mask", lambda x: x == 1)
    if on_missing == "drop":
        return out.where(some)
    return out.withColumn("mask", F.when(some, F.col("mask")).otherwise(F.raise_error(F.lit("no assistant token"))))


def split_long(text: Column, limit: int = LONG) -> Column:
    """Pieces of a text: while it is longer than limit, cut at the first white space at or after it; none there: the rest is one piece."""
    # limit characters, then up to the next white space, which begins the next piece
    piece = f"(?s)(.{{{limit}}}\\S*(?=\\s)|.+)"
    return F.when(F.length(text) > limit, F.regexp_extract_all(text, F.lit(piece), F.lit(1))).otherwise(F.array(text))


def merged(df: DataFrame, by: str, order: str, ids: str = "ids") -> DataFrame:
    """(by, ids): the ids of a text's pieces, joined in order."""
    each = df.groupBy(by).agg(F.array_sort(F.collect_list(F.struct(order, ids))).alias("r"))
    return each.select(by, F.flatten(F.col(f"r.{ids}")).alias(ids))


def encode(df: DataFrame, tok: Tokenizer, text: str = "text", bos: bool = True, eos: bool = True, limit: int = LONG) -> DataFrame:
    """df with ids in place of text. Long texts are encoded in pieces; bos and eos are added where the tokenizer doesn't.

    A null text counts as empty.
    """
    flags = tok.metadata(bos, eos)
    first = [tok.bos[1]] if flags["append_bos"] else []
    last = [tok.eos[1]] if flags["append_eos"] else []

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = tok.make()
        for pieces in batches:
            for portion in in_portions((np.array([*first, *(i for p in own for i in encoder(p)), *last], np.int32),) for own in pieces):
                yield pd.Series([x for (x,) in portion], dtype=object)

    others = [c for c in df.columns if c != text]
    return df.select(*others, ids(split_long(F.coalesce(F.col(text), F.lit("")), limit)).alias("ids"))


def encode_words(df: DataFrame, vocabulary: int, text: str = "text") -> DataFrame:
    """df with ids of the word-hash tokenizer in place of text, without Python."""
    return df.select(*(c for c in df.columns if c != text), word_hash_ids(F.col(text), vocabulary).alias("ids"))
