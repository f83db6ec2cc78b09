"""Removes repeated substrings of LENGTH bytes or more by distributed prefix doubling over sparse positions.

Ranking every byte position at growing offsets would shuffle many times the input, so positions are
chosen by content: in each window of LENGTH bytes the START-byte prefix of lowest hash, the leftmost of
equals (one position in about 35). Equal windows choose equal positions at equal places, so nothing is lost.
Prefixes are ranked at three lengths: START bytes, then the whole stretch of windows that a position serves,
then LENGTH. At each step Spark sorts positions by their pair of ranks; equal pairs stand together, the
earliest is the first of its rank, and what is unique drops out:

1. a position whose START bytes are unique has no repeated window;
2. positions with equal stretches repeat all their windows but for the earliest position;
3. the earliest positions of different stretches that share their START bytes are compared window by window,
   ranked by the START bytes and the pair of 64-byte ranks at offsets 0 and LENGTH - 64.

In each task the equal pairs of a batch of rows are met first, so a passage in a third of all texts sends
one row a batch to the sort. Ranks are 128 bits of hashes, those of windows 96.

A byte goes if a window over it also starts earlier: in a smaller doc_id, or earlier in the same document.
Null ids come before all others and are one document; rows of one id count as one document, so repeated rows
give equal results. Null and empty texts have no bytes. Long texts are read in pieces of PIECE
bytes that overlap by LENGTH - 1. Other columns do no harm; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm.common import maybe_among, stage

LENGTH = 100
START = 32
PIECE = 1 << 20
_FACTOR = 0x9E3779B97F4A7C15
_LOW = np.uint64((PIECE << 1) - 1)
_FIRST_ID = -(1 << 63)


def _doubled(b: np.ndarray) -> dict[int, np.ndarray]:
    """Ranks of all prefixes of 1, 2, 4 .. 64 bytes, each from the pair of ranks at half the length."""
    ranks = {1: (b.astype(np.uint64) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)}
    n = 1
    while 2 * n <= 64 and 2 * n <= len(b):
        x = ranks[n]
        ranks[2 * n] = x[:-n] * np.uint64(pow(_FACTOR, n, 1 << 64)) + x[n:]
        n *= 2
    return ranks


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(29))


def positions(piece: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each chosen position: first and last start of the windows that it serves, rank of its START bytes, rank of the stretch."""
    rank = _mixed(_doubled(piece)[START])
    low = (rank & ~_LOW) | np.arange(len(rank), dtype=np.uint64)
    n, width = 1, LENGTH - START + 1
    while 2 * n <= width:
        low = np.minimum(low[:-n], low[n:])
        n *= 2
    if width > n:
        low = np.minimum(low[: len(low) - (width - n)], low[width - n :])
    at = (low & _LOW).astype(np.int64)
    change = np.flatnonzero(np.diff(at)) + 1
    first, last = np.concatenate([[0], change]), np.concatenate([change, [len(at)]]) - 1
    at = at[first]
    view = memoryview(np.ascontiguousarray(piece))
    stretch = [xxhash.xxh64_intdigest(view[a : b + LENGTH], c) for a, b, c in zip(first.tolist(), last.tolist(), (at - first).tolist(), strict=True)]
    return first, last, rank[at], np.array(stretch, np.uint64)


def _pieces(text: str | None) -> Iterator[tuple[int, np.ndarray]]:
    whole = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    for k in range(0, len(whole) - LENGTH + 1, PIECE):
        yield k, whole[k : k + PIECE + LENGTH - 1]


def _repeats(order: tuple[np.ndarray, ...], document: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Whether an earlier (document, start) has the same pair of ranks, among the rows given."""
    by = np.lexsort((start, document, *order))
    new = np.ones(len(by), bool)
    for x in order:
        new[1:] &= x[by][1:] == x[by][:-1]
    new[1:] = ~new[1:]
    head = by[np.maximum.accumulate(np.where(new, np.arange(len(by)), 0))]
    out = np.zeros(len(by), bool)
    out[by] = (document[head] != document[by]) | (start[head] != start[by])
    return out


def _merged(first: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of spans as maximal spans."""
    if not len(first):
        return first, end
    by = np.argsort(first, kind="stable")
    first, end = first[by], np.maximum.accumulate(end[by])
    new = np.concatenate([[True], first[1:] > end[:-1]])
    return first[new], end[np.append(np.flatnonzero(new)[1:] - 1, len(end) - 1)]


_ROWS_AT_ONCE = 2000
_POSITIONS = "doc long, key long, first int, last int, start_rank long, stretch_rank long, repeated boolean"
_NAMES = [x.split()[0] for x in _POSITIONS.split(", ")]


def _chosen(docs: DataFrame) -> DataFrame:
    """Positions of all texts; with repeated, spans (first, last start) whose windows repeat within the batch."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in (b.iloc[k : k + _ROWS_AT_ONCE] for b in batches for k in range(0, len(b), _ROWS_AT_ONCE)):
            parts = []
            for row, text in enumerate(batch["text"]):
                for k, piece in _pieces(text):
                    first, last, start, stretch = positions(piece)
                    parts.append((np.full(len(first), row), first + k, last + k, start.view(np.int64), stretch.view(np.int64)))
            if not parts:
                continue
            row, first, last, start, stretch = (np.concatenate(x) for x in zip(*parts, strict=True))
            doc, key = batch["doc"].to_numpy(np.int64)[row], batch["key"].to_numpy(np.int64)[row]
            known = _repeats((stretch, start), doc, first)
            gone = {"row": [], "first": [], "last": []}
            at = np.flatnonzero(known)
            for own in np.split(at, np.flatnonzero(np.diff(row[at])) + 1) if len(at) else ():
                a, b = _merged(first[own], last[own] + LENGTH)
                gone["row"].append(np.full(len(a), row[own[0]]))
                gone["first"].append(a)
                gone["last"].append(b - LENGTH)
            left = ~known
            yield pd.DataFrame(dict(zip(_NAMES, (doc[left], key[left], first[left], last[left], start[left], stretch[left], False), strict=True)))
            if gone["row"]:
                r, a, b = (np.concatenate(gone[x]) for x in ("row", "first", "last"))
                d, k = batch["doc"].to_numpy(np.int64)[r], batch["key"].to_numpy(np.int64)[r]
                # these have their answer; their ranks only spread them over the tasks
                spread = _mixed(d.astype(np.uint64) * np.uint64(_FACTOR) + a.astype(np.uint64)).view(np.int64)
                yield pd.DataFrame(dict(zip(_NAMES, (d, k, a, b, spread, spread, True), strict=True)))

    return docs.select("doc", "key", "text").mapInPandas(rows, _POSITIONS)


def _cut_out(reps: DataFrame) -> DataFrame:
    """(doc, key, start_rank, first, body): the bytes of every stretch in reps: doc, key, text, stretches."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for doc, key, text, stretches in zip(batch["doc"], batch["key"], batch["text"], batch["stretches"], strict=True):
                whole = text.encode("utf-8", "surrogatepass")
                out += [(doc, key, s["start_rank"], s["first"], whole[s["first"] : s["last"] + LENGTH]) for s in stretches]
            yield pd.DataFrame(out, columns=["doc", "key", "start_rank", "first", "body"])

    return reps.select("doc", "key", "text", "stretches").mapInPandas(rows, "doc long, key long, start_rank long, first int, body binary")


def _window_ranks(stretches: DataFrame) -> DataFrame:
    """(doc, key, start, pair_rank, at) of every window of the stretches that _cut_out() gives.

    start: half of the rank of the START bytes; at: twice the position, plus one if the window repeats within the batch.
    """

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            pairs, sizes = [np.zeros(0, np.uint64)], []
            for body in batch["body"]:
                r = _doubled(np.frombuffer(body, np.uint8))[64]
                n = len(body) - LENGTH + 1
                pairs.append(_mixed(_mixed(r[:n]) * np.uint64(_FACTOR) + r[LENGTH - 64 : LENGTH - 64 + n]))
                sizes.append(n)
            sizes = np.array(sizes, np.int64)
            doc, key, start, first = (np.repeat(batch[x].to_numpy(np.int64), sizes) for x in ("doc", "key", "start_rank", "first"))
            at = first + np.arange(len(first)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            pair = np.concatenate(pairs).view(np.int64)
            yield pd.DataFrame({"key": key, "start": start.astype(np.int32), "pair_rank": pair, "doc": doc, "at": 2 * at + _repeats((pair, start), doc, at)})

    return stretches.mapInPandas(rows, "key long, start int, pair_rank long, doc long, at long")


def _earlier(df: DataFrame, ranks: list[str], at: str) -> DataFrame:
    """df sorted by its pair of ranks, with later: whether the same pair has an earlier (doc, at)."""
    window = Window.partitionBy(*ranks).orderBy("doc", at)
    head = F.first(F.struct("doc", at)).over(window)
    return df.withColumn("later", F.struct("doc", at) != head)


def repeated_spans(docs: DataFrame, unique: bool = False) -> DataFrame:
    """(doc, key, first, end): spans of bytes, overlapping ones too, that the contract removes. docs: doc, key, text.

    unique: no (doc, key) occurs twice, so that texts need no shuffle to tell.
    """
    ranked = _earlier(_chosen(docs).repartition("start_rank"), ["start_rank", "stretch_rank"], "first")
    # several stretches behind the same START bytes
    whole = Window.partitionBy("start_rank")
    several = F.min("stretch_rank").over(whole) != F.max("stretch_rank").over(whole)
    marks = ranked.withColumn("several", several).where("repeated or later or several")
    marks = stage(marks.select("doc", "key", "first", "last", "start_rank", (F.col("repeated") | F.col("later")).alias("gone")), "marks")
    open_ = marks.where("not gone").groupBy("doc", "key").agg(F.collect_set(F.struct("first", "last", "start_rank")).alias("stretches"))
    texts = docs.where(maybe_among(open_.select("doc", "key"), "doc", "key"))
    texts = texts if unique else texts.dropDuplicates(["doc", "key"])
    # once their bytes are written, what the texts took to be shuffled is free
    windows = _window_ranks(stage(_cut_out(texts.join(open_, ["doc", "key"])), "stretches"))
    later = _earlier(windows, ["start", "pair_rank"], "at").where("later or at % 2 = 1").withColumn("at", (F.col("at") / 2).cast("int"))
    one = marks.where("gone").select("doc", "key", "first", (F.col("last") + LENGTH).alias("end"))
    return one.union(later.select("doc", "key", F.col("at").alias("first"), (F.col("at") + LENGTH).alias("end")))


def dedup(df: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 for every row of df."""
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    ids = df.agg(F.count("*").alias("n"), F.countDistinct(doc_id).alias("distinct")).first()
    # rows of one id are told apart by their text, where there are any
    unique = ids.n == ids["distinct"]
    key = F.lit(0).cast("long") if unique else F.xxhash64(t)
    docs = df.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(doc_id).cast("long"), F.lit(_FIRST_ID)).alias("doc"), key.alias("key"), t.alias("text"))
    spans = stage(repeated_spans(docs, unique).groupBy("doc", "key").agg(F.collect_set(F.struct("first", "end")).alias("spans")), "spans")
    touched = maybe_among(spans.select("doc", "key"), "doc", "key")
    docs = docs.withColumn("touched", touched)
    found = docs.where("touched").join(spans, ["doc", "key"], "left")
    none = F.array().cast(spans.schema["spans"].dataType)
    cut = _cut("text", F.coalesce("spans", none))
    changed = found.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), cut.alias("cut")).select("doc_id", "n_bytes", "cut.*")
    zero = F.lit(0).cast("long")
    same = docs.where("not touched").select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), zero.alias("n_removed"), zero.alias("n_spans"), F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))
    return changed.union(same)


@F.pandas_udf(T.StructType([T.StructField("n_removed", T.LongType()), T.StructField("n_spans", T.LongType()), T.StructField("kept_sha256", T.StringType())]))
def _cut(texts: pd.Series, spans: pd.Series) -> pd.DataFrame:
    out = []
    for text, own in zip(texts, spans, strict=True):
        whole = text.encode("utf-8", "surrogatepass")
        first, end = _merged(*(np.array([s[x] for s in own], np.int64) for x in ("first", "end")))
        kept = hashlib.sha256()
        at = 0
        for a, b in zip(first.tolist(), end.tolist(), strict=True):
            kept.update(whole[at:a])
            at = b
        kept.update(whole[at:])
        out.append((int((end - first).sum()), len(first), kept.hexdigest()))
    return pd.DataFrame(out, columns=["n_removed", "n_spans", "kept_sha256"])
