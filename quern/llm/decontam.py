"""Benchmark decontamination by templates.

Words are lower-cased and stripped of punctuation; numbers, names (capitalised inside a sentence) and
units (after a number) become typed placeholders. Windows of five such tokens, three of them literal at
least, are hashed and joined with the windows of the benchmark. Along one alignment of an item and a document
equal values of the item must stand for equal values of the document, which also finds questions with other
numbers or names; windows with a value that stands for several don't count.
An item is found in a document if 0.8 or more of its windows are.

Whether an item's first word is a name or unit depends on what a document has before it, so its first window is
sought in each reading. An item of under FEW such windows is also sought word for word: whole, or by windows
of five words where it has more than SHORT.

Null and empty texts have no windows. Repeated rows and rows without an id are told apart by their text. Empty tables on either
side give no findings. Clashing column names do no harm: only the id and the text are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm.common import stage

WINDOW = 5
LITERALS = 3
SHARE = 0.8
#: With fewer windows the loss of one goes below SHARE.
FEW = 5
SHORT = WINDOW + FEW - 2
#: Bits of the filter that every task holds: 1 MB whatever the benchmark's size. It only spares rows.
FILTER_BITS = 1 << 23

# fixed values: measures that may follow a number
UNITS = frozenset(
    "mm cm m km in inch inches ft foot feet yd yard yards mi mile miles mg g kg gram grams kilogram kilograms lb lbs pound pounds oz ounce ounces t ton tons ml l litre litres liter liters "
    "s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years "
    "percent % c f k degree degrees dollar dollars cent cents euro euros usd eur gbp kb mb gb tb hz khz mhz ghz w kw mw v kv a j kj cal kcal pa kpa".split()
)
# fixed values: number words
NUMBER_WORDS = frozenset("zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion".split())

_EDGES = re.compile(r"^\W+|\W+$")
_NUMBER = re.compile(r"[$€£]?[+-]?\d[\d.,:/-]*%?$")
_ENDS = (".", "!", "?", ":", ";", '."', '!"', '?"', ".)", ".'")
_NAME, _NUM, _UNIT = 1, 2, 4
_END = 8
_SLOTS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)
_FACTORS = np.array([pow(0x9E3779B97F4A7C15, k + 1, 1 << 64) | 1 for k in range(WINDOW)], np.uint64)
_PLAIN = np.array([pow(0xD6E8FEB86659FD93, k + 1, 1 << 64) | 1 for k in range(SHORT)], np.uint64)
_WORDS_AT_ONCE = 1 << 15
_CACHE_WORDS = 1 << 18


class _Words(dict):
    """word -> its row in hashes and flags; forgets all when full."""

    def __init__(self):
        super().__init__()
        self.hashes = np.zeros(_CACHE_WORDS, np.uint64)
        self.flags = np.zeros(_CACHE_WORDS, np.uint8)

    def __missing__(self, word):
        if len(self) == len(self.hashes):  # only between blocks is it emptied, so rows in use stay valid
            self.hashes, self.flags = (np.concatenate([x, np.zeros_like(x)]) for x in (self.hashes, self.flags))
        plain = plain_word(word)
        k = self[word] = len(self)
        self.hashes[k] = xxhash.xxh64_intdigest(plain.encode("utf-8", "surrogatepass"))
        number = bool(_NUMBER.match(plain)) or plain in NUMBER_WORDS
        bare = word.lstrip("\"'([{")
        name = not number and len(plain) > 1 and bare[:1].isupper() and not bare.isupper()
        self.flags[k] = name * _NAME | number * _NUM | (plain in UNITS) * _UNIT | word.endswith(_ENDS) * _END
        return k


_words = _Words()


def plain_word(word: str) -> str:
    return _EDGES.sub("", word).lower() or word.lower()


def _tokens(index: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes and whether each is a placeholder; first marks the first word of a text."""
    flags = _words.flags[index]
    before = np.concatenate([[0], flags[:-1]]).astype(np.uint8)
    number = (flags & _NUM) != 0
    unit = ((flags & _UNIT) != 0) & ((before & _NUM) != 0) & ~first & ~number
    name = ((flags & _NAME) != 0) & ((before & _END) == 0) & ~first & ~unit
    out = _words.hashes[index]
    out[number], out[unit], out[name] = _SLOTS[_NUM - 2], _SLOTS[1], _SLOTS[2]
    return out, number | unit | name


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _sums(values: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """A hash of every len(factors) values in a row."""
    n = len(values) - len(factors) + 1
    out = np.full(max(n, 0), len(factors), np.uint64)
    for k, factor in enumerate(factors):
        out += values[k : k + len(out)] * factor
    return _mixed(out)


def template_windows(texts: list[str], wanted: np.ndarray | None = None, lengths: tuple[int, ...] = ()) -> Iterator[tuple[int, int, int, int, list[str]]]:
    """(row, kind, position, hash, values of placeholders) of every window of a document; with wanted, of those in the filter.

    kind: 0 for templates, and each of lengths for so many words as they are.
    """
    split, index, begins = _indexed(texts)
    first = np.zeros(len(index) + 1, bool)
    first[begins[:-1]] = True
    tokens, slot = _tokens(index, first[:-1])
    row = np.repeat(np.arange(len(split)), np.diff(begins))
    filled = np.concatenate([[0], np.cumsum(slot)])
    for kind in (0, *lengths):
        size = kind or WINDOW
        value = _sums(_words.hashes[index], _PLAIN[:size]) if kind else _sums(tokens, _FACTORS)
        n = len(value)
        keep = row[:n] == row[size - 1 :][:n]
        if not kind:
            keep &= filled[size:][:n] - filled[:n] <= WINDOW - LITERALS
        if wanted is not None:
            bit = value & np.uint64(FILTER_BITS - 1)
            keep &= (wanted[(bit >> np.uint64(3)).astype(np.int64)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1 == 1
        signed = value.view(np.int64)
        for p in np.flatnonzero(keep).tolist():
            r, at = int(row[p]), p - int(begins[row[p]])
            yield r, kind, at, int(signed[p]), [] if kind else [plain_word(split[r][at + k]) for k in range(WINDOW) if slot[p + k]]


def _indexed(texts: list[str]) -> tuple[list[list[str]], np.ndarray, np.ndarray]:
    """The words of texts, their rows in _words, one text after another, and where each text begins."""
    split = [(t or "").split() for t in texts]
    if len(_words) > _CACHE_WORDS // 2:
        _words.clear()
    look = _words.__getitem__
    index = np.array([look(w) for ws in split for w in ws], np.int64)
    return split, index, np.cumsum([0, *map(len, split)])


def item_windows(texts: list[str]) -> Iterator[tuple[int, int, int, int, list[str]]]:
    """The windows by which items are sought, as template_windows() has them."""
    for r, text in enumerate(texts):
        own = [x[1:] for x in template_windows([text])]
        words, index, _ = _indexed([text])
        words, n = words[0], len(index)
        if n >= WINDOW:
            flags = int(_words.flags[index[0]])
            tokens, slot = _tokens(index, np.arange(n) == 0)
            for reading in (_NAME, _UNIT):
                if flags & reading and not slot[0] and slot[1:WINDOW].sum() < WINDOW - LITERALS:
                    other = tokens[:WINDOW].copy()
                    other[0] = _SLOTS[2 if reading == _NAME else 1]
                    own.append((0, 0, int(_sums(other, _FACTORS).view(np.int64)[0]), [plain_word(w) for k, w in enumerate(words[:WINDOW]) if slot[k] or not k]))
        if n and len({x[1] for x in own}) < FEW:
            size = n if n <= SHORT else WINDOW
            own += [(size, at, int(v), []) for at, v in enumerate(_sums(_words.hashes[index], _PLAIN[:size]).view(np.int64))]
        yield from ((r, *x) for x in own)


def _windows(df: DataFrame, text: str, keys: list[str], find) -> DataFrame:
    """Rows (keys, kind, pos, window, slots) of what find has of a list of texts."""
    schema = T.StructType([*(df.schema[k] for k in keys), *(T.StructField(x, T.LongType()) for x in ("kind", "pos", "window")), T.StructField("slots", T.ArrayType(T.StringType()))])

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [t if isinstance(t, str) else "" for t in batch[text]]
            start, size = 0, 0
            for k, t in enumerate(texts):
                size += len(t) // 4
                if size > _WORDS_AT_ONCE or k + 1 == len(texts):
                    found = list(find(texts[start : k + 1]))
                    if found:
                        r, kind, pos, window, slots = zip(*found, strict=True)
                        out = batch[keys].iloc[[start + x for x in r]].reset_index(drop=True)
                        yield out.assign(kind=kind, pos=pos, window=window, slots=pd.Series(slots, dtype=object))
                    start, size = k + 1, 0

    return df.select(*keys, text).mapInPandas(rows, schema)


def _filter(windows: DataFrame):
    """A broadcast bit map of the benchmark's windows; at most FILTER_BITS bits reach the driver."""
    bit = F.col("window").bitwiseAND(FILTER_BITS - 1)
    words = windows.groupBy((bit / 64).cast("long").alias("at")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (bit % 64).cast("int"))).alias("bits"))
    out = np.zeros(FILTER_BITS // 64, np.int64)
    for at, bits in words.collect():
        out[at] = bits
    return windows.sparkSession.sparkContext.broadcast(out.tobytes())


def _agreeing(windows: list) -> tuple[list[int], bool]:
    """Positions of the windows (pos, i, d) without a value i of the item that stands for several values d, and whether a value differs."""
    stands: dict[str, set] = {}
    for _, i, d in windows:
        for x, y in zip(i, d, strict=True):
            stands.setdefault(x, set()).add(y)
    kept = [(pos, i, d) for pos, i, d in windows if all(len(stands[x]) == 1 for x in i)]
    return [pos for pos, _, _ in kept], any(x != y for _, i, d in kept for x, y in zip(i, d, strict=True))


@F.pandas_udf(T.StructType([T.StructField("found", T.ArrayType(T.LongType())), T.StructField("changed", T.BooleanType())]))
def _agreeing_udf(lines: pd.Series) -> pd.DataFrame:
    out = [_agreeing([(w["pos"], list(w["i"]), list(w["d"])) for w in line]) for line in lines]
    return pd.DataFrame({"found": pd.Series([x[0] for x in out], dtype=object), "changed": pd.Series([x[1] for x in out], dtype=bool)})


def findings(docs: DataFrame, benchmark: DataFrame, text: str = "text", doc_id: str = "doc_id", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, text_key, item_id, share, reparameterised) for every item found in a document.

    share: of the item's windows; text_key: a hash that tells texts without an id apart;
    reparameterised: a placeholder holds another value than in the item.
    """
    items = benchmark.select(F.col(item_id).alias("item_id"), F.col(item_text).cast("string").alias("text"))
    wanted = _windows(items, "text", ["item_id"], item_windows).distinct().persist()
    total = wanted.groupBy("item_id", "kind").agg(F.countDistinct("pos").alias("total"))
    texts = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(F.col(text).cast("string")).alias("text_key"), F.col(text).cast("string").alias("text"))
    held = _filter(wanted)
    lengths = tuple(sorted(r.kind for r in wanted.where("kind > 0").select("kind").distinct().collect()))
    have = _windows(texts, "text", ["doc_id", "text_key"], lambda part: template_windows(part, np.frombuffer(held.value, np.uint8), lengths))
    right = wanted.select("window", "kind", "item_id", F.col("pos").alias("item_pos"), F.col("slots").alias("item_slots"))
    both = have.join(right, ["window", "kind"]).withColumn("shift", F.col("pos") - F.col("item_pos"))
    window = F.struct(F.col("item_pos").alias("pos"), F.col("item_slots").alias("i"), F.col("slots").alias("d"))
    lines = both.groupBy("doc_id", "text_key", "item_id", "kind", "shift").agg(F.collect_set(window).alias("windows"))
    lines = lines.select("doc_id", "text_key", "item_id", "kind", _agreeing_udf("windows").alias("w")).select("*", "w.found", "w.changed")
    each = lines.groupBy("doc_id", "text_key", "item_id", "kind").agg(F.size(F.array_distinct(F.flatten(F.collect_list("found")))).alias("n"), F.max("changed").alias("reparameterised"))
    out = each.join(total, ["item_id", "kind"]).withColumn("share", F.col("n") / F.col("total")).where(F.col("share") >= SHARE)
    # what is there word for word isn't reparameterised
    return out.groupBy("doc_id", "text_key", "item_id").agg(F.max("share").alias("share"), F.min("reparameterised").alias("reparameterised"))


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """docs without the documents in which an item is found.

    The finds are a table of known size: Spark sends them to the documents where they are small, and shuffles otherwise.
    """
    found = stage(findings(docs, benchmark, text, doc_id).select(F.col("doc_id").alias("__decontam_id"), F.col("text_key").alias("__decontam_key")).distinct(), "found")
    same = docs[doc_id].eqNullSafe(found["__decontam_id"]) & (F.xxhash64(docs[text].cast("string")) == found["__decontam_key"])
    return docs.join(found, same, "left_anti")
