"""Byte-level BPE by a file of ranks: distinct words are folded by higher-order functions over a literal table.

Texts are cut into words by a pattern; a word that is a token itself is done, any other starts as its bytes and is merged
step by step, the pair of the lowest rank first and of those the leftmost. A task numbers its distinct words as they come and
keeps the texts as numbers; for about BATCH_CHARS of text a row holds the words that are new, and the fold runs over them
in the JVM, without a shuffle. So a word is folded once a task, but that a task forgets the words after its first HELD once it has KEPT. A token is one
character of a string there (FIRST plus its id), so that a pair is a substring of two and a merge an overlay. The literal
table has, dealt to buckets by XXH64, the token of every pair that makes one. Decoding concatenates the bytes of the ids.

The fold takes time with the square of a word's length: words of over LONG bytes are merged by a heap instead, to the same
ids. Null and empty texts have no ids. Repeated rows and rows without an id take part; an empty table gives an empty result. Columns
other than the two named are not read, so their names don't matter.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import json
import re
from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The character of token 0; higher ids follow.
FIRST = 0x10000
#: Buckets of the literal table, a power of two.
BUCKETS = 1 << 16
LONG = 256
BATCH_CHARS = 1 << 20
#: Words that a task remembers.
KEPT = 400_000
#: Of these, the first ones that it never forgets: words that occur often come early.
HELD = 200_000
#: Parts of the input that a task takes where there are enough for all: the more it reads, the fewer words are folded twice.
PARTS_A_TASK = 3
_DONE = " "


def ranks_of(path: str) -> dict[bytes, int]:
    """Token -> rank of a file with a token in base64 and its rank on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


def _ranges(kind: str) -> str:
    """The characters up to U+FFFF of a class of the regex package, as ranges within brackets."""
    is_one, out, start = regex.compile(kind).match, [], None
    for c in range(0x10001):
        one = c < 0x10000 and not 0xD800 <= c < 0xE000 and is_one(chr(c)) is not None
        if one and start is None:
            start = c
        elif not one and start is not None:
            out.append(f"\\u{start:04x}-\\u{c - 1:04x}")
            start = None
    return "".join(out)


def plain_pattern(pattern: str) -> str | None:
    """A pattern of the re module, twice as fast, with the same matches in texts up to U+FFFF; None where parts of it may mean something else there."""
    parts = re.findall(r"\\p\{[LN]\}|\\.|\[\^?|\(\?[!=:](?=.)|\(\?|[^\\\[(]", pattern, re.DOTALL)
    if "".join(parts) != pattern:
        return None
    out, inside = [], False
    for part in parts:
        if part in (r"\p{L}", r"\p{N}", r"\s"):
            part = _ranges(part) if inside else f"[{_ranges(part)}]"
        elif part == r"\S" and not inside:
            part = f"[^{_ranges(chr(92) + 's')}]"
        elif part[0] == "\\" or part == "(?" or inside and part[0] == "[":
            return None
        elif part[0] == "[":
            inside = True
        elif part == "]":
            inside = False
        out.append(part)
    return "".join(out)


def _finder(pattern: str, plain: str | None) -> Callable[[str], list[str]]:
    """findall of the pattern; plain is its plain_pattern()."""
    full = regex.compile(pattern).findall
    if plain is None:
        return full
    most = re.compile(plain).findall
    return lambda text: most(text) if text.isascii() or len(text.encode("utf-16-le", "surrogatepass")) == 2 * len(text) else full(text)


def merged(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one word, by a heap of its pairs."""
    if piece in ranks:
        return [ranks[piece]]
    n = len(piece)
    ends, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap: list[tuple[int, int, int]] = []

    def offer(start: int) -> None:
        """The pair that begins at start, if it makes a token."""
        if start >= 0 and ends[start] < n:
            stop = ends[ends[start]]
            rank = ranks.get(piece[start:stop])
            if rank is not None:
                heapq.heappush(heap, (rank, start, stop))

    for start in range(n - 1):
        offer(start)
    gone = bytearray(n)
    while heap:
        _, start, stop = heapq.heappop(heap)
        # stale unless both parts are still as they were
        if gone[start] or ends[start] >= n or ends[ends[start]] != stop or ends[start] == stop:
            continue
        gone[ends[start]] = 1
        ends[start] = stop
        if stop < n:
            before[stop] = start
        offer(start)
        offer(before[start])
    out, start = [], 0
    while start < n:
        out.append(ranks[piece[start : ends[start]]])
        start = ends[start]
    return out


def _let(value: Column, body) -> Column:
    """body(value), with value evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


class _Table:
    """The literal table and what is looked up in it."""

    def __init__(self, ranks: dict[bytes, int]):
        one = lambda rank: chr(FIRST + rank)
        buckets: list[dict[str, str]] = [{} for _ in range(BUCKETS)]

        def put(key: str, value: str) -> None:
            buckets[xxhash.xxh64_intdigest(key.encode(), 42) % BUCKETS][key] = value

        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    put(one(left) + one(right), one(rank))
        self.literal = F.from_json(F.lit(json.dumps(buckets, separators=(",", ":"), ensure_ascii=False)), "array<map<string,string>>")
        self.bytes_ = "".join(chr(b) for b in range(256))
        self.singles = "".join(one(ranks[bytes([b])]) for b in range(256))

    @staticmethod
    def found(table: Column, key: Column) -> Column:
        return F.try_element_at(F.get(table, F.xxhash64(key).bitwiseAND(BUCKETS - 1)), key)

    def folded(self, table: Column, word: Column) -> Column:
        """The tokens of a word, a character each."""

        def step(state: Column, _: Column) -> Column:
            pairs = F.transform(F.sequence(F.lit(1), F.char_length(state) - 1), lambda i: self.found(table, F.substr(state, i, F.lit(2))))

            def merge(tokens: Column) -> Column:
                # tokens are ordered by rank as characters are by code point
                least = F.array_min(tokens)
                at = F.array_position(tokens, least).cast("int")
                return F.coalesce(F.overlay(state, least, at, F.lit(2)), F.concat(F.lit(_DONE), state))

            return F.when(F.startswith(state, F.lit(_DONE)) | (F.char_length(state) < 2), state).otherwise(_let(pairs, merge))

        singles = F.translate(F.decode(F.encode(word, "UTF-8"), "ISO-8859-1"), self.bytes_, self.singles)
        return F.ltrim(F.aggregate(F.sequence(F.lit(2), F.octet_length(word)), singles, step))


def _numbered(batches: Iterator[pa.RecordBatch], pattern: str, ranks: dict[bytes, int], plain: str | None = None) -> Iterator[pa.RecordBatch]:
    """A row for about BATCH_CHARS of text: its ids, each text's words as numbers, and the words that are new, from the number `first` on.

    fold has the new words that are to be folded; where a task has forgotten words, numbers go on after those that it holds.
    """
    find = _finder(pattern, plain)
    number: defaultdict[str, int] = defaultdict()
    number.default_factory = number.__len__
    ids: list = []
    numbers: list[np.ndarray] = []
    size, told, kind = 0, 0, None
    text = pa.list_(pa.string())

    def row() -> pa.RecordBatch:
        words = list(islice(number, told, None))
        coded = (w.encode("utf-8", "surrogatepass") for w in words)
        fold = [w if 1 < len(b) <= LONG and b not in ranks else None for w, b in zip(words, coded, strict=True)]
        sizes = np.array([len(x) for x in numbers], np.int64)
        return pa.RecordBatch.from_arrays([pa.array([ids], pa.list_(kind)), pa.array([told], pa.int64()), pa.array([sizes.tobytes()]), pa.array([np.concatenate(numbers).tobytes()]), pa.array([[None if f else w for w, f in zip(words, fold, strict=True)]], text), pa.array([fold], text)], ["ids", "first", "sizes", "numbers", "words", "fold"])

    for batch in batches:
        kind = batch.schema.field("id").type
        for doc_id, body in zip(batch.column("id").to_pylist(), batch.column("text"), strict=True):
            body = body.as_py()
            found = find(body)
            ids.append(doc_id)
            numbers.append(np.fromiter(map(number.__getitem__, found), np.int32, len(found)))
            size += len(body)
            if size > BATCH_CHARS:
                yield row()
                if len(number) > KEPT:
                    held = list(islice(number, HELD))
                    number.clear()
                    number.update(zip(held, range(len(held)), strict=True))
                ids, numbers, size, told = [], [], 0, len(number)
    if ids:
        yield row()


def _coded(df: DataFrame, path: str, pattern: str, text: str, doc_id: str) -> tuple[DataFrame, T.DataType, dict[bytes, int]]:
    """The rows of _numbered with the folded words' tokens; the type of the ids; the ranks."""
    ranks = ranks_of(path)
    table = _Table(ranks)
    docs = df.select(F.col(doc_id).alias("id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    parts = docs.rdd.getNumPartitions()
    docs = docs.coalesce(max(parts // PARTS_A_TASK, min(parts, 2 * df.sparkSession.sparkContext.defaultParallelism), 1))
    kind = docs.schema["id"].dataType
    words = T.ArrayType(T.StringType())
    schema = T.StructType().add("ids", T.ArrayType(kind)).add("first", T.LongType()).add("sizes", T.BinaryType()).add("numbers", T.BinaryType()).add("words", words).add("fold", words)
    plain = plain_pattern(pattern)
    rows = docs.mapInArrow(lambda batches: _numbered(batches, pattern, ranks, plain), schema)
    tokens = _let(table.literal, lambda t: F.transform("fold", lambda w: F.when(w.isNotNull(), table.folded(t, w))))
    return rows.withColumn("tokens", tokens).drop("fold"), kind, ranks


def _texts(batches: Iterator[pa.RecordBatch], ranks: dict[bytes, int]) -> Iterator[tuple[pa.Array, int, list[str], list[np.ndarray]]]:
    """For each row of _coded, in the order of the task's rows: the texts' ids, the number of the first new word, the tokens of new words, a character each, and the words of each text."""
    for batch in batches:
        for k in range(batch.num_rows):
            first, words, tokens = (batch.column(name)[k].as_py() for name in ("first", "words", "tokens"))
            found = [code if word is None else "".join([chr(FIRST + k) for k in merged(word.encode("utf-8", "surrogatepass"), ranks)]) for word, code in zip(words, tokens, strict=True)]
            sizes, numbers = (np.frombuffer(batch.column(name)[k].as_py(), kind) for name, kind in (("sizes", np.int64), ("numbers", np.int32)))
            yield batch.column("ids")[k].values, first, found, np.split(numbers, np.cumsum(sizes)[:-1])


def encode(df: DataFrame, path: str, pattern: str, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id and token_ids (array of int) of each row of df; path: the file of ranks, pattern: what a word is."""
    rows, kind, ranks = _coded(df, path, pattern, text, doc_id)

    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: list[np.ndarray] = []
        for ids, first, new, texts in _texts(batches, ranks):
            del known[first:]
            known += [np.frombuffer(x.encode("utf-32-le"), np.int32) - FIRST for x in new]
            none = np.zeros(0, np.int32)
            found = [np.concatenate([none, *map(known.__getitem__, words.tolist())]) for words in texts]
            yield pa.RecordBatch.from_arrays([ids, pa.array(found, pa.list_(pa.int32()))], ["doc_id", "token_ids"])

    return rows.mapInArrow(out, T.StructType().add("doc_id", kind).add("token_ids", T.ArrayType(T.IntegerType())))


def decode(df: DataFrame, path: str, ids: str = "token_ids", name: str = "decoded") -> DataFrame:
    """df with the bytes of its ids (null: null); an id without a token raises."""
    ranks = ranks_of(path)
    pieces = [""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        pieces[rank] = token.decode("latin-1")
    table = F.from_json(F.lit(json.dumps(pieces, ensure_ascii=False)), "array<string>")
    text = _let(table, lambda t: F.array_join(F.transform(ids, lambda i: F.element_at(t, i + 1)), ""))
    return df.withColumn(name, F.encode(text, "ISO-8859-1"))


def digest(df: DataFrame, path: str, pattern: str, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_tokens, and the SHA-256 of the ids, joined by commas, and of the bytes that they decode to."""
    rows, kind, ranks = _coded(df, path, pattern, text, doc_id)

    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = {chr(FIRST + rank): token for token, rank in ranks.items()}
        names = {chr(FIRST + rank): str(rank).encode() for rank in ranks.values()}
        listed: list[bytes] = []
        decoded: list[bytes] = []
        sizes = np.zeros(0, np.int32)
        for ids, first, new, texts in _texts(batches, ranks):
            del listed[first:], decoded[first:]
            listed += [b",".join(map(names.__getitem__, x)) for x in new]
            decoded += [b"".join(map(pieces.__getitem__, x)) for x in new]
            sizes = np.concatenate([sizes[:first], np.array([len(x) for x in new], np.int32)])
            counts, of_ids, of_bytes = [], [], []
            for words in texts:
                own = words.tolist()
                counts.append(int(sizes[words].sum()))
                of_ids.append(hashlib.sha256(b",".join(map(listed.__getitem__, own))).hexdigest())
                of_bytes.append(hashlib.sha256(b"".join(map(decoded.__getitem__, own))).hexdigest())
            yield pa.RecordBatch.from_arrays([ids, pa.array(counts, pa.int64()), pa.array(of_ids), pa.array(of_bytes)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return rows.mapInArrow(out, T.StructType().add("doc_id", kind).add("n_tokens", T.LongType()).add("ids_sha256", T.StringType()).add("decoded_sha256", T.StringType()))
