"""SimHash near-duplicate groups: fingerprints, pigeonhole blocks, verified links, components.

Texts are lower-cased in A-Z, split at ASCII white space and cut into shingles of `shingle` words, repeats included
(fewer words: the whole sequence). A bit of the fingerprint is set if it is set in over half of the
shingles' XXH64. Fingerprints that differ in max_distance bits or fewer are linked. A shingle of three words and two
bits is the default; texts of a Jaccard similarity of 0.8 on five words differ in about ten bits, of 0.95 in four.

Such distances are out of reach for keys of a few blocks. Where near copies down to a similarity are asked for (first_of_each), each
text also has a wide fingerprint of its words, whose bits change less: a text of 200 words in which four are replaced keeps 0.8 of its
five-word shingles and 0.98 of its words. WIDE longs give KEYS masks each of 32 bits; texts that agree on one of these keys are
compared with the first of the key, and linked if the true Jaccard similarity of their five-word shingles reaches the bound.
Texts under five words are linked if they are equal only.

Null and empty texts have fingerprint zero and link like any other. Equal texts share a fingerprint;
links are searched between distinct fingerprints only. Rows with a null doc_id take part; a component's
id is the smallest id that is not null. Other columns pass through; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm.common import components, maybe_among, stage, unstage
from quern.llm.passages import shingles

SHINGLE_WORDS = 3
SEED = 42
MAX_DISTANCE = 2
#: Blocks with more fingerprints are split again instead of being paired.
PAIR_LIMIT = 48
_STEP = 1 << 15
#: Longs of a wide fingerprint, and the halves of one that are keys.
WIDE = 8
KEYS = (0xFFFFFFFF00000000, 0x00000000FFFFFFFF, 0xAAAAAAAAAAAAAAAA, 0x5555555555555555)
PREFIX = "__simhash_"


def fingerprint(text: str | None, shingle: int = SHINGLE_WORDS) -> int:
    """The fingerprint of one text as an unsigned 64-bit number."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = memoryview(b" ".join(words))
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    if len(words) > shingle:
        starts, ends = starts[: len(starts) - shingle + 1], ends[shingle - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    digest, ones = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for k in range(0, len(starts), _STEP):
        part = zip(starts[k : k + _STEP].tolist(), ends[k : k + _STEP].tolist(), strict=True)
        hashes = np.array([digest(joined[a:b], SEED) for a, b in part], np.uint64)
        ones += np.unpackbits(hashes.view(np.uint8), bitorder="little").reshape(-1, 64).sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > len(starts), bitorder="little")
    return int(bits.view(np.uint64)[0])


def wide_fingerprint(text: str | None) -> np.ndarray:
    """WIDE longs of a text's words: a bit is set if it is in more than half of them, words counting by the root of how often they occur."""
    words = Counter((text or "").encode("utf-8", "surrogatepass").lower().split())
    if not words:
        return np.zeros(WIDE, np.uint64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    weights, total = np.sqrt(np.fromiter(words.values(), np.float32, len(words))), np.zeros(WIDE * 64, np.float64)
    for k in range(0, len(h), _STEP):
        part = h[k : k + _STEP, None] * _MULTIPLIERS
        part ^= part >> np.uint64(29)
        part *= np.uint64(0xBF58476D1CE4E5B9)
        part ^= part >> np.uint64(32)
        bits = np.unpackbits(part.view(np.uint8).reshape(len(part), -1), axis=1, bitorder="little")
        total += weights[k : k + _STEP] @ bits
    return np.packbits(2 * total > weights.sum(), bitorder="little").view(np.uint64)


def _both_fingerprints(text: Column, shingle: int) -> Column:
    @F.pandas_udf("narrow long, wide array<long>")
    def fingerprints(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            narrow = np.array([fingerprint(t, shingle) for t in texts], np.uint64).view(np.int64)
            yield pd.DataFrame({"narrow": narrow, "wide": pd.Series([wide_fingerprint(t).view(np.int64) for t in texts], dtype=object)})

    return fingerprints(text)


def fingerprints_of(text: Column, shingle: int = SHINGLE_WORDS) -> Column:
    @F.pandas_udf(T.LongType())
    def fingerprints(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(np.array([fingerprint(t, shingle) for t in texts], np.uint64).view(np.int64))

    return fingerprints(text)


#: Odd numbers that make WIDE hashes of one.
_MULTIPLIERS = np.array([(0x9E3779B97F4A7C15 * (2 * k + 1)) & (1 << 64) - 1 for k in range(WIDE)], np.uint64)


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def links(fingerprints: DataFrame, max_distance: int = MAX_DISTANCE) -> DataFrame:
    """(u, v) for pairs of distinct fingerprints (column fp) that differ in one to max_distance bits.

    Differing bits touch at most max_distance of max_distance + 2 blocks, so close pairs agree on two blocks at
    least: each fingerprint joins its blocks under a key for each two of them that may agree. A block with over
    PAIR_LIMIT fingerprints is not paired: the bits outside its key are split into blocks again, with finer keys, and
    so on. Keys end where the bits left are too few to split, and a block has few fingerprints by then, so nothing
    is left out.
    """
    free = (1 << 64) - 1
    blocks = max_distance + 2
    # a member of a block: its fingerprint and the mask of the bits that are not yet in its key
    members = fingerprints.select("fp", F.lit(_signed(free)).alias("free")).distinct()
    masks = [free]
    found = None
    while masks:
        finer = {}
        for mask in masks:
            bits = [b for b in range(64) if mask >> b & 1]
            parts = [sum(1 << int(b) for b in part) for part in np.array_split(bits, blocks)]
            finer[mask] = [mask & ~(a | b) for a, b in combinations(parts, 2)]
        # the masks are given by the blocks, whatever the table's size
        options = fingerprints.sparkSession.createDataFrame([(_signed(mask), [_signed(x) for x in left]) for mask, left in finer.items()], "free long, left array<long>")
        keyed = members.join(F.broadcast(options), "free").select("fp", F.explode("left").alias("free")).withColumn("key", F.col("fp").bitwiseAND(F.bitwise_not("free")))
        keyed = stage(keyed, "blocks")
        sizes = keyed.groupBy("free", "key").agg(F.count("*").alias("n")).where("n > 1")
        inside = stage(keyed.join(sizes, ["free", "key"]), "inside")
        unstage(keyed)
        last = min(x.bit_count() for left in finer.values() for x in left) < 2 * blocks
        small = inside if last else inside.where(F.col("n") <= PAIR_LIMIT)
        a, b = small.select("free", "key", F.col("fp").alias("u")), small.select("free", "key", F.col("fp").alias("v"))
        close = F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= max_distance
        pairs = stage(a.join(b, ["free", "key"]).where((F.col("u") < F.col("v")) & close).select("u", "v").distinct(), "pairs")
        found = pairs if found is None else found.union(pairs)
        large = inside.where(F.col("n") > PAIR_LIMIT).select("fp", "free")
        if last or large.isEmpty():
            break
        members, masks = large, list(dict.fromkeys(x for left in finer.values() for x in left))
    return found.distinct()


def _labelled(known: DataFrame, head: Column, max_distance: int, more: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(fp, component, head) for every distinct fingerprint of known; head aggregates its rows. more gives further links (u, v) of heads."""
    heads = stage(known.groupBy(F.col("fingerprint").alias("fp")).agg(head.alias("head")), "heads")
    found = links(heads.select("fp"), max_distance)
    labels = components(found.union(more(heads)) if more else found)
    return stage(heads.join(labels, heads.fp == labels.node, "left").select("fp", "head", F.coalesce("component", "fp").alias("component")), "ends")


def candidates(wide: DataFrame) -> DataFrame:
    """(u, v) of texts (column node, with their wide fingerprint) that share a key: each with the least node of the key.

    A key of many texts gives as many pairs as it has texts, and its least node is found by partial sums wherever they are.
    """
    masks = F.array(*(F.lit(_signed(m)) for m in KEYS))
    each = wide.select("node", F.posexplode(F.flatten(F.transform("wide", lambda x: F.transform(masks, lambda m: x.bitwiseAND(m))))).alias("key", "value"))
    shared = stage(each.groupBy("key", "value").agg(F.min("node").alias("least"), F.count("*").alias("n")).where("n > 1").drop("n"), "keys")
    pairs = each.where(maybe_among(shared, "key", "value")).join(shared, ["key", "value"]).where("node <> least")
    return pairs.select(F.col("node").alias("u"), F.col("least").alias("v")).distinct()


def alike(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """The pairs (u, v) whose texts (node, text) have so large a Jaccard similarity of five-word shingles."""
    nodes = stage(pairs.select(F.col("u").alias("node")).union(pairs.select("v")).distinct(), "nodes")

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def marks(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            # 32 bits are enough within one pair
            yield pd.Series([np.unique(shingles(t or "").astype(np.uint32)).view(np.int32) for t in batch], dtype=object)

    wanted = texts.where(maybe_among(nodes, "node")).join(nodes, "node", "left_semi")
    own = stage(wanted.select("node", marks("text").alias("marks")), "marks")
    side = lambda x: own.select(F.col("node").alias(x), F.col("marks").alias(f"{x}_marks"))
    both = F.size(F.array_intersect("u_marks", "v_marks"))
    enough = both >= similarity * (F.size("u_marks") + F.size("v_marks") - both) - 1e-9
    # sizes that differ too much need no look at the shingles
    near = F.least(F.size("u_marks"), F.size("v_marks")) >= similarity * F.greatest(F.size("u_marks"), F.size("v_marks")) - 1e-9
    return pairs.join(side("u"), "u").join(side("v"), "v").where((F.size("u_marks") > 0) & near).where(enough).select("u", "v")


def near_duplicates(df: DataFrame, text: str = "text", doc_id: str = "doc_id", shingle: int = SHINGLE_WORDS, max_distance: int = MAX_DISTANCE, keep_text: bool = True) -> DataFrame:
    """df, with keep_text=False without its texts, with fingerprint (long) and component_id, the smallest doc_id among all texts linked to it."""
    known = df.drop("component_id").withColumn("fingerprint", fingerprints_of(F.col(text).cast("string"), shingle))
    known = stage(known if keep_text else known.drop(text), "fingerprints")
    ends = _labelled(known, F.min(doc_id), max_distance)
    lowest = ends.groupBy("component").agg(F.min("head").alias("component_id"))
    named = ends.join(lowest, "component").select(F.col("fp").alias("fingerprint"), "component_id")
    return known.join(named, "fingerprint")


def first_of_each(df: DataFrame, text: str = "text", doc_id: str = "doc_id", shingle: int = 5, max_distance: int = 4, similarity: float | None = 0.8) -> DataFrame:
    """One row of df for each group of near duplicates: that of the smallest doc_id, nulls last.

    Near duplicates are linked by fingerprints that differ in max_distance bits or fewer, and, where a similarity is given, by keys
    of the wide fingerprints and the verified Jaccard similarity. Of rows that tie, repeated rows included, one
    stays. Rows that go are found by their numbers, so that others need no shuffle.
    """
    row, mark, wide = PREFIX + "row", PREFIX + "fingerprint", PREFIX + "wide"
    body = F.col(text).cast("string")
    marked = df.withColumn(mark, fingerprints_of(body, shingle)) if similarity is None else df.withColumn(PREFIX, _both_fingerprints(body, shingle)).withColumn(mark, F.col(f"{PREFIX}.narrow")).withColumn(wide, F.col(f"{PREFIX}.wide")).drop(PREFIX)
    # the numbers are fixed once the table is written
    known = stage(marked.withColumn(row, F.monotonically_increasing_id()), "fingerprints")
    narrow = known.select(F.col(mark).alias("fingerprint"), F.col(doc_id).alias("id"), F.col(row).alias("row"), *([F.col(wide).alias("wide")] if similarity else []))

    def more(heads: DataFrame) -> DataFrame:
        # one text for each fingerprint, told apart by its row
        ends = heads.select(F.col("head.row").alias("node"), "fp", F.col("head.wide").alias("wide"))
        pairs = stage(candidates(ends.select("node", "wide")), "candidates")
        same = alike(pairs, known.select(F.col(row).alias("node"), body.alias("text")), similarity)
        named = lambda x: ends.select(F.col("node").alias(x), F.col("fp").alias(f"{x}_fp"))
        return same.join(named("u"), "u").join(named("v"), "v").select(F.col("u_fp").alias("u"), F.col("v_fp").alias("v"))

    parts = [F.col("id").isNull(), F.col("id"), F.col("row").alias("row")] + ([F.col("wide").alias("wide")] if similarity else [])
    ends = _labelled(narrow, F.min(F.struct(*parts)), max_distance, more if similarity else None)
    first = ends.groupBy("component").agg(F.min("head").alias("head")).select(F.col("head.row").alias("row"))
    gone = stage(narrow.select("row").join(first, "row", "left_anti").withColumnRenamed("row", row), "gone")
    maybe = maybe_among(gone, row)
    kept = known.where(~maybe).union(known.where(maybe).join(gone, row, "left_anti").select(*known.columns))
    return kept.select(*df.columns)
