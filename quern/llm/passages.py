"""Near-duplicate passages of MIN_WORDS words or more, by compact windows.

Texts are lower-cased, split at white space and read as overlapping shingles of five words. For each of
FUNCTIONS hash functions the Cartesian tree over a text's shingle hashes groups all its passages of MIN_WORDS
words or more into compact windows (first, least, last): every passage within that holds the least shingle has its
hash as signature. Trees are only followed where a node spans a whole passage. A window also has a second
signature, the least hash of the next function around its least shingle. Windows of equal signature meet in a sort by
the second one, in which copies of a window stand for one: each is paired with the first of its signature, the first of both
signatures and the NEIGHBOURS before it. Pairs that have ENOUGH signatures in common, first or second, have
their windows joined to intervals, which are verified on the shingles themselves: passages of MIN_WORDS words of which
the other text has so many shingles that the Jaccard similarity reaches SIMILARITY.

Up to NEIGHBOURS + 2 texts of a signature all pairs are met. In larger groups those that share a second signature stand
together, and the pairs met at first stay linear in the rows. Signatures that hold a large share of
a sample of texts are dealt to several tasks by text, each of which meets a text of the sample. Once the links of these pairs have made
classes, all pairs of a larger group's windows that are of different classes are met as well, in blocks of BLOCK by BLOCK rows, so that no group's size
bounds what is linked. Two passages that hold differ in MISSED shingles at most, and one of SPAN shingles has HALF of them on one side of
its least. Fewer may be missed where shingles repeat: a fifth of the distinct ones. So of the shingles that passages beginning near one another
share, one of the few rarest in the block is near the other's least, and rows meet by these, not each with each. Pairs are only verified if all but so many of such a HALF, and then
all but MISSED of SPAN in a row, are near the other's least, each way. So classes are those of all pairs; passages are those of the pairs that were met, and texts of one class need not all have met.

Equal texts are one class and are expanded at the end. Null, empty and short texts have no passage. Repeated
rows, and rows without an id, take part; an empty table gives an empty result. Other columns do no harm.
Texts are told apart by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import bit_map, components, in_bit_map, maybe_among, stage, text_or_empty, unstage, words_of

SHINGLE = 5
MIN_WORDS = 50
SPAN = MIN_WORDS - SHINGLE + 1
FUNCTIONS = 6
ENOUGH = 2
#: Rows before its own that a text meets in its group, besides the firsts.
NEIGHBOURS = 3
#: One text in SAMPLE shows which signatures are common; those of more than one in SHARE of its windows, and of HOT windows, are dealt to tasks of about DEALT windows.
SAMPLE = 64
SHARE = 2000
HOT = 20
DEALT = 4096
SIMILARITY = 0.8
#: Of SPAN shingles in a row around one of them, so many follow it or so many go before it.
HALF = SPAN // 2
#: Distinct shingles that the one of two passages may have besides the other's, which is a fifth of their union at most.
MISSED = int((1 - SIMILARITY) * SPAN + 1e-9)
#: Rows of a side of a block, the words of 64 bits of a row's shingles, and rows tested at once.
BLOCK = 4096
BITS_WORDS = 8
#: Passages that start within so many places are looked up by the same codes.
CORE = 8
_STRIP = 64
_PAIRS_AT_ONCE = 1 << 16
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
#: Bytes of texts whose words are hashed at once, and windows' rows that are met at once.
BYTES_AT_ONCE = 1 << 20
ROWS_AT_ONCE = 1 << 16
_XXH = np.array([0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5], np.uint64)
_IS_SPACE = np.isin(np.arange(256), list(b" \t\n\r\x0b\x0c"))
_LOWER = np.frombuffer(bytes(range(256)).lower(), np.uint8)
_STARTS_AT_ONCE = 4096
#: Shingles of pairs that are verified at once.
_TOKENS_AT_ONCE = 1 << 17


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(31))


def _rotated(x: np.ndarray, by: int) -> np.ndarray:
    return x << np.uint64(by) | x >> np.uint64(64 - by)


def _word_hashes(data: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 of the lower-cased words of texts that lie one after another in data, and each text's number of words; begins: where texts begin and the last one ends."""
    n = len(data)
    padded = np.zeros(n + 8, np.uint8)
    padded[:n] = _LOWER[data]
    inside = ~_IS_SPACE[data]
    # a word begins after a space or where a text begins
    edge = np.zeros(n + 1, bool)
    edge[begins] = True
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:n]
    last[:-1] &= ~inside[1:] | edge[1:n]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    lengths = ends - starts
    eights = np.ndarray(n + 1, np.dtype("<u8"), padded, 0, (1,))
    fours = np.ndarray(n + 1, np.dtype("<u4"), padded, 0, (1,))
    out = np.empty(len(starts), np.uint64)
    order = np.argsort(np.minimum(lengths, 32).astype(np.uint8), kind="stable")
    cuts = np.searchsorted(lengths[order], np.arange(1, 34))
    for length in range(1, 32):
        words = order[cuts[length - 1] : cuts[length]]
        if not len(words):
            continue
        at = starts[words]
        h = np.full(len(words), _XXH[4] + np.uint64(length), np.uint64)
        done = 0
        while length - done >= 8:
            h = _rotated(h ^ _rotated(eights[at + done] * _XXH[1], 31) * _XXH[0], 27) * _XXH[0] + _XXH[3]
            done += 8
        if length - done >= 4:
            h = _rotated(h ^ fours[at + done].astype(np.uint64) * _XXH[0], 23) * _XXH[1] + _XXH[2]
            done += 4
        for k in range(done, length):
            h = _rotated(h ^ padded[at + k].astype(np.uint64) * _XXH[4], 11) * _XXH[0]
        h = (h ^ h >> np.uint64(33)) * _XXH[1]
        h = (h ^ h >> np.uint64(29)) * _XXH[2]
        out[words] = h ^ h >> np.uint64(32)
    long = order[cuts[31] :]
    held = padded.tobytes() if len(long) else b""
    for word, begin, end in zip(long.tolist(), starts[long].tolist(), ends[long].tolist(), strict=True):
        out[word] = xxhash.xxh64_intdigest(held[begin:end])
    return out, np.diff(np.searchsorted(starts, begins))


def _shingles_of(data: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the overlapping shingles of texts that lie one after another, and each text's number of shingles."""
    h, counts = _word_hashes(data, begins)
    sizes = np.maximum(counts - SHINGLE + 1, 0)
    n = len(h) - SHINGLE + 1
    if n < 1:
        return np.zeros(0, np.uint64), sizes
    out = np.zeros(n, np.uint64)
    for k in range(SHINGLE):
        out = out * _FACTOR + h[k : k + n]
    # those that reach into the next text are none
    own = np.zeros(len(h) + 1, np.int64)
    ends = np.cumsum(counts)
    np.add.at(own, ends - counts, sizes > 0)
    np.add.at(own, ends - counts + sizes, -(sizes > 0).astype(np.int64))
    return _mixed(out[np.cumsum(own)[:n] > 0]), sizes


def shingles(text: str) -> np.ndarray:
    """Hashes of a text's overlapping shingles."""
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    return _shingles_of(data, np.array([0, len(data)]))[0]


def shingles_of(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(from, to, shingles, sizes): those of a string column's texts in order, about BYTES_AT_ONCE at once; sizes: of each text's shingles."""
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    begin = 0
    while begin < len(texts):
        end = max(begin + 1, int(np.searchsorted(offsets, offsets[begin] + BYTES_AT_ONCE, side="right")) - 1)
        yield begin, end, *_shingles_of(data[offsets[begin] : offsets[end]], offsets[begin : end + 1] - offsets[begin])
        begin = end


def _least(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least of each SPAN values in a row and its place."""
    low, at, width = values, np.arange(len(values)), 1
    while width < SPAN:
        step = min(width, SPAN - width)
        left = low[:-step] <= low[step:]
        low, at = np.where(left, low[:-step], low[step:]), np.where(left, at[:-step], at[step:])
        width += step
    return low, at


def compact_windows(values: np.ndarray, begins: np.ndarray | None = None, at: np.ndarray | None = None) -> np.ndarray:
    """Rows (first, least, last): the Cartesian trees' nodes that span SPAN values or more; begins: where sequences start.

    Such a node is the least of some SPAN values in a row, which finds them all at once. Ancestors of a
    node span more than it does, so their stack alone gives the bounds of every node. Equal values: the leftmost is less.
    """
    n = len(values)
    begins = np.zeros(1, np.int64) if begins is None else begins
    if n < SPAN:
        return np.zeros((0, 3), np.int64)
    at = _least(values)[1] if at is None else at
    ends = np.append(begins[1:], n)
    inside = np.ones(len(at), bool)
    for end in ends[:-1].tolist():
        inside[max(0, end - SPAN + 1) : end] = False
    least = np.zeros(n, bool)
    least[at[inside]] = True
    nodes = np.flatnonzero(least)
    sequence = np.searchsorted(begins, nodes, side="right") - 1
    keys = values[nodes]
    where = np.concatenate([nodes, [-1, n]])
    first = np.maximum(where[_nearest(keys, sequence, -1)] + 1, begins[sequence])
    last = np.minimum(where[_nearest(keys, sequence, 1)] - 1, ends[sequence] - 1)
    return np.array([first, nodes, last], np.int64).T


def _nearest(keys: np.ndarray, sequence: np.ndarray, step: int) -> np.ndarray:
    """For each key the place of the nearest one before it (step -1) that is not greater, or after it (1) that is less, in its sequence.

    Where there is none: len(keys) before and len(keys) + 1 after. Each looks where the last one it looked at found its own.
    """
    n = len(keys)
    none = n if step < 0 else n + 1
    out = np.arange(step, n + step)
    out[np.flatnonzero(np.diff(sequence)) + (step < 0)] = none
    if n:
        out[0 if step < 0 else -1] = none
    todo, held = np.arange(n), keys
    while len(todo):
        at = out[todo]
        inside = at < n
        todo, at, held = todo[inside], at[inside], held[inside]
        further = keys[at] > held if step < 0 else keys[at] >= held
        todo, at, held = todo[further], at[further], held[further]
        out[todo] = out[at]
    return out


def _surroundings(s: np.ndarray, first: np.ndarray, least: np.ndarray, last: np.ndarray) -> np.ndarray:
    """16 bits each of the shingles that may lie in one passage with each window's least, in their order around it; zero where there is none."""
    at = least[:, None] + np.arange(1 - SPAN, SPAN)
    used = (at >= first[:, None]) & (at <= last[:, None])
    return np.where(used, s[np.where(used, at, 0)] % np.uint64(0xFFFF) + np.uint64(1), np.uint64(0)).astype(np.uint16)


def _bits(codes: np.ndarray) -> np.ndarray:
    """Of rows of codes the HALF before the middle, the HALF after it and all as bits, one after another.

    Where a window has fewer on one side, no passage has HALF of them there, and all bits are set.
    """
    out = np.zeros((len(codes), 3 * BITS_WORDS), np.uint64)
    row = np.arange(len(codes))
    middle = SPAN - 1
    parts = (range(middle - HALF, middle), range(middle + 1, middle + 1 + HALF), range(2 * SPAN - 1))
    for part, places in enumerate(parts):
        for at in places:
            code = codes[:, at]
            word = part * BITS_WORDS + (code >> 6) % BITS_WORDS
            out[row, word] |= np.where(code > 0, np.uint64(1) << (code & 63).astype(np.uint64), np.uint64(0))
    for part, farthest in enumerate((middle - HALF, middle + HALF)):
        out[codes[:, farthest] == 0, part * BITS_WORDS : (part + 1) * BITS_WORDS] = ~np.uint64(0)
    return out


def _most_shared(codes: np.ndarray, one: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Of SPAN codes in a row of each row of one, those that the row of other beside it has: the most."""
    out = np.zeros(len(one), np.int16)
    if not len(one):
        return out
    rows, row = np.unique(other, return_inverse=True)
    order = np.argsort(row, kind="stable")
    cuts = np.searchsorted(row[order], np.arange(0, len(rows) + _STRIP, _STRIP))
    has = np.zeros((min(_STRIP, len(rows)), 1 << 16), bool)
    for k, (begin, end) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)):
        held = codes[rows[k * _STRIP : (k + 1) * _STRIP]]
        line = np.arange(len(held))[:, None]
        has[line, held] = held > 0
        for at in range(begin, end, _STRIP * _STRIP):
            pairs = order[at : min(end, at + _STRIP * _STRIP)]
            total = np.zeros((len(pairs), codes.shape[1] + 1), np.int16)
            np.cumsum(has[row[pairs][:, None] - k * _STRIP, codes[one[pairs]]], axis=1, out=total[:, 1:])
            out[pairs] = (total[:, SPAN:] - total[:, :-SPAN]).max(1)
        has[line, held] = False
    return out


def _distinct_codes(codes: np.ndarray) -> np.ndarray:
    """The number of distinct codes of each SPAN in a row, in every row; zero where a code is missing."""
    n, width = codes.shape
    starts = width - SPAN + 1
    ordered = np.sort(codes.astype(np.uint32) << 7 | np.arange(width, dtype=np.uint32), axis=1)
    row, at = np.nonzero((ordered[:, 1:] ^ ordered[:, :-1]) < 128)
    one, two = (ordered[row, at] & 127).astype(np.int64), (ordered[row, at + 1] & 127).astype(np.int64)
    close = two - one < SPAN
    row, one, two = row[close], one[close], two[close]
    # a code and its next occurrence count once from the start that has the later one to the one that has the earlier
    size = n * (starts + 1)
    change = np.bincount(row * (starts + 1) + np.maximum(two - SPAN + 1, 0), minlength=size) - np.bincount(row * (starts + 1) + np.minimum(one + 1, starts), minlength=size)
    again = np.cumsum(change.reshape(n, starts + 1), axis=1)[:, :starts]
    return np.where((codes[:, :starts] > 0) & (codes[:, SPAN - 1 :] > 0), SPAN - again, 0)


def _may_lack(distinct: np.ndarray) -> np.ndarray:
    """Distinct codes that a passage of so many may have besides those of another that resembles it."""
    # codes are of 16 bits: two of a passage's shingles may look like others of it
    return (np.minimum(distinct + 2, SPAN) * (1 - SIMILARITY) + 1e-9).astype(np.int64)


def _rare_codes(codes: np.ndarray, rank: np.ndarray, distinct: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, rank) of the codes one of which is met by every row that has a passage in common with the row.

    Passages that start within CORE places all hold the same SPAN - CORE + 1 places. If they may lack k codes,
    one of the k + 1 rarest of these is met. The least's own code is met by all.
    """
    starts = distinct.shape[1]
    marks = [np.zeros(0, np.int64)]
    for begin in range(0, starts, CORE):
        end = min(begin + CORE, starts)
        most = distinct[:, begin:end].max(1)
        rows = np.flatnonzero(most)
        core = np.sort(rank[codes[rows, end - 1 : begin + SPAN]], axis=1)
        new = np.ones(core.shape, bool)
        new[:, 1:] = core[:, 1:] != core[:, :-1]
        line, at = np.nonzero(new & (np.cumsum(new, axis=1) <= _may_lack(most[rows])[:, None] + 1))
        marks.append(rows[line] << 16 | core[line, at])
    marks = np.unique(np.concatenate(marks))
    return marks >> 16, marks & 0xFFFF


def _without_repeats(columns: list[np.ndarray], codes: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Of the windows of a text that repeats itself, those of equal signature and surroundings as one, from the first's begin to the last's end."""
    signature, second, function, node, first, last = columns
    mixed = codes.astype(np.int64) @ np.arange(1, 2 * codes.shape[1], 2, dtype=np.int64) ** 5
    order = np.lexsort((mixed, node, signature))
    signature, second, function, node, first, last = (x[order] for x in columns)
    codes = codes[order]
    new = np.ones(len(order), bool)
    new[1:] = (signature[1:] != signature[:-1]) | (node[1:] != node[:-1])
    alike = np.flatnonzero(~new)
    new[alike] = (codes[alike] != codes[alike - 1]).any(1)
    begins = np.flatnonzero(new)
    if not len(begins):
        return columns, codes
    least, most = (lambda x: np.minimum.reduceat(x, begins)), (lambda x: np.maximum.reduceat(x, begins))
    return [signature[new], least(second), function[new], node[new], least(first), most(last)], np.ascontiguousarray(codes[new])


def _windows(texts: DataFrame, among=None) -> DataFrame:
    """(signature, second, function, node, first, last) of every compact window; with among, of the signatures in a bit map, with their surroundings."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for node, s, sizes in ((b.column(0).to_numpy()[i:j], s, sizes) for b in batches for i, j, s, sizes in shingles_of(b.column(1))):
            # texts without a window
            enough = sizes >= SPAN
            s, nodes, sizes = s[np.repeat(enough, sizes)], node[enough], sizes[enough]
            if not len(nodes):
                continue
            begins = np.cumsum(sizes) - sizes
            hashed = lambda f: _mixed(s + np.uint64((f + 1) * 0x632BE59BD9B4E019 & (1 << 64) - 1))
            values = hashed(0)
            low, at = first_low, _ = _least(values)
            for f in range(FUNCTIONS):
                first, least, last = compact_windows(values, begins, at).T
                signature = values[least].view(np.int64)
                if f + 1 < FUNCTIONS:
                    values = hashed(f + 1)
                    low, at = _least(values)
                else:
                    low = first_low
                if among is not None:
                    kept = in_bit_map(among.value, signature)
                    first, least, last, signature = first[kept], least[kept], last[kept], signature[kept]
                row = np.searchsorted(begins, least, side="right") - 1
                around = np.clip(least - SPAN // 2, begins[row], begins[row] + sizes[row] - SPAN)
                second = low[around].astype(np.uint32).view(np.int32)
                columns = [signature, second, np.full(len(row), f, np.int32), nodes[row], (first - begins[row]).astype(np.int32), (last - begins[row]).astype(np.int32)]
                names = ["signature", "second", "function", "node", "first", "last"]
                if among is not None:
                    codes = _surroundings(s, first, least, last)
                    columns, codes = _without_repeats(columns, codes)
                    names.append("around")
                columns = [pa.array(x) for x in columns]
                if among is not None:
                    ends = np.arange(0, codes.nbytes + 1, 2 * codes.shape[1], np.int32)
                    columns.append(pa.Array.from_buffers(pa.binary(), len(codes), [None, pa.py_buffer(ends), pa.py_buffer(codes)]))
                yield pa.RecordBatch.from_arrays(columns, names)

    return texts.select("node", "text").mapInArrow(rows, "signature long, second int, function int, node long, first int, last int" + (", around binary" if among is not None else ""))


def _common(texts: DataFrame) -> DataFrame:
    """(signature, function, parts, sampled): signatures of many windows of the sampled texts, fewer than SHARE in all, with one of these windows."""
    sample = stage(_windows(texts.where(F.pmod("node", F.lit(SAMPLE)) == 0)), "sample")
    least = F.lit(max(HOT, sample.count() // SHARE))
    groups = sample.groupBy("signature", "function").agg(F.count("*").alias("n"), F.min(F.struct("node", "first", "last", "second")).alias("sampled"))
    common = stage(groups.where(F.col("n") > least).select("signature", "function", F.ceil(F.col("n") * SAMPLE / DEALT).cast("int").alias("parts"), "sampled"), "common")
    unstage(sample)
    return common


def _neighbours(batches: Iterator[pa.RecordBatch], sampled: dict[tuple[int, int], tuple[int, int, int, int]]) -> Iterator[pa.RecordBatch]:
    """The pairs that rows sorted by signature meet, and the rows of larger groups; see _candidates."""
    rest = [np.zeros(0, np.int64)] * 5
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= ROWS_AT_ONCE:
            rows = [np.concatenate([x, *(b.column(k).to_numpy().astype(np.int64, copy=False) for b in held)]) for k, x in enumerate(rest)]
            # the last signature may go on
            cut = int(np.searchsorted(rows[0], rows[0][-1]))
            rest = [x[cut:] for x in rows]
            held, n = [], 0
            if cut:
                yield _met([x[:cut] for x in rows], sampled)
    rows = [np.concatenate([x, *(b.column(k).to_numpy().astype(np.int64, copy=False) for b in held)]) for k, x in enumerate(rest)]
    yield _met(rows, sampled)


def _met(rows: list[np.ndarray], sampled: dict[tuple[int, int], tuple[int, int, int, int]]) -> pa.RecordBatch:
    """Of whole groups: see _neighbours."""
    signature, node, span, part, second = rows
    alone = np.ones(len(signature), bool)
    same = signature[1:] == signature[:-1]
    alone[1:] &= ~same
    alone[:-1] &= ~same
    # those that are dealt meet a sampled one at least
    signature, node, span, part, second = (x[~alone | (part >= 0)] for x in rows)
    order = np.lexsort((span, node, second, part, signature))
    signature, node, span, part, second = (x[order] for x in (signature, node, span, part, second))
    n = len(signature)
    changes = lambda *columns: np.concatenate([np.ones(min(n, 1), bool), np.logical_or.reduce([x[1:] != x[:-1] for x in columns])])
    new = changes(signature, part, second, node, span >> 32)
    signature, node, span, part, second = (x[new] for x in (signature, node, span, part, second))
    n = len(signature)
    first, last, function = span >> 32, span & 0xFFFFFFFF, part & 7
    starts = changes(signature, part)
    begins = np.flatnonzero(starts)
    group = np.cumsum(starts) - 1
    sizes = np.diff(np.append(begins, n))
    me = np.arange(n)
    runs = np.flatnonzero(changes(signature, part, second))
    # a group is larger if it has more rows than all meet; one that is dealt is in any case
    beyond = (sizes[group] > NEIGHBOURS + 2) | (part >= 0)
    dealt = np.flatnonzero(part[begins] >= 0)
    samples = np.array([sampled[key] for key in zip(signature[begins[dealt]].tolist(), function[begins[dealt]].tolist(), strict=True)], np.int64).reshape(-1, 4)
    all_node, all_first, all_last, all_second = (np.concatenate([x, samples[:, k]]) for k, x in enumerate((node, first, last, second)))
    leads = begins.copy()
    leads[dealt] = n + np.arange(len(dealt))
    lead = leads[group]
    out = [[np.zeros(0, np.int64)] for _ in range(7)]
    bit = lambda f: np.int64(1) << f
    for other in (lead, *(np.where(me - begins[group] >= k, me - k, me) for k in range(1, NEIGHBOURS + 1)), runs[np.searchsorted(runs, me, side="right") - 1] if n else me):
        own = np.flatnonzero(all_node[other] != node)
        o = other[own]
        seen = bit(function[own]) | np.where(all_second[o] == second[own], bit((function[own] + 1) % FUNCTIONS), 0)
        above = node[own] > all_node[o]
        pair = lambda x, all_x: (np.where(above, x[own], all_x[o]), np.where(above, all_x[o], x[own]))  # noqa: E731, B023
        for x, values in zip(out, (seen, *pair(node, all_node), *pair(first, all_first), *pair(last, all_last)), strict=True):
            x.append(values)
    seen, a, b, a_first, b_first, a_last, b_last = (np.concatenate(x) for x in out)
    single = np.flatnonzero(beyond)
    large = pa.concat_arrays([pa.nulls(len(a), pa.int64()), pa.array(signature[single])])
    functions = pa.concat_arrays([pa.nulls(len(a), pa.int32()), pa.array(function[single].astype(np.int32))])
    joined = lambda x, y: pa.array(np.concatenate([x, y[single]]))
    short = lambda x, y: pa.array(np.concatenate([x, y[single]]).astype(np.int32))
    columns = [large, functions, short(seen, np.zeros(n, np.int64)), joined(a, node), joined(b, node), short(a_first, first), short(a_last, last), short(b_first, first), short(b_last, last)]
    return pa.RecordBatch.from_arrays(columns, ["large", "function", "seen", "a", "b", "a_first", "a_last", "b_first", "b_last"])


def _candidates(windows: DataFrame, common: DataFrame) -> DataFrame:
    """(large, function, a, b, a_first, a_last, b_first, b_last): texts that have ENOUGH signatures in common, with their intervals.

    large is null for these. The other rows are the texts a of larger groups, with the group's signature and function.
    """
    # common has no more rows than SHARE for all functions together
    sampled = {(r.signature, r.function): r.sampled for r in common.select("signature", "function", "sampled").toLocalIterator()}
    parts = common.select(F.col("signature"), F.col("function"), "parts")
    dealt = windows.join(F.broadcast(parts), ["signature", "function"], "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64("node", "function"), F.col("parts")), F.lit(-1)).cast("int"))
    shift = lambda x, by: F.call_function("shiftleft", F.col(x).cast("long"), F.lit(by))
    # few columns, as most windows meet none and are dropped once they are sorted
    packed = dealt.select("signature", "node", shift("first", 32).bitwiseOR(F.col("last")).alias("span"), shift("part", 3).bitwiseOR(F.col("function")).alias("part"), "second")
    sorted_ = packed.repartition("signature", "part").sortWithinPartitions("signature")
    met = sorted_.mapInArrow(lambda batches: _neighbours(batches, sampled), "large long, function int, seen int, a long, b long, a_first int, a_last int, b_first int, b_last int")
    pairs = met.groupBy("large", "function", "a", "b").agg(F.bit_or("seen").alias("seen"), F.min("a_first").alias("a_first"), F.max("a_last").alias("a_last"), F.min("b_first").alias("b_first"), F.max("b_last").alias("b_last"))
    return pairs.where(F.col("large").isNotNull() | (F.bit_count("seen") >= ENOUGH)).drop("seen")


def _near_each_other(halves: np.ndarray, around: np.ndarray, lacks: np.ndarray) -> np.ndarray:
    """Whether all but so many bits as it may lack of one of a row's halves are among those around the other's least."""
    ok = None
    for side in range(2):
        missing = sum(np.bitwise_count(halves[..., side * BITS_WORDS + k] & ~around[..., k]).astype(np.uint16) for k in range(BITS_WORDS))
        ok = missing <= lacks if ok is None else ok | (missing <= lacks)
    return ok


def _sharing(codes: np.ndarray, distinct: np.ndarray, component: np.ndarray, mine: np.ndarray, theirs: np.ndarray, same: bool) -> Iterator[np.ndarray]:
    """For _STRIP rows of mine at once which rows of theirs are of other classes and have one of their rare codes; of the same rows each pair once."""
    ordered = np.sort(codes[theirs], axis=1)
    new = ordered > 0
    new[:, 1:] &= ordered[:, 1:] != ordered[:, :-1]
    at, place = np.nonzero(new)
    held = ordered[at, place]
    count = np.bincount(held, minlength=1 << 16)
    here = np.zeros(1 << 16, bool)
    here[held] = here[codes[mine]] = True
    here = np.flatnonzero(here)
    rank = np.zeros(1 << 16, np.int64)
    rank[here[np.argsort(count[here], kind="stable")]] = np.arange(len(here))
    labels, label = np.unique(np.concatenate([component[mine], component[theirs]]), return_inverse=True)
    # a list of their rows for each code, by class
    key = rank[held] * len(labels) + label[len(mine) :][at]
    order = np.argsort(key, kind="stable")
    key, at = key[order], at[order]
    row, rare = _rare_codes(codes[mine], rank, distinct[mine])
    own = rare * len(labels) + label[row]
    low, high = np.searchsorted(key, rare * len(labels)), np.searchsorted(key, own)
    if not same:
        row, order = np.sort(np.concatenate([row, row])), np.argsort(np.concatenate([row, row]), kind="stable")
        low = np.concatenate([low, np.searchsorted(key, own, side="right")])[order]
        high = np.concatenate([high, np.searchsorted(key, (rare + 1) * len(labels))])[order]
    some = high > low
    row, low, high = row[some], low[some], high[some]
    cuts = np.searchsorted(row, np.arange(0, len(mine) + _STRIP, _STRIP))
    for k, (begin, end) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)):
        ok = np.zeros((_STRIP, len(theirs)), bool)
        for r, lo, hi in zip((row[begin:end] - k * _STRIP).tolist(), low[begin:end].tolist(), high[begin:end].tolist(), strict=True):
            ok[r, at[lo:hi]] = True
        yield ok


def _block_pairs(codes: np.ndarray, bits: np.ndarray, component: np.ndarray, mine: np.ndarray, theirs: np.ndarray, distinct: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Rows of mine and of theirs that are of different classes and may have a passage in common; distinct: of _distinct_codes, if known."""
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    if not len(mine) or not len(theirs):
        return left[0], right[0]
    halves, around = bits[:, : 2 * BITS_WORDS], bits[:, 2 * BITS_WORDS :]
    same = np.array_equal(mine, theirs)
    distinct = _distinct_codes(codes) if distinct is None else distinct
    if max(len(mine), len(theirs)) > _STRIP:
        strips = _sharing(codes, distinct, component, mine, theirs, same)
    else:
        strips = [component[mine][:, None] != component[theirs]]
        if same:
            strips[0] &= np.tri(len(mine), k=-1, dtype=bool)
    for k, ok in enumerate(strips):
        i, j = np.nonzero(ok)
        i, j = mine[k * _STRIP + i], theirs[j]
        for begin in range(0, len(i), _PAIRS_AT_ONCE):
            x, y = i[begin : begin + _PAIRS_AT_ONCE], j[begin : begin + _PAIRS_AT_ONCE]
            for test in (
                lambda x, y: _near_each_other(halves[x], around[y], _may_lack(distinct[x].max(1))),
                lambda x, y: _most_shared(codes, x, y) >= SPAN - MISSED,
            ):
                good = test(x, y)
                x, y = x[good], y[good]
                good = test(y, x)
                x, y = x[good], y[good]
            left.append(x)
            right.append(y)
    return np.concatenate(left), np.concatenate(right)


def _rest_of_groups(members: DataFrame, classes: DataFrame, heads: DataFrame) -> DataFrame:
    """(a, b, a_first, a_last, b_first, b_last): all pairs of different classes in the groups (signature, function, node) that may hold."""
    classed = members.join(classes, "node", "left").select("signature", "function", "node", F.coalesce("component", "node").alias("component"))
    mixed = classed.groupBy("signature", "function").agg(F.count("*").alias("n"), F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").drop("low", "high")
    wanted = stage(classed.join(mixed, ["signature", "function"]), "mixed")
    windows = _windows(heads.where(maybe_among(wanted.select("node"), "node")), bit_map(wanted, F.col("signature")))
    # copies that went on are dropped here
    rows = windows.join(wanted, ["signature", "function", "node"]).groupBy("signature", "function", "node", "around").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.min("component").alias("component"))
    rows = stage(rows, "surroundings")
    unstage(wanted)
    sizes = rows.groupBy("signature", "function").agg(F.count("*").alias("n"), F.min("component").alias("low"), F.max("component").alias("high")).where("low < high")
    sizes = stage(sizes.select("signature", "function", F.ceil(F.col("n") / BLOCK).cast("int").alias("parts"), "n"), "sizes")
    # groups of one block share tasks of about BLOCK rows and more
    buckets = max(1, sizes.where("parts = 1").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] // BLOCK)
    part = F.pmod(F.xxhash64("node", "around"), F.col("parts")).cast("int")
    dealt = rows.join(sizes.drop("n"), ["signature", "function"]).withColumn("part", part).withColumn("met", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    bucket = F.when(F.col("parts") == 1, F.pmod(F.xxhash64("signature", "function"), F.lit(buckets))).otherwise(-F.pmod(F.xxhash64("signature", "function"), F.lit(1 << 62)) - 1)
    dealt = dealt.select(bucket.alias("bucket"), F.least("part", "met").alias("p"), F.greatest("part", "met").alias("q"), "signature", "function", "part", "node", "component", "first", "last", "around")

    def meet(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values(["signature", "function", "node"], ignore_index=True)
        codes = np.frombuffer(b"".join(block["around"]), np.uint16).reshape(len(block), -1)
        bits, distinct = _bits(codes), _distinct_codes(codes)
        component, part = block["component"].to_numpy(np.int64), block["part"].to_numpy(np.int64)
        keys = block[["signature", "function"]].to_numpy(np.int64)
        begins = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]).any(1)]))
        found = []
        p, q = int(block["p"].iloc[0]), int(block["q"].iloc[0])
        for begin, end in zip(begins.tolist(), [*begins[1:].tolist(), len(block)], strict=True):
            own = np.arange(begin, end)
            i, j = _block_pairs(codes, bits, component, own[part[own] == p], own[part[own] == q], distinct)
            found.append(np.stack([i, j], 1))
        pairs = np.concatenate(found)
        node, first, last = (block[x].to_numpy(np.int64) for x in ("node", "first", "last"))
        pairs = np.where((node[pairs[:, 0]] > node[pairs[:, 1]])[:, None], pairs, pairs[:, ::-1])
        a, b = pairs.T
        return pd.DataFrame({"a": node[a], "b": node[b], "a_first": first[a], "a_last": last[a], "b_first": first[b], "b_last": last[b]})

    met = dealt.groupBy("bucket", "p", "q").applyInPandas(meet, "a long, b long, a_first int, a_last int, b_first int, b_last int")
    return met.groupBy("a", "b").agg(F.min("a_first").alias("a_first"), F.max("a_last").alias("a_last"), F.min("b_first").alias("b_first"), F.max("b_last").alias("b_last"))


def similar_spans(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Spans (first word, end) of a made of passages of MIN_WORDS words that b nearly repeats."""
    values = np.unique(np.concatenate([a, b]), return_inverse=True)[1]
    _, firsts, ends = _similar_spans(values[: len(a)], np.array([len(a)]), values[len(a) :], np.array([len(b)]))
    return list(zip(firsts.tolist(), ends.tolist(), strict=True))


def _similar_spans(a: np.ndarray, a_sizes: np.ndarray, b: np.ndarray, b_sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(pair, first, end): for pairs of texts, whose values of 32 bits are one after another in a and in b, the spans of a of similar_spans."""
    a_begins, b_begins = np.cumsum(a_sizes) - a_sizes, np.cumsum(b_sizes) - b_sizes
    pair = np.repeat(np.arange(len(a_sizes)), a_sizes)
    nothing = np.zeros(0, np.int64)
    if len(a) < SPAN or len(b) < SPAN:
        return nothing, nothing, nothing
    # values of different pairs are different
    a = pair << 32 | a.astype(np.uint32)
    b = np.repeat(np.arange(len(b_sizes)), b_sizes) << 32 | b.astype(np.uint32)
    sorted_, order = _in_order(b)
    at = np.minimum(np.searchsorted(sorted_, a), len(b) - 1)
    shared = sorted_[at] == a
    place = order[at]
    total = np.concatenate([[0], np.cumsum(shared)])
    within = (pair[SPAN - 1 :] == pair[: len(a) - SPAN + 1]) & (b_sizes >= SPAN)[pair[: len(a) - SPAN + 1]]
    starts = np.flatnonzero((total[SPAN:] - total[:-SPAN] >= SIMILARITY * SPAN - 1e-9) & within)
    # passages that b has word for word hold anyway
    line = place - np.arange(len(a))
    bend = np.concatenate([[0], np.cumsum(line[1:] != line[:-1])])
    straight = (total[starts + SPAN] - total[starts] == SPAN) & (bend[starts + SPAN - 1] == bend[starts])
    good, starts = [starts[straight]], starts[~straight]
    if len(starts):
        # a count stands for a set where no shingle is met twice
        twice = np.append(sorted_[1:] == sorted_[:-1], False)[at] & shared
        odd_a, odd_b = _repeats_within(a), _repeats_within(b)
        again = np.concatenate([[0], np.cumsum(twice)])
    # starts between two good ones of one span change nothing: a few show which ones these are
    for every in (8, 1):
        known = np.sort(np.concatenate(good))
        if len(known):
            after = np.searchsorted(known, starts)
            left, right = known[np.maximum(after - 1, 0)], known[np.minimum(after, len(known) - 1)]
            starts = starts[(after == 0) | (after == len(known)) | (right - left > MIN_WORDS) | (pair[left] != pair[right])]
        tried = np.zeros(len(starts), bool)
        tried[::every] = True
        for k in range(0, len(starts), every * _STARTS_AT_ONCE):
            p = starts[k : k + every * _STARTS_AT_ONCE : every]
            index = p[:, None] + np.arange(SPAN)
            s, q = shared[index], place[index]
            # the passage of b around the median place of the shared shingles
            lines = np.sort(np.where(s, q - np.arange(SPAN), len(b)), axis=1)
            first = b_begins[pair[p]]
            begin = np.clip(lines[np.arange(len(p)), s.sum(1) // 2], first, first + b_sizes[pair[p]] - SPAN)
            both = (s & (q >= begin[:, None]) & (q < begin[:, None] + SPAN)).sum(1)
            ok = both >= SIMILARITY * (2 * SPAN - both) - 1e-9
            odd = np.flatnonzero(odd_a[p] | odd_b[begin] | (again[p + SPAN] > again[p]))
            if len(odd):
                own, other = a[p[odd][:, None] + np.arange(SPAN)], b[begin[odd][:, None] + np.arange(SPAN)]
                union = _distinct(np.concatenate([own, other], axis=1))
                ok[odd] = _distinct(own) + _distinct(other) - union >= SIMILARITY * union - 1e-9
            good.append(p[ok])
        starts = starts[~tried]
    good = np.sort(np.concatenate(good))
    if not len(good):
        return nothing, nothing, nothing
    cut = np.flatnonzero((np.diff(good) > MIN_WORDS) | (pair[good[1:]] != pair[good[:-1]]))
    firsts, lasts = good[np.concatenate([[0], cut + 1])], good[np.append(cut, len(good) - 1)]
    pair = pair[firsts]
    return pair, firsts - a_begins[pair], lasts - a_begins[pair] + MIN_WORDS


def _in_order(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """x, of no negative values, sorted, and the places of its values, equal ones in their order."""
    bits = len(x).bit_length()
    if not len(x) or int(x.max()).bit_length() + bits > 63:
        order = np.argsort(x, kind="stable")
        return x[order], order
    packed = np.sort(x << bits | np.arange(len(x)))
    return packed >> bits, packed & (1 << bits) - 1


def _distinct(rows: np.ndarray) -> np.ndarray:
    """The number of distinct values of each row."""
    rows = np.sort(rows, axis=1)
    return (rows[:, 1:] != rows[:, :-1]).sum(1) + 1


def _repeats_within(x: np.ndarray) -> np.ndarray:
    """For each start of SPAN values whether one of them is met twice."""
    ordered, order = _in_order(x)
    same = ordered[1:] == ordered[:-1]
    # a value and its next occurrence under SPAN later spoil the starts from the one's reach to the other's
    one, two = order[:-1][same], order[1:][same]
    close = two - one < SPAN
    change = np.zeros(len(x) + 1, np.int64)
    np.add.at(change, np.maximum(two[close] - SPAN + 1, 0), 1)
    np.add.at(change, one[close] + 1, -1)
    return np.cumsum(change)[: len(x) - SPAN + 1] > 0


def _verified_spans(pairs: pa.RecordBatch, schema: pa.Schema) -> pa.RecordBatch:
    """(a, b, a_spans, b_spans) of pairs that hold, of (a, b, a_first, b_first, a_tokens, b_tokens)."""

    def side(x: str, rows: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        tokens = pairs.column(f"{x}_tokens")
        tokens = tokens if rows is None else tokens.take(pa.array(rows))
        return tokens.flatten().to_numpy(), tokens.value_lengths().to_numpy().astype(np.int64)

    pair, first, end = _similar_spans(*side("a"), *side("b"))
    # where no passage of the one is like the other, there is none the other way round
    rows = np.unique(pair)
    back, back_first, back_end = _similar_spans(*side("b", rows), *side("a", rows))
    columns = [pairs.column(x).take(pa.array(rows)) for x in ("a", "b")]
    for x, of, one, two in (("a", np.searchsorted(rows, pair), first, end), ("b", back, back_first, back_end)):
        begin = pairs.column(f"{x}_first").to_numpy()[rows][of]
        values = pa.StructArray.from_arrays([pa.array((v + begin).astype(np.int32)) for v in (one, two)], ["first", "end"])
        columns.append(pa.ListArray.from_arrays(pa.array(np.searchsorted(of, np.arange(len(rows) + 1)).astype(np.int32)), values))
    return pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, b, a_spans, b_spans) of the pairs with passages that hold."""
    nodes = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for node, s, sizes in ((b.column(0)[i:j], s, sizes) for b in batches for i, j, s, sizes in shingles_of(b.column(1))):
            # 32 bits are enough within one pair
            offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
            yield pa.RecordBatch.from_arrays([node, pa.ListArray.from_arrays(offsets, pa.array(s.astype(np.uint32).view(np.int32)))], ["node", "tokens"])

    wanted = texts.where(maybe_among(nodes, "node")).select("node", "text").mapInArrow(tokens, "node long, tokens array<int>").join(nodes, "node", "left_semi").dropDuplicates(["node"])
    wanted = stage(wanted, "tokens")
    side = lambda x: wanted.select(F.col("node").alias(x), F.col("tokens").alias(f"{x}_tokens"))
    cut = lambda x: F.slice(f"{x}_tokens", F.col(f"{x}_first") + 1, F.col(f"{x}_last") - F.col(f"{x}_first") + 1).alias(f"{x}_tokens")
    half = pairs.join(side("a"), "a").select("a", "b", "a_first", "b_first", "b_last", cut("a"))
    both = half.join(side("b"), "b").select("a", "b", "a_first", "b_first", "a_tokens", cut("b"))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            begin, sizes = 0, np.cumsum(batch.column("a_tokens").value_lengths().to_numpy() + batch.column("b_tokens").value_lengths().to_numpy())
            while begin < len(sizes):
                end = max(begin + 1, int(np.searchsorted(sizes, _TOKENS_AT_ONCE + (sizes[begin - 1] if begin else 0), side="right")))
                yield _verified_spans(batch.slice(begin, end - begin), schema)
                begin = end

    spans = pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32())]))
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("a_spans", spans), ("b_spans", spans)])
    span = "array<struct<first:int,end:int>>"
    return both.mapInArrow(verify, f"a long, b long, a_spans {span}, b_spans {span}")


def repeated_passages(df: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, class_id and passages of each row of df that has a near-duplicate passage in another.

    class_id: the smallest doc_id of the texts linked by passages; passages: array of (first word, end), merged.
    """
    texts = df.select(F.col(doc_id).alias("doc_id"), text_or_empty(text).alias("text")).withColumn("node", F.xxhash64("text"))
    nodes = stage(texts.groupBy("node").agg(F.min("doc_id").alias("head"), F.count("*").alias("copies"), F.max(F.size(words_of(F.col("text")))).alias("words")), "nodes")
    # one text of each kind goes on; where the map fills up, copies go on, too, and are told apart by their node
    heads = texts.where(maybe_among(nodes.select("node", F.col("head").alias("doc_id")), "node", "doc_id")).select("node", "text")
    pairs = stage(_candidates(_windows(heads), _common(heads)), "pairs")
    links = stage(_verified(pairs.where("large IS NULL").drop("large", "function"), heads), "links")
    members = pairs.where("large IS NOT NULL").select(F.col("large").alias("signature"), "function", F.col("a").alias("node"))
    if not members.isEmpty():
        rest = stage(_rest_of_groups(members, components(links.select(F.col("a").alias("u"), F.col("b").alias("v"))), heads), "rest")
        links = links.union(stage(_verified(rest, heads), "links"))
    spans = links.select(F.col("a").alias("node"), F.inline("a_spans")).union(links.select("b", F.inline("b_spans")))
    spans = spans.groupBy("node").agg(F.sort_array(F.collect_set(F.struct("first", "end"))).alias("spans"))
    classes = components(links.select(F.col("a").alias("u"), F.col("b").alias("v")))
    copied = (F.col("copies") > 1) & (F.col("words") >= MIN_WORDS)
    known = nodes.join(classes, "node", "left").join(spans, "node", "left").where(F.col("component").isNotNull() | copied)
    known = stage(known.withColumn("component", F.coalesce("component", "node")), "known")
    ids = known.groupBy("component").agg(F.min("head").alias("class_id"))
    whole = F.array(F.struct(F.lit(0).alias("first"), F.col("words").cast("int").alias("end")))
    joined = F.aggregate(
        "spans",
        F.array().cast("array<struct<first:int,end:int>>"),
        lambda acc, s: F.when(
            (F.size(acc) > 0) & (s["first"] <= F.get(acc, F.size(acc) - 1)["end"]),
            F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.struct(F.get(acc, F.size(acc) - 1)["first"].alias("first"), F.greatest(F.get(acc, F.size(acc) - 1)["end"], s["end"]).alias("end")))),
        ).otherwise(F.concat(acc, F.array(s))),
    )
    known = known.join(ids, "component").select("node", "class_id", F.when(copied, whole).otherwise(joined).alias("passages"))
    return texts.select("doc_id", "node").join(known, "node").select("doc_id", "class_id", "passages")
