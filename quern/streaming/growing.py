"""Growing tables: chunks, eras and packs of an append-only stream, emitted as they fill, and the rest at an end mark.

A source's rows arrive in the order of idx across micro-batches, within one they are sorted; rows that come too late raise. A
row that is marked as the last of its source releases what is held back; it may have null ids, and then only marks the end.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quern.operators.packing import Pool
from quern.operators.shuffling import lcg_parameters

#: The idx after which a source has no more rows.
_OVER = (1 << 63) - 1


def _in_order(key: tuple, batches: Iterator[pd.DataFrame], idx: str, seen: int) -> tuple[pd.DataFrame, int]:
    """A micro-batch of a source, sorted, and its last idx; a row at or before `seen`, or a second one of an idx, raises."""
    batch = pd.concat(list(batches)).sort_values(idx, ignore_index=True)
    order = batch[idx].tolist()
    for before, at in zip([seen, *order], order, strict=False):
        if at <= before:
            raise ValueError(f"row {at} of {key[0]} came after row {before}" if before < _OVER else f"row {at} of {key[0]} came after its end")
    return batch, order[-1]


def _marked(rows: DataFrame, end: str | None) -> DataFrame:
    return rows.withColumn("__end", F.coalesce(F.col(end), F.lit(False)) if end else F.lit(False))


def chunk_stream(rows: DataFrame, length: int, source: str = "source", idx: str = "idx", ids: str = "ids") -> DataFrame:
    """(source, seq, tokens) of a stream of (source, idx, ids), with the unfinished tail of each source as state.

    The state of a source is less than `length` tokens.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seq, seen, tail = state.get if state.exists else (0, -1, [])
        tail = list(tail)
        batch, seen = _in_order(key, batches, idx, seen)
        out = []
        for tokens in batch[ids]:
            tail += [int(t) for t in tokens]  # the state takes plain numbers only
            while len(tail) >= length:
                out.append((key[0], seq, tail[:length]))
                tail, seq = tail[length:], seq + 1
        state.update((seq, seen, tail))
        yield pd.DataFrame(out, columns=["source", "seq", "tokens"])

    return rows.groupBy(source).applyInPandasWithState(step, "source string, seq long, tokens array<int>", "seq long, seen long, tail array<int>", "append", GroupStateTimeout.NoTimeout)


def era_stream(rows: DataFrame, era: int, seed: int, source: str = "source", idx: str = "idx", end: str | None = None) -> DataFrame:
    """(source, idx, source_idx): a stream's indices, dense from zero, permuted within eras of `era` rows, each era once it is full.

    end: a boolean column that marks the last row of a source, with which the last era comes out, however short, with
    a permutation of its own size. The result is that of shuffling.era_permuted() with era_parameters() of the seed.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        (seen,) = state.get if state.exists else (0,)
        batch, last = _in_order(key, batches, idx, seen - 1)
        if last != seen + len(batch) - 1:
            raise ValueError(f"rows of {key[0]} are missing before row {last}")
        now, over = last + 1, bool(batch["__end"].any())
        sizes = [(k, era) for k in range(seen // era, now // era)]
        if over and now % era:
            sizes.append((now // era, now % era))
        out = []
        for k, size in sizes:
            a, b = lcg_parameters(size, seed + k)
            out += [(key[0], k * era + x, k * era + (a * x + b) % size) for x in range(size)]
        state.update((_OVER if over else now,))
        yield pd.DataFrame(out, columns=["source", "idx", "source_idx"])

    return _marked(rows, end).select(source, idx, "__end").groupBy(source).applyInPandasWithState(step, "source string, idx long, source_idx long", "seen long", "append", GroupStateTimeout.NoTimeout)


def pack_stream(rows: DataFrame, length: int, max_segments: int, max_buffered: int, source: str = "source", idx: str = "idx", ids: str = "ids", end: str | None = None, pad: int = 0) -> DataFrame:
    """(source, pack, tokens, segments) of a stream of (source, idx, ids), packed by first fit, each pack once it is closed.

    The packs are those of packing.first_fit_packs(): a pack is closed when it is full, has max_segments rows, or is the oldest of
    max_buffered when another one is opened; the others come out with the end mark. The open packs, with their tokens, are the
    state of a source: max_buffered * length tokens at most. A segment is a row's idx, -1 padding.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen, new, numbers, used, counts, rows_, sizes, tokens = state.get if state.exists else (-1, 0, [], [], [], [], [], [])
        pool = Pool(length, max_segments, max_buffered, [list(p) for p in zip(numbers, used, counts, strict=True)], new)
        # of each open pack its rows' (idx, size) and its tokens, flat in the state
        held: dict[int, tuple[list[tuple[int, int]], list[int]]] = {}
        row, token = 0, 0
        for number, size, count in zip(numbers, used, counts, strict=True):
            held[number] = (list(zip(rows_[row : row + count], sizes[row : row + count], strict=True)), list(tokens[token : token + size]))
            row, token = row + count, token + size
        batch, seen = _in_order(key, batches, idx, seen)
        over, out = bool(batch["__end"].any()), []

        def close(number: int) -> None:
            own, flat = held.pop(number)
            segments = [i for i, n in own for _ in range(n)]
            out.append((key[0], number, flat + [pad] * (length - len(flat)), segments + [-1] * (length - len(flat))))

        for i, own in zip(batch[idx].tolist(), batch[ids], strict=True):
            if own is None or not len(own):
                continue
            number, closed = pool.add(len(own), i)
            of_pack, flat = held.setdefault(number, ([], []))
            of_pack.append((i, len(own)))
            flat += [int(t) for t in own]
            for done in closed:
                close(done)
        if over:
            for number in list(held):
                close(number)
            pool.opened, seen = [], _OVER
        own = [held[p[0]] for p in pool.opened]
        state.update((seen, pool.new, *([p[k] for p in pool.opened] for k in range(3)), [i for r, _ in own for i, _ in r], [n for r, _ in own for _, n in r], [t for _, flat in own for t in flat]))
        yield pd.DataFrame(out, columns=["source", "pack", "tokens", "segments"])

    shape = "seen long, new long, numbers array<long>, used array<long>, counts array<long>, rows array<long>, sizes array<long>, tokens array<int>"
    marked = _marked(rows, end).select(source, idx, ids, "__end")
    return marked.groupBy(source).applyInPandasWithState(step, "source string, pack long, tokens array<int>, segments array<long>", shape, "append", GroupStateTimeout.NoTimeout)
