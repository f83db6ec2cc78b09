"""SentencePiece encoding and decoding by suffix-array matching.

The distinct words of a batch are concatenated and indexed by a suffix array; every piece is found in it
by binary search, its range of suffixes gives edges (position, piece), and the edges, sorted by
position, are relaxed from left to right. The models read are merge models, whose encoding is not the
path of the best sum of scores. It has this property instead: every prefix of a word has exactly one
encoding, and a sequence of pieces is the encoding of its text if all neighbours are the encoding of
theirs. So an edge relaxes its end if its piece follows the last piece of its start; this gives the very
ids that the merges give. Whether two pieces may follow one another is found by letting the merges
inside both run in order of their ranks and looking whether one across their border comes first.

Normalisation: a space is put before the text and spaces become U+2581; nothing else is changed.
Characters that aren't in the model become their UTF-8 bytes' pieces. Null and empty texts give no
pieces. Decoding restores the text, but that U+2581 becomes a space. Long texts are encoded whole, repeated
rows one by one, empty tables give empty results; other columns pass through.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
NONE = np.int32(2**31 - 1)
_UNIT = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
_CHARS_AT_ONCE = 1 << 19
_UNITS_KEPT = 250_000


def load_model(path: str = DEFAULT_MODEL) -> dict:
    """Tables of a merge model, to be broadcast; their size depends on the model alone."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    size = sp.get_piece_size()
    text = [sp.id_to_piece(k) for k in range(size)]
    normal = [k for k in range(size) if not (sp.is_byte(k) or sp.is_control(k) or sp.is_unknown(k) or sp.is_unused(k))]
    scores = np.array([sp.get_score(k) for k in range(size)])
    _, rank = np.unique(-scores, return_inverse=True)
    ids = {text[k]: k for k in normal}
    if any(c not in ids for p in ids for c in p) or any(SPACE in p.lstrip(SPACE) for p in ids):
        raise ValueError("a model is needed whose pieces consist of pieces and don't go on after a space")
    longest = max(map(len, ids))
    model = {"text": text, "bytes": np.array([sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int32), "rank": rank.astype(np.int32), "longest": longest}
    events, left, right = (np.full((size + 1, longest + 1), NONE, np.int32) for _ in range(3))
    sound = np.zeros(size, bool)
    for piece, k in ids.items():
        symbols, at = [ids[c] for c in piece], 0
        left[k, 0], right[k, 0] = symbols[0], symbols[-1]
        while True:
            joined = [ids.get(text[a] + text[b]) for a, b in zip(symbols, symbols[1:])]
            best = min(((rank[j], i) for i, j in enumerate(joined) if j is not None), default=None)
            if best is None:
                break
            events[k, at] = best[0]
            symbols[best[1] : best[1] + 2] = [joined[best[1]]]
            at += 1
            left[k, at], right[k, at] = symbols[0], symbols[-1]
        sound[k] = symbols == [k]
    halves = {}
    for piece, k in ids.items():
        for cut in range(1, len(piece)):
            a, b = ids.get(piece[:cut]), ids.get(piece[cut:])
            if a is not None and b is not None:
                halves[a * (size + 1) + b] = rank[k]
    keys = np.array(sorted(halves), np.int64)
    model |= {"events": events, "left": left, "right": right, "pair": keys, "pair_rank": np.array([halves[x] for x in keys.tolist()], np.int32)}
    usable = [k for k in normal if sound[k]]
    alphabet = {c: i + 2 for i, c in enumerate(sorted({c for p in ids for c in p}))}
    model |= {"alphabet": np.array([ord(c) for c in sorted(alphabet)], np.uint32), "ids": np.array(usable, np.int32), "lengths": np.array([len(text[k]) for k in usable], np.int32)}
    width = -(-longest // 4) * 4
    codes = np.zeros((2, len(usable), width), np.uint64)
    codes[1] = 0xFFFF
    for row, k in enumerate(usable):
        codes[:, row, : len(text[k])] = [alphabet[c] for c in text[k]]
    model["low"], model["high"] = (_packed(c) for c in codes)
    return model


def _packed(codes: np.ndarray) -> list[np.ndarray]:
    """Rows of 16-bit codes as columns of four codes each, which compare in the same order."""
    c = codes.astype(np.uint64)
    return [c[:, k] << np.uint64(48) | c[:, k + 1] << np.uint64(32) | c[:, k + 2] << np.uint64(16) | c[:, k + 3] for k in range(0, codes.shape[1], 4)]


def _before(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    less, same = a[0] < b[0], a[0] == b[0]
    for x, y in zip(a[1:], b[1:], strict=True):
        less |= same & (x < y)
        same &= x == y
    return less


class Encoder:
    """Encodes texts with a model's tables. Words met before are kept, up to a bound."""

    def __init__(self, model: dict):
        self.model = model
        self.base = len(model["text"]) + 1
        self.known = np.zeros(0, np.int64)
        self.fits = np.zeros(0, bool)
        self.forget()

    def forget(self) -> None:
        self.units: dict[str, int] = {}
        self.ids = np.zeros(0, np.int32)
        self.ends = np.zeros(1, np.int64)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.units) > _UNITS_KEPT:
            self.forget()
        units, fresh, rows = self.units, [], []
        for text in texts:
            parts = text.split(" ") if text else []
            if "" in parts or SPACE in text:
                parts = [x[1:] for x in _UNIT.findall(SPACE + text.replace(" ", SPACE))]
            row = []
            for part in parts:
                k = units.get(part)
                if k is None:
                    k = units[part] = len(units)
                    fresh.append(part)
                row.append(k)
            rows.append(np.array(row, np.int64))
        if fresh:
            ids, lengths = self._encode_units([SPACE + x for x in fresh])
            self.ids = np.concatenate([self.ids, ids])
            self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(lengths)])
        return [_gather(self.ids, self.ends[row], self.ends[row + 1]) for row in rows]

    def _encode_units(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all units in a row, and the number of each unit's."""
        m = self.model
        points = np.frombuffer("\0".join([*units, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
        sizes = np.fromiter(map(len, units), np.int64, len(units))
        at = np.minimum(np.searchsorted(m["alphabet"], points), len(m["alphabet"]) - 1)
        inside = m["alphabet"][at] == points
        codes = np.where(inside, at + 2, 1)
        stops = np.cumsum(sizes + 1) - 1
        codes[stops] = 0
        start, piece = self._edges(codes)
        unknown = np.flatnonzero(codes == 1)
        start = np.concatenate([start, unknown])
        piece = np.concatenate([piece, np.full(len(unknown), self.base - 1, np.int32)])
        begins = np.concatenate([[0], stops[:-1] + 1])
        offset = np.arange(len(codes)) - np.repeat(begins, sizes + 1)
        order = np.lexsort((start, offset[start]))
        start, piece = start[order], piece[order]
        length = np.concatenate([np.fromiter(map(len, m["text"]), np.int64, self.base - 1), [1]])
        last = np.full(len(codes), -1, np.int64)
        length_at = np.zeros(len(codes), np.int64)
        bounds = np.searchsorted(offset[start], np.arange(int(sizes.max(initial=0)) + 1))
        for k in range(len(bounds) - 1):
            s, p = start[bounds[k] : bounds[k + 1]], piece[bounds[k] : bounds[k + 1]]
            ok = np.ones(len(s), bool) if k == 0 else self._follows(last[s], p)
            end = s[ok] + length[p[ok]]
            last[end], length_at[end] = p[ok], length[p[ok]]
        ids, where = [], []
        here = stops.copy()
        live = np.arange(len(units))
        while len(live):
            ids.append(last[here[live]])
            where.append(here[live])
            here[live] -= length_at[here[live]]
            live = live[here[live] > begins[live]]
        ids, where = np.concatenate(ids), np.concatenate(where)
        order = np.argsort(where, kind="stable")
        ids, where = ids[order], where[order]
        unit = np.searchsorted(stops, where)
        return self._with_bytes(ids, points[where - 1], unit, len(units))

    def _with_bytes(self, ids, points, unit, n) -> tuple[np.ndarray, np.ndarray]:
        """Puts the pieces of UTF-8 bytes for unknown characters."""
        odd = np.flatnonzero(ids == self.base - 1)
        if not len(odd):
            return ids.astype(np.int32), np.bincount(unit, minlength=n)
        spelled = {c: self.model["bytes"][list(chr(c).encode("utf-8", "surrogatepass"))] for c in np.unique(points[odd]).tolist()}
        times = np.ones(len(ids), np.int64)
        times[odd] = [len(spelled[c]) for c in points[odd].tolist()]
        out = np.repeat(ids, times)
        unit = np.repeat(unit, times)
        out[np.repeat(ids == self.base - 1, times)] = np.concatenate([spelled[c] for c in points[odd].tolist()])
        return out.astype(np.int32), np.bincount(unit, minlength=n)

    def _edges(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position, piece) for every occurrence of a piece, from the sorted suffixes."""
        m = self.model
        width = 4 * len(m["low"])
        padded = np.concatenate([codes.astype(np.uint64), np.zeros(width, np.uint64)])
        # nothing after a word's end takes part in the order
        four = padded[: -3] << np.uint64(48) | padded[1:-2] << np.uint64(32) | padded[2:-1] << np.uint64(16) | padded[3:]
        keys = [four[k : k + len(codes)] for k in range(0, width, 4)]
        suffixes = np.lexsort(keys[::-1])
        keys = [k[suffixes] for k in keys]
        bound = []
        for wanted in (m["low"], m["high"]):
            low, high = np.zeros(len(wanted[0]), np.int64), np.full(len(wanted[0]), len(suffixes), np.int64)
            while (open_ := low < high).any():
                middle = (low + high) // 2
                probe = np.minimum(middle, len(suffixes) - 1)
                less = _before([k[probe] for k in keys], wanted)
                low, high = np.where(open_ & less, middle + 1, low), np.where(open_ & ~less, middle, high)
            bound.append(low)
        return _gather(suffixes, *bound), np.repeat(m["ids"], bound[1] - bound[0])

    def _follows(self, last: np.ndarray, piece: np.ndarray) -> np.ndarray:
        """Whether the merges leave a border between last and piece; answers are kept."""
        keys = last * self.base + piece
        at = np.searchsorted(self.known, keys)
        new = np.unique(keys[(at == len(self.known)) | (self.known[np.minimum(at, len(self.known) - 1)] != keys)] if len(self.known) else keys)
        if len(new):
            if len(self.known) > 1 << 22:
                self.known, self.fits, new = np.zeros(0, np.int64), np.zeros(0, bool), np.unique(keys)
            place = np.searchsorted(self.known, new)
            self.known, self.fits = np.insert(self.known, place, new), np.insert(self.fits, place, self._border(new // self.base, new % self.base))
            at = np.searchsorted(self.known, keys)
        return self.fits[at]

    def _border(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        m = self.model
        out = np.ones(len(a), bool)
        live = np.flatnonzero((a < self.base - 1) & (b < self.base - 1))
        i, j = np.zeros(len(a), np.int64), np.zeros(len(a), np.int64)
        while len(live):
            u, v, x, y = a[live], b[live], i[live], j[live]
            key = m["right"][u, x].astype(np.int64) * self.base + m["left"][v, y]
            at = np.minimum(np.searchsorted(m["pair"], key), len(m["pair"]) - 1)
            across = np.where(m["pair"][at] == key, m["pair_rank"][at], NONE)
            mine, theirs = m["events"][u, x], m["events"][v, y]
            joined = (across < mine) & (across <= theirs) & (across != NONE)
            out[live[joined]] = False
            left = mine <= theirs
            i[live] += left
            j[live] += ~left
            live = live[~joined & ((mine != NONE) | (theirs != NONE))]
        return out


def _gather(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """values[starts[0]:ends[0]], values[starts[1]:ends[1]] ... in a row."""
    sizes = ends - starts
    before = np.cumsum(sizes) - sizes
    return values[np.arange(int(sizes.sum())) + np.repeat(starts - before, sizes)]


def decode(model: dict, ids: np.ndarray) -> str:
    """The text of ids; bytes that aren't UTF-8 become U+FFFD."""
    pieces = model.get("spelled")
    if pieces is None:
        pieces = [x.encode() for x in model["text"]]
        for b, k in enumerate(model["bytes"].tolist()):
            pieces[k] = bytes([b])
        model["spelled"] = pieces
    whole = b"".join([pieces[k] for k in ids.tolist()]).decode("utf-8", "replace").replace(SPACE, " ")
    return whole[1:] if whole.startswith(" ") else whole


_encoders: dict[int, Encoder] = {}


def _encoder(shared) -> Encoder:
    if id(shared.value) not in _encoders:
        _encoders.clear()
        _encoders[id(shared.value)] = Encoder(shared.value)
    return _encoders[id(shared.value)]


def _mapped(df: DataFrame, text: str, model: str, fields: list[T.StructField], made) -> DataFrame:
    """df with the columns of fields, which made(encoder, texts, ids) gives for a block of rows."""
    shared = df.sparkSession.sparkContext.broadcast(load_model(model))
    names = [f.name for f in fields]
    kept = [c for c in df.columns if c not in names]
    schema = T.StructType([*(df.schema[c] for c in kept), *fields])

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = _encoder(shared)
        for batch in batches:
            texts = [t if isinstance(t, str) else "" for t in batch[text]]
            start, size = 0, 0
            for k, t in enumerate(texts):
                size += len(t)
                if size > _CHARS_AT_ONCE or k + 1 == len(texts):
                    part = texts[start : k + 1]
                    new = made(encoder, part, encoder.encode(part))
                    yield batch[kept].iloc[start : k + 1].reset_index(drop=True).assign(**new)[[*kept, *names]]
                    start, size = k + 1, 0

    return df.mapInPandas(rows, schema)


def encode(df: DataFrame, text: str = "text", model: str = DEFAULT_MODEL) -> DataFrame:
    """df with piece_ids (array of int)."""
    field = T.StructField("piece_ids", T.ArrayType(T.IntegerType()))
    return _mapped(df, text, model, [field], lambda e, texts, ids: {"piece_ids": pd.Series(ids, dtype=object)})


def digest(df: DataFrame, text: str = "text", model: str = DEFAULT_MODEL) -> DataFrame:
    """df with n_pieces, n_byte_pieces, ids_sha256 (of the ids as 32-bit little-endian numbers) and round_trip."""
    fields = [T.StructField("n_pieces", T.LongType()), T.StructField("n_byte_pieces", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("round_trip", T.BooleanType())]

    def made(e: Encoder, texts: list[str], ids: list[np.ndarray]) -> dict:
        low, high = int(e.model["bytes"].min()), int(e.model["bytes"].max())
        return {
            "n_pieces": [len(x) for x in ids],
            "n_byte_pieces": [int(((x >= low) & (x <= high)).sum()) for x in ids],
            "ids_sha256": [hashlib.sha256(x.astype("<i4").tobytes()).hexdigest() for x in ids],
            "round_trip": [decode(e.model, x) == t for x, t in zip(ids, texts, strict=True)],
        }

    return _mapped(df, text, model, fields, made)


def decoded(df: DataFrame, ids: str = "piece_ids", model: str = DEFAULT_MODEL) -> DataFrame:
    """df with decoded_text, the text of its ids."""
    shared = df.sparkSession.sparkContext.broadcast(load_model(model))
    kept = [c for c in df.columns if c != "decoded_text"]
    schema = T.StructType([*(df.schema[c] for c in kept), T.StructField("decoded_text", T.StringType())])

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch[kept].assign(decoded_text=[decode(shared.value, np.asarray([] if x is None else x, np.int64)) for x in batch[ids]])

    return df.mapInPandas(rows, schema)
