"""Product codes of vectors in whole numbers: a codebook a part, found by rounds of assignment, searched by vantage-point trees.

A component x becomes floor(4096 x); a vector is cut into PARTS equal parts, and each part has a codebook that begins with that part
of the ENTRIES smallest ids. In each of ROUNDS rounds every part goes to its nearest entry (squared distance, ties to the
lower index), then an entry becomes the componentwise floor of its parts' mean. An entry without parts stays.

The nearest entry is found by a vantage-point tree over a part's entries: a node has an entry and the others, split at
the median distance into a near and a far half. Distances to the entry are whole numbers; their roots are rounded
outwards, and a half is visited unless the triangle inequality rules it out strictly, so that rounding only costs visits. What is
visited is compared by whole numbers and by index.

Vectors that are null or hold null or non-finite components are dropped, and so are those of another length than the vector of the
smallest id. Components beyond LARGEST after scaling raise. Rows without an id take part, after all ids; rows of equal ids are ordered by
their components. With fewer than ENTRIES vectors there are as many entries. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import stage

SCALE = 4096
PARTS = 8
ENTRIES = 16
ROUNDS = 6
#: Squared distances of a part of 2,048 components within this fit 63 bits.
LARGEST = 1 << 24
#: Labels up to this number have their sums broadcast, more are joined.
BROADCAST_LABELS = 100_000


@dataclass
class Node:
    """An entry, and the entries of the two halves with the bounds of their distances to it."""

    entry: int
    near: Node | None
    far: Node | None
    near_most: float
    far_least: float


def _up(squares: np.ndarray) -> np.ndarray:
    """Roots of whole numbers, not below the true ones."""
    return np.nextafter(np.sqrt(np.nextafter(squares.astype(np.float64), np.inf)), np.inf)


def _down(squares: np.ndarray) -> np.ndarray:
    """Roots of whole numbers, not above the true ones."""
    return np.maximum(np.nextafter(np.sqrt(np.nextafter(squares.astype(np.float64), -np.inf).clip(0)), -np.inf), 0.0)


def _squares(points: np.ndarray, entry: np.ndarray) -> np.ndarray:
    difference = points - entry
    return np.einsum("ij,ij->i", difference, difference)


def tree(book: np.ndarray, members: list[int] | None = None) -> Node | None:
    """The vantage-point tree of a codebook's entries, one entry a row."""
    members = list(range(len(book))) if members is None else members
    if not members:
        return None
    first, rest = members[0], np.array(members[1:], np.int64)
    if not len(rest):
        return Node(first, None, None, 0.0, 0.0)
    away = _squares(book[rest], book[first])
    order = np.argsort(away, kind="stable")
    half = (len(rest) + 1) // 2
    near, far = order[:half], order[half:]
    return Node(first, tree(book, rest[near].tolist()), tree(book, rest[far].tolist()), float(_up(away[near]).max()), float(_down(away[far]).min()) if len(far) else np.inf)


def nearest(points: np.ndarray, book: np.ndarray, root: Node | None = None) -> tuple[np.ndarray, np.ndarray]:
    """For each row of points the nearest entry, ties to the lower index, and its squared distance."""
    root = root or tree(book)
    best = np.full(len(points), np.iinfo(np.int64).max, np.int64)
    at = np.full(len(points), len(book), np.int64)

    def visit(node: Node | None, rows: np.ndarray) -> None:
        if node is None or not len(rows):
            return
        away = _squares(points[rows], book[node.entry])
        closer = (away < best[rows]) | ((away == best[rows]) & (node.entry < at[rows]))
        best[rows[closer]], at[rows[closer]] = away[closer], node.entry
        low, high = _down(away), _up(away)

        def near(some: np.ndarray) -> None:
            visit(node.near, rows[some][low[some] - _up(best[rows[some]]) <= node.near_most])

        def far(some: np.ndarray) -> None:
            visit(node.far, rows[some][high[some] + _up(best[rows[some]]) >= node.far_least])

        # the half that a row lies in comes first, which bounds the other
        inside = low <= node.near_most
        near(inside)
        far(~inside)
        far(inside)
        near(~inside)

    visit(root, np.arange(len(points)))
    return at, best


def _scaled(df: DataFrame, vector: str, vec_id: str, label: str) -> DataFrame:
    """(vec_id, label, whole: array of long) of the vectors that are kept."""
    wide = F.col(vector).cast("array<double>")
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))
    fine = wide.isNotNull() & F.forall(wide, finite)
    whole = F.transform(wide, lambda x: F.when(F.abs(x) * SCALE <= LARGEST, F.floor(x * SCALE)).otherwise(F.raise_error(F.lit("a component is too large")).cast("long")))
    kept = df.where(fine).select(F.col(vec_id).alias("vec_id"), F.col(label).alias("label"), whole.alias("whole"))
    first = F.min_by(F.size("whole"), F.struct(F.col("vec_id").isNull(), F.col("vec_id"), F.size("whole")))
    kept = stage(kept, "vectors")
    length = kept.agg(first.alias("n")).first()["n"]
    if length is None:
        return kept
    if length == 0 or length % PARTS:
        raise ValueError(f"vectors of {length} components don't have {PARTS} equal parts")
    return kept.where(F.size("whole") == length)


def _matrix(column: pd.Series) -> np.ndarray:
    if not len(column):
        return np.zeros((0, PARTS), np.int64)
    return np.stack(column.to_numpy()).astype(np.int64, copy=False)


def codebooks(vectors: DataFrame) -> np.ndarray:
    """The final entries, [part, entry, component], of vectors (vec_id, whole).

    Each round is one pass: tasks sum their vectors by part and entry, so that what is gathered has PARTS * ENTRIES rows a task.
    """
    ordered = vectors.orderBy(F.col("vec_id").asc_nulls_last(), "whole").limit(ENTRIES)
    first = np.array([r["whole"] for r in ordered.select("whole").collect()], np.int64)
    books = first.reshape(len(first), PARTS, -1).transpose(1, 0, 2).copy()
    for _ in range(ROUNDS):

        def sums(batches: Iterator[pd.DataFrame], books: np.ndarray = books) -> Iterator[pd.DataFrame]:
            parts, entries, width = books.shape
            roots = [tree(b) for b in books]
            total, count = np.zeros(books.shape, np.int64), np.zeros((parts, entries), np.int64)
            for batch in batches:
                if not len(batch):
                    continue
                points = _matrix(batch["whole"]).reshape(len(batch), parts, width)
                for p in range(parts):
                    at, _ = nearest(points[:, p], books[p], roots[p])
                    for k in range(width):  # whole numbers under 2^53 in a batch
                        total[p, :, k] += np.bincount(at, points[:, p, k], entries).astype(np.int64)
                    count[p] += np.bincount(at, minlength=entries)
            part, entry = np.nonzero(count)
            yield pd.DataFrame({"part": part.astype(np.int32), "entry": entry.astype(np.int32), "n": count[part, entry], "total": list(total[part, entry])})

        width = books.shape[2]
        each = vectors.select("whole").mapInPandas(sums, "part int, entry int, n long, total array<long>")
        found = each.groupBy("part", "entry").agg(F.sum("n").alias("n"), F.array(*(F.sum(F.get("total", F.lit(k))) for k in range(width))).alias("total")).collect()
        for r in found:
            books[r["part"], r["entry"]] = np.array(r["total"], np.int64) // r["n"]
    return books


def compress(df: DataFrame, vector: str = "embedding", vec_id: str = "vec_id", label: str = "label") -> tuple[DataFrame, np.ndarray]:
    """(vec_id, label, code: array of entry numbers, error) of every vector that is kept, and the codebooks."""
    vectors = _scaled(df, vector, vec_id, label)
    if vectors.isEmpty():
        return vectors.select("vec_id", "label", F.array().cast("array<int>").alias("code"), F.lit(0).cast("long").alias("error")), np.zeros((PARTS, 0, 0), np.int64)
    books = codebooks(vectors)

    @F.pandas_udf("code array<int>, error long")
    def coded(whole: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        roots = [tree(b) for b in books]
        for batch in whole:
            points = _matrix(batch).reshape(len(batch), PARTS, -1)
            found = [nearest(points[:, p], books[p], roots[p]) for p in range(PARTS)]
            yield pd.DataFrame({"code": list(np.stack([at for at, _ in found], 1).astype(np.int32)), "error": np.sum([d for _, d in found], axis=0)})

    return vectors.select("vec_id", "label", coded("whole").alias("c")).select("vec_id", "label", "c.*"), books


def decompress(codes: DataFrame, books: np.ndarray, code: str = "code") -> DataFrame:
    """codes with vector: the entries of its code one after another, in the scale of the vectors."""
    table = F.array(*(F.array(*(F.array(*(F.lit(int(x) / SCALE) for x in entry)) for entry in book)) for book in books))
    return codes.withColumn("vector", F.flatten(F.transform(code, lambda e, p: F.get(F.get(table, p), e))))


def with_label_errors(codes: DataFrame) -> DataFrame:
    """codes with label_error: the error summed over equal labels, nulls together.

    The sums are a row a label: broadcast where labels are few, else joined by label, where large labels may be split.
    """
    codes = stage(codes, "codes")
    sums = stage(codes.groupBy("label").agg(F.sum("error").cast("long").alias("label_error")), "labels").withColumnRenamed("label", "__label")
    few = sums.count() <= BROADCAST_LABELS
    return codes.join(F.broadcast(sums) if few else sums, F.col("label").eqNullSafe(F.col("__label"))).drop("__label")


def digest_of(books: np.ndarray) -> str:
    """The SHA-256 of all components, by part, entry and position, joined by commas."""
    return hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()
