"""Vectors as short codes: a codebook for each part position, nearest entries found in vantage-point trees."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored
from .vectors import dimension, integers, whole

#: Entries of a node that is searched as a whole.
LEAF = 3
#: What an error that a long can't hold is given as.
MOST_ERROR = (1 << 63) - 1
_SPLIT = 1 << 60


def _wide(size: int, length: int) -> bool:
    """Whether squared distances of components up to this size may need more than 62 bits."""
    return (2 * int(size) + 1) ** 2 * max(1, length) >= 1 << 62


def _root(square: np.ndarray) -> np.ndarray:
    """Integer square roots, rounded down."""
    if square.dtype == object:
        return np.array([math.isqrt(x) for x in square], dtype=object)
    root = np.sqrt(square.astype(np.float64)).astype(np.int64)
    root -= root * root > square
    return root + ((root + 1) * (root + 1) <= square)


class VantageTree:
    """Nearest entries by Euclidean distance, ties to the lower index, exact for integers.

    A node measures the distances from its vantage entry, and splits the others at their median into a near and a far
    child, which keep the least and greatest of these distances rounded outwards. By the triangle inequality a child is no
    nearer than its bound, with the point's own distance rounded towards it; it is visited unless that bound, squared, is greater
    than the best squared distance so far, so ties are met. What decides are squared distances in integers.
    """

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        self.top = self._node(np.arange(len(entries)))

    def _node(self, which: np.ndarray):
        if len(which) <= LEAF:
            return which
        apart = ((self.entries[which][:, None] - self.entries[which][None]) ** 2).sum(axis=2)
        at = int(np.argmax(apart.sum(axis=1)))
        rest, squares = np.delete(which, at), np.delete(apart[at], at)
        order = np.argsort(squares, kind="stable")
        half = len(rest) // 2
        return int(which[at]), [self._child(rest[part], squares[part]) for part in (order[:half], order[half:])]

    def _child(self, which: np.ndarray, squares: np.ndarray):
        ends = np.array([squares.min(), squares.max()], dtype=squares.dtype)
        low, high = _root(ends)
        return low, high + (high * high < ends[1]), self._node(which)

    def search(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each point the index of its nearest entry and the squared distance."""
        index = np.full(len(points), -1, np.int64)
        best = np.zeros(len(points), points.dtype)

        def measure(rows: np.ndarray, entry: int) -> np.ndarray:
            square = ((points[rows] - self.entries[entry]) ** 2).sum(axis=1)
            if not points.shape[1]:
                square = np.zeros(len(rows), points.dtype)
            better = (index[rows] < 0) | (square < best[rows]) | ((square == best[rows]) & (entry < index[rows]))
            index[rows[better]], best[rows[better]] = entry, square[better]
            return square

        def visit(node, rows: np.ndarray) -> None:
            if not len(rows):
                return
            if isinstance(node, np.ndarray):
                for entry in node:
                    measure(rows, int(entry))
                return
            vantage, children = node
            square = measure(rows, vantage)
            below = _root(square)
            above = below + (below * below < square)
            bounds = [np.maximum(np.maximum(below - high, low - above), 0) for low, high, _ in children]
            near = bounds[0] <= bounds[1]
            for mine, order in ((near, (0, 1)), (~near, (1, 0))):
                for child in order:
                    take = mine & (bounds[child] * bounds[child] <= best[rows])
                    visit(children[child][2], rows[take])

        visit(self.top, np.arange(len(points)))
        return index, best


@dataclass
class Codebooks:
    """For each part position its entries, a row each; what is broadcast has parts * entries * length numbers, whatever the input."""

    scale: int
    dim: int
    books: list[np.ndarray]

    def digest(self) -> str:
        return hashlib.sha256(",".join(str(int(x)) for book in self.books for x in book.ravel()).encode()).hexdigest()


def _assigned(codebooks: Codebooks):
    """Function of a column of vectors: their integers by part, the nearest entries and squared distances, (rows, parts) each."""
    trees: dict[bool, list[VantageTree]] = {}
    length = codebooks.dim // len(codebooks.books)
    size = max([0, *(abs(int(x)) for book in codebooks.books for x in (book.max(initial=0), book.min(initial=0)))])

    def assign(column: pa.Array):
        x = integers(column, codebooks.dim, codebooks.scale)
        wide = x.dtype == object or _wide(max(size, int(np.abs(x).max(initial=0))), length)
        if wide not in trees:
            trees[wide] = [VantageTree(book.astype(object if wide else np.int64)) for book in codebooks.books]
        x = x.astype(object if wide else np.int64).reshape(len(x), len(codebooks.books), length)
        found = [tree.search(x[:, part]) for part, tree in enumerate(trees[wide])]
        return x, np.stack([f[0] for f in found], axis=1), np.stack([f[1] for f in found], axis=1)

    return assign


def fit(rows: DataFrame, key: str, vector: str, parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> Codebooks:
    """Fits a codebook for each part on all rows, which hold whole vectors only.

    Each starts as that part of the `entries` smallest keys (nulls last, equal keys by their vectors; fewer where there are
    fewer rows) and goes through `rounds` rounds: parts go to their nearest entries, an entry becomes floor(sum / count) of its parts.
    A task adds up its own rows; sums of entries are all that the driver sees.
    """
    dim = -(-dimension(rows, vector) // parts) * parts
    length = dim // parts
    first = rows.select(F.col(key).alias("k"), F.col(vector).alias("v")).orderBy(F.col("k").asc_nulls_last(), "v").limit(entries)
    first = integers(pa.array([r.v for r in first.collect()], pa.list_(pa.float64())), dim, scale)
    codebooks = Codebooks(scale, dim, [first[:, p * length : (p + 1) * length] for p in range(parts)])
    n = len(first)
    if not n or not dim:
        return codebooks
    schema = "part int, entry int, place int, high decimal(38,0), low long, n long"

    for _ in range(rounds):
        def totals(batches: Iterator[pa.RecordBatch], codebooks: Codebooks = codebooks) -> Iterator[pa.RecordBatch]:
            assign, sums, counts = _assigned(codebooks), np.zeros((parts, n, length), object), np.zeros((parts, n), np.int64)
            for batch in batches:
                x, index, _ = assign(batch.column(0))
                small = x.dtype != object and np.abs(x).max(initial=0) < 1 << 40  # sums of a batch, 2^20 rows at most, then fit
                for p in range(parts):
                    counts[p] += np.bincount(index[:, p], minlength=n)
                    part = np.zeros((n, length), np.int64 if small else object)
                    np.add.at(part, index[:, p], x[:, p])
                    sums[p] += part.astype(object)
            at = np.argwhere(counts[:, :, None].repeat(length, axis=2) > 0)
            if len(at):
                split = [divmod(int(sums[tuple(a)]), _SPLIT) for a in at]
                columns = [pa.array(at[:, i].astype(np.int32)) for i in range(3)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array([s[0] for s in split]).cast(pa.decimal128(38, 0)), pa.array([s[1] for s in split], pa.int64()), pa.array(counts[at[:, 0], at[:, 1]])], ["part", "entry", "place", "high", "low", "n"])

        summed = rows.select(vector).mapInArrow(totals, schema).groupBy("part", "entry", "place").agg(F.sum("high").alias("high"), F.sum(F.col("low").cast("decimal(38,0)")).alias("low"), F.sum("n").alias("n"))
        books = [book.astype(object) for book in codebooks.books]
        for r in summed.collect():  # parts * entries * length rows at most
            books[r.part][r.entry, r.place] = (int(r.high) * _SPLIT + int(r.low)) // r.n
        codebooks = Codebooks(scale, dim, books)
    return codebooks


def encode(rows: DataFrame, codebooks: Codebooks, key: str, vector: str, label: str) -> DataFrame:
    """Each row's key, label, code (two hex digits for each part) and error; rows hold whole vectors only."""
    kinds = dict(rows.dtypes)

    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        assign = _assigned(codebooks)
        for batch in batches:
            if batch.num_rows:
                _, index, square = assign(batch.column(2))
                code = ["".join(f"{i:02x}" for i in row) for row in index.tolist()]
                error = [min(sum(row), MOST_ERROR) for row in square.tolist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(code, pa.string()), pa.array(error, pa.int64())], ["key", "label", "code", "error"])

    picked = rows.select(F.col(key).alias("key"), F.col(label).alias("label"), F.col(vector).alias("vector"))
    return picked.mapInArrow(codes, f"key {kinds[key]}, label {kinds[label]}, code string, error long")


def decode(codes: DataFrame, codebooks: Codebooks) -> DataFrame:
    """Adds `decoded`, the vector of entries that a code names, scaled back."""
    books = F.array(*[F.array(*[F.array(*[F.lit(float(x) / codebooks.scale) for x in entry]) for entry in book]) for book in codebooks.books])
    at = lambda p: F.conv(F.substring("code", 2 * p + 1, 2), 16, 10).cast("int") + 1
    return codes.withColumn("decoded", F.concat(*[F.element_at(F.element_at(books, p + 1), at(p)) for p in range(len(codebooks.books))]))


def compress(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> DataFrame:
    """Codes of all vectors by codebooks fitted on all of them.

    Rows whose vector is null or holds a null or non-finite component are dropped. Vectors shorter than the longest, and a length
    that parts don't divide, count as followed by zeros. Repeated rows each have their own; an empty table gives no rows; a null label is one more
    label; other columns, whatever their names, are not read. Distances are exact whatever the components' size; an error
    beyond a long is given as the greatest long.

    Returns key, code, error (squared distances summed over parts), label_error (errors summed over equal labels), codebooks_sha256.
    """
    if entries > 256:
        raise ValueError("two hex digits tell 256 entries")
    kept = stored(vectors.where(whole(vector)).select(F.col(key).alias("k"), F.col(vector).alias("v"), F.col(label).alias("l")), "code-vectors")
    codebooks = fit(kept, "k", "v", parts, entries, rounds, scale)
    coded = stored(encode(kept, codebooks, "k", "v", "l"), "codes")
    # A table's size is known, so Spark sends it to all executors only where it is small; else it splits the rows of a hot label.
    labels = stored(coded.groupBy("label").agg(F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(MOST_ERROR).cast("decimal(38,0)")).cast("long").alias("label_error")), "code-labels")
    out = coded.join(labels.withColumnRenamed("label", "other"), F.col("label").eqNullSafe(F.col("other")))
    return out.select(F.col("key").alias(key), "code", "error", "label_error", F.lit(codebooks.digest()).alias("codebooks_sha256"))
