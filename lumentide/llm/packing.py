"""Packing documents into windows of near-equal length by multiway differencing."""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import session_setup, sha, stored
from .tokens import LeadEncoder

#: Rests of documents are cut into pieces of at most this share of a window, so that several meet in each.
PIECE_SHARE = 4
#: Windows that are filled together.
BLOCK_WINDOWS = 192


def differencing(sizes: np.ndarray, windows: int) -> np.ndarray:
    """Deals sizes into windows of near-equal sums by the largest differencing method; gives each size's window.

    Every size starts as a partial partition of its own. The two with the largest imbalances are merged, the
    largest sum of one with the smallest of the other, until one is left.
    """
    n = len(sizes)
    if not n:
        return np.zeros(0, np.int64)
    parent = np.arange(n)
    heap = []
    for i, x in enumerate(sizes.tolist()):
        heap.append((-x, i, np.array([x], np.int64), np.array([i], np.int64)))  # sums descending; empty windows aren't stored
    heapq.heapify(heap)
    order = n
    while len(heap) > 1:
        _, _, a, ra = heapq.heappop(heap)
        _, _, b, rb = heapq.heappop(heap)
        overlap = len(a) + len(b) - windows  # so many windows get something from both
        if overlap > 0:  # a's empty windows take b's largest sums, a's smallest sums the rest of b's
            alone = windows - len(a)
            sums, roots = a.copy(), ra
            at = np.arange(len(a) - 1, len(a) - 1 - overlap, -1)
            sums[at] += b[alone:]
            parent[rb[alone:]] = ra[at]
            sums, roots = np.concatenate([sums, b[:alone]]), np.concatenate([roots, rb[:alone]])
        else:
            sums, roots = np.concatenate([a, b]), np.concatenate([ra, rb])
        by = np.argsort(-sums, kind="stable")
        sums, roots = sums[by], roots[by]
        spread = sums[0] - (sums[-1] if len(sums) == windows else 0)
        heapq.heappush(heap, (-int(spread), order, sums, roots))
        order += 1
    while (up := parent[parent]).tobytes() != parent.tobytes():
        parent = up
    return np.unique(parent, return_inverse=True)[1]


def fill_windows(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The window of each size: as few windows as the total needs, more whenever a window would exceed its capacity."""
    windows = max(1, -(-int(sizes.sum()) // capacity))
    while True:
        at = differencing(sizes, windows)
        if not len(at) or np.bincount(at, sizes).max() <= capacity:
            return at
        windows += 1


PIECE_SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 1, key: str = "doc_id", text: str = "text", keep_ids: bool = False) -> DataFrame:
    """Packs all documents' token ids into sequences of at most `capacity` ids with little padding.

    A document is its ids and end_id (null text: empty, so end_id alone). It is cut into full windows, which
    stand alone, and a rest, cut into near-equal pieces of at most a quarter of a window. Rest pieces are dealt
    by hash into blocks of about BLOCK_WINDOWS windows, each block is split by differencing into as many windows
    as its total needs, and the count rises while one exceeds the capacity. Rows that share a key are packed each
    for itself. An empty table gives no rows.

    Returns for each piece: key, start (its document's ids before it), length, ids_crc32, doc_tokens, sequence_id,
    offset (in the sequence, gapless from 0) and, if keep_ids, the ids (binary, little-endian 32-bit).
    """
    spark = docs.sparkSession
    session_setup(spark)
    most = max(1, capacity // PIECE_SHARE)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = LeadEncoder.get(tokenizer)
        for batch in batches:
            rows = []
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = np.append(encoder.encode(t or ""), np.uint32(end_id)).astype("<u4")
                n = len(ids)
                full = n // capacity
                rest = n - full * capacity
                parts = -(-rest // most)
                cuts = [*range(0, full * capacity, capacity), *(full * capacity + (rest * i) // parts for i in range(parts)), n]
                raw = ids.tobytes()
                for a, b in zip(cuts, cuts[1:], strict=False):
                    piece = raw[4 * a : 4 * b]
                    rows.append((k, a, b - a, zlib.crc32(piece), n, piece if keep_ids else None))
            cols = list(zip(*rows, strict=True)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if i == 5 else pa.int64()) for i, c in enumerate(cols)], names=["k", "start", "length", "crc", "n", "ids"])

    pieces = docs.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t")).mapInArrow(cut, "k long, start long, length long, crc long, n long, ids binary")
    pieces = stored(pieces.withColumn("row", F.monotonically_increasing_id()), "pieces")  # the number is stored, so all plans see the same
    rest = F.col("length") < capacity
    total = pieces.where(rest).agg(F.sum("length")).first()[0] or 0
    blocks = max(1, round(total / (BLOCK_WINDOWS * capacity)))

    def fill(table: pa.Table) -> pa.Table:
        """Adds window and offset to a block's pieces; other columns, keys and nulls among them, stay as they are."""
        table = table.combine_chunks().sort_by([("k", "ascending"), ("start", "ascending"), ("row", "ascending")])
        size = table["length"].to_numpy()
        window = fill_windows(size, capacity)
        by = np.argsort(window, kind="stable")
        size, window = size[by], window[by]
        before = np.cumsum(size) - size
        first = np.flatnonzero(np.append(True, window[1:] != window[:-1]))
        offset = before - np.repeat(before[first], np.diff(np.append(first, len(size))))
        table = table.take(pa.array(by))
        return table.append_column("window", pa.array(window, pa.int64())).append_column("offset", pa.array(offset, pa.int64()))

    # Ids don't go through Python again; where they are wanted they are joined on the piece's number.
    columns = ["k", "start", "length", "crc", "n", "row"]
    dealt = pieces.where(rest).select(*columns, F.pmod(sha("k", "start", "row"), F.lit(blocks)).alias("block"))
    names = [F.col("k").alias(key), "start", "length", F.col("crc").alias("ids_crc32"), F.col("n").alias("doc_tokens")]
    alone = pieces.where(~rest).select(*names, (F.col("row") * 2 + 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"), "ids")
    packed = dealt.groupBy("block").applyInArrow(fill, f"{', '.join(f'{c} long' for c in columns)}, block long, window long, offset long")
    packed = packed.join(pieces.select("row", "ids"), "row") if keep_ids else packed.withColumn("ids", F.lit(None).cast("binary"))
    packed = packed.select(*names, (F.shiftleft("block", 32) + F.col("window") * 2).alias("sequence_id"), "offset", "ids")
    out = packed.unionByName(alone)
    return out if keep_ids else out.drop("ids")


def sequences(packed: DataFrame) -> DataFrame:
    """The token ids of each sequence (binary, 32-bit), from pack_documents(..., keep_ids=True). A sequence holds at most `capacity` ids."""
    ordered = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(ordered.alias("p")).select("sequence_id", F.expr("aggregate(p, cast('' as binary), (a, x) -> concat(a, x.ids))").alias("ids"))
