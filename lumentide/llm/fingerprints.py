"""Digests of improbable byte windows in chained Bloom filters, and their likeness."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWEST, bucket_udf, key_cuts, mix64, ordered_key, partitions, session_setup, text_buffer

#: Bytes of a window; windows a window is ranked among; times it must be the rarest of them to be selected.
WINDOW, AMONG, SUPPORT = 32, 32, 8
#: Steps of entropy; bits and features of one filter; bits a feature sets.
BIN_SHIFT, BINS, FILTER_BITS, FILTER_FEATURES, FEATURE_BITS = 10, 641, 2048, 160, 5
#: Texts of SHORT bytes or more have the rare windows as features, texts of MIDDLE bytes or fewer all 4-byte windows; those
#: between have both, each in filters of its own, so texts of like length can always be held against each other.
SHORT, MIDDLE, FINE = 160, 512, 0x8000

_COUNT = np.arange(WINDOW + 2)
_NLOGN = np.rint(np.where(_COUNT > 0, _COUNT * np.log2(np.maximum(_COUNT, 1)), 0) * 4096).astype(np.int32)
_STEP = np.append(0, np.diff(_NLOGN)).astype(np.int32)  # what the n-th equal byte adds to the sum of n log n
_TOP = int(_NLOGN[WINDOW])
_MULTIPLIERS = mix64(np.arange(1, WINDOW + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
_PART = 1 << 15


def window_bins(data: np.ndarray) -> np.ndarray:
    """The entropy bin (0 to BINS - 1) of each window of WINDOW bytes, whole counts in fixed point.

    From one window to the next only two byte counts change, so a running sum of their steps gives all entropies.
    """
    n = len(data)
    if n < WINDOW:
        return np.zeros(0, np.int32)
    out = np.empty(n - WINDOW + 1, np.int32)
    for at in range(0, len(out), _PART):  # parts that stay in the cache
        part = data[at : at + _PART + WINDOW - 1]
        m = len(part)
        ahead, behind = np.zeros(m, np.uint8), np.zeros(m, np.uint8)  # equal bytes within a window's length
        for d in range(1, WINDOW):
            same = (part[:-d] == part[d:]).view(np.uint8)
            ahead[:-d] += same
            behind[d:] += same
        total = out[at : at + _PART]
        total[0] = _NLOGN[np.bincount(part[:WINDOW], minlength=256)].sum()
        total[1:] = _STEP[behind[WINDOW:] + 1] - _STEP[ahead[: m - WINDOW] + 1]
        np.cumsum(total, out=total)
        np.subtract(_TOP, total, out=total)
        total >>= BIN_SHIFT
    return out


def _inside(offsets: np.ndarray, n: int, span: int) -> np.ndarray:
    """Whether the `span` bytes from each of the first n positions on lie in one text."""
    edge = np.zeros(n + 1, np.int32)
    np.add.at(edge, np.clip(offsets[1:-1] - span + 1, 0, n), 1)
    np.add.at(edge, np.clip(offsets[1:-1], 0, n), -1)
    return np.cumsum(edge[:-1]) == 0


def bin_counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many windows of these texts have each entropy."""
    bins = window_bins(data)
    return np.bincount(bins[_inside(offsets, len(bins), WINDOW)], minlength=BINS)


def digests(data: np.ndarray, offsets: np.ndarray, ranks: np.ndarray) -> list[bytes]:
    """The digest of each text: filters of FILTER_BITS in a chain, each with 2 bytes before it for its features.

    Of every AMONG windows in a row the rarest (then the leftmost) gets a point; windows with SUPPORT points are the
    features of a text of SHORT bytes or more. A text of MIDDLE bytes or fewer, and one in which no window is rare enough,
    has its 4-byte windows as features, in further filters marked FINE. A text without bytes has none.
    """
    n_rows = len(offsets) - 1
    bins = window_bins(data)
    lengths = np.diff(offsets)
    n = len(bins)
    at, owner = np.zeros(0, np.int64), np.zeros(0, np.int64)
    if n >= AMONG:
        bits = max(1, (n - 1).bit_length())
        key = (ranks[bins] << bits) | np.arange(n)
        if 10 + bits < 31:
            key = key.astype(np.int32)
        least, done = key, 1
        while done < AMONG:  # the least of `done` windows from each on
            step = min(done, AMONG - done)
            least = np.minimum(least[:-step], least[step:])
            done += step
        good = _inside(offsets, len(least), AMONG + WINDOW - 1)
        points = np.bincount(least[good] & ((1 << bits) - 1), minlength=n)
        at = np.flatnonzero(points >= SUPPORT)
        owner = np.searchsorted(offsets, at, side="right") - 1
        keep = lengths[owner] >= SHORT
        at, owner = at[keep], owner[keep]
    hashes = np.zeros(len(at), np.uint64)
    for k in range(WINDOW):
        hashes += (data[at + k].astype(np.uint64) + np.uint64(1)) * _MULTIPLIERS[k]
    fine = np.flatnonzero((lengths > 0) & ((lengths <= MIDDLE) | (np.bincount(owner, minlength=n_rows) == 0)))
    more, whose = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for i in fine:
        text = data[offsets[i] : offsets[i + 1]].astype(np.uint64) + np.uint64(1)
        w = min(4, len(text))
        more.append(np.unique(sum(text[k : len(text) - w + 1 + k] * _MULTIPLIERS[k] for k in range(w))))
        whose.append(np.full(len(more[-1]), i))
    return [x + y for x, y in zip(_filters(hashes, owner, n_rows, 0), _filters(np.concatenate(more), np.concatenate(whose), n_rows, FINE), strict=True)]


def _filters(hashes: np.ndarray, owner: np.ndarray, n_rows: int, mark: int) -> list[bytes]:
    """The chain of filters of each row's features (owner: their rows, ascending)."""
    hashes = mix64(hashes)
    first = np.searchsorted(owner, np.arange(n_rows + 1))
    number = np.arange(len(owner)) - first[owner] if len(owner) else owner
    chain = -(-np.diff(first) // FILTER_FEATURES)
    base = np.append(0, np.cumsum(chain))
    where = base[owner] + number // FILTER_FEATURES if len(owner) else owner
    bits = np.zeros((int(base[-1]), FILTER_BITS), bool)
    for k in range(FEATURE_BITS):
        bits[where, ((hashes >> np.uint64(12 * k)) & np.uint64(FILTER_BITS - 1)).astype(np.int64)] = True
    packed = np.packbits(bits, axis=1)
    counts = (np.bincount(where, minlength=int(base[-1])) | mark).astype("<u2")
    whole = np.concatenate([counts.view(np.uint8).reshape(-1, 2), packed], axis=1)
    size = whole.shape[1]
    raw = whole.tobytes()
    return [raw[size * a : size * b] for a, b in zip(base[:-1].tolist(), base[1:].tolist(), strict=True)]


_SIZE = 2 + FILTER_BITS // 8


def likeness(a: bytes, b: bytes) -> float:
    """How alike two digests are, 0 to 1: the filters' bit overlap between what chance gives and the most there can be.

    Each filter of the digest with fewer features is held against all of the other's; the best count, weighted by
    features. Two digests without features are alike (1); one without and one with are not (0), nor are two
    of texts so unequal in length that they have no kind of features in common.
    """
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    x, y = (np.frombuffer(v, np.uint8).reshape(-1, _SIZE) for v in (a, b))
    nx, ny = (np.ascontiguousarray(v[:, :2]).view("<u2")[:, 0].astype(np.int64) for v in (x, y))
    for mark in (0, FINE):  # the rare windows if both have them, else the short ones
        mx, my = (nx & FINE) == mark, (ny & FINE) == mark
        if mx.any() and my.any():
            break
    else:
        return 0.0
    x, y, nx, ny = x[mx], y[my], nx[mx] & ~FINE, ny[my] & ~FINE
    if nx.sum() > ny.sum():
        x, y, nx, ny = y, x, ny, nx
    bx, by = (np.unpackbits(np.ascontiguousarray(v[:, 2:]), axis=1).astype(np.float32) for v in (x, y))
    sx, sy = bx.sum(1), by.sum(1)
    both = bx @ by.T
    chance = sx[:, None] * sy[None, :] / FILTER_BITS
    most = np.minimum(sx[:, None], sy[None, :])
    # A filter with few features can overlap no more than these allow: the rest of its partner is no difference.
    score = np.clip((both - chance) / np.maximum(most - chance, 1e-9), 0, 1)
    # As a later filter may hold only part of what one of the other digest holds, the overlaps add up.
    if len(y) > 1:
        score = np.maximum(score.max(1), np.clip((both - chance).sum(1) / np.maximum(sx - sx * by.max(0).sum() / FILTER_BITS, 1e-9), 0, 1))
    else:
        score = score[:, 0]
    return float(min(1.0, (score * nx).sum() / nx.sum()))


def entropy_ranks(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Ranks the entropies of all windows of all texts by rarity, 0 the rarest; windows of hardly any entropy come last.

    What is gathered is a count for each of BINS entropies, however many the texts.
    """
    session_setup(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BINS, np.int64)
        for batch in batches:
            total += bin_counts(*text_buffer(batch.column(0)))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some], pa.int64())], names=["bin", "n"])

    counts = np.zeros(BINS, np.int64)
    for r in docs.select(text).mapInArrow(count, "bin long, n long").groupBy("bin").agg(F.sum("n").alias("n")).collect():
        counts[r.bin] = r.n
    low = np.arange(BINS) < BINS // 4
    order = np.lexsort((np.arange(BINS)[::-1], counts, low))
    ranks = np.empty(BINS, np.int64)
    ranks[order] = np.arange(BINS)
    return ranks


def fingerprint(docs: DataFrame, ranks: np.ndarray | None = None, text: str = "text", into: str = "fingerprint") -> DataFrame:
    """Adds the digest (base64) of every whole text; null counts as empty, whose digest is empty. Equal texts: equal digests."""
    ranks = entropy_ranks(docs, text) if ranks is None else ranks
    fields = docs.select("*", F.lit("").alias(into)).schema if into not in docs.columns else docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(text))
            got = [base64.b64encode(x).decode() for x in digests(*text_buffer(column), ranks)]
            cols = [batch.column(i) for i, f in enumerate(batch.schema) if f.name != into]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(got, pa.string())], names=[*(f.name for f in batch.schema if f.name != into), into])

    return docs.drop(into).mapInArrow(run, fields)


def next_rows(docs: DataFrame, key: str, text: str, run, schema: str, extra: int = 0) -> DataFrame:
    """Gives run(rows) the texts in descending key order, as an iterator of (key, text, next text); the last's next is the first.

    Keys are cut into ranges; the first row of each range is also sent to the range before it, so every range has
    the next of its last row. Texts are shuffled once, none of them goes to the driver, and a task holds a batch.
    """
    spark = docs.sparkSession
    session_setup(spark)
    n = partitions(spark)
    rows = docs.select(ordered_key(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    cuts = np.unique(key_cuts(rows.select("k"), "k", 8 * n))
    bucket = bucket_udf(cuts)
    placed = rows.withColumn("b", bucket("k", F.lit(0).cast("long")))
    heads = {r.b: r.k for r in rows.select("k").withColumn("b", bucket("k", F.lit(0).cast("long"))).groupBy("b").agg(F.max("k").alias("k")).collect()}
    order = sorted(heads, reverse=True)  # the order in which the ranges come
    before = {b: order[i - 1] for i, b in enumerate(order)}  # the highest range's head goes to the lowest

    @F.pandas_udf("int")
    def goes_to(k: pd.Series, b: pd.Series) -> pd.Series:
        """The range that also needs this row, or -1."""
        top = b.map(heads).to_numpy(np.int64)
        return pd.Series(np.where(k.to_numpy(np.int64) == top, b.map(before).to_numpy(np.int64), -1).astype(np.int32))

    both = F.array(F.struct(F.col("b").alias("b"), F.lit(False).alias("guest")), F.struct(F.col("g").alias("b"), F.lit(True).alias("guest")))
    copies = placed.withColumn("g", goes_to("k", "b")).select("k", "t", F.explode(F.when(F.col("g") >= 0, both).otherwise(F.slice(both, 1, 1))).alias("p")).select("p.b", "p.guest", "k", "t")
    # Rows that share a key come by text, so that the first of them is the same wherever it is sent.
    dealt = copies.repartition(n, "b").sortWithinPartitions("b", "guest", F.desc("k"), "t")

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, str, str]]:
        held = None
        for batch in batches:
            for b, guest, k, t in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held is not None and held[0] == b:
                    yield held[1], held[2], t
                held = None if guest else (b, k, t)

    return dealt.mapInArrow(lambda batches: run(pairs(batches)), schema)


def fingerprints_of_edits(docs: DataFrame, key: str = "doc_id", text: str = "text", batch: int = 128) -> DataFrame:
    """Fingerprints every whole text and its edited text, whose last third comes from the next text in descending key order.

    The last floor(n/3) of a text's n code points give way to the first as many (or all) of the next text. Null text
    is empty. A single row is its own next. An empty table gives no rows. Rows that share a key come by text.
    Returns key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.
    """
    ranks = entropy_ranks(docs, text)

    def run(rows: Iterator[tuple[int, str, str]]) -> Iterator[pa.RecordBatch]:
        def made(group: list[tuple[int, str, str]]) -> pa.RecordBatch:
            keys = [k for k, _, _ in group]
            own = [t for _, t, _ in group]
            cut = [len(t) // 3 for t in own]
            edited = [t[: len(t) - c] + x[:c] for (_, t, x), c in zip(group, cut, strict=True)]
            follows = [group[-1][2]]
            got = digests(*text_buffer(pa.array(own + edited + follows, pa.large_string())), ranks)
            m = len(group)
            a, e, after = got[:m], got[m : 2 * m], got[1:m] + got[2 * m :]
            # Where a range ends inside the group, the next text is not the group's next row.
            for i in range(m - 1):
                if group[i][2] != own[i + 1]:
                    after[i] = digests(*text_buffer(pa.array([group[i][2]], pa.large_string())), ranks)[0]
            show = lambda v: [base64.b64encode(x).decode() for x in v]
            cols = [pa.array([None if k == LOWEST else k for k in keys], pa.int64()), pa.array([len(t) for t in own], pa.int64()), pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited]), pa.array(show(a)), pa.array(show(e)), pa.array([likeness(x, y) for x, y in zip(a, e, strict=True)]), pa.array([likeness(x, y) for x, y in zip(a, after, strict=True)])]
            return pa.RecordBatch.from_arrays(cols, names=["k", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

        group: list[tuple[int, str, str]] = []
        size = 0
        for row in rows:
            group.append(row)
            size += len(row[1])
            if len(group) >= batch or size > 1 << 20:
                yield made(group)
                group, size = [], 0
        if group:
            yield made(group)

    out = next_rows(docs, key, text, run, "k long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    return out.withColumnRenamed("k", key)
