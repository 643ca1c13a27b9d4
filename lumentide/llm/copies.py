"""Families of near copies by sketches of their word pairs, for operators in which a family should count as one text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, mix64, stored, text_buffer
from .jaccard import _components, shingle_hashes

#: Words of a shingle; with two, a changed word takes two shingles away.
SHINGLE = 2
#: Least hashes in a sketch, and how many of them make a band: texts that agree in a band are compared.
HASHES, BAND = 48, 4
#: Share of equal least hashes, an estimate of the Jaccard similarity, from which texts are linked.
LIKE = 0.65
_PORTION = 1 << 20


def text_key(text: str):
    """A text's hash, of 63 bits; null counts as empty."""
    return F.xxhash64(F.coalesce(F.col(text), F.lit(""))).bitwiseAND(F.lit((1 << 63) - 1))


def sketches(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The least of each of HASHES hash functions over a text's shingles; a row of zeros for a text without words."""
    h, begin = shingle_hashes(data, offsets, SHINGLE)
    h = (h >> np.uint64(32)).astype(np.uint32)
    some = np.flatnonzero(begin[1:] > begin[:-1])
    out = np.zeros((len(begin) - 1, HASHES), np.uint32)
    odd = (mix64(np.arange(1, 2 * HASHES + 1, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32)
    for i in range(HASHES if len(some) else 0):
        x = (h ^ odd[2 * i + 1]) * (odd[2 * i] | np.uint32(1))
        x ^= x >> np.uint32(15)
        out[some, i] = np.minimum.reduceat(x * np.uint32(0x2C1B3C6D), begin[:-1][some])
    return out


def near_copies(docs: DataFrame, text: str = "text") -> DataFrame:
    """The different texts of docs that have copies or near copies, each with its family.

    Texts that agree in a band of their sketches are held against the one with the least hash among them; where the sketches agree in
    LIKE of their hashes the two are linked, and what is linked makes a family. It is an estimate: of texts that share
    80 % of their word pairs one link in about 500 is missed. Null, empty and wordless texts have no near copies.

    Returns text_key, family (the least text_key in it), rows (of this text), texts (different ones in the family), for rows * texts > 1.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffer(batch.column(0))
            at, parts = 0, []
            while at < batch.num_rows:  # some rows at a time, so that hashes of a batch of long texts stay few
                to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + _PORTION, side="right")) - 1)
                parts.append(sketches(data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]))
                at = to
            if not parts:
                continue
            sketch = np.concatenate(parts)
            words = sketch.any(axis=1)
            bands = sketch.reshape(len(sketch), -1, BAND).astype(np.uint64)
            code = np.tile(np.arange(1, bands.shape[1] + 1, dtype=np.uint64), (len(sketch), 1))
            for i in range(BAND):
                code = mix64(code * np.uint64(0x9E3779B97F4A7C15) + bands[:, :, i])
            short = pa.array([row.tobytes() for row in (sketch & np.uint32(255)).astype(np.uint8)], pa.binary())
            lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(words * code.shape[1])).astype(np.int32)), pa.array(code[words].view(np.int64).ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(1), short, lists], names=["text_key", "sketch", "bands"])

    taken = docs.select(F.col(text), text_key(text)).mapInArrow(run, "text_key long, sketch binary, bands array<long>")
    texts = stored(taken.groupBy("text_key").agg(F.count("*").alias("rows"), F.first("sketch").alias("sketch"), F.first("bands").alias("bands")), "sketches")
    entries = texts.select("text_key", F.explode("bands").alias("band"))
    heads = entries.groupBy("band").agg(F.min("text_key").alias("head"), F.count("*").alias("n")).where("n > 1").select("band", "head")
    pairs = entries.join(heads, "band").where("text_key <> head").select("text_key", "head").distinct()

    def alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(-1, HASHES) for i in (2, 3))
            yield batch.filter(pa.array((a == b).mean(axis=1) >= LIKE)).select([0, 1])

    left = texts.select("text_key", F.col("sketch").alias("x"))
    right = texts.select(F.col("text_key").alias("head"), F.col("sketch").alias("y"))
    met = pairs.join(left, "text_key").join(right, "head").select("text_key", "head", "x", "y")
    links = stored(met.mapInArrow(alike, "a long, b long"), "links")
    if links.isEmpty():
        families = texts.select("text_key", F.col("text_key").alias("family"), "rows", F.lit(1).cast("long").alias("texts"))
    else:
        comps = _components(links)
        known = texts.select("text_key", "rows").join(comps.select(F.col("node").alias("text_key"), "comp"), "text_key", "left")
        sizes = stored(comps.groupBy("comp").agg(F.count("*").alias("texts")), "family-sizes")
        families = known.join(sizes, "comp", "left").select("text_key", F.coalesce("comp", "text_key").alias("family"), "rows", F.coalesce("texts", F.lit(1)).alias("texts"))
    out = stored(families.where(F.col("rows") * F.col("texts") > 1), "families")
    dropped(texts)
    dropped(links)
    return out
