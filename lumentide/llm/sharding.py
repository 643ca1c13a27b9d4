"""Contiguous shards of near-equal bytes, cut from global prefix sums."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWEST, bucket_udf, key_cuts, ordered_key, partitions, session_setup, sha, stored


def assign_shards(docs: DataFrame, shards: int = 16, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Deals all rows into `shards` contiguous shards of near-equal bytes.

    Rows are ordered by key, nulls first; the order of rows with one key is arbitrary but kept. The
    narrow rows (key, size, checksum) go into ordered buckets; bucket totals give each bucket the bytes and
    rows before it, and a running sum inside the bucket gives each row its place. A row goes to the shard in
    whose equal share of all bytes its middle byte lies, so a shard misses its target by no more than a row.

    Size is the UTF-8 bytes of the text plus 1; null text counts as no bytes. An empty table gives no rows.
    Other columns of docs, whatever their names, are not touched; join on the key to get them.
    Returns key, size, text_crc32, shard, slot (gapless from 0 in each shard), before (bytes of all rows before).
    """
    spark = docs.sparkSession
    session_setup(spark)
    rows = docs.select(ordered_key(key).alias("k"), (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"), F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("crc"))
    rows = stored(rows.withColumn("salt", F.pmod(sha("crc", F.monotonically_increasing_id()), F.lit(1 << 20))), "shard-rows")
    n = partitions(spark)
    cuts = key_cuts(rows, "k", 8 * n)
    # The salt spreads a key that very many rows share; it is stored, so a rerun task sees the same.
    bucketed = rows.withColumn("b", bucket_udf(cuts)("k", F.col("salt")))
    totals = {r.b: (r.bytes, r.rows) for r in bucketed.groupBy("b").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")).collect()}
    base, bytes_before, rows_before = {}, 0, 0
    for b in sorted(totals):
        base[b] = (bytes_before, rows_before)
        bytes_before, rows_before = bytes_before + totals[b][0], rows_before + totals[b][1]
    total = max(1, bytes_before)

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, at = None, (0, 0)
        for frame in frames:
            for b, part in frame.groupby("b", sort=False):
                if b != now:
                    now, at = b, base[b]
                size = part["size"].to_numpy(np.int64)
                end = at[0] + np.cumsum(size)
                before = end - size
                shard = np.minimum(shards - 1, (before + end).astype(object) * shards // (2 * total)).astype(np.int32)
                yield pd.DataFrame({"k": part["k"], "size": size, "crc": part["crc"], "shard": shard, "at": at[1] + np.arange(len(part)), "before": before})
                at = (int(end[-1]), at[1] + len(part))

    placed = bucketed.repartition(n, "b").sortWithinPartitions("b", "k", "size", "crc").mapInPandas(place, "k long, size long, crc long, shard int, at long, before long")
    placed = stored(placed, "shard-places")
    first = {r.shard: r.first for r in placed.groupBy("shard").agg(F.min("at").alias("first")).collect()}  # a row for each shard
    starts = F.create_map(*[x for s, f in first.items() for x in (F.lit(s), F.lit(f))]) if first else None
    slot = F.col("at") - F.element_at(starts, F.col("shard")) if first else F.col("at")
    return placed.select(F.nullif(F.col("k"), F.lit(LOWEST)).alias(key), "size", F.col("crc").alias("text_crc32"), "shard", slot.alias("slot"), "before")


def write_shards(docs: DataFrame, path: str, shards: int = 16, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Writes docs, with its shard, as one folder for each shard; rows of a shard are dealt over several files. Repeated keys are an error."""
    if not docs.groupBy(key).agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        raise ValueError("a key that several rows share can't tell their shards")
    where = assign_shards(docs, shards, key, text).select(F.col(key).alias("__key"), F.col("shard").alias("__shard"))
    joined = docs.join(where, docs[key].eqNullSafe(where["__key"]), "left").drop("__key")
    joined.repartition(F.col("__shard"), F.pmod(sha(F.col(key)), F.lit(16))).write.partitionBy("__shard").parquet(path)
    return docs.sparkSession.read.parquet(path)
