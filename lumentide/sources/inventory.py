"""Listings of files: names and sizes without their content."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumentide.operators.pairing import by_prefix

#: Bytes of a file that a task holds at a time.
PART = 1 << 22


def listing(spark: SparkSession, path: str, rules: list[tuple[str, str]] | None = None) -> DataFrame:
    """Every file below path: rel_path, suffix, size_bytes, and a category by prefix; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", F.col("length").alias("size_bytes"))
    root = path.split("://")[-1].rstrip("/") + "/"
    rel = F.substring_index(F.regexp_replace("path", r"^[a-z]+:/+", "/"), root, -1)
    out = files.select("path", rel.alias("rel_path"), F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).alias("suffix"), "size_bytes")
    return out.withColumn("category", by_prefix(F.col("rel_path"), rules) if rules else F.lit("unclassified"))


def summary(files: DataFrame, by: str) -> DataFrame:
    """Number, megabytes and first path of each category."""
    return files.groupBy(by).agg(F.count("*").alias("n"), (F.sum("size_bytes") / 1e6).alias("mb"), F.min("path").alias("first"))


def manifest(spark: SparkSession, path: str, roles: list[tuple[str, str]]) -> DataFrame:
    """Every file's checksum, kind by suffix, and role by a part of its name; a broken one (no bytes) is told by its status.

    Tasks read their files in parts, so a file can be of any size.
    """
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = []
            for p in batch.column(0).to_pylist():
                store, at = fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", p))
                total = hashlib.sha256()
                with store.open_input_stream(at) as stream:
                    while part := stream.read(PART):
                        total.update(part)
                sums.append(total.hexdigest())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sums, pa.string())], ["path", "length", "sha256"])

    files = listed.mapInArrow(run, "path string, length long, sha256 string")
    name = F.lower("path")
    role = F.coalesce(*(F.when(name.contains(part), what) for part, what in roles), F.lit("other"))
    kind = F.when(name.rlike(r"\.(py|r|sh|ps1|mjs)$"), "code").when(name.rlike(r"\.(png|jpe?g|tiff?|gif|svg)$"), "image").when(name.rlike(r"\.(csv|parquet|json|xlsx)$"), "table").otherwise("other")
    return files.select("path", kind.alias("kind"), role.alias("role"), "sha256", F.when(F.col("length") == 0, "empty").otherwise("ok").alias("status"))


def changed(before: DataFrame, after: DataFrame) -> DataFrame:
    """Paths whose checksum differs between two manifests, or that only one has: empty if nothing was touched."""
    j = before.select("path", F.col("sha256").alias("a")).join(after.select("path", F.col("sha256").alias("b")), "path", "full_outer")
    return j.where(~F.col("a").eqNullSafe(F.col("b"))).select("path", F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").otherwise("changed").alias("change"))
