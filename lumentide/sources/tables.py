"""Text tables: schemas, encodings, samples told by their folders; and writers that never overwrite."""

from __future__ import annotations

import codecs
import csv
import io
import json
import platform
import sys
from collections.abc import Iterator
from datetime import datetime

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ENCODINGS = ("utf-8", "cp932", "shift_jis", "latin1")


def read_csv(spark: SparkSession, path: str | list[str], schema: str | None = None, encoding: str = "utf-8") -> DataFrame:
    """A table with a header line; a byte order mark before the first name is dropped, NaN and inf become null."""
    reader = spark.read.option("header", "true").option("encoding", encoding).option("enforceSchema", "true")
    df = reader.schema(schema).csv(path) if schema else reader.option("inferSchema", "true").csv(path)
    if df.columns and df.columns[0].startswith("﻿"):
        df = df.withColumnRenamed(df.columns[0], df.columns[0].lstrip("﻿"))
    missing = lambda c: F.when(~F.isnan(c) & (F.abs(c) != float("inf")), F.col(c)).alias(c)
    return df.select(*(missing(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes))


def probed_encoding(spark: SparkSession, path: str, encodings: tuple[str, ...] = ENCODINGS) -> str:
    """The first encoding that reads all of a file, or all files, of a path; a byte order mark tells UTF-8. Files are tried in tasks."""

    def fits(raw: bytes, encoding: str) -> bool:
        if raw.startswith(codecs.BOM_UTF8):
            return encoding == "utf-8"
        decoder, step = codecs.getincrementaldecoder(encoding)(), 1 << 20
        try:
            for i in range(0, len(raw) + 1, step):
                decoder.decode(raw[i : i + step], final=i + step > len(raw))
        except UnicodeDecodeError:
            return False
        return True

    known = ("utf-8", *(e for e in encodings if e not in ("utf-8", "utf8", "utf-8-sig")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column(0):
                yield pa.RecordBatch.from_arrays([pa.array([[fits(raw.as_py(), e) for e in known]], pa.list_(pa.bool_()))], ["fits"])

    tried = spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "fits array<boolean>")
    row = tried.agg(*(F.bool_and(F.get("fits", F.lit(i))).alias(f"e{i}") for i in range(len(known)))).first()
    for i, e in enumerate(known):
        if row[i] is None or row[i]:
            return e
    raise ValueError(f"none of {encodings} reads {path}")


def read_csv_any(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A table in the first of ENCODINGS that reads it. Encodings that the scan doesn't know are decoded in tasks, a file in each."""
    e = {"latin1": "iso-8859-1"}.get(found := probed_encoding(spark, path), found)
    if e in ("utf-8", "iso-8859-1"):
        return read_csv(spark, path, schema, e)
    files = spark.read.format("binaryFile").load(path).select("content")
    names = next(csv.reader(io.StringIO(bytes(files.first().content).decode(e).partition("\n")[0].rstrip("\r"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                rows = list(csv.reader(io.StringIO(raw.decode(e), newline="")))[1:]
                columns = list(zip(*([v or None for v in (r + [""] * len(names))[: len(names)]] for r in rows), strict=True)) or [()] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], names=names)

    df = files.mapInArrow(run, ", ".join(f"`{n}` string" for n in names))
    return df if schema is None else df.select(*(F.col(f.name).try_cast(f.dataType) for f in T._parse_datatype_string(schema)))


def read_tagged(spark: SparkSession, pattern: str, tag: str, schema: str | None = None) -> DataFrame:
    """All tables that fit a pattern as one scan, with the name of each one's folder as its tag."""
    folder = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2)
    df = spark.read.option("header", "true").schema(schema).csv(pattern) if schema else spark.read.option("header", "true").option("inferSchema", "true").csv(pattern)
    return df.select(F.url_decode(folder).alias(tag), "*")


def write_csv(df: DataFrame, path: str, mark: bool = False) -> None:
    """Writes a table with a header line; an existing path is an error. With mark, the first name carries a byte order mark."""
    names = ["﻿" + c if mark and i == 0 else c for i, c in enumerate(df.columns)]
    df.toDF(*names).write.mode("errorifexists").option("header", "true").csv(path)


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def run_directory(spark: SparkSession, base: str, step: str, tag: str | None = None, now: datetime | None = None) -> str:
    """A new folder <base>/<step>/<stamp>[_tag]; _2, _3 and so on if it is there."""
    stamp = (now or datetime.now()).strftime("%Y%m%d-%H%M%S") + (f"_{tag}" if tag else "")
    n = 1
    while True:
        path = f"{base.rstrip('/')}/{step}/{stamp}" + (f"_{n}" if n > 1 else "")
        fs, p = _fs(spark, path)
        if not fs.exists(p) and fs.mkdirs(p):
            return path
        n += 1


def write_run_info(spark: SparkSession, folder: str, parameters: dict, **extra) -> str:
    """run_info.json: time, command, parameters, versions, and what else is given."""
    info = {"timestamp": datetime.now().isoformat(timespec="seconds"), "argv": sys.argv, "parameters": parameters, "python": platform.python_version(), "platform": platform.platform(), "spark": spark.version} | extra
    path = f"{folder.rstrip('/')}/run_info.json"
    fs, p = _fs(spark, path)
    out = fs.create(p, False)
    out.write(json.dumps(info, indent=1, default=str).encode())
    out.close()
    return path


def next_version(spark: SparkSession, df: DataFrame, base: str) -> str:
    """Writes a table beside its earlier versions (v1, v2, ...), which stay as they are; gives the new path."""
    n = 1
    while True:
        fs, p = _fs(spark, f"{base.rstrip('/')}/v{n}")
        if not fs.exists(p):
            df.write.mode("errorifexists").parquet(f"{base.rstrip('/')}/v{n}")
            return f"{base.rstrip('/')}/v{n}"
        n += 1
