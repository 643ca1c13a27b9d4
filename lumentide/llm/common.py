"""What the corpus operators share: ordered buckets, tables in the shared folder, byte-level views of Arrow text."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows in one Arrow batch; texts can be long, so batches are kept short.
BATCH_ROWS = 256
#: Most buckets an ordering is cut into; what is gathered per bucket on the driver is a few numbers.
MAX_BUCKETS = 1 << 16
_SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def session_setup(spark: SparkSession) -> None:
    """Short Arrow batches, so that a batch of long texts stays small."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir; in local mode an own one where that is unset."""
    sc = spark.sparkContext
    path = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not path:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="shared-")
        sc.setCheckpointDir(path)
    return path.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes df as a Parquet table in the shared folder and reads it: cuts lineage, survives lost executors.

    The write's shuffle files are deleted as soon as it has ended, as nothing can read them again.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_SHUFFLE_CLEANUP, None)
    spark.conf.set(_SHUFFLE_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(_SHUFFLE_CLEANUP)
        else:
            spark.conf.set(_SHUFFLE_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Deletes a table that stored() wrote and that nothing reads any more."""
    spark = df.sparkSession
    for f in {f.rpartition("/")[0] for f in df.inputFiles()}:
        if "/tables/" in f:
            path = spark._jvm.org.apache.hadoop.fs.Path(f)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def key_cuts(df: DataFrame, key: str, n: int) -> np.ndarray:
    """Ascending cut points that split an integer key into at most n ranges of about as many rows (null keys count as the lowest)."""
    n = min(n, MAX_BUCKETS)
    if n < 2:
        return np.empty(0, np.int64)
    got = df.agg(F.percentile_approx(F.col(key).cast("long"), [i / n for i in range(1, n)], max(10_000, 4 * n))).first()[0]
    return np.array(got or [], np.int64)


#: What a null key counts as where rows are ordered; a real key of this value comes back as null.
LOWEST = -(1 << 63)


def ordered_key(key: str):
    return F.coalesce(F.col(key).cast("long"), F.lit(LOWEST))


def bucket_udf(cuts: np.ndarray):
    """Column function of a key without nulls and a salt: the key's range.

    A key that fills several ranges (the cut points repeat) is spread over them by the salt; the order of keys
    over ranges holds all the same.
    """
    @F.pandas_udf("int")
    def bucket(key: pd.Series, salt: pd.Series) -> pd.Series:
        key = key.to_numpy(np.int64)
        left, right = np.searchsorted(cuts, key, side="left"), np.searchsorted(cuts, key, side="right")
        spread = np.maximum(right - left, 1)
        return pd.Series(np.where(right > left, left + 1 + salt.to_numpy(np.int64) % spread, right).astype(np.int32))

    return bucket


def sha(*parts) -> object:
    """Hash of some columns for dealing rows evenly, whatever the keys."""
    return F.xxhash64(*parts)


def text_buffer(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a text column in one array, and the offsets of its rows; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(buffers[2], np.uint8)[offsets[0] : offsets[-1]] if buffers[2] is not None else np.empty(0, np.uint8)
    return data, offsets - offsets[0]


_MIX = np.uint64(0x9E3779B97F4A7C15)


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads 64-bit values (a bijection)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_TABLE = mix64(np.arange(1, 257, dtype=np.uint64) * _MIX)
_R = 0xD1342543DE82EF95  # odd, so it has an inverse modulo 2**64
_LOW = 1 << 12  # exponents are taken apart into this many low values and the rest, so that tables stay small


def _tables(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base to the powers 0 to _LOW - 1, and to the multiples of _LOW up to n."""
    high = np.full(n // _LOW + 1, pow(base, _LOW, 1 << 64), np.uint64)
    low = np.full(_LOW, base, np.uint64)
    high[0] = low[0] = 1
    return np.cumprod(low, dtype=np.uint64), np.cumprod(high, dtype=np.uint64)


_INVERSE = pow(_R, -1, 1 << 64)


def segment_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of data[start:end] for each pair: equal for equal bytes wherever they stand."""
    n = len(data)
    low, high = _tables(_R, n)
    prefix = np.zeros(n + 1, np.uint64)
    for i, power in enumerate(high):  # nothing as long as the data is kept but the sums
        part = data[i * _LOW : (i + 1) * _LOW]
        np.multiply(_TABLE[part], low[: len(part)], out=prefix[1 + i * _LOW : 1 + i * _LOW + len(part)])
        prefix[1 + i * _LOW : 1 + i * _LOW + len(part)] *= power
    np.cumsum(prefix, out=prefix)
    low, high = _tables(_INVERSE, n)
    h = (prefix[ends] - prefix[starts]) * (low[starts & (_LOW - 1)] * high[starts >> 12])
    return mix64(h ^ ((ends - starts).astype(np.uint64) * _MIX))


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word `[^\\x20\\x09-\\x0D]+`, and the row it stands in."""
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z
    word = ~_SPACE[data]
    first = word.copy()
    first[1:] &= ~word[:-1]
    at = offsets[:-1][(offsets[:-1] < n) & (offsets[1:] > offsets[:-1])]
    first[at] = word[at]
    last = word.copy()
    last[:-1] &= ~word[1:]
    to = at[1:] - 1 if len(at) else at
    last[to] = word[to]
    last[n - 1] = word[n - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)
