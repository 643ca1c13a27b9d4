"""Exact top-k by inner product, in three phases over lists of partial scores."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored
from .vectors import dimension, whole

#: Queries that are sent to all executors at once, about; more go in further blocks.
BLOCK = 2048
#: Products of integers are exact in doubles up to here.
EXACT = 1 << 53
_ROWS = 4096


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Arrays of whole numbers as a matrix, zeros where one is shorter."""
    flat, sizes = column.flatten().to_numpy(zero_copy_only=False), column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(column), width))
    out[np.repeat(np.arange(len(column)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


class _Lists:
    """Partial scores of a block of queries over the lists; list j has components bounds[j] to bounds[j + 1]."""

    def __init__(self, rids: np.ndarray, queries: np.ndarray, bounds: list[int]):
        self.rids, self.queries, self.bounds = rids, queries, bounds

    def partial(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(list, class ids, scores by row and query) of batches of (list, cid, x)."""
        for whole_batch in batches:
            for at in range(0, whole_batch.num_rows, _ROWS):
                batch = whole_batch.slice(at, _ROWS)
                j, cid = batch.column(0).to_numpy(), batch.column(1).to_numpy()
                for one in np.unique(j):
                    rows = np.flatnonzero(j == one)
                    low, high = self.bounds[one], self.bounds[one + 1]
                    yield int(one), cid[rows], _matrix(batch.column(2).take(pa.array(rows)), high - low) @ self.queries[:, low:high].T


def _first_phase(lists: _Lists, depth: int):
    """Of the rows a task reads: the `depth` highest entries of each list and query, and the lowest score."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for j, cid, score in lists.partial(batches):
            ids, score = np.broadcast_to(cid, score.T.shape), score.T
            low = score.min(axis=1)
            if j in held:
                ids, score, low = np.concatenate([held[j][0], ids], axis=1), np.concatenate([held[j][1], score], axis=1), np.minimum(held[j][2], low)
            if score.shape[1] > depth:
                top = np.argpartition(-score, depth - 1, axis=1)[:, :depth]
                ids, score = np.take_along_axis(ids, top, axis=1), np.take_along_axis(score, top, axis=1)
            held[j] = ids, score, low
        for j, (ids, score, low) in held.items():
            n, m = score.shape
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(lists.rids, m)), pa.array(np.full(n * m, j, np.int32)), pa.array(ids.ravel()), pa.array(score.ravel().astype(np.int64)), pa.array(np.repeat(low, m).astype(np.int64))], ["q", "list", "cid", "score", "low"])

    return run


def _second_phase(lists: _Lists, cutoffs: np.ndarray, need: np.ndarray):
    """All entries that reach their list's cutoff; above is by how much they pass what an entry that isn't sent can have."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for j, cid, score in lists.partial(batches):
            row, query = np.nonzero(score >= cutoffs[:, j])
            if len(row):
                found = score[row, query].astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(lists.rids[query]), pa.array(cid[row]), pa.array(found), pa.array(found - cutoffs[query, j] + 1), pa.array(need[query])], ["q", "cid", "score", "above", "need"])

    return run


def _resolved(pairs: DataFrame, classes: DataFrame, lists: _Lists) -> DataFrame:
    """The exact scores of (q, cid), by the classes' vectors."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q = batch.column(0).to_numpy()
            x = _matrix(batch.column(2), lists.queries.shape[1])
            score = (x * lists.queries[np.searchsorted(lists.rids, q)]).sum(axis=1).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score), batch.column(3)], ["q", "cid", "score", "copies"])

    joined = pairs.join(classes, "cid").select("q", "cid", "x", F.size("ids").alias("copies"))
    return joined.mapInArrow(run, "q long, cid long, score long, copies int")


def top_k(vectors: DataFrame, queries: Column, k: int = 10, key: str = "vec_id", vector: str = "embedding", scale: int = 1024, lists: int = 2, depth: int | None = None) -> DataFrame:
    """For each row that `queries` (a condition) picks: the k other rows of the highest inner product, ties to the smaller key.

    Components become floor(scale * x). Rows of equal vectors form a class, which holds its k + 1 smallest keys, as no more of
    them can be in a result; so a vector that very many rows share is one entry. Each class is cut into `lists`
    parts, and the lists of partial scores are kept apart. In blocks of about BLOCK queries, all that is ever sent to executors:
    1. every task gives its highest entries of each list; the exact scores of the best `depth` of each list give a
       safe cutoff, the (k + 1)-th score found (the query itself may be among them);
    2. the cutoff, less what each list has at least, is shared evenly by the lists; every entry that reaches its share is
       collected, as what reaches none can't reach the cutoff in all;
    3. what could still reach it, but has parts that weren't sent, is scored exactly.

    Rows whose vector is null or holds a null or non-finite component take no part. Vectors shorter than another count as followed by zeros.
    A null key is no query and comes last among ties; repeated rows are rows of their own. An empty table gives no rows, other
    columns are not read. Components so large that scores may pass 2^53 raise an ArithmeticError.

    Returns query_id, rank (from 1), vec_id (named as key), score; fewer than k where there are fewer rows.
    """
    spark, depth = vectors.sparkSession, depth or 3 * (k + 1)
    ints = F.transform(F.col(vector), lambda x: F.floor(x.cast("double") * F.lit(float(scale))))
    kept = vectors.where(whole(vector)).select(F.col(key).alias("key"), queries.alias("asks"), ints.alias("x"))
    kept = stored(kept.withColumn("rid", F.monotonically_increasing_id()), "topk-rows")
    dim = dimension(kept, "x")
    most = kept.agg(F.max(F.array_max(F.transform("x", lambda v: F.abs(v.cast("double")))))).first()[0] or 0.0
    if most * most * max(1, dim) >= EXACT:
        raise ArithmeticError(f"components up to {most / scale} are too large for exact scores")
    number = F.row_number().over(Window.partitionBy("x").orderBy(F.col("key").asc_nulls_last(), "rid"))
    classes = kept.withColumn("i", number).where(F.col("i") <= k + 1).groupBy("x").agg(F.collect_list(F.struct("key", "rid")).alias("ids"))
    classes = stored(classes.withColumn("cid", F.monotonically_increasing_id()), "topk-classes")
    bounds = [dim * j // lists for j in range(lists + 1)]
    part = F.explode(F.array(*[F.struct(F.lit(j).alias("list"), F.slice("x", bounds[j] + 1, bounds[j + 1] - bounds[j]).alias("x")) for j in range(lists)]))
    entries = stored(classes.select("cid", part.alias("p")).select("p.list", "cid", "p.x"), "topk-lists")
    asking = kept.where("asks").select("rid", F.col("key").alias("query_id"), "x")
    blocks = -(-asking.count() // BLOCK)
    asking = stored(asking.withColumn("block", F.pmod(F.xxhash64("rid"), F.lit(max(1, blocks))).cast("int")), "topk-queries")

    found = None
    for b in range(blocks):
        block = sorted(asking.where(F.col("block") == b).select("rid", "x").collect())  # about BLOCK rows
        rids = np.array([r.rid for r in block], np.int64)
        if len(rids):
            local = _Lists(rids, _matrix(pa.array([r.x for r in block], pa.list_(pa.int64())), dim), bounds)
            best = _block(entries, classes, local, k, depth)
            best = best.join(asking.where(F.col("block") == b).select(F.col("rid").alias("q"), "query_id"), "q")
            path = found or f"{stored_path(entries)}-found"
            best.select("query_id", F.col("rank"), F.col("key").alias(key), "score").write.mode("append").parquet(path)
            found = path
    schema = f"query_id {dict(kept.dtypes)['key']}, rank int, {key} {dict(kept.dtypes)['key']}, score long"
    return spark.read.schema(schema).parquet(found) if found else spark.createDataFrame([], schema)


def stored_path(table: DataFrame) -> str:
    """The folder of a table that stored() wrote."""
    return table.inputFiles()[0].rpartition("/")[0]


def _block(entries: DataFrame, classes: DataFrame, local: _Lists, k: int, depth: int) -> DataFrame:
    """The k best rows of each query of a block: q, key, rank, score."""
    schema = "q long, list int, cid long, score long, low long"
    gathered = stored(entries.mapInArrow(_first_phase(local, depth), schema), "topk-gathered")
    number = F.row_number().over(Window.partitionBy("q", "list").orderBy(F.desc("score"), "cid"))  # of depth entries from each task
    tops = gathered.withColumn("i", number).where(F.col("i") <= depth).select("q", "cid").distinct()
    count = F.sum("copies").over(Window.partitionBy("q").orderBy(F.desc("score"), "cid").rowsBetween(Window.unboundedPreceding, 0))
    safe = _resolved(tops, classes, local).withColumn("n", count).where(F.col("n") >= k + 1).groupBy("q").agg(F.max("score").alias("safe"))
    n, m = len(local.rids), len(local.bounds) - 1
    lows = np.zeros((n, m), np.int64)
    for r in gathered.groupBy("q", "list").agg(F.min("low").alias("low")).collect():  # a row for each list and query of the block
        lows[np.searchsorted(local.rids, r.q), r["list"]] = r.low
    cutoffs, need = lows.copy(), np.full(n, -EXACT * 4, np.int64)
    for r in safe.collect():
        i = np.searchsorted(local.rids, r.q)
        cutoffs[i] = np.maximum(lows[i], lows[i] + (r.safe - lows[i].sum()) // m)
        need[i] = r.safe - (cutoffs[i] - 1).sum()

    schema = "q long, cid long, score long, above long, need long"
    sums = entries.mapInArrow(_second_phase(local, cutoffs, need), schema).groupBy("q", "cid").agg(F.sum("score").alias("score"), F.sum("above").alias("above"), F.max("need").alias("need"), F.count("*").alias("n"))
    sums = stored(sums.where("above >= need"), "topk-collected")
    scores = sums.where(F.col("n") == m).select("q", "cid", "score").union(_resolved(sums.where(F.col("n") < m).select("q", "cid"), classes, local).select("q", "cid", "score"))
    best = Window.partitionBy("q").orderBy(F.desc("score"))
    rows = scores.withColumn("i", F.rank().over(best)).where(F.col("i") <= k + 1).join(classes.select("cid", "ids"), "cid")
    rows = rows.select("q", "score", F.explode("ids").alias("id")).where("id.rid <> q").select("q", "score", "id.key", "id.rid")
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), F.col("key").asc_nulls_last(), "rid"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= k).select("q", "key", "rank", "score")
