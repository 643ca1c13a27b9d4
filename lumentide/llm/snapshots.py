"""Differences between two snapshots of a table; rows whose key changed are found again by their content.

Rows are matched by counted order-statistic trees, one for each group (a key, then a content). A tree has three levels
of 64 children: its order is cut into 4096 ranges, the counts of ranges and of their 64 parents are two small tables, and
a leaf, all entries of a group in one range, is a sorted run inside a task. The i-th entry of one tree is the i-th
of the other: intervals of places go down from the counts to the leaves, which select what stands there. So no group,
however large, meets in one task, and nothing but the 4095 bounds of the key ranges goes to the driver.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

#: Children of a node above the leaves; a tree has FAN * FAN ranges.
FAN = 64
#: Children of a node inside a leaf.
INNER = 16
#: A row that stands for more copies than this is cut before its copies are written, so that one task doesn't write them all.
MOST_COPIES = 1 << 16


class CountedTree:
    """Order-statistic tree over entries in order, each of which stands for a count of rows."""

    def __init__(self, counts: np.ndarray):
        self.levels = [counts.astype(np.int64)]
        while len(self.levels[-1]) > INNER:
            self.levels.append(np.add.reduceat(self.levels[-1], np.arange(0, len(self.levels[-1]), INNER)))
        self.ends = np.cumsum(self.levels[0])

    def select(self, places: np.ndarray) -> np.ndarray:
        """The entry in which each place (from 0, below the sum of counts) lies."""
        node, rest = np.zeros(len(places), np.int64), places.astype(np.int64, copy=True)
        for counts in reversed(self.levels):
            padded = np.concatenate([counts, np.zeros(-len(counts) % INNER, np.int64)]).reshape(-1, INNER)
            sums = np.cumsum(padded, axis=1)[node]
            child = (sums <= rest[:, None]).sum(axis=1)
            rest -= np.where(child > 0, np.take_along_axis(sums, np.maximum(child - 1, 0)[:, None], axis=1)[:, 0], 0)
            node = node * INNER + child
        return node

    def before(self, entry: np.ndarray) -> np.ndarray:
        return self.ends[entry] - self.levels[0][entry]


def _changes(column: pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks()
    return pc.not_equal(column.slice(1), column.slice(0, len(column) - 1)).to_numpy(zero_copy_only=False)


def _selected(table: pa.Table) -> Iterator[pa.RecordBatch]:
    """Of whole leaves, in order (entries, then intervals of places): what stands in each interval, and what no interval asks for."""
    new = np.concatenate([[True], _changes(table["g"]) | _changes(table["a"]) | _changes(table["b"])])
    leaf = np.cumsum(new) - 1
    kind, n = table["kind"].to_numpy(), table["n"].to_numpy()
    entries, asked = np.flatnonzero(kind == 0), np.flatnonzero(kind == 1)
    if not len(entries):
        return
    tree = CountedTree(n[entries])
    base = np.zeros(leaf[-1] + 1, np.int64)
    sizes = np.bincount(leaf[entries], weights=None, minlength=leaf[-1] + 1)
    first = np.cumsum(sizes) - sizes
    has = sizes > 0
    base[has] = tree.before(first[has])
    low = base[leaf[asked]] + table["at"].to_numpy()[asked] if len(asked) else np.zeros(0, np.int64)
    high = low + n[asked]
    begin, end = tree.select(low), tree.select(np.maximum(high - 1, 0))
    many = end - begin + 1
    which = np.repeat(np.arange(len(asked)), many)
    entry = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + begin[which]
    start, stop = np.maximum(low[which], tree.before(entry)), np.minimum(high[which], tree.ends[entry])
    taken = np.zeros(len(entries), np.int64)
    np.add.at(taken, entry, stop - start)
    left = np.flatnonzero(tree.levels[0] > taken)
    rows = np.concatenate([entries[entry], entries[left]])
    of = pa.array(np.concatenate([asked[which], np.zeros(len(left), np.int64)]), mask=np.arange(len(rows)) >= len(which))
    out = {
        "g": table["g"].take(rows), "n": pa.array(np.concatenate([stop - start, (tree.levels[0] - taken)[left]])),
        "within": pa.array(np.concatenate([start - low[which], np.zeros(len(left), np.int64)])), "x": table["x"].take(rows), "y": table["y"].take(of),
    }
    yield from pa.table(out).combine_chunks().to_batches()


def _select_in_leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """_selected over a sorted stream, some whole leaves at a time."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) < 50_000:
            continue
        table = pa.Table.from_batches(held)
        cut = np.flatnonzero(_changes(table["g"]) | _changes(table["a"]) | _changes(table["b"]))
        if len(cut):
            yield from _selected(table.slice(0, cut[-1] + 1))
            held = table.slice(cut[-1] + 1).to_batches()
    if sum(b.num_rows for b in held):
        yield from _selected(pa.Table.from_batches(held))


def _in_leaves(entries: DataFrame, intervals: DataFrame) -> DataFrame:
    """Sends intervals (g, a, b, at, n, y) to the leaves of entries (g, a, b, z, o, n, x); returns g, n, within, x and y."""
    kinds = dict(entries.select("x").dtypes) | dict(intervals.select("y").dtypes)
    left = entries.select("g", "a", "b", F.lit(0).alias("kind"), "z", "o", "n", F.lit(0).cast("long").alias("at"), "x", F.lit(None).cast(kinds["y"]).alias("y"))
    right = intervals.select("g", "a", "b", F.lit(1), F.lit(0), "at", "n", "at", F.lit(None).cast(kinds["x"]), "y")
    both = left.union(right).repartition("g", "a", "b").sortWithinPartitions("g", "a", "b", "kind", "z", "o")
    return both.mapInArrow(_select_in_leaves, f"g binary, n long, within long, x {kinds['x']}, y {kinds['y']}")


def _overlaps(kids: str, start: Column, size: Column) -> Column:
    return F.filter(kids, lambda k: (k["first"] < start + size) & (k["first"] + k["size"] > start))


def _matched(entries: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Matches the i-th row of side 0 with the i-th of side 1 in each group.

    entries: g (binary), side, shard (0 to FAN * FAN - 1, ascending in the order), z and o (the order inside a shard), n
    (rows it stands for) and x. Returns pairs (n, x of side 0 as e, x of side 1 as l) and what is left of either side (g, n, x).
    """
    entries = entries.select("g", "side", F.expr(f"shard div {FAN}").cast("int").alias("a"), F.expr(f"shard % {FAN}").cast("int").alias("b"), "z", "o", "n", "x")
    leaves = stored(entries.groupBy("g", "side", "a", "b").agg(F.sum("n").alias("size")), "snapshot-leaves")
    prefix = F.sum("size").over(Window.partitionBy("g", "side").orderBy("a")) - F.col("size")  # of 64 rows at most
    nodes = leaves.groupBy("g", "side", "a").agg(F.sum("size").alias("size")).withColumn("first", prefix)
    prefix = F.sum("size").over(Window.partitionBy("g", "side", "a").orderBy("b")) - F.col("size")  # of 64 rows at most
    placed = leaves.withColumn("first", prefix)
    roots = nodes.where("side = 1").groupBy("g").agg(F.sort_array(F.collect_list(F.struct("first", "size", "a"))).alias("kids"))
    below = placed.where("side = 1").groupBy("g", "a").agg(F.sort_array(F.collect_list(F.struct("first", "size", "b"))).alias("kids"))
    asking = placed.where("side = 0").join(nodes.where("side = 0").select("g", "a", F.col("first").alias("above")), ["g", "a"])
    asking = asking.select("g", F.col("a").alias("ea"), F.col("b").alias("eb"), (F.col("above") + F.col("first")).alias("start"), "size")
    cut = lambda low, high: (F.greatest(low, F.col("k.first")), F.least(high, F.col("k.first") + F.col("k.size")))
    down = asking.join(roots, "g").withColumn("k", F.explode(_overlaps("kids", F.col("start"), F.col("size"))))
    low, high = cut(F.col("start"), F.col("start") + F.col("size"))
    down = down.select("g", "ea", "eb", (low - F.col("start")).alias("at"), (high - low).alias("n"), F.col("k.a").alias("a"), (low - F.col("k.first")).alias("start"))
    down = down.join(below, ["g", "a"]).withColumn("k", F.explode(_overlaps("kids", F.col("start"), F.col("n"))))
    low, high = cut(F.col("start"), F.col("start") + F.col("n"))
    routes = down.select(
        "g", F.col("ea").alias("a"), F.col("eb").alias("b"), (F.col("at") + low - F.col("start")).alias("at"), (high - low).alias("n"),
        F.struct("a", F.col("k.b").alias("b"), (low - F.col("k.first")).alias("off")).alias("y"),
    )
    sent = stored(_in_leaves(entries.where("side = 0"), routes), "snapshot-sent")
    asked = sent.where("y is not null").select("g", "y.a", "y.b", (F.col("y.off") + F.col("within")).alias("at"), "n", F.col("x").alias("y"))
    got = stored(_in_leaves(entries.where("side = 1"), asked), "snapshot-got")
    pairs = got.where("y is not null").select("n", F.col("y").alias("e"), F.col("x").alias("l"))
    return pairs, sent.where("y is null").select("g", "n", "x"), got.where("y is null").select("g", "n", "x")


def _ranges(cuts: np.ndarray):
    @F.pandas_udf("int")
    def ranges(key: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(cuts, key.to_numpy(np.int64), side="right").astype(np.int32))

    return ranges


def difference(earlier: DataFrame, later: DataFrame, key: str = "doc_id", columns: Sequence[str] = ("text", "lang", "source")) -> DataFrame:
    """Says how later came from earlier: one row for each pair, and for each row of either that has no partner.

    Rows of equal keys pair: `same`, or `update` where columns differ. Then, among rows without a partner that agree in all
    columns, the i-th smallest earlier key pairs with the i-th largest later key: `rekey`. What is left is `delete` or `insert`.
    Nulls, in columns or as keys, equal only nulls; a null key is the smallest. Where a key is repeated, its rows of equal content
    pair first, the others in the order of a hash of their content; rows equal in all columns are counted, not told apart. Keys are integers,
    columns are compared as strings. Empty tables give only inserts or deletes; other columns, whatever their names, are not read.

    Returns key (later, else earlier), old_key, op, changed (differing columns of a pair, comma-joined), row_sha256 (of the
    later row's columns joined by line feeds, null as `~`).
    """
    parts = [f"c{i}" for i in range(len(columns))]

    def digests(df: DataFrame, side: int) -> DataFrame:
        texts = [F.col(c).cast("string") for c in columns]
        whole = F.sha2(F.concat_ws("\n", *[F.coalesce(t, F.lit("~")) for t in texts]), 256) if side else F.lit(None).cast("string")
        return df.select(F.col(key).cast("long").alias("key"), *[F.unhex(F.sha2(t, 256)).alias(p) for t, p in zip(texts, parts, strict=True)], whole.alias("sha"), F.lit(1 - side).cast("long").alias("e"), F.lit(side).cast("long").alias("l"))

    rows = digests(earlier, 0).union(digests(later, 1)).groupBy("key", *parts).agg(F.sum("e").alias("e"), F.sum("l").alias("l"), F.max("sha").alias("sha"))
    rows = stored(rows, "snapshot-rows")
    same = rows.where("e > 0 and l > 0").select("key", F.col("key").alias("old_key"), F.lit("same").alias("op"), F.lit("").alias("changed"), "sha", F.least("e", "l").alias("n"))

    content = F.unhex(F.sha2(F.concat_ws("/", *[F.coalesce(F.hex(p), F.lit("~")) for p in parts]), 256))
    left = rows.where("e <> l").withColumn("content", content).withColumn("o", F.xxhash64("content"))
    left = left.select(
        F.coalesce(F.col("key").cast("string"), F.lit("~")).cast("binary").alias("g"), (F.col("e") < F.col("l")).cast("int").alias("side"),
        (F.shiftright("o", 52) + FAN * FAN // 2).cast("int").alias("shard"), F.lit(0).alias("z"), "o", F.abs(F.col("e") - F.col("l")).alias("n"), F.struct("key", "content", "sha", *parts).alias("x"),
    )
    pairs, deleted, inserted = _matched(left)
    differ = F.concat_ws(",", *[F.when(~F.col(f"e.{p}").eqNullSafe(F.col(f"l.{p}")), F.lit(c)) for p, c in zip(parts, columns, strict=True)])
    updates = pairs.select(F.col("l.key").alias("key"), F.col("e.key").alias("old_key"), F.lit("update").alias("op"), differ.alias("changed"), F.col("l.sha").alias("sha"), "n")

    bounds = rows.agg(F.percentile_approx("key", [i / (FAN * FAN) for i in range(1, FAN * FAN)], 4 * FAN * FAN)).first()[0]
    spread = _ranges(np.unique(np.array(bounds or [], np.int64)))

    def keyed(df: DataFrame, side: int) -> DataFrame:
        """Side 1 is in descending order, with nulls last."""
        k = F.col("x.key")
        shard = F.when(k.isNull(), 0).otherwise(spread(F.coalesce(k, F.lit(0))))
        order = (FAN * FAN - 1 - shard, k.isNull(), F.bitwise_not(k)) if side else (shard, k.isNotNull(), k)
        return df.select(F.col("x.content").alias("g"), F.lit(side).alias("side"), order[0].cast("int").alias("shard"), order[1].cast("int").alias("z"), F.coalesce(order[2], F.lit(0)).alias("o"), "n", F.struct("x.key", "x.sha").alias("x"))

    moved, deleted, inserted = _matched(keyed(deleted, 0).union(keyed(inserted, 1)))
    none, empty = F.lit(None), F.lit("").alias("changed")
    out = same.union(updates)
    out = out.union(moved.select("l.key", F.col("e.key"), F.lit("rekey"), empty, "l.sha", "n"))
    out = out.union(deleted.select("x.key", "x.key", F.lit("delete"), empty, none.cast("string"), "n"))
    out = out.union(inserted.select("x.key", none.cast("long"), F.lit("insert"), empty, "x.sha", "n"))
    out = stored(out, "snapshot-result")
    large = out.where(F.col("n") > MOST_COPIES).withColumn("piece", F.explode(F.sequence(F.lit(0), F.expr(f"(n - 1) div {MOST_COPIES}"))))
    large = large.withColumn("n", F.least(F.lit(MOST_COPIES), F.col("n") - F.col("piece") * MOST_COPIES)).repartition("key", "old_key", "sha", "piece").drop("piece")
    out = out.where(F.col("n") <= MOST_COPIES).union(large).withColumn("one", F.explode(F.array_repeat(F.lit(0), F.col("n").cast("int"))))
    return out.select("key", "old_key", "op", "changed", F.col("sha").alias("row_sha256"))
