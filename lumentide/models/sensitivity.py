"""Sensitivity of a model to its inputs, over a low-discrepancy design."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Published direction numbers of the sequence from its second dimension on, as (polynomial, first odd numbers).
_DIRECTIONS = [
    (0, (1,)), (1, (1, 3)), (1, (1, 3, 1)), (2, (1, 1, 1)), (1, (1, 1, 3, 3)), (4, (1, 3, 5, 13)), (2, (1, 1, 5, 5, 17)), (4, (1, 1, 5, 5, 5)),
    (7, (1, 1, 7, 11, 19)), (11, (1, 1, 5, 1, 1)), (13, (1, 1, 1, 3, 11)), (14, (1, 3, 5, 5, 31)), (1, (1, 3, 3, 9, 7, 49)), (13, (1, 1, 1, 15, 21, 21)), (16, (1, 3, 1, 13, 27, 49)),
]
_BITS = 30


def _directions(dimension: int) -> list[int]:
    """The dimension's direction numbers, scaled to _BITS bits."""
    if dimension == 0:
        return [1 << (_BITS - 1 - i) for i in range(_BITS)]
    polynomial, m = _DIRECTIONS[dimension - 1]
    s, m = len(m), list(m)
    while len(m) < _BITS:
        new = m[-s] ^ (m[-s] << s)
        for k in range(1, s):
            new ^= (m[-k] << k) * ((polynomial >> (s - 1 - k)) & 1)
        m.append(new)
    return [x << (_BITS - 1 - i) for i, x in enumerate(m)]


def sequence_point(index: Column, dimension: int) -> Column:
    """The index-th point of the sequence in a dimension, in [0, 1): the numbers of the set bits of the index's Gray code, xor-ed."""
    gray = index.bitwiseXOR(F.shiftright(index, 1))
    out = F.lit(0).cast("long")
    for i, v in enumerate(_directions(dimension)):
        out = out.bitwiseXOR(F.shiftright(gray, i).bitwiseAND(F.lit(1)) * F.lit(v))
    return out.cast("double") / float(1 << _BITS)


def design(spark: SparkSession, bounds: dict[str, tuple[float, float]], n: int = 1024, skip: int = 1024) -> DataFrame:
    """n base points of the sequence, each in 2 D + 2 blocks: (id, block, the inputs).

    Block a has the first D dimensions, block b the last D; in a_<input> that input comes from b, in b_<input> from a. Every row is
    made from its index alone; the first `skip` points are left out. At most 8 inputs.
    """
    names = list(bounds)
    if 2 * len(names) > len(_DIRECTIONS) + 1:
        raise ValueError(f"at most {(len(_DIRECTIONS) + 1) // 2} inputs")
    index = F.col("id") + F.lit(skip)
    place = lambda f, u: bounds[f][0] + (bounds[f][1] - bounds[f][0]) * u
    d = spark.range(n).select("id", *(place(f, sequence_point(index, i)).alias(f"a_{f}") for i, f in enumerate(names)), *(place(f, sequence_point(index, len(names) + i)).alias(f"b_{f}") for i, f in enumerate(names)))
    other = {"a": "b", "b": "a"}
    blocks = [(side, side, None) for side in "ab"] + [(f"{side}_{f}", side, f) for side in "ab" for f in names]
    rows = [F.struct(F.lit(name).alias("block"), *(F.col(f"{other[side] if f == swap else side}_{f}").alias(f) for f in names)) for name, side, swap in blocks]
    return d.select("id", F.explode(F.array(*rows)).alias("x")).select("id", "x.*")


def sensitivity(scores: DataFrame, inputs: list[str], score: str = "score") -> DataFrame:
    """First-order and total indices of each input from the scores (id, block, score) of a design; null where scores don't vary.

    Scores are centred first. Both blocks of an input serve, so each index is a mean of two estimates.
    """
    centred = scores.select("id", "block", (F.col(score) - scores.agg(F.avg(score)).first()[0]).alias("y"))
    of = lambda block: F.max(F.when(F.col("block") == block, F.col("y")))
    d = centred.groupBy("id").agg(of("a").alias("a"), of("b").alias("b"), *(of(f"{side}_{f}").alias(f"{side}_{i}") for i, f in enumerate(inputs) for side in "ab"))
    spread = F.nullif((F.var_pop("a") + F.var_pop("b")) / 2, F.lit(0.0))
    a, b = F.col("a"), F.col("b")
    parts = []
    for i in range(len(inputs)):
        x, y = F.col(f"a_{i}"), F.col(f"b_{i}")
        parts += [((F.avg(b * (x - a)) + F.avg(a * (y - b))) / 2 / spread).alias(f"s_{i}"), ((F.avg(F.pow(a - x, 2)) + F.avg(F.pow(b - y, 2))) / 4 / spread).alias(f"t_{i}")]
    rows = [F.struct(F.lit(f).alias("input"), F.col(f"s_{i}").alias("first"), F.col(f"t_{i}").alias("total")) for i, f in enumerate(inputs)]
    return d.agg(*parts).select(F.explode(F.array(*rows)).alias("x")).select("x.*")
