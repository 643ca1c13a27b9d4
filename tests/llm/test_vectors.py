"""Vector codes and exact top-k: against plain loops in Python's integers; broken, short, repeated and large vectors."""

import hashlib
import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lumentide.llm import codes, queries, topk

SCHEMA = "vec_id long, embedding array<float>, label int, code string, score long"


def floors(v, scale, dim):
    return [math.floor(scale * float(np.float32(x))) for x in v] + [0] * (dim - len(v))


def whole(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def plain_codes(rows, parts=8, entries=16, rounds=6):
    kept = sorted((r for r in rows if whole(r[1])), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    dim = -(-max((len(r[1]) for r in kept), default=0) // parts) * parts
    size = dim // parts
    x = [floors(r[1], 4096, dim) for r in kept]
    cut = lambda v, p: v[p * size : (p + 1) * size]
    books = [[cut(v, p) for v in x[:entries]] for p in range(parts)]
    near = lambda p, v: min((sum((a - b) ** 2 for a, b in zip(e, cut(v, p))), i) for i, e in enumerate(books[p]))
    for _ in range(rounds):
        at = [[near(p, v)[1] for v in x] for p in range(parts)]
        for p in range(parts):
            for i in range(len(books[p])):
                mine = [cut(v, p) for v, j in zip(x, at[p]) if j == i]
                books[p][i] = [sum(c) // len(mine) for c in zip(*mine)] if mine else books[p][i]
    found = [[near(p, v) for p in range(parts)] for v in x]
    error = [sum(d for d, _ in f) for f in found]
    by = {}
    for r, e in zip(kept, error):
        by[r[2]] = by.get(r[2], 0) + e
    sha = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    most = (1 << 63) - 1
    return sorted(((r[0], "".join(f"{i:02x}" for _, i in f), min(e, most), min(by[r[2]], most), sha) for r, f, e in zip(kept, found, error)), key=repr)


def plain_top(rows, k=10):
    kept = [r for r in rows if whole(r[1])]
    dim = max((len(r[1]) for r in kept), default=0)
    x = [floors(r[1], 1024, dim) for r in kept]
    out = []
    for i, r in enumerate(kept):
        if r[0] is not None and r[0] % 100 == 0:
            scores = [(-sum(a * b for a, b in zip(x[i], x[j])), kept[j][0] is None, kept[j][0] or 0) for j in range(len(kept)) if j != i]
            out += [(r[0], n + 1, None if none else key, -s) for n, (s, none, key) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=repr)


def frame(spark, rows):
    return spark.createDataFrame([(*r, "c", 5) for r in rows], SCHEMA)


def some_rows(n, dim, seed=1):
    r = random.Random(seed)
    rows = [(i, [r.gauss(0, 0.2) for _ in range(dim)], r.choice([None, 1, 2])) for i in range(n)]
    return rows + [(n, None, 1), (n + 1, [0.1, None] * (dim // 2), 1), (n + 2, [float("nan")] * dim, 1), (n + 3, [math.inf] + [0.0] * (dim - 1), None), (n + 4, [-0.5, 0.25], 2), (n + 5, [], 2), (None, [0.3] * dim, 7), (3, rows[3][1], 2)]


def test_tree_finds_the_nearest():
    r = np.random.default_rng(5)
    for n, size in ((1, 4), (2, 3), (16, 8), (40, 2), (7, 1)):
        entries = r.integers(-6, 6, (n, size))
        points = r.integers(-8, 8, (500, size))
        far = ((points[:, None] - entries[None]) ** 2).sum(axis=2)
        for kind in (np.int64, object):  # ties are many here
            index, square = codes.VantageTree(entries.astype(kind)).search(points.astype(kind))
            assert (index == far.argmin(axis=1)).all() and (square == far.min(axis=1)).all()


def test_roots_are_exact():
    squares = np.array([0, 1, 2, 3, 4, (1 << 60) - 1, (1 << 60), (1 << 30) ** 2 - 1, 3037000498**2, 3037000498**2 - 1], np.int64)
    assert codes._root(squares).tolist() == [math.isqrt(int(x)) for x in squares]


def test_codes_equal_plain_loops(spark):
    for rows in (some_rows(120, 16), some_rows(9, 24, 2), [(1, [1e30, -1e20, 3.0], 1), (2, [0.5, 1e30, 1.0], None), (3, [1e30, -1e20, 3.0], None)], []):
        got = codes.compress(frame(spark, rows))
        assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
        assert sorted((tuple(r) for r in got.collect()), key=repr) == plain_codes(rows)


def test_decoded_codes_are_the_nearest_entries(spark):
    rows = [r for r in some_rows(60, 16) if whole(r[1]) and len(r[1]) == 16]
    df = frame(spark, rows)
    books = codes.fit(df, "vec_id", "embedding")
    for r in codes.decode(codes.encode(df, books, "vec_id", "embedding", "label").where("key is not null and key <> 3"), books).collect():
        x = floors(rows[r.key][1], 4096, 16)
        assert sum((a - round(4096 * b)) ** 2 for a, b in zip(x, r.decoded)) == r.error


def test_top_equals_plain_loops(spark):
    r = random.Random(6)
    hot = [r.gauss(0, 0.2) for _ in range(12)]
    for rows in (some_rows(450, 12), some_rows(5, 12), [(i, hot if i % 3 == 0 else [r.gauss(0, 0.2) for _ in range(12)], 1) for i in range(600)], [(i, [0.0] * 4, 1) for i in range(250)], []):
        got = topk.top_k(frame(spark, rows), F.col("vec_id") % 100 == 0)
        assert got.columns == ["query_id", "rank", "vec_id", "score"]
        assert sorted((tuple(x) for x in got.collect()), key=repr) == plain_top(rows)


def test_top_in_blocks_and_lists(spark, monkeypatch):
    rows = some_rows(700, 10, 8)
    monkeypatch.setattr(topk, "BLOCK", 3)
    for lists in (1, 3):
        got = topk.top_k(frame(spark, rows), F.col("vec_id") % 100 == 0, lists=lists, depth=11)
        assert sorted((tuple(x) for x in got.collect()), key=repr) == plain_top(rows)
    with pytest.raises(ArithmeticError):
        topk.top_k(frame(spark, [(0, [1e30], 1)]), F.col("vec_id") % 100 == 0)


@pytest.mark.parametrize("name", ["op12_codes", "op13_topk"])
def test_queries_equal_sql(name, spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{sf_dir}/embeddings.parquet'")
    got = queries.QUERIES[name](spark, sf_dir)
    want = con.execute(queries.ORACLES[name])
    assert got.columns == [c[0] for c in want.description]
    assert sorted(tuple(r) for r in got.collect()) == sorted(want.fetchall())
