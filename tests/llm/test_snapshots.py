"""Differences of snapshots: against plain loops, trees against sorted lists; giant groups, repeats, nulls, clashing names."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from lumentide.llm import queries, snapshots

SCHEMA = "doc_id long, text string, lang string, source string, key string, op long"


def plain(earlier, later):
    """Rows are (key, text, lang, source); keys are unique on either side."""
    old, new = dict((r[0], r[1:]) for r in earlier), dict((r[0], r[1:]) for r in later)
    sha = lambda c: hashlib.sha256("\n".join("~" if x is None else x for x in c).encode()).hexdigest()
    out = []
    for k in old.keys() & new.keys():
        changed = ",".join(n for n, a, b in zip(("text", "lang", "source"), old[k], new[k]) if a != b)
        out.append((k, k, "update" if changed else "same", changed, sha(new[k])))
    left, right = defaultdict(list), defaultdict(list)
    for k in old.keys() - new.keys():
        left[old[k]].append(k)
    for k in new.keys() - old.keys():
        right[new[k]].append(k)
    for c in left.keys() | right.keys():
        a, b = sorted(left[c]), sorted(right[c], reverse=True)
        out += [(y, x, "rekey", "", sha(c)) for x, y in zip(a, b)]
        out += [(x, x, "delete", "", None) for x in a[len(b) :]] + [(y, None, "insert", "", sha(c)) for y in b[len(a) :]]
    return Counter(out)


def run(spark, earlier, later):
    frame = lambda rows: spark.createDataFrame([(*r, "k", 1) for r in rows], SCHEMA)
    return Counter(tuple(r) for r in snapshots.difference(frame(earlier), frame(later)).collect())


def test_tree_selects_like_a_list():
    r = np.random.default_rng(3)
    for n in (1, 15, 16, 17, 300, 5000):
        counts = r.integers(0 if n > 1 else 1, 4, n)
        counts[r.integers(0, n)] += 1000
        tree, flat = snapshots.CountedTree(counts), np.repeat(np.arange(n), counts)
        assert (tree.select(np.arange(len(flat))) == flat).all()
        assert (tree.before(np.arange(n)) == np.append(0, np.cumsum(counts)[:-1])).all()


def test_difference_equals_plain_loops(spark):
    """A giant group of one content on either side, others of a few, nulls in every column and a null key."""
    r = random.Random(4)
    contents = [("hot", "en", "s0")] * 6 + [(None, None, None), ("", "en", None), (None, "en", ""), ("a", "b", "c"), ("~", "~", "~"), ("x\ny", "z", "s")]
    earlier = [(k, *r.choice(contents)) for k in range(0, 3000, 2)]
    later = [(k, *r.choice(contents)) if r.random() < 0.2 else (k, *c) for k, *c in earlier if r.random() < 0.6] + [(-1 - k, *r.choice(contents)) for k in range(1400)]
    for a, b in ((earlier, later), (later, earlier), (earlier, earlier), ([], later), (earlier, []), ([], [])):
        assert run(spark, a, b) == plain(a, b)
    lone = [(None, "n", "en", "s"), (5, "m", "en", "s")]
    assert run(spark, lone, [(None, "n2", "en", "s")]) == Counter([(None, None, "update", "text", hashlib.sha256(b"n2\nen\ns").hexdigest()), (5, 5, "delete", "", None)])


def test_repeated_keys_and_counted_rows(spark):
    """Equal rows of a key pair first; rows equal in everything are counted, and each is told."""
    a, b = (7, "a", "en", "s"), (7, "b", "en", "s")
    got = run(spark, [a] * 5 + [b] * 3, [b] * 4 + [(8, "a", "en", "s")] * 6)
    sha = lambda t: hashlib.sha256(f"{t}\nen\ns".encode()).hexdigest()
    want = Counter({(7, 7, "same", "", sha("b")): 3, (7, 7, "update", "text", sha("b")): 1, (8, 7, "rekey", "", sha("a")): 4, (8, None, "insert", "", sha("a")): 2})
    assert got == want
    many = spark.range(200_000).selectExpr("1L as doc_id", "'t' as text", "'en' as lang", "'s' as source")
    few = many.limit(150_000)
    assert {(r.op, r.n) for r in snapshots.difference(many, few).groupBy("op").agg({"*": "count"}).toDF("op", "n").collect()} == {("same", 150_000), ("delete", 50_000)}


def test_query_equals_loops_and_sql(spark, sf_dir):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source").collect()]
    later = []
    for k, text, lang, source in docs:
        case = zlib.crc32(str(k).encode()) % 10
        if case:
            later.append((-1 - k if case in (3, 4) else k, text + "+" if case == 1 else text, source if case == 2 else lang, lang if case == 2 else None if case == 4 else source))
        if case == 5:
            later.append((-1 - k, text, lang, source))
    got = queries.op11_snapshots(spark, sf_dir)
    assert [x.split(":")[0] for x in ("key:long", "old_key:long", "op", "changed", "row_sha256")] == got.columns
    rows = Counter(tuple(r) for r in got.collect())
    assert rows == plain(docs, later)
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf_dir}/documents.parquet'")
    assert rows == Counter(con.execute(queries.ORACLES["op11_snapshots"]).fetchall())


def test_null_keys_are_left_as_they_are(spark):
    docs = spark.createDataFrame([(None, "t", "en", "s"), (3, None, None, None)], "doc_id long, text string, lang string, source string")
    assert queries.later_documents(docs).where("doc_id is null and text = 't'").count() == 1
    assert queries.later_documents(docs.where("false")).count() == 0


@pytest.mark.parametrize("key", [-(1 << 63), (1 << 63) - 1])
def test_extreme_keys(spark, key):
    assert run(spark, [(key, "t", "en", "s"), (0, "t", "en", "s")], [(1, "t", "en", "s"), (2, "t", "en", "s")]) == plain([(key, "t", "en", "s"), (0, "t", "en", "s")], [(1, "t", "en", "s"), (2, "t", "en", "s")])
