"""What the queries return, their SQL twins, and models against plain re-computations."""

import glob
import math
import os
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from lumentide.llm import fingerprints, jaccard, language, packing, perplexity, queries, tokens
from lumentide.llm.common import text_buffer

CONTRACT = {
    "op1_sharding": "doc_id bigint, size bigint, text_crc32 bigint, law string, shard int, slot bigint, grown_shard int",
    "op2_pages": "page_id bigint, url string, text string, n_chars bigint",
    "op3_fingerprints": "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double",
    "op4_quality": "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean",
    "op5_private": "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string",
    "op6_jaccard": "doc_id bigint, n_shingles bigint, component_id bigint",
    "op7_packing": "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint",
    "op8_language": "doc_id bigint, held_out boolean, lang_pred string, score double",
    "op9_token_files": "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint",
    "op10_pieces": "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string",
}


@pytest.mark.parametrize("name", sorted(CONTRACT))
def test_contract_of_query(name, spark, sf_dir):
    got = queries.QUERIES[name](spark, sf_dir)
    kinds = dict(got.dtypes)
    want = [x.split() for x in CONTRACT[name].split(", ")]
    assert all(kinds.get(c) == t for c, t in want), got.dtypes
    table, key = ("pages", "page_id") if name == "op2_pages" else ("documents", "doc_id")
    whole = {r[0] for r in spark.read.parquet(f"{sf_dir}/{table}.parquet").select(key).collect()}
    rows = got.select(*(c for c, _ in want)).collect()
    assert {r[0] for r in rows} == whole and (name == "op7_packing" or len(rows) == len(whole))
    assert all(v is not None or c == "grown_shard" for r in rows for c, v in r.asDict().items())


def test_jaccard_equals_sql(spark, sf_dir):
    con = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/documents.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    want = sorted(con.execute(queries.ORACLES["op6_jaccard"]).fetchall())
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in queries.op6_jaccard(spark, sf_dir).collect()) == want


def _family(r, size, words):
    """A text and copies of it with more and more words changed, so that some link and some just don't."""
    base = [r.choice(words) for _ in range(120)]
    for i in range(size):
        copy = list(base)
        for _ in range(i % 9):
            copy[r.randrange(len(copy))] = r.choice(words)
        yield " ".join(copy)


def test_jaccard_of_large_families_and_common_passages(spark):
    """Lists far longer than CHEAP_LIST: many near copies on both sides of the threshold, and a passage in many texts."""
    r = random.Random(11)
    words = ["".join(r.choice("abcdefghij") for _ in range(4)) for _ in range(400)]
    passage = " ".join(r.choice(words) for _ in range(40))
    texts = [*_family(r, 90, words), *_family(r, 40, words)]
    texts += [" ".join(r.choice(words) for _ in range(r.randint(5, 60))) + " " + passage + " " + " ".join(r.choice(words) for _ in range(r.randint(0, 20))) for _ in range(80)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = [{tuple(t.split()[i : i + 5]) for i in range(max(1, len(t.split()) - 4))} for t in texts]
    comp = list(range(len(texts)))

    def find(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((find(i), find(j)))
                comp[b] = a
    want = {i: find(i) for i in range(len(texts))}
    assert {x.doc_id: x.component_id for x in jaccard.linked_components(df, 5, 80).collect()} == want


def test_prefix_choice_by_cost():
    assert jaccard.choose_prefix(np.ones(100, np.int64), 100, 80) == (1, 21)  # nothing to meet: no longer than needed
    m, length = jaccard.choose_prefix(np.full(100, 50), 100, 80)
    assert m > 1 and length == 20 + m
    cost = lambda k: 49 * (20 + k) * (1 + 100 / jaccard.ENTRIES_A_TOKEN / k)
    assert cost(m) == min(cost(k) for k in range(1, 65))


def test_packing_keeps_wide_keys_beside_nulls(spark):
    keys = [None, (1 << 53) + 1, (1 << 53) + 3, (1 << 63) - 1, -5]
    df = spark.createDataFrame([(k, f"some text number {i}") for i, k in enumerate(keys)], "doc_id long, text string")
    for keep in (False, True):
        got = packing.pack_documents(df, public_tokenizers.path("byte_bpe_50k.json"), 64, 1, keep_ids=keep).collect()
        assert sorted({r.doc_id for r in got} - {None}) == sorted(k for k in keys if k is not None) and None in {r.doc_id for r in got}


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_added_tokens_in_texts(name):
    path = public_tokenizers.path(name)
    t = Tokenizer.from_file(path)
    texts = ["a <|endoftext|> b", "<|endoftext|>", "<|EndOfText|> x", "no such token", "<|startoftext|>it<|endoftext|>"]
    encode = (lambda x: tokens.CachedEncoder.get(path).encode([x])[0]) if "word" in name else lambda x: tokens.LeadEncoder.get(path).encode(x).tobytes()
    for x in texts:
        assert np.frombuffer(encode(x), "<u4").tolist() == t.encode(x, add_special_tokens=False).ids, x


def test_fingerprints_have_no_cliff():
    r = random.Random(1)
    words = ["".join(r.choice("abcdefghilmnoprstu") for _ in range(r.randint(2, 9))) for _ in range(3000)]
    text = " ".join(r.choice(words) for _ in range(400))
    ranks = np.arange(fingerprints.BINS)[::-1].copy()
    for a, b in ((150, 154), (158, 162), (170, 174), (510, 514)):
        x, y, z = fingerprints.digests(*text_buffer(pa.array([text[:a], text[:b], text[-b:]], pa.large_string())), ranks)
        assert fingerprints.likeness(x, y) > 0.9 and fingerprints.likeness(x, z) < 0.2


def _plain_kneser_ney(grams: Counter, order: int):
    """Modified Kneser-Ney by dictionaries: what KneserNey does with sorted arrays."""
    levels = {order: grams}
    for n in range(order - 1, 0, -1):
        levels[n] = Counter(g[1:] for g in levels[n + 1])
    discounts, contexts = {}, {}
    for n, g in levels.items():
        few = [max(1, sum(c == k for c in g.values())) for k in (1, 2, 3, 4)]
        y = few[0] / (few[0] + 2 * few[1])
        discounts[n] = [0] + [min(max(k - (k + 1) * y * few[k] / few[k - 1], 0.1), k - 0.05) for k in (1, 2, 3)]
        contexts[n] = defaultdict(list)
        for x, c in g.items():
            contexts[n][x[:-1]].append(c)

    def p(x: bytes) -> float:
        if not x:
            return 1 / 256
        n, lower = len(x), p(x[1:])
        seen = contexts[n].get(x[:-1])
        if not seen:
            return lower
        d, c = discounts[n], levels[n].get(x, 0)
        left = sum(d[min(k, 3)] for k in seen)
        return (c - d[min(c, 3)]) / sum(seen) + left / sum(seen) * lower

    return p


@pytest.mark.parametrize("order", [1, 2, 3, 4, 5])
def test_kneser_ney_against_dictionaries(order):
    text = b"the cat sat on the mat, the dog sat on the log, and that was that; the end of the text."
    grams = Counter(text[i : i + order] for i in range(len(text) - order + 1))
    codes = np.array([int.from_bytes(g, "big") for g in grams], np.int64)
    model = perplexity.KneserNey(codes, np.array(list(grams.values()), np.int64), order)
    p = _plain_kneser_ney(grams, order)
    probes = [*grams, b"zzzzz"[:order], b"the q"[:order], b"at on"[:order]]
    got = model.logp(np.array([int.from_bytes(g, "big") for g in probes], np.int64))
    assert np.allclose(got, [math.log(p(g)) for g in probes])


def test_language_score_tells_odd_texts(spark):
    rows = [("the quick brown fox jumps over the lazy dog and runs away from the big bear", "en"), ("der schnelle braune fuchs springt ueber den faulen hund und laeuft davon", "de")] * 20
    model = language.fit(spark.createDataFrame(rows, "text string, lang string"))
    langs, score, _ = model.predict(["the dog and the bear run over the lazy fox and away", "zzz qqq"])
    assert langs[0] == "en" and score[0] > 0.95 and score[1] < 0.8


def test_more_labels_than_the_model_holds(spark, monkeypatch):
    monkeypatch.setattr(language, "MOST_LANGUAGES", 2)
    rows = [("one two", "a")] * 3 + [("three four", "b")] * 2 + [("five", "c")]
    assert language.fit(spark.createDataFrame(rows, "text string, lang string")).languages == ["a", "b"]


def test_token_files_of_one_repeated_key(spark, tmp_path):
    """A key that holds all rows goes over several ranges; starts stay gapless."""
    df = spark.createDataFrame([(7, f"text {i}") for i in range(300)], "doc_id long, text string")
    tokens.write_token_files(df, str(tmp_path / "f"), public_tokenizers.path("word_bpe_49k.json"), 2)
    got = sorted((r.start, r.n_tokens, r.ids_crc32, r.ids) for r in tokens.read_token_files(spark, str(tmp_path / "f")).collect())
    assert [s for s, *_ in got] == np.cumsum([0, *(n for _, n, *_ in got)])[:-1].tolist() and all(zlib.crc32(bytes(i)) == c for _, _, c, i in got)


def test_private_spans_beside_numbers():
    from lumentide.llm import private

    judge = private.fit_judge()

    def found(text):
        ((_, spans),) = private.found_spans([text], judge)
        return [(private.KINDS[k], text[s:e]) for s, k, e in spans]

    assert found("in 2024 212-555-0199 call") == [("phone", "212-555-0199")]
    assert found("212-555-0199 646-555-0123") == [("phone", "212-555-0199"), ("phone", "646-555-0123")]
    assert found("in the years 2019 2020 2021 and 2022") == []
    runs = [x for x in private._parts_of_runs("call 212 555 0199 646 now")]
    assert len({(s, e) for s, _, e in runs}) > 1 and any(a[0] < b[2] and b[0] < a[2] for a in runs for b in runs if a != b)


def test_written_shards_and_clashing_columns(spark, sf_dir, tmp_path):
    from lumentide.llm import sharding

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = sharding.write_shards(docs, str(tmp_path / "shards"), 4)
    assert got.count() == docs.count() and {r[0] for r in got.select("__shard").distinct().collect()} == {0, 1, 2, 3}
    with pytest.raises(ValueError):
        sharding.write_shards(docs.unionByName(docs), str(tmp_path / "again"), 4)
    out = perplexity.quality(docs.withColumn("bits", docs.doc_id), also=("bits", "source"))
    assert out.columns.count("bits") == 1 and dict(out.dtypes)["bits"] == "double" and "source" in out.columns


def test_pipeline_packs_every_id_of_its_input(spark, sf_dir):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {r.doc_id: len(t.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in docs.collect()}
    rows = corpus_pipeline.packing(spark, docs, sf_dir).collect()
    pieces = defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append((r.start, r.length))
        assert r.doc_tokens == want[r.doc_id]
    for k, v in pieces.items():
        v.sort()
        assert [s for s, _ in v] == np.cumsum([0, *(n for _, n in v)])[:-1].tolist() and sum(n for _, n in v) == want[k]
    windows = defaultdict(list)
    for r in rows:
        windows[r.sequence_id].append((r.offset, r.length))
    assert pieces.keys() == want.keys()
    for v in windows.values():
        v.sort()
        assert [o for o, _ in v] == np.cumsum([0, *(n for _, n in v)])[:-1].tolist() and sum(n for _, n in v) <= 2048


def test_blocks_are_dealt_like_plain_differencing():
    """differencing() against the textbook version on whole tuples of sums."""
    r = random.Random(2)
    for _ in range(30):
        sizes, k = [r.randint(1, 500) for _ in range(r.randint(1, 40))], r.randint(1, 6)
        parts = [[(s, [i])] + [(0, [])] * (k - 1) for i, s in enumerate(sizes)]
        while len(parts) > 1:
            parts.sort(key=lambda p: p[0][0] - p[-1][0])
            a, b = parts.pop(), parts.pop()
            parts.append(sorted(((x[0] + y[0], x[1] + y[1]) for x, y in zip(a, b[::-1], strict=True)), key=lambda x: -x[0]))
        plain = [s for s, _ in parts[0]]
        got = np.bincount(packing.differencing(np.array(sizes), k), sizes, k)
        assert got.max() - got.min() <= 1.05 * (max(plain) - min(plain)) + max(sizes) * 0.2
