"""The corpus operators against brute force, exact round trips and held-out accuracy; nulls, empties, ties, clashing names."""

import hashlib
import random
import re
import string
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest

from lumentide.llm import copies, fingerprints, jaccard, language, packing, pages, perplexity, pieces, private, queries, sharding, tokens

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [None, "", " ", "a", "été ça", "one two three", "\n\n", "x" * 5000, "numbers 12 and 3.4", "same same same " * 50]


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and long texts, repeated rows, clashing names."""
    rows = [(i if i else None, t, None if i % 3 == 0 else "en", None, None, "k") for i, t in enumerate(ODD)]
    return spark.createDataFrame([*rows, *rows[:4]], "doc_id long, text string, lang string, source string, n_chars long, score string")


@pytest.fixture(scope="module")
def empty(odd):
    return odd.where("false")


def test_shards_are_contiguous_and_even(docs, odd, empty):
    rows = sorted(sharding.assign_shards(docs, 16).collect(), key=lambda r: r.doc_id)
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert [r.shard for r in rows] == sorted(r.shard for r in rows)
    for r in rows:
        raw = (texts[r.doc_id] or "").encode()
        assert (r["size"], r.text_crc32) == (len(raw) + 1, zlib.crc32(raw))
    size = Counter()
    for s in {r.shard for r in rows}:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
    for r in rows:
        size[r.shard] += r["size"]
    total, most = sum(size.values()), max(r["size"] for r in rows)
    assert max(abs(v - total / 16) for v in size.values()) <= most
    assert sharding.assign_shards(odd, 4).count() == len(ODD) + 4 and sharding.assign_shards(empty).count() == 0


def test_pages():
    page = """<html><body><header class="site"><p>Brand, and, more, words here</p></header><nav><a href=x>Home</a></nav>
    <div class="content"><h1>Head &amp; line</h1><p>First paragraph, with commas, and enough   words to count for something.</p><div class="ad">Buy, now, cheap.</div>
    <p>Second <b>bold</b><br>text, also long enough to be part of the article.</p></div><div class="sidebar"><p>Other, things, to read.</p></div>
    <section id="comments"><p>Nice, very nice, I say.</p></section><script>if (a < b) { x("</p>") }</script><footer>(c)</footer></body></html>"""
    assert pages.main_text(page) == "Head & line\nFirst paragraph, with commas, and enough words to count for something.\nSecond bold text, also long enough to be part of the article."
    assert pages.main_text("") == "" and pages.main_text("<p") == "" and pages.main_text("plain") == "plain"
    assert pages.main_text("<div>" * 3000 + "deep") == "deep"


def test_pages_keep_text_under_names_and_after_dropped_elements():
    text = "First paragraph, with commas, and enough words to count for something."
    for names in ("site-content no-sidebar", "page has-sidebar", "content menu-closed", "post tag-news"):
        inner = f"<p>{text}</p><p>Second, of some length too, as it should be.</p>"
        page = f"<body><div class='{names}'>{inner}<div class='sidebar'>Other, things.</div></div><div class='ad'>Buy, now.</div></body>"
        assert pages.main_text(page) == f"{text}\nSecond, of some length too, as it should be."
    for opening in ("<li class='share'>", "<li hidden>"):
        assert pages.main_text(f"<article><p>{text}</p><ul>{opening}Share this<li>One item, of a list</ul><p>{text}</p></article>") == f"{text}\nOne item, of a list\n{text}"
    for opening in ("<p class='notice'>", "<p hidden>"):
        assert pages.main_text(f"<article>{opening}Note<p>{text}<p>{text}</article>") == f"{text}\n{text}"
    assert pages.main_text(f"<table><tr><td class='sidebar'>Links<td><p>{text}</p><p>{text}</p></table>") == f"{text}\n{text}"
    assert pages.main_text(f"<head><title>x</title><body><p>{text}") == text


def test_pages_of_the_table(spark, sf_dir):
    import html

    rows = {r.page_id: r for r in queries.op2_pages(spark, sf_dir).collect()}
    for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect():
        body = re.sub(r"<br>", " ", re.search(r"<article>(.*?)(</article>|\Z)", r.html, re.S)[1])
        parts = (re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]*>?", "", p))).strip() for p in re.split(r"</?(?:p|h1)>", body))
        assert rows[r.page_id].text == "\n".join(p for p in parts if p) and rows[r.page_id].n_chars == len(rows[r.page_id].text)


def test_fingerprints_tell_edits_from_others(docs, odd, empty):
    rows = {r.doc_id: r for r in fingerprints.fingerprints_of_edits(docs).collect()}
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    order = sorted(texts, reverse=True)
    for a, b in zip(order, order[1:] + order[:1]):
        t, c = texts[a], len(texts[a]) // 3
        assert rows[a].edited_sha256 == hashlib.sha256((t[: len(t) - c] + texts[b][:c]).encode()).hexdigest()
    long = [r for i, r in rows.items() if len(texts[i]) > 300]
    assert np.median([r.near_edited for r in long]) > 0.5 > np.median([r.near_next for r in long])
    by_text = {}
    for i, r in rows.items():
        assert by_text.setdefault(texts[i], r.fingerprint) == r.fingerprint
    assert fingerprints.fingerprints_of_edits(odd).count() == len(ODD) + 4 and fingerprints.fingerprints_of_edits(empty).count() == 0


def test_entropy_of_windows():
    data = np.frombuffer(random.Random(1).randbytes(300).replace(b"\x07", b"a") + b"a" * 90, np.uint8)
    for i, b in enumerate(fingerprints.window_bins(data)):
        n = np.bincount(data[i : i + 32])
        n = n[n > 0] / 32
        assert abs(b - (-(n * np.log2(n)).sum()) / 5 * 640) < 1.01


def test_quality_features_and_bands(docs, odd, empty):
    rows = {r.doc_id: r for r in perplexity.quality(docs).collect()}
    for d in docs.collect():
        w, t = WORD.findall(d.text or ""), d.text or ""
        seen = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        cover = {j for i in range(len(w) - 7) if seen[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        r = rows[d.doc_id]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(cover))
        assert r.base_failed == (len(w) < 20 or 100 * len(cover) > 30 * len(w)) and not (r.base_failed and r.kept)
    assert perplexity.quality(odd).count() == len(ODD) + 4 and perplexity.quality(empty).count() == 0


def test_model_is_a_distribution():
    r = random.Random(2)
    data = np.frombuffer("".join(r.choice("abc ") for _ in range(3000)).encode(), np.uint8)
    codes, n = np.unique(perplexity.gram_codes(data, 3), return_counts=True)
    kn = perplexity.KneserNey(codes, n, 3)
    for context in (b"ab", b"zz", b"az"):
        all_next = np.array([int.from_bytes(context + bytes([b]), "big") for b in range(256)], np.uint64)
        assert abs(np.exp(kn.logp(all_next)).sum() - 1) < 1e-3


def test_score_leaves_the_text_itself_out():
    """Equal to a model counted over the other texts, with the same discounts."""
    r = random.Random(9)
    texts = ["".join(r.choice("abcd ") for _ in range(n)).encode() for n in (90, 60, 4, 3, 70)]
    grams = lambda some: np.unique(np.concatenate([perplexity.gram_codes(np.frombuffer(t, np.uint8), 3) for t in some]), return_counts=True)
    every = perplexity.KneserNey(*grams(texts), 3)
    total, _, n = every.score(np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)]))
    for i, t in enumerate(texts):
        others = perplexity.KneserNey(*grams(texts[:i] + texts[i + 1 :]), 3)
        for k, level in others.levels.items():
            level.discount = every.levels[k].discount
        assert n[i] == len(t) - 2 and abs(total[i] - others.logp(perplexity.gram_codes(np.frombuffer(t, np.uint8), 3)).sum()) < 1e-9


def test_copies_do_not_change_what_stays(spark, docs):
    """Scores and bands with a text 300 times are those with it once."""
    one = docs.where("lang = 'en' and length(text) > 1500").orderBy("doc_id").limit(1)
    key = one.first().doc_id
    many = docs.unionByName(one.crossJoin(spark.range(300)).select(docs.columns))
    alone, among = ({(r.doc_id, r.bits, r.low, r.high, r.kept) for r in perplexity.quality(x).collect()} for x in (docs, many))
    assert alone == among and {x[4] for x in among if x[0] == key} == {True}


def gibberish(n_words, seed):
    r = random.Random(seed)
    letters = [string.ascii_lowercase, string.ascii_letters + "?!@^~=+/", "?!@^~=+/;:_()[]{}"][seed % 3]
    return " ".join("".join(r.choice(letters) for _ in range(r.randrange(3, 9))) for _ in range(n_words))


def test_gibberish_is_rejected_at_every_length(spark, docs):
    junk = [(10**9 + i, gibberish(n, i), "en", "s", 0) for i, n in enumerate(n for n in (25, 40, 200) for _ in range(12))]
    known = {r.text for r in docs.collect()}
    new = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("lang = 'en'").orderBy("doc_id").collect() if r.text not in known and len(r.text) > 1500][:40]
    clean = [(2 * 10**9 + i, " ".join(t.split()[:n]), "en", "s", 0) for i, (t, n) in enumerate(zip(new, [22, 25, 40, 80] * 10))]
    rows = perplexity.quality(docs.unionByName(spark.createDataFrame(junk + clean, docs.schema))).collect()
    assert not any(r.kept for r in rows if 10**9 <= r.doc_id < 2 * 10**9)
    short = [r for r in rows if r.doc_id >= 2 * 10**9 and not r.base_failed]
    assert len(short) > 30 and sum(r.kept for r in short) >= 0.95 * len(short)


def test_small_languages_have_their_own_bands(spark, docs):
    """English texts in Cyrillic letters stay, few or many of them; gibberish among many doesn't."""
    letters = {c: chr(0x430 + i) for i, c in enumerate(string.ascii_lowercase)} | {c: chr(0x410 + i) for i, c in enumerate(string.ascii_uppercase)}
    texts = ["".join(letters.get(c, c) for c in r.text) for r in docs.where("lang = 'en' and length(text) > 500").orderBy("doc_id").collect() if not re.search(r"[#*$%&|<>]", r.text)]
    for n in (2, 30, 60):
        rows = [(10**9 + i, t, "ru", "s", 0) for i, t in enumerate(texts[:n])] + [(2 * 10**9, gibberish(200, 1), "ru", "s", 0)] * (n > 2)
        got = [r for r in perplexity.quality(docs.unionByName(spark.createDataFrame(rows, docs.schema))).collect() if r.doc_id >= 10**9 and not r.base_failed]
        assert sum(r.kept for r in got if r.doc_id < 2 * 10**9) >= 0.95 * sum(r.doc_id < 2 * 10**9 for r in got) > 0
        assert not any(r.kept for r in got if r.doc_id == 2 * 10**9)


def test_model_keeps_its_order_at_every_size(spark):
    """More than 6 million different 5-grams, where the order once fell; the model in files equals the one in memory."""
    r = random.Random(8)
    rows = [(0, r.randbytes(9000).hex()), (1, "the same few words again and again")]
    made = perplexity.fit_model(spark.createDataFrame(rows, "doc_id long, text string"))
    all_grams = [perplexity.gram_codes(np.frombuffer(t.encode(), np.uint8), 5) for _, t in rows]
    codes, n = np.unique(np.concatenate(all_grams), return_counts=True)
    some = np.concatenate([all_grams[0][:2000], all_grams[1]])
    assert np.allclose(made.logp(some), perplexity.KneserNey(codes, n, 5).logp(some))
    wide = spark.range(64).selectExpr("id as doc_id", "concat_ws('', transform(sequence(0, 9999), i -> decode(unhex(substr(md5(concat(id, ' ', i)), 1, 16)), 'iso-8859-1'))) as text")
    assert perplexity.count_grams(wide, 5).count() > 6_000_000
    assert perplexity.fit_model(wide).order == perplexity.ORDER


PLAIN = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]


def plain_spans(t):
    out = []
    for k, p in enumerate(PLAIN):
        for m in re.finditer(p, t):
            d = re.sub("[^0-9]", "", m[0])
            if (k == 1 and any(int(x) > 255 for x in m[0].split("."))) or (k == 2 and not (14 <= len(d) <= 19 and private.luhn(d))) or (k == 3 and not 10 <= len(d) <= 15):
                continue
            out.append((m.start(), k, m.end()))
    return sorted(out)


def test_private_spans(docs, odd, empty):
    r = random.Random(3)
    for _ in range(5000):
        t = "".join(r.choice("ab1.9@-+ 0()4é") for _ in range(r.randrange(40)))
        assert private.base_spans(t) == plain_spans(t)
    judge = private.fit_judge()
    x, k, y = private.made_examples(2000, 99)
    cut = np.array(judge.thresholds)[k]
    picked = judge.probability(x) >= cut
    assert y[picked].mean() > 0.97 and picked[y == 1].mean() > 0.8
    base, every = private.found_spans(["call (212) 555-0199 or a@b.com"], judge)[0]
    assert set(base) <= set(every) and private.redacted("x a@b.com", [(2, 0, 9)]) == "x [EMAIL]"
    assert private.find_private(odd).count() == len(ODD) + 4 and private.redact(empty).count() == 0
    assert private.redact(odd).columns == odd.columns


def components(texts, k, percent):
    low = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
    sets = {}
    for d, t in texts.items():
        w = WORD.findall((t or "").translate(low))
        sets[d] = {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    x, y = sorted((find(a), find(b)))
                    root[y] = x
    return {d: (len(sets[d]), find(d)) for d in sets}


@pytest.mark.parametrize("k,percent", [(4, 85), (5, 80)])
def test_jaccard_components(spark, k, percent):
    r = random.Random(k)
    word = lambda: "".join(r.choice("abcdef") for _ in range(4))
    base = [[word() for _ in range(r.choice((5, 30, 120)))] for _ in range(6)]
    texts = {0: None, 1: "", 2: "one", 3: "One", 4: "one two"}
    passage = [word() for _ in range(60)]
    for i in range(5, 200):
        w = list(r.choice(base))
        for _ in range(r.choice((0, 0, 1, 2, 4, 8))):
            w[r.randrange(len(w))] = word()
        texts[i] = " ".join(w + (passage if r.random() < 0.3 else []))
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in jaccard.linked_components(df, k, percent).collect()}
    assert got == components(texts, k, percent)


@pytest.mark.parametrize("k, percent", [(4, 85), (5, 80)])
def test_jaccard_of_sets_of_unequal_size(spark, k, percent):
    """Texts cut down to the least similar size, beside passages that many texts share, so that prefixes differ in length."""
    r = random.Random(percent)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    passages = [[word() for _ in range(12)] for _ in range(4)]
    texts = {}
    for i in range(0, 360, 2):
        w = [word() for _ in range(r.choice((6, 12, 20, 44)))] + (r.choice(passages) if r.random() < 0.7 else [])
        n = len(w) - k + 1
        texts[i], texts[i + 1] = " ".join(w), " ".join(w[: len(w) - int(n * (100 - percent) / 100)])
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in jaccard.linked_components(df, k, percent).collect()}
    assert got == components(texts, k, percent)


def test_jaccard_odd_rows(odd, empty):
    rows = jaccard.linked_components(odd, 4, 85).collect()
    assert len(rows) == len(ODD) + 4 and jaccard.linked_components(empty, 4, 85).count() == 0


def test_differencing_fills_windows():
    sizes = np.random.default_rng(4).integers(20, 512, 1200)
    at = packing.fill_windows(sizes, 2048)
    load = np.bincount(at, sizes)
    assert load.max() <= 2048 and sizes.sum() / (2048 * len(load)) > 0.95


def test_packing_holds_every_id_once(docs, odd, empty):
    path = public_tokenizers.path("byte_bpe_50k.json")
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    rows = packing.pack_documents(docs, path, keep_ids=True).collect()
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
        assert zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length
    for d in docs.collect():
        ids = np.array([*t.encode(d.text or "", add_special_tokens=False).ids, 1], "<u4")
        pieces_ = sorted(by_doc[d.doc_id], key=lambda r: r.start)
        assert b"".join(bytes(p.ids) for p in pieces_) == ids.tobytes() and all(p.doc_tokens == len(ids) for p in pieces_)
    for s in by_seq.values():
        at = 0
        for r in sorted(s, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
    assert packing.pack_documents(odd, path).count() >= len(ODD) + 4 and packing.pack_documents(empty, path).count() == 0


def test_language_held_out(docs, odd, empty):
    from pyspark.sql import functions as F

    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    model = language.fit(docs.where(~held))
    got = language.predict(docs.where(held & F.col("lang").isNotNull()), model).collect()
    assert sum(r.lang == r.lang_pred for r in got) > 0.97 * len(got)
    rows = language.predict(odd, model).collect()
    assert all(r.lang_pred == "und" for r in rows if not re.search(r"[^\W\d_]", r.text or "")) and len(rows) == len(ODD) + 4
    none = language.fit(empty)
    assert {r.lang_pred for r in language.predict(odd, none).collect()} == {"und"}


def test_mixed_text_gets_both_languages():
    rng = np.random.default_rng(0)
    texts = {"a": "abab baba abba " * 40, "b": "xyxy yxyx xyyx " * 40}
    logp = np.full((2, language.SLOTS), np.log(0.01 / language.SLOTS), np.float32)
    for j, t in enumerate(texts.values()):
        n = np.bincount(language.words_of([t])[0], minlength=language.SLOTS)
        logp[j] = np.log(0.99 * n / n.sum() + 0.01 / language.SLOTS)
    names, score, share = language.Model(["a", "b"], logp).predict([texts["a"], texts["a"] + texts["b"]])
    assert names[0] == "a" and score[0] == 1 and (share[1] > 0.4).all() and rng is not None


def test_token_files_round_trip(spark, docs, odd, empty, tmp_path):
    path = public_tokenizers.path("word_bpe_49k.json")
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    tokens.write_token_files(docs, f"file://{tmp_path}/a", path, 2)
    rows = sorted(tokens.read_token_files(spark, f"file://{tmp_path}/a").collect(), key=lambda r: r.doc_id)
    start = 0
    for r, d in zip(rows, sorted(docs.collect(), key=lambda d: d.doc_id), strict=True):
        ids = np.array([*t.encode(d.text or "", add_special_tokens=False).ids, 2], "<u4").tobytes()
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (d.doc_id, start, len(ids) // 4, zlib.crc32(ids))
        start += r.n_tokens
    tokens.write_token_files(odd, f"file://{tmp_path}/b", path, 2)
    assert tokens.read_token_files(spark, f"file://{tmp_path}/b").count() == len(ODD) + 4
    tokens.write_token_files(empty, f"file://{tmp_path}/c", path, 2)
    assert tokens.read_token_files(spark, f"file://{tmp_path}/c").count() == 0


def test_simple8b():
    r = np.random.default_rng(5)
    for n in (0, 1, 511, 512, 513, 3000):
        for top in (1, 2, 300, 50_000, 1 << 20, 1 << 32):
            x = r.integers(0, top, n, dtype=np.uint64)
            if n > 9:
                x[3] = (1 << 32) - 1
            blob = tokens.pack_ids(x)
            assert (tokens.unpack_ids(blob) == x).all()
            if n == 3000:
                assert all((tokens.unpack_block(blob, i) == x[512 * i : 512 * i + 512]).all() for i in range(6))


def test_pieces_equal_the_library(docs, odd, empty):
    path = public_tokenizers.path("piece_bpe_32k.model")
    e = pieces.PieceEncoder.get(path)
    r = random.Random(6)
    some = [t or "" for t in ODD] + ["▁a ▁", "</s> <0x0A> x", "\x00a", "数字 漢字", "a​b", "=======", "aaaaaaaa"]
    some += ["".join(r.choice("abcdeiorst .,\n=-_/é漢") for _ in range(r.randrange(40))) for _ in range(3000)]
    for t in some:
        assert e.encode(t) == e.library.encode(t)
    for row, d in zip(sorted(pieces.encode_decode(docs, path).collect(), key=lambda x: x.doc_id), sorted(docs.collect(), key=lambda x: x.doc_id), strict=True):
        ids = e.library.encode(d.text or "") + [e.end]
        assert row.n_tokens == len(ids) and row.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256(e.library.decode(ids).encode()).hexdigest()
    assert pieces.encode_decode(odd, path).count() == len(ODD) + 4 and pieces.encode_decode(empty, path).count() == 0


def test_pipeline_stages(spark, odd, empty, sf_dir):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    ids = {r.doc_id for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == list(corpus_pipeline.COLUMNS) and {r.doc_id for r in out.collect()} <= ids
        assert stage(spark, empty, sf_dir).count() == 0, name
        stage(spark, odd, sf_dir).count()
    kept = {r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, sf_dir).collect()}
    want = components({r.doc_id: r.text for r in docs.collect()}, 5, 80)
    assert kept == {d for d, (_, c) in want.items() if d == c}


def test_pipeline_keeps_rows_without_labels_or_own_keys(spark, sf_dir, docs):
    import corpus_pipeline
    from pyspark.sql import functions as F

    bare = docs.withColumn("lang", F.lit(None).cast("string"))
    assert corpus_pipeline.language(spark, bare, sf_dir).count() == docs.count()
    texts = ["alpha beta gamma delta epsilon zeta", "one two three four five six seven", "red green blue white black pink"]
    rows = [(None, t, "en", "s", 0) for t in texts] + [(7, t + " more", "en", "s", 0) for t in texts[:2]] + [(7, texts[0], "en", "s", 0), (8, texts[2] + " more", "en", "s", 0), (9, texts[2] + " more", "en", "s", 0)]
    kept = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, docs.schema), sf_dir).collect()
    # of equal texts the row of the least key (null first) stays; texts that differ stay, whatever their keys
    assert sorted((r.doc_id or 0, r.text) for r in kept) == sorted({(0, t) for t in texts} | {(7, t + " more") for t in texts[:2]} | {(8, texts[2] + " more")})


def test_pipeline_stages_by_plain_loops(spark, sf_dir):
    """near_duplicates has its own in test_pipeline_stages."""
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("doc_id % 3 = 0 or lang = 'es'")
    rows = docs.collect()
    stage = lambda f: {r.doc_id: r for r in f(spark, docs, sf_dir).collect()}
    assert set(stage(corpus_pipeline.language)) == {r.doc_id for r in rows if re.search(r"[^\W\d_]", r.text or "")}
    # quality: the model of all other texts, in memory
    texts = {i: (t or "").encode() for i, t in ((r.doc_id, r.text) for r in rows)}
    different = sorted(set(texts.values()))
    # near copies of each other count as one text, and have one place in the quartiles
    keyed = {(r.text or "").encode(): r.k for r in docs.select("text", copies.text_key("text").alias("k")).collect()}
    related = {r.text_key: (r.family, r.texts) for r in copies.near_copies(docs).collect()}
    family = {t: related.get(keyed[t], (keyed[t], 1)) for t in different}
    weights: dict[int, float] = Counter()
    for t in different:
        for c in perplexity.gram_codes(np.frombuffer(t, np.uint8), 5).tolist():
            weights[c] += 1 / family[t][1]
    codes = np.array(sorted(weights), np.uint64)
    model = perplexity.KneserNey(codes, np.array([max(1, int(weights[c] + 0.5 + 1e-6)) for c in codes.tolist()], np.int64), 5)
    total, squares, n = model.score(np.frombuffer(b"".join(different), np.uint8), np.cumsum([0, *map(len, different)]))
    bits = -total / np.maximum(n, 1) / np.log(2)
    spread = squares / np.maximum(n, 1) / np.log(2) ** 2 - bits**2
    place = {t: i for i, t in enumerate(different)}
    at = lambda x, q: sorted(x)[max(0, -(-int(q * 100) * len(x) // 100) - 1)]
    want = set()
    for lang in {r.lang for r in rows}:
        mine = defaultdict(list)
        for i in {place[texts[r.doc_id]] for r in rows if r.lang == lang}:
            if n[i]:
                mine[family[different[i]][0]].append(i)
        own = list(mine)
        mean = lambda x: np.array([x[i].mean() for i in mine.values()])
        low, high, error = at(mean(bits), 0.25), at(mean(bits), 0.75), at(mean(spread), 0.5) ** 0.5
        span = max(high - low, 0.05) + 8 / len(own)
        for r in rows:
            if r.lang == lang:
                i, w = place[texts[r.doc_id]], WORD.findall(r.text or "")
                seen = Counter(tuple(w[j : j + 8]) for j in range(len(w) - 7))
                cover = {k for j in range(len(w) - 7) if seen[tuple(w[j : j + 8])] > 1 for k in range(j, j + 8)}
                further = 3 * error * max(0, max(n[i], 1) ** -0.5 - at(mean(n), 0.5) ** -0.5)
                if len(w) >= 20 and 100 * len(cover) <= 30 * len(w) and low - 2.5 * span - further <= bits[i] <= high + 2 * span + further:
                    want.add(r.doc_id)
    assert set(stage(corpus_pipeline.quality)) == want
    judge = private.fit_judge()
    hidden = stage(corpus_pipeline.private)
    for r in rows:
        _, every = private.found_spans([r.text or ""], judge)[0]
        text = None if r.text is None else private.redacted(r.text, every)
        assert (hidden[r.doc_id].text, hidden[r.doc_id].n_chars) == (text, None if text is None else len(text))
    pieces_of = Counter(r.doc_id for r in corpus_pipeline.packing(spark, docs, sf_dir).collect())
    assert set(pieces_of) == set(texts)
