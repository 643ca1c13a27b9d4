"""Quality rules: counts of words, symbols and repeats, and an n-gram perplexity band for each language."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, mix64, partitions, segment_hashes, session_setup, shared_dir, stored, text_buffer, word_bounds
from .copies import near_copies, text_key

#: How many UTF-8 bytes an n-gram has, at every size of input.
ORDER = 5
#: About how many n-grams one shard of the model holds, so that the task which writes it stays small.
SHARD_GRAMS = 2_000_000
#: About how many a shard holds at least where there are more partitions than that needs: each shard costs every lookup a step.
LEAST_GRAMS = 100_000
#: What a language's spread is widened by, in bits, divided by its number of different texts: the fewer there are, the less
#: they say of it. A byte has 8 bits.
WIDEN_BITS = 8.0
#: How many interquartile ranges beyond the quartiles a language's band reaches, down and up.
REACH_DOWN, REACH_UP = 2.5, 2.0
#: How many standard errors of a mean of bits a band reaches further for a text shorter than its language's median one,
#: less those of the median one: the scores of short texts scatter.
REACH_ERRORS = 3.0
#: Languages up to which their bands are sent to every executor; more are joined by a shuffle.
MOST_BANDS = 100_000
MIN_WORDS, REPEAT_WINDOW, MAX_REPEAT = 20, 8, 30
SYMBOLS = b"#*$%&|<>"


def gram_codes(data: np.ndarray, n: int) -> np.ndarray:
    """The n bytes from each position on as one number."""
    m = len(data) - n + 1
    code = np.zeros(max(m, 0), np.uint64)
    if m > 0:
        for k in range(n):
            code <<= np.uint64(8)
            code |= data[k : k + m]
    return code


def _whole(offsets: np.ndarray, m: int, n: int) -> np.ndarray:
    """Whether the n bytes from each of m positions on lie in one text."""
    edge = np.zeros(m + 1, np.int32)
    np.add.at(edge, np.clip(offsets[1:-1] - n + 1, 0, m), 1)
    np.add.at(edge, np.clip(offsets[1:-1], 0, m), -1)
    return np.cumsum(edge[:-1]) == 0


def _different(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different ones of some numbers, ascending, and the place of each number among them."""
    shift = len(keys).bit_length()
    if not len(keys) or int(keys.max()) >> (63 - shift):  # no room for a place beside a number
        return np.unique(keys, return_inverse=True)
    both = np.sort((keys << shift) | np.arange(len(keys)))  # much faster than sorting places by numbers
    at = both & ((1 << shift) - 1)
    both >>= shift
    new = np.append(True, both[1:] != both[:-1])
    back = np.empty(len(keys), np.int64)
    back[at] = np.cumsum(new) - 1
    return both[new], back


def count_grams(docs: DataFrame, order: int, text: str = "text", copies: "Level | None" = None) -> DataFrame:
    """How often each n-gram stands in the different texts: (gram, n). Tasks count what they read, Spark adds up.

    A text for which `copies` has m counts as 1/m each time, so that all its copies and near copies count as one text.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, counts = np.zeros(0, np.uint64), np.zeros(0)

        def merge(parts: list) -> tuple[np.ndarray, np.ndarray]:
            c = np.concatenate([p[0] for p in parts])
            by = np.argsort(c, kind="stable")
            c, k = c[by], np.concatenate([p[1] for p in parts])[by]
            first = np.flatnonzero(np.append(True, c[1:] != c[:-1])) if len(c) else np.zeros(0, np.int64)
            return c[first], np.add.reduceat(k, first) if len(first) else k

        held: list = []
        size = 0
        for batch in batches:
            data, offsets = text_buffer(batch.column(0))
            code = gram_codes(data, order)
            whole = _whole(offsets, len(code), order)
            times = np.ones(len(batch), np.int64)
            if copies is not None:
                texts, back = np.unique(batch.column(1).to_numpy(), return_inverse=True)
                times = np.maximum(copies.find(texts)[0][back], 1)
            each = np.repeat(times, np.diff(offsets))[: len(code)]
            for m in np.unique(times):
                some, n = np.unique(code[whole & (each == m)], return_counts=True)
                held.append((some, n / m))
                size += len(some)
            if size > max(1 << 21, len(codes)):
                codes, counts = merge([(codes, counts), *held])
                held, size = [], 0
            if len(codes) > 1 << 22:  # a task's memory is bounded: what it has goes out, Spark adds it up
                yield pa.RecordBatch.from_arrays([pa.array(codes.view(np.int64)), pa.array(counts)], names=["gram", "n"])
                codes, counts = codes[:0], counts[:0]
        if held or len(codes):
            codes, counts = merge([(codes, counts), *held])
            for i in range(0, len(codes), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(codes[i : i + (1 << 16)].view(np.int64)), pa.array(counts[i : i + (1 << 16)])], names=["gram", "n"])

    parts = docs.select(F.col(text), text_key(text)).mapInArrow(count, "gram long, n double")
    # halves go up, also where a sum of many parts falls short of one by its last bits
    return parts.groupBy("gram").agg(F.greatest(F.round(F.sum("n") + 1e-6), F.lit(1)).cast("long").alias("n"))


def packed(codes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, int]:
    """Ascending n-grams with their counts as one array of integers, and how many contexts they have.

    After codes and counts come the contexts (the n-grams less their last byte), and of each the sum of counts and how
    many n-grams it has that stand once, twice, and more often.
    """
    context = codes >> 8
    first = np.flatnonzero(np.append(True, context[1:] != context[:-1])) if len(codes) else np.zeros(0, np.int64)
    sums = [np.add.reduceat(x.astype(np.int64), first) if len(first) else first for x in (counts, counts == 1, counts == 2, counts > 2)]
    return np.concatenate([codes, counts, context[first], *sums]).astype(np.int64), len(first)


@dataclass
class Shard:
    """A range of one length's n-grams that holds whole contexts; the packed array itself, or the file it is in."""

    first: int  # the least context
    rows: int
    contexts: int
    source: np.ndarray | str

    def parts(self) -> tuple[np.ndarray, ...]:
        """Codes, counts, contexts, and their sums (4 x contexts). Files are mapped, not read."""
        whole = self.source if isinstance(self.source, np.ndarray) else np.asarray(np.memmap(_local_file(self.source), np.int64, "r"))
        r, c = self.rows, self.contexts
        return whole[:r], whole[r : 2 * r], whole[2 * r : 2 * r + c], whole[2 * r + c :].reshape(4, c)


def _local_file(uri: str) -> str:
    """The path of a file in the shared folder; where that isn't a mounted one, of a copy in the executor's own folder."""
    store, path = fs.FileSystem.from_uri(uri)
    if isinstance(store, fs.LocalFileSystem):
        return path
    copy = os.path.join(tempfile.gettempdir(), os.path.basename(path))
    if not os.path.exists(copy):
        part = f"{copy}-{uuid.uuid4().hex}"
        fs.copy_files(path, part, source_filesystem=store, destination_filesystem=fs.LocalFileSystem())
        os.replace(part, copy)
    return copy


class Level:
    """One length's n-grams in shards, and the three discounts of modified Kneser-Ney."""

    def __init__(self, shards: list[Shard], few: list[int]):
        self.shards = sorted(shards, key=lambda x: x.first)
        few = [max(1, n) for n in few]  # how many n-grams stand 1, 2, 3, 4 times
        y = few[0] / (few[0] + 2 * few[1])
        self.discount = np.array([0, *(min(max(k - (k + 1) * y * few[k] / few[k - 1], 0.1), k - 0.05) for k in (1, 2, 3))])
        self.open: dict[int, tuple[np.ndarray, ...]] = {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"open": {}}

    def find(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The count of each of some ascending n-grams (0 where there is none), its context's place among theirs, and the contexts' sums."""
        n = np.zeros(len(codes), np.int64)
        context = codes >> 8
        new = np.append(True, context[1:] != context[:-1])[: len(codes)]
        place = np.cumsum(new) - 1
        context = context[new]
        sums = np.zeros((4, len(context)), np.int64)
        firsts = np.array([x.first for x in self.shards[1:]], np.int64)
        cut, cut_context = np.searchsorted(codes, firsts << 8), np.searchsorted(context, firsts)  # shards hold whole contexts
        for i, (lo, hi, a, b) in enumerate(zip([0, *cut], [*cut, len(codes)], [0, *cut_context], [*cut_context, len(context)], strict=True)):
            if lo == hi or i >= len(self.shards):
                continue
            if i not in self.open:
                self.open[i] = self.shards[i].parts()
            known, counts, contexts, of = self.open[i]
            some = codes[lo:hi]
            at = np.minimum(np.searchsorted(known, some), len(known) - 1)
            n[lo:hi] = np.where(known[at] == some, counts[at], 0)
            some = context[a:b]
            at = np.minimum(np.searchsorted(contexts, some), len(contexts) - 1)
            sums[:, a:b] = np.where(contexts[at] == some, of[:, at], 0)
        return n, place, sums


class KneserNey:
    """Modified Kneser-Ney model over bytes: interpolated, three discounts an order, continuation counts below the top."""

    def __init__(self, codes: np.ndarray, counts: np.ndarray, order: int):
        by = np.argsort(codes)
        codes, counts = codes[by].astype(np.int64), counts[by].astype(np.int64)
        self.order, self.levels = order, {}
        for n in range(order, 0, -1):
            array, contexts = packed(codes, counts)
            self.levels[n] = Level([Shard(int(codes[0]) >> 8, len(codes), contexts, array)], [int((counts == k).sum()) for k in (1, 2, 3, 4)])
            codes, counts = np.unique(codes & ((1 << 8 * (n - 1)) - 1), return_counts=True)  # how many different bytes stand before each shorter n-gram

    @classmethod
    def of(cls, levels: dict[int, Level]) -> "KneserNey":
        model = cls.__new__(cls)
        model.order, model.levels = max(levels), levels
        return model

    def _logp(self, keys: np.ndarray, own: np.ndarray | None = None) -> np.ndarray:
        """Log probability of the last byte of n-grams of the model's order after the bytes before it.

        A key is a text's number and an n-gram; keys ascend. `own` is how often the text has the n-gram: all counts
        are then those of the other texts, at each length, as if the text had not been counted.
        """
        shift = 8 * self.order
        steps: list[tuple] = []
        codes, back = _different(keys & ((1 << shift) - 1))
        for n in range(self.order, 0, -1):
            found, place, sums = self.levels[n].find(codes)
            count = found[back]
            context = keys >> 8
            new = np.append(True, context[1:] != context[:-1])[: len(keys)]
            first = np.flatnonzero(new)  # a text's keys of one context
            sums = sums[:, place[back[first]]]
            if own is not None and len(first):
                left = np.maximum(count - own, 0)
                gone = (count > 0) & (left == 0)
                sums[0] -= np.add.reduceat(count - left, first)
                rare = np.flatnonzero(left < 3)  # the others stand more than twice before and after
                group = (np.cumsum(new) - 1)[rare]
                was, now = np.minimum(count[rare], 3), left[rare]
                for k in (1, 2, 3):
                    sums[k] -= np.bincount(group[was == k], minlength=len(first)) - np.bincount(group[now == k], minlength=len(first))
                count, sums = left, np.maximum(sums, 0)
            shorter, up = _different((keys >> shift << shift) | (keys & ((1 << 8 * (n - 1)) - 1)))
            discount, total = self.levels[n].discount, np.maximum(sums[0], 1)
            times = np.diff(np.append(first, len(keys)))
            seen, share, rest = (np.repeat(x, times) for x in (sums[0] > 0, 1 / total, discount[1:] @ sums[1:] / total))
            steps.append((seen, (count - discount[np.minimum(count, 3)]) * share, rest, up))
            if own is not None:
                own = np.bincount(up[gone], minlength=len(shorter)) if len(keys) else own  # each different longer n-gram counted once
            codes, to = _different(codes & ((1 << 8 * (n - 1)) - 1))  # the shorter keys' n-grams by those of the longer: far fewer than keys
            longer = np.empty(len(shorter), np.int64)
            longer[up] = back
            keys, back = shorter, to[longer]
        p = np.full(len(keys), 1 / 256)
        for seen, own_part, rest, up in reversed(steps):
            p = p[up]
            p = np.where(seen, own_part + rest * p, p)
        return np.log(p)

    def logp(self, codes: np.ndarray) -> np.ndarray:
        """Log probability of the last byte of each n-gram of the model's order after the bytes before it."""
        keys, back = np.unique(codes.astype(np.int64), return_inverse=True)
        return self._logp(keys)[back]

    def score(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each text: the sum of log probabilities by a model of the other texts, that of their squares, and how many bytes they are of (those with a full context).

        The texts must be among those that the model was counted over, and what their families count as is what each has itself.
        """
        rows = len(offsets) - 1
        codes = gram_codes(data, self.order).view(np.int64)
        at = np.flatnonzero(_whole(offsets, len(codes), self.order))
        row = np.repeat(np.arange(rows), np.diff(offsets))[at]
        keys, own = np.unique(row << 8 * self.order | codes[at], return_counts=True)
        p = self._logp(keys, own)
        text = keys >> 8 * self.order
        return np.bincount(text, own * p, minlength=rows), np.bincount(text, own * p * p, minlength=rows), np.maximum(np.diff(offsets) - self.order + 1, 0)


def sharded(grams: DataFrame, name: str) -> tuple[list[Shard], list[int]]:
    """Writes a table (gram, n) as sorted arrays in the shared folder; also gives how many n-grams stand 1, 2, 3, 4 times."""
    spark = grams.sparkSession
    folder = f"{shared_dir(spark)}/tables/{name}-{uuid.uuid4().hex}"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
        if not held:
            return
        codes, counts = (np.concatenate(x) for x in zip(*held, strict=True))
        array, contexts = packed(codes, counts)
        store, path = fs.FileSystem.from_uri(folder)
        store.create_dir(path, recursive=True)
        file = uuid.uuid4().hex  # a task that runs again writes another file; only what it yields counts
        with store.open_output_stream(f"{path}/{file}") as out:
            out.write(array.tobytes())
        row = {"first": int(codes[0]) >> 8, "size": len(codes), "contexts": contexts, "file": file, "few": [int((counts == k).sum()) for k in (1, 2, 3, 4)]}
        yield pa.RecordBatch.from_pylist([row])

    rows = grams.count()
    parts = max(min(partitions(spark), 1 + rows // LEAST_GRAMS), 1 + rows // SHARD_GRAMS)
    ranges = grams.repartitionByRange(parts, F.shiftright("gram", 8)).sortWithinPartitions("gram")
    got = ranges.mapInArrow(write, "first long, size long, contexts long, file string, few array<long>").collect()
    return [Shard(r["first"], r["size"], r["contexts"], f"{folder}/{r['file']}") for r in got], [sum(r["few"][k] for r in got) for k in range(4)]


def fit_model(docs: DataFrame, text: str = "text", order: int = ORDER, families: DataFrame | None = None) -> KneserNey | None:
    """Counts the n-grams of families of near copies in Spark and writes the model to the shared folder; None where there are none."""
    session_setup(docs.sparkSession)
    levels = {}
    families = near_copies(docs, text) if families is None else families
    shards, few = sharded(families.select(F.col("text_key").alias("gram"), (F.col("rows") * F.col("texts")).alias("n")), "copies")
    grams = stored(count_grams(docs, order, text, Level(shards, few) if shards else None), "grams")
    for n in range(order, 0, -1):
        shards, few = sharded(grams, f"grams{n}")
        if not shards:
            return None
        levels[n] = Level(shards, few)
        if n > 1:  # how many different bytes stand before each shorter n-gram
            longer = grams
            grams = stored(longer.groupBy(F.col("gram").bitwiseAND(F.lit((1 << 8 * (n - 1)) - 1)).alias("gram")).agg(F.count("*").alias("n")), "grams")
            dropped(longer)
    dropped(grams)
    return KneserNey.of(levels)


def _portions(offsets: np.ndarray, most: int = 1 << 17) -> list[tuple[int, int]]:
    """Runs of rows of at most `most` bytes (or one row), so that what scoring holds at a time is bounded by a text, not by a batch."""
    cuts, rows = [0], len(offsets) - 1
    while cuts[-1] < rows:
        cuts.append(max(cuts[-1] + 1, int(np.searchsorted(offsets, offsets[cuts[-1]] + most, side="right")) - 1))
    return list(zip(cuts, cuts[1:], strict=False)) or [(0, 0)]


FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def text_features(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """FEATURES of each text, by hashes of words, lines and windows of eight words."""
    rows = len(offsets) - 1
    starts, ends, row = word_bounds(data, offsets)
    n_words = np.bincount(row, minlength=rows)
    opens = np.append(0, np.cumsum((data & 0xC0) != 0x80))  # bytes that begin a code point
    word_chars = np.bincount(row, opens[ends] - opens[starts], minlength=rows).astype(np.int64)
    marks = np.zeros(256, bool)
    marks[list(SYMBOLS)] = True
    is_mark = np.append(0, np.cumsum(marks[data]))
    n_symbols = is_mark[offsets[1:]] - is_mark[offsets[:-1]]
    # lines
    cut = np.flatnonzero(data == 10)
    line_from, line_to = np.sort(np.concatenate([offsets[:-1], cut + 1])), np.sort(np.concatenate([cut, offsets[1:]]))
    has_word = np.searchsorted(starts, line_from) < np.searchsorted(starts, line_to)
    line_from, line_to = line_from[has_word], line_to[has_word]
    line_row = np.searchsorted(offsets, line_from, side="right") - 1
    h = segment_hashes(data, line_from, line_to)
    key = mix64(h + mix64(line_row.astype(np.uint64)))
    n_dup = np.bincount(line_row, minlength=rows)
    seen = np.unique(key, return_index=True)[1]
    n_dup = n_dup - np.bincount(line_row[seen], minlength=rows)
    # windows of words
    w = segment_hashes(data, starts, ends)
    m = len(w) - REPEAT_WINDOW + 1
    n_repeat = np.zeros(rows, np.int64)
    if m > 0:
        window = np.zeros(m, np.uint64)
        for k in range(REPEAT_WINDOW):
            window = mix64(window + w[k : k + m])
        inside = row[:m] == row[REPEAT_WINDOW - 1 :]
        at = np.flatnonzero(inside)
        key = mix64(window[at] + mix64(row[at].astype(np.uint64)))
        by = np.argsort(key, kind="stable")
        s = key[by]
        same = s[1:] == s[:-1]
        twice = np.zeros(len(at), bool)
        twice[by[1:][same]] = True
        twice[by[:-1][same]] = True
        cover = np.zeros(len(w) + 1, np.int32)
        np.add.at(cover, at[twice], 1)
        np.add.at(cover, at[twice] + REPEAT_WINDOW, -1)
        n_repeat = np.bincount(row[np.cumsum(cover[:-1]) > 0], minlength=rows)
    return [n_words, word_chars, n_symbols, n_dup, n_repeat]


def quality(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", reach: tuple[float, float] = (REACH_DOWN, REACH_UP), also: tuple[str, ...] = ()) -> DataFrame:
    """Scores every whole text and decides which documents stay.

    A byte n-gram model with modified Kneser-Ney smoothing is counted over all texts, each family of near copies
    (copies.near_copies) as one text however large it is. A document's bits a byte are those of its bytes with a full context, by the
    counts less its own, which stand for its family's. Quartiles, too, take each family once in a language, by its mean. Each language's band reaches `reach` interquartile ranges below the lower
    and above the upper quartile of its texts; the fewer texts a language has, the
    wider its band, and it is never that of other languages.
    For texts shorter than the language's median one the band is wider by REACH_ERRORS standard errors of a mean of so
    many bytes' bits, less those of the median one; low and high are the document's own bounds. Null lang is a language
    of its own. base_failed: fewer than MIN_WORDS words, or more than MAX_REPEAT % of words
    in repeated windows. kept: neither base_failed nor outside the band. Null text has no words and fails.
    Texts shorter than an n-gram have no score and fail by their words. An empty table gives no rows.

    Returns key, FEATURES, base_failed, bits (null without score), low, high, kept, and the columns of `also`
    (those named as one of the results are replaced by it).
    """
    spark = docs.sparkSession
    session_setup(spark)
    also = tuple(c for c in also if c not in (*FEATURES, "base_failed", "bits", "low", "high", "kept"))
    families = near_copies(docs, text)
    model = fit_model(docs, text, families=families)
    shared = spark.sparkContext.broadcast(model)  # the names of its shards
    extra = [*dict.fromkeys((key, lang, *also))]

    def score(carried: list[str], features: tuple[str, ...]) -> DataFrame:
        """Scores with the columns carried, and with the counts of words where they are asked for."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            kn = shared.value
            for batch in batches:
                data, offsets = text_buffer(batch.column(0))
                found, scores = [], []
                for i, j in _portions(offsets):
                    part, bounds = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                    found.append(text_features(part, bounds) if features else [])
                    scores.append(kn.score(part, bounds) if kn is not None else (np.zeros(j - i), np.zeros(j - i), np.zeros(j - i, np.int64)))
                found, (total, squares, n) = ([np.concatenate(x) for x in zip(*y, strict=True)] for y in (found, scores))
                bits = -total / np.maximum(n, 1) / np.log(2)
                spread = np.maximum(squares / np.maximum(n, 1) / np.log(2) ** 2 - bits**2, 0)  # variance of the bits of single bytes
                arrays = [*(pa.array(x, pa.int64()) for x in found), pa.array(bits, mask=n == 0), pa.array(n, pa.int64()), pa.array(spread), *batch.columns[1:]]
                yield pa.RecordBatch.from_arrays(arrays, names=[*features, "bits", "n_scored", "spread", "text_key", *places])

        places = {f"c{extra.index(c)}": c for c in carried}
        kinds = "".join(f", {at} {docs.schema[c].dataType.simpleString()}" for at, c in places.items())
        taken = docs.select(F.col(text).alias("t"), text_key(text).alias("k"), *(F.col(c).alias(at) for at, c in places.items()))
        return taken.mapInArrow(run, f"{''.join(f + ' long, ' for f in features)}bits double, n_scored long, spread double, text_key long{kinds}")

    # Columns of `also` can be as large as the texts: such rows are scored again, not stored.
    scored = stored(score([lang], ()) if also else score(extra, FEATURES), "quality")
    judged = score(extra, FEATURES) if also else scored
    lang_at = F.col(f"c{extra.index(lang)}")
    quartiles = lambda: F.percentile(F.round("bits", 4), F.array(*map(F.lit, (0.25, 0.5, 0.75))))
    # Exact quantiles of rounded values: what an aggregate holds is a count for each different value, which rounding bounds.
    different = scored.where("bits is not null").groupBy(lang_at.alias("l"), "text_key").agg(*(F.min(c).alias(c) for c in ("bits", "n_scored", "spread")))
    related = families.where("texts > 1").select("text_key", "family")
    different = different.join(related, "text_key", "left").groupBy("l", F.coalesce("family", "text_key").alias("family")).agg(*(F.mean(c).alias(c) for c in ("bits", "n_scored", "spread")))
    bands = different.groupBy("l").agg(F.count("bits").alias("n"), quartiles().alias("q"), F.percentile("n_scored", 0.5).alias("mid_n_scored"), F.percentile(F.round("spread", 4), 0.5).alias("mid_spread"))
    q = F.col("q")
    # A band is no narrower than a twentieth of a bit: where all documents are alike, none is out of the way.
    span = F.greatest(q[2] - q[0], F.lit(0.05)) + WIDEN_BITS / F.greatest("n", F.lit(1))
    bands = stored(bands.select("l", (q[0] - reach[0] * span).alias("low"), (q[2] + reach[1] * span).alias("high"), "mid_n_scored", "mid_spread"), "bands")
    joined = judged.join(F.broadcast(bands) if bands.count() <= MOST_BANDS else bands, lang_at.eqNullSafe(F.col("l")), "left").drop("l")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words"))
    further = REACH_ERRORS * F.sqrt("mid_spread") * F.greatest(1 / F.sqrt(F.greatest("n_scored", F.lit(1))) - 1 / F.sqrt("mid_n_scored"), F.lit(0.0))
    joined = joined.withColumns({"low": F.col("low") - further, "high": F.col("high") + further})
    inside = F.coalesce(F.col("bits").between(F.col("low"), F.col("high")), F.lit(True))
    return joined.select(F.col(f"c{extra.index(key)}").alias(key), *FEATURES, failed.alias("base_failed"), "bits", "low", "high", (~failed & inside).alias("kept"), *(F.col(f"c{extra.index(c)}").alias(c) for c in also if c != key))
