"""Cached encoding of whole texts to token ids, and a word-aligned file format for them."""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWEST, bucket_udf, key_cuts, ordered_key, partitions, session_setup, shared_dir

#: Chunks of a text that are kept with their ids in each worker, and the longest such chunk.
CACHE_CHUNKS, CACHE_CHARS = 900_000, 48

#: Chunks with other characters go through the whole tokenizer; these have the same classes and cases in every Unicode version.
_UNUSUAL = re.compile(r"[^\t\n\r -~\u00a1-\u024f]")
# Fixed values of the public files: how each splits text before merging.
LEAD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def _byte_letters() -> dict[int, str]:
    """The letter that byte-level tokenizers write for each byte: itself where printable, else the next from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(0x100 + i) for i, b in enumerate(hidden)}


def added_tokens(whole: dict) -> re.Pattern | None:
    """What finds the added tokens of a tokenizer's file in a text, whatever their case; None where it has none."""
    names = [re.escape(t["content"]) for t in whole.get("added_tokens") or [] if t["content"]]
    return re.compile("|".join(names), re.I) if names else None


class LeadEncoder:
    """Encodes texts as a byte-level `tokenizers` file with leading spaces does.

    The file's vocabulary, in which a merge's place is the id of what it makes, is given to tiktoken, which is
    several times as fast as the file's own library and gives the same ids (tested). A text that holds one of the file's
    added tokens goes to that library. Empty text: no ids.
    """

    _made: dict = {}

    def __init__(self, path: str):
        import json

        import tiktoken
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            whole = json.load(f)
        vocab = whole["model"]["vocab"]
        self.added = added_tokens(whole)
        self.tokenizer = Tokenizer.from_file(path)
        back = {v: k for k, v in _byte_letters().items()}
        ranks = {bytes(back[c] for c in token): i for token, i in vocab.items()}
        self.encoding = tiktoken.Encoding("lead", pat_str=LEAD_PATTERN, mergeable_ranks=ranks, special_tokens={})

    @classmethod
    def get(cls, path: str) -> "LeadEncoder":
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def encode(self, text: str) -> np.ndarray:
        if self.added and self.added.search(text):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")
        return np.array(self.encoding.encode_ordinary(text), "<u4")


class CachedEncoder:
    """Encodes texts as a `tokenizers` file that lower-cases and drops white space does, keeping the ids of chunks.

    Texts are split at white space, which no token crosses, so the ids of a text are those of its chunks in
    order. The file's own model merges each new word; chunks with unusual characters go through the whole
    tokenizer, and so do texts that hold one of the file's added tokens. Empty text: no ids.
    """

    _made: dict = {}

    def __init__(self, path: str):
        os.environ.setdefault("RAYON_NUM_THREADS", "1")
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import json

        import regex
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            self.added = added_tokens(json.load(f))
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.words_of = regex.compile(WORD_PATTERN).findall
        self.letters = _byte_letters()
        self.cache: dict[str, bytes] = {}
        self.raw = [i.to_bytes(4, "little") for i in range(self.tokenizer.get_vocab_size())]

    @classmethod
    def get(cls, path: str) -> "CachedEncoder":
        """One encoder for a worker and file; its cache lives as long as the worker."""
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def _word(self, word: str) -> bytes:
        got = self.cache.get(word)
        if got is None:
            letters = word.encode().decode("latin-1").translate(self.letters)
            got = b"".join([self.raw[t.id] for t in self.model.tokenize(letters)])
            if len(word) <= CACHE_CHARS:
                self.cache[word] = got
        return got

    def _chunk(self, chunk: str) -> bytes:
        """The ids of a chunk that isn't known. Most are a word, or one with a mark behind it."""
        if _UNUSUAL.search(chunk):
            return np.array(self.tokenizer.encode(chunk, add_special_tokens=False).ids, "<u4").tobytes()
        chunk = chunk.lower()
        if chunk.isalpha():
            return self._word(chunk)
        if chunk[-1:] in ".," and chunk[:-1].isalpha():
            return self._word(chunk[:-1]) + self._word(chunk[-1])
        return b"".join([self._word(w) for w in self.words_of(chunk)])

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        if len(self.cache) > CACHE_CHUNKS:
            self.cache.clear()
        cache, out = self.cache, []
        for text in texts:
            if self.added and self.added.search(text):
                out.append(np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes())
                continue
            ids = []
            for chunk in text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" "):
                got = cache.get(chunk)
                if got is None:
                    got = self._chunk(chunk)
                    if len(chunk) <= CACHE_CHARS:
                        cache[chunk] = got
                ids.append(got)
            out.append(b"".join(ids))
        return out


# Simple-8b: selector s packs COUNTS[s] ids of WIDTHS[s] bits in the low 60 bits of a word; the top 4 bits hold s.
COUNTS = np.array([60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1], np.int64)
WIDTHS = 60 // COUNTS
#: Ids in a block that can be decoded by itself; wider ids than ESCAPE_BITS are escapes, listed beside the words.
BLOCK, ESCAPE_BITS = 512, 20
MAGIC = b"LTS8B\x01\x00\x00"


def pack_ids(ids: np.ndarray) -> bytes:
    """Simple-8b words of ids, with escapes and the first word of each block.

    Layout, little-endian: magic; counts of ids, words, escapes (3 x u8); first word of each block (u4); positions
    of escapes (u4), their values (u4), padding to 8 bytes; words (u8). Every block starts a new word.
    """
    n = len(ids)
    ids = ids.astype(np.uint64)
    wide = np.flatnonzero(ids >> np.uint64(ESCAPE_BITS))
    escapes = ids[wide].astype("<u4")
    ids[wide] = 0
    blocks = -(-n // BLOCK)
    padded = np.zeros(blocks * BLOCK, np.uint64)
    padded[:n] = ids
    left = np.full(blocks, BLOCK, np.int64)
    if blocks:
        left[-1] = n - (blocks - 1) * BLOCK
    # fits[s]: whether the COUNTS[s] ids from here on, as far as there are any, all fit
    width = (np.maximum((padded.astype(np.float64).view(np.int64) >> 52) - 1022, 0)).astype(np.uint8)
    choice = np.full(len(padded), len(COUNTS) - 1, np.uint8)
    rows = width.reshape(blocks, BLOCK)
    for s in range(len(COUNTS) - 2, -1, -1):
        run, need = int(COUNTS[s]), WIDTHS[s]
        ok = np.ones((blocks, BLOCK + run), bool)
        ok[:, :BLOCK] = rows <= need
        if not ok[:, :BLOCK].any():
            break
        done = 1
        while done < run:  # ok[i]: all of i .. i + done - 1 fit
            step = min(done, run - done)
            ok[:, : BLOCK + run - step] &= ok[:, step:]
            done += step
        choice[ok[:, :BLOCK].ravel()] = s
    # walk all blocks side by side
    at, lanes = np.zeros(blocks, np.int64), np.arange(blocks, dtype=np.int64)
    where, which, owner = [], [], []
    while len(lanes):
        pos = lanes * BLOCK + at
        s = choice[pos]
        where.append(pos), which.append(s), owner.append(lanes)
        at = at + COUNTS[s]
        keep = at < left[lanes]
        lanes, at = lanes[keep], at[keep]
    if where:
        where, which, owner = map(np.concatenate, (where, which, owner))
        order = np.argsort(where, kind="stable")
        where, which, owner = where[order], which[order], owner[order]
        words = which.astype(np.uint64) << np.uint64(60)
        tail = np.concatenate([padded, np.zeros(60, np.uint64)])
        for s in np.unique(which):
            mine = which == s
            base, total = where[mine], np.zeros(int(mine.sum()), np.uint64)
            end = (base // BLOCK + 1) * BLOCK
            for k in range(int(COUNTS[s])):
                total |= np.where(base + k < end, tail[base + k], np.uint64(0)) << np.uint64(k * int(WIDTHS[s]))
            words[mine] |= total
        offsets = np.searchsorted(owner, np.arange(blocks)).astype("<u4")
    else:
        words, offsets = np.zeros(0, np.uint64), np.zeros(0, "<u4")
    head = MAGIC + np.array([n, len(words), len(escapes)], "<u8").tobytes() + offsets.tobytes() + wide.astype("<u4").tobytes() + escapes.tobytes()
    return head + b"\0" * (-len(head) % 8) + words.astype("<u8").tobytes()


def unpack_ids(blob: bytes) -> np.ndarray:
    """The ids that pack_ids() packed."""
    if blob[:8] != MAGIC:
        raise ValueError("not a packed id file")
    n, n_words, n_escapes = map(int, np.frombuffer(blob, "<u8", 3, 8))
    blocks = -(-n // BLOCK)
    at = 32 + 4 * blocks
    wide, values = np.frombuffer(blob, "<u4", n_escapes, at), np.frombuffer(blob, "<u4", n_escapes, at + 4 * n_escapes)
    at += 8 * n_escapes
    words = np.frombuffer(blob, "<u8", n_words, at + -at % 8)
    offsets = np.frombuffer(blob, "<u4", blocks, 32).astype(np.int64)
    which = (words >> np.uint64(60)).astype(np.int64)
    count = COUNTS[which]
    # where each word's first id goes: the running count inside its block
    before = np.cumsum(count) - count
    block = np.searchsorted(offsets, np.arange(n_words), side="right") - 1
    first = before - before[offsets[block]] + block * BLOCK if n_words else before
    out = np.zeros(blocks * BLOCK + 60, np.uint32)
    for s in np.unique(which):
        mine = which == s
        word, base, w = words[mine], first[mine], int(WIDTHS[s])
        mask, end = np.uint64((1 << w) - 1), (block[mine] + 1) * BLOCK
        for k in range(int(COUNTS[s])):
            inside = base + k < end
            out[(base + k)[inside]] = ((word >> np.uint64(k * w)) & mask)[inside]
    out[wide] = values
    return out[:n]


def unpack_block(blob: bytes, block: int) -> np.ndarray:
    """The ids of one block, read without those before it."""
    n, n_words, n_escapes = map(int, np.frombuffer(blob, "<u8", 3, 8))
    blocks = -(-n // BLOCK)
    offsets = np.frombuffer(blob, "<u4", blocks, 32)
    at = 32 + 4 * blocks + 8 * n_escapes
    words = np.frombuffer(blob, "<u8", n_words, at + -at % 8)[offsets[block] : offsets[block + 1] if block + 1 < blocks else n_words]
    size = min(BLOCK, n - block * BLOCK)
    out = [(int(x) >> (k * int(WIDTHS[int(x) >> 60]))) & ((1 << int(WIDTHS[int(x) >> 60])) - 1) for x in words for k in range(int(COUNTS[int(x) >> 60]))][:size]
    ids = np.array(out, np.uint32)
    at = 32 + 4 * blocks
    wide, values = np.frombuffer(blob, "<u4", n_escapes, at), np.frombuffer(blob, "<u4", n_escapes, at + 4 * n_escapes)
    here = (wide // BLOCK) == block
    ids[wide[here] - block * BLOCK] = values[here]
    return ids


#: Ids in a segment of a file, about; a segment holds whole documents.
SEGMENT_IDS = 1 << 19
SEGMENT = pa.schema([("bucket", pa.int32()), ("part", pa.int32()), ("before", pa.int64()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("doc_ids", pa.binary()), ("lengths", pa.binary()), ("blob", pa.binary())])


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int, key: str = "doc_id", text: str = "text") -> None:
    """Encodes every whole text and writes the ids, in ascending key order, as packed segments.

    Rows go into key ranges (one shuffle of the texts); each range is sorted and written in order as segments of
    whole documents: keys, lengths, the ids of the range before it, and the Simple-8b blob. Null text is empty; each document ends with end_id.
    Null keys come first; rows that share a key keep an arbitrary order. Files go through Spark's writer, to
    any store. An empty table writes no segment.
    """
    spark = docs.sparkSession
    session_setup(spark)
    n = partitions(spark)
    rows = docs.select(ordered_key(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    cuts = key_cuts(rows.select("k"), "k", 8 * n)
    tail = np.array([end_id], "<u4").tobytes()

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = CachedEncoder.get(tokenizer)
        now, part, keys, ids, held, before = None, 0, [], [], 0, 0

        def flush() -> pa.RecordBatch:
            lengths = np.array([len(x) // 4 for x in ids], "<u4")
            joined = np.frombuffer(b"".join(ids), "<u4")
            values = [[now], [part], [before], [len(keys)], [len(joined)], [np.array(keys, "<i8").tobytes()], [lengths.tobytes()], [pack_ids(joined)]]
            return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(values, SEGMENT, strict=True)], schema=SEGMENT)

        for batch in batches:
            bs, ks = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for b, k, e in zip(bs, ks, encoder.encode(batch.column(2).to_pylist()), strict=True):
                if keys and (b != now or held >= SEGMENT_IDS):
                    yield flush()
                    part, before = (part + 1, before + held) if b == now else (0, 0)
                    keys, ids, held = [], [], 0
                now = b
                keys.append(k)
                ids.append(e + tail)
                held += len(ids[-1]) // 4
        if keys:
            yield flush()

    salt = F.pmod(F.xxhash64("t"), F.lit(1 << 20))
    placed = rows.withColumn("b", bucket_udf(cuts)("k", salt)).select("b", "k", "t").repartition(n, "b").sortWithinPartitions("b", "k")
    placed.mapInArrow(segments, "bucket int, part int, before long, n_docs long, n_ids long, doc_ids binary, lengths binary, blob binary").write.parquet(path)


def read_token_files(spark: SparkSession, path: str, key: str = "doc_id") -> DataFrame:
    """Reads the files back: key, start (ids of all documents before it), n_tokens, ids_crc32 and the ids (binary, 32-bit).

    Only the totals of the key ranges (MAX_BUCKETS at most) are gathered; a segment tells what lies before it in its range.
    """
    files = spark.read.parquet(path)
    totals = {r.bucket: r.n for r in files.groupBy("bucket").agg(F.sum("n_ids").alias("n")).collect()}
    start, starts = 0, {}
    for b in sorted(totals):
        starts[b] = start
        start += totals[b]

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                ids = unpack_ids(r["blob"]).astype("<u4")
                lengths = np.frombuffer(r["lengths"], "<u4").astype(np.int64)
                ends = np.cumsum(lengths)
                raw = ids.tobytes()
                pieces = [raw[4 * (e - m) : 4 * e] for e, m in zip(ends.tolist(), lengths.tolist(), strict=True)]
                base = starts[r["bucket"]] + r["before"]
                keys = np.frombuffer(r["doc_ids"], "<i8")
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64(), mask=keys == LOWEST), pa.array(base + ends - lengths), pa.array(lengths), pa.array([zlib.crc32(x) for x in pieces], pa.int64()), pa.array(pieces, pa.binary())], names=[key, "start", "n_tokens", "ids_crc32", "ids"])

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    return files.select("bucket", "before", "doc_ids", "lengths", "blob").mapInArrow(documents, f"`{key}` long, start long, n_tokens long, ids_crc32 long, ids binary")


def token_file_path(spark: SparkSession, name: str) -> str:
    import uuid

    return f"{shared_dir(spark)}/tables/{name}-{uuid.uuid4().hex}"
