"""Exact merge-type encoding by backtracking, for SentencePiece models of kind BPE with byte fallback."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import session_setup

#: The sign that SentencePiece writes for a space (fixed value).
SPACE = "▁"
CACHE_SEGMENTS, CACHE_CHARS, CACHE_PAIRS = 500_000, 48, 600_000


class PieceEncoder:
    """Encodes as the SentencePiece library does with a BPE model, without its merge queue.

    A sequence of pieces is the encoding of a text just when every two neighbours are the encoding of what they
    spell together. So the encoder walks a text from the left: it takes the longest piece that starts there (all
    matches come from one Aho-Corasick pass), checks it against the piece before by merging the two anew, tries
    the next shorter piece if they don't stand together, and goes back a piece where none does; a bit for each
    position remembers those from which no way led on.

    A text is split before each run of space signs, as no piece of these models has one behind another character;
    each segment is encoded once and kept. Characters that the model lacks become byte pieces, which never merge.
    """

    _made: dict = {}

    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece

        self.library = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        plain = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.text = {i: sp.id_to_piece(i) for i in plain}
        self.ids = {p: i for i, p in self.text.items()}
        self.rank = {p: -sp.get_score(i) for p, i in self.ids.items()}
        if any(SPACE in p.lstrip(SPACE) for p in self.ids):
            raise ValueError("a piece of this model crosses a space")
        if sp.encode("ÅÅ", out_type=str) != sp.encode("Å", out_type=str) + [f"<0x{b:02X}>" for b in "Å".encode()]:
            raise ValueError("this model normalises texts")  # only models that keep texts as they are
        self.dummy = sp.encode("a", out_type=str)[0].startswith(SPACE)
        self.bytes = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.end = sp.eos_id()
        self.automaton = ahocorasick.Automaton()
        for p, i in self.ids.items():
            self.automaton.add_word(p, (len(p), i))
        self.automaton.make_automaton()
        #: The longest piece that a piece starts with, itself excepted.
        self.shorter = {i: next((self.ids[p[:n]] for n in range(len(p) - 1, 0, -1) if p[:n] in self.ids), None) for p, i in self.ids.items()}
        self.size = {i: len(p) for i, p in self.text.items()}
        self.known = {p for p in self.ids if len(p) == 1}
        self.pairs: dict[int, bool] = {}
        self.cache: dict[str, tuple[int, ...]] = {}
        self.alone = {i: self.merged(p) == [p] for i, p in self.text.items()}

    @classmethod
    def get(cls, path: str) -> "PieceEncoder":
        """One encoder for a worker and model; its cache lives as long as the worker."""
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def merged(self, text: str) -> list[str]:
        """Merges characters, best piece first, leftmost first; for short texts."""
        parts, rank = [*text], self.rank
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = rank.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def together(self, a: int, b: int) -> bool:
        """Whether two pieces stand side by side in an encoding: merging what they spell gives the two."""
        key = a << 20 | b
        got = self.pairs.get(key)
        if got is None:
            if len(self.pairs) > CACHE_PAIRS:
                self.pairs.clear()
            p, q = self.text[a], self.text[b]
            got = self.pairs[key] = self.merged(p + q) == [p, q]
        return got

    def walk(self, text: str) -> list[int]:
        """The pieces of a text whose characters are all in the model."""
        n = len(text)
        whole = self.ids.get(text)
        if whole is not None and self.alone[whole]:
            return [whole]
        longest: list[int] = [-1] * n
        for end, (size, i) in self.automaton.iter(text):
            longest[end - size + 1] = i  # ends rise, so the last is the longest
        failed = bytearray((n >> 3) + 1)
        out: list[int] = []
        at, piece = 0, longest[0]
        size, shorter, together, alone = self.size, self.shorter, self.together, self.alone
        while True:
            while piece is not None:
                to = at + size[piece]
                if not failed[to >> 3] >> (to & 7) & 1 and (together(out[-1], piece) if out else alone[piece]):
                    break
                piece = shorter[piece]
            if piece is not None:
                out.append(piece)
                at = to
                if at == n:
                    return out
                piece = longest[at]
            else:  # no piece leads on from here
                failed[at >> 3] |= 1 << (at & 7)
                if not out:
                    raise AssertionError("a text without an encoding")
                last = out.pop()
                at -= size[last]
                piece = shorter[last]

    def segment(self, text: str) -> tuple[int, ...]:
        known = self.known
        if all(c in known for c in text):
            return tuple(self.walk(text))
        out: list[int] = []
        run = 0
        for i, c in enumerate(text):
            if c not in known:
                if run < i:
                    out += self.walk(text[run:i])
                out += [self.bytes[b] for b in c.encode()]
                run = i + 1
        if run < len(text):
            out += self.walk(text[run:])
        return tuple(out)

    def encode(self, text: str) -> list[int]:
        """The library's encode(text), without an end id."""
        if not text:
            return []
        if len(self.cache) > CACHE_SEGMENTS:
            self.cache.clear()
        cache, out = self.cache, []
        parts = _BEFORE_SPACES.split(((" " if self.dummy else "") + text).replace(SPACE, " "))
        for part in parts:
            got = cache.get(part)
            if got is None:
                got = self.segment(part.replace(" ", SPACE)) if part else ()
                if len(part) <= CACHE_CHARS:
                    cache[part] = got
            out.append(got)
        return [*chain.from_iterable(out)]


_BEFORE_SPACES = re.compile(r"(?<=[^ ])(?= )")


def encode_decode(docs: DataFrame, model: str, key: str = "doc_id", text: str = "text", keep: bool = True) -> DataFrame:
    """Encodes every whole text with an end id, then decodes the ids with the library.

    Null text counts as empty, whose only id is the end. An empty table gives no rows.
    Returns key, n_tokens, ids_sha256 (of decimal ids joined by one space), decoded_sha256 and, if keep, ids and
    decoded text.
    """
    session_setup(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = PieceEncoder.get(model)
        decode, end, digits = encoder.library.decode, encoder.end, [str(i) for i in range(encoder.library.get_piece_size())]
        for batch in batches:
            rows = []
            for t in batch.column(1).to_pylist():
                ids = encoder.encode(t or "")
                ids.append(end)
                decoded = decode(ids)
                shown = hashlib.sha256(" ".join([digits[i] for i in ids]).encode()).hexdigest()
                rows.append((len(ids), shown, hashlib.sha256(decoded.encode()).hexdigest(), ids if keep else None, decoded if keep else None))
            cols = list(zip(*rows, strict=True)) or [[]] * 5
            kinds = [pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32()), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=["k", "n", "i", "d", "ids", "decoded"])

    out = docs.select(F.col(key).cast("long"), F.col(text)).mapInArrow(run, "k long, n long, i string, d string, ids array<int>, decoded string")
    out = out.toDF(key, "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded")
    return out if keep else out.drop("ids", "decoded")
