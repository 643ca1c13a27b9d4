"""Languages of a text as a mixture: proportions by expectation-maximisation, the set by penalised likelihood."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import session_setup

#: Slots that hashed character 3-grams are counted in, and the most languages (so the table has a known bound).
SLOTS, MOST_LANGUAGES = 1 << 16, 256
#: What a further language must gain, in nats for each of its parameters, times the log of the words.
PENALTY = 4.0
STEPS = 12
#: Least probability of a slot under a language relative to an even spread; keeps one odd word from deciding.
FLOOR = 0.01
_LETTER = re.compile(r"[^\W\d_]")


def words_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Slots of the 3-grams of lower-cased letters, with a mark on each side of a word: (slots, first 3-gram of each word, text of each word)."""
    texts = [t.lower() for t in texts]
    code = np.frombuffer(("\n" + "\n".join(texts) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
    starts = np.cumsum(np.append(1, np.array([len(t) + 1 for t in texts[:-1]], np.int64))) if texts else np.zeros(0, np.int64)
    letter = _letters(code)
    sym = np.where(letter, code, np.uint32(32))
    # a 3-gram at each letter: the one before, itself, the one behind
    h = sym[:-2] * np.uint32(0x9E3779B1) + sym[1:-1] * np.uint32(0x85EBCA77) + sym[2:] * np.uint32(0xC2B2AE3D)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    h >>= np.uint32(16)
    inner = letter[1:-1]
    begins = np.flatnonzero(inner & ~letter[:-2])
    slots = h[inner]
    first = np.cumsum(inner)[begins] - 1 if len(begins) else begins
    row = np.searchsorted(starts, begins + 1, side="right") - 1
    return slots, first, row


_KNOWN: dict[str, np.ndarray] = {}


def _letters(code: np.ndarray) -> np.ndarray:
    """Whether each code point is a letter or a mark that follows letters."""
    if "bmp" not in _KNOWN:
        import unicodedata

        _KNOWN["bmp"] = np.array([unicodedata.category(chr(c))[0] in "LM" for c in range(0x110000)])
    return _KNOWN["bmp"][code]


@dataclass
class Model:
    languages: list[str]
    logp: np.ndarray  # languages x SLOTS

    def word_scores(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The log likelihood of each word under each language (languages x words), and each word's text."""
        slots, first, row = words_of(texts)
        if not len(first):
            return np.zeros((len(self.languages), 0)), row
        return np.stack([np.add.reduceat(one[slots], first) for one in self.logp]).astype(np.float64), row

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score and proportions of each text.

        The score is the main language's proportion, times the probability of the text's best single language among all
        (for short or odd texts far from 1). Every text starts with its best single language; the best pair,
        triple and so on, by the proportions that all languages together get, replace it if the likelihood grows
        by more than PENALTY log(words) for each language more. No set beats all languages together, so texts that
        would not pay for a second language even then are settled as soon as a bound shows it.
        """
        n, k = len(texts), len(self.languages)
        share = np.zeros((n, k))
        scores, row = self.word_scores(texts) if k else (share, share[:0])
        if not k or not len(row):
            return ["und"] * n, np.zeros(n), share
        first = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
        owners = row[first]
        words = np.diff(np.append(first, len(row)))
        top = scores.max(0)
        like = np.exp(np.maximum(scores - top, -30))
        tops = np.add.reduceat(top, first)
        single = np.stack([np.add.reduceat(np.maximum(x - top, -30), first) for x in scores])
        best = single.argmax(0)
        chosen = np.zeros((len(owners), k))
        chosen[np.arange(len(owners)), best] = 1
        value = single.max(0)
        fine = PENALTY * np.log(words + 1)
        if k > 1:
            start = np.full((len(owners), k), 0.1 / k)
            start[np.arange(len(owners)), best] += 0.9
            open_, full, limit = self._mixture(like, first, words, np.arange(len(owners)), start, value + fine)
            order = np.argsort(-full, axis=1, kind="stable")
            for size in range(2, k + 1):
                if not len(open_):
                    break
                allowed = np.zeros((len(open_), k))
                np.put_along_axis(allowed, order[:, :size], 1 / size, axis=1)
                _, pi, got = self._mixture(like, first, words, open_, allowed, None)
                got = got - (size - 1) * fine[open_]
                better = got > value[open_]
                value[open_[better]] = got[better]
                chosen[open_[better]] = pi[better]
                still = limit - size * fine[open_] > value[open_]
                open_, order, limit = open_[still], order[still], limit[still]
        share[owners] = chosen
        main = share.argmax(1)
        # How sure the best single language is among all, a letter counting once though it stands in three 3-grams.
        sure = np.zeros(n)
        sure[owners] = 1 / np.exp((single - single.max(0)) / 3).sum(0)
        score = share.max(1) * sure
        return [self.languages[m] if s > 0 else "und" for m, s in zip(main, share.max(1), strict=True)], score, share

    @staticmethod
    def _mixture(like: np.ndarray, first: np.ndarray, words: np.ndarray, which: np.ndarray, pi: np.ndarray, least: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Expectation-maximisation from pi for some texts: (texts, proportions, log likelihood less the words' best).

        With `least` (a value for each text), the likelihood's upper bound is given instead, and texts whose bound
        falls to `least` are left out: the likelihood is concave, so no proportions gain more over the present
        ones than the largest slope less the number of words.
        """
        for step in range(STEPS):
            size = words[which]
            if step == 0 or len(which) < len(take_of):
                begin = np.append(0, np.cumsum(size)[:-1]) if len(size) else size
                take = np.repeat(first[which] - begin, size) + np.arange(int(size.sum()))
                part = like[:, take]
                take_of = which
            if not len(which):
                break
            mix = np.zeros(part.shape[1])
            for j in range(len(like)):
                mix += part[j] * np.repeat(pi[:, j], size)
            np.maximum(mix, 1e-300, out=mix)
            total = np.add.reduceat(np.log(mix), begin)
            slope = np.stack([np.add.reduceat(x / mix, begin) for x in part], axis=1)
            bound = total + slope.max(1) - size
            if least is None and step == STEPS - 1:
                return which, pi, total
            pi = pi * slope / size[:, None]
            if least is not None:
                keep = bound > least[which]
                if not keep.all():
                    which, pi, bound = which[keep], pi[keep], bound[keep]
        return which, pi, bound if len(which) else np.zeros(0)


def fit(docs: DataFrame, text: str = "text", lang: str = "lang") -> Model:
    """Counts the 3-gram slots of every labelled text for each language (docs are the rows to learn from; null lang or text: left out).

    The model learns the MOST_LANGUAGES labels that most texts have, ties by name; that bounds the table.
    """
    session_setup(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            by: dict[str, list[str]] = {}
            for t, g in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                by.setdefault(g, []).append(t)
            for g, texts in by.items():
                slots, _, _ = words_of(texts)
                total[g] = total.get(g, 0) + np.bincount(slots, minlength=SLOTS)
        for g, n in total.items():
            some = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([g] * len(some)), pa.array(some), pa.array(n[some])], names=["lang", "slot", "n"])

    rows = docs.select(text, lang).where(F.col(text).isNotNull() & F.col(lang).isNotNull())
    most = [r[0] for r in rows.groupBy(lang).agg(F.count("*").alias("n")).orderBy(F.desc("n"), lang).limit(MOST_LANGUAGES).collect()]
    rows = rows.where(F.col(lang).isin(most)) if len(most) == MOST_LANGUAGES else rows
    counted = rows.mapInArrow(count, "lang string, slot long, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n")).toArrow()
    names = counted.column("lang").to_pylist()
    languages = sorted(set(names))
    place = {g: i for i, g in enumerate(languages)}
    table = np.zeros((SLOTS, len(languages)))
    if names:
        table[counted.column("slot").to_numpy(), [place[g] for g in names]] = counted.column("n").to_numpy()
    total = np.maximum(table.sum(0), 1)
    p = (1 - FLOOR) * table / total + FLOOR / SLOTS
    return Model(languages, np.ascontiguousarray(np.log(p).T.astype(np.float32)))


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Adds lang_pred, score and lang_mix (proportions of the languages found) to every row.

    Null text, and text without a letter, is `und` with score 0. Prediction looks at the text alone. Columns of docs
    named as one of the three are replaced.
    """
    session_setup(docs.sparkSession)
    docs = docs.drop("lang_pred", "score", "lang_mix")
    shared = docs.sparkSession.sparkContext.broadcast(model)  # SLOTS x MOST_LANGUAGES numbers at most
    added = {"lang_pred": "string", "score": "double", "lang_mix": "map<string,double>"}
    schema = docs.selectExpr("*", *(f"cast(null as {t}) as {n}" for n, t in added.items())).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text)).to_pylist()
            known = [i for i, t in enumerate(texts) if t and _LETTER.search(t)]
            langs, scores, mixes = ["und"] * len(texts), [0.0] * len(texts), [[]] * len(texts)
            got, score, share = m.predict([texts[i] for i in known])
            for i, g, s, mix in zip(known, got, score.tolist(), share, strict=True):
                langs[i], scores[i] = g, min(1.0, s)
                mixes[i] = [(m.languages[j], float(mix[j])) for j in np.flatnonzero(mix > 0)]
            cols = [*batch.columns, pa.array(langs), pa.array(scores, pa.float64()), pa.array(mixes, pa.map_(pa.string(), pa.float64()))]
            yield pa.RecordBatch.from_arrays(cols, names=[*(f.name for f in batch.schema), "lang_pred", "score", "lang_mix"])

    return docs.mapInArrow(run, schema)
