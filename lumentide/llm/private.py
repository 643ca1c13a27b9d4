"""Personal data: plain patterns, and candidates that boosted trees judge by format and context."""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import session_setup

KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int, int]  # start, kind's place in KINDS, end

_AT = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# Digits before a match's first ones can't be: matches are leftmost, so they start with their whole run of digits.
_IP = re.compile(r"(?<![0-9])([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]")
_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d if d < 5 else 2 * d - 9)
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """The plain patterns' matches, leftmost and non-overlapping for each kind, failing ones dropped; linear time.

    Emails are found from their @: the local part reaches left as far as its characters go, but not into the match before.
    """
    out: list[Span] = []
    last = 0
    for m in _AT.finditer(text) if "@" in text else ():
        at = start = m.start()
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        if start < at:
            out.append((start, 0, m.end()))
            last = m.end()
    if not _DIGIT.search(text):
        return out
    if "." in text:
        for m in _IP.finditer(text):
            if all(len(x := p.lstrip("0")) < 4 and int(x or 0) <= 255 for p in m.groups()):
                out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = _NOT_DIGIT.sub("", m[0])
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


_DIGIT = re.compile(r"[0-9]")
#: Generators of candidates: wide on purpose, overlapping, several for a kind.
_GENERATORS = [
    (0, re.compile(r"(?<![\w.%+-])[\w.%+-]{1,64}[ ]?[\[({<][ ]?(?:at|AT|@)[ ]?[\])}>][ ]?[A-Za-z0-9-]{1,63}(?:[ ]?(?:\.|[\[({<][ ]?(?:dot|DOT|\.)[ ]?[\])}>])[ ]?[A-Za-z0-9-]{1,63}){1,5}")),
    (0, re.compile(r"(?<![\w.%+-])[\w.%+-]{1,64}@[A-Za-z0-9-]{1,63}(?![\w.-])")),
    (1, re.compile(r"(?<![\w:.])(?:[0-9A-Fa-f]{1,4}:){2,7}:?(?:[0-9A-Fa-f]{1,4})?(?![\w:])")),
    (1, re.compile(r"(?<![\w:.])(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6}(?![\w:])")),
    (2, re.compile(r"(?<![\w.])[0-9]{3,6}(?:[ ./_-]?[0-9]{2,6}){2,5}(?![\w.])")),
    (2, re.compile(r"(?<![\w])[0-9]{13,19}(?![\w])")),
    (3, re.compile(r"(?<![\w.+-])(?:\([0-9]{2,5}\)[ ]?|[0-9]{2,5}[ ./-])[0-9]{2,4}(?:[ ./-][0-9]{2,4}){1,4}(?![\w.-]*[0-9])")),
    (3, re.compile(r"(?<![\w.+-])00[1-9][0-9]{0,2}[ ./-]?[0-9]{2,4}(?:[ ./-]?[0-9]{2,4}){1,4}(?![\w])")),
    (3, re.compile(r"(?<![\w.+-])(?:\([0-9]{2,5}\)[ ]?|[0-9]{2,5}[ ./-])[0-9]{4,9}(?![\w.-]*[0-9])")),
    (3, re.compile(r"(?<![\w.+-])[0-9]{7,12}(?![\w.-]*[0-9])")),
]
#: Digits of a phone number at most.
MOST_PHONE = 15
_RUN = re.compile(r"[0-9 ()./_-]+")
_GROUPS = re.compile(r"[0-9]+")
_NUMERIC = [(kind, pattern) for kind, pattern in _GENERATORS if kind > 1]


def _parts_of_runs(text: str) -> Iterator[Span]:
    """Candidates in runs of digit groups: each start and end at which a numeric generator fits, overlapping ones included.

    A candidate has 19 digits at most, so a start has few ends, however long the run.
    """
    for run in _RUN.finditer(text):
        groups = [g.span() for g in _GROUPS.finditer(text, *run.span())]
        for i, (start, _) in enumerate(groups) if len(groups) > 1 else ():
            digits = 0
            for a, end in groups[i : i + 19]:
                digits += end - a
                if digits > 19 or end - a < 2:  # no generator takes a single digit
                    break
                after = text[end : end + 2]
                if digits < 7 or after[:1].isalnum() or after[:1] == "_" or (after[:1] in (".", "-", "/") and after[1:].isdigit()):
                    continue
                for s in (start - 1, start) if text[start - 1 : start] == "(" else (start,):
                    for kind, pattern in _NUMERIC:
                        if (digits <= MOST_PHONE if kind == 3 else digits >= 13) and pattern.fullmatch(text, s, end):
                            yield s, kind, end


_OPEN = re.compile(r"[0-9@:]|[\[({<] ?(?:at|AT) ?[\])}>]")
_CUES = [re.compile(p, re.I) for p in (r"e-?mail|mail|contact|write to|@", r"\bip\b|host|server|address|ping|addr", r"card|visa|master|amex|credit|debit|\bcc\b", r"phone|tel\b|tel\.|call|fax|mobile|cell|whatsapp|sms|my number|reach", r"order|isbn|issn|ref|invoice|serial|\bid\b|no\.|account|version|\bv\b|build|token|hash|sha|uuid|doi|page|pp\.|date|code|sku", r"[$€£]|price|total|usd|eur")]
_GROUP = re.compile(r"[0-9A-Za-z]+")
N_FEATURES = 4 + 15 + len(_CUES)


def cues(text: str, start: int) -> list[float]:
    """What stands before a candidate."""
    before = text[max(0, start - 40) : start]
    return [float(bool(c.search(before))) for c in _CUES]


def features(text: str, start: int, end: int, kind: int, cued: list[float] | None = None) -> list[float]:
    """Format of a candidate and what stands around it."""
    s = text[start:end]
    digits = _NOT_DIGIT.sub("", s)
    groups = _GROUP.findall(s)
    before, after = text[max(0, start - 1) : start], text[end : end + 1]
    last = len(groups[-1]) if groups else 0
    out = [float(kind == k) for k in range(4)]
    out += [end - start, len(digits), len(digits) / max(1, end - start), len(groups), sum(not c.isalnum() for c in s), float(bool(digits) and luhn(digits)), max(map(len, groups), default=0), min(map(len, groups), default=0), float(last), float(s[:1] == "("), float(s[:2] == "00"), s.count(":"), float(before[-1:].isalnum()), float(after[:1].isalnum()), float(len(set(map(len, groups))) == 1)]
    return out + (cues(text, start) if cued is None else cued)


@dataclass
class Trees:
    """Gradient-boosted trees of logistic loss, each a full tree by depth: split features, cuts, leaf values."""

    base: float
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]]
    depth: int

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for feature, cut, leaf in self.trees:
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                at = 2 * at + 1 + (x[np.arange(len(x)), feature[at]] > cut[at])
            out += leaf[at - (2**self.depth - 1)]
        return out


def boost(x: np.ndarray, y: np.ndarray, rounds: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 32, l2: float = 1.0) -> Trees:
    """Fits boosted trees by second-order gains over binned features."""
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)
    p = y.mean()
    model = Trees(float(np.log(p / (1 - p))), [], depth)
    margin = np.full(len(y), model.base)
    inner, leaves = 2**depth - 1, 2**depth
    for _ in range(rounds):
        prob = 1 / (1 + np.exp(-margin))
        g, h = prob - y, prob * (1 - prob)
        feature, cut, leaf = np.zeros(inner, np.int64), np.full(inner, np.inf), np.zeros(leaves)
        node = np.zeros(len(y), np.int64)
        for i in range(inner):
            mine = np.flatnonzero(node == i)
            best = (1e-6, 0, np.inf)
            if len(mine):
                gs, hs = g[mine].sum(), h[mine].sum()
                for j, e in enumerate(edges):
                    if not len(e):
                        continue
                    b = binned[mine, j]
                    gl, hl = np.cumsum(np.bincount(b, g[mine], len(e) + 1))[:-1], np.cumsum(np.bincount(b, h[mine], len(e) + 1))[:-1]
                    gain = gl**2 / (hl + l2) + (gs - gl) ** 2 / (hs - hl + l2) - gs**2 / (hs + l2)
                    k = int(gain.argmax())
                    if gain[k] > best[0]:
                        best = (float(gain[k]), j, float(e[k]))
            feature[i], cut[i] = best[1], best[2]
            node[mine] = 2 * i + 1 + (x[mine, best[1]] > best[2])
        for i in range(leaves):
            mine = node == inner + i
            leaf[i] = -rate * g[mine].sum() / (h[mine].sum() + l2)
        margin += leaf[node - inner]
        model.trees.append((feature, cut, leaf))
    return model


def made_examples(n: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """n labelled candidates (features, kinds, labels), written by rule: personal data and look-alikes in made-up context."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefghilmnoprstuvwz") for _ in range(r.randint(2, 9)))
    num = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    hexa = lambda k: "".join(r.choice("0123456789abcdef") for _ in range(k))

    def valid(k: int, good: bool) -> str:
        while luhn(s := r.choice("3456") + num(k - 1)) != good:
            pass
        return s

    def grouped(s: str, sep: str, size: int = 4) -> str:
        return sep.join(s[i : i + size] for i in range(0, len(s), size))

    at, dot = (lambda: r.choice([" [at] ", "[at]", " (at) ", "(at)", "{at}", " {at} "])), (lambda: r.choice([".", ".", " [dot] ", "(dot)", " (dot) "]))
    yes = [
        (0, lambda: f"{word()}{r.choice(['', '.', '_'])}{word()}{at()}{word()}{dot()}{r.choice(['com', 'org', 'net', 'de', 'fr', 'es'])}"),
        (1, lambda: ":".join(hexa(r.randint(1, 4)) for _ in range(8))),
        (1, lambda: f"{hexa(4)}:{hexa(r.randint(1, 4))}:{hexa(r.randint(1, 4))}::{hexa(r.randint(1, 4))}"),
        (2, lambda: grouped(valid(16, True), r.choice([".", "/", "_"]))),
        (2, lambda: valid(13, True)),
        (3, lambda: f"({num(3)}) {num(3)}-{num(4)}"),
        (3, lambda: f"{r.randint(200, 989)}{(s := r.choice('-. '))}{num(3)}{s}{num(4)}"),
        (3, lambda: f"00{r.randint(1, 99)} {num(3)} {num(3)} {num(4)}"),
        (3, lambda: " ".join(["0" + str(r.randint(1, 9)), *(num(2) for _ in range(4))])),
        (3, lambda: f"0{num(r.randint(1, 4))}{r.choice(' -/')}{num(r.randint(5, 8))}"),
        (3, lambda: f"({num(3)}) {num(r.randint(6, 7))}"),
        (3, lambda: f"0{num(r.randint(8, 10))}"),
        (3, lambda: f"{num(3)}{r.choice('-. ')}{num(4)}"),
    ]
    no = [
        (0, lambda: f"{word()}@{word()}"),
        (1, lambda: f"{r.randint(0, 23):02d}:{r.randint(0, 59):02d}:{r.randint(0, 59):02d}"),
        (1, lambda: f"{r.randint(1, 40)}:{r.randint(1, 90)}:{r.randint(1, 90)}"),
        (2, lambda: valid(r.randint(13, 19), False)),
        (2, lambda: grouped(valid(16, False), r.choice(["", "-", " ", "."]))),
        (2, lambda: f"978-{r.randint(0, 9)}-{num(4)}-{num(4)}-{r.randint(0, 9)}"),
        (2, lambda: num(r.randint(8, 13))),
        (2, lambda: f"{num(3)}.{num(3)}.{num(3)}"),
        (3, lambda: f"{r.randint(1900, 2030)}-{r.randint(1, 12):02d}-{r.randint(1, 28):02d}"),
        (3, lambda: f"{r.randint(1, 28):02d}.{r.randint(1, 12):02d}.{r.randint(1900, 2030)}"),
        (3, lambda: f"{num(2)}-{num(2)}-{num(2)}"),
        (3, lambda: f"{r.randint(1900, 2030)}/{num(2)}/{num(3)}"),
        (3, lambda: " ".join(num(r.randint(2, 4)) for _ in range(r.randint(3, 5)))),
        (3, lambda: f"{r.randint(10, 999)}.{num(3)}.{num(3)}"),
    ]
    bare = [  # what only its context tells from a number to call
        (3, lambda: num(r.randint(7, 12))),
        (3, lambda: f"{num(r.randint(2, 5))}{r.choice(' -/.')}{num(r.randint(4, 9))}"),
        (3, lambda: f"{r.randint(1900, 2030)}-{r.randint(1900, 2030)}"),
    ]
    own = ["email: ", "ip address ", "card number: ", "phone: "]
    calls = {3: ["tel. ", "call ", "phone ", "fax: ", "mobile ", "call me at ", "cell: ", "my phone number is ", "reach us by telephone on "], 2: ["visa ", "card ", "credit card "], 1: ["server ", "ip ", "host "], 0: ["mail ", "contact ", "write to "]}
    other = ["order no. ", "isbn ", "ref ", "version ", "serial ", "total $", "page ", "date ", "token = ", "id "]
    xs, ks, ys = [], [], []
    while len(ys) < n:
        good = r.random() < 0.5
        plain = not good and r.random() < 0.2
        kind, make = r.choice(yes if good else bare if plain else no)
        value = make()
        if not good and not plain and r.random() < 0.15:  # a span too wide: true data and a number beside it
            kind, make = r.choice([x for x in yes if x[0] > 1])
            beside = r.choice([str(r.randint(1900, 2030)), num(r.randint(2, 4)), make()])
            value = " ".join(r.sample([make(), beside], 2))
        draw = r.random()
        if good:
            lead = r.choice([own[kind], *calls[kind]]) if draw < 0.6 else word() + " "
        else:
            lead = r.choice(other) if draw < 0.5 else (word() + " " if draw < 0.95 or plain else r.choice(calls[kind]))
        before = " ".join(word() for _ in range(r.randint(0, 8))) + " " + lead
        text = before + value + r.choice([" ", ".", ",", ") ", ""]) + " ".join(word() for _ in range(r.randint(0, 5)))
        xs.append(features(text, len(before), len(before) + len(value), kind))
        ks.append(kind)
        ys.append(good)
    return np.array(xs), np.array(ks), np.array(ys, float)


@dataclass
class Judge:
    trees: Trees
    slope: float
    shift: float
    thresholds: tuple[float, ...]

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.slope * self.trees.margin(x) + self.shift)))


def fit_judge(examples: int = 6000, precision: float = 0.995, seed: int = 5) -> Judge:
    """Trains on `examples` made candidates, calibrates on as many others, and sets each kind's threshold to the lowest
    at which that precision is reached there (never under one half)."""
    x, _, y = made_examples(examples, seed)
    trees = boost(x, y)
    cx, ck, cy = made_examples(examples, seed + 1)
    m = trees.margin(cx)
    a, b = 1.0, 0.0
    for _ in range(50):  # Platt's scaling by Newton's method
        p = 1 / (1 + np.exp(-(a * m + b)))
        w = np.maximum(p * (1 - p), 1e-9)
        grad = np.array([((p - cy) * m).sum(), (p - cy).sum()])
        hess = np.array([[(w * m * m).sum() + 1e-3, (w * m).sum()], [(w * m).sum(), w.sum() + 1e-3]])
        a, b = np.array([a, b]) - np.linalg.solve(hess, grad)
    judge = Judge(trees, float(a), float(b), ())
    p = judge.probability(cx)
    cuts = []
    for k in range(len(KINDS)):
        mine = np.argsort(-p[ck == k])
        hits = np.cumsum(cy[ck == k][mine]) / np.arange(1, len(mine) + 1)
        good = np.flatnonzero(hits >= precision)
        cuts.append(max(0.5, float(p[ck == k][mine][good[-1]])) if len(good) else 1.0)
    judge.thresholds = tuple(cuts)
    return judge


#: Candidates that are judged at a time.
_PORTION = 1 << 14


def _candidates(text: str) -> Iterator[Span]:
    """All that the generators propose; digits that fail Luhn's sum, or are too few or many for a card, are no card."""
    whole = ((m.start(), kind, m.end()) for kind, pattern in _GENERATORS for m in pattern.finditer(text))
    for s, kind, e in (x for part in (whole, _parts_of_runs(text)) for x in part):
        if kind > 1:
            digits = _NOT_DIGIT.sub("", text[s:e])
            if len(digits) > MOST_PHONE if kind == 3 else not 13 <= len(digits) <= 19 or not luhn(digits):
                continue
        yield s, kind, e


def found_spans(texts: list[str], judge: Judge) -> list[tuple[list[Span], list[Span]]]:
    """Base spans and all spans of each text. Added spans overlap neither base ones nor each other; the surest wins.

    Candidates are judged some at a time, and those under their threshold forgotten, so memory goes by what is found.
    """
    bases = [base_spans(t) if t else [] for t in texts]
    masks: dict[int, bytearray] = {}  # characters that a span holds
    sure: list[tuple[float, int, int, int, int]] = []
    rows: list[list[float]] = []
    where: list[tuple[int, int, int, int]] = []

    def decide() -> None:
        if rows:
            p = judge.probability(np.array(rows))
            for j in np.flatnonzero(p >= np.array(judge.thresholds)[[w[2] for w in where]]):
                sure.append((-float(p[j]), *where[j]))
            rows.clear()
            where.clear()

    for i, (t, base) in enumerate(zip(texts, bases, strict=True)):
        if not t or not _OPEN.search(t):
            continue
        taken = masks[i] = bytearray(len(t))
        for s, _, e in base:
            taken[s:e] = b"\1" * (e - s)
        last, cued = -1, None
        for s, kind, e in _candidates(t):
            if taken.find(1, s, e) < 0:
                last, cued = s, cued if s == last else cues(t, s)
                rows.append(features(t, s, e, kind, cued))
                where.append((i, s, kind, e))
                if len(rows) == _PORTION:
                    decide()
    decide()
    out = [(b, list(b)) for b in bases]
    for _, i, s, kind, e in sorted(sure, key=lambda x: (x[0], x[2])):
        if masks[i].find(1, s, e) < 0:
            masks[i][s:e] = b"\1" * (e - s)
            out[i][1].append((s, kind, e))
    return [(b, sorted(a)) for b, a in out]


def shown(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def redacted(text: str, spans: list[Span]) -> str:
    """The text with every span replaced by its kind in brackets; overlapping spans become one, by the first's kind."""
    out, at = [], 0
    for s, k, e in spans:
        if s >= at:
            out += [text[at:s], f"[{KINDS[k].upper()}]"]
        at = max(at, e)
    return "".join([*out, text[at:]])


def find_private(docs: DataFrame, key: str = "doc_id", text: str = "text", judge: Judge | None = None) -> DataFrame:
    """Finds personal data in every whole text: key, base counts (n_email ...), base (as text), spans, and the redacted text.

    Null text is empty and has none; its redacted text is null. Offsets count code points, ends exclusive.
    An empty table gives no rows.
    """
    session_setup(docs.sparkSession)
    judge = judge or fit_judge()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            rows = found_spans(texts, judge)
            counts = [pa.array([sum(k == j for _, k, _ in b) for b, _ in rows], pa.int64()) for j in range(len(KINDS))]
            clean = [redacted(t, a) if a else t for t, (_, a) in zip(texts, rows, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *counts, pa.array([shown(b) for b, _ in rows], pa.string()), pa.array([shown(a) for _, a in rows], pa.string()), pa.array(clean, pa.string())], names=["k", *(f"n_{x}" for x in KINDS), "base", "spans", "redacted"])

    out = docs.select(F.col(key).cast("long"), F.col(text)).mapInArrow(run, f"k long, {', '.join(f'n_{x} long' for x in KINDS)}, base string, spans string, redacted string")
    return out.withColumnRenamed("k", key)


def redact(docs: DataFrame, text: str = "text", judge: Judge | None = None) -> DataFrame:
    """Replaces every span found in the text column; all rows and other columns stay."""
    session_setup(docs.sparkSession)
    judge = judge or fit_judge()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(text)
            texts = batch.column(at).to_pylist()
            clean = [redacted(t, a) if a else t for t, (_, a) in zip(texts, found_spans(texts, judge), strict=True)]
            cols = [pa.array(clean, pa.string()) if i == at else c for i, c in enumerate(batch.columns)]
            yield pa.RecordBatch.from_arrays(cols, names=[f.name for f in batch.schema])

    return docs.mapInArrow(run, docs.schema)


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()
