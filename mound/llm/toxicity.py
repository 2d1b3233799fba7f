"""Toxicity by a subsequence string kernel, Nystroem landmarks and a linear SVM.

A text is a bag of strings: its white-space tokens in lower case without outer punctuation,
and every run of single characters joined (``i d i o t``). Two strings are compared by the
gap-weighted subsequence kernel: every three characters in order, over a span of at most
``SPAN``, count ``DECAY ** span``; the ends of a string are characters too. A gap or an
inserted character (``id.iot``, ``stuupid``) therefore only lowers the value. The kernel
against ``LANDMARKS`` strings, whitened by the kernel among them (Nystroem), gives the
features of a string, and a linear SVM is fitted to labelled texts by multiple instances:
a toxic text has at least one toxic string, a clean text has none. The margin of a text is
that of its worst string; Platt's sigmoid turns it into a score.

The SVM and the landmarks are one linear function of the subsequences, so scoring a string
sums one weight for each of its subsequences; no text needs its neighbours or a shuffle.

Fitting: string counts cover about ``FIT_ROWS`` labelled texts; the SVM is fitted on the driver
to about ``FIT_TEXTS`` texts of each label, chosen by hash, against all strings of the clean ones.
The ``HIDDEN`` strings that most often make a text toxic are fitted with characters inserted and repeated too.
"""

from __future__ import annotations

import itertools
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mound.llm.tables import row_hash, settle, text_of

DECAY = 0.8
SPAN = 7
LANDMARKS = 256
FIT_ROWS = 20_000
FIT_TEXTS = 1_000
ROUNDS = 6
# Words that most often make a text toxic, as many as are fitted in hidden forms too.
HIDDEN = 64
COST = 10.0
CACHED = 250_000
# Starts of a long string and rows of a feature matrix that are handled at a time; cells of a lookup by array.
STARTS = 4_096
ROWS = 512
CELLS = 1 << 22
MIX = 0x9E3779B97F4A7C15
OUTER = "\"'`.,;:!?()[]{}<>|*_~-#/\\«»¿¡…“”‘’"


def strings(text: str | None) -> set[str]:
    """The strings of a text."""
    if not text:
        return set()
    tokens = text.lower().split()
    found = {t.strip(OUTER) for t in set(tokens)}
    for single, run in itertools.groupby(tokens, lambda t: len(t) == 1):
        if single:
            joined = "".join(run)
            if len(joined) > 2:
                found.add(joined)
    found.discard("")
    return found


def _triples(length: int, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of all subsequences of three within the span that start at ``low`` to ``high``, and their weights."""
    starts = np.arange(low, min(high, length))
    a, b = (x + 1 for x in np.triu_indices(SPAN - 1, 1))
    first = np.repeat(starts, len(a))
    places = np.stack([first, first + np.tile(a, len(starts)), first + np.tile(b, len(starts))])
    places = places[:, places[2] < length]
    return places, (DECAY ** (places[2] - places[0] + 1)).astype(np.float32)


def _norm(length: int) -> float:
    """Root of the sum of all squared weights: spans end at ``last`` in ``last - 1`` ways from each start before."""
    last = np.arange(2, SPAN)
    return float(np.sqrt((DECAY ** (2.0 * (last + 1)) * (last - 1) * np.maximum(0, length - last)).sum()))


class Alphabet:
    """Small numbers for the characters of the landmarks; 0 stands for any other."""

    def __init__(self, words: list[str]):
        self.points = np.array(sorted({ord(c) for w in words for c in w}), dtype=np.int32)
        self.size = len(self.points) + 3
        self.kind = np.int32 if self.size**3 < 2**31 else np.int64

    def coded(self, batch: list[str], length: int) -> np.ndarray:
        """One row a string, with both ends marked."""
        points = np.frombuffer("".join(batch).encode("utf-32-le", "surrogatepass"), dtype=np.int32)
        place = np.minimum(np.searchsorted(self.points, points), max(0, len(self.points) - 1))
        known = self.points[place] == points if len(self.points) else np.zeros(len(points), bool)
        out = np.zeros((len(batch), length + 2), dtype=self.kind)
        out[:, 1:-1] = np.where(known, place + 1, 0).reshape(len(batch), length)
        out[:, 0], out[:, -1] = self.size - 2, self.size - 1
        return out

    def subsequences(self, words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """By length: places in ``words``, coded subsequences of each, weights scaled to length 1.

        A long string comes in several parts, ``STARTS`` starts at a time, so no part is large.
        """
        by_length: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            by_length.setdefault(len(w), []).append(i)
        for length, at in by_length.items():
            norm = _norm(length + 2)
            step = max(1, 500_000 // (15 * min(length + 2, STARTS)))
            for k in range(0, len(at), step):
                some = at[k : k + step]
                c = self.coded([words[i] for i in some], length)
                for low in range(0, length + 2, STARTS):
                    places, weights = _triples(length + 2, low, low + STARTS)
                    if places.shape[1]:
                        pairs = c[:, places[0]] * self.kind(self.size) + c[:, places[1]]
                        yield np.array(some), pairs * self.kind(self.size) + c[:, places[2]], weights / np.float32(norm)


class Codes:
    """The coded subsequences that occur in some words, numbered from 1; 0 stands for any other.

    A small alphabet looks them up in an array of all cells, a large one by bisection: memory follows the words, not
    the cube of the alphabet.
    """

    def __init__(self, alphabet: Alphabet, words: list[str]):
        found = [np.unique(c) for _, c, _ in alphabet.subsequences(words)]
        self.codes = np.unique(np.concatenate(found)) if found else np.zeros(0, alphabet.kind)
        self.cells = alphabet.size**3

    def spread(self, values: np.ndarray) -> np.ndarray | None:
        """``values`` (one for each number, from 0) by cell, where cells are few."""
        if self.cells > CELLS:
            return None
        out = np.full(self.cells, values[0], dtype=values.dtype)
        out[self.codes] = values[1:]
        return out

    def numbers(self, c: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.codes, c)
        at[at == len(self.codes)] = 0
        return np.where(self.codes[at] == c, at + 1, 0) if len(self.codes) else at * 0


@dataclass
class Model:
    """One weight for each subsequence of the landmarks, the offset, and Platt's two numbers."""

    alphabet: Alphabet
    codes: Codes
    weights: np.ndarray  # from 1 by the number of the code; 0 for others
    offset: float
    slope: float
    shift: float
    mark: str = field(default_factory=lambda: uuid.uuid4().hex)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "table"}

    @cached_property
    def table(self) -> np.ndarray | None:
        return self.codes.spread(self.weights)

    def margins(self, words: list[str]) -> np.ndarray:
        out = np.full(len(words), self.offset, dtype=np.float64)
        table = self.table
        for at, codes, weights in self.alphabet.subsequences(words):
            own = table[codes] if table is not None else self.weights[self.codes.numbers(codes)]
            out[at] += own @ weights
        return out

    def score(self, margin: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.slope * margin + self.shift, -60, 60)))


def kernel(alphabet: Alphabet, words: list[str], landmarks: list[str]) -> np.ndarray:
    """Kernel of every word with every landmark, both scaled to length 1."""
    codes = Codes(alphabet, landmarks)
    row = codes.spread(np.arange(len(codes.codes) + 1, dtype=np.int32))
    number = codes.numbers if row is None else row.__getitem__
    table = np.zeros((len(codes.codes) + 1, len(landmarks)), dtype=np.float32)
    for at, c, w in alphabet.subsequences(landmarks):
        np.add.at(table, (number(c), at[:, None]), np.broadcast_to(w, c.shape))
    out = np.zeros((len(words), len(landmarks)), dtype=np.float32)
    for at, c, w in alphabet.subsequences(words):
        p = number(c)
        i, j = np.nonzero(p)
        if len(i):
            firsts = np.flatnonzero(np.r_[True, i[1:] != i[:-1]])
            # Some words at a time, so that their rows of the table stay within a few megabytes.
            step = max(1, 8_192 // c.shape[1])
            for k in range(0, len(firsts), step):
                lo, hi = firsts[k], firsts[k + step] if k + step < len(firsts) else len(i)
                part = table[p[i[lo:hi], j[lo:hi]]] * w[j[lo:hi], None]
                out[at[i[firsts[k : k + step]]]] += np.add.reduceat(part, firsts[k : k + step] - lo)
    return out


def stretched(word: str) -> list[str]:
    """Ways to hide a word that the SVM shall see too: inserted and repeated characters."""
    inner = range(1, len(word))
    out = [m.join(word) for m in ".-_*"]
    out += [word[:i] + m + word[i:] for i in inner for m in ".*-"]
    return out + [word[:i] + word[i - 1] + word[i:] for i in inner]


def _svm(parts: list[np.ndarray], y: np.ndarray, cost: np.ndarray, rounds: int = 30) -> np.ndarray:
    """Linear SVM with squared hinge loss by Newton steps; the last weight is the offset.

    The parts of the matrix stay where they are, in single precision; margins and normal equations are summed over blocks
    of their rows in double.
    """
    size = parts[0].shape[1] + 1
    starts = np.cumsum([0] + [len(x) for x in parts])
    blocks = [(x[k : k + ROWS], slice(s + k, s + min(k + ROWS, len(x)))) for s, x in zip(starts, parts) for k in range(0, len(x), ROWS)]
    w = np.zeros(size)
    ridge = np.eye(size)
    ridge[-1, -1] = 1e-6
    active = np.zeros(len(y), dtype=bool)
    for _ in range(rounds):
        left, right, now = ridge.copy(), np.zeros(size), np.zeros(len(y), dtype=bool)
        for x, at in blocks:
            b = np.hstack([x.astype(np.float64), np.ones((len(x), 1))])
            inside = y[at] * (b @ w) < 1
            now[at] = inside
            b, c, z = b[inside], cost[at][inside], y[at][inside]
            left += b.T @ (c[:, None] * b)
            right += b.T @ (c * z)
        if (now == active).all():
            break
        active = now
        w = np.linalg.solve(left, right)
    return w


def _platt(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the sigmoid, by Newton steps on smoothed targets."""
    p, n = (y > 0).sum(), (y <= 0).sum()
    target = np.where(y > 0, (p + 1) / (p + 2), 1 / (n + 2))
    z = np.stack([margin, np.ones_like(margin)], 1)
    w = np.array([1.0, 0.0])
    for _ in range(50):
        q = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve(z.T @ ((q * (1 - q))[:, None] * z) + 1e-3 * np.eye(2), z.T @ (q - target))
        w = w - step
        if abs(step).max() < 1e-9:
            break
    return float(w[0]), float(w[1])


def _tokens(rows: DataFrame, distinct: bool) -> DataFrame:
    """Strings of each text: one row a text with an array, or one row a string and label."""

    def listed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"toxic": b.toxic, "strings": [sorted(strings(t)) for t in b.text]})

    out = rows.mapInPandas(listed, "toxic int, strings array<string>")
    return out.select("toxic", F.explode("strings").alias("string")) if distinct else out


def apart(labelled: DataFrame) -> DataFrame:
    """One text of each group of near copies: words that copies share would pass for signs of their label.

    Two min-hashes of five-word shingles, one after the other; texts that share either are near copies.
    """

    def marked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            marks = []
            for text in b.text:
                t = text.lower().split()
                hashes = [xxhash.xxh64_intdigest(" ".join(t[i : i + 5])) >> 1 for i in range(max(1, len(t) - 4))]
                marks.append((min(hashes), min(h * MIX % 2**63 for h in hashes)))
            yield b.assign(h0=[m[0] for m in marks], h1=[m[1] for m in marks])

    rows = labelled.mapInPandas(marked, "text string, toxic int, h0 long, h1 long")
    for mark in ("h0", "h1"):
        least = F.min(F.struct("text", "toxic", "h1")).alias("r")
        rows = rows.groupBy(mark).agg(least).select("r.*")
    return rows.select("text", "toxic")


def fit(labelled: DataFrame, landmarks: int = LANDMARKS, fit_texts: int = FIT_TEXTS) -> Model:
    """Fit to ``text`` and ``toxic`` (0 or 1); rows with a null in either are left out.

    Without texts of both labels the model scores every text 0, or 1 if all are toxic.
    """
    labelled = labelled.select(F.col("text"), F.col("toxic").cast("int").alias("toxic")).filter(
        "text is not null and toxic in (0, 1)"
    )
    labelled = settle(apart(labelled))
    n = {r.toxic: r.n for r in labelled.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(n) < 2:
        none = Alphabet([])
        return Model(none, Codes(none, []), np.zeros(1, np.float32), 1.0 if 1 in n else -1.0, 60.0, 0.0)
    counts = _tokens(labelled, True).groupBy("string").agg(
        F.sum("toxic").alias("bad"), F.sum(1 - F.col("toxic")).alias("good")
    )
    # How far the shares of toxic and clean texts with the string stand apart, in standard errors.
    both = F.lit(float(n[0] + n[1]))
    share = (F.col("bad") + F.col("good")) / both
    error = F.sqrt(share * (1 - share + 1 / both) * (1.0 / n[0] + 1.0 / n[1]))
    z = (F.col("bad") / n[1] - F.col("good") / n[0]) / error
    counts = counts.filter("bad > 0").select("string", z.alias("z"))
    marks = [r.string for r in counts.orderBy(F.desc("z"), "string").limit(landmarks).collect()]
    picked = F.when(F.col("toxic") == 1, F.lit(n[1])).otherwise(F.lit(n[0]))
    sample = labelled.filter(F.pmod(row_hash(17, "text"), picked) < fit_texts)
    texts = _tokens(sample, False).collect()
    y = np.array([2 * r.toxic - 1 for r in texts])
    words = sorted({s for r in texts for s in r.strings})
    number = {w: i for i, w in enumerate(words)}
    bags = [np.array([number[s] for s in r.strings], dtype=np.int64) for r in texts]
    del texts  # the driver keeps each string once
    alphabet = Alphabet(marks)
    values, vectors = np.linalg.eigh(kernel(alphabet, marks, marks).astype(np.float64))
    keep = values > 1e-3 * values.max()
    whiten = vectors[:, keep] / np.sqrt(values[keep])

    codes = Codes(alphabet, marks)

    def features(some: list[str]) -> np.ndarray:
        out = np.zeros((len(some), whiten.shape[1]), np.float32)
        for k in range(0, len(some), ROWS):
            out[k : k + ROWS] = kernel(alphabet, some[k : k + ROWS], marks) @ whiten
        return out

    def model_of(w: np.ndarray) -> Model:
        table = np.zeros(len(codes.codes) + 1)
        beta = whiten @ w[:-1]
        for at, c, weights in alphabet.subsequences(marks):
            np.add.at(table, codes.numbers(c), beta[at][:, None] * weights[None, :])
        return Model(alphabet, codes, table.astype(np.float32), float(w[-1]), 1.0, 0.0)

    def worst(margin: np.ndarray) -> np.ndarray:
        return np.array([b[margin[b].argmax()] if len(b) else -1 for b in bags])

    # The first guess at the string that makes a text toxic: the one with the best odds, or likest to all.
    first = model_of(np.append(features(marks).sum(0), 0.0)).margins(words)
    rank = first / max(1e-9, abs(first).max())
    for i, m in enumerate(marks):
        if m in number:
            rank[number[m]] = 1 + len(marks) - i
    chosen = worst(rank)
    # Every string of every clean text of the sample is one of the other side, and stays so in all rounds.
    clean = sorted({i for b, label in zip(bags, y) if label < 0 for i in b})
    against = features([words[i] for i in clean])
    margin = np.zeros(len(words))
    for _ in range(ROUNDS):
        at = [int(i) for i in chosen[y > 0] if i >= 0]
        often = [words[i] for i, k in Counter(at).most_common(HIDDEN) if k > 1 and len(words[i]) > 3]
        extra = [v for o in often for v in stretched(o)]
        bad = [words[i] for i in at] + extra
        side = np.repeat([1.0, -1.0], [len(bad), len(clean)])
        light = COST * len(at) / max(1, len(extra)) / 4
        weight = np.repeat([COST, light, COST], [len(at), len(extra), len(clean)])
        model = model_of(_svm([features(bad), against], side, weight))
        margin = model.margins(words)
        new = worst(margin)
        if (new[y > 0] == chosen[y > 0]).all():
            break
        chosen = new
    top = np.array([margin[i] if i >= 0 else model.offset for i in worst(margin)])
    model.slope, model.shift = _platt(top, y)
    return model


_seen: dict[str, float] = {}
_seen_by: list[str] = [""]


def _margins(model: Model, bags: list[set[str]]) -> np.ndarray:
    """Worst margin of each bag. Strings once scored are kept for later tasks of the worker."""
    if _seen_by[0] != model.mark or len(_seen) > CACHED:
        _seen.clear()
        _seen_by[0] = model.mark
    new = sorted({s for b in bags for s in b if s not in _seen})
    _seen.update(zip(new, model.margins(new).tolist()))
    return np.array([max((_seen[s] for s in b), default=model.offset) for b in bags])


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Add ``score`` (0 to 1) and ``predicted`` (0 or 1, at 0.5) to every row.

    A null or empty text has no string and gets the score of the offset alone. Columns
    named ``score`` or ``predicted`` are replaced; all others stay. Equal texts get equal scores.
    """
    rows = docs.drop("score", "predicted")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for batch in batches:
            for k in range(0, len(batch), 256):
                part = batch.iloc[k : k + 256].copy()
                part["score"] = m.score(_margins(m, [strings(t) for t in part[text]]))
                part["predicted"] = (part["score"] >= 0.5).astype("int32")
                yield part

    return rows.mapInPandas(scored, f"{fields}, score double, predicted int")


def held_out(doc_id: Column) -> Column:
    """True for the fifth of the documents whose labels are never learnt from."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, most: int = FIT_ROWS) -> DataFrame:
    """Texts with a label that may be learnt from: about ``most`` of them, chosen by hash, or all.

    An id counts once: of several labels the toxic one holds, of several texts the one of smallest hash. Null ids
    and labels but 0 and 1 are left out. The chosen labels are settled, so Spark sends them to the documents if they are measured
    small.
    """
    known = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).filter(~held_out(F.col("doc_id")))
    known = known.filter("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n = known.count()
    some = settle(known.filter(F.pmod(row_hash(19, "doc_id"), F.lit(max(1, n))) < most))
    texts = docs.select("doc_id", text_of("text").alias("text")).join(some, "doc_id")
    one = texts.groupBy("doc_id", "toxic").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
    return one.select("text", "toxic")
