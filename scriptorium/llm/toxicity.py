"""Toxicity by a weighted lexicon, learned from labelled texts and matched by an Aho-Corasick automaton.

Texts are folded first: letters of other scripts that look Latin, digits and signs that stand for letters inside a word,
case, width and invisible characters.  The lexicon has beginnings of words, each weighted by its log odds among the words
of toxic against other texts; phrases of one or two words that hold an entry but speak for a clean text are exceptions, in
the same automaton, and cover the entries inside them.  A text's score comes from its summed weights over its length.

Weights and calibration come from a bounded sample of the labelled texts (`sample`); the texts that calibrate a lexicon are
not those that it was learned from.  Scoring reads every text in full and nothing but the text.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scriptorium.llm.common import slices, written

#: Letters of other scripts and the Latin letters that they look like; signs that stand for letters.
LOOKS = {"а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "ё": "e", "һ": "h", "і": "i", "ї": "i", "ј": "j", "к": "k", "м": "m", "о": "o", "р": "p", "ѕ": "s", "т": "t", "у": "y", "х": "x", "ԝ": "w", "α": "a", "β": "b", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ɑ": "a", "ɡ": "g"}
SIGNS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s"}
UNSEEN = "­​‌‍⁠﻿"
#: Texts that weights are learned from at most (in expectation), longest beginning of a word, least log odds and how sure.
SAMPLE = 8192
LONGEST = 12
LEAST, SURE = math.log(4), 2.5
#: Labelled-toxic and other texts that an entry, and an exception, must be seen in.
SEEN, CLEAN = 3, 5

_look = str.maketrans(LOOKS | dict.fromkeys(UNSEEN))
_sign = str.maketrans(SIGNS)
_signed = re.compile(r"(?<!\S)[^\s013457-8@$]*[013457-8@$]\S*")
_between = re.compile(r"[\W_]+")
_digits = re.compile(r"[\W\d_]+")


def _unsign(match: re.Match) -> str:
    """A word's signs as letters, if it has a letter; those that end a word are ornament."""
    word = match[0]
    return word if _digits.fullmatch(word) else word.rstrip("@$").translate(_sign)


def fold(text: str | None) -> str:
    """The folded words of a text, each between single spaces; a space alone if there are none."""
    text = (text or "").lower()
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text).lower().translate(_look)
    words = _between.sub(" ", _signed.sub(_unsign, text)).strip()
    return f" {words} " if words else " "


class Model(NamedTuple):
    """weights of beginnings of words, phrases that are exceptions, and the calibration of a text's sum and length."""

    weights: dict[str, float]
    exceptions: list[str]
    calibration: tuple[float, float, float]


class Matcher:
    """One automaton of entries and exceptions; an entry with l stands for its spelling with 1 too."""

    def __init__(self, weights: dict[str, float], exceptions: Iterable[str] = ()):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for entry, w in weights.items():
            for spelling in {entry, entry[0] + entry[1:].replace("l", "i")}:
                if spelling == entry or spelling not in weights:
                    self.automaton.add_word(f" {spelling}", (len(spelling) + 1, w))
        for phrase in exceptions:
            self.automaton.add_word(f" {phrase} ", (len(phrase) + 2, -1.0))
        if len(self.automaton):
            self.automaton.make_automaton()

    def hits(self, folded: str) -> dict[int, float]:
        """Where words begin that an entry starts and no exception covers, and the weight of the longest such entry."""
        if not len(self.automaton):
            return {}
        found: dict[int, float] = {}
        covered: list[tuple[int, int]] = []
        for end, (size, w) in self.automaton.iter(folded):
            if w < 0:
                covered.append((end - size + 1, end))
            else:
                found[end - size + 1] = w  # the longest of a word comes last
        for begin, end in covered:
            at = begin
            while 0 <= at < end:
                found.pop(at, None)
                at = folded.find(" ", at + 1, end)
        return found


def amounts(folded: str, matcher: Matcher) -> tuple[float, int]:
    """Summed weights and number of words."""
    return sum(matcher.hits(folded).values()), folded.count(" ") - 1


def features(weight: np.ndarray, words: np.ndarray) -> np.ndarray:
    return np.stack([np.ones(len(weight)), weight / (words + 20.0), np.log1p(weight)], axis=1)


def calibrated(weight: np.ndarray, words: np.ndarray, calibration: tuple[float, float, float]) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(features(weight, words) @ np.array(calibration), -30, 30)))


def calibrate(weight: np.ndarray, words: np.ndarray, toxic: np.ndarray) -> tuple[float, float, float]:
    """Logistic regression by Newton's method, with a small ridge; without both classes, a constant."""
    x, beta, ridge = features(weight, words), np.zeros(3), np.diag([1e-6, 1e-3, 1e-3])
    if not 0 < toxic.sum() < len(toxic):
        return (4.0 if len(toxic) and toxic.all() else -4.0, 0.0, 0.0)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + ridge, x.T @ (toxic - p) - ridge @ beta)
        beta = beta + np.clip(step, -5, 5)
    return tuple(float(b) for b in beta)


def choose(counts: dict[str, tuple[int, int]], toxic_words: int, other_words: int) -> dict[str, float]:
    """Entries from the counts of beginnings of words in toxic and other texts.

    A beginning counts if its log odds surely exceed LEAST; the shortest such beginnings are taken, and each is extended as
    long as one next letter has nearly all of its occurrences in toxic texts, so `tra` becomes `trash`.
    """

    def odds(p: int, q: int) -> tuple[float, float]:
        lo = math.log((p + 0.5) / (toxic_words - p + 0.5)) - math.log((q + 0.5) / (other_words - q + 0.5))
        return lo, lo - SURE * math.sqrt(1 / (p + 0.5) + 1 / (q + 0.5))

    sure = {b for b, (p, q) in counts.items() if len(b) >= 2 and p >= SEEN and odds(p, q)[1] > LEAST}
    longer: dict[str, str] = {}
    for b, (p, _) in counts.items():
        if p > counts.get(longer.get(b[:-1], ""), (0, 0))[0]:
            longer[b[:-1]] = b
    chosen = {}
    for b in sure:
        if any(b[:k] in sure for k in range(2, len(b))):
            continue
        while b in longer and counts[longer[b]][0] >= 0.95 * counts[b][0]:
            b = longer[b]
        chosen[b] = odds(*counts[b])[0]
    return chosen


def _word_counts(texts: DataFrame) -> DataFrame:
    """word, n: array of the texts that have it, toxic and other of half 0, then of half 1."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                counts: Counter = Counter()
                for text, toxic, half in zip(*(part.column(c).to_pylist() for c in ("text", "toxic", "half")), strict=True):
                    counts.update((w, 2 * half + (toxic != 1)) for w in set(fold(text).split()))
                yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in counts], pa.string()), pa.array([k[1] for k in counts], pa.int32()), pa.array(counts.values(), pa.int64())], names=["word", "kind", "n"])

    kinds = [F.sum(F.when(F.col("kind") == k, F.col("n")).otherwise(0)).alias(f"n{k}") for k in range(4)]
    return texts.mapInArrow(work, "word string, kind int, n long").groupBy("word").agg(*kinds)


def _phrase_counts(texts: DataFrame, weights: dict[str, float]) -> DataFrame:
    """phrase, toxic, other: texts with a phrase of one or two words that has an entry."""
    share = texts.sparkSession.sparkContext.broadcast(weights)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(share.value)
        for batch in batches:
            for part in slices(batch, "text"):
                counts: Counter = Counter()
                for text, toxic in zip(part.column("text").to_pylist(), part.column("toxic").to_pylist(), strict=True):
                    folded, seen = fold(text), set()
                    for at in matcher.hits(folded):
                        end = folded.index(" ", at + 1)
                        word = folded[at + 1 : end]
                        seen |= {word, f"{folded[folded.rfind(' ', 0, max(at, 0)) + 1 : at]} {word}".strip(), f"{word} {folded[end + 1 : max(folded.find(' ', end + 1), end + 1)]}".strip()}
                    counts.update((p, toxic != 1) for p in seen)
                yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in counts], pa.string()), pa.array([int(k[1]) for k in counts], pa.int32()), pa.array(counts.values(), pa.int64())], names=["phrase", "kind", "n"])

    kinds = [F.sum(F.when(F.col("kind") == k, F.col("n")).otherwise(0)).alias(c) for k, c in enumerate(("toxic", "other"))]
    return texts.mapInArrow(work, "phrase string, kind int, n long").groupBy("phrase").agg(*kinds)


def fit(labelled: DataFrame, text: str = "text", toxic: str = "toxic", sample: int = SAMPLE) -> Model:
    """Learn lexicon, exceptions and calibration from labelled texts (toxic: 1, anything else: not; null: left out).

    At most about `sample` texts are used, chosen by their hash, whatever the number of labelled texts; equal texts count
    once, as toxic if any of them is.  Without labelled texts, or with one class only, every score is the same.
    """
    rows = labelled.filter(F.col(toxic).isNotNull() & F.col(text).isNotNull()).select(F.col(text).alias("text"), (F.col(toxic) == 1).cast("int").alias("toxic"))
    n = rows.count()
    part = F.pmod(F.xxhash64("text"), F.lit(1 << 20))
    some = rows.filter(part * n < sample * (1 << 20)) if n > sample else rows
    texts = written(some.groupBy("text").agg(F.max("toxic").alias("toxic")).withColumn("half", (F.pmod(F.xxhash64(F.lit("half"), "text"), F.lit(2))).cast("int")), "labelled")
    words = _word_counts(texts)
    begins = words.select(F.explode(F.transform(F.sequence(F.lit(1), F.least(F.length("word"), F.lit(LONGEST))), lambda k: F.substring(F.col("word"), F.lit(1), k))).alias("begin"), *[f"n{k}" for k in range(4)])
    sums = [F.sum(f"n{k}").alias(f"n{k}") for k in range(4)]
    table = begins.groupBy("begin").agg(*sums).filter(F.col("n0") + F.col("n2") >= SEEN).collect()  # bounded with the sample
    total = [x or 0 for x in words.agg(*sums).first()]
    halves = [choose({r[0]: (r[1 + 2 * h], r[2 + 2 * h]) for r in table}, total[2 * h], total[1 + 2 * h]) for h in range(2)]
    weights = choose({r[0]: (r[1] + r[3], r[2] + r[4]) for r in table}, total[0] + total[2], total[1] + total[3])
    exceptions = [r[0] for r in _phrase_counts(texts, weights).filter((F.col("toxic") == 0) & (F.col("other") >= CLEAN)).select("phrase").collect()]
    share = labelled.sparkSession.sparkContext.broadcast(halves)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matchers = [Matcher(w) for w in reversed(share.value)]  # each half by the lexicon of the other
        for batch in batches:
            found = [amounts(fold(t), matchers[h]) for t, h in zip(batch.column("text").to_pylist(), batch.column("half").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.float64()), pa.array([x[1] for x in found], pa.int64()), batch.column("toxic")], names=["weight", "words", "toxic"])

    seen = texts.mapInArrow(measure, "weight double, words long, toxic int").toArrow()  # bounded with the sample
    return Model(weights, exceptions, calibrate(*(seen.column(c).to_numpy().astype(float) for c in ("weight", "words", "toxic"))))


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with `score` (double, 0 to 1) and `hits` (long), the words that entries begin.

    Null and empty texts have no words and score as such; repeated rows score alike.  Columns of these names are replaced.
    """
    share = docs.sparkSession.sparkContext.broadcast(model)
    held = docs.drop(*[c for c in ("score", "hits") if c != text])
    schema = T.StructType([*held.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("hits", T.LongType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = share.value
        matcher = Matcher(known.weights, known.exceptions)
        for batch in batches:
            for part in slices(batch, text):
                weight, words, hits = np.zeros(part.num_rows), np.zeros(part.num_rows), np.zeros(part.num_rows, np.int64)
                for k, t in enumerate(part.column(text)):
                    folded = fold(t.as_py())
                    found = matcher.hits(folded)
                    weight[k], words[k], hits[k] = math.fsum(found.values()), folded.count(" ") - 1, len(found)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(calibrated(weight, words, known.calibration)), pa.array(hits)], names=schema.names)

    return held.mapInArrow(work, schema)
