"""Quality rules: a short-circuit cascade.

The rules are independent predicates over whole texts.  A first job times every rule and counts what it rejects on a
sample of documents; the cascade then runs them by rejections per second, each on what the ones before it left.  The
order changes the work, never the verdict: a document is kept if no rule rejects it.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scriptorium.llm.common import ascii_set, mix, offsets, owner, per_owner, runs, slices, span_hashes

SPACE = ascii_set(" \t\n\x0b\x0c\r")
SYMBOL = ascii_set("#*$%&|<>")
UPPER = ascii_set("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
LOWER = ascii_set("abcdefghijklmnopqrstuvwxyz")
DIGIT = ascii_set("0123456789")
SHINGLE = 8
#: At most so many documents are timed.
SAMPLE_ROWS = 2000

Texts = tuple[np.ndarray, np.ndarray]
Rule = Callable[[Texts], np.ndarray]


def words(t: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin, end and text of each run of bytes other than white space."""
    begin, end = runs(~SPACE[t[0]], t[1])
    return begin, end, owner(t[1], begin)


def count_words(t: Texts) -> np.ndarray:
    return per_owner(words(t)[2], len(t[1]) - 1)


def count_bytes(t: Texts, table: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(table[t[0]])))
    return total[t[1][1:]] - total[t[1][:-1]]


def count_word_characters(t: Texts) -> np.ndarray:
    lead = ~SPACE & (np.arange(256) & 0xC0 != 0x80)
    return count_bytes(t, lead)


def line_counts(t: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Lines with a word, and those of them that equal an earlier line of their text."""
    data, at = t
    n = len(at) - 1
    begins = np.unique(np.concatenate((at[:-1], np.flatnonzero(data == 10) + 1)))
    ends = np.concatenate((begins[1:], [len(data)]))
    ends = ends - (data[np.maximum(ends - 1, 0)] == 10) * (ends > begins) if len(data) else ends
    total = np.concatenate(([0], np.cumsum(~SPACE[data])))
    full = total[ends] > total[begins]
    begins, ends = begins[full], ends[full]
    of = owner(at, begins)
    h = mix(span_hashes(data, begins, ends) + of.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    _, first = np.unique(h, return_index=True)
    lines = per_owner(of, n)
    return lines, lines - per_owner(of[first], n)


def count_repeat_words(t: Texts) -> np.ndarray:
    """Words inside a window of eight words that is found twice or more in the text."""
    begin, end, of = words(t)
    n = len(t[1]) - 1
    if len(begin) < SHINGLE:
        return np.zeros(n, np.int64)
    h = span_hashes(t[0], begin, end)
    m = len(h) - SHINGLE + 1
    window = np.zeros(m, np.uint64)
    for k in range(SHINGLE):
        window = window * np.uint64(0x2545F4914F6CDD1D) + h[k : k + m]
    window = mix(window + of[:m].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    inside = np.flatnonzero(of[:m] == of[SHINGLE - 1 :])
    order = inside[np.argsort(window[inside], kind="stable")]
    same = window[order[1:]] == window[order[:-1]]
    twice = np.zeros(len(order), bool)
    twice[1:] |= same
    twice[:-1] |= same
    steps = np.zeros(len(h) + 1, np.int64)
    hit = order[twice]
    np.add.at(steps, hit, 1)
    np.add.at(steps, hit + SHINGLE, -1)
    return per_owner(of[np.cumsum(steps[:-1]) > 0], n)


def base_counts(t: Texts) -> dict[str, np.ndarray]:
    return {"n_words": count_words(t), "word_chars": count_word_characters(t), "n_symbols": count_bytes(t, SYMBOL), "n_dup_lines": line_counts(t)[1], "n_repeat_words": count_repeat_words(t)}


def base_failed(c: dict[str, np.ndarray]) -> np.ndarray:
    return (c["n_words"] < 20) | (100 * c["n_repeat_words"] > 30 * c["n_words"])


def _long_words(t: Texts) -> np.ndarray:
    return count_word_characters(t) > 16 * np.maximum(count_words(t), 1)


def _few_letters(t: Texts) -> np.ndarray:
    """Under half of the characters in words are letters (all beyond ASCII count as letters)."""
    letters = UPPER | LOWER | (np.arange(256) >= 0xC0)
    return 2 * count_bytes(t, letters) < count_word_characters(t)


def _capitals(t: Texts) -> np.ndarray:
    upper = count_bytes(t, UPPER)
    return upper > count_bytes(t, LOWER) + 20


#: name -> predicate that is true for a text to reject.  No words or no text: only `few_words` rejects it.
#: Repeated lines are no reason: line dedup mends them, and labels call most such documents clean.
RULES: dict[str, Rule] = {
    "few_words": lambda t: count_words(t) < 20,
    "repeated_windows": lambda t: 100 * count_repeat_words(t) > 30 * count_words(t),
    "symbols": lambda t: 10 * count_bytes(t, SYMBOL) > count_words(t),
    "capitals": _capitals,
    "long_words": _long_words,
    "few_letters": _few_letters,
}


def measure(docs: DataFrame, text: str = "text", rules: dict[str, Rule] = RULES, sample_rows: int = SAMPLE_ROWS, seed: int = 7) -> list[tuple[str, float, float]]:
    """(rule, share rejected, seconds a document) on at most sample_rows documents, best rejection per cost first."""
    n = docs.count()
    sample = docs.select(F.col(text).alias("text")).sample(fraction=min(1.0, 1.5 * sample_rows / max(n, 1)), seed=seed).limit(sample_rows)

    def time_rules(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                t = offsets(part.column("text"))
                for name, rule in rules.items():
                    began = time.thread_time()
                    out = int(rule(t).sum())
                    yield pa.RecordBatch.from_pydict({"rule": [name], "n": [part.num_rows], "out": [out], "s": [time.thread_time() - began]})

    seen = {r["rule"]: r for r in sample.mapInArrow(time_rules, "rule string, n long, out long, s double").groupBy("rule").agg(F.sum("n").alias("n"), F.sum("out").alias("out"), F.sum("s").alias("s")).collect()}
    found = [(k, seen[k]["out"] / seen[k]["n"], seen[k]["s"] / seen[k]["n"]) if k in seen else (k, 0.0, 0.0) for k in rules]
    return sorted(found, key=lambda x: (-x[1] / max(x[2], 1e-9), x[2], x[0]))


def cascade(t: pa.Array, order: list[str], rules: dict[str, Rule] = RULES) -> np.ndarray:
    """Index in order of the first rule that rejects each text, -1 for none; each rule sees only what is left."""
    verdict = np.full(len(t), -1)
    left = np.arange(len(t))
    for i, name in enumerate(order):
        if not len(left):
            break
        out = rules[name](offsets(t if len(left) == len(t) else t.take(pa.array(left))))
        verdict[left[out]] = i
        left = left[~out]
    return verdict


def quality_rules(docs: DataFrame, text: str = "text", rules: dict[str, Rule] = RULES, sample_rows: int = SAMPLE_ROWS, counts: bool = False) -> DataFrame:
    """docs with `rejected_by` (the first rule of the cascade's order that rejects, null if kept) and `kept`.

    counts adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed, which need every text
    whole and so don't short-circuit.  Null text: as empty, rejected by few_words.  Repeated rows: each judged alike.
    Columns of these names in docs are replaced.
    """
    order = [name for name, _, _ in measure(docs, text, rules, sample_rows)]
    added = {"rejected_by": "string", "kept": "boolean"} | ({"n_words": "long", "word_chars": "long", "n_symbols": "long", "n_dup_lines": "long", "n_repeat_words": "long", "base_failed": "boolean"} if counts else {})
    held = docs.drop(*[c for c in added if c != text])
    schema = T.StructType(held.schema.fields + T._parse_datatype_string(", ".join(f"{k} {v}" for k, v in added.items())).fields)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text):
                t = part.column(text)
                t = t.fill_null("") if t.null_count else t
                v = cascade(t, order, rules)
                cols = [pa.array([order[i] if i >= 0 else None for i in v], pa.string()), pa.array(v < 0)]
                if counts:
                    c = base_counts(offsets(t))
                    cols += [pa.array(c[k]) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")] + [pa.array(base_failed(c))]
                yield pa.RecordBatch.from_arrays([*part.columns, *cols], names=[*part.schema.names, *added])

    return held.mapInArrow(judge, schema)


def reject(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents that no rule rejects, with their own columns."""
    order = [name for name, _, _ in measure(docs, text)]

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text):
                t = part.column(text)
                yield part.filter(pa.array(cascade(t.fill_null("") if t.null_count else t, order) < 0))

    return docs.mapInArrow(keep, docs.schema)
