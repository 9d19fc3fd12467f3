"""Phrases against plain containment: any length and script, nulls, repeats, a phrase that every text has, chosen keys."""

import random

import numpy as np
import pytest

import scriptorium.operators.phrases as P
from scriptorium.operators.citations import exists_in, ground_truth

TEXTS = ["An intrauterine device (MEC 2) is safe.", "Ödem und Straße — größer", "tiny", "", None, "AAAA" * 300, "a 😀 b", "x\ty\nz", "გამარჯობა მსოფლიო"]
PHRASES = ["intrauterine device", "MEC", "ödem", "device (mec 2)", "und str", "e", "is", "zz", "a 😀 b", "\ty\n", "მსოფლიო", "aaaaaaaaa", "aaab", "", None, "tiny", "tinyx", "an intrauterine device (mec 2) is safe.", "safe. an"]


def some(n, seed):
    r = random.Random(seed)
    words = ["der", "über", "mec", "a", "of the", "device", "naïve", "x-1"]
    texts = [" ".join(r.choice(words) for _ in range(r.randrange(30))) for _ in range(n)]
    return texts, [t[i : i + r.randrange(1, 20)] if r.random() < 0.7 else " ".join(r.sample(words, 3)) for t in texts for i in [r.randrange(len(t) + 1)]]


@pytest.mark.parametrize("slice_", [40, 1 << 20])
def test_exists_in(spark, monkeypatch, slice_):
    monkeypatch.setattr(P, "SLICE", slice_)
    texts, phrases = some(120, 3)
    texts, phrases = TEXTS + texts, PHRASES + phrases
    df = spark.createDataFrame([(i, p) for i, p in enumerate(phrases)], "id int, phrase string")
    got = {r["id"]: r["found"] for r in exists_in(df, spark.createDataFrame([(t, 1) for t in texts], "content string, gram int").repartition(3)).collect()}
    low = [t.lower() for t in texts if t is not None]
    assert got == {i: None if p is None else any(p.lower() in t for t in low) for i, p in enumerate(phrases)}


def test_nothing_to_find(spark):
    none = spark.createDataFrame([], "content string")
    asked = spark.createDataFrame([("a",), ("",), (None,)], "phrase string")
    assert {r["phrase"]: r["found"] for r in exists_in(asked, none).collect()} == {"a": False, "": False, None: None}
    assert exists_in(asked.limit(0), spark.createDataFrame([("a",)], "content string")).count() == 0


@pytest.mark.parametrize("few", [0, 50_000])
def test_ground_truth_by_page(spark, monkeypatch, few):
    monkeypatch.setattr(P, "FEW", few)
    texts, phrases = some(150, 9)
    chunks = [(i, i % 4, t, i % 3 > 0) for i, t in enumerate(texts)]
    questions = [(i, phrases[i : i + 3] + ["ÜBER"], [i % 4, 9]) for i in range(60)] + [(99, [], [1]), (98, ["a"], [])]
    got = {r["id"]: (r["live"], r["retired"], r["answerable"]) for r in ground_truth(spark.createDataFrame(questions, "id int, terms array<string>, pages array<int>"), spark.createDataFrame(chunks, "chunk_id int, page int, content string, live boolean")).collect()}
    for i, terms, pages in questions:
        hit = [live for _, page, t, live in chunks if page in pages and any(x and x.lower() in t.lower() for x in terms)]
        assert got[i] == (sum(hit), len(hit) - sum(hit), any(hit))


def test_numbers_of_short_runs_are_their_codes():
    codes = np.array([0, 1, 0x10FFFF, 97, 0, 0, 0x10FFFF, 0x10FFFF, 0x10FFFF], np.uint32)
    of = {n: [tuple(codes[i : i + n].tolist()) for i in range(len(codes) - n + 1)] for n in P.SIZES}
    known = {(run, int(x)) for n in P.SIZES for run, x in zip(of[n], P.numbers(codes, n).tolist(), strict=True)}
    assert len(known) == len({x for _, x in known}) == len({run for run, _ in known})
    assert max(P.numbers(codes, 3).tolist()) < 1 << 61 and max(P.numbers(codes, 8).tolist()) < 1 << 63


@pytest.mark.parametrize("slice_", [700, 1 << 20])
def test_whether_a_phrase_stands_anywhere_needs_no_index_of_places(spark, monkeypatch, slice_):
    """However often a run of characters stands in the texts, only phrases leave a task."""
    monkeypatch.setattr(P, "SLICE", slice_)
    monkeypatch.setattr(P, "index_texts", None)
    r = random.Random(5)
    texts = ["".join(r.choice("abä ") for _ in range(n)) for n in (0, 1, 7, 8, 9, 64, 600, 5000)] + ["the " * 4000, None]
    phrases = [t[i : i + n] for t in texts if t for n in (1, 2, 7, 8, 9, 63, 64, 65, 511, 512, 530) for i in (0, len(t) // 3, max(0, len(t) - n))]
    phrases += [p[:-1] + "x" for p in phrases] + ["the the", "the  the", "he t" * 3, "", None]
    got = {x["phrase"] for x in P.phrases_found(spark.createDataFrame([(p,) for p in phrases], "phrase string"), spark.createDataFrame([(t,) for t in texts], "content string").repartition(3)).collect()}
    assert got == {p for p in phrases if p and any(p in t for t in texts if t)}


def test_no_bytes_have_no_powers(monkeypatch):
    """The first texts that a worker is given may all be empty."""
    monkeypatch.setattr(P, "_powers", {})
    sums, back = P._sums(np.zeros(0, np.uint8))
    assert sums.tolist() == [0] and back.tolist() == [1]
