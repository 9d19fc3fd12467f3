"""Hard negatives against a plain version, packed scores against plain products."""

import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_contracts import vectors

import scriptorium.llm.negatives as N
from scriptorium.llm.negatives import mine, scale_of, scores


@pytest.mark.parametrize("most", [3, 300, 40000, 1 << 22])
def test_packed_scores(most):
    r = np.random.default_rng(most)
    a, c = r.integers(-most, most, (7, 9)), r.integers(-most, most + 1, (23, 9))
    assert (scores(a, c, scale_of(min(a.min(), c.min()), max(a.max(), c.max()), 9)) == a @ c.T).all()


def test_scores_beyond_a_long():
    with pytest.raises(ValueError):
        scale_of(-(1 << 30), 1 << 30, 64)


def plain(rows, positives=5, negatives=5, low=80, every=100):
    ok = [(i, [int(np.floor(256 * np.float64(np.float32(x)))) for x in v], y) for i, v, y in rows if i is not None and y is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for k, (i, v, y) in enumerate(ok):
        if i % every:
            continue
        scored = sorted((-sum(p * q for p, q in zip(v, w, strict=True)), j, z, m) for m, (j, w, z) in enumerate(ok) if m != k and len(w) == len(v))
        for s, j, *_ in [x for x in scored if x[2] == y][:positives]:
            near = [(n, -t) for t, n, z, _ in scored if z != y and low * -s <= 100 * -t <= 100 * -s][:negatives]
            out += [(i, j, rank + 1, n, -s, t) for rank, (n, t) in enumerate(near)]
    return sorted(out)


@pytest.mark.parametrize("block", [2, 4096])
def test_all_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(N, "ANCHORS", block)
    monkeypatch.setattr(N, "CANDIDATES", 16)
    df = spark.createDataFrame([(*r, 1, "x") for r in vectors()], "vec_id long, embedding array<float>, label int, row int, q string").repartition(3)
    got = mine(df, anchor=F.col("vec_id") % 100 == 0)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(map(tuple, got.collect())) == plain(vectors())


def test_one_vector_with_a_third_of_all_rows(spark):
    r = random.Random(1)
    rows = [(i, [r.randrange(9) / 256 for _ in range(4)] if i % 3 else [0.02, 0.01, 0.03, 0.02], i % 2) for i in range(900)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = sorted(map(tuple, mine(df, anchor=F.col("vec_id") % 100 == 0, positives=2, negatives=3).collect()))
    assert got == plain(rows, 2, 3) and len(got) > 30


def test_nothing_to_mine(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert mine(df, anchor=F.lit(True)).count() == 0
    assert mine(spark.createDataFrame([(1, None, 2)], df.schema), anchor=F.lit(True)).count() == 0
    found = defaultdict(int)
    for x in mine(spark.createDataFrame([(1, [0.5], 2), (2, [0.5], 2), (3, [0.5], 1)], df.schema), anchor=F.lit(True)).collect():
        found[x["anchor_id"]] += 1
    assert found == {1: 1, 2: 1}
