"""The inverted file: recall and vectors read, where vectors cluster and where they don't; nulls, zeros and one hot vector."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from scriptorium.operators.vector_index import build_index, open_index, probed, search_index, share_read


def exact(x, q, k):
    d = np.round(1 - (q @ x.T) / (np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(x, axis=1)[None, :]), 6) + 0.0
    return [{(int(i), float(row[i])) for i in np.lexsort((np.arange(len(x)), row))[:k]} for row in d]


def recall(spark, index, x, q, k=10):
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(q)], "query_id long, query_vector array<double>")
    got = [set() for _ in q]
    for r in search_index(spark, index, df, k).collect():
        got[r["query_id"]].add((r["vec_id"], r["distance"]))
    want = exact(x, q, k)
    return sum(len(a & b) for a, b in zip(got, want, strict=True)) / sum(map(len, want))


def stored(spark, x):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(3)


@pytest.mark.parametrize("clusters", [60, 0])
def test_recall_and_vectors_read(spark, tmp_path, clusters):
    r = np.random.default_rng(5)
    n = 6000 if clusters else 1500
    x = r.standard_normal((n, 32)) + (8 * r.standard_normal((clusters, 32))[r.integers(0, clusters, n)] / 4 if clusters else 0)
    index = build_index(stored(spark, x), f"{tmp_path}/index")
    q = x[::75] + 0.05 * r.standard_normal((len(x[::75]), 32))
    assert recall(spark, index, x, q) >= 0.9
    if clusters:
        assert share_read(index, q) <= 0.2
        table = spark.read.parquet(f"{index.path}/lists")
        read = table.where(F.col("list").isin(probed(index, q[:1])[0].tolist()))
        assert read.count() <= 0.2 * n
        files = lambda df: df.select(F.input_file_name()).distinct().count()
        assert files(read) <= 0.2 * files(table)  # whole lists stay unread
    again = open_index(spark, index.path)
    assert again.probes == index.probes and (again.centroids == index.centroids).all() and again.sizes.sum() == n


def test_odd_vectors(spark, tmp_path):
    r = np.random.default_rng(2)
    x = np.vstack([np.tile(r.standard_normal(8), (300, 1)), r.standard_normal((600, 8))])
    odd = [(10_000, [0.0] * 8), (10_001, None), (10_002, [float("nan")] * 8), (10_003, [1.0] * 7 + [None])]
    df = stored(spark, x).unionByName(spark.createDataFrame(odd, "vec_id long, embedding array<double>"))
    index = build_index(df, f"{tmp_path}/odd")
    assert index.sizes.sum() == 901  # the zero vector is there and near to nothing
    assert recall(spark, index, x, x[::90]) >= 0.9
    none = search_index(spark, index, spark.createDataFrame([(1, None), (2, [0.0] * 8)], "query_id long, query_vector array<double>"))
    assert none.count() == 0


def test_no_vectors(spark, tmp_path):
    index = build_index(spark.createDataFrame([], "vec_id long, embedding array<double>"), f"{tmp_path}/none")
    assert search_index(spark, index, spark.createDataFrame([(1, [1.0])], "query_id long, query_vector array<double>")).count() == 0
