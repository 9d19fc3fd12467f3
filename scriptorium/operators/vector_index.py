"""Approximate nearest vectors by an inverted file: vectors lie in lists by their nearest centroid, a query reads a few lists.

Centroids are fitted on a bounded sample, chosen by hash over all rows; every vector is written to its list.  How many lists
a query reads is fitted too, so that the sample's own nearest neighbours are found: few where vectors cluster, more where
they don't.  Distances are exact, so what an answer can lack is a neighbour, never its distance.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Vectors that centroids are fitted on (about), of these the queries that fit the number of lists, and the recall aimed at.
SAMPLE, TRIALS, RECALL = 10_000, 200, 0.96
#: Queries of a block, and vectors whose distances to it are held at once.
BLOCK, ROWS = 2_000, 1_024


class VectorIndex(NamedTuple):
    """path: of the table, partitioned by list; centroids: unit vectors; sizes: vectors of each list; probes: lists a query reads."""

    path: str
    centroids: np.ndarray
    sizes: np.ndarray
    probes: int


def _unit(x: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(norm == 0, 1, norm)


def _matrix(batch: pa.RecordBatch | pa.Table, column: str) -> np.ndarray:
    values = batch.column(column)
    values = values.combine_chunks() if isinstance(values, pa.ChunkedArray) else values
    return values.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(batch.num_rows, -1)


def _sound(vectors: DataFrame) -> DataFrame:
    x = F.col("embedding")
    return vectors.select("vec_id", "embedding").where(x.isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v)))


def fit_centroids(vectors: DataFrame, lists: int | None = None, sample: int = SAMPLE, k: int = 10, recall: float = RECALL) -> tuple[np.ndarray, int]:
    """Centroids, and the fewest lists that give the sample's queries `recall` of their k nearest in the sample."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    n = vectors.count()
    part = F.pmod(F.xxhash64("vec_id"), F.lit(1 << 20))
    some = vectors.where(part * n < sample * (1 << 20)) if n > sample else vectors
    rows = some.select("embedding").toArrow()  # bounded by the sample
    if not rows.num_rows:
        return np.zeros((0, 0)), 0
    x = _unit(_matrix(rows, "embedding"))
    lists = lists or max(1, min(len(x) // 8, int(4 * n**0.5)))
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double")))
    unit = F.transform("embedding", lambda v: v.cast("double") / F.when(norm == 0, 1.0).otherwise(norm))
    model = KMeans(k=lists, maxIter=12, seed=7, featuresCol="f").fit(some.select(array_to_vector(unit).alias("f")))
    centroids = _unit(np.array(model.clusterCenters()))
    q = x[np.linspace(0, len(x) - 1, min(TRIALS, len(x))).astype(int)]
    own = (x @ centroids.T).argmax(1)
    near = np.argsort(-(q @ x.T), axis=1, kind="stable")[:, : k + 1]
    place = np.argsort(np.argsort(-(q @ centroids.T), axis=1, kind="stable"), axis=1)  # of each list for each query
    need = np.take_along_axis(place, own[near], axis=1)
    found = [(need < p).mean() for p in range(1, len(centroids) + 1)]
    return centroids, int(np.argmax(np.array(found) >= recall)) + 1


def build_index(vectors: DataFrame, path: str, **fitting) -> VectorIndex:
    """Write vectors (vec_id, embedding) by list; a vector that is null or has a null or NaN component is left out.

    Lists of any size are written by several tasks, as the rows of one list needn't meet.
    """
    spark, vectors = vectors.sparkSession, _sound(vectors)
    centroids, probes = fit_centroids(vectors, **fitting)
    share = spark.sparkContext.broadcast(centroids)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                nearest = (_unit(_matrix(batch, "embedding")) @ share.value.T).argmax(1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(nearest.astype(np.int32))], names=[*batch.schema.names, "list"])

    kinds = dict(vectors.dtypes)
    rows = vectors.mapInArrow(assign, f"vec_id {kinds['vec_id']}, embedding {kinds['embedding']}, list int")
    rows.hint("rebalance", "list").write.mode("overwrite").partitionBy("list").parquet(f"{path}/lists")
    n = dict(map(tuple, spark.read.schema(rows.schema).parquet(f"{path}/lists").groupBy("list").count().collect()))
    table = [(i, c.tolist(), n.get(i, 0), probes) for i, c in enumerate(centroids)]
    spark.createDataFrame(table, "list int, centroid array<double>, n long, probes int").coalesce(1).write.mode("overwrite").parquet(f"{path}/centroids")
    return open_index(spark, path)


def open_index(spark: SparkSession, path: str) -> VectorIndex:
    rows = spark.read.parquet(f"{path}/centroids").orderBy("list").collect()  # as many as lists
    return VectorIndex(path, np.array([r["centroid"] for r in rows]), np.array([r["n"] for r in rows], np.int64), rows[0]["probes"] if rows else 0)


def probed(index: VectorIndex, queries: np.ndarray) -> np.ndarray:
    """The lists that each query reads."""
    return np.argsort(-(_unit(queries) @ index.centroids.T), axis=1, kind="stable")[:, : index.probes]


def share_read(index: VectorIndex, queries: np.ndarray) -> float:
    """The share of all vectors that a query reads, on average."""
    return float(index.sizes[probed(index, queries)].sum(axis=1).mean() / max(1, index.sizes.sum()))


def search_index(spark: SparkSession, index: VectorIndex, queries: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, vec_id, distance, rank): the k nearest of the vectors in each query's lists, ties by vec_id.

    Queries (query_id, query_vector) go in blocks; a block reads only the lists that some query of it wants, a task
    measures a few vectors at a time, and only against the queries of their list.
    """
    out = spark.createDataFrame([], "query_id long, vec_id long, distance double")
    if not len(index.centroids):
        return out.withColumn("rank", F.lit(0))
    stored = spark.read.parquet(f"{index.path}/lists")
    n = queries.count()
    blocks = -(-n // BLOCK)
    block_of = F.pmod(F.xxhash64("query_id"), F.lit(max(1, blocks)))
    for b in range(blocks):
        own = queries.where("query_vector is not null").where(block_of == b).select("query_id", "query_vector").toArrow()
        if not own.num_rows:
            continue
        q = _matrix(own, "query_vector")
        lists = probed(index, q)
        wants = np.zeros((len(index.centroids), len(q)), bool)
        wants[lists, np.arange(len(q))[:, None]] = True
        block = spark.sparkContext.broadcast((own.column("query_id").to_numpy(), q, wants))

        def near(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            ids, q, wants = block.value
            length = np.linalg.norm(q, axis=1)
            for batch in batches:
                for at in range(0, batch.num_rows, ROWS):
                    part = batch.slice(at, ROWS)
                    x, vec = _matrix(part, "embedding"), part.column("vec_id").to_numpy()
                    i, j = np.nonzero(wants[part.column("list").to_numpy()])
                    size = np.linalg.norm(x, axis=1)[i] * length[j]
                    d = np.round(1 - (x @ q.T)[i, j] / np.where(size == 0, np.nan, size), 6) + 0.0
                    order = np.lexsort((vec[i], d, j))
                    order = order[~np.isnan(d[order])]
                    place = np.arange(len(order)) - np.searchsorted(j[order], j[order])
                    order = order[place < k]
                    yield pa.RecordBatch.from_arrays([pa.array(ids[j[order]]), pa.array(vec[i[order]]), pa.array(d[order])], names=["query_id", "vec_id", "distance"])

        some = stored.where(F.col("list").isin(np.unique(lists).tolist()))
        out = out.unionByName(some.mapInArrow(near, "query_id long, vec_id long, distance double"))
    return out.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "vec_id"))).where(F.col("rank") <= k)
