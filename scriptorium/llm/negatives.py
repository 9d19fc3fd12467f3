"""Hard negatives for contrastive training: per anchor and positive, the best rows of other labels that score nearly as well.

Scores are exact integer inner products.  Two candidates' components, made non-negative by a bias, stand in separate
fields of one wide integer; a block of such integers is multiplied once by the anchors' components, the products of all
components add up within their fields, and the scores are read from the fields.  Two fields of up to 26 bits fit the 53
bits that a double holds exactly, so the product of a block is one matrix product; wider scores use Python's integers.

Anchors are a stated set of queries.  They are taken in blocks of a fixed size, each block goes to all tasks, and every
task keeps the best few of its candidates for each anchor; what tasks keep meets in a window with few rows a task.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from math import ceil
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scriptorium.llm.common import shared_dir, written

#: Anchors of a block (about), and candidates whose scores are held at once.
ANCHORS = 4096
CANDIDATES = 512
#: Candidates in one wide integer where scores don't fit two fields of a double.
WIDE = 8


class Scale(NamedTuple):
    """What every component lies between, and the bits of a field that holds a sum of products of biased components."""

    low: int
    high: int
    bits: int


def scale_of(low: int, high: int, size: int) -> Scale:
    """Bounds of all components; a ValueError where 100 times a score would leave 64 bits."""
    low, high = int(low), int(high)
    if 100 * size * max(abs(low), abs(high)) ** 2 >= 1 << 63:
        raise ValueError(f"components from {low} to {high} of vectors of {size} give scores that a long can't hold")
    return Scale(low, high, max(1, (size * (high - low) ** 2).bit_length()))


def scores(anchors: np.ndarray, candidates: np.ndarray, scale: Scale) -> np.ndarray:
    """Inner products (int64) of each anchor with each candidate, from packed candidates."""
    fields, kind = (2, np.float64) if 2 * scale.bits <= 53 else (WIDE, object)
    n, size = candidates.shape
    lanes = np.zeros((-(-n // fields) * fields, size), np.int64)
    lanes[:n] = candidates - scale.low
    lanes = lanes.astype(kind).reshape(len(lanes) // fields, fields, size)
    packed = sum(lanes[:, f] * (kind(2 ** (scale.bits * f)) if kind is np.float64 else 1 << (scale.bits * f)) for f in range(fields))
    biased = anchors - scale.low
    product = biased.astype(kind) @ packed.T
    if kind is np.float64:
        product = product.astype(np.int64)
    mask = (1 << scale.bits) - 1
    out = np.stack([((product >> (scale.bits * f)) & mask).astype(np.int64) for f in range(fields)], axis=2).reshape(len(anchors), len(lanes) * fields)[:, :n]
    # (c - low)(a - low) summed, less what the biases added
    return out + scale.low * biased.sum(axis=1)[:, None] + scale.low * candidates.sum(axis=1)[None, :]


class Best:
    """The best k candidates of each of n keys so far: higher scores first, ties by smaller id, then by row."""

    def __init__(self, n: int, k: int):
        self.k, self.floor = k, np.full(n, np.iinfo(np.int64).min)
        self.key, self.score, self.id, self.row = (np.zeros(0, np.int64) for _ in range(4))

    def add(self, key: np.ndarray, score: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        if not len(key):
            return
        key, score, ids, rows = (np.concatenate(x) for x in ((self.key, key), (self.score, score), (self.id, ids), (self.row, rows)))
        order = np.lexsort((rows, ids, -score, key))
        key, score, ids, rows = key[order], score[order], ids[order], rows[order]
        first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        place = np.arange(len(key)) - np.repeat(first, np.diff(np.append(first, len(key))))
        top = place < self.k
        self.key, self.score, self.id, self.row = key[top], score[top], ids[top], rows[top]
        full = place == self.k - 1
        self.floor[key[full]] = score[full]

    def batch(self) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (self.key, self.score, self.id, self.row)], names=["key", "score", "id", "row"])


def _blocks(batch: pa.RecordBatch, size: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Rows, ids, labels and components of the vectors of one length, a few at a time."""
    lists = batch.column("q")
    keep = np.flatnonzero(lists.value_lengths().to_numpy(zero_copy_only=False) == size)
    for i in range(0, len(keep), CANDIDATES):
        part = batch.take(pa.array(keep[i : i + CANDIDATES]))
        row, ids, label = (part.column(c).to_numpy() for c in ("row", "id", "label"))
        yield row, ids, label, part.column("q").flatten().to_numpy().reshape(len(row), size)


OUT = "key long, score long, id long, row long"
RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def _top(df: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("key").orderBy(F.desc("score"), "id", "row")
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def mine(vectors: DataFrame, anchor: Column, id: str = "vec_id", vector: str = "embedding", label: str = "label", positives: int = 5, negatives: int = 5, low: int = 80, steps: int = 256) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: hard negatives of every anchor.

    Components are floor(steps * x).  An anchor's positives are the best other rows of its label; for each, the best rows
    of other labels with low * positive_score <= 100 * negative_score <= 100 * positive_score.  Rows without id, label or
    vector, or with a component that is null or not finite, take no part.  Ties go by id; of repeated rows each counts as
    a row, so a copy of an anchor is one of its positives and an anchor itself.  Vectors of different lengths don't meet;
    empty ones score 0.  Other columns are left out.  An anchor without positives, or a positive without negatives, has
    no rows.
    """
    spark = vectors.sparkSession
    sound = F.forall(F.col(vector), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    parts = [F.col(id).cast("long").alias("id"), F.col(label).cast("long").alias("label"), anchor.alias("anchor")]
    q = F.transform(F.col(vector), lambda x: F.floor(x.cast("double") * steps).cast("long")).alias("q")
    rows = vectors.filter(F.col(id).isNotNull() & F.col(label).isNotNull() & F.col(vector).isNotNull() & sound).select(*parts, q)
    rows = written(rows.withColumn("row", F.monotonically_increasing_id()), "vectors")
    kinds = rows.filter("anchor").groupBy(F.size("q").alias("size")).count().collect()  # a row for each length of vector
    bounds = rows.agg(F.min(F.array_min("q")), F.max(F.array_max("q"))).first()
    path = f"{shared_dir(spark)}/negatives-{uuid.uuid4().hex}"
    spark.createDataFrame([], RESULT).write.parquet(path)  # so that the table is there without anchors too
    for size, n in kinds:
        scale = scale_of(bounds[0] or 0, bounds[1] or 0, size)
        blocks = ceil(n / ANCHORS)
        block = F.pmod(F.xxhash64("row"), F.lit(blocks))
        for k in range(blocks):
            own = rows.filter(F.col("anchor") & (F.size("q") == size) & (block == k)).select("row", "id", "label", "q").toArrow()
            _mine_block(rows, own, size, scale, positives, negatives, low).write.mode("append").parquet(path)
    return spark.read.schema(RESULT).parquet(path)


def _mine_block(rows: DataFrame, own: pa.Table, size: int, scale: Scale, positives: int, negatives: int, low: int) -> DataFrame:
    spark = rows.sparkSession
    a_row, a_id, a_label = (own.column(c).to_numpy() for c in ("row", "id", "label"))
    a_q = own.column("q").combine_chunks().flatten().to_numpy().reshape(len(a_row), size)
    share = spark.sparkContext.broadcast((a_row, a_label, a_q))

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row_of, label_of, vectors = share.value
        best = Best(len(row_of), positives)
        for batch in batches:
            for row, ids, label, q in _blocks(batch, size):
                s = scores(vectors, q, scale)
                i, j = np.nonzero((label_of[:, None] == label[None, :]) & (row_of[:, None] != row[None, :]) & (s >= best.floor[:, None]))
                best.add(i, s[i, j], ids[j], row[j])
        yield best.batch()

    tops = _top(rows.mapInArrow(near, OUT), positives).select("key", "rank", "id", "score").toArrow()  # a few rows an anchor of the block
    slot = tops.column("key").to_numpy() * positives + tops.column("rank").to_numpy() - 1
    p_id, p_score, there = np.zeros(len(a_row) * positives, np.int64), np.zeros(len(a_row) * positives, np.int64), np.zeros(len(a_row) * positives, bool)
    p_id[slot], p_score[slot], there[slot] = tops.column("id").to_numpy(), tops.column("score").to_numpy(), True
    limits = spark.sparkContext.broadcast((p_score.reshape(-1, positives), there.reshape(-1, positives)))

    def hard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, label_of, vectors = share.value
        top, known = limits.value
        best = Best(len(label_of) * positives, negatives)
        for batch in batches:
            for row, ids, label, q in _blocks(batch, size):
                s = scores(vectors, q, scale)
                other = label_of[:, None] != label[None, :]
                for p in range(positives):
                    at = np.arange(len(label_of)) * positives + p
                    i, j = np.nonzero(other & known[:, p, None] & (s <= top[:, p, None]) & (100 * s >= low * top[:, p, None]) & (s >= best.floor[at][:, None]))
                    best.add(i * positives + p, s[i, j], ids[j], row[j])
        yield best.batch()

    names = spark.createDataFrame(pa.table({"key": np.flatnonzero(there), "anchor_id": np.repeat(a_id, positives)[there], "positive_id": p_id[there], "positive_score": p_score[there]}))
    kept = _top(rows.mapInArrow(hard, OUT), negatives).join(F.broadcast(names), "key")  # names: a few rows an anchor of the block
    return kept.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
