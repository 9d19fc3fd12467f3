"""Small helpers that the training-data operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SLICE_BYTES = 1 << 19


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share; a temporary one only where none is named and all runs on one machine."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if spark.sparkContext.getCheckpointDir() is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("name a folder that all executors share in spark.checkpoint.dir")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def written(df: DataFrame, label: str) -> DataFrame:
    """df as a table in the shared folder, read back: cuts the lineage and survives a lost executor."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def sieve(keys: DataFrame, key: Column, bits: int = 21) -> Callable[[Column], Column]:
    """A test that is true for every key in keys and for few others, from a bit map of fixed size (2^bits bits).

    key is the 64-bit hash of a row of keys; the test takes the same hash of another table's rows.
    """
    bit = lambda h: F.shiftrightunsigned(h, 64 - bits)
    at = lambda h: F.shiftright(bit(h), 6).cast("int")
    words = 1 << (bits - 6)
    marks = {r[0]: r[1] for r in keys.select(bit(key).alias("bit"), at(key).alias("at")).groupBy("at").agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("m")).collect()}  # `words` rows at most
    table = F.split(F.lit(",".join(str(marks.get(i, 0)) for i in range(words))), ",").cast("array<long>")
    return lambda h: F.call_function("shiftrightunsigned", table[at(h)], bit(h).bitwiseAND(F.lit(63)).cast("int")).bitwiseAND(F.lit(1)) == 1


def merged(rows: DataFrame, keys: list[str], spans: str) -> DataFrame:
    """rows (keys, an array of spans) with the array as maximal runs: sorted, and joined where they touch.

    Spans become rows and runs are numbered in order, within the keys' partition, so no array grows step by step.
    """
    each = rows.select(*keys, F.inline(spans))
    w = Window.partitionBy(*keys).orderBy("begin", "end")
    before = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = each.withColumn("new", (before.isNull() | (F.col("begin") > before)).cast("int"))
    run = new.withColumn("run", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    run = run.groupBy(*keys, "run").agg(F.min("begin").alias("begin"), F.max("end").alias("end"))
    return run.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("begin", "end"))).alias(spans))


def slide(x: np.ndarray, w: int, least: np.ufunc) -> np.ndarray:
    """Least (or greatest) of each window of w values."""
    size = 1
    while size * 2 <= w:
        x = least(x[:-size], x[size:])
        size *= 2
    return least(x[: len(x) - (w - size)], x[w - size :]) if w > size else x


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have."""
    while name in df.columns:
        name += "_"
    return name


def text_key(column: str) -> list:
    """128 bits that stand for a text."""
    text = F.coalesce(F.col(column), F.lit(""))
    return [F.xxhash64(text).alias("k1"), F.xxhash64(F.lit("second"), text).alias("k2")]


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about limit bytes of text each, so that work arrays stay small; a longer text is one part.

    Memory that the batch before has freed goes back to the system first.
    """
    pa.default_memory_pool().release_unused()
    sizes = np.cumsum(np.diff(offsets(batch.column(column))[1]))
    at, done = 0, 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(sizes, done + limit, side="right")))
        yield batch.slice(at, to - at)
        at, done = to, int(sizes[to - 1])


def grouped(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[int, pa.Table]]:
    """Groups of rows from a stream that is sorted by a long key, each whole even where it runs over batches."""
    held, at = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key).to_numpy()
        cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
        for i, j in zip(cuts, cuts[1:], strict=False):
            if held and keys[i] != at:
                yield at, pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(i, j - i))
            at = keys[i]
    if held:
        yield at, pa.Table.from_batches(held)


def offsets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a column of texts and where each begins, one more for the end; null counts as empty."""
    if texts.null_count:
        texts = texts.fill_null("")
    texts = texts.cast(pa.large_string())
    _, at, data = texts.buffers()
    at = np.frombuffer(at, np.int64, len(texts) + 1, texts.offset * 8) if at is not None and len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, at - at[0]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values (the public-domain splitmix64 finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BASE = 0x9E3779B97F4A7C15
_powers: dict[str, np.ndarray] = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def powers(kind: str, n: int) -> np.ndarray:
    if len(_powers[kind]) < n:
        base = _BASE if kind == "up" else pow(_BASE, -1, 1 << 64)
        steps = np.full(max(n, SLICE_BYTES + 1), base, np.uint64)
        steps[0] = 1
        _powers[kind] = np.multiply.accumulate(steps)
    return _powers[kind][:n]


def span_hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit hash of each byte span, from one running sum."""
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(mix_table(salt)[data] * powers("up", len(data)), out=total[1:])
    h = (total[end] - total[begin]) * powers("down", len(data) + 1)[begin]
    return mix(h + (end - begin).astype(np.uint64) * np.uint64(0xD1B54A32D192ED03))


def mix_table(salt: int = 0) -> np.ndarray:
    """A number for each byte."""
    if f"bytes{salt}" not in _powers:
        _powers[f"bytes{salt}"] = mix(np.arange(1, 257, dtype=np.uint64) + np.uint64(salt << 8))
    return _powers[f"bytes{salt}"]


def runs(mask: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of the true runs, cut where a text begins."""
    cut = np.zeros(len(mask) + 1, bool)
    cut[at] = True
    before = np.concatenate(([False], mask[:-1])) if len(mask) else mask
    after = np.concatenate((mask[1:], [False])) if len(mask) else mask
    return np.flatnonzero(mask & (~before | cut[:-1])), np.flatnonzero(mask & (~after | cut[1:])) + 1


def ascii_set(characters: str) -> np.ndarray:
    table = np.zeros(256, bool)
    table[[ord(c) for c in characters]] = True
    return table


def owner(at: np.ndarray, positions: np.ndarray) -> np.ndarray:
    """The text in which each byte position lies."""
    return np.searchsorted(at, positions, side="right") - 1


def per_owner(owners: np.ndarray, n: int, weights: np.ndarray | None = None) -> np.ndarray:
    return np.bincount(owners, weights, n).astype(np.int64)
