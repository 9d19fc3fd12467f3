"""Exact repeats of long byte strings, by suffix arrays over shards.

A window of `SIZE` bytes is known by the least hash of its 16-byte grams.  Neighbouring windows of one least hash make a
segment, so equal windows lie in segments of one hash, and segments can be dealt to shards by it.  A hash with one
segment, in which it occurs once, holds no repeat and drops out.  Segments that are equal throughout are counted, not
sorted: all their windows repeat.  What is left, one copy of each different segment, goes to its shard, where a suffix
array by induced sorting and the permuted common prefixes tell which windows start twice.

A hash whose different segments come to more than `HOT` bytes is spread by whole windows instead: their 128-bit hashes
are counted, which no single task has to hold.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.common import grouped, merged, offsets, owner, sieve, slices, slide, span_hashes, text_key, written
from scriptorium.llm.suffixes import repeated

SIZE, GRAM = 400, 16
#: Bytes of segments a shard, about, and bytes of different segments under one hash that still fit a shard.
SHARD, HOT = 3 << 20, 8 << 20
SLICE = 1 << 19
END = 0xFF  # in no UTF-8 text

SEGMENT = "k1 long, k2 long, begin int, end int, h long, c1 long, c2 long, again boolean"


def segments(t: tuple[np.ndarray, np.ndarray]) -> dict[str, np.ndarray]:
    """Text, begin and end (in its bytes), least hash, content hashes, and whether the hash occurs twice in the segment."""
    data, at = t
    n, grams = len(data), SIZE - GRAM + 1
    empty = {k: np.zeros(0, np.int64) for k in ("of", "begin", "end", "h", "c1", "c2", "again")}
    if n < SIZE:
        return empty
    where = np.arange(n - GRAM + 1)
    g = span_hashes(data, where, where + GRAM)
    least = slide(g, grams, np.minimum)
    of = owner(at, np.arange(len(least)))
    valid = np.arange(len(least)) + SIZE <= at[of + 1]
    new = valid.copy()
    new[1:] &= (least[1:] != least[:-1]) | (of[1:] != of[:-1]) | ~valid[:-1]
    begin = np.flatnonzero(new)
    if not len(begin):
        return empty
    stop = valid.copy()
    stop[:-1] &= new[1:] | ~valid[1:]
    last = np.flatnonzero(stop)
    end = last + SIZE
    h = least[begin]
    # places of least hashes, sorted by hash, then place: is there a second one inside the segment?
    padded = np.concatenate((np.zeros(grams - 1, np.uint64), np.where(valid, least, 0), np.zeros(grams - 1, np.uint64)))
    spots = np.flatnonzero(slide(padded, grams, np.maximum)[: len(g)] == g)
    values, code = np.unique(g[spots], return_inverse=True)
    line = np.sort(code.astype(np.int64) * (n + 1) + spots)
    mine = np.searchsorted(values, h).astype(np.int64) * (n + 1)
    again = np.searchsorted(line, mine + end - GRAM, side="right") - np.searchsorted(line, mine + begin) > 1
    return {"of": of[begin], "begin": begin - at[of[begin]], "end": end - at[of[begin]], "h": h.view(np.int64), "c1": span_hashes(data, begin, end).view(np.int64), "c2": span_hashes(data, begin, end, 1).view(np.int64), "again": again}


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text", SLICE):
            s = segments(offsets(part.column("text")))
            of = pa.array(s["of"])
            yield pa.RecordBatch.from_arrays([part.column("k1").take(of), part.column("k2").take(of), pa.array(s["begin"], pa.int32()), pa.array(s["end"], pa.int32()), pa.array(s["h"]), pa.array(s["c1"]), pa.array(s["c2"]), pa.array(s["again"], pa.bool_())], names=["k1", "k2", "begin", "end", "h", "c1", "c2", "again"])


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Where the windows that start twice in the shard start, as runs within each segment."""
    for _, shard in grouped(batches, "shard"):
        data, at = offsets(shard.column("bytes").combine_chunks().cast(pa.large_binary()).view(pa.large_string()))
        room = np.diff(at)
        t = np.full(len(data) + len(room), END, np.uint8)
        starts = at[:-1] + np.arange(len(room))
        t[np.arange(len(data)) + np.repeat(np.arange(len(room)), room)] = data
        hit = repeated(t, SIZE)
        of = np.repeat(np.arange(len(room)), room + 1)
        hit &= np.arange(len(t)) - starts[of] <= room[of] - SIZE
        edge = np.flatnonzero(hit & ~np.concatenate(([False], hit[:-1])))
        stop = np.flatnonzero(hit & ~np.concatenate((hit[1:], [False])))
        rows = pa.array(of[edge])
        yield pa.RecordBatch.from_arrays([shard.column(k).combine_chunks().take(rows) for k in ("k1", "k2", "at")] + [pa.array(edge - starts[of[edge]], pa.int32()), pa.array(stop - starts[of[edge]] + SIZE, pa.int32())], names=["k1", "k2", "at", "begin", "end"])


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch.set_column(batch.schema.get_field_index("bytes"), "bytes", batch.column("bytes").cast(pa.large_binary()).view(pa.large_string())), "bytes", SLICE):
            data, at = offsets(part.column("bytes"))
            of = owner(at, np.arange(len(data)))
            starts = np.flatnonzero(np.arange(len(data)) + SIZE <= at[of + 1]) if len(data) else np.zeros(0, np.int64)
            rows = pa.array(of[starts])
            yield pa.RecordBatch.from_arrays([part.column(k).take(rows) for k in ("k1", "k2", "at")] + [pa.array(starts - at[of[starts]], pa.int32()), pa.array(span_hashes(data, starts, starts + SIZE).view(np.int64)), pa.array(span_hashes(data, starts, starts + SIZE, 1).view(np.int64))], names=["k1", "k2", "at", "off", "w1", "w2"])


def find_repeats(docs: DataFrame, text: str = "text", hot: int = HOT, shard_bytes: int = SHARD) -> DataFrame:
    """(k1, k2, removed): for each text (by its key) with repeated windows, the maximal runs of their bytes."""
    read = docs.select(*text_key(text), F.coalesce(text, F.lit("")).alias("text"))
    seen = written(read.mapInArrow(_segments, SEGMENT), "segments")
    kinds = seen.groupBy("h", "c1", "c2").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("k1", "k2", "begin", "end")).alias("one"), F.bool_or("again").alias("again"))
    kinds = written(kinds, "kinds")
    groups = kinds.groupBy("h").agg(F.count(F.lit(1)).alias("kinds"), F.sum(F.col("one.end") - F.col("one.begin")).alias("bytes"), F.bool_or("again").alias("again")).where("kinds > 1 or again")
    open_ = written(kinds.join(groups.select("h", "bytes"), "h").select("h", "n", "one.*", "bytes"), "open")
    total = open_.agg(F.sum(F.col("end") - F.col("begin"))).first()[0] or 0
    # the bytes of one copy of each segment: from the texts that have one, each cut in its own row
    near = sieve(open_, F.xxhash64("k1", "k2"))
    pieces = open_.select(F.struct("k1", "k2").alias("key"), "h", "n", F.col("begin").alias("at"), "end", "bytes")
    cut = read.where(near(F.xxhash64("k1", "k2"))).select(F.struct("k1", "k2").alias("key"), F.col("text").cast("binary").alias("raw")).join(pieces, "key")
    cut = cut.select("h", "key.*", "at", "bytes", F.expr("substring(raw, at + 1, end - at)").alias("piece")).groupBy("h", "k1", "k2", "at").agg(F.first("bytes").alias("size"), F.first("piece").alias("bytes"))
    cut = written(cut, "pieces")
    shards = max(1, -(-int(total) // shard_bytes))
    dealt = cut.where(F.col("size") <= hot).select(F.pmod(F.xxhash64("h"), F.lit(shards)).alias("shard"), "k1", "k2", "at", "bytes")
    sorted_ = dealt.repartition("shard").sortWithinPartitions("shard").mapInArrow(_search, "k1 long, k2 long, at int, begin int, end int")
    spans = sorted_.select("k1", "k2", (F.col("at") + F.col("begin")).alias("begin"), (F.col("at") + F.col("end")).alias("end"))
    wide = cut.where(F.col("size") > hot)
    if wide.limit(1).count():
        windows = written(wide.select("k1", "k2", "at", "bytes").mapInArrow(_windows, "k1 long, k2 long, at int, off int, w1 long, w2 long"), "windows")
        twice = windows.groupBy("w1", "w2").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
        hits = windows.join(twice, ["w1", "w2"]).select("k1", "k2", (F.col("at") + F.col("off")).alias("begin"))
        spans = spans.unionByName(hits.select("k1", "k2", "begin", (F.col("begin") + SIZE).alias("end")))
    equal = kinds.where("n > 1").select("h", "c1", "c2")
    spans = spans.unionByName(seen.join(equal, ["h", "c1", "c2"]).select("k1", "k2", "begin", "end"))
    return merged(spans.groupBy("k1", "k2").agg(F.collect_set(F.struct("begin", "end")).alias("removed")), ["k1", "k2"], "removed")


def cut_repeats(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs without the text, with n_bytes (long), `removed` array<struct<begin,end>> and `kept` binary.

    removed has the maximal runs of bytes that a string of `SIZE` bytes covers which also starts elsewhere, in this row
    or another; kept is the rest, joined (a cut may fall inside a character, hence bytes).  Null text counts as empty.
    Repeated rows repeat each other's text.  Columns of these names are replaced.
    """
    found = written(find_repeats(docs, text), "removed")
    docs = docs.drop(*[c for c in ("n_bytes", "removed", "kept") if c != text])
    body = F.coalesce(F.col(text), F.lit("")).cast("binary")
    key = F.struct(*text_key(text))
    near = sieve(found, F.xxhash64("k1", "k2"))
    test = near(F.xxhash64(*text_key(text)))
    empty = F.expr("cast(array() as array<struct<begin:int,end:int>>)")
    start = F.struct(F.lit(0).alias("at"), F.lit("").cast("binary").alias("out"))
    piece = lambda s, to: F.concat(s["out"], F.call_function("substring", F.col("__raw"), s["at"] + 1, to - s["at"]))
    kept = F.aggregate("removed", start, lambda s, x: F.struct(x["end"].alias("at"), piece(s, x["begin"]).alias("out")), lambda s: piece(s, F.octet_length("__raw")))
    own = [c for c in docs.columns if c != text]
    some = docs.where(test).join(found.select(F.struct("k1", "k2").alias("__key"), "removed"), key == F.col("__key"), "left").select(*own, body.alias("__raw"), F.coalesce("removed", empty).alias("removed"))
    some = some.select(*own, F.octet_length("__raw").cast("long").alias("n_bytes"), "removed", kept.alias("kept"))
    rest = docs.where(~test).select(*own, F.octet_length(body).cast("long").alias("n_bytes"), empty.alias("removed"), body.alias("kept"))
    return some.unionByName(rest)
