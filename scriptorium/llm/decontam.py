"""Benchmark decontamination by winnowing.

Each text becomes a sequence of word hashes.  A k-gram of words is a fingerprint if it is the least of some window of
w k-grams, so any shared span of k + w - 1 words shares a fingerprint.  Fingerprints of documents and items meet in an
equi-join; each hit is extended word by word, and a run that reaches the target length counts.  With k + w - 1 equal to
the target, nothing of that length is missed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.common import ascii_set, merged, mix, offsets, owner, per_owner, runs, slices, slide, span_hashes, text_key, written

WORD = ascii_set("0123456789abcdefghijklmnopqrstuvwxyz") | (np.arange(256) >= 0x80)
FOLD = np.where((np.arange(256) >= 65) & (np.arange(256) <= 90), np.arange(256) + 32, np.arange(256)).astype(np.uint8)
TARGET, GRAM = 13, 5
#: Bits of the map of item fingerprints that goes to every task: 2^23 bits are 1 MB, however many items there are.
MAP_BITS = 23

FINGERPRINTS = "array<struct<class:int,h:long,pos:int,near:array<long>>>"


def word_hashes(t: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text of each word: A-Z in lower case, runs of digits, letters and everything beyond ASCII."""
    data = FOLD[t[0]]
    begin, end = runs(WORD[data], t[1])
    return span_hashes(data, begin, end) | np.uint64(1), owner(t[1], begin)


def winnow(h: np.ndarray, of: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Positions and hashes of the fingerprints for spans of `length` words, and how far to extend a hit."""
    k = min(GRAM, length)
    w = length - k + 1
    if len(h) < length:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), w - 1
    m = len(h) - k + 1
    gram = np.zeros(m, np.uint64)
    for j in range(k):
        gram = gram * np.uint64(0x2545F4914F6CDD1D) + h[j : j + m]
    gram = mix(gram) | np.uint64(1)
    least = slide(gram, w, np.minimum)
    least[of[: len(least)] != of[length - 1 : length - 1 + len(least)]] = 0  # spans two texts
    padded = np.concatenate((np.zeros(w - 1, np.uint64), least, np.zeros(w - 1, np.uint64)))
    at = np.flatnonzero(slide(padded, w, np.maximum) == gram)
    return at, gram[at], w - 1


def _near(h: np.ndarray, of: np.ndarray, at: np.ndarray, k: int, reach: int) -> np.ndarray:
    """Word hashes from reach before to reach after the k-gram at each position, 0 beyond the text."""
    i = at[:, None] + np.arange(-reach, k + reach)
    inside = (i >= 0) & (i < len(h))
    i = np.clip(i, 0, max(len(h) - 1, 0))
    return np.where(inside & (of[i] == of[at][:, None]), h[i], np.uint64(0))


def _lists(values: np.ndarray, counts: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))), pa.int32()), values)


def _rows(t: tuple[np.ndarray, np.ndarray], classes: list[int], marked: np.ndarray | None, of_class=None) -> tuple[np.ndarray, pa.Array]:
    """Words of each text, and its fingerprints as lists; of_class narrows a class to some texts."""
    h, of = word_hashes(t)
    n = len(t[1]) - 1
    n_words = per_owner(of, n)
    parts = []
    for c in classes:
        at, gram, reach = winnow(h, of, c)
        if marked is not None:
            bit = gram >> np.uint64(64 - MAP_BITS)
            some = (marked[(bit >> np.uint64(3)).astype(np.int64)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1 == 1
            at, gram = at[some], gram[some]
        if of_class is not None:
            some = of_class(n_words)[of[at]] == c
            at, gram = at[some], gram[some]
        first = np.searchsorted(of, np.arange(n))
        near = _near(h, of, at, min(GRAM, c), reach) if len(at) else np.zeros((0, 1), np.uint64)
        parts.append((of[at], np.full(len(at), c), gram, at - first[of[at]], near))
    of = np.concatenate([p[0] for p in parts]) if parts else np.zeros(0, np.int64)
    order = np.argsort(of, kind="stable")
    near = pa.concat_arrays([_lists(pa.array(p[4].ravel().view(np.int64)), np.full(len(p[0]), p[4].shape[1])) for p in parts]) if parts else pa.array([], pa.list_(pa.int64()))
    join = lambda j, kind: pa.array(np.concatenate([p[j] for p in parts]).view(kind) if parts else np.zeros(0, kind)).take(pa.array(order))
    items = pa.StructArray.from_arrays([join(1, np.int64).cast(pa.int32()), join(2, np.int64), join(3, np.int64).cast(pa.int32()), near.take(pa.array(order))], names=["class", "h", "pos", "near"])
    return n_words, _lists(items, per_owner(of, n))


def find_spans(docs: DataFrame, items: DataFrame, text: str = "text", doc_id: str = "doc_id", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per document: rid, the id as `doc_id`, `n_words`, `spans` array<struct<begin,end>> (word positions that lie
    in a run of `TARGET` words, or of a whole shorter item, shared with an item; sorted, merged) and `items` (ids as
    strings, sorted).

    Null and wordless texts have no words and no spans; so do wordless items.  Repeated ids are separate rows, apart by
    rid.  Repeated items count by id.
    """
    spark = docs.sparkSession
    of_class = lambda n: np.minimum(n, TARGET)

    def item_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                n_words, prints = _rows(offsets(part.column("text")), list(range(1, TARGET + 1)), None, of_class)
                yield pa.RecordBatch.from_arrays([part.column("item"), prints], names=["item", "prints"])

    given = items.select(F.col(item_id).cast("string").alias("item"), F.col(item_text).alias("text"))
    prints = written(given.mapInArrow(item_rows, f"item string, prints {FINGERPRINTS}").select("item", F.inline("prints")), "item-prints")
    # items that share a fingerprint and what stands around it are one row until a hit is extended
    kinds = written(prints.select("class", "h", F.col("near").alias("item_near")).distinct().withColumn("kind", F.monotonically_increasing_id()), "print-kinds")
    classes = sorted(r[0] for r in prints.select("class").distinct().collect())  # 13 at most
    marked = np.zeros(1 << MAP_BITS >> 3, np.uint8)
    bits = prints.select(F.shiftrightunsigned("h", 64 - MAP_BITS).alias("bit")).distinct()
    for row in bits.groupBy(F.shiftright("bit", 3).alias("byte")).agg(F.bit_or(F.expr("shiftleft(1, cast(bit & 7 as int))")).alias("v")).toLocalIterator():  # 2^20 rows at most
        marked[row["byte"]] = row["v"]
    bits_given = spark.sparkContext.broadcast(marked)

    def doc_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                n_words, found = _rows(offsets(part.column("text")), classes, bits_given.value)
                yield pa.RecordBatch.from_arrays([part.column("rid"), part.column("doc_id"), part.column("k1"), part.column("k2"), pa.array(n_words), found], names=["rid", "doc_id", "k1", "k2", "n_words", "prints"])

    read = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), *text_key(text))
    kind = docs.schema[doc_id].dataType.simpleString()
    seen = written(read.mapInArrow(doc_rows, f"rid long, doc_id {kind}, k1 long, k2 long, n_words long, prints {FINGERPRINTS}"), "doc-prints")

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            c_all, pos_all = batch.column("class").to_numpy(), batch.column("pos").to_numpy()
            for c in np.unique(c_all):
                rows = np.flatnonzero(c_all == c)
                k, reach = min(GRAM, c), c - min(GRAM, c)
                wide = k + 2 * reach
                a, b = (batch.column(x).take(pa.array(rows)).flatten().to_numpy().reshape(-1, wide) for x in ("near", "item_near"))
                same = (a == b) & (a != 0)
                left = np.logical_and.accumulate(same[:, :reach][:, ::-1], axis=1).sum(1) if reach else 0
                right = np.logical_and.accumulate(same[:, reach + k :], axis=1).sum(1) if reach else 0
                good = same[:, reach : reach + k].all(1) & (left + k + right >= c)
                begin = (pos_all[rows] - left)[good]
                out.append((rows[good], begin, (pos_all[rows] + k + right)[good]))
            rows, begin, end = (np.concatenate([x[i] for x in out]) if out else np.zeros(0, np.int64) for i in range(3))
            take = pa.array(rows.astype(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("rid").take(take), batch.column("kind").take(take), pa.array(begin, pa.int32()), pa.array(end, pa.int32())], names=["rid", "kind", "begin", "end"])

    hits = (
        seen.where(F.size("prints") > 0)
        .select("rid", F.inline("prints"))
        .join(kinds, ["class", "h"])
        .select("rid", "kind", "class", "pos", "near", "item_near")
        .mapInArrow(extend, "rid long, kind long, begin int, end int")
    )
    hits = written(hits, "hits")
    spans = merged(hits.groupBy("rid").agg(F.collect_set(F.struct("begin", "end")).alias("spans")), ["rid"], "spans")
    owners = prints.join(kinds, (prints["class"] == kinds["class"]) & (prints["h"] == kinds["h"]) & (prints["near"] == kinds["item_near"])).select("kind", "item").distinct()
    named = hits.select("rid", "kind").distinct().join(owners, "kind").groupBy("rid").agg(F.array_sort(F.collect_set("item")).alias("items"))
    return seen.drop("prints").join(spans, "rid", "left").join(named, "rid", "left")


def contamination(spans: DataFrame) -> DataFrame:
    """Adds n_hit, n_items, items_sha256 and contaminated to find_spans."""
    n_hit = F.coalesce(F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + (x["end"] - x["begin"])), F.lit(0).cast("long"))
    items = F.coalesce("items", F.expr("cast(array() as array<string>)"))
    return spans.select("*", n_hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"), F.sha2(F.concat_ws(",", items), 256).alias("items_sha256")).withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def decontaminate(docs: DataFrame, items: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """docs without contaminated ones, with their own columns.  The verdict depends on the text alone, so equal texts go or stay together."""
    bad = written(contamination(find_spans(docs, items, text, doc_id)).where("contaminated").select("k1", "k2").distinct(), "contaminated")
    k1, k2 = text_key(text)
    return docs.join(bad.select(F.struct("k1", "k2").alias("__key")), F.struct(k1, k2) == F.col("__key"), "left_anti")
