"""N-gram Jaccard join of documents by chosen paths.

A text is the set of its five-word shingles, sketched by minhashes.  In each run, texts are split into buckets by a
sampled minhash (a token they share if the values agree); small buckets are compared in full, large ones are split
again on further samples.  A pair at the threshold stays together with at least the chance of its similarity in each
run, so the number of runs follows from the target recall.  Buckets yield a coarse graph that holds the true links;
its components are then joined exactly, on whole shingle sets, in blocks of bounded size, which counts every link
without writing pairs out.  Equal texts are one text from the start.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.common import grouped, mix, offsets, owner, per_owner, runs, sieve, slices, span_hashes, text_key, written
from scriptorium.llm.components import components
from scriptorium.llm.quality import SPACE

SHINGLE, SIMILARITY, RECALL = 5, 0.8, 0.9999
#: Minhashes of a sketch, of 16 bits each.
HASHES = 128
#: Sketches within a bucket link two texts from this estimate on: five standard deviations under the threshold.
COARSE = 0.62
#: A bucket of at most so many texts is compared in full.
BUCKET = 200
#: A larger one is split on so many further samples, so many times.  What is then still large agrees on all of them: most
#: of it is close to one text, and the rest is compared in full in blocks.
SPLITS, DEPTH = 2, 2
#: Texts a block of the exact join.
BLOCK = 256
CHUNK = 8192

_seeds = mix(np.arange(1, 2 * HASHES + 1, dtype=np.uint64))


def shingles(t: tuple[np.ndarray, np.ndarray], size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text of each shingle; a text of fewer words, but not none, has one, of all its words."""
    begin, end = runs(~SPACE[t[0]], t[1])
    of = owner(t[1], begin)
    h = span_hashes(t[0], begin, end)
    n = len(t[1]) - 1
    counts = per_owner(of, n)
    first = np.concatenate(([0], np.cumsum(counts)))[:-1]
    short = np.flatnonzero((counts > 0) & (counts < size))
    m = max(len(h) - size + 1, 0)
    gram = np.zeros(m, np.uint64)
    for k in range(size):
        gram = gram * np.uint64(0x2545F4914F6CDD1D) + h[k : k + m]
    whole = np.flatnonzero(of[:m] == of[size - 1 :]) if m else np.zeros(0, np.int64)
    few = [(mix(h[first[i] : first[i] + counts[i]] * _seeds[: counts[i]]).sum(dtype=np.uint64)) for i in short]
    h, of = np.concatenate((gram[whole], np.array(few, np.uint64))), np.concatenate((of[whole], short))
    order = np.argsort(of, kind="stable")
    return mix(h[order]), of[order]


def sketch(t: tuple[np.ndarray, np.ndarray], keys: list[int]) -> list[pa.Array]:
    """Of each text its minhashes (16 bits each) and those numbered in keys whole, null without words."""
    h, of = shingles(t)
    n = len(t[1]) - 1
    some = np.flatnonzero(per_owner(of, n))
    out, whole = np.zeros((len(some), HASHES), np.int16), np.zeros((len(some), len(keys)), np.int64)
    if len(some):
        starts = np.searchsorted(of, some)
        for j in range(HASHES):
            least = np.minimum.reduceat((h ^ _seeds[j]) * (_seeds[HASHES + j] | np.uint64(1)), starts)
            out[:, j] = (least >> np.uint64(48)).astype(np.uint16).view(np.int16)
            for i in np.flatnonzero(np.array(keys) == j):
                whole[:, i] = least.view(np.int64)
    mask = np.ones(n, bool)
    mask[some] = False
    ends = lambda width: pa.array(np.concatenate(([0], np.cumsum(~mask) * width)).astype(np.int32))
    return [pa.ListArray.from_arrays(ends(x.shape[1]), pa.array(x.ravel()), mask=pa.array(mask)) for x in (out, whole)]


def _roots(linked: np.ndarray) -> np.ndarray:
    """Least index that each row of a symmetric matrix of links reaches."""
    n = len(linked)
    root = np.arange(n)
    while True:
        least = np.minimum(root, np.where(linked, root[None, :], n).min(axis=1, initial=n))
        least = least[least]
        if (least == root).all():
            return root
        root = least


def _bucket_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links that hold each bucket's similar texts together, at most one a text."""
    for _, members in grouped(batches, "bucket"):
        ids = members.column("tid").to_numpy()
        marks = members.column("sig").combine_chunks().flatten().to_numpy().reshape(-1, HASHES)
        same = np.stack([(marks == m).sum(axis=1) for m in marks])
        root = _roots(same >= COARSE * HASHES)
        moved = np.flatnonzero(root != np.arange(len(root)))
        if len(moved):
            yield pa.RecordBatch.from_arrays([pa.array(ids[root[moved]]), pa.array(ids[moved])], names=["a", "b"])


def draws(similarity: float, recall: float) -> list[list[int]]:
    """The samples of each run, first those that split all texts, then those of each further split: every run has its own order."""
    n_runs = max(1, math.ceil(math.log(1 - recall) / math.log(1 - similarity)))
    first = [1 + (r % 4 == 3) for r in range(n_runs)]  # 1 / similarity samples a node on average
    every = np.argsort(mix(np.arange(HASHES, dtype=np.uint64) + np.uint64(11))).tolist()
    out = []
    for k in first:
        out.append(every[: k + SPLITS * DEPTH])
        every = every[k + SPLITS * DEPTH :] + every[: k + SPLITS * DEPTH]
    return out


def coarse_links(texts: DataFrame, similarity: float = SIMILARITY, recall: float = RECALL) -> DataFrame:
    """texts (tid, sig, keys) -> links (a, b) whose components hold every pair of the similarity, at the recall."""
    plan = draws(similarity, recall)
    firsts = [(r, i) for r, run in enumerate(plan) for i in range(len(run) - SPLITS * DEPTH)]
    at = F.array(*[F.struct(F.lit(r).alias("run"), F.xxhash64(F.lit(r), F.lit(i), F.col("keys")[j]).alias("key")) for j, (r, i) in enumerate(firsts)])
    rows = texts.where("sig is not null").select("tid", F.inline(at))
    small, left = None, None
    for depth in range(DEPTH + 1):
        rows = written(rows, "splits")
        sizes = rows.groupBy("run", "key").agg(F.count(F.lit(1)).alias("n"), F.min("tid").alias("head")).where("n > 1")
        sized = written(rows.join(sizes, ["run", "key"]), "buckets")
        here = sized.where(F.col("n") <= BUCKET).groupBy("run", "key").agg(F.sort_array(F.collect_set("tid")).alias("members")).select("members").where(F.size("members") > 1).distinct()
        small = here if small is None else small.unionByName(here)
        left = sized.where(F.col("n") > BUCKET).select("run", "key", "tid", "head", "n")
        if depth < DEPTH:
            more = F.element_at(F.array(*[F.array(*[F.lit(c) for c in run[len(run) - SPLITS * DEPTH :][SPLITS * depth : SPLITS * (depth + 1)]]) for run in plan]), F.col("run") + 1)
            rows = left.join(texts.select("tid", "sig"), "tid").select("tid", "run", F.explode(F.transform(more, lambda c: F.xxhash64("key", c, F.get("sig", c)))).alias("key"))
    small = small.distinct().select(F.xxhash64("members", F.size("members")).alias("bucket"), F.explode("members").alias("tid"))
    # what is still large: close to its first text, or compared in blocks with the others that aren't
    sig = texts.select("tid", "sig")
    # (buckets of one group share their first text, so a text meets it once)
    ends = left.select("tid", "head").distinct()
    led = ends.join(sig, "tid").join(sig.select(F.col("tid").alias("head"), F.col("sig").alias("head_sig")), "head")
    agree = F.aggregate(F.zip_with("sig", "head_sig", lambda a, b: (a == b).cast("int")), F.lit(0), lambda s, v: s + v)
    led = written(led.select("tid", "head", (agree >= F.lit(COARSE * HASHES)).alias("close")), "led")
    links = led.where("close and tid <> head").select(F.col("head").alias("a"), F.col("tid").alias("b"))
    apart = left.join(led.where("not close").select("tid", "head"), ["tid", "head"], "left_semi").select("run", "key", "tid")
    if apart.limit(1).count():
        blocks = apart.groupBy("run", "key").agg(F.ceil(2 * F.count(F.lit(1)) / F.lit(BUCKET)).cast("int").alias("blocks"))
        apart = written(apart.join(blocks, ["run", "key"]).withColumn("block", F.pmod(F.xxhash64("tid"), "blocks").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))), "apart")
        pairs = apart.select(F.xxhash64("run", "key", F.least("block", "other"), F.greatest("block", "other")).alias("bucket"), "tid")
        small = small.unionByName(pairs)
    full = small.join(sig, "tid").select("bucket", "tid", "sig").repartition("bucket").sortWithinPartitions("bucket")
    return full.mapInArrow(_bucket_links, "a long, b long").unionByName(links)


def _exact(similarity: float):
    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, members in grouped(batches, "group"):
            # the join with the texts may repeat a row whose id and text repeat
            ids, keep = np.unique(members.column("tid").to_numpy(), return_index=True)
            members = members.take(pa.array(keep))
            copies, side = (members.column(k).to_numpy() for k in ("copies", "block"))
            sets = members.column("grams").combine_chunks()
            size = np.asarray(sets.value_lengths())
            _, word = np.unique(sets.flatten().to_numpy(), return_inverse=True)
            text = np.repeat(np.arange(len(ids)), size)
            order = np.argsort(word, kind="stable")
            word, text = word[order], text[order]
            common = np.zeros((len(ids), len(ids)), np.float32)
            for k in range(0, int(word[-1]) + 1 if len(word) else 0, CHUNK):
                i, j = np.searchsorted(word, (k, k + CHUNK))
                part = np.zeros((len(ids), min(CHUNK, int(word[-1]) + 1 - k)), np.float32)
                part[text[i:j], word[i:j] - k] = 1
                common += part @ part.T
            linked = common * (1 + similarity) >= similarity * (size[:, None] + size[None, :]) - 1e-3  # |x & y| >= s |x | y|
            np.fill_diagonal(linked, False)
            if not members.column("within")[0].as_py():
                linked &= side[:, None] != side[None, :]
            root = _roots(linked)
            some = np.flatnonzero(linked.any(axis=1))
            if len(some):
                yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in (ids[some], ids[root[some]], linked[some].sum(axis=1), (linked[some] * copies[None, :]).sum(axis=1))], names=["tid", "root", "texts", "docs"])

    return join


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            h, of = shingles(offsets(part.column("text")))
            order = np.lexsort((h, of))
            h, of = h[order], of[order]
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (of[1:] != of[:-1])
            counts = per_owner(of[new], part.num_rows)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))), pa.int32()), pa.array(h[new].view(np.int64)))
            yield pa.RecordBatch.from_arrays([part.column("tid"), part.column("comp"), part.column("copies"), part.column("m"), lists], names=["tid", "comp", "copies", "m", "grams"])


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", similarity: float = SIMILARITY, recall: float = RECALL) -> DataFrame:
    """One row per row of docs: doc_id, k1, k2 (the text's key), class_id, leads, n_links, n_text_links.

    class_id is the least doc_id (null only if all are) of the connected component of texts whose shingle sets have the Jaccard similarity;
    n_links counts other rows with an equal or linked text, n_text_links the different texts linked; leads is
    true for the class's first row by doc_id and key, and null for a text without words.  A text without words
    (null too) links to nothing: its row is its own class.  Repeated ids and rows are separate rows.
    """
    read = docs.select(F.col(doc_id).alias("doc_id"), *text_key(text), F.col(text).alias("text"))
    keys = [c for run in draws(similarity, recall) for c in run[: len(run) - SPLITS * DEPTH]]
    kind = docs.schema[doc_id].dataType.simpleString()

    def sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("k1"), part.column("k2"), *sketch(offsets(part.column("text")), keys)], names=["doc_id", "k1", "k2", "sig", "keys"])

    seen = read.mapInArrow(sketches, f"doc_id {kind}, k1 long, k2 long, sig array<short>, keys array<long>")
    texts = seen.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("head"), F.first("sig").alias("sig"), F.first("keys").alias("keys"))
    texts = written(texts.withColumn("tid", F.monotonically_increasing_id()), "texts")
    coarse = components(coarse_links(texts.select("tid", "sig", "keys"), similarity, recall))
    sizes = coarse.groupBy("root").agg(F.count(F.lit(1)).alias("m"))
    some = written(coarse.join(sizes, "root").select(F.col("node").alias("tid"), F.col("root").alias("comp"), "m").join(texts.drop("sig", "keys"), "tid"), "coarse")
    hashed = F.xxhash64("k1", "k2", "head")
    near = sieve(some, hashed)
    heads = read.where(near(F.xxhash64("k1", "k2", "doc_id"))).select(F.struct("k1", "k2", "doc_id").alias("at"), "text")
    some = some.select(F.struct("k1", "k2", F.col("head").alias("doc_id")).alias("at"), "tid", "comp", "copies", "m")
    grams = heads.join(some, "at").select("tid", "comp", "copies", "m", "text").mapInArrow(_grams, "tid long, comp long, copies long, m long, grams array<long>")
    blocks = F.ceil(F.col("m") / BLOCK).cast("int")
    placed = grams.withColumn("block", F.pmod(F.xxhash64("tid"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    lo, hi = F.least("block", "other"), F.greatest("block", "other")
    placed = placed.select(F.xxhash64("comp", lo, hi).alias("group"), (lo == hi).alias("within"), "tid", "copies", "block", "grams")
    found = written(placed.repartition("group").sortWithinPartitions("group").mapInArrow(_exact(similarity), "tid long, root long, texts long, docs long"), "found")
    classes = components(found.select(F.col("root").alias("a"), F.col("tid").alias("b"))).select(F.col("node").alias("tid"), "root")
    counts = found.groupBy("tid").agg(F.sum("texts").alias("texts"), F.sum("docs").alias("docs"))
    known = texts.select("k1", "k2", "tid", "copies", "head", F.col("sig").isNotNull().alias("worded")).join(classes, "tid", "left").join(counts, "tid", "left").withColumn("root", F.coalesce("root", "tid"))
    least = known.groupBy("root").agg(F.min(F.struct(F.col("head").isNull().alias("none"), "head", "k1", "k2")).alias("least"))
    known = known.join(least, "root").select(F.struct("k1", "k2").alias("at"), "copies", "worded", "texts", "docs", "least")
    rows = read.select("doc_id", "k1", "k2", F.struct("k1", "k2").alias("at")).join(known, "at")
    zero = F.lit(0).cast("long")
    return rows.select(
        "doc_id",
        "k1",
        "k2",
        F.when(F.col("worded"), F.col("least.head")).otherwise(F.col("doc_id")).alias("class_id"),
        F.when(F.col("worded"), F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "k1", "k2").eqNullSafe(F.col("least"))).alias("leads"),
        F.when(F.col("worded"), F.col("copies") - 1 + F.coalesce("docs", zero)).otherwise(zero).alias("n_links"),
        F.coalesce("texts", zero).alias("n_text_links"),
    )


def keep_one(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """docs with the leading document of each class, once; documents without words all stay."""
    found = written(near_duplicates(docs, text, doc_id).select(F.struct("doc_id", "k1", "k2").alias("__at"), F.coalesce("leads", F.lit(True)).alias("stays"), F.coalesce("leads", F.lit(False)).alias("leads")), "classes")
    at = F.struct(F.col(doc_id).alias("doc_id"), *text_key(text))
    left = docs.join(found.where(~F.col("stays")).select("__at").distinct(), at == F.col("__at"), "left_anti")
    again = found.where("leads").groupBy("__at").count().where("count > 1").select("__at")
    if not again.limit(1).count():
        return left
    again = written(again, "repeated")
    return left.join(again, at == F.col("__at"), "left_anti").unionByName(left.join(again, at == F.col("__at"), "left_semi").dropDuplicates([doc_id, text]))
