"""Line dedup: an exact set-similarity join of lines.

A line is the set of its words, ordered by rarity, rarest first.  Two lines of n and m words with a Jaccard similarity of
`SIMILARITY` (4/5) share a word among the first n - ceil(4n/5) + 1 of each, so lines meet on those words; length,
positional and 128-bit signature filters thin the candidates, and word sets are compared in full at the end.  A line
goes if an earlier line matches it.

Postings (a line under a word of its prefix) are by far the most rows, so they are made, sent and met in columns: a task
deals them to buckets by word and sends each bucket's share as a few byte strings.  Equal lines are one line.  A word with
many occurrences, or whose lines mostly match one another, leaves its rows for a join of tables instead, where lines first
meet the earliest line under each word, and only those that this leaves meet the rest; a large group of near-equal lines
thus never meets itself in full.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.common import ascii_set, fresh, grouped, mix, offsets, owner, runs, sieve, slices, span_hashes, written

#: Similarity 4/5, in whole numbers: 9 x overlap >= 4 x (n + m).
SIMILARITY = 0.8
SPACE = r"[ \t\x0B\f\r]+"
BLANKS = " \t\x0b\f\r"
_SPACE = ascii_set(" \t\n\x0b\x0c\r")
#: Cells (2^18) of the table of word counts from which rarity is read; a word's rarity is its cell's.  Blocks in which it is summed.
CELL_BITS, BLOCKS = 18, 64
#: Bits of a word's hash under its grade; a grade is half a power of two of the count.
WORD_BITS = 58
#: From this grade on (2^16 occurrences), and from so many lines on, a word's rows go to the join of tables.
HOT_GRADE, MANY = 32, 4096
#: So do those of a word with more matches a line.
CLOSE = 16
#: Postings a bucket, about, and pairs looked at in one go.
BUCKET, PAIRS = 1 << 18, 1 << 20

AT = ("doc", "bits", "no")
LINE = ("h1", "h2")


def _lines(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    """doc, bits (the text's hash), no (the line's place), line and its 128-bit hash h1, h2, for lines with a word."""
    body = F.coalesce(F.col(text), F.lit(""))
    some = docs.select(F.col(doc_id).alias("doc"), F.xxhash64(body).alias("bits"), F.posexplode(F.split(body, "\n")).alias("no", "line"))
    return some.where(F.btrim("line", F.lit(BLANKS)) != "").select(*AT, "line", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit("line"), "line").alias("h2"))


def _words(line: Column) -> Column:
    return F.array_distinct(F.transform(F.array_remove(F.split(line, SPACE), ""), lambda w: F.xxhash64(w)))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Word counts of a task by cell, in blocks."""
    counts = np.zeros(1 << CELL_BITS, np.int64)
    for batch in batches:
        for part in slices(batch, "text"):
            data, at = offsets(part.column("text"))
            h = span_hashes(data, *runs(~_SPACE[data], at))
            counts += np.bincount((h >> np.uint64(64 - CELL_BITS)).astype(np.int64), minlength=len(counts))
    width = len(counts) // BLOCKS
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(BLOCKS)), pa.ListArray.from_arrays(pa.array(np.arange(BLOCKS + 1) * width, pa.int32()), pa.array(counts))], names=["block", "counts"])


def _sum(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for block, rows in grouped(batches, "block"):
        counts = rows.column("counts").combine_chunks().flatten().to_numpy().reshape(rows.num_rows, -1).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([counts])], names=["block", "counts"])


def rarity(texts: DataFrame) -> tuple[np.ndarray, int]:
    """The table of grades, from the counts over all texts, and the words in all."""
    counts = texts.mapInArrow(_count, "block long, counts array<long>").repartition(BLOCKS, "block").sortWithinPartitions("block").mapInArrow(_sum, "block long, counts array<long>")
    table = np.zeros((BLOCKS, (1 << CELL_BITS) // BLOCKS), np.int64)
    for r in counts.collect():  # BLOCKS rows
        table[r["block"]] = r["counts"]
    table = table.ravel()
    return np.minimum(63, np.floor(2 * np.log2(np.maximum(table, 1)))).astype(np.uint8), int(table.sum())


def _by_line(number: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Order by number, then word.  One number of 64 bits has all of the former and the top of the latter; only if that
    ties for different words are both sorted in full."""
    width = max(1, int(number[-1]).bit_length()) if len(number) else 1
    key = number.astype(np.uint64) << np.uint64(64 - width) | word >> np.uint64(width)
    order = np.argsort(key)
    tied = np.flatnonzero(key[order[1:]] == key[order[:-1]])
    return order if (word[order[1:][tied]] == word[order[:-1][tied]]).all() else np.lexsort((word, number))


def postings(t: tuple[np.ndarray, np.ndarray], grades: np.ndarray) -> dict[str, np.ndarray]:
    """word, line (its hash), n (words), k (place), s0 and s1 (signature) of every different line and word of its prefix."""
    data, at = t
    begin, end = runs(~_SPACE[data], at)
    breaks = np.flatnonzero(data == 10)
    of_text = owner(at, begin)
    line = np.searchsorted(breaks, begin) + of_text
    h = span_hashes(data, begin, end)
    word = grades[(h >> np.uint64(64 - CELL_BITS)).astype(np.int64)].astype(np.uint64) << np.uint64(WORD_BITS) | h >> np.uint64(64 - WORD_BITS)
    first = np.flatnonzero(np.diff(line, prepend=-1)) if len(line) else np.zeros(0, np.int64)
    # equal lines once
    low = np.concatenate(([-1], breaks))[np.searchsorted(breaks, begin[first])] + 1
    low = np.maximum(low, at[of_text[first]])
    high = np.minimum(np.concatenate((breaks, [len(data)]))[np.searchsorted(breaks, begin[first])], at[of_text[first] + 1])
    raw = data.tobytes()
    ids = np.fromiter((xxhash.xxh64_intdigest(raw[i:j], 42) for i, j in zip(low.tolist(), high.tolist(), strict=True)), np.uint64, len(first))
    number = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(line))))
    one = np.zeros(len(first), bool)
    one[np.unique(ids, return_index=True)[1]] = True
    word, number = word[one[number]], number[one[number]]
    order = _by_line(number, word)
    word, number = word[order], number[order]
    new = np.ones(len(word), bool)
    new[1:] = (word[1:] != word[:-1]) | (number[1:] != number[:-1])
    word, number = word[new], number[new]
    start = np.flatnonzero(np.diff(number, prepend=-1)) if len(number) else np.zeros(0, np.int64)
    n = np.diff(np.append(start, len(number)))
    which = np.repeat(np.arange(len(start)), n)
    k = np.arange(len(word)) - start[which]
    bit = np.uint64(1) << (word & np.uint64(63))
    upper = (n[which] > 64) & (word >> np.uint64(6) & np.uint64(1) == 1)
    sign = [np.bitwise_xor.reduceat(np.where(upper == side, bit, np.uint64(0)), start) if len(start) else np.zeros(0, np.uint64) for side in (False, True)]
    some = k < (n - -(-4 * n // 5) + 1)[which]
    which = which[some]
    return {"word": word[some], "line": ids[number[start]][which], "n": n[which].astype(np.int32), "k": k[some].astype(np.int32), "s0": sign[0][which], "s1": sign[1][which]}


_KINDS = {"word": np.uint64, "line": np.uint64, "n": np.int32, "k": np.int32, "s0": np.uint64, "s1": np.uint64}


def matches(p: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Index pairs of postings that may match, and the index of those whose word goes to the join of tables.

    p is sorted by word, n and line.  Each posting meets the later ones of its word of up to 5/4 of its words.
    """
    size = len(p["word"])
    start = np.flatnonzero(np.diff(p["word"], prepend=~p["word"][:1])) if size else np.zeros(0, np.int64)
    lines = np.diff(np.append(start, size))
    group = np.repeat(np.arange(len(start)), lines)
    hot = (p["word"][start] >> np.uint64(WORD_BITS) >= HOT_GRADE) | (lines > MANY)
    key = group.astype(np.int64) << 32 | p["n"]
    reach = np.searchsorted(key, group.astype(np.int64) << 32 | p["n"] * 5 // 4, side="right")
    count = np.where(hot[group], 0, reach - np.arange(size) - 1)
    found, at = [np.zeros((2, 0), np.int64)], 0
    total = np.concatenate(([0], np.cumsum(count)))
    while at < size:
        to = max(at + 1, int(np.searchsorted(total, total[at] + PAIRS, side="right")) - 1)
        x = np.repeat(np.arange(at, to), count[at:to])
        y = x + 1 + np.arange(len(x)) - (total[x] - total[at])
        n, m = p["n"][x], p["n"][y]
        least = -(-4 * (n + m) // 9)
        good = np.minimum(n - p["k"][x], m - p["k"][y]) >= least
        good &= p["k"][x] + p["k"][y] <= n + m - 2 * least
        x, y, n, m, least = x[good], y[good], n[good], m[good], least[good]
        a, b = p["s0"][x] ^ p["s0"][y], p["s1"][x] ^ p["s1"][y]
        wide = (n > 64) & (m > 64)
        apart = np.where(wide, np.bitwise_count(a).astype(np.int32) + np.bitwise_count(b), np.bitwise_count(a ^ b))
        good = apart <= n + m - 2 * least
        found.append(np.stack((x[good], y[good])))
        at = to
    x, y = np.concatenate(found, axis=1)
    close = np.bincount(group[x], minlength=len(start)) > CLOSE * lines
    stay = ~close[group[x]]
    return x[stay], y[stay], np.flatnonzero((hot | close)[group])


def _dealt(grades, buckets: int):
    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                p = postings(offsets(part.column("text")), grades.value)
                # a hot word's rows only pass through, so any bucket will do
                hot = p["word"] >> np.uint64(WORD_BITS) >= HOT_GRADE
                to = mix(np.where(hot, p["line"] * np.uint64(0x9E3779B97F4A7C15) + p["word"], p["word"])) % np.uint64(buckets)
                order = np.argsort(to, kind="stable")
                to = to[order]
                cuts = np.concatenate(([0], np.flatnonzero(to[1:] != to[:-1]) + 1, [len(to)])) if len(to) else np.zeros(1, np.int64)
                cols = [pa.array(to[cuts[:-1]].astype(np.int64))]
                for name, kind in _KINDS.items():
                    raw = pa.py_buffer(p[name][order].astype(kind, copy=False).tobytes())
                    cols.append(pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer((cuts * np.dtype(kind).itemsize).astype(np.int32).tobytes()), raw]))
                yield pa.RecordBatch.from_arrays(cols, names=["bucket", *_KINDS])

    return deal


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with x and y: two lines that may match.  Rows without y: a posting for the join of tables."""
    names = ["x", "y", "token", "n", "k", "s0", "s1"]
    for _, rows in grouped(batches, "bucket"):
        p = {name: np.concatenate([np.frombuffer(b.as_buffer(), kind) for b in rows.column(name)]) for name, kind in _KINDS.items()}
        order = np.lexsort((p["line"], p["n"], p["word"]))
        p = {name: v[order] for name, v in p.items()}
        new = np.ones(len(order), bool)
        new[1:] = (p["word"][1:] != p["word"][:-1]) | (p["line"][1:] != p["line"][:-1])
        p = {name: v[new] for name, v in p.items()}
        x, y, rest = matches(p)
        line = p["line"].view(np.int64)
        pair = np.unique(np.stack((line[x], line[y])), axis=1) if len(x) else np.zeros((2, 0), np.int64)
        none = lambda kind: pa.nulls(pair.shape[1], kind)
        yield pa.RecordBatch.from_arrays([pa.array(pair[0]), pa.array(pair[1]), none(pa.int64()), none(pa.int32()), none(pa.int32()), none(pa.int64()), none(pa.int64())], names=names)
        if len(rest):
            yield pa.RecordBatch.from_arrays([pa.array(line[rest]), pa.nulls(len(rest), pa.int64()), pa.array(p["word"][rest].view(np.int64)), pa.array(p["n"][rest]), pa.array(p["k"][rest]), pa.array(p["s0"][rest].view(np.int64)), pa.array(p["s1"][rest].view(np.int64))], names=names)


def _at(x: str) -> Column:
    return F.struct(*[F.col(f"{x}.{c}").alias(c) for c in AT])


def _may_match(x: str, y: str) -> Column:
    """Order, length, positional and signature filters; x is the earlier line."""
    least = f"cast(ceil(4 * ({x}.n + {y}.n) / 9) as int)"
    return F.expr(
        f"struct({x}.doc, {x}.bits, {x}.no) < struct({y}.doc, {y}.bits, {y}.no)"
        f" and 5 * {x}.n >= 4 * {y}.n and 5 * {y}.n >= 4 * {x}.n"
        f" and least({x}.n - {x}.k, {y}.n - {y}.k) >= {least} and {x}.k + {y}.k <= {x}.n + {y}.n - 2 * {least}"
        f" and if({x}.n > 64 and {y}.n > 64, bit_count({x}.s0 ^ {y}.s0) + bit_count({x}.s1 ^ {y}.s1), bit_count({x}.s0 ^ {x}.s1 ^ {y}.s0 ^ {y}.s1)) <= {x}.n + {y}.n - 2 * {least}"
    )


def _verified(pairs: DataFrame, known: DataFrame) -> DataFrame:
    """Of pairs (x, y) of places, the lines y whose words match x's."""
    side = lambda name: known.select(F.struct(*AT).alias(name), F.col("words").alias(f"{name}_words"), *([] if name == "x" else LINE))
    both = pairs.join(side("y"), "y").join(side("x"), "x")
    return both.where(9 * F.size(F.array_intersect("x_words", "y_words")) >= 4 * (F.size("x_words") + F.size("y_words"))).select(*LINE).distinct()


def _firsts(docs: DataFrame, text: str, doc_id: str) -> tuple[DataFrame, DataFrame]:
    """All lines, and the different ones with their first place and their rows."""
    every = written(_lines(docs, text, doc_id).drop("line"), "lines")
    firsts = every.groupBy(*LINE).agg(F.min(F.struct(*AT)).alias("at"), F.count(F.lit(1)).alias("copies"))
    return every, written(firsts.select(*LINE, "at.*", "copies"), "lines-first")


def _repeated(docs: DataFrame, firsts: DataFrame, text: str, doc_id: str) -> DataFrame:
    """h1, h2 of the lines that an earlier, different line matches."""
    texts = docs.select(F.coalesce(F.col(text), F.lit("")).alias("text"))
    grades, total = rarity(texts)
    buckets = max(1, -(-total // (4 * BUCKET)))
    dealt = texts.mapInArrow(_dealt(docs.sparkSession.sparkContext.broadcast(grades), buckets), "bucket long, word binary, line binary, n binary, k binary, s0 binary, s1 binary")
    found = dealt.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(_meet, "x long, y long, token long, n int, k int, s0 long, s1 long")
    found = written(found, "line-candidates")
    # the lines among them, with their words: read again at their first place
    ends = written(found.select(F.explode(F.array("x", "y")).alias("h1")).where("h1 is not null").distinct(), "line-ends")
    near = sieve(ends, F.xxhash64("h1"))
    first = firsts.where(near(F.xxhash64("h1"))).join(ends, "h1", "left_semi").select(*LINE, F.struct(*AT).alias("first"))
    known = _lines(docs, text, doc_id).where(near(F.xxhash64("h1"))).join(first, list(LINE)).where(F.struct(*AT) == F.col("first"))
    known = written(known.dropDuplicates(list(AT)).select(*AT, *LINE, _words(F.col("line")).alias("words")), "line-words")
    at = known.select("h1", F.struct(*AT).alias("at"))
    pairs = found.where("y is not null").select("x", "y").distinct().join(at.select(F.col("h1").alias("x"), F.col("at").alias("a")), "x").join(at.select(F.col("h1").alias("y"), F.col("at").alias("b")), "y")
    gone = written(_verified(pairs.select(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y")), known), "lines-gone")
    rows = found.where("y is null")
    if not rows.limit(1).count():
        return gone
    rows = written(rows.select(F.col("x").alias("h1"), "token", "n", "k", "s0", "s1").join(known.drop("words"), "h1"), "line-rows")
    heads = rows.groupBy("token").agg(F.min(F.struct(*AT, "n", "k", "s0", "s1")).alias("x"))
    heads = written(heads.select("token", "x.*"), "line-heads")
    led = rows.alias("y").join(heads.alias("x"), (F.col("x.token") == F.col("y.token")) & _may_match("x", "y"))
    gone = written(gone.unionByName(_verified(led.select(_at("x").alias("x"), _at("y").alias("y")).distinct(), known)).distinct(), "lines-gone")
    left = rows.join(gone, list(LINE), "left_anti")
    rest = left.alias("y").join(rows.alias("x"), (F.col("x.token") == F.col("y.token")) & _may_match("x", "y"))
    return gone.unionByName(_verified(rest.select(_at("x").alias("x"), _at("y").alias("y")).distinct(), known)).distinct()


def dedup_lines(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """docs with `text` cut to the lines that no earlier line equals or matches, and n_lines, n_removed (long).

    Earlier: by doc_id (null first), then by the text's hash, then by line.  Lines without a word stay where they are.
    Null text stays null, with no lines.  Rows of the same doc_id and text are one document and share its outcome.
    Columns named n_lines or n_removed are replaced.
    """
    docs = docs.drop("n_lines", "n_removed")
    every, firsts = _firsts(docs, text, doc_id)
    gone = _repeated(docs, firsts, text, doc_id)
    fate = firsts.join(gone.withColumn("gone", F.lit(True)), list(LINE), "left").where("gone or copies > 1")
    fate = written(fate.select(*LINE, F.struct(*AT).alias("first"), F.coalesce("gone", F.lit(False)).alias("gone")), "lines-fate")
    removed = every.join(fate, list(LINE)).where(F.col("gone") | (F.struct(*AT) != F.col("first")))
    lost, key, stay = fresh(docs, "__lost"), fresh(docs, "__key"), fresh(docs, "__stay")
    cut = written(removed.groupBy("doc", "bits").agg(F.collect_set("no").alias(lost)).select(F.struct("doc", "bits").alias(key), lost), "lines-lost")
    # only documents that lose a line meet their list
    own = F.struct(F.col(doc_id).alias("doc"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("bits"))
    near = sieve(cut, F.xxhash64(key))
    some = docs.where(near(F.xxhash64(own))).join(cut, own == F.col(key), "left").drop(key)
    out = some.unionByName(docs.where(~near(F.xxhash64(own))).withColumn(lost, F.lit(None).cast("array<int>")))
    parts = F.split(F.col(text), "\n")
    kept = F.filter(parts, lambda line, i: ~F.array_contains(lost, i))
    changed = F.col(lost).isNotNull()
    zero = F.lit(0).cast("long")
    n_lines = F.when(F.col(text).isNull(), zero).otherwise(F.size(parts).cast("long")).alias("n_lines")
    n_removed = F.when(changed, F.size(lost).cast("long")).otherwise(zero).alias("n_removed")
    cut_text = F.when(changed, F.array_join(kept, "\n")).otherwise(F.col(text)).alias(text)
    return out.select(*[cut_text if c == text else F.col(f"`{c}`") for c in docs.columns], n_lines, n_removed)
