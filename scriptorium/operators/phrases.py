"""Which texts hold which phrases, in any case, whatever letters, spaces or signs they have: a positional q-gram index.

Whether a phrase stands anywhere at all needs no index (phrases_found).  For the rest, a phrase is cut into overlapping runs
of characters of one size: the largest of SIZES that it has room for.  Texts give up only the runs that some phrase has, so
the index is as large as what is asked, not as the corpus: a map of bits of fixed size tells which those may be.  A phrase
with a run that no text has is nowhere.  The others' candidates are the places of their rarest run, and the text around
such a place decides.  Runs are known by a number: of up to three characters that is their code, of more a hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from scriptorium.shared import kept

SIZES = (1, 2, 3, 4, 8)
EXACT = 3
#: Bits of the map, keys that go to every task rather than through a shuffle, and characters that are worked on at once.
BITS, FEW, SLICE = 22, 300_000, 1 << 20
_ODD = np.uint64(0x9E3779B97F4A7C15)
#: Sizes of phrases in bytes are looked up in these classes, in a map of 2^LEAST to 2^MAP bits, summed in blocks.
CLASSES, LEAST, MAP, BLOCK = (1, 8, 64, 512), 16, 26, 1 << 15
_BASE = 0xD1B54A32D192ED03
_BACK = pow(_BASE, -1, 1 << 64)
_MARKS = np.array([0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53], np.uint64)
_SLOT = np.uint64(46)
_VALUES = np.random.default_rng(7).integers(1, 1 << 64, 256, np.uint64)
_powers: dict[int, np.ndarray] = {}


def numbers(codes: np.ndarray, size: int) -> np.ndarray:
    """The number of each run of `size` code points: its code below 2^61 (shorter runs first), or a hash with 2^61 or 2^62 set."""
    n = max(0, len(codes) - size + 1)
    if size <= EXACT:
        h = np.zeros(n, np.uint64)
        for k in range(size):
            h = (h + np.uint64(k > 0)) * np.uint64(0x110000) + codes[k : k + n]
        return h
    h, width = codes.astype(np.uint64), 1
    while width < size:  # halves of a run make the run
        h = (h[:-width] * _ODD) ^ (h[width:] + (h[:-width] >> np.uint64(31)))
        width *= 2
    h = h[:n] * _ODD
    return (h >> np.uint64(4)) | np.uint64((1 << 61) if size == 4 else (1 << 62))


def _slices(texts: list[str | None]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of texts of about SLICE characters: first, last, code points, and where each text begins."""
    first, size = 0, 0
    for k, t in enumerate([*texts, None]):
        if k == len(texts) or (size and size + len(t or "") > SLICE):
            if k > first:
                some = [x or "" for x in texts[first:k]]
                at = np.concatenate(([0], np.cumsum([len(x) for x in some]))).astype(np.int64)
                yield first, k, np.frombuffer("".join(some).encode("utf-32-le", "surrogatepass"), np.uint32), at
            first, size = k, 0
        size += len(t or "")


def _places(codes: np.ndarray, at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers of the runs inside texts, their texts and their places in them."""
    text = np.repeat(np.arange(len(at) - 1), np.diff(at))
    place = np.arange(len(codes)) - at[:-1][text]
    whole = np.flatnonzero(place + size <= np.diff(at)[text])
    return numbers(codes, size)[whole], text[whole], place[whole]


def index_phrases(phrases: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, phrase, gram, place) of the distinct lower-case phrases; null and empty ones have no run."""
    p = phrases.select(*keys, F.lower("phrase").alias("phrase")).where(F.length("phrase") > 0).distinct()
    schema = T.StructType([*p.schema.fields, T.StructField("gram", T.LongType()), T.StructField("place", T.LongType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = np.array([len(t) for t in batch.column("phrase").to_pylist()])
            for low, high in zip(SIZES, (*SIZES[1:], 1 << 62), strict=True):
                part = batch.take(pa.array(np.flatnonzero((lengths >= low) & (lengths < high))))
                for i, _, codes, at in _slices(part.column("phrase").to_pylist()):
                    gram, text, place = _places(codes, at, low)
                    yield pa.RecordBatch.from_arrays([*part.take(pa.array(text + i)).columns, pa.array(gram.view(np.int64)), pa.array(place)], names=schema.names)

    return p.mapInArrow(work, schema)


def _bit_map(asked: DataFrame) -> np.ndarray:
    """Bits of the runs asked for; at most 2^(BITS - 6) rows are collected, whatever is asked."""
    bit = F.col("gram").bitwiseXOR(F.shiftright("gram", 31)).bitwiseAND(F.lit((1 << BITS) - 1))
    words = asked.select(bit.alias("bit")).groupBy(F.shiftright("bit", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("marks")).toArrow()
    out = np.zeros(1 << (BITS - 6), np.int64)
    out[words.column("word").to_numpy()] = words.column("marks").to_numpy()
    return np.unpackbits(out.view(np.uint8), bitorder="little").astype(bool)


def index_texts(texts: DataFrame, columns: list[str], asked: DataFrame, reach: int | None = None) -> DataFrame:
    """The runs of texts (columns, content) that are in asked (phrase, gram), and a few more.

    Without reach (columns, gram, n): how often each stands in a text.  With it (columns, gram, around): once for each
    place, with reach characters before and behind.
    """
    marks = texts.sparkSession.sparkContext.broadcast(_bit_map(asked))
    length = F.length("phrase")
    size_of = F.coalesce(*[F.when(length >= s, F.lit(s)) for s in reversed(SIZES)])
    sizes = [r[0] for r in asked.select(size_of.alias("s")).distinct().collect()]  # at most all SIZES
    rows = texts.select(*columns, F.lower("content").alias("content"))
    more = [T.StructField("n", T.LongType())] if reach is None else [T.StructField("around", T.StringType())]
    schema = T.StructType([*rows.schema.fields[:-1], T.StructField("gram", T.LongType()), *more])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = marks.value
        for batch in batches:
            whole = batch.column("content").to_pylist()
            for i, _, codes, at in _slices(whole):
                for size in sizes:
                    signed = numbers(codes, size).view(np.int64)
                    there = np.flatnonzero(bits[(signed ^ (signed >> 31)) & ((1 << BITS) - 1)])
                    text = np.searchsorted(at, there, side="right") - 1
                    inside = there + size <= at[text + 1]
                    there, text = there[inside], text[inside]
                    gram, place, text = signed[there], there - at[text], text + i
                    if reach is None:
                        order = np.lexsort((gram, text))
                        gram, text = gram[order], text[order]
                        new = np.flatnonzero((np.diff(gram, prepend=-1) != 0) | (np.diff(text, prepend=-1) != 0))
                        last = pa.array(np.diff(np.append(new, len(gram))))
                        gram, text = gram[new], text[new]
                    else:
                        last = pa.array([whole[t][max(0, p - reach) : p + reach] for t, p in zip(text.tolist(), place.tolist(), strict=True)], pa.string())
                    yield pa.RecordBatch.from_arrays([*batch.select(columns).take(pa.array(text)).columns, pa.array(gram), last], names=schema.names)

    return rows.mapInArrow(work, schema)


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(FEW + 1).count() <= FEW else df


def rarest(phrases: DataFrame, texts: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, phrase, gram, place, count): of each phrase whose runs all occur, the run with the fewest places."""
    indexed = kept(index_phrases(phrases, keys), "grams")
    counts = index_texts(texts, keys, indexed).groupBy(*keys, "gram").agg(F.sum("n").alias("count"))
    w = Window.partitionBy(*keys, "phrase")
    known = indexed.join(counts, [*keys, "gram"], "left").withColumn("all", F.count("count").over(w) == F.count(F.lit(1)).over(w)).where("all")
    return kept(known.withColumn("r", F.row_number().over(w.orderBy("count", "place"))).where("r = 1").drop("r", "all"), "rarest")


def _confirmed(chosen: DataFrame, texts: DataFrame, columns: list[str], keys: list[str]) -> DataFrame:
    """(columns, phrase) where the text around a place of the phrase's rarest run holds the phrase."""
    reach = chosen.agg(F.max(F.length("phrase"))).first()[0] or 0
    met = index_texts(texts, columns, chosen, reach).join(_small(chosen.select(*keys, "phrase", "gram")), [*keys, "gram"])
    return met.where(F.contains("around", "phrase")).select(*columns, "phrase")


def held_phrases(phrases: DataFrame, texts: DataFrame, ids: list[str], keys: list[str]) -> DataFrame:
    """(ids, held): the lower-case phrases that a text holds, in one row, as distinct structs (keys, phrase).

    phrases: (keys, phrase), texts: (ids, keys, content); a phrase meets the texts with its keys.  Rows with the same ids
    count as one text.  Null and empty phrases are held by none, null texts hold nothing.
    """
    met = _confirmed(rarest(phrases, texts, keys), texts, [*ids, *keys], keys)
    return met.groupBy(*ids).agg(F.collect_set(F.struct(*keys, "phrase")).alias("held"))


def _power(base: int, n: int) -> np.ndarray:
    if base not in _powers or len(_powers[base]) < n:
        steps = np.full(max(n, SLICE + 1), base, np.uint64)
        steps[0] = 1
        _powers[base] = np.multiply.accumulate(steps)
    return _powers[base][:n]


def _sums(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Running sums of bytes, and powers that take back their place: from both follows the print of any run of bytes."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_VALUES[data] * _power(_BASE, len(data)), out=out[1:])
    return out, _power(_BACK, len(data) + 1)


def _print(before: np.ndarray, behind: np.ndarray, back: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit number of runs of `size` bytes."""
    h = ((behind - before) * back + np.uint64(size)) * _ODD
    return (h ^ (h >> np.uint64(32))) * _ODD


def _spot(h: np.ndarray, mark: np.uint64, bits: int) -> np.ndarray:
    return ((h * mark) >> np.uint64(64 - bits)).view(np.int64)


def _byte_slices(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """UTF-8 bytes of texts, about SLICE at once, and where each text begins, one more for the end; null counts as empty."""
    texts = texts.fill_null("").cast(pa.large_string())
    _, at, data = texts.buffers()
    if not len(texts) or data is None:
        return
    at, data = np.frombuffer(at, np.int64, len(texts) + 1, texts.offset * 8), np.frombuffer(data, np.uint8)
    first = 0
    while first < len(texts):
        to = max(first + 1, int(np.searchsorted(at, at[first] + SLICE, side="right")) - 1)
        yield data[at[first] : at[to]], at[first : to + 1] - at[first]
        first = to


def _print_map(asked: DataFrame, bits: int) -> np.ndarray:
    """A packed map of 2^bits bits that marks the prints of phrases and of their beginnings."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data, at in _byte_slices(batch.column("phrase")):
                (sums, back), size = _sums(data), np.diff(at)
                for s in np.unique(size).tolist():
                    begin = at[:-1][size == s]
                    for n in {s, max(x for x in CLASSES if x <= s)}:
                        h = _print(sums[begin], sums[begin + n], back[begin], n)
                        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([_spot(h, m, bits) for m in _MARKS]) + 1)], names=["spot"])

    spots = asked.select("phrase").mapInArrow(work, "spot long")
    blocks = spots.groupBy(F.bitmap_bucket_number("spot").alias("block")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("spot")).alias("marks"))
    out = np.zeros((-(-(1 << bits) // BLOCK), BLOCK // 8), np.uint8)
    for r in blocks.collect():  # 4 KB each, and as many as the map has, whatever is asked
        out[r["block"] - 1] = np.frombuffer(r["marks"], np.uint8)
    return out.ravel()


def _marked(h: np.ndarray, marks: np.ndarray, bits: int, known: np.ndarray | None = None) -> np.ndarray:
    """Which prints have all their marks, less those that known has."""
    left = np.arange(len(h))
    for k, m in enumerate(_MARKS):
        spot = _spot(h, m, bits)
        good = np.flatnonzero(marks[spot])
        left, h = left[good], h[good]
        if k == 0 and known is not None:
            good = np.flatnonzero(known[(h >> _SLOT).view(np.int64)] != h)
            left, h = left[good], h[good]
    return left


def _said(data: np.ndarray, at: np.ndarray, sizes: list[int], marks: np.ndarray, bits: int, known: np.ndarray) -> Iterator[tuple[np.ndarray, int]]:
    """Where runs of bytes begin that are phrases, or now and then others with the same marks, and their size.

    A run is given once, and not again while known has its print.  Of the sizes of a class (but the first) only places are
    looked at where a beginning of a phrase stands that is as long as the class.
    """
    sums, back = _sums(data)
    every = lambda n: _print(sums[:-n], sums[n:], back[:-n], n) if len(data) >= n else np.zeros(0, np.uint64)
    for low, high in zip(CLASSES, (*CLASSES[1:], 1 << 62), strict=True):
        own = [s for s in sizes if low <= s < high]
        heads = _marked(every(low), marks, bits) if own and low > CLASSES[0] else None
        for s in own:
            begin = heads[heads + s <= len(data)] if heads is not None else None
            h = every(s) if begin is None else _print(sums[begin], sums[begin + s], back[begin], s)
            some = _marked(h, marks, bits, known)
            h, begin = h[some], some if begin is None else begin[some]
            whole = begin + s <= at[np.searchsorted(at, begin, side="right")]
            h, one = np.unique(h[whole], return_index=True)
            known[(h >> _SLOT).view(np.int64)] = h
            yield begin[whole][one], s


def phrases_found(phrases: DataFrame, texts: DataFrame) -> DataFrame:
    """(phrase) the distinct lower-case phrases that a text of texts (content) holds.

    Texts are read once, and the runs of every size that phrases have looked up by prints in a map of bits, which has
    room for what is asked; so the work grows with the texts and the number of sizes, not with how often a phrase stands
    there.  Runs that pass leave a task about once, and meet the phrases as they are.
    """
    asked = kept(phrases.select(F.lower("phrase").alias("phrase")).where(F.length("phrase") > 0).distinct(), "asked")
    sizes = [r[0] for r in asked.select(F.octet_length("phrase")).distinct().collect()]
    bits = min(MAP, max(LEAST, (asked.count() * 64).bit_length()))
    marks = texts.sparkSession.sparkContext.broadcast(_print_map(asked, bits))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, there = np.zeros(1 << 18, np.uint64), np.unpackbits(marks.value, bitorder="little").view(bool)
        for batch in batches:
            for data, at in _byte_slices(batch.column("content")):
                for begin, s in _said(data, at, sizes, there, bits, known):
                    if len(begin):
                        yield pa.RecordBatch.from_arrays([pa.array([data[i : i + s].tobytes() for i in begin.tolist()], pa.binary())], names=["said"])

    said = texts.select(F.lower("content").alias("content")).mapInArrow(work, "said binary").distinct()
    return asked.join(said, F.col("phrase").cast("binary") == F.col("said"), "left_semi")
