"""Lines to sections and chunks: offsets, fonts, headings, page spans, and greedy packing."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scriptorium.functions.text import CATEGORY_CELL, ENUMERATOR
from scriptorium.shared import gathered, kept

# Characters a chunk aims at, may reach, and repeats from the one before.
TARGET, CAP, OVERLAP = 1200, 1800, 200
PART_PAGES = 120
SENTENCE_END = (".", "?", "!", ":", ";")


def offsets(lines: DataFrame) -> DataFrame:
    """lines (version_id, page, line_no, text) with char_start and char_end: one character between lines, two between pages.

    Windows are a version's pages, and a page's lines.
    """
    size = F.length("text").cast("long")
    w = Window.partitionBy("version_id", "page").orderBy("line_no")
    inside = F.coalesce(F.sum(size + 1).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    pages = lines.groupBy("version_id", "page").agg((F.sum(size + 1) - 1).alias("size"))
    before = F.coalesce(F.sum(F.col("size") + 2).over(Window.partitionBy("version_id").orderBy("page").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    pages = pages.withColumn("page_start", before).drop("size")
    out = lines.withColumn("__in", inside).join(pages, ["version_id", "page"])
    return out.withColumn("char_start", F.col("page_start") + F.col("__in")).withColumn("char_end", F.col("char_start") + size).drop("__in", "page_start")


def page_spans(lines: DataFrame) -> DataFrame:
    """(version_id, page, char_start, char_end) of lines with offsets."""
    return lines.groupBy("version_id", "page").agg(F.min("char_start").alias("char_start"), F.max("char_end").alias("char_end"))


def pages_for_spans(spans: DataFrame, pages: DataFrame) -> DataFrame:
    """spans (version_id, span_id, begin, end) with page_start and page_end: the page in force at the first and at the last
    character.  What lies between two pages belongs to the earlier one."""
    starts = pages.select("version_id", F.lit(None).cast(spans.schema["span_id"].dataType).alias("span_id"), F.col("char_start").alias("x"), F.lit(0).alias("kind"), "page")
    point = F.inline(F.array(F.struct(F.col("begin").cast("long").alias("x"), F.lit(1).alias("kind")), F.struct((F.col("end") - 1).cast("long").alias("x"), F.lit(2).alias("kind"))))
    points = spans.select("version_id", "span_id", point).withColumn("page", F.lit(None).cast(pages.schema["page"].dataType))
    # a version's starts and points in order: the page in force is the last one begun (of equal starts the later page)
    w = Window.partitionBy("version_id").orderBy("x", "kind", "page").rowsBetween(Window.unboundedPreceding, 0)
    at = starts.unionByName(points).withColumn("page", F.last("page", ignorenulls=True).over(w)).where("kind > 0")
    found = at.groupBy("version_id", "span_id").agg(F.max(F.when(F.col("kind") == 1, F.col("page"))).alias("page_start"), F.max(F.when(F.col("kind") == 2, F.col("page"))).alias("page_end"))
    return spans.join(found, ["version_id", "span_id"], "left")


def body_size(lines: DataFrame) -> DataFrame:
    """The font size of most characters of each version, the smaller of equals."""
    n = lines.groupBy("version_id", "font_size").agg(F.sum(F.length("text")).alias("n"))
    return n.groupBy("version_id").agg(F.max_by("font_size", F.struct("n", -F.col("font_size"))).alias("body_size"))


def page_flags(chars: DataFrame) -> DataFrame:
    """chars (version_id, page, n, n_sideways) with rotated (50 characters or more, over half sideways) and empty."""
    p = chars.groupBy("version_id", "page").agg(F.sum("n").alias("n"), F.sum("n_sideways").alias("sideways"))
    return p.select("version_id", "page", ((F.col("n") >= 50) & (2 * F.col("sideways") > F.col("n"))).alias("rotated"), (F.col("n") == 0).alias("empty"))


def rejected(chars: DataFrame) -> DataFrame:
    """(version_id, pages, reason): no_text where no page of the version has a character, else null."""
    p = chars.groupBy("version_id").agg(F.count_distinct("page").alias("pages"), F.sum("n").alias("n"))
    return p.select("version_id", "pages", F.when(F.coalesce("n", F.lit(0)) == 0, "no_text").alias("reason"))


def damaged_pages(lines: DataFrame, rotated: DataFrame, bad) -> DataFrame:
    """Pages with an unreadable line or set sideways, per version, sorted."""
    a = lines.where(bad(F.col("text"))).groupBy("version_id").agg(F.collect_set("page").alias("a"))
    b = rotated.where("rotated").groupBy("version_id").agg(F.collect_set("page").alias("b"))
    none = F.expr("cast(array() as array<bigint>)")
    return a.join(b, "version_id", "full_outer").select("version_id", F.array_sort(F.array_union(F.coalesce("a", none), F.coalesce("b", none))).alias("pages"))


def sections(lines: DataFrame) -> DataFrame:
    """lines with `section`: the last heading at or above each line."""
    w = Window.partitionBy("version_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn("section", F.last("heading", ignorenulls=True).over(w))


CHUNK = "ordinal long, char_start long, char_end long, content string, section string, n_lines long"


class _Packer:
    """Greedy, in order: a heading or a full chunk closes what is open, whose tail of whole lines opens the next.

    What is held is the open chunk: at most CAP characters and a line.
    """

    def __init__(self, version: object):
        self.version, self.ordinal, self.section = version, 0, None
        self.open: list[tuple[str, int, int]] = []
        self.size = 0

    def close(self) -> tuple:
        out = (self.version, self.ordinal, self.open[0][1], self.open[-1][2], "\n".join(x[0] for x in self.open), self.section, len(self.open))
        self.ordinal += 1
        return out

    def add(self, text: str, begin: int, end: int, heading: str | None) -> tuple | None:
        """The chunk that this line closes, if it closes one."""
        done = None
        if heading is not None and self.open:
            done, self.open = self.close(), []
        elif self.open:
            span = end - self.open[0][1]
            if span > TARGET and (span > CAP or self.open[-1][0].rstrip().endswith(SENTENCE_END)):
                done, last, tail = self.close(), self.open[-1][2], []
                for old in reversed(self.open[1:]):
                    if tail and last - old[1] > OVERLAP:
                        break
                    tail.append(old)
                tail.reverse()
                self.open = [] if tail and end - tail[0][1] > CAP else tail
        self.section = self.section if heading is None else heading
        self.open.append((text, begin, end))
        return done


def pack_chunks(lines: DataFrame) -> DataFrame:
    """Chunks of each version's lines (with offsets, `heading`), ordered by line_no.

    Versions are dealt to tasks and sorted there; a task streams through its lines and holds the one open chunk, so a
    version of any number of lines is packed in the same memory.
    """
    kind = lines.schema["version_id"].dataType.simpleString()
    schema = f"version_id {kind}, {CHUNK}"
    names = ["version_id", *(c.split()[0] for c in CHUNK.split(", "))]
    arrow = [pa.int64() if kind == "bigint" else pa.int32() if kind == "int" else pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer: _Packer | None = None

        def rows(done: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), arrow, strict=True)], names=names)

        for batch in batches:
            done = []
            for version, text, begin, end, heading in zip(*(batch.column(c).to_pylist() for c in ("version_id", "text", "char_start", "char_end", "heading")), strict=True):
                if packer is None or packer.version != version:
                    if packer is not None:
                        done.append(packer.close())
                    packer = _Packer(version)
                closed = packer.add(text, begin, end, heading)
                if closed is not None:
                    done.append(closed)
            if done:
                yield rows(done)
        if packer is not None:
            yield rows([packer.close()])

    held = lines.select("version_id", "line_no", "text", "char_start", "char_end", "heading").repartition("version_id").sortWithinPartitions("version_id", "line_no")
    return held.mapInArrow(work, schema)


def parts(documents: DataFrame, pages: str = "n_pages", limit: int = PART_PAGES) -> DataFrame:
    """One row a part of at most `limit` pages: first and last page, and the part's suffix (none if there is one part)."""
    n = F.greatest(F.ceil(F.col(pages) / limit), F.lit(1)).cast("int")
    out = documents.withColumn("n_parts", n).withColumn("part", F.explode(F.sequence(F.lit(1), F.col("n_parts"))))
    width = F.greatest(F.lit(2), F.length(F.col("n_parts").cast("string")))
    suffix = F.when(F.col("n_parts") == 1, "").otherwise(F.concat(F.lit(" (part "), F.call_function("lpad", F.col("part").cast("string"), width, F.lit("0")), F.lit(")")))
    return out.select("*", ((F.col("part") - 1) * limit + 1).cast("long").alias("first_page"), F.least(F.col("part") * limit, F.col(pages)).cast("long").alias("last_page"), suffix.alias("suffix"))


def describe_rows(cells: DataFrame, methods: list[str]) -> DataFrame:
    """Table cells (version_id, page, row_no, col_no, header, text; column 0 is the label) as lines that name themselves.

    A row needs a label and as many category cells as the page has known method columns, three at least.  A label
    without cells is the parent of those below it.
    """
    known = F.col("header").isin(methods)
    row = cells.groupBy("version_id", "page", "row_no").agg(
        F.max(F.when(F.col("col_no") == 0, F.trim("text"))).alias("label"),
        F.count_if(known).alias("columns"),
        F.count_if(known & F.trim("text").rlike(f"^{CATEGORY_CELL}$")).alias("filled"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(known, F.struct("col_no", "header", F.trim("text").alias("text"))))), lambda x: F.concat_ws(": ", x["header"], x["text"])), ", ").alias("cells"),
    )
    w = Window.partitionBy("version_id", "page").orderBy("row_no").rowsBetween(Window.unboundedPreceding, -1)
    row = row.withColumn("parent", F.last(F.when(F.col("filled") == 0, F.col("label")), ignorenulls=True).over(w))
    full = row.where((F.col("columns") >= 3) & (F.col("filled") == F.col("columns")) & (F.coalesce("label", F.lit("")) != ""))
    bare = F.regexp_replace("label", ENUMERATOR, "")
    label = F.when(F.col("parent").isNull(), F.col("label")).otherwise(F.concat_ws(" — ", "parent", bare))
    return full.select("version_id", "page", "row_no", F.concat_ws(" — ", label, "cells").alias("content"))


def fee_rows(rows: DataFrame) -> DataFrame:
    """rows (version_id, row_no, costs, zones array<string>), where a cell stacks several lines, as one line a fee row.

    Each zone's numbers, in an even count of at least four groups of digits, halve into from and to with 0 < from < to;
    a row with one zone that doesn't is dropped whole.
    """
    lines = rows.select("version_id", "row_no", F.posexplode(F.split("costs", "\n")).alias("line", "cost"), "zones")
    zone = F.transform("zones", lambda z: F.trim(F.coalesce(F.get(F.split(z, "\n"), F.col("line")), F.lit(""))))
    lines = lines.withColumn("z", zone)
    number = lambda groups: F.array_join(groups, "").try_cast("long")

    def halves(z):
        g = F.split(z, " +")
        k = (F.size(g) / 2).cast("int")
        ok = z.rlike(r"^\d+(?: +\d+)*$") & (F.size(g) >= 4) & (F.size(g) % 2 == 0)
        a, b = F.slice(g, 1, F.greatest(k, F.lit(1))), F.slice(g, k + 1, F.greatest(k, F.lit(1)))
        return F.when(ok & (number(a) > 0) & (number(a) < number(b)), F.concat(F.array_join(a, " "), F.lit(" bis "), F.array_join(b, " ")))

    parsed = F.transform("z", lambda z, i: F.concat(F.lit("Honorarzone "), (i + 1).cast("string"), F.lit(": "), halves(z)))
    lines = lines.withColumn("parsed", parsed).where(F.forall("parsed", lambda x: x.isNotNull()) & (F.trim("cost") != ""))
    return lines.select("version_id", "row_no", F.col("line").cast("long").alias("line"), F.concat(F.lit("Anrechenbare Kosten "), F.trim("cost"), F.lit(" — "), F.array_join("parsed", ", ")).alias("content"))


_BASE = 0x9E3779B97F4A7C15 | 1


def _powers(n: int, base: int) -> np.ndarray:
    steps = np.full(max(n, 1), base, np.uint64)
    steps[0] = 1
    return np.multiply.accumulate(steps)


def hashed_grams(texts: pd.Series, dim: int = 64) -> pd.Series:
    """The default encoder: words and word pairs hashed to signed buckets.  Deterministic, no weights.

    All words of a batch are hashed together, from one running sum over its characters.
    """
    low = [(t or "").lower() for t in texts]
    codes = np.frombuffer("\n".join(low).encode("utf-32-le", "surrogatepass"), np.uint32)
    begins = np.cumsum([0, *(len(t) + 1 for t in low[:-1])])
    blank = np.isin(codes, [9, 10, 11, 12, 13, 28, 29, 30, 31, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])
    edge = np.diff(np.concatenate(([1], blank, [1])).astype(np.int8))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * _powers(len(codes), _BASE)[: len(codes)])))
    word = (total[end] - total[start]) * _powers(len(codes) + 1, pow(_BASE, -1, 1 << 64))[start]
    row = np.searchsorted(begins, start, side="right") - 1
    pairs = np.flatnonzero(row[1:] == row[:-1])
    h = np.concatenate((word, word[pairs] * np.uint64(31) + word[pairs + 1] * np.uint64(0x94D049BB133111EB) + np.uint64(7)))
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    at = np.concatenate((row, row[pairs])) * dim + (h % np.uint64(dim)).astype(np.int64)
    sign = np.where(h >> np.uint64(40) & np.uint64(1), 1.0, -1.0)
    return pd.Series(list(np.bincount(at, sign, len(low) * dim).reshape(len(low), dim)), index=texts.index, dtype=object)


#: What the encoder sees before a text that is searched, and before one that asks.
PASSAGE, QUERY = "passage: ", "query: "


def embed(chunks: DataFrame, encoder: Callable[[pd.Series], pd.Series] = hashed_grams, dim: int = 64, prefix: str = PASSAGE, text: str = "content", batch: int = 200) -> DataFrame:
    """chunks with `embedding` of unit length: the encoder sees prefixed texts in batches; a wrong dimension is an error."""

    def work(parts_: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts_:
            out = []
            for i in range(0, len(s), batch):
                got = encoder(prefix + s.iloc[i : i + batch].fillna(""))
                if any(len(v) != dim for v in got):
                    raise ValueError(f"the encoder's vectors don't have {dim} dimensions")
                out.append(got)
            yield pd.concat(out) if out else pd.Series([], dtype=object)

    encode = F.pandas_udf(work, "array<double>")
    norm = F.sqrt(F.aggregate("__v", F.lit(0.0), lambda s, x: s + x * x))
    return chunks.withColumn("__v", encode(F.col(text))).withColumn("__n", norm).withColumn("embedding", F.transform("__v", lambda x: F.when(F.col("__n") == 0, x).otherwise(x / F.col("__n")))).drop("__v", "__n")


def index_versions(lines: DataFrame, versions: DataFrame, bad, reference, encoder: Callable[[pd.Series], pd.Series] = hashed_grams) -> tuple[DataFrame, DataFrame]:
    """(chunks, outcome): pending editions chunked, glyph-damaged chunks rejected, the rest embedded and flagged.

    outcome has (version_id, n_chunks, n_rejected, error); only an edition without an error is to be made active, after
    its chunks are written.
    """
    todo = versions.where("status = 'pending'").select("version_id")
    # chunks and outcome both read what is packed: lines are dealt and sorted once
    packed = kept(pack_chunks(offsets(lines.join(gathered(todo), "version_id", "left_semi"))).where(F.col("content").rlike(r"\S")), "packed")
    counted = packed.groupBy("version_id").agg(F.count_if(~bad(F.col("content"))).alias("n_chunks"), F.count_if(bad(F.col("content"))).alias("n_rejected"))
    outcome = versions.select("version_id", "status").join(counted, "version_id", "left")
    error = F.when(F.col("status") != "pending", "not_pending").when(F.coalesce("n_chunks", F.lit(0)) + F.coalesce("n_rejected", F.lit(0)) == 0, "no_text").when(F.col("n_chunks") == 0, "all_damaged")
    outcome = outcome.select("version_id", F.coalesce("n_chunks", F.lit(0)).alias("n_chunks"), F.coalesce("n_rejected", F.lit(0)).alias("n_rejected"), error.alias("error"))
    chunks = embed(packed.where(~bad(F.col("content")))).withColumn("is_reference", reference(F.col("content")))
    return chunks, outcome
