"""Alignment of two tokenizers' tokens by byte ranges, and the id pairs that a corpus links.

Both vocabularies are public files whose paths are parameters; nothing is trained.  A is a byte-level BPE, run over space +
text; B is a piece model that puts the space itself.  All A and B tokens of a slice of texts are sorted together by where
they begin; with the running maximum of where they end, a group breaks where a token begins at that maximum, which is
where A and B tokens both end.  Within a group the tokens that overlap are expanded into pairs.

A B piece never holds a space after another character, so B splits a text at its runs of spaces: distinct parts of a slice
are encoded once.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from scriptorium.llm.common import slices, written
from scriptorium.llm.pieces import MODEL, spread

BYTE_BPE = "/opt/tokenizers/byte_bpe_50k.json"
#: Fixed value: how a byte-level BPE of this kind cuts a text before its merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
PART = re.compile(r" +[^ ]*")
#: A pair with more than 1 / SHARE of all links is looked up by broadcast: there are at most SHARE of those.
SHARE = 1 << 14


class Tokenizers(NamedTuple):
    """ranks: A's bytes by rank; names: its id of each rank; a_size, b_size: bytes of each id; model: the piece file's content."""

    ranks: dict[bytes, int]
    names: np.ndarray
    a_size: np.ndarray
    b_surface: list[bytes]
    b_size: np.ndarray
    model: bytes


def _unmapped() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable Latin-1 as it is, the rest from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def load(byte_bpe: str = BYTE_BPE, model: str = MODEL) -> Tokenizers:
    """Read both files on the driver; the result goes to the workers with the job (its size is the vocabularies')."""
    import sentencepiece

    with open(byte_bpe, encoding="utf-8") as f:
        file = json.load(f)
    table, vocabulary = _unmapped(), file["model"]["vocab"]
    surface = {t: bytes(table[c] for c in t) for t in vocabulary if all(c in table for c in t)}
    merged = [m if isinstance(m, list) else m.split(" ") for m in file["model"]["merges"]]
    order = [t for t in surface if len(surface[t]) == 1] + ["".join(m) for m in merged]
    if len({surface[t] for t in order if len(surface[t]) == 1}) < 256:
        raise ValueError("a byte-level vocabulary has a token for each byte")
    size = max(vocabulary.values()) + 1
    a_size = np.zeros(size, np.int64)
    for t in order:
        a_size[vocabulary[t]] = len(surface[t])
    with open(model, "rb") as f:
        content = f.read()
    sp = sentencepiece.SentencePieceProcessor(model_proto=content)
    pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
    if any("▁" in p.lstrip("▁") for p in pieces):
        raise ValueError("pieces with a space after another character would join the parts of a text")
    b_surface = [bytes([int(p[3:5], 16)]) if sp.is_byte(i) else b"" if sp.is_control(i) or sp.is_unknown(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
    return Tokenizers({surface[t]: k for k, t in enumerate(order)}, np.array([vocabulary[t] for t in order]), a_size, b_surface, np.array([len(x) for x in b_surface]), content)


class Encoders:
    """Both encoders in a worker."""

    def __init__(self, files: Tokenizers):
        import sentencepiece
        import tiktoken

        self.files = files
        self.a = tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks=files.ranks, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_proto=files.model)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """A's ids and B's ids of all texts on end, and how many of each a text has; none where the bytes differ from space + text."""
        parts = [PART.findall(" " + t) if t else [] for t in texts]
        distinct = list(dict.fromkeys(chain.from_iterable(parts)))
        index = dict(zip(distinct, range(len(distinct)), strict=True))
        # the encoder puts the first space; of nothing else it makes nothing, so a space that ends a text is its piece
        found = [f if f or p != " " else [self.b.piece_to_id("▁")] for f, p in zip(self.b.encode([p[1:] for p in distinct], num_threads=1), distinct, strict=True)]
        surface = self.files.b_surface
        whole = np.array([b"".join(map(surface.__getitem__, f)) == p.encode() for f, p in zip(found, distinct, strict=True)], bool)
        ends = np.concatenate(([0], np.cumsum([len(f) for f in found]))).astype(np.int64)
        flat = np.fromiter(chain.from_iterable(found), np.int64, int(ends[-1]))
        a, b, n_a, n_b = [], [], [], []
        for text, row in zip(texts, parts, strict=True):
            chosen = np.fromiter(map(index.__getitem__, row), np.int64, len(row))
            ids = np.zeros(0, np.int64)
            if row and whole[chosen].all():
                ids = self.files.names[self.a.encode_to_numpy(" " + text, disallowed_special=())]
            if len(ids):
                b.append(flat[spread(ends, chosen)[0]])
                a.append(ids)
            n_a.append(len(ids))
            n_b.append(len(b[-1]) if len(ids) else 0)
        join = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
        return join(a), join(b), np.array(n_a, np.int64), np.array(n_b, np.int64)


class Alignment(NamedTuple):
    """group: of each A token, then of each B token; a, b: places of the tokens that overlap, in A and in B; together: whether those end alike."""

    group: np.ndarray
    a: np.ndarray
    b: np.ndarray
    together: np.ndarray


def coalesce(a_size: np.ndarray, b_size: np.ndarray) -> Alignment:
    """Groups and overlaps of two runs of tokens over the same bytes, from the tokens' sizes (none of them 0)."""
    a_end, b_end = np.cumsum(a_size), np.cumsum(b_size)
    begin, end = np.concatenate((a_end - a_size, b_end - b_size)), np.concatenate((a_end, b_end))
    side = np.repeat(np.array([0, 1], np.int8), [len(a_size), len(b_size)])
    order = np.lexsort((side, begin))
    reach = np.maximum.accumulate(end[order])
    breaks = np.ones(len(order), bool)
    breaks[1:] = begin[order][1:] >= reach[:-1]
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(breaks) - 1
    low = np.searchsorted(b_end, a_end - a_size, side="right")
    count = np.searchsorted(b_end - b_size, a_end, side="left") - low
    a = np.repeat(np.arange(len(a_size)), count)
    b = np.repeat(low - (np.cumsum(count) - count), count) + np.arange(len(a))
    return Alignment(group, a, b, a_end[a] == b_end[b])


LINKS = "array<struct<a:int,b:int,n:int>>"


def align(docs: DataFrame, text: str = "text", byte_bpe: str = BYTE_BPE, model: str = MODEL) -> DataFrame:
    """docs with n_a, n_b, n_groups (long), `groups` and `links`: how A's and B's tokens of each whole text meet.

    `groups` spells the groups in order: `a1,a2|b1;a3|b2,b3` are decimal ids of A and B.  `links` has each pair of ids
    whose tokens end together in the text, and how often.  A text that is null, empty, or that B's pieces don't give
    back byte by byte (one that has U+2581, say) has no tokens: zeros, an empty string, no links.  Repeated rows are
    aligned alike.  Columns of these names are replaced.
    """
    files = docs.sparkSession.sparkContext.broadcast(load(byte_bpe, model))
    held = docs.drop(*[c for c in ("n_a", "n_b", "n_groups", "groups", "links") if c != text])
    schema = T.StructType([*held.schema.fields, *T._parse_datatype_string(f"n_a long, n_b long, n_groups long, groups string, links {LINKS}").fields])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = Encoders(files.value)
        n_ids = len(files.value.a_size), len(files.value.b_size)
        # a token's spelling with what stands before it: first of a group or not
        spelt = np.array([f"{sign}{i}" for signs, n in zip((";,", "|,"), n_ids, strict=True) for sign in signs for i in range(n)], object)
        for batch in batches:
            for part in slices(batch, text):
                a, b, n_a, n_b = both.encode(part.column(text).to_pylist())
                a_doc, b_doc = np.repeat(np.arange(len(n_a)), n_a), np.repeat(np.arange(len(n_b)), n_b)
                found = coalesce(files.value.a_size[a], files.value.b_size[b])
                first = np.ones(len(found.group), bool)
                first[1:] = found.group[1:] != found.group[:-1]
                if len(b):
                    first[len(a)] = True
                n_groups = np.bincount(a_doc[first[: len(a)]], minlength=len(n_a))
                word = np.concatenate((a, 2 * n_ids[0] + b)) + ~first * np.repeat(n_ids, [len(a), len(b)])
                inner = np.lexsort((np.repeat([0, 1], [len(a), len(b)]), found.group))
                words = spelt[word[inner]]
                at = np.concatenate(([0], np.cumsum(n_a + n_b)))
                groups = ["".join(words[i:j].tolist())[1:] for i, j in zip(at[:-1], at[1:], strict=True)]
                i, j = found.a[found.together], found.b[found.together]
                pairs, n = np.unique((a_doc[i] * n_ids[0] + a[i]) * n_ids[1] + b[j], return_counts=True)
                row, pair = np.divmod(pairs, n_ids[0] * n_ids[1])
                fields = [pa.array(x.astype(np.int32)) for x in (*np.divmod(pair, n_ids[1]), n)]
                ends = np.concatenate(([0], np.cumsum(np.bincount(row, minlength=len(n_a))))).astype(np.int32)
                links = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays(fields, ["a", "b", "n"]))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(n_a), pa.array(n_b), pa.array(n_groups), pa.array(groups, pa.string()), links], names=schema.names)

    return held.mapInArrow(work, schema)


def count_links(aligned: DataFrame) -> DataFrame:
    """a, b, count and best: how many links of the corpus hold an id pair linked, and whether no pair of its B id has more."""
    counts = aligned.select(F.inline("links")).groupBy("a", "b").agg(F.sum("n").alias("count"))
    return counts.withColumn("best", F.col("count") == F.max("count").over(Window.partitionBy("b")))  # a B id has at most A's vocabulary of pairs


def judge_links(aligned: DataFrame) -> DataFrame:
    """aligned, less its links, with n_links, n_best and count_sum (long): what the whole corpus says of a text's links.

    n_best: links whose pair is its B id's most frequent, ties included; count_sum: the pairs' counts over all links.  A
    text without links has zeros, an empty table stays empty, and repeated rows count each.
    """
    rest = [c for c in aligned.columns if c not in ("links", "n_links", "n_best", "count_sum")]
    packed = aligned.select(F.struct(*rest).alias("own"), "links").withColumn("row", F.monotonically_increasing_id())
    texts = written(packed, "links")
    counts = written(count_links(texts), "link-counts")
    total = counts.agg(F.sum("count")).first()[0] or 0
    often = F.col("count") * SHARE > total
    hot = F.broadcast(counts.filter(often))  # at most SHARE rows, as their shares add up to 1
    each = texts.select("row", F.inline("links"))
    value = [F.sum("n").alias("n_links"), F.sum(F.when(F.col("best"), F.col("n"))).alias("n_best"), F.sum(F.col("n") * F.col("count")).alias("count_sum")]
    seen = each.join(hot, ["a", "b"]).groupBy("row").agg(*value)
    rare = each.join(hot, ["a", "b"], "left_anti").join(counts.filter(~often), ["a", "b"]).groupBy("row").agg(*value)
    sums = seen.unionByName(rare).groupBy("row").agg(*[F.sum(c).alias(c) for c in ("n_links", "n_best", "count_sum")])
    return texts.select("row", "own").join(sums, "row", "left").select("own.*", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("n_links", "n_best", "count_sum")])
