"""SentencePiece encoding with N best segmentations, decoding, and token counts.

Pieces come from a public model file, whose path is a parameter; nothing is trained.  A piece's score follows from its
rank in that file by Zipf's law, log p = -log(rank + 1) - log H, so pieces form a unigram lattice.  A character that no
piece covers becomes its bytes, at the lowest score less ten.  A space is a space here (the file's U+2581), one is put
before the text, and U+2581 itself is spelt in bytes, so decoding gives back every text.

No piece holds a space after another character, so every path of the lattice passes through the start of each run of
spaces: a text splits there into pre-tokens, whose segmentations are independent.  Forward and backward Viterbi scores
are taken for all distinct pre-tokens of a slice of texts at once, in arrays; they give each one's best segmentation and
what its second best loses.  Only the pre-tokens whose second best costs a text least can differ in its next best
segmentations, and those are searched by A-star.
"""

from __future__ import annotations

import heapq
import math
import re
from collections.abc import Iterator
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from scriptorium.llm.common import mix, powers, slices

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
PRETOKEN = re.compile(r" +[^ ]*|[^ ]+")
UNKNOWN_PENALTY = 10.0
#: Pre-tokens that a task remembers the counts of, and bytes of text that are segmented at once.
CACHE = 200_000
SLICE = 1 << 19
N_BEST = 3


class Pieces(NamedTuple):
    """scores: of each piece and None for each proper prefix of one; reverse: the same for suffixes; surface: bytes of each id."""

    scores: dict[str, tuple[int, float] | None]
    reverse: dict[str, float | None]
    bytes_at: int
    unknown: float
    surface: list[bytes]


def load(model: str = MODEL) -> Pieces:
    """Read a piece file on the driver; the result goes to the workers with the job (its size is the vocabulary's)."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    names = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
    surface = [bytes([int(p[3:5], 16)]) if sp.is_byte(i) else b"" if sp.is_control(i) or sp.is_unknown(i) else p.replace("▁", " ").encode() for i, p in enumerate(names)]
    inner = [p for p in names if "▁" in p.lstrip("▁")]
    if inner:
        raise ValueError(f"pieces with a space after another character would join pre-tokens: {inner[:3]}")
    plain = [i for i in range(len(names)) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))]
    total = math.log(sum(1 / (r + 1) for r in range(len(plain))))
    scores: dict[str, tuple[int, float] | None] = {}
    reverse: dict[str, float | None] = {}
    for rank, i in enumerate(plain):
        p, s = surface[i].decode(), -math.log(rank + 1) - total
        for k in range(1, len(p)):
            scores.setdefault(p[:k], None)
            reverse.setdefault(p[k:], None)
        scores[p] = (i, s)
        reverse[p] = s
    return Pieces(scores, reverse, names.index("<0x00>"), -math.log(len(plain)) - total - UNKNOWN_PENALTY, surface)


def n_best(word: str, pieces: Pieces, n: int) -> list[tuple[float, tuple[int, ...]]]:
    """The n best segmentations of a pre-token, best first.

    Of equal costs (to nine places) the path that has come furthest goes on, so a pre-token with endless ties takes no more
    than n walks along it; a path is a chain that shares what it has in common with others.
    """
    size = len(word)
    ends: list[list[tuple[int, float, tuple[int, ...]]]] = [[] for _ in range(size + 1)]
    best = [-math.inf] * (size + 1)
    best[0] = 0.0
    get = pieces.scores.get
    for i in range(size):
        here, single = best[i], False
        for j in range(i + 1, size + 1):
            found = get(word[i:j], False)
            if found is False:
                break
            if found is not None:
                single |= j == i + 1
                ends[j].append((i, found[1], (found[0],)))
                if here + found[1] > best[j]:
                    best[j] = here + found[1]
        if not single:
            ends[i + 1].append((i, pieces.unknown, tuple(pieces.bytes_at + b for b in word[i].encode("utf-8", "surrogatepass"))))
            best[i + 1] = max(best[i + 1], here + pieces.unknown)
    # backward: what is done plus the forward score is the exact score of the best completion
    heap, out, count = [(round(-best[size], 9), size, 0, 0.0, None)], [], 0
    while heap and len(out) < n:
        _, at, _, done, path = heapq.heappop(heap)
        if not at:
            ids: list[int] = []
            while path is not None:
                ids += path[0]
                path = path[1]
            out.append((done, tuple(ids)))
            continue
        for i, s, p in ends[at]:
            count += 1
            heapq.heappush(heap, (round(-(done + s + best[i]), 9), i, count, done + s, (p, path)))
    return out


def alternatives(word: str, pieces: Pieces, n: int, best: tuple[int, ...]) -> list[tuple[float, tuple[int, ...]]]:
    """The n best with the given one of the best first, which of several ties it may be."""
    found = n_best(word, pieces, n)
    return [(found[0][0], best), *[x for x in found if x[1] != best][: n - 1]]


class Lattice(NamedTuple):
    """Best segmentations of many pre-tokens: flat ids with offsets, scores, and the loss of each one's second best."""

    ids: np.ndarray
    offsets: np.ndarray
    score: np.ndarray
    loss: np.ndarray


class Table(NamedTuple):
    """Hashes of pieces and of their prefixes, sorted, with the piece's id (-1 for a mere prefix) and score."""

    hashes: np.ndarray
    ids: np.ndarray
    scores: np.ndarray


def _codes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the words on end, and where each begins."""
    codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
    return codes, np.concatenate(([0], np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))))


def _code_hashes(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    total = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(mix(codes.astype(np.uint64) + np.uint64(1)) * powers("up", len(codes)), out=total[1:])
    return total, powers("down", len(codes) + 1)


def table_of(pieces: Pieces) -> Table:
    names = list(pieces.scores)
    codes, at = _codes(names)
    total, down = _code_hashes(codes)
    h = mix((total[at[1:]] - total[at[:-1]]) * down[at[:-1]] + np.diff(at).astype(np.uint64))
    order = np.argsort(h)
    found = [pieces.scores[n] for n in names]
    return Table(h[order], np.array([-1 if f is None else f[0] for f in found])[order], np.array([0.0 if f is None else f[1] for f in found])[order])


def lattice(words: list[str], pieces: Pieces, table: Table) -> Lattice:
    """Viterbi forwards and backwards over all words together, one place in the word and one piece length at a time."""
    codes, at = _codes(words)
    n, sizes = len(words), np.diff(at)
    total, down = _code_hashes(codes)
    place = np.arange(len(codes)) - np.repeat(at[:-1], sizes)
    room = np.repeat(sizes, sizes) - place
    edges: dict[tuple[int, int], tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
    live, length = np.arange(len(codes)), 0
    while len(live):
        length += 1
        h = mix((total[live + length] - total[live]) * down[live] + np.uint64(length))
        k = np.minimum(np.searchsorted(table.hashes, h), len(table.hashes) - 1)
        there = table.hashes[k] == h
        ids, scores = np.where(there, table.ids[k], -1), table.scores[k]
        if length == 1:  # a character that is no piece is its bytes
            scores = np.where(ids < 0, pieces.unknown, scores)
            some = np.arange(len(live))
        else:
            some = np.flatnonzero(ids >= 0)
        starts = live[some]
        by = np.argsort(place[starts], kind="stable")
        starts, some = starts[by], some[by]
        cuts = np.flatnonzero(np.diff(place[starts], prepend=-1, append=-2))
        for i, j in zip(cuts[:-1], cuts[1:], strict=True):
            edges[int(place[starts[i]]), length] = starts[i:j], ids[some[i:j]], scores[some[i:j]]
        live = live[there & (room[live] > length)]
    word = np.repeat(np.arange(n), sizes)
    # node of a place: one more a word, for its end
    best = np.full(len(codes) + n, -np.inf)
    best[at[:-1] + np.arange(n)] = 0.0
    step, piece = np.zeros(len(best), np.int64), np.zeros(len(best), np.int64)
    order = sorted(edges)
    for key in order:
        starts, ids, scores = edges[key]
        a = starts + word[starts]
        b = a + key[1]
        new = best[a] + scores
        up = new > best[b]
        best[b[up]], step[b[up]], piece[b[up]] = new[up], key[1], ids[up]
    back = np.full(len(best), -np.inf)
    back[at[1:] + np.arange(n)] = 0.0
    for key in reversed(order):
        starts, ids, scores = edges[key]
        a = starts + word[starts]
        back[a] = np.maximum(back[a], back[a + key[1]] + scores)
    # the best path, from the ends
    taken = np.zeros(len(best), np.int64)
    node, who, parts = at[1:] + np.arange(n), np.arange(n), []
    while len(node):
        prior = node - step[node]
        taken[prior] = step[node]
        parts.append((who, prior, piece[node]))
        more = prior > at[who] + who
        node, who = prior[more], who[more]
    second = np.full(n, -np.inf)
    for key in order:
        starts, ids, scores = edges[key]
        a = starts + word[starts]
        off = taken[a] != key[1]
        np.maximum.at(second, word[starts[off]], (best[a] + scores + back[a + key[1]])[off])
    who, prior, ids = (np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, np.int64) for i in range(3))
    by = np.argsort(prior, kind="stable")
    who, prior, ids = who[by], prior[by], ids[by]
    spelt = np.flatnonzero(ids < 0)
    counts = np.ones(len(ids), np.int64)
    raw = [chr(c).encode("utf-8", "surrogatepass") for c in codes[prior[spelt] - who[spelt]]]
    counts[spelt] = [len(b) for b in raw]
    flat = np.repeat(ids, counts)
    flat[np.repeat(ids < 0, counts)] = pieces.bytes_at + np.frombuffer(b"".join(raw), np.uint8).astype(np.int64)
    ends = np.concatenate(([0], np.cumsum(np.bincount(who, counts, n)))).astype(np.int64)
    score = best[at[1:] + np.arange(n)]
    return Lattice(flat.astype(np.int32), ends, score, score - second)


def spread(offsets: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the chosen lists' elements in a flat array of lists, and how many each has."""
    sizes = offsets[chosen + 1] - offsets[chosen]
    begin = np.cumsum(sizes) - sizes
    return np.repeat(offsets[chosen] - begin, sizes) + np.arange(int(sizes.sum())), sizes


def combine(words: list[list[tuple[float, tuple[int, ...]]]], n: int) -> list[tuple[float, tuple[int, ...]]]:
    """The n best ways to choose a segmentation for each of some pre-tokens: loss against the best, and the choices."""
    start = (0,) * len(words)
    heap, seen, out = [(0.0, start)], {start}, []
    while heap and len(out) < n:
        cost, choice = heapq.heappop(heap)
        out.append((cost, choice))
        for k, w in enumerate(words):
            if choice[k] + 1 < len(w):
                more = (*choice[:k], choice[k] + 1, *choice[k + 1 :])
                if more not in seen:
                    seen.add(more)
                    heapq.heappush(heap, (sum(words[m][0][0] - words[m][c][0] for m, c in enumerate(more)), more))
    return out


def cheapest(loss: np.ndarray, n: int) -> np.ndarray:
    """The n places of least finite loss, ties to the left, in text order."""
    if n < 1:
        return np.zeros(0, np.int64)
    near = np.flatnonzero(loss <= np.partition(loss, n - 1)[n - 1]) if n <= len(loss) else np.arange(len(loss))
    near = near[np.argsort(loss[near], kind="stable")][:n]
    return np.sort(near[np.isfinite(loss[near])])


def _surface(pieces: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all ids on end, and where each begins."""
    return np.frombuffer(b"".join(pieces.surface), np.uint8), np.concatenate(([0], np.cumsum([len(x) for x in pieces.surface])))


def _spelt(ids: np.ndarray, spelt: np.ndarray, at: np.ndarray) -> str:
    """What ids stand for, without the space put before every text."""
    places, _ = spread(at, ids)
    return spelt[places].tobytes().decode("utf-8", "replace")[1:]


def encode(docs: DataFrame, text: str = "text", model: str = MODEL, n: int = N_BEST, decoded: str | None = None) -> DataFrame:
    """docs with `ids` array<int> (the best segmentation), `score` double, and `others`, the next n - 1 best.

    Each of `others` has its score and its edits: pieces begin to end (exclusive) of the best give way to ids.  Null
    text: null ids and score, no others.  Empty text: the one piece of the leading space.  Repeated rows are encoded
    alike.  Columns of these names are replaced.  decoded names a column for the text that the ids stand for, as decode
    gives it, made in the same pass; it may be the text's own.
    """
    pieces = docs.sparkSession.sparkContext.broadcast(load(model))
    added = "ids array<int>, score double, others array<struct<score:double,edits:array<struct<begin:int,end:int,ids:array<int>>>>>"
    held = docs.drop(*[c for c in ("ids", "score", "others") if c != text])
    extra = [T.StructField(decoded, T.StringType())] if decoded else []
    schema = T.StructType([f for f in held.schema.fields if f.name != decoded] + T._parse_datatype_string(added).fields + extra)
    kinds = [pa.list_(pa.int32()), pa.float64(), pa.list_(pa.struct([("score", pa.float64()), ("edits", pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32()), ("ids", pa.list_(pa.int32()))])))]))]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pieces.value
        table = table_of(known)
        spelt = _surface(known)
        for batch in batches:
            for part in slices(batch, text, SLICE):
                words = [PRETOKEN.findall(" " + t) if t is not None else [] for t in part.column(text).to_pylist()]
                distinct = list(dict.fromkeys(chain.from_iterable(words)))
                index = dict(zip(distinct, range(len(distinct)), strict=True))
                found = lattice(distinct, known, table)
                place, sizes, scores, others = [], [], [], []
                for row in words:
                    if not row:
                        sizes.append(None)
                        scores.append(None)
                        others.append([])
                        continue
                    chosen = np.fromiter(map(index.__getitem__, row), np.int64, len(row))
                    spots, counts = spread(found.offsets, chosen)
                    best = float(found.score[chosen].sum())
                    near = cheapest(found.loss[chosen], n - 1)
                    own = [found.ids[found.offsets[chosen[w]] : found.offsets[chosen[w] + 1]] for w in near]
                    lists = [alternatives(row[w], known, n, tuple(x.tolist())) for w, x in zip(near, own, strict=True)]
                    begin = np.cumsum(counts) - counts
                    rest = []
                    for loss, choice in combine(lists, n)[1:]:
                        edits = [{"begin": int(begin[w]), "end": int(begin[w] + counts[w]), "ids": list(x[c][1])} for w, x, c in zip(near, lists, choice, strict=True) if c]
                        rest.append({"score": best - loss, "edits": edits})
                    place.append(spots)
                    sizes.append(len(spots))
                    scores.append(best)
                    others.append(rest)
                ends = np.concatenate(([0], np.cumsum([s or 0 for s in sizes]))).astype(np.int32)
                ids = found.ids[np.concatenate(place)] if place else np.zeros(0, np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(ids), mask=pa.array([s is None for s in sizes]))
                own = [part.column(c) for c in part.schema.names if c != decoded]
                again = [pa.array([None if s is None else _spelt(ids[a : a + s].astype(np.int64), *spelt) for a, s in zip(ends[:-1], sizes, strict=True)], pa.string())] if decoded else []
                yield pa.RecordBatch.from_arrays([*own, lists, pa.array(scores, kinds[1]), pa.array(others, kinds[2]), *again], names=schema.names)

    return held.mapInArrow(work, schema)


def decode(encoded: DataFrame, ids: str = "ids", text: str = "decoded", model: str = MODEL) -> DataFrame:
    """encoded with the text that ids stand for; null ids give null, and bytes that aren't UTF-8 the replacement sign."""
    pieces = encoded.sparkSession.sparkContext.broadcast(load(model))
    held = encoded.drop(*[text] if text != ids else [])
    schema = T.StructType([*held.schema.fields, T.StructField(text, T.StringType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spelt = _surface(pieces.value)
        for batch in batches:
            texts = []
            for row in batch.column(ids):
                texts.append(_spelt(row.values.to_numpy(zero_copy_only=False).astype(np.int64), *spelt) if row.is_valid else None)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=schema.names)

    return held.mapInArrow(work, schema)


def trie_counts(words: list[str], pieces: Pieces) -> list[int]:
    """Pieces in the best segmentation of each pre-token, for sorted distinct words.

    Sorted words walk their trie depth first: a word keeps the forward scores of the prefix it shares with the one
    before it, so each node of the trie is scored once, and its end takes the count there.
    """
    best, count, out, before = [0.0], [0], [], ""
    get = pieces.reverse.get
    for word in words:
        at = 0
        for a, b in zip(before, word, strict=False):
            if a != b:
                break
            at += 1
        del best[at + 1 :], count[at + 1 :]
        for j in range(at + 1, len(word) + 1):
            top, n, single = -math.inf, 0, False
            for i in range(j - 1, -1, -1):
                s = get(word[i:j], False)
                if s is False:
                    break
                if s is not None:
                    single |= i == j - 1
                    if best[i] + s > top:
                        top, n = best[i] + s, count[i] + 1
            if not single and best[j - 1] + pieces.unknown > top:
                top, n = best[j - 1] + pieces.unknown, count[j - 1] + len(word[j - 1].encode("utf-8", "surrogatepass"))
            best.append(top)
            count.append(n)
        out.append(count[-1])
        before = word
    return out


def count_tokens(docs: DataFrame, text: str = "text", model: str = MODEL) -> DataFrame:
    """docs with n_pretokens and n_tokens (long) of the best unigram segmentation.

    Null text: 0 and 0.  Empty text: 1 and 1, the leading space.  Repeated rows count alike.  Columns of these names are
    replaced.
    """
    pieces = docs.sparkSession.sparkContext.broadcast(load(model))
    held = docs.drop(*[c for c in ("n_pretokens", "n_tokens") if c != text])
    schema = T.StructType([*held.schema.fields, T.StructField("n_pretokens", T.LongType()), T.StructField("n_tokens", T.LongType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, known = pieces.value, {}
        for batch in batches:
            for part in slices(batch, text):
                words = [PRETOKEN.findall(" " + t) if t is not None else [] for t in part.column(text).to_pylist()]
                new = sorted(set(chain.from_iterable(words)).difference(known))
                if len(known) + len(new) > CACHE:
                    known, new = {}, sorted(set(chain.from_iterable(words)))
                known.update(zip(new, trie_counts(new, table), strict=True))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(map(len, words), pa.int64()), pa.array((sum(map(known.__getitem__, w)) for w in words), pa.int64())], names=schema.names)

    return held.mapInArrow(work, schema)
