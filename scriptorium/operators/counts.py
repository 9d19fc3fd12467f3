"""How many texts hold one of some terms, for many sets of terms at once: texts are read where they lie, only counts leave a task."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.operators.phrases import _print, _sums
from scriptorium.operators.search import spread, together

#: Bytes of texts that a task looks at together, sets of terms it knows at once, and bits (of a term and a text) it holds.
BYTES, SETS, CELLS = 8_000_000, 1_000_000, 32_000_000
#: A word is a run of bytes that are no ASCII separators, so one of any script.
_WORD = bytes(c if c > 127 or chr(c) in "abcdefghijklmnopqrstuvwxyz0123456789" else 32 for c in range(256))
_TABLE = np.frombuffer(_WORD, np.uint8)
_SPOT = np.uint64(44)


class Asked:
    """Sets (page, terms, set) by page and size; terms by their longest word, which a text with the term has inside one of its own.

    A term that is one word is in every text that has such a word; others are looked at where they may be.
    """

    def __init__(self, sets: pa.Table):
        names = sets.column("terms").combine_chunks().flatten().unique()
        self.terms = [t.encode() for t in names.to_pylist()]
        words = [max(t.translate(_WORD).split(), key=len, default=b"") for t in self.terms]
        self.whole = np.array([w == t for w, t in zip(words, self.terms, strict=True)], bool)
        self.bare = np.array([not w for w in words], bool)
        pieces = sorted({w for w in words if w}, key=lambda w: (len(w), w))
        place = {w: i for i, w in enumerate(pieces)}
        of = np.array([place.get(w, -1) for w in words], int)
        order = np.argsort(of, kind="stable")[np.count_nonzero(of < 0) :]
        self.pieces, self.of_piece = pieces, order
        self.first = np.searchsorted(of[order], np.arange(len(pieces) + 1))
        self.sizes = []
        data, at = np.frombuffer(b"".join(pieces), np.uint8), np.concatenate([[0], np.cumsum([len(w) for w in pieces])]).astype(int)
        (sums, back), size = _sums(data), np.diff(at)
        for s in np.unique(size).tolist():
            own = np.flatnonzero(size == s)
            h = _print(sums[at[own]], sums[at[own] + s], back[at[own]], s)
            by = np.argsort(h)
            spots = np.zeros(1 << 20, bool)
            spots[(h >> _SPOT).view(np.int64)] = True
            self.sizes.append((s, h[by], own[by], spots))

        self.pages = sets.column("page").combine_chunks().unique()
        page = pc.index_in(sets.column("page").combine_chunks(), value_set=self.pages).to_numpy(zero_copy_only=False).astype(int)
        n = pc.list_value_length(sets.column("terms")).to_numpy().astype(int)
        order = np.lexsort((n, page))
        _, member = spread((np.cumsum(n) - n)[order], n[order])
        flat = pc.index_in(sets.column("terms").combine_chunks().flatten(), value_set=names).to_numpy(zero_copy_only=False).astype(int)[member]
        self.sets, page, n = sets.column("set").to_numpy()[order], page[order], n[order]
        begin = np.cumsum(n) - n
        cut = np.flatnonzero((np.diff(page, prepend=-1) != 0) | (np.diff(n, prepend=-1) != 0))
        #: of each page, its runs of sets of one size: the first set, and a row of terms for each
        self.runs: list[list[tuple[int, np.ndarray]]] = [[] for _ in range(len(self.pages))]
        for i, j in zip(cut.tolist(), [*cut[1:].tolist(), len(n)], strict=True):
            self.runs[page[i]].append((i, flat[begin[i] : begin[i] + (j - i) * n[i]].reshape(j - i, n[i])))

    def inside(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(word, term), by word: the terms whose longest word stands in a word."""
        data, at = np.frombuffer(b"".join(words), np.uint8), np.concatenate([[0], np.cumsum([len(w) for w in words])]).astype(int)
        sums, back = _sums(data)
        end = np.repeat(at[1:], np.diff(at))
        found = []
        for s, prints, own, spots in self.sizes:
            begin = np.flatnonzero(np.arange(len(data)) + s <= end)
            h = _print(sums[begin], sums[begin + s], back[begin], s)
            some = np.flatnonzero(spots[(h >> _SPOT).view(np.int64)])
            begin, h = begin[some], h[some]
            place = np.minimum(np.searchsorted(prints, h), len(prints) - 1)
            good = np.flatnonzero(prints[place] == h)
            begin, piece = begin[good], own[place[good]]
            word = np.searchsorted(at, begin, side="right") - 1
            same = np.array([self.pieces[p] in words[w] for w, p in zip(word.tolist(), piece.tolist(), strict=True)], bool)
            found.append(np.unique(word[same] * len(self.pieces) + piece[same]))
        pairs = np.sort(np.concatenate([np.zeros(0, int), *found]))
        word, piece = np.divmod(pairs, max(1, len(self.pieces)))
        of, member = spread(self.first[piece], self.first[piece + 1] - self.first[piece])
        return word[of], self.of_piece[member]

    def count(self, texts: pa.Table, counts: np.ndarray) -> None:
        """Adds to counts (0 or 1 by live, set) the texts (page, live, said) of a set's page that hold one of its terms."""
        page = pc.fill_null(pc.index_in(texts.column("page").combine_chunks(), value_set=self.pages), -1).to_numpy(zero_copy_only=False).astype(int)
        group = page * 2 + pc.fill_null(texts.column("live").combine_chunks(), False).to_numpy(zero_copy_only=False)
        order = np.argsort(group, kind="stable")[np.count_nonzero(page < 0) :]
        if not len(order):
            return
        group, said = group[order], texts.column("said").combine_chunks().take(pa.array(order))
        _, offsets, text = said.buffers()
        at, text = np.frombuffer(offsets, np.int32, len(said) + 1, said.offset * 4), np.frombuffer(text or b"", np.uint8)
        spaced = pa.Array.from_buffers(said.type, len(said), [None, offsets, pa.py_buffer(_TABLE[text].tobytes())], offset=said.offset)
        words = pc.ascii_split_whitespace(spaced)
        length = pc.list_value_length(words).to_numpy(zero_copy_only=False)
        forms = pc.dictionary_encode(words.flatten())
        word, term_of = self.inside(forms.dictionary.cast(pa.binary()).to_pylist())
        last = np.searchsorted(word, np.arange(len(forms.dictionary) + 1))
        n_terms = np.diff(last)
        token = forms.indices.to_numpy(zero_copy_only=False)
        some = np.flatnonzero(n_terms[token])
        row = np.repeat(np.arange(len(said)), length)[some]
        of, member = spread(last[token[some]], n_terms[token[some]])
        row, term = row[of], term_of[member]

        wanted, line = np.zeros(len(self.terms), bool), np.full(len(self.terms), -1)
        cut = np.concatenate([[0], np.flatnonzero(np.diff(group)) + 1, [len(group)]])
        for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            page, live = divmod(int(group[a]), 2)
            here = np.unique(np.concatenate([x.ravel() for _, x in self.runs[page]]))
            wanted[here] = True
            i, j = np.searchsorted(row, [a, b])
            own = wanted[term[i:j]]
            t, r = term[i:j][own], row[i:j][own]
            wanted[here] = False
            bare = here[self.bare[here]]
            if len(bare):
                t, r = np.concatenate([t, np.repeat(bare, b - a)]), np.concatenate([r, np.tile(np.arange(a, b), len(bare))])
            unsure = np.flatnonzero(~self.whole[t])
            if len(unsure):
                good = np.ones(len(t), bool)
                good[unsure] = [self.terms[x] in text[at[y] : at[y + 1]].tobytes() for x, y in zip(t[unsure].tolist(), r[unsure].tolist(), strict=True)]
                t, r = t[good], r[good]
            present, t = np.unique(t, return_inverse=True)
            line[present] = np.arange(len(present))
            wide = max(64, CELLS // (len(present) + 1) // 64 * 64)
            for c in range(a, b, wide):
                now = slice(None) if b - a <= wide else np.flatnonzero((r >= c) & (r < c + wide))
                bits = np.zeros((len(present) + 1, -(-min(wide, b - c) // 64) * 64), bool)  # the last row is of terms that are not here
                bits[t[now], r[now] - c] = True
                held = np.packbits(bits, axis=1).view(np.uint64)
                for first, rows in self.runs[page]:
                    lines = line[rows]
                    met = np.flatnonzero((lines >= 0).any(axis=1))
                    for k in range(0, len(met), step := max(1, CELLS // 8 // held.shape[1])):
                        x = lines[met[k : k + step]]
                        union = held[x[:, 0]]
                        for n in range(1, x.shape[1]):
                            union |= held[x[:, n]]
                        counts[live, first + met[k : k + step]] += np.bitwise_count(union).sum(axis=1, dtype=np.int64)
            line[present] = -1


def term_counts(sets: DataFrame, texts: DataFrame) -> DataFrame:
    """(set, live, retired): how many texts (page, live, content) of a set's page hold one of its terms, where any does.

    sets (set, page, terms) has distinct lower-case terms, none null or empty; a set's counts are kept in a task from its
    first text to its last, and pairs of a set and a text are bits that don't outlive a slice of texts.  More than SETS
    sets are taken in blocks, for each of which the texts are read again.
    """
    blocks = -(-sets.count() // SETS) or 1
    rows = texts.where("content is not null").select(F.col("page").cast(sets.schema["page"].dataType).alias("page"), "live", F.lower("content").alias("said"))

    def counted(block: DataFrame) -> DataFrame:
        known = texts.sparkSession.sparkContext.broadcast(Asked(block.select("set", "page", "terms").toArrow()))

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            asked = known.value
            counts = np.zeros((2, len(asked.sets)), np.int64)
            for some in together(batches, "said", BYTES):
                asked.count(some, counts)
            found = np.flatnonzero(counts.any(axis=0))
            yield pa.RecordBatch.from_arrays([pa.array(asked.sets[found]), pa.array(counts[1, found]), pa.array(counts[0, found])], names=["set", "live", "retired"])

        return rows.mapInArrow(work, "set long, live long, retired long")

    parts = [counted(sets if blocks == 1 else sets.where(F.pmod(F.xxhash64("set"), F.lit(blocks)) == b)) for b in range(blocks)]
    return functools.reduce(DataFrame.unionByName, parts).groupBy("set").agg(F.sum("live").alias("live"), F.sum("retired").alias("retired"))
