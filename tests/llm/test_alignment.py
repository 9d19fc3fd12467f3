"""Aligned tokens against a brute-force version that encodes whole texts by the public libraries and compares byte ends."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from test_operators import corpus

from scriptorium.llm import queries as Q
from scriptorium.llm.alignment import BYTE_BPE, align, coalesce, judge_links
from scriptorium.llm.pieces import MODEL

ODD = ["a▁b", "  lead", "trail  ", "tab\tx\n\n y", " nb  x", "\x00z", "é", "ﬁ﻿", "<s></s> <unk>", "<|endoftext|>", "<0x41>", "\r\n", "  ", " ", "\U0001f600 x", "٣ ५", "it's we'll 12ab", "x" * 5000, " " * 3000, "no spaces," * 800]
ROWS = corpus() + [(2000 + i, t) for i, t in enumerate(ODD)]


def byte_of():
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in plain)}


def tokens(texts):
    """Of each text the ids with the byte at which each ends, for A and for B."""
    import sentencepiece
    from tokenizers import Tokenizer

    a, b, table = Tokenizer.from_file(BYTE_BPE), sentencepiece.SentencePieceProcessor(model_file=MODEL), byte_of()
    a.encode_special_tokens = True
    for text in texts:
        found = a.encode(" " + (text or ""), add_special_tokens=False)
        pieces = b.encode(text or "")
        spelt = [bytes(table[c] for c in t) for t in found.tokens]
        other = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, b.id_to_piece(i)) for i in pieces)]
        if not text or not b"".join(spelt) == b"".join(other) == (" " + text).encode():
            yield [], []
            continue
        yield list(zip(found.ids, np.cumsum([len(x) for x in spelt]).tolist(), strict=True)), list(zip(pieces, np.cumsum([len(x) for x in other]).tolist(), strict=True))


def brute(rows):
    both = list(tokens([t for _, t in rows]))
    links = [[(i, j) for i, e in a for j in [dict((f, x) for x, f in b).get(e)] if j is not None] if len(a) < 300 else [(i, dict((f, x) for x, f in b)[e]) for ends in [dict((f, x) for x, f in b)] for i, e in a if e in ends] for a, b in both]
    count = Counter(x for each in links for x in each)
    most = defaultdict(int)
    for (_, j), n in count.items():
        most[j] = max(most[j], n)
    for (i, _), (a, b), own in zip(rows, both, links, strict=True):
        cuts, groups, low = sorted({e for _, e in a} & {e for _, e in b}), [], 0
        for cut in cuts:
            groups.append("|".join(",".join(str(x) for x, e in side if low < e <= cut) for side in (a, b)) if len(cuts) < 3000 else None)
            low = cut
        yield {"doc_id": i, "n_a": len(a), "n_b": len(b), "n_groups": len(cuts), "n_links": len(own), "n_best": sum(count[x] == most[x[1]] for x in own), "count_sum": sum(count[x] for x in own), "groups_sha256": hashlib.sha256(";".join(groups).encode()).hexdigest() if a and len(cuts) < 3000 else ("" if not a else None)}


def test_query(spark, tmp_path):
    spark.createDataFrame(ROWS, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = [r.asDict() for r in Q.QUERIES["op11_token_alignment"](spark, str(tmp_path)).collect()]
    want = list(brute(ROWS))
    unhashed = {w["doc_id"] for w in want if w["groups_sha256"] is None}  # too long for the plain version to spell
    key = lambda rows: sorted(repr({k: v for k, v in r.items() if k != "groups_sha256" or r["doc_id"] not in unhashed}) for r in rows)
    assert key(got) == key(want)
    assert sum(r["n_links"] for r in got) > 5000 and any(r["n_best"] < r["n_links"] for r in got)


def test_intervals_against_all_pairs():
    r = random.Random(4)
    for _ in range(200):
        n = r.randrange(1, 40)
        cut = lambda: np.diff([0, *sorted(r.sample(range(1, n), r.randrange(n))), n])  # noqa: E731, B023
        a, b = cut(), cut()
        found = coalesce(a, b)
        span = lambda x: [(e - s, e) for e, s in zip(np.cumsum(x), x, strict=True)]
        pairs = [(i, j, x[1] == y[1]) for i, x in enumerate(span(a)) for j, y in enumerate(span(b)) if x[0] < y[1] and y[0] < x[1]]
        assert list(zip(found.a, found.b, found.together, strict=True)) == pairs
        ends = sorted({x[1] for x in span(a)} & {x[1] for x in span(b)})
        assert found.group.tolist() == [int(np.searchsorted(ends, x[1])) for x in span(a) + span(b)]


def test_columns_that_clash_and_empty_tables(spark):
    rows = spark.createDataFrame([("some text", 1, "g", 5), (None, 2, "h", 6)], "text string, n_a int, groups string, row int")
    judged = judge_links(align(rows).withColumnRenamed("n_b", "n_best"))
    assert judged.columns == ["text", "row", "n_a", "n_groups", "groups", "n_links", "n_best", "count_sum"]
    assert {(r["row"], r["n_a"] > 0, r["n_links"] > 0) for r in judged.collect()} == {(5, True, True), (6, False, False)}
    assert judge_links(align(rows.limit(0))).count() == 0


@pytest.mark.parametrize("share", [1, 1 << 30])
def test_rare_and_frequent_pairs_alike(spark, monkeypatch, share):
    """All pairs by the shuffled join, then all by the broadcast one."""
    import scriptorium.llm.alignment as A

    rows = [(i, t) for i, t in ROWS if i is not None and i < 40]
    monkeypatch.setattr(A, "SHARE", share)
    got = {r["doc_id"]: (r["n_best"], r["count_sum"]) for r in judge_links(align(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    assert got == {w["doc_id"]: (w["n_best"], w["count_sum"]) for w in brute(rows)}
