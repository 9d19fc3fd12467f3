"""Packing as a stream, the default encoder, and runs that break off between their writes."""

import random

import pandas as pd
import pytest

import scriptorium.operators.indexing as I
from scriptorium.functions import text as X
from scriptorium.operators.layout import CAP, OVERLAP, SENTENCE_END, TARGET, _Packer, hashed_grams, offsets, pack_chunks


def plain(lines):
    """(text, begin, end, heading) of one version, packed by lists of line numbers."""
    out, a, section = [], 0, None
    for k, (_, _, end, heading) in enumerate(lines):
        shut = k > a and (heading is not None or end - lines[a][1] > CAP or (end - lines[a][1] > TARGET and lines[k - 1][0].rstrip().endswith(SENTENCE_END)))
        if shut:
            out.append((a, k, section))
            tail = [t for t in range(a + 1, k) if lines[k - 1][2] - lines[t][1] <= OVERLAP] or list(range(max(a + 1, k - 1), k))
            a = k if heading is not None or not tail or end - lines[tail[0]][1] > CAP else tail[0]
        section = heading if heading is not None else section
    return out + [(a, len(lines), section)] if lines else []


def made(r, n):
    rows, at = [], 0
    for _ in range(n):
        t = "x" * r.choice([0, 5, 80, 150, 700, 2500]) + r.choice(["", ".", " and"])
        rows.append((t, at, at + len(t), r.choice([None] * 9 + ["1 Head"])))
        at += len(t) + 1
    return rows


def test_packing_against_plain(spark):
    r = random.Random(4)
    versions = {v: made(r, r.randrange(1, 300)) for v in range(25)}
    rows = [(v, k, t, b, e, h) for v, lines in versions.items() for k, (t, b, e, h) in enumerate(lines)]
    r.shuffle(rows)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")  # chunks run over batches
    try:
        got = pack_chunks(spark.createDataFrame(rows, "version_id long, line_no long, text string, char_start long, char_end long, heading string")).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = [(v, o, lines[a][1], lines[z - 1][2], "\n".join(x[0] for x in lines[a:z]), s, z - a) for v, lines in versions.items() for o, (a, z, s) in enumerate(plain(lines))]
    assert sorted(map(tuple, got)) == sorted(want)


def test_a_million_lines_hold_one_chunk():
    packer, most = _Packer(1), 0
    for k in range(1_000_000):
        packer.add("a line of text", 15 * k, 15 * k + 14, None)
        most = max(most, len(packer.open))
    assert most <= CAP // 15 + 1 and packer.ordinal > 8000


def test_encoder():
    texts = pd.Series(["passage: The cat sat", "passage: the  CAT\tsat", "", None, "cat the", "x\x85y z", "passage: the cat sat down"])
    v = hashed_grams(texts)
    assert all(len(x) == 64 for x in v) and (v[0] == v[1]).all() and not v[2].any() and not v[3].any()
    assert (hashed_grams(texts[[4]]).iloc[0] == v[4]).all() and abs(v[0]).sum() <= 7 and (v[5] == hashed_grams(pd.Series(["x y z"]))[0]).all()
    assert (v[0] != v[6]).any() and not len(hashed_grams(pd.Series([], dtype=object)))


@pytest.mark.parametrize("dies_at", ["chunks/run=0", "outcomes/run=0", "manifest/run=0"])
def test_a_run_that_breaks_off(spark, tmp_path, monkeypatch, dies_at):
    from pyspark.sql import DataFrameWriter

    lines = offsets(spark.createDataFrame([(v, 1, k, f"text {v} {k}." if v != 3 else "", None) for v in range(6) for k in range(4)], "version_id long, page long, line_no long, text string, heading string"))
    versions = spark.createDataFrame([(v, "pending" if v != 4 else "withdrawn") for v in range(6)], "version_id long, status string")
    index = lambda: I.index_run(f"{tmp_path}/i", 0, lines, versions, X.has_unresolved_glyph, X.looks_like_reference)
    write = DataFrameWriter.parquet

    def broken(self, path, *args, **kw):
        if path.endswith(dies_at):
            raise OSError("lost")
        return write(self, path, *args, **kw)

    monkeypatch.setattr(DataFrameWriter, "parquet", broken)
    with pytest.raises(OSError):
        index()
    monkeypatch.setattr(DataFrameWriter, "parquet", write)
    if dies_at == "manifest/run=0":  # all is there but for the manifest: nothing counts
        assert I.outcomes(spark, f"{tmp_path}/i").count() == 0 and I.indexed_chunks(spark, f"{tmp_path}/i").count() == 0
        assert I.broken_runs(spark, f"{tmp_path}/i") == [0]
    for _ in range(2):
        index()
        assert {(r["version_id"], r["error"]) for r in I.outcomes(spark, f"{tmp_path}/i").collect()} == {(0, None), (1, None), (2, None), (3, "no_text"), (5, None)}
        chunks = I.indexed_chunks(spark, f"{tmp_path}/i").collect()
        assert sorted(r["version_id"] for r in chunks) == [0, 1, 2, 5] and all(len(r["embedding"]) == 64 for r in chunks)
        assert {(r["version_id"], r["status"]) for r in I.activate(versions, f"{tmp_path}/i").collect()} == {(0, "active"), (1, "active"), (2, "active"), (3, "pending"), (4, "withdrawn"), (5, "active")}
    assert I.broken_runs(spark, f"{tmp_path}/i") == []


def test_lines_are_packed_once_for_chunks_and_outcome(spark):
    from pyspark.sql import functions as F

    from scriptorium.operators.layout import index_versions

    lines = spark.createDataFrame([(1, 1, 0, "a", None), (1, 2, 1, "b", None), (2, 1, 0, " ", None), (3, 1, 0, "c", None)], "version_id long, page long, line_no long, text string, heading string")
    versions = spark.createDataFrame([(1, "pending"), (2, "pending"), (3, "active")], "version_id long, status string")
    never = lambda c: F.lit(False)
    chunks, outcome = index_versions(lines, versions, never, never)
    assert {(r["version_id"], r["n_chunks"], r["error"]) for r in outcome.collect()} == {(1, 1, None), (2, 0, "no_text"), (3, 0, "not_pending")}
    assert [r["version_id"] for r in chunks.collect()] == [1]
    for df in (chunks, outcome):
        assert "MapInArrow" not in df._jdf.queryExecution().executedPlan().toString()
