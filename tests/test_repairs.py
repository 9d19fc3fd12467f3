"""Repairs, registration, export, evaluation and totals: literal cases."""

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from scriptorium.functions import text as X
from scriptorium.operators import audit as A
from scriptorium.operators import boq as B
from scriptorium.operators import citations as C
from scriptorium.operators import layout as Y
from scriptorium.operators import lifecycle as L
from scriptorium.operators import repair as R
from scriptorium.sources import files


def parts(path):
    return {p.parent.name: p.name for p in path.glob("*/*.parquet")}


def test_sectors_are_repaired_where_they_drifted(spark, tmp_path, monkeypatch):
    docs = spark.createDataFrame([(1, "007", "medical"), (2, "b", "legal"), (3, "b", None), (4, "c", "legal"), (5, None, "legal"), (6, "d", "legal")], "document_id long, issuing_org string, sector string")
    vocab = spark.createDataFrame([("007", None, "EU"), ("b", "medical", "EU"), ("d", "legal", "US")], "org string, sector string, region string")
    path = tmp_path / "docs"
    docs.repartition(1).write.partitionBy("issuing_org").parquet(str(path))
    before = parts(path)
    real = R.kept

    def broken(df, label):
        if label == "staged":
            raise OSError("lost")
        return real(df, label)

    monkeypatch.setattr(R, "kept", broken)
    with pytest.raises(OSError):
        R.repair_sectors(spark, str(path), docs.schema, vocab)
    assert parts(path) == before
    monkeypatch.setattr(R, "kept", real)
    assert R.repair_sectors(spark, str(path), docs.schema, vocab) == 1
    after = parts(path)
    assert {k for k in after if after[k] != before[k]} == {"issuing_org=b"}
    now = spark.read.schema(docs.schema).parquet(str(path))
    assert sorted((r["document_id"], r["issuing_org"], r["sector"]) for r in now.where("issuing_org is not null").collect()) == [(1, "007", "medical"), (2, "b", "medical"), (3, "b", None), (4, "c", "legal"), (6, "d", "legal")]
    assert now.count() == 6 and L.drift(now, vocab).where("state = 'drift'").count() == 0
    assert R.repair_sectors(spark, str(path), docs.schema, vocab) == 0 and parts(path) == after


def test_only_placeholders_are_repaired(spark, tmp_path):
    fake = "0123456789ab4def8123456789abcdef" + "0" * 32
    stored = spark.createDataFrame([(1, fake, 0), (2, fake, 0), (3, "a" * 64, 0), (4, "b" * 64, 1), (5, "c" * 64, 1)], "version_id long, file_hash string, bucket long")
    found = spark.createDataFrame([(1, "d" * 64), (3, "e" * 64), (4, "b" * 64)], "version_id long, file_hash string")
    path = str(tmp_path / "h")
    stored.write.partitionBy("bucket").parquet(path)
    made = X.is_placeholder_hash(F.col("file_hash"))
    state = lambda: [r["state"] for r in L.hash_state(spark.read.schema(stored.schema).parquet(path), found, made).orderBy("version_id").collect()]
    assert state() == ["placeholder", "file_missing", "CONTENT_CHANGED", "ok", "file_missing"]
    assert R.repair_hashes(spark, path, stored.schema, found, made, "bucket") == 1
    assert state() == ["ok", "file_missing", "CONTENT_CHANGED", "ok", "file_missing"]
    assert R.repair_hashes(spark, path, stored.schema, found, made, "bucket") == 0


def test_a_work_is_one_document(spark):
    schema = "clinic_id string, issuing_org string, title string"
    docs = spark.createDataFrame([(7, None, "a", "T"), (8, "c1", "a", "T")], f"document_id long, {schema}")
    vocab = spark.createDataFrame([("a", "legal", "EU"), ("b", None, "US")], "org string, sector string, region string")
    rows = [(None, "a", "T"), ("c1", "a", "T"), ("c2", "a", "T"), ("c2", "a", "T"), (None, "b", "T"), (None, "x", "T"), (None, "b", None)]
    incoming = spark.createDataFrame([(i, *r, "forged") for i, r in enumerate(rows)], f"seq long, {schema}, sector string")
    found, new = L.with_documents(incoming, docs, vocab)
    ids = [r["document_id"] for r in found.orderBy("seq").collect()]
    assert ids[:2] == ["7", "8"] and ids[2] == ids[3] and ids[5] is None and len(set(ids)) == 6
    assert sorted((r["document_id"], r["sector"], r["region"]) for r in new.collect()) == sorted([(ids[2], "legal", "EU"), (ids[4], "medical", "US"), (ids[6], "medical", "US")])
    # a second batch finds what the first made
    again, none = L.with_documents(incoming, docs.withColumn("document_id", F.col("document_id").cast("string")).unionByName(new.select("document_id", *schema.replace(" string", "").split(", "))), vocab)
    assert [r["document_id"] for r in again.orderBy("seq").collect()] == ids and none.count() == 0


def test_export_with_questions(spark):
    log = spark.createDataFrame([(1, "c", [10, 99], 1), (2, "c", [10], 2), (3, "c", [10], 3), (4, "d", [11], 1)], "seq long, clinic_id string, chunk_ids array<long>, query_id long")
    log = log.withColumns({"actor_id": F.lit("a"), "created_at": F.lit("2024-01-01").cast("timestamp"), "query_hash": F.when(F.col("seq") == 4, "other").otherwise(F.sha2(F.lit("saltwhy"), 256))})
    chunks = spark.createDataFrame([(10, "Take two\n a day."), (11, "x")], "chunk_id long, content string")
    quotes = spark.createDataFrame([(1, 10, "two a day"), (2, 10, "three a day"), (3, 98, "two"), (4, 11, "x")], "seq long, chunk_id long, quote string")
    verified = spark.createDataFrame([("c", True), ("d", False)], "clinic_id string, intact boolean")
    queries = spark.createDataFrame([(1, "why", "salt", None), (2, None, None, "2024-02-01")], "query_id long, text string, text_salt string, redacted_at string")
    rows = A.export(log, chunks, quotes, verified, queries).orderBy("seq").collect()
    assert [(r["missing"], r["gone"], r["changed"], r["evidential"]) for r in rows] == [([99], 0, 0, False), ([], 0, 1, False), ([], 1, 0, False), ([], 0, 0, False)]
    assert [(r["question"], r["redacted_at"], r["hash_verifiable"], r["hash_matches"]) for r in rows] == [("why", None, True, True), (None, "2024-02-01", False, None), (None, None, False, None), ("why", None, True, False)]
    assert "question" not in A.export(log, chunks, quotes, verified).columns
    assert A.export(log.where("seq = 1").withColumn("chunk_ids", F.array(F.lit(10).cast("long"))), chunks, quotes, verified).first()["evidential"] is True


def test_reasons_for_no_answer(spark):
    hits = spark.createDataFrame([(1, 10, 5, 1), (1, 11, 5, 2), (1, 12, 6, 13), (2, 10, 5, 1), (3, 10, 5, 1)], "query_id long, chunk_id long, version_id long, rank int")
    sel = spark.createDataFrame([(1, 1), (1, 2), (1, 13), (2, 0), (2, 5), (4, 1)], "query_id long, source int")
    asked = spark.createDataFrame([(i,) for i in (1, 2, 3, 4)], "query_id long")
    got = [tuple(r) for r in C.answer_reasons(sel, hits, asked).orderBy("query_id").collect()]
    assert got == [(1, 2, 1, 1, None), (2, 0, 0, 2, "sources_do_not_answer"), (3, 0, 0, 0, "sources_do_not_answer"), (4, 0, 0, 0, "no_relevant_sources")]


def test_the_passage_of_a_miscited_quote(spark):
    q = spark.createDataFrame([(1, "said  elsewhere", "not here", ["no", None, "was said elsewhere", "said elsewhere"]), (2, "not, here", "here it is not", []), (3, "...", "x", None)], "quote_id long, quote string, cited string, others array<string>")
    corpus = spark.createDataFrame([("x",)], "content string")
    got = [(r["verdict"], r["passage"], r["overlap"]) for r in C.diagnose(q, corpus).orderBy("quote_id").collect()]
    assert got == [("mis_cited", 3, 0.0), ("paraphrase", None, 1.0), ("paraphrase", None, 0.0)]


def test_rates_are_kept_apart(spark):
    schema = "id long, expect string, groups long, pages array<string>, expect_pages array<bigint>, error string, tags array<string>, rejected long, diagnoses array<struct<verdict: string, is_invention: boolean>>"
    rows = [
        (1, "answerable", 1, ["3"], [3], None, ["g"], 0, []),
        (2, "answerable", 1, ["4"], [3], None, None, 1, [("boundary", False)]),
        (3, "answerable", 0, [], None, None, ["x", "g"], 2, [("parametric_leak", True), ("boundary", False)]),
        (4, "answerable", 1, ["3"], [3], "timeout", ["g"], 1, [("synthesis", True)]),
        (5, "not_covered", 0, [], None, None, [], 0, None),
        (6, "withdrawn_source", 1, ["1"], None, None, [], 0, None),
    ]
    judged = C.verdict(spark.createDataFrame(rows, schema))
    got = {(r["expect"], r["measure"]): r["rate"] or r["total"] for r in C.rates(judged, "g").collect()}
    assert got == {
        ("answerable", "answered"): "2/3",
        ("answerable", "answered_off_source"): "1/2",
        ("answerable", "answered_with_g"): "1/2",
        ("answerable", "answered_without_g"): "1/1",
        ("not_covered", "correctly_declined"): "1/1",
        ("withdrawn_source", "correctly_declined"): "0/1",
        ("withdrawn_source", "leaked"): "1/1",
        ("rejected", "rejected"): 4,
        ("rejected", "inventions"): 2,
        ("rejected", "boundary"): 2,
        ("rejected", "parametric_leak"): 1,
        ("rejected", "synthesis"): 1,
    }
    assert C.rates(judged.limit(0), "g").where("rate = '0/0'").count() == 7


def test_printed_totals(spark):
    d = lambda x: None if x is None else Decimal(x)
    rows = [("f", "position", [], "1.00", None), ("f", "kg", ["a"], None, "30.01"), ("f", "position", ["a"], "10.00", None), ("f", "position", ["a"], None, None), ("f", "kg", ["a", "", "c"], None, None), ("f", "position", ["a", "", "c"], "20.00", None), ("f", "kg", ["b"], None, "5.00"), ("f", "entry", ["b"], "7.00", None)]
    e = spark.createDataFrame([(f, k, p, d(a), d(t)) for f, k, p, a, t in rows], "file_id string, kind string, kg array<string>, amount decimal(18,2), printed decimal(18,2)")
    got = {tuple(r["path"]): (r["level"], r["positions"], str(r["total"]), r["state"]) for r in B.group_totals(e).collect()}
    assert got == {(): (0, 4, "31.00", "not_printed"), ("a",): (1, 3, "30.00", "agrees"), ("a", "", "c"): (3, 1, "20.00", "not_printed"), ("b",): (1, 0, "0.00", "differs")}


def test_editions_without_text(spark):
    chars = spark.createDataFrame([(1, 1, 0, 0), (1, 2, 0, 0), (2, 1, 0, 0), (2, 2, 9, 0)], "version_id long, page long, n long, n_sideways long")
    assert [tuple(r) for r in Y.rejected(chars).orderBy("version_id").collect()] == [(1, 2, "no_text"), (2, 2, None)]


def test_questions_in_yaml(spark, tmp_path):
    pytest.importorskip("yaml")
    (tmp_path / "q.yaml").write_text("# set\nquestions:\n  - id: a\n    text: 'Was ist üblich?'\n    expect: answerable\n    expect_pages: [1, 2]\n    tags: [g]\n    odd: 1\n  - id: b\n    note: >\n      two\n      lines\n", encoding="utf-8")
    got = files.read_questions(spark, str(tmp_path / "q.yaml")).orderBy("id").collect()
    assert (got[0]["text"], got[0]["expect_pages"], got[0]["tags"]) == ("Was ist üblich?", [1, 2], ["g"])
    assert got[1]["text"] is None and got[1]["tags"] is None and got[1]["note"] == "two lines\n"
    (tmp_path / "bad.yml").write_text("- a\n")
    with pytest.raises(Exception, match="no list of questions"):
        files.read_questions(spark, str(tmp_path / "bad.yml")).collect()
