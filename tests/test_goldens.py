"""Small literal cases of the rules, sources and sinks."""

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from scriptorium.functions import numbers as N
from scriptorium.functions import text as X
from scriptorium.operators import audit as A
from scriptorium.operators import boq as B
from scriptorium.operators import citations as C
from scriptorium.operators import layout as Y
from scriptorium.operators import lifecycle as L
from scriptorium.operators import search as S
from scriptorium.sources import files, gaeb


def values(spark, f, rows):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i long, x string")
    return [r[0] for r in df.orderBy("i").select(f(F.col("x"))).collect()]


def test_decimals(spark):
    rows = ["1.234,56", "1,234.56", "1234,56", "1234.56", "€ 125,50", "10", "", None, "not a number", "1.180"]
    want = [Decimal(x) if x else None for x in ("1234.56", "1234.56", "1234.56", "1234.56", "125.50", "10", None, None, None, "1.180")]
    assert values(spark, N.parse_decimal, rows) == want
    assert values(spark, lambda x: N.parse_decimal(x, F.lit(".")), ["1.180"]) == [Decimal(1180)]
    assert values(spark, N.is_bad_number, rows) == [False] * 8 + [True, False]
    got = values(spark, N.quantity_and_unit, ["720 m2", "25m3", "1Ps...", "25", "", "x", "1.180 m"])
    assert [(r["value"] and float(r["value"]), r["unit"]) for r in got] == [(720, "m2"), (25, "m3"), (1, "Ps"), (25, ""), (None, ""), (None, ""), (1.18, "m")]


def test_references(spark):
    rows = ["91. Maber QX, Tolland RV. Title. Journal 2008;77:1", "See https://example.org", "Smith J et al found", "Patients may use implants (44) when needed.", "", "Prose\nmore prose\nMaber QX, x"]
    assert values(spark, X.looks_like_reference, rows) == [True, True, True, False, False, False]


def test_table_guard(spark):
    rows = ["ii. With aura 1", "Patients with obesity can use implants (U.S. MEC 1)", "Step 2", "CHC: 4", "500 000 34 865 41 530 1", "1 2 3", "prose line\nHypertension 3 4*", "Label — —", ""]
    assert values(spark, X.looks_like_headerless_row, rows) == [True, False, False, False, True, False, True, True, False]


def test_truncation_and_replacement(spark):
    assert values(spark, X.looks_truncated, ["Parent — ii. Systolic ≥160 mm Hg or", "Complete label", "Open (bracket", "Kosten und", "ends,", ""]) == [True, False, True, True, True, False]
    old = "ii. Systolic ≥160 mm Hg or — CHC: 4"
    new = ["Blood pressure — Systolic ≥160 mm Hg or diastolic ≥100 mm Hg — CHC: 4", "Systolic ≥160 mm Hg or diastolic — CHC: 3", old, "Systolic — CHC: 4", "no row"]
    assert values(spark, lambda x: X.row_replaces(F.lit(old), x), new) == [True, False, False, False, False]


def test_headings(spark):
    cases = [("1.2 Änderung der Leistung", 14.0, False), ("2.5 mg daily", 10.0, True), ("3 Body text", 10.0, False), ("3. Bold one", 10.0, True), ("4 " + "x" * 95, 14.0, True), ("25 000 3 120 3 657", 14.0, True), ("No number", 14.0, True)]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i long, t string, s double, b boolean")
    got = [r[0] for r in df.orderBy("i").select(X.heading(F.col("t"), F.col("s"), F.col("b"), F.lit(10.0))).collect()]
    assert got == ["1.2 Änderung der Leistung", None, None, "3 Bold one", None, None, None]


def test_normalising(spark):
    assert values(spark, X.normalise_quote, [" a\u00a0 b\n\tc ", "e\u0301", None]) == ["a b c", "é", None]
    assert values(spark, X.is_placeholder_hash, ["0123456789ab4def8123456789abcdef" + "0" * 32, "a" * 64, None]) == [True, False, False]
    assert values(spark, lambda x: X.rebase(x, "/data/corpus"), ["ab/x.pdf", "/srv/corpus/ab/x.pdf", "C:\\old\\corpus\\ab\\x.pdf", "/other/x.pdf"]) == ["/data/corpus/ab/x.pdf"] * 3 + ["/data/corpus/x.pdf"]
    assert values(spark, X.slug, ["My file (1).pdf", "???"]) == ["My-file-1-.pdf", "file"]


def test_statuses_and_tenants(spark):
    docs = spark.createDataFrame([(1, "medical", None), (2, "legal", "c1"), (3, "medical", "c2")], "document_id long, sector string, clinic_id string").withColumns({"title": F.lit("t"), "issuing_org": F.lit("o")})
    versions = spark.createDataFrame([(10, 1, "active"), (11, 1, "archived"), (12, 1, "pending"), (13, 1, "withdrawn"), (20, 2, "active")], "version_id long, document_id long, status string").withColumn("version_label", F.lit("v"))
    chunks = spark.createDataFrame([(v * 10 + k, v, k == 1, 5 if k == 2 else None) for v in (10, 11, 12, 13, 20) for k in range(3)], "chunk_id long, version_id long, is_reference boolean, superseded_by long")
    ids = lambda **k: sorted(r["chunk_id"] for r in S.searchable(chunks, versions, docs, "medical", **k).collect())
    assert ids() == [100] and ids(include_archived=True) == [100, 110]
    assert sorted(r["document_id"] for r in S.visible(docs, "c1").collect()) == [1, 2]
    for bad in ("", "a b", None):
        with pytest.raises(ValueError):
            S.visible(docs, bad)


def test_web_search(spark):
    rows = [(1, "acute asthma attack in children"), (2, "asthma in adults"), (3, "attack of acute asthma"), (4, "heart failure")]
    found = S.postings(spark.createDataFrame(rows, "chunk_id long, content string"))
    hits = lambda q: sorted(r[0] for r in S.websearch(found, q).collect())
    assert hits("acute asthma") == [1, 3]
    assert hits('"acute asthma" attack') == [1, 3]
    assert hits('"asthma attack"') == [1]
    assert hits("asthma -acute") == [2]
    assert hits("adults or heart") == [2, 4]
    assert hits("!!! ()") == hits("") == [] and hits('asthma & "acute') == [1, 3]


def test_supersession(spark):
    v = spark.createDataFrame([(1, 1, "active", None), (2, 1, "active", None), (3, 1, "pending", None), (4, 2, "active", None), (5, 1, "archived", 2), (6, 1, "active", None)], "version_id long, document_id long, status string, superseded_by long")
    r = spark.createDataFrame([(1, 1, 1), (2, 1, 4), (3, 5, 2), (4, 1, 5), (5, 1, 3), (6, 1, 2), (7, 1, 6), (8, 6, 1), (9, 1, 99)], "seq long, old long, new long")
    got = [x["reason"] for x in L.supersede(r, v).orderBy("seq").collect()]
    assert got == ["self", "other_document", "already_superseded", "successor_superseded", "successor_pending", None, "already_superseded", "successor_superseded", "unknown"]
    after = {x["version_id"]: (x["status"], x["superseded_by"]) for x in L.apply_supersession(v, L.supersede(r, v).where("reason is null")).collect()}
    assert after[1] == ("archived", 2) and after[2] == ("active", None)
    chain = spark.createDataFrame([(i, i + 1 if i < 60 else None) for i in range(61)] + [(100, 101), (101, 100)], "version_id long, superseded_by long")
    ends = {x["version_id"]: x["latest_id"] for x in L.latest_edition(chain).collect()}
    assert ends[60] == 60 and ends[10] == 60 and 9 not in ends and 100 not in ends
    assert {100, 101} <= {x[0] for x in L.cycles(chain).collect()}


def test_alias_load(spark):
    rows = [("", "x"), ("abc", " "), ("ABC", "x"), ("abc", "Abc"), ("ab", "x"), ("renitec", "enalapril"), ("renitec", "enalapril"), ("two", "a1"), ("two", "b1"), ("old", "same"), ("oldx", "other")]
    df = spark.createDataFrame([(i, a, g) for i, (a, g) in enumerate(rows)], "row_no long, alias string, generic_name string")
    have = spark.createDataFrame([("old", "same"), ("oldx", "mine")], "alias string, generic_name string")
    out = L.load_aliases(df, have, "registry")
    assert [r["outcome"] for r in out.orderBy("row_no").collect()] == ["rejected"] * 5 + ["inserted", "repeated", "contested", "contested", "unchanged", "conflict"]
    assert L.load_report(out).first()["accepted"] is False
    with pytest.raises(ValueError):
        L.load_aliases(df, have, " ")


def test_chain_notices_every_field(spark):
    log = spark.createDataFrame([(i, f"c{i % 2}", "a", [i, i + 1], None, "r") for i in range(6)], "seq long, clinic_id string, actor_id string, chunk_ids array<long>, error string, response string").withColumn("created_at", F.lit("2024-01-01 00:00:00").cast("timestamp"))
    none = log.select("clinic_id", F.lit("").alias("row_hash")).limit(0)
    rows = A.append_chain(log, none, A.ENTRY).cache()
    assert all(r["intact"] for r in A.verify_chain(rows, A.ENTRY).collect())
    more = A.append_chain(log.withColumn("seq", F.col("seq") + 10), rows.groupBy("clinic_id").agg(F.max_by("row_hash", "seq").alias("row_hash")), A.ENTRY)
    assert all(r["intact"] and r["entries"] == 6 for r in A.verify_chain(rows.unionByName(more), A.ENTRY).collect())
    changes = {"actor_id": F.lit("b"), "chunk_ids": F.reverse("chunk_ids"), "error": F.lit("e"), "response": F.lit("s"), "created_at": F.col("created_at") + F.expr("interval 1 second")}
    for c, v in changes.items():
        bad = {r["clinic_id"]: (r["first_broken"], r["reason"]) for r in A.verify_chain(rows.withColumn(c, F.when(F.col("seq") == 2, v).otherwise(F.col(c))), A.ENTRY).collect()}
        assert bad == {"c0": (2, "content"), "c1": (None, None)}
    assert {r["clinic_id"]: r["first_broken"] for r in A.verify_chain(rows.where("seq <> 3"), A.ENTRY).collect()} == {"c0": None, "c1": 5}
    assert {r["clinic_id"]: r["first_broken"] for r in A.verify_from(rows, A.ENTRY, 2).collect()} == {"c0": None, "c1": 2}


def test_quotes(spark):
    cited = "Patients should take 2.5 mg daily, unless told otherwise by their doctor."
    rows = [("take 2.5 mg daily", []), ("take 2.5\n mg  daily", []), ('"take 2.5 mg daily."', []), ("found in other passage", ["was found in other passage here"]), ("too short", []), ("words that the corpus holds elsewhere", []), ("nobody ever wrote such a sentence", []), ("should take 2.5 mg daily unless told otherwise by nobody", [])]
    q = spark.createDataFrame([(i, t, cited, o) for i, (t, o) in enumerate(rows)], "quote_id long, quote string, cited string, others array<string>")
    corpus = spark.createDataFrame([("some words that the corpus holds elsewhere indeed",), (cited,)], "content string")
    got = [r["verdict"] for r in C.diagnose(q, corpus).orderBy("quote_id").collect()]
    assert got == ["clean", "typography", "boundary", "mis_cited", "paraphrase", "synthesis", "parametric_leak", "paraphrase"]
    cites = spark.createDataFrame([(1, 1, "take  2.5 mg"), (1, 1, "take 25 mg"), (1, 2, "x"), (1, 1, " ")], "query_id long, chunk_id long, quote string")
    hits = spark.createDataFrame([(1, 1, cited)], "query_id long, chunk_id long, content string")
    assert sorted(str(r["reason"]) for r in C.validate(cites, hits).collect()) == ["None", "empty", "not_contained", "not_retrieved"]


def test_tables(spark):
    methods = ["Cu-IUD", "LNG-IUD", "Implant"]
    cells = [(1, 1, r, c, h, t) for r, row in enumerate([("Hypertension", "", "", ""), ("ii. Systolic", "1", "2", "4*"), ("Bad", "1", "x", "2")]) for c, (h, t) in enumerate(zip(["", *methods], row, strict=True))]
    df = spark.createDataFrame(cells, "version_id long, page long, row_no long, col_no long, header string, text string")
    assert [r["content"] for r in Y.describe_rows(df, methods).collect()] == ["Hypertension — Systolic — Cu-IUD: 1, LNG-IUD: 2, Implant: 4*"]
    fees = spark.createDataFrame([(1, 0, "500 000\n600 000", ["70 439 85 269\n155 461 188 190", "80 000 90 000\n1 2 3"])], "version_id long, row_no long, costs string, zones array<string>")
    assert [r["content"] for r in Y.fee_rows(fees).collect()] == ["Anrechenbare Kosten 500 000 — Honorarzone 1: 70 439 bis 85 269, Honorarzone 2: 80 000 bis 90 000"]
    flags = Y.page_flags(spark.createDataFrame([(1, 1, 60, 40), (1, 2, 60, 10), (1, 3, 40, 40), (1, 4, 0, 0)], "version_id long, page long, n long, n_sideways long"))
    assert [(r["rotated"], r["empty"]) for r in flags.orderBy("page").collect()] == [(True, False), (False, False), (False, False), (False, True)]


def test_grid_source(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("\ufeffPos;Kurztext;Menge;Einheit;Einheitspreis\n01.0010;Beton C25/30;12,5;m3;125,50\n\n01.0020;\"Stahl; gebogen\";3;Stk;10\n".encode())
    (tmp_path / "b.csv").write_bytes("Pos,Bezeichnung,Menge\n1,Tür,2\n".encode("latin-1"))
    found, rejects = B.positions_from_cells(files.read_grid(spark, f"{tmp_path}/*.csv"))
    got = sorted((r["oz"], r["short_text"], float(r["quantity"]), r["unit"]) for r in found.collect())
    assert got == [("01.0010", "Beton C25/30", 12.5, "m3"), ("01.0020", "Stahl; gebogen", 3.0, "Stk"), ("1", "Tür", 2.0, "")]
    assert rejects.count() == 0
    (tmp_path / "r.txt").write_text("\ufeffalias,generic_name\nrenitec,enalapril\n,\n", encoding="utf-8")
    assert [tuple(r) for r in files.read_registry(spark, str(tmp_path / "r.txt")).collect()] == [("renitec", "enalapril")]
    (tmp_path / "s.txt").write_text("alias\nx\n")
    with pytest.raises(ValueError, match="generic_name"):
        files.read_registry(spark, str(tmp_path / "s.txt"))


def test_xml_round_trip(spark, tmp_path):
    rows = [("f1", 1, "01", "Wall & <door>", "2.000", "m2", "3.5000", "T1"), ("f1", 2, "02", "Roof", "1.500", "St", "10.0000", "T2"), ("f2", 1, "01", "Flat", "1.000", "h", "5.0000", ""), ("f3", 1, "01", "Unpriced", "1.000", "h", None, "")]
    p = spark.createDataFrame([(f, n, oz, t, Decimal(q), u, Decimal(x) if x else None, s) for f, n, oz, t, q, u, x, s in rows], "file_id string, row_no long, oz string, short_text string, quantity decimal(18,3), unit string, unit_price decimal(18,4), section string")
    done, refused = gaeb.offers(p)
    assert [r["file_id"] for r in refused.collect()] == ["f3"]
    gaeb.write(done, str(tmp_path / "out"))
    back = gaeb.read(spark, f"{tmp_path}/out/*/*.txt").orderBy("file_id", "place").collect()
    assert [(r["section"], r["oz"], r["short_text"], str(r["quantity"]), r["unit"], float(r["unit_price"])) for r in back] == [("T1", "01", "Wall & <door>", "2.000", "m2", 3.5), ("T2", "02", "Roof", "1.500", "St", 10.0), ("", "01", "Flat", "1.000", "h", 5.0)]


def test_reports(spark, tmp_path):
    outcomes = spark.createDataFrame([("q1", "answered")], "id string, verdict string")
    files.write_report(outcomes.groupBy("verdict").count(), outcomes, str(tmp_path / "run"))
    assert files.read_report(spark, str(tmp_path / "run")).first()["id"] == "q1"
    (tmp_path / "q.jsonl").write_text('{"id": "a", "text": "t", "expect": "answerable", "expect_pages": [1, 2]}\n')
    assert files.read_questions(spark, str(tmp_path / "q.jsonl")).first()["expect_pages"] == [1, 2]


def test_phrases_are_asked_of_the_whole_corpus(spark):
    """Found in any text whatever the question's id, inside longer words too; no question is lost."""
    corpus = spark.createDataFrame([(8, "Plain words"), (9999, "ANTICOAGULANT therapy"), (5, None)], "version_id long, content string")
    asked = spark.createDataFrame([(1000, "coagul"), (2001, "Plain"), (2001, "Plain"), (3000, "absent"), (4000, None)], "query_id long, phrase string")
    got = sorted((r["query_id"], r["found"]) for r in C.exists_in(asked, corpus).collect())
    assert got == [(1000, True), (2001, True), (2001, True), (3000, False), (4000, None)]


def test_phrases_of_every_turn_have_a_row(spark):
    from scriptorium import plans

    sf = "/root/testdata/sf0.001"
    turns = spark.read.parquet(f"{sf}/conversations.parquet").where("role = 'user'").count()
    rows = plans.QUERIES["h5_exists_in_searchable"](spark, sf).collect()
    assert len(rows) == turns and sum(bool(r["found"]) for r in rows) > 0


def test_chain_is_a_stream_of_rows(spark):
    """No group becomes one row: a key with most of the rows is chained in order, from its stored tail, without collecting."""
    import hashlib

    n = 30_000
    log = spark.range(n).select(F.col("id").alias("seq"), F.when(F.col("id") % 10 == 0, F.concat(F.lit("c"), F.col("id") % 70)).otherwise("big").alias("clinic_id"), F.concat(F.lit("é"), F.col("id")).alias("response"))
    tails = spark.createDataFrame([("big", "f" * 64)], "clinic_id string, row_hash string")
    out = A.append_chain(log.repartition(7), tails, ["clinic_id", "response"])
    assert "collect_list" not in out._jdf.queryExecution().executedPlan().toString()
    rows = {r["seq"]: r for r in out.collect()}
    assert len(rows) == n
    last = {"big": "f" * 64}
    for i in range(n):
        k = rows[i]["clinic_id"]
        assert rows[i]["prev_hash"] == last.get(k, A.GENESIS)
        text = f'{{"clinic_id":"{k}","response":"é{i}"}}'
        last[k] = hashlib.sha256((rows[i]["prev_hash"] + text).encode()).hexdigest()
        assert rows[i]["row_hash"] == last[k]


def test_late_entries_are_chained(spark, tmp_path):
    """Two batches out of order: nothing is lost, and the chain in its own order is whole."""
    from scriptorium.streaming import jobs

    schema = "seq long, clinic_id string, response string"
    for batch, rows in enumerate([[(3, "a", "x"), (5, "a", "y")], [(1, "a", "late"), (4, "a", "late too"), (6, "b", "z")]]):
        spark.createDataFrame(rows, schema).write.mode("append" if batch else "overwrite").parquet(f"{tmp_path}/source")
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/source")
        jobs.append_chain_stream(stream, ["clinic_id", "response"], f"{tmp_path}/table", f"{tmp_path}/state").awaitTermination()
    rows = jobs.chain_entries(spark, f"{tmp_path}/table")
    assert [r["seq"] for r in rows.where("clinic_id = 'a'").orderBy("chain_no").collect()] == [3, 5, 1, 4] and rows.count() == 5
    log = rows.join(spark.read.schema(schema).parquet(f"{tmp_path}/source").select("seq", "response"), "seq")
    assert all(r["intact"] for r in A.verify_chain(log, ["clinic_id", "response"], order="chain_no").collect())


def test_a_batch_of_one_key_is_repeated_after_a_failure(spark, tmp_path, monkeypatch):
    """The second batch, all of one key, dies between entries and tails; run again, no entry is lost or doubled."""
    from pyspark.sql import DataFrameWriter

    from scriptorium.streaming import jobs

    fields, write = ["clinic_id", "response"], DataFrameWriter.parquet

    def start():
        stream = spark.readStream.schema("seq long, clinic_id string, response string").parquet(f"{tmp_path}/source")
        jobs.append_chain_stream(stream, fields, f"{tmp_path}/table", f"{tmp_path}/state").awaitTermination()

    def broken(self, path, *args, **kw):
        if path.endswith("tails/batch=1"):
            raise OSError("lost")
        return write(self, path, *args, **kw)

    made = lambda a, b: spark.range(a, b).select(F.col("id").alias("seq"), F.lit("big").alias("clinic_id"), F.col("id").cast("string").alias("response"))
    made(0, 50).write.parquet(f"{tmp_path}/source")
    start()
    made(50, 30_000).repartition(6).write.mode("append").parquet(f"{tmp_path}/source")
    monkeypatch.setattr(DataFrameWriter, "parquet", broken)
    with pytest.raises(Exception, match="lost"):
        start()
    monkeypatch.setattr(DataFrameWriter, "parquet", write)
    start()
    rows = jobs.chain_entries(spark, f"{tmp_path}/table")
    log = rows.join(spark.read.parquet(f"{tmp_path}/source").select("seq", "response"), "seq")
    [r] = A.verify_chain(log, fields, order="chain_no").collect()
    assert r["intact"] and r["entries"] == r["through_seq"] == 30_000


def test_long_aliases_match(spark):
    q = spark.createDataFrame([(1, "Dose of Low Molecular Weight Heparin today"), (2, "low weight"), (3, None)], "query_id long, text string")
    a = spark.createDataFrame([("low molecular weight heparin", "enoxaparin"), ("dose", "low weight")], "alias string, generic_name string")
    assert [r["expanded"] for r in S.expand_queries(q, a).orderBy("query_id").collect()] == ["Dose of Low Molecular Weight Heparin today enoxaparin low weight", "low weight", None]


def test_covers_of_any_number_of_terms(spark):
    found = S.postings(spark.createDataFrame([(1, "a b c x a"), (2, "a x x b x c"), (3, "a b")], "chunk_id long, content string"))
    q = spark.createDataFrame([(1, ["a", "b", "c"]), (2, ["a"]), (3, [])], "query_id long, terms array<string>")
    got = {(r["query_id"], r["chunk_id"]): r["cover"] for r in S.cover_density(S.match_all(found, q)).collect()}
    assert got == {(1, 1): round(1 / 3 + 1 / 4, 6), (1, 2): round(1 / 6, 6), (2, 1): 2.0, (2, 2): 1.0, (2, 3): 1.0}


def test_foreign_tender_xml(spark, tmp_path):
    """A file in the format's own nesting that the library didn't write: five levels, German numbers, markup in texts."""
    text = lambda tag, t: f"<{tag}><p><span>{t}</span></p></{tag}>"
    item = lambda no, t, qty, up: f'<Item {no}><Qty>{qty}</Qty><QU>m3</QU><Description><CompleteText><DetailTxt><Text><p><span>long</span></p></Text></DetailTxt><OutlineText><OutlTxt>{text("TextOutlTxt", t)}</OutlTxt></OutlineText></CompleteText></Description>{up}</Item>'
    inner = f"<Itemlist>{item('RNoPart=' + chr(34) + '7' + chr(34), 'Tief', '', '')}</Itemlist>"
    for label in ("", "Ebene 4", "", "Ebene 2"):
        inner = f"<BoQCtgy>{text('LblTx', label) if label else ''}<BoQBody>{inner}</BoQBody></BoQCtgy>"
    body = f'<BoQCtgy>{text("LblTx", "Erdarbeiten")}<BoQBody><Itemlist>{item("RNo=" + chr(34) + "5" + chr(34), "Aushub &amp; Abfuhr", "12,5", "<UP>1.003,50</UP>")}{item("", "Ohne", "1.200,25", "")}</Itemlist>{inner}</BoQBody></BoQCtgy>'
    (tmp_path / "a.x83").write_text(f'<?xml version="1.0"?><g:GAEB xmlns:g="urn:x">{body}</g:GAEB>', encoding="utf-8")
    (tmp_path / "b.x83").write_text("<GAEB", encoding="utf-8")
    (tmp_path / "c.x83").write_text("<Other/>", encoding="utf-8")
    got = [(r["place"], r["section"], r["oz"], r["short_text"], float(r["quantity"]), r["unit_price"] and float(r["unit_price"])) for r in gaeb.read(spark, f"{tmp_path}/*.x83").orderBy("place").collect()]
    assert got == [(1, "Erdarbeiten", "5", "long", 12.5, 1003.5), (2, "Erdarbeiten", "0020", "long", 1200.25, None), (3, "Ebene 4", "7", "long", 0.0, None)]
    assert sorted(r["error"].split(":")[0] for r in gaeb.rejects(spark, f"{tmp_path}/*.x83").collect()) == ["no XML", "root is Other"]


def test_cleaning_keeps_repeated_texts(spark):
    rows = [["Pos.", "Kurztext", "Menge", "Einheit", "EP", "Gesamt"], ["1", "Wall", "2", "m2", "3,00", "6,00"], ["", "wie vor", "", "", "", ""], ["Pos.", "Kurztext", "Menge", "Einheit", "EP", "Gesamt"], ["", "wie vor", "", "", "", ""], ["Seite 2 von 9"], ["5 20", "Gründung"], ["2", "Roof", "1", "St", "229.622,15273.250"], ["Büro", "Gesamt, Netto", "", "", "", "236,00"], ["Büro", "Gesamt, Netto", "", "", "", "236,00"]]
    cells = spark.createDataFrame([("f", n, k, t) for n, r in enumerate(rows) for k, t in enumerate(r)], "file_id string, row_no long, col_no long, text string")
    got = {r["row_no"]: r["row"] for r in B.clean_rows(B.grid(cells)).collect()}
    assert sorted(got) == [0, 1, 2, 4, 6, 7, 8]
    assert got[6] == ["520", "Gründung"] and got[7][4] == "229.622,15" and got[8] == ["", "Gesamt, Netto", "", "", "", "236,00"]


def test_refused_erasures_are_rows(spark):
    r = spark.createDataFrame([(1, "objection"), (2, "whim"), (3, None)], "query_id long, legal_basis string")
    assert sorted((x["query_id"], x["reason"]) for x in A.refused(r).collect()) == [(2, "legal_basis"), (3, "legal_basis")]


def test_ground_truth(spark):
    chunks = spark.createDataFrame([(1, 1, "Anticoagulant use", True), (2, 1, "other", False), (3, 1, "COAGULate", False), (4, 2, "coagul", True), (5, 1, "a-b c", True)], "chunk_id long, page long, content string, live boolean")
    q = spark.createDataFrame([(1, ["coagul", "anti"], [1]), (2, ["b c"], [1, 1]), (3, ["none"], [2])], "id long, terms array<string>, pages array<long>")
    assert sorted(tuple(r) for r in C.ground_truth(q, chunks).collect()) == [(1, 1, 1, True), (2, 1, 0, True), (3, 0, 0, False)]
