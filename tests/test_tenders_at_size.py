"""Tenders: no table of cells is worked out again for each thing that is asked of it."""

from pyspark.sql import functions as F

from scriptorium.functions.numbers import parse_decimal, quantity_and_unit
from scriptorium.operators import boq as B


def test_roles_read_a_profile_once(spark):
    import scriptorium.plans as plans

    plan = plans.QUERIES["l6_column_roles"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") <= 2  # the cells, and what their numbers say of separators


def test_roles_of_open_columns(spark):
    rows = [(1, 0, 0.0, 0.0, 1.0, 4.0), (1, 1, 0.1, 0.0, 0.0, 20.0), (1, 2, 0.1, 0.0, 0.0, 20.0), (1, 3, 0.9, 0.0, 0.0, 2.0), (1, 4, 0.0, 0.9, 0.0, 2.0), (1, 5, 0.9, 0.0, 0.6, 5.0), (1, 6, 0.9, 0.0, 0.0, 5.0), (2, 0, 0.9, 0.0, 0.0, 5.0)]
    p = spark.createDataFrame(rows, "file_id long, col_no long, numeric double, units double, positions double, mean_length double")
    got = B.infer_roles(p).select("file_id", "unit", "quantity", "short_text", "oz", "unit_price", "total").orderBy("file_id").collect()
    assert [tuple(r) for r in got] == [(1, 4, 3, 1, 0, 6, None), (2, None, None, None, None, None, None)]


def test_a_header_is_one_pattern(spark):
    field = B.header_field(F.col("t"))
    assert str(field).count("startswith") == 0
    labels = ["OZ", " Pos.-Nr. 3", "Preis/Einheit", "Gesamtpreis (EUR)", "EP gesamt", "Einheitspreis netto", "Einheit", "me", "Kurztext", "Zusatztext", "stück", "kg / oz", "(x", "", None, "Teil", "up total", "G-Preis", "No. 7", "DIN276"]
    df = spark.createDataFrame([(x,) for x in labels], "t string")

    def want(text):
        label = (text or "").strip(" ").lower()
        names = sorted(((n, i, f) for i, (f, ns) in enumerate(B.HEADERS.items()) for n in ns), key=lambda x: (-len(x[0]), x[1]))
        priced = any(w in label for w in B.TOTAL_WORDS.split("|"))
        return next((f for n, _, f in names if label.startswith(n) and not (priced and f == "unit_price")), None)

    assert [r[0] for r in df.select(field).collect()] == [want(x) for x in labels]


def test_words_are_no_quantities_whatever_follows(spark):
    cells = ["Position 12", "EUR 12,50", "€ 3", "E EUR 3", "  12 m2", "ÄEUR 4", "-3", "12Stk", "x", "3", None]
    df = spark.createDataFrame([(x,) for x in cells], "t string")
    got = [r[0] for r in df.select(quantity_and_unit(F.col("t"))["value"]).collect()]
    alone = [r[0] for r in df.select(parse_decimal(F.col("t"))).collect()]
    assert [None if g is None else float(g) for g in got] == [None, 12.5, 3, None, 12, None, -3, 12, None, 3, None]
    assert all(a is None or a == g for a, g in zip(alone, got))


def test_offers_deal_positions_before_they_are_written(spark):
    """The rows are shuffled once, as they are; XML is made behind that exchange and no file is joined to itself."""
    import scriptorium.plans as plans

    plan = plans.QUERIES["a6_priced_offers"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("lineitem.parquet") == 1 and plan.count("REPARTITION_BY_COL") == 1 and "LeftSemi" not in plan
    assert plan.count("Exchange hashpartitioning(file_id") == 1


def test_printed_totals_deal_files_once_to_as_many_tasks_as_rows_need(spark, monkeypatch):
    import re

    import scriptorium.plans as plans

    monkeypatch.setattr(B, "DEALT", 500)
    plan = plans.QUERIES["h14_printed_totals"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    rows = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").count()
    dealt = re.findall(r"Exchange hashpartitioning\(file_id#\d+L?, (\d+)\), REPARTITION_BY_NUM", plan)
    assert dealt and {int(n) for n in dealt} == {-(-rows // 500)} and plan.count("Exchange ") == len(dealt)


def test_cells_are_looked_at_one_by_one_only_where_a_row_asks_for_it(spark):
    """Rows that no pattern finds are cleaned without a look at their cells; those that one finds come out as they should."""
    rows = {
        1: ["Pos.", "Kurztext", "Menge", "Gesamtpreis"],
        2: ["01.0001", "Wand", "3,00", "12,50"],
        3: ["5 20", "Gr\u00fcndung", "", ""],
        4: ["", "goes on", "", ""],
        5: ["01.0002", "a\u0001b", "1", "100,00119,00"],
        6: ["", "Seite 2", "", ""],
        7: ["520\n", "x", "", ""],
        8: ["Pos.", "Kurztext", "Menge", "Gesamtpreis"],
        9: [" ", "", "\t", ""],
        10: [" ", "", "", ""],
    }
    cells = spark.createDataFrame([(1, r, c, t) for r, row in rows.items() for c, t in enumerate(row) if (r, c) != (4, 0)], "file_id long, row_no long, col_no long, text string")
    got = {r["row_no"]: (r["row"], r["words"]) for r in B.clean_rows(B.grid(cells)).collect()}
    assert got == {
        1: (rows[1], True),
        2: (rows[2], False),
        3: (["520", "Gr\u00fcndung", "", ""], False),
        4: (["", "goes on", "", ""], True),
        5: (["01.0002", "a\u0001b", "1", "100,00"], False),
        7: (["520", "x", "", ""], False),
        9: (["", "", "\t", ""], True),
    }
    plan = B.clean_rows(B.grid(cells))._jdf.queryExecution().optimizedPlan().toString()
    assert B.TWO_AMOUNTS in plan  # cells are netted behind a test of their row
