"""Queries on bills of quantities: orders as files, line items as their rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scriptorium.corpus import Corpus
from scriptorium.functions.numbers import is_bad_number, parse_decimal, quantity_and_unit
from scriptorium.functions.text import plain_number
from scriptorium.operators import boq as B
from scriptorium.plans.registry import query
from scriptorium.shared import kept

ITEMS = """items AS (SELECT l_orderkey AS file_id, l_linenumber AS row_no, CAST(l_quantity AS DECIMAL(18,3)) AS quantity, CASE WHEN l_orderkey % 11 <> 0 OR l_linenumber <> 1 THEN CAST((CAST(round(l_extendedprice * 100) AS BIGINT) // CAST(l_quantity AS BIGINT)) / 100.0 AS DECIMAL(18,4)) END AS unit_price,
  CASE WHEN l_orderkey % 3 <> 0 THEN CAST(l_extendedprice AS DECIMAL(18,2)) END AS source_total, p_brand AS section, p_name FROM lineitem JOIN part ON p_partkey = l_partkey)"""


def items(c: Corpus) -> DataFrame:
    total, quantity = F.col("l_extendedprice").cast("decimal(18,2)"), F.col("l_quantity").cast("decimal(18,3)")
    cents = F.floor(F.round(F.col("l_extendedprice") * 100) / F.floor("l_quantity"))
    price = (cents.cast("decimal(18,0)") / F.lit(100).cast("decimal(3,0)")).cast("decimal(18,4)")
    j = c.table("lineitem").join(c.table("part").select("p_partkey", "p_brand", "p_name"), F.col("l_partkey") == F.col("p_partkey"))
    return j.select(
        F.col("l_orderkey").alias("file_id"),
        F.col("l_linenumber").cast("long").alias("row_no"),
        quantity.alias("quantity"),
        F.when((F.col("l_orderkey") % 11 != 0) | (F.col("l_linenumber") != 1), price).alias("unit_price"),
        F.when(F.col("l_orderkey") % 3 != 0, total).alias("source_total"),
        F.col("p_brand").alias("section"),
        F.col("p_name"),
    )


_PRICED = """priced AS (SELECT *, CAST(round(quantity * unit_price, 2) AS DECIMAL(18,2)) AS product, coalesce(source_total, CAST(round(quantity * unit_price, 2) AS DECIMAL(18,2))) AS line_total FROM items)"""



@query("h11_totals", f"WITH {ITEMS}, {_PRICED} SELECT file_id, CAST(sum(coalesce(line_total, 0)) AS DECIMAL(38,2)) AS total, count(*) AS positions, bool_and(unit_price IS NOT NULL) AS priced FROM priced GROUP BY file_id")
def h11_totals(c: Corpus) -> DataFrame:
    return B.grand_totals(B.totals(items(c)))


@query("h12_disagreements", f"WITH {ITEMS}, {_PRICED} SELECT file_id, row_no, line_total FROM priced WHERE coalesce(abs(product - source_total) > 0.02, false)")
def h12_disagreements(c: Corpus) -> DataFrame:
    return B.totals(items(c)).where("disagrees").select("file_id", "row_no", "line_total")


@query("h13_sections", f"WITH {ITEMS} SELECT file_id, section, min(row_no) AS first_row, row_number() OVER (PARTITION BY file_id ORDER BY min(row_no), section) AS place FROM items GROUP BY file_id, section")
def h13_sections(c: Corpus) -> DataFrame:
    return B.first_seen_sections(items(c))


@query("h10_mode_width", "WITH w AS (SELECT l_orderkey AS file_id, l_linenumber AS row_no, sum(3 + l_partkey % 3) AS width FROM lineitem GROUP BY ALL), n AS (SELECT file_id, width, count(*) AS n, min(row_no) AS first FROM w GROUP BY ALL) SELECT file_id, width FROM (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY n DESC, first) AS k FROM n) WHERE k = 1")
def h10_mode_width(c: Corpus) -> DataFrame:
    rows = c.table("lineitem").select(F.col("l_orderkey").alias("file_id"), F.col("l_linenumber").alias("row_no"), F.explode(F.sequence(F.lit(1).cast("long"), 3 + F.col("l_partkey") % 3)).alias("col_no"))
    return B.mode_width(rows)


@query(
    "h14_cost_group_rollup",
    f"WITH {ITEMS}, {_PRICED} SELECT left(section, 7) AS g1, section AS g2, sum(line_total) AS total, grouping(left(section, 7)) + grouping(section) AS level FROM priced GROUP BY ROLLUP (left(section, 7), section)",
)
def h14_cost_group_rollup(c: Corpus) -> DataFrame:
    p = B.totals(items(c)).select(F.substring("section", 1, 7).alias("g1"), F.col("section").alias("g2"), "line_total")
    return p.rollup("g1", "g2").agg(F.sum("line_total").alias("total"), (F.grouping("g1").cast("long") + F.grouping("g2").cast("long")).alias("level")).select("g1", "g2", "total", "level")


_PART = "sum(CAST(l_extendedprice AS DECIMAL(18,2))) FILTER (l_returnflag {0})"


@query(
    "h14_printed_totals",
    f"""WITH o AS (SELECT l_orderkey AS file_id, {_PART.format(">= 'A'")} AS t, {_PART.format("IN ('A', 'R')")} AS ar, {_PART.format("= 'R'")} AS r, count(*) AS n, count(*) FILTER (l_returnflag IN ('A', 'R')) AS n_ar, count(*) FILTER (l_returnflag = 'R') AS n_r, bool_or(l_returnflag = 'A') AS a FROM lineitem GROUP BY l_orderkey),
p AS (SELECT file_id, '' AS path, 0 AS level, n AS positions, t AS total, NULL AS printed FROM o UNION ALL SELECT file_id, 'Order', 1, n, t, t + CASE WHEN file_id % 4 = 0 THEN 1 ELSE 0 END FROM o
UNION ALL SELECT file_id, 'Order/A', 2, n_ar, ar, ar - 0.01 FROM o WHERE a UNION ALL SELECT file_id, CASE WHEN a THEN 'Order/A/R' ELSE 'Order//R' END, 3, n_r, r, CASE WHEN file_id % 2 = 0 THEN r END FROM o WHERE n_r > 0)
SELECT file_id, path, level, positions, CAST(total AS DOUBLE) AS total, CAST(printed AS DOUBLE) AS printed, CASE WHEN printed IS NULL THEN 'not_printed' WHEN abs(printed - total) <= 0.02 THEN 'agrees' ELSE 'differs' END AS state FROM p""",
)
def h14_printed_totals(c: Corpus) -> DataFrame:
    """Every order as a tender of three levels of headings, of which one or two may be missing: kept items stand right under the order,
    accepted ones under A, returned ones under R, which is part of A where there is one.  Every fourth order's amount is wrong."""
    i = c.table("lineitem").select(F.col("l_orderkey").alias("file_id"), F.col("l_returnflag").alias("f"), F.col("l_extendedprice").cast("decimal(18,2)").alias("amount"))
    # files are dealt once, to as many tasks as their rows need; all that follows is by file and stays where it is
    i = i.repartition(-(-c.table("lineitem").count() // B.DEALT) or 1, "file_id")
    part = lambda *f: F.sum(F.when(F.col("f").isin(*f), F.col("amount")))
    o = i.groupBy("file_id").agg(F.sum("amount").alias("t"), part("A", "R").alias("ar"), part("R").alias("r"), F.bool_or(F.col("f") == "A").alias("a"))
    k = F.col("file_id")
    head = lambda rank, level, name, printed, there: F.when(there, F.struct(F.lit(rank).alias("rank"), F.lit(level).alias("level"), F.lit(name).alias("heading"), printed.cast("decimal(20,2)").alias("printed")))
    heads = F.array_compact(F.array(head(0, 1, "Order", F.col("t") + F.when(k % 4 == 0, 1).otherwise(0), F.lit(True)), head(2, 2, "A", F.col("ar") - F.lit("0.01").cast("decimal(3,2)"), F.col("a")), head(4, 3, "R", F.when(k % 2 == 0, F.col("r")), F.col("r").isNotNull())))
    heads = o.select("file_id", F.inline(heads)).withColumns({"kind": F.lit("kg"), "amount": F.lit(None).cast("decimal(18,2)")})
    place = F.when(F.col("f") == "A", 3).when(F.col("f") == "R", 5).otherwise(1)
    rows = i.select("file_id", place.alias("rank"), F.lit(None).cast("int").alias("level"), F.lit(None).cast("string").alias("heading"), F.lit(None).cast("decimal(20,2)").alias("printed"), F.lit("position").alias("kind"), "amount").unionByName(heads)
    rows = rows.withColumn("row_no", F.row_number().over(Window.partitionBy("file_id").orderBy("rank", "amount")))
    out = B.group_totals(B.cost_groups(rows, 3))
    return out.withColumns({"path": F.array_join("path", "/"), "total": F.col("total").cast("double"), "printed": F.col("printed").cast("double")})


# One order is a sheet: a header, then a row a line item, written German, English or undecided by the order's key.
_NUM = "CASE file_id % 3 WHEN 0 THEN replace(replace(replace(printf('%,.2f', {v}), ',', '#'), '.', ','), '#', '.') WHEN 1 THEN printf('%,.2f', {v}) ELSE CAST(CAST(floor({v}) AS BIGINT) AS VARCHAR) END"


def _number(v) -> object:
    english = F.format_number(v, 2)
    german = F.translate(english, ",.", ".,")
    k = F.col("file_id") % 3
    return F.when(k == 0, german).when(k == 1, english).otherwise(F.floor(v).cast("string"))


#: An order may repeat a line number: rows are numbered afresh.
ROW = "row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice)"


def numbered(c: Corpus) -> DataFrame:
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice")
    return c.table("lineitem").withColumn("row_no", F.row_number().over(w).cast("long")).withColumn("file_id", F.col("l_orderkey"))


def sheet(c: Corpus, headers: bool = True) -> DataFrame:
    """Cells: number, text, quantity, unit, unit price, total."""
    i = numbered(c).select("file_id", "row_no", "l_quantity", "l_extendedprice", "l_partkey")
    price = F.col("l_extendedprice") / F.col("l_quantity")
    unit = F.when(F.col("l_partkey") % 4 == 0, "m2").when(F.col("l_partkey") % 4 == 1, "Stk").when(F.col("l_partkey") % 4 == 2, "m³").otherwise("psch")
    body = [F.concat(F.lit("01."), F.lpad(F.col("row_no").cast("string"), 4, "0")), F.concat(F.lit("Position with text "), F.col("l_partkey").cast("string")), _number(F.col("l_quantity")), unit, _number(price), _number(F.col("l_extendedprice"))]
    rows = i.select("file_id", "row_no", F.posexplode(F.array(*body)).alias("col_no", "text"))
    if headers:
        head = i.select("file_id").distinct().select("file_id", F.lit(0).cast("long").alias("row_no"), F.posexplode(F.array(*[F.lit(x) for x in ("Pos.", "Kurztext", "Menge", "Einheit", "Einheitspreis (EUR)", "Gesamtpreis")])).alias("col_no", "text"))
        rows = rows.unionByName(head)
    return rows.select("file_id", "row_no", F.col("col_no").cast("long").alias("col_no"), "text")


@query(
    "l1_thousands_vote",
    f"""WITH n AS (SELECT l_orderkey AS file_id, unnest([l_quantity, l_extendedprice / l_quantity, l_extendedprice]) AS v FROM lineitem), t AS (SELECT file_id, {_NUM.format(v="v")} AS x FROM n),
v AS (SELECT file_id, count(*) FILTER (regexp_matches(x, '^\\d{{1,3}}(?:\\.\\d{{3}})+,\\d+$|^\\d+,\\d{{1,2}}$')) AS g, count(*) FILTER (regexp_matches(x, '^\\d{{1,3}}(?:,\\d{{3}})+\\.\\d+$|^\\d+\\.\\d{{1,2}}$')) AS e FROM t GROUP BY file_id) SELECT file_id, CASE WHEN g > e THEN '.' WHEN e > g THEN ',' END AS thousands FROM v""",
)
def l1_thousands_vote(c: Corpus) -> DataFrame:
    return B.separators(sheet(c))


@query(
    "l2_decimal_parse",
    "SELECT l_orderkey, l_linenumber, CAST(CASE WHEN l_orderkey % 5 = 3 THEN NULL ELSE CAST(l_extendedprice AS DECIMAL(18,2)) END AS DOUBLE) AS value, l_orderkey % 5 = 3 AS bad FROM lineitem",
)
def l2_decimal_parse(c: Corpus) -> DataFrame:
    english = F.format_number("l_extendedprice", 2)
    k = F.col("l_orderkey") % 5
    raw = F.when(k == 0, F.translate(english, ",.", ".,")).when(k == 1, english).when(k == 2, F.concat(F.lit("€ "), F.translate(english, ",.", ".,"))).when(k == 3, F.concat(F.lit("n/a "), english)).otherwise(F.concat(F.replace(english, F.lit(","), F.lit("")), F.lit(" EUR")))
    return c.table("lineitem").select("l_orderkey", "l_linenumber", parse_decimal(raw).cast("double").alias("value"), is_bad_number(raw).alias("bad"))


@query(
    "l3_quantity_unit",
    """SELECT l_orderkey, l_linenumber, CAST(l_quantity AS DOUBLE) AS value, CASE l_orderkey % 4 WHEN 0 THEN 'm2' WHEN 1 THEN '' WHEN 2 THEN 'Stk' ELSE 'Ps' END AS unit FROM lineitem""",
)
def l3_quantity_unit(c: Corpus) -> DataFrame:
    q = F.floor("l_quantity").cast("string")
    k = F.col("l_orderkey") % 4
    cell = F.when(k == 0, F.concat(q, F.lit(" m2"))).when(k == 1, q).when(k == 2, F.concat(q, F.lit("Stk"))).otherwise(F.concat(q, F.lit("Ps...")))
    x = quantity_and_unit(cell)
    return c.table("lineitem").select("l_orderkey", "l_linenumber", x["value"].cast("double").alias("value"), x["unit"].alias("unit"))


@query(
    "l4_header_mapping",
    "SELECT DISTINCT l_orderkey AS file_id, f.field, CAST(f.col_no AS BIGINT) AS col_no FROM lineitem, (VALUES ('oz', 0), ('short_text', 1), ('quantity', 2), ('unit', 3), ('unit_price', 4), ('total', 5)) f(field, col_no)",
)
def l4_header_mapping(c: Corpus) -> DataFrame:
    return B.map_header(sheet(c).where("row_no = 0")).select("file_id", "field", "col_no")


_SHEET = f"""rows AS (SELECT l_orderkey AS file_id, row_no, l_quantity, l_extendedprice, l_partkey, l_extendedprice / l_quantity AS price FROM (SELECT *, {ROW} AS row_no FROM lineitem)),
cells AS (SELECT file_id, row_no, unnest(range(0, 6)) AS col_no, unnest(['01.' || lpad(CAST(row_no AS VARCHAR), 4, '0'), 'Position with text ' || l_partkey, {_NUM.format(v="l_quantity")}, CASE l_partkey % 4 WHEN 0 THEN 'm2' WHEN 1 THEN 'Stk' WHEN 2 THEN 'm³' ELSE 'psch' END, {_NUM.format(v="price")}, {_NUM.format(v="l_extendedprice")}]) AS text FROM rows),
files AS (SELECT DISTINCT file_id FROM rows),
head AS (SELECT file_id, 0 AS row_no, unnest(range(0, 6)) AS col_no, unnest(['Pos.', 'Kurztext', 'Menge', 'Einheit', 'Einheitspreis (EUR)', 'Gesamtpreis']) AS text FROM files)"""
#: A column of numbers is numeric where its cells don't read like a position's number.
_PROFILE = f"""WITH {_SHEET} SELECT file_id, CAST(col_no AS BIGINT) AS col_no, count(*) AS filled, round(avg(CASE WHEN col_no IN (2, 4, 5) AND NOT regexp_matches(text, '^\\d+(?:[.\\-/]\\d+)+$') THEN 1.0 ELSE 0.0 END), 6) AS numeric,
  round(avg(CASE WHEN col_no = 3 THEN 1.0 ELSE 0.0 END), 6) AS units, round(avg(CASE WHEN regexp_matches(text, '^\\d+(?:[.\\-/]\\d+)+$') THEN 1.0 ELSE 0.0 END), 6) AS positions, round(avg(length(text)), 6) AS mean_length FROM cells GROUP BY file_id, col_no"""


@query("l5_column_profile", _PROFILE)
def l5_column_profile(c: Corpus) -> DataFrame:
    cells = sheet(c, headers=False)
    return B.profile(cells, B.separators(cells))


@query(
    "l6_column_roles",
    """WITH a AS (SELECT l_orderkey AS file_id, l_orderkey % 3 <> 1 OR avg(CASE WHEN round(l_extendedprice / l_quantity, 2) >= 1000 THEN 1.0 ELSE 0 END) > 0.5 AS price, l_orderkey % 3 <> 1 OR avg(CASE WHEN l_extendedprice >= 1000 THEN 1.0 ELSE 0 END) > 0.5 AS total FROM lineitem GROUP BY l_orderkey)
SELECT file_id, CAST(3 AS BIGINT) AS unit, CAST(1 AS BIGINT) AS short_text, CAST(CASE WHEN file_id % 3 <> 1 THEN 2 END AS BIGINT) AS quantity, CAST(0 AS BIGINT) AS oz, CAST(CASE WHEN price THEN 4 WHEN total THEN 5 END AS BIGINT) AS unit_price, CAST(CASE WHEN price AND total THEN 5 END AS BIGINT) AS total FROM a""",
)
def l6_column_roles(c: Corpus) -> DataFrame:
    """Without a header an English amount under a thousand, such as 17.00, reads like a position's number; a column of them is none of numbers."""
    cells = sheet(c, headers=False)
    return B.infer_roles(B.profile(cells, B.separators(cells)))


_AGREE = """numbers AS (SELECT l_orderkey AS file_id, l_linenumber AS row_no, l_quantity AS quantity, unnest([4, 5, 6]) AS col_no, unnest([round(l_extendedprice / l_quantity, 2), p_retailprice, l_extendedprice]) AS value FROM lineitem JOIN part ON p_partkey = l_partkey),
pairs AS (SELECT a.file_id, a.col_no AS price_col, b.col_no AS total_col, round(avg(CASE WHEN abs(CAST(round(a.quantity * a.value * 10000) AS BIGINT) - CAST(round(b.value * 10000) AS BIGINT)) <= 200 THEN 1.0 ELSE 0.0 END), 6) AS share, count(*) AS rows FROM numbers a JOIN numbers b USING (file_id, row_no) WHERE a.col_no <> b.col_no GROUP BY ALL)"""


def numbers(c: Corpus) -> DataFrame:
    j = c.table("lineitem").join(c.table("part").select("p_partkey", "p_retailprice"), F.col("l_partkey") == F.col("p_partkey"))
    price = F.round(F.col("l_extendedprice") / F.col("l_quantity"), 2)
    return j.select(F.col("l_orderkey").alias("file_id"), F.col("l_linenumber").alias("row_no"), F.col("l_quantity").cast("decimal(18,2)").alias("quantity"), F.posexplode(F.array(price, F.col("p_retailprice"), F.col("l_extendedprice"))).alias("i", "v")).select("file_id", "row_no", "quantity", (F.col("i") + 4).cast("long").alias("col_no"), F.col("v").cast("decimal(18,2)").alias("value"))


@query("l7_column_agreement", f"WITH {_AGREE} SELECT file_id, price_col, total_col, share FROM (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY share DESC, price_col, total_col) AS k FROM pairs) WHERE k = 1 AND share >= 0.8")
def l7_column_agreement(c: Corpus) -> DataFrame:
    return B.price_columns(B.agreement(numbers(c)))


@query(
    "l8_grid_cleaning",
    f"""WITH {_SHEET} SELECT file_id, row_no, col_no, text FROM cells UNION ALL SELECT * FROM head UNION ALL SELECT file_id, 800, unnest([0, 1]), unnest(['520', 'Gründung']) FROM files""",
)
def l8_grid_cleaning(c: Corpus) -> DataFrame:
    """Every sheet with a page mark, its header twice, a cost group's number with a gap and, in German, gross amounts run into net ones."""
    cells = sheet(c)
    net = parse_decimal(F.col("text"), F.lit(".")).cast("double")
    glued = F.concat("text", F.translate(F.format_number(net * 1.19, 2), ",.", ".,"))
    cells = cells.withColumn("text", F.when((F.col("file_id") % 3 == 0) & (F.col("col_no") == 5) & (F.col("row_no") > 0), glued).otherwise(F.col("text")))
    again = cells.where("row_no = 0").withColumn("row_no", F.lit(1003).cast("long"))
    mark = cells.where("row_no = 0 and col_no = 0").withColumns({"row_no": F.lit(900).cast("long"), "text": F.lit("Seite 2 von 9")})
    group = cells.where("row_no = 0 and col_no < 2").withColumns({"row_no": F.lit(800).cast("long"), "text": F.when(F.col("col_no") == 0, "5 20").otherwise("Gründung")})
    return B.clean(cells.unionByName(again).unionByName(mark).unionByName(group))


_ENTRIES = f"""WITH {_SHEET}, e AS (SELECT file_id, row_no, 'position' AS kind, '01.' || lpad(CAST(row_no AS VARCHAR), 4, '0') AS oz, 'Position with text ' || l_partkey AS short_text, CASE WHEN row_no % 3 = 0 THEN 'goes on' END AS long_text, CAST(l_quantity AS DOUBLE) AS quantity,
  CASE l_partkey % 4 WHEN 0 THEN 'm2' WHEN 1 THEN 'Stk' WHEN 2 THEN 'm³' ELSE 'psch' END AS unit, CASE WHEN file_id % 3 = 2 THEN floor(price) ELSE CAST(printf('%.2f', price) AS DOUBLE) END AS unit_price, CASE WHEN file_id % 3 = 2 THEN floor(l_extendedprice) ELSE l_extendedprice END AS source_total FROM rows)"""


def _long_sheet(c: Corpus) -> DataFrame:
    """Sheets whose rows stand ten apart, with a heading of a cost group before the second and text that goes on after every third."""
    cells = sheet(c).withColumn("row_no", F.col("row_no") * 10)
    group = cells.where("row_no = 10 and col_no < 2").withColumns({"row_no": F.lit(15).cast("long"), "text": F.when(F.col("col_no") == 0, "520").otherwise("Gründung")})
    more = cells.where("row_no > 0 and row_no % 30 = 0 and col_no = 1").withColumns({"row_no": F.col("row_no") + 1, "text": F.lit("goes on")})
    return cells.unionByName(group).unionByName(more)


@query(
    "l9_positions",
    f"""{_ENTRIES} SELECT file_id, row_no * 10 AS row_no, kind, oz, short_text, long_text, quantity, unit, unit_price, source_total, CASE WHEN row_no > 1 THEN '/520 Gründung' ELSE '' END AS kg FROM e
UNION ALL SELECT file_id, 15, 'kg', '520', 'Gründung', NULL, NULL, NULL, NULL, NULL, '/520 Gründung' FROM files""",
)
def l9_positions(c: Corpus) -> DataFrame:
    found, _ = B.entries_from_cells(_long_sheet(c))
    number = [F.col(n).cast("double").alias(n) for n in ("quantity", "unit_price", "source_total")]
    return found.select("file_id", "row_no", "kind", "oz", "short_text", "long_text", "unit", *number, F.array_join("kg", "/").alias("kg"))


@query("l10_header_search", "SELECT DISTINCT l_orderkey AS file_id, CAST(CASE WHEN l_orderkey % 2 = 0 THEN 0 END AS BIGINT) AS head FROM lineitem WHERE l_orderkey % 2 = 0 OR l_orderkey % 3 <> 1")
def l10_header_search(c: Corpus) -> DataFrame:
    """Half of the sheets have no header, and every fourth a title row that names columns under which no quantity follows."""
    cells = sheet(c)
    title = cells.where("file_id % 4 = 0 and row_no = 0 and col_no < 2").withColumns({"row_no": F.lit(-1).cast("long"), "text": F.when(F.col("col_no") == 0, "Bezeichnung").otherwise("Menge")})
    cells = cells.where("file_id % 2 = 0 or row_no > 0").unionByName(title)
    return B.columns(kept(B.clean_rows(B.grid(cells)), "grid")).select("file_id", "head")


@query("l11_edited_rows", "SELECT l_orderkey AS file_id, CAST(l_linenumber AS BIGINT) AS row_no, CASE l_linenumber WHEN 1 THEN NULL WHEN 2 THEN 'row 2: quantity is not a number' WHEN 3 THEN 'row 3: price is not a number' WHEN 4 THEN 'row 4: no text' END AS error FROM lineitem")
def l11_edited_rows(c: Corpus) -> DataFrame:
    n = F.col("l_linenumber")
    rows = c.table("lineitem").select(
        F.col("l_orderkey").alias("file_id"),
        n.cast("long").alias("row_no"),
        F.when(n == 4, " ").otherwise("text").alias("short_text"),
        F.when(n == 2, "viel").otherwise(F.concat(F.floor("l_quantity").cast("string"), F.lit(" m2"))).alias("quantity_text"),
        F.when(n == 3, "teuer").when(n == 5, "").otherwise("12,50").alias("unit_price_text"),
    )
    return B.check_edits(rows).select("file_id", "row_no", "error")


_LEVELS = """g AS (SELECT l_orderkey % 500 AS file_id, row_number() OVER (PARTITION BY l_orderkey % 500 ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice) AS row_no, CASE WHEN l_partkey % 5 BETWEEN 1 AND 3 THEN l_partkey % 5 END AS level, 'H' || l_partkey AS heading FROM lineitem)"""


@query(
    "i6_cost_group_path",
    f"""WITH {_LEVELS}, l AS (SELECT *, max(row_no) FILTER (level = 1) OVER w AS r1, max(row_no) FILTER (level = 2) OVER w AS r2, max(row_no) FILTER (level = 3) OVER w AS r3 FROM g WINDOW w AS (PARTITION BY file_id ORDER BY row_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
n AS (SELECT l.file_id, l.row_no, h1.heading AS a, CASE WHEN l.r2 > coalesce(l.r1, -1) THEN h2.heading END AS b, CASE WHEN l.r3 > greatest(coalesce(l.r1, -1), coalesce(l.r2, -1)) THEN h3.heading END AS c FROM l LEFT JOIN g h1 ON h1.file_id = l.file_id AND h1.row_no = l.r1 LEFT JOIN g h2 ON h2.file_id = l.file_id AND h2.row_no = l.r2 LEFT JOIN g h3 ON h3.file_id = l.file_id AND h3.row_no = l.r3)
SELECT file_id, row_no, CASE WHEN c IS NOT NULL THEN coalesce(a, '') || '/' || coalesce(b, '') || '/' || c WHEN b IS NOT NULL THEN coalesce(a, '') || '/' || b ELSE coalesce(a, '') END AS kg FROM n""",
)
def i6_cost_group_path(c: Corpus) -> DataFrame:
    f = F.col("l_orderkey") % 500
    n = F.row_number().over(Window.partitionBy(f).orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice"))
    k = F.col("l_partkey") % 5
    rows = c.table("lineitem").select(f.alias("file_id"), n.alias("row_no"), F.when((k < 4) & (k > 0), k).alias("level"), F.concat(F.lit("H"), "l_partkey").alias("heading"))
    return B.cost_groups(rows, 3).select("file_id", "row_no", F.array_join("kg", "/").alias("kg"))


@query(
    "i7_continuation_folding",
    f"""WITH r AS (SELECT l_orderkey AS file_id, row_no, row_no % 3 = 1 AS pos, 'T' || l_partkey AS text FROM (SELECT *, {ROW} AS row_no FROM lineitem)), i AS (SELECT *, count(*) FILTER (pos) OVER (PARTITION BY file_id ORDER BY row_no) AS island FROM r)
SELECT file_id, CAST(min(row_no) AS BIGINT) AS row_no, max(text) FILTER (pos) AS short_text, coalesce(string_agg(text, chr(10) ORDER BY row_no) FILTER (NOT pos), '') AS long_text FROM i WHERE island > 0 GROUP BY file_id, island""",
)
def i7_continuation_folding(c: Corpus) -> DataFrame:
    n = F.col("row_no")
    rows = numbered(c).select("file_id", "row_no", (n % 3 == 1).alias("is_position"), F.concat(F.lit("T"), "l_partkey").alias("text"))
    return B.fold_continuations(rows).select("file_id", "row_no", "short_text", "long_text")


@query("i8_first_by_signature", f"SELECT file_id, row_no FROM (SELECT l_orderkey AS file_id, row_no, row_number() OVER (PARTITION BY l_orderkey, l_shipdate, l_returnflag ORDER BY row_no) AS k, l_returnflag FROM (SELECT *, {ROW} AS row_no FROM lineitem)) WHERE k = 1 OR l_returnflag = 'N'")
def i8_first_by_signature(c: Corpus) -> DataFrame:
    rows = numbered(c).select("file_id", "row_no", "l_shipdate", "l_returnflag")
    return B.first_by_signature(rows, F.when(F.col("l_returnflag") != "N", F.concat_ws("|", "l_shipdate", "l_returnflag"))).select("file_id", "row_no")


@query("s_plain_numbers", "SELECT l_orderkey, l_linenumber, regexp_replace(regexp_replace(CAST(CAST(l_extendedprice AS DECIMAL(18,3)) AS VARCHAR), '0+$', ''), '\\.$', '') AS plain FROM lineitem")
def s_plain_numbers(c: Corpus) -> DataFrame:
    return c.table("lineitem").select("l_orderkey", "l_linenumber", plain_number(F.col("l_extendedprice").cast("decimal(18,3)")).alias("plain"))
