"""Bills of quantities as long tables of cells (file_id, row_no, col_no, text): columns, positions, groups, totals."""

from __future__ import annotations

import functools
import operator
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scriptorium.functions.numbers import UNIT_TOKENS, parse_decimal, quantity_and_unit, thousands_vote
from scriptorium.shared import kept

# Header labels of each field, and words that make a label a sum.
HEADERS = {
    "oz": ["oz", "o.z", "ordnungszahl", "positionsnummer", "positions-nr", "pos.-nr", "pos-nr", "pos.nr", "position", "pos", "nummer", "nr", "lfd", "item", "no.", "no", "kg / oz", "kg/oz", "kg oz", "oz / kg", "kg"],
    "short_text": ["kurztext", "bezeichnung", "beschreibung", "leistungsbeschreibung", "leistung", "leistungstext", "positionstext", "artikel", "benennung", "text", "description", "title", "gegenstand", "din 276", "din276", "din", "quelleinträge", "quelleintrag", "quelleintraege"],
    "quantity": ["menge", "mengenansatz", "vordersatz", "anzahl", "stück", "stueck", "qty", "quantity", "masse", "umfang"],
    "unit": ["einheit", "mengeneinheit", "mengen-einheit", "me", "m.e", "eh", "unit", "qu", "einh"],
    "unit_price": ["einheitspreis", "einheits-preis", "einzelpreis", "e-preis", "ep", "up", "preis/einheit", "preis", "unitprice", "unit price", "netto", "angebotspreis"],
    "teilbetrag": ["teilbetrag", "teil-betrag", "teilsumme", "anteil", "partial"],
    "long_text": ["langtext", "detailtext", "spezifikation", "long text", "zusatztext"],
    "section": ["titel", "los", "gruppe", "gewerk", "abschnitt", "section", "kapitel"],
    "total": ["gesamtpreis", "gesamtbetrag", "gesamtsumme", "gesamt", "gp", "g-preis", "summe", "betrag", "endpreis", "total", "line total", "positionssumme"],
}
TOTAL_WORDS = "gesamt|summe|brutto|total|betrag|endpreis"
POSITION_NUMBER = r"^\d+(?:[.\-/]\d+)+$"
AGREEMENT, TOLERANCE = 0.8, 0.02
#: Rows of files that a task is dealt, about.
DEALT = 250_000


def separators(cells: DataFrame) -> DataFrame:
    """(file_id, thousands): what each file's unambiguous numbers say."""
    return cells.groupBy("file_id").agg(thousands_vote(F.col("text")).alias("thousands"))


def header_field(text: Column) -> Column:
    """The field of the longest label that a cell equals or begins with, of equals the one named first; null for none.

    A label of a sum is never a unit price.  The names are a fixed list, so they are one pattern, longest first.
    """
    names = sorted(((n, i, f) for i, (f, ns) in enumerate(HEADERS.items()) for n in ns), key=lambda x: (-len(x[0]), x[1]))

    def field(label: Column, some: list[tuple[str, int, str]]) -> Column:
        """The field of the first of some names that label begins with."""
        of: dict[str, str] = {}
        for name, _, f in some:
            of.setdefault(name, f)
        known = F.create_map(*[F.lit(x) for pair in of.items() for x in pair])
        return F.try_element_at(known, F.nullif(F.regexp_extract(label, "^(?:" + "|".join(map(re.escape, of)) + ")", 0), F.lit("")))

    label = F.lower(F.trim(text))
    # most cells begin like no name
    first = "^[" + "".join(sorted({re.escape(n[0]) for n, _, _ in names})) + "]"
    return F.when(label.rlike(first), _let(label, lambda x: F.when(x.rlike(TOTAL_WORDS), field(x, [n for n in names if n[2] != "unit_price"])).otherwise(field(x, names))))


def map_header(cells: DataFrame) -> DataFrame:
    """(file_id, row_no, field, col_no): the field each cell names; the first column wins a field."""
    named = cells.select("file_id", "row_no", "col_no", header_field(F.col("text")).alias("field")).where(F.col("field").isNotNull())
    return named.groupBy("file_id", "row_no", "field").agg(F.min("col_no").alias("col_no"))


def header_rows(cells: DataFrame) -> DataFrame:
    """(file_id, row_no): the first row that names a text and a quantity column."""
    field = header_field(F.col("text"))
    m = cells.groupBy("file_id", "row_no").agg(F.bool_or(field == "short_text").alias("t"), F.bool_or(field == "quantity").alias("q")).where("t and q")
    return m.groupBy("file_id").agg(F.min("row_no").alias("row_no"))


def profile(cells: DataFrame, thousands: DataFrame) -> DataFrame:
    """Per column: filled cells, shares of numbers, units and position numbers, mean length."""
    x = F.trim("text")
    number = quantity_and_unit(x, F.col("thousands"))["value"]
    c = cells.join(thousands, "file_id").where(x != "")
    share = lambda flag: F.round(F.avg(F.when(flag, 1.0).otherwise(0.0)), 6)
    return c.groupBy("file_id", "col_no").agg(
        F.count(F.lit(1)).alias("filled"),
        share(number.isNotNull() & ~x.rlike(POSITION_NUMBER)).alias("numeric"),
        share(F.regexp_replace(F.lower(x), r"\.+$", "").isin(UNIT_TOKENS)).alias("units"),
        share(x.rlike(POSITION_NUMBER)).alias("positions"),
        F.round(F.avg(F.length(x)), 6).alias("mean_length"),
    )


def infer_roles(profiles: DataFrame) -> DataFrame:
    """(file_id, unit, quantity, short_text, oz, unit_price, total) as columns' numbers, from content alone.

    The unit column is over half units; the text is the longest prose; the quantity is the last numeric column before
    the unit; what numbers positions stands left of the text; the first and second numeric columns after the unit are
    the price and the total.  A file's columns are few and stand in one row.
    """
    own = profiles.groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct("col_no", "numeric", "units", "positions", "mean_length"))).alias("p"))
    cols = lambda test: F.transform(F.filter("p", test), lambda x: x["col_no"])
    numeric = lambda x: (x["numeric"] >= 0.5) & (x["positions"] < 0.5)
    prose = F.filter("p", lambda x: (x["numeric"] < 0.5) & (x["units"] < 0.5))
    text = F.array_max(F.transform(prose, lambda x: F.struct(x["mean_length"].alias("m"), (-x["col_no"]).alias("c"))))
    own = _settled(own, unit=F.array_min(cols(lambda x: x["units"] >= 0.5)), short_text=-text["c"])
    after = cols(lambda x: numeric(x) & (x["col_no"] > F.col("unit")))
    return own.select(
        "file_id",
        "unit",
        "short_text",
        F.array_max(cols(lambda x: numeric(x) & (x["col_no"] < F.col("unit")))).alias("quantity"),
        F.array_min(cols(lambda x: ((x["positions"] >= 0.5) | (x["numeric"] >= 0.5)) & (x["col_no"] < F.col("short_text")))).alias("oz"),
        F.get(after, F.lit(0)).alias("unit_price"),
        F.get(after, F.lit(1)).alias("total"),
    )


def agreement(numbers: DataFrame) -> DataFrame:
    """numbers (file_id, row_no, col_no, value, quantity): for each ordered pair of columns, the share of rows where
    quantity x price is the total.  A file has a handful of columns, so pairs are few."""
    a = numbers.select("file_id", "row_no", "quantity", F.col("col_no").alias("price_col"), F.col("value").alias("price"))
    b = numbers.select("file_id", "row_no", F.col("col_no").alias("total_col"), F.col("value").alias("total"))
    pairs = a.join(b, ["file_id", "row_no"]).where("price_col <> total_col")
    ok = F.abs(F.col("quantity") * F.col("price") - F.col("total")) <= TOLERANCE
    return pairs.groupBy("file_id", "price_col", "total_col").agg(F.round(F.avg(F.when(ok, 1.0).otherwise(0.0)), 6).alias("share"), F.count(F.lit(1)).alias("rows"))


def price_columns(agreed: DataFrame) -> DataFrame:
    """(file_id, price_col, total_col) of the pair that agrees most, if on 0.8 of the rows; ties to the left."""
    best = agreed.groupBy("file_id").agg(F.max_by(F.struct("price_col", "total_col", "share"), F.struct("share", -F.col("price_col"), -F.col("total_col"))).alias("b"))
    return best.where(F.col("b.share") >= AGREEMENT).select("file_id", "b.*")


def totals(positions: DataFrame) -> DataFrame:
    """positions (file_id, quantity, unit_price, source_total) with line_total and disagrees (by more than 0.02)."""
    product = F.round(F.col("quantity").cast("decimal(18,3)") * F.col("unit_price").cast("decimal(18,4)"), 2).cast("decimal(18,2)")
    total = F.coalesce(F.col("source_total").cast("decimal(18,2)"), product)
    return positions.withColumn("line_total", total).withColumn("disagrees", F.coalesce(F.abs(product - F.col("source_total").cast("decimal(18,2)")) > 0.02, F.lit(False)))


def grand_totals(priced: DataFrame) -> DataFrame:
    """Per file: the sum (unpriced positions as 0), how many positions, and whether all are priced."""
    return priced.groupBy("file_id").agg(F.sum(F.coalesce("line_total", F.lit(0).cast("decimal(18,2)"))).cast("decimal(38,2)").alias("total"), F.count(F.lit(1)).alias("positions"), F.bool_and(F.col("unit_price").isNotNull()).alias("priced"))


def first_seen_sections(positions: DataFrame) -> DataFrame:
    s = positions.groupBy("file_id", "section").agg(F.min("row_no").alias("first_row"))
    return s.withColumn("place", F.row_number().over(Window.partitionBy("file_id").orderBy("first_row", "section")))


def cost_groups(rows: DataFrame, levels: int = 4) -> DataFrame:
    """rows (file_id, row_no, level, heading) with `kg`: the headings in force at each row.

    Entering a level drops the deeper ones; a level that was skipped is empty.  level is null on rows that head nothing.
    """
    w = Window.partitionBy("file_id").orderBy("row_no").rowsBetween(Window.unboundedPreceding, 0)
    out = rows
    for k in range(1, levels + 1):
        out = out.withColumn(f"__{k}", F.last(F.when(F.col("level") == k, F.struct("row_no", "heading")), ignorenulls=True).over(w))
    deep = F.lit(0)
    names = []
    above: Column = F.lit(-1)
    for k in range(1, levels + 1):
        live = F.col(f"__{k}").isNotNull() & (F.col(f"__{k}")["row_no"] > above)
        names.append(F.when(live, F.col(f"__{k}")["heading"]).otherwise(""))
        deep = F.when(live, k).otherwise(deep)
        above = F.greatest(above, F.coalesce(F.col(f"__{k}")["row_no"], F.lit(-1)))
    out = out.withColumn("kg", F.slice(F.array(*names), F.lit(1), F.greatest(deep, F.lit(0))))
    return out.drop(*[f"__{k}" for k in range(1, levels + 1)])


def group_totals(entries: DataFrame) -> DataFrame:
    """entries (file_id, kind, kg, amount, printed) summed along the path of headings and held against what they print.

    (file_id, path, level, positions, total, printed, state) for every heading that a path names, and for the whole file
    (level 0).  Positions are summed by path first, so a path of any depth is spread once a path and not once a position.
    Unpriced positions count 0; a skipped level is no heading; headings with the same path are one, their printed amounts
    summed.  state: not_printed, agrees, or differs (by more than the tolerance).
    """
    zero = F.lit(0).cast("decimal(18,2)")
    position = F.col("kind") == "position"
    at = entries.groupBy("file_id", "kg").agg(
        F.count_if(position).alias("positions"),
        F.sum(F.when(position, F.coalesce("amount", zero))).alias("total"),
        F.sum(F.when(F.col("kind") == "kg", F.col("printed"))).alias("printed"),
    )
    up = F.transform(F.sequence(F.lit(0), F.size("kg")), lambda n: F.slice("kg", F.lit(1), n))
    spread = at.withColumn("path", F.explode(up)).where((F.size("path") == 0) | (F.get("path", F.size("path") - 1) != ""))
    own = F.col("path") == F.col("kg")
    out = spread.groupBy("file_id", "path").agg(F.sum("positions").alias("positions"), F.coalesce(F.sum("total"), zero).cast("decimal(38,2)").alias("total"), F.sum(F.when(own, F.col("printed"))).cast("decimal(38,2)").alias("printed"))
    state = F.when(F.col("printed").isNull(), "not_printed").when(F.abs(F.col("printed") - F.col("total")) <= TOLERANCE, "agrees").otherwise("differs")
    return out.select("file_id", "path", F.size("path").cast("long").alias("level"), "positions", "total", "printed", state.alias("state"))


def fold_continuations(rows: DataFrame) -> DataFrame:
    """rows (file_id, row_no, is_position, text): positions with the text of the rows that follow, joined by line feeds."""
    w = Window.partitionBy("file_id").orderBy("row_no").rowsBetween(Window.unboundedPreceding, 0)
    island = rows.withColumn("island", F.sum(F.when(F.col("is_position"), 1).otherwise(0)).over(w)).where("island > 0")
    more = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(~F.col("is_position"), F.struct("row_no", "text")))), lambda x: x["text"]), "\n")
    return island.groupBy("file_id", "island").agg(F.min("row_no").alias("row_no"), F.max(F.when(F.col("is_position"), F.col("text"))).alias("short_text"), more.alias("long_text"))


def first_by_signature(rows: DataFrame, signature: Column) -> DataFrame:
    """Rows whose signature (repeated headings, repeated totals) comes first in its file."""
    n = F.row_number().over(Window.partitionBy("file_id", "__s").orderBy("row_no"))
    return rows.withColumn("__s", signature).withColumn("__n", n).where((F.col("__n") == 1) | F.col("__s").isNull()).drop("__s", "__n")


def mode_width(cells: DataFrame) -> DataFrame:
    """The commonest number of cells a row of each file, the first seen of equals."""
    rows = cells.groupBy("file_id", "row_no").agg(F.count(F.lit(1)).alias("width"))
    n = rows.groupBy("file_id", "width").agg(F.count(F.lit(1)).alias("n"), F.min("row_no").alias("first"))
    return n.groupBy("file_id").agg(F.max_by("width", F.struct("n", -F.col("first"))).alias("width"))


# Words of lines that belong to the page, the same with their letters alone, words of a document's closing
# total, and the cost groups' numbers (a hundred, a ten, a unit, and what is appended).
FURNITURE = ["brutto", "mwst", "mehrwertsteuer", "umsatzsteuer", "ust.", "seite ", "page ", "kostenberechnung", "kostenschätzung"]
SQUASHED = ["rutto", "wst", "mehrwertsteuer", "umsatzsteuer"]
TOTAL_LABELS = ["gesamt", "summe", "endsumme", "gesamtsumme"]
COST_GROUP = r"^[1-8]\d\d(?:[.\-/]\d+)?$"
AMOUNT = r"\d{1,3}(?:\.\d{3})*,\d{2}"
VAT = (1.19, 1.07)
#: Between the cells of a row in one text; a cell that is a number of a position or a cost group, one that is a number, and
#: two amounts in a cell, side by side or not.  A line's end may stand where $ would allow it.
_CELL = "\u0001"
_END = "[\n\r\u0085\u2028\u2029]"
A_POSITION = rf"(?:^|{_CELL}) *(?:[1-8]\d\d(?:[.\-/]\d+)?|\d+(?:[.\-/]\d+)+)(?:\r\n|{_END})? *(?:{_CELL}|\z)"
A_NUMBER = rf"(?:^|{_CELL})[\d.,\s€+-]*\d[\d.,\s€-]*(?:{_END} *)?(?:{_CELL}|\z)"
TWO_AMOUNTS = rf",\d\d[^{_CELL}]*,\d\d|,\d\d\d{{1,3}}\.\d\d\d"


def cost_group_level(number: Column) -> Column:
    """1 to 4 by the shape of a cost group's number, null for any other text."""
    x = F.trim(number)
    return F.when(x.rlike(COST_GROUP), F.when(F.length(x) > 3, 4).when(F.substring(x, 3, 1) != "0", 3).when(F.substring(x, 2, 1) != "0", 2).otherwise(1))


def _settled(df: DataFrame, **named: Column) -> DataFrame:
    """df with columns that are computed once, whatever reads them later; those of the same name are replaced."""
    return df.select(*[c for c in df.columns if c not in named], F.inline(F.array(F.struct(*[v.alias(k) for k, v in named.items()]))))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    return F.transform(F.array(value), body)[0]


def _any(text: Column, words: list[str]) -> Column:
    return functools.reduce(operator.or_, [F.contains(text, F.lit(w)) for w in words])


def _net(cell: Column, marked: Column) -> Column:
    """A cell without its lines on tax and gross sums; of two amounts of which the second is the first with tax, the first.

    marked: whether a cell of the row has a line break or a word of FURNITURE.
    """
    kept = F.array_join(F.filter(F.split(F.trim(cell), r"\r?\n"), lambda x: (F.trim(x) != "") & ~_any(F.lower(x), FURNITURE)), "\n")
    amounts = F.regexp_extract_all(F.replace(kept, F.lit("\n"), F.lit(" ")), F.lit(f"({AMOUNT}|(?<=,\\d\\d)\\d{{1,3}}(?:\\.\\d{{3}})+)"), F.lit(1))
    number = lambda x: F.replace(F.replace(x, F.lit("."), F.lit("")), F.lit(","), F.lit(".")).cast("double")
    taxed = lambda x: functools.reduce(operator.or_, [F.abs(number(x[0]) * rate - number(x[1])) <= number(x[0]) * rate * 0.005 for rate in VAT])
    net = lambda x: F.when(F.size(x) == 2, F.when(taxed(x), x[0]))
    # nothing to take out of one line that names no tax and has no two amounts in a text
    some = (cell.contains(",") & cell.rlike(r",\d\d\d|[a-zA-Z].*,\d\d.*,\d\d|,\d\d.*[a-zA-Z].*,\d\d|,\d\d.*,\d\d.*[a-zA-Z]")) | (marked & (cell.contains("\n") | _let(F.lower(cell), lambda x: _any(x, FURNITURE))))
    return F.when(some, F.coalesce(_let(amounts, net), kept)).otherwise(F.trim(cell))


def _unglued(cell: Column) -> Column:
    """Amounts printed side by side as one cell, apart: the cents of the first end where the next begins."""
    return F.filter(F.split(F.regexp_replace(F.trim(cell), rf"({AMOUNT})(?=\d)", "$1\u0001"), "\u0001"), lambda x: x != "")


def grid(cells: DataFrame) -> DataFrame:
    """(file_id, row_no, row): cells as rows of texts by column, a missing one empty.  Dealt by file, so what follows stays there."""
    c = F.col("col_no").cast("int")
    texts = F.collect_list(F.struct(c.alias("c"), F.coalesce("text", F.lit("")).alias("t")))
    # n powers of two add up to 2^n - 1 only if they are the first n: then the row has each of its columns once
    marks = F.sum(F.when((c >= 0) & (c < 62), F.expr("shiftleft(1L, cast(col_no as int))")))
    rows = cells.repartition("file_id").groupBy("file_id", "row_no").agg(texts.alias("m"), F.max("col_no").cast("int").alias("last"), marks.alias("marks"))
    full = (F.size("m") == F.col("last") + 1) & (F.col("last") < 62) & (F.col("marks") == F.expr("shiftleft(1L, last + 1) - 1"))
    by_column = _let(F.map_from_entries("m"), lambda m: F.transform(F.sequence(F.lit(0), F.col("last")), lambda i: F.coalesce(F.try_element_at(m, i), F.lit(""))))
    return rows.select("file_id", "row_no", F.when(full, F.transform(F.array_sort("m"), lambda x: x["t"])).otherwise(by_column).alias("row"))


def clean_rows(rows: DataFrame) -> DataFrame:
    """Rows of a grid without what belongs to the page, in this order: tax taken out of cells; a gap closed in a leading
    cost group's number; footers, page marks and tax lines dropped, unless a row has a number of its own; of equal column
    headings the first kept; a closing total without what stands before its label, the first of equals kept; amounts that
    ran together taken apart where that gives a row the width most rows have."""
    # what is asked of every row is asked of its cells in a row of text, by one pattern; cells are looked at one by one only
    # in rows that such a pattern finds (a cell that holds the mark between cells makes its row one of them)
    wide = rows.withColumns({"said": F.array_join("row", _CELL), "width": F.size("row")}).where(F.col("said").rlike(f"[^ {_CELL}]"))
    of_width = Window.partitionBy("file_id", "width")
    wide = wide.withColumns({"n": F.count(F.lit(1)).over(of_width), "first": F.min("row_no").over(of_width)})
    wide = wide.withColumn("common", F.max_by("width", F.struct("n", -F.col("first"))).over(Window.partitionBy("file_id"))).drop("n", "first")
    marked = _let(F.lower("said"), lambda x: _any(x, ["\n", *FURNITURE]))
    split = F.length(F.replace("said", F.lit(_CELL), F.lit(""))) != F.length("said") - (F.col("width") - 1)
    wide = wide.withColumns({"marked": marked, "split": split, "gap": F.col("said").rlike(r"\d +\d")})
    taxed = F.col("marked") | F.col("split") | F.col("said").rlike(TWO_AMOUNTS)
    row = F.when(taxed, F.transform("row", lambda c: _net(c, F.col("marked")))).otherwise(F.transform("row", lambda c: F.trim(c)))
    out = _settled(wide, row=row)
    lead = F.array_position(F.transform("row", lambda c: F.trim(c) != ""), True) - 1

    def closed(c: Column, i: Column, at: Column) -> Column:
        tight = F.regexp_replace(F.trim(c), r"\s+", "")
        return F.when((i == at) & F.trim(c).rlike(r"^\d[\d ]*\d$") & F.contains(c, F.lit(" ")) & tight.rlike(COST_GROUP), tight).otherwise(c)

    tight = F.when(F.col("gap") | F.col("marked") | F.col("split"), _let(F.struct(F.col("row").alias("row"), lead.alias("at")), lambda x: F.transform(x["row"], lambda c, i: closed(c, i, x["at"])))).otherwise(F.col("row"))
    out = _settled(out, row=tight).drop("gap", "marked", "said")
    out = out.withColumn("said", F.array_join("row", _CELL)).where(F.col("said").rlike(f"[^ {_CELL}]"))
    has = lambda test: F.exists("row", test)
    number = lambda c: F.trim(c).rlike(r"^[\d.,\s€+-]*\d[\d.,\s€-]*$")
    whole = lambda pattern, test: F.when(F.col("split"), has(test)).otherwise(F.col("said").rlike(pattern))
    numbered = whole(A_POSITION, lambda c: F.trim(c).rlike(COST_GROUP) | F.trim(c).rlike(POSITION_NUMBER))
    # a heading has three cells with text at least
    wordy = F.col("said").rlike(f"(?:[^ {_CELL}][^{_CELL}]*+{_CELL}[ {_CELL}]*+){{2}}[^ {_CELL}]")
    out = out.withColumns({"numbered": numbered, "words": ~whole(A_NUMBER, number), "wordy": wordy}).drop("said", "split")
    joined = F.lower(F.array_join(F.filter("row", lambda c: F.trim(c) != ""), " "))
    out = _settled(out, joined=F.when(~F.col("numbered"), joined))
    out = out.where(F.col("numbered") | ~(_any(F.col("joined"), FURNITURE) | _any(F.regexp_replace("joined", "[^a-zäöüß0-9]", ""), SQUASHED)))
    words = F.col("words")
    heading = words & F.col("wordy") & (F.size(F.array_distinct(F.filter(F.transform("row", header_field), lambda f: f.isNotNull()))) >= 3)
    out = _settled(out, heading=heading)
    out = out.withColumn("total", ~F.col("heading") & ~F.col("numbered") & _any(F.col("joined"), TOTAL_LABELS))
    label = F.array_position(F.transform("row", lambda c: _let(F.lower(c), lambda x: _any(x, TOTAL_LABELS))), True) - 1
    out = _settled(out, label=F.when(F.col("total"), label))
    tidy = F.transform("row", lambda c, i: F.when((i < F.col("label")) & (F.trim(c) != "") & ~number(c), "").otherwise(c))
    out = _settled(out, row=F.when(F.col("total") & (F.col("label") >= 0), tidy).otherwise(F.col("row")))
    sign = F.concat(F.when(F.col("heading"), "heading|").otherwise("total|"), F.array_join(F.transform("row", lambda c: F.lower(F.trim(c))), "|"))
    out = first_by_signature(out, F.when(F.col("heading") | F.col("total"), sign))
    apart = F.flatten(F.transform("row", lambda c: F.when(F.trim(c) == "", F.array(F.lit(""))).otherwise(_unglued(c))))
    out = _settled(out, apart=F.when(F.size("row") < F.col("common"), apart))
    row = F.when(F.size("apart") == F.col("common"), F.col("apart")).otherwise(F.col("row"))
    return out.select("file_id", "row_no", row.alias("row"), "words")


def clean(cells: DataFrame) -> DataFrame:
    """clean_rows on cells; cells without text are left out."""
    return clean_rows(grid(cells)).select("file_id", "row_no", F.posexplode("row").alias("col_no", "text")).where(F.trim("text") != "").select("file_id", "row_no", F.col("col_no").cast("long").alias("col_no"), "text")


FIELDS = ("oz", "short_text", "quantity", "unit", "unit_price", "teilbetrag", "long_text", "section", "total")


def columns(rows: DataFrame) -> DataFrame:
    """(file_id, head, cols map<field, column>): the first row that names a text and a quantity column and is followed by a
    quantity; a file without one by its columns' content.  A price column that quantity and total speak against gives way
    to one they agree with."""
    cells = rows.select("file_id", "row_no", F.posexplode("row").alias("c", "text"))
    thousands = kept(separators(cells), "separators")
    named = F.transform("row", header_field)
    first = F.map_filter(F.map_from_entries(F.transform(F.array(*[F.lit(f) for f in FIELDS]), lambda f: F.struct(f, (F.array_position(F.col("named"), f) - 1).cast("int")))), lambda k, v: v >= 0)
    heads = _settled(rows.where("words"), named=named).where(F.array_contains("named", "short_text") & F.array_contains("named", "quantity")).select("file_id", F.col("row_no").alias("head"), first.alias("cols"))
    tried = rows.join(heads, "file_id").where("row_no > head").join(thousands, "file_id")
    full = _settled(tried, q=quantity_and_unit(F.get("row", F.element_at("cols", "quantity")), F.col("thousands"))["value"]).where("q is not null")
    head = kept(full.groupBy("file_id").agg(F.min_by("cols", "head").alias("cols"), F.min("head").alias("head")), "headers")
    whole = F.map_contains_key("cols", "unit")
    body = rows.join(head.select("file_id", "head", whole.alias("whole")), "file_id", "left").where("head is null or row_no > head")
    # the content of columns is looked into only where a header leaves something open
    below = body.where("whole is not true").select("file_id", "row_no", F.posexplode("row").alias("col_no", "text"))
    roles = infer_roles(profile(below, thousands))
    body = body.drop("whole")
    guess = F.map_filter(F.create_map(*[x for f in ("oz", "short_text", "quantity", "unit", "unit_price", "total") for x in (F.lit(f), F.col(f).cast("int"))]), lambda k, v: v.isNotNull())
    both = roles.select("file_id", guess.alias("guess"), F.col("unit").cast("int").alias("u")).join(head, "file_id", "left")
    # a header without a unit takes the column that looks like one, if no other field has it
    unit = F.when(F.col("u").isNotNull() & ~F.map_contains_key("cols", "unit") & ~F.array_contains(F.map_values("cols"), F.col("u")), F.map_concat("cols", F.create_map(F.lit("unit"), F.col("u")))).otherwise(F.col("cols"))
    both = both.select("file_id", "head", F.coalesce(unit, "guess").alias("cols")).unionByName(head.where(whole).select("file_id", "head", "cols"))
    found = kept(both.where(F.map_contains_key("cols", "short_text") & F.map_contains_key("cols", "quantity")), "roles")
    at = lambda f: F.try_element_at("cols", F.lit(f))
    value = lambda c: parse_decimal(c, F.col("thousands"))
    checked = body.drop("head").join(found, "file_id").where(at("total").isNotNull()).join(thousands, "file_id")
    q = quantity_and_unit(F.get("row", at("quantity")), F.col("thousands"))["value"]
    checked = _settled(checked, q=q, t=value(F.get("row", at("total")))).where("q <> 0 and t is not null")
    checked = checked.select("file_id", at("unit_price").alias("now"), at("quantity").alias("cq"), at("total").alias("ct"), "q", "t", "thousands", F.posexplode("row").alias("c", "text"))
    checked = _settled(checked.where("c <> cq and c <> ct"), u=value(F.col("text"))).where("u is not null")
    share = checked.groupBy("file_id", "c").agg(F.avg((F.abs(F.col("q") * F.col("u") - F.col("t")) <= TOLERANCE).cast("double")).alias("share"), F.first("now").alias("now")).where(F.col("share") >= AGREEMENT)
    # the column named stays if it agrees, else the one that agrees most, the leftmost of equals
    best = share.groupBy("file_id").agg(F.max_by("c", F.struct(F.col("c") == F.coalesce("now", F.lit(-1)), "share", -F.col("c"))).alias("price"))
    price = F.when(F.col("price").isNotNull(), F.map_concat(F.map_filter("cols", lambda k, v: k != "unit_price"), F.create_map(F.lit("unit_price"), F.col("price")))).otherwise(F.col("cols"))
    return found.join(best, "file_id", "left").join(thousands, "file_id").select("file_id", "head", price.alias("cols"), "thousands")


def entries_from_cells(cells: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entries, rejects): every row that carries something, in order, with its kind and the cost-group headings above it.

    kind is position (it has a quantity), kg (a cost group's heading) or entry; a text without a number after a position
    is no entry but goes on in that position's long_text.  A file without columns or positions is rejected with its first
    rows.  A missing number is the row's place times ten.
    """
    rows = kept(clean_rows(grid(cells)), "grid")
    known = kept(columns(rows), "columns")
    body = rows.drop("words").join(known, "file_id").where("head is null or row_no > head")
    at = lambda f: F.coalesce(F.trim(F.get("row", F.try_element_at("cols", F.lit(f)))), F.lit(""))
    e = body.select("file_id", "row_no", "thousands", *[at(f).alias(f) for f in FIELDS])
    e = e.withColumn("n", F.row_number().over(Window.partitionBy("file_id").orderBy("row_no")))
    e = _settled(e, q=quantity_and_unit(F.col("quantity"), F.col("thousands")))
    e = e.where("short_text <> '' or quantity <> '' or total <> ''")
    level = cost_group_level(F.col("oz"))
    e = e.withColumn("position", F.col("q.value").isNotNull()).withColumn("level", F.when(~F.col("position"), level)).withColumn("heading", F.trim(F.concat_ws(" ", "oz", "short_text")))
    e = cost_groups(e)
    w = Window.partitionBy("file_id").orderBy("row_no").rowsBetween(Window.unboundedPreceding, 0)
    e = e.withColumn("island", F.sum(F.col("position").cast("int")).over(w))
    goes_on = ~F.col("position") & F.col("level").isNull() & (F.col("short_text") != "") & (F.col("oz") == "") & (F.col("island") > 0)
    e = e.withColumn("kind", F.when(F.col("position"), "position").when(F.col("level").isNotNull(), "kg").when(goes_on, "more").otherwise("entry"))
    more = e.where("kind = 'more'").groupBy("file_id", "island").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row_no", "short_text"))), lambda x: x["short_text"]), "\n").alias("more"))
    e = e.where("kind <> 'more' and (kind <> 'entry' or short_text <> '' or total <> '')").join(more, ["file_id", "island"], "left")
    is_position = F.col("kind") == "position"
    long = F.concat_ws("\n", F.nullif("long_text", F.lit("")), F.when(is_position, F.col("more")))
    price = parse_decimal(F.col("unit_price"), F.col("thousands"))
    out = e.select(
        "file_id",
        "row_no",
        "kind",
        F.when(is_position & (F.col("oz") == ""), F.lpad((F.col("n") * 10).cast("string"), 4, "0")).otherwise(F.col("oz")).alias("oz"),
        "short_text",
        F.nullif(long, F.lit("")).alias("long_text"),
        F.when(is_position, F.round("q.value", 3)).cast("decimal(18,3)").alias("quantity"),
        F.when(is_position, F.coalesce(F.nullif("unit", F.lit("")), F.col("q.unit"))).alias("unit"),
        F.round(price, 4).cast("decimal(18,4)").alias("unit_price"),
        F.round(parse_decimal(F.col("total"), F.col("thousands")), 2).cast("decimal(18,2)").alias("source_total"),
        F.round(parse_decimal(F.col("teilbetrag"), F.col("thousands")), 2).cast("decimal(18,2)").alias("teilbetrag"),
        F.coalesce(F.nullif("section", F.lit("")), F.try_element_at("kg", F.lit(-1)), F.lit("")).alias("section"),
        "kg",
    )
    out = kept(out, "entries")
    good = out.where("kind = 'position'").select("file_id").distinct()
    bad = cells.join(good, "file_id", "left_anti").where("row_no < 3")
    rejects = bad.groupBy("file_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row_no", "col_no", "text"))), lambda x: x["text"]), " | ").alias("first_rows"))
    return out.join(good, "file_id", "left_semi"), rejects


def positions_from_cells(cells: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(positions, rejects): the positions among entries_from_cells."""
    entries, rejects = entries_from_cells(cells)
    return entries.where("kind = 'position'").drop("kind"), rejects


def check_edits(rows: DataFrame) -> DataFrame:
    """Rows a person typed (file_id, row_no, short_text, quantity_text, unit_price_text) with numbers and `error`."""
    q = quantity_and_unit(F.col("quantity_text"))
    p = parse_decimal(F.col("unit_price_text"))
    place = F.concat(F.lit("row "), F.col("row_no").cast("string"), F.lit(": "))
    blank = F.coalesce(F.trim("quantity_text"), F.lit("")) == ""
    error = F.when(F.coalesce(F.trim("short_text"), F.lit("")) == "", F.concat(place, F.lit("no text"))).when(blank | q["value"].isNull(), F.concat(place, F.lit("quantity is not a number"))).when((F.coalesce(F.trim("unit_price_text"), F.lit("")) != "") & p.isNull(), F.concat(place, F.lit("price is not a number")))
    return rows.select("*", F.round(q["value"], 3).cast("decimal(18,3)").alias("quantity"), q["unit"].alias("unit"), F.round(p, 4).cast("decimal(18,4)").alias("unit_price"), error.alias("error"))
