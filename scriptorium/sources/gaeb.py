"""GAEB XML in and out."""

from __future__ import annotations

from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.functions.numbers import parse_decimal

_ITEM = ["section", "oz", "short_text", "quantity", "unit", "unit_price"]


def _name(element: ElementTree.Element) -> str:
    """Tag without its namespace, which differs by version."""
    return element.tag.rpartition("}")[2]


def _text(element: ElementTree.Element, *names: str) -> str:
    """The first text under an element that stands in a tag of these names."""
    return next((e.text.strip() for e in element.iter() if _name(e) in names and e.text and e.text.strip()), "")


def _items(content: bytes) -> tuple[list[dict], str | None]:
    """Items in document order with the nearest category label above each, at any depth; or what is wrong with the file."""
    try:
        root = ElementTree.fromstring(content)
    except ElementTree.ParseError as e:
        return [], f"no XML: {e}"
    if _name(root) != "GAEB":
        return [], f"root is {_name(root)}"
    out: list[dict] = []
    todo = [(root, "")]
    while todo:
        node, section = todo.pop()
        if _name(node) == "Item":
            text = _text(node, "TextOutlTxt", "span") or _text(node, "OutlineText")
            number = next((v.strip() for k in ("RNoPart", "RNo") if (v := node.get(k)) and v.strip()), f"{len(out) * 10 + 10:04d}")
            out.append({"section": section, "oz": number, "short_text": text, "quantity": _text(node, "Qty"), "unit": _text(node, "QU"), "unit_price": _text(node, "UP")})
            continue
        if _name(node) == "BoQCtgy":
            label = next((e for e in node if _name(e) == "LblTx"), None)
            section = (_text(label, "span", "LblTx") if label is not None else "") or section
        todo.extend((child, section) for child in reversed(node))
    return out, None if out else "no items"


def _parsed(spark: SparkSession, path: str) -> DataFrame:
    """A row an item with what the file says, and one with `error` for a file without items."""
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file_id"), "content")

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for file_id, content in zip(batch.column("file_id").to_pylist(), batch.column("content").to_pylist(), strict=True):
                items, error = _items(content)
                rows += [x | {"file_id": file_id, "place": n + 1, "error": None} for n, x in enumerate(items)]
                if error:
                    rows.append({"file_id": file_id, "error": error})
            names = ["file_id", "place", "error", *_ITEM]
            kinds = [pa.string(), pa.int64(), *[pa.string()] * (len(names) - 2)]
            yield pa.RecordBatch.from_arrays([pa.array([r.get(k) for r in rows], t) for k, t in zip(names, kinds, strict=True)], names=names)

    return files.mapInArrow(parse, "file_id string, place long, error string, " + ", ".join(f"{k} string" for k in _ITEM))


def read(spark: SparkSession, path: str) -> DataFrame:
    """Items of GAEB files of any namespace version: (file_id, place, section, oz, short_text, quantity, unit, unit_price).

    A category's label counts for all below it until a nearer one, at any depth.  A missing quantity is 0, a missing number
    the item's place times ten; numbers may be German or English.  Files without items are in rejects.
    """
    x = _parsed(spark, path).where("error is null")
    return x.select(
        "file_id",
        "place",
        "section",
        "oz",
        F.trim(F.regexp_replace("short_text", r"\s+", " ")).alias("short_text"),
        F.coalesce(F.round(parse_decimal(F.col("quantity")), 3), F.lit(0)).cast("decimal(18,3)").alias("quantity"),
        "unit",
        F.round(parse_decimal(F.col("unit_price")), 4).cast("decimal(18,4)").alias("unit_price"),
    )


def rejects(spark: SparkSession, path: str) -> DataFrame:
    """(file_id, error) of files that are no GAEB or hold no item."""
    return _parsed(spark, path).where("error is not null").select("file_id", "error")


def _uuid(name) -> object:
    """A version 5 shaped id from a name: the same name, the same id."""
    h = F.sha1(name)
    variant = F.translate(F.substring(h, 17, 1), "0123456789abcdef", "89ab89ab89ab89ab")
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def _escape(x) -> object:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        x = F.replace(x, F.lit(a), F.lit(b))
    return x


def _block(tag: str, text) -> object:
    """A text as the format nests it."""
    return F.concat(F.lit(f"<{tag}><p><span>"), _escape(F.coalesce(text, F.lit(""))), F.lit(f"</span></p></{tag}>"))


def offers(positions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """positions (file_id, row_no, oz, short_text, quantity, unit, unit_price, section) -> (file_id, xml) priced offers, and
    (file_id, unpriced) for the files that have a position without a price.

    A flat list if the only section is empty, else a category a section in first-seen order.  Columns long_text and
    source_total are used where there are any: a total that the source printed is carried over, not computed.
    """
    both = written(positions)
    return both.where("unpriced = 0").select("file_id", "xml"), both.where("unpriced > 0").select("file_id", "unpriced")


def written(positions: DataFrame) -> DataFrame:
    """(file_id, unpriced, xml) of every file at once, as in offers: xml is null where a position has no price.

    Positions are dealt by file before anything is written of them, so no XML is shuffled.
    """
    p = positions.repartition("file_id")
    money = lambda c: c.cast("decimal(18,2)").cast("string")
    product = F.round(F.col("quantity").cast("decimal(18,3)") * F.col("unit_price").cast("decimal(18,4)"), 2).cast("decimal(18,2)")
    total = F.coalesce(F.col("source_total").cast("decimal(18,2)"), product) if "source_total" in p.columns else product
    long = F.coalesce("long_text", F.lit("")) if "long_text" in p.columns else F.lit("")
    detail = F.when(long != "", F.concat(F.lit("<DetailTxt>"), _block("Text", long), F.lit("</DetailTxt>"))).otherwise("")
    item = F.concat(
        F.lit('<Item ID="'), _uuid(F.concat_ws("/", F.col("file_id").cast("string"), F.col("row_no").cast("string"))), F.lit('" RNoPart="'), _escape(F.col("oz")), F.lit('"><Qty>'), F.col("quantity").cast("decimal(18,3)").cast("string"), F.lit("</Qty><QU>"), _escape(F.col("unit")),
        F.lit("</QU><Description><CompleteText><OutlineText><OutlTxt>"), _block("TextOutlTxt", F.col("short_text")), F.lit("</OutlTxt></OutlineText>"), detail, F.lit("</CompleteText></Description><UP>"), money(F.round(F.col("unit_price").cast("decimal(18,4)"), 2)), F.lit("</UP><IT>"), money(total), F.lit("</IT></Item>"),
    )
    section = p.withColumn("section", F.coalesce("section", F.lit(""))).withColumn("item", item).withColumn("total", total).groupBy("file_id", "section").agg(F.min("row_no").alias("first"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row_no", "item"))), lambda x: x["item"]), "").alias("items"), F.sum("total").alias("total"), F.count_if(F.col("unit_price").isNull()).alias("unpriced"))
    whole = section.groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct("first", "section", "items"))).alias("s"), F.sum("total").alias("total"), F.sum("unpriced").alias("unpriced"))
    body = lambda x: F.concat(F.lit("<Itemlist>"), x["items"], F.lit("</Itemlist>"))
    category = lambda x, i: F.concat(F.lit('<BoQCtgy RNoPart="'), F.lpad((i + 1).cast("string"), 2, "0"), F.lit('">'), _block("LblTx", x["section"]), F.lit("<BoQBody>"), body(x), F.lit("</BoQBody></BoQCtgy>"))
    flat = (F.size("s") == 1) & (F.col("s")[0]["section"] == "")
    inner = F.when(flat, body(F.col("s")[0])).otherwise(F.array_join(F.transform("s", category), ""))
    xml = F.concat(F.lit('<?xml version="1.0" encoding="UTF-8"?><GAEB xmlns="http://www.gaeb.de/GAEB_DA_XML/DA84/3.2"><PrjInfo><NamePrj>'), _escape(F.col("file_id").cast("string")), F.lit("</NamePrj><Cur>EUR</Cur></PrjInfo><Award><DP>84</DP><Cur>EUR</Cur><BoQ><BoQBody>"), inner, F.lit("</BoQBody><Totals><Total>"), money(F.col("total")), F.lit("</Total></Totals></BoQ></Award></GAEB>"))
    return whole.select("file_id", "unpriced", F.when(F.col("unpriced") == 0, xml).alias("xml"))


def write(documents: DataFrame, path: str) -> None:
    """One text file a project, in a folder of its own."""
    documents.select("file_id", "xml").repartition("file_id").write.partitionBy("file_id").text(path, lineSep="\n")
