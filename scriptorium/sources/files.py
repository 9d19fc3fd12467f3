"""File sources: content-addressed intake, registries, grids, GAEB XML, question sets and run reports."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

LIMIT = 100 << 20


def read_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)


def intake(files: DataFrame, key: str, magic: bytes = b"%PDF-", limit: int = LIMIT) -> DataFrame:
    """files (key, content) with file_hash, path (hash[:2]/hash.pdf), `reason` for refusing one, and whether the same bytes came before."""
    h = F.sha2("content", 256)
    reason = F.when(F.col("content").isNull() | (F.length("content") == 0), "empty").when(F.substring("content", 1, len(magic)) != F.lit(magic), "wrong_type").when(F.length("content") > limit, "too_large")
    first = F.row_number().over(Window.partitionBy("file_hash").orderBy(key)) > 1
    return files.withColumn("file_hash", h).withColumn("reason", reason).withColumn("path", F.concat(F.substring("file_hash", 1, 2), F.lit("/"), "file_hash", F.lit(".pdf"))).drop("content").withColumn("repeated", first)


def read_registry(spark: SparkSession, path: str, columns: tuple[str, ...] = ("alias", "generic_name")) -> DataFrame:
    """A delimited registry: a header is needed, a byte-order mark is dropped, blank lines are skipped; a missing column is an error that names it."""
    df = spark.read.option("header", True).option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True).csv(path)
    df = df.toDF(*[c.lstrip("﻿").strip() for c in df.columns])
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing column: {', '.join(missing)}")
    blank = F.lit(True)
    for c in df.columns:
        blank = blank & (F.coalesce(F.trim(c), F.lit("")) == "")
    return df.where(~blank).select(*[F.coalesce(c, F.lit("")).alias(c) for c in columns])


def read_grid(spark: SparkSession, path: str) -> DataFrame:
    """Delimited files as cells (file_id, row_no, col_no, text).

    UTF-8, or Latin-1 where that fails; the delimiter of ; , and tab that most lines agree on; blank rows dropped.
    """
    raw = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file_id"), "content")
    text = F.coalesce(F.try_validate_utf8(F.col("content").cast("string")), F.decode("content", "ISO-8859-1"))
    lines = raw.select("file_id", F.posexplode(F.split(F.regexp_replace(text, "^﻿", ""), "\r\n|\n|\r")).alias("row_no", "line")).where(F.trim("line") != "")
    counts = F.array(*[F.struct((F.length("line") - F.length(F.replace("line", F.lit(d)))).alias("n"), F.lit(d).alias("d")) for d in (";", ",", "\t")])
    seen = lines.select("file_id", F.inline(counts)).where("n > 0").groupBy("file_id", "d", "n").agg(F.count(F.lit(1)).alias("lines"))
    best = seen.groupBy("file_id").agg(F.max_by("d", F.struct("lines", "n", "d")).alias("d"))
    cells = lines.join(best, "file_id", "left").select("file_id", "row_no", "line", F.coalesce("d", F.lit(";")).alias("d"))
    # a quoted cell may hold the delimiter
    pieces = F.when(F.col("line").contains('"'), F.call_function("regexp_extract_all", F.concat("d", "line"), F.concat(F.col("d"), F.lit('("(?:[^"]|"")*"|[^'), F.col("d"), F.lit("]*)")), F.lit(1))).otherwise(F.split("line", F.concat(F.lit("["), F.col("d"), F.lit("]"))))
    rows = cells.select("file_id", F.col("row_no").cast("long").alias("row_no"), F.posexplode(pieces).alias("col_no", "text"))
    unquoted = F.when(F.col("text").rlike('^".*"$'), F.replace(F.expr("substring(text, 2, length(text) - 2)"), F.lit('""'), F.lit('"'))).otherwise(F.col("text"))
    return rows.select("file_id", "row_no", F.col("col_no").cast("long").alias("col_no"), F.trim(unquoted).alias("text"))


QUESTION = "id string, text string, expect string, language string, source string, note string, tags array<string>, expect_pages array<bigint>"


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """A question set: JSON lines, or YAML with a list under `questions` where the path ends in .yaml or .yml.

    A field that a question lacks is null; other fields are left out.  A YAML file is one record of its set and is parsed
    where it is read, with PyYAML; files are as many as there are sets.  A file without `questions` is an error that names it.
    """
    if not path.endswith((".yaml", ".yml")):
        return spark.read.schema(QUESTION).json(path)
    import yaml  # noqa: F401  asked for here, so that its absence is told before a job starts

    names = [f.split()[0] for f in QUESTION.split(", ")]

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import yaml

        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                found = yaml.safe_load(content.decode("utf-8-sig"))
                if not isinstance(found, dict) or not isinstance(found.get("questions"), list):
                    raise ValueError(f"no list of questions: {path}")
                yield pd.DataFrame([[q.get(n) for n in names] for q in found["questions"]], columns=names, dtype=object)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(parse, QUESTION)


def write_report(summary: DataFrame, outcomes: DataFrame, path: str) -> None:
    """A run's report: summary and outcomes as JSON lines under one path."""
    summary.write.mode("errorifexists").json(f"{path}/summary")
    outcomes.write.mode("errorifexists").json(f"{path}/outcomes")


def read_report(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(f"{path}/outcomes")
