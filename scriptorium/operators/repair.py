"""Repairs that write back: only the partitions that hold something to mend are written again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from scriptorium.operators.lifecycle import drift, hash_state
from scriptorium.shared import kept


def rewrite(spark: SparkSession, path: str, schema: StructType, fixes: DataFrame, key: str, column: str, by: str) -> int:
    """Set column of the table at path, stored in partitions of by, to the value that fixes (key, column) has; how many rows.

    schema is given, so that the name of a partition isn't read as a number.  The new rows are written beside the table
    first, then take the place of their partitions; the others aren't touched.  A run that breaks off between leaves
    partitions that are old or new, and is repeated from the report.  Nothing to fix writes nothing.
    """
    table = spark.read.schema(schema).parquet(path)
    f = kept(fixes.select(F.col(key).alias("__k"), F.col(column).alias("__new")).dropDuplicates(["__k"]), "fixes")
    n = table.join(f, F.col(key) == F.col("__k"), "left_semi").count()
    if n == 0:
        return 0
    touched = table.join(f, F.col(key) == F.col("__k"), "left_semi").select(F.col(by).alias("__by")).distinct()
    rows = table.join(touched, F.col(by).eqNullSafe(F.col("__by")), "left_semi").join(f, F.col(key) == F.col("__k"), "left")
    rows = rows.withColumn(column, F.coalesce("__new", column)).select(*schema.names)
    staged = kept(rows, "staged").hint("rebalance", by)
    staged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)
    return n


def repair_sectors(spark: SparkSession, path: str, schema: StructType, vocabulary: DataFrame, by: str = "issuing_org") -> int:
    """Stored sectors that differ from their organisation's become it; documents of unknown organisations stay as they are."""
    found = drift(spark.read.schema(schema).parquet(path), vocabulary).where("state = 'drift'")
    return rewrite(spark, path, schema, found.select("document_id", F.col("derived").alias("sector")), "document_id", "sector", by)


def repair_hashes(spark: SparkSession, path: str, schema: StructType, files: DataFrame, placeholder, by: str) -> int:
    """Placeholders become the hash of their file.  A hash whose content changed, and one without a file, are never touched."""
    found = hash_state(spark.read.schema(schema).parquet(path), files, placeholder).where("state = 'placeholder'").select("version_id")
    fixes = found.join(files.select("version_id", "file_hash"), "version_id")
    return rewrite(spark, path, schema, fixes, "version_id", "file_hash", by)
