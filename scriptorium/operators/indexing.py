"""Indexing in runs, all or nothing: chunks are staged, outcomes follow, and a manifest written last makes a run count.

A run has a number and folders of its own under a path that all executors see.  Whatever is in them before the manifest is
invisible; a run that broke off is repeated under its number and overwrites what it left, so nothing is lost or doubled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scriptorium.operators.layout import hashed_grams, index_versions
from scriptorium.shared import kept

MANIFEST = "chunks long, editions long, run long"


def index_run(path: str, run: int, lines: DataFrame, versions: DataFrame, bad, reference, encoder=hashed_grams) -> None:
    """Index the pending editions among versions (version_id, status) as run `run` (0 or more)."""
    spark = lines.sparkSession
    spark.createDataFrame([], "chunks long, editions long").write.mode("ignore").parquet(f"{path}/manifest/run=-1")
    chunks, outcome = index_versions(lines, versions.where("status = 'pending'"), bad, reference, encoder)
    chunks.write.mode("overwrite").parquet(f"{path}/chunks/run={run}")
    outcome.write.mode("overwrite").parquet(f"{path}/outcomes/run={run}")
    n = spark.read.parquet(f"{path}/chunks/run={run}").count(), spark.read.parquet(f"{path}/outcomes/run={run}").count()
    spark.createDataFrame([n], "chunks long, editions long").write.mode("overwrite").parquet(f"{path}/manifest/run={run}")


def _listed(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MANIFEST).parquet(f"{path}/manifest").select("run").where("run >= 0").distinct()


def broken_runs(spark: SparkSession, path: str) -> list[int]:
    """Runs that left something and aren't in the manifest: to be run again."""
    left = spark.read.parquet(f"{path}/chunks").select(F.col("run").cast("long").alias("run")).distinct()
    return sorted(r[0] for r in left.join(_listed(spark, path), "run", "left_anti").collect())  # a row a run


def outcomes(spark: SparkSession, path: str) -> DataFrame:
    """(version_id, n_chunks, n_rejected, error, run) of the runs that count; of an edition's runs the first without an error."""
    rows = spark.read.parquet(f"{path}/outcomes").withColumn("run", F.col("run").cast("long")).join(_listed(spark, path), "run", "left_semi")
    w = Window.partitionBy("version_id").orderBy(F.col("error").isNotNull(), "run")
    return rows.withColumn("r", F.row_number().over(w)).where("r = 1").drop("r")


def indexed_chunks(spark: SparkSession, path: str) -> DataFrame:
    """Chunks that count: embedded and flagged, of editions that came out without an error."""
    good = outcomes(spark, path).where("error is null").select("version_id", "run")
    return spark.read.parquet(f"{path}/chunks").withColumn("run", F.col("run").cast("long")).join(good, ["version_id", "run"], "left_semi")


def activate(versions: DataFrame, path: str) -> DataFrame:
    """versions with `status`: pending ones whose chunks all count are active."""
    done = kept(outcomes(versions.sparkSession, path).where("error is null").select("version_id", F.lit(True).alias("__done")), "done")
    status = F.when((F.col("status") == "pending") & F.col("__done"), "active").otherwise(F.col("status"))
    return versions.join(done, "version_id", "left").withColumn("status", status).drop("__done")
