"""Structured Streaming jobs: ingest, chain append, progress, scheduled verification, windowed counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from scriptorium.operators.audit import append_chain


def ingest(source: DataFrame, corpus_path: str, checkpoint: str, key: str = "file_hash", index=None) -> StreamingQuery:
    """New files once each: a batch is cut to the hashes the corpus lacks, indexed, and written under its batch number.

    index(files) gives (chunks, outcome), both by version_id; chunks are written first and a file's outcome last, so only
    a file whose chunks are all there is listed, with status `active` or the error that keeps it out.  Hashes lie apart
    from texts, and a batch reads of them only the prefixes it has itself.  A batch that is run again after a failure
    overwrites its own folders, so nothing is lost or doubled.
    """
    prefix = F.substring(key, 1, 2).alias("prefix")

    def land(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        fresh = batch.dropDuplicates([key])
        listed = "prefix string, batch long, status string, error string, n_chunks long, " + f"{key} string"
        if batch_id:
            known = spark.read.schema(listed).parquet(f"{corpus_path}/files").where(F.col("batch") < batch_id)
            wanted = [r[0] for r in fresh.select(prefix).distinct().collect()]  # 256 prefixes at most
            fresh = fresh.join(known.where(F.col("prefix").isin(wanted)).select(key), key, "left_anti")
        fresh.write.mode("overwrite").parquet(f"{corpus_path}/texts/batch={batch_id}")
        landed = spark.read.schema(fresh.schema).parquet(f"{corpus_path}/texts/batch={batch_id}")
        if index is None:
            outcome = landed.select(key, F.lit(None).cast("string").alias("error"), F.lit(0).cast("long").alias("n_chunks"))
        else:
            chunks, outcome = index(landed)
            chunks.write.mode("overwrite").parquet(f"{corpus_path}/chunks/batch={batch_id}")
            outcome = outcome.select(F.col("version_id").alias(key), "error", "n_chunks")
        outcome = outcome.withColumn("status", F.when(F.col("error").isNull(), "active").otherwise("pending"))
        outcome.withColumn("prefix", prefix).write.mode("overwrite").partitionBy("prefix").parquet(f"{corpus_path}/files/batch={batch_id}")

    return source.writeStream.foreachBatch(land).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def landed(spark: SparkSession, corpus_path: str) -> DataFrame:
    """Files of all batches with their status, error and number of chunks."""
    return spark.read.parquet(f"{corpus_path}/files")


def append_chain_stream(source: DataFrame, fields: list[str], path: str, checkpoint: str, key: str = "clinic_id", order: str = "seq") -> StreamingQuery:
    """Appends a stream of entries to their chains: (key, order, prev_hash, row_hash, chain_no), under the batch's number.

    A batch is sorted by key and order and folded as it streams by, from the tails that the batch before has left, so a
    task holds one hash, whatever a key's share of a batch.  Entries are written first and all chains' tails last; a batch
    that is run again overwrites its own folders.  Rows that come late, with a number below one of an earlier batch, go
    after the tail like any other: a chain's order is that of arrival, which chain_no counts from 1.
    """

    def land(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        kind = dict(batch.dtypes)[key]
        stored = f"{key} {kind}, row_hash string, n long"
        tails = spark.read.schema(stored).parquet(f"{path}/tails/batch={batch_id - 1}") if batch_id else spark.createDataFrame([], stored)
        chained = append_chain(batch, tails, fields, key, order, "chain_no").select(key, order, "prev_hash", "row_hash", "chain_no")
        chained.write.mode("overwrite").parquet(f"{path}/entries/batch={batch_id}")
        new = spark.read.schema(chained.schema).parquet(f"{path}/entries/batch={batch_id}").groupBy(key).agg(F.max_by("row_hash", "chain_no").alias("row_hash"), F.max("chain_no").alias("n"))
        tails.join(new, key, "left_anti").unionByName(new).write.mode("overwrite").parquet(f"{path}/tails/batch={batch_id}")

    return source.writeStream.foreachBatch(land).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def chain_entries(spark: SparkSession, path: str) -> DataFrame:
    """Entries of all batches."""
    return spark.read.parquet(f"{path}/entries").drop("batch")


def job_progress(events: DataFrame) -> DataFrame:
    """events (job_id, kind of planned, done, failed): percent = 10 + floor(90 x finished / planned); done if one landed
    and none is open.  The same aggregation serves a table and a stream (update mode)."""
    count = lambda k: F.count_if(F.col("kind") == k)
    g = events.groupBy("job_id").agg(count("planned").alias("planned"), count("done").alias("done"), count("failed").alias("failed"))
    over = F.col("done") + F.col("failed")
    percent = F.when(F.col("planned") == 0, 0).otherwise(10 + F.floor(90 * over / F.col("planned")))
    state = F.when(over < F.col("planned"), "running").when(F.col("done") > 0, "done").otherwise("failed")
    return g.select("job_id", "planned", "done", "failed", percent.cast("long").alias("percent"), state.alias("state"))


def windowed_counts(events: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events per clinic and tumbling window; on a stream, rows later than the watermark are dropped."""
    return events.withWatermark("created_at", late).groupBy(F.window("created_at", window).alias("w"), "clinic_id").agg(F.count(F.lit(1)).alias("n")).select("clinic_id", F.col("w.start").alias("start"), "n")


def verify_when_due(source: DataFrame, verify, checkpoint: str) -> StreamingQuery:
    """Runs verify(spark) once for whatever is new; the verification itself always reads from the genesis."""
    return source.writeStream.foreachBatch(lambda batch, _: verify(batch.sparkSession)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_updates(df: DataFrame, path: str, checkpoint: str) -> None:
    """Run an aggregating stream in update mode over what there is: each batch's changed rows, under its number."""

    def keep(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("run", F.lit(batch_id).cast("long")).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    df.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def last_updates(rows: DataFrame, *keys: str) -> DataFrame:
    """The newest row of each key."""
    own = [c for c in rows.columns if c not in ("run", "batch")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*own), "run").alias("x")).select("x.*")
