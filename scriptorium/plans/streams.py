"""Queries of the streaming jobs (run over what there is), and approximate search."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.corpus import Corpus, with_views
from scriptorium.functions import text as X
from scriptorium.operators import audit as A
from scriptorium.operators import layout as Y
from scriptorium.operators.vector_index import build_index, search_index
from scriptorium.plans.audit import _PAYLOAD
from scriptorium.plans.registry import query
from scriptorium.sources import gaeb
from scriptorium.streaming import jobs


def _in_batches(c: Corpus, table: str, late: str, label: str, run) -> str:
    """Feeds a table to a stream in two runs of one checkpoint: first the rows that aren't `late`, then those that are.

    run(stream, folder) starts and ends a run.  Returns the folder.
    """
    out = c.scratch(label)
    rows = c.table(table)
    for mode, part in (("overwrite", rows.where(f"not coalesce({late}, false)")), ("append", rows.where(late))):
        part.write.mode(mode).parquet(f"{out}/source")
        run(c.spark.readStream.schema(rows.schema).parquet(f"{out}/source"), out)
    return out


_LATE_CHAIN = """folded AS (SELECT clinic_id, list(seq ORDER BY late, seq) AS seqs, list_reduce(list_prepend([repeat('0', 64)], list(CAST([payload] AS VARCHAR[]) ORDER BY late, seq)), lambda acc, p: list_append(acc, sha256(acc[-1] || p[1]))) AS hashes FROM (SELECT *, seq % 3 = 0 AS late FROM paid) GROUP BY clinic_id)
SELECT clinic_id, unnest(seqs) AS seq, unnest(hashes[:-2]) AS prev_hash, unnest(hashes[2:]) AS row_hash, unnest(range(1, len(seqs) + 1)) AS chain_no FROM folded"""


@query("k2_streaming_chain", f"{with_views('audit')}, {_PAYLOAD}, {_LATE_CHAIN}")
def k2_streaming_chain(c: Corpus) -> DataFrame:
    """Every third entry comes in a later batch than its successors."""
    log = Corpus(c.spark, c.dir)

    def run(stream: DataFrame, out: str) -> None:
        log.table = lambda name: stream
        jobs.append_chain_stream(log.audit_log(), A.ENTRY, f"{out}/table", f"{out}/state").awaitTermination()

    out = _in_batches(c, "events", "event_id % 3 = 0", "chain", run)
    return jobs.chain_entries(c.spark, f"{out}/table")


@query("k3_job_progress", "WITH e AS (SELECT o_orderkey % 300 AS job_id, CASE WHEN o_orderstatus = 'O' THEN 'planned' WHEN o_orderkey % 7 = 0 THEN 'failed' ELSE 'done' END AS kind FROM orders), g AS (SELECT job_id, count(*) FILTER (kind = 'planned') AS planned, count(*) FILTER (kind = 'done') AS done, count(*) FILTER (kind = 'failed') AS failed FROM e GROUP BY job_id) SELECT *, CASE WHEN planned = 0 THEN 0 ELSE 10 + CAST(floor(90 * (done + failed) / planned) AS BIGINT) END AS percent, CASE WHEN done + failed < planned THEN 'running' WHEN done > 0 THEN 'done' ELSE 'failed' END AS state FROM g")
def k3_job_progress(c: Corpus) -> DataFrame:
    """A stream in update mode over two batches; the last state of each job is what there is to see."""
    k = F.when(F.col("o_orderstatus") == "O", "planned").when(F.col("o_orderkey") % 7 == 0, "failed").otherwise("done")

    def run(stream: DataFrame, out: str) -> None:
        jobs.run_updates(jobs.job_progress(stream.select((F.col("o_orderkey") % 300).alias("job_id"), k.alias("kind"))), f"{out}/table", f"{out}/state")

    out = _in_batches(c, "orders", "o_orderkey % 4 = 1", "progress", run)
    return jobs.last_updates(c.spark.read.parquet(f"{out}/table"), "job_id")


_WINDOWS = f"""{with_views('audit')}, first_run AS (SELECT max(created_at) - INTERVAL '2 hours' AS mark FROM audit WHERE seq % 5 <> 0),
n AS (SELECT clinic_id, time_bucket(INTERVAL '1 hour', created_at) AS start, count(*) FILTER (seq % 5 <> 0) AS early, count(*) FILTER (seq % 5 = 0) AS late FROM audit GROUP BY ALL)
SELECT clinic_id, start, CASE WHEN start + INTERVAL '1 hour' <= mark THEN early ELSE early + late END AS n FROM n, first_run WHERE early > 0 OR start + INTERVAL '1 hour' > mark"""


@query("k5_windowed_counts", _WINDOWS)
def k5_windowed_counts(c: Corpus) -> DataFrame:
    """A stream over two batches: every fifth event comes late, and goes if the watermark has passed its window's end."""
    log = Corpus(c.spark, c.dir)

    def run(stream: DataFrame, out: str) -> None:
        log.table = lambda name: stream
        jobs.run_updates(jobs.windowed_counts(log.audit_log()), f"{out}/table", f"{out}/state")

    out = _in_batches(c, "events", "event_id % 5 = 0", "windows", run)
    return jobs.last_updates(c.spark.read.parquet(f"{out}/table"), "clinic_id", "start").withColumn("start", F.col("start").cast("timestamp_ntz"))


@query(
    "k1_streaming_ingest",
    r"SELECT file_hash, CASE WHEN NOT regexp_matches(text, '\S') THEN 'no_text' END AS error, CASE WHEN regexp_matches(text, '\S') THEN 'active' ELSE 'pending' END AS status FROM (SELECT DISTINCT sha256(text) AS file_hash, text FROM documents)",
)
def k1_streaming_ingest(c: Corpus) -> DataFrame:
    """Documents as arriving files, two batches of which the second repeats some of the first; each new one is indexed."""

    def run(stream: DataFrame, out: str) -> None:
        files = stream.select(F.sha2("text", 256).alias("file_hash"), "text")
        jobs.ingest(files, f"{out}/table", f"{out}/state", index=_index).awaitTermination()

    out = _in_batches(c, "documents", "doc_id % 4 = 1", "ingest", run)
    return jobs.landed(c.spark, f"{out}/table").select("file_hash", "error", "status")


def _index(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Chunks of new files, embedded and flagged, and what became of each file."""
    lines = files.select(F.col("file_hash").alias("version_id"), F.posexplode(F.split("text", "\n")).alias("line_no", "text")).withColumns({"page": F.floor(F.col("line_no") / 4) + 1, "heading": F.lit(None).cast("string")})
    versions = files.select(F.col("file_hash").alias("version_id"), F.lit("pending").alias("status"))
    return Y.index_versions(lines, versions, X.has_unresolved_glyph, X.looks_like_reference)


@query("k4_scheduled_verify", f"{with_views('audit')} SELECT clinic_id, max(seq) AS verified_through_seq, count(*) AS entries_verified FROM audit GROUP BY clinic_id")
def k4_scheduled_verify(c: Corpus) -> DataFrame:
    from scriptorium.plans.audit import chained

    out = c.scratch("verify")

    def verify(spark) -> None:
        verified = A.verify_chain(chained(Corpus(spark, c.dir)), A.ENTRY)
        verified.where("intact").select("clinic_id", F.col("through_seq").alias("verified_through_seq"), F.col("entries").alias("entries_verified")).write.mode("overwrite").parquet(f"{out}/points")

    source = c.spark.readStream.schema(c.table("events").schema).parquet(f"{c.dir}/events.parquet*")
    jobs.verify_when_due(source.select("event_id"), verify, f"{out}/state").awaitTermination()
    return c.spark.read.parquet(f"{out}/points")


@query("a6_priced_offers")
def a6_priced_offers(c: Corpus) -> DataFrame:
    from scriptorium.plans.boq import items

    p = items(c).select("file_id", "row_no", F.lpad((F.col("row_no") * 10).cast("string"), 4, "0").alias("oz"), F.col("p_name").alias("short_text"), "quantity", F.lit("St").alias("unit"), "unit_price", "section")
    return gaeb.written(p).select("file_id", "xml")


@query("e2_approximate_top_k")
def e2_approximate_top_k(c: Corpus) -> DataFrame:
    index = build_index(c.table("embeddings").select("vec_id", "embedding"), c.scratch("vectors"))
    return search_index(c.spark, index, c.query_vectors().select("query_id", "query_vector"))
