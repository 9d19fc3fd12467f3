"""Hash-chained audit logs: payloads, appending, verification, erasure, export."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from scriptorium.functions.text import normalise_quote

GENESIS = "0" * 64
LEGAL_BASES = ["consent_withdrawn", "objection", "unlawful_processing", "legal_obligation", "no_longer_needed"]
ENTRY = ["actor_id", "chunk_ids", "clinic_id", "created_at", "error", "response"]
ERASURE = ["clinic_id", "erased_at", "erased_by", "legal_basis", "query_id"]


def payload(df: DataFrame, fields: list[str]) -> Column:
    """Canonical JSON, version v1: keys sorted, nulls kept, timestamps in UTC with six digits."""
    kinds = dict(df.dtypes)
    cols = [(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'") if kinds[c].startswith("timestamp") else F.col(c)).alias(c) for c in sorted(fields)]
    return F.to_json(F.struct(*cols), {"ignoreNullFields": "false"})


def append_chain(new: DataFrame, tails: DataFrame, fields: list[str], key: str = "clinic_id", order: str = "seq", number: str | None = None) -> DataFrame:
    """new with prev_hash and row_hash, chained within each key from the stored tail (key, row_hash) or the genesis.

    number names a column for each entry's place in its chain; tails then have n, how many entries a chain has.

    row_hash = sha256(prev_hash and payload).  A chain is sequential, so a key's new rows pass one task in order, but
    as a sorted stream of which only the last hash is held; payloads are made before, in parallel.  Rows without a key
    have no chain and are left out.
    """
    t = tails.select(F.col(key).alias("__k"), F.col("row_hash").alias("__tail"), (F.col("n") if number else F.lit(0)).cast("long").alias("__n"))
    body = new.where(F.col(key).isNotNull()).withColumn("__p", payload(new, fields))
    body = body.join(t, body[key] == t["__k"], "left").withColumn("__tail", F.coalesce("__tail", F.lit(GENESIS))).withColumn("__n", F.coalesce("__n", F.lit(0).cast("long"))).drop("__k")
    body = body.repartition(key).sortWithinPartitions(key, order, "__p")
    own = [f for f in body.schema.fields if f.name not in ("__p", "__tail", "__n")]
    schema = T.StructType([*own, T.StructField("prev_hash", T.StringType()), T.StructField("row_hash", T.StringType()), *([T.StructField(number, T.LongType())] if number else [])])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, last, n = None, "", 0
        for batch in batches:
            before, after, places = [], [], []
            for k, tail, had, text in zip(*(batch.column(c).to_pylist() for c in (key, "__tail", "__n", "__p")), strict=True):
                if k != at:
                    at, last, n = k, tail, had
                before.append(last)
                last, n = hashlib.sha256((last + text).encode()).hexdigest(), n + 1
                after.append(last)
                places.append(n)
            made = [pa.array(before, pa.string()), pa.array(after, pa.string()), *([pa.array(places, pa.int64())] if number else [])]
            yield pa.RecordBatch.from_arrays([*[batch.column(f.name) for f in own], *made], names=schema.names)

    return body.mapInArrow(fold, schema)


def verify_chain(log: DataFrame, fields: list[str], key: str = "clinic_id", order: str = "seq") -> DataFrame:
    """Per key: entries, tail, and the first row whose link or content is broken (the link is checked first).

    Each row needs only its predecessor's hash, so rows are checked in parallel once that is beside them.
    """
    before = F.coalesce(F.lag("row_hash").over(Window.partitionBy(key).orderBy(order)), F.lit(GENESIS))
    checked = log.withColumn("__before", before)
    again = F.sha2(F.concat("prev_hash", payload(log, fields)), 256)
    reason = F.when(F.col("prev_hash") != F.col("__before"), "link").when(F.col("row_hash") != again, "content")
    checked = checked.select(key, order, "row_hash", reason.alias("reason"))
    broken = F.col("reason").isNotNull()
    return checked.groupBy(key).agg(
        F.count(F.lit(1)).alias("entries"),
        F.max_by("row_hash", order).alias("tail_row_hash"),
        F.max(order).alias("through_seq"),
        F.min(F.when(broken, F.col(order))).alias("first_broken"),
        F.min_by(F.when(broken, F.col("reason")), F.when(broken, F.col(order))).alias("reason"),
        (F.count_if(broken) == 0).alias("intact"),
    )


def verify_from(log: DataFrame, fields: list[str], start_seq: int, key: str = "clinic_id", order: str = "seq") -> DataFrame:
    """Verification anchored at start_seq: that row is taken on trust; a key without it is broken there."""
    later = log.where(F.col(order) >= start_seq)
    anchor = later.where(F.col(order) == start_seq).select(F.col(key).alias("__k"), F.lit(True).alias("anchored"))
    first = F.row_number().over(Window.partitionBy(key).orderBy(order)) == 1
    before = F.lag("row_hash").over(Window.partitionBy(key).orderBy(order))
    again = F.sha2(F.concat("prev_hash", payload(log, fields)), 256)
    rows = later.withColumn("__first", first).withColumn("__b", before).withColumn("reason", F.when(~F.col("__first") & (F.col("prev_hash") != F.col("__b")), "link").when(F.col("row_hash") != again, "content"))
    out = rows.groupBy(key).agg(F.count(F.lit(1)).alias("entries"), F.min(F.when(F.col("reason").isNotNull(), F.col(order))).alias("first_broken"))
    keys = log.select(F.col(key).alias("__id")).distinct()
    out = keys.join(out, F.col("__id") == F.col(key), "left").join(anchor, F.col("__id") == F.col("__k"), "left")
    return out.select(F.col("__id").alias(key), F.coalesce("entries", F.lit(0)).alias("entries"), F.when(F.col("anchored").isNull(), F.lit(start_seq)).otherwise(F.col("first_broken")).alias("first_broken"))


def checkpoint(verified: DataFrame, previous: DataFrame, at: Column, by: str, key: str = "clinic_id") -> tuple[DataFrame, DataFrame]:
    """(new checkpoints for intact chains, report): a broken chain is bounded in time by its last checkpoint."""
    last = previous.groupBy(key).agg(F.max_by(F.struct("verified_through_seq", "verified_at"), "id").alias("last"))
    joined = verified.join(last, key, "left")
    new = verified.where("intact and entries > 0").select(key, F.col("through_seq").alias("verified_through_seq"), "tail_row_hash", F.col("entries").alias("entries_verified"), at.alias("verified_at"), F.lit(by).alias("verified_by"))
    report = joined.select(key, "entries", "intact", "first_broken", "reason", F.when(~F.col("intact"), F.col("last.verified_at")).alias("intact_at"), F.when(~F.col("intact"), F.col("last.verified_through_seq")).alias("intact_through"))
    return new, report


def checkpoint_line(report: DataFrame, key: str = "clinic_id") -> DataFrame:
    """A line of text a chain, for a file outside the log's reach."""
    line = (
        F.when(F.col("entries") == 0, F.concat(F.col(key), F.lit(" EMPTY")))
        .when(F.col("intact"), F.concat(F.col(key), F.lit(" INTACT through "), F.col("through_seq").cast("string"), F.lit(" entries "), F.col("entries").cast("string"), F.lit(" tail "), F.col("tail_row_hash")))
        .otherwise(F.concat(F.col(key), F.lit(" BROKEN at "), F.col("first_broken").cast("string"), F.lit(" ("), F.col("reason"), F.lit(")")))
    )
    return report.select(F.col(key), line.alias("line"))


def salted_hash(salt: Column, text: Column) -> Column:
    return F.sha2(F.concat(salt, text), 256)


def refused(requests: DataFrame) -> DataFrame:
    """Requests whose legal basis is none of LEGAL_BASES (null too), with the reason."""
    return requests.where(~F.coalesce(F.col("legal_basis").isin(LEGAL_BASES), F.lit(False))).withColumn("reason", F.lit("legal_basis"))


def erase(queries: DataFrame, requests: DataFrame, at: Column) -> tuple[DataFrame, DataFrame]:
    """(queries after, new erasure records to chain): text and salt go, the hash stays; a second request does nothing.

    requests has query_id, clinic_id, erased_by, legal_basis (of LEGAL_BASES; see refused for others).
    """
    valid = requests.where(F.col("legal_basis").isin(LEGAL_BASES)).dropDuplicates(["query_id"])
    fresh = valid.join(queries.where(F.col("redacted_at").isNull()).select("query_id"), "query_id", "left_semi")
    hit = fresh.select("query_id", F.lit(True).alias("__hit"))
    out = queries.join(hit, "query_id", "left")
    gone = F.col("__hit").isNotNull()
    out = out.withColumns({"text": F.when(~gone, F.col("text")), "text_salt": F.when(~gone, F.col("text_salt")), "redacted_at": F.when(gone, at).otherwise(F.col("redacted_at"))}).drop("__hit")
    return out, fresh.select("query_id", "clinic_id", "erased_by", "legal_basis", at.alias("erased_at"))


def in_range(log: DataFrame, clinic: str, actor: str | None = None, since=None, until=None) -> DataFrame:
    out = log.where(F.col("clinic_id") == clinic)
    if actor is not None:
        out = out.where(F.col("actor_id") == actor)
    if since is not None:
        out = out.where(F.col("created_at") >= F.lit(since).cast("timestamp"))
    if until is not None:
        out = out.where(F.col("created_at") <= F.lit(until).cast("timestamp"))
    return out


def export(log: DataFrame, chunks: DataFrame, quotes: DataFrame, verified: DataFrame, queries: DataFrame | None = None) -> DataFrame:
    """Entries with their sources as they are today: the ids that no longer resolve, and whether every quote still stands.

    quotes: (seq, chunk_id, quote); gone counts those whose passage no longer exists, changed those that their passage no
    longer holds, spaces aside.  evidential: the chain is intact, every quote matches and every source resolves.

    With queries (query_id, text, text_salt, redacted_at) and a log that has query_id and query_hash, entries carry their
    question, null once it is erased, when it was erased, whether its hash can be verified, which takes the salt, and if so
    whether it is the question's.  An entry whose query is unknown can't be verified.
    """
    ids = log.select("seq", F.posexplode("chunk_ids").alias("i", "chunk_id"))
    there = chunks.select("chunk_id", "content", F.lit(True).alias("there"))
    sources = ids.join(there.drop("content"), "chunk_id", "left").groupBy("seq").agg(F.transform(F.array_sort(F.collect_list(F.when(F.col("there").isNull(), F.struct("i", "chunk_id")))), lambda x: x["chunk_id"]).alias("missing"))
    told = quotes.join(there, "chunk_id", "left")
    stands = F.coalesce(F.contains(normalise_quote(F.col("content")), normalise_quote(F.col("quote"))), F.lit(False))
    told = told.groupBy("seq").agg(F.count(F.lit(1)).alias("quotes"), F.count_if(F.col("there").isNull()).alias("gone"), F.count_if(F.col("there").isNotNull() & ~stands).alias("changed"))
    asked = queries is not None
    out = log.select("seq", "clinic_id", "actor_id", "created_at", *(["query_id", "query_hash"] if asked else []))
    out = out.join(sources, "seq", "left").join(told, "seq", "left").join(verified.select("clinic_id", "intact"), "clinic_id", "left")
    none = F.expr("cast(array() as array<bigint>)")
    out = out.withColumns({"missing": F.coalesce("missing", none), **{c: F.coalesce(c, F.lit(0)) for c in ("quotes", "gone", "changed")}})
    out = out.withColumn("match", F.col("gone") + F.col("changed") == 0).withColumn("evidential", F.col("intact") & F.col("match") & (F.size("missing") == 0))
    if not asked:
        return out
    q = queries.select("query_id", F.col("text").alias("question"), "text_salt", "redacted_at")
    out = out.join(q, "query_id", "left").withColumn("hash_verifiable", F.col("text_salt").isNotNull())
    return out.withColumn("hash_matches", F.when(F.col("hash_verifiable"), salted_hash(F.col("text_salt"), F.col("question")) == F.col("query_hash"))).drop("text_salt")
