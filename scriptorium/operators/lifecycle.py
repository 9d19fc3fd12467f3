"""Editions and aliases over time: registration, supersession, integrity, and the loads that guard them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

MAX_DEPTH = 50


def register(incoming: DataFrame, existing: DataFrame) -> DataFrame:
    """incoming (file_hash, clinic_id, issuing_org, title, version_label, seq) with `outcome`.

    duplicate: the bytes are known or came earlier in this batch; label_conflict: other bytes under a known edition of
    the work; new otherwise.  Works match null-safely on clinic, organisation and title.
    """
    known = existing.select(F.col("file_hash").alias("__h")).distinct()
    first = F.row_number().over(Window.partitionBy("file_hash").orderBy("seq"))
    rows = incoming.withColumn("__n", first).join(known, F.col("file_hash") == F.col("__h"), "left")
    taken = existing.select(*[F.col(c).alias(f"__{c}") for c in ("clinic_id", "issuing_org", "title", "version_label")]).distinct().withColumn("__taken", F.lit(True))
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in ("clinic_id", "issuing_org", "title", "version_label")])
    rows = rows.join(taken, same, "left")
    duplicate = (F.col("__n") > 1) | F.col("__h").isNotNull()
    again = F.row_number().over(Window.partitionBy("clinic_id", "issuing_org", "title", "version_label", duplicate).orderBy("seq")) > 1
    outcome = F.when(duplicate, "duplicate").when(F.col("__taken") | again, "label_conflict").otherwise("new")
    return rows.withColumn("outcome", outcome).select(*incoming.columns, "outcome")


def with_documents(incoming: DataFrame, documents: DataFrame, vocabulary: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(incoming with document_id, documents to create): each work is looked up by clinic, organisation and title, null-safely.

    An id is text: an existing document keeps its own, a new one has the md5 of its key, so the same work in two batches,
    or in one run twice, is one document.  Sector and region come from the organisation (vocabulary: org, sector, region)
    and never from incoming; without a sector it is medical.  An unknown organisation creates nothing: document_id is null.
    """
    key = ("clinic_id", "issuing_org", "title")
    own = documents.select(*[F.col(k).alias(f"__{k}") for k in key], F.col("document_id").cast("string").alias("__id")).groupBy(*[f"__{k}" for k in key]).agg(F.min("__id").alias("__id"))
    v = vocabulary.select(F.col("org").alias("__org"), F.coalesce("sector", F.lit("medical")).alias("__sector"), F.col("region").alias("__region"))
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in key])
    rows = incoming.join(own, same, "left").join(v, F.col("issuing_org") == F.col("__org"), "left")
    made = F.md5(F.to_json(F.struct(*key), {"ignoreNullFields": "false"}))
    rows = rows.withColumn("__made", F.when(F.col("__id").isNull() & F.col("__org").isNotNull(), made))
    new = rows.where("__made is not null").groupBy(F.col("__made").alias("document_id"), *key).agg(F.first("__sector").alias("sector"), F.first("__region").alias("region"))
    return rows.select(*incoming.columns, F.when(F.col("__org").isNotNull(), F.coalesce("__id", "__made")).alias("document_id")), new


def quarantine(versions: DataFrame) -> DataFrame:
    """A licence that nobody affirmed withdraws an edition once it is indexed."""
    return versions.withColumn("status", F.when(F.coalesce(F.col("license_status").isin("public_domain", "licensed"), F.lit(False)), F.col("status")).otherwise("withdrawn"))


def supersede(requests: DataFrame, versions: DataFrame) -> DataFrame:
    """requests (seq, old, new) with `reason` (null: accepted).

    Refused: self, another document's successor, a predecessor or successor that is superseded already (in the table
    or by an earlier request), a pending successor.
    """
    v = versions.select("version_id", "document_id", "status", "superseded_by")
    o = v.select(F.col("version_id").alias("old"), F.col("document_id").alias("__od"), F.col("superseded_by").alias("__os"))
    n = v.select(F.col("version_id").alias("new"), F.col("document_id").alias("__nd"), F.col("superseded_by").alias("__ns"), F.col("status").alias("__nst"))
    rows = requests.join(o, "old", "left").join(n, "new", "left")
    reason = (
        F.when(F.col("old") == F.col("new"), "self")
        .when(F.col("__od").isNull() | F.col("__nd").isNull(), "unknown")
        .when(F.col("__od") != F.col("__nd"), "other_document")
        .when(F.col("__os").isNotNull(), "already_superseded")
        .when(F.col("__ns").isNotNull(), "successor_superseded")
        .when(F.col("__nst") == "pending", "successor_pending")
    )
    rows = rows.withColumn("reason", reason)
    turn = F.row_number().over(Window.partitionBy("old", F.col("reason").isNull()).orderBy("seq"))
    rows = rows.withColumn("reason", F.when(F.col("reason").isNull() & (turn > 1), "already_superseded").otherwise(F.col("reason")))
    # a successor that an earlier accepted request retires
    retired = rows.where("reason is null").select(F.col("old").alias("new"), F.col("seq").alias("__when"))
    rows = rows.join(retired, "new", "left")
    return rows.select("seq", "old", "new", F.when(F.col("reason").isNull() & (F.col("__when") < F.col("seq")), "successor_superseded").otherwise(F.col("reason")).alias("reason"))


def apply_supersession(versions: DataFrame, accepted: DataFrame) -> DataFrame:
    """versions after accepted (old, new): predecessors point on and are archived."""
    a = accepted.select(F.col("old").alias("version_id"), F.col("new").alias("__new"))
    out = versions.join(a, "version_id", "left")
    return out.withColumns({"superseded_by": F.coalesce("__new", "superseded_by"), "status": F.when(F.col("__new").isNotNull(), "archived").otherwise(F.col("status"))}).drop("__new").select(*versions.columns)


def latest_edition(versions: DataFrame, depth: int = MAX_DEPTH) -> DataFrame:
    """(version_id, latest_id, hops): the end of each edition's chain by pointer doubling; a start that needs more than
    depth hops, or never ends, has no row."""
    jump = versions.select("version_id", F.col("superseded_by").alias("at"), F.when(F.col("superseded_by").isNull(), 0).otherwise(1).alias("hops"), F.coalesce("superseded_by", "version_id").alias("to"))
    jump = jump.select("version_id", "to", "hops")
    steps = 1
    while steps < depth:
        ahead = jump.select(F.col("version_id").alias("to"), F.col("to").alias("__to"), F.col("hops").alias("__hops"))
        jump = jump.join(ahead, "to", "left").select("version_id", F.coalesce("__to", "to").alias("to"), (F.col("hops") + F.coalesce("__hops", F.lit(0))).alias("hops"))
        steps *= 2
    ends = versions.where(F.col("superseded_by").isNull()).select(F.col("version_id").alias("to"))
    return jump.where(F.col("hops") <= depth).join(ends, "to", "left_semi").select("version_id", F.col("to").alias("latest_id"), F.col("hops").cast("long").alias("hops"))


def cycles(versions: DataFrame, depth: int = MAX_DEPTH) -> DataFrame:
    """Editions whose chain doesn't end within depth hops."""
    return versions.select("version_id").join(latest_edition(versions, depth), "version_id", "left_anti")


def tails(versions: DataFrame) -> DataFrame:
    """Active editions that nothing supersedes; a document may have several."""
    return versions.where(F.col("superseded_by").isNull() & (F.col("status") == "active"))


def withdraw(versions: DataFrame, documents: DataFrame, reason: str, orgs: list[str] | None = None, ids: list | None = None, title_part: str | None = None, restore: bool = False) -> tuple[DataFrame, DataFrame]:
    """(versions after, report): selectors are or-ed, a reason is needed, and a selected edition that stays as it is is a no-op."""
    if not reason.strip():
        raise ValueError("a reason is needed")
    picks: list[Column] = []
    if orgs:
        picks.append(F.col("issuing_org").isin(orgs))
    if ids:
        picks.append(F.col("version_id").isin(ids))
    if title_part:
        picks.append(F.col("title").contains(title_part))
    if not picks:
        raise ValueError("nothing selected")
    wide = versions.join(documents.select("document_id", "issuing_org", "title"), "document_id")
    aim = "active" if restore else "withdrawn"
    can = F.col("status") == "withdrawn" if restore else F.col("status") != "withdrawn"
    picked = reduce(lambda a, b: a | b, picks)
    out = wide.withColumn("new_status", F.when(picked & can, aim).otherwise(F.col("status")))
    report = out.where(picked).select("version_id", "status", "new_status", (F.col("status") == F.col("new_status")).alias("no_op"), F.lit(reason).alias("reason"))
    return out.drop("status", "issuing_org", "title").withColumnRenamed("new_status", "status"), report


def inventory(documents: DataFrame, versions: DataFrame, chunks: DataFrame) -> DataFrame:
    """Chunks by organisation, title and status, editions without one included."""
    n = chunks.groupBy("version_id").agg(F.count(F.lit(1)).alias("n"))
    return versions.join(n, "version_id", "left").join(documents.select("document_id", "issuing_org", "title"), "document_id").groupBy("issuing_org", "title", "status").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("chunks"))


def drift(documents: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Documents whose stored sector isn't the one their organisation has; unknown organisations are flagged.

    An organisation that declares no sector is medical.
    """
    v = vocabulary.select(F.col("org").alias("issuing_org"), F.coalesce("sector", F.lit("medical")).alias("derived"), "region")
    out = documents.join(v, "issuing_org", "left")
    return out.select("document_id", "issuing_org", "sector", "derived", "region", F.when(F.col("derived").isNull(), "unknown_org").when(F.col("derived") != F.col("sector"), "drift").otherwise("ok").alias("state"))


def hash_state(registered: DataFrame, files: DataFrame, placeholder: Column) -> DataFrame:
    """file_missing, placeholder, ok or CONTENT_CHANGED for each registered hash against what the files hash to."""
    f = files.select("version_id", F.col("file_hash").alias("__actual"))
    out = registered.join(f, "version_id", "left")
    state = F.when(F.col("__actual").isNull(), "file_missing").when(placeholder, "placeholder").when(F.col("__actual") == F.col("file_hash"), "ok").otherwise("CONTENT_CHANGED")
    return out.select(*registered.columns, state.alias("state"))


def delete_uncited(chunks: DataFrame, audit: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(deleted, refused): a chunk that the audit log cites stays."""
    cited = audit.select(F.explode("chunk_ids").alias("chunk_id")).distinct()
    return chunks.join(cited, "chunk_id", "left_anti"), chunks.join(cited, "chunk_id", "left_semi")


def load_aliases(rows: DataFrame, existing: DataFrame, source: str) -> DataFrame:
    """rows (row_no, alias, generic_name) with `outcome` and `detail`.

    rejected rows break a rule; contested aliases have more than one generic name in the file; of the rest, equal ones
    are unchanged, different ones conflict, others are inserted, once.
    """
    if not source.strip():
        raise ValueError("a source is needed")
    a, g = F.trim("alias"), F.trim("generic_name")
    reason = (
        F.when(F.coalesce(a, F.lit("")) == "", "no_alias")
        .when(F.coalesce(g, F.lit("")) == "", "no_generic_name")
        .when(a != F.lower(a), "upper_case")
        .when(a == F.lower(g), "own_generic_name")
        .when((F.length(a) > 128) | (F.length(g) > 128), "too_long")
        .when(F.length(a) < 3, "too_short")
    )
    rows = rows.select("row_no", a.alias("alias"), g.alias("generic_name"), reason.alias("detail"))
    good = F.col("detail").isNull()
    names = rows.where(good).groupBy("alias").agg(F.count_distinct("generic_name").alias("__names"), F.min("row_no").alias("__first"))
    known = existing.select("alias", F.col("generic_name").alias("__known"))
    out = rows.join(names, "alias", "left").join(known, "alias", "left")
    outcome = F.when(~good, "rejected").when(F.col("__names") > 1, "contested").when(F.col("__known") == F.col("generic_name"), "unchanged").when(F.col("__known").isNotNull(), "conflict").when(F.col("row_no") > F.col("__first"), "repeated").otherwise("inserted")
    return out.select("row_no", "alias", "generic_name", outcome.alias("outcome"), F.when(outcome == "conflict", F.col("__known")).otherwise(F.col("detail")).alias("detail"))


def load_report(loaded: DataFrame) -> DataFrame:
    """One row of counts; a contest refuses the whole file."""
    count = lambda o: F.count_if(F.col("outcome") == o).alias(o)
    return loaded.agg(*[count(o) for o in ("inserted", "unchanged", "conflict", "contested", "rejected", "repeated")], (F.count_if(F.col("outcome") == "contested") == 0).alias("accepted"))


def new_rows(candidates: DataFrame, chunks: DataFrame) -> DataFrame:
    """Insert-only: candidate rows (version_id, page, content, seq) whose content the version hasn't, with the next ordinals."""
    fresh = candidates.join(chunks.select("version_id", "content"), ["version_id", "content"], "left_anti")
    top = chunks.groupBy("version_id").agg(F.max("ordinal").alias("__top"))
    n = F.row_number().over(Window.partitionBy("version_id").orderBy("seq"))
    return fresh.join(top, "version_id", "left").select("version_id", "page", "content", (F.coalesce(F.col("__top"), F.lit(-1)) + n).alias("ordinal"))


def replaced_rows(old: DataFrame, new: DataFrame, replaces) -> DataFrame:
    """(old_id, new_id): the first new row (by ordinal) on the same page that old is a truncated reading of."""
    o = old.select("version_id", "page", F.col("chunk_id").alias("old_id"), F.col("content").alias("__old"))
    n = new.select("version_id", "page", F.col("chunk_id").alias("new_id"), F.col("content").alias("__new"), "ordinal")
    pairs = o.join(n, ["version_id", "page"]).where((F.col("old_id") != F.col("new_id")) & replaces(F.col("__old"), F.col("__new")))
    return pairs.groupBy("old_id").agg(F.min_by("new_id", "ordinal").alias("new_id"))


def set_superseded(chunks: DataFrame, pairs: DataFrame) -> DataFrame:
    p = pairs.select(F.col("old_id").alias("chunk_id"), F.col("new_id").alias("__by"))
    return chunks.join(p, "chunk_id", "left").withColumn("superseded_by", F.coalesce("__by", "superseded_by")).drop("__by").select(*chunks.columns)


def memoise(requests: DataFrame, cache: DataFrame, parts: list[str]) -> tuple[DataFrame, DataFrame]:
    """(hits, misses): the key is the sha256 of the parts, each ended by NUL; declines are answers too and stay cached."""
    key = F.sha2(F.concat(*[F.concat(F.coalesce(F.col(p).cast("string"), F.lit("")), F.lit("\0")) for p in parts]), 256)
    keyed = requests.withColumn("cache_key", key)
    return keyed.join(cache, "cache_key"), keyed.join(cache, "cache_key", "left_anti").dropDuplicates(["cache_key"])
