"""Queries on the audit trail, citations and evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.corpus import Corpus, with_views
from scriptorium.functions import text as X
from scriptorium.operators import audit as A
from scriptorium.operators import citations as C
from scriptorium.plans import search as PS
from scriptorium.plans.registry import query
from scriptorium.shared import kept

_PAYLOAD = """paid AS (SELECT *, '{"actor_id":"' || actor_id || '","chunk_ids":[' || array_to_string(chunk_ids, ',') || '],"clinic_id":"' || clinic_id || '","created_at":"' || strftime(created_at, '%Y-%m-%dT%H:%M:%S.%fZ') || '","error":' || coalesce('"' || error || '"', 'null') || ',"response":"' || replace(response, '"', '\\"') || '"}' AS payload FROM audit)"""
_CHAIN = """folded AS (SELECT clinic_id, list(seq ORDER BY seq) AS seqs, list_reduce(list_prepend([repeat('0', 64)], list(CAST([payload] AS VARCHAR[]) ORDER BY seq)), lambda acc, p: list_append(acc, sha256(acc[-1] || p[1]))) AS hashes FROM paid GROUP BY clinic_id),
chained AS (SELECT clinic_id, unnest(seqs) AS seq, unnest(hashes[:-2]) AS prev_hash, unnest(hashes[2:]) AS row_hash FROM folded)"""


def chained(c: Corpus) -> DataFrame:
    log = c.audit_log()
    return A.append_chain(log, log.select("clinic_id", F.lit("").alias("row_hash")).where(F.lit(False)), A.ENTRY)


@query("j5_canonical_json", f"{with_views('audit')}, {_PAYLOAD} SELECT seq, sha256(payload) AS payload_sha256 FROM paid")
def j5_canonical_json(c: Corpus) -> DataFrame:
    log = c.audit_log()
    return log.select("seq", F.sha2(A.payload(log, A.ENTRY), 256).alias("payload_sha256"))


@query("i4_chain_append", f"{with_views('audit')}, {_PAYLOAD}, {_CHAIN} SELECT clinic_id, seq, prev_hash, row_hash FROM chained")
def i4_chain_append(c: Corpus) -> DataFrame:
    return chained(c).select("clinic_id", "seq", "prev_hash", "row_hash")


def tampered(c: Corpus) -> DataFrame:
    """Some responses edited after the fact, and some rows lost."""
    t = chained(c).where("seq % 997 <> 5")
    return t.withColumn("response", F.when(F.col("seq") % 701 == 3, F.lit("{}")).otherwise(F.col("response")))


_TAMPERED = """t AS (SELECT p.* REPLACE (CASE WHEN seq % 701 = 3 THEN '{}' ELSE response END AS response), c.prev_hash, c.row_hash, seq % 701 = 3 AS edited FROM paid p JOIN chained c USING (clinic_id, seq) WHERE seq % 997 <> 5),
checked AS (SELECT *, CASE WHEN prev_hash <> coalesce(lag(row_hash) OVER (PARTITION BY clinic_id ORDER BY seq), repeat('0', 64)) THEN 'link' WHEN edited THEN 'content' END AS reason FROM t)"""


@query(
    "i2_chain_verify",
    f"{with_views('audit')}, {_PAYLOAD}, {_CHAIN}, {_TAMPERED} SELECT clinic_id, count(*) AS entries, max(seq) AS through_seq, arg_max(row_hash, seq) AS tail_row_hash, min(seq) FILTER (reason IS NOT NULL) AS first_broken, arg_min(reason, seq) FILTER (reason IS NOT NULL) AS reason, count(reason) = 0 AS intact FROM checked GROUP BY clinic_id",
)
def i2_chain_verify(c: Corpus) -> DataFrame:
    return A.verify_chain(tampered(c), A.ENTRY)


@query(
    "j8_bounds_of_a_break",
    f"""{with_views('audit')}, {_PAYLOAD}, {_CHAIN}, {_TAMPERED}, old AS (SELECT clinic_id, max(seq) AS through FROM paid WHERE created_at < TIMESTAMP '2024-01-16 00:00:00' GROUP BY clinic_id), r AS (SELECT clinic_id, count(*) AS entries, count(reason) = 0 AS intact, min(seq) FILTER (reason IS NOT NULL) AS first_broken, arg_min(reason, seq) FILTER (reason IS NOT NULL) AS reason FROM checked GROUP BY clinic_id)
SELECT r.*, CASE WHEN NOT intact THEN through END AS intact_through, CASE WHEN NOT intact AND through IS NOT NULL THEN '2024-01-16' END AS intact_at FROM r LEFT JOIN old USING (clinic_id)""",
)
def j8_bounds_of_a_break(c: Corpus) -> DataFrame:
    """The chains as they were in the middle of the month gave checkpoints; what broke later is bounded by them."""
    then = kept(chained(c), "chained")
    old, _ = A.checkpoint(A.verify_chain(then.where("created_at < timestamp '2024-01-16 00:00:00'"), A.ENTRY), then.select("clinic_id", F.lit(0).alias("id"), F.lit(0).cast("long").alias("verified_through_seq"), F.lit("").alias("verified_at")).where(F.lit(False)), F.lit("2024-01-16"), "scheduler")
    previous = old.select("clinic_id", F.lit(1).alias("id"), "verified_through_seq", "verified_at")
    _, report = A.checkpoint(A.verify_chain(tampered(c), A.ENTRY), previous, F.lit("2024-02-01"), "scheduler")
    return report


@query(
    "j8_verify_and_checkpoint",
    f"{with_views('audit')}, {_PAYLOAD}, {_CHAIN}, {_TAMPERED} SELECT clinic_id, max(seq) AS verified_through_seq, arg_max(row_hash, seq) AS tail_row_hash, count(*) AS entries_verified FROM checked GROUP BY clinic_id HAVING count(reason) = 0",
)
def j8_verify_and_checkpoint(c: Corpus) -> DataFrame:
    verified = A.verify_chain(tampered(c), A.ENTRY)
    previous = verified.select("clinic_id", F.lit(1).alias("id"), F.lit(0).alias("verified_through_seq"), F.lit("2024-01-01").alias("verified_at")).where(F.lit(False))
    new, _ = A.checkpoint(verified, previous, F.lit("2024-02-01"), "scheduler")
    return new.select("clinic_id", "verified_through_seq", "tail_row_hash", "entries_verified")


@query(
    "a10_checkpoint_lines",
    f"""{with_views('audit')}, {_PAYLOAD}, {_CHAIN}, {_TAMPERED} SELECT clinic_id, CASE WHEN count(reason) = 0 THEN clinic_id || ' INTACT through ' || max(seq) || ' entries ' || count(*) || ' tail ' || arg_max(row_hash, seq)
ELSE clinic_id || ' BROKEN at ' || min(seq) FILTER (reason IS NOT NULL) || ' (' || arg_min(reason, seq) FILTER (reason IS NOT NULL) || ')' END AS line FROM checked GROUP BY clinic_id""",
)
def a10_checkpoint_lines(c: Corpus) -> DataFrame:
    return A.checkpoint_line(A.verify_chain(tampered(c), A.ENTRY))


@query("i9_latest_per_clinic", f"{with_views('audit')} SELECT clinic_id, max(seq) AS seq, arg_max(response, seq) AS response FROM audit GROUP BY clinic_id")
def i9_latest_per_clinic(c: Corpus) -> DataFrame:
    return c.audit_log().groupBy("clinic_id").agg(F.max("seq").alias("seq"), F.max_by("response", "seq").alias("response"))


@query("h3_clinics", f"{with_views('audit')} SELECT DISTINCT clinic_id FROM audit")
def h3_clinics(c: Corpus) -> DataFrame:
    return c.audit_log().select("clinic_id").distinct()


@query("b9_audit_range", f"{with_views('audit')} SELECT seq, actor_id, created_at FROM audit WHERE clinic_id = 'clinic8' AND actor_id = 'actor0' AND created_at >= TIMESTAMP '2024-01-02 00:00:00' AND created_at <= TIMESTAMP '2024-01-20 00:00:00'")
def b9_audit_range(c: Corpus) -> DataFrame:
    out = A.in_range(c.audit_log(), "clinic8", "actor0", "2024-01-02 00:00:00", "2024-01-20 00:00:00")
    return out.select("seq", "actor_id", F.col("created_at").cast("timestamp_ntz").alias("created_at"))


@query("j4_salted_hashing", "SELECT conv_id, turn, sha256('salt' || conv_id || text) AS text_hash FROM conversations")
def j4_salted_hashing(c: Corpus) -> DataFrame:
    salt = F.concat(F.lit("salt"), F.col("conv_id").cast("string"))
    return c.table("conversations").select("conv_id", "turn", A.salted_hash(salt, F.col("text")).alias("text_hash"))


@query(
    "j6_erasure",
    """SELECT query_id, CASE WHEN query_id % 5 <> 0 OR query_id % 3 = 0 THEN text END AS text, query_id % 5 = 0 AS redacted, query_id % 5 = 0 AND query_id % 3 <> 0 AS recorded FROM (
SELECT conv_id * 1000 + turn AS query_id, text FROM conversations) WHERE NOT (query_id % 5 = 0 AND query_id % 3 = 0) UNION ALL SELECT conv_id * 1000 + turn, text, false, false FROM conversations WHERE (conv_id * 1000 + turn) % 15 = 0""",
)
def j6_erasure(c: Corpus) -> DataFrame:
    q = c.table("conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), "text", F.lit("s").alias("text_salt"), F.lit(None).cast("timestamp").alias("redacted_at"))
    r = q.where("query_id % 5 = 0").select("query_id", F.lit("c").alias("clinic_id"), F.lit("dpo").alias("erased_by"), F.when(F.col("query_id") % 3 == 0, "curiosity").otherwise("objection").alias("legal_basis"))
    out, records = A.erase(q, r, F.lit("2024-03-01").cast("timestamp"))
    return out.join(records.select("query_id", F.lit(True).alias("recorded")), "query_id", "left").select("query_id", "text", F.col("redacted_at").isNotNull().alias("redacted"), F.coalesce("recorded", F.lit(False)).alias("recorded"))


@query(
    "i3_erasure_chain",
    """WITH q AS (SELECT DISTINCT conv_id * 1000 AS seq, 'c' || (conv_id % 3) AS clinic_id FROM conversations), p AS (SELECT *, '{"clinic_id":"' || clinic_id || '","erased_at":"2024-03-01T00:00:00.000000Z","erased_by":"dpo","legal_basis":"objection","query_id":"' || seq || '"}' AS payload FROM q),
f AS (SELECT clinic_id, list_reduce(list_prepend(repeat('0', 64), list(payload ORDER BY seq)), lambda a, b: sha256(a || b)) AS tail_row_hash, count(*) AS entries FROM p GROUP BY clinic_id) SELECT clinic_id, entries, tail_row_hash, true AS intact FROM f""",
)
def i3_erasure_chain(c: Corpus) -> DataFrame:
    q = c.table("conversations").select((F.col("conv_id") * 1000).alias("seq"), F.concat(F.lit("c"), F.col("conv_id") % 3).alias("clinic_id")).distinct()
    q = q.withColumns({"erased_at": F.lit("2024-03-01").cast("timestamp"), "erased_by": F.lit("dpo"), "legal_basis": F.lit("objection"), "query_id": F.col("seq").cast("string")})
    log = A.append_chain(q, q.select("clinic_id", F.lit("").alias("row_hash")).where(F.lit(False)), A.ERASURE)
    return A.verify_chain(log, A.ERASURE).select("clinic_id", "entries", "tail_row_hash", "intact")


@query(
    "j7_audit_export",
    f"""{with_views('chunks', 'audit')}, {_PAYLOAD}, {_CHAIN}, {_TAMPERED}, intact AS (SELECT clinic_id, count(reason) = 0 AS intact FROM checked GROUP BY clinic_id),
cited AS (SELECT seq, unnest(chunk_ids) AS chunk_id, generate_subscripts(chunk_ids, 1) AS i FROM audit), s AS (SELECT seq, list(chunk_id ORDER BY i) FILTER (c.content IS NULL) AS missing FROM cited LEFT JOIN chunks c USING (chunk_id) GROUP BY seq),
q AS (SELECT seq, bool_and(coalesce(contains(c.content, CASE WHEN seq % 6 = 0 THEN 'fabricated words' ELSE left(c.content, 12) END), false)) AS match FROM cited LEFT JOIN chunks c USING (chunk_id) WHERE i = 1 GROUP BY seq)
SELECT seq, clinic_id, coalesce(array_to_string(missing, ','), '') AS missing, match, intact AND match AND missing IS NULL AS evidential FROM audit JOIN s USING (seq) JOIN q USING (seq) JOIN intact USING (clinic_id)""",
)
def j7_audit_export(c: Corpus) -> DataFrame:
    log, chunks = c.audit_log(), c.chunks()
    first = log.select("seq", F.col("chunk_ids")[0].alias("chunk_id")).join(chunks.select("chunk_id", "content"), "chunk_id", "left")
    quotes = first.select("seq", "chunk_id", F.when(F.col("seq") % 6 == 0, "fabricated words").otherwise(F.substring("content", 1, 12)).alias("quote"))
    out = A.export(log, chunks, quotes, A.verify_chain(tampered(c), A.ENTRY))
    return out.select("seq", "clinic_id", F.array_join(F.col("missing").cast("array<string>"), ",").alias("missing"), "match", "evidential")


@query(
    "j7_export_with_questions",
    f"""{with_views('chunks', 'audit')}, {_PAYLOAD}, {_CHAIN}, {_TAMPERED}, intact AS (SELECT clinic_id, count(reason) = 0 AS intact FROM checked GROUP BY clinic_id),
q AS (SELECT conv_id * 1000 + turn AS query_id, any_value(CASE WHEN conv_id % 3 <> 0 THEN text END) AS question, any_value(CASE WHEN conv_id % 3 <> 0 THEN 'salt' || conv_id END) AS salt, any_value(conv_id % 3 = 0) AS erased FROM (SELECT conv_id, turn, min(text) AS text FROM conversations GROUP BY ALL) GROUP BY ALL),
e AS (SELECT a.seq, a.clinic_id, CAST(substr(a.clinic_id, 7) AS BIGINT) * 1000 + a.seq % 3 AS query_id, a.chunk_ids, c.content FROM audit a LEFT JOIN chunks c ON c.chunk_id = a.chunk_ids[1]),
s AS (SELECT seq, count(*) FILTER (c.content IS NULL) AS missing FROM (SELECT seq, unnest(chunk_ids) AS chunk_id FROM audit) LEFT JOIN chunks c USING (chunk_id) GROUP BY seq)
SELECT e.seq, e.query_id, sha256(q.question) AS question_sha256, q.erased AS erased, q.salt IS NOT NULL AS hash_verifiable, CASE WHEN q.salt IS NOT NULL THEN e.seq % 7 <> 0 END AS hash_matches, CASE WHEN content IS NULL THEN 1 ELSE 0 END AS gone, CASE WHEN content IS NOT NULL AND e.seq % 6 = 0 THEN 1 ELSE 0 END AS changed,
  i.intact AND content IS NOT NULL AND e.seq % 6 <> 0 AND s.missing = 0 AS evidential FROM e JOIN s USING (seq) JOIN intact i USING (clinic_id) LEFT JOIN q USING (query_id)""",
)
def j7_export_with_questions(c: Corpus) -> DataFrame:
    """Entries with the turn that asked: a third of the turns are erased, some are unknown, and every seventh entry has
    another text's hash; quotes are told with other spaces than their passage has."""
    said = c.table("conversations").groupBy("conv_id", "turn").agg(F.min("text").alias("text"))
    live = F.col("conv_id") % 3 != 0
    salt = F.concat(F.lit("salt"), F.col("conv_id"))
    asked = said.select((F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), "text", salt.alias("salt"), live.alias("live"))
    queries = asked.select("query_id", F.when(F.col("live"), F.col("text")).alias("text"), F.when(F.col("live"), F.col("salt")).alias("text_salt"), F.when(~F.col("live"), F.lit("2024-03-01").cast("timestamp")).alias("redacted_at"))
    query_id = F.substring("clinic_id", 7, 20).cast("long") * 1000 + F.col("seq") % 3
    log, chunks = c.audit_log().withColumn("query_id", query_id), c.chunks()
    taken = F.when(F.col("seq") % 7 == 0, "other").otherwise(A.salted_hash(F.col("salt"), F.col("text")))
    log = log.join(asked, "query_id", "left").withColumn("query_hash", taken).drop("text", "salt", "live")
    first = log.select("seq", F.col("chunk_ids")[0].alias("chunk_id")).join(chunks.select("chunk_id", "content"), "chunk_id", "left")
    quote = F.concat(F.lit(" "), F.replace(F.substring("content", 1, 30), F.lit(" "), F.lit("  ")), F.lit("\n"))
    quotes = first.select("seq", "chunk_id", F.when(F.col("seq") % 6 == 0, "fabricated words").otherwise(quote).alias("quote"))
    out = A.export(log, chunks, quotes, A.verify_chain(tampered(c), A.ENTRY), queries)
    erased = F.when(F.col("redacted_at").isNotNull(), True).when(F.col("hash_verifiable"), False)
    return out.select("seq", "query_id", F.sha2("question", 256).alias("question_sha256"), erased.alias("erased"), "hash_verifiable", "hash_matches", "gone", "changed", "evidential")


_CITATIONS = """cites AS (SELECT h.query_id, h.chunk_id, h.rank, CASE h.rank % 5 WHEN 0 THEN left(c.content, 30) WHEN 1 THEN '  ' || replace(left(c.content, 40), ' ', '  ') || chr(10) WHEN 2 THEN 'fabricated ' || left(c.content, 10) WHEN 3 THEN '  ' ELSE left(c.content, 30) END AS quote FROM hits h JOIN chunks c USING (chunk_id)
  UNION ALL SELECT query_id, -1, 99, 'x' FROM questions WHERE query_id % 3 = 0)"""
_REASONS = """reasons AS (SELECT t.query_id, t.chunk_id, CASE WHEN c.content IS NULL THEN 'not_retrieved' WHEN trim(regexp_replace(quote, '\\s+', ' ', 'g')) = '' THEN 'empty' WHEN NOT contains(trim(regexp_replace(c.content, '\\s+', ' ', 'g')), trim(regexp_replace(quote, '\\s+', ' ', 'g'))) THEN 'not_contained' END AS reason FROM cites t LEFT JOIN chunks c USING (chunk_id))"""


def cited(c: Corpus) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Citations of the hits and some stray ones, the hits, and the chunks that search may return."""
    s = PS.stored(c)
    hits = kept(PS.hybrid(c, s=s).join(s.select("chunk_id", F.substring("content", 1, 40).alias("content")), "chunk_id"), "hits")
    k = F.col("rank") % 5
    head = lambda n: F.substring("content", 1, n)
    quote = F.when(k == 0, head(30)).when(k == 1, F.concat(F.lit("  "), F.replace(head(40), F.lit(" "), F.lit("  ")), F.lit("\n"))).when(k == 2, F.concat(F.lit("fabricated "), head(10))).when(k == 3, F.lit("  ")).otherwise(head(30))
    cites = hits.select("query_id", "chunk_id", quote.alias("quote"))
    stray = c.questions().where("query_id % 3 = 0").select("query_id", F.lit(-1).cast("long").alias("chunk_id"), F.lit("x").alias("quote"))
    return cites.unionByName(stray), hits.select("query_id", "chunk_id"), s.select("chunk_id", "content")


@query("j1_verbatim_validation", f"{PS.HYBRID}, {_CITATIONS}, {_REASONS} SELECT query_id, chunk_id, reason FROM reasons")
def j1_verbatim_validation(c: Corpus) -> DataFrame:
    return C.validate(*cited(c)).select("query_id", "chunk_id", "reason")


@query(
    "j2_guarded_answers",
    f"""{PS.HYBRID}, {_CITATIONS}, {_REASONS} SELECT q.query_id, count(chunk_id) FILTER (reason IS NULL) AS kept, count(reason) AS rejected, CASE WHEN count(chunk_id) FILTER (reason IS NULL) > 0 THEN NULL WHEN count(reason) > 0 THEN 'verification_failed' ELSE 'sources_do_not_answer' END AS no_answer_reason
FROM questions q LEFT JOIN reasons r USING (query_id) GROUP BY q.query_id""",
)
def j2_guarded_answers(c: Corpus) -> DataFrame:
    out = C.answers(C.guard_rows(C.validate(*cited(c))), c.questions())
    return out.select("query_id", F.size("kept").cast("long").alias("kept"), "rejected", "no_answer_reason")


@query(
    "j3_answer_assembly",
    f"""{PS.HYBRID_20}, sel AS (SELECT query_id, (query_id // 7) % 14 + 1 AS source FROM questions) SELECT s.query_id, h.chunk_id, CAST(s.source AS BIGINT) AS source, h.chunk_id IS NULL AS dropped FROM sel s LEFT JOIN hits h ON h.query_id = s.query_id AND h.rank = s.source AND h.rank <= 12""",
)
def j3_answer_assembly(c: Corpus) -> DataFrame:
    sel = c.questions().select("query_id", (F.floor(F.col("query_id") / 7) % 14 + 1).alias("source"))
    kept, dropped = C.assemble(sel, PS.hybrid(c, 20))
    out = sel.join(kept.select("query_id", "chunk_id"), "query_id", "left").join(dropped, "query_id", "left")
    return out.select("query_id", "chunk_id", F.col("source").cast("long").alias("source"), (F.col("out_of_range") > 0).alias("dropped"))


@query(
    "j3_answer_reasons",
    f"""{with_views('docs', 'versions', 'chunks', 'questions')}, {PS.SEARCHABLE}, {PS._POSTINGS}, {PS._LEXICAL}, sel AS (SELECT query_id, unnest([query_id % 14, query_id % 14 + 2]) AS source FROM questions WHERE query_id % 5 <> 0),
h AS (SELECT query_id, count(*) AS hits FROM lexical_hits GROUP BY ALL), j AS (SELECT s.query_id, l.chunk_id, c.version_id FROM sel s LEFT JOIN lexical_hits l ON l.query_id = s.query_id AND l.rank = s.source AND l.rank <= 12 LEFT JOIN chunks c USING (chunk_id)),
n AS (SELECT query_id, count(chunk_id) AS citations, count(DISTINCT version_id) AS editions, count(*) - count(chunk_id) AS missed FROM j GROUP BY ALL)
SELECT q.query_id, coalesce(citations, 0) AS citations, coalesce(editions, 0) AS editions, CASE WHEN hits IS NULL THEN 0 ELSE coalesce(missed, 0) END AS out_of_range, CASE WHEN hits IS NULL THEN 'no_relevant_sources' WHEN coalesce(citations, 0) = 0 THEN 'sources_do_not_answer' END AS no_answer_reason FROM (SELECT DISTINCT query_id FROM questions) q LEFT JOIN h USING (query_id) LEFT JOIN n USING (query_id)""",
)
def j3_answer_reasons(c: Corpus) -> DataFrame:
    """Two selections a question from its lexical hits, some of them of no hit; every fifth question selects nothing."""
    q = c.questions()
    sel = q.where("query_id % 5 <> 0").select("query_id", F.explode(F.array(F.col("query_id") % 14, F.col("query_id") % 14 + 2)).alias("source"))
    hits = kept(PS.lexical(c).join(c.chunks().select("chunk_id", "version_id"), "chunk_id").select("query_id", "chunk_id", "version_id", "rank"), "hits")
    return C.answer_reasons(sel, hits, q)


_GRAMS = "list_distinct(list_transform(range(1, len({w}) - 2), lambda i: array_to_string({w}[i:i + 3], ' ')))"
_QUOTES = f"""quotes AS (SELECT b.item_id AS quote_id, b.text AS quote, d.text AS cited, regexp_extract_all(lower(b.text), '[a-z0-9]+') AS qw, regexp_extract_all(lower(d.text), '[a-z0-9]+') AS cw FROM benchmark b JOIN documents d ON d.doc_id = b.item_id * 3),
gq AS (SELECT *, CASE WHEN len(qw) >= 4 THEN {_GRAMS.format(w="qw")} ELSE [] END AS g, CASE WHEN len(cw) >= 4 THEN {_GRAMS.format(w="cw")} ELSE [] END AS cg FROM quotes),
corpus AS (SELECT DISTINCT unnest(CASE WHEN len(w) >= 4 THEN {_GRAMS.format(w="w")} ELSE [] END) AS gram FROM (SELECT regexp_extract_all(lower(content), '[a-z0-9]+') AS w FROM searchable)),
wanted AS (SELECT quote_id, unnest(list_filter(g, lambda x: NOT list_contains(cg, x))) AS gram FROM gq), el AS (SELECT quote_id, count(*) AS elsewhere FROM wanted WHERE gram IN (SELECT gram FROM corpus) GROUP BY ALL)"""


@query(
    "i5_quote_diagnosis",
    f"""{with_views('docs', 'versions', 'chunks')}, {PS.SEARCHABLE}, {_QUOTES} SELECT quote_id, CAST(len(g) AS BIGINT) AS n_grams, CAST(len(list_intersect(g, cg)) AS BIGINT) AS in_cited, coalesce(elsewhere, 0) AS elsewhere,
CASE WHEN contains(cited, quote) THEN 'clean' WHEN contains(trim(regexp_replace(cited, '\\s+', ' ', 'g')), trim(regexp_replace(quote, '\\s+', ' ', 'g'))) THEN 'typography'
  WHEN contains(cited, trim(quote, ' .,;:"''()[]“”‘’')) THEN 'boundary' WHEN len(qw) < 4 THEN 'paraphrase' WHEN coalesce(elsewhere, 0) > 0 THEN 'synthesis' WHEN len(list_intersect(g, cg)) = 0 THEN 'parametric_leak' ELSE 'paraphrase' END AS verdict FROM gq LEFT JOIN el USING (quote_id)""",
)
def i5_quote_diagnosis(c: Corpus) -> DataFrame:
    b = c.table("benchmark").select(F.col("item_id").alias("quote_id"), F.col("text").alias("quote"), (F.col("item_id") * 3).alias("doc_id"))
    quotes = b.join(c.table("documents").select("doc_id", F.col("text").alias("cited")), "doc_id").withColumn("others", F.expr("cast(array() as array<string>)"))
    return C.diagnose(quotes, PS._searchable(c)).drop("passage", "overlap")


@query(
    "i5_other_passages",
    """WITH q AS (SELECT b.item_id AS quote_id, b.text AS quote, d.text AS cited, o.text AS other, regexp_extract_all(lower(b.text), '[a-z0-9]+') AS w, regexp_extract_all(lower(d.text), '[a-z0-9]+') AS cw FROM benchmark b JOIN documents d ON d.doc_id = b.item_id * 3 JOIN documents o ON o.doc_id = b.item_id * 3 + 1),
n AS (SELECT *, trim(regexp_replace(nfc_normalize(quote), '\\s+', ' ', 'g')) AS nq, trim(regexp_replace(nfc_normalize(cited), '\\s+', ' ', 'g')) AS nc, trim(regexp_replace(nfc_normalize(other), '\\s+', ' ', 'g')) AS no FROM q),
v AS (SELECT *, contains(cited, quote) OR contains(nc, nq) OR contains(cited, trim(quote, ' .,;:"''()[]“”‘’')) AS stands, CASE WHEN contains(no, nq) THEN 1 WHEN quote_id % 3 = 0 THEN 2 END AS place FROM n)
SELECT quote_id, NOT stands AND place IS NOT NULL AS mis_cited, CASE WHEN NOT stands THEN CAST(place AS BIGINT) END AS passage, round(len(list_intersect(list_distinct(w), list_distinct(cw))) / greatest(len(list_distinct(w)), 1), 6) AS overlap FROM v""",
)
def i5_other_passages(c: Corpus) -> DataFrame:
    """Quotes beside two other passages: the next document and, for every third, one that holds the quote with other spaces."""
    b = c.table("benchmark").select(F.col("item_id").alias("quote_id"), F.col("text").alias("quote"), (F.col("item_id") * 3).alias("doc_id"))
    d = c.table("documents")
    told = F.when(F.col("quote_id") % 3 == 0, F.concat(F.lit("It says: "), F.replace("quote", F.lit(" "), F.lit("  ")), F.lit("\n as before"))).otherwise("nothing")
    quotes = b.join(d.select("doc_id", F.col("text").alias("cited")), "doc_id").join(d.select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("other")), "doc_id")
    quotes = quotes.withColumn("others", F.array("other", told)).drop("other")
    out = C.diagnose(quotes, PS._searchable(c))
    return out.select("quote_id", (F.col("verdict") == "mis_cited").alias("mis_cited"), "passage", "overlap")


@query(
    "c12_ground_truth",
    f"""{with_views('versions', 'chunks', 'questions')}, live AS (SELECT c.page, lower(c.content) AS content, v.status = 'active' AND c.superseded_by IS NULL AS live FROM chunks c JOIN versions v USING (version_id)),
q AS (SELECT query_id AS id, terms, query_id % 20 + 1 AS page FROM questions), p AS (SELECT DISTINCT id, terms, page FROM q),
hit AS (SELECT id, count(*) FILTER (live) AS live, count(*) FILTER (NOT live) AS retired FROM p JOIN live USING (page) WHERE len(list_filter(terms, lambda t: contains(content, t))) > 0 GROUP BY ALL)
SELECT id, coalesce(live, 0) AS live, coalesce(retired, 0) AS retired, coalesce(live, 0) > 0 AS answerable FROM q LEFT JOIN hit USING (id)""",
)
def c12_ground_truth(c: Corpus) -> DataFrame:
    chunks = c.chunks().join(c.versions().select("version_id", "status"), "version_id").withColumn("live", (F.col("status") == "active") & F.col("superseded_by").isNull())
    q = c.questions().select(F.col("query_id").alias("id"), "terms", F.array(F.col("query_id") % 20 + 1).alias("pages"))
    return C.ground_truth(q, chunks)


_OUTCOMES = """o AS (SELECT doc_id AS id, CASE WHEN quality = 0 THEN 'not_covered' WHEN toxic = 1 THEN 'withdrawn_source' ELSE 'answerable' END AS expect, doc_id % 3 AS groups, [CAST(doc_id % 4 AS VARCHAR), 'iv'] AS pages, CASE WHEN doc_id % 2 = 0 THEN [doc_id % 5] ELSE CAST([] AS BIGINT[]) END AS expect_pages, CASE WHEN doc_id % 23 = 0 THEN 'timeout' END AS error FROM labels),
judged AS (SELECT *, CASE WHEN error IS NOT NULL THEN 'error' WHEN expect = 'answerable' THEN CASE WHEN groups = 0 THEN 'wrongly_declined' WHEN len(expect_pages) > 0 AND NOT list_contains(expect_pages, id % 4) THEN 'answered_off_source' ELSE 'answered' END
  WHEN expect = 'withdrawn_source' THEN CASE WHEN groups > 0 THEN 'withdrawn_leaked' ELSE 'withdrawn_declined' END ELSE CASE WHEN groups > 0 THEN 'answered_uncovered' ELSE 'correctly_declined' END END AS verdict FROM o)"""


def outcomes(c: Corpus) -> DataFrame:
    i = F.col("doc_id")
    return c.table("labels").select(
        i.alias("id"),
        F.when(F.col("quality") == 0, "not_covered").when(F.col("toxic") == 1, "withdrawn_source").otherwise("answerable").alias("expect"),
        (i % 3).alias("groups"),
        F.array((i % 4).cast("string"), F.lit("iv")).alias("pages"),
        F.when(i % 2 == 0, F.array(i % 5)).otherwise(F.expr("cast(array() as array<bigint>)")).alias("expect_pages"),
        F.when(i % 23 == 0, "timeout").alias("error"),
    )


@query("h8_verdicts", f"WITH {_OUTCOMES} SELECT id, verdict FROM judged")
def h8_verdicts(c: Corpus) -> DataFrame:
    return C.verdict(outcomes(c)).select("id", "verdict")


@query(
    "h9_evaluation_report",
    f"""WITH {_OUTCOMES}, r AS (SELECT expect, count(*) FILTER (verdict IN ('answered', 'correctly_declined', 'withdrawn_declined')) || '/' || count(*) FILTER (verdict <> 'error') AS rate FROM judged GROUP BY expect)
SELECT expect, verdict, count(*) AS n, array_to_string(list(id ORDER BY id), ',') AS ids, any_value(rate) AS rate FROM judged JOIN r USING (expect) GROUP BY expect, verdict""",
)
def h9_evaluation_report(c: Corpus) -> DataFrame:
    return C.report(C.verdict(outcomes(c))).select("expect", "verdict", "n", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"), "rate")


_TAGGED = """t AS (SELECT j.*, id % 4 = 1 AS tagged, id % 3 AS rejected, CASE id % 3 WHEN 0 THEN CAST([] AS VARCHAR[]) WHEN 1 THEN ['typography'] ELSE ['parametric_leak', 'boundary'] END AS diagnoses FROM judged j)"""


@query(
    "h9_rates",
    f"""WITH {_OUTCOMES}, {_TAGGED}, ok AS (SELECT * FROM t WHERE verdict <> 'error'),
m AS (SELECT 'answerable' AS expect, 'answered' AS measure, count(*) FILTER (groups > 0) AS good, count(*) AS total FROM ok WHERE expect = 'answerable' UNION ALL SELECT 'answerable', 'answered_off_source', count(*) FILTER (verdict = 'answered_off_source'), count(*) FROM ok WHERE expect = 'answerable' AND len(expect_pages) > 0
UNION ALL SELECT 'answerable', 'answered_with_glyphs', count(*) FILTER (groups > 0), count(*) FROM ok WHERE expect = 'answerable' AND tagged UNION ALL SELECT 'answerable', 'answered_without_glyphs', count(*) FILTER (groups > 0), count(*) FROM ok WHERE expect = 'answerable' AND NOT tagged
UNION ALL SELECT 'not_covered', 'correctly_declined', count(*) FILTER (groups = 0), count(*) FROM ok WHERE expect = 'not_covered' UNION ALL SELECT 'withdrawn_source', 'correctly_declined', count(*) FILTER (groups = 0), count(*) FROM ok WHERE expect = 'withdrawn_source' UNION ALL SELECT 'withdrawn_source', 'leaked', count(*) FILTER (groups > 0), count(*) FROM ok WHERE expect = 'withdrawn_source'
UNION ALL SELECT 'rejected', 'rejected', NULL, CAST(sum(rejected) AS BIGINT) FROM t UNION ALL SELECT 'rejected', 'inventions', NULL, count(*) FILTER (list_contains(diagnoses, 'parametric_leak')) FROM t UNION ALL SELECT 'rejected', d, NULL, count(*) FROM (SELECT unnest(diagnoses) AS d FROM t) GROUP BY d)
SELECT *, good || '/' || total AS rate FROM m""",
)
def h9_rates(c: Corpus) -> DataFrame:
    i = F.col("id")
    leak = lambda v, bad: F.struct(F.lit(v).alias("verdict"), F.lit(bad).alias("is_invention"))
    none = F.expr("cast(array() as array<struct<verdict: string, is_invention: boolean>>)")
    found = F.when(i % 3 == 0, none).when(i % 3 == 1, F.array(leak("typography", False))).otherwise(F.array(leak("parametric_leak", True), leak("boundary", False)))
    tagged = C.verdict(outcomes(c)).withColumns({"tags": F.when(i % 4 == 1, F.array(F.lit("glyphs"), F.lit("table"))).when(i % 4 == 2, F.array(F.lit("table"))), "rejected": i % 3, "diagnoses": found})
    return C.rates(tagged, "glyphs")


@query("a8_run_comparison", f"WITH {_OUTCOMES}, n AS (SELECT id, CASE WHEN id % 10 = 0 THEN 'error' ELSE verdict END AS after FROM judged WHERE id % 31 <> 0) SELECT coalesce(j.id, n.id) AS id, verdict AS before, after FROM judged j FULL OUTER JOIN n USING (id) WHERE verdict IS DISTINCT FROM after")
def a8_run_comparison(c: Corpus) -> DataFrame:
    old = C.verdict(outcomes(c))
    new = old.where("id % 31 <> 0").withColumn("verdict", F.when(F.col("id") % 10 == 0, "error").otherwise(F.col("verdict")))
    return C.compare_runs(old, new)


@query("h4_live_and_retired", f"{with_views('versions', 'chunks')} SELECT document_id, count(*) FILTER (status = 'active') AS active, count(*) FILTER (status <> 'active') AS retired FROM chunks JOIN versions USING (version_id) GROUP BY ALL")
def h4_live_and_retired(c: Corpus) -> DataFrame:
    j = c.chunks().join(c.versions().select("version_id", "document_id", "status"), "version_id")
    return j.groupBy("document_id").agg(F.count_if(F.col("status") == "active").alias("active"), F.count_if(F.col("status") != "active").alias("retired"))


@query(
    "h5_exists_in_corpus",
    f"""{with_views('chunks', 'questions')}, low AS (SELECT DISTINCT lower(content) AS content FROM chunks), held AS (SELECT DISTINCT phrase FROM (SELECT DISTINCT terms[1] AS phrase FROM questions) JOIN low ON contains(content, phrase))
SELECT query_id, CASE WHEN terms[1] IS NOT NULL THEN h.phrase IS NOT NULL END AS found FROM questions q LEFT JOIN held h ON h.phrase = q.terms[1]""",
)
def h5_exists_in_corpus(c: Corpus) -> DataFrame:
    """The first term of every question, looked up in all chunks, retired ones too."""
    q = c.questions().select("query_id", F.get("terms", F.lit(0)).alias("phrase"))
    return C.exists_in(q, c.chunks()).select("query_id", "found")


_PHRASES = """phrases AS (SELECT conv_id * 1000 + turn AS query_id, nullif(regexp_extract(lower(text), '[a-z]{4,}'), '') AS phrase FROM conversations WHERE role = 'user')"""


@query(
    "h5_exists_in_searchable",
    f"{with_views('docs', 'versions', 'chunks')}, {PS.SEARCHABLE}, {_PHRASES}, low AS (SELECT lower(content) AS content FROM searchable), held AS (SELECT DISTINCT phrase FROM (SELECT DISTINCT phrase FROM phrases) JOIN low ON contains(content, phrase)) SELECT query_id, CASE WHEN p.phrase IS NOT NULL THEN h.phrase IS NOT NULL END AS found FROM phrases p LEFT JOIN held h ON h.phrase = p.phrase",
)
def h5_exists_in_searchable(c: Corpus) -> DataFrame:
    """The first word of four letters or more of every user's turn, looked up in all that search can return."""
    word = F.regexp_extract(F.lower("text"), "[a-z]{4,}", 0)
    q = c.table("conversations").where("role = 'user'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), F.nullif(word, F.lit("")).alias("phrase"))
    return C.exists_in(q, PS._searchable(c)).select("query_id", "found")


_ASKED = """phrases AS (SELECT conv_id * 1000 + turn AS query_id, CASE (conv_id + turn) % 6 WHEN 0 THEN w[1] || ' ' || w[2] WHEN 1 THEN w[2] || ' ' || w[3] || ' ' || w[4] WHEN 2 THEN left(w[1], 3) WHEN 3 THEN nullif(regexp_extract(text, '[^ -~\n]+[a-z]*'), '') WHEN 4 THEN right(w[2], 2) || ' ' || left(w[3], 1) ELSE upper(regexp_extract(w[3], '[a-z]+')) END AS phrase
  FROM (SELECT *, string_split(text, ' ') AS w FROM conversations))"""


@query(
    "h5_phrases_in_corpus",
    f"{with_views('chunks')}, {_ASKED}, low AS (SELECT DISTINCT lower(content) AS content FROM chunks), held AS (SELECT DISTINCT p.phrase FROM (SELECT DISTINCT lower(phrase) AS phrase FROM phrases) p JOIN low ON contains(content, p.phrase)) SELECT query_id, p.phrase, CASE WHEN p.phrase IS NOT NULL THEN h.phrase IS NOT NULL END AS found FROM phrases p LEFT JOIN held h ON h.phrase = lower(p.phrase)",
)
def h5_phrases_in_corpus(c: Corpus) -> DataFrame:
    """A phrase of every turn: two words, three, three letters, letters beyond ASCII, a word's end with the next one's
    beginning, or capitals; looked up in all chunks."""
    w = F.split("text", " ")
    word = lambda k: F.get(w, F.lit(k - 1))
    kind = (F.col("conv_id") + F.col("turn")) % 6
    odd = F.nullif(F.regexp_extract("text", "[^ -~\n]+[a-z]*", 0), F.lit(""))
    phrase = F.when(kind == 0, F.concat(word(1), F.lit(" "), word(2))).when(kind == 1, F.concat(word(2), F.lit(" "), word(3), F.lit(" "), word(4))).when(kind == 2, F.substring(word(1), 1, 3)).when(kind == 3, odd).when(kind == 4, F.concat(F.right(word(2), F.lit(2)), F.lit(" "), F.left(word(3), F.lit(1)))).otherwise(F.upper(F.regexp_extract(word(3), "[a-z]+", 0)))
    asked = c.table("conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), phrase.alias("phrase"))
    return C.exists_in(asked, c.chunks()).select("query_id", "phrase", "found")


_LIVE = """live AS (SELECT version_id, page, superseded_by IS NULL AND (version_id + page) % 4 <> 0 AS live FROM chunks)"""


@query(
    "h6_coverage",
    f"""{with_views('chunks')}, {_LIVE}, g AS (SELECT version_id, min(page) AS lo, max(page) AS hi, coalesce(list_sort(list(DISTINCT page) FILTER (live)), CAST([] AS BIGINT[])) AS p FROM live GROUP BY version_id)
SELECT version_id, lo, hi, CAST(len(p) AS BIGINT) AS n_live, array_to_string(list_filter(range(lo, hi + 1), lambda x: NOT list_contains(p, x)), ',') AS missing FROM g""",
)
def h6_coverage(c: Corpus) -> DataFrame:
    live = c.chunks().select("version_id", "page", (F.col("superseded_by").isNull() & ((F.col("version_id") + F.col("page")) % 4 != 0)).alias("live"))
    return C.coverage(live).withColumn("missing", F.array_join(F.col("missing").cast("array<string>"), ","))


@query(
    "h7_page_ranges",
    f"""{with_views('chunks')}, p AS (SELECT DISTINCT version_id, page FROM chunks WHERE (version_id + page) % 4 <> 0), i AS (SELECT *, page - row_number() OVER (PARTITION BY version_id ORDER BY page) AS island FROM p),
r AS (SELECT version_id, min(page) AS a, CASE WHEN min(page) = max(page) THEN CAST(min(page) AS VARCHAR) ELSE min(page) || '-' || max(page) END AS t FROM i GROUP BY version_id, island)
SELECT v.version_id, coalesce(string_agg(t, ', ' ORDER BY a), '-') AS ranges FROM (SELECT DISTINCT version_id FROM chunks) v LEFT JOIN r USING (version_id) GROUP BY v.version_id""",
)
def h7_page_ranges(c: Corpus) -> DataFrame:
    return C.ranges(c.chunks().select("version_id", F.when((F.col("version_id") + F.col("page")) % 4 != 0, F.col("page")).alias("page")), "version_id")


@query("h15_damage_ratio", f"{with_views('versions', 'lines')} SELECT v.version_id, round(coalesce(coalesce(len(unreadable_pages), 0) / nullif(max(l.page), 0), 0), 6) AS ratio FROM versions v LEFT JOIN lines l USING (version_id) GROUP BY v.version_id, unreadable_pages")
def h15_damage_ratio(c: Corpus) -> DataFrame:
    pages = c.lines().groupBy("version_id").agg(F.max("page").alias("n"))
    damaged = F.size(F.coalesce("unreadable_pages", F.expr("cast(array() as array<bigint>)")))
    return c.versions().join(pages, "version_id", "left").select("version_id", F.round(F.coalesce(F.try_divide(damaged, F.col("n")), F.lit(0.0)), 6).alias("ratio"))


@query("s_page_labels", f"{with_views('chunks')} SELECT version_id, CASE WHEN min(page) = max(page) THEN 'p. ' || min(page) ELSE 'pp. ' || min(page) || '-' || max(page) END AS label FROM chunks GROUP BY version_id")
def s_page_labels(c: Corpus) -> DataFrame:
    return c.chunks().groupBy("version_id").agg(F.min("page").alias("a"), F.max("page").alias("b")).select("version_id", X.page_label(F.col("a"), F.col("b")).alias("label"))
