"""The operators' queries over whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scriptorium.llm.jaccard import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "class_id", "n_links", "n_text_links")


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scriptorium.llm.pieces import encode

    encoded = encode(_table(spark, sf_dir, "documents").select("doc_id", "text"), decoded="decoded")
    return encoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_pieces"),
        F.xxhash64("ids").alias("ids_xxhash64"),
        F.round("score", 6).alias("score"),
        F.transform("others", lambda o: F.round(o["score"], 6)).alias("other_scores"),
        F.transform("others", lambda o: o["edits"]).alias("other_edits"),
        F.col("decoded").eqNullSafe(F.col("text")).alias("exact"),
    )


def op3_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scriptorium.llm.pii import KINDS, find_personal_data, spelled

    found = find_personal_data(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long")
    counts = [count(k).alias(f"n_{name}") for k, name in enumerate(KINDS[:4])]
    return found.select("doc_id", *counts, F.sha2(spelled("base"), 256).alias("base_sha256"), spelled("spans").alias("spans"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scriptorium.llm.linededup import dedup_lines

    found = dedup_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scriptorium.llm.decontam import contamination, find_spans

    found = contamination(find_spans(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scriptorium.llm.sharding import shard

    text = F.coalesce("text", F.lit(""))
    docs = _table(spark, sf_dir, "documents").select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    return shard(docs).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scriptorium.llm.pieces import count_tokens

    return count_tokens(_table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_pretokens", "n_tokens")


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scriptorium.llm.html import extract

    pages = extract(_table(spark, sf_dir, "pages").select("page_id", "html"))
    return pages.select("page_id", F.length("text").cast("long").alias("n_chars"), F.size(F.split("text", "\n")).cast("long").alias("n_lines"), "text")


def op9_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scriptorium.llm.repeats import cut_repeats

    cut = cut_repeats(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    removed = F.aggregate("removed", F.lit(0).cast("long"), lambda s, x: s + (x["end"] - x["begin"]))
    return cut.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"), (removed > 0).alias("repeats"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scriptorium.llm.quality import quality_rules

    judged = quality_rules(_table(spark, sf_dir, "documents").select("doc_id", "text"), counts=True)
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & F.col("kept")).alias("kept"))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scriptorium.llm.alignment import align, judge_links

    aligned = align(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    digest = F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise("").alias("groups_sha256")
    judged = judge_links(aligned.select("doc_id", "n_a", "n_b", "n_groups", digest, "links"))
    return judged.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scriptorium.llm.negatives import mine

    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(_table(spark, sf_dir, "embeddings").select("vec_id", "embedding", label.alias("label")), anchor=F.col("vec_id") % 100 == 0)


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scriptorium.llm.toxicity import fit, score

    docs, labels = _table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "labels").select("doc_id", "toxic")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    known = docs.filter(~held_out).join(labels.filter("toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic")), "doc_id")
    scored = score(docs, fit(known.select("text", "toxic")))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ngram_jaccard_join": op1_ngram_jaccard_join,
    "op2_sentencepiece": op2_sentencepiece,
    "op3_personal_data": op3_personal_data,
    "op4_line_dedup": op4_line_dedup,
    "op5_decontamination": op5_decontamination,
    "op6_sharding": op6_sharding,
    "op7_token_counts": op7_token_counts,
    "op8_html_extraction": op8_html_extraction,
    "op9_suffix_array_dedup": op9_suffix_array_dedup,
    "op10_quality_rules": op10_quality_rules,
    "op11_token_alignment": op11_token_alignment,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_toxicity": op13_toxicity,
}

_SPLIT = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_COUNT = "len(regexp_extract_all(coalesce(text, ''), '{}'))"

_OP5 = r"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
windows AS (SELECT DISTINCT item, n, array_to_string(w[p:p + n - 1], ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS p FROM (SELECT *, least(len(w), 13) AS n FROM b WHERE len(w) > 0))),
sizes AS (SELECT DISTINCT n FROM windows), grams AS (SELECT DISTINCT g FROM windows),
spots AS (SELECT rid, n, p, array_to_string(w[p:p + n - 1], ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS p FROM d, sizes WHERE len(w) >= n)),
hits AS (SELECT rid, n, p, g FROM spots SEMI JOIN grams USING (g)),
n_hit AS (SELECT rid, count(DISTINCT k) AS n FROM (SELECT rid, unnest(range(p, p + n)) AS k FROM hits) GROUP BY rid),
items AS (SELECT rid, list(DISTINCT item ORDER BY item) AS ids FROM hits JOIN windows USING (g) WHERE hits.n = windows.n GROUP BY rid)
SELECT doc_id, len(w) AS n_words, coalesce(h.n, 0) AS n_hit, coalesce(len(ids), 0) AS n_items, sha256(coalesce(array_to_string(ids, ','), '')) AS items_sha256, coalesce(h.n, 0) > 0 AND 20 * coalesce(h.n, 0) >= len(w) AS contaminated
FROM d LEFT JOIN n_hit h USING (rid) LEFT JOIN items i USING (rid)"""

_OP10 = f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, text, {_SPLIT} AS w FROM documents),
g AS (SELECT rid, p, array_to_string(w[p:p + 7], ' ') AS g FROM (SELECT rid, w, unnest(range(1, len(w) - 6)) AS p FROM d)),
twice AS (SELECT rid, g FROM g GROUP BY ALL HAVING count(*) > 1),
again AS (SELECT rid, count(DISTINCT k) AS n FROM (SELECT rid, unnest(range(p, p + 8)) AS k FROM g SEMI JOIN twice USING (rid, g)) GROUP BY rid),
dup AS (SELECT rid, count(*) - count(DISTINCT line) AS n FROM (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY rid),
c AS (SELECT doc_id, len(w) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, {_COUNT.format('[#*$%&|<>]')} AS n_symbols, coalesce(dup.n, 0) AS n_dup_lines, coalesce(again.n, 0) AS n_repeat_words,
  {_COUNT.format('[A-Z]')} AS upper, {_COUNT.format('[a-z]')} AS lower, {_COUNT.format('[^\\x00-\\x7F]')} AS wide FROM d LEFT JOIN again USING (rid) LEFT JOIN dup USING (rid)),
f AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM c)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 10 * n_symbols > n_words OR upper > lower + 20 OR word_chars > 16 * greatest(n_words, 1) OR 2 * (upper + lower + wide) < word_chars) AS kept FROM f"""

_OP12 = r"""WITH v AS (SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.r AS a, a.vec_id AS anchor_id, c.r AS c, c.vec_id AS id, a.label = c.label AS same, CAST(list_inner_product(a.q, c.q) AS BIGINT) AS score FROM v a JOIN v c ON len(a.q) = len(c.q) AND a.r <> c.r WHERE a.vec_id % 100 = 0),
p AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, id, c) AS k FROM s WHERE same),
n AS (SELECT s.anchor_id, p.id AS positive_id, row_number() OVER (PARTITION BY p.a, p.k ORDER BY s.score DESC, s.id, s.c) AS rank, s.id AS negative_id, p.score AS positive_score, s.score AS negative_score
  FROM p JOIN s ON s.a = p.a AND NOT s.same AND 80 * p.score <= 100 * s.score AND s.score <= p.score WHERE p.k <= 5)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5"""

ORACLE_SQL: dict[str, str] = {"op5_decontamination": _OP5, "op10_quality_rules": _OP10, "op12_hard_negatives": _OP12}
