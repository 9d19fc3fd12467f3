"""Quotes and answers: verbatim checks, diagnosis of the ones that fail, assembly, and evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scriptorium.functions.text import WORDS, looks_like_headerless_row, normalise_quote, strip_edges
from scriptorium.operators.counts import term_counts
from scriptorium.operators.phrases import held_phrases, phrases_found
from scriptorium.shared import gathered, kept

GRAM = 4


def validate(citations: DataFrame, retrieved: DataFrame, chunks: DataFrame | None = None) -> DataFrame:
    """citations (query_id, chunk_id, quote) with `reason`: null if the quote stands in the retrieved chunk.

    retrieved: (query_id, chunk_id, content).  With chunks (chunk_id, content) retrieved needs no content: a chunk is
    normalised once, however many questions it was retrieved for.
    """
    if chunks is not None:
        there = retrieved.select("query_id", "chunk_id")
        texts = chunks.join(there.select("chunk_id").distinct(), "chunk_id", "left_semi").select("chunk_id", normalise_quote(F.col("content")).alias("__c"))
        met = citations.join(there, ["query_id", "chunk_id"]).withColumn("__q", normalise_quote(F.col("quote"))).join(texts, "chunk_id", "left")
        reason = F.when(F.coalesce("__q", F.lit("")) == "", "empty").when(~F.contains("__c", "__q"), "not_contained")
        lost = citations.join(there, ["query_id", "chunk_id"], "left_anti")
        return met.select(*citations.columns, reason.alias("reason")).unionByName(lost.select(*citations.columns, F.lit("not_retrieved").alias("reason")))
    r = retrieved.select("query_id", "chunk_id", F.col("content").alias("__c"), F.lit(True).alias("__there"))
    out = citations.join(r, ["query_id", "chunk_id"], "left")
    quote = normalise_quote(F.col("quote"))
    reason = F.when(F.col("__there").isNull(), "not_retrieved").when(F.coalesce(quote, F.lit("")) == "", "empty").when(~F.contains(normalise_quote(F.col("__c")), quote), "not_contained")
    return out.select(*citations.columns, reason.alias("reason"))


def guard_rows(citations: DataFrame) -> DataFrame:
    """Valid citations with `reason` set where the quote is a table row without its heading."""
    return citations.withColumn("reason", F.when(F.col("reason").isNull() & looks_like_headerless_row(F.col("quote")), "table_row").otherwise(F.col("reason")))


def answers(citations: DataFrame, queries: DataFrame) -> DataFrame:
    """One row a query: kept chunk ids in order, how many were rejected, and why there is no answer."""
    g = citations.groupBy("query_id").agg(
        F.array_sort(F.collect_set(F.when(F.col("reason").isNull(), F.col("chunk_id")))).alias("kept"),
        F.count_if(F.col("reason").isNotNull()).alias("rejected"),
        F.count_if(F.col("reason") == "table_row").alias("rows"),
    )
    out = queries.select("query_id").join(g, "query_id", "left")
    kept = F.coalesce("kept", F.expr("cast(array() as array<bigint>)"))
    why = F.when(F.size(kept) > 0, F.lit(None)).when(F.col("rows") > 0, "table_not_citable").when(F.col("rejected") > 0, "verification_failed").otherwise("sources_do_not_answer")
    return out.select("query_id", kept.alias("kept"), F.coalesce("rejected", F.lit(0)).alias("rejected"), why.alias("no_answer_reason"))


def assemble(selections: DataFrame, hits: DataFrame, limit: int = 12) -> tuple[DataFrame, DataFrame]:
    """(citations, dropped): a selection's 1-based source is the shown hit of that rank; provenance comes from the hit."""
    h = hits.where(F.col("rank") <= limit)
    j = selections.join(h, (selections["query_id"] == h["query_id"]) & (selections["source"] == h["rank"]), "left").drop(h["query_id"])
    dropped = j.groupBy("query_id").agg(F.count_if(F.col("chunk_id").isNull()).alias("out_of_range"))
    return j.where(F.col("chunk_id").isNotNull()), dropped


def answer_reasons(selections: DataFrame, hits: DataFrame, queries: DataFrame, limit: int = 12) -> DataFrame:
    """One row a query: its citations, editions among them, selections out of range, and why there is no answer.

    hits (query_id, chunk_id, version_id, rank).  Without a hit there are no_relevant_sources; with hits, but no selection
    of one that is shown, the sources_do_not_answer.
    """
    cited, dropped = assemble(selections, hits, limit)
    n = cited.groupBy("query_id").agg(F.count(F.lit(1)).alias("citations"), F.count_distinct("version_id").alias("editions"))
    any_hit = hits.select("query_id", F.lit(True).alias("__hit")).distinct()
    out = queries.select("query_id").distinct().join(any_hit, "query_id", "left").join(n, "query_id", "left").join(dropped, "query_id", "left")
    why = F.when(F.col("__hit").isNull(), "no_relevant_sources").when(F.col("citations").isNull(), "sources_do_not_answer")
    # a query without hits showed nothing that a selection could miss
    missed = F.when(F.col("__hit").isNotNull(), F.coalesce("out_of_range", F.lit(0))).otherwise(0).cast("long")
    return out.select("query_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("citations", "editions")], missed.alias("out_of_range"), why.alias("no_answer_reason"))


def grams(text: Column, n: int = GRAM, each: bool = False) -> Column:
    """Distinct runs (each: all, in order) of n lower-case ASCII words; none for a shorter text."""
    w = F.regexp_extract_all(F.lower(text), F.lit(WORDS), F.lit(0))
    # words once: an expression inside a lambda is worked out for each of its elements
    runs = F.transform(F.array(w), lambda x: F.transform(F.sequence(F.lit(1), F.greatest(F.size(x) - n + 1, F.lit(1))), lambda i: F.concat_ws(" ", *[F.get(x, i + (k - 1)) for k in range(n)])))[0]
    return F.when(F.size(w) >= n, runs if each else F.array_distinct(runs)).otherwise(F.expr("cast(array() as array<string>)"))


def diagnose(quotes: DataFrame, corpus: DataFrame) -> DataFrame:
    """quotes (quote_id, quote, cited, others array<string>) with verdict, n_grams, in_cited, elsewhere, passage and overlap.

    passage is the 1-based place in others of the first that holds a mis-cited quote, overlap the share of the quote's
    distinct words that the cited text has (0 without words).

    corpus (content) is the searchable text.  Its grams meet the quotes' by equality, and only those: the distinct grams
    of the quotes decide what is kept of the corpus, where it is read, unless they are too many to be broadcast.
    """
    q, c = F.col("quote"), F.col("cited")
    words = F.regexp_extract_all(F.lower(q), F.lit(WORDS), F.lit(0))
    rows = quotes.withColumn("__g", grams(q)).withColumn("__c", grams(c))
    wanted = rows.select("quote_id", F.explode(F.array_except("__g", "__c")).alias("gram"))
    asked = gathered(kept(wanted.select("gram").distinct(), "grams"))
    found = corpus.select(F.explode(grams(F.col("content"), each=True)).alias("gram")).join(asked, "gram", "left_semi").distinct()
    elsewhere = wanted.join(found, "gram", "left_semi").groupBy("quote_id").agg(F.count(F.lit(1)).alias("elsewhere"))
    rows = rows.join(elsewhere, "quote_id", "left").withColumn("elsewhere", F.coalesce("elsewhere", F.lit(0)))
    shared = F.size(F.array_intersect("__g", "__c"))
    holds = F.transform(F.coalesce("others", F.expr("cast(array() as array<string>)")), lambda p: F.coalesce(F.contains(normalise_quote(p, True), normalise_quote(q, True)), F.lit(False)))
    place = F.nullif(F.array_position(holds, F.lit(True)), F.lit(0).cast("long"))
    distinct = F.array_distinct(words)
    overlap = F.round(F.size(F.array_intersect(distinct, F.regexp_extract_all(F.lower(c), F.lit(WORDS), F.lit(0)))) / F.greatest(F.size(distinct), F.lit(1)), 6)
    edge = strip_edges(q)
    verdict = (
        F.when(F.contains(c, q), "clean")
        .when(F.contains(normalise_quote(c), normalise_quote(q)), "typography")
        .when((edge != "") & F.contains(c, edge), "boundary")
        .when(place.isNotNull(), "mis_cited")
        .when(F.size(words) < GRAM, "paraphrase")
        .when(F.col("elsewhere") > 0, "synthesis")
        .when(shared == 0, "parametric_leak")
        .otherwise("paraphrase")
    )
    return rows.select("quote_id", verdict.alias("verdict"), F.size("__g").cast("long").alias("n_grams"), shared.cast("long").alias("in_cited"), "elsewhere", F.when(verdict == "mis_cited", place).alias("passage"), overlap.alias("overlap"))


def exists_in(phrases: DataFrame, corpus: DataFrame) -> DataFrame:
    """phrases (phrase, and any other columns) with `found`: whether a text of corpus (content) holds the phrase, in any case.

    Any phrase counts: of several words, short, in any script, and inside longer words; null has found null, and the empty
    phrase stands in every text, so it is found if there is one.
    """
    there = phrases_found(phrases.select("phrase"), corpus.select("content")).withColumnRenamed("phrase", "__p")
    out = phrases.withColumn("__q", F.lower("phrase")).join(there, F.col("__q") == F.col("__p"), "left")
    any_text = F.lit(bool(corpus.where("content is not null").limit(1).count()))
    return out.withColumn("found", F.when(F.col("phrase") == "", any_text).when(F.col("phrase").isNotNull(), F.col("__p").isNotNull())).drop("__q", "__p")


def ground_truth(questions: DataFrame, chunks: DataFrame) -> DataFrame:
    """questions (id, terms, pages) with how many live and retired chunks (chunk_id, page, content, live) on those pages
    hold one of the terms, in any case, inside longer words too.

    Questions with the same terms on a page are counted once, and chunks where they are read (term_counts).  Rows with the
    same chunk_id and live are one chunk, whatever pages they have; these are met by their phrases.
    """
    terms = F.array_sort(F.filter(F.array_distinct(F.transform("terms", lambda x: F.lower(x))), lambda x: x.isNotNull() & (x != "")))
    asks = questions.select("id", F.explode(F.array_distinct("pages")).alias("page"), terms.alias("terms")).withColumn("page", F.col("page").cast(chunks.schema["page"].dataType))
    asks = kept(asks.where("page is not null and size(terms) > 0").distinct(), "asks")
    sets = kept(asks.select("page", "terms").distinct().withColumn("set", F.monotonically_increasing_id()), "sets")
    there = chunks.where("content is not null and live is not null").join(gathered(sets.select("page").distinct()), "page", "left_semi")
    there = kept(there.select("chunk_id", "page", "live", "content"), "texts")
    again = there.groupBy("chunk_id", "live").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("chunk_id", "live")
    several = again.limit(1).count()
    again = gathered(again) if several else F.broadcast(again)
    counts = term_counts(sets, there.join(again, ["chunk_id", "live"], "left_anti"))
    hit = asks.join(sets, ["page", "terms"]).join(counts, "set").select("id", "live", "retired")
    if several:
        hit = hit.unionByName(_repeated(asks, there.join(again, ["chunk_id", "live"], "left_semi")))
    n = hit.groupBy("id").agg(F.sum("live").alias("live"), F.sum("retired").alias("retired"))
    out = questions.select("id").join(n, "id", "left")
    return out.select("id", F.coalesce("live", F.lit(0)).alias("live"), F.coalesce("retired", F.lit(0)).alias("retired"), (F.coalesce("live", F.lit(0)) > 0).alias("answerable"))


def _repeated(asks: DataFrame, chunks: DataFrame) -> DataFrame:
    """(id, live, retired) of chunks that stand in several rows, each counted once: a pair counts at the first term held."""
    each = asks.select("id", F.explode("terms").alias("phrase"), "page").groupBy("id").agg(F.array_sort(F.collect_set(F.struct("page", "phrase"))).alias("asks"))
    t = each.select("id", "asks", F.posexplode("asks").alias("at", "ask")).select("id", "ask.page", "ask.phrase", F.slice("asks", F.lit(1), F.col("at")).alias("before"))
    held = held_phrases(t.select("page", "phrase"), chunks, ["chunk_id", "live"], ["page"])
    met = held.select("live", "held", F.explode("held").alias("ask")).select("live", "held", "ask.page", "ask.phrase")
    hit = met.join(gathered(t, 1_000_000), ["page", "phrase"]).where((F.size("before") == 0) | ~F.arrays_overlap("before", "held"))
    return hit.groupBy("id").agg(F.count_if("live").alias("live"), F.count_if(~F.col("live")).alias("retired"))


def verdict(outcomes: DataFrame) -> DataFrame:
    """outcomes (expect, groups, pages array<string>, expect_pages array<bigint>, error) with `verdict`."""
    answered = F.col("groups") > 0
    cited = F.transform(F.filter("pages", lambda p: p.rlike("^[0-9]+$")), lambda p: p.cast("long"))
    off = (F.size(F.coalesce("expect_pages", F.expr("cast(array() as array<bigint>)"))) > 0) & answered & (F.size(cited) > 0) & ~F.arrays_overlap(cited, "expect_pages")
    v = (
        F.when(F.coalesce("error", F.lit("")) != "", "error")
        .when(F.col("expect") == "answerable", F.when(~answered, "wrongly_declined").when(off, "answered_off_source").otherwise("answered"))
        .when(F.col("expect") == "withdrawn_source", F.when(answered, "withdrawn_leaked").otherwise("withdrawn_declined"))
        .otherwise(F.when(answered, "answered_uncovered").otherwise("correctly_declined"))
    )
    return outcomes.withColumn("verdict", v)


def report(judged: DataFrame) -> DataFrame:
    """Per expectation: counts, how many of how many went right, and the ids of each verdict.  Errors are in no rate."""
    good = F.col("verdict").isin("answered", "correctly_declined", "withdrawn_declined")
    counted = F.col("verdict") != "error"
    by = judged.groupBy("expect", "verdict").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list("id")).alias("ids"))
    rate = judged.groupBy("expect").agg(F.concat(F.count_if(good & counted).cast("string"), F.lit("/"), F.count_if(counted).cast("string")).alias("rate"))
    return by.join(rate, "expect")


def rates(judged: DataFrame, tag: str) -> DataFrame:
    """(expect, measure, good, total, rate) of verdicts with groups, tags, rejected and diagnoses, never folded into one number.

    judged: verdict's columns, tags array<string>, rejected (quotes), diagnoses array<struct<verdict, is_invention>>.
    Answered questions are split by tag; off-source answers count among questions that name pages.  Errors are in no
    rate, but their rejected quotes count.  good and rate are null where there is only a count, in total.
    """
    right = F.col("verdict") != "error"
    answered = F.col("groups") > 0
    tagged = F.array_contains(F.coalesce("tags", F.expr("cast(array() as array<string>)")), tag)
    paged = F.size(F.coalesce("expect_pages", F.expr("cast(array() as array<bigint>)"))) > 0
    of = lambda kind: right & (F.col("expect") == kind)
    measures = [
        ("answerable", "answered", of("answerable"), answered),
        ("answerable", "answered_off_source", of("answerable") & paged, F.col("verdict") == "answered_off_source"),
        ("answerable", f"answered_with_{tag}", of("answerable") & tagged, answered),
        ("answerable", f"answered_without_{tag}", of("answerable") & ~tagged, answered),
        ("not_covered", "correctly_declined", of("not_covered"), ~answered),
        ("withdrawn_source", "correctly_declined", of("withdrawn_source"), ~answered),
        ("withdrawn_source", "leaked", of("withdrawn_source"), answered),
    ]
    found = F.coalesce("diagnoses", F.expr("cast(array() as array<struct<verdict: string, is_invention: boolean>>)"))
    sums = judged.agg(
        *[F.count_if(pool & good).alias(f"g{i}") for i, (_, _, pool, good) in enumerate(measures)],
        *[F.count_if(pool).alias(f"t{i}") for i, (_, _, pool, _) in enumerate(measures)],
        F.coalesce(F.sum("rejected"), F.lit(0)).cast("long").alias("rejected"),
        F.coalesce(F.sum(F.size(F.filter(found, lambda d: d["is_invention"]))), F.lit(0)).cast("long").alias("inventions"),
    )
    none = F.lit(None).cast("long")
    line = lambda e, m, g, t: F.struct(F.lit(e).alias("expect"), F.lit(m).alias("measure"), g.alias("good"), t.alias("total"))
    lines = [line(e, m, F.col(f"g{i}"), F.col(f"t{i}")) for i, (e, m, _, _) in enumerate(measures)]
    lines += [line("rejected", m, none, F.col(m)) for m in ("rejected", "inventions")]
    by = judged.select(F.explode(found["verdict"]).alias("measure")).groupBy("measure").agg(F.count(F.lit(1)).alias("total"))
    out = sums.select(F.inline(F.array(*lines))).unionByName(by.select(F.lit("rejected").alias("expect"), "measure", none.alias("good"), "total"))
    return out.withColumn("rate", F.when(F.col("good").isNotNull(), F.concat_ws("/", "good", "total")))


def compare_runs(old: DataFrame, new: DataFrame) -> DataFrame:
    """Questions whose verdict differs between two runs (id, verdict)."""
    o = old.select("id", F.col("verdict").alias("before"))
    n = new.select("id", F.col("verdict").alias("after"))
    return o.join(n, "id", "full_outer").where(~F.col("before").eqNullSafe(F.col("after")))


def coverage(chunks: DataFrame) -> DataFrame:
    """Per version: first and last page, pages with a live chunk, pages without one, as ranges."""
    g = chunks.groupBy("version_id").agg(F.min("page").alias("lo"), F.max("page").alias("hi"), F.array_sort(F.collect_set(F.when(F.col("live"), F.col("page")))).alias("live_pages"))
    missing = F.array_except(F.sequence("lo", "hi"), "live_pages")
    return g.select("version_id", "lo", "hi", F.size("live_pages").cast("long").alias("n_live"), missing.alias("missing"))


def ranges(pages: DataFrame, key: str, page: str = "page") -> DataFrame:
    """(key, ranges): pages as '1-3, 7' by islands of consecutive numbers; a key without pages has '-'."""
    island = F.col(page) - F.row_number().over(Window.partitionBy(key).orderBy(page))
    runs = pages.where(F.col(page).isNotNull()).select(key, page).distinct().withColumn("island", island).groupBy(key, "island").agg(F.min(page).alias("a"), F.max(page).alias("b"))
    text = F.when(F.col("a") == F.col("b"), F.col("a").cast("string")).otherwise(F.concat_ws("-", "a", "b"))
    out = runs.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("a", text.alias("t")))), lambda x: x["t"]), ", ").alias("ranges"))
    return pages.select(key).distinct().join(out, key, "left").withColumn("ranges", F.coalesce("ranges", F.lit("-")))
