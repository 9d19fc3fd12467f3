"""Lexical search without pairs of words and questions in a shuffle."""

from itertools import product

from scriptorium.operators import search as S


def _corpus(spark):
    texts = [f"{a} x {b} y {a} {b}" for a, b in product(["alpha", "beta", "gamma", "the"], repeat=2)] + ["", "the the the", None]
    chunks = spark.createDataFrame([(i, t, "m" if i % 2 else "n") for i, t in enumerate(texts)], "chunk_id long, content string, sector string")
    asked = [["alpha"], ["alpha", "beta"], ["beta", "alpha"], ["the", "gamma", "alpha"], ["the"], ["the", "missing"], [], ["the", "the"], None, ["the", None]]
    q = spark.createDataFrame([(i, t, "m" if i % 3 else "n") for i, t in enumerate(asked)], "query_id long, terms array<string>, sector string")
    return chunks, q


def test_matches_and_ranks_equal_those_of_postings(spark):
    chunks, q = _corpus(spark)
    rows = S.match_all(S.postings(chunks), q)
    want = {(r["query_id"], r["chunk_id"], r["cover"]) for r in S.cover_density(rows).collect()}
    assert {tuple(r) for r in S.lexical_matches(chunks, q).select("query_id", "chunk_id").collect()} == {w[:2] for w in want}
    got = S.lexical_search(chunks, q, k=100).collect()
    assert {(r["query_id"], r["chunk_id"], r["cover"]) for r in got} == want
    best = {(r["query_id"], r["chunk_id"], r["rank"]) for r in S.lexical_search(chunks, q, k=2).collect()}
    assert best == {(r["query_id"], r["chunk_id"], r["rank"]) for r in S.lexical_top_k(S.cover_density(rows), 2).collect()}
    own = {(r["query_id"], r["chunk_id"]) for r in S.lexical_search(chunks, q, k=100, on=["sector"]).collect()}
    assert own == {(a, b) for a, b, _ in want if (a % 3 == 0) == (b % 2 == 0)}


def test_pairs_of_questions_and_chunks_are_not_shuffled(spark):
    import scriptorium.plans as plans

    plan = plans.QUERIES["e3_lexical_match"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(query_id" not in plan and "hashpartitioning(chunk_id" not in plan


def test_covers_of_few_terms_need_no_map(spark):
    """Covers of up to three terms equal those of the general form, and are found without a map for each occurrence."""
    import random

    from pyspark.sql import functions as F

    from scriptorium.operators import search as S

    r = random.Random(5)
    rows = [(i, [r.choice("abcde") for _ in range(r.randint(0, 30))], "a", ["b", "c"][: i % 3]) for i in range(300)]
    df = spark.createDataFrame(rows, "id int, w array<string>, term string, others array<string>")
    at = F.filter(F.transform("w", lambda x, i: F.struct(i.alias("pos"), x.alias("term"))), lambda x: (x["term"] == F.col("term")) | F.array_contains("others", x["term"]))
    got = df.select(S._cover(at, F.size("others") + 1).alias("x"), S._cover_of_few("w", "term", "others").alias("y")).collect()
    assert [g.x for g in got] == [g.y for g in got] and len({g.x for g in got}) > 20


def test_covers_are_found_in_blocks(spark, monkeypatch):
    """Any number of terms, blocks, and slices of pairs: the best chunks are those of all occurrences; a pair carries no text."""
    import random

    r = random.Random(7)
    texts = [" ".join(r.choice(["aa", "Bb", "cc", "dd", "e\u00e9", "\u212a"]) + r.choice([" ", ", ", "\t"]) for _ in range(r.randint(0, 25))) for _ in range(300)]
    chunks = spark.createDataFrame(list(enumerate([*texts, None, "  "])), "chunk_id long, content string")
    asked = [[t for t in "aa bb cc dd e k".split() if r.random() < 0.5] for _ in range(60)]
    q = spark.createDataFrame(list(enumerate(asked)), "query_id long, terms array<string>")
    want = {tuple(x) for x in S.lexical_top_k(S.cover_density(S.match_all(S.postings(chunks), q)), 9).collect()}
    for chars, sets, pairs in ((16_000_000, 400_000, 2_000_000), (300, 7, 50)):
        for n, v in zip(("CHARS", "SETS", "PAIRS"), (chars, sets, pairs), strict=True):
            monkeypatch.setattr(S, n, v)
        found = S.lexical_search(chunks, q, k=9)
        assert {tuple(x) for x in found.collect()} == want and len(want) > 100
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "regexp_extract_all" not in plan


def test_only_active_editions_are_cut_into_lines(spark):
    from scriptorium.corpus import Corpus
    from scriptorium.plans.search import _searchable

    plan = _searchable(Corpus(spark, "/root/testdata/sf0.001"))._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in plan[plan.index("Generate") :]


def test_retrieved_chunks_are_normalised_once(spark):
    from scriptorium.operators import citations as C

    chunks = spark.createDataFrame([(1, "a  b\u00a0c"), (2, None), (3, "x")], "chunk_id long, content string")
    seen = spark.createDataFrame([(q, i) for q in (1, 2) for i in (1, 2)], "query_id long, chunk_id long")
    cites = spark.createDataFrame([(q, i, t) for q in (1, 2, 3) for i in (1, 2, 3, -1) for t in ("a b c", " b ", "x", " ", None)], "query_id long, chunk_id long, quote string")
    want = C.validate(cites, seen.join(chunks, "chunk_id"))
    assert sorted(map(repr, C.validate(cites, seen, chunks).collect())) == sorted(map(repr, want.select(*cites.columns, "reason").collect()))


def test_quotes_grams_go_to_the_corpus_and_words_are_cut_once(spark):
    """The corpus' grams are not shuffled, and a long line takes time by its length, not its square."""
    import time

    from scriptorium.operators import citations as C
    from pyspark.sql import functions as F

    quotes = spark.createDataFrame([(1, "one two three four five", "none"), (2, "one two", "one two"), (3, "x", None)], "quote_id long, quote string, cited string")
    quotes = quotes.withColumn("others", F.expr("cast(array() as array<string>)"))
    corpus = spark.createDataFrame([("One two,three FOUR",), ("w " * 100_000,), (None,)], "content string").repartition(2)
    begin = time.time()
    out = C.diagnose(quotes, corpus)
    assert {r["quote_id"]: (r["n_grams"], r["elsewhere"]) for r in out.collect()} == {1: (2, 1), 2: (0, 0), 3: (0, 0)}
    assert time.time() - begin < 60
    texts = spark.createDataFrame([("a b c d e a b c d",), ("a b c",), (None,)], "t string")
    assert [r[0] for r in texts.select(C.grams(F.col("t"))).collect()] == [["a b c d", "b c d e", "c d e a", "d e a b", "e a b c"], [], []]
    assert texts.select(F.sum(F.size(C.grams(F.col("t"), each=True)))).first()[0] == 6
    assert "BroadcastHashJoin" in out._jdf.queryExecution().executedPlan().toString()


def test_texts_and_sets_of_a_search_stay_where_they_are(spark, monkeypatch):
    """No text is dealt and no set meets a block of texts in a shuffle: sets go to the texts, each block of sets with one pass."""
    chunks, q = _corpus(spark)
    want = {tuple(r) for r in S.lexical_search(chunks, q, k=3).collect()}
    monkeypatch.setattr(S, "SETS", 2)
    monkeypatch.setattr(S, "HELD", 5)
    monkeypatch.setattr(S, "CHARS", 40)
    found = S.lexical_search(chunks.repartition(3), q, k=3)
    assert {tuple(r) for r in found.collect()} == want
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroups" not in plan and plan.count("MapInArrow") >= 3
    assert not any("Exchange" in line and "said" in line for line in plan.splitlines())


def test_lists_fuse_as_rows_do(spark):
    import random

    from pyspark.sql import functions as F

    r = random.Random(2)
    rows = [(i, *[r.sample(range(30), r.randint(0, 12)) if r.random() < 0.8 else None for _ in range(2)]) for i in range(60)]
    lists = spark.createDataFrame(rows, "query_id long, vector array<long>, lexical array<long>")
    half = lambda c: lists.select("query_id", F.posexplode(c).alias("at", "chunk_id")).select("query_id", "chunk_id", (F.col("at") + 1).alias("rank"))
    want = sorted(tuple(x) for x in S.fuse(half("vector"), half("lexical"), 7).collect())
    assert sorted(tuple(x) for x in S.fuse_lists(lists, 7).collect()) == want and len(want) > 200


def test_vectors_that_k_chunks_precede_do_not_leave_a_block():
    import numpy as np

    of, d = np.array([0, 0, 0, 0, 1, 1, 2]), np.array([0.1, 0.2, 0.2000001, 0.3, 0.1, np.inf, np.inf])
    n = np.array([1, 4, 1, 9, 2, 3, 1])
    assert S._reached(of, d, n, 5).tolist() == [0, 1, 2, 4, 5, 6] and S._reached(of, d, n, 1).tolist() == [0, 4, 6]


def test_distances_are_taken_once_for_a_pair_of_vectors(spark):
    """Hits are enriched by ids; no vector of a question is needed for each of its hits."""
    v = {1: [1.0, 0.0], 2: [1.0, 1.0], 3: [0.0, 0.0]}
    vectors = spark.createDataFrame(list(v.items()), "vec_id long, embedding array<double>")
    hits = spark.createDataFrame([(q, c, c % 2) for q in (7, 8, 9) for c in (10, 11, 12)], "query_id long, chunk_id long, rank int")
    chunks = spark.createDataFrame([(10, 1, 1, 1), (11, 1, 2, 2), (12, 2, 1, 3)], "chunk_id long, version_id long, page long, vec_id long")
    versions = spark.createDataFrame([(1, 5, "Ed. 1", 2, None), (2, 5, "Ed. 2", None, [3])], "version_id long, document_id long, version_label string, superseded_by long, unreadable_pages array<long>")
    documents = spark.createDataFrame([(5, "T", "O", "x")], "document_id long, title string, issuing_org string, other string")
    asked = spark.createDataFrame([(7, 1), (8, 1), (9, 2)], "query_id long, asked long")
    out = S.enrich(hits, chunks, vectors, versions, documents, asked)
    got = {(r["query_id"], r["chunk_id"]): (r["distance"], r["is_superseded"], r["page"], r["title"], r["rank"]) for r in out.collect()}
    far = {(1, 1): 0.0, (1, 2): 0.292893, (2, 1): 0.292893, (2, 2): 0.0}
    assert got == {(q, c): (far.get((a, w)), e, p, "T", c % 2) for q, a in ((7, 1), (8, 1), (9, 2)) for c, w, e, p in ((10, 1, True, 1), (11, 2, True, 2), (12, 3, False, 1))}
