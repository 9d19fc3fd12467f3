"""Ground truth counts where pairs arise."""

from scriptorium.operators.citations import ground_truth


def test_each_chunk_counts_once_and_no_pair_is_shuffled(spark):
    chunks = spark.createDataFrame([(i, 1 + i % 2, t, i % 3 > 0) for i, t in enumerate(["alpha beta", "beta gamma", "Alphabet", "", None, "gamma alpha beta", "x"])], "chunk_id long, page int, content string, live boolean")
    asked = [(1, ["alpha", "beta"], [1, 2]), (2, ["beta", "Beta", None], [1]), (3, [], [1]), (4, None, [2]), (5, ["gamma", "alpha", "lpha"], [2, 2]), (6, ["zzz"], [1, 2])]
    got = ground_truth(spark.createDataFrame(asked, "id int, terms array<string>, pages array<int>"), chunks)
    want = set()
    rows = chunks.collect()
    for i, terms, pages in asked:
        hit = [r["live"] for r in rows if r["page"] in pages and any(t and t.lower() in (r["content"] or "").lower() for t in terms or [])]
        want.add((i, sum(hit), len(hit) - sum(hit), sum(hit) > 0))
    assert {tuple(r) for r in got.collect()} == want
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Deduplicate" not in plan and "Aggregate [id#" in plan and "Aggregate [chunk_id" in plan and "live#" in plan
    assert not any("Aggregate [id#" in line and "chunk_id" in line for line in plan.splitlines())


def test_sets_are_counted_where_texts_are_read(spark, monkeypatch):
    """Terms of any script, with spaces and signs; rows of one chunk; slices, blocks of sets and tiles of bits change nothing."""
    import random

    from scriptorium.operators import counts as N

    r = random.Random(3)
    words = ["alpha", "Beta", "gammaalpha", "x-ray", "მსოფლიო", "Straße", "a b", "MEC 2", "...", "\ty"]
    texts = [r.choice([" ", "", ", "]).join(r.choice(words) for _ in range(r.randint(0, 7))) for _ in range(200)] + [None, "alpha " * 400]
    rows = [(i if i % 40 else 0, r.randint(1, 4), t, i % 3 > 0 if i % 50 else None) for i, t in enumerate(texts)]
    chunks = spark.createDataFrame(rows, "chunk_id long, page long, content string, live boolean").repartition(3)
    terms = ["alpha", "ALPHA", "pha", "x-ray", "მსოფ", "სო", "straße", "a b", "mec 2", ".", "-", " ", "", None, "\ty", "zzz", "gamma"]
    asked = [(i, [r.choice(terms) for _ in range(r.randint(0, 4))], [r.randint(1, 5) for _ in range(r.randint(0, 3))]) for i in range(80)]
    q = spark.createDataFrame(asked, "id int, terms array<string>, pages array<int>")
    want = set()
    for i, some, pages in asked:
        hit = {(c, live) for c, p, t, live in rows if p in pages and live is not None and any(x and x.lower() in (t or "").lower() for x in some)}
        n = sum(live for _, live in hit)
        want.add((i, n, len(hit) - n, n > 0))
    assert {tuple(x) for x in ground_truth(q, chunks).collect()} == want and sum(w[3] for w in want) > 20
    for size, sets, cells in ((400, 9, 64), (3_000, 50, 1_000)):
        for n, v in zip(("BYTES", "SETS", "CELLS"), (size, sets, cells), strict=True):
            monkeypatch.setattr(N, n, v)
        assert {tuple(x) for x in ground_truth(q, chunks).collect()} == want


def test_no_pair_leaves_a_task(spark):
    import __spark_entry__ as entry

    plan = entry.queries()["c12_ground_truth"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "held" not in plan
