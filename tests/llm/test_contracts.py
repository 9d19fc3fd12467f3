"""The registered queries, run on small tables: every contract column against a brute-force version, and against SQL where there is some."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest
from test_operators import PRIVATE, base, classes, corpus, removed, spans

from scriptorium.llm import queries as Q

TEXTS = list({i: (i, t) for i, t in corpus() if i is not None}.values()) + [(500 + i, t) for i, t in enumerate(PRIVATE)] + [(600, "A" * 300), (601, "$$ word " * 40), (602, "é" * 50 + " word" * 30), (603, "12 34 56 78 " * 10)]
ITEMS = [(1, " ".join((corpus()[9][1] or "").split()[:30])), (2, "A"), (3, " ".join((corpus()[12][1] or "").split()[2:9])), (4, None), (5, "!!!"), (10, corpus()[3][1]), (11, " ".join((corpus()[12][1] or "").split()[2:9]))]
sha = lambda x: hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(TEXTS, "doc_id long, text string").coalesce(1).write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame(ITEMS, "item_id long, text string").coalesce(1).write.parquet(f"{root}/benchmark.parquet")
    spark.createDataFrame([(1, "<p>one<p>two"), (2, None)], "page_id long, html string").coalesce(1).write.parquet(f"{root}/pages.parquet")
    spark.createDataFrame(vectors(), "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(f"{root}/embeddings.parquet")
    return str(root)


def vectors():
    """Ties, repeated rows, and rows that take no part; integers divided by 256, so that floors are exact."""
    r = random.Random(8)
    rows = [(i, [r.randrange(-9, 30) / 256 for _ in range(6)], r.randrange(3)) for i in range(400)]
    rows += rows[::50] + [(1000 + i, rows[i][1], rows[i][2]) for i in range(0, 90, 9)] + [(-100, rows[5][1], 1), (-7, rows[5][1], 0)]
    return rows + [(700, None, 1), (800, [0.1] * 5 + [None], 1), (900, [float("nan")] * 6, 2), (1100, [float("inf")] * 6, 2), (None, rows[3][1], 1), (1200, rows[3][1], None), (1300, [], 1), (1400, [0.5, 0.5], 2), (1401, [0.4, 0.5], 1), (1402, [0.5, 0.4], 2)]


def run(spark, sf, name):
    return [r.asDict() for r in Q.QUERIES[name](spark, sf).collect()]


def same(got, want):
    key = lambda x: sorted(map(repr, (tuple(sorted(r.items())) for r in x)))
    assert key(got) == key(want)


def test_near_duplicates_query(spark, sf):
    want = [{"doc_id": i, "class_id": c[0], "n_links": c[1]} for (i, _), c in zip(TEXTS, classes(TEXTS)[0], strict=True)]
    same([{k: r[k] for k in ("doc_id", "class_id", "n_links")} for r in run(spark, sf, "op1_ngram_jaccard_join")], want)


def test_pieces_query(spark, sf):
    rows = run(spark, sf, "op2_sentencepiece")
    assert len(rows) == len(TEXTS) and all(r["exact"] for r in rows)
    counts = {r["doc_id"]: r["n_tokens"] for r in run(spark, sf, "op7_token_counts")}
    assert all(counts[r["doc_id"]] == max(r["n_pieces"] or 0, 0) for r in rows if r["n_pieces"] is not None)


def test_personal_data_query(spark, sf):
    names = ("email", "ip", "card", "phone")
    for r in run(spark, sf, "op3_personal_data"):
        found = spans(dict(TEXTS)[r["doc_id"]])
        kinds = Counter(x.split(":")[0] for x in found.split(",") if x)
        assert [r[f"n_{k}"] for k in names] == [kinds[k] for k in names] and r["base_sha256"] == sha(found)
        assert set(filter(None, found.split(","))) <= set(filter(None, r["spans"].split(",")))


def test_added_spans_are_secrets(spark, tmp_path):
    """Held-out truth: of planted credentials most get a span beyond the base, and of plain prose none."""
    import random

    r = random.Random(2)
    token = lambda n: "".join(r.choice("0123456789abcdef") for _ in range(n))
    prose = lambda: " ".join(r.choice(["the", "cost", "of", "token", "price", "green", "key", "word"]) for _ in range(60))
    rows = [(i, f"{prose()} {r.choice(['password=', 'api_key: ', 'token = '])}{token(24)} {prose()}" if i % 2 else prose()) for i in range(400)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {x["doc_id"]: x["spans"] for x in run(spark, str(tmp_path), "op3_personal_data")}
    assert sum(bool(got[i]) for i in range(1, 400, 2)) >= 190 and not any(got[i] for i in range(0, 400, 2))


def lines_left(rows):
    sets, seen, out = [], set(), {}
    for i, t in sorted(rows):
        kept = []
        for line in (t or "").split("\n"):
            w = frozenset(re.findall("[^ \t\x0b\x0c\r]+", line))
            if w and (line in seen or any(9 * len(w & x) >= 4 * (len(w) + len(x)) for x in sets)):
                seen.add(line)
                sets.append(w)
                continue
            if w:
                seen.add(line)
                sets.append(w)
            kept.append(line)
        n = (t or "").count("\n") + 1 if t is not None else 0
        out[i] = (n, n - len(kept) if t is not None else 0, "\n".join(kept) if t is not None else None)
    return out


def test_line_dedup_query(spark, sf):
    want = [{"doc_id": i, "n_lines": n, "n_removed": gone, "kept_sha256": sha(t) if t is not None else None} for i, (n, gone, t) in lines_left(TEXTS).items()]
    same(run(spark, sf, "op4_line_dedup"), want)


def contaminated(text, items):
    words = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    w, hit, found = words(text), set(), set()
    for item, t in items:
        iw = words(t)
        n = min(13, len(iw))
        grams = {tuple(iw[j : j + n]) for j in range(len(iw) - n + 1)} if n else set()
        for j in range(len(w) - n + 1 if n else 0):
            if tuple(w[j : j + n]) in grams:
                hit |= set(range(j, j + n))
                found.add(str(item))
    return len(w), len(hit), sorted(found)


def test_decontamination_query(spark, sf):
    want = []
    for i, t in TEXTS:
        n, hit, items = contaminated(t, ITEMS)
        want.append({"doc_id": i, "n_words": n, "n_hit": hit, "n_items": len(items), "items_sha256": sha(",".join(items)), "contaminated": hit > 0 and 20 * hit >= n})
    same(run(spark, sf, "op5_decontamination"), want)


def test_sharding_query(spark, sf):
    rows = run(spark, sf, "op6_sharding")
    texts = dict(TEXTS)
    by = defaultdict(list)
    for r in rows:
        b = (texts[r["doc_id"]] or "").encode()
        assert r["size"] == len(b) + 1 and r["text_crc32"] == zlib.crc32(b) and r["law"] == "rows" and r["grown_shard"] is None
        by[r["shard"]].append(r["slot"])
    assert sorted(r["doc_id"] for r in rows) == sorted(texts) and set(by) <= set(range(16))
    assert all(sorted(s) == list(range(len(s))) for s in by.values()) and max(map(len, by.values())) - min(map(len, by.values())) <= 1


def test_sharding_keeps_any_column(spark):
    from scriptorium.llm.sharding import shard

    names = ["part", "rid", "row", "at", "ends", "order", "bucket", "before", "n", "slot", "shard", "__rid"]
    df = spark.createDataFrame([tuple(f"{n}{i}" for n in names) for i in range(50)], names)
    out = shard(df, 4)
    rows = out.collect()
    assert out.columns == [n for n in names if n not in ("slot", "shard")] + ["shard", "slot"]
    assert {r["part"] for r in rows} == {f"part{i}" for i in range(50)} and all(r["bucket"][6:] == r["part"][4:] for r in rows)


def test_suffix_array_query(spark, sf):
    want = [{"doc_id": i, "n_bytes": n, "n_removed": cut, "n_spans": k, "kept_sha256": sha(kept), "repeats": cut > 0} for (i, _), (n, cut, k, kept) in zip(TEXTS, removed(TEXTS, 400), strict=True)]
    same(run(spark, sf, "op9_suffix_array_dedup"), want)


def verdict(t):
    t = t or ""
    n, chars, symbols, _, _, failed = base(t)
    upper, lower, wide = (sum(1 for c in t if f(c)) for f in (lambda c: "A" <= c <= "Z", lambda c: "a" <= c <= "z", lambda c: ord(c) > 127))
    return not (failed or 10 * symbols > n or upper > lower + 20 or chars > 16 * max(n, 1) or 2 * (upper + lower + wide) < chars)


def test_quality_query(spark, sf):
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    same(run(spark, sf, "op10_quality_rules"), [{"doc_id": i, **dict(zip(names, base(t), strict=True)), "kept": verdict(t)} for i, t in TEXTS])


@pytest.mark.parametrize("name", sorted(Q.ORACLE_SQL))
def test_matches_sql(spark, sf, name):
    c = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet/*.parquet'")
    found = c.execute(Q.ORACLE_SQL[name])
    names = [x[0] for x in found.description]
    same(run(spark, sf, name), [dict(zip(names, r, strict=True)) for r in found.fetchall()])


def test_texts_of_many_numbers(spark, tmp_path):
    """Spans are the brute-force ones in texts with thousands of numbers, valid and not, over many blocks of matches."""
    r = random.Random(6)
    number = lambda: r.choice([str(r.randrange(10 ** r.randrange(1, 9))), ".".join(str(r.randrange(300)) for _ in range(4)), f"+1 {r.randrange(10**9, 10**10)},", "x@y.org"])
    texts = {i: " ".join(number() for _ in range(n)) for i, n in enumerate([255, 256, 257, 512, 3000])}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = run(spark, str(tmp_path), "op3_personal_data")
    assert {x["doc_id"]: x["base_sha256"] for x in rows} == {i: sha(spans(t)) for i, t in texts.items()}


def test_wider_spans_stay_clear_of_base_ones(spark):
    from pyspark.sql import functions as F

    from scriptorium.llm.pii import SPANS, _clear

    r = random.Random(7)
    cases = []
    for _ in range(60):
        some = lambda n, k: [(a, a + r.randrange(1, 9), k, "", "", "") for a in sorted(r.sample(range(900), n))]  # noqa: E731, B023
        cases.append((some(r.randrange(0, 300), 0), some(r.randrange(0, 300), 4)))
    got = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], f"i int, base {SPANS}, wider {SPANS}").select("i", _clear(F.col("base"), F.col("wider")).alias("c")).collect()
    for x in got:
        base, wider = cases[x["i"]]
        assert sorted(map(tuple, x["c"])) == sorted(w for w in wider if not any(b[0] < w[1] and w[0] < b[1] for b in base))


def test_two_hundred_thousand_numbers(spark, tmp_path):
    import time

    spark.createDataFrame([(1, " ".join(str(k * 7919 % 10**8) for k in range(200_000)))], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    began = time.time()
    assert len(run(spark, str(tmp_path), "op3_personal_data")) == 1
    assert time.time() - began < 60
