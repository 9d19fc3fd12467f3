"""Every registered query with SQL against DuckDB, on the smallest tables."""

import datetime
import decimal
import math

import duckdb
import pytest

import scriptorium.plans as plans

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(plans.ORACLE_SQL))
def test_matches_sql(spark, duck, name):
    df = plans.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    found = duck.execute(plans.ORACLE_SQL[name])
    names = [x[0] for x in found.description]
    assert sorted(names) == cols
    want = sorted((tuple(plain(r[names.index(c)]) for c in cols) for r in found.fetchall()), key=repr)
    assert got == want


def test_chunk_invariants(spark):
    """Dense ordinals, spans within the cap unless one line is longer, every line covered, overlap short."""
    rows = plans.QUERIES["f8_chunk_packing"](spark, SF).collect()
    by = {}
    for r in rows:
        by.setdefault(r["version_id"], []).append(r)
    assert by
    for chunks in by.values():
        chunks.sort(key=lambda r: r["ordinal"])
        assert [r["ordinal"] for r in chunks] == list(range(len(chunks)))
        for a, b in zip(chunks, chunks[1:], strict=False):
            assert b["char_start"] > a["char_start"] and b["char_end"] > a["char_end"]
            assert b["char_start"] <= a["char_end"] + 2
        assert all(r["char_end"] - r["char_start"] <= 1800 or r["n_lines"] <= 2 for r in chunks)


def test_recall_of_approximate_search(spark):
    from pyspark.sql import functions as F

    from scriptorium.corpus import Corpus
    from scriptorium.operators.search import vector_top_k

    c = Corpus(spark, SF)
    q = c.query_vectors().withColumn("sector", F.lit("x"))
    exact = vector_top_k(c.table("embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding", F.lit("x").alias("sector")), q, 10)
    found = plans.QUERIES["e2_approximate_top_k"](spark, SF)
    hits = exact.join(found.select("query_id", F.col("vec_id").alias("chunk_id")), ["query_id", "chunk_id"]).count()
    assert hits >= 0.9 * exact.count()
