"""Parts of pages where there is none."""

from scriptorium.operators import layout as Y


def test_documents_without_characters_have_no_part(spark, tmp_path):
    import duckdb

    import __spark_entry__ as entry

    sizes = [0, None, 1, 120, 121, 240, 12_000, 12_001, 118_800, 118_801]
    spark.createDataFrame(list(enumerate(sizes)), "doc_id long, n_chars long").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(tuple(r) for r in entry.queries()["f9_page_parts"](spark, str(tmp_path)).collect())
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert got == sorted(con.sql(entry.oracle_sql()["f9_page_parts"]).fetchall()) and {r[0] for r in got} == set(range(2, len(sizes)))


def test_a_file_without_pages_is_one_part(spark):
    found = Y.parts(spark.createDataFrame([(1, 0)], "id int, n_pages long")).select("part", "first_page", "last_page", "suffix")
    assert [tuple(r) for r in found.collect()] == [(1, 1, 0, "")]
