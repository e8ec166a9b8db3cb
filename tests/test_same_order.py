import duckdb

from editlens.plans import table_queries
from oracle import catalog_sql


def test_moved_entries_have_places_of_their_own(spark, tmp_path):
    """Half a thousand million places on there are entries of later documents in a large table."""
    words = " ".join(["Wort"] * 12 * 208)
    rows = [(0, words, "de", "s", len(words)), (121981, words, "de", "s", len(words))]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, table_queries.x04_same_order(spark, str(tmp_path)).collect()), key=str)
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    want = sorted(con.execute(catalog_sql.SQL["x04_same_order"]).fetchall(), key=str)
    assert got == want and len({r[0] for r in got}) < len(got)
