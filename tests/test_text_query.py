"""The query of spaced and cleaned texts equals its SQL on texts with vertical tabs, with v at an end, and on NULL."""

import duckdb

from listing_lake.plans import registry


def test_odd_texts(spark, tmp_path):
    texts = ["vax v", "a\vb", "\v a_b\v", None, "", " v ", "a/b-c", "a/b/c", "v\v v", "x;y\f"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    c = duckdb.connect()
    c.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    want = sorted(c.execute(registry.oracle_sql()["c6_c7_text"]).fetchall())
    assert sorted(map(tuple, registry.queries()["c6_c7_text"](spark, str(tmp_path)).collect())) == want
