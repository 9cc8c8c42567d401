import pytest

from tidemark.llm import queries


@pytest.mark.parametrize("name", list(queries.SQL))
def test_query_equals_sql(spark, sf, against, name):
    against(spark, sf, queries.QUERIES[name], queries.SQL[name])


def test_token_queries(spark, sf):
    ids = {r.doc_id: len(r.ids) for r in queries.p8_ids(spark, sf).collect()}
    assert {r.doc_id for r in queries.p10_found(spark, sf).collect()} == {d for d, n in ids.items() if n > 1024}
    assert len(ids) == spark.read.parquet(f"{sf}/documents.parquet").count()
