import pytest

import __spark_entry__ as entry_module
from annalist.plans import QUERIES, SQL
from tests.compare import same_rows


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, duck, sf, name):
    same_rows(QUERIES[name](spark, sf), duck, SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_has_rows(spark, sf, name):
    df = QUERIES[name](spark, sf)
    assert df.count() > 0
    assert len(set(df.columns)) == len(df.columns)


def test_entry(spark):
    assert entry_module.entry(spark).count() > 0


def test_sql_names_are_queries():
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())


def test_detect_language_is_mostly_right(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang", "n_chars")
    found = QUERIES["language"](spark, sf).join(docs, "doc_id").filter("n_chars > 200")
    assert found.filter("language = lang").count() >= 0.95 * found.count()


def test_passages_after_other_characters(spark, tmp_path):
    import duckdb

    from annalist.plans import papers

    items = [(1, "Alpha beta gamma delta epsilon zeta"), (2, "one two three"), (3, " led by white space it is"), (4, "x"), (5, "five words\nhere  are\tnow")]
    docs = [(1, 'He said "Alpha beta gamma delta epsilon zeta", then left'), (2, "(one two three)."), (3, "text  led by white space it is"), (4, "aXxb"), (5, "nothing"), (6, "(five words\nhere  are\tnow)"), (7, None)]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    same_rows(papers.passage_spans(spark, str(tmp_path)), con, papers.SQL["passage_spans"])
