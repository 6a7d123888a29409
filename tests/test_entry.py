import duckdb
import pytest
from conftest import SF

import __spark_entry__ as entry
from check_oracle import TABLES, rows_of

# One query per kind of plan; check_oracle.py compares all of them.
SAMPLE = (
    "analyze_counts",
    "query_top_n",
    "search_batch_float",
    "upsert_latest",
    "byte_mode_counts",
    "strict_prefix_text",
    "attach_stats",
)


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(
            f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{SF}/{table}.parquet')"
        )
    return connection


def test_every_query_has_sql():
    own = {query.__name__ for query in entry.QUERIES}
    assert own <= set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert len(rows) == 10 and rows[0].score >= rows[-1].score > 0


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    result = duck.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in result.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows_of(df.columns, df.collect()) == rows_of(columns, result.fetchall())


def test_batches_of_an_index_hold_every_document(spark, tmp_path):
    rows = [(1, "alpha beta", "en"), (-3, "alpha gamma", None), (2, "alpha", "de"), (-4, "beta", None)]
    rows += [(None, "alpha delta", "fr")]
    frame = spark.createDataFrame([(*r, "s") for r in rows], "doc_id long, text string, lang string, source string")
    frame.write.parquet(str(tmp_path / "documents.parquet"))
    for query in ("compact_index", "index_rebuild"):
        found = {r.token: r for r in entry.queries()[query](spark, str(tmp_path)).collect()}
        assert {t: found[t].df for t in ("ALPHA", "BETA", "GAMMA", "DELTA")} == {
            "ALPHA": 4, "BETA": 2, "GAMMA": 1, "DELTA": 1
        }
    assert found["ALPHA"].n_docs == 5
