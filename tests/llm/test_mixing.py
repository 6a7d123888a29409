import hashlib
import math

import duckdb
import pytest
from pyspark.sql import functions as F
from check_oracle import rows_of
from samples import ODD, SF, docs, no_docs, odd_docs  # noqa: F401

from textlode.llm import mixing, queries


def plain_count(mean, key, seed=mixing.SEED):
    parts = max(1, math.ceil(mean / mixing.MEAN))
    total = 0
    for part in range(parts):
        digest = hashlib.md5(f"{seed}:{part}:{key}".encode()).hexdigest()[:13]
        u, p, k = int(digest, 16) / 16**13, math.exp(-mean / parts), 0
        c = p
        while c <= u and k < 1000:
            k += 1
            p = p * (mean / parts) / k
            c += p
        total += k
    return total


@pytest.mark.parametrize("name", ["op2_warc", "op5_mixing_sources"])
def test_query_equals_sql(spark, name):
    duck = duckdb.connect()
    for table in ("documents", "pages"):
        duck.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{SF}/{table}.parquet')")
    df = getattr(queries, name)(spark, SF)
    result = duck.execute(queries.oracle_sql()[name])
    columns = [c[0] for c in result.description]
    assert rows_of(df.columns, df.collect()) == rows_of(columns, result.fetchall())


def test_numbers_follow_weights(spark):
    rows = [(i, "a" if i % 4 else "b", "x" * 9) for i in range(8000)] + [(8001, None, "x" * 9)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    mixed = mixing.replicate(docs, weights={"a": 1, "b": 3}, copy="copy", rate="rate").collect()
    found = {s: [r for r in mixed if r.source == s] for s in ("a", "b", None)}
    total = 8001
    assert abs(len(found["a"]) - total / 4) < 200 and abs(len(found["b"]) - 3 * total / 4) < 300
    assert not found[None]
    rate = {"a": total / 4 / 6000, "b": 3 * total / 4 / 2000}
    got = {}
    for r in mixed:
        got[r.doc_id] = got.get(r.doc_id, 0) + 1
        assert math.isclose(r.rate, rate[r.source])
    for i, source, _ in rows[:-1]:
        assert got.get(i, 0) == plain_count(rate[source], i)


def test_large_rates_are_sums(spark):
    docs = spark.createDataFrame(
        [(1, "rare", "x"), (2, "big", "y" * 9999)], "doc_id long, source string, text string"
    )
    mixed = mixing.replicate(docs, weights={"rare": 1, "big": 1}, copy="copy").collect()
    n = sum(r.doc_id == 1 for r in mixed)
    assert n == plain_count(0.5 * (2 + 10000) / 2, 1) and 2200 < n < 2800
    assert {r.copy for r in mixed if r.doc_id == 1} == set(range(1, n + 1))


def test_rows_without_identifier_differ(spark):
    rows = [(None, "s", f"text {i}") for i in range(4000)] + [(None, "s", None)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    mixed = mixing.replicate(docs, copy="copy")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        dealt = mixing.replicate(docs).groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(dealt) > 1 and max(r["count"] for r in dealt) < 3000
    got = {}
    for r in mixed.collect():
        got[r.text] = got.get(r.text, 0) + 1
    for _, _, text in rows:
        assert got.get(text, 0) == plain_count(1.0, hashlib.md5((text or "").encode()).hexdigest())
    assert len(set(got.values())) > 2


def test_order_is_global(spark, docs):
    order = [r.doc_id for r in mixing.replicate(docs).collect()]
    again = [r.doc_id for r in mixing.replicate(docs).collect()]
    assert order == again and order != sorted(order)


def test_odd_texts(odd_docs, no_docs):
    mixed = mixing.replicate(odd_docs, copy="nth")
    assert mixed.columns == [*odd_docs.columns, "nth"]
    counts = {}
    for r in mixed.collect():
        key = (r.doc_id, r.text)
        counts[key] = counts.get(key, 0) + 1
    for i, text in ODD:
        n = plain_count(1.0, hashlib.md5(text.encode()).hexdigest() if i is None else i)
        assert counts.get((i, text), 0) == n * (2 if i == 9 else 1)
    assert mixing.replicate(no_docs).columns == no_docs.columns
    assert mixing.replicate(no_docs).count() == 0
    assert mixing.replicate(odd_docs, weights={"other": 1}).count() == 0
