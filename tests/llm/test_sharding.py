from collections import Counter

import duckdb
import pytest
from check_oracle import rows_of
from pyspark.sql import functions as F
from samples import SF, docs, no_docs, odd_docs  # noqa: F401

from textlode.llm import queries, sharding


def test_query_equals_sql(spark):
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF}/documents.parquet')")
    df = queries.op12_sharding(spark, SF)
    result = duck.execute(queries.oracle_sql()["op12_sharding"])
    columns = [c[0] for c in result.description]
    assert rows_of(df.columns, df.collect()) == rows_of(columns, result.fetchall())


@pytest.mark.parametrize("n", [1, 2, 3, 5, 8, 10, 12, 13, 97, 1000, 1001, 1025])
def test_permutation_and_its_inverse(spark, n):
    a, b = sharding.sides(n)
    assert 0 <= a * b - n < a
    rows = spark.range(n).select(
        "id",
        sharding.permuted(F.col("id"), n, "s").alias("p"),
        sharding.restored(sharding.permuted(F.col("id"), n, "s"), n, "s").alias("back"),
    )
    found = rows.collect()
    assert sorted(r.p for r in found) == list(range(n))
    assert all(r.id == r.back for r in found)


def test_walks_of_any_length_end_in_range(spark, monkeypatch):
    # A range far below a x b, so that most numbers leave it for a long time.
    monkeypatch.setattr(sharding, "sides", lambda n: (16, 16))
    found = spark.range(5).select(sharding.permuted(F.col("id"), 5).alias("p")).collect()
    assert sorted(r.p for r in found) == list(range(5))


def test_shuffle_depends_on_seed_and_mixes(spark):
    rows = spark.range(4000).select(
        sharding.permuted(F.col("id"), 4000, "a").alias("a"),
        sharding.permuted(F.col("id"), 4000, "b").alias("b"),
    ).collect()
    assert sum(r.a == r.b for r in rows) < 10
    # Neighbours are apart: a third of the range in the mean.
    apart = [abs(x.a - y.a) for x, y in zip(rows, rows[1:])]
    assert 1100 < sum(apart) / len(apart) < 1570


def test_shards_are_even_whole_and_the_same_for_any_partitions(spark, docs):  # noqa: F811
    keep = docs.select("doc_id", "text")
    one = sharding.sharded(keep, ["doc_id"], 7)
    other = sharding.sharded(keep.repartition(13), ["doc_id"], 7)
    rows = sorted(map(tuple, one.collect()))
    assert rows == sorted(map(tuple, other.collect()))
    assert {r[0] for r in rows} == {r.doc_id for r in docs.collect()}
    slots = {}
    for r in rows:
        slots.setdefault(r[2], []).append(r[3])
    sizes = [len(s) for s in slots.values()]
    assert max(sizes) - min(sizes) <= 1 and len(slots) == 7
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_shard_and_slot_are_computable(spark):
    rows = spark.range(100).select(F.col("id").alias("doc_id"))
    n = F.lit(0)
    found = sharding.sharded(rows, ["doc_id"], 3).withColumn(
        "back", sharding.row_of(F.col("shard"), F.col("slot"), 100, 3)
    )
    assert all(r.doc_id == r.back for r in found.collect())
    place = spark.range(1).select(sharding.shard_of(n + 42, 100, 3).alias("at")).head()["at"]
    row = found.where("doc_id = 42").head()
    assert (place.shard, place.slot) == (row.shard, row.slot)


def test_odd_and_empty_tables(spark, odd_docs, no_docs):  # noqa: F811
    found = sharding.document_shards(odd_docs).collect()
    assert len(found) == odd_docs.count()
    assert Counter(r.shard for r in found).most_common()[0][1] == 2
    null = [r for r in found if r.doc_id == 1]
    assert null[0].size == 1 and null[0].text_crc32 == 0 and null[0].grown_shard is None
    assert sharding.document_shards(no_docs).collect() == []
    clash = odd_docs.withColumns({c: F.lit(1) for c in ("number", "at", "tie", "salt", "slot")})
    assert sharding.sharded(clash, ["doc_id"]).count() == odd_docs.count()


def test_one_key_of_all_rows_is_spread(spark, monkeypatch):
    kept = {}

    def keep(df, name, store=sharding.stored):
        kept[name] = store(df, name)
        return kept[name]

    monkeypatch.setattr(sharding, "stored", keep)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    rows = spark.range(20_000, numPartitions=8).select(
        F.lit(None).cast("long").alias("doc_id"), F.lit("same").alias("text")
    )
    found, n = sharding.numbered(rows, ["doc_id"], "number")
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert n == 20_000
    assert found.agg(F.count_distinct("number"), F.max("number")).head()[:] == (20_000, 19_999)
    parts = [r["n"] for r in kept["counts"].collect()]
    assert sum(parts) == 20_000 and len(parts) > 1 and max(parts) < 12_000


def test_written_shards_are_in_order(spark, docs, tmp_path, monkeypatch):  # noqa: F811
    monkeypatch.setattr(sharding, "FILE_ROWS", 10)
    placed = sharding.sharded(docs, ["doc_id"], 4)
    sharding.write_shards(placed, f"{tmp_path}/out")
    files = list((tmp_path / "out" / "shard=2").glob("*.parquet"))
    assert len(files) > 1
    for file in files:
        slots = [r.slot for r in spark.read.parquet(str(file)).collect()]
        assert slots == sorted(slots)
    back = spark.read.parquet(f"{tmp_path}/out")
    assert back.select(*placed.columns).exceptAll(placed).count() == 0
    assert back.count() == docs.count()
