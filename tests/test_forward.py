"""Layout by document: what an upsert reads, and what a search reads."""

import pytest
from pyspark.sql import functions as F

from textlode import Analyzer, TermIndex
from textlode.operators.statistics import document_frequency
from textlode.sources import index_tables
from textlode.sources.index_tables import IndexTables, read_index, write_index

AN = Analyzer(gram_sizes=())


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


COLUMN = {"forward": "terms#", "term_freq": "tf#", "token_df": "df#"}


def scans(df, table):
    """Scans of a table in the plan, known by a column that no other table has."""
    plan = df._jdf.queryExecution().toString()
    return [
        x for x in plan.splitlines()
        if "FileScan parquet" in x and any(f"{sep}{COLUMN[table]}" in x for sep in "[,")
    ]


def jobs_of(spark, run):
    """Jobs that a call starts."""
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("counted", "counted")
    before = set(tracker.getJobIdsForGroup("counted"))
    run()
    after = set(tracker.getJobIdsForGroup("counted"))
    spark.sparkContext.setJobGroup("other", "other")
    return len(after - before)


@pytest.fixture
def grown(spark, corpus, tmp_path):
    """An index of 200 documents in two batches."""
    texts = {i: f"w{i % 17} w{i % 5} common" for i in range(200)}
    docs = corpus([texts[i] for i in range(200)])
    tables = write_index(spark, docs.where("doc_id < 100"), str(tmp_path / "i"), AN)
    return write_index(spark, docs.where("doc_id >= 100"), tables.path, AN)


def test_forward_rows_equal_the_postings(spark, grown):
    forward = grown._read("forward", "BIGINT").select("doc_id", F.inline("terms"))
    assert rows(forward, "doc_id", "token", "tf") == rows(grown.log(), "doc_id", "token", "tf")
    files = grown._read("forward", "BIGINT").groupBy(F.input_file_name().alias("f"))
    assert files.agg(F.count_distinct("doc_bucket").alias("n")).where("n > 1").count() == 0


def test_an_upsert_reads_the_buckets_of_its_documents(spark, corpus, grown):
    key, seen = grown.key_type, {}
    inner = IndexTables._changes

    def kept(self, before, batch_id, key):
        seen["changes"] = inner(self, before, batch_id, key)
        return seen["changes"]

    IndexTables._changes = kept
    try:
        grown.write_batch(corpus({7: "w3 fresh", 1007: "w3"}), 2, AN, replace=True)
    finally:
        IndexTables._changes = inner
    changes, added, with_tokens = seen["changes"]
    assert (added, with_tokens) == (1, 1)
    filters = [x.split("PartitionFilters")[1] for x in scans(changes, "forward")]
    # The batch's own rows, and those of the same buckets of earlier batches.
    assert sorted("doc_bucket" in f.split("PushedFilters")[0] for f in filters) == [False, True]
    assert not scans(changes, "term_freq")
    buckets = {int(f.split("doc_bucket=")[1].split("/")[0]) for f in changes.inputFiles() if "forward" in f}
    wanted = spark.createDataFrame([(7,), (1007,)], "doc_id long").select(
        index_tables.doc_bucket(F.col("doc_id"), 16).alias("b")
    )
    assert set(grown._buckets_of(2)) == {r.b for r in wanted.collect()} <= buckets
    fresh = document_frequency(grown.postings())
    assert rows(grown.frequencies(), "token", "df") == rows(fresh, "token", "df")
    assert grown.n_docs() == 201 and key == "bigint"


def test_one_document_takes_few_jobs(spark, grown):
    index = TermIndex.open(spark, grown.path, analyzer=AN)
    assert jobs_of(spark, lambda: index.update(5, "w3 other")) <= 24
    opened = []
    assert jobs_of(spark, lambda: opened.append(TermIndex.open(spark, grown.path, analyzer=AN))) <= 1
    assert jobs_of(spark, lambda: opened.append(opened[0].search("w3"))) <= 1


def test_a_snapshot_stays(spark, corpus, grown):
    now = grown.snapshot()
    before = rows(now.postings(), "doc_id", "token", "tf")
    grown.write_batch(corpus({3: "other"}), 2, AN, replace=True)
    assert rows(now.postings(), "doc_id", "token", "tf") == before and now.n_docs() == 200
    assert rows(grown.postings(), "doc_id", "token", "tf") != before


def test_batch_search_reads_the_buckets_of_its_tokens(spark, corpus, tmp_path):
    docs = corpus([f"w{i % 40} x{i}" for i in range(120)])
    path = write_index(spark, docs, str(tmp_path / "i"), AN).path
    index = TermIndex.open(spark, path, analyzer=AN)
    asked = spark.createDataFrame([(1, "w3", 200)], "query_id long, search string, top_n int")
    found = index.search_batch(asked)
    assert [r.doc_id for r in found.orderBy("rank").collect()] == [3, 43, 83]
    for table in ("term_freq", "token_df"):
        listed = scans(found, table)
        assert listed and all("token_bucket" in x.split("PartitionFilters")[1] for x in listed)
    one = index.snapshot.postings(tokens=["3"])
    assert len(one.select(F.input_file_name()).distinct().collect()) == 1
    assert len(read_index(spark, path).log().inputFiles()) > 8


def test_long_texts_make_several_rows(spark, corpus, tmp_path, monkeypatch):
    monkeypatch.setattr(index_tables, "FORWARD_CHARS", 50)
    words = " ".join(f"word{i}" for i in range(60))
    sent = spark.createDataFrame([(0, 1, words), (1, 1, "aa"), (1, 2, "bb " + words)], "doc_id long, seq long, text string")
    for i, docs in enumerate((sent, sent.where("seq = 1").drop("seq"))):
        tables = write_index(spark, docs, str(tmp_path / f"i{i}"), AN)
        sizes = {r.doc_id: r.n for r in tables._read("forward", "BIGINT").groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
        assert sizes[0] > 3
        fresh = document_frequency(tables.postings())
        assert rows(tables.frequencies(), "token", "df") == rows(fresh, "token", "df")
        tables.write_batch(corpus({0: "word1 new"}), 1, AN, replace=True)
        fresh = document_frequency(tables.postings())
        assert rows(tables.frequencies(), "token", "df") == rows(fresh, "token", "df")
        compact = tables.compact(str(tmp_path / f"c{i}"))
        forward = compact._read("forward", "BIGINT").select("doc_id", F.inline("terms"))
        assert rows(forward, "doc_id", "token") == rows(tables.postings(), "doc_id", "token")


def test_buckets_follow_the_size(spark, corpus, tmp_path, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    assert index_tables.buckets_for(docs) == index_tables.TOKEN_BUCKETS
    monkeypatch.setattr(index_tables, "BUCKET_BYTES", 10_000)
    assert 20 < index_tables.buckets_for(docs) <= index_tables.MOST_BUCKETS
    tables = write_index(spark, corpus(["aa", "bb"]), str(tmp_path / "i"), AN, buckets=3)
    tables.write_batch(corpus({5: "cc"}), 1, AN)
    assert {row["buckets"] for row in tables.commits()} == {3}


def test_only_a_missing_folder_is_no_index(spark, tmp_path):
    from pyspark.errors import AnalysisException

    tables = IndexTables(spark, str(tmp_path / "none"))
    assert tables.commits() == [] and tables.n_docs() == 0
    (tmp_path / "bad" / "commits").mkdir(parents=True)
    (tmp_path / "bad" / "commits" / "x.parquet").write_text("not parquet")
    with pytest.raises(Exception) as raised:
        IndexTables(spark, str(tmp_path / "bad")).commits()
    assert not isinstance(raised.value, AnalysisException) or "PATH_NOT_FOUND" not in str(raised.value)
