import pytest
from pyspark.sql import functions as F

from textlode import Analyzer, TermIndex
from textlode.operators import blockmax
from textlode.operators.statistics import document_frequency, term_frequency
from textlode.sources import index_tables
from textlode.sources.index_tables import write_index

AN = Analyzer(gram_sizes=())
WORDS = ("apple", "birch", "cedar", "dogwood", "elm", "fir")


def rows(df):
    return sorted(tuple(r) for r in df.select("query_id", "rank", "doc_id", "score").collect())


@pytest.fixture(scope="module")
def docs(spark):
    """400 texts of very unlike lengths, many of them equal."""
    word = F.element_at(F.array(*map(F.lit, WORDS)), F.pmod(F.xxhash64("id", "i"), F.lit(6)).cast("int") + 1)
    return (
        spark.range(400).withColumn("i", F.explode(F.sequence(F.lit(1), F.pmod("id", F.lit(97)) + 1)))
        .withColumn("w", F.when(F.col("i") > 1, F.concat(word, F.pmod("id", F.lit(3)))).otherwise(word))
        .groupBy(F.col("id").alias("doc_id"))
        .agg(F.array_join(F.sort_array(F.collect_list("w")), " ").alias("text"))
    )


@pytest.fixture(scope="module")
def requests(spark):
    sent = [(1, "apple birch", 3), (2, "cedar fir elm", 25), (3, "nothing", 5), (4, "apple zzz", 5),
            (5, None, 5), (6, "", 5), (7, "elm", -2), (8, "dogwood elm", 4000), (9, "fir", None)]
    return spark.createDataFrame(sent, "query_id long, search string, top_n int")


@pytest.mark.parametrize(("heavy", "mode"), [(1, "float"), (64, "pruned"), (10_000, "float")])
def test_blocks_give_the_ranking(spark, docs, requests, tmp_path, monkeypatch, heavy, mode):
    monkeypatch.setattr(index_tables, "HEAVY_DF", heavy)
    path = str(tmp_path / "i")
    for half in (0, 1):
        write_index(spark, docs.where(F.col("doc_id") % 2 == half), path, AN, buckets=2, blocks=True)
    index = TermIndex.open(spark, path, mode, AN)
    found = index.search_blocks(requests)
    assert rows(found.results) == rows(index.search_batch(requests))
    report = {r["query_id"]: r for r in found.report.collect()}
    assert all(r["postings_read"] <= r["postings"] for r in report.values())


def test_blocks_are_left_out(spark, tmp_path):
    """One long document has the best score of a frequent token; short ones cannot reach it."""
    texts = [(i, "apple " + "birch " * (i % 3)) for i in range(300)] + [(300, "apple " * 500), (301, "fir")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    path = str(tmp_path / "i")
    write_index(spark, docs, path, AN, buckets=2, blocks=True)
    index = TermIndex.open(spark, path, analyzer=AN)
    ask = spark.createDataFrame([(1, "apple", 1)], "query_id long, search string, top_n int")
    found = index.search_blocks(ask)
    assert [r["doc_id"] for r in found.results.collect()] == [300]
    row = found.report.head()
    assert (row["postings"], row["postings_read"], row["blocks_read"]) == (301, 1, 1)


def test_ties_keep_the_smallest_key(spark, tmp_path):
    texts = [(i, "elm fir") for i in range(90, 0, -1)] + [(0, "x")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    path = str(tmp_path / "i")
    write_index(spark, docs, path, AN, buckets=8, blocks=True)
    ask = spark.createDataFrame([(1, "fir", 4)], "query_id long, search string, top_n int")
    found = TermIndex.open(spark, path, analyzer=AN).search_blocks(ask).results
    assert [r["doc_id"] for r in found.orderBy("rank").collect()] == [1, 2, 3, 4]


def test_views_without_blocks(spark, docs, requests, tmp_path):
    """A document sent again may lie in two blocks: only a compacted folder has bounds then."""
    plain = write_index(spark, docs, str(tmp_path / "plain"), AN, buckets=2)
    with pytest.raises(ValueError):
        TermIndex.open(spark, plain.path, analyzer=AN).search_blocks(requests)
    path = str(tmp_path / "i")
    write_index(spark, docs, path, AN, buckets=2, blocks=True)
    index = TermIndex.open(spark, path, analyzer=AN).update(5, "apple " * 40)
    with pytest.raises(ValueError):
        index.search_blocks(requests)
    compact = index.tables.compact(str(tmp_path / "c"))
    again = TermIndex.open(spark, compact.path, analyzer=AN)
    assert rows(again.search_blocks(requests).results) == rows(index.search_batch(requests))


def test_empty_tables(spark, docs, requests, tmp_path):
    path = str(tmp_path / "i")
    write_index(spark, docs.limit(0), path, AN, buckets=2, blocks=True)
    empty = TermIndex.open(spark, path, analyzer=AN).search_blocks(requests)
    assert empty.results.count() == 0 and empty.report.count() == 0
    write_index(spark, docs, path, AN)
    index = TermIndex.open(spark, path, analyzer=AN)
    assert index.search_blocks(requests.limit(0)).results.count() == 0
    assert rows(index.search_blocks(requests).results) == rows(index.search_batch(requests))


def test_shuffled_cells(spark, docs, requests, tmp_path):
    path = str(tmp_path / "i")
    write_index(spark, docs, path, AN, buckets=2, blocks=True)
    index = TermIndex.open(spark, path, analyzer=AN)
    now, postings = index.snapshot, index.postings
    terms = (
        postings.select("token").distinct().join(index.stats, "token").where("idf > 0")
        .select(F.lit(1).cast("long").alias("query_id"), "token", "idf")
    )
    ask = spark.createDataFrame([(1, 7)], "query_id long, top_n int")
    listed, every = terms.select("token"), range(2)
    few, many = (
        blockmax.search_blocks(now.block_postings(every), now.block_maxima(listed, every), terms, ask, n)
        for n in (0, 1_000)
    )
    assert rows(few.results) == rows(many.results) and few.results.count() == 7


def test_a_folder_with_blocks_stores_tokens_once(spark, tmp_path):
    """Its copy by document holds words; upserts make their n-grams from there."""
    texts = [(1, "banana bandana"), (2, "bananas rust"), (3, ""), (4, "rusty")]
    schema, analyzer = "doc_id long, text string", Analyzer()
    docs = spark.createDataFrame(texts, schema)
    tables = write_index(spark, docs, str(tmp_path / "i"), analyzer, blocks=True)
    words = analyzer.words(docs, "doc_id").distinct().count()
    forward = tables._batch("forward", "bigint", 0)
    assert forward.select(F.explode("terms")).count() == words < tables.log().count()

    def agrees(tables, docs):
        wanted = term_frequency(docs, analyzer)
        for found, expected, columns in (
            (tables.postings(), wanted, ["doc_id", "token", "tf"]),
            (tables.frequencies(), document_frequency(wanted), ["token", "df"]),
        ):
            assert sorted(map(tuple, found.select(columns).collect())) == sorted(
                map(tuple, expected.select(columns).collect())
            )

    agrees(tables, docs)
    more = spark.createDataFrame([(5, "ananas rust")], schema)
    write_index(spark, more, tables.path, analyzer)
    agrees(tables, docs.unionByName(more))
    again = spark.createDataFrame([(4, "rusty zebra")], schema)
    write_index(spark, again, tables.path, analyzer)
    all_docs = docs.where("doc_id <> 4").unionByName(more).unionByName(again)
    agrees(tables, all_docs)
    agrees(tables.compact(str(tmp_path / "c")), all_docs)
