"""Folders that store words: their n-grams are made on reading, with the rows of stored tokens."""

import pytest
from pyspark.sql import functions as F

from textlode import Analyzer, TermIndex
from textlode.functions.porter2 import porter2_stems
from textlode.operators.statistics import document_frequency, term_frequency
from textlode.operators.upserts import in_order
from textlode.plans import sizing
from textlode.sources.index_tables import IndexTables, forward_rows, write_index

TEXTS = ["banana bandana banana", "bananas rust banana", "", "rusty trusty bandanas "]


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def agrees(tables, docs, analyzer):
    postings = term_frequency(docs, analyzer)
    whole = rows(postings, "doc_id", "token", "tf")
    assert rows(tables.postings(), "doc_id", "token", "tf") == whole != []
    df = rows(document_frequency(postings), "token", "df")
    assert rows(tables.frequencies(), "token", "df") == df
    some = ["ANA", "NAN", "BANAN", "RUST", "none"]
    assert rows(tables.postings(tokens=some), "doc_id", "token", "tf") == [
        r for r in whole if r[1] in some
    ]


@pytest.mark.parametrize("analyzer", [Analyzer(), Analyzer(mode="bytes"), Analyzer(vocabulary_stemmer=porter2_stems)])
def test_words_are_stored_and_tokens_read(spark, corpus, tmp_path, analyzer):
    docs = corpus(TEXTS)
    tables = write_index(spark, docs, str(tmp_path / "i"), analyzer)
    agrees(tables, docs, analyzer)
    words = analyzer.words(docs, "doc_id").distinct().count()
    assert tables.log().count() == words < tables.postings().count()


def test_batches_and_compaction(spark, corpus, tmp_path):
    docs = corpus(TEXTS)
    tables = write_index(spark, docs.where("doc_id < 2"), str(tmp_path / "i"), Analyzer())
    write_index(spark, docs.where("doc_id >= 2"), tables.path, Analyzer())
    agrees(tables, docs, Analyzer())
    compact = tables.compact(str(tmp_path / "c"))
    agrees(compact, docs, Analyzer())
    assert compact.log().count() == tables.log().count() and compact.n_docs() == 4
    compact.refresh_stats()
    agrees(compact, docs, Analyzer())


@pytest.mark.parametrize("replace", [False, True])
def test_documents_sent_again(spark, corpus, tmp_path, replace):
    """By batches of words, of rows with an order, and of other n-grams."""
    tables = write_index(spark, corpus(TEXTS), str(tmp_path / "i"), Analyzer())
    expected = {(r[0], r[1]): r[2] for r in rows(tables.postings(), "doc_id", "token", "tf")}

    def sent(texts, analyzer, seq=None):
        docs = corpus(texts)
        batch = docs.withColumn("seq", F.lit(seq).cast("long")) if seq else docs
        tables.write_batch(batch, tables.next_batch(), analyzer, replace=replace)
        if replace:
            for key in [k for k in expected if k[0] in texts]:
                del expected[key]
        expected.update({(r[0], r[1]): r[2] for r in rows(term_frequency(docs, analyzer), "doc_id", "token", "tf")})
        found = rows(tables.postings(), "doc_id", "token", "tf")
        assert found == sorted((*k, v) for k, v in expected.items())
        fresh = document_frequency(tables.postings())
        assert rows(tables.frequencies(), "token", "df") == rows(fresh, "token", "df")

    sent({0: "banal bananas", 9: "rust"}, Analyzer())
    sent({0: "cabana", 1: "rusting"}, Analyzer(), seq=7)
    sent({3: "trust"}, Analyzer(gram_sizes=(2,)))
    compact = tables.compact(str(tmp_path / "c"))
    assert rows(compact.postings(), "doc_id", "token", "tf") == rows(tables.postings(), "doc_id", "token", "tf")


def test_searches_agree(spark, corpus, tmp_path):
    docs = corpus(TEXTS * 3)
    asked = spark.createDataFrame([(1, "banana rust", 5), (2, "trusty", 0)], "query_id long, search string, top_n int")
    path = write_index(spark, docs, str(tmp_path / "i"), Analyzer()).path
    for mode in ("float", "pruned"):
        index, fresh = TermIndex.open(spark, path, mode), TermIndex.from_documents(docs, mode)
        assert index.search("banana trust").collect() == fresh.search("banana trust").collect()
        for width in ({}, {"max_rows": 0}):
            found = index.search_batch(asked, **width)
            assert sorted(found.collect()) == sorted(fresh.search_batch(asked).collect()) != []


def test_a_task_analyses_little(spark, tmp_path):
    """A task of 64 MB of files held some gigabytes of counted n-grams."""
    text = F.concat_ws(" ", *(F.sha2((F.col("id") * 40 + i).cast("string"), 512) for i in range(40)))
    spark.range(16_000).select(F.col("id").alias("doc_id"), text.alias("text")).write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    assert sizing.input_bytes(docs) > 32 * 1024 * 1024
    assert sizing.spread_width(docs) >= sizing.input_bytes(docs) / (2 * 1024 * 1024)


def test_tokens_of_all_texts_are_made_of_different_words(corpus):
    """n-grams are made of counted words, not of every occurrence."""
    docs = corpus(["abcdef abcdef abcd. ", "ABCDEF running", None, ""])
    for analyzer in (Analyzer(), Analyzer(vocabulary_stemmer=porter2_stems), Analyzer(mode="bytes")):
        plain = analyzer.tokens(docs, "doc_id").groupBy("token").count().collect()
        found = analyzer.counted_tokens(docs)
        assert {r["token"]: r["n"] for r in found.collect()} == {r["token"]: r["count"] for r in plain}
        scans = found._jdf.queryExecution().optimizedPlan().collectLeaves().mkString()
        assert "text" not in scans and "word" in scans


def test_no_posting_is_shuffled_to_read_or_merge_a_folder(spark, corpus, tmp_path, monkeypatch):
    monkeypatch.setattr("textlode.operators.upserts.LOG_FILE_BYTES", 0)
    docs = corpus({i: TEXTS[i % 4] + str(i) for i in range(12)})
    tables = write_index(spark, docs, str(tmp_path / "i"), Analyzer())
    index = TermIndex.open(spark, tables.path).update(3, "rust bandana")
    plan = index.postings._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1 and "MapInArrow" in plan
    wanted = TermIndex.from_documents(docs).bulk_update(corpus({3: "rust bandana"})).postings
    assert rows(index.postings, "doc_id", "token", "tf") == rows(wanted, "doc_id", "token", "tf")


def test_texts_are_shuffled_to_upsert_them_and_no_posting(spark, corpus, monkeypatch):
    monkeypatch.setattr("textlode.operators.upserts.LOG_FILE_BYTES", 0)
    monkeypatch.setattr(sizing, "TEXT_PARTITION_BYTES", 16)
    docs, more = corpus(TEXTS * 3), corpus({1: "rust", 99: "banana"})
    updated = TermIndex.from_documents(docs).bulk_update(more)
    plan = updated.postings._jdf.queryExecution().executedPlan().toString()
    dealt = [line for line in plan.splitlines() if "hashpartitioning" in line]
    assert len(dealt) == 2 and all("hashpartitioning(doc_id" in x and "token" not in x for x in dealt)
    log = term_frequency(docs.where("doc_id NOT IN (1, 99)").unionByName(more), Analyzer())
    stale = term_frequency(docs.where("doc_id = 1"), Analyzer()).join(log, ["doc_id", "token"], "left_anti")
    wanted = log.unionByName(stale)
    assert rows(updated.postings, "doc_id", "token", "tf") == rows(wanted, "doc_id", "token", "tf")


def test_stemmed_words_are_shuffled_once(spark, corpus):
    """To the tasks of their documents, from where they are written."""
    docs = in_order(corpus(TEXTS), unique=True)
    rows_of = forward_rows(docs, Analyzer(vocabulary_stemmer=porter2_stems), False, 16, words=True)
    plan = rows_of._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") - plan.count("BroadcastExchange ") == 1


def test_words_left_by_a_stopword_table_are_found_once(spark, corpus, tmp_path):
    listed = spark.createDataFrame([("RUST",), ("",)], "word string")
    analyzer, seen = Analyzer(stopwords=listed), []
    spied = Analyzer(stopwords=listed, tokenizer=lambda text: seen.append(1) or analyzer.tokenize(text))
    docs = corpus(["rust banana", "rust ", "", None])
    tables = write_index(spark, docs, str(tmp_path / "i"), spied)
    assert rows(tables.documents(), "doc_id", "has_tokens") == [(0, True), (1, False), (2, False)]
    assert len(seen) == 1
